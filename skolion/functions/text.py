"""Scalar text functions as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the engine splits on it: also no-break and typographic blanks, in a form Java and RE2 both read.
BLANK = r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+"
# Words that title queries drop, and words that say nothing about a text's content.
TITLE_STOP = "for with via the a of on in to and under".split()
CONTENT_STOP = "the a an of to in for and or on with from by as is are be this that we our it its using use used can will into over under across".split()
# Instructions planted in passages.
INJECTIONS = (
    r"ignore (all|any|previous|prior) (instructions|prompts)", r"disregard (the|all|previous)", r"system\s*:", r"you are now",
    r"send (your|the) (password|credentials|api key)", r"email .*@", r"(visit|click|go to) https?://", r"do not cite",
)


def _c(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without outer white space. It takes one argument: transform() would pass a second one to F.trim."""
    return F.regexp_replace(c, f"^{BLANK}|{BLANK}$", "")


def words(c: Column | str) -> Column:
    """Pieces between white space; none for null or empty texts."""
    return F.filter(F.split(_c(c), BLANK), lambda w: w != "")


def bm25_tokens(c: Column | str) -> Column:
    """Lower-case words that are all letters and digits or hold a hyphen; others are dropped, not stripped."""
    return F.filter(F.split(F.lower(_c(c)), BLANK), lambda w: w.rlike(r"^[\p{L}\p{N}]+$") | F.contains(w, F.lit("-")))


def term_tokens(c: Column | str) -> Column:
    """Lower-case runs of at least two letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def title_query(c: Column | str) -> Column:
    """A title without its connecting words."""
    stop = F.array(*[F.lit(w) for w in TITLE_STOP])
    return F.array_join(F.filter(words(F.lower(_c(c))), lambda w: ~F.array_contains(stop, w)), " ")


def listed(c: Column | str) -> Column:
    """Trimmed parts between commas, without empty ones."""
    return F.filter(F.transform(F.split(_c(c), ","), stripped), lambda w: w != "")


def normalised(c: Column | str) -> Column:
    """Runs of blanks and tabs as one blank, runs of line feeds as one, no outer white space."""
    s = F.regexp_replace(F.regexp_replace(_c(c), r"[ \t]+", " "), r"\n{2,}", "\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(_c(c), 256), 1, 16)


def token_count(c: Column | str) -> Column:
    return F.size(words(c))


def page_range(start: Column | str, end: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.when(a == b, F.concat(F.lit("p."), a.cast("string"))).otherwise(F.concat(F.lit("pp."), a.cast("string"), F.lit("-"), b.cast("string")))


def snippet(c: Column | str, size: int = 280) -> Column:
    s = _c(c)
    return F.when(F.char_length(s) > size, F.concat(F.substring(s, 1, size), F.lit("…"))).otherwise(s)


def paper_ids(c: Column | str) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(r"\b(\d{4}\.\d{4,5})(?:v\d+)?\b"), 1)


def without_version(c: Column | str) -> Column:
    return F.substring_index(_c(c), "v", 1)


def _pieces(c: Column | str) -> Column:
    return F.transform(F.split(F.replace(_c(c), F.lit("\n"), F.lit(" ")), r"(?<=[.!?])\s+"), stripped)


def boilerplate(s: Column) -> Column:
    """Addresses, links, very short sentences and lists of names."""
    w = words(s)
    capital = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    return F.contains(s, F.lit("@")) | s.rlike("https?://") | (F.size(w) < 4) | (capital / F.size(w) > 0.6)


def answer_sentences(c: Column | str) -> Column:
    """Sentences of more than 25 characters that an answer may quote."""
    return F.filter(_pieces(c), lambda s: (F.char_length(s) > 25) & ~boilerplate(s))


def metric_sentences(c: Column | str) -> Column:
    """Sentences of more than 20 characters without citation marks around them."""
    return F.transform(F.filter(_pieces(c), lambda s: F.char_length(s) > 20), lambda s: F.regexp_replace(s, r"^[ \[\]0-9]+|[ \[\]0-9]+$", ""))


def content_words(c: Column | str) -> Column:
    """Distinct words of content."""
    stop = F.array(*[F.lit(w) for w in CONTENT_STOP])
    found = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"([a-z][a-z0-9-]+)"), 1)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def injected(c: Column | str) -> Column:
    return _c(c).rlike("(?i)" + "|".join(INJECTIONS))


#: Fixed value: the namespace of point ids.
NAMESPACE = "12345678-1234-5678-1234-567812345678"


def point_id(c: Column | str, namespace: str = NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a string, null for null."""
    name = F.col(c) if isinstance(c, str) else c
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def hash_bucket(word: Column, size: int = 384) -> Column:
    """The word's md5 as a 128-bit number modulo size."""
    half = lambda at: F.conv(F.substring(F.md5(word), at, 16), 16, 10).cast("decimal(20,0)")
    carry = (1 << 64) % size
    return (((half(1) % size) * carry + half(17) % size) % size).cast("int")
