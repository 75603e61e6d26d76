"""Several values packed in one string field, one row per value with its position.

The field is split on quote characters: odd pieces are literals, even pieces are cut at delimiters. Array
folds then put values together again: a literal glued to plain text, a name with its surname first, an
organisation followed by its place, and (for labels) a compound that stands as one value elsewhere in the
column. All of it is built-in expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Private-use characters stand for what has been recognised; texts that hold them already lose them.
QUOTE, HARD, COMMA, OPEN, CLOSE = (chr(0xE000 + k) for k in range(5))
_OWN = f"[{QUOTE}-{CLOSE}]"


@dataclass(frozen=True)
class Notation:
    """How a field separates its values. hard: always separates. commas: separate too; with names they may
    stand within one value. words: separate between blanks, as in names."""

    hard: str = r"[;|/\t\n\r·•、]"
    words: str = ""
    names: bool = False


AUTHORS = Notation(words=r"(?:[,;]?\s+(?:and|AND|&)\s+)", names=True)
LABELS = Notation()


def _marked(field: Column, n: Notation) -> Column:
    """The field with delimiters outside quotes and literals replaced by marks."""
    s = F.regexp_replace(field, _OWN, "")
    s = F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))
    # brackets or braces around the whole list
    s = F.regexp_replace(s, r"(?s)^\[(.*)\]$|^\{(.*)\}$", "$1$2")
    s = F.replace(F.replace(s, F.lit('\\"'), F.lit(QUOTE)), F.lit('""'), F.lit(QUOTE))
    pieces = F.split(s, '"')

    def literal(x: Column) -> Column:
        # what JSON escapes is undone by the JSON reader; anything else stays as it is
        undone = F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>")
        return F.when(F.contains(x, F.lit("\\")), F.coalesce(undone.getItem(0), x)).otherwise(x)

    def plain(x: Column) -> Column:
        if n.words:
            x = F.regexp_replace(x, n.words, HARD)
        return F.regexp_replace(F.regexp_replace(x, n.hard, HARD), ",", COMMA)

    marked = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit(OPEN), literal(x), F.lit(CLOSE))).otherwise(plain(x)))
    return F.array_join(marked, "")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def _unquote(c: Column) -> Column:
    """Marks of a literal go if it is the whole value, and are quotes again within one."""
    whole = F.regexp_extract(c, f"(?s)^{OPEN}([^{OPEN}{CLOSE}]*){CLOSE}$", 1)
    value = F.when(c.rlike(f"(?s)^{OPEN}[^{OPEN}{CLOSE}]*{CLOSE}$"), whole).otherwise(F.regexp_replace(c, f"[{OPEN}{CLOSE}]", '"'))
    return _strip(F.when(value == QUOTE, F.lit("")).otherwise(F.replace(value, F.lit(QUOTE), F.lit('"'))))


def _fold_commas(segment: Column, n: Notation) -> Column:
    """Pieces between commas, with those joined again that are one value."""
    pieces = F.filter(F.transform(F.split(segment, COMMA), _strip), lambda x: x != "")
    if not n.names:
        return pieces
    single = r"^[^\s]+$"
    initials = r"^\p{Lu}\.?(?:[\s-]*\p{Lu}\.?){0,3}$"

    def join(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        plain = ~F.contains(piece, F.lit(OPEN)) & ~F.contains(last, F.lit(OPEN)) & ~F.contains(last, F.lit(", "))
        one = plain & (last.rlike(single) | piece.rlike(single) | piece.rlike(initials))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(", "), piece)))
        # slice() of no elements is evaluated too, so an empty list takes the first branch
        return F.when((F.size(done) > 0) & one, joined).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, F.array().cast("array<string>"), lambda done, x: F.when(F.size(done) == 0, F.array(x)).otherwise(join(done, x)))


def values(field: Column, n: Notation, compounds: Column | None = None) -> Column:
    """array<string> of the field's values in order. Null or empty gives an empty array.

    compounds: unquoted stretches of this field, delimiters included, that are one value.
    """
    marked = _marked(F.coalesce(field, F.lit("")), n)
    if compounds is not None:
        guard = lambda c: F.concat(F.lit(OPEN), c, F.lit(CLOSE))
        longest = F.array_sort(compounds, lambda a, b: F.length(b) - F.length(a))
        marked = F.aggregate(longest, marked, lambda t, c: F.replace(t, _as_marked(c, n), guard(c)))
    parts = F.flatten(F.transform(F.split(marked, HARD), lambda seg: _fold_commas(seg, n)))
    return F.filter(F.transform(parts, _unquote), lambda x: x != "")


def _as_marked(c: Column, n: Notation) -> Column:
    return F.regexp_replace(F.regexp_replace(c, n.hard, HARD), ",", COMMA)


_CUT = r"(?<=[;|/\t\n\r·•、,])|(?=[;|/\t\n\r·•、,])"


def known_compounds(df: DataFrame, field: str) -> DataFrame:
    """Distinct quoted values of the column that hold a delimiter: what stands as one value somewhere."""
    marked = _marked(F.col(field), LABELS)
    literals = F.regexp_extract_all(marked, F.lit(f"(?s){OPEN}([^{OPEN}{CLOSE}]*){CLOSE}"), 1)
    one = df.select(F.explode(literals).alias("v")).select(_strip(F.replace(F.col("v"), F.lit(QUOTE), F.lit('"'))).alias("compound"))
    return one.where(F.col("compound").rlike(r"[;|/\t\n\r·•、,]")).distinct()


def _runs(field: Column, pieces: list[int]) -> Column:
    """Unquoted stretches of so many neighbouring pieces as are given, with the delimiters between them."""
    plain = F.regexp_replace(_marked(field, LABELS), f"(?s){OPEN}[^{OPEN}{CLOSE}]*{CLOSE}", OPEN)
    # the marked text has lost which delimiter stood where; cut the raw text at quotes instead
    raw = F.regexp_replace(F.regexp_replace(field, r'\\"|""', QUOTE), r'(?s)"[^"]*"', OPEN)
    raw = F.when(F.contains(plain, F.lit(OPEN)), raw).otherwise(field)
    raw = F.regexp_replace(raw, r"(?s)^\s*[\[{](.*)[\]}]\s*$", "$1")
    stretches = F.split(raw, OPEN)
    def of(stretch: Column) -> Column:
        atoms = F.split(stretch, _CUT)
        lengths = F.array(*[F.lit(2 * k - 1) for k in pieces])
        starts = F.sequence(F.lit(1), F.size(atoms))
        return F.flatten(F.transform(starts, lambda i: F.transform(
            F.filter(lengths, lambda k: i + k - 1 <= F.size(atoms)), lambda k: _strip(F.array_join(F.slice(atoms, i, k), "")))))

    return F.array_distinct(F.filter(F.flatten(F.transform(stretches, of)), lambda x: x.rlike(r"[;|/\t\n\r·•、,]")))


def explode_field(df: DataFrame, key: str, field: str, n: Notation, compounds: bool = False) -> DataFrame:
    """(key, pos INT from 1, item_value): one row per value of each distinct (key, field).

    Null or empty fields give no rows; repeated rows give their values once; other columns are not read.
    With compounds, unquoted stretches that the column holds elsewhere as one quoted value stay whole; the
    stretches are matched by a join on their text, whose small side AQE may broadcast by its measured size.
    """
    rows = df.select(F.col(key).alias("k"), F.col(field).alias("f")).where(F.length(F.trim("f")) > 0).distinct()
    found = F.lit(None).cast("array<string>")
    if compounds:
        whole = known_compounds(df, field)
        # how many pieces they have: a few numbers, whatever the rows
        pieces = sorted(r[0] for r in whole.select(((F.size(F.split("compound", _CUT)) + 1) / 2).cast("int")).distinct().collect())
        runs = rows.where(F.col("f").rlike(r"[;|/\t\n\r·•、,]")).select("k", "f", F.explode(_runs(F.col("f"), pieces or [2])).alias("compound"))
        hits = runs.join(whole, "compound", "left_semi").groupBy(F.col("k").alias("hk"), F.col("f").alias("hf")).agg(F.collect_set("compound").alias("whole"))
        rows = rows.join(hits, F.col("k").eqNullSafe(F.col("hk")) & (F.col("f") == F.col("hf")), "left").select("k", "f", "whole")
        found = F.coalesce(F.col("whole"), F.array().cast("array<string>"))
    got = values(F.col("f"), n, found if compounds else None)
    return rows.select(F.col("k").alias(key), F.posexplode(got).alias("p", "item_value")).select(key, (F.col("p") + 1).cast("int").alias("pos"), "item_value").distinct()
