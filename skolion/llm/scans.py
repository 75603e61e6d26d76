"""Noise in text from scanned pages, and its repair into continuous paragraphs.

Two readings of the texts. The first counts words; a rare word that turns into a much more frequent one when one
confusion of a scanner is undone is misrecognised. The second labels the lines of every page as header, body or
break with a linear-chain conditional random field over layout features (trained on pages into which running headers
and page numbers were put), and lists words and cuts that aren't clear by the known words alone. Only those are
joined with the counts of all words. Headers found on pages are carried over to chunks by their offsets; a chunk
without a place on a page is labelled itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread
from .filters import BITS, bit_filter, passing
from .filters import is_set as _set

if TYPE_CHECKING:
    import pandas as pd

# Fixed values: (printed, recognised) by scanners.
CONFUSIONS = (
    ("e", "c"), ("n", "ri"), ("s", "5"), ("S", "5"), ("i", "1"), ("l", "1"), ("I", "1"), ("I", "l"), ("a", "ä"), ("o", "0"), ("O", "0"), ("t", "†"), ("d", "cl"),
    ("u", "ii"), ("m", "rn"), ("g", "9"), ("h", "b"), ("b", "6"), ("f", "ſ"), ("s", "ſ"), ("y", "v"), ("w", "vv"), ("li", "h"), ("T", "7"), ("cl", "d"), ("B", "8"),
    ("rn", "m"), ("ri", "n"), ("c", "e"), ("q", "9"), ("Z", "2"), ("z", "2"),
)
#: Specks read as characters within words.
SPECKS = "`*¦°^~·"
HYPHENS = "-‐¬­–"

WORD = re.compile(r"[^\s.,;:()\[\]?!\"\-‐¬­–—]+")
#: A word is misrecognised if its correction is at least so many times as frequent, and occurs so often.
RATIO, LEAST = 4, 3
#: Known clean words that the second reading gets (about 20 MB in a worker): the vocabulary of the line model, and
#: words that need no join. What other words mean is looked up in the counts of all words.
KNOWN = 200_000
#: Pages that the line model is trained on.
SAMPLE = 400
BIN = 4096

_CUT = re.compile(rf"([^\W\d_]+)[{HYPHENS}][ \t]?\n[ \t]?([^\W\d_]+)")
# the same place only; it begins with one of few characters, which is found fast
_CUT_AT = re.compile(rf"[{HYPHENS}][ \t]?\n[ \t]?(?=[^\W\d_])")
_FIRST_LETTERS = re.compile(r"[^\W\d_]+")
_CUT_WHOLE = re.compile(_CUT.pattern + r"([^\s]*)[ \n]?")
_SPECK_AT = re.compile(rf"[{re.escape(SPECKS)}†ſ](?=[\w.,\-])")
_SPECK = re.compile(rf"(?<=[\w.,\-])[{re.escape(SPECKS)}†ſ](?=[\w.,\-])")
_NUMBER = re.compile(r"^[\W_]*(?:p(?:a[gq9][ec])?\.?\s*)?(?:[\dIl|]{1,5}|[ivxlc]{1,6})(?:\s*(?:of|/)\s*\d+)?[\W_]*$", re.IGNORECASE)
_CUE = re.compile(r"\bet al\b|\bVol\b|\bNo\. ?\d|[Pp]reprint|under review|\. \. \.|\b(?:19|20)\d\d$|^[^\W\d_]+: \S|^\d+ \D*$|\D \d{1,4}$")
_STRONG = re.compile(r"\bet al\b|, Vol\b|[Pp]reprint|under review|\. \. \.|^[^\W\d_]+: \S")
_NAMES = re.compile(r"^(?:[A-Z][\w'-]+ )+et al\.?$|^\d{1,4} [A-Z][\w'-]+ and [A-Z][\w'-]+$")
_HEADING = re.compile(r"^(?:\d{1,2}(?:\.\d+)*\.? )\s*[A-Z]")
_ITEM = re.compile(r"^\s*(?:\([a-z\d]{1,3}\)|[a-z\d]{1,2}[.)]|[-•*])\s")
_LETTERS = re.compile(r"[^\W\d_]+")
HEADER, BODY, BREAK = 0, 1, 2
#: Of the features, the first ones tell headers from text; all of them tell where a paragraph begins.
OF_HEADERS, FEATURES = 28, 33


# ---- words


def cuts(text: str) -> list[tuple[int, int]]:
    """(start, end) of every hyphen and line's end between two letters."""
    return [m.span() for m in _CUT_AT.finditer(text) if m.start() and text[m.start() - 1].isalpha()]


def specked(text: str) -> bool:
    """Whether a speck was read as a character within a word or number."""
    return any(m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_.,-") for m in _SPECK_AT.finditer(text))


def whole_words(text: str) -> list[str]:
    """Words of a text, those cut by a line's end joined; without a first or last one that the text itself may cut."""
    at, parts = 0, []
    for s, e in cuts(text):
        parts.append(text[at:s])
        at = e
    found = WORD.findall("".join([*parts, text[at:]]) if parts else text)
    if found and not text[:1].isupper():
        found = found[1:]
    if found and text.rstrip()[-1:] not in ".!?:;)\"'":
        found = found[:-1]
    return found


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n) over the whole of all texts; counted within tasks before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        seen: Counter = Counter()
        for b in batches:
            for t in b[column]:
                if t:
                    seen.update(whole_words(t))
            if len(seen) > 400_000:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        if seen:  # an empty frame has no types
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return texts.select(column).where(F.col(column).isNotNull()).mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# what a second misreading further on may have turned into: not a plain letter
_FURTHER = tuple((p, r) for p, r in CONFUSIONS if not (r.isascii() and r.isalpha() and len(r) == 1))
_NO_SPECKS = {ord(c): None for c in SPECKS}


def corrections(word: str) -> Iterator[str]:
    """Words that `word` may be a misreading of: specks dropped, then one confusion undone, and a further one."""
    bare = word.translate(_NO_SPECKS)
    if bare != word:
        yield bare
    for start in {word, bare}:
        for printed, read in CONFUSIONS:
            at = start.find(read)
            while at >= 0:
                one = start[:at] + printed + start[at + len(read) :]
                yield one
                # a second misreading further on
                for p2, r2 in _FURTHER:
                    again = one.find(r2, at + len(printed))
                    if again >= 0:
                        yield one[:again] + p2 + one[again + len(r2) :]
                at = start.find(read, at + 1)


def misread(counts: DataFrame) -> DataFrame:
    """(word, good): words with a correction that is RATIO times as frequent; the most frequent one, then the first.
    Corrections that surely are no word are dropped where they are made, by a filter of fixed size."""
    known = counts.select(F.col("word").alias("good"), F.col("n").alias("m")).where(F.col("m") >= LEAST)
    sent = counts.sparkSession.sparkContext.broadcast(bit_filter(known.select(F.xxhash64("good"))))

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd
        import xxhash

        bits, digest, mask = sent.value, xxhash.xxh64_intdigest, BITS - 1
        for b in batches:
            out = []
            for w, n in zip(b["word"], b["n"]):
                seen = {w}
                for g in corrections(w):
                    h = digest(g, 42)  # the same hash as the filter's; half of its test stands here for speed
                    a = h & mask
                    if bits[a >> 3] >> (a & 7) & 1 and g not in seen and _set(bits, h) and _LETTERS.search(g):
                        seen.add(g)
                        out.append((w, n, g))
            yield pd.DataFrame(out, columns=["word", "n", "good"])

    # short words of plain letters are left alone: too many of them turn into each other
    plain = F.col("word").rlike("^[A-Za-z]+$")
    tried = spread(counts.where((F.length("word") > F.when(plain, 3).otherwise(1)) & F.col("word").rlike(r"\p{L}"))).mapInPandas(propose, "word string, n bigint, good string")
    hits = tried.join(known, "good").where(F.col("m") >= RATIO * F.col("n"))
    return hits.groupBy("word").agg(F.min_by("good", F.struct(-F.col("m"), "good")).alias("good"))


def clean_words(counts: DataFrame, bad: DataFrame) -> DataFrame:
    """(word, n) of all known words: often enough, and not misread."""
    return counts.where(F.col("n") >= LEAST).join(bad, "word", "left_anti")


def known_words(clean: DataFrame, size: int = KNOWN) -> frozenset[str]:
    """The most frequent known words, of a bounded number."""
    return frozenset(clean.orderBy(F.desc("n"), "word").limit(size).toPandas()["word"])


def compounds(pairs: DataFrame, clean: DataFrame) -> DataFrame:
    """(a, b) of the pairs that are compounds wrapped at their own hyphen: both halves are known words, the whole
    isn't. Decided by the counts of all words, however rare."""
    word = lambda c: clean.select(F.col("word").alias(c))
    whole = pairs.select("a", "b", F.concat("a", "b").alias("ab")).distinct()
    return whole.join(word("a"), "a", "left_semi").join(word("b"), "b", "left_semi").join(word("ab"), "ab", "left_anti").select("a", "b")


# ---- lines


def _width(lines: list[str]) -> int:
    return sorted(map(len, lines))[(len(lines) * 3) // 4] if lines else 1


def features(lines: list[str], known: frozenset[str]) -> np.ndarray:
    """Layout features of every line of a page."""
    n, width = len(lines), max(20, _width(lines))
    x = np.zeros((n, FEATURES), np.float32)
    x[:, 0] = 1
    x[:, 16] = width < 140
    ends = [bool(s) and s.rstrip()[-1:] in ".!?:;\"')" for s in lines]
    titled = [bool(_HEADING.match(s)) and len(s) < 60 for s in lines]
    for i, s in enumerate(lines):
        rank = min(i, n - 1 - i)
        short = len(s) < 0.75 * width and len(s) < 110
        f = x[i]
        f[2], f[3], f[4], f[5] = rank == 0, rank == 1, short, len(s) < 0.4 * width
        f[6] = ends[i]
        first = s.lstrip()[:1]
        f[7] = first.islower()
        before = i > 0
        f[13] = before and not ends[i - 1] and not first.islower()
        f[14] = before and ends[i - 1] and len(lines[i - 1]) < 0.85 * width
        number = len(s) < 24 and bool(_NUMBER.match(s))
        f[15] = bool(_ITEM.match(s)) and not number
        f[17] = before and ends[i - 1]
        f[28] = before and titled[i - 1]
        f[29] = titled[i]
        f[30] = before and lines[i - 1].rstrip().endswith((".", "!", "?", ":")) and (len(lines[i - 1].rstrip()) < 0.85 * width or width > 140)
        f[31] = before and not ends[i - 1] and not titled[i - 1] and len(lines[i - 1]) >= 0.85 * width
        f[32] = not before and not first.islower()
        if not short and rank > 1:  # on a narrow page a running header is as long as any line
            continue
        words = _LETTERS.findall(s)
        f[1] = number
        f[8] = len(s) > 3 and s.upper() == s and bool(words)
        capital = [w for w in words if len(w) > 3]
        f[9] = bool(capital) and sum(w[0].isupper() for w in capital) >= 0.6 * len(capital)
        clean = bool(words) and sum(w.lower() in known or w in known for w in words) >= 0.99 * len(words)
        f[10] = clean
        # a line of text may end with a number by chance; one as long as others must show more
        f[11] = bool((_CUE if short else _STRONG).search(s))
        # a section's title is made of words that also stand within sentences; names of authors aren't
        f[12] = bool(_HEADING.match(s)) and bool(words) and sum(w.lower() in known for w in words) >= 0.6 * len(words)
        edge = rank <= 1
        # what a hyphen cuts goes on below
        f[18] = edge and (not ends[i] or f[8]) and not first.islower() and not f[12] and (number or s.rstrip()[-1:] not in HYPHENS)
        f[19] = edge and f[12]
        f[20] = edge and number
        f[21] = edge and f[11]
        f[22] = edge and not first.islower() and bool(_STRONG.search(s))
        f[23] = bool(_NAMES.match(s))
        f[24] = f[18] and (f[9] or f[8])
        f[25] = f[24] and i <= 1
        f[26] = f[24] and len(capital) >= 3
        f[27] = edge and short and not f[12] and bool(_HEADING.match(s))
        f[29] = f[29] and not f[27]
    return x


@dataclass(frozen=True)
class LineModel:
    """A linear-chain conditional random field. Body is the label that the others are scored against."""

    header: np.ndarray  # OF_HEADERS weights
    breaks: np.ndarray  # FEATURES weights
    moves: np.ndarray  # label x next label
    starts: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        e = np.zeros((len(x), 3))
        e[:, HEADER], e[:, BREAK] = x[:, :OF_HEADERS] @ self.header, x @ self.breaks
        return e

    def label(self, lines: list[str], known: frozenset[str], headers: set[int] | None = None) -> list[int]:
        """The most probable labels along the whole page; with headers, these lines are headers and no others are."""
        if not lines:
            return []
        e = self.scores(features(lines, known))
        if headers is not None:
            e[:, HEADER] = -1e4
            e[sorted(headers), HEADER] = 1e4
        moves, rows = self.moves.tolist(), e.tolist()
        score, back = [s + v for s, v in zip(self.starts.tolist(), rows[0])], []
        for row in rows[1:]:
            step, new = [], []
            for k in range(3):
                a, b, c = score[0] + moves[0][k], score[1] + moves[1][k], score[2] + moves[2][k]
                best = 0 if a >= b and a >= c else (1 if b >= c else 2)
                step.append(best)
                new.append((a, b, c)[best] + row[k])
            back.append(step)
            score = new
        at = max(range(3), key=lambda k: score[k])
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return out[::-1]


def _plain_labels(lines: list[str]) -> list[int]:
    """Body or break for the lines of a page without headers."""
    width, out = _width(lines), []
    for i, s in enumerate(lines):
        prior = lines[i - 1].rstrip() if i else ""
        fresh = prior.endswith((".", "!", "?", ":")) and (len(prior) < 0.85 * width or width > 140)
        new = _ITEM.match(s) or (_HEADING.match(s) and len(s) < 60) or (i == 0 and not s[:1].islower()) or fresh or (i and _HEADING.match(lines[i - 1]) and len(lines[i - 1]) < 60)
        out.append(BREAK if new else BODY)
    return out


def _invented_header(rng: np.random.Generator, words: list[str], page: int) -> str:
    """A running header, footer or page number as printers set them, from words of the corpus."""
    pick = lambda k: [words[j] for j in rng.integers(0, len(words), k)]
    title = " ".join(w.capitalize() if rng.random() < 0.8 else w for w in pick(int(rng.integers(1, 9))))
    name = "".join(pick(2))[:12].capitalize()
    other = "".join(pick(2))[:10].capitalize()
    kind = int(rng.integers(0, 12))
    if kind < 4:
        return ("{0}", "Page {0}", "- {0} -", "— {0} —", "[{0}]", "{0}.", "| {0}", "p. {0}", "Page {0} of 40", "{0} / 40", "Pagc {0}", ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[page % 9])[int(rng.integers(0, 12))].format(page)
    if kind == 4:
        return title[: int(rng.integers(12, 60))]
    if kind == 5:
        return title.upper()[: int(rng.integers(12, 60))]
    if kind == 6:
        return f"{name} et al."
    if kind == 7:
        return f"{page} {name} and {other}"
    if kind == 8:
        return f"{name}: {title}"[:48].upper()
    if kind == 9:
        return f"{title[:40]}, Vol. {page}" if rng.random() < 0.6 else f"{title[:40]} {int(rng.integers(1990, 2026))}"
    if kind == 10:
        return f"Preprint. Under review by {name}."
    return f"{title[:40]} . . . {page}"


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials."""
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit_chain(pages: list[tuple[np.ndarray, list[int]]], rounds: int = 200, rate: float = 0.1, penalty: float = 1e-5) -> LineModel:
    """Weights, moves and starts fitted together: the likelihood of whole pages' labels is climbed in steps scaled by
    each weight's own slopes, so that rare features are learned too; slopes come from forward and backward sums."""
    most, n = max(len(y) for _, y in pages), len(pages)
    x, y, real = np.zeros((n, most, FEATURES)), np.zeros((n, most, 3)), np.zeros((n, most), bool)
    for i, (f, labels) in enumerate(pages):
        x[i, : len(labels)], real[i, : len(labels)] = f, True
        y[i, np.arange(len(labels)), labels] = 1
    both = real[:, 1:] & real[:, :-1]
    seen = np.einsum("ntj,ntk,nt->jk", y[:, :-1], y[:, 1:], both)
    total = real.sum()
    model = LineModel(np.zeros(OF_HEADERS), np.zeros(FEATURES), np.zeros((3, 3)), np.zeros(3))
    weights = [model.header, model.breaks, model.moves, model.starts]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        e = np.zeros((n, most, 3))
        e[..., HEADER], e[..., BREAK] = x[..., :OF_HEADERS] @ model.header, x @ model.breaks
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = model.starts + e[:, 0]
        for t in range(1, most):
            ahead[:, t] = np.where(real[:, t, None], _sum(ahead[:, t - 1, :, None] + model.moves, 1) + e[:, t], ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            behind[:, t] = np.where(real[:, t + 1, None], _sum(model.moves + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        whole = _sum(ahead[:, -1], 1)
        p = np.exp(ahead + behind - whole[:, None, None]) * real[..., None]
        pairs = np.exp(ahead[:, :-1, :, None] + model.moves + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * both[..., None, None]
        off = (y - p) / total
        slopes = (
            np.einsum("ntf,nt->f", x[..., :OF_HEADERS], off[..., HEADER]) - penalty * model.header, np.einsum("ntf,nt->f", x, off[..., BREAK]) - penalty * model.breaks,
            (seen - pairs.sum((0, 1))) / total - penalty * model.moves, (y[:, 0] - p[:, 0]).sum(0) / total - penalty * model.starts,
        )
        mean, square = [0.9 * m + 0.1 * g for m, g in zip(mean, slopes)], [0.99 * q + 0.01 * g * g for q, g in zip(square, slopes)]
        weights = [w + rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-9) for w, m, q in zip(weights, mean, square)]
        model = LineModel(*weights)
    return model


def train(pages: list[str], known: frozenset[str], seed: int = 5) -> LineModel:
    """A model from pages without suspicious edge lines, with invented headers put into half of their versions."""
    rng = np.random.default_rng(seed)
    words = sorted(w for w in known if w.isalpha() and w.islower() and len(w) > 2)[:5000] or ["word", "page", "line"]
    found: list[tuple[np.ndarray, list[int]]] = []
    versions = 2 * max(1, -(-SAMPLE // max(1, len(pages))))  # few pages are used more often, with other headers
    for text in pages:
        lines = text.split("\n")
        # what looks like a header at the edges already is left out, as its label is unknown
        while lines and len(lines[0]) < 75 and (_NUMBER.match(lines[0]) or (lines[0].rstrip()[-1:] not in ".,;" and len(lines[0]) < 0.6 * _width(lines) and not _HEADING.match(lines[0])) or (_CUE.search(lines[0]) and not _HEADING.match(lines[0]))):
            lines = lines[1:]
        while lines and len(lines[-1]) < 75 and (_NUMBER.match(lines[-1]) or (lines[-1].rstrip()[-1:] not in ".,;" and len(lines[-1]) < 0.6 * _width(lines)) or (_CUE.search(lines[-1]) and lines[-1][:1].isupper())):
            lines = lines[:-1]
        if len(lines) < 2:
            continue
        for round_ in range(versions):
            own, y = list(lines), _plain_labels(lines)
            if rng.random() < 0.4:  # a page that ends, or begins, within a sentence
                words_ = own[-1].split(" ")
                own[-1] = " ".join(words_[: int(rng.integers(1, max(2, len(words_))))]).rstrip(".")
            if rng.random() < 0.3:
                words_ = own[0].split(" ")
                own[0] = " ".join(words_[int(rng.integers(0, len(words_))) :])
                y[0] = BODY if own[0][:1].islower() else y[0]
            if round_ % 2:
                page = int(rng.integers(1, 400))
                for _ in range(int(rng.integers(1, 3))):
                    own.insert(0, _invented_header(rng, words, page))
                    y.insert(0, HEADER)
                    if rng.random() < 0.5:
                        break
                if rng.random() < 0.5:
                    own.append(_invented_header(rng, words, page))
                    y.append(HEADER)
                if rng.random() < 0.3:
                    own, y = own[1:] + own[:1], y[1:] + y[:1]
            elif rng.random() < 0.4 and len(own) > 3:  # a page that begins or ends with a section's title
                at = 0 if rng.random() < 0.6 else len(own)
                k = int(rng.integers(2, 4))
                own.insert(at, f"{int(rng.integers(1, 10))} " + " and ".join(w.capitalize() for w in [words[j] for j in rng.integers(0, len(words), k)]))
                y.insert(at, BREAK)
            found.append((features(own, known), y))
    if not found:  # nothing to learn from: every line goes on
        return LineModel(np.full(OF_HEADERS, -1.0), np.full(FEATURES, -1.0), np.zeros((3, 3)), np.zeros(3))
    # long pages are fitted in parts, so that little is padded
    long = 80
    return fit_chain([(x[i : i + long], y[i : i + long]) for x, y in found for i in range(0, len(y), long)])


# ---- records


@dataclass(frozen=True)
class Reader:
    """What the second reading needs in every task."""

    model: LineModel
    known: frozenset[str]

    def cut_words(self, text: str) -> tuple[bool, list[tuple[str, str]]]:
        """Whether a word is surely cut by a line's end, and the halves of those that may be wrapped compounds."""
        sure, open_ = False, []
        for s, e in cuts(text):
            at = s
            while at and text[at - 1].isalpha():
                at -= 1
            a, b = text[at:s], _FIRST_LETTERS.match(text, e)[0]
            if a + b in self.known:
                sure = True
            else:
                open_.append((a, b))
        return sure, open_

    def suspicious(self, text: str) -> list[str]:
        return [w for w in set(whole_words(text)) - self.known if len(w) > 1]

    def headers(self, text: str, inner: bool = False) -> list[tuple[int, int]]:
        """(start, end) of every line labelled header; with inner, not of the first and last line."""
        lines, at, out = text.split("\n"), 0, []
        for i, (line, label) in enumerate(zip(lines, self.model.label(lines, self.known))):
            if label == HEADER and line.strip() and not (inner and i in (0, len(lines) - 1)):
                out.append((at, at + len(line)))
            at += len(line) + 1
        return out


@dataclass(frozen=True)
class Words:
    """What the first reading gives: misread words with their corrections, all known words, and the reader."""

    bad: DataFrame
    clean: DataFrame
    reader: Reader


def prepare(texts: DataFrame, pages: DataFrame) -> Words:
    """From a reading of all texts and a bounded sample of pages."""
    counts = materialise(word_counts(texts))
    bad = materialise(misread(counts))
    clean = materialise(clean_words(counts, bad))
    known = known_words(clean)
    sample = pages.where(F.length("text") > 200).select("text").orderBy(F.xxhash64("text"), "text").limit(SAMPLE)
    return Words(bad, clean, Reader(train(list(sample.toPandas()["text"]), known), known))


_EXAMINED = "kind string, key string, paper_id string, begin int, uid bigint, noisy boolean, spans array<struct<s:int,e:int>>, words array<string>, cuts array<struct<a:string,b:string>>"


def examined(records: DataFrame, reader: Reader, full: bool) -> DataFrame:
    """kind, key, paper_id, begin, uid, noisy, spans, words, cuts of every record with text, and with full its text:
    spans are header lines within the text, words those not known to be clean, cuts those that may be compounds. The
    last two are left out where the record is noisy anyway, unless full. A record without a place (chunks of papers
    without pages) is labelled but for its first and last line, which its window may have cut."""
    sent = records.sparkSession.sparkContext.broadcast(reader)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        own = sent.value
        for b in batches:
            noisy, spans, words, open_ = [], [], [], []
            for t, page, placed in zip(b["text"], b["kind"] == "page", b["placed"]):
                found = own.headers(t, inner=not page) if page or not placed else []
                cut, maybe = own.cut_words(t)
                bad = bool(found) or cut or specked(t)
                noisy.append(bad)
                spans.append([{"s": s, "e": e} for s, e in found])
                words.append([] if bad and not full else own.suspicious(t))
                open_.append([] if bad and not full else [{"a": x, "b": y} for x, y in maybe])
            out = {c: b[c] for c in ("kind", "key", "paper_id", "begin", "uid")} | {"noisy": noisy, "spans": spans, "words": words, "cuts": open_}
            yield pd.DataFrame(out | ({"text": b["text"]} if full else {}))

    rows = records.select("kind", "key", "paper_id", "begin", "placed", "text", F.monotonically_increasing_id().alias("uid")).where(F.length("text") > 0)
    return rows.mapInPandas(read, _EXAMINED + (", text string" if full else ""))


def records_of(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """kind, key, paper_id, begin, placed, text of all pages and chunks; placed where headers of pages can be carried
    over: the offset is known and the paper has pages."""
    page = pages.select(F.lit("page").alias("kind"), F.concat_ws("#", "paper_id", F.col("page_number").cast("string")).alias("key"), "paper_id", F.col("char_start").alias("begin"), F.lit(True).alias("placed"), "text")
    chunk = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "paper_id", F.col("char_start").alias("begin"), "text")
    # papers that have chunks but no pages, or none that is known
    lone = chunks.select("paper_id").distinct().join(pages.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", F.lit(True).alias("lone"))
    return page.unionByName(chunk.join(lone, "paper_id", "left").withColumn("placed", F.col("begin").isNotNull() & F.col("lone").isNull()).drop("lone"))


def _over_headers(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, s, e) of header lines of the paper's pages that a chunk overlaps, in offsets of the paper."""
    spans = found.where("kind = 'page' AND begin IS NOT NULL").select("paper_id", "begin", F.explode("spans").alias("x")).select(
        "paper_id", (F.col("begin") + F.col("x.s")).alias("s"), (F.col("begin") + F.col("x.e")).alias("e")).distinct()
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / BIN), F.floor(b / BIN)))
    begin, end = F.col("char_start"), F.col("char_start") + F.char_length("text")
    narrow = chunks.where(begin.isNotNull() & F.col("paper_id").isNotNull() & (F.length("text") > 0)).select(F.col("chunk_id").alias("key"), "paper_id", begin.alias("begin"), end.alias("end"), bins(begin, end).alias("bin")).distinct()
    placed = spans.select("paper_id", "s", "e", bins(F.col("s"), F.col("e")).alias("bin"))
    hit = narrow.join(placed, ["paper_id", "bin"]).where((F.col("s") < F.col("end")) & (F.col("e") > F.col("begin") + 1))
    return hit.select("key", "s", "e").distinct()


def _cut_rows(found: DataFrame, words: Words, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(keys, a, b) of cuts that may be compounds, of those that are none, and of those that are."""
    rows = found.select(*keys, F.explode("cuts").alias("x")).select(*keys, "x.a", "x.b")
    kept = materialise(compounds(rows.select("a", "b"), words.clean))
    return rows.join(kept, ["a", "b"], "left_anti"), rows.join(kept, ["a", "b"], "left_semi")


def noisy_records(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_kind, record_key) of every page and chunk with a cut word, a misread character or a header line.

    Whole texts are read; null and empty ones are clean, repeated rows count once, and a null page number or
    paper leaves that part of the key out. Ties between corrections go to the more frequent, then to the first.
    """
    words = prepare(pages.select("text").unionByName(chunks.select("text")), pages)
    found = materialise(examined(records_of(pages, chunks), words.reader, full=False))
    key = ["kind", "key"]
    sure = found.where("noisy").select(*key)
    odd = found.where("NOT noisy").select(*key, F.explode("words").alias("word")).join(words.bad.select("word"), "word", "left_semi").select(*key)
    cut = _cut_rows(found.where("NOT noisy"), words, *key)[0].select(*key)
    crossed = _over_headers(found, chunks).select(F.lit("chunk").alias("kind"), "key")
    every = sure.unionByName(odd).unionByName(cut).unionByName(crossed).distinct()
    return every.select(F.col("kind").alias("record_kind"), F.col("key").alias("record_key"))


def rebuild(text: str, headers: Iterable[tuple[int, int]], fixes: dict[str, str], kept: set[tuple[str, str]], reader: Reader) -> str:
    """The text with header lines dropped, cut words joined (but for the compounds kept), misread words replaced and
    lines run into paragraphs by the sequence model's labels of the text's own lines. Lines of more than 140
    characters aren't wrapped."""
    spans, own, over, at = list(headers), text.split("\n"), set(), 0
    for i, line in enumerate(own):
        # offsets of a chunk may be off by the white space that it lost, and it may hold a part of a header only
        if line and any(2 * (min(e, at + len(line)) - max(s, at)) >= len(line) for s, e in spans):
            over.add(i)
        at += len(line) + 1
    labels = reader.model.label(own, reader.known, over)
    lines, marks = [x for i, x in enumerate(own) if i not in over], [x for i, x in enumerate(labels) if i not in over]
    body = "\n".join(lines)

    # a cut word moves up whole, the line's end comes after it; a line that was its rest alone goes
    def whole(m: re.Match) -> str:
        if (m[1], m[2]) in kept:
            return m[0]
        i = body.count("\n", 0, m.start()) + 1
        marks[i] = None if m[0].endswith("\n") else BODY
        return m[1] + m[2] + m[3] + "\n"

    body = _CUT_WHOLE.sub(whole, body)
    body = WORD.sub(lambda m: fixes.get(m[0], m[0]), body)
    body = _SPECK.sub("", body)
    lines = body.split("\n")
    width, out = _width(lines), ""
    for i, (line, label) in enumerate(zip(lines, [x for x in marks if x is not None])):
        out += line if not i else (("\n" if label == BREAK or width > 140 else " ") + line)
    return out


def repaired(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_kind, record_key, text): every noisy record with its text repaired; clean ones stay as they are and
    aren't listed. Copies of a record are repaired once, from the text with the smallest hash.

    What is wrong with a record is found from numbers and words; then its text alone moves to meet it, while texts
    of clean records are dropped where they are read, by a filter of fixed size.
    """
    words = prepare(pages.select("text").unionByName(chunks.select("text")), pages)
    reader = words.reader
    sent = pages.sparkSession.sparkContext.broadcast(reader)
    found = materialise(examined(records_of(pages, chunks), reader, full=True))
    key = ["kind", "key"]
    one = materialise(found.groupBy(*key).agg(F.min(F.struct(F.xxhash64("text"), "begin", "uid")).alias("r")).select(*key, "r.uid", F.coalesce("r.begin", F.lit(0)).alias("shift")))
    fixes = found.select("uid", F.explode("words").alias("word")).join(words.bad, "word").groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("word", "good"))).alias("fixes"))
    cut, kept = _cut_rows(found, words, "uid")
    kept = kept.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("kept"))
    crossed = _over_headers(found, chunks).select(F.lit("chunk").alias("kind"), "key", "s", "e").join(one, key).select("uid", (F.col("s") - F.col("shift")).alias("s"), (F.col("e") - F.col("shift")).alias("e"))
    own = found.select("uid", F.explode("spans").alias("x")).select("uid", "x.s", "x.e")
    headers = crossed.unionByName(own).distinct().groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("headers"))
    wrong = found.where("noisy").select("uid").unionByName(cut.select("uid")).unionByName(fixes.select("uid")).unionByName(headers.select("uid")).distinct()
    wrong = materialise(wrong.join(one, "uid").join(fixes, "uid", "left").join(kept, "uid", "left").join(headers, "uid", "left").drop("shift"))
    bits = pages.sparkSession.sparkContext.broadcast(bit_filter(wrong.select(F.xxhash64("uid"))))

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[passing(bits.value, b["h"].to_numpy(np.int64)), ["uid", "text"]]

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            out = []
            for kind, key_, text, fix, keep, heads in zip(b["kind"], b["key"], b["text"], b["fixes"], b["kept"], b["headers"]):
                spans = [(max(0, h["s"]), max(0, h["e"])) for h in heads] if heads is not None else []
                fix, keep = dict(fix) if fix is not None else {}, {(x["a"], x["b"]) for x in keep} if keep is not None else set()
                out.append((kind, key_, rebuild(text, spans, fix, keep, sent.value)))
            yield pd.DataFrame(out, columns=["record_kind", "record_key", "text"])

    texts = found.select("uid", "text", F.xxhash64("uid").alias("h")).mapInPandas(some, "uid bigint, text string")
    joined = texts.join(wrong, "uid").select("kind", "key", "text", "fixes", "kept", "headers")
    return joined.mapInPandas(mend, "record_kind string, record_key string, text string")
