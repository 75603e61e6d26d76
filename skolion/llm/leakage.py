"""Evaluation passages in training text: a prefix-filtered set join with exact verification.

An item's passage of 12 words is the set of its 8 shingles of five words; a document that repeats the passage
holds all of them, so it holds the rarest. A first reading of the corpus counts in how many documents each item
shingle stands; every passage keeps its rarest one as prefix. A second reading looks for prefixes alone and, where
the document is long enough before and after the place, gives the 12 words around it, which must equal the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

if TYPE_CHECKING:
    import pandas as pd

#: Consecutive words that make a case, and words of a shingle.
PASSAGE, SHINGLE = 12, 5
#: Item shingles that are looked for in one reading of the corpus; more items are read in blocks (16 MB each).
BLOCK = 2_000_000

# A hyphen at a line's end within a word; what isn't part of any word.
_BROKEN = re.compile(r"(?<=\w)[-‐‑¬­–]\s*\n\s*(?=\w)")
_OUTSIDE = re.compile(r"[^\w\s]+|_+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Words between white space in lower case, without anything but letters and digits; words that a line's end
    cut with a hyphen are whole again. Null and empty texts have none."""
    return _OUTSIDE.sub("", _BROKEN.sub("", text).lower()).split() if text else []


class _Hasher:
    """Shingle hashes of many texts at once, with the words' hashes remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def shingles(self, tokens: list[str], n: int = SHINGLE) -> np.ndarray:
        import xxhash

        if len(tokens) < n:
            return np.empty(0, np.uint64)
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        h = np.fromiter((known.get(t) or known.setdefault(t, xxhash.xxh3_64_intdigest(t)) for t in tokens), np.uint64, len(tokens))
        out = np.zeros(len(tokens) - n + 1, np.uint64)
        for j in range(n):
            out = out * _ODD + h[j : j + len(out)]
        return out


def passages(items: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(item, field, start, shingles array<bigint>, text) of every window of PASSAGE words of every field."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        hasher = _Hasher()
        for b in batches:
            out = []
            for item, name, text in zip(b["item"], b["field"], b["t"]):
                w = words(text)
                s = hasher.shingles(w).view(np.int64)
                out += [(item, name, i, s[i : i + PASSAGE - SHINGLE + 1], " ".join(w[i : i + PASSAGE])) for i in range(len(w) - PASSAGE + 1)]
            yield pd.DataFrame(out, columns=["item", "field", "start", "shingles", "words"])

    long = [items.select(F.col(key).alias("item"), F.lit(f).alias("field"), F.col(f).alias("t")) for f in fields]
    rows = long[0]
    for more in long[1:]:
        rows = rows.unionByName(more)
    kind = dict(items.dtypes)[key]
    return rows.where(F.col("t").isNotNull()).distinct().mapInPandas(cut, f"item {kind}, field string, start int, shingles array<bigint>, words string")


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).where(F.col("doc").isNotNull() & F.col("t").isNotNull())


def _hits(want: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Positions in s of members of the sorted want."""
    return np.nonzero(want[np.minimum(np.searchsorted(want, s), len(want) - 1)] == s)[0] if len(s) and len(want) else np.empty(0, np.int64)


def frequencies(docs: DataFrame, key: str, text: str, wanted: np.ndarray) -> DataFrame:
    """(shingle, df): in how many rows each of the wanted shingles stands; summed up in the tasks first."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.view(np.uint64)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        hasher, want = _Hasher(), sent.value
        seen = np.zeros(len(want), np.int64)
        for b in batches:
            for t in b["t"]:
                s = hasher.shingles(words(t))
                hit = _hits(want, s)
                if len(hit):
                    seen[np.unique(np.searchsorted(want, s[hit]))] += 1
        some = np.nonzero(seen)[0]
        if len(some):  # an empty frame has no types
            yield pd.DataFrame({"shingle": want[some].view(np.int64), "df": seen[some]})

    return _read(docs, key, text).select("t").mapInPandas(count, "shingle bigint, df bigint").groupBy("shingle").agg(F.sum("df").alias("df"))


def surroundings(docs: DataFrame, key: str, text: str, shingles: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """(doc, words): the PASSAGE words around each prefix that a document holds, by the prefix's offsets in passages,
    where these words begin and end within the document."""
    order = np.lexsort((offsets, shingles.view(np.uint64)))
    sent = docs.sparkSession.sparkContext.broadcast((shingles.view(np.uint64)[order], offsets[order]))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        hasher, (want, offset) = _Hasher(), sent.value
        for b in batches:
            out = set()
            for d, t in zip(b["doc"], b["t"]):
                w = words(t)
                s = hasher.shingles(w)
                for at in _hits(want, s):
                    first, end = np.searchsorted(want, s[at]), np.searchsorted(want, s[at], "right")
                    for begin in at - offset[first:end]:
                        if 0 <= begin <= len(w) - PASSAGE:
                            out.add((d, " ".join(w[begin : begin + PASSAGE])))
            if out:  # an empty frame has no types
                yield pd.DataFrame(list(out), columns=["doc", "words"])

    return _read(docs, key, text).mapInPandas(find, f"doc {dict(docs.dtypes)[key]}, words string")


def leaked(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", fields: tuple[str, ...] = ("question", "reference_answer"), block: int = BLOCK) -> DataFrame:
    """(doc_key, item_key): the document repeats at least PASSAGE consecutive words of one of the item's fields.

    Whole texts are read, twice. Null keys, null or empty texts and fields of fewer words give no rows; repeated
    rows and texts shared by several ids give each pair once. Other columns are not read. Shingles of the items, and
    their prefixes, are sent in blocks of a fixed size, however many items there are.
    """
    windows = materialise(passages(items, item_key, list(fields)))

    def blocks(df: DataFrame) -> Iterator[pd.DataFrame]:
        n = max(1, -(-df.count() // block))
        for b in range(n):
            yield (df if n == 1 else df.where(F.pmod(F.xxhash64("shingle"), F.lit(n)) == b)).toPandas()

    shingles = materialise(windows.select(F.explode("shingles").alias("shingle")).distinct())
    counted = [frequencies(docs, doc_key, text, part["shingle"].to_numpy(dtype=np.int64)) for part in blocks(shingles)]
    rarity = materialise(reduce(DataFrame.unionByName, counted))
    each = windows.select("item", "field", "start", "words", F.size("shingles").alias("of"), F.posexplode("shingles").alias("offset", "shingle")).join(rarity, "shingle")
    # one aggregation a passage; a passage of which some shingle stands nowhere can't stand anywhere
    rarest = each.groupBy("item", "field", "start", "words", "of").agg(F.min(F.struct("df", "offset", "shingle")).alias("p"), F.count("*").alias("held")).where("held = of")
    prefixes = materialise(rarest.select("item", "words", "p.shingle", "p.offset"))
    found = [surroundings(docs, doc_key, text, p["shingle"].to_numpy(np.int64), p["offset"].to_numpy(np.int64)) for p in blocks(prefixes.select("shingle", "offset").distinct())]
    # equal words are the exact containment
    out = reduce(DataFrame.unionByName, found).join(prefixes.select("item", "words").distinct(), "words")
    return out.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).distinct()
