"""Filling token windows with whole documents by Karmarkar-Karp multiway differencing.

Texts are only counted where they are read; what moves is one number a document. Documents are dealt to groups by
a hash, each of a bounded number of items, and every group is packed by itself: partial partitions with the most
different sums are merged, the largest window of one with the smallest of the other, until one partition is left.
If one of its windows is above the capacity, the group is packed again with more windows. A document longer than
a window gives as many full windows as it fills, and its remainder is an item like any other.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread

if TYPE_CHECKING:
    import pandas as pd

CAPACITY = 2048
#: Items of a group, on average. The room that a group's last window leaves is shared by so many.
GROUP = 4096
#: Setting with the path of the public tokenizer's file on the driver, and its default; files aren't part of the
#: repository.
SETTING, TOKENIZER = "spark.skolion.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """Tokens of a text under a byte-level BPE vocabulary given as ranks; no token is special."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    # Fixed value: the published word pattern of this vocabulary.
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    coder = tiktoken.Encoding("public", pat_str=words, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row over its whole text; null and empty texts have 0 tokens.

    tokenizer: a path on the driver, else the session's setting; the file is shipped to the executors with the job.
    """
    spark = docs.sparkSession
    path = tokenizer or spark.conf.get(SETTING, TOKENIZER)
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        tokens = counter(SparkFiles.get(name))
        for b in batches:
            yield pd.DataFrame({"item": b["item"], "n_tokens": [tokens(t) if t else 0 for t in b["t"]]})

    rows = docs.select(F.col(key).alias("item"), F.col(text).alias("t"))
    out = rows.mapInPandas(count, rows.select("item", F.lit(0).alias("n_tokens")).schema)
    return out.withColumnRenamed("item", key)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of every item, by Karmarkar-Karp differencing into `windows` parts.

    A partial partition is a descending vector of sums with a tree of items behind every sum; empty windows are
    left out, so that merging costs what both sides really hold.
    """
    if windows <= 1 or not len(sizes):
        return np.zeros(len(sizes), dtype=np.int64)
    # heap entry: (-spread, tie, sums of occupied slots descending, their trees); a tree is an item or a pair
    heap: list = [(-int(s), i, [int(s)], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        # the slots of b, smallest first, meet those of a, largest first; unoccupied slots are zeros
        free = windows - len(a)
        if len(b) <= free:
            sums, trees = a + b, ta + tb
        else:
            over = len(b) - free  # so many of b's smallest must share a slot with a's smallest
            sums, trees = list(a), list(ta)
            for j in range(over):
                # b's j-th smallest meets the over-j-th from a's end: a's smallest meets b's largest of these
                at = len(a) - over + j
                sums[at] += b[len(b) - 1 - j]
                trees[at] = (ta[at], tb[len(b) - 1 - j])
            sums += b[:free]
            trees += tb[:free]
        order = sorted(range(len(sums)), key=lambda i: -sums[i])
        sums, trees = [sums[i] for i in order], [trees[i] for i in order]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, tie, sums, trees))
        tie += 1
    out = np.empty(len(sizes), dtype=np.int64)
    for w, tree in enumerate(heap[0][3]):
        stack = [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack.extend(t)
            else:
                out[t] = w
    return out


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of every item; none above the capacity, and as few windows as differencing reaches.

    Windows begin at the fewest that could hold the items; their number rises while one of them is too full.
    """
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, windows)
        if np.bincount(at, weights=sizes, minlength=windows).max(initial=0) <= capacity:
            return at
        windows += 1


def pack(counts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(key, copy, piece_no, window_id, token_start, token_end, n_tokens) for every part of every document.

    Parts of one window sum up to at most `capacity`. Only documents longer than a window are split, into full
    windows and one remainder. A document without tokens needs no window and has a null window_id; repeated rows
    are packed as often as they occur, told apart by `copy`; a null key is a key. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("a window holds at least one token")
    rows = counts.groupBy(key, "n_tokens").count().select(key, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    rows = materialise(rows)  # read three times below; a document is two numbers
    groups = max(1, -(-rows.count() // group))
    rows = rows.withColumn("g", F.pmod(F.xxhash64(key, "copy"), F.lit(groups)).cast("int"))
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    whole = rows.where(full > 0).select(key, "copy", "g", F.posexplode(F.array_repeat(F.lit(capacity), full)).alias("piece_no", "n_tokens"))
    whole = whole.select(
        key, "copy", "piece_no", F.concat_ws("-", F.lit("full"), F.col(key).cast("string"), "copy", "piece_no").alias("window_id"),
        (F.col("piece_no") * capacity).alias("token_start"), ((F.col("piece_no") + 1) * capacity).alias("token_end"), "n_tokens")
    rest = rows.select(key, "copy", "g", full.alias("piece_no"), (full * capacity).alias("token_start"), (F.col("n_tokens") - full * capacity).cast("int").alias("size"))
    rest = rest.withColumn("keep", (F.col("size") > 0) | (F.col("piece_no") == 0)).where("keep").drop("keep")

    def one(g: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", key, "copy"], ascending=[False, True, True], ignore_index=True)
        some = items["size"].to_numpy() > 0
        at = fill(items["size"].to_numpy()[some], capacity)
        items["window_id"] = None
        items.loc[some, "window_id"] = [f"g{g[0]}-{w}" for w in at]
        items["token_end"] = items["token_start"] + items["size"]
        return items.rename(columns={"size": "n_tokens"})[columns]

    columns = [key, "copy", "piece_no", "window_id", "token_start", "token_end", "n_tokens"]
    schema = f"`{key}` {dict(counts.dtypes)[key]}, copy int, piece_no int, window_id string, token_start int, token_end int, n_tokens int"
    # packing costs much more than its bytes tell, so its tasks aren't merged by size
    return whole.select(*columns).unionByName(spread(rest, "g").groupBy("g").applyInPandas(one, schema))
