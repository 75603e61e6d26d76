"""Dense scoring: a stated set of queries against all rows, in blocks of matrix products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..session import materialise
from .lexical import best

if TYPE_CHECKING:
    import pandas as pd

#: Queries that are sent to the tasks at once: 4,096 vectors of 384 doubles are 12 MB.
QUERY_BLOCK = 4096
SIZE = 384


@lru_cache(maxsize=200_000)
def _bucket(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest(), 16) % SIZE


def hash_vector(text: str | None) -> np.ndarray:
    """Counts of the words' md5 buckets, of unit length; zero for null and empty texts."""
    v = np.zeros(SIZE)
    for w in (text or "").lower().split():
        v[_bucket(w)] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


def hash_weights(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, weight): the same embedding as sparse rows, by built-in expressions only."""
    counts = rows.select(key, F.explode(T.words(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("w")).groupBy(key, T.hash_bucket(F.col("w")).alias("bucket")).agg(F.count("*").alias("n"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, key).select(key, "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("weight"))


def hash_embed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, embedding ARRAY<DOUBLE>)."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": [hash_vector(t) for t in b[text]]})

    return rows.select(key, text).mapInPandas(embed, f"`{key}` {dict(rows.dtypes)[key]}, embedding array<double>")


def _scores(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return q @ m.T
    if metric == "euclidean":
        gap = np.maximum(0, (q * q).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * q @ m.T)
        return -np.sqrt(gap)
    nq, nm = np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1)
    return (q / np.where(nq, nq, 1)[:, None]) @ (m / np.where(nm, nm, 1)[:, None]).T


def dense_topk(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = True, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, score, rank): the k best rows of every query. rows (id, embedding), queries (qid, embedding).

    Every task keeps the k best of its batch for every query, so what is shuffled doesn't grow with k times the
    batch. Queries are sent in blocks of a fixed size; null vectors take no part; ties go to the smaller id.
    """
    spark = rows.sparkSession
    rows, queries = rows.where("embedding IS NOT NULL"), queries.where("embedding IS NOT NULL")
    kinds = dict(queries.dtypes)["qid"], dict(rows.dtypes)["id"]
    n = queries.count()
    parts = []
    for b in range(max(1, -(-n // block))):
        some = queries if n <= block else queries.where(F.pmod(F.xxhash64("qid"), F.lit(-(-n // block))) == b)
        got = some.select("qid", "embedding").toPandas()
        sent = spark.sparkContext.broadcast((got["qid"].to_numpy(), np.stack(got["embedding"].to_numpy()).astype(float) if len(got) else np.zeros((0, 1))))

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            import pandas as pd

            names, q = sent.value
            for batch in batches:
                if not len(batch) or not len(names):
                    continue
                ids = batch["id"].to_numpy()
                s = np.round(_scores(q, np.stack(batch["embedding"].to_numpy()).astype(float), metric), 6)
                if exclude_self:
                    s[names[:, None] == ids[None, :]] = -np.inf
                place = np.argsort(ids, kind="stable")
                order = place[np.argsort(-s[:, place], axis=1, kind="stable")][:, :k]
                line = np.repeat(np.arange(len(names)), order.shape[1])
                out = pd.DataFrame({"qid": names[line], "id": ids[order.ravel()], "score": s[line, order.ravel()]})
                yield out[np.isfinite(out["score"])]

        parts.append(rows.select("id", "embedding").mapInPandas(score, f"qid {kinds[0]}, id {kinds[1]}, score double"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return best(every, k)


def dense_over(rows: DataFrame, queries: DataFrame, pairs: DataFrame, k: int, metric: str = "cosine", block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(qid, id, score) of the k best rows of every query and of the given (qid, id) pairs; and (qid, lo, hi), the
    range of each query's scores over all rows. Scores of other pairs never leave the task that computes them.
    """
    spark = rows.sparkSession
    wanted = pairs.groupBy("id").agg(F.collect_set("qid").alias("want"))  # at most the stated queries a row
    rows, queries = rows.where("embedding IS NOT NULL").join(wanted, "id", "left").select("id", "embedding", "want"), queries.where("embedding IS NOT NULL")
    kinds = dict(queries.dtypes)["qid"], dict(rows.dtypes)["id"]
    blocks = max(1, -(-queries.count() // block))
    parts = []
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "embedding").toPandas()
        sent = spark.sparkContext.broadcast((got["qid"].to_numpy(), np.stack(got["embedding"].to_numpy()).astype(float) if len(got) else np.zeros((0, 1))))

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            import pandas as pd

            names, q = sent.value
            line = {n: i for i, n in enumerate(names)}
            low, high = np.full(len(names), np.inf), np.full(len(names), -np.inf)
            for batch in batches:
                if not len(batch) or not len(names):
                    continue
                ids = batch["id"].to_numpy()
                s = np.round(_scores(q, np.stack(batch["embedding"].to_numpy()).astype(float), metric), 6)
                low, high = np.minimum(low, s.min(1)), np.maximum(high, s.max(1))
                place = np.argsort(ids, kind="stable")
                order = place[np.argsort(-s[:, place], axis=1, kind="stable")][:, :k]
                asked = [(line[n], j) for j, want in enumerate(batch["want"]) if want is not None for n in want if n in line]
                at = np.concatenate([np.stack([np.repeat(np.arange(len(names)), order.shape[1]), order.ravel()], 1), np.array(asked, dtype=int).reshape(-1, 2)])
                at = np.unique(at, axis=0)
                yield pd.DataFrame({"qid": names[at[:, 0]], "id": ids[at[:, 1]], "score": s[at[:, 0], at[:, 1]], "lo": None, "hi": None})
            seen = np.isfinite(low)
            if seen.any():
                yield pd.DataFrame({"qid": names[seen], "id": None, "score": None, "lo": low[seen], "hi": high[seen]})

        parts.append(rows.mapInPandas(score, f"qid {kinds[0]}, id {kinds[1]}, score double, lo double, hi double"))
    every = materialise(reduce(DataFrame.unionByName, parts))
    ranges = every.where("lo IS NOT NULL").groupBy("qid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return every.where("lo IS NULL").select("qid", "id", "score"), ranges


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, embedding ARRAY<DOUBLE>): the mean of every key's vectors; null vectors take no part."""
    each = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "x"))
    mean = each.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding"))


def similar_edges(rows: DataFrame, k: int = 8, least: float = 0.30) -> DataFrame:
    """(src, dst, score): the k most similar others of every row, those of at least `least`."""
    found = dense_topk(rows, rows.select(F.col("id").alias("qid"), "embedding"), k)
    return found.where(F.col("score") >= least).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "score")


def normalised_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return rows.withColumn(vector, V.unit(F.col(vector)))


def svd_projection(weights: DataFrame, size: int) -> DataFrame:
    """(id, embedding): latent coordinates of (id, term, w) rows by an exact singular value decomposition.

    Terms are numbered in order of their text. The sign of a coordinate is free; its size isn't.
    """
    from pyspark.mllib.linalg import SparseVector
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    terms = weights.select("term").distinct().orderBy("term").rdd.map(lambda r: r[0]).zipWithIndex().toDF(["term", "col"])
    ids = weights.select("id").distinct().orderBy("id").rdd.map(lambda r: r[0]).zipWithIndex().toDF(["id", "row"])
    width = terms.count()
    cells = weights.join(terms, "term").join(ids, "id").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "w"))).alias("cells"))
    matrix = IndexedRowMatrix(cells.rdd.map(lambda r: IndexedRow(r["row"], SparseVector(width, [(c["col"], c["w"]) for c in r["cells"]]))))
    svd = matrix.computeSVD(min(size, width - 1), computeU=True)
    sigma = svd.s.toArray()
    out = svd.U.rows.map(lambda r: (int(r.index), [float(x) for x in r.vector.toArray() * sigma])).toDF(["row", "embedding"])
    return out.join(ids, "row").select("id", "embedding")

