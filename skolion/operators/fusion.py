"""Min-max normalised fusion of score pools, first occurrences, and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import best

#: Scores whose range is smaller count as equal.
FLAT = 1e-12


def minmax(scores: DataFrame, low: Column | None = None) -> DataFrame:
    """score within its query's range, 0 for all where the range is flat. low: a value that the range includes."""
    w = Window.partitionBy("qid")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    if low is not None:
        lo, hi = F.least(lo, low), F.greatest(hi, low)
    return scores.withColumn("score", F.when(hi - lo < FLAT, F.lit(0.0)).otherwise((F.col("score") - lo) / (hi - lo)))


def fuse(lexical: DataFrame, dense: DataFrame, lam: Column | float) -> DataFrame:
    """(qid, id, score): lam times the lexical plus the rest of the dense score; an absent side is 0."""
    a, b = lexical.select("qid", "id", F.col("score").alias("lex")), dense.select("qid", "id", F.col("score").alias("den"))
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    both = a.join(b, ["qid", "id"], "full_outer")
    score = lam * F.coalesce("lex", F.lit(0.0)) + (1 - lam) * F.coalesce("den", F.lit(0.0))
    return both.select("qid", "id", F.round(score, 6).alias("score"))


def hybrid_pool(lexical: DataFrame, dense: DataFrame, lam: float = 0.5, pool: int = 100, k: int = 5) -> DataFrame:
    """The two best pools, normalised within themselves, fused; lexical scores must be positive."""
    lex = best(lexical, pool).where("score > 0").drop("rank")
    den = best(dense, pool).drop("rank")
    return best(fuse(minmax(lex), minmax(den), lam), k)


def hybrid_full(lexical: DataFrame, dense: DataFrame, ranges: DataFrame, lam: float, k: int) -> DataFrame:
    """Fusion over all rows: rows without a lexical score have 0, also for the range.

    dense holds the scores of rows with a lexical score and of each query's best rows, ranges (qid, lo, hi) the range
    over all. No other row can be among the k best: those before it in dense are not below it in the lexical score.
    """
    flat = F.col("hi") - F.col("lo") < FLAT
    den = dense.join(ranges, "qid").select("qid", "id", F.when(flat, F.lit(0.0)).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("score"))
    return best(fuse(minmax(lexical, F.lit(0.0)), den, lam), k)


def pinned(scores: DataFrame, allowed: DataFrame) -> DataFrame:
    """Only rows of allowed (qid, id); a query without any isn't restricted."""
    some = allowed.select("qid").distinct().withColumn("restricted", F.lit(True))
    kept = scores.join(allowed.select("qid", "id").distinct().withColumn("ok", F.lit(True)), ["qid", "id"], "left").join(some, "qid", "left")
    return kept.where("restricted IS NULL OR ok").drop("ok", "restricted")


def first_occurrences(ranked: DataFrame, group: str) -> DataFrame:
    """(qid, group, rank): groups in the order of their best row."""
    first = ranked.groupBy("qid", group).agg(F.min("rank").alias("first"))
    return first.select("qid", group, F.row_number().over(Window.partitionBy("qid").orderBy("first", group)).alias("rank"))


def merge_pools(primary: DataFrame, more: DataFrame) -> DataFrame:
    """(qid, id, score, rank): the primary list, then what only the other has, in order; the primary's row wins."""
    both = primary.withColumn("src", F.lit(0)).unionByName(more.withColumn("src", F.lit(1)))
    once = both.withColumn("n", F.row_number().over(Window.partitionBy("qid", "id").orderBy("src", "rank"))).where("n = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("src", "rank", "id"))).select("qid", "id", "score", "rank")


def citations(ranked: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Ranked chunks with paper, title, page range, snippet and label; unknown ones have defaults.

    chunks: chunk_id, paper_id, page_start, page_end, text. papers: paper_id, title.
    """
    return cited(ranked.join(chunks.withColumnRenamed("chunk_id", "id"), "id", "left"), papers)


def cited(ranked: DataFrame, papers: DataFrame) -> DataFrame:
    """The same for ranked chunks that have paper_id, page_start, page_end and text with them."""
    out = ranked.join(papers.select("paper_id", "title"), "paper_id", "left")
    paper, title = F.coalesce("paper_id", F.lit("?")), F.coalesce("title", "paper_id", F.lit("?"))
    start, end = F.coalesce("page_start", F.lit(0)), F.coalesce("page_end", "page_start", F.lit(0))
    return out.select(
        "qid", "rank", F.col("id").alias("chunk_id"), paper.alias("paper_id"), title.alias("title"), "score", T.page_range(start, end).alias("page_range"),
        T.snippet("text").alias("snippet"), F.concat(title, F.lit(" ("), paper, F.lit("), "), T.page_range(start, end)).alias("label"),
    )
