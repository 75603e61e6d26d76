"""Search over settings as one job: a table of configurations against all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fusion, metrics
from ..operators.lexical import best


def grid(spark, weights: list[float], pools: list[int]) -> DataFrame:
    """(trial, lam, pool) in a fixed order."""
    rows = [(i, w, p) for i, (w, p) in enumerate((w, p) for w in weights for p in pools)]
    return spark.createDataFrame(rows, "trial int, lam double, pool int")


def trials(lexical: DataFrame, dense: DataFrame, configs: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(trial, lam, pool, objective, best_so_far): mean NDCG of every configuration over ranked id lists.

    lexical and dense (qid, id, score, rank) are cut to each trial's pool, normalised within it, and fused.
    """
    def pool(df: DataFrame) -> DataFrame:
        cut = df.crossJoin(F.broadcast(configs)).where(F.col("rank") <= F.col("pool"))  # configs are a stated, small table
        return fusion.minmax(cut.select(F.struct("trial", "qid").alias("qid"), "id", "score"))

    lam = F.broadcast(configs.select("trial", "lam"))
    a, b = pool(lexical).withColumnRenamed("score", "a"), pool(dense).withColumnRenamed("score", "b")
    both = a.join(b, ["qid", "id"], "full_outer").withColumn("trial", F.col("qid.trial")).join(lam, "trial")
    scored = both.select("qid", "id", F.round(F.col("lam") * F.coalesce("a", F.lit(0.0)) + (1 - F.col("lam")) * F.coalesce("b", F.lit(0.0)), 6).alias("score"))
    asked = relevant.crossJoin(F.broadcast(configs.select("trial"))).select(F.struct("trial", "qid").alias("qid"), "id")
    per = metrics.ranking_metrics(best(scored, k), asked, k).groupBy("qid.trial").agg(F.round(F.avg("ndcg"), 6).alias("objective"))
    out = configs.join(per, "trial")
    return out.withColumn("best_so_far", F.max("objective").over(Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)))
