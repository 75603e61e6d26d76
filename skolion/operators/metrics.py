"""Ranking and groundedness metrics over ranked lists, one job for all queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def relevance(gold: DataFrame, qid: str, relevant: str, corpus: DataFrame | None = None, key: str = "paper_id") -> DataFrame:
    """(qid, id): distinct relevant ids, those in the corpus; queries left without any disappear."""
    rows = gold.select(F.col(qid).alias("qid"), F.explode(relevant).alias("id")).where("id IS NOT NULL").distinct()
    return rows if corpus is None else rows.join(corpus.select(F.col(key).alias("id")).distinct(), "id", "left_semi").select("qid", "id")


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, recall, ndcg, ndcg_truncated) for every query with relevant ids.

    ranked (qid, id, rank). ndcg discounts over k places; ndcg_truncated ends the ideal list where the retrieved
    one ends, as the first layer reports it. Queries that retrieve nothing have 0.
    """
    sizes = relevant.groupBy("qid").agg(F.count("*").alias("n"))
    top = ranked.where(F.col("rank") <= k)
    hits = top.join(relevant, ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    got = top.groupBy("qid").agg(F.count("*").alias("got"))
    every = sizes.join(hits, "qid", "left").join(got, "qid", "left")
    ideal = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    gain = F.coalesce("gain", F.lit(0.0))
    cut = F.least(F.col("n"), F.coalesce("got", F.lit(0)), F.lit(k))
    return every.select(
        "qid", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round(gain / ideal(F.least("n", F.lit(k))), 6).alias("ndcg"),
        F.round(F.when(cut > 0, gain / ideal(cut)).otherwise(0.0), 6).alias("ndcg_truncated"))


def at_ranks(rows: DataFrame, targets: DataFrame, parts: int = 256) -> DataFrame:
    """(g, which, value): the value of (g, v) rows at each target's rank (g, which, rank from 0), exactly.

    Each round counts the rows in `parts` ranges of a target's interval and goes on with the range that holds the
    rank, between the least and greatest value in it, until these are one. No group is sorted or gathered; a null g
    is a group, null values take no part.
    """
    rows = rows.where("v IS NOT NULL").select("g", F.col("v").cast("double").alias("v"))
    bounds = rows.groupBy(F.col("g").alias("bg")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    open_ = materialise(targets.join(bounds, F.col("g").eqNullSafe(F.col("bg"))).select("g", "which", "rank", "lo", "hi"))
    done = []
    while True:
        done.append(open_.where("lo = hi").select("g", "which", F.col("lo").alias("value")))
        rest = open_.where("lo < hi")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        hit = rows.withColumnRenamed("g", "rg").join(rest, F.col("rg").eqNullSafe(F.col("g"))).where(F.col("v").between(F.col("lo"), F.col("hi"))).select("g", "which", "rank", "v", F.least(F.floor(share * parts), F.lit(parts - 1)).alias("part"))
        counts = hit.groupBy("g", "which", "rank", "part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        to = F.sum("n").over(Window.partitionBy("g", "which").orderBy("part"))
        found = counts.withColumn("to", to).where((F.col("to") > F.col("rank")) & (F.col("to") - F.col("n") <= F.col("rank")))
        open_ = materialise(found.select("g", "which", (F.col("rank") - F.col("to") + F.col("n")).alias("rank"), "lo", "hi"))


def percentiles(rows: DataFrame, share: float) -> DataFrame:
    """(g, n, p): rows and exact percentile of every group of (g, v), between its two neighbouring values."""
    n = materialise(rows.where("v IS NOT NULL").groupBy("g").agg(F.count("*").alias("n")))
    place = share * (F.col("n") - 1)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("which"), F.ceil(place).alias("rank")))).alias("x")
    found = at_ranks(rows, n.select("g", sides).select("g", "x.*"))
    pair = found.groupBy(F.col("g").alias("pg")).agg(F.max(F.when(F.col("which") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("value"))).alias("b"))
    return n.join(pair, F.col("g").eqNullSafe(F.col("pg"))).select("g", "n", (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("p"))


def summary(per_query: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Means of the values by group and over all (group null), with an exact 95th percentile of the last."""
    per_query = materialise(per_query.select(group, *values))  # a row a query, read in every round below
    means = [F.round(F.avg(v), 6).alias(v) for v in values]
    rows = per_query.groupingSets([[F.col(group)], []], F.col(group)).agg(F.count("*").alias("n"), *means, F.grouping(group).alias("overall"))
    both = F.explode(F.array(F.struct(F.col(group).alias("k"), F.lit(0).alias("overall")), F.struct(F.lit(None).cast(dict(per_query.dtypes)[group]).alias("k"), F.lit(1).alias("overall")))).alias("g")
    p = percentiles(per_query.select(both, F.col(values[-1]).alias("v")), 0.95).select(F.col("g.k").alias("k"), F.col("g.overall").alias("o"), F.round("p", 6).alias("p95"))
    return rows.join(p, F.col(group).eqNullSafe(F.col("k")) & (F.col("overall") == F.col("o")), "left").drop("k", "o")


def lift(new: str, old: str):
    """Relative gain in percent, 0 where the old value is 0."""
    return F.when(F.col(old) == 0, F.lit(0.0)).otherwise(F.round(100 * (F.col(new) - F.col(old)) / F.col(old), 6))
