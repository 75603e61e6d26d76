"""Online feedback: running and rolling rates, regimes, arms, and learners with drift detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..session import table
from ..streaming import online
from . import Registry

R = Registry()

_LOG = "l AS (SELECT event_id, ts, user_id, user_id % 11 AS arm, CASE WHEN event_type IN ('click', 'purchase') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, row_number() OVER (ORDER BY event_id) AS step FROM events)"


def log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("arm", (F.col("user_id") % 11).cast("int")).withColumn("reward", F.col("event_type").isin("click", "purchase").cast("double"))
    return online.numbered(e.withColumn("reward", F.coalesce("reward", F.lit(0.0))), "event_id")


@R.add(sql=f"WITH {_LOG} SELECT step, round(avg(reward) OVER (ORDER BY step), 6) AS mean FROM l")
def prequential_running_mean(spark: SparkSession, sf: str) -> DataFrame:
    return online.running_mean(log(spark, sf), "reward")


@R.add(sql=f"WITH {_LOG} SELECT step, round(avg(reward) OVER (ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS mean FROM l")
def rolling_helpful_rate(spark: SparkSession, sf: str) -> DataFrame:
    return online.rolling_mean(log(spark, sf), "reward")


@R.add(sql=f"WITH {_LOG}, h AS (SELECT max(step) / 2 AS h FROM l), g AS (SELECT avg(reward) FILTER (step <= h) AS pre, avg(reward) FILTER (step > h) AS post FROM l, h) SELECT round(pre, 6) AS pre, round(post, 6) AS post, CASE WHEN pre = 0 THEN 0 ELSE round(100 * (post - pre) / pre, 6) END AS lift FROM g")
def regime_lift(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf)
    half = F.broadcast(rows.agg((F.max("step") / 2).alias("h")))
    g = rows.crossJoin(half).agg(F.avg(F.when(F.col("step") <= F.col("h"), F.col("reward"))).alias("pre"), F.avg(F.when(F.col("step") > F.col("h"), F.col("reward"))).alias("post"))
    return g.select(F.round("pre", 6).alias("pre"), F.round("post", 6).alias("post"), metrics.lift("post", "pre").alias("lift"))


@R.add(sql=f"WITH {_LOG} SELECT event_type, arm, round(n / sum(n) OVER (PARTITION BY event_type), 3) AS share FROM (SELECT e.event_type, arm, count(*) AS n FROM l JOIN events e USING (event_id) GROUP BY 1, 2)")
def arm_distribution(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = log(spark, sf).groupBy("event_type", "arm").agg(F.count("*").alias("n"))
    return n.select("event_type", "arm", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 3).alias("share"))


@R.add(sql="SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def p95_by_group(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.percentiles(table(spark, sf, "events").select(F.col("event_type").alias("g"), F.col("value").alias("v")), 0.95)
    return found.select(F.col("g").alias("event_type"), "n", F.round("p", 6).alias("p95"))


@R.add(sql="SELECT lam::DOUBLE / 10 AS weight, round(greatest(0, 1 - 2 * abs(lam / 10.0 - 0.25)), 6) AS pre, round(greatest(0, 1 - 2 * abs(lam / 10.0 - 0.85)), 6) AS post FROM range(11) t(lam)")
def reward_probability(spark: SparkSession, sf: str) -> DataFrame:
    w = spark.range(11).select((F.col("id") / 10).alias("weight"))
    p = lambda ideal: F.round(online.helpful_probability(F.col("weight"), F.lit(ideal)), 6)
    return w.select("weight", p(online.IDEAL_BEFORE).alias("pre"), p(online.IDEAL_AFTER).alias("post"))


@R.add()
def online_learner_stateful(spark: SparkSession, sf: str) -> DataFrame:
    """A learner with drift detection for every user, over all their events in order."""
    e = table(spark, sf, "events")
    return online.learn_events(e, "user_id", "event_id", (F.col("event_id") % 11).cast("int"), F.col("event_type").isin("click", "purchase"))


@R.add()
def online_simulation(spark: SparkSession, sf: str) -> DataFrame:
    """1,200 steps with a change of preference at 600: adaptive and fixed mixing weights side by side."""
    from pyspark.sql import Window

    gold = table(spark, sf, "gold_qa").select(F.col("item_id").alias("qid"), (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("place"))
    return online.simulate(online.feedback_stream(gold).withColumn("tenant", F.lit("one")), "tenant")


@R.add()
def online_summary(spark: SparkSession, sf: str) -> DataFrame:
    sim = online_simulation(spark, sf)
    g = sim.groupingSets([[F.col("regime")], []], "regime").agg(F.count("*").alias("steps"), F.round(F.avg("r_static"), 6).alias("static"), F.round(F.avg("r_adaptive"), 6).alias("adaptive"), F.count_if("alarm").alias("alarms"))
    return g.withColumn("lift", metrics.lift("adaptive", "static"))
