"""Sampling and splitting by hashes: the same rows in every run and at every number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import at_ranks


def draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def per_group(rows: DataFrame, group: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of every group; the rank limit runs before the shuffle."""
    order = Window.partitionBy(group).orderBy(draw(key, seed), key)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def split(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds part: train for the first int(n * share) rows in the order of their draws, else validation.

    The draw that ends the first part is found by counting, so nothing is sorted as a whole. Rows with equal keys
    share a draw and a part.
    """
    u = F.conv(F.substring(draw(key, seed), 1, 13), 16, 10).cast("double")  # 52 bits, which a double holds
    drawn = rows.select(F.lit(0).alias("g"), F.coalesce(u, F.lit(-1.0)).alias("v"))
    last = int(rows.count() * share) - 1
    end = -2.0
    if last >= 0:
        end = at_ranks(drawn, rows.sparkSession.createDataFrame([(0, 0, last)], "g int, which int, rank bigint")).first()["value"]
    return rows.withColumn("part", F.when(F.coalesce(u, F.lit(-1.0)) <= end, F.lit("train")).otherwise(F.lit("validation")))
