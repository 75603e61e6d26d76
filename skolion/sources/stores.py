"""What document, vector and run stores do, as transformations of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key, the one whose order columns are largest; nulls count as smallest. Rows with a null key fold into one."""
    by = F.struct(*[x for c in order for x in (F.col(c).isNotNull(), F.col(c))])
    return rows.groupBy(F.col(key)).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), by).alias("r")).select("r.*")


def replace_by(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows without those whose key comes in again, and the incoming ones."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").select(*incoming.columns).unionByName(incoming)


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Wanted rows whose key isn't done yet; a null key is never done."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def with_metadata(vectors: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Vectors that have a row of metadata."""
    return vectors.join(chunks, key, "inner")


def first_topic_wins(rows: DataFrame, key: str, topic: str, rank: str, n: int) -> DataFrame:
    """The n first rows of every topic, where a key belongs to the first topic only that lists it."""
    first = rows.groupBy(key).agg(F.min(F.struct(topic, rank)).alias("f"))
    kept = first.select(F.col(key), F.col("f")[topic].alias(topic), F.col("f")[rank].alias(rank))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(topic).orderBy(rank, key))).where(F.col("place") <= n)


def head_per_group(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def one(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def chosen(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in a table of wanted keys, each as often as it is stored; unknown keys give none."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def ordered(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Rows with their place within the group in the order of the key as text, as a scan by id gives them."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col(key).cast("string"))))


def fresh(cache: DataFrame, created: str, seconds: int = 3600) -> DataFrame:
    """Rows of a cache that haven't expired."""
    return cache.where(F.col(created) > F.current_timestamp() - F.expr(f"INTERVAL {seconds} SECONDS"))


def fingerprint(rows: DataFrame, key: str, text: str, width: int = 4096) -> DataFrame:
    """(fingerprint): 16 digits that change with any text or its place.

    Hashes of texts are hashed in ranges of `width` keys, the ranges' hashes again; no text leaves its task.
    """
    each = rows.groupBy(key).agg(F.min(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("h"))
    part = lambda df, by, at: df.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("k"), F.col("h")))), lambda x: x["h"]), ""), 256).alias("h"))
    one = part(each.withColumn("r1", F.floor(F.col(key) / width)), "r1", key)
    two = part(one.withColumn("r2", F.floor(F.col("r1") / width)), "r2", "r1")
    return part(two.withColumn("r3", F.lit(0)), "r3", "r2").select(F.substring("h", 1, 16).alias("fingerprint"))


def run_record(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(n_docs, n_chunks, n_pages) of a run."""
    a = chunks.agg(F.count_distinct("paper_id").alias("n_docs"), F.count_distinct("chunk_id").alias("n_chunks"))
    return a.crossJoin(F.broadcast(pages.agg(F.count_distinct("paper_id", "page_number").alias("n_pages"))))
