"""Queries on deliveries and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed
from ..operators.delivery import DeliveryLog
from ..session import table
from . import Registry

R = Registry()
#: Table and identifier of everything delivered at least once.
DELIVERED = {"chunks": "chunk_id", "ingest_requests": "paper_id"}


def delivery_log(spark: SparkSession, sf_dir: str, name: str) -> DeliveryLog:
    return DeliveryLog(spark, f"{sf_dir}/{name}.parquet", DELIVERED[name], ["received_at", "delivery_id"])


def _ranked(columns: str, kept: bool) -> str:
    return " UNION ALL ".join(
        f"SELECT {columns.format(t=t)} FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY received_at, delivery_id) rn"
        f" FROM {t}) WHERE rn {'=' if kept else '>'} 1" for t, k in DELIVERED.items())  # fmt: skip


@R.add(sql=_ranked("'{t}' AS table_name, delivery_id", False))
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [delivery_log(spark, sf_dir, t).surplus(["delivery_id"]).select(F.lit(t).alias("table_name"), "delivery_id") for t in DELIVERED]
    return parts[0].unionByName(parts[1])


_WIDE = "delivery_id, batch_id, chunk_id, paper_id, chunk_index, text, page_start, char_start, sha256, run_id"


@R.add(sql=f"SELECT {_WIDE} FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY received_at, delivery_id) rn FROM chunks) WHERE rn = 1")
def p1_kept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery_log(spark, sf_dir, "chunks").kept(_WIDE.split(", "))


@R.add(sql="SELECT paper_id, title, authors, venue, year, topic FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY received_at, delivery_id) rn FROM ingest_requests) WHERE rn = 1")
def p1_kept_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery_log(spark, sf_dir, "ingest_requests").kept(["paper_id", "title", "authors", "venue", "year", "topic"])


def author_values(papers: DataFrame) -> DataFrame:
    return packed.explode_field(papers, "paper_id", "authors", packed.AUTHORS)


def topic_values(papers: DataFrame) -> DataFrame:
    return packed.explode_field(papers, "paper_id", "topics", packed.LABELS, compounds=True)


@R.add()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers")
    columns = lambda df, field: df.select("paper_id", F.lit(field).alias("field_name"), "pos", "item_value")
    return columns(author_values(papers), "authors").unionByName(columns(topic_values(papers), "topics"))
