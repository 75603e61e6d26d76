"""Files the engine reads and writes, with explicit schemas: an id read as a number would lose its zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import DeliveryLog

MANIFEST = "paper_id string, title string, authors string, venue string, year int, pdf_url string, pdf_path string, topics string, doi string"
QA = "id string, question string, reference_answer string, relevant array<string>, topic string, query_type string"
PDF = b"%PDF"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).csv(path, header=True, quote='"', escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The items of a JSON document {items: [...]}, one row each."""
    doc = spark.read.schema(f"items array<struct<{', '.join(f'{a}: {b}' for a, b in (f.split(' ', 1) for f in QA.split(', ')))}>>").json(path, multiLine=True)
    return doc.select(F.explode("items").alias("i")).select("i.*")


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a JSON document {edges: [[src, dst], ...]}."""
    doc = spark.read.schema("n_edges int, edges array<array<string>>").json(path, multiLine=True)
    return doc.select(F.explode("edges").alias("e")).select(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, ok): files under a path and whether they begin like a PDF of at least 10 kB."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", ((F.substring("content", 1, 4) == F.lit(PDF)) & (F.col("length") >= 10_000)).alias("ok"))


def rehydrated_lines(spark: SparkSession, path: str, schema: str, key: str = "paper_id") -> DataFrame:
    """The first line of each key of a cache of JSON lines that was appended to, files in the order of their names.
    Keys are texts, also where they were written as numbers; a null key is a key."""
    kept = ", ".join(f"{p.strip().split()[0]} string" if p.strip().split()[0] == key else p for p in schema.split(","))
    rows = spark.read.schema(kept).json(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.withColumn("__at", place).groupBy(key).agg(F.min_by(F.struct(*rows.columns), "__at").alias("r")).select("r.*")


def rehydrated(spark: SparkSession, path: str, key: str, order: list[str]) -> DeliveryLog:
    """The first row of each key of a parquet cache that was appended to."""
    return DeliveryLog(spark, path, key, order)
