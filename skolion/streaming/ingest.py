"""Resumable ingest of files that arrive, and the first of each message on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.chunking import Windows, chunk_pages

PAGES = "paper_id string, page_number int, text string, char_start int, char_end int"


def first_arrivals(stream: DataFrame, key: str, received: str, horizon: str = "30 days") -> DataFrame:
    """Rows whose key wasn't seen within the horizon before; state is dropped beyond it.

    A stream can keep the copy that comes first only. Where the earliest received one must stay, a batch over the
    stored rows decides (operators.delivery). Rows with a null key aren't copies of each other, and those with a
    null time have no place on the stream; they all pass.
    """
    placed = F.col(key).isNotNull() & F.col(received).isNotNull()
    once = stream.where(placed).withWatermark(received, horizon).dropDuplicatesWithinWatermark([key])
    return once.unionByName(stream.where(~placed))


def ingest_available(spark: SparkSession, pages: str, chunks: str, checkpoint: str, windows: Windows = Windows(), files: int = 1000, schema: str | StructType = PAGES) -> None:
    """Chunks all page files that aren't done yet, a bounded number of files a batch, and returns.

    A paper's pages arrive in one file. Each batch is written to a folder of its own, so a batch that is repeated
    after a failure replaces itself; a call after a break goes on where the last one stopped.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunk_pages(batch, windows).write.mode("overwrite").parquet(f"{chunks}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pages)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
