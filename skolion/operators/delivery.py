"""Exactly one row of each identifier out of at-least-once deliveries.

Only identifiers, delivery order and file-row positions are shuffled. The smallest (received, delivery)
of each identifier wins; the winners' positions become one bitmap for every 32,768 rows of a file, and the
wide payload is then read file by file under these bitmaps, without being shuffled at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

if TYPE_CHECKING:
    import pyarrow as pa

#: Rows of one bitmap, fixed by bitmap_construct_agg.
BUCKET = 32768
#: Buckets that one task reads together; a million rows of a file.
BUCKETS_A_TASK = 32

_FILE, _ROW = "__file", "__row"


def _nulls_last(name: str) -> list:
    return [F.col(name).isNull(), F.col(name)]


class DeliveryLog:
    """Parquet rows delivered at least once, identified by one column.

    key: the identifier, compared exactly. order: the columns that decide which copy stays, the smallest
    first; a null counts as larger than any value, and equal rows are told apart by file and position, so
    repeated rows leave one copy. Rows whose identifier is null can't be copies of each other and all stay.
    An empty table gives an empty result. Columns may have any names but __file and __row.

    opener: from a file's URI to a pyarrow file system and the path in it, called in the tasks; by default the
    local one, Hadoop's, or an object store's with the credentials of its environment.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], opener: Callable[[str], tuple] | None = None):
        self.spark, self.path, self.key, self.order, self.opener = spark, path, key, order, opener or open_system
        self.frame = spark.read.parquet(path)

    def _narrow(self) -> DataFrame:
        return self.frame.select(
            F.col(self.key).alias("__key"), *self.order,
            F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW),
        )

    def winners(self) -> DataFrame:
        """File and row of the copy of each identifier that stays: one aggregation with map-side combine, so
        that a hot identifier is reduced to one row a task before the shuffle."""
        order = F.struct(*[c for name in self.order for c in _nulls_last(name)], F.col(_FILE), F.col(_ROW))
        rows = self._narrow().where(F.col("__key").isNotNull())
        best = rows.groupBy("__key").agg(F.min(order).alias("w"))
        unkeyed = self._narrow().where(F.col("__key").isNull()).select(_FILE, _ROW)
        return best.select(f"w.{_FILE}", f"w.{_ROW}").unionByName(unkeyed)

    def bitmaps(self) -> DataFrame:
        """(file, bucket, keep): a bit for every row of the bucket that stays; null if none does."""
        position = F.col(_ROW) + 1
        keep = self.winners().groupBy(F.col(_FILE), F.bitmap_bucket_number(position).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("keep"))
        every = self.frame.select(F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
        every = every.groupBy(F.col(_FILE), F.bitmap_bucket_number(position).alias("bucket")).agg(F.max(_ROW).alias("last"))
        return every.join(keep, [_FILE, "bucket"], "left")

    def read(self, columns: list[str], surplus: bool = False, apart: bool = False) -> DataFrame:
        """The given columns of the rows that stay, or of the surplus ones. apart: for work that costs much more than
        the bitmaps' bytes tell, which would put all files in one task."""
        schema = T.StructType([self.frame.schema[c] for c in columns])
        names, opener = list(columns), self.opener

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _read_under_bitmaps(batches, names, surplus, opener)

        work = self.bitmaps()
        task = F.floor((F.col("bucket") - 1) / BUCKETS_A_TASK)
        work = (spread(work, F.col(_FILE), task) if apart else work.repartition(F.col(_FILE), task)).sortWithinPartitions(_FILE, "bucket")
        return work.select(_FILE, "bucket", "last", "keep").mapInArrow(rows, schema)

    def kept(self, columns: list[str] | None = None, apart: bool = False) -> DataFrame:
        return self.read(columns or self.frame.columns, apart=apart)

    def surplus(self, columns: list[str] | None = None) -> DataFrame:
        return self.read(columns or self.frame.columns, surplus=True)


# Schemes of Spark's connectors and those that pyarrow has for the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfs"}


def open_system(uri: str) -> tuple:
    """The pyarrow file system of a file's URI as Spark writes it, and the path in it."""
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    scheme = SCHEMES.get(parts.scheme, parts.scheme)
    if scheme == "s3":
        # names of buckets aren't part of a region's address here; the path keeps its escapes undone
        return fs.S3FileSystem(), unquote(parts.netloc + parts.path)
    return fs.FileSystem.from_uri(scheme + uri[len(parts.scheme) :])


def _read_under_bitmaps(batches: Iterator[pa.RecordBatch], names: list[str], surplus: bool, opener: Callable[[str], tuple]) -> Iterator[pa.RecordBatch]:
    """Reads each file's row groups that the given buckets touch, and filters them by the bitmaps."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    now, buckets = None, {}

    def emit() -> Iterator[pa.RecordBatch]:
        if now is None:
            return
        system, path = opener(now)
        with pq.ParquetFile(path, filesystem=system) as source:
            start, meta = 0, source.metadata
            for g in range(meta.num_row_groups):
                n = meta.row_group(g).num_rows
                at = start
                start += n
                if not any(b in buckets for b in range(at // BUCKET, (at + n - 1) // BUCKET + 1)):
                    continue
                for batch in source.iter_batches(batch_size=8192, row_groups=[g], columns=names):
                    position = np.arange(at, at + batch.num_rows)
                    at += batch.num_rows
                    take = np.zeros(batch.num_rows, dtype=bool)
                    for b in np.unique(position // BUCKET):
                        if b not in buckets:
                            continue
                        inside = position // BUCKET == b
                        bits = buckets[b]
                        stays = np.zeros(inside.sum(), bool) if bits is None else bits[position[inside] % BUCKET]
                        take[inside] = ~stays if surplus else stays
                    if take.any():
                        part = batch.filter(pa.array(take))
                        yield pa.RecordBatch.from_arrays([_plain(part.column(c)) for c in names], names=names)

    for batch in batches:
        for file, bucket, keep in zip(*(batch.column(c).to_pylist() for c in (_FILE, "bucket", "keep"))):
            if file != now:
                yield from emit()
                now, buckets = file, {}
            bits = None if keep is None else np.unpackbits(np.frombuffer(keep, np.uint8), bitorder="little").astype(bool)
            buckets[bucket - 1] = bits
    yield from emit()


def _plain(column: pa.Array) -> pa.Array:
    """Timestamps as Spark takes them: microseconds, UTC."""
    import pyarrow as pa

    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if pa.types.is_timestamp(column.type) and column.type.unit != "us":
        column = column.cast(pa.timestamp("us", column.type.tz))
    return column


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The same choice on rows that no file holds: the wide row rides along in one aggregation.

    Nulls as in DeliveryLog, but rows with a null key fold into one. Rows equal in key and order are taken
    by their remaining sortable columns.
    """
    sortable = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    rest = [c for c in sortable if c not in order and c != key]
    by = F.struct(*[c for name in order for c in _nulls_last(name)], *[F.col(c) for c in rest])
    return df.groupBy(F.col(key)).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), by).alias("r")).select("r.*")
