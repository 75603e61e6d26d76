"""A filter of fixed size that spares joins what can't match: members always pass, others the more the fuller it is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (1 MB). Two of them are set for every member.
BITS = 1 << 23


def bit_filter(hashes: DataFrame) -> bytes:
    """The filter of the 64-bit hashes in the one column; combined in the tasks before the shuffle."""
    h = F.col(hashes.columns[0])
    at = F.explode(F.array(*[F.pmod(x, F.lit(BITS)) for x in (h, F.shiftright(h, 32))])).alias("at")
    words = hashes.select(at).select((F.col("at") / 64).cast("int").alias("i"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    rows, out = words.toPandas(), np.zeros(BITS // 64, np.int64)  # BITS / 64 rows at most
    out[rows["i"].to_numpy(int)] = rows["b"].to_numpy(np.int64)
    return out.tobytes()


def is_set(bits: bytes, h: int) -> bool:
    """Whether a hash, as an unsigned number, may be a member."""
    a = h & (BITS - 1)
    if not bits[a >> 3] >> (a & 7) & 1:
        return False
    a = h >> 32 & (BITS - 1)
    return bool(bits[a >> 3] >> (a & 7) & 1)


def passing(bits: bytes, h: np.ndarray) -> np.ndarray:
    """is_set() for many signed hashes at once."""
    b = np.frombuffer(bits, np.uint8)
    found = np.ones(len(h), bool)
    for x in (h, h >> 32):
        a = x & (BITS - 1)
        found &= (b[a >> 3] >> (a & 7).astype(np.uint8) & 1).astype(bool)
    return found
