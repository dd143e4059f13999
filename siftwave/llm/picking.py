"""Finding few rows of a wide table by narrow keys without shuffling the rest.

A Bloom filter of the wanted keys goes to the scan's tasks, so that only rows which
may be wanted, and a few others, meet the keys in a join. The filter has 12 bits a
key, up to ``BITS``; with very many keys it fills up and lets more rows through, which
costs shuffles but changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U64, mix

BITS = 1 << 29  # 64 MB
SEGMENT = 1 << 19
HASHES = 3


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """``(HASHES, n)`` bit numbers of 64-bit keys; ``bits`` is a power of two."""
    shift = U64(65 - int(bits).bit_length())
    return np.stack([(mix(h ^ U64(0x5851F42D4C957F2D + i)) >> shift).astype(np.int64) for i in range(HASHES)])


def wanted_filter(keys: DataFrame) -> Broadcast:
    """Broadcast bitmap of the longs in the first column of ``keys``."""
    spark, column = keys.sparkSession, keys.columns[0]
    bits = SEGMENT
    while bits < min(BITS, 12 * keys.count()):
        bits *= 2

    def bit_numbers(h: pa.Array) -> pa.Array:
        p = places(np.asarray(h).view(U64), bits)
        return pa.array(list(p.T), pa.list_(pa.int64()))

    def segment(rows: pa.Table) -> pa.Table:
        bit = np.unique(np.asarray(rows.column("bit").combine_chunks()))
        flags = np.zeros(SEGMENT, bool)
        flags[bit % SEGMENT] = True
        return pa.table({"nth": pa.array([int(bit[0] // SEGMENT)]), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    each = keys.select(F.explode(F.arrow_udf(bit_numbers, "array<long>")(column)).alias("bit")).distinct()
    parts = each.groupBy((F.col("bit") / SEGMENT).cast("long")).applyInArrow(segment, "nth long, flags binary").collect()  # BITS at most
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in parts:
        bitmap[r.nth * (SEGMENT // 8) : (r.nth + 1) * (SEGMENT // 8)] = np.frombuffer(r.flags, np.uint8)
    return spark.sparkContext.broadcast(bitmap)


def in_filter(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = places(h, len(bitmap) * 8)
    return ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def may_be_wanted(shared: Broadcast, h: Column) -> Column:
    """False only for keys that aren't wanted."""
    return F.arrow_udf(lambda x: pa.array(in_filter(shared.value, np.asarray(x).view(U64))), "boolean")(h)
