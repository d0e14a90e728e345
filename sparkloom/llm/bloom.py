"""Bloom filters over 64-bit hashes: built on Spark a word of 64 bits at a time, broadcast, looked up in numpy.

There are 64 bits for each hash, but no more than ``2 ** most`` in all: a fuller filter passes more, and loses none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFTS = (0, 12, 24, 32)  # where the bits of a hash begin that tell a place


def size(n: int, most: int) -> int:
    """The base-2 logarithm of a filter's bits."""
    return min(most, max(12, int(np.ceil(np.log2(max(1, n) * 64)))))


def packed(places: DataFrame, bits: int) -> np.ndarray:
    """The words of the filter whose set bits are in ``places(place)``. They reach the driver as Arrow columns: as rows, a word takes some 500 bytes there."""
    mask = F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS INT))"))
    rows = places.groupBy(F.shiftright("place", 6).alias("at")).agg(mask.alias("mask")).toArrow()
    made = np.zeros(1 << (bits - 6), np.uint64)
    for batch in rows.to_batches():
        made[batch.column("at").to_numpy()] = batch.column("mask").to_numpy().view(np.uint64)
    return made


def of_hashes(hashes: DataFrame, n: int, most: int) -> np.ndarray:
    """A filter of the ``n`` rows of ``hashes(hash)``, each with a bit from every one of ``SHIFTS``."""
    bits = size(n, most)
    parts = F.array(*[F.shiftrightunsigned("hash", k) for k in SHIFTS])
    return packed(hashes.select(F.explode(parts).alias("part")).select(F.col("part").bitwiseAND(F.lit((1 << bits) - 1)).alias("place")), bits)


def holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes a filter of ``of_hashes`` lets pass."""
    mask = np.uint64((len(words) << 6) - 1)
    hit = np.ones(len(hashes), bool)
    for shift in SHIFTS:
        place = hashes >> np.uint64(shift) & mask
        hit &= (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit
