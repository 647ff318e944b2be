"""Covering masks: fewer tables than positions of the differing bits, and no pair within the radius is missed.

Every bit gets a vector of r+1 bits. For each non-zero vector v, a mask keeps the bits whose vector has an odd number of
ones in common with v. The vectors of any r bits leave some v orthogonal to all of them, so two hashes that differ in at
most r bits agree under the mask of that v. How many masks there are depends on r alone. Which vectors the bits get only
says how many bits a mask keeps, and so how seldom others meet; here it is 28 of 64 at the least for a radius over 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signed(x: int) -> int:
    """64 bits as a signed long."""
    return x - (1 << 64) if x >> 63 else x


def vector(bit: int, radius: int) -> int:
    """The vector of one of 64 bits: all vectors in turn where they are no more than bits, and a code of great distance beyond."""
    if radius < 6:
        return 1 + bit % ((1 << (radius + 1)) - 1)
    bent = (bit & bit >> 1 & 1) ^ (bit >> 2 & bit >> 3 & 1) ^ (bit >> 4 & bit >> 5 & 1)
    return bit | 64 | (bent << 7 if radius > 6 else 0)


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 covering masks of 64 bits for a radius up to 7, as signed longs."""
    if not 0 <= radius <= 7:
        raise ValueError("masks are made for radius 0 to 7")
    vectors = [vector(i, radius) for i in range(64)]
    return [signed(sum(1 << i for i, u in enumerate(vectors) if (u & v).bit_count() & 1)) for v in range(1, 1 << (radius + 1))]


def masked(rows: DataFrame, hash: str, radius: int) -> DataFrame:
    """rows with (v, value), once for each mask: its number, and the hash under it."""
    tables = F.array(*[F.struct(F.lit(n).cast("short").alias("v"), F.lit(m).alias("m")) for n, m in enumerate(masks(radius))])
    cut = rows.select("*", F.explode(tables).alias("__t"))
    return cut.select(*rows.columns, F.col("__t.v").alias("v"), F.col(hash).bitwiseAND(F.col("__t.m")).alias("value"))
