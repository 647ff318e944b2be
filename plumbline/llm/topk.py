"""Exact top-k search by a vector-approximation file.

Vectors become integers. Their approximation has one byte a component: its cell of 2**t values, with the least t for a
vector with which all its cells fit. The product of a query with the cells, and what the components can add within their
cells, bound the inner product from both sides.

1. Cells are scanned, a block of them for a block of queries in a task; the first block gives each query a bound that its
   k-th best score reaches, and all blocks give the vectors whose upper bound reaches that. No exact vector moves.
2. Exact vectors are read for those alone, in the order of their bounds: 2k of a query first, and then only those whose
   upper bound reaches the k-th exact score of these.

Equal vectors count as one with its k + 1 smallest ids, as no query can want more of them.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.store import table

#: Rows of a block of cells and of queries; the least bits that cells leave out.
BLOCK, QUERY_BLOCK = 8_192, 1_024
SHIFT = 0
#: The least and the largest number of 64 bits.
_LONG = (-(1 << 63), (1 << 63) - 1)


def integers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null where the vector is null or has a component that is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def cells(v: Column, shift: int = SHIFT) -> tuple[Column, Column]:
    """(t, cells): how many bits the cells of a vector leave out, and each component's cell, in one byte."""
    most = F.greatest(F.array_max(v), F.lit(-1) - F.array_min(v))
    t = F.greatest(F.lit(shift), F.length(F.bin(most)) - 7)
    return t, F.transform(v, lambda x: F.call_function("shiftright", x, t).cast("tinyint"))


def bounds(q: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, up): bounds of each query's inner product with each vector of cells; exact integers, whatever their type."""
    most = max(1, int(q.max(initial=0)), -int(q.min(initial=0))) * 256 * c.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64
    if most << int(t.max(initial=0)) >= 1 << 52:
        kind = object
    base = q.astype(kind) @ c.T.astype(kind)
    base = base.astype(object if kind is object else np.float64)
    step = np.array([1 << int(x) for x in t], base.dtype)
    up, down = (f(q.astype(base.dtype), 0).sum(1) for f in (np.maximum, np.minimum))
    return base * step + np.outer(down, step - 1), base * step + np.outer(up, step - 1)


def survivors(q: np.ndarray, own: np.ndarray, least: np.ndarray, c: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """For each query the (places, low, up) of the vectors that can be among its k best: those that k others don't surely beat.

    Others beat a vector if their lower bounds exceed its upper bound, or equal it and their ids are smaller. ``least``
    is a bound that the k-th best score is known to reach.
    """
    low, up = bounds(q, c, t)
    if low.dtype == object:
        low, up = (np.minimum(np.maximum(x, _LONG[0]), _LONG[1]) for x in (low, up))
    out = []
    for n in range(len(q)):
        other = np.flatnonzero(ids != own[n])
        if len(other) > k:
            floor = np.partition(low[n][other], len(other) - k)[len(other) - k]
            top = other[low[n][other] >= floor]
            last = top[np.lexsort((ids[top], -low[n][top]))[k - 1]]
            other = other[(up[n][other] > floor) | ((up[n][other] == floor) & (ids[other] <= ids[last]))]
        other = other[up[n][other] >= least[n]]
        out.append((other, low[n][other], up[n][other]))
    return out


def product(v: Column, w: Column) -> Column:
    """The inner product of two vectors of 64-bit integers; what lies beyond 64 bits is the least or the largest of them.

    Sums that leave 64 bits on their way are made anew in 38 decimal digits. What leaves these too counts by its sign,
    which a sum of doubles tells.
    """

    def total(kind: str, plus, times) -> Column:
        return F.aggregate(F.zip_with(v, w, lambda a, b: times(a.cast(kind), b.cast(kind))), F.lit(0).cast("decimal(38,0)" if kind.startswith("decimal") else kind), plus)

    short = total("long", F.try_add, F.try_multiply)
    exact = total("decimal(19,0)", lambda s, x: F.try_add(s, x).cast("decimal(38,0)"), F.try_multiply)
    clipped = F.greatest(F.lit(Decimal(_LONG[0])), F.least(F.lit(Decimal(_LONG[1])), exact)).cast("long")
    sign = total("double", lambda s, x: s + x, lambda a, b: a * b) > 0
    return F.when(short.isNotNull(), short).when(exact.isNotNull(), clipped).when(sign, F.lit(_LONG[1])).otherwise(F.lit(_LONG[0]))


def _scan(k: int):
    def flat(column: pa.ChunkedArray, rows: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)

    def run(key: tuple, whole: pa.Table) -> pa.Table:
        asks = whole.column("asks").to_numpy()
        queries, known = whole.filter(pa.array(asks)), whole.filter(pa.array(~asks))
        columns = [np.zeros(0, np.int64)] * 4
        if len(queries) and len(known):
            least = np.array([_LONG[0] if x is None else x for x in queries.column("least").to_pylist()], object)
            ids, t = known.column("id").to_numpy(), known.column("t").to_numpy()
            found = survivors(flat(queries.column("v"), len(queries)), queries.column("id").to_numpy(), least, flat(known.column("c"), len(known)), t, ids, k)
            n = [len(x[0]) for x in found]
            row = known.column("row").to_numpy()
            clipped = lambda x: [min(max(int(y), _LONG[0]), _LONG[1]) for y in x]
            columns = [np.repeat(queries.column("row").to_numpy(), n), np.concatenate([row[x[0]] for x in found]), *[np.concatenate([np.array(clipped(x[i]), np.int64) for x in found]) for i in (1, 2)]]
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["q", "row", "low", "up"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = SHIFT, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product for each row where ``is_query`` holds.

    Components are taken as floor(scale * x). Ties go to the smaller id. A query's candidates are all rows that don't
    have its id; with fewer than k it gets all. Rows with a null id, a null vector or a component that is null or not
    finite take no part, nor do empty vectors; only vectors of the query's length are candidates. Where several rows
    have a query's id, its smallest vector is the query; as candidates such rows all stand. Other columns aren't read.
    An empty table gives an empty result. Components and scores beyond 64 bits
    count as the least or the largest number of 64 bits, and the other scores stay exact.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"), is_query.alias("asks")).where("id is not null and v is not null and size(v) > 0")
    # A row for each id and vector, with its number of copies; of equal vectors the smallest ids alone can be wanted.
    rows = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"), F.max("asks").alias("asks"))
    t, c = cells(F.col("v"), shift)
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    asked = table(rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.size("v").alias("d"), F.monotonically_increasing_id().alias("row")), "queries")
    file = table(rows.withColumn("place", place).where(F.col("place") <= k + 1).select("id", "v", "copies", F.size("v").alias("d"), t.alias("t"), c.alias("c"), F.monotonically_increasing_id().alias("row")), "cells")

    # Blocks are by hash, so their number follows from the rows; each side is copied to the other's blocks, as bytes.
    n, m = file.count(), asked.count()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    deal = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    right = file.select("d", every(query_blocks).alias("i"), deal(blocks).alias("j"), F.lit(False).alias("asks"), "row", "id", none("array<long>").alias("v"), none("long").alias("least"), "t", "c")

    def scanned(queries: DataFrame, own: DataFrame, j: Column) -> DataFrame:
        left = queries.select("d", deal(query_blocks).alias("i"), j.alias("j"), F.lit(True).alias("asks"), "row", "id", "v", "least", F.lit(0).alias("t"), none("array<tinyint>").alias("c"))
        return left.unionByName(own).groupBy("d", "i", "j").applyInArrow(_scan(k), "q long, row long, low long, up long")

    ranked = lambda df, by, most: df.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*by))).where(F.col("n") <= most)
    kth = lambda df, value: ranked(df, [F.desc(value)], k).groupBy("q").agg(F.when(F.count("*") >= k, F.min(value)).alias("least"))
    first = asked.withColumn("least", none("long"))
    if blocks > 1:
        # Query blocks meet one block each, and not all the same.
        some = right.where(F.col("j") == F.pmod("i", F.lit(blocks)))
        reached = kth(scanned(first, some, F.pmod(deal(query_blocks), F.lit(blocks))), "low")
        first = asked.join(reached, asked["row"] == reached["q"], "left").select("row", "id", "v", "d", "least")
    seen = table(scanned(first, right, every(blocks)), "survivors")

    exact, query = file.select("row", F.col("id").alias("vec_id"), "v", "copies"), asked.select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("w"))
    scored = lambda df: df.join(exact, "row").join(query, "q").select("q", "query_id", "vec_id", "copies", product(F.col("v"), F.col("w")).alias("score"))
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("up"), F.desc("low"), "row"))
    reached = kth(seen, "low")
    seen = seen.join(reached, "q").where("least is null or up >= least").drop("least").withColumn("n", order)
    near = table(scored(seen.where(F.col("n") <= 2 * k)), "scored")
    reached = kth(near, "score")
    rest = scored(seen.where(F.col("n") > 2 * k).join(reached, "q").where("least is null or up >= least"))
    best = near.unionByName(rest).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
