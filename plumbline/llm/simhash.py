"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Bit i of a fingerprint gets the vector 1 + i mod (2^(r+1) - 1) of r+1 bits. For each non-zero vector v, a mask keeps the
bits whose vector has an odd number of ones in common with v. The vectors of any r bits leave some v orthogonal to all
of them, so two fingerprints that differ in at most r bits agree under the mask of that v: every link is found in some
table, and each link is confirmed by counting the differing bits.

The work is on distinct fingerprints; copies only add to a count. Buckets of two give their link in the aggregation
itself. Larger ones are scanned once by rows sorted by bucket, in which fingerprints that were linked leave the scan,
and give at most one link a member. Buckets over ``BUCKET`` go another exact way that never brings them together: a
link of r bits has a fingerprint half way, so members meet at the fingerprints within half the radius of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free, groups
from plumbline.plans.components import connected_components
from plumbline.plans.store import table

#: Distinct fingerprints of one bucket that a task holds, 8 bytes each.
BUCKET = 20_000


def simhash(text: str | None, shingle: int, seed: int = 42) -> int:
    """The fingerprint of a text, as an unsigned number; zero for a text of no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1]
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, fp): fp is the 64-bit fingerprint in a long. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(x.as_py(), shingle, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def masks(radius: int) -> list[int]:
    """The covering masks for a radius, as signed longs."""
    top = 1 << (radius + 1)
    made = [sum(1 << i for i in range(64) if ((1 + i % (top - 1)) & v).bit_count() & 1) for v in range(1, top)]
    return [x - (1 << 64) if x >> 63 else x for x in made]


def _scan(radius: int):
    """Links of sorted buckets; a breadth-first walk takes linked members out of the later comparisons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["v", "key"]):
            v, key, fp = (whole.column(c).to_numpy() for c in ("v", "key", "fp"))
            cuts = np.flatnonzero((v[1:] != v[:-1]) | (key[1:] != key[:-1])) + 1
            a, b = [], []
            for own in np.split(fp.view(np.uint64), cuts):
                rest = own
                while len(rest) > 1:
                    root, queue, rest = rest[0], [rest[0]], rest[1:]
                    while queue and len(rest):
                        near = np.bitwise_count(rest ^ queue.pop()) <= radius
                        if near.any():
                            new = rest[near]
                            rest = rest[~near]
                            queue += list(new)
                            a += [root] * len(new)
                            b += list(new)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    return run


def _balls(radius: int):
    """(z, fp, inner): fingerprints z within half the radius, rounded up, of fp; inner: also within it rounded down."""
    low, high = radius // 2, (radius + 1) // 2
    flips = [(sum(1 << i for i in c), n <= low) for n in range(high + 1) for c in combinations(range(64), n)]
    flip, inner = np.array([x for x, _ in flips], np.uint64), np.array([x for _, x in flips])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 64):
                part = fp[at : at + 64]
                z = (part[:, None] ^ flip).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(np.repeat(part, len(flip)).view(np.int64)), pa.array(np.tile(inner, len(part)))], ["z", "fp", "inner"])

    return run


def links(distinct: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are those of all pairs within the radius."""
    tables = F.array(*[F.struct(F.lit(n).cast("short").alias("v"), F.lit(m).alias("m")) for n, m in enumerate(masks(radius))])
    keys = distinct.select("fp", F.explode(tables).alias("t")).select("t.v", (F.col("fp").bitwiseAND(F.col("t.m"))).alias("key"), "fp")
    met = table(keys.groupBy("v", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    pairs = met.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    more = keys.join(met.where("n > 2").select("v", "key", "n"), ["v", "key"])
    some = more.where(F.col("n") <= bucket).select("v", "key", "fp").repartition("v", "key").sortWithinPartitions("v", "key", "fp").mapInArrow(_scan(radius), "a long, b long")
    balls = more.where(F.col("n") > bucket).select("fp").distinct().mapInArrow(_balls(radius), "z long, fp long, inner boolean")
    low = balls.where("inner").groupBy("z").agg(F.min("fp").alias("b"))
    wide = balls.join(low, "z").select(F.col("fp").alias("a"), "b").where("a != b").distinct()
    return pairs.unionByName(some).unionByName(wide)


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, seed: int = 42) -> DataFrame:
    """Each row's fingerprint and the component of its near-duplicates.

    Returns (id_col, fingerprint, component_id), one row per row of docs: 16 lower-case hex digits, and the smallest id
    among the rows that links reach, itself included. Other columns of docs aren't read. A text that is null, empty or
    without words has fingerprint zero and links like any other. Rows with a null id are fingerprinted and link, but
    don't name a component: it is null where no member has an id. Repeated rows and ids stay as they are. Empty tables
    give empty results.
    """
    seen = table(fingerprints(docs, shingle, id_col, text_col, seed), "fingerprints")
    distinct = table(seen.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    linked = connected_components(links(distinct, radius, bucket)).withColumnRenamed("node", "fp")
    named = linked.join(distinct, "fp").groupBy("component").agg(F.min("first").alias("least"))
    other = linked.join(named, "component").select("fp", "least", F.lit(True).alias("linked"))
    # Written, so that the last join reads two exchanges, whose partitions Spark can split where copies are many.
    whole = table(distinct.join(other, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id")), "whole")
    return seen.join(whole, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """The rows of docs, with all their columns, of the smallest id of each component; rows of a null id stay.

    Where that id has several rows, one of those with the same text stays. ``found`` has the components, if they are not
    to be those of ``near_duplicates``.
    """
    found = near_duplicates(docs, shingle, radius, id_col, text_col) if found is None else found
    at, n, own = free("id", docs), free("rows", docs), free("text", docs)
    kept = table(found.where(F.col("component_id") == F.col(id_col)).groupBy(F.col(id_col).alias(at)).agg(F.count("*").alias(n)), "kept")
    # The ids to keep grow with the documents, so they are never broadcast: the plan is the same at every size.
    some = docs.where(F.col(id_col).isNotNull()).join(kept.hint("merge"), docs[id_col] == kept[at], "left_semi")
    if not kept.where(F.col(n) > 1).isEmpty():
        some = some.withColumn(own, F.xxhash64(text_col)).dropDuplicates([id_col, own]).drop(own)
    return some.unionByName(docs.where(F.col(id_col).isNull()))
