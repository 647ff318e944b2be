"""Operator 1 completed to a Jaccard similarity: every pair of word-shingle sets from a similarity on.

Covering LSH of SimHash fingerprints links what is closest, and exact Jaccard confirms it; in large groups of near copies
that joins nearly all. Sets as dissimilar as 0.8 differ in some 10 of 64 bits, though, which no number of masks that could
be afforded covers. So the rest is found by prefixes: shingles are put in one order for all texts, those that are common in
a sample last, and two sets of similarity s share one of their first n - ceil(s n) + 1 shingles. Sets that meet there, and
that no links join yet, are compared by their sizes and by parity bits, four or more a shingle, of which no more can differ
than shingles do; neither ever drops a pair that is similar enough. Exact Jaccard confirms what is left.

The work is on distinct sets. A bucket in which all sets are in one component is done. One over ``SMALL`` first gives a
tree of links, a member's at most, and where these, once confirmed, leave several components, all pairs across; those over
``BLOCK`` are compared block by block in tasks of their own. In one over ``SPLIT`` sets meet at two shingles instead: the
first two that two sets have in common are both among their first n - ceil(s n) + 2. Sets count as equal if their 64-bit
hashes are, and so do shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches_for_a_while, groups
from plumbline.llm.simhash import links as covering_links
from plumbline.llm.simhash import majority
from plumbline.plans.components import connected_components
from plumbline.plans.store import drop, materialize, table

#: Members of a bucket of which all pairs are confirmed at once, members of a block, members that one shingle brings together.
SMALL, BLOCK, SPLIT = 16, 4096, 1 << 15
#: One text of SAMPLED tells which shingles are common, or of more, so that some SAMPLE texts do: those in OFTEN of the
#: sample, COMMON at most. They only decide the order of shingles, and so what is compared, not what is found.
SAMPLED, SAMPLE, OFTEN, COMMON = 16, 1_000_000, 8, 1 << 18
#: Parity bits of a set at least and at most; bits of the marks by which texts are passed over that no pair can want.
PARITY, MOST, MARKS = 1 << 10, 1 << 20, 1 << 22


def shingles(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's shingles, sorted and distinct; a text of fewer words is one shingle, one of none has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: len(words) - size + 1]
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def parity(s: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each place, at four places a shingle or more, a power of two."""
    size = min(MOST, max(PARITY, 1 << (4 * len(s) - 1).bit_length())) if len(s) else PARITY
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of parity words as they would be at fewer places."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _common(texts: DataFrame, size: int) -> np.ndarray:
    """Shingles that many texts of a sample have, the rarest first. The sample doesn't grow beyond some SAMPLE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), size).view(np.int64))], ["s"])

    one_of = max(SAMPLED, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64(F.lit("common"), "t"), F.lit(one_of)) == 0).select("text").distinct()
    often = some.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    got = often.orderBy(F.desc("n"), "s").limit(COMMON).toArrow().column("s").to_numpy()
    return got[::-1].copy().view(np.uint64)


def _sketches(texts: DataFrame, size: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(id, t, h, fp, n, bits, p, prefix) of every row: t stands for the text, h for its set of n shingles, fp is its fingerprint.

    The first p of ``prefix`` are those of which similar sets share one; one more follows, so that they share two.
    """
    order = np.argsort(common)
    sent = texts.sparkSession.sparkContext.broadcast((common[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            yield sketched(whole, *sent.value)

    def sketched(batch: pa.RecordBatch, known: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        h, fp, n, bits, p, prefix = [], [], [], [], [], []
        for x in batch.column(2):
            s = shingles(x.as_py(), size)
            at = np.searchsorted(known, s)
            late = np.zeros(len(s), bool)
            late[at < len(known)] = known[at[at < len(known)]] == s[at < len(known)]
            last = s[late][np.argsort(rank[at[late]])]
            first = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1 if len(s) else 0
            h.append(xxhash.xxh64_intdigest(s.tobytes()))
            fp.append(majority(s))
            n.append(len(s))
            bits.append(parity(s))
            p.append(first)
            prefix.append(np.concatenate([s[~late], last])[: first + 1].view(np.int64))
        made = [*[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (h, fp)], pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(p, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "t", "h", "fp", "n", "bits", "p", "prefix"])

    return texts.select("id", "t", "text").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, t long, h long, fp long, n int, bits binary, p int, prefix array<long>")


class _Cell:
    """Members of one stream of cells, and which of them may be similar enough."""

    def __init__(self, rows: pa.Table, similarity: float) -> None:
        self.h, self.n, self.component = (rows.column(c).to_numpy() for c in ("h", "n", "component"))
        self.similarity, self.apart = similarity, (1 - similarity) / (1 + similarity)
        raw = rows.column("bits").to_pylist()
        self.words, self.place, self.bits = np.array([len(x) // 8 for x in raw]), np.zeros(len(raw), np.int64), {}
        for w in np.unique(self.words).tolist():
            of = np.flatnonzero(self.words == w)
            self.place[of], self.bits[w] = np.arange(len(of)), np.frombuffer(b"".join(raw[k] for k in of), np.uint64).reshape(-1, w)

    def near(self, x: int, at: np.ndarray) -> np.ndarray:
        """Which of the members ``at`` may be similar enough to x."""
        n = self.n[at].astype(np.int64)
        out = np.minimum(n, self.n[x]) >= self.similarity * np.maximum(n, self.n[x]) - 1e-9
        own = self.bits[int(self.words[x])][self.place[x]]
        for w in np.unique(self.words[at[out]]).tolist():
            of = np.flatnonzero(out & (self.words[at] == w))
            least = min(w, len(own))
            far = np.bitwise_count(folded(self.bits[w][self.place[at[of]]], least) ^ folded(own, least)).sum(1, dtype=np.int64)
            out[of] = far <= (n[of] + self.n[x]) * self.apart + 1e-9
        return out

    def pairs(self, low: int, high: int) -> tuple[list, list]:
        """All pairs of different components."""
        a, b = [], []
        for x in range(low, high - 1):
            at = np.arange(x + 1, high)
            at = at[self.component[at] != self.component[x]]
            at = at[self.near(x, at)]
            a += [self.h[x]] * len(at)
            b += self.h[at].tolist()
        return a, b

    def tree(self, low: int, high: int) -> tuple[list, list]:
        """Pairs that join whatever all pairs would: a breadth-first walk, in which linked members leave the rest."""
        a, b, rest = [], [], np.arange(low, high)
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop(0)
                known = self.component[rest] == self.component[x]
                new = np.zeros(len(rest), bool)
                new[~known] = self.near(x, rest[~known])
                a += [self.h[x]] * int(new.sum())
                b += self.h[rest[new]].tolist()
                queue += rest[known | new].tolist()
                rest = rest[~(known | new)]
        return a, b


def _meet(similarity: float, trees: bool):
    """Pairs within sorted cells that may be similar enough, of different components; with ``trees`` only a tree where a bucket is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["token", "i", "j"]):
            token, i, j, members = (whole.column(c).to_numpy() for c in ("token", "i", "j", "members"))
            cell = _Cell(whole, similarity)
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            a, b = [], []
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(token)], strict=True):
                x, y = (cell.tree if trees and members[low] > SMALL else cell.pairs)(low, high)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], ["a", "b"])

    return run


def _candidates(members: DataFrame, similarity: float, trees: bool) -> DataFrame:
    """(a, b): distinct pairs of ``members`` (token, members, h, n, bits, component) that may be similar enough."""
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = members.withColumn("block", F.pmod(F.xxhash64("h"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = placed.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "h", "n", "bits", "component", "members")
    found = cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "h").mapInArrow(_meet(similarity, trees), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, info: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose exact Jaccard similarity is high enough; only their texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, x in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([h.as_py()], pa.int64()), pa.array([shingles(x.as_py(), size).view(np.int64)], pa.list_(pa.int64()))], ["h", "s"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    wanted = table(info.join(ends, "h").select("h", "t"), "wanted")
    # One bit for each value of the hash: rows of 32768 bits, MARKS / 32768 at most, so that broadcasting them is safe.
    mark = F.col("t").bitwiseAND(F.lit(MARKS - 1))
    marks = wanted.groupBy(F.bitmap_bucket_number(mark).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark)).alias("marks"))
    bit = F.bitmap_bit_position(mark)
    byte = F.conv(F.hex(F.substr("marks", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = texts.join(F.broadcast(marks), F.bitmap_bucket_number(mark) == F.col("row")).where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    # Copies of a text are told apart by nothing; one of each is enough, and goes before the shuffle where it can.
    one = some.select("t", "text").distinct().join(wanted.hint("merge"), "t").dropDuplicates(["h"])
    sets, path = materialize(one.select("h", "text").mapInArrow(run, "h long, s array<long>"), "sets")
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("x")).hint("merge"), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("y")).hint("merge"), "b")
    same = F.size(F.array_intersect("x", "y"))
    links = table(both.where(same / (F.size("x") + F.size("y") - same) >= similarity).select("a", "b"), "links")
    drop(texts.sparkSession, path)
    return links


def _close(info: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs of sets whose fingerprints are equal or linked by covering LSH."""
    first = table(info.groupBy("fp").agg(F.min("h").alias("r")), "fingerprints")
    equal = info.select("h", "fp").join(first, "fp").where("h != r").select(F.col("h").alias("a"), F.col("r").alias("b"))
    near = covering_links(first.select("fp"), radius).distinct()
    near = near.join(first.select(F.col("fp").alias("a"), F.col("r").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("r").alias("y")), "b")
    return near.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _placed(info: DataFrame, links: DataFrame) -> DataFrame:
    """info with each set's component of the links."""
    known = connected_components(links).withColumnRenamed("node", "h")
    return info.join(known, "h", "left").withColumn("component", F.coalesce("component", "h"))


def _met(keys: DataFrame) -> DataFrame:
    """(members, token, a, b): tokens of ``keys`` (token, h, component) that sets of several components have, a and b among them.

    Tokens at which the same sets meet are as good as one of them; those of one component need no comparison.
    """
    met = keys.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("c"), F.max("component").alias("d"), F.min("h").alias("a"), F.max("h").alias("b"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y"))
    return table(met.where("c != d").groupBy("members", "x", "y").agg(F.min("token").alias("token"), F.min("a").alias("a"), F.min("b").alias("b")), "met")


def _members(keys: DataFrame, met: DataFrame) -> DataFrame:
    """(token, members, h): the sets that have the tokens of ``met``."""
    two = met.where("members = 2").select("token", "members", F.explode(F.array("a", "b")).alias("h"))
    return two.unionByName(keys.join(met.where("members > 2").select("token", "members"), "token").select("token", "members", "h"))


def _buckets(placed: DataFrame, similarity: float) -> DataFrame:
    """(token, members, h): where sets meet of which no component is known that joins them.

    Two sets that share a token of their prefixes meet there, and at their first two common tokens where the first has
    over ``SPLIT`` sets. From a similarity of more than a half on, different sets that are similar have two in common.
    """
    own = placed.select("h", "component", "prefix", F.posexplode(F.slice("prefix", 1, F.col("p"))).alias("at", "token"))
    keys = own.select("h", "component", "token")
    met = _met(keys)
    hot = met.where(F.col("members") > SPLIT).select("token")
    if similarity <= 0.5 or hot.isEmpty():
        return _members(keys, met)
    later = F.explode(F.slice("prefix", F.col("at") + 2, F.size("prefix")))
    twice = own.join(hot, "token").select("h", "component", "token", later.alias("next")).select("h", "component", F.xxhash64("token", "next").alias("token"))
    return _members(keys, met.where(F.col("members") <= SPLIT)).unionByName(_members(twice, _met(twice)))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """Each row's fingerprint and the component of its near-duplicates.

    Returns (id_col, fingerprint, component_id) as ``simhash.near_duplicates`` does; links are all pairs of a Jaccard
    similarity of ``similarity`` or more, and a fingerprint is that of the text's distinct shingles. ``radius`` only
    decides how many links covering LSH finds before prefixes do. Texts without words are alike, and like no other. Null
    texts have no words; ids may be null or repeat; an empty table gives an empty result; other columns aren't read.
    """
    with batches_for_a_while(docs.sparkSession):
        return _near_duplicates(docs, shingle, similarity, id_col, text_col, radius)


def _near_duplicates(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str, radius: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    seen, path = materialize(_sketches(texts, shingle, similarity, _common(texts, shingle)), "sketches")
    ids = table(seen.select("id", "h", "fp"), "ids")
    info = table(seen.groupBy("h").agg(F.min("id").alias("first"), F.first(F.struct("t", "fp", "n", "bits", "p", "prefix")).alias("s")).select("h", "first", "s.*"), "distinct")
    drop(spark, path)

    pairs = table(_close(info, radius), "pairs")
    links = _confirmed(pairs, texts, info, shingle, similarity)
    placed, path = materialize(_placed(info.drop("first", "t", "fp"), links), "placed")
    members = table(_buckets(placed, similarity), "members")

    known = placed.select("h", "n", "bits", "component")
    pairs = pairs.unionByName(table(_candidates(members.join(known, "h"), similarity, True).join(pairs, ["a", "b"], "left_anti"), "pairs"))
    links = links.unionByName(_confirmed(pairs, texts, info, shingle, similarity))
    large = members.where(F.col("members") > SMALL)
    if not large.isEmpty():
        known = _placed(known.drop("component"), links)
        large = large.join(known, "h")
        apart = large.groupBy("token").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c != d").select("token")
        rest = table(_candidates(large.join(apart, "token"), similarity, False).join(pairs, ["a", "b"], "left_anti"), "pairs")
        if not rest.isEmpty():
            links = links.unionByName(_confirmed(rest, texts, info, shingle, similarity))

    linked = connected_components(links).withColumnRenamed("node", "h")
    named = linked.join(info, "h").groupBy("component").agg(F.min("first").alias("least"))
    other = linked.join(named, "component").select("h", "least", F.lit(True).alias("linked"))
    whole = table(info.select("h", "first").join(other, "h", "left").select("h", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id")), "whole")
    drop(spark, path)
    return ids.join(whole, "h").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
