"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

Two suffixes are equal to the threshold if their windows of ``size`` bytes are. Sorting all suffixes of all texts would
move many times the corpus, so the first digit is read at a place that equal windows have in common: the smallest hash
of the ``digit``-byte strings in the window (the leftmost of equals). Consecutive windows mostly share it, so a text of n
bytes gives some 2n / (size - digit) first digits, each with the range of window starts that it stands for. Passes:

1. the first digit; one that has a single place in all texts drops out with all its windows;
2. the rest of the window, for those that are left: tasks get whole groups of equal first digits with the bytes around
   them, and order their windows by a 64-bit hash of all ``size`` bytes. The bytes of windows with equal hashes are then
   compared, stretch by stretch; where any differ, the windows at hand are ordered anew by passes over digits of 8 bytes,
   most significant first, in which windows that are alone in their group drop out. Groups of equal windows are the repeats.

A first digit with over ``GROUP`` places isn't brought together: its windows are shuffled one by one instead, by a digest of
128 bits, and counted. Equal texts are taken as one, and are repeats from end to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import groups
from plumbline.plans.store import table

#: Bytes of the first digit; places of one first digit that a task holds; bytes of a long text that are looked at once.
DIGIT, GROUP, SEGMENT = 128, 20_000, 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_tables: dict[int, tuple] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    if not _tables or max(_tables) < n:
        n = 1 << max(16, (n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _tables.clear()
        _tables[n] = tuple(out)
    return next(iter(_tables.values()))


def hashes(data: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes from every place, or from the places ``at``; equal bytes have equal ones."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=total[1:])
    if at is None:
        x = (total[size:] - total[:-size]) * inverse[: len(data) - size + 1]
    else:
        x = (total[at + size] - total[at]) * inverse[at]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def first_digits(data: bytes, size: int, digit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, place, first start, last start) of the first digits of a text's windows, for a segment at a time."""
    w = size - digit + 1
    for s in range(0, len(data) - size + 1, SEGMENT):
        part = np.frombuffer(data, np.uint8, min(SEGMENT + size - 1, len(data) - s), s)
        h = hashes(part, digit)
        packed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        blocks = -(-len(h) // w)
        padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = packed
        grid = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - w + 1
        best = np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)
        starts = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1])
        place = best[starts].astype(np.int64)
        yield h[place].view(np.int64), place + s, starts + s, np.append(starts[1:] - 1, n - 1) + s


class _Seen:
    """Keys that were here before; forgets all of them at times, so that it stays small."""

    def __init__(self, most: int = 200_000) -> None:
        self.keys, self.most = set(), most

    def __call__(self, key: bytes) -> bool:
        if key in self.keys:
            return True
        if len(self.keys) >= self.most:
            self.keys.clear()
        self.keys.add(key)
        return False


def _index(size: int, digit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            rows, parts = [], []
            for n, (t, data) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                if not seen(t.as_py()):
                    for x in first_digits(data.as_py(), size, digit):
                        rows.append(np.full(len(x[0]), n))
                        parts.append(x)
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), batch.column(0).take(pa.array(np.concatenate(rows))), *[pa.array(c.astype(np.int32)) for c in columns[1:]]], ["k", "t", "pos", "s1", "s2"])

    return run


def _contexts(size: int):
    """The bytes of all windows of each place, and in a row without a first digit the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for t, data, at in zip(batch.column("t"), batch.column("data"), batch.column("at"), strict=True):
                key, b = t.as_py(), data.as_py()
                if seen(key):
                    continue
                own = at.values
                k, pos, s1, s2 = (own.field(c) for c in ("k", "pos", "s1", "s2"))
                a, e = s1.to_numpy(), s2.to_numpy() + size
                for i in range(0, len(own), 4096):
                    n = min(4096, len(own) - i)
                    cut = [b[x:y] for x, y in zip(a[i : i + n].tolist(), e[i : i + n].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([k.slice(i, n), pa.array([key] * n, pa.binary()), *[c.slice(i, n) for c in (pos, s1, s2)], pa.array(cut, pa.binary())], ["k", "t", "pos", "s1", "s2", "data"])
                one = lambda x, kind: pa.array([x], kind)
                yield pa.RecordBatch.from_arrays([one(None, pa.int64()), one(key, pa.binary()), *[one(-1, pa.int32())] * 3, one(b, pa.binary())], ["k", "t", "pos", "s1", "s2", "data"])

    return run


def _windows(rows: pa.Table | pa.RecordBatch, size: int) -> tuple[np.ndarray, ...]:
    """(data, row, start, place in data) of all windows of rows with contexts."""
    s1, s2 = rows.column("s1").to_numpy(), rows.column("s2").to_numpy()
    n = (s2 - s1 + 1).astype(np.int64)
    data = np.frombuffer(b"".join(rows.column("data").to_pylist()), np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    base = np.cumsum(n + size - 1) - (n + size - 1)
    return data, row, s1[row] + step, base[row] + step


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place, as numbers; zeros follow the data."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data) + 1,), np.uint64, padded.data, strides=(1,))


def _same_bytes(data: np.ndarray, at: np.ndarray, order: np.ndarray, same: np.ndarray, size: int) -> bool:
    """Whether neighbours in the order that are said to be the same have the same bytes; those of windows that go on in step are compared once."""
    x, y = at[order[:-1][same]], at[order[1:][same]]
    own = np.lexsort((x, y - x))
    x, y = x[own], y[own]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] - x[:-1] > size) | (y[1:] - y[:-1] != x[1:] - x[:-1])
    first = np.flatnonzero(new)
    length = x[np.append(first[1:] - 1, len(x) - 1)] - x[first] + size if len(x) else first
    eights = _eights(data)
    for n in range(0, len(first), 1 << 12):
        a, b, size_of = x[first[n : n + (1 << 12)]], y[first[n : n + (1 << 12)]], length[n : n + (1 << 12)]
        steps = np.maximum(1, -(-size_of // 8))
        of = np.repeat(np.arange(len(a)), steps)
        # The last digit ends where the stretch ends, and may begin within the one before it.
        step = np.minimum((np.arange(len(of)) - (np.cumsum(steps) - steps)[of]) * 8, np.maximum(0, size_of[of] - 8))
        differ = eights[a[of] + step] ^ eights[b[of] + step]
        short = size_of[of] < 8
        differ[short] &= (np.uint64(1) << (size_of[of][short] * 8).astype(np.uint64)) - np.uint64(1)
        if differ.any():
            return False
    return True


def radix_groups(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``size`` bytes, from the places ``at``, equal another, by passes over digits, most significant first."""
    digits = [(d, 8) for d in range(0, size - 7, 8)]
    digits += [(size - size % 8, size % 8)] if size % 8 else []
    eights, left, group = _eights(data), np.arange(len(at)), np.zeros(len(at), np.int64)
    for d, width in digits:
        v = eights[at[left] + d]
        if width < 8:
            v &= np.uint64((1 << 8 * width) - 1)
        order = np.lexsort((v, group))
        left, group, v = left[order], group[order], v[order]
        new = np.ones(len(left) + 1, bool)
        new[1:-1] = (group[1:] != group[:-1]) | (v[1:] != v[:-1])
        alone = new[1:] & new[:-1]
        left, group = left[~alone], np.cumsum(new[:-1])[~alone]
    again = np.zeros(len(at), bool)
    again[left] = True
    return again


def repeated(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Which windows equal another: by their hashes, and if these are wrong, by ``radix_groups``."""
    h = hashes(data, size, at)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not _same_bytes(data, at, order, same, size):
        return radix_groups(data, at, size)
    again = np.zeros(len(at), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again


def _runs(row: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the bytes that windows cover; starts ascend within a row."""
    if not len(row):
        return row, start, start
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    return row[first], start[first], start[np.append(first[1:] - 1, len(row) - 1)] + size


def _sort(size: int, most: int = 2_048):
    """The repeated bytes, by places sorted by first digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["k"]):
            whole = whole.combine_chunks()
            k = whole.column("k").to_numpy()
            cuts = np.concatenate([np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
            at = 0
            while at < len(k):
                to = int(cuts[max(np.searchsorted(cuts, at + most, "right") - 1, np.searchsorted(cuts, at, "right"))])
                rows, at = whole.slice(at, to - at), to
                t = rows.column("t").to_pylist()
                key = list(zip(t, rows.column("pos").to_pylist(), rows.column("s1").to_pylist(), strict=True))
                rows = rows.filter(pa.array([i == 0 or key[i] != key[i - 1] for i in range(len(key))]))
                data, row, start, place = _windows(rows, size)
                again = repeated(data, place, size)
                own, a, b = _runs(row[again], start[again], size)
                yield pa.RecordBatch.from_arrays([rows.column("t").combine_chunks().take(pa.array(own)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["t", "a", "b"])

    return run


def _each(size: int):
    """(w, t, s): every window, as a digest of its bytes, of places whose first digit has too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                data, row, start, place = _windows(rows, size)
                view = memoryview(data)
                w = [hashlib.blake2b(view[x : x + size], digest_size=16).digest() for x in place.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), rows.column("t").take(pa.array(row)), pa.array(start.astype(np.int32))], ["w", "t", "s"])

    return run


def shared_windows(windows: DataFrame, size: int) -> DataFrame:
    """(t, a, b): the bytes of each window (w, t, s) whose digest is found at two places or more."""
    mark = F.xxhash64("t", "s")
    # Read from a table, so that Spark can split a digest with many places: a join above the grouping itself can't be.
    again = table(windows.groupBy("w").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).where("x != y").select("w"), "again")
    return windows.join(again, "w").select("t", F.col("s").alias("a"), (F.col("s") + size).alias("b")).distinct()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal runs: those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for data, spans in zip(batch.column("data"), batch.column("spans"), strict=True):
            b, own = data.as_py(), spans.values
            runs = merged(list(zip(own.field("a").to_pylist(), own.field("b").to_pylist(), strict=True)))
            kept = b"".join(b[x:y] for x, y in zip([0, *[r[1] for r in runs]], [*[r[0] for r in runs], len(b)], strict=True))
            out.append((kept, len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        kept, removed, runs, digest = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["t", "kept", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text", digit: int = DIGIT, group: int = GROUP, with_kept: bool = False) -> DataFrame:
    """What is left of each text without the bytes of every ``size``-byte string that starts in two places or more.

    Returns one row per row of docs: (id_col, n_bytes, n_removed, n_spans, kept_sha256), over UTF-8 bytes, and with
    ``with_kept`` the bytes that are left, in ``kept``. All places of a repeated string are removed, the first one too;
    they may overlap, may lie in one text, and are judged on the texts as they came. Strings don't reach across texts. A
    null text counts as empty; texts shorter than ``size`` have no such strings. Rows with equal texts are repeats of
    each other. Ids may be null or repeat; other columns aren't read. ``digit`` must be less than ``size``.

    Windows count as equal if their bytes are; of first digits with over ``group`` places, if their 128-bit digests are.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # A cast takes the bytes as they are; encode would put others in the place of those that aren't UTF-8.
    rows = rows.select("id", F.col("text").cast("binary").alias("data")).withColumn("sha", F.sha2("data", 256)).withColumn("t", F.unhex(F.substr("sha", F.lit(1), F.lit(32))))
    long = rows.where(F.octet_length("data") >= size).select("t", "data")
    index = table(long.mapInArrow(_index(size, digit), "k long, t binary, pos int, s1 int, s2 int"), "index")
    mark = F.xxhash64("t", "pos")
    met = table(index.groupBy("k").agg(F.min(mark).alias("x"), F.max(mark).alias("y"), F.count("*").alias("n")).where("x != y").select("k", "n"), "met")
    # Both sides of the joins on texts are read from tables, so that Spark can split a text with many copies.
    found = table(index.join(met.select("k"), "k").groupBy("t").agg(F.collect_set(F.struct("k", "pos", "s1", "s2")).alias("at")), "found")
    contexts = table(long.join(found.hint("merge"), "t").mapInArrow(_contexts(size), "k long, t binary, pos int, s1 int, s2 int, data binary"), "contexts")
    places, hot = contexts.where("k is not null"), met.where(F.col("n") > group)
    if hot.isEmpty():
        spans = None
    else:
        # At most one in ``group`` places is such a first digit, so these are few, and no contexts move to meet them.
        few = F.broadcast(hot.select("k"))
        spans = shared_windows(places.join(few, "k", "left_semi").mapInArrow(_each(size), "w binary, t binary, s int"), size)
        places = places.join(few, "k", "left_anti")
    some = places.repartition("k").sortWithinPartitions("k", "t", "pos", "s1").mapInArrow(_sort(size), "t binary, a int, b int")
    spans = (some if spans is None else some.unionByName(spans)).groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    texts = contexts.where("k is null").select("t", "data").join(spans, "t")
    cut = texts.mapInArrow(_cut, "t binary, kept binary, n_removed long, n_spans long, kept_sha256 string")
    # A text that several tasks came upon was cut by each of them, to the same end.
    cut = cut.drop(*[] if with_kept else ["kept"]).groupBy("t").agg(*[F.first(c).alias(c) for c in (["kept"] if with_kept else []) + ["n_removed", "n_spans", "kept_sha256"]])
    copies = rows.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t", F.lit(True).alias("copied"))
    known = table(cut.join(copies, "t", "full_outer"), "known")
    n = F.octet_length("data").cast("long")
    own = rows.select("id", "t", "sha", n.alias("n_bytes"), *[F.col("data")] * with_kept).join(known, "t", "left")
    whole = F.col("copied") & (F.col("n_bytes") >= size)
    pick = lambda all_gone, c, none: F.when(whole, all_gone).otherwise(F.coalesce(F.col(c), none))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    out = [F.col("id").alias(id_col), "n_bytes", pick(F.col("n_bytes"), "n_removed", zero).alias("n_removed"), pick(one, "n_spans", zero).alias("n_spans"), pick(F.lit(hashlib.sha256().hexdigest()), "kept_sha256", F.col("sha")).alias("kept_sha256")]
    return own.select(*out, *[pick(F.lit(b""), "kept", F.col("data")).alias("kept")] * with_kept)
