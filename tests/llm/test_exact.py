"""Top-k search, decontamination and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, suffix, topk
from plumbline.llm.queries import SQL, op7_topk, op9_decontaminate, op10_repeats
from tests.llm import brute
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", ["op7_topk", "op9_decontaminate", "op10_repeats"])
def test_queries_equal_their_sql(spark, small, name):
    query = {"op7_topk": op7_topk, "op9_decontaminate": op9_decontaminate, "op10_repeats": op10_repeats}[name]
    assert compare(query(spark, small), connect(small), SQL[name]) == ""


VECTORS = "vec_id long, embedding array<float>, score long, rank int"


def top(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], VECTORS)
    return {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, **more).select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("blocks", [(8192, 1024), (50, 3)])
def test_top_k_in_blocks_with_ties(spark, blocks):
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.25, 1.0, 3.0]) for _ in range(6)]) for i in range(300)] + [(i, [1.0] * 6) for i in range(300, 360)]
    assert top(spark, rows, block=blocks[0], query_block=blocks[1]) == brute.op7(rows)


def test_a_vector_that_most_rows_have_and_repeated_rows(spark):
    r = random.Random(4)
    rows = [(i, [1.5, -2.0, 0.25, 3.0] if i % 3 else [r.gauss(0, 40) for _ in range(4)]) for i in range(900)]
    assert top(spark, rows, block=64, query_block=7) == brute.op7(rows)
    assert top(spark, rows, block=64, query_block=7, shift=4) == brute.op7(rows)
    some = [(1, [1.0, 1.0])] * 5 + [(20, [1.0, 0.0])] + [(2, [1.0, 1.0])] * 30 + [(3, [9.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in some], VECTORS)
    got = [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 3, 64 * 64 * 9)] + [(20, n, 1 if n < 7 else 2, 64 * 64) for n in range(2, 21)]


def test_scores_beyond_64_bits_stay_with_their_rows(spark):
    """Large vectors are clipped where they don't fit, and no other score changes."""
    most = (1 << 63) - 1
    rows = [(20, [1.0, 2.0]), (40, [1e300, 1.0]), (1, [3.0, 1.0]), (2, [1e300, 1e300]), (3, [-1e300, 5.0]), (4, [1e16, -1e16]), (60, [1e16, 1e16])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [max(-most - 1, min(most, math.floor(64 * x))) for x in v] for i, v in rows}
    score = lambda a, b: max(-most - 1, min(most, sum(x * y for x, y in zip(ints[a], ints[b], strict=True))))
    want = set()
    for q in (20, 40, 60):
        best = sorted((-score(q, i), i) for i in ints if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()} == want


def test_cells_bound_the_products():
    r = random.Random(6)
    for size in (1, 200, 5000, 1 << 40):
        v = np.array([[r.randrange(-size, size + 1) for _ in range(8)] for _ in range(30)], object)
        t = np.array([max(0, int(max(max(x), -1 - min(x))).bit_length() - 7) for x in v])
        c = np.array([[int(x) >> int(b) for x in row] for row, b in zip(v, t, strict=True)], np.int64)
        assert c.min() >= -128 and c.max() <= 127
        q = np.array([[r.randrange(-size, size + 1) for _ in range(8)] for _ in range(5)], np.int64)
        low, up = topk.bounds(q, c.astype(np.int8), t)
        exact = q.astype(object) @ v.T
        assert (low <= exact).all() and (exact <= up).all()
        if not t.any():
            assert (low == exact).all() and (up == exact).all()


@pytest.mark.parametrize("shift", [0, 3, 6])
def test_cells_of_any_width_give_the_same(spark, shift):
    r = random.Random(shift)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(200)]
    assert top(spark, rows, shift=shift) == brute.op7(rows)


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [1.0, None]), (80, [inf, 0.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5, 0.5]), (100, [1.0, 1.0, 1.0]), (3, []), (120, [2e6, -3e6]), (4, [1e6, 1e6])]
    assert top(spark, rows) == brute.op7(rows)
    assert top(spark, []) == set() and top(spark, [(0, [1.0])]) == set()


def matched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit(1), "h": F.lit(2), "term": F.lit("x"), "words": F.lit("x")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("x"))
    return decontaminate.match(d, i, **more).collect()


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_of_made_texts(spark, limit):
    r = random.Random(8)
    word = lambda: r.choice("the of a b c d e f g Éé x1 x2 x3 x4 x5 x6".split())
    items = [(n, " ".join(word() for _ in range(r.choice([1, 2, 5, 9, 10, 11, 25])))) for n in range(12)] + [(50, ""), (51, None), (52, "...")]
    docs = []
    for n in range(80):
        text = [word() for _ in range(r.randrange(0, 120))]
        if r.random() < 0.6:
            w = (r.choice(items[:12])[1]).split()
            a = r.randrange(max(1, len(w) - 9))
            at = r.randrange(len(text) + 1)
            text[at:at] = w[a : a + r.choice([9, 10, 12, 30])]
        docs.append((n, r.choice([" ", ", ", "\n"]).join(text)))
    docs += [(200, None), (201, ""), (202, "--")]
    got = {x.doc_id: (x.n_words, x.n_hit, len(x["items"]), brute.sha(",".join(x["items"]))) for x in matched(spark, docs, items, broadcast_bytes=limit)}
    assert got == brute.op9(docs, items)


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_long_texts_and_a_term_that_all_have(spark, limit):
    r = random.Random(9)
    item = [f"k{n}" for n in range(40)]
    items = [(1, " ".join(item)), (2, " ".join(["the"] * 12)), (3, "the k3 the"), (4, None)]
    docs = [(n, " ".join(["the"] * 2000 + [f"u{r.randrange(50)}" for _ in range(3000)] + item[n % 30 : n % 30 + 11])) for n in range(12)] + [(50, "k3 the"), (51, "x the k3 the y")]
    got = {x.doc_id: (x.n_words, x.n_hit, len(x["items"]), brute.sha(",".join(x["items"]))) for x in matched(spark, docs, items, broadcast_bytes=limit)}
    assert got == brute.op9(docs, items)


def test_proximity_and_repeated_rows(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    docs = [(1, " ".join(words)), (2, " ".join(words[::-1])), (2, " ".join(words[::-1])), (3, " ".join(words[:9])), (None, "x " + " ".join(words))]
    rows = sorted(((x.doc_id, x.n_hit, list(x["items"]), list(x.near_items)) for x in matched(spark, docs, [(7, " ".join(words))])), key=repr)
    assert rows == [(1, 10, ["7"], ["7"]), (2, 0, [], ["7"]), (2, 0, [], ["7"]), (3, 0, [], []), (None, 10, ["7"], ["7"])]


def test_odd_rows_of_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and then"), (2, "one")], "item_id long, text string")
    rows = decontaminate.match(odd, items).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if r.n_hit} == {1, 5, 12}
    assert decontaminate.match(none, items).count() == 0
    assert {r.n_hit for r in decontaminate.match(odd, items.limit(0)).collect()} == {0}
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4


@pytest.mark.parametrize(("size", "digit", "group"), [(12, 4, 20_000), (12, 4, 2), (12, 11, 3), (5, 1, 20_000)])
def test_repeats_of_made_texts(spark, size, digit, group):
    r = random.Random(size * digit + group)
    parts = ["".join(r.choice("abé") for _ in range(r.randrange(1, 30))) for _ in range(25)]
    docs = [(n, "".join(r.choice(parts) for _ in range(r.randrange(0, 7)))) for n in range(70)] + [(100, None), (101, ""), (102, "z" * 40), (103, "ab" * 30)]
    docs += [(104, docs[3][1]), (105, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = suffix.remove_repeats(df, size=size, digit=digit, group=group, with_kept=True).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows} == brute.op10(docs, size)
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in rows)


def thue_morse(order: int, flip: bool) -> str:
    s = [flip]
    while len(s) < 1 << order:
        s += [not x for x in s]
    return "".join("ab"[x] for x in s)


def test_equal_hashes_of_different_bytes(spark):
    """Thue-Morse strings and their opposites agree in the low bits of any polynomial modulo 2**64, all 64 of them if long enough."""
    x, y = thue_morse(11, False), thue_morse(11, True)
    data = np.frombuffer((x + y).encode(), np.uint8)
    h = suffix.hashes(data, 2048, np.array([0, 2048]))
    assert x != y and h[0] == h[1]
    assert not suffix.repeated(data, np.array([0, 2048]), 2048).any()
    assert suffix.repeated(np.append(data, data), np.array([0, 2048, 4096, 6144]), 2048).all()
    docs = [(1, x + "1"), (2, y + "2"), (3, "3" + x), (4, "4" * 30 + y + "5")]
    df = spark.createDataFrame(docs[:2] + [docs[3]], "doc_id long, text string")
    for group in (20_000, 1):
        rows = suffix.remove_repeats(df, size=2048, group=group).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute.op10([docs[0], docs[1], docs[3]], 2048)


@pytest.mark.parametrize("size", [3, 8, 13, 24])
def test_radix_passes_and_comparisons_agree(size):
    r = random.Random(size)
    data = np.array([r.randrange(2) for _ in range(700)] + [0] * 60, np.uint8)
    at = np.arange(len(data) - size + 1)
    windows = [data[i : i + size].tobytes() for i in at]
    want = [windows.count(w) > 1 for w in windows]
    assert suffix.radix_groups(data, at, size).tolist() == want == suffix.repeated(data, at, size).tolist()


def test_long_texts_are_looked_at_in_segments(spark, monkeypatch):
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(5000))
    data = (text + text[1000:1600] + "tail").encode()
    whole = list(suffix.first_digits(data, 400, 128))
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    parts = list(suffix.first_digits(data, 400, 128))
    assert len(whole) == 1 and len(parts) > 1
    flat = lambda found: {(int(k), int(p), s) for x in found for k, p, a, b in zip(*x, strict=True) for s in range(a, b + 1)}
    assert flat(whole) == flat(parts) and len(flat(whole)) == len(data) - 399


def test_odd_rows_of_repeats(odd, none):
    rows = suffix.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert got[6][0].n_removed == got[6][0].n_bytes and got[7][0].n_removed > 400 and got[2][0].n_bytes == 0
    assert got[10][0].n_removed == 60000 and got[12][0].n_removed == 0
    assert suffix.remove_repeats(none).count() == 0


def test_bytes_that_are_no_utf8_stay_as_they_are(spark):
    """Such texts come from files of other encodings; they are counted, compared and kept byte by byte."""
    data = [(1, b"\xff\xfe" * 300 + b"abc" * 200), (2, b"\xff\xfe" * 300 + b"q"), (3, b"\xf0\x9f" * 150), (4, b"\xc3\xa9" * 100 + b"\xff" * 500)]
    docs = spark.createDataFrame([(i, bytearray(b)) for i, b in data], "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.remove_repeats(docs).collect()}
    none = hashlib.sha256().hexdigest()
    kept = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {1: (1200, 1200, 1, none), 2: (601, 600, 1, kept(b"q")), 3: (300, 0, 0, kept(data[2][1])), 4: (700, 500, 1, kept(b"\xc3\xa9" * 100))}


def test_a_window_with_many_places_is_split(spark):
    """One digest with most of the windows doesn't stay in one task, and all its places are found."""
    own = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        w = F.when(F.col("id") % 4 > 0, F.lit("same")).otherwise(F.col("id").cast("string")).cast("binary")
        found = suffix.shared_windows(spark.range(0, 20_000, 1, 16).select(w.alias("w"), F.col("id").cast("string").cast("binary").alias("t"), F.lit(3).alias("s")), 400)
        rows = found.collect()
        assert {(int(x.t), x.a, x.b) for x in rows} == {(n, 3, 403) for n in range(20_000) if n % 4} and len(rows) == 15_000
        assert "SortMergeJoin(skew=true)" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
