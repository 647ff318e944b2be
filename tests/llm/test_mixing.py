from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.llm.queries import SQL, op4_mix
from tests.oracle import compare, connect


def test_query_equals_its_sql(spark, small):
    assert compare(op4_mix(spark, small), connect(small), SQL["op4_mix"]) == ""


def shares(sizes, repeats=3):
    """Targets by raising one limit after another, as the words say."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: n % 3 + 1 for n, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > repeats * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: repeats * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 10, None: 5}, {"a": 1, "b": 1, "c": 1000}, {"a": 0, "b": 7}, {"a": 5}, {"a": 3, "b": 3, "c": 3, "d": 3, "e": 900}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([("2" if s is None else "1" + s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows, (F.col("rank") - 1) % 3 + 1).collect()}
    assert got == {"2" if s is None else "1" + s: pytest.approx(t) for s, t in shares(sizes).items()}


def test_taken_words(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert sum(r.taken for r in rows) == sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
        assert r.taken <= 3 * r["size"]
    assert all(abs(n - t) <= len(by) for n, t in by.values())


def test_reruns_and_partitions_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    one = sorted(map(tuple, mixing.mix(docs, range_rows=10).collect()), key=repr)
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(7, "text"), range_rows=10).collect()), key=repr)
    # Ranges only divide the work: where each document starts in the mix is the same.
    assert one == sorted(map(tuple, mixing.mix(docs, range_rows=10_000).collect()), key=repr)


def test_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and sum(r.taken for r in rows) == sum(r["size"] for r in rows)
    by = {(r.doc_id, r["size"]) for r in rows}
    assert (2, 0) in by and (3, 0) in by and (4, 0) in by and (9, 30001) in by
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix(none).count() == 0
    assert {r.taken for r in mixing.mix(odd.where("doc_id in (2, 3, 4)")).collect()} == {0}
