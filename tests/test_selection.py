"""Order statistics and running totals without one task for all."""

from __future__ import annotations

import random
import statistics

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import statistics as st
from plumbline.plans import selection
from plumbline.plans.ranks import numbered, running


def groups(seed: int) -> dict[str | None, list[float]]:
    r = random.Random(seed)
    return {
        "even": [r.gauss(0, 1) for _ in range(1000)], "odd": [r.lognormvariate(0, 30) for _ in range(1001)], "two": [0.0] * 500 + [1.0] * 500, "same": [7.5] * 400,
        "one": [3.0], "pair": [1.0, 2.0], "hot": [5.0] * 600 + [r.random() for _ in range(401)], None: [-1.0, 4.0, 9.0],
    }


@pytest.mark.parametrize(("fraction", "accuracy"), [(0.5, 10_000), (0.5, 20), (0.25, 50), (0.99, 30), (0.0, 10), (1.0, 10)])
def test_quantiles_are_exact(spark, fraction, accuracy):
    data = groups(int(fraction * 100))
    df = spark.createDataFrame([(g, v) for g, x in data.items() for v in [*x, None]] + [("none", None)], "g string, v double").repartition(5)
    got = {r.g: r for r in selection.described(df, "v", "g", fraction, accuracy).collect()}
    assert set(got) == set(data)
    for g, x in data.items():
        assert got[g]["at"] == pytest.approx(float(np.quantile(x, fraction)), rel=1e-12, abs=1e-12)
        assert (got[g].n, got[g].min, got[g].max, got[g].mean) == (len(x), min(x), max(x), pytest.approx(statistics.fmean(x), rel=1e-9, abs=1e-12))


def test_a_sketch_that_misses_the_rank_is_given_up(spark, monkeypatch):
    monkeypatch.setattr(selection.F, "percentile_approx", lambda *_: F.array(F.lit(900.0), F.lit(950.0)))
    df = spark.range(1001).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    assert selection.described(df, "v", "g").first()["at"] == 500.0


def test_describe(spark):
    df = spark.createDataFrame([(3,), (1,), (None,), (2,), (10,)], "v int")
    assert tuple(st.describe(df, "v").first()) == (4, 1, 10, 4.0, 2.5)
    assert tuple(st.describe(df.where("v is null"), "v").first()) == (0, None, None, None, None)
    assert tuple(st.describe(df.withColumn("v", F.col("v").cast("double")).union(spark.sql("select double('nan')")), "v").first())[-1] == 3.0


def test_no_exact_percentile_over_rows(spark):
    plan = st.describe(spark.range(10), "id")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_running_totals_and_numbers(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), n, r.randrange(9)) for n in range(500)]
    df = spark.createDataFrame(rows, "g string, n int, k long").repartition(7)
    upto: dict = {}
    want = set()
    for g, n, k in sorted(rows, key=lambda x: x[1]):
        upto[g] = upto.get(g, 0) + k
        want.add((g, n, k, upto[g]))
    assert {tuple(x) for x in running(df, "upto", F.col("k"), "n", by=["g"]).collect()} == want
    assert sorted(x.place for x in numbered(df, "place", F.desc("n")).collect()) == list(range(1, 501))
    assert {x.n + x.place for x in numbered(df, "place", F.desc("n")).collect()} == {500}


def test_bounds_are_sketched_once(spark):
    """A sketch is made anew wherever a plan holds it, and its bounds may then differ between the steps."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = selection.described(df, "v", "g")._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" not in plan


def test_values_between_two_are_rounded_as_the_sql_rounds_them(spark):
    r = random.Random(3)
    rows = [(f"g{n}", r.randrange(130_000)) for n in range(40) for _ in range(r.randrange(2, 90))]
    got = {x.g: x["at"] for x in selection.described(spark.createDataFrame(rows, "g string, v long"), "v", "g", 0.9).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE t AS SELECT unnest(?) AS g, unnest(?::BIGINT[]) AS v", [list(x) for x in zip(*rows, strict=True)])
    assert got == dict(c.execute("SELECT g, quantile_cont(v, 0.9) FROM t GROUP BY g").fetchall())
