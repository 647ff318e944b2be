from __future__ import annotations

import pytest

from plumbline.config import Config, Gate, load_config
from plumbline.errors import ConfigError
from plumbline.operators import gate, health, statistics


def scored(spark, cfg=None, **metrics):
    names = ["integrity", "duplicates", "leakage", "annotation_validity", "annotation_coverage", "blur", "image_stats"]
    rates = spark.createDataFrame([tuple(metrics.get(n) for n in names)], ", ".join(f"{n} double" for n in names))
    balance = spark.createDataFrame([(metrics.get("class_balance"),)], "imbalance double")
    return health.components(rates, balance, cfg)


def test_a_rate_takes_its_share(spark):
    zero = dict.fromkeys(["duplicates", "leakage", "annotation_validity", "annotation_coverage", "blur", "image_stats"], 0.0)
    c = scored(spark, integrity=0.025, class_balance=1.0, **zero)
    assert {r.key: r.score for r in c.collect()}["integrity"] == pytest.approx(50)
    o = health.overall(c).first()
    assert (o.overall, o.grade) == (90.0, "A")


def test_what_does_not_apply_is_left_out(spark):
    c = scored(spark, integrity=0.0, class_balance=10.0)
    rows = {r.key: r for r in c.collect()}
    assert rows["class_balance"].score == pytest.approx(50) and rows["leakage"].applicable is False and rows["leakage"].effective_weight == 0
    assert health.overall(c).first().overall == pytest.approx(83.3)
    assert health.overall(scored(spark)).first().overall is None


def test_gate(spark):
    c = scored(spark, integrity=0.02, leakage=0.5)
    findings = spark.createDataFrame([("x", "medium", 3), ("y", "high", 1)], "id string, severity string, affected_count long")
    o = health.overall(c)
    assert gate.evaluate(c, o, findings, Gate(fail_on="critical")) == (gate.PASS, [])
    code, reasons = gate.evaluate(c, o, findings, Gate(fail_on="high", max_corrupt_rate=0.01, fail_under=99))
    assert code == gate.FAIL and len(reasons) == 3
    with pytest.raises(ConfigError):
        gate.evaluate(c, o, findings, Gate(max_leakage_rate=0.1), "validate")


def test_settings(tmp_path):
    p = tmp_path / "plumbline.yaml"
    p.write_text("quality: {blur_threshold: 50}\nscoring: {weights: {leakage: 30}}\nci: {fail_on: null}\n")
    c = load_config(p, {"workers": 2}, {"PLUMBLINE_NO_CACHE": "1"})
    assert (c.quality.blur_threshold, c.scoring.weights["leakage"], c.scoring.weights["blur"], c.ci.fail_on, c.workers, c.use_cache) == (50, 30, 5, None, 2, False)


@pytest.mark.parametrize("bad", [{"quality": {"blur": 1}}, {"quality": {"blur_threshold": "x"}}, {"quality": {"min_side_px": True}}, {"use_cache": 1}, {"ci": {"fail_on": "severe"}}, {"duplicates": {"phash_max_distance": 8}}, {"scoring": {"weights": {"charm": 1}}}, {"scoring": {"zero_at": {"class_balance": 1}}}, {"workers": -1}])
def test_bad_settings(bad):
    with pytest.raises(ConfigError):
        load_config(None, bad, {})


def test_defaults_round_trip():
    assert load_config(None, Config().to_dict(), {}).to_dict() == Config().to_dict()


def test_describe_of_nothing_and_histogram_edges(spark):
    none = spark.createDataFrame([], "x double")
    assert tuple(statistics.describe(none, "x").first()) == (0, None, None, None, None)
    rows = spark.createDataFrame([(-5.0,), (0.0,), (24.9,), (25.0,), (1e9,), (None,)], "x double")
    got = [r["count"] for r in statistics.histogram(rows, "x", *statistics.HISTOGRAMS["blur"]).orderBy("bin").collect()]
    assert got == [3, 1, 0, 0, 0, 0, 1]


def test_balance_needs_two_used_classes(spark):
    c = spark.createDataFrame([(0, "a", 5, 1.0), (1, "b", 0, 0.0)], "class_id int, name string, count long, share double")
    assert statistics.balance(c).first().imbalance is None
    c = spark.createDataFrame([(0, "a", 5, 0.5), (1, "b", 5, 0.5), (2, "c", 0, 0.0)], "class_id int, name string, count long, share double")
    b = statistics.balance(c).first()
    assert (b.imbalance, b.max_class, b.min_class) == (1.0, "a", "a") and b.evenness == pytest.approx(0.6309, abs=1e-4)
