"""Findings beyond the lists they show."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import findings as fi
from plumbline.operators import statistics as st

IMAGES = "id string, path string, split string, status string, is_grayscale boolean, flags array<string>, blur_score double"


def test_every_affected_image_is_counted_and_listed(spark, monkeypatch):
    monkeypatch.setattr(fi, "IDS", 5)
    images = spark.createDataFrame([(f"i{n:02d}", f"p{n}", "train" if n % 2 else "val", "corrupted" if n < 12 else "ok", False, ["blurry"] if n >= 20 else [], 1.0) for n in range(40)], IMAGES)
    issues = [("tiny_box", f"i{n % 30:02d}", f"l{n}", n) for n in range(60)] + [("missing_label_file", f"i{n:02d}", f"l{n}", None) for n in range(8, 30)] + [("orphan_label", None, "lost", None)]
    issues = spark.createDataFrame(issues, "code string, image_id string, label_path string, line int")
    members = spark.createDataFrame([("g", f"i{n:02d}", f"p{n}", "train" if n % 2 else "val", "s", "exact", "cross_split") for n in range(20, 36)], "group_id string, id string, path string, split string, sha256 string, kind string, scope string")
    boxes = spark.createDataFrame([], "image_id string, split string, class_id int")
    classes = st.by_class(boxes, spark.createDataFrame([(0, "a")], "class_id int, name string"))
    found = {r.id: r for r in fi.build(images, issues, members, members.select("group_id"), boxes, classes).collect()}
    rows = fi.affected(images, issues, members)
    listed = {r.finding: {*r.ids} for r in rows.groupBy("finding").agg(F.collect_list("id").alias("ids")).collect()}
    want = {"integrity_corrupted": range(12), "quality_blurry": range(20, 40), "annotations_tiny_box": range(30), "annotations_missing_label_file": range(12, 30), "leakage_exact": range(20, 36)}
    assert listed == {k: {f"i{n:02d}" for n in v} for k, v in want.items()} and rows.count() == sum(map(len, want.values()))
    for id, v in want.items():
        assert found[id].ids_total == len(v) and len(found[id].ids) == 5 and set(found[id].ids) <= listed[id]
    assert found["annotations_orphan_label"].ids_total == 0
