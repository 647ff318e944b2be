from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.config import Config, Duplicates
from plumbline.operators import duplicates as du
from plumbline.plans import covering


@pytest.mark.parametrize("distance", [0, 3, 7])
def test_pairs_are_those_of_all_comparisons(spark, distance):
    r = random.Random(distance)
    base = [r.getrandbits(64) for _ in range(12)]
    hashes = []
    for n in range(300):
        x = r.choice(base)
        for _ in range(r.randrange(9)):
            x ^= 1 << r.randrange(64)
        hashes.append((f"i{n:03d}", x - (1 << 64) if x >> 63 else x))
    df = spark.createDataFrame(hashes, "id string, h long")
    mask = (1 << 64) - 1
    want = {(a, b, ((x ^ y) & mask).bit_count()) for a, x in hashes for b, y in hashes if a < b and ((x ^ y) & mask).bit_count() <= distance}
    rows = [tuple(r) for r in du.similar_pairs(df, "h", distance).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("radius", [0, 1, 4, 5, 6, 7])
def test_masks_cover_every_choice_of_bits(radius):
    """However the bits that differ lie, some mask keeps none of them; and every mask keeps about half the bits."""
    made, r = [m & ((1 << 64) - 1) for m in covering.masks(radius)], random.Random(radius)
    assert len(made) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in made) >= (28 if radius > 3 else 1)
    for _ in range(3000):
        x = sum(1 << b for b in r.sample(range(64), radius))
        assert any(not x & m for m in made)


def test_rows_are_copied_alike_at_every_size(spark):
    df = spark.createDataFrame([("a", 5, 1), ("b", 6, 1), ("c", None, 1)], "id string, h long, s long")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    pairs = du.similar_pairs(df, "h", 7, second="s")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 2)]
    assert covering.masked(df.where("h is not null"), "h", 7).count() == 2 * 255


def test_a_crowded_part_loses_no_pair(spark):
    """All hashes agree in 24 bits, and over 5 000 rows with them: the audit still finds every near pair."""
    r = random.Random(1)
    hashes = [r.getrandbits(40) for _ in range(5200)]
    for n in range(0, 400, 2):
        hashes[n + 1] = hashes[n] ^ (1 << r.randrange(40)) ^ (1 << r.randrange(40))
    rows = [(f"i{n:05d}", f"p/{n:05d}", "train", "ok", f"s{n}", h, 5, 50.0) for n, h in enumerate(hashes)]
    members, edges = du.members(spark.createDataFrame(rows, IMAGE), Duplicates())
    want = {frozenset((f"i{n:05d}", f"i{n + 1:05d}")) for n in range(0, 400, 2)}
    assert want <= {frozenset((e.a, e.b)) for e in edges.collect()}
    assert members.count() >= 400


def test_large_groups_are_named_without_a_list(spark, monkeypatch):
    monkeypatch.setattr(du, "NAMED", 3)
    rows = [("r", f"i{n}", f"p{n}", "train" if n < 4 else "test", "s") for n in range(5)] + [("q", f"j{n}", f"q{n}", "val", "t") for n in range(2)]
    members, groups = du.with_groups(spark.createDataFrame(rows, "root string, id string, path string, split string, sha256 string"))
    got = {g.first_path: g for g in groups.collect()}
    assert got["p0"]["size"] == 5 and got["p0"].splits == ["train", "test"] and got["p0"].group_id != got["q0"].group_id
    assert {r.id for r in du.leaked(members).collect()} == {"i4"}


def test_distance_eight_is_refused(spark):
    with pytest.raises(ValueError):
        du.similar_pairs(spark.createDataFrame([("a", 1)], "id string, h long"), "h", 8)


IMAGE = "id string, path string, split string, status string, sha256 string, phash_l long, dhash_l long, contrast double"


def test_groups_leakage_and_tags(spark):
    rows = [
        ("a", "p/a", "train", "ok", "s1", 0, 0, 50.0), ("b", "p/b", "train", "ok", "s1", 0, 0, 50.0), ("c", "p/c", "test", "ok", "s1", 0, 0, 50.0),
        ("d", "p/d", "train", "ok", "s2", 0xFF00FF, 7, 50.0), ("e", "p/e", "val", "ok", "s3", 0xFF00F0, 7, 50.0), ("f", "p/f", "val", "ok", "s4", -1, -1, 50.0),
        ("g", "p/g", "val", "corrupted", "s4", -1, -1, 50.0), ("h", "p/h", "train", "ok", "s5", -2, -1, 0.5),
    ]
    images = spark.createDataFrame(rows, IMAGE)
    members, groups = du.with_groups(*du.members(images, Duplicates()))
    got = {(r.kind, r.scope, tuple(r.splits), r.size, r.unique_files, r.max_distance) for r in groups.collect()}
    assert got == {("exact", "cross_split", ("train", "test"), 3, 1, 0), ("perceptual", "cross_split", ("train", "val"), 2, 2, 4)}
    assert {r.id for r in du.leaked(members).collect()} == {"c", "e"}
    t = du.leakage_totals(images, members).first()
    assert (t.leaked_images, t.eval_images, t.applicable) == (2, 3, True) and t.leakage_rate == pytest.approx(2 / 3)
    pairs = {(r.a, r.b): (r.exact_groups, r.perceptual_groups, r.images_a, r.images_b) for r in du.leakage_pairs(members).collect()}
    assert pairs == {("train", "test"): (1, 0, 2, 1), ("train", "val"): (0, 1, 1, 1)}
    assert du.summary(members, groups).first().redundant_within_split == 1
    own = images.withColumns({"flags": F.array().cast("array<string>"), "is_grayscale": F.lit(False), "label_status": F.lit("ok"), "invalid_lines": F.lit(0)})
    boxes = spark.createDataFrame([("f", ["large"])], "image_id string, flags array<string>")
    tags = {r.id: list(r.tags) for r in du.tags(own, members, boxes, Config()).collect()}
    assert tags["a"] == ["exact_duplicate", "cross_split_leak"] and tags["e"] == ["near_duplicate", "cross_split_leak"]
    assert tags["f"] == ["suspicious_boxes"] and tags["g"] == ["corrupted"] and tags["h"] == []


def test_near_search_can_be_off(spark):
    rows = [("d", "p/d", "train", "ok", "s2", 0, 0, 50.0), ("e", "p/e", "val", "ok", "s3", 1, 0, 50.0), ("x", "p/x", "val", "ok", "s3", 1, 0, 50.0)]
    members, _ = du.members(spark.createDataFrame(rows, IMAGE), Duplicates(enabled=False))
    assert {r.id for r in members.collect()} == {"e", "x"}


def test_no_images(spark):
    members, groups = du.with_groups(*du.members(spark.createDataFrame([], IMAGE)))
    assert members.count() == groups.count() == 0
    assert du.summary(members, groups).first().redundant_within_split == 0


def test_copies_for_the_masks_are_never_gathered_in_the_driver(spark):
    """However small the hashes are as a table, neither side of the join is broadcast."""
    df = spark.range(50).select("id", F.col("id").alias("h"))
    plan = du.similar_pairs(df, "h", 7)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
