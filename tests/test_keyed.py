"""The keyed store: the latest row of a key, states that switch whole, segments that stay few."""

from __future__ import annotations

import random

import pytest

from plumbline.plans.keyed import KeyedStore
from plumbline.sources import demo, yolo
from plumbline.sources import images as im

ROWS = "k string, p string, v int"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/store", ["k", "p"])


def state(store) -> dict:
    return {(r.k, r.p): r.v for r in store.read().collect()}


def test_latest_rows_win_in_few_segments(spark, store, tmp_path):
    assert store.read() is None
    r, want = random.Random(1), {}
    for n in range(9):
        new = {(f"k{r.randrange(40)}", r.choice("ab")): n for _ in range(r.choice([1, 3, 30]))}
        store.put(spark.createDataFrame([(*k, v) for k, v in new.items()], ROWS))
        want |= new
        assert state(store) == want
        sizes = [s for _, s in store._state()[1]["segments"]]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) <= 2 * len(want)
    store.put(spark.createDataFrame([], ROWS))
    assert state(store) == want and len(list((tmp_path / "store" / "states").glob("0*.json"))) <= 4
    kept = {p.name for p in (tmp_path / "store" / "segments").iterdir()}
    now = store._state()[1]
    assert kept == {n for n, _ in now["segments"]} | set(now["left"])


def test_costs_follow_the_change(spark, store):
    store.put(spark.range(1000).selectExpr("cast(id as string) k", "'a' p", "1 v"))
    first = store._state()[1]["segments"]
    store.put(spark.createDataFrame([("7", "a", 2)], ROWS))
    assert [s for _, s in store._state()[1]["segments"]] == [1000, 1] and store._state()[1]["segments"][0] == first[0]
    assert state(store)["7", "a"] == 2 and len(state(store)) == 1000


def test_a_failed_run_leaves_the_old_state(spark, store, monkeypatch):
    store.put(spark.createDataFrame([("a", "x", 1)], ROWS))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.put(spark.createDataFrame([("a", "x", 1)], ROWS).selectExpr("k", "p", "1 div (v - 1) v"))
    monkeypatch.setattr(store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.put(spark.createDataFrame([("a", "x", 3), ("b", "x", 3)], ROWS))
    assert state(store) == {("a", "x"): 1}


def test_two_writers(spark, store):
    other, first = KeyedStore(spark, store.path, store.key), store._publish
    store.put(spark.createDataFrame([("a", "x", 1)], ROWS))

    def late(number, content):
        store._publish = first
        other.put(spark.createDataFrame([("b", "x", 2), ("c", "x", 2)], ROWS))
        return first(number, content)

    store._publish = late
    store.put(spark.createDataFrame([("c", "x", 3)], ROWS))
    assert state(store) == {("a", "x"): 1, ("b", "x"): 2, ("c", "x"): 3}


def test_only_changed_files_are_measured_again(spark, tmp_path, monkeypatch):
    root, cache = tmp_path / "set", f"file://{tmp_path}/cache"
    for n in range(6):
        (root / "images" / "train").mkdir(parents=True, exist_ok=True)
        (root / "images" / "train" / f"[{n}] a{{b}} é+%41.png").write_bytes(demo.png(demo.scene(n)))
    (root / "labels").mkdir()
    asked: list[int] = []
    measure = im.measure
    monkeypatch.setattr(im, "measure", lambda folder, files, *a: asked.append(files.count()) or measure(folder, files, *a))

    def run(by=im.cached, *more) -> dict:
        found = yolo.discover(spark, root)
        return {r.path: (r.sha256, r.phash_l, r.status) for r in by(found.folder, found.files, *more).collect()}

    first = run(im.cached, cache)
    (root / "images" / "train" / "[3] a{b} é+%41.png").write_bytes(demo.png(demo.scene(9)))
    (root / "images" / "train" / "new.png").write_bytes(demo.png(demo.scene(8)))
    second = run(im.cached, cache)
    assert asked == [6, 2] and len(first) == 6 and {s for _, _, s in second.values()} == {"ok"}
    assert {p for p in second if second[p] != first.get(p)} == {"images/train/[3] a{b} é+%41.png", "images/train/new.png"}
    assert run(im.cached, cache) == second and asked == [6, 2, 0]
    monkeypatch.setattr(im, "FEW", 1)
    assert run(measure) == second
