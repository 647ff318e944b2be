from __future__ import annotations

import random

from plumbline.plans.components import connected_components


def reachable(edges):
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def run(spark, edges, kind="long"):
    df = connected_components(spark.createDataFrame(edges, f"a {kind}, b {kind}"))
    rows = df.collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_chain_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    random.Random(1).shuffle(edges)
    assert run(spark, edges) == reachable(edges)


def test_random_graph(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)]
    assert run(spark, edges) == reachable(edges)


def test_nulls_loops_repeats_and_nothing(spark):
    edges = [(1, None), (None, 2), (3, 3), (4, 5), (5, 4), (4, 5)]
    assert run(spark, edges) == {4: 4, 5: 4}
    assert run(spark, []) == {}


def test_strings(spark):
    assert run(spark, [("b", "a"), ("c", "b"), ("y", "z")], "string") == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}


def test_a_scope_leaves_only_what_is_taken_off_it(spark):
    from pathlib import Path

    from plumbline.plans import store

    with store.scope(spark) as written:
        a, kept = store.materialize(spark.range(3), "kept")
        _, gone = store.materialize(a, "gone")
        written.remove(kept)
    there = lambda p: Path(p.removeprefix("file://")).exists()
    assert there(kept) and not there(gone) and a.count() == 3
