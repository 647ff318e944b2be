from __future__ import annotations

import random
from itertools import combinations

import pytest

from plumbline.llm import simhash
from plumbline.llm.queries import op1_simhash
from plumbline.plans.components import connected_components
from tests.llm import brute


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_difference(radius):
    masks = [m & ((1 << 64) - 1) for m in simhash.masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1 and all(20 < m.bit_count() < 60 for m in masks)
    r = random.Random(radius)
    some = list(combinations(range(64), radius)) if radius < 3 else [tuple(r.sample(range(64), radius)) for _ in range(20000)]
    assert all(any(not m & sum(1 << b for b in bits) for m in masks) for bits in some)


def test_query_is_the_brute_force_result(spark, small, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, small).collect()}
    assert got == brute.op1(texts)


def clusters(seed, n=400):
    r = random.Random(seed)
    centers = [r.getrandbits(64) for _ in range(5)]
    out = set(centers)
    while len(out) < n:
        x = r.choice(sorted(out)) if r.random() < 0.3 else r.choice(centers)
        for _ in range(r.randrange(1, 7)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("radius", "bucket"), [(4, 20_000), (4, 3), (3, 3), (2, 2)])
def test_links_have_the_components_of_all_pairs(spark, radius, bucket):
    prints = clusters(radius * 10 + bucket % 7)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in prints}
    distinct = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    found = simhash.links(distinct, radius, bucket)
    roots = {r.node: r.component for r in connected_components(found).collect()}
    root = brute.components(len(prints), ((i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius))
    groups = {}
    for x, r in zip(prints, root, strict=True):
        groups.setdefault(r, set()).add(x)
    mine = {}
    for x in prints:
        mine.setdefault(roots.get(signed[x], signed[x]), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    zero = "0" * 16
    assert {got[2][0], got[3][0], got[4][0]} == {(zero, 2)} and (zero, 2) in got[None]
    assert got[12] == [got[1][0]] * 2 and got[1][0][1] == 1
    assert got[6][0] == got[8][0] and got[6][0][1] == 6 and got[6][0] in got[None]
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each_stays(odd):
    kept = [r.doc_id for r in simhash.first_of_each(odd).collect()]
    assert kept.count(None) == 2 and 12 not in kept and 8 not in kept and kept.count(6) == 1
    twice = odd.where("doc_id = 12")
    assert simhash.first_of_each(twice).count() == 1
    assert simhash.first_of_each(twice).columns == odd.columns


def test_the_first_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "x", "y", 1, 2), (1, "a b c d e f", "x", "y", 1, 2), (2, "a b c d e f", "x", "y", 1, 2), (None, "z", "x", "y", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, _id string, _rows int, __id int")
    out = simhash.first_of_each(df)
    assert out.columns == df.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1]
    assert {tuple(r) for r in out.select("_text", "_id", "_rows", "__id").collect()} == {("x", "y", 1, 2)}
