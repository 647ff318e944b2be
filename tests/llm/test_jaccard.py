"""The pipeline's near duplicates against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

import corpus_pipeline as pipeline
from plumbline.llm import jaccard
from tests.llm import brute


def sets(text: str | None) -> set:
    w = brute.lower(text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()


def firsts(rows: list[tuple]) -> dict:
    s = [sets(t) for _, t in rows]
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    root = brute.components(len(rows), ((i, j) for i, j in combinations(range(len(rows)), 2) if alike(s[i], s[j])))
    least: dict = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return {i: least[r] for (i, _), r in zip(rows, root, strict=True)}


def edited(seed: int, groups: int, copies: int) -> list[tuple]:
    """Copies of texts with some words changed or cut off at an end: similarities on both sides of 0.8."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([5, 6, 9, 40, 150, 400]))]
        for _ in range(copies):
            w = base[r.randrange(1 + len(base) // 8) :]
            for _ in range(r.randrange(1 + len(base) // 40)):
                w[r.randrange(len(w))] = word()
            out.append((len(out), " ".join(w)))
    r.shuffle(out)
    return out


def test_the_stage_keeps_the_first_of_all_pairs_of_similar_shingles(spark, small, documents, texts):
    want = firsts(texts)
    got = {r.doc_id for r in pipeline.distinct(spark, documents, small).collect()}
    assert got == set(want.values())
    assert len(got) < len({c for _, c in brute.op1(texts, pipeline.SHINGLE, pipeline.RADIUS).values()})


@pytest.mark.parametrize(("limits", "groups", "copies"), [((64, 4096, 1 << 15), 40, 8), ((3, 5, 1 << 15), 12, 20), ((3, 4, 2), 12, 20), ((16, 4096, 6), 12, 20)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, limits, groups, copies):
    for name, value in zip(("SMALL", "BLOCK", "SPLIT"), limits, strict=True):
        monkeypatch.setattr(jaccard, name, value)
    rows = edited(groups, groups, copies)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == firsts(rows)


@pytest.mark.parametrize(("small", "split"), [(2, 1 << 15), (16, 1 << 15), (2, 5)])
def test_a_large_group_of_near_copies_and_what_shares_only_a_passage_with_it(spark, monkeypatch, small, split):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "SPLIT", split)
    r = random.Random(5)
    base = [f"b{n}" for n in range(120)]
    texts = []
    for n in range(150):
        w = list(base)
        for _ in range(n % 4):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join([*base[:30], *(f"y{n}-{k}" for k in range(60))]) for n in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.component_id for x in jaccard.near_duplicates(docs).collect()} == firsts(rows)


def test_a_shingle_of_too_many_sets_is_split_by_the_next_one_without_loss(spark, monkeypatch):
    """All texts begin alike, so they meet at one shingle; few of them share the next ones, and only those are similar."""
    monkeypatch.setattr(jaccard, "SPLIT", 10)
    r = random.Random(9)
    rows = []
    for n in range(60):
        rest = [f"v{n}-{k}" for k in range(14)]
        for _ in range(2):
            rows.append((len(rows), " ".join(["all", "of", "them", "begin", "so", *rest, f"end{r.randrange(10**6)}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select("doc_id", "text").selectExpr("doc_id as id", "text", "xxhash64(text) as t")
    seen = jaccard._sketches(texts, 5, 0.8, jaccard._common(texts, 5)).selectExpr("h", "h as component", "p", "prefix")
    largest = jaccard._buckets(seen, 0.8).agg({"members": "max"}).first()[0]
    assert largest is None or largest <= 10
    assert {x.doc_id: x.component_id for x in jaccard.near_duplicates(docs).collect()} == firsts(rows)


def test_settings_of_the_session_stay(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "5000")
        jaccard.near_duplicates(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
        assert spark.conf.get(names[0]) == "5000" and spark.conf.get(names[1]) == before[1]
    finally:
        spark.conf.set(names[0], before[0])


def test_odd_rows(odd, none):
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(odd).collect()}
    assert got[2] == got[3] == got[4] == 2 and got[12] == 1 and got[6] == got[7] == got[8] == 6 and got[None] in (2, 6)
    assert jaccard.near_duplicates(odd).count() == odd.count() and jaccard.near_duplicates(none).count() == 0
