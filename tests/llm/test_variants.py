"""Spelling variants against all pairs."""

from __future__ import annotations

import random

import pytest

from plumbline.llm import variants
from plumbline.llm.queries import SQL, op12_variants
from tests.llm import brute
from tests.oracle import compare, connect


def test_query_equals_its_sql(spark, small):
    assert compare(op12_variants(spark, small), connect(small), SQL["op12_variants"]) == ""


def test_query_equals_brute_force(spark, small, texts):
    got = {tuple(r) for r in op12_variants(spark, small).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute.op12(texts)
    assert any(r[1] for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_words_of_few_letters(spark, seed):
    """Many words of two or three letters of the alphabet: runs of one letter, words that are prefixes of others, crowded nodes."""
    r = random.Random(seed)
    letters = ["ab", "abc", "aé", "aaab"][seed]
    words = {"".join(r.choice(letters) for _ in range(r.randrange(0 if seed == 2 else 1, 9))) for _ in range(300)}
    counts = {w: r.choice([1, 2, 3, 5, 5, 10, 25, 26, 125, 700]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(x) for x in variants.grouped(df).collect()} == brute.grouped(counts)


def test_long_chains_and_hubs(spark):
    counts = {"a" * k: 5 ** (12 - k) for k in range(1, 12)}
    counts |= {f"hub{chr(0xC0 + k)}x": 7 for k in range(60)} | {"hubx": 50}
    rows = {x.word: x for x in variants.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert {tuple(x) for x in rows.values()} == brute.grouped(counts)
    assert rows["a" * 11].root == "a" and rows["hubÀx"].root == "hubx" and rows["hubx"].n_near == 60


def test_light_edges_are_few(spark):
    r = random.Random(5)
    words = {"".join(r.choice("abcdefgh") for _ in range(10)) for _ in range(500)} | {"common" + "".join(r.choice("xyz") for _ in range(4)) for _ in range(80)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    assert variants.light_edges(df).groupBy("word").count().agg({"count": "max"}).first()[0] <= len(words).bit_length()


def test_odd_rows(spark, odd, none):
    rows = variants.variants(odd, least=1, count=1, every=3).collect()
    text = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in rows} == brute.op12(text, least=1, count=1, every=3)
    assert variants.variants(none).count() == 0 and variants.grouped(spark.createDataFrame([(None, 3)], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        variants.variants(odd, ratio=1)
