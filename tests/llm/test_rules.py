"""Quality rules against measures written out in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import rules
from plumbline.llm.queries import SQL, op11_rules
from tests.llm import brute
from tests.oracle import compare, connect


def test_query_equals_its_sql(spark, small):
    assert compare(op11_rules(spark, small), connect(small), SQL["op11_rules"]) == ""


def test_query_equals_brute_force(spark, small, texts):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in op11_rules(spark, small).collect()}
    assert got == {i: brute.op11(t) for i, t in texts}


def test_good_documents_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{d}/labels.parquet").join(op11_rules(spark, d), "doc_id").where("not base_failed")
    good, bad = (known.where(f"quality = {q}") for q in (1, 0))
    assert good.where("kept").count() >= 0.98 * good.count() and bad.where("not kept").count() == bad.count() > 0


def test_measures_of_made_texts(spark):
    r = random.Random(3)
    word = lambda: r.choice(["a", "b", "the", "x#y", "12", "é", "...", "-", "$", "und,"])
    made = ["".join(word() + r.choice([" ", " ", " ", "\n", "\t ", "\r\n", " \x0b"]) for _ in range(r.randrange(0, 70))) for _ in range(60)]
    made += ["", " ", "\n\n", "one", "a b", "a b c", "a b c a b c", "a a a a", "a a a a a", "same\nsame\n same\nsame \n\n\n", "- x\n* y\nz...\nw…", "a\0b \0 \0 \0 \0"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for row in rules.judged(df).collect():
        m = row.rules
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute.op11(made[row.doc_id])[:5], made[row.doc_id]
        words, lines = brute.WORDS.findall(made[row.doc_id]), [x for x in made[row.doc_id].split("\n") if brute.WORDS.search(x)]
        stop = {x for y in rules.STOP_WORDS.values() for x in y.split()}
        assert m.n_lines == len(lines) and m.n_unlettered == sum(not any(c.isalpha() for c in w) for w in words)
        assert m.n_stop_words == sum(w.strip(rules.MARKS).lower() in stop for w in words)
        assert m.n_bullets == sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in lines) and m.n_ellipses == sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*$", x)) for x in lines)


def test_windows_whose_hashes_agree_are_told_by_their_words(spark, monkeypatch):
    monkeypatch.setattr(rules.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d a b c")], "doc_id long, text string")
    assert {r.doc_id: r.rules.n_repeat_words for r in rules.judged(df).collect()} == {1: 0, 2: 6}


@pytest.mark.parametrize(("rule", "text", "broken"), [
    (rules.Rule("r", "n_words", low=2_000), "a", True), (rules.Rule("r", "n_words", low=2_000), "a b", False), (rules.Rule("r", "n_words", high=2_000), "a b c", True),
    (rules.Rule("r", "n_symbols", "n_words", high=500), "a #", False), (rules.Rule("r", "n_symbols", "n_words", high=499), "a #", True), (rules.Rule("r", "n_symbols", "n_words", low=1), "", False), (rules.Rule("r", "n_symbols", "n_words"), "#", False),
])
def test_bounds(spark, rule, text, broken):
    row = rules.judged(spark.createDataFrame([(text,)], "text string"), [rule]).first().rules
    assert row.failed == (["r"] if broken else []) and row.kept is not broken


def test_odd_rows(odd, none):
    rows = rules.judged(odd, out="words").collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter((r.doc_id, r.text, r.source) for r in odd.collect())
    assert {r.words.n_words for r in rows if not (r.text or "").strip()} == {0} and not any(r.words.kept for r in rows if not r.text)
    long = next(r.words for r in rows if r.doc_id == 9)
    assert long.n_repeat_words == 30000 and long.failed == ["repeated_words"] + [x for x in long.failed if x != "repeated_words"]
    assert rules.judged(none).count() == 0 and rules.kept(odd).columns == odd.columns
    assert rules.judged(odd, []).where("rules.kept").count() == odd.count()
