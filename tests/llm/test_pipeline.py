"""The pipeline's stages on documents and on odd rows."""

from __future__ import annotations

import corpus_pipeline as pipeline
from plumbline.llm import decontaminate, mixing, pii, quality, simhash
from plumbline.llm.common import read
from plumbline.plans.store import table
from tests.llm import brute
from tests.llm.test_jaccard import firsts


def test_each_stage_decides_on_what_the_last_one_kept(spark, small, documents):
    docs, steps = documents, {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = table(stage(spark, before, small), name)
        steps[name] = (before, docs)
        if name != "mix":
            assert docs.columns == documents.columns
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = (rows(x) for x in steps["quality"])
    good = {r.doc_id for r in quality.score(documents, quality.train(documents)).where("keep").collect()}
    assert set(after) == good and all(after[i] == before[i] for i in after)

    before, after = (rows(x) for x in steps["near_duplicates"])
    assert set(after) == set(firsts(list(before.items())).values())

    before, after = (rows(x) for x in steps["decontamination"])
    items = [(r.item_id, r.text) for r in read(spark, small, "benchmark").collect()]
    assert set(after) == {i for i, v in brute.op9(list(before.items()), items).items() if not v[1]}

    before, after = (rows(x) for x in steps["personal_data"])
    assert set(after) == set(before)
    found = {i: brute.op8(t) for i, t in before.items()}
    assert all((after[i] == before[i]) or sum(found[i][:4]) or "IBAN" in after[i] for i in before)
    assert all(after[i] != before[i] for i in before if sum(found[i][:4]))
    assert all(r.n_chars == len(r.text) for r in steps["personal_data"][1].collect())

    before, after = steps["mix"]
    want = {tuple(r) for r in mixing.mix(before).where("taken > 0").collect()}
    assert {tuple(r) for r in after.collect()} == want


def test_run_is_all_stages(spark, small):
    out = pipeline.run(spark, small)
    assert out.count() > 0 and out.agg({"taken": "sum"}).first()[0] > 0


def test_stages_on_odd_rows(spark, small, odd, none):
    for docs in (odd, none):
        for _, stage in pipeline.STAGES:
            out = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), small)
            assert out.count() <= docs.count()


def test_stages_call_operators():
    assert all(any(v is m for v in vars(pipeline).values()) for m in (simhash, decontaminate, pii, mixing, quality))
