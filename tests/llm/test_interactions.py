"""Filter interactions against orders that are gone through document by document."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from plumbline.llm import interactions
from plumbline.llm.queries import SQL, op13_interactions
from tests.llm import brute
from tests.oracle import compare, connect

LABELS = "doc_id long, quality int, toxic int"


def test_query_equals_its_sql(spark, small):
    assert compare(op13_interactions(spark, small), connect(small), SQL["op13_interactions"]) == ""


def test_query_equals_brute_force(spark, small, documents):
    docs = [(r.doc_id, r.text, r.source) for r in documents.select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = op13_interactions(spark, small).collect()
    assert len(got) == 600 * len({s for _, _, s in docs}) and {tuple(r) for r in got} == brute.op13(docs, labels)


def test_made_documents(spark):
    r = random.Random(11)
    word = lambda: r.choice(["a", "b", "The", "END", "x1", "x#", "é", "w" + str(r.randrange(300))])
    texts = [" ".join(word() for _ in range(r.choice([0, 10, 49, 50, 51, 90, 200]))) for _ in range(60)]
    docs = [(r.randrange(90) if r.random() < 0.95 else None, r.choice([*texts, None]), r.choice(["a", "b", "", None])) for _ in range(200)]
    docs += docs[:15]
    labels = [(n, r.choice([0, 1, None]), r.choice([0, 1, None])) for n in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("id", "h", "t", "part", "mask", "word", "n_words", "first")})
    got = interactions.audit(df, spark.createDataFrame(labels, LABELS)).collect()
    want = brute.op13(docs, labels)
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (12, 0, 1)], LABELS)
    docs = [(x.doc_id, x.text, x.source) for x in odd.collect()]
    assert {tuple(x) for x in interactions.audit(odd, labels).collect()} == brute.op13(docs, [(1, 1, 0), (12, 0, 1)])
    assert interactions.audit(none, labels).count() == 0
    assert interactions.audit(odd, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
