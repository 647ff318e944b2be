from __future__ import annotations

import csv
import io
import json
import os
import random
from types import SimpleNamespace
from urllib.parse import urlparse

from pyspark.sql import functions as F

from plumbline.plans.store import shared_dir
from plumbline.sinks import parts, reports


def test_json_has_every_row(spark):
    audit = SimpleNamespace(meta={"id": "x"}, tables={"issues": spark.range(100_001), "images": spark.range(1), "none": spark.range(0)})
    got = json.loads(reports.to_json(audit))
    assert sorted(r["id"] for r in got["issues"]) == list(range(100_001)) and "images" not in got and got["none"] == []
    chunks = list(reports.stream_json(audit, include_images=True))
    assert json.loads(b"".join(chunks))["images"] == [{"id": 0}] and max(map(len, chunks)) <= parts.CHUNK
    assert not [n for n in os.listdir(f"{urlparse(shared_dir(spark)).path}/plumbline") if n.startswith("report-")]


def test_csv_lines_are_read_back_in_order(spark, monkeypatch):
    monkeypatch.setattr(parts, "CHUNK", 7)
    r = random.Random(1)
    rows = [(n, r.choice(['a"b', "x,y", "two\nlines", "\r", " blank ", "", None, "é😀"]), r.choice([True, False, None]), r.choice([0.5, None, 12.25])) for n in range(300)]
    df = spark.createDataFrame(rows, "n int, t string, b boolean, d double").repartition(5).orderBy(F.desc("n"))
    text = b"".join(parts.stream(df.select(parts.csv_line(df)))).decode()
    back = list(csv.reader(io.StringIO(text, newline="")))
    assert back == [["" if x is None else str(x) for x in row] for row in rows[::-1]]


def test_joined_lines():
    for cut in range(1, 9):
        text = b"a\nbb\n\nccc\n"
        chunks = (text[i : i + cut] for i in range(0, len(text), cut))
        assert b"".join(parts.joined(chunks, b"|")) == b"a|bb||ccc"
