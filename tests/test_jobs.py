"""Work that is watched by its tasks and stopped while it runs."""

from __future__ import annotations

import os
import threading
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from plumbline.errors import Cancelled
from plumbline.plans.jobs import watched
from plumbline.plans.store import shared_dir
from plumbline.service import AuditService
from plumbline.session import AuditSession
from plumbline.sources import demo
from plumbline.sources import images as im


def slow(spark, seconds: float, parts: int = 8):
    def run(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(parts, numPartitions=parts).mapInArrow(run, "id long")


def written(spark) -> set[str]:
    place = f"{urlparse(shared_dir(spark)).path}/plumbline"
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def test_tasks_are_told_within_a_job(spark):
    seen: list[tuple[int, int]] = []
    with watched(spark, None, lambda done, of: seen.append((done, of))):
        assert slow(spark, 1.5, 12).count() == 12
    assert any(0 < d < n for d, n in seen) and all(d <= n for d, n in seen)
    n = len(seen)
    slow(spark, 0.3, 2).count()
    assert len(seen) == n and not spark.sparkContext.getJobTags()


def test_a_running_job_is_stopped_and_others_go_on(spark):
    stop, other = threading.Event(), []
    beside = threading.Thread(target=lambda: other.append(slow(spark, 1, 2).count()))
    beside.start()
    timer = threading.Timer(1, stop.set)
    timer.start()
    began = time.monotonic()
    with pytest.raises(Cancelled), watched(spark, stop.is_set):
        slow(spark, 60).count()
    assert time.monotonic() - began < 4
    beside.join()
    assert other == [2]


def test_other_failures_stay_what_they_are(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"), watched(spark, lambda: False):
        spark.range(3).select(F.expr("1 div id")).collect()


def test_an_audit_is_cancelled_within_a_stage(spark, tmp_path, monkeypatch):
    demo.generate(tmp_path / "demo")
    s = AuditService(spark, tmp_path / "home")
    monkeypatch.setattr(im, "measure", lambda folder, files, *_: files.join(slow(spark, 60).select(F.lit(1).alias("one")), F.lit(True)))
    before = written(spark)
    job = s.submit(str(tmp_path / "demo"))
    while job.stage != "images":
        time.sleep(0.1)
    time.sleep(3)
    began = time.monotonic()
    s.cancel(job.id)
    s.wait()
    assert job.status == "cancelled" and time.monotonic() - began < 3 and not s.audits()
    assert written(spark) == before


def test_a_failed_audit_leaves_no_tables(spark, tmp_path, monkeypatch):
    demo.generate(tmp_path / "demo")
    monkeypatch.setattr(im, "described", lambda *_: 1 / 0)
    before = written(spark)
    with pytest.raises(ZeroDivisionError):
        AuditSession(spark).run(tmp_path / "demo")
    assert written(spark) == before
