"""Pages of stored orders against those cut from a sort."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import pages as pg

IMAGES = "id string, path string, file_size long, width int, height int, blur_score double, brightness double, n_boxes long"


@pytest.fixture(scope="module")
def images(spark):
    r = random.Random(1)
    some = lambda x: x if r.random() < 0.9 else None
    return spark.createDataFrame([(f"i{n}", f"p/{n:04d}", some(r.randrange(20)), some(r.randrange(9)), 5, some(r.random()), some(float(r.randrange(4))), r.randrange(3)) for n in range(997)], IMAGES).repartition(6).cache()


@pytest.mark.parametrize(("sort", "descending"), [("path", False), ("size", True), ("blur", False), ("brightness", True)])
def test_pages_are_those_of_a_sort(images, sort, descending):
    want = [r.id for r in pg.ordered(images, sort, descending).collect()]
    stored = pg.Stored(images, pg.order_of(sort, descending), per=100)
    assert stored.total == 997
    for number, size in ((1, 50), (2, 50), (3, 40), (20, 50), (21, 50), (1, 200), (0, 7), (5, 10_000), (10**6, 50)):
        of = max(1, min(pg.MOST, size))
        at = (max(1, number) - 1) * of
        assert [r.id for r in stored.page(number, size).collect()] == want[at : at + of], (number, size)
    assert stored.page(1).columns == images.columns
    stored.drop()


def test_a_deep_page_reads_its_range_alone(spark):
    stored = pg.Stored(spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("id")), [F.asc("id")], per=1_000)
    for number in (1, 500, 1_000):
        own = stored.page(number)
        assert {f.split("range__=")[1].split("/")[0] for f in own.inputFiles()} == {str((number - 1) * 50 // 1_000)}
        assert [r.id for r in own.collect()] == list(range((number - 1) * 50, number * 50))


def test_no_rows(spark):
    stored = pg.Stored(spark.range(0), [F.asc("id")])
    assert stored.total == 0 and stored.page(1).count() == stored.page(9).count() == 0
