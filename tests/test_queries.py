"""Every query with SQL against DuckDB, and every other one for rows of a stable schema."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from plumbline import queries as own
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_its_sql(spark, small, duck, name):
    assert compare(own.QUERIES[name](spark, small), duck, own.SQL[name]) == ""


def test_every_sql_has_a_query():
    assert set(own.SQL) <= set(own.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_audits_ask_for_no_number_of_boxes(spark, small):
    """Findings, the gate and the health score read classes and splits of boxes, so no order of all lines is made for them."""
    from plumbline.queries import _Audited

    audited = _Audited(spark, small)
    assert set(audited.boxes.columns) == {"image_id", "class_id", "split"}
    assert "images" not in audited.classes.columns
