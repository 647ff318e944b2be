"""Filters, orders and pages over stored audits."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import SEVERITIES
from plumbline.errors import ConfigError
from plumbline.plans.ranks import numbered
from plumbline.plans.store import drop, note, shared_dir

SORTS = {"path": "path", "size": "file_size", "width": "width", "height": "height", "blur": "blur_score", "brightness": "brightness", "annotations": "n_boxes"}
MOST, MOST_GROUPS = 200, 100
#: Rows of a stored order that stand in one range; rows up to which pages are cut from the front of a sort instead.
RANGE, FRONT = 100_000, 1_000


@dataclass
class ImageFilter:
    """What images to show; unset parts don't narrow."""

    split: str | None = None
    status: str | None = None
    q: str | None = None
    tags: list[str] = field(default_factory=list)
    class_id: int | None = None
    ids: DataFrame | None = None
    min_width: int | None = None
    max_width: int | None = None
    min_height: int | None = None
    max_height: int | None = None


def images(rows: DataFrame, f: ImageFilter, boxes: DataFrame | None = None) -> DataFrame:
    """The images that pass. ``error`` and ``duplicate`` are tags for any bad status or line, and for either kind of copy.

    An image without a size fails every bound on it.
    """
    for name in ("split", "status"):
        if (v := getattr(f, name)) is not None:
            rows = rows.where(F.col(name) == v)
    if f.q:
        rows = rows.where(F.lower("path").contains(f.q.lower()))
    for side in ("width", "height"):
        if (v := getattr(f, f"min_{side}")) is not None:
            rows = rows.where(F.col(side) >= v)
        if (v := getattr(f, f"max_{side}")) is not None:
            rows = rows.where(F.col(side) <= v)
    for tag in f.tags:
        if tag == "error":
            rows = rows.where((F.col("status") != "ok") | F.array_contains("tags", "invalid_annotations"))
        elif tag == "duplicate":
            rows = rows.where(F.arrays_overlap("tags", F.array(F.lit("exact_duplicate"), F.lit("near_duplicate"))))
        else:
            rows = rows.where(F.array_contains("tags", tag))
    if f.class_id is not None and boxes is not None:
        rows = rows.join(boxes.where(F.col("class_id") == f.class_id).select(F.col("image_id").alias("id")), "id", "left_semi")
    return rows.join(f.ids, "id", "left_semi") if f.ids is not None else rows


def order_of(sort: str = "path", descending: bool = False) -> list[Column]:
    """By a key and then by path; descending turns both round, and nulls are last going up and first going down."""
    if sort not in SORTS:
        raise ConfigError(f"sort must be one of {', '.join(SORTS)}")
    key = F.col(SORTS[sort])
    return [key.desc_nulls_first(), F.desc("path")] if descending else [key.asc_nulls_last(), F.asc("path")]


def ordered(rows: DataFrame, sort: str = "path", descending: bool = False) -> DataFrame:
    """Rows in the order of ``order_of``."""
    return rows.orderBy(*order_of(sort, descending))


def _bounds(number: int, size: int, most: int) -> tuple[int, int]:
    """The first and the last place of a page, from 1; its number is 1 or more and its size from 1 to ``most``, or else is made so."""
    size = max(1, min(most, size))
    last = max(1, number) * size
    return last - size + 1, last


def page(rows: DataFrame, number: int = 1, size: int = 50, most: int = MOST) -> DataFrame:
    """The rows of a page near the front. All rows up to its last go through one task; ``Stored`` has pages of any depth."""
    first, last = _bounds(number, size, most)
    return rows.offset(first - 1).limit(last - first + 1)


class Stored:
    """Rows in an order that is made once and written in ranges of places, of which a page reads one or two.

    ``total`` is how many there are. Rows that the order doesn't tell apart keep the places they got when it was made.
    """

    def __init__(self, rows: DataFrame, order: list[Column], per: int = RANGE) -> None:
        self.spark, self.schema, self.per = rows.sparkSession, rows.schema, per
        place = F.col("place__")
        dealt = numbered(rows, "place__", *order).withColumn("range__", F.expr(f"(place__ - 1) div {per}"))
        self.path = f"{shared_dir(self.spark)}/plumbline/order-{uuid.uuid4().hex}"
        note(self.path)
        dealt.sortWithinPartitions("range__", "place__").write.partitionBy("range__").parquet(self.path)
        self._with_place = dealt.drop("range__").schema
        self.total = self._read([]).agg(F.coalesce(F.max(place), F.lit(0))).first()[0]

    def _read(self, ranges: list[int]) -> DataFrame:
        return self.spark.read.schema(self._with_place).parquet(*[f"{self.path}/range__={r}" for r in ranges] or [self.path])

    def page(self, number: int = 1, size: int = 50, most: int = MOST) -> DataFrame:
        """The rows of a page, in order; none beyond the end."""
        first, last = _bounds(number, size, most)
        last = min(last, self.total)
        if first > last:
            return self.spark.createDataFrame([], self.schema)
        own = self._read(list(range((first - 1) // self.per, (last - 1) // self.per + 1)))
        return own.where(F.col("place__").between(first, last)).orderBy("place__").drop("place__")

    def drop(self) -> None:
        drop(self.spark, self.path)


def issues(rows: DataFrame, code: str | None = None, level: str | None = None, split: str | None = None, q: str | None = None) -> DataFrame:
    for name, v in (("code", code), ("level", level), ("split", split)):
        if v is not None:
            rows = rows.where(F.col(name) == v)
    return rows.where(F.lower(F.coalesce("image_path", "label_path", F.lit(""))).contains(q.lower())) if q else rows


def duplicates(groups: DataFrame, kind: str | None = None, scope: str | None = None, split: str | None = None) -> DataFrame:
    """Groups across splits first, then exact ones, then the larger, then by id."""
    for name, v in (("kind", kind), ("scope", scope)):
        if v is not None:
            groups = groups.where(F.col(name) == v)
    if split is not None:
        groups = groups.where(F.array_contains("splits", split))
    return groups.orderBy(F.when(F.col("scope") == "cross_split", 0).otherwise(1), F.when(F.col("kind") == "exact", 0).otherwise(1), F.desc("size"), "group_id")


def findings(rows: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    if severity is not None and severity not in SEVERITIES:
        raise ConfigError(f"severity must be one of {', '.join(SEVERITIES)}")
    for name, v in (("severity", severity), ("category", category)):
        if v is not None:
            rows = rows.where(F.col(name) == v)
    return rows
