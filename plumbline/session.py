"""An audit: a dataset's tables, from listing to findings, registered as views."""

from __future__ import annotations

import datetime
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.errors import Cancelled
from plumbline.operators import annotations as an
from plumbline.operators import duplicates as du
from plumbline.operators import findings as fi
from plumbline.operators import health as he
from plumbline.operators import statistics as st
from plumbline.plans.jobs import watched
from plumbline.plans.store import scope, table
from plumbline.sources import images as im
from plumbline.sources import yolo
from plumbline.sources.paths import dataset_path

STAGES = ("discover", "images", "annotations", "duplicates", "leakage", "statistics", "scoring", "findings")
#: The tables of an audit, each a Parquet folder where it is stored.
TABLES = ("images", "boxes", "issues", "classes", "dup_members", "dup_groups", "leakage_pairs", "leakage_totals", "totals", "splits", "balance", "histograms", "described", "counted", "health_components", "health_overall", "findings", "affected")
AUDIT_ID = re.compile(r"^[A-Za-z0-9_-]{4,64}$")


def new_id(now: datetime.datetime | None = None) -> str:
    return f"{(now or datetime.datetime.now(datetime.UTC)):%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:8]}"


@dataclass
class Audit:
    """The tables of an audit and what is known about it."""

    id: str
    tables: dict[str, DataFrame]
    meta: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def views(self, prefix: str = "audit_") -> None:
        """Registers every table as a temporary view, for SQL."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(f"{prefix}{name}")


class AuditSession:
    """Runs audits with given settings."""

    def __init__(self, spark: SparkSession, config: Config | None = None, cache: str | None = None) -> None:
        self.spark, self.config, self.cache = spark, (config or Config()).check(), cache

    def run(self, root: str | Path, mode: str = "scan", progress: Callable[[str, int, int], None] | None = None, cancelled: Callable[[], bool] | None = None, tasks: Callable[[int, int], None] | None = None) -> Audit:
        """Audits a folder. ``validate`` reads no pixels and looks for no duplicates, and says nothing about either.

        progress is called with each stage's name, number and how many there are, tasks with how many of the tasks that
        Spark runs just now are done, and of how many. Once cancelled says so, also while a stage runs, running jobs are
        stopped and the audit ends with ``Cancelled``. What an audit that fails has written on its way is deleted.
        """
        with watched(self.spark, cancelled, tasks), scope(self.spark) as written:
            audit = self._run(root, mode, progress, cancelled)
            written.clear()
            return audit

    def _run(self, root: str | Path, mode: str, progress: Callable[[str, int, int], None] | None, cancelled: Callable[[], bool] | None) -> Audit:
        began, cfg, spark = time.monotonic(), self.config, self.spark
        full = mode == "scan"

        def stage(name: str) -> None:
            if cancelled and cancelled():
                raise Cancelled(f"cancelled before {name}")
            if progress:
                progress(name, STAGES.index(name) + 1, len(STAGES))

        stage("discover")
        layout = yolo.discover(spark, dataset_path(str(root)))
        labels, declared = layout.labels, layout.declared()
        stage("images")
        measured = table(im.described(im.cached(layout.folder, layout.files, self.cache, cfg, full), cfg), "images")
        stage("annotations")
        texts = yolo.label_texts(layout.folder, labels, cfg.annotations.max_label_bytes)
        has_labels = not labels.isEmpty()
        states, boxes, issues = an.validate(measured.select("id", "path", "split", "label_path"), texts, len(layout.classes), cfg.annotations)
        if not has_labels:
            states, issues = states.withColumn("label_status", F.lit("n/a")), issues.where("false")
        boxes, issues = table(boxes, "boxes"), table(an.numbered(issues), "issues")
        images = measured.join(states, "id").join(boxes.groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("n_boxes")), "id", "left").na.fill({"n_boxes": 0})
        images = table(images, "labelled")
        t: dict[str, DataFrame] = {"boxes": boxes, "issues": issues}
        stage("duplicates")
        notes = list(layout.notes)
        if full:
            rows, edges = du.members(images, cfg.duplicates)
            members, groups = (table(x, "dup") for x in du.with_groups(rows, edges))
        else:
            empty = "group_id string, id string, path string, split string, sha256 string, kind string, scope string"
            members = spark.createDataFrame([], empty)
            groups = spark.createDataFrame([], "group_id string, kind string, scope string, splits array<string>, size long, unique_files long, max_distance int, first_path string")
        t |= {"dup_members": members, "dup_groups": groups}
        stage("leakage")
        t |= {"leakage_pairs": du.leakage_pairs(members), "leakage_totals": du.leakage_totals(images, members)}
        if not full:
            t["leakage_totals"] = t["leakage_totals"].withColumn("applicable", F.lit(False)).withColumn("leakage_rate", F.lit(None).cast("double"))
        t["images"] = images = table(du.tags(images, members, boxes, cfg), "images")
        stage("statistics")
        classes = table(st.by_class(boxes, declared), "classes")
        balance = st.balance(classes)
        bins = [df.select(F.lit(name).alias("histogram"), "*") for name, df in st.histograms(images, boxes).items()]
        hist = bins[0]
        for b in bins[1:]:
            hist = hist.unionByName(b)
        t |= {"classes": classes, "balance": balance, "totals": st.totals(images, boxes), "splits": st.by_split(images, boxes), "histograms": hist, "described": st.described(images, boxes), "counted": st.counted(images, boxes, issues)}
        stage("scoring")
        t["health_components"] = he.components(he.rates(images, members if full else None, has_labels), balance, cfg)
        t["health_overall"] = he.overall(t["health_components"])
        stage("findings")
        t["findings"] = fi.build(images, issues, members if full else None, groups if full else None, boxes, classes, notes, cfg)
        t["affected"] = fi.affected(images, issues, members if full else None)
        t = {name: table(t[name], name) if name in ("findings", "health_components", "health_overall", "totals") else t[name] for name in TABLES}
        now = datetime.datetime.now(datetime.UTC)
        meta = {
            "id": new_id(now), "created_at": now.isoformat(timespec="seconds"), "mode": mode, "root": str(layout.root), "dataset": layout.name, "classes": layout.classes,
            "splits": layout.splits, "has_labels": has_labels, "notes": notes, "config": cfg.to_dict(), "duration_s": round(time.monotonic() - began, 3),
        }
        return Audit(meta["id"], t, meta)
