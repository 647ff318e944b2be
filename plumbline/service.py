"""Audits as a service: jobs that run one at a time, and questions about stored audits; no web framework."""

from __future__ import annotations

import datetime
import shutil
import threading
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import find_config, load_config
from plumbline.errors import Cancelled, ConfigError, NotFound, PlumblineError
from plumbline.operators import pages as pg
from plumbline.session import Audit, AuditSession
from plumbline.sinks import reports
from plumbline.sinks.store import AuditStore
from plumbline.sinks.thumbnails import thumbnail
from plumbline.sources.archives import extract
from plumbline.sources.paths import dataset_path, remove_tree

#: Audits that stay loaded, and orders that stay stored.
LOADED, ORDERS = 3, 8


@dataclass
class Job:
    id: str
    path: str
    mode: str
    source: str = "path"
    status: str = "queued"
    stage: str = ""
    done: int = 0
    total: int = 0
    tasks_done: int = 0
    tasks_total: int = 0
    error: str | None = None
    audit_id: str | None = None
    created_at: str = field(default_factory=lambda: datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"))
    finished_at: str | None = None

    @property
    def progress(self) -> float:
        """From 0 to 1: stages that are done, and of the one that runs the share of its tasks just now."""
        within = self.tasks_done / self.tasks_total if self.tasks_total else 0.0
        return 1.0 if self.status == "done" else (self.done + within) / self.total if self.total else 0.0


def rows(df: DataFrame) -> list[dict]:
    """A bounded DataFrame, such as a page, as dictionaries."""
    return [r.asDict(recursive=True) for r in df.collect()]


class AuditService:
    """Runs audits in the background and answers questions about them."""

    def __init__(self, spark: SparkSession, home: str | Path, allowed: list[str] | None = None) -> None:
        self.spark, self.home, self.allowed = spark, Path(home), allowed
        self.store = AuditStore(spark, self.home / "audits")
        self._jobs: dict[str, Job] = {}
        self._cancelled: set[str] = set()
        self._loaded: OrderedDict[str, Audit] = OrderedDict()
        self._orders: OrderedDict[tuple, pg.Stored] = OrderedDict()
        self._lock, self._pool = threading.Lock(), ThreadPoolExecutor(1)

    # Jobs.
    def submit(self, path: str, mode: str = "scan", config: dict | None = None) -> Job:
        if mode not in ("scan", "validate"):
            raise ConfigError("mode must be scan or validate")
        root = dataset_path(path, self.allowed)
        load_config(None, config, {})
        return self._start(root, mode, config, "path")

    def submit_archive(self, archive: str, mode: str = "scan", config: dict | None = None) -> Job:
        """Unpacks a ZIP file and audits what is in it; it is deleted with the audit."""
        folder = self.home / "uploads" / uuid.uuid4().hex
        folder.parent.mkdir(parents=True, exist_ok=True)
        # Executors see the home, and not where an upload came in.
        own = folder.with_suffix(".zip")
        shutil.copyfile(archive, own)
        try:
            root = extract(self.spark, own.resolve(), folder.resolve())
        finally:
            own.unlink()
        return self._start(root, mode, config, "upload")

    def _start(self, root: Path, mode: str, config: dict | None, source: str) -> Job:
        job = Job(uuid.uuid4().hex[:12], str(root), mode, source)
        self._jobs[job.id] = job
        self._pool.submit(self._work, job, root, config)
        return job

    def _work(self, job: Job, root: Path, config: dict | None) -> None:
        def tell(stage: str, n: int, of: int) -> None:
            job.stage, job.done, job.total, job.tasks_done, job.tasks_total = stage, n - 1, of, 0, 0

        def count(done: int, of: int) -> None:
            job.tasks_done, job.tasks_total = done, of

        try:
            job.status = "running"
            session = AuditSession(self.spark, load_config(find_config(root), config), f"file://{(self.home / 'cache').resolve()}")
            audit = session.run(root, job.mode, tell, lambda: job.id in self._cancelled, count)
            audit.meta["source"] = job.source
            self.store.save(audit)
            job.status, job.audit_id = "done", audit.id
        except Cancelled:
            job.status = "cancelled"
        except Exception as e:  # a job's failure is its state, for whoever asks
            job.status, job.error = "failed", f"{type(e).__name__}: {e}"[:500]
        if job.status != "done" and job.source == "upload":
            remove_tree(root, self.home / "uploads")
        job.finished_at = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")

    def job(self, id: str) -> Job:
        if id not in self._jobs:
            raise NotFound(f"no job {id!r}")
        return self._jobs[id]

    def jobs(self) -> list[Job]:
        return sorted(self._jobs.values(), key=lambda j: j.created_at, reverse=True)

    def cancel(self, id: str) -> Job:
        self._cancelled.add(self.job(id).id)
        return self.job(id)

    def wait(self) -> None:
        """Until all jobs have ended."""
        self._pool.submit(lambda: None).result()

    # Audits.
    def audits(self) -> list[dict]:
        return self.store.list()

    def load(self, id: str) -> Audit:
        """An audit; the last three stay loaded."""
        with self._lock:
            if id in self._loaded and self.store.exists(id):
                self._loaded.move_to_end(id)
                return self._loaded[id]
            self._loaded[id] = self.store.load(id)
            while len(self._loaded) > LOADED:
                self._loaded.popitem(last=False)
            return self._loaded[id]

    def overview(self, id: str) -> dict:
        a = self.load(id)
        shown = a["findings"].drop("ids")
        return {"audit": a.meta, **{n: rows(a[n]) for n in ("totals", "splits", "balance", "health_components", "health_overall", "leakage_totals", "leakage_pairs", "histograms")}, "classes": rows(a["classes"].limit(1000)), "findings": rows(shown)}

    def delete(self, id: str) -> None:
        """Deletes an audit, its previews, and what was unpacked for it; never a dataset in its own place."""
        meta = self.store.load(id).meta
        self._loaded.pop(id, None)
        with self._lock:
            for key in [k for k in self._orders if k[0] == id]:
                self._orders.pop(key).drop()
        self.store.delete(id)
        remove_tree(self.home / "thumbnails" / id, self.home / "thumbnails")
        if meta.get("source") == "upload":
            uploads = (self.home / "uploads").resolve()
            top = next((p for p in [Path(meta["root"]), *Path(meta["root"]).parents] if p.parent == uploads), None)
            if top:
                remove_tree(top, uploads)

    def image_page(self, id: str, f: pg.ImageFilter | None = None, finding: str | None = None, class_name: str | None = None, sort: str = "path", order: str = "asc", page: int = 1, size: int = 50) -> dict:
        a, f = self.load(id), f or pg.ImageFilter()
        if class_name is not None:
            names = a.meta["classes"]
            if class_name not in names:
                raise ConfigError(f"no class {class_name!r}")
            f.class_id = names.index(class_name)
        if finding is not None:
            if a["findings"].where(F.col("id") == finding).isEmpty():
                raise NotFound(f"no finding {finding!r}")
            f.ids = a["affected"].where(F.col("finding") == finding).select("id")
        found = pg.images(a["images"], f, a["boxes"])
        tags = [r.tag for r in a["images"].select(F.explode("tags").alias("tag")).distinct().orderBy("tag").collect()]  # of a fixed list of names
        shown, total = self._page((id, repr(f), finding, sort, order), found, pg.order_of(sort, order == "desc"), page, size)
        items = rows(shown.select("id", "path", "split", "status", "width", "height", "file_size", F.round("blur_score", 2).alias("blur_score"), F.round("brightness", 2).alias("brightness"), "n_boxes", "tags", (F.col("status") == "ok").alias("has_preview")))
        return {"total": total, "page": max(1, page), "items": items, "available_tags": tags}

    def _page(self, key: tuple, found: DataFrame, order: list[Column], page: int, size: int, most: int = pg.MOST) -> tuple[DataFrame, int]:
        """A page of rows in an order, and how many there are. Pages beyond the front are read from an order that is stored once."""
        with self._lock:
            own = self._orders.get(key)
            if own is None and max(1, page) * max(1, min(most, size)) > pg.FRONT:
                own = self._orders[key] = pg.Stored(found, order)
                while len(self._orders) > ORDERS:
                    self._orders.popitem(last=False)[1].drop()
            if own is not None:
                self._orders.move_to_end(key)
                return own.page(page, size, most), own.total
        return pg.page(found.orderBy(*order), page, size, most), found.count()

    def image(self, id: str, image_id: str) -> dict:
        a = self.load(id)
        own = rows(a["images"].where(F.col("id") == image_id).limit(1))
        if not own:
            raise NotFound(f"no image {image_id!r}")
        here = F.col("image_id") == image_id
        groups = a["dup_members"].where(F.col("id") == image_id).select("group_id")
        return own[0] | {"boxes": rows(a["boxes"].where(here).join(a["classes"].select("class_id", "name"), "class_id", "left").orderBy("line")), "issues": rows(a["issues"].where(here).orderBy("seq")), "duplicate_groups": rows(a["dup_groups"].join(groups, "group_id", "left_semi"))}

    def preview(self, id: str, image_id: str, size: int = 256) -> Path:
        own = self.image(id, image_id)
        if own["status"] != "ok":
            raise NotFound("the image has no preview")
        return thumbnail(self.spark, Path(self.load(id).meta["root"]), own["path"], self.home / "thumbnails" / id, image_id, size)

    def issues_page(self, id: str, page: int = 1, size: int = 50, **f) -> dict:
        found = pg.issues(self.load(id)["issues"], **f)
        shown, total = self._page((id, "issues", repr(sorted(f.items()))), found, [F.asc("seq")], page, size)
        return {"total": total, "items": rows(shown)}

    def duplicates_page(self, id: str, page: int = 1, size: int = 20, **f) -> dict:
        a = self.load(id)
        found = pg.duplicates(a["dup_groups"], **f)
        shown = pg.page(found, page, size, pg.MOST_GROUPS)
        members = a["dup_members"].join(shown.select("group_id"), "group_id", "left_semi").groupBy("group_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("path", "id", "split"))), 1, 200).alias("members"))
        by = {r["group_id"]: r["members"] for r in rows(members)}
        return {"total": found.count(), "items": [g | {"members": by.get(g["group_id"], [])} for g in rows(shown)]}

    def leakage(self, id: str) -> dict:
        a = self.load(id)
        return {"totals": rows(a["leakage_totals"])[0], "pairs": rows(a["leakage_pairs"])}

    def findings(self, id: str, most: int = 50, **f) -> list[dict]:
        found = pg.findings(self.load(id)["findings"], **f)
        return rows(found.withColumn("ids", F.slice("ids", 1, most)))

    def report(self, id: str, fmt: str, csv_kind: str = "images", include_images: bool = False) -> tuple[str, Iterator[bytes]]:
        """(file name, chunks) of a report."""
        return reports.stream(self.load(id), fmt, csv_kind, include_images)


def as_dict(job: Job) -> dict:
    return asdict(job) | {"progress": round(job.progress, 3)}


__all__ = ["AuditService", "Job", "PlumblineError", "as_dict", "rows"]
