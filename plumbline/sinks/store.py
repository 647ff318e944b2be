"""Audits as folders of Parquet tables, published by the file that is written last."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.errors import NotFound
from plumbline.session import AUDIT_ID, TABLES, Audit

META = "meta.json"


class AuditStore:
    """Audits in a folder that all executors can write to."""

    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        self.spark, self.root = spark, Path(root)

    def _place(self, id: str) -> Path:
        if not AUDIT_ID.match(id):
            raise NotFound(f"no audit {id!r}")
        return self.root / id

    def save(self, audit: Audit) -> Path:
        """Writes all tables, then the summary, whose presence says that the audit is whole."""
        place = self._place(audit.id)
        for name, df in audit.tables.items():
            df.write.mode("overwrite").parquet(f"file://{place.resolve()}/{name}")
        o = audit["health_overall"].first()
        totals = audit["totals"].first().asDict()
        severities = {r.severity: r["count"] for r in audit["findings"].groupBy("severity").count().collect()}  # five at most
        meta = audit.meta | {"overall": o.overall, "grade": o.grade, "images": totals["images"], "annotations": totals["annotations"], "findings": severities}
        part = place / f"{META}.tmp"
        part.write_text(json.dumps(meta, ensure_ascii=False), "utf-8")
        os.replace(part, place / META)
        audit.meta = meta
        return place

    def exists(self, id: str) -> bool:
        return bool(AUDIT_ID.match(id)) and (self.root / id / META).is_file()

    def load(self, id: str) -> Audit:
        place = self._place(id)
        if not self.exists(id):
            raise NotFound(f"no audit {id!r}")
        tables = {name: self.spark.read.parquet(f"file://{place.resolve()}/{name}") for name in TABLES if (place / name).is_dir()}
        if "affected" not in tables:  # audits stored before there was such a table
            tables["affected"] = tables["findings"].select(F.col("id").alias("finding"), F.explode("ids").alias("id"))
        if "ids_total" not in tables["findings"].columns:
            tables["findings"] = tables["findings"].withColumn("ids_total", F.size("ids").cast("long"))
        return Audit(id, tables, json.loads((place / META).read_text("utf-8")))

    def list(self) -> list[dict]:
        """Summaries, the newest first; those that can't be read are passed over."""
        out = []
        for path in self.root.glob(f"*/{META}"):
            try:
                out.append(json.loads(path.read_text("utf-8")))
            except (OSError, ValueError):
                continue
        return sorted(out, key=lambda m: (m.get("created_at", ""), m.get("id", "")), reverse=True)

    def delete(self, id: str) -> None:
        """Removes an audit: its summary first, so that half of it is never listed. The dataset stays."""
        if not self.exists(id):
            raise NotFound(f"no audit {id!r}")
        (self._place(id) / META).unlink()
        shutil.rmtree(self._place(id), ignore_errors=True)
