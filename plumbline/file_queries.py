"""Queries of the operators that read and write files, and of rules that no other query's tables set off, with their SQL.

The files are a dataset made of the nations, one image for each: its key says what split, size and grey it has and what is
wrong with it or its labels. It is written to the shared folder, listed, measured, validated and audited; the SQL says from the
keys alone what must come out.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.operators import findings as fi
from plumbline.operators import statistics as st
from plumbline.plans.keyed import KeyedStore
from plumbline.plans.store import shared_dir
from plumbline.queries import Q_BOXES, Q_IMAGES, Q_MEMBERS, boxes, groups, images, members, query
from plumbline.session import Audit, AuditSession
from plumbline.sinks import reports
from plumbline.sinks.store import AuditStore
from plumbline.sources import images as im
from plumbline.sources import yolo
from plumbline.sources.demo import png

_audits: dict[tuple, Audit] = {}

GIF = b"GIF89a\x01\x00\x01\x00\x00\x00\x00;"


def _place(spark: SparkSession, name: str) -> Path:
    """A new folder in the shared one, which must be of a file system that is mounted."""
    where = urlparse(shared_dir(spark))
    if where.scheme not in ("", "file"):
        raise ValueError(f"{shared_dir(spark)} isn't a mounted folder")
    path = Path(where.path) / "plumbline" / f"{name}-{uuid.uuid4().hex}"
    path.mkdir(parents=True)
    return path


def dataset(spark: SparkSession, sf_dir: str) -> Path:
    """Writes the nations' dataset."""
    root = _place(spark, "nations")
    for (k,) in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").orderBy("n_nationkey").collect():  # 25 nations
        split = {3: "val", 4: "test"}.get(k % 5, "train")
        data = png(np.full((48 + k, 64 + 2 * k, 3), 10 * k))
        data = b"" if k % 7 == 3 else GIF if k % 6 == 1 else data[: len(data) // 2] if k % 11 == 5 else data
        lines = [f"{c} 0.5 0.5 0.{2 + c} 0.3" for c in range(k % 3 + 1)] + ["=1+1"] * (k % 4 == 2)
        for kind, name, content in (("images", f"{k:02d}.{'gif' if k % 6 == 1 else 'png'}", data), ("labels", f"{k:02d}.txt", "" if k % 4 == 1 else "\n".join(lines))):
            if kind == "images" or k % 4:
                path = root / kind / split / name
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(content if isinstance(content, bytes) else content.encode())
    (root / "labels" / "train" / "ghost.txt").write_text("0 0.5 0.5 0.2 0.3")
    (root / "data.yaml").write_text("names: [a, b, c, d]\ntrain: images/train\nval: images/val\ntest: [images/test, ../../etc]\n")
    return root


def audit(spark: SparkSession, sf_dir: str) -> Audit:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _audits:
        _audits[key] = AuditSession(spark).run(dataset(spark, sf_dir))
    return _audits[key]


# What the keys say.
Q_FILES = """f AS (SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split, CASE WHEN n_nationkey % 6 = 1 THEN 'gif' ELSE 'png' END AS suffix,
  CASE WHEN n_nationkey % 6 = 1 THEN 'unsupported' WHEN n_nationkey % 7 = 3 THEN 'zero_byte' WHEN n_nationkey % 11 = 5 THEN 'corrupted' ELSE 'ok' END AS status, 64 + 2 * n_nationkey AS w, 48 + n_nationkey AS h FROM nation),
files AS (SELECT *, concat('images/', split, '/', lpad(CAST(k AS VARCHAR), 2, '0'), '.', suffix) AS path, concat('labels/', split, '/', lpad(CAST(k AS VARCHAR), 2, '0'), '.txt') AS label_path,
  CASE k % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' ELSE 'ok' END AS label_status, CASE WHEN k % 4 IN (2, 3) THEN k % 3 + 1 ELSE 0 END AS n_boxes, CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END AS bad FROM f),
codes AS (SELECT 'malformed_line' AS code, label_path, k % 3 + 2 AS line FROM files WHERE bad = 1 UNION ALL SELECT 'missing_label_file', label_path, NULL FROM files WHERE k % 4 = 0 UNION ALL SELECT 'empty_label_file', label_path, NULL FROM files WHERE k % 4 = 1
  UNION ALL SELECT 'orphan_label', 'labels/train/ghost.txt', NULL)"""
_FLAGS = "list_filter([CASE WHEN least(w, h) < 64 THEN 'low_resolution' END, 'blurry', CASE WHEN 10 * k < 35 THEN 'dark' END, CASE WHEN 10 * k > 220 THEN 'bright' END, 'low_contrast'], lambda x: x IS NOT NULL)"


@query(f"WITH {Q_FILES} SELECT path, split, status, CASE WHEN status = 'ok' THEN 'PNG' END AS format, CASE WHEN status = 'ok' THEN w END AS width, CASE WHEN status = 'ok' THEN h END AS height, CASE WHEN status = 'ok' THEN 3 END AS channels, status = 'ok' AS gray, CASE WHEN status = 'ok' THEN 10e0 * k END AS brightness, CASE WHEN status = 'ok' THEN 0e0 END AS contrast, CASE WHEN status = 'ok' THEN round(CAST(w AS DOUBLE) / h, 4) END AS aspect_ratio, CASE WHEN status = 'ok' THEN false END AS hash_reliable, CASE WHEN status = 'ok' THEN array_to_string({_FLAGS}, ',') ELSE '' END AS flags FROM files")
def file_images(spark, d):
    """Image files, listed and measured: status, header, pixels and flags."""
    ok = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    kept = [F.round(ok(c), 6).alias(c) for c in ("brightness", "contrast")]
    return audit(spark, d)["images"].select("path", "split", "status", *map(ok, ("format", "width", "height", "channels", "aspect_ratio", "hash_reliable")), (F.col("is_grayscale") & (F.col("status") == "ok")).alias("gray"), *kept, F.array_join("flags", ",").alias("flags"))


@query(f"WITH {Q_FILES} SELECT path, label_path, label_status, n_boxes, bad AS invalid_lines FROM files")
def file_labels(spark, d):
    """The label file of every image, and what it holds."""
    return audit(spark, d)["images"].select("path", "label_path", "label_status", "n_boxes", "invalid_lines")


@query(f"WITH {Q_FILES} SELECT code, label_path, line FROM codes")
def file_issues(spark, d):
    """What is wrong with label files, line by line."""
    return audit(spark, d)["issues"].select("code", "label_path", "line")


@query(f"WITH {Q_FILES} SELECT count(*) AS images, count(*) FILTER (status = 'ok') AS valid_images, count(*) FILTER (status = 'corrupted') AS corrupted_images, count(*) FILTER (status = 'unsupported') AS unsupported_images, count(*) FILTER (status = 'zero_byte') AS zero_byte_images, CAST(sum(n_boxes) AS BIGINT) AS annotations, CAST(sum(bad) AS BIGINT) AS invalid_lines, CAST(sum(n_boxes + bad) AS BIGINT) AS annotation_lines FROM files")
def file_totals(spark, d):
    """The totals of an audit of files."""
    return audit(spark, d)["totals"].select("images", "valid_images", "corrupted_images", "unsupported_images", "zero_byte_images", "annotations", "invalid_lines", "annotation_lines")


_COUNTED = f"""SELECT 'format' AS statistic, 'PNG' AS value, count(*) AS count FROM files WHERE status = 'ok' UNION ALL SELECT 'channels', '3', count(*) FROM files WHERE status = 'ok'
UNION ALL SELECT 'unique_resolutions', 'all', count(DISTINCT concat(w, 'x', h)) FROM files WHERE status = 'ok' UNION ALL SELECT 'issue', code, count(*) FROM codes GROUP BY code
UNION ALL SELECT 'flag', n.flag, count(x.flag) FROM (SELECT unnest(['low_resolution', 'extreme_aspect', 'blurry', 'dark', 'bright', 'low_contrast']) AS flag) n LEFT JOIN (SELECT unnest({_FLAGS}) AS flag FROM files WHERE status = 'ok') x ON x.flag = n.flag GROUP BY 2"""


@query(f"WITH {Q_FILES} {_COUNTED}")
def file_counts(spark, d):
    """Formats, channels, different sizes, issues and flags of an audit of files."""
    return audit(spark, d)["counted"].where("statistic not in ('resolution', 'tag')")


@query(f"""WITH {Q_FILES}, v AS (SELECT unnest(['width', 'height', 'aspect_ratio', 'brightness', 'contrast', 'blur_score']) AS measure, unnest([CAST(w AS DOUBLE), CAST(h AS DOUBLE), CAST(w AS DOUBLE) / h, 10e0 * k, 0e0, 0e0]) AS x FROM files WHERE status = 'ok' UNION ALL SELECT 'boxes_per_image', n_boxes FROM files WHERE status = 'ok' AND label_status <> 'missing')
SELECT measure, count(*) AS n, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg(x), 3) AS mean, round(median(x), 4) AS median FROM v GROUP BY 1""")
def file_measures(spark, d):
    """Summaries of what the images of an audit measure."""
    return audit(spark, d)["described"].select("measure", "n", *[F.round(c, n).alias(c) for c, n in (("min", 4), ("max", 4), ("mean", 3), ("median", 4))])


@query(f"WITH {Q_FILES} SELECT code, label_path, line, CASE WHEN code = 'malformed_line' THEN '''=1+1' END AS raw FROM codes")
def file_csv(spark, d):
    """The CSV report of issues, written and read again: formulas come with an apostrophe."""
    path = _place(spark, "csv") / "issues"
    reports.write_csv(audit(spark, d), "issues", f"file://{path}")
    back = spark.read.option("header", True).option("escape", '"').csv(f"file://{path}")
    return back.select("code", "label_path", F.col("line").cast("int").alias("line"), "raw")


@query(f"WITH {Q_FILES} SELECT 'issues' AS name, code AS a, label_path AS b, CAST(line AS BIGINT) AS n FROM codes UNION ALL SELECT 'images', path, status, n_boxes FROM files UNION ALL SELECT 'classes', name, '', k FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS name, unnest(range(4)) AS k) UNION ALL SELECT 'totals', '', '', count(*) FROM files")
def file_json(spark, d):
    """The JSON report, read again: what its tables hold."""
    found = json.loads(reports.to_json(audit(spark, d), include_images=True))
    columns = {"issues": ("code", "label_path", "line"), "images": ("path", "status", "n_boxes"), "classes": ("name", None, "class_id"), "totals": (None, None, "images")}
    rows = [(name, *[x[c] if c else "" for c in of]) for name, of in columns.items() for x in found[name]]
    return spark.createDataFrame(rows, "name string, a string, b string, n long")


@query(f"WITH {Q_FILES} SELECT path, status, split FROM files")
def file_stored(spark, d):
    """An audit, saved and loaded again: its images."""
    store = AuditStore(spark, _place(spark, "store"))
    own = audit(spark, d)
    store.save(own)
    return store.load(own.id)["images"].select("path", "status", "split")


@query(f"WITH {Q_FILES} SELECT status, count(*) AS files, count(*) AS known, 0::BIGINT AS differ FROM files GROUP BY 1")
def file_cache(spark, d):
    """Files measured twice with a cache: what it knew the second time, and what came out otherwise."""
    root, cache, cfg = Path(audit(spark, d).meta["root"]), f"file://{_place(spark, 'cache')}/measured", Config()
    layout = yolo.discover(spark, root)
    once = im.cached(layout.folder, layout.files, cache, cfg)
    known = KeyedStore(spark, cache, ["folder", "path", "params"]).read().select("path").distinct().withColumn("known", F.lit(True))
    again = im.cached(layout.folder, layout.files, cache, cfg).select("path", "status", F.col("sha256").alias("sha"), F.col("brightness").alias("b"))
    both = once.select("path", F.col("status").alias("s"), "sha256", "brightness").join(again, "path").join(known, "path", "left")
    differ = ~(F.col("s").eqNullSafe(F.col("status")) & F.col("sha").eqNullSafe(F.col("sha256")) & F.col("b").eqNullSafe(F.col("brightness")))
    return both.groupBy("status").agg(F.count("*").alias("files"), F.count("known").alias("known"), F.count_if(differ).alias("differ"))


def _found(df: DataFrame, case: str, *ids: str) -> DataFrame:
    return df.where(F.col("id").isin(*ids)).select(F.lit(case).alias("case"), "id", "severity", "affected_count")


@query(f"""WITH {Q_IMAGES}, v AS (SELECT count(*) FILTER (status = 'ok') AS n FROM images) SELECT 'none' AS "case", 'no_images' AS id, 'critical' AS severity, 0::BIGINT AS affected_count UNION ALL SELECT 'train', 'no_val_split', 'medium', 0 UNION ALL SELECT 'train', 'no_test_split', 'info', 0
UNION ALL SELECT 'few', 'tiny_val_split', 'low', (SELECT count(*) FROM images WHERE split = 'val' AND doc_id % 25 = 3) UNION ALL SELECT 'notes', 'layout_note', 'low', 0 UNION ALL SELECT 'large', 'integrity_too_large', 'medium', (SELECT count(*) FROM images WHERE status = 'ok' AND doc_id % 3 = 0)
UNION ALL SELECT 'labels', 'annotations_missing_label_file', CASE WHEN count(*) >= 0.10 * any_value(v.n) THEN 'high' ELSE 'medium' END, count(*) FROM images, v WHERE status = 'ok' AND label_status = 'missing' UNION ALL SELECT 'labels', 'annotations_empty_label_file', CASE WHEN count(*) > 0.5 * any_value(v.n) THEN 'low' ELSE 'info' END, count(*) FROM images, v WHERE status = 'ok' AND label_status = 'empty' HAVING count(*) > 0""")
def findings_structure(spark, d):
    """Findings on splits, notes, sizes and label files, each of images changed to set it off."""
    own, b = images(spark, d), boxes(spark, d).where("false")
    classes = spark.createDataFrame([], "class_id int, name string, count long, images long, share double")
    none = spark.createDataFrame([], "code string, image_id string, label_path string, line int")
    build = lambda rows, issues=none, notes=None: fi.build(rows, issues, None, None, b, classes, notes)
    code = F.when(F.col("label_status") == "missing", "missing_label_file").when(F.col("label_status") == "empty", "empty_label_file")
    issues = own.select(code.alias("code"), F.col("id").alias("image_id"), F.col("path").alias("label_path"), F.lit(None).cast("int").alias("line")).where("code is not null")
    parts = [
        _found(build(own.where("false")), "none", "no_images"), _found(build(own.where("split = 'train'")), "train", "no_val_split", "no_test_split"), _found(build(own.where("split <> 'val' or doc_id % 25 = 3")), "few", "tiny_val_split"),
        _found(build(own, notes=["a note"]), "notes", "layout_note"), _found(build(own.withColumn("status", F.when((F.col("status") == "ok") & (F.col("doc_id") % 3 == 0), "too_large").otherwise(F.col("status")))), "large", "integrity_too_large"),
        _found(build(own, issues), "labels", "annotations_missing_label_file", "annotations_empty_label_file"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {Q_MEMBERS} SELECT CASE WHEN scope = 'cross_split' THEN 'leakage_perceptual' ELSE 'duplicates_perceptual' END AS id, CASE WHEN scope = 'cross_split' THEN 'high' ELSE 'low' END AS severity, CASE WHEN scope = 'cross_split' THEN count(DISTINCT id) ELSE count(*) END AS affected_count FROM members GROUP BY scope")
def findings_perceptual(spark, d):
    """Findings on near duplicates, of groups that are taken for such."""
    near = lambda df: df.withColumn("kind", F.lit("perceptual"))
    none = spark.createDataFrame([], "code string, image_id string, label_path string, line int")
    classes = spark.createDataFrame([], "class_id int, name string, count long, images long, share double")
    out = fi.build(images(spark, d), none, near(members(spark, d)), near(groups(spark, d)), boxes(spark, d).where("false"), classes)
    return out.where("id like '%perceptual'").select("id", "severity", "affected_count")


_FEW = "class_id < 2 AND (class_id = 0 OR image_id % 60 = 0) AND NOT (split = 'val' AND class_id = 1) AND NOT (split = 'test' AND class_id = 0)"


@query(f"""WITH {Q_BOXES}, few AS (SELECT * FROM boxes WHERE {_FEW}), c AS (SELECT class_id, count(*) AS n FROM few GROUP BY 1)
SELECT 'class_imbalance' AS id, CASE WHEN round(CAST(max(n) AS DOUBLE) / min(n), 2) >= 50 THEN 'high' ELSE 'medium' END AS severity, min(n) AS affected_count FROM c HAVING count(*) = 2 AND round(CAST(max(n) AS DOUBLE) / min(n), 2) >= 10
UNION ALL SELECT concat('classes_missing_', s), 'medium', count(*) FROM (SELECT DISTINCT class_id, s FROM few, (SELECT unnest(['val', 'test']) AS s) x WHERE split = 'train') t WHERE NOT EXISTS (SELECT 1 FROM few f WHERE f.split = t.s AND f.class_id = t.class_id) GROUP BY s""")
def findings_classes(spark, d):
    """Findings on uneven classes, and on those that val or test lack."""
    few = boxes(spark, d).where(_FEW)
    classes = st.by_class(few, spark.createDataFrame([(0, "a"), (1, "b")], "class_id int, name string"))
    none = spark.createDataFrame([], "code string, image_id string, label_path string, line int")
    out = fi.build(images(spark, d), none, None, None, few, classes, None)
    return out.where("id = 'class_imbalance' or id like 'classes_missing%'").select("id", "severity", "affected_count")
