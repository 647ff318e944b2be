"""Queries of filters, views, stored orders and stores over the driver's tables, with their SQL.

As in ``queries``, documents stand for images, order lines for boxes and events for issues.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Annotations
from plumbline.operators import annotations as an
from plumbline.operators import duplicates as du
from plumbline.operators import findings as fi
from plumbline.operators import pages as pg
from plumbline.operators import statistics as st
from plumbline.plans import ranks, selection
from plumbline.plans.components import connected_components
from plumbline.plans.keyed import KeyedStore
from plumbline.plans.store import shared_dir, table
from plumbline.queries import FLAG_LIST, Q_BOXES, Q_FINDINGS, Q_FLAGGED, Q_IMAGES, Q_MEMBERS, Q_PAIRS, RANK, _Audited, _issues, boxes, images, near_duplicate_pairs, query
from plumbline.sources import listing as li
from plumbline.sources import yolo


def _own_boxes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Images, and the boxes of those by the image's id."""
    own = table(images(spark, d), "images")
    return own, boxes(spark, d).join(own.select("doc_id", "id"), F.col("image_id") == F.col("doc_id")).select(F.col("id").alias("image_id"), "class_id", "line")


@query(f"WITH {Q_IMAGES}, {Q_BOXES} SELECT id, path FROM images i WHERE split = 'val' AND EXISTS (SELECT 1 FROM boxes b WHERE b.image_id = i.doc_id AND b.class_id = 3)")
def images_with_class(spark, d):
    """Images of a split that have a box of a class."""
    own, b = _own_boxes(spark, d)
    return pg.images(own, pg.ImageFilter(split="val", class_id=3), b).select("id", "path")


@query(f"WITH {Q_IMAGES}{Q_FLAGGED} SELECT id, path FROM flagged WHERE usable AND status = 'ok' AND dark AND height >= 200 AND height <= 400")
def images_of_finding(spark, d):
    """Images that a finding is about, within bounds of their height."""
    own = table(images(spark, d), "images")
    about = fi.affected(own, _issues(spark, d), None).where("finding = 'quality_dark'").select("id")
    return pg.images(own, pg.ImageFilter(ids=about, min_height=200, max_height=400)).select("id", "path")


@query(f"""WITH {Q_MEMBERS}{Q_FLAGGED}, codes(k, code) AS (VALUES {', '.join(f"({n}, '{c}')" for n, c in enumerate(an.LEVELS))}), e AS (SELECT code, substring(sha1(concat('documents/src1/', user_id)), 1, 12) AS id FROM events JOIN codes ON event_id % 15 = k),
a AS (SELECT concat('integrity_', status) AS finding, id FROM images WHERE status <> 'ok' UNION SELECT concat('quality_', flag), id FROM (SELECT id, unnest({FLAG_LIST}) AS flag FROM flagged WHERE usable)
 UNION SELECT concat('annotations_', code), id FROM e WHERE code NOT IN ('missing_label_file', 'empty_label_file') OR id IN (SELECT id FROM images WHERE status = 'ok') UNION SELECT CASE WHEN scope = 'cross_split' THEN 'leakage_exact' ELSE 'duplicates_exact' END, id FROM members)
SELECT finding, count(*) AS images, min(id) AS first, max(id) AS last FROM a GROUP BY finding""")
def images_by_finding(spark, d):
    """How many images every finding is about, and the first and last of them."""
    a = _Audited(spark, d)
    return fi.affected(a.images, _issues(spark, d), a.members).groupBy("finding").agg(F.count("*").alias("images"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(f"{Q_FINDINGS} SELECT id, affected_count FROM f WHERE severity = 'low' AND starts_with(id, 'quality_')")
def findings_filtered(spark, d):
    """Findings of a severity and a category."""
    return pg.findings(_Audited(spark, d).findings(_issues(spark, d)), "low", "image_quality").select("id", "affected_count")


@query(f"{Q_FINDINGS} SELECT severity, count(*) AS count FROM f GROUP BY 1")
def findings_by_severity(spark, d):
    """Findings by severity."""
    return st.value_counts(_Audited(spark, d).findings(_issues(spark, d)), "severity")


@query(f"{Q_FINDINGS} SELECT id, affected_count AS ids_total, CAST(least(50, affected_count) AS INT) AS shown FROM f WHERE starts_with(id, 'quality_') AND id <> 'quality_mixed_grayscale' OR starts_with(id, 'integrity_')")
def findings_public(spark, d):
    """What is shown of findings about images: how many there are, and the first fifty of them."""
    found = _Audited(spark, d).findings(_issues(spark, d)).where("category in ('image_quality', 'integrity') and id != 'quality_mixed_grayscale'")
    return found.select("id", "ids_total", F.size(F.slice("ids", 1, 50)).alias("shown"))


@query(f"WITH {Q_IMAGES} SELECT id, path, split, status, width, height, file_size, round(blur_score, 2) AS blur_score, status = 'ok' AS has_preview FROM images WHERE lang = 'de'")
def image_items(spark, d):
    """Images as lists show them."""
    return images(spark, d).where("lang = 'de'").select("id", "path", "split", "status", "width", "height", "file_size", F.round("blur_score", 2).alias("blur_score"), (F.col("status") == "ok").alias("has_preview"))


@query(f"WITH {Q_IMAGES}, r AS (SELECT id, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS n, contrast FROM images WHERE status = 'ok') SELECT id FROM r WHERE n = 1 AND contrast >= 5")
def searched_images(spark, d):
    """Images that are compared with others: the first of each content, with contrast enough."""
    own = du.firsts(images(spark, d).where("status = 'ok' and sha256 is not null"))
    return own.where(F.col("contrast") >= 5).select("id")


@query(f"""WITH RECURSIVE {Q_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS root FROM r GROUP BY node), m AS (SELECT c.root, max(p.distance) AS d FROM c JOIN pairs p ON p.a = c.node GROUP BY 1)
SELECT concat('p/', lpad(CAST(c.root AS VARCHAR), 9, '0')) AS first_path, count(*) AS size, count(*) AS unique_files, any_value(m.d) AS max_distance, 'perceptual' AS kind, CASE WHEN count(DISTINCT c.node % 2) > 1 THEN 'cross_split' ELSE 'within_split' END AS scope FROM c JOIN m ON c.root = m.root GROUP BY c.root""")
def near_groups(spark, d):
    """Groups of near hashes: how large they are, and how far their members are from each other at most."""
    edges = table(near_duplicate_pairs(spark, d), "edges")
    found = connected_components(edges.select("a", "b"))
    id, path = F.col("node").cast("string"), F.concat(F.lit("p/"), F.lpad(F.col("node").cast("string"), 9, "0"))
    rows = found.select(F.col("component").alias("root"), id.alias("id"), path.alias("path"), F.when(F.col("node") % 2 == 0, "train").otherwise("val").alias("split"), id.alias("sha256"))
    return du.with_groups(rows, edges.select(F.col("a").cast("string").alias("a"), "distance"))[1].select("first_path", "size", "unique_files", "max_distance", "kind", "scope")


_MOST = 10_000_000


@query(f"""WITH f AS (SELECT d.doc_id, d.lang AS split, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT CAST(doc_id AS VARCHAR) AS image_id, concat('p/', doc_id) AS image_path, split, concat(doc_id, '.txt') AS label_path, CASE WHEN missing THEN 'missing_label_file' WHEN doc_id % 7 = 0 THEN 'label_file_too_large' WHEN doc_id % 5 = 0 THEN 'label_file_unreadable' ELSE 'malformed_line' END AS code,
 CASE WHEN NOT missing AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 3 END AS line, CASE WHEN NOT missing AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN left(concat(doc_id, repeat('x', 300)), 200) END AS raw FROM f""")
def label_file_errors(spark, d):
    """What is wrong with label files as such and with their lines, with the image they belong to and the line's first 200 characters."""
    own = spark.read.parquet(f"{d}/documents.parquet").selectExpr("cast(doc_id as string) as id", "concat('p/', doc_id) as path", "lang as split", "concat(doc_id, '.txt') as label_path")
    size = f"case when doc_id % 7 = 0 then {_MOST + 1}L else 20L end as size"
    files = spark.read.parquet(f"{d}/labels.parquet").selectExpr("concat(doc_id, '.txt') as label_path", size, "case when doc_id % 5 > 0 then concat('0 0.5 0.5 0.2 0.2\\n\\n \\t', doc_id, repeat('x', 300), '  ') end as text")
    return an.validate(own, files, 1, Annotations(max_label_bytes=_MOST))[2].where("code != 'orphan_label'").select("image_id", "image_path", "split", "label_path", "code", "line", "raw")


@query(f"""WITH {Q_IMAGES}, codes(k, code) AS (VALUES {', '.join(f"({n}, '{c}')" for n, c in enumerate(an.LEVELS))}), e AS (SELECT code, substring(sha1(concat('documents/src1/', user_id)), 1, 12) AS id FROM events JOIN codes ON event_id % 15 = k)
SELECT i.id, i.path, count(*) AS issues, count(DISTINCT code) AS codes FROM images i JOIN e ON i.id = e.id GROUP BY 1, 2""")
def image_issues(spark, d):
    """The issues of each image that has any."""
    return images(spark, d).select("id", "path").join(_issues(spark, d).select(F.col("image_id").alias("id"), "code"), "id").groupBy("id", "path").agg(F.count("*").alias("issues"), F.countDistinct("code").alias("codes"))


@query(f"""WITH {Q_MEMBERS} SELECT id, group_id, row_number() OVER (ORDER BY {RANK('split')}, path) AS place FROM members""")
def members_in_order(spark, d):
    """Members of all groups, numbered in one order of splits and paths."""
    from plumbline.functions.columns import split_rank
    from plumbline.queries import members

    return ranks.numbered(members(spark, d), "place", split_rank(F.col("split")), "path").select("id", "group_id", F.col("place").cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM lineitem")
def running_quantities(spark, d):
    """Running totals of the quantities of order lines, by flag, over the whole table."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    return ranks.running(rows, "upto", F.col("q"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", by=["l_returnflag"]).drop("q")


@query("SELECT lang AS grp, count(n_chars) AS n, quantile_cont(n_chars, 0.9) AS p90 FROM documents GROUP BY 1 UNION ALL SELECT source, count(n_chars), quantile_cont(n_chars, 0.9) FROM documents GROUP BY source")
def high_quantiles(spark, d):
    """The exact 90th percentile of lengths, by language and by source."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(F.col("lang").alias("grp"), "n_chars").unionByName(docs.select(F.col("source").alias("grp"), "n_chars"))
    return selection.described(rows, "n_chars", "grp", 0.9).select("grp", "n", F.col("at").alias("p90"))


@query(f"WITH {Q_BOXES}, p AS (SELECT b.image_id, b.class_id, b.line, a.line AS of_line, greatest(0.0, least(a.cx + a.w / 2, b.cx + b.w / 2) - greatest(a.cx - a.w / 2, b.cx - b.w / 2)) * greatest(0.0, least(a.cy + a.h / 2, b.cy + b.h / 2) - greatest(a.cy - a.h / 2, b.cy - b.h / 2)) AS inter, a.w * a.h + b.w * b.h AS total FROM (SELECT * REPLACE (image_id % 20 AS image_id, image_id * 10 + line AS line) FROM boxes) a JOIN (SELECT * REPLACE (image_id % 20 AS image_id, image_id * 10 + line AS line) FROM boxes) b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.line < b.line), q AS (SELECT * FROM p WHERE total - inter > 0 AND inter / (total - inter) >= 0.8) SELECT image_id, class_id, line, min(of_line) AS of_line FROM q GROUP BY 1, 2, 3")
def crowded_boxes(spark, d):
    """Boxes that cover eight tenths or more of an earlier one, where twenty images hold them all and a grid finds them."""
    own = boxes(spark, d).withColumns({"line": F.col("image_id") * 10 + F.col("line"), "image_id": F.col("image_id") % 20})
    return an.duplicate_boxes(own, Annotations(duplicate_iou=0.8, max_boxes_for_iou=10)).drop("iou")


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 300")
def stored_page(spark, d):
    """The seventh page of orders, the dearest first, of an order that is stored: paging is the operator."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", "o_custkey")
    return pg.Stored(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], per=1_000).page(7, 50)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'third' WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'first' END AS version, CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END * o_custkey AS value FROM orders WHERE o_orderkey % 3 <> 1 OR o_orderkey % 2 = 0 OR o_orderkey % 5 = 0")
def merged_store(spark, d):
    """Orders merged into a keyed store three times, some of them anew: the latest of each."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    store = KeyedStore(spark, f"{shared_dir(spark)}/plumbline/keyed-{uuid.uuid4().hex}", ["o_orderkey"])
    for n, (name, some) in enumerate((("first", "o_orderkey % 3 != 1"), ("second", "o_orderkey % 2 = 0"), ("third", "o_orderkey % 5 = 0")), 1):
        store.put(orders.where(some).select("o_orderkey", F.lit(name).alias("version"), (F.col("o_custkey") * n).alias("value")))
    return store.read()


@query("SELECT doc_id, concat('set/labels/', source, '/', doc_id, '.x.txt') AS label, concat(source, '/', doc_id, '.x.PNG') AS plain, '.PNG' AS suffix, 4 AS above FROM documents")
def label_places(spark, d):
    """Where images' labels belong, and paths without their dots, as columns."""
    path = F.concat(F.lit("set/images/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".x.PNG"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", path.alias("path"))
    plain = li.normal(F.concat(F.lit("a/../b/./../"), F.substring_index("path", "/", -2)))
    return docs.select("doc_id", yolo.label_path(F.col("path")).alias("label"), plain.alias("plain"), li.suffix(F.col("path")).alias("suffix"), F.size(li.ancestors(F.col("path"))).alias("above"))
