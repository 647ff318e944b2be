"""Queries of the audit operators over the driver's tables, with their SQL.

The tables have no images, so documents stand for them: the text is the content, orders' lines are the annotations of the
document of the same number, and labels say which documents are annotated. ``IMAGES``, ``LINES`` and ``BOXES`` are
written in SQL that both engines read, and each query is the operator over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import Annotations, Config, Gate
from plumbline.functions.columns import hamming, image_id, to_hex
from plumbline.operators import annotations as an
from plumbline.operators import duplicates as du
from plumbline.operators import findings as fi
from plumbline.operators import gate as ga
from plumbline.operators import health as he
from plumbline.operators import pages as pg
from plumbline.operators import statistics as st
from plumbline.plans.store import table

SPLIT = "CASE WHEN doc_id % 5 = 3 THEN 'val' WHEN doc_id % 5 = 4 THEN 'test' ELSE 'train' END"
# A document as an image: sizes and measures are made of its numbers.
IMAGES = f"""SELECT substring(sha1(concat('documents/', source, '/', d.doc_id)), 1, 12) AS id, concat('documents/', source, '/', d.doc_id) AS path,
  d.doc_id AS doc_id, {SPLIT.replace('doc_id', 'd.doc_id')} AS split, lang, text, n_chars AS file_size,
  CASE WHEN d.doc_id % 97 = 0 THEN 'corrupted' WHEN d.doc_id % 101 = 0 THEN 'zero_byte' WHEN d.doc_id % 211 = 0 THEN 'unsupported' ELSE 'ok' END AS status,
  CAST(CASE WHEN d.doc_id % 101 <> 0 THEN 20 + n_chars % 640 END AS INT) AS width, CAST(CASE WHEN d.doc_id % 101 <> 0 THEN 20 + (d.doc_id * 7) % 480 END AS INT) AS height,
  CAST(CASE WHEN d.doc_id % 13 <> 0 THEN n_chars % 1200 END AS DOUBLE) AS blur_score, CAST(CASE WHEN d.doc_id % 13 <> 0 THEN (d.doc_id * 31) % 256 END AS DOUBLE) AS brightness,
  CAST(CASE WHEN d.doc_id % 13 <> 0 THEN (d.doc_id * 17) % 140 END AS DOUBLE) AS contrast, d.doc_id % 29 = 0 AS is_grayscale,
  CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.toxic = 1 THEN 'empty' ELSE 'ok' END AS label_status,
  CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 10 END AS BIGINT) AS total_lines, CAST(CASE WHEN l.quality = 0 THEN 2 ELSE 0 END AS BIGINT) AS invalid_lines
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
# Annotation lines, numbered in their image by all that tells them apart.
LINES = """SELECT CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS line,
  l_orderkey AS image_id, CAST(l_linenumber - 1 AS INT) AS class_id, (l_quantity - 2) / 50 AS cx, l_discount * 10 AS cy, l_tax * 12.5e0 AS w, (l_partkey % 1000) / 1000e0 AS h, l_returnflag
FROM lineitem"""
BOXES = "SELECT image_id, line, class_id, cx, cy, w, h, w * h AS area, l_returnflag, CASE WHEN image_id % 5 = 3 THEN 'val' WHEN image_id % 5 = 4 THEN 'test' ELSE 'train' END AS split FROM lines WHERE cx >= 0 AND cy >= 0 AND w > 0 AND h > 0 AND greatest(cx, cy, w, h) <= 1"


def _view(spark: SparkSession, sf_dir: str, sql: str, **views: str) -> DataFrame:
    """A query of the shared SQL over tables of the folder."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "lineitem") if f" {t}" in " ".join([sql, *views.values()])}
    for name, text in views.items():
        frames[name] = spark.sql(_named(text, frames), **{k: v for k, v in frames.items() if f"{{{k}}}" in _named(text, frames)})
    return spark.sql(_named(sql, frames), **{k: v for k, v in frames.items() if f"{{{k}}}" in _named(sql, frames)})


def _named(sql: str, frames: dict) -> str:
    for name in frames:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {name}", f"{word} {{{name}}}")
    return sql


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images, with the flags of their measures and the hash of their content."""
    q = Config().quality
    from plumbline.functions.columns import quality_flags

    own = _view(spark, sf_dir, IMAGES).withColumn("sha256", F.sha2("text", 256)).drop("text")
    return own.withColumn("flags", quality_flags(*[F.col(c) for c in ("status", "width", "height", "blur_score", "brightness", "contrast")], q))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as valid boxes."""
    return _view(spark, sf_dir, BOXES, lines=LINES)


def copies(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, groups), written once, of images of which there are copies; a group is a content."""
    own = images.where("status = 'ok'").select("id", "path", "split", "sha256")
    many = own.groupBy("sha256").count().where("count > 1").select("sha256")
    found, groups = du.with_groups(table(own.join(many, "sha256").withColumn("root", F.col("sha256")), "copies"))
    return table(found, "members"), table(groups, "groups")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(images(spark, sf_dir))[0]


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(images(spark, sf_dir))[1]


CLASSES = [(n, f"kind_{n}") for n in range(10)]


def declared(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class_id int, name string")


# SQL parts that the oracles share.
Q_IMAGES = f"images AS (SELECT *, sha256(text) AS sha256 FROM ({IMAGES}))"
Q_BOXES = f"lines AS ({LINES}), boxes AS ({BOXES})"
RANK = lambda c: f"CASE {c} WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 9 END"
Q_MEMBERS = f"""{Q_IMAGES}, ok AS (SELECT id, path, split, sha256 FROM images WHERE status = 'ok'),
g AS (SELECT sha256, concat('g_', substring(sha1(string_agg(id, '|' ORDER BY id)), 1, 10)) AS group_id, count(*) AS size, count(DISTINCT split) AS n_splits, min(path) AS first_path,
  min({RANK('split')}) AS first_rank FROM ok GROUP BY sha256 HAVING count(*) > 1),
members AS (SELECT o.*, g.group_id, CASE WHEN n_splits > 1 THEN 'cross_split' ELSE 'within_split' END AS scope, g.first_rank FROM ok o JOIN g ON o.sha256 = g.sha256)"""
Q_FLAGGED = """, flagged AS (SELECT *, status = 'ok' AND width > 0 AND height > 0 AS usable,
  coalesce(least(width, height) < 64, false) AS low_resolution, coalesce(CAST(greatest(width, height) AS DOUBLE) / least(width, height) > 4.0, false) AS extreme_aspect, coalesce(blur_score < 100, false) AS blurry,
  coalesce(brightness < 35, false) AS dark, coalesce(brightness > 220, false) AS bright, coalesce(contrast < 20, false) AS low_contrast FROM images)"""
FLAG_LIST = "list_filter([CASE WHEN low_resolution THEN 'low_resolution' END, CASE WHEN extreme_aspect THEN 'extreme_aspect' END, CASE WHEN blurry THEN 'blurry' END, CASE WHEN dark THEN 'dark' END, CASE WHEN bright THEN 'bright' END, CASE WHEN low_contrast THEN 'low_contrast' END], lambda x: x IS NOT NULL)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {Q_MEMBERS} SELECT group_id, 'exact' AS kind, CASE WHEN n_splits > 1 THEN 'cross_split' ELSE 'within_split' END AS scope, size, 1::BIGINT AS unique_files, 0 AS max_distance, first_path FROM g")
def exact_duplicate_groups(spark, d):
    """Groups of the same content."""
    return groups(spark, d).drop("splits")


@query(f"WITH {Q_MEMBERS} SELECT group_id, id, split, row_number() OVER (PARTITION BY group_id ORDER BY {RANK('split')}, split, path) AS place FROM members")
def duplicate_members_ranked(spark, d):
    """Members of each group in the order of splits and paths."""
    from pyspark.sql import Window

    from plumbline.functions.columns import split_rank

    w = Window.partitionBy("group_id").orderBy(split_rank(F.col("split")), "split", "path")
    return members(spark, d).select("group_id", "id", "split", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {Q_MEMBERS}, r AS (SELECT group_id, split, count(*) - 1 AS n FROM members GROUP BY 1, 2)
SELECT count(*) AS groups, count(*) AS exact, 0::BIGINT AS perceptual, count(*) FILTER (n_splits = 1) AS within_split, count(*) FILTER (n_splits > 1) AS cross_split, CAST(sum(size) AS BIGINT) AS images_in_groups, (SELECT CAST(sum(n) AS BIGINT) FROM r) AS redundant_within_split FROM g""")
def duplicate_summary(spark, d):
    """Counts of duplicate groups."""
    return du.summary(*copies(images(spark, d)))


@query(f"WITH {Q_MEMBERS} SELECT split, CAST(sum(n) AS BIGINT) AS redundant FROM (SELECT group_id, split, count(*) - 1 AS n FROM members GROUP BY 1, 2) GROUP BY split")
def redundant_by_split(spark, d):
    """Copies beyond the first within each split."""
    return du.redundant(members(spark, d))


@query(f"""WITH {Q_MEMBERS}, s AS (SELECT group_id, split, {RANK('split')} AS r, count(*) AS n FROM members GROUP BY 1, 2),
p AS (SELECT a.split AS a, b.split AS b, a.group_id, a.n AS na, b.n AS nb FROM s a JOIN s b ON a.group_id = b.group_id AND a.r < b.r)
SELECT a, b, count(*) AS exact_groups, 0::BIGINT AS perceptual_groups, count(*) AS total_groups, CAST(sum(na) AS BIGINT) AS images_a, CAST(sum(nb) AS BIGINT) AS images_b, array_to_string(list_slice(list_sort(list(group_id)), 1, 12), ',') AS examples FROM p GROUP BY a, b""")
def leakage_pairs(spark, d):
    """Pairs of splits that share content."""
    return du.leakage_pairs(members(spark, d)).withColumn("examples", F.array_join("examples", ","))


@query(f"""WITH {Q_MEMBERS}, e AS (SELECT count(*) FILTER (split <> 'train') AS n, count(DISTINCT split) > 1 AS applicable FROM ok), l AS (SELECT count(DISTINCT id) AS n FROM members WHERE {RANK('split')} <> first_rank)
SELECT l.n AS leaked_images, e.n AS eval_images, CAST(l.n AS DOUBLE) / e.n AS leakage_rate, applicable FROM l, e""")
def leakage_totals(spark, d):
    """How many images of val and test have a copy in an earlier split."""
    own = table(images(spark, d), "images")
    return du.leakage_totals(own, copies(own)[0])


@query(f"WITH {Q_MEMBERS} SELECT id, path, split, group_id FROM members WHERE {RANK('split')} <> first_rank")
def leaked_members(spark, d):
    """Images whose group has a member in an earlier split."""
    return du.leaked(members(spark, d)).select("id", "path", "split", "group_id")


# Two hashes of 40 bits made of the customers' numbers stand for perceptual hashes.
HASHED = "SELECT c_custkey AS id, (c_custkey * 2654435761) % 1099511627776 AS phash, (c_custkey * 40503 + 977) % 65536 AS dhash FROM customer"
Q_PAIRS = f"h AS ({HASHED}), pairs AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.phash, b.phash)) AS INT) AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.phash, b.phash)) <= 7 AND bit_count(xor(a.dhash, b.dhash)) <= 10)"


def _hashed(spark, d) -> DataFrame:
    return spark.sql(HASHED.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{d}/customer.parquet"))


@query(f"WITH {Q_PAIRS} SELECT * FROM pairs")
def near_duplicate_pairs(spark, d):
    """Pairs of hashes within 7 bits whose other hashes are within 10."""
    return du.similar_pairs(_hashed(spark, d), "phash", 7, "id", "dhash", 10)


@query(f"""WITH RECURSIVE {Q_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def duplicate_components(spark, d):
    """Connected components of the near pairs."""
    from plumbline.plans.components import connected_components

    return connected_components(near_duplicate_pairs(spark, d).select("a", "b"))


@query(f"""WITH {Q_PAIRS} SELECT part, CAST(value AS INT) AS value, count(*) AS count FROM (SELECT unnest(range(8)) AS part, unnest(list_transform(range(8), lambda n: (phash // CAST(pow(256, n) AS BIGINT)) % 256)) AS value FROM h) GROUP BY 1, 2 HAVING count(*) > 20""")
def crowded_buckets(spark, d):
    """Parts of hashes that more than 20 rows have."""
    return du.skipped_buckets(_hashed(spark, d), "phash", 20).select(F.col("part").cast("long").alias("part"), F.col("value").cast("int").alias("value"), "count")


@query(f"""WITH {Q_MEMBERS}{Q_FLAGGED}, m AS (SELECT id, max(CASE WHEN scope = 'cross_split' THEN 1 ELSE 0 END) AS cross_split FROM members GROUP BY id),
b AS (SELECT i.id FROM images i JOIN ({LINES}) l ON l.image_id = i.doc_id WHERE l.w * l.h > 0.95 GROUP BY i.id)
SELECT f.id, array_to_string(list_concat(CASE WHEN status <> 'ok' THEN [status] ELSE list_concat(CASE WHEN usable THEN {FLAG_LIST} ELSE [] END, CASE WHEN is_grayscale THEN ['grayscale'] ELSE [] END) END,
  CASE label_status WHEN 'missing' THEN ['missing_label'] WHEN 'empty' THEN ['empty_label'] ELSE [] END, CASE WHEN invalid_lines > 0 THEN ['invalid_annotations'] ELSE [] END, CASE WHEN b.id IS NOT NULL THEN ['suspicious_boxes'] ELSE [] END,
  CASE WHEN m.id IS NOT NULL THEN ['exact_duplicate'] ELSE [] END, CASE WHEN m.cross_split = 1 THEN ['cross_split_leak'] ELSE [] END), ';') AS tags FROM flagged f LEFT JOIN m ON f.id = m.id LEFT JOIN b ON f.id = b.id""")
def tag_assignment(spark, d):
    """The tags of every image."""
    own = table(images(spark, d), "images")
    big = _view(spark, d, "SELECT image_id, w * h AS area FROM lines WHERE w * h > 0.95e0", lines=LINES).join(own.select("doc_id", "id"), F.col("image_id") == F.col("doc_id")).select(F.col("id").alias("image_id"), F.array(F.lit("large")).alias("flags"))
    return du.tags(own, copies(own)[0], big, Config()).select("id", F.array_join("tags", ";").alias("tags"))


def _validated(spark, d, images: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``validate`` over documents as images and rows of labels as their files: an empty text for what is toxic."""
    own = spark.read.parquet(f"{d}/documents.parquet").where(images).selectExpr("cast(doc_id as string) as id", "concat('p/', doc_id) as path", "lang as split", "concat(doc_id, '.txt') as label_path")
    files = spark.read.parquet(f"{d}/labels.parquet").selectExpr("concat(doc_id, '.txt') as label_path", "20L as size", "case when toxic = 1 then '' else '0 0.5 0.5 0.2 0.2' end as text")
    return an.validate(own, files, 1)


@query("SELECT CAST(d.doc_id AS VARCHAR) AS id, 'missing_label_file' AS code, d.lang AS split FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def missing_labels(spark, d):
    """Images without a label file, as the validation finds them."""
    return _validated(spark, d, "true")[2].where("code = 'missing_label_file'").select(F.col("image_id").alias("id"), "code", "split")


@query("SELECT concat(l.doc_id, '.txt') AS label_path, 'orphan_label' AS code FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL")
def orphan_labels(spark, d):
    """Label files without an image among the English ones, as the validation finds them."""
    return _validated(spark, d, "lang = 'en'")[2].where("code = 'orphan_label'").select("label_path", "code")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.toxic = 1 THEN 'empty' ELSE 'ok' END AS label_status, count(*) AS count FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def label_states(spark, d):
    """The validation's state of every image's label file."""
    return st.value_counts(_validated(spark, d, "true")[0], "label_status")


@query(f"WITH {Q_IMAGES} SELECT label_status, count(*) AS count FROM images GROUP BY 1")
def label_coverage(spark, d):
    """How many images have labels."""
    return st.value_counts(images(spark, d), "label_status")


_TOTALS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_images" for s in st.BAD)


@query(f"""WITH {Q_IMAGES}, {Q_BOXES}, a AS (SELECT count(*) AS images, count(*) FILTER (status = 'ok') AS valid_images, count(*) FILTER (status <> 'ok') AS invalid_images, {_TOTALS},
 count(*) FILTER (label_status = 'missing') AS missing_label_images, count(*) FILTER (label_status = 'empty') AS empty_label_images, CAST(sum(total_lines) AS BIGINT) AS annotation_lines, CAST(sum(invalid_lines) AS BIGINT) AS invalid_lines,
 CAST(sum(file_size) AS BIGINT) AS total_bytes, count(*) FILTER (status = 'ok' AND is_grayscale) AS grayscale_images FROM images),
b AS (SELECT count(*) AS annotations, count(DISTINCT class_id) AS classes_seen, count(DISTINCT image_id) AS annotated_images FROM boxes) SELECT a.*, b.*, CAST(annotations AS DOUBLE) / valid_images AS annotations_per_image FROM a, b""")
def totals(spark, d):
    """All totals."""
    return st.totals(images(spark, d), boxes(spark, d))


@query(f"WITH {Q_IMAGES}, s AS (SELECT unnest(['ok', 'corrupted', 'unsupported', 'zero_byte', 'too_large']) AS status) SELECT s.status, count(i.id) AS count FROM s LEFT JOIN images i ON s.status = i.status GROUP BY 1")
def status_counts(spark, d):
    """Images by status, with those that none has."""
    return st.by_status(images(spark, d))


@query(f"""WITH {Q_IMAGES}, {Q_BOXES}, b AS (SELECT split, count(*) AS annotations, count(DISTINCT image_id) AS annotated_images FROM boxes GROUP BY 1)
SELECT i.split, count(*) AS images, count(*) FILTER (status = 'ok') AS valid, count(*) FILTER (status <> 'ok') AS invalid, coalesce(max(b.annotations), 0) AS annotations, coalesce(max(b.annotated_images), 0) AS annotated_images,
 count(*) FILTER (label_status = 'missing') AS missing_labels, count(*) FILTER (label_status = 'empty') AS empty_labels FROM images i LEFT JOIN b ON i.split = b.split GROUP BY i.split""")
def split_stats(spark, d):
    """Counts by split."""
    return st.by_split(images(spark, d), boxes(spark, d))


_CLASSES = f"""{Q_BOXES}, declared AS (SELECT CAST(n AS INT) AS class_id, concat('kind_', n) AS name FROM (SELECT unnest(range(10)) AS n)),
seen AS (SELECT class_id, count(*) AS count, count(DISTINCT image_id) AS images FROM boxes GROUP BY 1),
classes AS (SELECT coalesce(d.class_id, s.class_id) AS class_id, coalesce(d.name, concat('class_', s.class_id)) AS name, coalesce(count, 0) AS count, coalesce(images, 0) AS images FROM declared d FULL JOIN seen s ON d.class_id = s.class_id)"""


@query(f"WITH {_CLASSES} SELECT *, CAST(count AS DOUBLE) / CAST((SELECT sum(count) FROM classes) AS BIGINT) AS share FROM classes")
def class_stats(spark, d):
    """Boxes and images by class, declared or seen."""
    return st.by_class(boxes(spark, d), declared(spark))


@query(f"WITH {Q_BOXES} SELECT class_id, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM boxes GROUP BY 1")
def class_per_split(spark, d):
    """Boxes by class, a column for each split."""
    return st.class_by_split(boxes(spark, d), ["train", "val", "test"])


@query(f"""WITH {_CLASSES}, u AS (SELECT count(*) FILTER (count > 0) AS used, max(count) AS hi, min(count) FILTER (count > 0) AS lo FROM classes)
SELECT (SELECT count(*) FROM classes) AS classes, used, round(CAST(hi AS DOUBLE) / lo, 2) AS imbalance, CAST(hi AS DOUBLE) / lo AS ratio, (SELECT round(-sum(CASE WHEN count > 0 THEN p * ln(p) ELSE 0 END) / ln(CAST(count(*) AS DOUBLE)), 4) FROM (SELECT count, count / (SELECT CAST(sum(count) AS DOUBLE) FROM classes) AS p FROM classes)) AS evenness, (SELECT name FROM classes WHERE count = hi ORDER BY class_id LIMIT 1) AS max_class, (SELECT name FROM classes WHERE count = lo ORDER BY class_id LIMIT 1) AS min_class FROM u""")
def class_balance(spark, d):
    """How even the classes are."""
    return st.balance(st.by_class(boxes(spark, d), declared(spark)))


@query(f"WITH {_CLASSES} SELECT class_id, name FROM classes WHERE count = 0")
def unused_classes(spark, d):
    """Classes without a box."""
    return st.by_class(boxes(spark, d), declared(spark)).where("count = 0").select("class_id", "name")


@query(f"""WITH {Q_BOXES}, few AS (SELECT * FROM boxes WHERE NOT (split = 'val' AND class_id IN (2, 5)) AND NOT (split = 'test' AND class_id = 6))
SELECT s.split, t.class_id FROM (SELECT DISTINCT class_id FROM few WHERE split = 'train') t, (SELECT unnest(['val', 'test']) AS split) s WHERE NOT EXISTS (SELECT 1 FROM few f WHERE f.split = s.split AND f.class_id = t.class_id)""")
def classes_missing_in_split(spark, d):
    """Classes of train that others lack, with some taken out."""
    few = boxes(spark, d).where("not (split = 'val' and class_id in (2, 5)) and not (split = 'test' and class_id = 6)")
    return st.missing_in_splits(few, images(spark, d))


# The labels that histograms must have, spelled out here again: the SQL doesn't take them from the operator.
_LABELS = {
    "aspect_ratio": "<0.5 0.5-0.75 0.75-0.95 ≈1:1 1.05-1.34 1.34-1.6 1.6-2 2-3 >3",
    "blur": "<25 25-50 50-100 100-200 200-500 500-1k >1k",
    "brightness": "0-32 32-64 64-96 96-128 128-160 160-192 192-224 224-255",
    "contrast": "<16 16-32 32-48 48-64 64-80 80-96 96-128 >128",
    "megapixels": "<0.1 0.1-0.3 0.3-0.5 0.5-1 1-2 2-4 4-8 >8",
    "boxes_per_image": "0 1 2 3-5 6-10 11-20 21+",
    "box_area": "<0.01% 0.01-0.1% 0.1-1% 1-5% 5-10% 10-25% 25-50% >50%",
}


def _bins(name: str) -> tuple[str, str]:
    """SQL of a histogram's labels and of a value's bin."""
    edges, _ = st.HISTOGRAMS[name]
    rows = ", ".join(f"({n}, '{label}')" for n, label in enumerate(_LABELS[name].split()))
    steps = " + ".join(f"CASE WHEN v >= CAST({e!r} AS DOUBLE) THEN 1 ELSE 0 END" for e in edges[1:-1])
    return f"labels(bin, label) AS (VALUES {rows})", steps


def _histogram(name: str, source: str) -> str:
    labels, steps = _bins(name)
    return f"WITH {source}, {labels}, b AS (SELECT {steps} AS bin FROM vals WHERE v IS NOT NULL) SELECT l.bin, l.label, count(b.bin) AS count FROM labels l LEFT JOIN b ON l.bin = b.bin GROUP BY 1, 2"


_VALID = {"aspect_ratio": "CAST(width AS DOUBLE) / height", "megapixels": "CAST(width AS DOUBLE) * height / 1e6", "blur": "blur_score", "brightness": "brightness", "contrast": "contrast"}


def _image_histogram(name: str) -> None:
    def run(spark, d):
        return st.histograms(images(spark, d), boxes(spark, d))[name]

    run.__name__, run.__doc__ = f"hist_{name}", f"The histogram of {name} over valid images."
    query(_histogram(name, f"{Q_IMAGES}, vals AS (SELECT {_VALID[name]} AS v FROM images WHERE status = 'ok')"))(run)


for _name in _VALID:
    _image_histogram(_name)


@query(_histogram("box_area", f"{Q_BOXES}, vals AS (SELECT area AS v FROM boxes)"))
def hist_box_area(spark, d):
    """The histogram of box areas."""
    return st.histogram(boxes(spark, d), "area", *st.HISTOGRAMS["box_area"])


@query(_histogram("boxes_per_image", f"{Q_BOXES}, n AS (SELECT image_id, count(*) AS n FROM boxes GROUP BY 1), vals AS (SELECT coalesce(n.n, 0) AS v FROM orders o LEFT JOIN n ON o.o_orderkey = n.image_id)"))
def hist_density(spark, d):
    """The histogram of boxes per image, over all orders."""
    per = boxes(spark, d).groupBy(F.col("image_id").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").join(per, "o_orderkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return st.histogram(rows, "n", *st.HISTOGRAMS["boxes_per_image"])


@query("SELECT count(n_chars) AS n, min(n_chars) AS min, max(n_chars) AS max, round(CAST(CAST(sum(n_chars) AS BIGINT) AS DOUBLE) / count(n_chars), 3) AS mean, median(n_chars) AS median FROM documents")
def describe_numeric(spark, d):
    """The summary of a number."""
    return st.describe(spark.read.parquet(f"{d}/documents.parquet"), "n_chars")


@query("SELECT lang AS grp, count(n_chars) AS n, CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max, round(CAST(CAST(sum(n_chars) AS BIGINT) AS DOUBLE) / count(n_chars), 3) AS mean, median(n_chars) AS median FROM documents GROUP BY 1 UNION ALL SELECT 'odd', count(*), min(l_extendedprice), max(l_extendedprice), round(avg(l_extendedprice), 3), median(l_extendedprice) FROM lineitem WHERE l_orderkey <> 1 OR l_linenumber > 1 UNION ALL SELECT 'even', count(*), 0, 3, round(CAST(sum(l_orderkey % 4) AS DOUBLE) / count(*), 3), median(l_orderkey % 4) FROM lineitem")
def describe_groups(spark, d):
    """Summaries with exact medians of groups of even and odd sizes, and of a few values that all rows share."""
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "lineitem"))
    rows = [docs.select(F.col("lang").alias("grp"), F.col("n_chars").cast("double").alias("v")), items.where("l_orderkey <> 1 or l_linenumber > 1").select(F.lit("odd").alias("grp"), F.col("l_extendedprice").cast("double").alias("v")), items.select(F.lit("even").alias("grp"), (F.col("l_orderkey") % 4).cast("double").alias("v"))]
    return st.summaries(rows[0].unionByName(rows[1]).unionByName(rows[2]), "v", "grp")


@query(f"WITH {Q_IMAGES} SELECT concat(width, 'x', height) AS resolution, count(*) AS count FROM images WHERE status = 'ok' AND width IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, min(path) LIMIT 12")
def top_resolutions(spark, d):
    """The 12 most frequent sizes: a top-k report."""
    return st.top_resolutions(images(spark, d))




def _line_texts(spark, d) -> DataFrame:
    """Order lines as texts of labels, two in each hundred of them broken."""
    return _view(spark, d, "SELECT image_id, line, " + _TEXT + " AS text FROM lines", lines=LINES)


_TEXT = """CASE WHEN (image_id + line) % 50 = 0 THEN concat('oops ', class_id) WHEN (image_id + line) % 50 = 1 THEN concat(class_id, ' 0.5 0.5 nan 0.1') WHEN (image_id + line) % 50 = 2 THEN concat(class_id - 5, ' 0.5 0.5 0.25 0.0')
 WHEN (image_id + line) % 50 = 3 THEN concat(class_id, ' 0.1 0.1 0.5 0.1 0.5 0.75') ELSE concat('  ', class_id, ' 0.', 10 + image_id % 80, ' 0.', 10 + line % 70, '\t0.', 100 + image_id % 700, ' 0.', 1 + line % 9) END"""


@query(f"""WITH lines AS ({LINES}), t AS (SELECT image_id, line, (image_id + line) % 50 AS k, class_id AS c, {_TEXT} AS text FROM lines)
SELECT image_id, line, CASE WHEN k IN (0, 1) THEN 'malformed_line' WHEN k = 2 THEN CASE WHEN c - 5 < 0 THEN 'invalid_class_id,zero_area' ELSE 'zero_area' END ELSE '' END AS codes,
 CASE WHEN k IN (0, 1) THEN NULL WHEN k = 2 THEN c - 5 ELSE c END AS class_id,
 CASE WHEN k IN (0, 1) THEN NULL WHEN k = 2 THEN 0.5e0 WHEN k = 3 THEN (0.1e0 + 0.5e0) / 2 ELSE CAST(concat('0.', 10 + image_id % 80) AS DOUBLE) END AS cx,
 CASE WHEN k IN (0, 1) THEN NULL WHEN k = 2 THEN 0.0e0 WHEN k = 3 THEN 0.75e0 - 0.1e0 ELSE CAST(concat('0.', 1 + line % 9) AS DOUBLE) END AS h FROM t""")
def parse_label_lines(spark, d):
    """Label lines as texts, parsed: what is wrong with them and where they are."""
    rows = _line_texts(spark, d).withColumn("key", F.struct("image_id", "line"))
    out = an.parsed(an.lines(rows.select("key", "text"), "key").drop("line"), 10)
    return out.select("key.image_id", "key.line", F.array_join("codes", ",").alias("codes"), "class_id", "cx", "h")


@query(f"""WITH {Q_BOXES} SELECT count(*) FILTER (cx - w / 2 < -0.005 OR cy - h / 2 < -0.005 OR cx + w / 2 > 1.005 OR cy + h / 2 > 1.005) AS out_of_bounds, count(*) FILTER (area < 0.0004) AS tiny, count(*) FILTER (area > 0.95) AS large, count(*) AS valid,
 (SELECT count(*) FROM lines WHERE cx < 0 OR cy < 0) AS negative, (SELECT count(*) FROM lines WHERE w = 0 OR h = 0) AS zero_area, (SELECT count(*) FROM lines WHERE greatest(cx, cy, w, h) > 1) AS beyond FROM boxes""")
def box_validation(spark, d):
    """How many lines have each error and warning."""
    rows = _view(spark, d, "SELECT image_id, line, concat_ws(' ', class_id, cx, cy, w, h) AS raw FROM lines", lines=LINES)
    out = an.parsed(rows.withColumn("tokens", F.split("raw", " ")), 0, Annotations())
    has, flag = (lambda c: F.count_if(F.array_contains("codes", c))), (lambda c: F.count_if(F.array_contains("flags", c)).alias(c))
    return out.agg(flag("out_of_bounds"), flag("tiny"), flag("large"), F.count_if(F.size("codes") == 0).alias("valid"), has("negative_coordinate").alias("negative"), has("zero_area").alias("zero_area"), has("coordinate_out_of_range").alias("beyond"))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def issue_counts(spark, d):
    """Rows of a log by kind."""
    return st.value_counts(spark.read.parquet(f"{d}/events.parquet"), "event_type")


@query(f"""WITH {Q_BOXES}, p AS (SELECT b.image_id, b.class_id, b.line, a.line AS of_line, greatest(0.0, least(a.cx + a.w / 2, b.cx + b.w / 2) - greatest(a.cx - a.w / 2, b.cx - b.w / 2)) * greatest(0.0, least(a.cy + a.h / 2, b.cy + b.h / 2) - greatest(a.cy - a.h / 2, b.cy - b.h / 2)) AS inter, a.w * a.h + b.w * b.h AS total
 FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.line < b.line), q AS (SELECT * FROM p WHERE total - inter > 0 AND inter / (total - inter) >= 0.5)
SELECT image_id, class_id, line, min(of_line) AS of_line FROM q GROUP BY 1, 2, 3""")
def duplicate_boxes(spark, d):
    """Boxes that cover half or more of an earlier one of their class."""
    return an.duplicate_boxes(boxes(spark, d), Annotations(duplicate_iou=0.5)).drop("iou")


@query(f"WITH {Q_IMAGES}{Q_FLAGGED} SELECT id, CASE WHEN usable THEN array_to_string({FLAG_LIST}, ',') ELSE '' END AS flags FROM flagged")
def quality_flags(spark, d):
    """The quality flags of every image."""
    return images(spark, d).select("id", F.array_join("flags", ",").alias("flags"))


_FLAG_NAMES = "[" + ", ".join(f"'{f}'" for f in st.FLAGS) + "]"


@query(f"WITH {Q_IMAGES}{Q_FLAGGED}, f AS (SELECT unnest(CASE WHEN usable THEN {FLAG_LIST} ELSE [] END) AS flag FROM flagged) SELECT n.flag, count(f.flag) AS count FROM (SELECT unnest({_FLAG_NAMES}) AS flag) n LEFT JOIN f ON n.flag = f.flag GROUP BY 1")
def flag_counts(spark, d):
    """Images by quality flag."""
    return st.flag_counts(images(spark, d))


class _Audited:
    """Images, their copies, boxes and classes, each written once and read by all that follows."""

    def __init__(self, spark, d) -> None:
        # Of boxes only what is read below is asked for: their numbers, which need an order of all lines, aren't.
        self.images, self.boxes = table(images(spark, d), "images"), table(boxes(spark, d).select("image_id", "class_id", "split"), "boxes")
        self.members, self.groups = copies(self.images)
        self.classes = table(st.by_class(self.boxes, declared(spark)).drop("images"), "classes")

    def components(self) -> DataFrame:
        return he.components(he.rates(self.images, self.members), st.balance(self.classes))

    def findings(self, issues: DataFrame) -> DataFrame:
        log = issues.where(~F.col("code").isin("missing_label_file", "empty_label_file"))
        return fi.build(self.images, log, self.members, self.groups, self.boxes, self.classes)


_RATES = f"""WITH {Q_MEMBERS}{Q_FLAGGED}, {_CLASSES}, v AS (SELECT CAST(count(*) AS DOUBLE) AS n_all, CAST(count(*) FILTER (status = 'ok') AS DOUBLE) AS n, CAST(count(*) FILTER (status <> 'ok') AS DOUBLE) AS bad, CAST(CAST(sum(invalid_lines) AS BIGINT) AS DOUBLE) AS il, CAST(CAST(sum(total_lines) AS BIGINT) AS DOUBLE) AS tl,
 CAST(count(*) FILTER (status = 'ok' AND label_status = 'missing') AS DOUBLE) AS miss, CAST(count(*) FILTER (status = 'ok' AND blur_score IS NOT NULL) AS DOUBLE) AS seen, CAST(count(*) FILTER (usable AND blurry) AS DOUBLE) AS blur, CAST(count(*) FILTER (usable AND (low_resolution OR extreme_aspect OR dark OR bright OR low_contrast)) AS DOUBLE) AS odd,
 CAST(count(*) FILTER (status = 'ok' AND split <> 'train') AS DOUBLE) AS evals FROM flagged),
o AS (SELECT CAST(CAST(sum(n) AS BIGINT) AS DOUBLE) AS n FROM (SELECT group_id, split, count(*) - 1 AS n FROM members GROUP BY 1, 2)), l AS (SELECT CAST(count(DISTINCT id) AS DOUBLE) AS n FROM members WHERE {RANK('split')} <> first_rank),
c AS (SELECT CAST(max(count) AS DOUBLE) / min(count) FILTER (count > 0) AS ratio FROM classes),
m(place, key, metric, weight, zero_at) AS (SELECT 0, 'integrity', bad / n_all, 20e0, 0.05e0 FROM v UNION ALL SELECT 1, 'duplicates', o.n / v.n, 10e0, 0.20e0 FROM v, o UNION ALL SELECT 2, 'leakage', l.n / evals, 20e0, 0.05e0 FROM v, l UNION ALL SELECT 3, 'annotation_validity', il / tl, 20e0, 0.05e0 FROM v
 UNION ALL SELECT 4, 'annotation_coverage', miss / n, 10e0, 0.25e0 FROM v UNION ALL SELECT 5, 'class_balance', ratio, 10e0, 100e0 FROM c UNION ALL SELECT 6, 'blur', blur / seen, 5e0, 0.30e0 FROM v UNION ALL SELECT 7, 'image_stats', odd / n, 5e0, 0.30e0 FROM v),
s AS (SELECT *, 100 * (1 - least(1e0, CASE WHEN key = 'class_balance' THEN ln(metric) / ln(zero_at) ELSE metric / zero_at END)) AS score FROM m)"""


@query(f"{_RATES} SELECT place, key, metric, weight, zero_at, metric IS NOT NULL AS applicable, weight / 100e0 AS effective_weight, CAST(floor(score * 1000) AS BIGINT) AS score_milli FROM s")
def health_components(spark, d):
    """The eight components of the health score."""
    return _Audited(spark, d).components().select("place", "key", "metric", "weight", "zero_at", "applicable", "effective_weight", F.floor(F.col("score") * 1000).alias("score_milli"))


@query(f"{_RATES} SELECT round(sum(weight * round(score, 2)) / 100, 1) AS overall, CASE WHEN round(sum(weight * round(score, 2)) / 100, 1) >= 90 THEN 'A' WHEN round(sum(weight * round(score, 2)) / 100, 1) >= 80 THEN 'B' WHEN round(sum(weight * round(score, 2)) / 100, 1) >= 70 THEN 'C' WHEN round(sum(weight * round(score, 2)) / 100, 1) >= 60 THEN 'D' ELSE 'F' END AS grade FROM s")
def health_overall(spark, d):
    """The health score and its grade."""
    return he.overall(_Audited(spark, d).components())


def _issues(spark, d) -> DataFrame:
    """Events as issues of the images of their users."""
    e = spark.read.parquet(f"{d}/events.parquet")
    code = F.element_at(F.array(*[F.lit(c) for c in an.LEVELS]), (F.col("event_id") % len(an.LEVELS) + 1).cast("int"))
    own = e.select(F.col("event_id").alias("seq"), code.alias("code"), F.concat(F.lit("documents/src1/"), F.col("user_id").cast("string")).alias("image_path"), (F.col("event_id") % 40).cast("int").alias("line"))
    return own.select("*", image_id(F.col("image_path")).alias("image_id"), F.regexp_replace("image_path", "documents", "labels").alias("label_path"), an.level(F.col("code")).alias("level"))


_CODES = ", ".join(f"({n}, '{c}')" for n, c in enumerate(an.LEVELS))
_HIGH = ", ".join(f"'{c}'" for c in fi.ERRORS_HIGH)
Q_FINDINGS = f"""{_RATES}, codes(k, code) AS (VALUES {_CODES}), f AS (
 SELECT concat('integrity_', status) AS id, CASE WHEN status = 'corrupted' THEN CASE WHEN count(*) >= 0.05 * (SELECT n_all FROM v) THEN 'critical' ELSE 'high' END WHEN status = 'zero_byte' THEN 'high' ELSE 'medium' END AS severity, count(*) AS affected_count FROM images WHERE status <> 'ok' GROUP BY status
 UNION ALL SELECT 'tiny_val_split', 'low', count(*) FILTER (split = 'val') FROM images HAVING count(*) FILTER (split = 'val') < 0.05 * count(*)
 UNION ALL SELECT 'quality_mixed_grayscale', 'low', count(*) FILTER (status = 'ok' AND is_grayscale) FROM images
 UNION ALL SELECT CASE WHEN scope = 'cross_split' THEN 'leakage_exact' ELSE 'duplicates_exact' END, CASE WHEN scope = 'cross_split' THEN 'critical' WHEN (count(*) - count(DISTINCT group_id)) / (SELECT n FROM v) >= 0.10 THEN 'high' ELSE 'medium' END, count(*) FROM members GROUP BY scope
 UNION ALL SELECT concat('annotations_', code), CASE WHEN code IN ({_HIGH}) THEN 'high' WHEN code IN ('label_file_too_large', 'duplicate_annotation', 'orphan_label') THEN 'medium' ELSE 'low' END, count(*) FROM events JOIN codes ON event_id % 15 = k WHERE code NOT IN ('missing_label_file', 'empty_label_file') GROUP BY code
 UNION ALL SELECT 'classes_unused', 'medium', count(*) FROM classes WHERE count = 0 HAVING count(*) > 0
 UNION ALL SELECT concat('quality_', flag), CASE WHEN flag = 'blurry' THEN CASE WHEN count(*) / (SELECT n FROM v) >= 0.20 THEN 'high' WHEN count(*) / (SELECT n FROM v) >= 0.05 THEN 'medium' ELSE 'low' END WHEN flag IN ('low_resolution', 'dark', 'bright') AND count(*) / (SELECT n FROM v) >= 0.10 THEN 'medium' ELSE 'low' END, count(*)
  FROM (SELECT unnest({FLAG_LIST}) AS flag FROM flagged WHERE usable) GROUP BY flag)"""


@query(f"{Q_FINDINGS} SELECT id, severity, affected_count FROM f")
def findings_rules(spark, d):
    """The findings of all rules."""
    return _Audited(spark, d).findings(_issues(spark, d)).select("id", "severity", "affected_count")


@query(f"""{Q_FINDINGS} SELECT 'fail_on' AS rule, id AS subject, CAST(affected_count AS DOUBLE) AS value FROM f WHERE severity IN ('critical', 'high')
UNION ALL SELECT 'max_corrupt_rate', key, round(metric, 6) FROM s WHERE key = 'integrity' AND round(metric, 6) > 0.01 UNION ALL SELECT 'max_leakage_rate', key, round(metric, 6) FROM s WHERE key = 'leakage' AND round(metric, 6) > 0.02""")
def ci_gate(spark, d):
    """What makes the audit fail."""
    a = _Audited(spark, d)
    c = table(a.components(), "components")
    return ga.failures(c, he.overall(c), a.findings(_issues(spark, d)), Gate(fail_on="high", max_corrupt_rate=0.01, max_leakage_rate=0.02)).select("rule", "subject", "value")


@query(f"WITH {Q_IMAGES} SELECT id, path, width, blur_score FROM images WHERE split = 'train' AND contains(lower(path), 'src1') AND width >= 100 ORDER BY blur_score DESC NULLS FIRST, path DESC LIMIT 20 OFFSET 20")
def image_page(spark, d):
    """The second page of some images, the sharpest first: paging is the operator."""
    rows = pg.images(images(spark, d), pg.ImageFilter(split="train", q="SRC1", min_width=100))
    return pg.page(pg.ordered(rows, "blur", descending=True), 2, 20).select("id", "path", "width", "blur_score")


@query(f"WITH codes(k, code) AS (VALUES {_CODES}) SELECT event_id AS seq, code, concat('documents/src1/', user_id) AS image_path FROM events JOIN codes ON event_id % 15 = k WHERE k IN (8, 9, 10, 11, 12, 13) AND contains(concat('documents/src1/', user_id), '7') ORDER BY event_id LIMIT 50")
def issues_page(spark, d):
    """The first page of some issues: paging is the operator."""
    rows = pg.issues(_issues(spark, d), level="warning", q="7")
    return pg.page(rows.orderBy("seq"), 1, 50).select("seq", "code", "image_path")


@query(f"WITH {Q_MEMBERS} SELECT group_id, size FROM g ORDER BY CASE WHEN n_splits > 1 THEN 0 ELSE 1 END, size DESC, group_id LIMIT 25")
def duplicates_page(spark, d):
    """The first page of duplicate groups: paging is the operator."""
    return pg.page(pg.duplicates(groups(spark, d), kind="exact"), 1, 25, pg.MOST_GROUPS).select("group_id", "size")


@query("SELECT doc_id, substring(sha1(concat('documents/', doc_id)), 1, 12) AS image_id, printf('%016x', doc_id * 1000003) AS hex, CAST(bit_count(xor(doc_id * 1000003, n_chars * 7)) AS INT) AS distance, CASE WHEN starts_with(lang, 'e') THEN concat('''=', lang) ELSE lang END AS guarded FROM documents")
def scalar_functions(spark, d):
    """Ids, hex codes, distances and guarded texts."""
    from plumbline.functions.columns import guarded

    docs = spark.read.parquet(f"{d}/documents.parquet")
    key = F.col("doc_id") * 1000003
    lang = F.when(F.col("lang").startswith("e"), F.concat(F.lit("="), F.col("lang"))).otherwise(F.col("lang"))
    return docs.select("doc_id", image_id(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"))).alias("image_id"), to_hex(key).alias("hex"), hamming(key, F.col("n_chars") * 7).alias("distance"), guarded(lang).alias("guarded"))


@query("SELECT split, class_id, n FROM (SELECT CASE WHEN doc_id % 5 = 3 THEN 'val' WHEN doc_id % 5 = 4 THEN 'test' ELSE 'train' END AS split, lang AS class_id, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id) GROUP BY 1, 2)")
def labelled_by_split(spark, d):
    """Annotated images by split and language."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id", "left_semi").groupBy(F.expr(SPLIT).alias("split"), F.col("lang").alias("class_id")).agg(F.count("*").alias("n"))


from plumbline import file_queries, view_queries  # noqa: E402, F401  they register their queries here
