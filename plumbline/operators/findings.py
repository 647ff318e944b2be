"""Findings: rules over the audit's tables, each with a severity.

Every rule is a row of evidence: how many are affected, of how many, and some examples. Rules are small aggregations;
a table of texts gives them words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import SEVERITIES, Config
from plumbline.operators import statistics as st

EXAMPLES, IDS = 8, 5000
#: id: category, title, what to do.
RULES = {
    "no_images": ("dataset_structure", "No images", "Check the folder and its manifest."),
    "no_val_split": ("dataset_structure", "No validation split", "Set part of the data aside for validation."),
    "no_test_split": ("dataset_structure", "No test split", "Set part of the data aside for a last test."),
    "tiny_val_split": ("dataset_structure", "Very small validation split", "Move more images to validation."),
    "layout_note": ("dataset_structure", "Note on the layout", "See whether the layout was read as meant."),
    "integrity_corrupted": ("integrity", "Files that can't be decoded", "Replace or remove them."),
    "integrity_zero_byte": ("integrity", "Empty files", "Copy them again or remove them."),
    "integrity_unsupported": ("integrity", "Files of other formats", "Convert or remove them."),
    "integrity_too_large": ("integrity", "Files over the size limits", "Scale them down or raise the limits."),
    "leakage_exact": ("data_leakage", "Same files in several splits", "Keep each group in one split."),
    "leakage_perceptual": ("data_leakage", "Near-identical images in several splits", "Keep each group in one split."),
    "duplicates_exact": ("duplicates", "Same files within a split", "Keep one of each group."),
    "duplicates_perceptual": ("duplicates", "Near-identical images within a split", "Look whether they are needed."),
    **{f"annotations_{c}": ("annotations", t, "Correct the lines named in the issues.") for c, t in {
        "malformed_line": "Lines that aren't annotations", "invalid_class_id": "Classes that don't exist", "negative_coordinate": "Coordinates below 0",
        "coordinate_out_of_range": "Coordinates above 1", "invalid_size": "Boxes of negative size", "zero_area": "Boxes without area",
        "label_file_unreadable": "Label files that can't be read", "label_file_too_large": "Label files over the size limit",
        "duplicate_annotation": "Boxes that repeat others", "box_out_of_bounds": "Boxes that reach out of the image", "tiny_box": "Tiny boxes",
        "large_box": "Boxes as large as the image", "missing_label_file": "Images without a label file", "empty_label_file": "Empty label files",
        "orphan_label": "Label files without an image"}.items()},
    "classes_unused": ("class_balance", "Classes without a box", "Annotate them or take them off the list."),
    "class_imbalance": ("class_balance", "Uneven classes", "Gather more of the rare ones or weigh them."),
    "classes_missing_val": ("class_balance", "Classes of train that validation lacks", "Split by class."),
    "classes_missing_test": ("class_balance", "Classes of train that test lacks", "Split by class."),
    **{f"quality_{c}": ("image_quality", t, "Look at the examples.") for c, t in {
        "blurry": "Blurry images", "low_resolution": "Small images", "extreme_aspect": "Very long images", "dark": "Dark images", "bright": "Overexposed images",
        "low_contrast": "Flat images", "mixed_grayscale": "Grayscale among colour images"}.items()},
}
ERRORS_HIGH = ["malformed_line", "invalid_class_id", "negative_coordinate", "coordinate_out_of_range", "invalid_size", "zero_area", "label_file_unreadable"]


def severity_rank(severity: Column) -> Column:
    """0 for the most severe."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def _evidence(rows: DataFrame, key: str, id: str | None, example: Column, extra: list[Column] | None = None) -> DataFrame:
    """(key, n, ids_total, ids, examples, ...) by key; of what is affected, the first ``IDS`` by example are ranked before they are gathered.

    ids_total counts all of them; ``affected`` has them as rows.
    """
    total = F.countDistinct(id) if id else F.lit(0)
    own = rows.groupBy(key).agg(F.count("*").alias("n"), total.alias("ids_total"), *(extra or []))
    each = rows.select(key, example.alias("e"), (F.col(id) if id else F.lit(None).cast("string")).alias("i")).distinct()
    first = each.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("e", "i"))).where(F.col("k") <= IDS)
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "e", "i"))).alias("l"))
    lists = lists.select(key, F.array_compact(F.array_distinct(F.transform("l", lambda x: x["i"]))).alias("ids"), F.slice(F.transform("l", lambda x: x["e"]), 1, EXAMPLES).alias("examples"))
    return own.join(lists, key)


ABOUT_IMAGES = ["missing_label_file", "empty_label_file"]


def _issues(images: DataFrame, issues: DataFrame) -> DataFrame:
    """The issues that findings are made of: of those about images as such, the ones of valid images."""
    valid = images.where("status = 'ok'").select(F.col("id").alias("image_id"))
    about = F.col("code").isin(ABOUT_IMAGES)
    return issues.where(~about).unionByName(issues.where(about).join(valid, "image_id", "left_semi"))


def _group(scope: Column, kind: Column) -> Column:
    return F.concat(F.when(scope == "cross_split", "leakage_").otherwise("duplicates_"), kind)


def affected(images: DataFrame, issues: DataFrame, members: DataFrame | None) -> DataFrame:
    """(finding, id): every image that a finding of ``build`` is about, each once."""
    rows = [
        images.where("status != 'ok'").select(F.concat(F.lit("integrity_"), F.col("status")).alias("finding"), "id"),
        images.where("status = 'ok'").select(F.explode("flags").alias("flag"), "id").select(F.concat(F.lit("quality_"), F.col("flag")).alias("finding"), "id"),
        _issues(images, issues).where("image_id is not null").select(F.concat(F.lit("annotations_"), F.col("code")).alias("finding"), F.col("image_id").alias("id")),
    ]
    if members is not None:
        rows.append(members.select(_group(F.col("scope"), F.col("kind")).alias("finding"), "id"))
    return reduce(DataFrame.unionByName, rows).distinct()


def build(images: DataFrame, issues: DataFrame, members: DataFrame | None, groups: DataFrame | None, boxes: DataFrame, classes: DataFrame, notes: list[str] | None = None, cfg: Config | None = None) -> DataFrame:
    """(place, id, severity, category, title, recommendation, affected_count, rate, ids_total, ids, examples), worst first.

    images as for ``health.rates`` with id and path; issues (code, image_id, label_path, line); classes as by ``by_class``.
    """
    spark = images.sparkSession
    kind = "id string, severity string, affected_count long, rate double, ids_total long, ids array<string>, examples array<string>"
    pick = lambda id, severity, n, rate=None, ids=None, examples=None: [
        (id if isinstance(id, Column) else F.lit(id)).alias("id"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), n.cast("long").alias("affected_count"),
        (rate if rate is not None else F.lit(None)).cast("double").alias("rate"), (F.lit(0) if ids is None else F.col("ids_total")).cast("long").alias("ids_total"), (ids if ids is not None else F.array()).cast("array<string>").alias("ids"), (examples if examples is not None else F.array()).cast("array<string>").alias("examples"),
    ]
    valid = F.col("status") == "ok"
    is_ = lambda s: F.col("split") == s
    size = images.agg(F.count("*").alias("n_all"), F.count_if(valid).alias("n_valid"), F.count_if(is_("train")).alias("n_train"), F.count_if(is_("val")).alias("n_val"), F.count_if(is_("test")).alias("n_test"), F.count_if(valid & F.col("is_grayscale")).alias("n_gray"))
    with_size = lambda df: df.join(F.broadcast(size))  # noqa: E731  one row
    zero, per_all, per_valid = F.lit(0), (lambda n: F.try_divide(n.cast("double"), F.col("n_all"))), (lambda n: n.cast("double") / F.greatest(F.lit(1), F.col("n_valid")))
    n = F.col("n")
    parts = [
        size.where("n_all = 0").select(*pick("no_images", "critical", zero)),
        size.where("n_train > 0 and n_val = 0").select(*pick("no_val_split", "medium", zero)),
        size.where("n_train > 0 and n_test = 0").select(*pick("no_test_split", "info", zero)),
        size.where("n_train > 0 and n_val > 0 and n_val < 0.05 * n_all").select(*pick("tiny_val_split", "low", F.col("n_val"), per_all(F.col("n_val")))),
        size.where("n_gray > 0 and n_gray < n_valid").select(*pick("quality_mixed_grayscale", "low", F.col("n_gray"), per_valid(F.col("n_gray")))),
    ]
    if notes:
        parts.append(spark.createDataFrame([("layout_note", "low", 0, None, 0, [], [x]) for x in notes], kind))

    bad = with_size(_evidence(images.where(~valid), "status", "id", F.col("path")))
    worst = F.when(F.col("status") == "corrupted", F.when(per_all(n) >= 0.05, "critical").otherwise("high")).when(F.col("status") == "zero_byte", "high").otherwise("medium")
    parts.append(bad.select(*pick(F.concat(F.lit("integrity_"), F.col("status")), worst, n, per_all(n), F.col("ids"), F.col("examples"))))

    if members is not None and groups is not None:
        named = members.select("group_id", "id", "path", F.struct("scope", "kind").alias("g"))
        found = with_size(_evidence(named, "g", "id", F.col("path"), [F.countDistinct("group_id").alias("n_groups"), F.countDistinct("id").alias("n_ids")]))
        cross, exact = F.col("g.scope") == "cross_split", F.col("g.kind") == "exact"
        rate = per_valid(n - F.col("n_groups"))
        how = F.when(cross & exact, "critical").when(cross, "high").when(exact, F.when(rate >= 0.10, "high").otherwise("medium")).otherwise("low")
        id = _group(F.col("g.scope"), F.col("g.kind"))
        parts.append(found.select(*pick(id, how, F.when(cross, F.col("n_ids")).otherwise(n), rate, F.col("ids"), F.col("examples"))))

    place = F.concat_ws(":", F.col("label_path"), F.col("line").cast("string"))
    by_code = with_size(_evidence(_issues(images, issues), "code", "image_id", place))
    code, rate = F.col("code"), per_valid(n)
    how = F.when(code.isin(ERRORS_HIGH), "high").when(code.isin("label_file_too_large", "duplicate_annotation", "orphan_label"), "medium").when(code == "missing_label_file", F.when(rate >= 0.10, "high").otherwise("medium")).when(code == "empty_label_file", F.when(rate > 0.5, "low").otherwise("info")).otherwise("low")
    parts.append(by_code.select(*pick(F.concat(F.lit("annotations_"), code), how, n, F.when(code.isin(ABOUT_IMAGES), rate), F.col("ids"), F.col("examples"))))

    names = F.array_sort(F.collect_list("name"))
    unused = classes.where("count = 0").agg(F.count("*").alias("n"), names.alias("names")).where("n > 0")
    parts.append(unused.select(*pick("classes_unused", "medium", n, None, None, F.slice("names", 1, EXAMPLES))))
    uneven = st.balance(classes).crossJoin(F.broadcast(classes.where("count > 0").agg(F.min("count").alias("least"))))  # one row each
    ratio = F.col("imbalance")
    parts.append(uneven.where(ratio >= 10).select(*pick("class_imbalance", F.when(ratio >= 50, "high").otherwise("medium"), F.col("least"), ratio, None, F.array("max_class", "min_class"))))
    lacking = st.missing_in_splits(boxes, images).join(classes.select("class_id", "name"), "class_id").groupBy("split").agg(F.count("*").alias("n"), names.alias("names"))
    parts.append(lacking.select(*pick(F.concat(F.lit("classes_missing_"), F.col("split")), "medium", n, None, None, F.slice("names", 1, EXAMPLES))))

    flagged = with_size(_evidence(images.where(valid).select("id", "path", F.explode("flags").alias("flag")), "flag", "id", F.col("path")))
    flag = F.col("flag")
    how = F.when(flag == "blurry", F.when(rate >= 0.20, "high").when(rate >= 0.05, "medium").otherwise("low")).when(flag.isin("low_resolution", "dark", "bright") & (rate >= 0.10), "medium").otherwise("low")
    parts.append(flagged.select(*pick(F.concat(F.lit("quality_"), flag), how, n, rate, F.col("ids"), F.col("examples"))))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    words = spark.createDataFrame([(k, *v) for k, v in RULES.items()], "id string, category string, title string, recommendation string")
    out = out.join(F.broadcast(words), "id")  # a row for each rule
    return out.withColumn("place", severity_rank(F.col("severity"))).orderBy("place", F.desc("affected_count"), "id").select("place", "id", "severity", "category", "title", "recommendation", "affected_count", "rate", "ids_total", "ids", "examples")
