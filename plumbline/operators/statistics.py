"""Totals, splits, classes, balance, histograms and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import histogram_bin, split_rank
from plumbline.plans import selection

FLAGS = ["low_resolution", "extreme_aspect", "blurry", "dark", "bright", "low_contrast"]
BAD = ["corrupted", "unsupported", "zero_byte", "too_large"]
INF = float("inf")
#: Histograms: edges and labels (fixed values).
HISTOGRAMS = {
    "aspect_ratio": ([0, 0.5, 0.75, 0.95, 1.05, 1.34, 1.6, 2, 3, INF], ["<0.5", "0.5-0.75", "0.75-0.95", "≈1:1", "1.05-1.34", "1.34-1.6", "1.6-2", "2-3", ">3"]),
    "blur": ([0, 25, 50, 100, 200, 500, 1000, INF], ["<25", "25-50", "50-100", "100-200", "200-500", "500-1k", ">1k"]),
    "brightness": ([0, 32, 64, 96, 128, 160, 192, 224, 256.001], ["0-32", "32-64", "64-96", "96-128", "128-160", "160-192", "192-224", "224-255"]),
    "contrast": ([0, 16, 32, 48, 64, 80, 96, 128, INF], ["<16", "16-32", "32-48", "48-64", "64-80", "80-96", "96-128", ">128"]),
    "megapixels": ([0, 0.1, 0.3, 0.5, 1, 2, 4, 8, INF], ["<0.1", "0.1-0.3", "0.3-0.5", "0.5-1", "1-2", "2-4", "4-8", ">8"]),
    "boxes_per_image": ([0, 1, 2, 3, 6, 11, 21, INF], ["0", "1", "2", "3-5", "6-10", "11-20", "21+"]),
    "box_area": ([0, 1e-4, 1e-3, 1e-2, 0.05, 0.1, 0.25, 0.5, 1.0001], ["<0.01%", "0.01-0.1%", "0.1-1%", "1-5%", "5-10%", "10-25%", "25-50%", ">50%"]),
}


def histogram(rows: DataFrame, value: str, edges: list[float], labels: list[str]) -> DataFrame:
    """(bin, label, count) with bins of no row too; null values aren't counted."""
    names = rows.sparkSession.createDataFrame(list(enumerate(labels)), "bin int, label string")
    counts = rows.where(F.col(value).isNotNull()).select(histogram_bin(F.col(value), edges).alias("bin")).groupBy("bin").count()
    return F.broadcast(names).join(counts, "bin", "left").select("bin", "label", F.coalesce("count", F.lit(0)).alias("count"))  # a row for each label


def summaries(rows: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, min, max, mean to 3 places, exact median) for each of a few groups with values; a group of null is one too."""
    return selection.described(rows, value, by).select(by, "n", "min", "max", F.round("mean", 3).alias("mean"), F.col("at").alias("median"))


def describe(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, min, max, mean to 3 places and the exact median; nulls if there is no value."""
    kind = dict(rows.dtypes)[value]
    found = summaries(rows.select(F.lit(0).alias("g"), F.col(value).alias("v")), "v", "g").drop("g")
    one = lambda c: F.max(c).cast(kind if c in ("min", "max") else "double").alias(c)
    return found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *map(one, ("min", "max", "mean", "median")))


def totals(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row of counts over images (status, file_size, label_status, total_lines, invalid_lines, is_grayscale) and boxes."""
    valid = F.col("status") == "ok"
    one = images.agg(
        F.count("*").alias("images"), F.count_if(valid).alias("valid_images"), F.count_if(~valid).alias("invalid_images"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_images") for s in BAD],
        F.count_if(F.col("label_status") == "missing").alias("missing_label_images"), F.count_if(F.col("label_status") == "empty").alias("empty_label_images"),
        F.coalesce(F.sum("total_lines"), F.lit(0)).cast("long").alias("annotation_lines"), F.coalesce(F.sum("invalid_lines"), F.lit(0)).cast("long").alias("invalid_lines"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("total_bytes"), F.count_if(valid & F.col("is_grayscale")).alias("grayscale_images"),
    )
    two = boxes.agg(F.count("*").alias("annotations"), F.countDistinct("class_id").alias("classes_seen"), F.countDistinct("image_id").alias("annotated_images"))
    out = one.crossJoin(F.broadcast(two))  # one row each
    return out.withColumn("annotations_per_image", F.coalesce(F.try_divide("annotations", "valid_images"), F.lit(0.0)))


def by_status(images: DataFrame) -> DataFrame:
    """(status, count), the bad ones with 0 too."""
    names = images.sparkSession.createDataFrame([(s,) for s in ["ok", *BAD]], "status string")
    return F.broadcast(names).join(images.groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("count"))  # five rows


def by_split(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(split, images, valid, invalid, annotations, annotated_images, missing_labels, empty_labels) in the order of splits."""
    b = boxes.groupBy("split").agg(F.count("*").alias("annotations"), F.countDistinct("image_id").alias("annotated_images"))
    valid = F.col("status") == "ok"
    i = images.groupBy("split").agg(F.count("*").alias("images"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.count_if(F.col("label_status") == "missing").alias("missing_labels"), F.count_if(F.col("label_status") == "empty").alias("empty_labels"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return i.join(b, "split", "left").select("split", "images", "valid", "invalid", zero("annotations"), zero("annotated_images"), "missing_labels", "empty_labels").orderBy(split_rank(F.col("split")), "split")


def by_class(boxes: DataFrame, declared: DataFrame) -> DataFrame:
    """(class_id, name, count, images, share) of declared (class_id, name) and seen classes; share is of all boxes."""
    seen = boxes.groupBy("class_id").agg(F.count("*").alias("count"), F.countDistinct("image_id").alias("images"))
    out = declared.join(seen, "class_id", "full_outer")
    name = F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    count = F.coalesce("count", F.lit(0))
    return out.select("class_id", name.alias("name"), count.alias("count"), F.coalesce("images", F.lit(0)).alias("images")).withColumn("share", F.coalesce(F.try_divide(F.col("count").cast("double"), F.sum("count").over(Window.partitionBy())), F.lit(0.0)))


def class_by_split(boxes: DataFrame, splits: list[str]) -> DataFrame:
    """(class_id, a column for each split): how many boxes each has."""
    return boxes.groupBy("class_id").pivot("split", splits).agg(F.count(F.lit(1))).na.fill(0)


def balance(classes: DataFrame) -> DataFrame:
    """One row: classes, used, imbalance (most by least among used, to 2 places), ratio (the same unrounded), evenness (entropy by ln of all, to 4), max_class, min_class.

    The two ratios need two used classes; ties go to the smaller class.
    """
    used = F.col("count") > 0
    p = F.col("share")
    out = classes.agg(
        F.count("*").alias("classes"), F.count_if(used).alias("used"), F.max("count").alias("_max"), F.min(F.when(used, F.col("count"))).alias("_min"),
        (-F.sum(F.when(used, p * F.ln(p)).otherwise(0.0))).alias("_h"),
        F.max_by("name", F.when(used, F.struct("count", -F.col("class_id")))).alias("max_class"), F.min_by("name", F.when(used, F.struct("count", "class_id"))).alias("min_class"),
    )
    able = F.col("used") >= 2
    return out.select("classes", "used", F.when(able, F.round(F.col("_max").cast("double") / F.col("_min"), 2)).alias("imbalance"), F.when(able, F.col("_max").cast("double") / F.col("_min")).alias("ratio"), F.when(able, F.round(F.col("_h") / F.ln(F.col("classes").cast("double")), 4)).alias("evenness"), F.when(able, F.col("max_class")).alias("max_class"), F.when(able, F.col("min_class")).alias("min_class"))


def missing_in_splits(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """(split, class_id): classes of train that val or test, where it exists, doesn't have."""
    there = images.where(F.col("split").isin("val", "test")).select("split").distinct()
    train = boxes.where("split = 'train'").select("class_id").distinct()
    want = train.join(F.broadcast(there))  # at most two splits
    return want.join(boxes.select("split", "class_id").distinct(), ["split", "class_id"], "left_anti").select("split", "class_id")


def top_resolutions(images: DataFrame, n: int = 12) -> DataFrame:
    """(resolution, count): the most frequent sizes of valid images; ties go to the smaller path."""
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")).alias("resolution")
    return images.where("status = 'ok' and width is not null").groupBy(size).agg(F.count("*").alias("count"), F.min("path").alias("_p")).orderBy(F.desc("count"), "_p").limit(n).drop("_p")


def unique_resolutions(images: DataFrame) -> DataFrame:
    """One row: how many different sizes valid images have."""
    size = F.when((F.col("width") > 0) & (F.col("height") > 0), F.struct("width", "height"))
    return images.where("status = 'ok'").agg(F.countDistinct(size).alias("unique_resolutions"))


def formats(images: DataFrame) -> DataFrame:
    """(format, count) of valid images; those without one are unknown."""
    return images.where("status = 'ok'").groupBy(F.coalesce(F.nullif("format", F.lit("")), F.lit("unknown")).alias("format")).count()


def channels(images: DataFrame) -> DataFrame:
    """(channels, count) of valid images; none and 0 are left out."""
    return images.where("status = 'ok' and channels > 0").groupBy("channels").count()


def described(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(measure, n, min, max, mean, median) of what valid images measure, all measures at once; see ``describe``."""
    valid, labelled = _measured(images, boxes)
    own = ["width", "height", "aspect_ratio", "blur_score", "brightness", "contrast"]
    long = lambda df, names: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in names])).alias("m")).select("m.*")
    found = summaries(long(valid, own).unionByName(long(labelled, ["boxes_per_image"])), "v", "measure")
    names = images.sparkSession.createDataFrame([(c,) for c in [*own, "boxes_per_image"]], "measure string")
    return F.broadcast(names).join(found, "measure", "left").select("measure", F.coalesce("n", F.lit(0)).alias("n"), "min", "max", "mean", "median")  # a row for each measure


def counted(images: DataFrame, boxes: DataFrame, issues: DataFrame) -> DataFrame:
    """(statistic, value, count): formats, channels, unique sizes, the most frequent sizes, and issues, tags and flags by name."""
    parts = {
        "format": formats(images), "channels": channels(images), "unique_resolutions": unique_resolutions(images).select(F.lit("all"), "unique_resolutions"),
        "resolution": top_resolutions(images), "issue": value_counts(issues, "code"), "tag": value_counts(images, "tags", "tag"), "flag": flag_counts(images),
    }
    return reduce(DataFrame.unionByName, [df.toDF("value", "count").select(F.lit(k).alias("statistic"), F.col("value").cast("string").alias("value"), F.col("count").cast("long").alias("count")) for k, df in parts.items()])


def flag_counts(images: DataFrame) -> DataFrame:
    """(flag, count) of quality flags, those of no image too."""
    names = images.sparkSession.createDataFrame([(f,) for f in FLAGS], "flag string")
    counts = images.select(F.explode("flags").alias("flag")).groupBy("flag").count()
    return F.broadcast(names).join(counts, "flag", "left").select("flag", F.coalesce("count", F.lit(0)).alias("count"))  # six rows


def value_counts(rows: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """(value, count) of a column, or of an array's elements."""
    kind = dict(rows.dtypes)[column]
    value = F.explode(column) if kind.startswith("array") else F.col(column)
    return rows.select(value.alias(name or column)).groupBy(name or column).count()


def _measured(images: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid images with aspect ratio and megapixels, and the number of boxes of those that can have labels."""
    valid = images.where("status = 'ok'").withColumn("aspect_ratio", F.try_divide(F.col("width").cast("double"), F.col("height"))).withColumn("megapixels", F.col("width").cast("double") * F.col("height") / 1e6)
    per = boxes.groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("n"))
    labelled = images.where("status = 'ok' and label_status not in ('missing', 'n/a')").join(per, "id", "left").select(F.coalesce("n", F.lit(0)).alias("boxes_per_image"))
    return valid, labelled


def histograms(images: DataFrame, boxes: DataFrame) -> dict[str, DataFrame]:
    """All histograms by name."""
    valid, labelled = _measured(images, boxes)
    rows = {"blur": (valid, "blur_score"), "boxes_per_image": (labelled, "boxes_per_image"), "box_area": (boxes, "area")}
    return {k: histogram(*rows.get(k, (valid, k)), *v) for k, v in HISTOGRAMS.items()}
