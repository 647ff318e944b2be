"""The health score: a weighted mean of eight components, each a measured rate on a line from 100 to 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import COMPONENTS, Config
from plumbline.operators.duplicates import leakage_totals, redundant

LABELS = {
    "integrity": "Image integrity", "duplicates": "Duplicates", "leakage": "Split leakage", "annotation_validity": "Annotation validity",
    "annotation_coverage": "Annotation coverage", "class_balance": "Class balance", "blur": "Sharpness", "image_stats": "Image statistics",
}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
STATS_FLAGS = ["low_resolution", "extreme_aspect", "dark", "bright", "low_contrast"]


def rates(images: DataFrame, members: DataFrame | None, has_labels: bool = True) -> DataFrame:
    """One row: the eight metrics, null where one doesn't apply, over images (status, split, flags, blur_score, label_status, total_lines, invalid_lines).

    Without ``members`` duplicates weren't looked for, and neither they nor leakage apply.
    """
    valid = F.col("status") == "ok"
    n = F.count_if(valid)
    labelled = lambda c: c if has_labels else F.lit(None).cast("double")
    rate = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    measured = valid & F.col("blur_score").isNotNull()
    flagged = lambda names: valid & F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    one = images.agg(
        rate(F.count_if(~valid), F.count("*")).alias("integrity"),
        labelled(rate(F.sum("invalid_lines"), F.sum("total_lines"))).alias("annotation_validity"),
        labelled(rate(F.count_if(valid & (F.col("label_status") == "missing")), n)).alias("annotation_coverage"),
        rate(F.count_if(measured & F.array_contains("flags", "blurry")), F.count_if(measured)).alias("blur"),
        rate(F.count_if(flagged(STATS_FLAGS)), n).alias("image_stats"), n.alias("_valid"),
    )
    null = F.lit(None).cast("double")
    if members is None:
        return one.withColumn("duplicates", null).withColumn("leakage", null)
    over = redundant(members).agg(F.coalesce(F.sum("redundant"), F.lit(0)).alias("_over"))
    leak = leakage_totals(images, members).select(F.when(F.col("applicable"), F.col("leakage_rate")).alias("leakage"))
    out = one.crossJoin(F.broadcast(over)).crossJoin(F.broadcast(leak))  # one row each
    return out.withColumn("duplicates", rate(F.col("_over"), F.col("_valid")))


def components(rates: DataFrame, balance: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Eight rows: (place, key, metric, applicable, score, weight, zero_at, effective_weight), in the fixed order."""
    s = (cfg or Config()).scoring
    # The score goes by the ratio before rounding, where the balance has it.
    ratio = F.col("ratio" if "ratio" in balance.columns else "imbalance")
    row = rates.crossJoin(F.broadcast(balance.select(ratio.alias("class_balance"))))  # one row each
    parts = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(k).alias("key"), F.col(k).cast("double").alias("metric"), F.lit(float(s.weights[k])).alias("weight"), F.lit(float(s.zero_at[k])).alias("zero_at")) for n, k in enumerate(COMPONENTS)])
    out = row.select(F.explode(parts).alias("c")).select("c.*")
    line = F.greatest(F.lit(0.0), F.col("metric")) / F.col("zero_at")
    curve = F.ln(F.greatest(F.lit(1.0), F.col("metric"))) / F.ln(F.greatest(F.lit(1.0000001), F.col("zero_at")))
    share = F.least(F.lit(1.0), F.when(F.col("key") == "class_balance", curve).otherwise(line))
    out = out.withColumn("applicable", F.col("metric").isNotNull()).withColumn("score", 100 * (1 - share))
    used = F.when(F.col("applicable"), F.col("weight")).otherwise(0.0)
    return out.withColumn("effective_weight", F.coalesce(F.try_divide(used, F.sum(used).over(Window.partitionBy())), F.lit(0.0)))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def overall(components: DataFrame) -> DataFrame:
    """One row: score, to one decimal, and grade; nulls if no component with a weight applies."""
    w = F.when(F.col("applicable"), F.col("weight"))
    score = F.round(F.try_divide(F.sum(w * F.round("score", 2)), F.sum(w)), 1)
    return components.agg(score.alias("overall")).withColumn("grade", grade(F.col("overall")))
