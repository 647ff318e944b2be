"""The gate: whether an audit passes, by rates, score and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import SEVERITIES, Gate
from plumbline.errors import ConfigError

#: The setting and the component whose rate it limits.
LIMITS = {"max_corrupt_rate": "integrity", "max_leakage_rate": "leakage", "max_invalid_annotation_rate": "annotation_validity", "max_duplicate_rate": "duplicates", "max_blur_rate": "blur"}
NEEDS_SCAN = {"leakage", "duplicates", "blur"}
PASS, FAIL, ERROR = 0, 1, 2


def failures(components: DataFrame, overall: DataFrame, findings: DataFrame, gate: Gate) -> DataFrame:
    """(rule, subject, value, bound) for everything that fails; rates are compared to six decimals."""
    spark = components.sparkSession
    limits = [(LIMITS[k], k, float(v)) for k in LIMITS if (v := getattr(gate, k)) is not None]
    by_rate = components.join(F.broadcast(spark.createDataFrame(limits, "key string, rule string, bound double")), "key")  # a row for each limit
    out = by_rate.where(F.round("metric", 6) > F.col("bound")).select("rule", F.col("key").alias("subject"), F.round("metric", 6).alias("value"), "bound")
    if gate.fail_under is not None:
        low = overall.where(F.col("overall") < gate.fail_under)
        out = out.unionByName(low.select(F.lit("fail_under").alias("rule"), F.lit("overall").alias("subject"), F.col("overall").alias("value"), F.lit(float(gate.fail_under)).alias("bound")))
    if gate.fail_on is not None:
        severe = findings.where(F.col("severity").isin(SEVERITIES[: SEVERITIES.index(gate.fail_on) + 1]))
        out = out.unionByName(severe.select(F.lit("fail_on").alias("rule"), F.col("id").alias("subject"), F.col("affected_count").cast("double").alias("value"), F.lit(None).cast("double").alias("bound")))
    return out


def evaluate(components: DataFrame, overall: DataFrame, findings: DataFrame, gate: Gate, mode: str = "scan") -> tuple[int, list[str]]:
    """(exit code, reasons). A limit on what wasn't measured is an error in validate mode, and is passed over else."""
    if mode == "validate":
        missing = [k for k, c in LIMITS.items() if c in NEEDS_SCAN and getattr(gate, k) is not None]
        if missing:
            raise ConfigError(f"{', '.join(missing)} need a full scan")
    found = failures(components, overall, findings, gate).orderBy("rule", "subject").collect()  # a row for each rule and finding at most
    reasons = [f"{r.rule}: {r.subject}" + ("" if r.bound is None else f" is {r.value:g}, bound {r.bound:g}") for r in found]
    return (FAIL if reasons else PASS), reasons
