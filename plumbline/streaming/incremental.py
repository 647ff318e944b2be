"""Watching a dataset: issue counts by time window, and duplicates of what came before.

Both are Structured Streaming queries. Windows close behind a watermark, so their state is bounded; contents are
remembered for as long as the watermark says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def issue_windows(issues: DataFrame, time: str = "ts", code: str = "code", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, end, code, n) of a stream of issues; rows later than ``late`` are left out."""
    counts = issues.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(code).alias("code")).agg(F.count("*").alias("n"))
    return counts.select("w.start", "w.end", "code", "n")


def first_seen(files: DataFrame, time: str = "ts", key: str = "sha256", late: str = "1 day") -> DataFrame:
    """The rows of a stream whose content didn't come before, within the watermark."""
    return files.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_measured(arrivals: DataFrame, measure, path: str, checkpoint: str) -> StreamingQuery:
    """Measures each batch of arrivals and appends it to a table; a batch that is repeated replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        measure(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return arrivals.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
