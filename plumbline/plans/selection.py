"""Exact order statistics of large tables: a sketch narrows the values down, ranges of what is left are counted.

1. A sketch of bounded size gives two values between which the wanted rank should lie.
2. A second look counts how many values lie below them, exactly. Bounds that don't hold the rank are given up.
3. The values between the bounds, a few in ten thousand, are counted by value, dealt to ranges and summed over these;
   the rank lies in one of them.

A value that most rows have is one row of the last step. No task holds more than a range, and nothing but the sketches
and the bounds, a row for each group, is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.ranks import running
from plumbline.plans.store import table

#: A sketch is off by one in so many ranks at most.
ACCURACY = 10_000


def described(rows: DataFrame, value: str, by: str, fraction: float = 0.5, accuracy: int = ACCURACY) -> DataFrame:
    """(by, n, min, max, mean, at): for each group of ``by``, of which there must be few, its values' summary.

    ``at`` is the exact quantile at ``fraction`` from 0 to 1, between two values in proportion, and mean isn't rounded.
    Nulls aren't values, and NaN is the largest one; groups without a value are left out. A null group is one too.
    """
    x, off = F.col("x"), 2 / accuracy
    own = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("x")).where(x.isNotNull())
    wanted = [max(0.0, fraction - off), min(1.0, fraction + off)]
    # Sketches differ by the order in which they are merged, so a second run may give other bounds: each is made once and read by all below.
    seen = own.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.percentile_approx("x", F.array(*map(F.lit, wanted)), accuracy).alias("p"))
    seen = table(seen, "sketches")
    position = (F.col("n") - 1) * F.lit(fraction)
    ranks = seen.select("*", F.floor(position).alias("a"), F.ceil(position).alias("b"), position.alias("position"))
    near = lambda left, right: left.join(F.broadcast(right.withColumnRenamed("g", "_g")), F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
    counts = near(own, ranks.select("g", "p")).groupBy("g").agg(F.count_if(x < F.get("p", F.lit(0))).alias("below"), F.count_if(x <= F.get("p", F.lit(1))).alias("upto"))
    tried = near(ranks, counts)
    good = (F.col("below") <= F.col("a")) & (F.col("b") < F.col("upto"))
    bounds = tried.select("g", "n", "min", "max", "mean", "a", "b", "position", F.when(good, F.get("p", F.lit(0))).otherwise(F.col("min")).alias("low"), F.when(good, F.get("p", F.lit(1))).otherwise(F.col("max")).alias("high"), F.when(good, F.col("below")).otherwise(0).alias("below"))
    left = near(own, bounds.select("g", "low", "high")).where(x.between(F.col("low"), F.col("high"))).groupBy("g", "x").agg(F.count("*").alias("k"))
    placed = near(running(left, "upto", F.col("k"), "x", by=["g"]), bounds)
    first = lambda rank: F.min(F.when(F.col("upto") + F.col("below") > F.col(rank), x))
    out = placed.groupBy("g", "n", "min", "max", "mean", "position", "a").agg(first("a").alias("low"), first("b").alias("high"))
    share = F.col("position") - F.col("a")
    # Rounded once after the product with the lower value, as DuckDB does it.
    between = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), F.col("low"), 1 - share, F.col("high") * share).cast("double")
    at = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between)
    return out.select(F.col("g").alias(by), "n", "min", "max", "mean", at.alias("at"))
