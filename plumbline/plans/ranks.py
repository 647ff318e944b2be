"""Numbers and running totals of rows in one order over a whole table, without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.store import table


def running(rows: DataFrame, name: str, amount: Column, *order: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """rows with ``name``: the total of ``amount`` up to and with the row in the order, in each group of ``by`` apart.

    Rows are dealt to ranges of the order, summed in each range, and those sums, a row for each range and group, are put
    before the totals within the range. Only a range is ever sorted in one task, and it may spill.
    """
    part, own = "__range", "__before"
    dealt = table(rows.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(part, *by).agg(F.sum(amount).alias(own))
    before = sums.withColumn(own, F.sum(own).over(Window.partitionBy(*by).orderBy(part)) - F.col(own)).toDF(*[f"{c}__" for c in (part, *by)], own)
    total = dealt.withColumn(name, F.sum(amount).over(Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    same = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in (part, *by)]
    # At most a row for each partition, and one more for each group.
    return total.join(F.broadcast(before) if not by else before, same).select(*rows.columns, (F.col(name) + F.col(own)).alias(name))


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with ``name``: their place from 1 in the order."""
    return running(rows, name, F.lit(1).cast("long"), *order)
