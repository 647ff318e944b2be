"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Each document gets a place in its source's shuffle and a virtual finish time: the words of its source up to and with
it, divided by the source's target. Taking all sources' documents in the order of finish times serves each source in
proportion to its target at every moment. Documents whose service starts before time 1 stand in line; of one that would
finish later, the words up to time 1 do. Together that is the budget and less than a word a source, and the order is cut
where the budget is used up.

Running totals never gather a source, or the whole order, in one task: rows fall into ranges (of the shuffle hash, or
of the finish time), the totals of ranges are summed up first, and rows are ordered within their range only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD
from plumbline.plans.store import table

#: Rows to a range, about, and ranges at most (so that tables of ranges stay small).
RANGE_ROWS, MOST_RANGES = 1_000, 1 << 16


def targets(sizes: DataFrame, weight: Column, repeats: int = 3) -> DataFrame:
    """(source, source_size) -> (source, source_size, target); source is a name whose order ranks the sources.

    ``weight`` is an expression over ``rank``, a source's place from 1. Targets share the sum of all sizes by weight, but
    none exceeds ``repeats`` times its source; what is over goes to the others by weight. Sources in order of limit /
    weight reach their limits one after another, so with the first k at their limits the level of the others is one
    division, and the level is that of the first k at which the next source stays below its limit.
    """
    by_need = Window.orderBy("need", "source")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = sizes.withColumn("rank", F.row_number().over(Window.orderBy("source"))).withColumn("w", weight.cast("long"))
    w = w.withColumn("most", F.lit(repeats).cast("long") * F.col("source_size")).withColumn("need", F.col("most").cast("double") / F.col("w"))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0).cast("long"))
    level = left.cast("double") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0).cast("long")))
    w = w.withColumn("level", level).withColumn("k", F.row_number().over(by_need))
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("need"), F.struct("k", "level"))).over(whole)["level"])
    return w.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = 3, seed: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The words that a mix of the sources takes from every document.

    Returns one row per row of docs: (id_col, size, source_size, target, taken, epochs, first_at). size is the number of
    words (0 for a null text). taken counts the words of all repeats, at most ``repeats`` times the size; the document
    at which a source's target or the budget ends gives its first words only. epochs is how often the document is started, first_at the place
    in words where the mix first takes it (null: never). Weights are 1, 2, 3, repeating over the sources by code point,
    null last: rows of a null source are a source of their own. The shuffle is by the MD5 of seed and id, or text where
    the id is null, so reruns agree; rows alike in that are told apart by size, and those that agree in that too are alike. An empty
    table gives an empty result, and a mix of empty texts takes nothing. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("2")).alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col(text_col).cast("string").alias("text"))
    rows = table(rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("?"), "text"), F.lit(""))))).drop("text"), "sizes")
    ranges = min(MOST_RANGES, 1 << math.ceil(math.log2(max(1, rows.count() / range_rows))))
    known = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aim = targets(known, (F.col("rank") - 1) % 3 + 1, repeats)

    # Running totals by source: ranges of the shuffle hash's first 4 hex digits, then rows within their range.
    rows = rows.withColumn("r", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("int") * ranges / 65536).cast("int"))
    of_range = rows.groupBy("source", "r").agg(F.sum("size").alias("sum"))
    of_range = of_range.select("source", "r", (F.sum("sum").over(Window.partitionBy("source").orderBy("r")) - F.col("sum")).alias("base"))
    within = Window.partitionBy("source", "r").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(of_range.join(aim, "source"), ["source", "r"])
    rows = table(rows.select("id", "source", "size", "h", (F.col("upto") + F.col("base")).alias("upto"), "source_size", "target"), "shuffled")

    # A copy for each time that service starts before the end, with its finish time as a share of the target.
    ahead = F.col("target") - (F.col("upto") - F.col("size"))
    stands = (F.col("size") > 0) & (ahead > 0)
    times = F.least(F.lit(repeats), F.ceil(ahead / F.col("source_size")).cast("int"))
    copies = rows.where(stands).withColumn("e", F.explode(F.sequence(F.lit(1), times)))
    before = (F.col("e") - 1) * F.col("source_size") + F.col("upto") - F.col("size")
    copies = copies.withColumn("finish", F.least(F.lit(1.0), (before + F.col("size")).cast("double") / F.col("target"))).withColumn("piece", F.least("size", F.ceil(F.col("target") - before)))
    copies = copies.withColumn("r", F.least(F.lit(ranges), F.floor(F.col("finish") * ranges)).cast("int"))
    of_range = copies.groupBy("r").agg(F.sum("piece").alias("sum"))
    of_range = of_range.select("r", (F.sum("sum").over(Window.orderBy("r")) - F.col("sum")).alias("base"))
    budget = known.agg(F.coalesce(F.sum("source_size"), F.lit(0).cast("long")).alias("budget"))
    order = Window.partitionBy("r").orderBy("finish", "source", "h", "id", "size", "e").rowsBetween(Window.unboundedPreceding, 0)
    copies = copies.withColumn("start", F.sum("piece").over(order) - F.col("piece"))
    # of_range has a row for each of at most MOST_RANGES + 1 ranges, and budget has one row.
    copies = copies.join(F.broadcast(of_range), "r").join(F.broadcast(budget)).withColumn("start", F.col("start") + F.col("base"))
    copies = copies.withColumn("words", F.greatest(F.lit(0).cast("long"), F.least("piece", F.col("budget") - F.col("start"))))
    got = F.col("words") > 0
    taken = copies.groupBy("id", "source", "h", "size", "upto").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"), F.count_if(got).alias("epochs"), F.min(F.when(got, F.col("start"))).alias("first_at"))
    out = ["id", "size", "source_size", "target", "taken", "epochs", "first_at"]
    rest = rows.where(~stands).withColumns({"taken": F.lit(0).cast("long"), "epochs": F.lit(0).cast("long"), "first_at": F.lit(None).cast("long")})
    return taken.select(*out).unionByName(rest.select(*out)).withColumnRenamed("id", id_col)
