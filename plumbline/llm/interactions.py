"""How filters interact: what each removes alone, after others, and on average over all orders.

A document either fails a filter or not, whatever was removed before, so the set of filters it fails, one of 32, says all:
at a step of an order it is removed if that filter is the first of its set. One aggregation counts the documents of each
set in each part, in 32 conditional counts, and as many of the good and the toxic ones. All orders, steps and averages
are sums over those counts: the documents are never looked at again.

Totals and distinct words come from a relational pipeline: words are exploded, counted by (document, word), and these
counts by document.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.rules import SPACE
from plumbline.plans.store import table

FILTERS = "ABCDE"
#: Fewest words, least share of distinct words, most share of capitals (both in hundredths), and characters that none may have.
WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, "#$%&*|"


def word_counts(rows: DataFrame) -> DataFrame:
    """(id, h, n_words, n_distinct) of rows (id, h, text) that have words; rows of one id and h are copies of one text.

    Texts are dealt once, copies of a scanned part apart from those of others, so that both counts are made where a text is
    and none of its words moves. Each row adds an empty string to its words, which no word is, and so counts the copies.
    """
    dealt = rows.select("id", "h", "text", F.spark_partition_id().alias("part")).repartition("id", "h", "part")
    words = dealt.select("id", "h", "part", F.explode(F.concat(F.array_remove(F.split("text", SPACE), ""), F.array(F.lit("")))).alias("word"))
    each = words.groupBy("id", "h", "part", "word").agg(F.count("*").alias("n"))
    own = F.col("word") != ""
    counts = each.groupBy("id", "h", "part").agg(F.try_divide(F.sum(F.when(own, F.col("n"))), F.sum(F.when(~own, F.col("n")))).cast("long").alias("n_words"), F.count_if(own).alias("n_distinct"))
    return counts.groupBy("id", "h").agg(F.max("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask), one row per row of docs: bit k of mask is set if the document fails filter k of ``FILTERS``.

    A: under 50 words; B: distinct words under 65 in 100 (a text without words has no such share, and doesn't fail);
    C: over 5 capitals A-Z in 100 code points; D: has a mark; E: has the text of a row with a smaller id. A null text is an
    empty one; a null part is an empty string. A null id is smaller than none and has none before it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    capitals = F.char_length(F.regexp_replace("text", "[^A-Z]++", ""))
    flags = rows.select("id", "part", "h", F.unhex(F.sha2("text", 256)).alias("t"), (capitals * 100 > F.char_length("text") * CAPITALS).alias("c"), F.col("text").rlike(f"[{MARKS}]").alias("d"))
    # Only texts of several ids can fail E; the table is read back so that the join can split a text with many copies.
    firsts = table(flags.where(F.col("id").isNotNull()).groupBy("t").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("t", "first"), "firsts")
    counts = table(word_counts(rows.select("id", "h", "text")), "words")
    known = flags.join(firsts, "t", "left").alias("f").join(counts.alias("w"), F.col("f.id").eqNullSafe(F.col("w.id")) & (F.col("f.h") == F.col("w.h")), "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = [n < WORDS, distinct * 100 < n * DISTINCT, F.col("c"), F.col("d"), F.coalesce(F.col("f.id") > F.col("first"), F.lit(False))]
    return known.select(F.col("f.id").alias("id"), "part", sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0)).alias("mask"))


def counted(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, documents, good, toxic): for each part three arrays of 32 counts, by mask, of the rows (id, part, mask).

    labels has a row (id, quality, toxic) for some ids; an id is good or toxic if any of its rows says so.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = failed.join(known.hint("merge"), "id", "left")
    count = lambda m, of: F.count_if((F.col("mask") == m) & of)
    kinds = {"documents": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = rows.groupBy("part").agg(*[count(m, of).alias(f"{k}_{m}") for k, of in kinds.items() for m in range(32)])
    return sums.select("part", *[F.array(*[f"{k}_{m}" for m in range(32)]).alias(k) for k in kinds])


def over(counts: Column, holds) -> Column:
    """The sum of the counts of the masks for which ``holds(mask)``."""
    return F.aggregate(F.transform(counts, lambda c, m: F.when(holds(m), c).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, c: a + c)


def orders(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters.

    A mask's documents are removed by each of its filters in an equal share of the orders, which makes shapley a sum too.
    """
    n, every = len(FILTERS), len(list(permutations(FILTERS)))
    # A fixed list: 120 orders of 5 steps, with the filter's bit and those of the filters before it.
    steps = [("".join(o), k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k in range(n)]
    listed = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","k":{k},"b":{b},"e":{e}}}' for o, k, b, e in steps) + "]"), "array<struct<o:string,k:int,b:int,e:int>>")
    b, e, zero = F.col("s.b"), F.col("s.e"), F.lit(0)
    here = lambda m: (m.bitwiseAND(b) != zero) & (m.bitwiseAND(e) == zero)
    share = F.transform("documents", lambda c, m: F.when(m.bitwiseAND(b) != zero, c * (F.lit(every) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return counts.select("*", F.explode(listed).alias("s")).select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step"),
        over(F.col("documents"), lambda m: m.bitwiseAND(b.bitwiseOR(e)) == zero).alias("kept"),
        over(F.col("documents"), here).alias("removed"),
        over(F.col("documents"), lambda m: (m.bitwiseAND(b) != zero) & (m.bitwiseAND(e) != zero)).alias("redundant"),
        over(F.col("documents"), lambda m: m == b).alias("unique_fails"),
        over(F.col("good"), here).alias("good_lost"),
        over(F.col("toxic"), here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, c: a + c).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interaction of the five filters in each part of docs: 600 rows a part, zeros included; see ``orders``.

    See ``failures`` for what the filters take out, nulls and ties, and ``counted`` for labels. Repeated rows count each;
    rows with one id and different texts are different documents. Other columns aren't read. No rows, no parts.
    """
    return orders(counted(failures(docs, id_col, text_col, part_col), labels, id_col))
