"""Benchmark decontamination by a positional inverted index, in DataFrame operations alone.

Terms of the benchmark are counted over all training documents. Each benchmark window is looked up by its rarest term;
several windows of an item that have the same one share it. Training tokens are turned into postings (term, document,
position, and the words around), of which only those of such terms go on; each meets the item places that have the term,
the lists are aligned at the offset between the two positions, and the words to the left and right are intersected
from the term outwards. A run as long as the window is an exact match. A posting around which all words of a window
stand, in whatever order, is a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import ascii_lower, free
from plumbline.plans.store import table

#: What stands between words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lookup tables are broadcast up to so many bytes, as measured; beyond, tokens that may be in them are shuffled.
BROADCAST_BYTES = 16 << 20
#: Bits of the marks by which tokens are passed over that no lookup table has.
MARKS = 1 << 22


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and characters beyond ASCII; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BREAK, -1), "")


def _run(own: Column, item: Column) -> Column:
    """How many words agree from the start of two lists."""
    same = F.zip_with(own, F.slice(item, 1, F.size(own)), lambda x, y: x == y)
    stop = F.array_position(same, F.lit(False)).cast("int")
    return F.when(stop > 0, stop - 1).otherwise(F.size(same))


def match(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact phrase and proximity matches of benchmark items in documents.

    Returns one row per row of docs: (id_col, text_hash, n_words, n_hit, items, near_items). A window is ``window`` consecutive
    words of an item; an item of fewer, but not none, is one window. n_hit counts the document's words inside any
    occurrence of a window; items are the ids, as sorted distinct strings, whose windows occur; near_items those of
    which all words of a window stand within window - 1 words around its rarest, exact or not. Null and empty texts have
    no words and match nothing, as have items with a null id. Rows of docs that agree in id and text are told apart only
    by their number; null ids are kept. Other columns aren't read.
    """
    w = window - 1
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), words(F.col(text_col)).alias("words"))
    bench = table(items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0).distinct(), "items")

    # How often the benchmark's terms stand in the documents.
    terms = table(bench.select(F.explode("words").alias("term")).distinct(), "terms")
    every = rows.select(F.explode("words").alias("term"))
    if _bytes(terms) <= broadcast_bytes:
        counts = every.join(F.broadcast(terms), "term").groupBy("term").count()
    else:
        counts = _marked(every, terms).groupBy("term").count().join(terms, "term")
    known = table(counts, "counts")

    # The rarest place of each window, with the words around it; windows with a term that never occurs can't.
    places = bench.select("item", F.xxhash64("words").alias("of"), "words", F.posexplode("words").alias("p", "term"))
    first = F.greatest(F.lit(0), F.col("p") - w)
    starts = F.sequence(first, F.greatest(F.lit(0), F.least(F.col("p"), F.size("words") - window)))
    starts = F.when(F.size("words") <= window, F.array(F.lit(0))).otherwise(F.filter(starts, lambda s: (s <= F.col("p")) & (s + window <= F.size("words"))))
    ahead = F.slice(F.concat(F.col("words"), F.array_repeat(F.lit("\x01"), w)), F.col("p") + 2, w)
    back = F.reverse(F.slice(F.concat(F.array_repeat(F.lit("\x01"), w), F.col("words")), F.col("p") + 1, w))
    places = places.select("item", "of", "p", "term", starts.alias("starts"), back.alias("back"), ahead.alias("ahead"), F.least(F.lit(window), F.size("words")).alias("need"))
    seen = places.join(known, "term", "left").withColumn("s", F.explode("starts"))
    order = Window.partitionBy("item", "of", "s").orderBy(F.coalesce("count", F.lit(0)), "p")
    rare = seen.withColumn("k", F.row_number().over(order)).where((F.col("k") == 1) & F.col("count").isNotNull())
    line = F.concat(F.reverse("back"), F.array("term"), F.col("ahead"))
    rare = rare.withColumn("set", F.array_distinct(F.array_remove(F.slice(line, F.col("s") - F.col("p") + w + 1, window), "\x01")))
    anchors = table(rare.groupBy("term", "item", "of", "p", "back", "ahead", "need").agg(F.collect_set("set").alias("sets")).drop("of", "p"), "anchors")

    # Postings of the documents, and for each document a mark (at 0), so that those without a match come through too.
    size = F.size("words")
    left = F.reverse(F.slice("words", F.greatest(F.lit(1), F.col("pos") - w), F.least(F.lit(w), F.greatest(F.lit(0), F.col("pos") - 1))))
    right = F.slice("words", F.col("pos") + 1, w)
    around = [F.when(F.col("pos") == 0, size).alias("n"), F.when(F.col("pos") > 0, left).alias("left"), F.when(F.col("pos") > 0, right).alias("right")]
    every = rows.select("id", "h", "words", F.posexplode(F.concat(F.array(F.lit("\x00")), F.col("words"))).alias("pos", "term"))
    mark = bench.sparkSession.range(1).select(F.lit("\x00").alias("term"))
    if _bytes(anchors) <= broadcast_bytes:
        met = every.join(F.broadcast(anchors.unionByName(mark, True)), "term").select("id", "h", "pos", "term", *around, "item", "back", "ahead", "need", "sets")
    else:
        # The words around go along before the shuffle, and only with terms that may be looked up; marks stay out of it.
        posted = table(_marked(every, anchors.select("term").distinct().unionByName(mark)).select("id", "h", "pos", "term", *around), "postings")
        met = posted.where("pos > 0").join(anchors, "term").unionByName(posted.where("pos = 0"), True)
    # Generating each row anew keeps the comparisons, which have lambdas, apart from the code that still has all words.
    met = met.select("id", "h", "pos", "term", "n", "left", "right", F.explode(F.array(F.struct("item", "back", "ahead", "need", "sets"))).alias("a"))
    met = met.withColumn("l", _run(F.col("left"), F.col("a.back"))).withColumn("r", _run(F.col("right"), F.col("a.ahead")))
    met = met.withColumn("hit", F.col("l") + F.col("r") + 1 >= F.col("a.need"))
    met = met.withColumn("near", F.col("hit") | F.exists("a.sets", lambda s: F.size(F.array_except(s, F.concat(F.col("left"), F.array("term"), F.col("right")))) == 0))
    met = met.where(F.col("n").isNotNull() | F.col("near"))
    out = met.groupBy("id", "h").agg(F.max("n").alias("n_words"), F.count("n").alias("rows"), F.collect_set(F.when(F.col("hit"), F.struct((F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.col("r")).alias("e")))).alias("runs"), F.collect_set(F.when(F.col("hit"), F.col("a.item"))).alias("items"), F.collect_set(F.when(F.col("near"), F.col("a.item"))).alias("near"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["s"], r["e"])))))
    out = out.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.array_sort("items").alias("items"), F.array_sort("near").alias("near_items"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_row"))
    return out.drop("_row")


def _bytes(df: DataFrame) -> int:
    """About how much memory the rows of a table of strings and their lists take: their text, and 64 bytes a string and row."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.aggregate(c, F.lit(64), lambda a, x: a + of(x, kind.elementType)), F.lit(0))
        return F.coalesce(F.octet_length(c), F.lit(0)) + 64 if isinstance(kind, T.StringType) else F.lit(8)

    return df.agg(F.sum(sum((of(F.col(f.name), f.dataType) for f in df.schema), F.lit(64)).cast("long"))).first()[0] or 0


def _marked(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of tokens whose term may be one of the terms: the bits of their hashes, in at most MARKS / 32768 + 1 rows, are broadcast."""
    mark = F.xxhash64("term").bitwiseAND(F.lit(MARKS - 1))
    bit = F.bitmap_bit_position(mark)
    marks = terms.groupBy(F.bitmap_bucket_number(mark).alias("_of")).agg(F.bitmap_construct_agg(bit).alias("_marks"))
    byte = F.conv(F.hex(F.substr("_marks", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = tokens.join(F.broadcast(marks), F.bitmap_bucket_number(mark) == F.col("_of"))
    return some.where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("_of", "_marks")


def clean(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs."""
    one, other = free("id", docs), free("hash", docs)
    hit = table(match(docs, items, window, id_col, text_col, item_col, item_text_col).where("n_hit > 0").select(F.col(id_col).alias(one), F.col("text_hash").alias(other)).distinct(), "hit")
    return docs.join(hit, docs[id_col].eqNullSafe(hit[one]) & (F.xxhash64(docs[text_col].cast("string")) == hit[other]), "left_anti")
