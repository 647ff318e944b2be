"""Spelling variants: words that differ by one inserted, deleted or replaced character, by merging an errata trie.

The nodes of the trie are the prefixes of the words. At every node the child with the most words below it is heavy, the
others are light, and so is the end of a word at the node; a word passes log2(n) light edges at most. Two words of a pair
part at one node, where at least one of them leaves by a light edge. So light subtrees alone are merged, each with its
edge's character skipped or replaced, into what they may coincide with (small into large):

* replaced by the heavy character, or with that character put before it, into the heavy child's subtree;
* with its character skipped, into the node's own subtree;
* with its character replaced by a wildcard, into the merge of all light subtrees of the node.

Subtrees are never walked: a word that is merged is a terminal, a string, and two terminals coincide if the strings are
equal, which is one equi-join with all words and one grouping. A pair is found once, at the node where its words part.
A wildcard's group has one word for each character at most; nothing else is grouped, and no pairs are formed in a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower
from plumbline.plans.store import drop, materialize, table

#: Runs of letters (fixed values).
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: What stands for a character that was replaced, in keys only: no word has it.
WILD = "\0"


def one_lost(run: Column, of: Column, every: int = 199) -> Column:
    """The run without one character where ``every`` divides the CRC-32 of ``of:run``: the one at CRC modulo length."""
    h = F.crc32(F.concat_ws(":", of, run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least: int = 6, count: int = 5, id_col: str = "doc_id", text_col: str = "text", every: int | None = None) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least ``least`` characters and ``count`` occurrences in all texts.

    Only A-Z are lower-cased. With ``every``, each run first goes through ``one_lost`` with the row's id. A null text has
    no runs, a null id is an empty one. Counts are summed in each task before they are shuffled.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("of"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.select((F.col("run") if every is None else one_lost(F.col("run"), F.col("of"), every)).alias("word"))
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, d, c, heavy): the light edges on each word's path: d characters lie before the edge, c is its own ('' at
    the word's end), heavy the heavy child's."""
    nodes = F.transform(F.sequence(F.lit(0), F.char_length("word")), lambda d: F.struct(d.alias("d"), F.substr("word", F.lit(1), d).alias("node"), F.substr("word", d + 1, F.lit(1)).alias("c")))
    path = words.select("word", "n", F.explode(nodes).alias("e")).select("word", "n", "e.*")
    below = path.groupBy("node", "c").agg(F.count("*").alias("size"))
    # A word's end is never heavy; of equals the first character is. Only nodes with a light edge are of use.
    largest = F.min(F.when(F.col("c") != "", F.struct((-F.col("size")).alias("s"), F.col("c").alias("c"))))["c"]
    heavy = table(below.groupBy("node").agg(largest.alias("heavy"), F.count("*").alias("k")).where("k > 1").select("node", "heavy"), "heavy")
    return path.join(heavy, "node").where("c != heavy").select("word", "n", "d", "c", "heavy")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of words (word, n; each word once) that have a near word.

    n_near counts the words that differ by one inserted, deleted or replaced character; form is the one of them with the
    largest n, ties to the smaller word, form_n its n.
    """
    edges = table(light_edges(words), "edges")
    head, tail = F.substr("word", F.lit(1), F.col("d")), lambda k: F.substr(F.col("word"), F.col("d") + k, F.char_length("word"))
    inner, next_ = F.col("c") != "", F.substr("word", F.col("d") + 2, F.lit(1))
    merged = F.array_compact(F.array(
        F.when(inner, F.concat(head, "heavy", tail(2))),
        F.concat(head, "heavy", tail(1)),
        # What is left must part from the word here and not later.
        F.when(inner & (next_ != F.col("c")), F.concat(head, tail(2))),
    ))
    into = edges.select("word", "n", F.explode(merged).alias("other")).join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = lambda n, w: F.struct((-F.col(n)).alias("n"), F.col(w).alias("word"))
    met = into.select(F.explode(F.array(F.struct(F.col("word"), best("m", "other").alias("best")), F.struct(F.col("other").alias("word"), best("n", "word").alias("best")))).alias("x")).select("x.word", F.lit(1).alias("k"), "x.best")
    wild = edges.where(inner).groupBy(F.concat(head, F.lit(WILD), tail(2)).alias("key")).agg(F.sort_array(F.collect_list(best("n", "word"))).alias("own")).where(F.size("own") > 1)
    each = F.transform("own", lambda x, i: F.struct(x["word"].alias("word"), (F.size("own") - 1).alias("k"), F.get("own", F.when(i == 0, 1).otherwise(0)).alias("best")))
    found = met.unionByName(wild.select(F.explode(each).alias("x")).select("x.*"))
    return found.groupBy("word").agg(F.sum("k").cast("long").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, twice as far in each round."""
    spark = forms.sparkSession
    now, path = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new, where = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        drop(spark, path)
        now, path = new.select("word", "root"), where
        if new.where("went").isEmpty():
            return now


def grouped(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Each word's form and root: (word, form, root, n, n_near, form_n), one row per row of words (word, n; each word once).

    Two words are near if they differ by exactly one inserted, deleted or replaced character. The form of a word is its
    near word of the largest n, ties to the smaller in code-point order, if that n is at least ``ratio`` times its own, and
    null otherwise; with a ratio over 1 forms lead to ever more frequent words, so they end. root is the last that they
    lead to, or the word itself. form_n is the form's n. Words are compared by code points. Null words take no part; an
    empty table gives an empty one.
    """
    if ratio <= 1:
        raise ValueError("forms only end with a ratio over 1")
    words = table(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "words")
    near = words.join(neighbours(words), "word", "left")
    often = F.col("form_n") >= F.col("n") * ratio
    known = table(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n")), "forms")
    roots = _roots(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, least: int = 6, count: int = 5, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text", every: int | None = None) -> DataFrame:
    """The spelling variants among the words of all texts: ``grouped`` over the ``vocabulary`` of docs.

    Repeated rows count as often as they stand; other columns aren't read. Null and empty texts have no words, and a table
    without words gives no rows.
    """
    return grouped(vocabulary(docs, least, count, id_col, text_col, every), ratio)
