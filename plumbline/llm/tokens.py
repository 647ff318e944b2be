"""Token counts: pieces once per distinct pre-token, joined to each document's pre-token frequencies, and summed.

The unit that is counted is a run between single spaces, with the space before it: no token of a byte-level vocabulary
reaches over such a boundary, so a document's count is the sum over its units. The first pass gathers the distinct
units of all documents and how often they stand there; each is tokenized once, for its number of pieces. The most
frequent units, at most ``HEAD`` of them, go to every task as a table; the documents' other units, which are few, are
joined by shuffle. No task holds the vocabulary, and no ids are kept.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.store import table

#: Units in the broadcast table: at most so many, each of at most LONG characters.
HEAD, LONG = 500_000, 40
#: Distinct units that a task gathers before it passes them on.
GATHER = 200_000
#: White space other than space and line feed, what some engines take for it, and U+0000, which marks units here.
ODD = "\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x2010))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_loaded: dict = {}


def _library(path: str):
    """The tokenizer of a file, once per process and in its default settings for texts."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        with open(path, "rb") as f:
            special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        _loaded[path] = t, special
    return _loaded[path]


def simple(text: str, special: list[str]) -> bool:
    """Whether single spaces between other characters than white space are all that can divide the text."""
    if "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
        return False
    return not any(c in text for c in ODD) and not any(s in text for s in special)


def units(text: str, path: str) -> list[str]:
    """Texts whose counts add up to that of ``text``.

    They are shown to the library with a space in front, the first one without; here that one starts with U+0000 and the
    others stand without their space. Long units, and texts with other white space, are divided by the library itself.
    """
    if not text:
        return []
    tokenizer, special = _library(path)
    if not simple(text, special):
        return [f"\0{text}"] if any(s in text for s in special) or len(text) <= LONG else _cut(text, tokenizer)
    first, *rest = text.split(" ")
    out = [f"\0{first}"] if len(first) <= LONG else _cut(first, tokenizer)
    if len(max(rest, key=len, default="")) <= LONG:
        return out + rest
    for x in rest:
        out += [x] if len(x) <= LONG else _cut(f" {x}", tokenizer)
    return out


def _cut(text: str, tokenizer) -> list[str]:
    """The library's own pre-tokens of a text; the text itself if they don't add up to it."""
    out = [f"\0{text[a:b]}" for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    return out if sum(map(len, out)) == len(text) + len(out) else [f"\0{text}"]


def _count(shown: list[str], path: str) -> list[int]:
    tokenizer, _ = _library(path)
    return [len(x) for x in tokenizer.encode_batch_fast([x[1:] if x[:1] == "\0" else f" {x}" for x in shown], add_special_tokens=False)]


def _gather(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])
        for batch in batches:
            for x in batch.column(0):
                seen.update(units(x.as_py(), path))
                if len(seen) >= GATHER:
                    yield out()
                    seen.clear()
        yield out()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_count(batch.column(0).to_pylist(), path), pa.int64())], ["unit", "n", "pieces"])

    return run


def _sum(path: str, head):
    """Each document's pieces of the units in the head, under a null unit, and its other units with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            rows, unit, n = [], [], []
            for i, x in enumerate(batch.column(2)):
                text = x.as_py()
                total, rest = 0, []
                for u in units(text, path) if text else ():
                    if (p := known.get(u)) is None:
                        rest.append(u)
                    else:
                        total += p
                other = Counter(rest)
                rows += [i] * (1 + len(other))
                unit += [None, *other]
                n += [total, *other.values()]
            at = pa.array(rows, pa.int32())
            size = pc.if_else(pa.array([u is None for u in unit], pa.bool_()), batch.column(3).take(at), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), size, pa.array(unit, pa.string()), pa.array(n, pa.int64())], ["id", "h", "n_bytes", "unit", "n"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, head: int = HEAD) -> DataFrame:
    """How many tokens every text has under the tokenizer file at ``path``, as its library gives them.

    Returns one row per row of docs: (id_col, n_bytes, n_tokens, over_limit); over_limit is n_tokens > ``limit``. No begin,
    end or other special tokens are added; strings of special tokens that stand in a text count as the library takes
    them by default. A null text counts as empty: 0 bytes and 0 tokens. Rows with one id and text, null ids and any
    other columns do no harm. The file must be a byte-level vocabulary without a normalizer, and be at that place on
    every executor.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    seen = rows.where("n_bytes > 0").select("text").mapInArrow(_gather(path), "unit string, n long")
    vocabulary = table(seen.groupBy("unit").agg(F.sum("n").alias("n")).mapInArrow(_pieces(path), "unit string, n long, pieces long"), "vocabulary")
    # The most frequent units, down to the eighth of a power of two in their number at which they become too many.
    short, step = vocabulary.where(F.char_length("unit") <= LONG + 1), F.floor(F.log2("n") * 8).cast("int")
    least, many = None, 0
    for x in short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 512 rows at most
        if (many := many + x["count"]) > head:
            break
        least = x["step"]
    top = short.where(F.lit(False) if least is None else step >= least).select("unit", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    kind = dict(rows.dtypes)["id"]
    parts = table(rows.select("id", "h", "text", "n_bytes").mapInArrow(_sum(path, known), f"id {kind}, h long, n_bytes long, unit string, n long"), "parts")
    whole = parts.where("unit is null").select("id", "h", "n_bytes", "n", F.lit(1).alias("rows"))
    rest = parts.where("unit is not null").select("id", "h", "unit", F.col("n").cast("int").alias("n")).join(vocabulary.select("unit", F.col("pieces").cast("int").alias("pieces")), "unit")
    rest = rest.select("id", "h", F.lit(None).cast("long").alias("n_bytes"), (F.col("n").cast("long") * F.col("pieces")).alias("n"), F.lit(0).alias("rows"))
    out = whole.unionByName(rest).groupBy("id", "h").agg(F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    out = out.withColumn("n_tokens", (F.col("n") / F.col("rows")).cast("long")).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
