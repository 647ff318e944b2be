"""The queries of this subpackage's operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, interactions, langid, mixing, pii, quality, rules, secrets, simhash, suffix, tokens, topk, variants
from plumbline.llm.common import read
from plumbline.llm.spans import joined
from plumbline.llm.sql import SQL


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of 4-word shingles and its component of links at 4 bits or fewer."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, radius=4)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document."""
    return tokens.token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), limit=512)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    return langid.detect(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes from every document."""
    return mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def _digest(spans: Column, base: list[str]) -> tuple[list[Column], Column, Column]:
    """Counts of the base kinds, the hash of the base spans and the string of all spans."""
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter(spans, of(k))).cast("long").alias(f"n_{k}") for k in base]
    return counts, F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(spans).alias("spans")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    counts, base, spans = _digest(F.col("secrets"), secrets.BASE)
    return secrets.scan(read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", *counts, base, spans)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, and whether to keep it."""
    return quality.classify(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the largest inner product for each vector whose id is divisible by 20."""
    return topk.top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; best_score is the highest score of its spans."""
    counts, base, spans = _digest(F.col("pii"), pii.BASE)
    found = pii.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *counts, base, spans, F.array_max(F.transform("pii", lambda s: s["score"])).alias("best_score"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document inside 10-word windows of benchmark items."""
    found = decontaminate.match(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"), window=10)
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that stand in two places or more."""
    return suffix.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), size=400)


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, whether it fails the two base rules, and whether it breaks none of the table's."""
    r = F.col("rules")
    measured = [r[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    base = F.arrays_overlap(r["failed"], F.array(*[F.lit(x.name) for x in rules.BASE]))
    found = rules.judged(read(spark, sf_dir, "documents", "doc_id", "text"), rules.RULES)
    return found.select("doc_id", *measured, base.alias("base_failed"), r["kept"].alias("kept"), F.array_join(r["failed"], ",").alias("failed"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents, some of which lose a letter first."""
    return variants.variants(read(spark, sf_dir, "documents", "doc_id", "text"), least=6, count=5, ratio=5, every=199)


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of every source, by order and step."""
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return interactions.audit(read(spark, sf_dir, "documents", "doc_id", "text", "source"), labels)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_tokens": op2_tokens,
    "op3_language": op3_language,
    "op4_mix": op4_mix,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_topk": op7_topk,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_repeats": op10_repeats,
    "op11_rules": op11_rules,
    "op12_variants": op12_variants,
    "op13_interactions": op13_interactions,
}

__all__ = ["QUERIES", "SQL"]
