"""From raw documents to a training mix: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard, mixing, pii, quality, simhash
from plumbline.llm.common import batches_for_a_while, read
from plumbline.plans.store import materialize, scope

#: Words of a shingle, bits that fingerprints of links by covering LSH differ in at most, least Jaccard similarity.
SHINGLE, RADIUS, SIMILARITY = 5, 4, 0.8


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on these documents, keeps."""
    return quality.kept(docs, quality.train(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates."""
    return simhash.first_of_each(docs, found=jaccard.near_duplicates(docs, SHINGLE, SIMILARITY, radius=RADIUS))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no 10 words of a benchmark item occur."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars counts the new text."""
    return pii.masking(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which words are taken, how many, how often each is started and where it first stands."""
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("decontamination", unseen),
    ("personal_data", private),
    ("mix", mixed),
]

#: Training by expectation-maximisation and XXH64 fingerprints are not to be had in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. What a stage wrote on its way goes when it is done, and its input too.

    Nulls, empty texts and an empty table are as each stage's operator defines them; the session's settings stay.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with batches_for_a_while(spark), scope(spark) as written:
            docs, path = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            written.remove(path)
            if before:
                written.append(before)
            before = path
    return docs
