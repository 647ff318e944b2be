"""A quality classifier from weak labels.

Labellers are heuristics that call a text good or bad, or say nothing where it is too short to judge; they overlap and
err. Expectation-maximisation over the counts of their joint votes estimates how often each is right, and with that the
probability that a text is good; a labeller that says nothing is left out of both steps. Those posteriors train a linear
scorer on hashed features: the text's n-grams of character shapes, and what its words and lines repeat. The scorer
decides on every text, also where the labellers say nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches_for_a_while, small_batches
from plumbline.llm.linear import logistic, packed, sigmoid

#: Rows to train the scorer on, its features, characters of a text that are looked at once.
SAMPLE, FEATURES, CHUNK = 6_000, 2_048, 1 << 18
#: Shapes: letters in lower and upper case, digits, blanks and line ends; others stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[[9, 11, 12, 13]] = 32
_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()/@+_"]] = True
#: In this order; a vote is 1 (good), 0 (bad) or -1 (nothing). The first seven look for a fault, the others for prose.
LABELLERS = ("marks", "capitals", "variety", "stutter", "lines", "tables", "ends", "prose", "sentences")


def measures(text: str) -> np.ndarray:
    """Shares that the labellers judge; nan where there is too little to judge.

    Marks among visible bytes, capitals among letters, distinct among words (as for 200 words, if there are more), words
    that repeat the last one, lines that stood before, words that are one mark, words that end in marks, words that end a
    sentence.
    """
    words = text.split()
    n = len(words)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(b, minlength=256)
    shape = np.bincount(_SHAPE, count, 256)
    lines = [x for x in text.split("\n") if x.strip()]
    part = lambda x, y, least: x / y if y >= least else np.nan
    return np.array([
        part(count[_MARKS].sum(), len(b) - shape[32] - shape[10], 20),
        part(shape[65], shape[97] + shape[65], 20),
        part(len(set(words)) * max(1.0, n / 200) ** 0.3, n, 30),
        part(sum(x == y for x, y in zip(words, words[1:], strict=False)), n - 1, 10),
        part(len(lines) - len(set(lines)), len(lines), 4),
        part(sum(len(w) == 1 and not w.isalnum() for w in words), n, 10),
        part(sum(len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum() for w in words), n, 10),
        part(sum(w[-1] in ".!?" for w in words), n, 15),
    ])


def votes(m: np.ndarray) -> list[int]:
    """The labellers' votes on measures; nothing where one that a labeller needs is nan."""
    marks, capitals, variety, stutter, lines, tables, ends, stops = m.tolist()
    vote = lambda good, *needed: -1 if any(x != x for x in needed) else int(good)
    return [
        vote(marks <= 0.05, marks),
        vote(capitals <= 0.5, capitals),
        vote(variety >= 0.2, variety),
        vote(stutter <= 0.15, stutter),
        vote(lines <= 0.3, lines),
        vote(tables <= 0.15, tables),
        vote(ends <= 0.25, ends),
        vote(marks < 0.03 and capitals < 0.3 and stutter < 0.05, marks, capitals, stutter),
        vote(0.01 < stops < 0.4 and tables < 0.05 and ends < 0.1, stops, tables, ends),
    ]


def features(text: str, m: np.ndarray, size: int = FEATURES) -> np.ndarray:
    """Square roots of the shares of hashed shape 1- to 4-grams, and hashed steps of the measures."""
    out = np.zeros(size)
    bits = np.uint32(32 - size.bit_length() + 1)
    for at in range(0, len(text), CHUNK):
        a = _SHAPE[np.frombuffer(text[at : at + CHUNK].encode("utf-8", "surrogatepass"), np.uint8)]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (a[1:] < 48)  # runs of letters and digits count once
        a = a[keep]
        h = a * np.uint32(0x9E3779B1)
        for n in range(1, 4):
            out += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> bits, minlength=size)
            h = h[:-1] * np.uint32(0xC2B2AE3D) + a[n:] * np.uint32(0x27D4EB2F + 2 * n)
    out = np.sqrt(out / max(1.0, out.sum()))
    for n, x in enumerate(m):
        step = -1 if np.isnan(x) else int(min(40, x * 20 if x <= 1 else 20 + x))
        out[(n * 2654435761 + (step + 2) * 40503 * 7919) % (1 << 32) >> int(bits)] += 0.35
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.8) -> tuple[float, np.ndarray]:
    """(share of good texts, rates[labeller, truth, vote + 1]) by EM over vote patterns and how often each occurs.

    Labellers are taken as independent given the truth, and whether one says nothing as independent of the truth: rates
    are among those that vote, with 0 for nothing. The start says that each is right with 0.8, so that good means good; one
    observation more for each vote keeps rates off 0 and 1.
    """
    k = patterns.shape[1]
    rates = np.tile([[0.0, 0.8, 0.2], [0.0, 0.2, 0.8]], (k, 1, 1))
    for _ in range(rounds):
        p = posterior(patterns, prior, rates)
        prior = float((counts * p).sum() / counts.sum())
        new = np.zeros_like(rates)
        for j in range(k):
            for vote in (0, 1):
                on = counts * (patterns[:, j] == vote)
                new[j, 1, vote + 1], new[j, 0, vote + 1] = (on * p).sum() + 1, (on * (1 - p)).sum() + 1
        rates = new / new.sum(2, keepdims=True)
    return prior, rates


def posterior(patterns: np.ndarray, prior: float, rates: np.ndarray) -> np.ndarray:
    """The probability of good for each pattern."""
    odds = np.full(len(patterns), np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    for j in range(patterns.shape[1]):
        odds += np.append(np.log(rates[j, 1, 1:] / rates[j, 0, 1:]), 0.0)[patterns[:, j]]
    return sigmoid(odds)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter(",".join(map(str, votes(measures(x.as_py() or "")))) for x in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])


def train(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE, size: int = FEATURES) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(share of good, the labellers' rates, the scorer's weights with the intercept last); None without any row.

    The rates come from the votes on all rows, of which the driver gets one count for each of at most 3**9 joint votes.
    The scorer is trained on at most ``rows`` distinct texts, chosen by hash: the bound of its sample. Its share of the
    table follows from a sketch of how many distinct texts there are, so copies don't thin it out. Null texts are empty
    ones; an empty table gives None.
    """
    with batches_for_a_while(docs.sparkSession):
        return _trained(docs, text_col, rows, size)


def _trained(docs: DataFrame, text_col: str, rows: int, size: int) -> tuple[float, np.ndarray, np.ndarray] | None:
    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    got = text.mapInArrow(_votes, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").toArrow()
    if not got.num_rows:
        return None
    patterns, counts = np.array([[int(x) for x in v.split(",")] for v in got.column(0).to_pylist()]), got.column(1).to_numpy().astype(float)
    prior, rates = estimate(patterns, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [measures(x.as_py()) for x in batch.column(1)]
            x = [packed(features(t.as_py(), own, size)) for t, own in zip(batch.column(1), m, strict=True)]
            p = posterior(np.array([votes(own) for own in m]).reshape(len(m), -1), prior, rates)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), pa.array(p, pa.float64())], ["h", "x", "p"])

    hashed = text.withColumn("h", F.xxhash64(F.lit("sample"), "text"))
    n = max(1, hashed.agg(F.approx_count_distinct("h")).first()[0])
    # A quarter more than needed, for the sketch's error; the smallest hashes of those stay.
    bound = min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, 1.25 * rows / n)))
    some = hashed.where(F.col("h") <= bound).distinct().select("h", "text")
    got = some.mapInArrow(run, "h long, x binary, p double").orderBy("h").limit(rows).toArrow()
    return prior, rates, logistic(got.column(1), size, got.column(2).to_numpy())


def _scores(texts: pa.Array, model: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """(score, posterior) of each text."""
    out = np.zeros((2, len(texts)))
    for n, t in enumerate(texts):
        if model is not None and (text := t.as_py()) and text.strip():
            prior, rates, w = model
            m = measures(text)
            out[0, n] = sigmoid(features(text, m, len(w) - 1) @ w[:-1] + w[-1])
            out[1, n] = posterior(np.array([votes(m)]), prior, rates)[0]
    return out[0], out[1]


def score(docs: DataFrame, model: tuple | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id_col, score, keep, posterior) for every row of docs.

    score is the scorer's probability that the text is good, and keep says that it reaches ``least``; posterior is what the
    labellers alone say. A text that is null or has no word scores 0 and is not kept, nor is any without a model. Ids may
    be null or repeat; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, p = _scores(batch.column(1), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s >= least), pa.array(p)], ["id", "score", "keep", "posterior"])

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, keep boolean, posterior double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, rows: int = SAMPLE) -> DataFrame:
    """Trains on docs and scores them: (id_col, score, keep, posterior), one row per row. See ``score``."""
    return score(docs, train(docs, text_col, rows), id_col, text_col, least)


def kept(docs: DataFrame, model: tuple | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text the model keeps.

    Null texts and those without a word go; without a model, which an empty table gives, nothing is kept.
    """
    small_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), sent.value)[0] >= least))

    return docs.mapInArrow(run, docs.schema)
