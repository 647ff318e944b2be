"""Language identification by hierarchical discrimination.

Features of a text are its hashed letter 1- to 3-grams, words apart, as square roots of their shares. One linear SVM
for each family against all others tells the family. Within it, a linear SVM for each two languages says which of them it
is rather, and the one that most prefer wins. All are trained on the driver, on a sample of at most ``SAMPLE`` rows that every learned
language has an equal part in; whole texts are read to learn and to predict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import free
from plumbline.llm.linear import matrix, packed, sigmoid, svm

#: Rows to learn from, features, characters of a text that are looked at once.
SAMPLE, FEATURES, CHUNK = 2_400, 4_096, 1 << 18
#: Families of languages by ISO 639-1 code (fixed values); any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "sinitic": "zh yue wuu",
    "austronesian": "id ms tl jv su",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: Unicode's letters, and no other word characters (such as superscript digits).
_LETTER = regex.compile(r"\p{L}")
_NOT = re.compile(r"[\W\d_]+")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


def features(text: str, size: int = FEATURES) -> np.ndarray:
    """Square roots of the shares of hashed letter n-grams; zeros for a text without letters."""
    out = np.zeros(size)
    for at in range(0, len(text), CHUNK):
        b = np.frombuffer(f" {_NOT.sub(' ', text[at : at + CHUNK].lower())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
        for h in (b * np.uint32(0x165667B1), two, three):
            out += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - size.bit_length() + 1), minlength=size)
    return np.sqrt(out / max(1.0, out.sum()))


class Model:
    """Family classifiers, and classifiers of pairs of languages by family; x and the weights have the intercept last."""

    def __init__(self, x: np.ndarray, langs: list[str], size: int = FEATURES) -> None:
        self.size, y = size, np.array(langs, object)
        own = np.array([family(v) for v in langs], object)
        self.families = sorted(set(own))
        self.languages = {f: sorted(set(y[own == f])) for f in self.families}
        self.by_family = np.stack([svm(x, np.where(own == f, 1.0, -1.0)) if len(self.families) > 1 else np.zeros(x.shape[1]) for f in self.families])
        self.pairs = {f: list(combinations(range(len(v)), 2)) for f, v in self.languages.items()}
        self.by_pair = {f: [self._between(x, y, v[a], v[b]) for a, b in self.pairs[f]] for f, v in self.languages.items()}

    @staticmethod
    def _between(x: np.ndarray, y: np.ndarray, a: str, b: str) -> np.ndarray:
        rows = (y == a) | (y == b)
        return svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language and a score from 0 to 1: the margins of family and language on a logistic scale, multiplied.

        The language that most of its family's pairs prefer wins, by the sum of its margins if several do; its margin is
        the least of its pairs'.
        """
        x = np.append(x, 1.0)
        z = self.by_family @ x
        n = int(np.argmax(z))
        f, score = self.families[n], float(sigmoid(2 * z[n])) if len(self.families) > 1 else 1.0
        count = len(self.languages[f])
        if count == 1:
            return self.languages[f][0], score
        won, total, least = np.zeros(count), np.zeros(count), np.full(count, np.inf)
        for (a, b), w in zip(self.pairs[f], self.by_pair[f], strict=True):
            m = float(w @ x)
            for side, margin in ((a, m), (b, -m)):
                won[side] += margin > 0
                total[side] += margin
                least[side] = min(least[side], margin)
        best = max(range(count), key=lambda k: (won[k], total[k], -k))
        return self.languages[f][best], score * float(sigmoid(2 * least[best]))


def sample(docs: DataFrame, keep: Column, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE) -> DataFrame:
    """(text, lang) of at most ``rows`` labelled rows, the same number of each language as far as it has them.

    Rows are taken in the order of a hash of their id and text; repeated rows count once. Counts of the languages, of
    which at most ``rows`` are learned (those with the most rows), give a bound below which the hashes of about twice
    as many rows as are needed fall, whatever the size of the table; only those are ranked, and only their texts move.
    """
    at, n, own = free("hash", docs), free("place", docs), free("lang", docs)
    labelled = docs.where(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).withColumn(at, F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)))
    # Distinct rows are counted by a sketch, so that no language's rows meet in one task.
    langs = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.approx_count_distinct(at).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    each = max(1, rows // max(1, len(langs)))
    top = 1 << 63
    bounds = [(r.lang, min(top - 1, int(-top + 2 * top * min(1.0, (2 * each + 40) / r.n)))) for r in langs]
    known = docs.sparkSession.createDataFrame(bounds, f"{own} {dict(docs.select(lang_col).dtypes)[lang_col]}, bound long")
    some = labelled.join(F.broadcast(known), labelled[lang_col] == known[own]).where(F.col(at) <= F.col("bound"))
    some = some.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(at).alias(at)).dropDuplicates([at])
    ranked = some.withColumn(n, F.row_number().over(Window.partitionBy("lang").orderBy(at))).where(F.col(n) <= each)
    return ranked.select("text", "lang")


def train(labelled: DataFrame, size: int = FEATURES) -> Model | None:
    """The model of the (text, lang) rows of ``sample``; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(features(x.as_py(), size)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["x", "lang"])

    got = labelled.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "x binary, lang string").orderBy("lang", "x").toArrow()
    if not got.num_rows:
        return None
    x, langs = matrix(got.column(0), size), got.column(1).to_pylist()
    del got
    return Model(x, langs, size)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row of docs.

    lang_pred is a language the model has learned, or ``und`` with score 0 if the text is null or has no letter, or if there
    is no model. Nothing but the text is used. Ids may be null or repeat.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            langs, scores = [], []
            for x in batch.column(1):
                text = x.as_py()
                lang, score = known.predict(features(text, known.size)) if known and text and _LETTER.search(text) else ("und", 0.0)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that are never learned from: the CRC-32 of the id as text is 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all: (id_col, held_out, lang_pred, score).

    A row with a null id is not held out, and not learned from. Empty tables give empty results; without any labelled row
    every prediction is ``und``.
    """
    keep = ~held_out(id_col) & F.col(id_col).isNotNull()
    model = train(sample(docs.select(id_col, text_col, lang_col), keep, id_col, text_col, lang_col, rows))
    return identify(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
