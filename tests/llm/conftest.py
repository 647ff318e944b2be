from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, t string, size long, fp long, unit string, k long, words string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, repeats and columns whose names operators use themselves."""
    passage = " ".join(f"w{n}" for n in range(130))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog, and then it sleeps. It is late.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "   \n\t ", "de", "b"), (5, "one", "fr", "b"),
        (6, passage, "en", "c"), (7, "Start " + passage + " end.", "en", None), (8, passage, "en", "c"), (None, passage, "en", "c"), (None, None, None, None),
        (9, "long " * 30000 + "tail", "en", "a"), (10, "x" * 60000, None, "a"), (11, "é😀 ünï wide space \x0b tab\tline\r\nnul\0end <|endoftext|> more", "fr", "d"),
        (12, "The quick brown fox jumps over the lazy dog, and then it sleeps. It is late.", "en", "a"), (12, "The quick brown fox jumps over the lazy dog, and then it sleeps. It is late.", "en", "a"), (13, "a b c", "en", "zz"), (13, "d e f g", "en", "zz"),
    ]
    rows = [(i, t, lang, src, len(t) if t else None, 7, 7, "t", 7, 7, "u", 7, "w") for i, t, lang, src in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
