from __future__ import annotations

from tokenizers import Tokenizer

from plumbline.llm import tokens
from plumbline.llm.queries import op2_tokens, tokenizer_path


def direct(texts):
    t = Tokenizer.from_file(tokenizer_path())
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_query_counts_as_the_library(spark, small, texts):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op2_tokens(spark, small).collect()}
    assert got == {i: (len(t.encode()), n, n > 512) for (i, t), n in zip(texts, direct([t for _, t in texts]), strict=True)}


def test_odd_rows_without_a_head_and_with_one(odd, none):
    texts = [r.text for r in odd.collect()]
    want = sorted(zip([len((t or "").encode()) for t in texts], direct(texts), strict=True))
    for head in (0, 5, 1000):
        got = sorted((r.n_bytes, r.n_tokens) for r in tokens.token_counts(odd, tokenizer_path(), head=head).collect())
        assert got == want
    assert tokens.token_counts(none, tokenizer_path()).count() == 0


def test_units_add_up_on_all_sorts_of_text(spark):
    import random

    r = random.Random(4)
    parts = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "don't", "we'll", "ÀÉ", "数字", "١٢", "42", "!?", "<|endoftext|>", "😀", "\0", "x" * 50, "᠎", "﻿", "²", "ª"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(1500)]
    path = tokenizer_path()
    assert [sum(tokens._count(tokens.units(t, path), path)) for t in texts] == direct(texts)
