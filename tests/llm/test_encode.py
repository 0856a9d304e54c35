"""Chunked encoding equals encoding at once, and decodes to the text."""

from __future__ import annotations

import random

import pytest

from corpusloom.llm import encode as e
from corpusloom.llm.encode import decode, encode, encoder


def _long(kind: str, n: int) -> str:
    rng = random.Random(kind)
    if kind == "words":
        return " ".join(rng.choice(["crawler", "l'été", "不完整的结果", "page's", "  ", "\n\n", "404", "…"]) for _ in range(n))
    return {"letters": "a" * n, "blanks": " " * n, "mixed": ("a" * 3000 + "   ") * (n // 3003), "han": "网页爬虫" * (n // 4)}[kind]


TEXTS = [None, "", " ", "<|endoftext|> is text", "naïve café — déjà vu", "👩‍💻", *(_long(k, n) for k in ("words", "letters", "blanks", "mixed", "han") for n in (2000, 9000))]


def test_equals_encoding_at_once(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["id"]: list(r["ids"]) for r in encode(df, chunk=2 * e.OVERLAP + 1).collect()}
    enc = encoder()
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert all(decode(got[i]) == (t or "") for i, t in enumerate(TEXTS))


def test_repeated_rows_and_counts(spark):
    long = _long("words", 3000)
    df = spark.createDataFrame([(1, long), (1, long), (2, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    n = len(encoder().encode_ordinary(long))
    got = sorted((r["id"], r["n_tokens"]) for r in encode(df, chunk=4000, counts=True).collect())
    assert got == [(1, n), (1, n), (2, 2), (2, 2), (3, 0)]


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chunk_must_exceed_overlaps(spark):
    with pytest.raises(ValueError, match="overlap"):
        encode(spark.createDataFrame([], "doc_id long, text string"), chunk=10)
