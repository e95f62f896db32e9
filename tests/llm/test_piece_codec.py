"""Encoding against the library where pieces of one score meet: runs of blanks."""
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomgraph.llm.piece_codec import PieceTable, digests, encode_and_decode

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def table():
    return PieceTable(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_runs_of_blanks(table, library):
    for n in range(101):
        for left, right in (("", ""), ("a", "b"), ("", "def f():"), ("x =", "")):
            text = left + " " * n + right
            assert table.encode(text) == library.encode(text), (left, n, right)


def test_random_texts(table, library):
    rng = random.Random(11)
    parts = [" ", "  ", " " * 4, " " * 16, "\t", "\n", "a", "the", "ing", "é", "漢字", "😀", "▁", "_", "0", "return", "==", "​", "ﬁ"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 5, 17]) for _ in range(rng.randrange(1, 9)))
        assert table.encode(text) == library.encode(text), text


def test_one_pass(spark, library):
    texts = [None, "", "a" + " " * 40 + "b", "word " * 60_000, *[f"text {i}" for i in range(3000)]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")
    rows = {r.doc_id: r for r in encode_and_decode(docs, MODEL).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].ids == library.encode(t or "") and rows[i].decoded == library.decode(rows[i].ids)
    assert digests(docs, MODEL).where("doc_id = 2").first().n_tokens == len(rows[2].ids)
