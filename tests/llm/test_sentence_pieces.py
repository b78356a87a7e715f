"""SentencePiece encoding over distinct chunks against the library, and on awkward rows."""

import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from marquee.llm import queries, sentence_pieces  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MODEL = P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, n_tokens int, decoded long, Text_ string"
AWKWARD = [
    None, "", " ", "  ", "a", "a ", " a", "  a  b ", "▁a▁ b", "\n", "x\n\ny  z\n", " \n ", "\x00a\x00", "naïve Ω 日本語 \U0001f389", "<s>hi</s> <0x0A> <unk>", "a　b\xa0c﻿",
    "word " * 30_000, "x" * 5000, "日本" * 2000, " " * 4000, "\n" * 300, "é ​ tab\tend\r\n",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected(library, text):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode() if ids else b"").hexdigest()


def test_query_agrees_with_the_library_on_whole_texts(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_sentence_pieces(spark, SMALL).collect()}
    assert got == {i: expected(library, t) for i, t in texts.items()}


def test_awkward_texts_repeated_rows_and_clashing_columns(spark, library):
    rows = [(i, t, "x", 1, 2, "y") for i, t in enumerate(AWKWARD)] + [(4, "a", "x", 1, 2, "y"), (None, "nobody's", "x", 1, 2, "y")]
    got = sentence_pieces.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), MODEL).collect()
    want = sorted((-1 if r[0] is None else r[0], library.encode(r[1] or ""), library.decode(library.encode(r[1])) if r[1] else "") for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids), r.decoded) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_random_mixtures(library):
    rng = random.Random(5)
    letters = [" ", " ", "\n", "▁", "a", "b", "the", "é", "中", "\U0001f600", "\t", "ing", "0", "'", "\x85"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    model, table = sentence_pieces.model_of(MODEL), sentence_pieces.chunk_table(MODEL)
    assert model.apart
    for a, b, ids, n in sentence_pieces.ids_by_text(model, table, texts):
        parts = np.split(ids, np.cumsum(n)[:-1])
        for t, x in zip(texts[a:b], parts, strict=True):
            assert x.tolist() == library.encode(t)
            assert model.decode(x).decode() == (library.decode(x.tolist()) if len(x) else "")


def test_whole_texts_where_pieces_may_cross(library):
    model, table = sentence_pieces.Model(MODEL), sentence_pieces.chunk_table(MODEL)
    model.apart = False
    table.clear()
    texts = ["a b\nc", "", "  x "]
    ((_, _, ids, n),) = sentence_pieces.ids_by_text(model, table, texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t) for t in texts]
    assert table.rows == 2
    table.clear()


def test_decode_of_given_ids_and_empty_table(spark, library):
    rows = [(1, [5, 300, 29871, 29871, 13]), (2, None), (3, []), (4, [0, 1, 2, 450]), (5, [29871]), (6, [259, 450])]
    got = {r.doc_id: r.text for r in sentence_pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), MODEL).collect()}
    assert {i: t for i, t in got.items() if i != 4} == {i: library.decode(x) if x else "" for i, x in rows if i != 4}
    assert sentence_pieces.encode(spark.createDataFrame([], SCHEMA), MODEL).collect() == []
