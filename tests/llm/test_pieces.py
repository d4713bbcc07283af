import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from scorewright.llm import pieces as op
from scorewright.llm.tokens import tokenizer_path

PATH = tokenizer_path(op.PIECE_BPE)
LIBRARY, OWN = SentencePieceProcessor(model_file=PATH), op.Pieces(PATH)
ODD = ["", " ", "  a  b ", "a\tb\r\nc", "▁x▁▁y", "<s>", "<0x0A>", "</s><unk>", "é", "ﬁ", "漢字かな", "\x00", "﻿", "　", "\xa0", "�", "😀 😀😀", "====" * 80, "a" * 5000, " " * 3000, " " * 15 + "x", "ab" * 2000, "-" * 33, "الله", "é", "1234567"]


def library(text):
    return LIBRARY.encode(text or "", add_bos=True, add_eos=True)


def test_odd_texts():
    for text in [*ODD, None]:
        ids = OWN.encode(text)
        assert ids.tolist() == library(text), text
        assert OWN.decode(ids) == LIBRARY.decode(ids.tolist())
    assert [x.tolist() for x in OWN.encode_many([*ODD, None] * 3)] == [library(t) for t in [*ODD, None] * 3]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(st.one_of(st.sampled_from(" \n\t▁aeinrst=-'.,é漢"), st.characters(exclude_categories=["Cs"])), max_size=30), st.sampled_from(["  ", "    ", "the", "ing", "tion", "<s>", "<0x0A>", "aaaa", "----", "\n\n"])), max_size=12).map("".join))
def test_any_text(text):
    ids = OWN.encode(text)
    assert ids.tolist() == library(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids.tolist())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 259, 264, 28705, 28726]), st.integers(3, 258), st.integers(0, 31999)), max_size=12))
def test_decode_any_ids(ids):
    assert OWN.decode(np.array(ids, np.uint32)) == LIBRARY.decode(ids)


def test_merges_one_by_one_and_in_rounds():
    rnd = random.Random(1)
    words = ["▁" * rnd.randint(0, 3) + "".join(rnd.choice("aeinrsthlo") for _ in range(rnd.randint(1, 300))) for _ in range(200)] + ["▁" * 40]
    for w in words:
        first = OWN.of_char[np.array([ord(c) for c in w])]
        assert OWN._merged(first, np.zeros(len(w), np.int64))[0].tolist() == OWN._one_by_one(first.tolist())


def test_small_cache(monkeypatch):
    monkeypatch.setattr(op, "MAX_WORDS", 5)
    monkeypatch.setattr(op, "BATCH_CHARS", 40)
    own = op.Pieces(PATH)
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (3, 30, 7, 3)] + ["y" * 300 + " z", None, ""]
    for _ in range(2):
        assert [x.tolist() for x in own.encode_many(texts)] == [library(t) for t in texts]


def test_refuses_other_models(tmp_path):
    with pytest.raises(Exception):
        op.Pieces(str(tmp_path / "none.model"))


def test_table(spark):
    texts = [*ODD, None, ODD[2], "word " * 60_000]
    df = spark.createDataFrame([(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int").repartition(5)
    rows = op.sentencepieces(df, PATH).collect()
    want = sorted((tuple(library(t)), LIBRARY.decode(library(t))) for t in texts)
    assert sorted((tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in rows) == want
    assert sum(r.doc_id is None for r in rows) == sum(i % 7 == 0 for i in range(len(texts)))
    assert op.sentencepieces(df.limit(0), PATH).count() == 0


def test_query(spark, sf):
    df = op.op12_sentencepiece(spark, sf)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = library(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in df.collect()} == want
