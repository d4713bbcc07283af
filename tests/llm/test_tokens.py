import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from scorewright.llm import packing, simple8b, token_files, tokens

ODD = ["", " ", "a  b", "a\n b", " \n\nx ", "it's  they're\tI'll", "Ünï ß́ é", "x\xa0y z\x1cw\x85", "<|endoftext|> a<|endoftext|>", "漢字 かな", "a" * 5000, "1234 5,6.7", "\r\n\t", "’s ’ 's'S", "😀 😀😀", " lead", "trail ", "́x", "A­B"]


def direct(name):
    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_chunks_give_the_same_ids(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for name, spaces in ((tokens.BYTE_BPE, True), (tokens.WORD_BPE, False)):
        e, want = tokens.Encoder(tokens.tokenizer_path(name), spaces), direct(name)
        for x in texts:
            assert e.encode(x).tolist() == want(x), (name, x[:80])


_direct = {n: direct(n) for n in (tokens.BYTE_BPE, tokens.WORD_BPE)}
_encoders = {n: tokens.Encoder(tokens.tokenizer_path(n), n == tokens.BYTE_BPE) for n in _direct}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.one_of(st.sampled_from(" \n\t\r'sStreé1,.́\xa0"), st.characters(exclude_categories=["Cs"])), max_size=40), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|END", "<|endoftext", "|>"])), max_size=5).map("".join))
def test_any_text(x):
    for n, e in _encoders.items():
        assert e.encode(x).tolist() == _direct[n](x)


def test_many_at_once():
    texts = ODD + [None] + ["b" * 70 + " c" + "d" * 80 + ", e" + "f" * 90, "x," * 50] * 2
    for n, e in _encoders.items():
        assert [x.tolist() for x in e.encode_many(texts)] == [_direct[n](x) for x in texts]


def test_equal_hashes_of_different_chunks(monkeypatch, sf):
    monkeypatch.setattr(tokens.Encoder, "key_mask", np.uint64(0xFE00000000000000))
    texts = [x for x in ODD if x] + [" ".join(f"{a}{b}" for a in ("alpha", "be", "gamma's", "12") for b in range(60))] * 2
    for n, spaces in ((tokens.BYTE_BPE, True), (tokens.WORD_BPE, False)):
        e = tokens.Encoder(tokens.tokenizer_path(n), spaces)
        for _ in range(2):
            assert [x.tolist() for x in e.encode_many(texts)] == [_direct[n](x) for x in texts]


def test_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CHUNKS", 8)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 40)
    e = tokens.Encoder(tokens.tokenizer_path(tokens.BYTE_BPE), True)
    for x in [" ".join(f"w{i}" for i in range(n)) for n in (3, 30, 7)] + ["y" * 300 + " z"]:
        assert e.encode(x).tolist() == _direct[tokens.BYTE_BPE](x)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 60), st.integers(0, 70000), st.integers(0, 2**60 - 1)), max_size=700), st.integers(1, 4))
def test_simple8b_round_trip(ids, times):
    ids = np.array(ids * times * 5, np.uint64)
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words) == ids).all() and len(simple8b.decode(words)) == len(ids)
    for b in range(len(offsets)):
        assert (simple8b.decode_block(words, offsets, b) == ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def test_simple8b_is_dense():
    words, _ = simple8b.encode(np.random.default_rng(0).integers(0, 2**15, 100_000))
    assert len(words) * 8 < 100_000 * 2.1
    assert len(simple8b.encode(np.zeros(4096, np.uint32))[0]) < 40


DOCS = [(5, "hello world"), (1, None), (3, ""), (2, "x y " * 4000), (None, "none"), (7, "dup"), (7, "dup")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1))


def test_token_files_round_trip(spark, monkeypatch, sf):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for docs in (DOCS, table):
        manifest = token_files.write_token_files(frame(spark, docs))
        got = token_files.read_token_files(manifest).collect()
        at, want = 0, []
        for d, x in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = np.array([*_direct[tokens.BYTE_BPE](x), 0], "<u4")
            want.append((d, at, len(ids), ids.tobytes()))
            at += len(ids)
        assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got), key=lambda r: r[1]) == want
    got = token_files.op3_simple8b_token_files(spark, sf).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == {d: (s, n, zlib.crc32(raw)) for d, s, n, raw in want}


def test_token_files_of_nothing(spark):
    assert token_files.read_token_files(token_files.write_token_files(frame(spark, []))).count() == 0


def check_packing(rows, docs):
    want, parts, sequences, padded = {}, {}, {}, {}
    for d, x in docs:
        want.setdefault(d, []).append(np.array([*_direct[tokens.WORD_BPE](x), 1], "<u4"))
    for r in rows:
        assert r.length > 0
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
        padded.setdefault(r.sequence_id, set()).add(r.padded)
    for d, many in want.items():
        raw = b"".join(x.tobytes() for x in many)
        assert sorted(b"".join(p for _, p in sorted(parts[d]))) == sorted(raw)
        if len(many) == 1:
            at = 0
            for start, p in sorted(parts[d]):
                assert start == at
                at += len(p) // 4
            assert b"".join(p for _, p in sorted(parts[d])) == raw
    for k, s in sequences.items():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048 and padded[k] == {at if bin(at).count("1") == 1 else 2048}
    return sum(n for s in sequences.values() for _, n in s) / (2048 * len(sequences)) if sequences else 1.0


def test_packing(spark, sf):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_packing(packing.pack_documents(frame(spark, DOCS)).collect(), DOCS)
    assert packing.pack_documents(frame(spark, [])).count() == 0
    df = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    assert check_packing(packing.pack_documents(df).collect(), table) > 0.99
    out = packing.op8_sum_of_squares_packing(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"]
    # The query against the library itself: every document's ids, cut as the pieces say, have the pieces' checksums.
    ids = {d: np.array([*_direct[tokens.WORD_BPE](x), 1], "<u4") for d, x in table}
    rows, length, filled = out.collect(), Counter(), Counter()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        length[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert length == {d: len(x) for d, x in ids.items()} and max(filled.values()) <= 2048
    assert all(r.padded == (filled[r.sequence_id] if bin(filled[r.sequence_id]).count("1") == 1 else 2048) for r in rows)


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(5)
    p = packing.Packer(40)
    for _ in range(600):
        size = int(rng.integers(1, 40))
        n = p.count.copy()
        costs = {}
        for h in [0, *np.flatnonzero(n[1:40]) + 1]:
            if h + size <= 40:
                m = n.copy()
                m[h] -= h > 0
                if h + size < 40:
                    m[h + size] += 1
                costs[int(h)] = int((m[1:40] ** 2).sum())
        assert costs[p.level(size)] == min(costs.values())
        p.add(("k", 0, np.zeros(size, np.uint32)))


LITERALS = [(1, "one<|endoftext|>two"), (2, "a <|startoftext|> b <|ENDOFTEXT|> <|endoftext|>"), (3, "no <|endoftext |> here"), (4, "x y " * 100_000 + "<|endoftext|> z"), (5, "last")]


def test_literals_of_added_tokens_as_the_library_has_them(spark):
    want = {}
    for name, spaces in ((tokens.BYTE_BPE, True), (tokens.WORD_BPE, False)):
        untouched = Tokenizer.from_file(tokens.tokenizer_path(name))
        want[name] = [untouched.encode(x, add_special_tokens=False).ids for _, x in LITERALS]
        assert [x.tolist() for x in tokens.encoder(tokens.tokenizer_path(name), spaces).encode_many([x for _, x in LITERALS])] == want[name]
    assert want[tokens.BYTE_BPE][0] == [505, 50256, 11545]
    got = token_files.read_token_files(token_files.write_token_files(frame(spark, LITERALS))).collect()
    assert [bytes(r.ids) for r in sorted(got, key=lambda r: r.start)] == [np.array([*x, 0], "<u4").tobytes() for x in want[tokens.BYTE_BPE]]
    parts = {}
    for r in packing.pack_documents(frame(spark, LITERALS)).collect():
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert [b"".join(p for _, p in sorted(parts[d])) for d, _ in LITERALS] == [np.array([*x, 1], "<u4").tobytes() for x in want[tokens.WORD_BPE]]


class Counted:
    """A tokenizer that notes how many texts it is given at once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **kw):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **kw)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


WORDS = ["".join(random.Random(i).choices("abcdeäéßñ", k=3 + i % 9)) + ("" if i % 7 else "'s 3&") for i in range(5000)]


@pytest.mark.parametrize("name, spaces", [(tokens.BYTE_BPE, True), (tokens.WORD_BPE, False)])
def test_new_chunks_go_to_the_library_together(name, spaces):
    encode = tokens.Encoder(tokens.tokenizer_path(name), spaces)
    counted = encode.tokenizer = Counted(encode.tokenizer)
    text = " ".join(WORDS)
    assert encode.encode(text).tolist() == counted.tokenizer.encode(text, add_special_tokens=False).ids
    assert encode.count > 4000 and counted.texts < encode.count / 20


@pytest.mark.parametrize("name, spaces", [(tokens.BYTE_BPE, True), (tokens.WORD_BPE, False)])
@pytest.mark.parametrize("more", [["abc<|startoftext|>", "abc<|endoftext|>"], ["<|startoftext|><", "<|endoftext|>b", "<|startoftext|>b"]])
def test_an_added_token_that_runs_into_the_mark(tmp_path, name, spaces, more):
    made = Tokenizer.from_file(tokens.tokenizer_path(name))
    made.add_special_tokens([AddedToken(x, normalized=False) for x in more])
    made.save(str(tmp_path / "t.json"))
    encode, text = tokens.Encoder(str(tmp_path / "t.json"), spaces), " ".join(["xabc", "b", *WORDS])
    assert encode.mark and encode.encode(text).tolist() == made.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", [{"lstrip": True}, {"rstrip": True}, {"single_word": True}, {"normalized": True}, {"content": "a-a"}])
def test_added_tokens_that_can_not_be_marks(tmp_path, kind):
    part = json.load(open(tokens.tokenizer_path(tokens.BYTE_BPE)))
    part["added_tokens"] = [{**t, **kind} for t in part["added_tokens"]]
    (tmp_path / "t.json").write_text(json.dumps(part))
    encode, text = tokens.Encoder(str(tmp_path / "t.json"), True), " ".join(["a-", "b", *WORDS])
    assert encode.mark is None and encode.encode(text).tolist() == encode.whole(text).tolist()
