import zlib

import numpy as np
from pyspark.sql import functions as F

from scorewright.llm import langid as op


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op.op5_language_id(spark, d).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held if r.lang_pred != "und"]) > 0.97
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id][1]))


def brute(model, text):
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    s = " " + " ".join(s.split()) + " "
    u32 = 2**32
    total = model.log_prior.copy()
    code = [0 if c == " " else ord(c) for c in s]
    shift = 32 - (op.BUCKETS.bit_length() - 1)
    for a, b in zip(code, code[1:]):
        h = (((a * 0x9E3779B1) % u32) ^ ((b * 0x85EBCA77) % u32)) * 0xC2B2AE3D % u32 >> shift
        total += model.log_prob[:, h]
    for a, b, c in zip(code, code[1:], code[2:]):
        if b:
            h = (((a * 0x27D4EB2F) % u32) ^ ((b * 0x165667B1) % u32) ^ ((c * 0x9E3779B1) % u32)) * 0x85EBCA6B % u32 >> shift
            total += model.log_prob[:, h]
    return model.languages[int(total.argmax())], 1 / np.exp(total - total.max()).sum()


def rows():
    en, de = "the quick brown fox and then this that", "der schnelle braune fuchs und dann über"
    out = [(i, " ".join([en if i % 2 else de] * (1 + i % 4)), "en" if i % 2 else "de") for i in range(60)]
    return out + [(100, None, "en"), (101, "", "en"), (102, "12 34 !!", "de"), (103, "the", None), (None, "und dann", "xx"), (104, "Über " * 500000, None), (0, "fox", "en")]


def test_against_plain_scoring(spark, monkeypatch):
    monkeypatch.setattr(op, "_BATCH_CHARS", 1000)
    docs = rows()[:65]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = op.fit(df.where("doc_id is not null"))
    texts = [t for _, t, _ in docs if t and any(c.isalpha() for c in t)]
    lang, score = model.predict(texts)
    for t, one, p in zip(texts, lang, score):
        want = brute(model, t)
        assert one == want[0] and abs(p - want[1]) < 1e-9


def test_edges(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("p", F.lit(1))
    got = op.identify(df).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "de"]
    assert by[None].held_out is False and "xx" not in {r.lang_pred for r in got}
    assert {r.lang_pred for r in op.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert op.identify(df.limit(0)).count() == 0
    out = op.language_stage(spark, df, "")
    assert out.columns == df.columns and {100, 101, 102}.isdisjoint({r.doc_id for r in out.collect()})


def test_training_sample_is_bounded(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "concat('word', id) as text", "if(id % 10 = 0, 'a', 'b') as lang")
    model = op.fit(df, train_docs=400)
    assert model.languages == ["a", "b"] and abs(model.log_prior[0] - model.log_prior[1]) < 1e-9


def test_any_number_of_languages(spark):
    """More names than the parameter: the most frequent ones; None: all of them."""
    docs = [(i, f"{'abcdefghijklmnopqrst'[k] * 3}{'uvwxyzabcdefghijklmn'[k] * 2} " * 5, f"l{k:02d}") for k in range(20) for i in range(100 * k, 100 * k + 4 + k)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert op.fit(df, max_languages=3).languages == ["l17", "l18", "l19"]
    whole = op.fit(df, max_languages=None)
    assert whole.languages == [f"l{k:02d}" for k in range(20)]
    lang, _ = whole.predict([t for _, t, _ in docs])
    assert lang == [x for _, _, x in docs]
    got = {r.doc_id: r.lang_pred for r in op.identify(df, max_languages=None).collect()}
    assert got == {i: x for i, _, x in docs}
