import hashlib

from pyspark.sql import functions as F

from scorewright.llm import exact_dedup as op

DOCS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "x" * 200 + "1"), (6, "x" * 200 + "2"), (7, "x" * 200 + "2"), (7, "x" * 200 + "2"), (8, "é"), (9, "ab"), (9, "cd"), (10, "y" * 300000), (11, "y" * 300000)]


def brute(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(t or "", []).append(d)
    return sorted((d, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs)


def test_groups(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("row", F.lit(0))
    rows = op.exact_dedup(df, digest_all=True).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == brute(DOCS)
    assert sum(r.kept for r in rows) == len({t or "" for _, t in DOCS})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_digest_only_where_needed(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    rows = op.exact_dedup(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == [x[:3] for x in brute(DOCS)]
    assert {r.doc_id for r in rows if r.text_sha256 is None} == {8, 9}  # no other text has both length and prefix


def test_empty(spark):
    assert op.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(DOCS)], "doc_id long, text string, other long")
    out = op.dedup_stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted({(max(d for d, u in DOCS if (u or "") == (t or "")), t or "") for _, t in DOCS})


def test_null_ids(spark):
    docs = [(1, "same"), (None, "same"), (None, "none has an id"), (None, "none has an id"), (None, "alone"), (2, "also alone, longer"), (3, ""), (None, None), (4, "same")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    texts = [t or "" for _, t in docs]
    top = {t: max((d for d, u in docs if (u or "") == t and d is not None), default=None) for t in texts}
    want = sorted(((d, top[t or ""], texts.count(t or "")) for d, t in docs), key=repr)
    for digest_all in (True, False):
        rows = op.exact_dedup(df, digest_all=digest_all).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in rows), key=repr) == want
        assert sorted((r.doc_id for r in rows if r.kept), key=repr) == sorted(top.values(), key=repr)
    assert sorted(((r.doc_id, r.text or "") for r in op.dedup_stage(spark, df, "").collect()), key=repr) == sorted(((d, t) for t, d in top.items()), key=repr)
