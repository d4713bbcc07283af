import zlib
from collections import Counter

from scorewright.llm import sharding as op


def check(rows, n, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == n
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and len(by) <= shards


def test_shards(spark):
    docs = [(i, None if i % 50 == 0 else "t" * (i % 300), "shard", i) for i in range(1003)] + [(7, "same", "x", 0)] * 40 + [(None, "", None, 1), (5000, "z" * 200000, "", 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string, slot long")
    for size in (1 << 12, 1 << 30):
        out = op.shuffle_into_shards(df, bucket_bytes=size)
        rows = out.collect()
        check(rows, len(docs), 24)
        assert Counter(tuple(r.record) for r in rows) == Counter(docs)
        again = {(r.shard, r.slot): r.record.doc_id for r in op.shuffle_into_shards(df.repartition(5), bucket_bytes=size).collect()}
        assert again == {(r.shard, r.slot): r.record.doc_id for r in rows}
        order = [r.record.doc_id or 0 for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert order != sorted(order) and sum(a < b for a, b in zip(order, order[1:])) < 0.6 * len(order)
        other = {(r.shard, r.slot): r.record.doc_id for r in op.shuffle_into_shards(df, bucket_bytes=size, seed=1).collect()}
        assert other != again


def test_few_and_none(spark):
    few = spark.createDataFrame([(i, "x") for i in range(5)], "doc_id long, text string")
    check(op.shuffle_into_shards(few).collect(), 5, 24)
    assert op.shuffle_into_shards(few.limit(0)).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op.op7_two_pass_sharding(spark, sf).collect()
    check(rows, len(docs), 24)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
