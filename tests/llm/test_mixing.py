import re
from collections import Counter

from pyspark.sql import functions as F

from scorewright.llm import common, mixing


def brute_targets(sizes):
    """Targets by repeated resharing: {source: target}."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    capped = set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        out = {s: (3 * sizes[s] if s in capped else level * weight[s]) for s in names}
        above = {s for s in free if out[s] > 3 * sizes[s]}
        if not above:
            return out
        capped |= above


def check(rows, docs):
    sizes = {}
    for d, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    goals = brute_targets(sizes)
    taken = {}
    source_of = {d: s for d, _, s in docs}
    assert len(rows) == len(docs)
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s]
        assert abs(r.target - goals[s]) < 1e-6 * max(1, goals[s])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s, g in goals.items():
        assert abs(taken.get(s, 0) - g) <= 0.5 + 1e-6, (s, taken.get(s), g)


def test_mix_meets_targets_and_repeats(spark):
    docs = [(i, " ".join(["w"] * (i % 97)), ["hot", "a", "b", "c", None, ""][0 if i % 3 else i % 6]) for i in range(600)]
    docs += [(1000, None, "a"), (1001, "  \n ", "empty"), (1002, "x " * 30000, "long")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("row", F.lit(1))
    slots, out = mixing.mix(df, block_words=32, shard_slots=64)
    rows = out.collect()
    check(rows, docs)
    again = {(r.doc_id, r.taken) for r in mixing.mix(df, block_words=32, shard_slots=64)[1].collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    placed = slots.collect()
    assert len({(r.shard, r.slot) for r in placed}) == len(placed)
    assert max(r.slot for r in placed) < 64
    assert sum(r.words for r in placed) == sum(r.taken for r in rows)


def test_query_on_the_test_table(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(mixing.op9_mix_sources(spark, sf).collect(), docs)


def test_mix_of_nothing(spark):
    slots, out = mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert slots.count() == 0 and out.count() == 0
    slots, out = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "x")], "doc_id long, text string, source string"))
    assert [(r.taken, r.target) for r in out.collect()] == [(0, 0.0), (0, 0.0)]


def test_permutation_is_a_bijection(spark):
    permuted = lambda k, n, key: mixing._permuted(k, n, *mixing._rectangle(n), key)
    orders = {}
    for n in (1, 2, 3, 7, 50, 1000, 4096, 5003):
        for key in (3, 4):
            got = [r.p for r in spark.range(n).coalesce(1).select("id", permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key)).alias("p")).orderBy("id").collect()]
            assert sorted(got) == list(range(n))
            orders[n, key] = got
        if n >= 50:
            steps = [b - a for a, b in zip(got, got[1:])]
            assert len(set(steps)) > n // 3 and orders[n, 3] != orders[n, 4]  # no arithmetic progression
            assert abs(sum((i - n / 2) * (x - n / 2) for i, x in enumerate(got))) < 0.5 * n**3 / 12  # nor nearly sorted
    big = 20_000_000_000
    far = [r.p for r in spark.range(0, big, big // 1000).select(permuted(F.col("id"), F.lit(big).cast("long"), F.lit(1)).alias("p")).collect()]
    assert len(set(far)) == len(far) and 0 <= min(far) and max(far) < big


def test_taken_word_by_word(spark):
    B = 16
    docs = [(i, " ".join(["w"] * (i * 7 % 61)), "abc"[i % 3]) for i in range(150)] + [(500, "x " * 40, "a")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    scratch = common.Scratch(spark, "t")
    slots, out = mixing.mix(df, block_words=B, shard_slots=8)
    uses = Counter()
    for r in slots.collect():
        for w in range(r.words):
            uses[r.source, r.block * B + w] += 1
    placed, _ = mixing.streams(df.select("doc_id", "text", "source"), scratch)
    want, covered = [], Counter()
    for r in placed.collect():
        want.append((r.doc_id, r["size"], sum(uses[r.source, w] for w in range(r.start, r.start + r["size"]))))
        for w in range(r.start, r.start + r["size"]):
            covered[r.source, w] += 1
    assert set(covered.values()) == {1} and len(covered) == sum(len(t.split()) for _, t, _ in docs)  # the stream has each word once
    assert sorted((r.doc_id, r["size"], r.taken) for r in out.collect()) == sorted(want)


def test_layout_does_not_matter(spark, monkeypatch):
    docs = [(i, " ".join(["w"] * (i % 301)), ["hot", "b", None][min(i % 5, 2)]) for i in range(700)] + [(9, "same row", "b")] * 30
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = None
    for parts, chunk in ((1, 4096), (7, 4096), (50, 8)):
        monkeypatch.setattr(mixing, "CHUNK", chunk)
        rows = sorted((r.doc_id, r["size"], r.taken) for r in mixing.mix(df.repartition(parts), block_words=32, shard_slots=64)[1].collect())
        want = want or rows
        assert rows == want
    assert len(want) == 730


def test_stage_repeats_whole_rows(spark):
    docs = [(i, "w " * 50, "s%d" % (i % 4), i) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, times long").withColumns({"_copy": F.lit(1), "mixed_id": F.lit("m"), "record": F.lit(0), "_mixed_id": F.lit(7)})
    out = mixing.mix_stage(spark, df, "")
    assert out.columns == df.columns and out.distinct().exceptAll(df).count() == 0
    n = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    goals = brute_targets({f"s{i}": 5000 for i in range(4)})
    for s, g in goals.items():
        assert abs(n.get(s, 0) - g / 50) <= 15
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
