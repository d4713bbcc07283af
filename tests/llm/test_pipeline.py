import os
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_minhash import brute as near_groups
from test_mixing import brute_targets
from test_tokens import check_packing

from scorewright.llm import common, langid, packing


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        held[name] = (docs.collect(), out.collect())
        if name != "pack":
            assert out.columns == columns
        docs = out

    before, after = held["language_id"]
    kept = {r.doc_id for r in after}
    pred = {r.doc_id: r for r in langid.identify(spark.createDataFrame(before)).collect()}
    assert kept == {d for d, r in pred.items() if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE}
    assert len(kept) > 0.9 * len(before)

    before, after = held["exact_dedup"]
    last = {}
    for r in before:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(last.values())

    before, after = held["minhash_near_dedup"]
    groups = near_groups([(r.doc_id, r.text) for r in before], 80)
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in groups})

    before, after = held["mix_sources"]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    goals, got = brute_targets(sizes), Counter()
    for r in after:
        got[r.source] += len(r.text.split())
    assert Counter(r.doc_id for r in after).most_common(1)[0][1] <= 3
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    # Each source's words come near its target: whole documents are rounded up or down, so by the spread of that.
    squares = Counter()
    for r in before:
        squares[r.source] += len(r.text.split()) ** 2
    far = lambda words: [s for s in sizes if abs(words.get(s, 0) - goals[s]) > 2 * squares[s] ** 0.5 + 0.01 * goals[s]]
    assert far(got) == [] and len(far(sizes)) >= 2  # documents handed on as they are would not do

    before, after = held["pack"]
    pieces = packing.pack_documents(spark.createDataFrame(before, docs.sparkSession.read.parquet(f"{sf}/documents.parquet").schema)).collect()
    check_packing(pieces, [(r.doc_id, r.text) for r in before])
    assert sum(r.length for r in after) == sum(r.length for r in pieces)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.agg(F.count("*")).first()[0] > 0
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"]


def test_odd_rows_pass_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _copy long, record string, `key` long, p string, times string, dropped_id long"
    cat = "the cat and the dog and the bird sat on the mat"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, cat, "en", None), (3, cat, "en", None), (None, cat, "en", "b"), (4, "12 !!", None, "b"), (5, "the dog " * 50000, "en", "a"), (6, cat + " now", "en", "a"), (None, cat + " or never then", "en", "a"), (0, "some other words that nobody else has written down here so far", "en", "c")]
    assert zlib.crc32(b"0") % 3 != 1  # so this row is one to learn from
    docs = spark.createDataFrame([(*r, i, "i", 1, "r", 2, "p", "t", 3) for i, r in enumerate(rows)], schema)
    want = {  # (doc_id, text) of the rows each stage leaves, by what it is to do
        "language_id": [(3, rows[2][1]), (3, rows[3][1]), (None, rows[4][1]), (5, rows[6][1]), (6, rows[7][1]), (None, rows[8][1]), (0, rows[9][1])],
        "exact_dedup": [(3, rows[2][1]), (5, rows[6][1]), (6, rows[7][1]), (None, rows[8][1]), (0, rows[9][1])],
        "minhash_near_dedup": [(3, rows[2][1]), (5, rows[6][1]), (None, rows[8][1]), (0, rows[9][1])],
    }
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "").cache()
        got = docs.collect()
        if name != "pack":
            assert docs.columns == before.columns and {tuple(r) for r in got} <= {tuple(r) for r in before.collect()}, name
        if name in want:
            assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want[name], key=repr), name
        elif name == "mix_sources":
            assert Counter((r.doc_id, r.text) for r in got).most_common(1)[0][1] <= 3 and any(r.doc_id == 5 for r in got)
        else:
            assert len({(r.doc_id, r.doc_tokens) for r in got}) == len({(r.doc_id, r.text) for r in before.collect()})
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "").cache()
        assert empty.count() == 0, name


def test_run_leaves_only_its_result(spark, sf):
    root = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, sf).count()
    new = set(os.listdir(root)) - before
    assert len(new) == 1 and [x.split("-", 1)[1] for x in os.listdir(os.path.join(root, new.pop()))] == ["pack"]


class Session:
    """A session as far as a folder is looked for, with settings of its own."""

    def __init__(self, spark, master, settings):
        self.conf, self.sparkContext = self, self
        self._jvm, self._jsc, self.master, self.settings = spark.sparkContext._jvm, spark.sparkContext._jsc, master, settings

    def getConf(self):
        return {}

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def getCheckpointDir(self):
        return self.settings.get("set")


def test_scratch_needs_a_shared_folder(spark):
    cluster = "spark://somewhere:7077"
    with pytest.raises(RuntimeError):
        common.shared_dir(Session(spark, cluster, {}))
    assert common.shared_dir(Session(spark, cluster, {"spark.checkpoint.dir": "/shared/x/"})) == "file:/shared/x"
    assert common.shared_dir(Session(spark, cluster, {"set": "file:/shared/y"})) == "file:/shared/y"
    assert os.path.isdir(common.shared_dir(Session(spark, "local[2]", {})).removeprefix("file:"))
