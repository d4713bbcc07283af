import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import embed_dedup as op


def brute(rows, threshold):
    ids = [i for i, _ in rows]
    x = [None if e is None or not len(e) or any(c is None or not np.isfinite(c) for c in e) or not any(e) else np.array(e, float) for _, e in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]):
                link[i, j] = x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= threshold
    label = list(ids)
    for _ in range(n):
        for i, j in np.argwhere(link):
            label[i] = label[j] = min(label[i], label[j])
    return sorted((ids[i], int(link[i].sum()), label[i]) for i in range(n))


def vectors(seed, n=300, dims=16):
    rng = np.random.default_rng(seed)
    bases = rng.normal(size=(12, dims))
    out = [(i, (bases[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.2, 0.4])).astype(np.float32).tolist()) for i in range(n)]
    out += [(n, None), (n + 1, [0.0] * dims), (n + 2, [float("nan")] * dims), (n + 3, [1.0, None] * (dims // 2)), (n + 4, []), (n + 5, [float("inf")] * dims), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [1e-38] * dims), (n + 9, [1e30] * dims)]
    return out


@pytest.mark.parametrize("tile", [4096, 40])
def test_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(op, "LEAST_BLOCK", tile)
    monkeypatch.setattr(op, "MOST_BLOCK", tile)
    monkeypatch.setattr(op, "STRIP", 32)
    monkeypatch.setattr(op, "CHUNK", 24)
    rows = vectors(tile)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("clash")).withColumn("label", F.lit(1))
    got = op.embedding_dedup(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.9)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_bound_is_rigorous():
    rng = np.random.default_rng(3)
    u, q, s, e = op.quantise(rng.normal(size=(400, 64)))
    cos, approx = u @ u.T, op.products(q, q) * s[:, None] * s
    assert (np.abs(cos - approx) <= e[:, None] + (1 + e[:, None]) * e).all()


def test_wide_vectors_and_mask(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 2500))
    x[25:] = x[:25] + rng.normal(size=(25, 2500)) * 0.45
    u, *code = op.quantise(x)
    strips = list(op.decided(code, code, 0.9))
    sure, maybe = (np.concatenate([s[k] for s in strips]) for k in (1, 2))
    want = u @ u.T >= 0.9
    assert not (sure & ~want).any() and not (want & ~sure & ~maybe).any() and maybe.any() and maybe.mean() < 0.5
    for dense in (0.0, 1.0):
        monkeypatch.setattr(op, "DENSE", dense)
        assert ((sure | op.exact(u, u, maybe, 0.9)) == want).all()


def test_empty_and_repeated(spark):
    assert op.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = op.embedding_dedup(spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted([(5, 2, 2, False), (5, 2, 2, False), (2, 2, 2, True), (None, 0, None, True)], key=repr)


_MEASURE = """
import resource
import numpy as np, pyarrow as pa
from scorewright.llm import embed_dedup as op

rows, cols, dims = {rows}, {cols}, 64
n = rows + cols
rng = np.random.default_rng(1)
base = rng.normal(size=(n // 16, dims))
made = (base[rng.integers(len(base), size=n)] + rng.normal(size=(n, dims)) * 0.1).astype(np.float32)
_, q, s, e = op.quantise(made.astype(np.float64))
raw = [x.tobytes() for x in q]
table = pa.table({{"dims": pa.array(np.full(n, dims, np.int32)), "low": np.zeros(n, np.int64), "high": np.ones(n, np.int64), "rep": np.arange(n), "copies": np.ones(n, np.int64), "block": np.repeat([0, 1], [rows, cols]), "q": pa.array(raw, pa.binary()), "scale": s, "bound": e}})
del made, base, q, s, e, raw
out = op._tile(0.9)(table)
assert out.num_rows > n / 2
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_memory_of_a_tile_does_not_grow_with_its_pairs():
    """Tiles with columns of the largest block: the peak of a whole one (measured apart: below 600 MB) is that of a part of its rows."""
    peaks = []
    for rows in (4096, 12288):
        done = subprocess.run([sys.executable, "-c", _MEASURE.format(rows=rows, cols=op.MOST_BLOCK)], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
        peaks.append(int(done.stdout))
    assert peaks[1] < 600 and peaks[1] - peaks[0] < 60, peaks
