"""Hundreds to thousands of variables: correlations by tiles, pruning on a graph, clusters, components, shared likelihood-ratio fits."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewright.operators import components, moments, stepwise, voting
from scorewright.plans import reduce as stage


def table(spark, x, names=None, missing=()):
    names = names or [f"x{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=names)
    for c, rows in missing:
        pdf.loc[rows, c] = np.nan
    df = spark.createDataFrame(pdf).repartition(4)
    return pdf, df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])


@pytest.mark.parametrize("held", [1 << 24, 200])
def test_strong_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(moments, "BLOCK", 4)
    monkeypatch.setattr(moments, "HELD", held)
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 3)) @ r.normal(size=(3, 14)) + 0.7 * r.normal(size=(400, 14)) + 1e6
    x[:, 5] = 3.0
    pdf, df = table(spark, x, missing=[("x2", range(0, 400, 3)), ("x9", range(0, 390)), ("x11", range(0, 399))])
    corr = pdf.corr().to_numpy()
    want = {(i, j): corr[i, j] for i in range(14) for j in range(i + 1, 14) if abs(corr[i, j]) > 0.4}
    got = {(i, j): c for i, j, c in moments.strong_pairs(df, list(pdf.columns), 0.4)}
    assert set(got) == set(want) and len(want) > 10
    assert all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
    assert moments.strong_pairs(df.limit(0), list(pdf.columns), 0.4) == []


def prune_by_rounds(n, pairs, strength):
    """The rule as it is stated: round by round over all that are there."""
    there, dropped = set(range(n)), []
    while True:
        many = [i for i in sorted(there) if sum((i in p) and p[0] in there and p[1] in there for p in pairs) > 1]
        if not many:
            return dropped
        keep = max(many, key=lambda i: (-1.0 if strength[i] is None else strength[i], -i))
        gone = sorted(({a, b} - {keep}).pop() for a, b in pairs if keep in (a, b) and a in there and b in there)
        dropped += gone
        there -= set(gone)


def test_prune_on_random_graphs():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 12)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < 0.3]
        strength = [r.choice([None, 0.1, 0.2, 0.5, r.random()]) for _ in range(n)]
        names = [f"v{i}" for i in range(n)]
        assert voting.prune(names, pairs, dict(zip(names, strength))) == [names[i] for i in prune_by_rounds(n, pairs, strength)]


def test_thousands_of_variables(spark):
    """Groups of alike variables among 700: pairs and drops as planted, most pairs never listed."""
    r = np.random.default_rng(3)
    p, n = 700, 200
    x = r.normal(size=(n, p)).astype(np.float32)
    for g in range(0, 300, 3):
        x[:, g + 1 : g + 3] = x[:, [g]] + 0.05 * r.normal(size=(n, 2))
    rows = spark.createDataFrame([(row.tolist(),) for row in x.astype(float)], "a array<double>").repartition(2)
    names = [f"x{i}" for i in range(p)]
    df = rows.select(*[F.col("a")[i].alias(c) for i, c in enumerate(names)])
    pairs = [(i, j) for i, j, _ in moments.strong_pairs(df, names, 0.9)]
    assert pairs == sorted((g + i, g + j) for g in range(0, 300, 3) for i, j in ((0, 1), (0, 2), (1, 2)))
    dropped = voting.prune(names, pairs, {c: i / p for i, c in enumerate(names)})
    assert sorted(dropped) == sorted(names[g + k] for g in range(0, 300, 3) for k in (0, 1))


def plain_clusters(corr, most, limit=1.0):
    """Everything again after every move."""
    first = components.first_component

    def fit(i, g):
        load = first(corr[np.ix_(g, g)])
        cov, var = corr[i, g] @ load, load @ corr[np.ix_(g, g)] @ load
        return min(cov * cov / var, 1.0) if var > 0 and corr[i, i] > 0 else 0.0

    groups = [list(range(len(corr)))]
    while len(groups) < most:
        second = [np.linalg.eigvalsh(corr[np.ix_(g, g)])[-2] if len(g) > 1 else -np.inf for g in groups]
        worst = int(np.argmax(second))
        if second[worst] <= limit:
            break
        g = groups.pop(worst)
        plus = first(corr[np.ix_(g, g)]) >= 0
        halves = [v for v, s in zip(g, plus) if s], [v for v, s in zip(g, plus) if not s]
        groups += halves if all(halves) else (g[: len(g) // 2], g[len(g) // 2 :])
        for _ in range(10 * len(corr)):
            move = next(((v, c, k) for c, g in enumerate(groups) for v in g for k in [int(np.argmax([fit(v, h) for h in groups]))] if fit(v, groups[k]) > fit(v, groups[c]) + 1e-12), None)
            if not move:
                break
            v, c, k = move
            groups = [x for x in ([y for y in g if y != v] if i == c else [*g, v] if i == k else g for i, g in enumerate(groups)) if x]
    return [set(g) for g in groups]


def mixed(seed, p, factors, n=400, noise=1.0):
    r = np.random.default_rng(seed)
    return np.corrcoef((r.normal(size=(n, factors)) @ (r.normal(size=(factors, p)) * (r.random((factors, p)) < 0.4)) + noise * r.normal(size=(n, p))).T)


@pytest.mark.parametrize(("seed", "decomposed"), [(0, 40), (1, 40), (2, 3), (3, 3)])
def test_clusters_as_by_working_everything_out_again(monkeypatch, seed, decomposed):
    monkeypatch.setattr(components, "DECOMPOSED", decomposed)
    corr = mixed(seed, 24, 4)
    out = {}
    for v, c, _ in components.cluster(corr, 6):
        out.setdefault(c, set()).add(v)
    assert [out[c] for c in sorted(out)] == plain_clusters(corr, 6)


def test_a_move_works_out_two_clusters(monkeypatch):
    """However many clusters there are: no more than two a move, and two a split."""
    made, moved = [], []
    init, settled = components._Cluster.__init__, components._settled
    monkeypatch.setattr(components._Cluster, "__init__", lambda self, *a: (made.append(1), init(self, *a))[1])
    monkeypatch.setattr(components, "_settled", lambda *a: (moved.append(len(made)), settled(*a))[1])
    out = components.cluster(mixed(9, 150, 12), 12)
    assert sorted(v for v, _, _ in out) == list(range(150)) and len({c for _, c, _ in out}) == 12
    assert len(moved) == 11 and moved[0] == 3


def test_leading_pairs():
    for seed, p, k in ((0, 64, 10), (1, 300, 8), (2, 5, 5), (3, 12, 2)):
        corr = mixed(seed, p, 6)
        values, vectors, error = components.leading_pairs(lambda q, c=corr: c @ q, p, k)
        want, of = np.linalg.eigh(corr)
        assert np.allclose(values, want[::-1][:k], atol=1e-8) and error < 1e-6
        assert np.allclose(np.abs(vectors.T @ of[:, ::-1][:, :k]).max(1), 1, atol=1e-6)


def test_components_without_a_matrix(spark, monkeypatch):
    """64 columns of the embeddings: as by the matrix; weights too; constants count for nothing."""
    monkeypatch.setattr(stage, "MATRIX_VARIABLES", 20)
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    names = [f"e{i}" for i in range(64)]
    df = e.select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)], (F.col("vec_id") % 3 + 1).alias("w"))
    for weight in (None, "w"):
        got = stage.principal(df, names, 13, 0.1, weight)
        want = components.best_component_correlation(moments.gram(df, names, weight).correlation(), 13)
        assert [got[n] for n in names] == pytest.approx(want.tolist(), abs=1e-6)
    some = df.withColumn("e3", F.lit(2.0))
    got = stage.principal(some, names[:30], 6, 0.1)
    assert abs(got["e3"]) < 1e-9 and [got[n] for n in names[:30]] == pytest.approx(components.best_component_correlation(moments.gram(some, names[:30]).correlation(), 6).tolist(), abs=1e-6)
    assert stage.principal(df.limit(0), names, 13, 0.1) == dict.fromkeys(names)


def likelihood(x, y, w):
    z = np.column_stack([np.ones(len(x)), *x.T])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (w * mu * (1 - mu))[:, None]).T @ z, z.T @ (w * (y - mu)))
    return float((w * (y * np.log(mu) + (1 - y) * np.log(1 - mu))).sum())


@pytest.mark.parametrize("weight", [None, "w"])
def test_likelihood_ratio_selection(spark, monkeypatch, weight):
    """Each step against single fits of every candidate; passes do not grow with the candidates."""
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 7))
    x[:, 4] = 0.8 * x[:, 0] + 0.6 * x[:, 4]
    y = (r.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 0.8 * x[:, 2] + 0.3 * x[:, 5])))).astype(float)
    w = r.choice([1.0, 2.0, 3.0], 600)
    names = [f"x{i}" for i in range(7)]
    pdf = pd.DataFrame(np.column_stack([x, y, w]), columns=[*names, "y", "w"])
    df = spark.createDataFrame(pdf).repartition(3)
    used = w if weight else np.ones(600)
    chosen, want = [], []
    while len(chosen) < 7:
        base = likelihood(x[:, chosen], y, used)
        p = {i: math.erfc(math.sqrt(max(likelihood(x[:, [*chosen, i]], y, used) - base, 0))) for i in range(7) if i not in chosen}
        best = min(p, key=p.get)
        if p[best] > 0.2:
            break
        chosen.append(best)
        want.append((names[best], p[best]))
    got = stepwise.stepwise_logistic(df, names, "y", 0.2, weight, likelihood_ratio=True)
    assert [v for v, _, _ in got] == [v for v, _ in want] and len(want) > 2
    assert [p for _, _, p in got] == pytest.approx([p for _, p in want], rel=1e-5)

    passes = []
    summed = stepwise.summed
    monkeypatch.setattr(stepwise, "summed", lambda *a: (passes.append(1), summed(*a))[1])
    counts = []
    for some in (names[:2], names):
        passes.clear()
        stepwise.stepwise_logistic(df, some, "y", 1e-30, weight, likelihood_ratio=True)
        counts.append(len(passes))
    assert counts[1] <= counts[0] + 3
