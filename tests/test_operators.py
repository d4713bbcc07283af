import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewright.functions.special import t_two_sided
from scorewright.operators import components, information, moments, nominal, numeric, profiles, quantiles, regression, rows, sampling, stepwise, voting
from scorewright.plans.config import LABEL, Roles


def frame(spark, n=400, seed=1):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=n), r.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": a + 0.1 * r.normal(size=n), "k": 3.0, "t": np.round(a, 1), "w": r.integers(1, 5, n).astype(float)})
    pdf["y"] = (r.random(n) < 1 / (1 + np.exp(-(0.3 + 1.2 * a - 0.7 * b)))).astype(int)
    pdf["z"] = 2 * a - b + r.normal(size=n)
    pdf.loc[::11, "b"] = np.nan
    return pdf, rows_of(spark, pdf)


def rows_of(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).repartition(5)


def test_exclude_keeps_unknown(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 0)], "i int, x int")
    assert sorted(r.i for r in rows.exclude(df, "x > 3").collect()) == [2, 3]
    assert rows.exclude(df, " ").count() == 3 and rows.exclude(df, F.col("x") == 0).count() == 2


def test_roles(spark):
    df = spark.createDataFrame([(1, 0, 1.5, "x", True), (2, 1, 2.5, "y", False), (3, None, 3.5, None, True)], "id int, two int, many double, s string, flag boolean")
    r = rows.auto_roles(df, "target", "id")
    assert (r.bin_vars, r.cont_vars, r.nom_vars, r.ord_vars) == (("two", "flag"), ("many",), ("s",), ())
    assert Roles(bin_vars=("a",), nom_vars=("a", "b"), cont_vars=("b",)).exclusive().nom_vars == ("a",)


def test_work_file_without_label(spark):
    assert rows.work_file(spark.range(3)).count() == 3
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], f"{LABEL} int")
    assert rows.work_file(df).count() == 3


def test_exact_sample_sizes(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    assert sampling.take(df, ["id"], 137, 3).count() == 137
    assert {r.id for r in sampling.take(df.repartition(7), ["id"], 137, 3).collect()} == {r.id for r in sampling.take(df, ["id"], 137, 3).collect()}
    up = sampling.top_up(df, ["id"], 1500, 3)
    assert up.count() == 1500 and up.where(f"{sampling.COPY} = 0").count() == 1000
    out = sampling.resample(df, ["id"], "y", 800, 0.25, 150, 3)
    assert sorted((r.y, r["count"]) for r in out.groupBy("y").count().collect()) == [(0, 600), (1, 200)]
    assert sampling.target_sizes(100, 0.1, 50) == (50, 450) and sampling.bootstrap_size(1000, 0.1, 0.2, 50) == 500
    assert sampling.top_up(df.limit(0), ["id"], 5, 1).count() == 0


@pytest.mark.parametrize("n", [1, 3, 7, 11, 250])
def test_quantiles_match_pandas(spark, n):
    r = random.Random(n)
    pdf = pd.DataFrame({"u": [float(r.randrange(40)) for _ in range(n)], "v": [r.gauss(0, 1e6) for _ in range(n)]})
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    for method in ("nearest", "linear"):
        for row in quantiles.quantiles(rows_of(spark, pdf), ["u", "v"], probs, method).collect():
            want = pdf[row.variable].quantile(probs, interpolation=method).tolist()
            assert [row[f"q{i}"] for i in range(5)] == pytest.approx(want, rel=1e-12)


def test_equal_frequency_bins_match_pandas(spark):
    pdf = pd.DataFrame({"x": [1, 1, 1, 1, 2, 3, 4, 5, 6, 7.0]})
    edges = quantiles.quantile_edges(rows_of(spark, pdf), ["x"], 5)["x"]
    got = sorted(r.b for r in rows_of(spark, pdf).select(quantiles.edges_bin(F.col("x"), edges).alias("b")).collect())
    assert got == sorted((pd.qcut(pdf.x, 5, labels=False, duplicates="drop") + 1).tolist())


def tie(i):
    return int(hashlib.md5(f"0-{i}".encode()).hexdigest()[:8], 16)


def test_rank_bins(spark):
    pdf, df = frame(spark)
    pdf["tie"] = pdf.id.map(tie)
    for col in ("a", "t"):
        got = {r.id: r.bin for r in quantiles.rank_bins(df, col, ["id"], 10).collect()}
        order = pdf.sort_values([col, "tie", "id"]).id.tolist()
        assert got == {i: (k + 1) * 10 // (len(pdf) + 1) for k, i in enumerate(order)}
    got = {r.id: r.bin for r in quantiles.rank_bins(df, "b", ["id"], 10, weight="w").collect()}
    some = pdf[pdf.b.notna()].sort_values(["b", "tie", "id"])
    want = np.floor(some.w.cumsum() * 10 / (some.w.sum() + 1)).astype(int)
    assert {i: got[i] for i in some.id} == dict(zip(some.id, want)) and all(got[i] is None for i in pdf.id[pdf.b.isna()])


def test_rank_bins_of_hot_values_and_an_outlier(spark, monkeypatch):
    """90 % of the rows share a value, one lies far out: bins are right, and no task orders more than a range's rows."""
    monkeypatch.setattr(quantiles, "ROWS_A_RANGE", 200)
    n = 4000
    pdf = pd.DataFrame({"id": np.arange(n), "x": [0.0 if i % 10 else float(i) for i in range(n)], "y": [i % 3 % 2 for i in range(n)]})
    pdf.loc[7, "x"] = 1e15
    df = rows_of(spark, pdf)
    pdf["tie"] = pdf.id.map(tie)
    order = pdf.sort_values(["x", "tie", "id"])
    want = dict(zip(order.id, ((np.arange(n) + 1) * 10 // (n + 1)).tolist()))
    assert {r.id: r.bin for r in quantiles.rank_bins(df, "x", ["id"], 10).collect()} == want
    table = {int(r.bin): r for r in information.bin_table(df, "x", "y", ["id"], 10).collect()}
    g = pdf.assign(bin=pdf.id.map(want)).groupby("bin")
    for b, part in g:
        r = table[b]
        assert (r.cnt, r.sum_dv, r.min_var, r.max_var) == (len(part), part.y.sum(), part.x.min(), part.x.max()) and r.mean_dv == pytest.approx(part.y.mean()) and r.mean_var == pytest.approx(part.x.mean())


@pytest.mark.parametrize("settings", [{}, {"ACCURACY": 20, "FINAL_ROWS": 60, "SPLITS": 4}, {"ACCURACY": 50, "FINAL_ROWS": 3, "SPLITS": 3, "TOGETHER": 2}])
def test_crossings_by_narrowing(spark, monkeypatch, settings):
    """Exact whatever the sketch gives: ties, outliers, infinities, missing values, thresholds at both ends."""
    for k, v in settings.items():
        monkeypatch.setattr(quantiles, k, v)
    r, n = random.Random(5), 1500
    pdf = pd.DataFrame({
        "u": [r.gauss(0, 1) for _ in range(n)], "t": [float(r.choice([0, 0, 0, 0, 1, 2, 2.5])) for _ in range(n)], "c": [7.0] * n,
        "o": [r.choice([1e300, -1e300, float("inf"), float("-inf"), r.random()]) for _ in range(n)], "m": [None if r.random() < 0.9 else float(r.randrange(9)) for _ in range(n)],
        "z": [None] * n, "w": [r.choice([0.25, 1.0, 4.0, 16.5]) for _ in range(n)],
    })
    df = rows_of(spark, pdf.astype({"z": "float64"})).repartition(5)
    names, shares = ["u", "t", "c", "o", "m", "z"], [0.0, 0.004, 0.31, 0.5, 0.97, 1.0]
    for weight in (None, "w"):
        goals = lambda total, _: [max(q * total, 1e-3) for q in shares] + [total + 5]
        found = quantiles.crossings(df, names, shares, goals, weight)
        assert set(found) == set(names) - {"z"}
        for c, s in found.items():
            part = pdf[pdf[c].notna()].sort_values(c)
            w = part.w if weight else pd.Series(1.0, part.index)
            by = w.groupby(part[c]).agg(["sum", "size"]).sort_index()
            upto = by["sum"].cumsum()
            assert (s.rows, s.total) == (len(part), pytest.approx(w.sum()))
            for t in goals(s.total, 0)[:-1]:
                x = upto.index[min(int(np.searchsorted(upto.to_numpy(), t, "left")), len(upto) - 1)]
                got = s.at[t]
                assert (got.value, got.rows) == (x, by["size"][x]) and got.weight == pytest.approx(by["sum"][x]) and got.before == pytest.approx(upto[x] - by["sum"][x])
            assert s.total + 5 not in s.at


def test_quantiles_shuffle_few_values(spark, monkeypatch):
    """Of 30,000 distinct values only those inside the brackets leave a scan."""
    monkeypatch.setattr(quantiles, "ACCURACY", 1000)
    seen, cells = [], quantiles._cells
    monkeypatch.setattr(quantiles, "_cells", lambda *a: (lambda made: (seen.append(made.count()), made)[1])(cells(*a)))
    df = spark.range(30_000).select((F.col("id") * F.lit(1.5)).alias("x"))
    row = quantiles.quantiles(df, ["x"], [0.1, 0.5, 0.9]).first()
    assert [row.q0, row.q1, row.q2] == [1.5 * round(q * 29_999) for q in (0.1, 0.5, 0.9)]
    assert len(seen) == 1 and seen[0] < 1000


def test_weighted_quantiles(spark):
    pdf, df = frame(spark)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = quantiles.weighted_quantiles(df, "b", "w", probs)
    some = pdf[pdf.b.notna()].sort_values("b")
    assert got == pytest.approx(np.interp(np.array(probs) * some.w.sum(), some.w.cumsum(), some.b).tolist())
    assert quantiles.weighted_quantiles(df.limit(0), "b", "w", [0.5]) == [None]


def test_width_bins(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (4.9,), (5.0,), (10.0,), (50.0,)], "x double")
    assert [r.b for r in df.select(quantiles.width_bin(F.col("x"), 0, 10, 4).alias("b")).collect()] == [None, 1, 1, 2, 3, 4, 4]


def test_missing_levels_have_a_row(spark):
    df = spark.createDataFrame([(1, 1), (None, 0), (1, 0), (None, 1)], "x int, y int")
    got = {r.lo: (r.xcount, r.xmean) for r in profiles.profile_levels(df, "x", "y").collect()}
    assert got == {1.0: (2, 0.5), None: (2, 0.5)}
    t = {r.variable: r for r in profiles.column_facts(df, ["x", "y"]).collect()}
    assert (t["x"].miss_cnt, t["x"].uniq_cnt, t["x"].max_cnt) == (2, 2, 2)
    assert profiles.varying_target(df.withColumn("c", F.when(F.col("y") == 1, 1)), ["x", "c"], "y") == {"x": True, "c": False}


def test_nominal_by_count():
    levels = [("a", 5, 0.1, 0.1), ("b", 40, 0.2, 0.1), ("c", 3, 0.3, 0.1), ("d", 45, 0.4, 0.1), ("e", 7, 0.9, 0.1)]
    groups = [[x[0] for x in g] for g in nominal.by_count(levels, 100, 10)]
    assert groups == [["a", "b"], ["c", "d"], ["e"]] or groups == [["a", "b"], ["c", "d", "e"]]
    # e comes when 93 of 100 rows are past, more than 100 - 10.
    assert groups[-1][-1] == "e" and len(groups) == 2


def test_nominal_t_test_uses_the_first_level():
    far = [[("a", 100, 0.1, 0.09)], [("b", 100, 0.9, 0.09), ("c", 1000, 0.1, 0.09)]]
    assert nominal.by_t_test(far, 0.05) == [["a"], ["b", "c"]]
    near = [[("a", 100, 0.50, 0.25)], [("b", 100, 0.52, 0.25)]]
    assert nominal.by_t_test(near, 0.05) == [["a", "b"]]
    assert nominal.by_t_test([[("a", 1, 0.5, None)], [("b", 1, 0.9, None)]], 0.05) == [["a", "b"]]


def test_nominal_scores(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", 0), (None, 1)] * 50, "v string, y int")
    n, mean = profiles.overall(df, "y")
    made = nominal.collapse(profiles.level_stats(df, "v", "y"), n, mean, minbinnp=0.01)
    assert made.groups == [["b"], ["a"], [None]]
    got = {r.v: r.s for r in df.select("v", made.score("v").alias("s")).distinct().collect()}
    assert got == {"b": 0.0, "a": pytest.approx(0.5 / 0.6 * 100), None: pytest.approx(100 / 0.6)}
    new = spark.createDataFrame([("zz",)], "v string").select(made.score("v").alias("s"), *made.flags("v")).first()
    assert list(new) == [0.0, 0, 0, 0]


def newton(x, y, w):
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(2)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-z @ b))
        h = (z * (w * mu * (1 - mu))[:, None]).T @ z
        b = b + np.linalg.solve(h, z.T @ (w * (y - mu)))
    like = (w * (y * np.log(mu) + (1 - y) * np.log(1 - mu))).sum()
    p = np.average(y, weights=w)
    null = w.sum() * (p * math.log(p) + (1 - p) * math.log(1 - p))
    return b, math.erfc(abs(b[1]) / math.sqrt(np.linalg.inv(h)[1, 1]) / math.sqrt(2)), 2 * (like - null), 1 - like / null


@pytest.mark.parametrize("weight", [None, "w"])
def test_logistic_fits(spark, weight):
    pdf, df = frame(spark)
    fits = regression.univariate(df, ["a", "b", "k"], "y", True, weight)
    for v in ("a", "b"):
        some = pdf[pdf[v].notna()]
        b, p, stat, r2 = newton(some[v].to_numpy(), some.y.to_numpy(), some.w.to_numpy() if weight else np.ones(len(some)))
        f = fits[v]
        assert (f.intercept, f.slope, f.p, f.stat, f.r2) == pytest.approx((b[0], b[1], p, stat, r2), rel=1e-6)
    assert math.isnan(fits["k"].p) and fits["k"].sign is None


def test_separation_gives_no_fit(spark):
    df = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, y int")
    assert math.isnan(regression.univariate(df, ["x"], "y", True)["x"].p)


def test_linear_fits(spark):
    pdf, df = frame(spark)
    for weight in (None, "w"):
        f = regression.univariate(df, ["b"], "z", False, weight)["b"]
        some = pdf[pdf.b.notna()]
        w = some.w.to_numpy() if weight else np.ones(len(some))
        x = np.column_stack([np.ones(len(some)), some.b])
        inv = np.linalg.inv((x * w[:, None]).T @ x)
        b = inv @ (x.T @ (w * some.z))
        left = (w * (some.z - x @ b) ** 2).sum()
        t = b[1] / math.sqrt(left / (len(some) - 2) * inv[1, 1])
        my = np.average(some.z, weights=w)
        assert (f.slope, f.p, f.stat, f.r2) == pytest.approx((b[1], t_two_sided(t, len(some) - 2), t * t, 1 - left / (w * (some.z - my) ** 2).sum()), rel=1e-8)


def test_correlations(spark):
    pdf, df = frame(spark)
    got = moments.pairwise(df, ["a", "b", "c", "k"]).correlation()
    want = pdf[["a", "b", "c", "k"]].corr().to_numpy()
    assert np.allclose(got[:3, :3], want[:3, :3]) and np.isnan(got[3]).all()
    with_y = moments.correlation_with(df, ["a", "b", "k"], "y")
    assert with_y["b"] == pytest.approx(abs(pdf.b.corr(pdf.y))) and with_y["k"] is None
    g = moments.gram(df, ["a", "b"], "w")
    some = pdf.dropna(subset=["a", "b"])
    cov = np.cov(some[["a", "b"]].T, aweights=some.w, ddof=0)
    assert np.allclose(g.products / g.weight, cov) and g.rows == len(some)


def test_component_correlation_identity(spark):
    pdf, df = frame(spark)
    names = ["a", "b", "c", "z"]
    x = pdf[names].dropna()
    got = components.best_component_correlation(moments.gram(df, names).correlation(), 2)
    zed = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    values, vectors = np.linalg.eigh(np.corrcoef(zed.T))
    scores = zed @ vectors[:, np.argsort(values)[::-1][:2]]
    want = [max(abs(np.corrcoef(scores[:, j], zed[:, i])[0, 1]) for j in range(2)) for i in range(4)]
    assert np.allclose(got, want)


def test_clusters_separate_blocks_whatever_the_order():
    r = np.random.default_rng(0)
    f = r.normal(size=(500, 3))
    x = np.repeat(f, 3, axis=1) + 0.4 * r.normal(size=(500, 9))
    for order in (np.arange(9), r.permutation(9)):
        out = components.cluster(np.corrcoef(x[:, order].T), 10)
        groups = {}
        for v, c, ratio in out:
            groups.setdefault(c, set()).add(int(order[v]) // 3)
            assert ratio < 0.5
        assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,)]
    assert components.cluster(np.zeros((0, 0)), 3) == [] and components.cluster(np.eye(1), 3) == [(0, 1, 1.0 - 1.0)]


def test_forward_linear_matches_refits(spark):
    pdf, df = frame(spark)
    names = ["a", "b", "c", "k"]
    some = pdf.dropna(subset=[*names, "z"])
    got = stepwise.stepwise_linear(df, names, "z", 0.05)
    chosen = []
    for v, step, p in got:
        best = {}
        for c in names:
            if c in chosen or c == "k":
                continue
            x = np.column_stack([np.ones(len(some)), some[[*chosen, c]]])
            inv = np.linalg.inv(x.T @ x)
            b = inv @ x.T @ some.z
            dof = len(some) - x.shape[1]
            best[c] = t_two_sided(b[-1] / math.sqrt(((some.z - x @ b) ** 2).sum() / dof * inv[-1, -1]), dof)
        assert v == min(best, key=best.get) and p == pytest.approx(best[v], rel=1e-6)
        chosen.append(v)
    assert [s for _, s, _ in got] == list(range(1, len(got) + 1)) and len(got) >= 2
    assert stepwise.stepwise_linear(df, [], "z", 0.05) == [] and stepwise.stepwise_linear(df, ["k"], "z", 0.05) == []


def score_p(some, inside, candidate, w):
    """p of Rao's score test for one more variable, by a refit of the base model."""
    z = np.column_stack([np.ones(len(some)), *[some[c] for c in inside]])
    y, b = some.y.to_numpy(), np.zeros(len(inside) + 1)
    for _ in range(60):
        mu = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (w * mu * (1 - mu))[:, None]).T @ z, z.T @ (w * (y - mu)))
    mu = 1 / (1 + np.exp(-z @ b))
    full = np.column_stack([z, some[candidate]])
    u, h = full.T @ (w * (y - mu)), (full * (w * mu * (1 - mu))[:, None]).T @ full
    return math.erfc(math.sqrt(u @ np.linalg.solve(h, u) / 2))


def test_forward_logistic(spark):
    pdf, df = frame(spark)
    some = pdf.dropna(subset=["a", "b"])
    got = stepwise.stepwise_logistic(df, ["a", "b", "k"], "y", 0.05)
    assert [v for v, _, _ in got] == ["a", "b"]
    r2 = some.a.corr(some.y) ** 2
    assert got[0][2] == pytest.approx(math.erfc(math.sqrt(len(some) * r2 / 2)), rel=1e-6)  # n r squared
    for weight in (None, "w"):
        w = some.w.to_numpy() if weight else np.ones(len(some))
        got, inside = stepwise.stepwise_logistic(df, ["a", "b", "t", "k"], "y", 0.9, weight), []
        for v, _, p in got:
            best = {c: score_p(some, inside, c, w) for c in ("a", "b", "t") if c not in inside}
            assert v == min(best, key=best.get) and p == pytest.approx(best[v], rel=1e-6)
            inside.append(v)
        assert len(inside) >= 2
    by_lr = stepwise.stepwise_logistic(df, ["a", "b", "k"], "y", 0.05, likelihood_ratio=True)
    assert [v for v, _, _ in by_lr] == ["a", "b"]
    assert stepwise.stepwise_logistic(df, ["k"], "y", 0.05) == []


def brute_iv(pdf, var, dep, decile):
    d = pdf[[var, dep, "id"]].dropna().sort_values([var, "id"])
    d = d.assign(bin=[(k + 1) * decile // (len(d) + 1) for k in range(len(d))] if d[var].nunique() > decile else d[var])
    g = d.groupby("bin")[dep].agg(["mean", "size"])
    resp, n = (g["mean"] * g["size"]).sum(), g["size"].sum()
    br, gr = g["mean"] * g["size"] / resp, (g["size"] - g["mean"] * g["size"]) / (n - resp)
    iv = gini = ks = cb = cg = cf = 0.0
    for i, (b, q, s) in enumerate(zip(br, gr, g["size"])):
        iv += 0.0 if b + q == 0 else s * max(b, q) if b * q == 0 else (b - q) * math.log(max(b / q, 1e-5))
        pb, pf, cb, cg, cf = cb, cf, cb + b, cg + q, cf + s / n
        gini += 2 * ((cf + pf) / 2 - (cb + pb) / 2) * (cf - pf) if i else 0
        ks = max(ks, abs(cb - cg))
    return iv, gini, ks


def test_information(spark):
    pdf, df = frame(spark)
    pdf["few"] = np.clip(np.round(pdf.a), -2, 2)
    df = rows_of(spark, pdf)
    for r in information.information(df, ["a", "b", "few"], "y", ["id"], 10).collect():
        assert (r.infv, r.gini, r.ks) == pytest.approx(brute_iv(pdf, r.variable, "y", 10), rel=1e-9)
    none = information.information(df.withColumn("y", F.lit(0)), ["a"], "y", ["id"], 10).first()
    assert (none.infv, none.gini, none.ks) == (None, None, None)


def strong(corr, limit):
    return [(i, j) for i in range(len(corr)) for j in range(i + 1, len(corr)) if abs(corr[i, j]) > limit]


def test_prune():
    c = np.eye(4)
    c[0, 1] = c[1, 0] = c[0, 2] = c[2, 0] = 0.9
    assert voting.prune(list("abcd"), strong(c, 0.7), {"a": 0.1, "b": 0.9, "c": 0.2, "d": 0.3}) == ["b", "c"]
    pair = np.eye(2)
    pair[0, 1] = pair[1, 0] = 0.99
    assert voting.prune(["a", "b"], strong(pair, 0.7), {"a": 0.1, "b": 0.2}) == []  # one partner alone is never pruned


def test_bounds_and_imputation():
    assert numeric.bounds(0, 1, 10, 20, 30, 1000) == (0, 35.0)
    assert numeric.bounds(3, 5, 5, 5, 5, 9) == (3, 9)
    s = numeric.Numeric("v", 100, 600, 0, 40, 12, 1, 10, 15, 20, 30, 0.5)
    s.lb, s.ub = 0, 35
    assert [numeric.default_impute(s, m) for m in ("std", "MAD", "range", "midrange", "maxabs", "ER")] == [12, 15, 0, 20, 0.0, None]
    s.fit = regression.Fit("v", p=0.2)
    assert numeric.imputed(s, "mean", 500, True) == 15
    s.fit = regression.Fit("v", p=0.01, intercept=-1, slope=0.1)
    assert numeric.imputed(s, "mean", 500, True) == 12 and numeric.imputed(s, "mean", 601, True) == 15
    assert numeric.imputed(s, "ER", 500, True) == pytest.approx(10.0)
    s.missing_rate = 0.9999999
    assert numeric.imputed(s, "ER", 500, True) == 35
