import json
import math
import random
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_operators import score_p

import scorewright
from scorewright.functions.special import t_two_sided
from scorewright.operators import nominal, stepwise
from scorewright.plans import queries
from scorewright.plans.config import LABEL, RecodeConfig, ReduceConfig, Roles, SampleConfig, roles_from_dict
from scorewright.plans.recode import Recoded, fit_recode, recode
from scorewright.plans.reduce import groups_of, reduce_variables
from scorewright.plans.sample import sample
from scorewright.sources import readers, sinks
from scorewright.streaming import scorer

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def norm(v):
    return None if v is None else float(f"{v:.8g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = queries.Q[name](spark, sf)
    r = con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    mine = sorted((tuple(norm(x[c]) for c in r.columns) for x in df.collect()), key=repr)
    assert mine == sorted((tuple(map(norm, x)) for x in r.fetchall()), key=repr)


def test_queries_without_sql_have_tests_of_their_own():
    assert set(queries.Q) - set(queries.SQL) == {"full_pipeline", "var_clusters"}


def test_component_queries_against_numpy(spark, sf):
    table = queries.model_table(spark, sf).select(*queries.NUMBERS).toPandas().dropna().astype(float)
    values, vectors = np.linalg.eigh(np.corrcoef(table.to_numpy().T))
    top = np.argsort(values)[::-1][:2]
    want = np.abs(vectors[:, top] * np.sqrt(values[top])).max(1)
    assert {r.variable: r.factor for r in queries.Q["pca_screen"](spark, sf).collect()} == pytest.approx(dict(zip(queries.NUMBERS, want)), abs=1e-6)

    e = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float)
    def screen(columns):
        v, w = np.linalg.eigh(np.corrcoef(e[:, columns].T))
        k = np.argsort(v)[::-1][:4]
        return dict(zip(columns, np.abs(w[:, k] * np.sqrt(np.maximum(v[k], 0))).max(1)))
    first = {c: f for g in groups_of(list(range(64)), 4) for c, f in screen(g).items()}  # 64 columns, 5 x 4 a group
    want = screen([c for c in range(64) if first[c] >= 0.2])
    assert {r.variable: r.factor for r in queries.Q["embedding_components"](spark, sf).collect()} == pytest.approx({f"e{c}": f for c, f in want.items()}, abs=1e-6)


def test_selection_queries_against_plain_code(spark, sf):
    table = queries.model_table(spark, sf).select("x2", "x4", "x5", "o1", "y").toPandas().astype(float)
    inside = []
    for r in sorted(queries.Q["stepwise_logistic"](spark, sf).collect(), key=lambda r: r.step):
        best = {c: score_p(table, inside, c, np.ones(len(table))) for c in ("x2", "x4", "x5", "o1") if c not in inside}
        assert best[r.variable] == min(best.values()) and r.p == pytest.approx(best[r.variable], rel=1e-5, abs=1e-300)
        inside.append(r.variable)
    rest = {c: score_p(table, inside, c, np.ones(len(table))) for c in ("x2", "x5", "o1") if c not in inside}
    assert inside and all(p > 0.05 for p in rest.values())
    rows = queries.Q["var_clusters"](spark, sf).collect()
    corr = np.corrcoef(queries.model_table(spark, sf).select(*queries.NUMBERS).toPandas().dropna().astype(float).to_numpy().T)
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster, []).append(queries.NUMBERS.index(r.variable))
    assert sorted(v for g in groups.values() for v in g) == list(range(6))
    part = {}
    for c, g in groups.items():
        v = np.linalg.eigh(corr[np.ix_(g, g)])[1][:, -1]
        part[c] = {i: (corr[i, g] @ v) ** 2 / (v @ corr[np.ix_(g, g)] @ v) for i in range(6)}
    for r in rows:
        i = queries.NUMBERS.index(r.variable)
        nearest = max(f[i] for c, f in part.items() if c != r.cluster)
        assert part[r.cluster][i] >= nearest - 1e-9 and r.ratio == pytest.approx((1 - part[r.cluster][i]) / (1 - nearest), abs=1e-6)


def test_more_than_a_hundred_variables(spark):
    """Selection goes by groups of at most 100; screening by groups, and its survivors once more."""
    r = np.random.default_rng(8)
    n, p = 500, 130
    x = r.normal(size=(n, p))
    x[:, 1::2] = x[:, ::2] + 0.4 * r.normal(size=(n, p // 2))
    y = (x[:, 3] + x[:, 120] + r.normal(size=n) > 0).astype(int)
    names = [f"R1_v{i:03d}" for i in range(p)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(n), y=y))
    config = ReduceConfig(sources=1, logistic_flg=False, cluster_flg=False, information_flg=False, nprin=5, minprin=0.5)
    master = {m.variable: m for m in reduce_variables(df, Roles(id="id", dep_var="y"), config)[0].collect()}
    assert len(master) == p
    shuffled = sorted(names)
    random.Random(config.random_seed).shuffle(shuffled)
    chosen = {}
    for group in groups_of(shuffled, 2):
        assert len(group) <= 100
        cols = [names.index(v) for v in group]
        z, left, base = x[:, cols] - x[:, cols].mean(0), y - y.mean(), np.ones((n, 1))
        inside = []
        while True:
            best = {}
            for i in range(len(cols)):
                if i not in inside:
                    m = np.column_stack([np.ones(n), *[z[:, j] for j in inside], z[:, i]])
                    inv = np.linalg.inv(m.T @ m)
                    b = inv @ m.T @ left
                    dof = n - m.shape[1]
                    best[i] = t_two_sided(b[-1] / math.sqrt(((left - m @ b) ** 2).sum() / dof * inv[-1, -1]), dof)
            i = min(best, key=best.get)
            if best[i] > config.alphareg:
                break
            inside.append(i)
            chosen[group[i]] = (len(inside), best[i])
    assert {v for v, m in master.items() if m.regsource} == set(chosen)
    for v, (step, pvalue) in chosen.items():
        assert master[v].reg_step == step and master[v].reg_pvalue == pytest.approx(pvalue, rel=1e-5)

    def screen(group):
        v, w = np.linalg.eigh(np.corrcoef(x[:, [names.index(g) for g in group]].T))
        k = np.argsort(v)[::-1][:5]
        return dict(zip(group, np.abs(w[:, k] * np.sqrt(np.maximum(v[k], 0))).max(1)))

    first = {c: f for g in groups_of(shuffled, math.ceil(p / 25)) for c, f in screen(g).items()}
    want = screen([c for c in shuffled if first[c] >= 0.5])
    assert {v: m.factor for v, m in master.items() if m.factor is not None} == pytest.approx(want, abs=1e-6)
    assert {v for v, m in master.items() if m.prinsource} == {v for v, f in want.items() if f >= 0.5}


def test_report_tables_and_logs(spark, tmp_path, caplog):
    df, roles = data(spark)
    made = fit_recode(df, roles, RecodeConfig(minbinnp=0.01, concrate=0.999))
    out = made.apply(df, roles)
    made.write_report(out, roles, str(tmp_path / "report"))
    tables = {k: readers.read_csv(spark, f"{tmp_path}/report/{k}") for k in ("binary_variables", "nominal_variables", "ordinal_variables", "continuous_variables", "correlations")}
    assert {k: sorted(r.var_name for r in t.collect()) for k, t in tables.items() if k != "correlations"} == {"binary_variables": ["b"], "nominal_variables": ["n"], "ordinal_variables": ["o"], "continuous_variables": ["c"]}
    corr = {r.variable: r.correlation for r in tables["correlations"].collect()}
    pdf = out.toPandas()
    want = {c: pdf[c].astype(float).corr(pdf.y) if pdf[c].nunique() > 1 else None for c in pdf.columns if c.startswith("R1_")}
    assert set(corr) == set(want) and all(corr[c] == (want[c] and pytest.approx(want[c], abs=1e-9)) for c in want)
    with caplog.at_level("INFO", "scorewright"):
        sample(spark.range(3000).withColumn("y", (F.col("id") % 20 == 0).cast("int")), Roles(id="id", dep_var="y"), SampleConfig(bootstrap=True, min_num_resp=50))
    assert "target values of the resampled rows: {0: " in caplog.text
    with sinks.log_to(str(tmp_path / "x.log"), str(tmp_path / "x.lst")) as log, sinks.printed_to(log):
        print("shown")
        print("warned", file=sys.stderr)
    assert "INFO shown" in (tmp_path / "x.lst").read_text() and "WARNING warned" in (tmp_path / "x.log").read_text()
    text = sinks.write_text(spark, "ünï\n2", f"file://{tmp_path}/a/b.txt")
    assert sinks.read_text(spark, text) == "ünï\n2"
    recodes = made.programs()
    assert sinks.read_recodes(spark, sinks.write_recodes(spark, recodes, f"{tmp_path}/r.json")) == recodes


def test_settings_from_options():
    c = ReduceConfig.from_dict({"fast_opt": "Y", "sources": 5, "binary_dv": "N", "unknown": 1})
    assert c.fast_opt and not c.binary_dv
    n = c.normal()
    assert (n.sources, n.regression_flg, n.logistic_flg, n.univ_reg_flg) == (1, True, False, False)
    assert RecodeConfig.from_dict({"cap_flrO": "Y"}).cap_flrO and SampleConfig.from_dict({"bootstrap": "y"}).bootstrap
    r = roles_from_dict({"id": "i", "dep_var": "y", "bin_vars": ["a"], "nom_vars": ["a", "b"], "weight": ""})
    assert r.weight is None and r.nom_vars == ("b",) or r.bin_vars == ()
    assert scorewright.sample is sample


def test_sample_stage(spark, tmp_path):
    df = spark.range(5000).withColumn("y", (F.col("id") % 20 == 0).cast("int"))
    roles = Roles(id="id", dep_var="y")
    out, rates = sample(df, roles, SampleConfig(exclusion_if="id < 100", bootstrap=True, oversampled_rr=0.2, min_num_resp=50), output=str(tmp_path))
    assert out.columns == ["id", "y", LABEL] and out.where("id < 100").count() == 0
    got = {r.partition: r.rate for r in rates.collect()}
    assert got["Model"] == pytest.approx(0.2, abs=0.05) and got["Test"] == pytest.approx(0.05, abs=0.02) and set(got) == {"Model", "Val", "Test"}
    model = out.where(f"{LABEL} <> 3")
    assert model.where("y = 1").count() / model.count() == pytest.approx(0.2, abs=0.002)
    assert spark.read.parquet(f"{tmp_path}/resampled").count() == out.count()


def data(spark):
    df = spark.range(2400).withColumns({
        "y": F.expr("cast(id % 100 < 30 + (id % 7) * 5 as int)"),
        "b": F.expr("case when id % 3 = 0 then ' Y ' when id % 3 = 1 then 'yes' end"),
        "n": F.expr("case when id % 5 < 4 then concat('l', id % 5) end"),
        "many": F.expr("concat('v', id % 200)"),
        "o": F.expr("cast(id % 7 as int)"),
        "c": F.expr("case when id % 4 > 0 then (id % 7) * 1.5D + (id % 13) / 10D end"),
        "gone": F.expr("case when id % 10 = 0 then 1.0D * id end"),
        "same": F.lit(2.0),
        LABEL: F.expr("cast(case when id % 10 < 3 then 3 else 1 end as int)"),
    })
    return df, Roles(id="id", dep_var="y", bin_vars=("b",), nom_vars=("n", "many"), ord_vars=("o",), cont_vars=("c", "gone", "same"))


def test_recode_stage(spark, tmp_path):
    df, roles = data(spark)
    made = fit_recode(df, roles, RecodeConfig(cap_flrC=True, impmethodC="ER", minbinnp=0.01, concrate=0.999), output=str(tmp_path))
    names = [r.name for r in made.recodes if r.keep]
    assert names == ["R1_b", "R1_n", "R1_o", "R1_c"]  # too many levels, too much missing, constant: left out
    out = made.apply(df, roles)
    assert out.columns == ["id", LABEL, "y", *names] and out.where("R1_c is null or R1_n is null").count() == 0
    meta = {r.var_name: r for r in made.meta_table(spark).collect()}
    assert meta["many"].overall_good == 0 and meta["gone"].overall_good == 0 and meta["c"].overall_good == 1
    assert meta["b"].ones_cnt == df.where(f"{LABEL} <> 3 and b = ' Y '").count()
    report = made.profile.collect()
    assert {r.variable for r in report} == {"b", "n", "many", "o", "c"}
    assert all(abs(sum(r.percent for r in report if r.variable == v) - 2) < 1e-9 for v in ("b", "n", "o", "c"))
    ones = next(r for r in report if r.variable == "b" and r.category == "1")
    assert ones["count"] == df.where(f"{LABEL} <> 3 and b is not null").count()  # the profile reads yes, the recode does not
    programs = json.loads((tmp_path / "numeric_recode.json").read_text())
    again = Recoded.from_programs(made.programs()).apply(df, roles)
    assert programs and again.exceptAll(out).count() == 0
    flags = fit_recode(df, roles, RecodeConfig(nom_method="BINARY", profiling=False, minbinnp=0.01))
    assert [r.name for r in flags.recodes if r.kind == "nominal"][0] == "R1_n_X1"
    assert "R1_many" in [r.name for r in fit_recode(df, roles, RecodeConfig(valcnt=0, concrate=0.999, profiling=False)).recodes]
    with pytest.raises(ValueError):
        fit_recode(df.withColumn("d", F.current_date()), Roles(id="id", dep_var="y", nom_vars=("d",)))


def test_reduce_stage(spark, tmp_path):
    df, roles = data(spark)
    rec, _ = recode(df, roles, RecodeConfig(profiling=False))
    rec = rec.withColumns({"R1_dup": F.col("R1_c") * 2 + 1, "R1_dup2": F.col("R1_c") * 3, "R1_const": F.lit(1.0), "R1_leak": F.col("y") * 1.0})
    master, chosen = reduce_variables(rec, roles, ReduceConfig(sources=2, decile=10, maxpuni=0.05), output=str(tmp_path))
    rows = {r.variable: r for r in master.collect()}
    assert set(rows) == {c for c in rec.columns if c.startswith("R1_")}
    assert rows["R1_leak"].drop_dv_corr == "Y" and "R1_leak" not in chosen and "R1_const" not in chosen
    like_c = ("R1_c", "R1_dup", "R1_dup2", "R1_o")  # all correlate above 0.7, so one at most stays
    assert sum(rows[v].drop_corr == "Y" for v in like_c) >= 2
    assert rows["R1_c"].num_sources == sum(rows["R1_c"][s] for s in master.columns if s.endswith("source"))
    assert (tmp_path / "selected_variables.txt").read_text() == "%let varlist_redu =\n" + " ".join(chosen) + "\n;"
    fast, picked = reduce_variables(rec.drop("R1_leak"), roles, ReduceConfig(fast_opt=True))
    assert "logsource" in fast.columns and "univsource" not in fast.columns and picked
    none, empty = reduce_variables(rec.select("id", "y", LABEL), roles, ReduceConfig())
    assert none.count() == 0 and empty == []
    again, same = reduce_variables(rec.repartition(9), roles, ReduceConfig(sources=2, decile=10, maxpuni=0.05))
    assert sorted(same) == sorted(chosen)


def test_full_pipeline_reads_all_rows(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").crossJoin(spark.range(20).withColumnRenamed("id", "copy"))
    rows.withColumn("l_orderkey", F.col("l_orderkey") * 20 + F.col("copy")).drop("copy").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.variable: r for r in queries.Q["full_pipeline"](spark, str(tmp_path)).collect()}
    roles = Roles(id="rid", dep_var="y", bin_vars=("b1",), nom_vars=("n1",), ord_vars=("o1",), cont_vars=("x1", "x2", "x3", "x4"))
    labelled, _ = sample(queries.model_table(spark, str(tmp_path)), roles, SampleConfig())
    table = fit_recode(labelled, roles, RecodeConfig(profiling=False)).apply(labelled, roles).where(f"{LABEL} <> 3").drop("rid").toPandas().astype(float)
    assert 0.7 * len(table) > ReduceConfig().samplesize  # the default draws a sample; from fewer rows none is seen to go, as the split has drawn by the same hashes
    assert set(got) == {c for c in table.columns if c.startswith("R1_")}
    for v, r in got.items():
        x = table[v]
        assert (r["count"], r.minimum, r.maximum) == (x.count(), x.min(), x.max()), v
        assert r.mean == pytest.approx(x.mean()) and r.dv_corr == pytest.approx(abs(x.corr(table.y)))


def test_recode_of_many_levels(spark):
    df = spark.range(24000).withColumns({
        "y": F.expr("cast(id % 12000 % 10 < 4 as int)"),
        "many": F.expr("case when id % 12 = 0 then 'often' else concat('v', id % 12000) end"),
        LABEL: F.lit(1),
    })
    made = fit_recode(df, Roles(id="id", dep_var="y", nom_vars=("many",)), RecodeConfig(valcnt=0, nom_method="MEAN", concrate=0.999, minbinnp=0.05, talpha=0.05))
    meta = {r.var_name: r for r in made.meta_table(spark).collect()}["many"]
    assert meta.uniq_cnt == 11001 and meta.overall_good == 1
    table = made.apply(df, Roles(id="id", dep_var="y", nom_vars=("many",), keep_list=("many",))).toPandas()
    levels = df.toPandas().groupby("many").y.agg(["count", "mean", "var"]).reset_index().sort_values(["mean", "many"])
    groups = nominal.by_t_test(nominal.by_count(list(levels.itertuples(index=False, name=None)), 24000, 1200), 0.05)
    assert sum(map(len, groups)) == 11001 and len(groups) > 1
    group_of = {v: i for i, g in enumerate(groups) for v in g}
    table["want"] = table.groupby(table.many.map(group_of)).y.transform("mean")
    assert (table.R1_many - table.want).abs().max() < 1e-9
    report = made.profile.collect()
    assert sum(r["count"] for r in report if r.category != "Overall") == 24000


def test_groups():
    assert groups_of(list("abcde"), 2) == [["a", "b", "c"], ["d", "e"]] and groups_of(["a"], 5) == [["a"]] and groups_of([], 3) == []


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,s,Sex,Age\n1,1.5,x,female,3\nNA,nan,NULL,male,\n3, 2,y,,40\n")
    df = readers.read_table(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "s": "string", "Sex": "string", "Age": "bigint"}
    assert [tuple(r) for r in df.select("a", "b", "s").collect()] == [(1, 1.5, "x"), (None, None, None), (3, 2.0, "y")]
    flags = readers.sex_and_child_flags(df).collect()
    assert [(r.IsFemale, r.IsChild) for r in flags] == [(1, 1), (0, 0), (0, 0)]
    nan = spark.createDataFrame([(float("nan"), True)], "x double, f boolean")
    assert list(readers.nan_to_null(nan).first()) == [None, 1]
    for kind in ("parquet", "csv", "json", "orc"):
        sinks.write_table(df, f"{tmp_path}/out.{kind}", kind)
        assert readers.read_table(spark, f"{tmp_path}/out.{kind}").count() == 3
    with sinks.log_to(str(tmp_path / "l/x.log"), str(tmp_path / "l/x.lst")) as log:
        log.debug("low")
        log.info("high")
    assert "low" in (tmp_path / "l/x.log").read_text() and "low" not in (tmp_path / "l/x.lst").read_text()
    assert readers.preview(df, 2).count() == 2


def test_stream_scoring(spark, tmp_path):
    df, roles = data(spark)
    made = fit_recode(df, roles, RecodeConfig(profiling=False))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    scorer.start(stream, made, roles, f"{tmp_path}/out", f"{tmp_path}/chk").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").exceptAll(made.apply(df, roles)).count() == 0


def test_logistic_selection_before_rounding_and_as_the_query_rounds_it(spark, sf):
    """The query rounds p as its SQL does; the operator's own p is that of plain code, however small."""
    df = queries.model_table(spark, sf)
    table, inside = df.select("x2", "x4", "x5", "o1", "y").toPandas().astype(float), []
    got = stepwise.stepwise_logistic(df, ["x2", "x4", "x5", "o1"], "y", 0.05)
    for v, _, p in got:
        want = {c: score_p(table, inside, c, np.ones(len(table))) for c in ("x2", "x4", "x5", "o1") if c not in inside}
        assert want[v] == min(want.values()) and p == pytest.approx(want[v], rel=1e-5, abs=1e-300)
        inside.append(v)
    assert inside and all(score_p(table, inside, c, np.ones(len(table))) > 0.05 for c in ("x2", "x5", "o1") if c not in inside)
    rows = sorted(queries.Q["stepwise_logistic"](spark, sf).collect(), key=lambda r: r.step)
    assert [tuple(r) for r in rows] == [(v, step, round(p, 6)) for v, step, p in got]


def test_logistic_selection_equals_sql_where_p_is_below_any_double(spark, sf, tmp_path):
    """x4 rules the target and x2 follows it closely: p of both is 0 in double, and x2 is listed first."""
    cut = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_discount", F.round(F.col("l_discount") * 100)).withColumn("l_extendedprice", 52000 - 1000 * F.col("l_discount"))
    copies = cut.crossJoin(spark.range(3).withColumnRenamed("id", "copy"))
    copies.withColumn("l_orderkey", F.col("l_orderkey") + 10_000_000 * F.col("copy")).drop("copy").coalesce(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.Q["stepwise_logistic"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(queries.SQL["stepwise_logistic"]).fetchall()) and ("x4", 1, 0.0) in got


@pytest.mark.parametrize("likelihood_ratio", [False, True])
def test_logistic_selection_takes_the_largest_statistic(spark, likelihood_ratio):
    r = np.random.default_rng(4)
    x = r.normal(size=6000)
    y = (x + 0.5 * r.normal(size=6000) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"weak": x + 0.3 * r.normal(size=6000), "strong": x, "y": y}))
    got = stepwise.stepwise_logistic(df, ["weak", "strong"], "y", 0.001, likelihood_ratio=likelihood_ratio)
    assert got == [("strong", 1, 0.0)]
    assert stepwise.stepwise_logistic(df, ["weak"], "y", 0.001, likelihood_ratio=likelihood_ratio) == [("weak", 1, 0.0)]


def test_var_clusters_against_plain_code(spark, sf):
    rows = queries.Q["var_clusters"](spark, sf).collect()
    table = queries.model_table(spark, sf).select(*queries.NUMBERS).toPandas().dropna().astype(float)
    corr, groups = table.corr(), {}
    for r in rows:
        groups.setdefault(r.cluster, []).append(r.variable)
    assert sorted(v for g in groups.values() for v in g) == sorted(queries.NUMBERS)
    part = {}
    for c, g in groups.items():
        inner = corr.loc[g, g].to_numpy()
        top = np.linalg.eigh(inner)[1][:, -1]
        part[c] = (corr[g] @ top) ** 2 / (top @ inner @ top)
    for r in rows:
        nearest = max(p[r.variable] for c, p in part.items() if c != r.cluster)
        own = part[r.cluster][r.variable]
        assert own >= nearest - 1e-9 and r.ratio == pytest.approx((1 - own) / (1 - nearest), abs=1e-6)
