import random

import pytest
from pyspark.sql import functions as F

from scorewright.operators import levels, nominal, quantiles
from scorewright.plans import recode as stage
from scorewright.plans.config import LABEL, RecodeConfig, Roles
from scorewright.plans.recode import Recoded, fit_recode


def stats(rows):
    """(level, count, mean, variance) of rows (level, y)."""
    by = {}
    for level, y in rows:
        by.setdefault(level, []).append(y)
    out = []
    for level, ys in by.items():
        known = [y for y in ys if y is not None]
        mean = sum(known) / len(known) if known else None
        var = sum((y - mean) ** 2 for y in known) / (len(known) - 1) if len(known) > 1 else None
        out.append((level, len(ys), mean, var))
    return out


def some_rows(seed, n, count):
    r = random.Random(seed)
    rate = [r.choice([0.1, 0.4, 0.5, 0.9]) for _ in range(count)]
    rows = []
    for _ in range(n):
        k = min(int(r.expovariate(1) * count / 6), count - 1)
        rows.append((f"v{k}" if k else None, int(r.random() < rate[k]) if r.random() > 0.02 else None))
    return rows + [("never", None)] * 5


@pytest.mark.parametrize("settings", [{}, {"minbinnp": 0.002}, {"minbinnp": 0.0, "minbinnc": 7}, {"minbinnp": 0.0, "minbinnc": 0}, {"minbinnp": 0.3, "bonfer": True}])
def test_collapse_in_partitions(spark, monkeypatch, settings):
    """The same groups as on the driver, whatever the partitions."""
    monkeypatch.setattr(levels, "LEVELS_A_PART", 60)
    rows = some_rows(3, 4000, 700)
    df = spark.createDataFrame(rows, "v string, y int").repartition(4)
    table = levels.level_table(df, {"v": F.col("v")}, "y")
    count, overall = table.count(), sum(y for _, y in rows if y is not None) / sum(y is not None for _, y in rows)
    made = levels.collapse_many(table, count, len(rows), overall, **settings)
    want = nominal.collapse_rows(stats(rows), len(rows), overall, **settings)
    got = {}
    for r in made.table.collect():
        got.setdefault(r.fgroup, set()).add(r.level)
        assert r.score == (pytest.approx(want.indexes[r.fgroup - 1]) if want.indexes[r.fgroup - 1] is not None else None)
    assert [got[g] for g in sorted(got)] == [set(g) for g in want.groups]
    assert made.rows == [sum(1 for v, y in rows if v in set(g) and y is not None) for g in want.groups]
    assert made.means == [pytest.approx(m) if m is not None else None for m in want.means]
    made.close()
    assert levels.collapse_many(table.limit(0), 0, 0, None) is None


@pytest.mark.parametrize("method", ["INDEX", "MEAN", "BINARY"])
def test_recode_by_table(spark, tmp_path, method):
    """A join gives what a list of levels gives; levels never seen score 0; the program reads back."""
    rows = some_rows(7, 3000, 400)
    df = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(rows)], "id int, v string, y int")
    roles, common = Roles(id="id", dep_var="y", nom_vars=("v",)), {"valcnt": 0, "concrate": 0.999, "nom_method": method}
    by_list = fit_recode(df, roles, RecodeConfig(**common))
    by_table = fit_recode(df, roles, RecodeConfig(**common, many_levels=50), output=str(tmp_path))
    assert {r.kind for r in by_table.recodes} == {"lookup"} and not any(" in (" in r.sql for r in by_table.recodes)
    new = df.union(spark.createDataFrame([(-1, "unheard of", 0)], df.schema))
    names = [r.name for r in by_list.recodes]
    want = {r.id: list(r)[2:] for r in by_list.apply(new, roles).collect()}
    for made in (by_table, Recoded.from_programs(by_table.programs())):
        out = made.apply(new, roles)
        assert out.columns == ["id", "y", *names]
        assert all(list(r)[2:] == pytest.approx(want[r.id]) for r in out.collect())
        assert " IN (" not in out._jdf.queryExecution().optimizedPlan().toString()
    a, b = ({(round(r.average_dv, 9), r["count"]) for r in m.profile.collect()} for m in (by_list, by_table))
    assert a == b
    by_table.close()


def test_three_scans_before_the_fits(spark, tmp_path, monkeypatch):
    """Facts of all variables of all types: one aggregate, one count inside brackets, one over levels."""
    path = str(tmp_path / "rows")
    spark.range(4000).select(
        "id", F.expr("cast(id % 3 = 0 as int) as y"), F.expr("if(id % 2 = 0, 'Y', 'N') as b"), F.expr("concat('n', id % 6) as n"), F.expr("concat('m', id) as m"), F.expr("cast(id % 7 as int) as o"), F.expr("id * 1.5D as c"), F.expr("if(id % 5 = 0, null, sqrt(id)) as d"),
    ).repartition(3).write.parquet(path)
    roles = Roles(id="id", dep_var="y", bin_vars=("b",), nom_vars=("n", "m"), ord_vars=("o",), cont_vars=("c", "d"))
    seen, sketch, cells, table = [], quantiles._sketch, quantiles._cells, levels.level_table
    monkeypatch.setattr(quantiles, "_sketch", lambda *a: (seen.append("sketch"), sketch(*a))[1])
    monkeypatch.setattr(quantiles, "_cells", lambda *a: (seen.append("cells"), cells(*a))[1])
    monkeypatch.setattr(levels, "level_table", lambda *a: (seen.append("levels"), table(*a))[1])
    facts = stage._Facts(spark.read.parquet(path), roles, RecodeConfig())
    assert seen == ["sketch", "cells", "levels"]
    assert facts.sizes["n"] == (6, 667) and facts.sizes["o"][0] == 7 and facts.nobs == 4000
    assert facts.found["missing", "d"] == 800 and "m" not in facts.full and "n" in facts.full
    assert facts.level_rows.count() < 100  # the 4,000 levels of m, which can't pass, are not shuffled
    facts.close()


def test_facts_of_refused_variables(spark):
    df = spark.range(3000).select("id", F.expr("cast(id % 2 as int) as y"), F.expr("concat('u', id) as u"), F.expr("if(id % 10 < 4, 'top', concat('x', id)) as t"), F.expr("if(id % 20 = 0, 'a', null) as g"), F.lit(1).alias(LABEL))
    made = fit_recode(df, Roles(id="id", dep_var="y", nom_vars=("u", "t", "g")), RecodeConfig(profiling=False))
    meta = {m["var_name"]: m for m in made.meta}
    assert meta["t"]["max_cnt"] == 1200 and meta["t"]["uniq_cnt"] == 1801 and meta["t"]["overall_good"] == 0
    assert meta["u"]["max_cnt"] == 1 and abs(meta["u"]["uniq_cnt"] - 3000) < 300 and meta["g"]["miss_cnt"] == 2850
    assert made.recodes == []
