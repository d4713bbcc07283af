import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewright.operators.predicates import PredicateError, compile_predicate, speaks_of_table
from scorewright.operators.rows import exclude

ROWS = [(i, None if i % 5 == 0 else float(i - 4), None if i % 4 == 0 else ["ab", "Abc", "x.y", "", " b "][i % 5], i % 3 == 0, float("nan") if i % 6 == 1 else 2.0 * i) for i in range(24)]
TEXTS = [
    'inds["x"] > 3', 'inds["x"] != 3', '~(inds["x"] < 3)', "inds.x.isna() | (inds.z >= 20)", 'inds[dep_var].isna()', 'inds["x"] == inds["z"]', '3 < inds["x"]',
    '(inds["x"] > 1) & ~(inds["z"] <= 9) ^ inds["b"]', 'inds["x"].isin([1, 2.0, -3, "ab"])', '~inds["t"].isin(["ab", ""])', 'inds["t"].isin([1, 2])', 'inds["x"].between(-2, 4)',
    'inds["x"].between(-2, 4, inclusive="left")', 'inds["x"].between(-2, inds["z"], "neither")', 'inds["x"].fillna(-1) < 0', 'inds["x"] / (inds["i"] - 9) > 0.5', 'inds["x"] // 3 == -1',
    'inds["x"] % 3 == 2', '-inds["x"] ** 2 < -20', 'abs(inds["x"]) <= 2', 'inds["x"].abs().gt(5)', 'inds["x"].notna() & inds["b"]', '~inds["b"]', 'inds["b"] == True',
    'inds["t"].str.startswith("a", na=False)', 'inds["t"].str.contains("b", na=False)', 'inds["t"].str.contains("B", case=False, na=True)', 'inds["t"].str.contains("x.y", regex=False, na=False)',
    'inds["t"].str.contains("x[.]|^A", na=False)', 'inds["t"].str.lower().str.endswith("bc", na=False)', 'inds["t"].str.strip() == "b"', 'inds["t"].str.len() > 2', 'inds["t"] + "!" == "ab!"',
    'inds["t"] == 3', 'inds["t"] != 3', 'inds["t"] >= "ab"', 'pd.isna(inds["t"]) | np.isnan(inds["z"])', 'pd.notnull(inds["x"]) & (inds["i"] * 2 - 1 > 20)', 'inds["i"].eq(3) | inds["i"].ne(limit) & inds["i"].le(1)',
    'inds["d"] >= "2024-01-10"', 'inds["x"] / 0 > 1', '0 / inds["x"] == 0', "inds['it''s' 'x'] > 2" if False else "inds['x'] > 2",
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "i int, x double, t string, b boolean, z double").withColumn("d", F.expr("timestamp'2024-01-01' + make_dt_interval(i)"))


def framed():
    """The same rows as a data frame, whose own evaluation of a text is the rule."""
    df = pd.DataFrame(ROWS, columns=["i", "x", "t", "b", "z"])
    df["d"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(df["i"], unit="D")
    df["t"] = df["t"].astype(object).where(df["t"].notna(), np.nan)
    return df


@pytest.mark.parametrize("text", TEXTS)
def test_like_a_data_frame(table, text):
    inds, names = framed(), {"dep_var": "x", "limit": 0}
    want = sorted(inds.i[~eval(text, {"inds": inds, "pd": pd, "np": np, **names})].tolist())
    assert sorted(r.i for r in exclude(table, python=text, names=names).select("i").collect()) == want
    column = compile_predicate(table, text, names)
    assert table.where(column.isNull()).count() == 0


REFUSED = {
    "__import__('os').system('true')": "only methods", "inds.nothing > 1": "no column 'nothing'", 'inds["q"] > 1': "no column 'q'", "inds": "the table itself", 'inds["x"]': "a mask is expected",
    'inds["x"] > 1 and inds["z"] > 1': "joined by &", 'not inds["b"]': "negated by ~", '1 < inds["x"] < 3': "chain", 'inds["x"] == None': "isna()", 'inds["x"] > other': "unknown name 'other'",
    'inds["x"] in [1]': "In is not allowed", 'inds["x"].apply(abs) > 1': "'apply' is not allowed", 'inds["t"].str.replace("a", "b") == "b"': ".str.replace is not allowed", 'inds["x"] > "a"': "between number and text",
    'inds["x"] & inds["b"]': "a mask is expected", 'inds.loc["x"] > 1': "allowed", "(lambda: 1)()": "only methods", "[i for i in inds]": "ListComp is not allowed", 'inds["x"].isin(inds["z"])': "list of literals",
    'inds["x"] if True else inds["z"]': "IfExp is not allowed", 'inds["x"].between(1)': "'right' is missing", 'inds["x"].isna(1)': "too many arguments", 'inds["x"].__class__ == 1': "attribute '__class__' is not allowed",
    'inds["t"].str.contains("a", flags=2)': "without flags", 'pd.eval("1")': "pd.eval is not allowed", 'f"{inds}" == "a"': "JoinedStr is not allowed", "inds[": "not a Python expression", 'inds["x"] @ 2 > 1': "MatMult is not allowed",
}


@pytest.mark.parametrize("text", REFUSED)
def test_refused_with_place(table, text):
    with pytest.raises(PredicateError, match=".*" + REFUSED[text].replace("(", r"\(").replace(")", r"\)").replace("[", r"\[")):
        compile_predicate(table, text)


def test_place_is_told(table):
    with pytest.raises(PredicateError, match="column 19 of line 1, 'other': unknown name"):
        compile_predicate(table, '(inds["x"] > 1) & (other)'.replace("(other)", "other"))


def test_sql_or_python():
    assert speaks_of_table('inds["a"] > 1') and not speaks_of_table("a > 1 AND b IS NULL") and not speaks_of_table("a > 1") and not speaks_of_table("")


def test_sample_stage_reads_python(spark):
    """The text that older settings hold excludes rows without target."""
    from scorewright.plans.config import Roles, SampleConfig
    from scorewright.plans.sample import sample

    df = spark.range(200).select("id", F.expr("if(id % 4 = 0, null, cast(id % 2 as int))").alias("y"))
    out, _ = sample(df, Roles(id="id", dep_var="y"), SampleConfig(exclusion_if="inds[dep_var].isna()"))
    assert out.count() == 150 and out.where("y is null").count() == 0
