"""Registered queries of the modelling operators, and DuckDB SQL that computes the same on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.scalars import clip, index, logit, transform
from ..operators import information, moments, nominal, numeric, profiles, quantiles, regression, rows, sampling, stepwise, voting
from .config import LABEL, ReduceConfig, RecodeConfig, Roles, SampleConfig
from .recode import fit_recode
from .reduce import clusters, principal, reduce_variables
from .sample import sample

SEED = 123456
KEYS = ["rid"]
NUMBERS = ["x1", "x2", "x3", "x4", "x5", "x6"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def model_table(spark: SparkSession, d: str) -> DataFrame:
    """Line items as modelling rows: a unique id, a noisy 0/1 target, variables of every role, some of them missing."""
    li = _t(spark, d, "lineitem")
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")] + [F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.col("l_quantity").cast("long").cast("string")]
    m = li.withColumn("rid", F.concat_ws("-", *parts))
    high = F.col("l_extendedprice") + 1000 * F.col("l_quantity") > 78000
    return m.select(
        "rid",
        F.when(high != (draw(1, F.col("rid")) < F.lit(0.2 * 4294967296)), 1).otherwise(0).alias("y"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("x1"),
        F.col("l_quantity").alias("x2"),
        (2 * F.col("l_quantity") + F.col("l_tax")).alias("x3"),
        (F.col("l_quantity") - F.col("l_discount")).alias("x4"),
        F.col("l_discount").alias("x5"),
        F.col("l_tax").alias("x6"),
        F.col("l_linenumber").alias("o1"),
        F.when(F.col("l_linenumber") != 1, F.when(F.col("l_linestatus") == "O", " Y ").otherwise("N")).alias("b1"),
        F.when(F.col("l_linenumber") != 6, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("n1"),
        F.col("l_quantity").alias("w"),
        F.col("l_extendedprice").alias("z"),
    )


_BUCKET = "('0x' || substr(md5('{seed}-' || CAST({key} AS VARCHAR)), 1, 8))::UBIGINT"
_M = """
WITH b AS (
  SELECT *, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT)) AS rid FROM lineitem
), m AS (
  SELECT rid, CASE WHEN (l_extendedprice + 1000 * l_quantity > 78000) <> (('0x' || substr(md5('1-' || rid), 1, 8))::UBIGINT < 0.2::DOUBLE * 4294967296) THEN 1 ELSE 0 END AS y,
    CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS x1, l_quantity AS x2, 2 * l_quantity + l_tax AS x3, l_quantity - l_discount AS x4,
    l_discount AS x5, l_tax AS x6, l_linenumber AS o1,
    CASE WHEN l_linenumber <> 1 THEN CASE WHEN l_linestatus = 'O' THEN ' Y ' ELSE 'N' END END AS b1,
    CASE WHEN l_linenumber <> 6 THEN l_returnflag || CAST(l_linenumber AS VARCHAR) END AS n1, l_quantity AS w, l_extendedprice AS z
  FROM b
)
"""
#: The numeric variables in long form.
_LONG = ", long AS (SELECT variable, value FROM (SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [*NUMBERS, "o1"]) + " FROM m) UNPIVOT INCLUDE NULLS (value FOR variable IN (" + ", ".join([*NUMBERS, "o1"]) + ")))"
LONG = [*NUMBERS, "o1"]


def _r(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as sums in another order differ in their last digits."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        Q[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


_TIE = _BUCKET.format(seed=0, key="rid")
_BINS = _M + f""", r AS (
  SELECT y, z, (row_number() OVER (ORDER BY z, {_TIE}, rid) * 10) // (count(*) OVER () + 1) AS bin FROM m
), t AS (SELECT bin, avg(y) AS mean_dv, count(*) AS cnt, avg(z) AS mean_var, min(z) AS min_var, max(z) AS max_var FROM r GROUP BY 1
), s AS (SELECT *, cnt * mean_dv / sum(cnt * mean_dv) OVER () AS br, (cnt - cnt * mean_dv) / (sum(cnt) OVER () - sum(cnt * mean_dv) OVER ()) AS gr, cnt / sum(cnt) OVER () AS fr FROM t)
"""


@query(_BINS + "SELECT CAST(bin AS DOUBLE) AS bin, round(mean_dv, 6) AS mean_dv, CAST(cnt AS DOUBLE) AS cnt, round(min_var, 6) AS min_var, round(max_var, 6) AS max_var, round((br - gr) * ln(greatest(br / gr, 1e-5)), 6) AS contribution FROM s")
def iv_rank_bins(spark, d):
    t = information.bin_table(model_table(spark, d), "z", "y", KEYS, 10).withColumn("variable", F.lit("z"))
    return _r(information.bin_metrics(t).select("bin", "mean_dv", "cnt", "min_var", "max_var", "contribution"))


@query(_BINS + """, c AS (SELECT *, sum(br) OVER o AS cb, sum(gr) OVER o AS cg, sum(fr) OVER o AS cf FROM s WINDOW o AS (ORDER BY bin)),
p AS (SELECT *, lag(cb) OVER (ORDER BY bin) AS pb, lag(cf) OVER (ORDER BY bin) AS pf FROM c)
SELECT 'z' AS variable, round(sum((br - gr) * ln(greatest(br / gr, 1e-5))), 6) AS infv, round(sum(coalesce(2 * ((cf + pf) / 2 - (cb + pb) / 2) * (cf - pf), 0)), 6) AS gini, round(max(abs(cb - cg)), 6) AS ks FROM p""")
def iv_ks_gini(spark, d):
    return _r(information.information(model_table(spark, d), ["z"], "y", KEYS, 10))


@query(_M + f""", r AS (
  SELECT y, z, w, CAST(floor(sum(w) OVER (ORDER BY z, {_TIE}, rid ROWS UNBOUNDED PRECEDING) * 10 / (sum(w) OVER () + 1)) AS BIGINT) AS bin FROM m
) SELECT CAST(bin AS DOUBLE) AS bin, round(avg(y), 6) AS mean_dv, round(sum(w), 6) AS cnt, round(min(z), 6) AS min_var, round(max(z), 6) AS max_var FROM r GROUP BY 1""")
def iv_weighted_bins(spark, d):
    return _r(information.bin_table(model_table(spark, d), "z", "y", KEYS, 10, weight="w").select("bin", "mean_dv", "cnt", "min_var", "max_var"))


@query(_M + """, t AS (SELECT CAST(o1 AS DOUBLE) AS bin, avg(y) AS mean_dv, max(y) AS max_dv, count(*) AS cnt FROM m GROUP BY 1),
s AS (SELECT *, cnt * mean_dv / sum(cnt * mean_dv) OVER () AS br, (cnt - cnt * mean_dv) / (sum(cnt) OVER () - sum(cnt * mean_dv) OVER ()) AS gr FROM t)
SELECT bin, round(mean_dv, 6) AS mean_dv, CAST(cnt AS DOUBLE) AS cnt, round(br, 6) AS br, round(gr, 6) AS gr FROM s""")
def iv_value_bins(spark, d):
    t = information.bin_table(model_table(spark, d), "o1", "y", KEYS, 10).withColumn("variable", F.lit("o1"))
    return _r(information.bin_metrics(t).select("bin", "mean_dv", "cnt", "br", "gr"))


@query(_M + """, t AS (SELECT o1 AS bin, count(*) AS cnt, avg(y) AS mean_dv, max(y) AS max_dv FROM m GROUP BY 1)
SELECT CAST(bin AS DOUBLE) AS bin, CAST(cnt AS DOUBLE) AS cnt, round(mean_dv, 6) AS mean_dv, CAST(max_dv AS DOUBLE) AS max_dv FROM t
UNION ALL SELECT NULL, CAST(count(*) AS DOUBLE), round(avg(y), 6), CAST(max(y) AS DOUBLE) FROM m""")
def bins_with_total(spark, d):
    return _r(information.with_total(information.bin_table(model_table(spark, d), "o1", "y", KEYS, 10)).select("bin", "cnt", "mean_dv", "max_dv"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice > 200000 END, false)")
def exclude_filter(spark, d):
    return rows.exclude(_t(spark, d, "orders"), "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice > 200000 END").select("o_orderkey", "o_orderstatus")


_PYTHON = """(inds[price] != 100.0) & (inds["o_orderkey"] % 3 == 1) | inds[price].isna() & inds.o_orderpriority.str.startswith("1-") | \
    (inds[price] / 1000).between(50, 90) & ~inds["o_orderstatus"].isin(["F", "P"]) | (inds["o_orderdate"] >= "1998-06-01") & (inds["o_orderpriority"].str.lower().str.contains("low|specified"))"""


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders)
SELECT o_orderkey, round(price, 2) AS price FROM o WHERE NOT (
  coalesce(price <> 100, true) AND o_orderkey % 3 = 1 OR price IS NULL AND o_orderpriority LIKE '1-%'
  OR coalesce(price / 1000 BETWEEN 50 AND 90, false) AND o_orderstatus NOT IN ('F', 'P')
  OR o_orderdate >= TIMESTAMP '1998-06-01' AND (lower(o_orderpriority) LIKE '%low%' OR lower(o_orderpriority) LIKE '%specified%'))""")
def exclude_python(spark, d):
    o = _t(spark, d, "orders").withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    return _r(rows.exclude(o, python=_PYTHON, names={"price": "price"}).select("o_orderkey", "price"), 2)


_SPLIT = f"CASE WHEN {_BUCKET.format(seed=SEED, key='o_orderkey')} < 0.7::DOUBLE * 4294967296 THEN 1 ELSE 3 END"


@query(f"SELECT o_orderkey, {_SPLIT} AS mod_val_test FROM orders")
def hash_split(spark, d):
    return sampling.split(_t(spark, d, "orders"), ["o_orderkey"], 0.7, SEED).select("o_orderkey", LABEL)


@query(f"SELECT o_orderkey, {_SPLIT} AS mod_val_test FROM orders WHERE {_SPLIT} <> 3")
def work_file(spark, d):
    return rows.work_file(sampling.split(_t(spark, d, "orders"), ["o_orderkey"], 0.7, SEED)).select("o_orderkey", LABEL)


@query(f"SELECT o_orderkey, CASE WHEN {_SPLIT} = 1 AND {_BUCKET.format(seed=SEED + 1, key='o_orderkey')} > 0.5::DOUBLE * 4294967296 THEN 2 ELSE {_SPLIT} END AS mod_val_test FROM orders")
def validation_carveout(spark, d):
    return sampling.carve_validation(sampling.split(_t(spark, d, "orders"), ["o_orderkey"], 0.7, SEED), ["o_orderkey"], SEED).select("o_orderkey", LABEL)


@query(f"""WITH l AS (SELECT o_totalprice, CASE WHEN {_SPLIT} = 1 AND {_BUCKET.format(seed=SEED + 1, key='o_orderkey')} > 0.5::DOUBLE * 4294967296 THEN 2 ELSE {_SPLIT} END AS p FROM orders)
SELECT CASE p WHEN 1 THEN 'Model' WHEN 2 THEN 'Val' ELSE 'Test' END AS partition, round(avg(o_totalprice), 4) AS rate FROM l GROUP BY p""")
def sample_rate_table(spark, d):
    out, rates = sample(_t(spark, d, "orders"), Roles(id="o_orderkey", dep_var="o_totalprice"), SampleConfig(binary_dv=False))
    return _r(rates, 4)


_TAKE = f"ORDER BY {_BUCKET.format(seed=SEED, key='o_orderkey')}, o_orderkey LIMIT"


@query(f"SELECT o_orderkey FROM orders {_TAKE} 500")
def sample_without_replacement(spark, d):
    return sampling.take(_t(spark, d, "orders"), ["o_orderkey"], 500, SEED).select("o_orderkey")


_TOP = f"""SELECT o_orderkey, 0 AS copy FROM {{t}} UNION ALL
SELECT o_orderkey, CAST(i + 1 AS INTEGER) FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_BUCKET.format(seed=SEED, key='o_orderkey')}, o_orderkey) - 1 AS slot FROM {{t}})
JOIN (SELECT i, CAST(floor({_BUCKET.format(seed=SEED + 7, key='i')}::DOUBLE * (SELECT count(*) FROM {{t}}) / 4294967296.0::DOUBLE) AS BIGINT) AS pick FROM range({{n}} - (SELECT count(*) FROM {{t}})) r(i)) ON slot = pick"""


@query(_TOP.format(t="orders", n="(SELECT count(*) FROM orders) + 300"))
def topup_with_replacement(spark, d):
    df = _t(spark, d, "orders")
    return sampling.top_up(df, ["o_orderkey"], df.count() + 300, SEED).select("o_orderkey", F.col(sampling.COPY).alias("copy"))


@query(f"""WITH yes AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), no AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')
SELECT o_orderkey, copy FROM (SELECT o_orderkey, 0 AS copy FROM yes {_TAKE} 200) UNION ALL SELECT o_orderkey, 0 FROM (SELECT o_orderkey FROM no {_TAKE} 300)""")
def stratified_resample(spark, d):
    df = _t(spark, d, "orders").withColumn("resp", (F.col("o_orderstatus") == "P").cast("int"))
    return sampling.resample(df, ["o_orderkey"], "resp", 500, 0.4, 100, SEED).select("o_orderkey", F.col(sampling.COPY).alias("copy"))


@query(f"SELECT o_orderkey FROM orders WHERE {_BUCKET.format(seed=SEED, key='o_orderkey')} <= 400.0::DOUBLE / (SELECT count(*) FROM orders) * 4294967296")
def row_cap(spark, d):
    return sampling.row_cap(_t(spark, d, "orders"), ["o_orderkey"], 400, SEED).select("o_orderkey")


@query(_M + "SELECT count(*) AS nobs, round(avg(y), 6) AS overall_avg FROM m")
def global_stats(spark, d):
    n, mean = profiles.overall(model_table(spark, d), "y")
    return _r(spark.createDataFrame([(n, mean)], "nobs long, overall_avg double"))


@query(_M + "SELECT count(*) - count(x1) AS x1, count(*) - count(b1) AS b1, count(*) - count(n1) AS n1 FROM m")
def missing_counts(spark, d):
    return spark.createDataFrame([profiles.missing_counts(model_table(spark, d), ["x1", "b1", "n1"])], "x1 long, b1 long, n1 long")


@query(_M + """, long AS (SELECT variable, value FROM (SELECT b1, n1, CAST(o1 AS VARCHAR) AS o1 FROM m) UNPIVOT INCLUDE NULLS (value FOR variable IN (b1, n1, o1))),
g AS (SELECT variable, value, count(*) AS n FROM long GROUP BY ALL)
SELECT variable, CAST(sum(CASE WHEN value IS NULL THEN n ELSE 0 END) AS BIGINT) AS miss_cnt, count(*) AS uniq_cnt, max(n) AS max_cnt FROM g GROUP BY 1""")
def distinct_and_mode(spark, d):
    return profiles.column_facts(model_table(spark, d), ["b1", "n1", "o1"])


@query("""SELECT 'l_quantity' AS variable, CASE WHEN count(DISTINCT l_quantity) = 2 THEN 'binary' ELSE 'continuous' END AS role FROM lineitem
UNION ALL SELECT 'flag', CASE WHEN count(DISTINCT l_linenumber > 3) = 2 THEN 'binary' ELSE 'continuous' END FROM lineitem UNION ALL SELECT 'l_returnflag', 'nominal'""")
def auto_roles(spark, d):
    df = _t(spark, d, "lineitem").select("l_quantity", (F.col("l_linenumber") > 3).cast("int").alias("flag"), "l_returnflag")
    r = rows.auto_roles(df, "target")
    return spark.createDataFrame([*[(v, "binary") for v in r.bin_vars], *[(v, "continuous") for v in r.cont_vars], *[(v, "nominal") for v in r.nom_vars]], "variable string, role string")


_NEAREST = ", ".join(f"round(max(CASE WHEN k = CAST(round_even({q}::DOUBLE * (n - 1), 0) AS BIGINT) THEN value END), 6) AS q{i}" for i, q in enumerate((0.01, 0.25, 0.5, 0.75, 0.99)))
_RANKED = _M + _LONG + ", r AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY variable) AS n FROM long WHERE value IS NOT NULL)"


@query(_RANKED + f" SELECT variable, max(n) AS n, {_NEAREST} FROM r GROUP BY 1")
def quantile_nearest(spark, d):
    return _r(quantiles.quantiles(model_table(spark, d), LONG, [0.01, 0.25, 0.5, 0.75, 0.99]))


@query(_M + _LONG + " SELECT variable, count(value) AS n, round(quantile_cont(value, 0.01), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1, round(quantile_cont(value, 0.99), 6) AS q2 FROM long WHERE value IS NOT NULL GROUP BY 1")
def quantile_linear(spark, d):
    return _r(quantiles.quantiles(model_table(spark, d), LONG, [0.01, 0.5, 0.99], "linear"))


_BOUNDS = _RANKED + """, q AS (SELECT variable, min(value) AS mn, max(value) AS mx, """ + ", ".join(f"max(CASE WHEN k = CAST(round_even({q}::DOUBLE * (n - 1), 0) AS BIGINT) THEN value END) AS p{n}" for q, n in ((0.01, 1), (0.25, 25), (0.5, 50), (0.75, 75), (0.99, 99))) + """ FROM r GROUP BY 1
), i AS (SELECT *, greatest(p75 - p25, p99 - p75, p25 - p1) AS iqr FROM q
), l AS (SELECT *, least(greatest(p25 - 1.5::DOUBLE * iqr, mn), p1) AS lb0, greatest(least(p75 + 1.5::DOUBLE * iqr, mx), p99) AS ub0 FROM i
), bounds AS (SELECT variable, p50, CASE WHEN lb0 = ub0 THEN mn ELSE lb0 END AS lb, CASE WHEN lb0 = ub0 THEN mx ELSE ub0 END AS ub FROM l)
"""


@query(_BOUNDS + "SELECT variable, round(p50, 6) AS median, round(lb, 6) AS lb, round(ub, 6) AS ub FROM bounds")
def numeric_bounds(spark, d):
    found = numeric.summarise(model_table(spark, d), LONG, "y")
    return _r(spark.createDataFrame([(v, s.median, s.lb, s.ub) for v, s in found.items()], "variable string, median double, lb double, ub double"))


@query(_M + "SELECT rid, CASE WHEN x1 IS NOT NULL THEN greatest(least(x1, 90000), 20000) END AS x1 FROM m")
def cap_floor(spark, d):
    return model_table(spark, d).select("rid", clip(F.col("x1"), 20000, 90000).alias("x1"))


@query(_M + "SELECT rid, round(v * v, 4) AS sq, round(sqrt(greatest(v, 0)), 6) AS sr, round(ln(greatest(v, 1e-5)), 6) AS ln, round(-1 / greatest(v, 1e-5), 6) AS iv, round(-exp(least(-v, 0)), 6) AS ep FROM (SELECT rid, x6 - 0.02::DOUBLE AS v FROM m)")
def transforms_sq_sr_ln(spark, d):
    v = F.col("x6") - F.lit(0.02)
    return model_table(spark, d).select("rid", F.round(transform("SQ_", v), 4).alias("sq"), *[F.round(transform(p, v), 6).alias(p[:2].lower()) for p in ("SR_", "LN_", "IV_", "EP_")])


@query(_M + "SELECT o1, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT o1, greatest(least(avg(y), 0.9999::DOUBLE), 0.0001::DOUBLE) AS p FROM m GROUP BY 1)")
def logit_of_rates(spark, d):
    return _r(model_table(spark, d).groupBy("o1").agg(F.avg("y").alias("p")).select("o1", logit(F.col("p")).alias("logit")))


@query(_RANKED + """, q AS (SELECT avg(value) AS mean, min(value) AS mn, max(value) AS mx, max(CASE WHEN k = CAST(round_even(0.5::DOUBLE * (n - 1), 0) AS BIGINT) THEN value END) AS med FROM r WHERE variable = 'x1')
SELECT unnest(['MEAN', 'MEDIAN', 'RANGE', 'MIDRANGE', 'SUM']) AS method, round(unnest([mean, med, mn, (mx - mn) / 2, 0]), 4) AS value FROM q""")
def impute_table(spark, d):
    s = numeric.summarise(model_table(spark, d), ["x1"], "y")["x1"]
    return _r(spark.createDataFrame([(m, float(numeric.default_impute(s, m))) for m in ("MEAN", "MEDIAN", "RANGE", "MIDRANGE", "SUM")], "method string, value double"), 4)


@query(_M + "SELECT CAST(o1 AS DOUBLE) AS lo, CAST(o1 AS DOUBLE) AS hi, count(*) AS xcount, round(avg(y), 6) AS xmean FROM (SELECT CASE WHEN o1 < 7 THEN o1 END AS o1, y FROM m) GROUP BY o1")
def profile_levels(spark, d):
    return _r(profiles.profile_levels(model_table(spark, d).withColumn("o1", F.expr("CASE WHEN o1 < 7 THEN o1 END")), "o1", "y"))


_QCUT = _M + """, e AS (SELECT list_sort(list_distinct(quantile_cont(x1, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM m
), c AS (SELECT x1, y, CASE WHEN x1 IS NOT NULL THEN CAST(greatest(len(list_filter(e.e, lambda v: v < x1)), 1) AS BIGINT) END AS bin FROM m, e)
"""


@query(_QCUT + "SELECT bin, round(min(x1), 6) AS lo, round(max(x1), 6) AS hi, count(*) AS xcount, round(avg(y), 6) AS xmean FROM c GROUP BY 1")
def profile_qcut(spark, d):
    return _r(profiles.profile_bins(model_table(spark, d), "x1", "y", 10))


_WIDTH = _M + """, e AS (SELECT quantile_cont(x1, 0.01) AS a, quantile_cont(x1, 0.99) AS z FROM m
), c AS (SELECT x1, y, CAST(CASE WHEN x1 IS NULL THEN NULL WHEN x1 < a THEN 1 WHEN x1 >= e.z THEN 10 ELSE floor((x1 - a) / ((e.z - a) / 10)) + 1 END AS BIGINT) AS bin FROM m, e)
"""


@query(_WIDTH + "SELECT bin, round(min(x1), 6) AS lo, round(max(x1), 6) AS hi, count(*) AS xcount, round(avg(y), 6) AS xmean FROM c GROUP BY 1")
def profile_equal_width(spark, d):
    return _r(profiles.profile_bins(model_table(spark, d), "x1", "y", 10, equal_width=True))


_REPORT = """, o AS (SELECT count(*) AS n, avg(y) AS a FROM m), rep AS (
  SELECT 'Overall' AS category, a AS average_dv, n AS count, 1.0::DOUBLE AS percent, 100.0::DOUBLE AS idx, '' AS star FROM o
  UNION ALL SELECT category, xmean, xcount, xcount / n, xmean / a * 100, CASE WHEN xmean / a * 100 >= 110 THEN '* (+)' WHEN xmean / a * 100 > 100 THEN '  (+)' WHEN xmean / a * 100 > 90 THEN '  (-)' WHEN xmean / a * 100 <= 90 THEN '* (-)' ELSE '  (0)' END FROM prof, o)
SELECT '{var}' AS variable, category, round(average_dv, 6) AS average_dv, count, round(percent, 6) AS percent, round(idx, 6) AS idx, star FROM rep"""


@query(_M + ", prof AS (SELECT coalesce(CAST(o1 AS VARCHAR), 'Missing') AS category, count(*) AS xcount, avg(y) AS xmean FROM m GROUP BY 1)" + _REPORT.format(var="o1"))
def profile_report(spark, d):
    m = model_table(spark, d)
    n, mean = profiles.overall(m, "y")
    levels = profiles.profile_levels(m, "o1", "y").withColumn("category", F.coalesce(F.col("lo").cast("int").cast("string"), F.lit("Missing")))
    return _r(profiles.report(levels, "o1", n, mean))


_TRUE = "coalesce(trim(b1) IN ('True', 'TRUE', '1', 'Y', 'y'), false)"


@query(_M + f"SELECT rid, CAST({_TRUE} AS INTEGER) AS \"R1_b1\" FROM m")
def binary_recode(spark, d):
    m = model_table(spark, d)
    roles = Roles(id="rid", dep_var="y", bin_vars=("b1",))
    return fit_recode(m, roles, RecodeConfig(profiling=False)).apply(m, roles).select("rid", "R1_b1")


@query(_M + f", prof AS (SELECT CAST(CAST({_TRUE} AS INTEGER) AS VARCHAR) AS category, count(*) AS xcount, avg(y) AS xmean FROM m GROUP BY 1)" + _REPORT.format(var="b1"))
def binary_profile(spark, d):
    return _r(fit_recode(model_table(spark, d), Roles(id="rid", dep_var="y", bin_vars=("b1",))).profile)


@query(_M + "SELECT n1 AS level, count(*) AS dcount, round(avg(y), 6) AS dmean, round(var_samp(y), 6) AS dvar FROM m GROUP BY 1")
def nominal_level_stats(spark, d):
    return _r(profiles.level_stats(model_table(spark, d), "n1", "y"))


@query(_M + """, o AS (SELECT count(*) AS n, avg(y) AS a FROM m), g AS (SELECT CASE WHEN n1 IS NULL THEN 1 WHEN n1 LIKE 'A%' THEN 2 ELSE 3 END AS g, avg(y) AS mean FROM m GROUP BY 1)
SELECT rid, round(mean / a * 100, 6) AS score FROM m JOIN g ON g.g = CASE WHEN n1 IS NULL THEN 1 WHEN n1 LIKE 'A%' THEN 2 ELSE 3 END, o""")
def nominal_map(spark, d):
    m = model_table(spark, d)
    n, mean = profiles.overall(m, "y")
    stats = {r.level: r for r in profiles.level_stats(m, "n1", "y").collect()}
    groups = [[None], [v for v in stats if v and v[0] == "A"], [v for v in stats if v and v[0] != "A"]]
    means = [sum(stats[v].dcount * stats[v].dmean for v in g) / sum(stats[v].dcount for v in g) for g in groups]
    made = nominal.Nominal(groups, means, [x / mean * 100 for x in means])
    return _r(m.select("rid", made.score("n1").alias("score")))


@query(_M + "".join(f"{' UNION ALL ' if i else ''} SELECT '{v}' AS variable, round(regr_slope(z, {v}), 4) AS slope, round(regr_intercept(z, {v}), 4) AS intercept, round(regr_r2(z, {v}), 6) AS r2, CASE WHEN regr_slope(z, {v}) > 0 THEN '(+)' ELSE '(-)' END AS sign FROM m" for i, v in enumerate(["x2", "x5", "x6", "o1"])))
def ols_univariate(spark, d):
    fits = regression.univariate(model_table(spark, d), ["x2", "x5", "x6", "o1"], "z", binary=False)
    return spark.createDataFrame([(v, f.slope, f.intercept, f.r2, f.sign) for v, f in fits.items()], "variable string, slope double, intercept double, r2 double, sign string").select("variable", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "sign")


@query(_M + " UNION ALL ".join(f"SELECT '{v}' AS variable, round(abs(corr(y, {v})), 6) AS corr, CAST(abs(corr(y, {v})) >= 0.05::DOUBLE AS INTEGER) AS corrsource FROM m" for v in NUMBERS))
def dep_correlation(spark, d):
    found = moments.correlation_with(model_table(spark, d), NUMBERS, "y")
    return _r(spark.createDataFrame(list(found.items()), "variable string, corr double").withColumn("corrsource", voting.flag(F.col("corr") >= 0.05)))


@query(_M + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM m" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def corr_matrix_long(spark, d):
    c = moments.pairwise(model_table(spark, d), NUMBERS).correlation()
    return _r(spark.createDataFrame([(a, b, float(c[i, j])) for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS) if i < j], "a string, b string, r double"))


@query(_M + """, c AS (SELECT sum(w) AS sw, sum(w * x5) / sum(w) AS m5, sum(w * x6) / sum(w) AS m6 FROM m)
SELECT round(any_value(sw), 2) AS weight, round(any_value(m5), 6) AS mean5, round(any_value(m6), 6) AS mean6, round(sum(w * (x5 - m5) * (x6 - m6)) / any_value(sw), 6) AS cov,
round(sum(w * (x5 - m5) * (x6 - m6)) / sqrt(sum(w * (x5 - m5) * (x5 - m5)) * sum(w * (x6 - m6) * (x6 - m6))), 6) AS corr FROM m, c""")
def weighted_moments(spark, d):
    g = moments.gram(model_table(spark, d), ["x5", "x6"], "w")
    return spark.createDataFrame([(round(float(g.weight), 2), float(g.mean[0]), float(g.mean[1]), float(g.products[0, 1] / g.weight), float(g.correlation()[0, 1]))], "weight double, mean5 double, mean6 double, cov double, corr double").select("weight", *[F.round(c, 6).alias(c) for c in ("mean5", "mean6", "cov", "corr")])


@query(_M + _LONG + " SELECT variable, count(value) AS count, round(min(value), 6) AS minimum, round(max(value), 6) AS maximum, round(avg(value), 4) AS mean FROM long GROUP BY 1")
def basic_stats_long(spark, d):
    return profiles.basic_stats(model_table(spark, d), LONG).select("variable", "count", F.round("minimum", 6).alias("minimum"), F.round("maximum", 6).alias("maximum"), F.round("mean", 4).alias("mean"))


_VOTES = _M + ", v AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST(coalesce(abs(corr(y, {v})) >= 0.05::DOUBLE, false) AS INTEGER) AS corrsource, CAST(coalesce(regr_r2(z, {v}) >= 0.3::DOUBLE, false) AS INTEGER) AS r2source, coalesce(abs(corr(y, {v})), 0) AS dv_corr FROM m" for v in NUMBERS) + ")"


def _master(spark, d):
    m = model_table(spark, d)
    corr = moments.correlation_with(m, NUMBERS, "y")
    fits = regression.univariate(m, NUMBERS, "z", binary=False)
    sources = {
        "corrsource": spark.createDataFrame([(v, int(r is not None and r >= 0.05)) for v, r in corr.items()], "variable string, corrsource int"),
        "r2source": spark.createDataFrame([(v, int(f.r2 >= 0.3)) for v, f in fits.items() if f.r2 >= 0.3], "variable string, r2source int"),
    }
    out = voting.vote(spark.createDataFrame([(v,) for v in NUMBERS], "variable string"), sources)
    return out.join(F.broadcast(spark.createDataFrame([(v, r or 0.0) for v, r in corr.items()], "variable string, dv_corr double")), "variable", "left")


@query(_VOTES + "SELECT variable, corrsource, r2source, corrsource + r2source AS num_sources FROM v")
def source_vote(spark, d):
    return _master(spark, d).select("variable", "corrsource", "r2source", "num_sources")


@query(_VOTES + "SELECT variable, round(dv_corr, 6) AS dv_corr, CASE WHEN dv_corr > 0.5::DOUBLE THEN 'Y' ELSE '' END AS drop_dv_corr FROM v")
def dv_corr_drop(spark, d):
    return _r(_master(spark, d).select("variable", "dv_corr", F.when(F.col("dv_corr") > 0.5, "Y").otherwise("").alias("drop_dv_corr")))


@query(_VOTES + "SELECT variable, corrsource + r2source AS num_sources FROM v WHERE (corrsource + r2source >= 2 OR r2source = 1) AND NOT dv_corr > 0.9::DOUBLE")
def final_select(spark, d):
    m = _master(spark, d).withColumn("drop_dv_corr", F.when(F.col("dv_corr") > 0.9, "Y").otherwise(""))
    return voting.select(m, 2, ("r2source",)).select("variable", "num_sources")


@query(_M + "SELECT o1, count(*) AS n, round(avg(y) / (SELECT avg(y) FROM m) * 100, 6) AS idx FROM m WHERE x1 IS NOT NULL GROUP BY 1")
def index_of_levels(spark, d):
    m = model_table(spark, d)
    mean = profiles.overall(m, "y")[1]
    return _r(rows.complete_rows(m, ["x1", "y"]).groupBy("o1").agg(F.count("*").alias("n"), F.avg("y").alias("a")).select("o1", "n", index(F.col("a"), F.lit(mean)).alias("idx")))


def _newton(source: str, steps: int = 12) -> str:
    """CTEs of logistic fits of y on x by k in ``source`` (k, x, y): fit (k, intercept, slope, wald, stat, r2).

    Newton's method from the log odds of the mean, on standardised x, a fixed
    number of steps.
    """
    sums = "sum(y - mu) AS u0, sum((y - mu) * z) AS u1, sum(mu * (1 - mu)) AS h00, sum(mu * (1 - mu) * z) AS h01, sum(mu * (1 - mu) * z * z) AS h11, sum(y * ln(mu) + (1 - y) * ln(1 - mu)) AS ll"
    at = f"SELECT k, any_value(a) AS a, any_value(b) AS b, any_value(mx) AS mx, any_value(sx) AS sx, any_value(my) AS my, count(*) AS n, {sums} FROM (SELECT d.k, y, a, b, mx, sx, my, (x - mx) / sx AS z, 1 / (1 + exp(-(a + b * (x - mx) / sx))) AS mu FROM {source} d JOIN facts f ON f.k = d.k JOIN {{prev}} s ON s.k = d.k) GROUP BY k"
    out = [f"facts AS MATERIALIZED (SELECT k, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM {source} GROUP BY k)", "s0 AS (SELECT k, ln(my / (1 - my)) AS a, 0.0::DOUBLE AS b FROM facts)"]
    for i in range(steps):
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT k, a + (h11 * u0 - h01 * u1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * u1 - h01 * u0) / (h00 * h11 - h01 * h01) AS b FROM ({at.format(prev=f's{i}')}))")
    out.append(f"fit AS MATERIALIZED (SELECT k, a - b / sx * mx AS intercept, b / sx AS slope, b / sqrt(h00 / (h00 * h11 - h01 * h01)) AS wald, 2 * (ll - nul) AS stat, 1 - ll / nul AS r2 FROM (SELECT *, n * (my * ln(my) + (1 - my) * ln(1 - my)) AS nul FROM ({at.format(prev=f's{steps}')})))")
    return ", ".join(out)


def _two_sided(z: str) -> str:
    """Two-sided tail of the normal law by the series of the error function; below a millionth it is 0."""
    x = f"(abs({z}) / sqrt(2))"
    return f"CASE WHEN {x} > 3.7 THEN 0 WHEN {x} < 1e-8 THEN 1 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 100), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln({x}) - lgamma(n + 1)) / (2 * n + 1))) END"


@query(_M + _LONG + ", src AS (SELECT variable AS k, value AS x, y FROM (SELECT y, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LONG) + " FROM m) UNPIVOT (value FOR variable IN (" + ", ".join(LONG) + "))), " + _newton("src") + f" SELECT k AS variable, round(intercept, 6) AS intercept, round(slope, 8) AS slope, round({_two_sided('wald')}, 6) AS p, round(stat, 4) AS stat, round(r2, 6) AS r2 FROM fit")
def logit_univariate(spark, d):
    fits = regression.univariate(model_table(spark, d), LONG, "y", binary=True)
    return spark.createDataFrame([(v, round(f.intercept, 6), round(f.slope, 8), round(f.p, 6), round(f.stat, 4), round(f.r2, 6)) for v, f in fits.items()], "variable string, intercept double, slope double, p double, stat double, r2 double")


_TERMS = {"": "v", "SQ_": "v * v", "SR_": "sqrt(greatest(v, 0))", "LN_": "ln(greatest(v, 1e-5))"}
#: best: the best transform of each numeric variable with its line, and what missing values get by equal response.
_BEST = _BOUNDS + ", capped AS (SELECT variable, greatest(least(value, ub), lb) AS v, y FROM (SELECT variable, value, y FROM (SELECT y, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMBERS) + " FROM m) UNPIVOT (value FOR variable IN (" + ", ".join(NUMBERS) + "))) JOIN bounds USING (variable)), src AS (" + " UNION ALL ".join(f"SELECT variable || '|{i}{p}' AS k, {e} AS x, y FROM capped" for i, (p, e) in enumerate(_TERMS.items())) + "), " + _newton("src", 25) + """
, picked AS (
  SELECT split_part(k, '|', 1) AS variable, substr(split_part(k, '|', 2), 2) AS transform, intercept, slope, wald,
         row_number() OVER (PARTITION BY split_part(k, '|', 1) ORDER BY CASE WHEN abs(wald) > 38.5 THEN 1e9 ELSE abs(wald) END DESC, split_part(k, '|', 2)) AS place
  FROM fit
), gone AS (""" + " UNION ALL ".join(f"SELECT '{v}' AS variable, count(*) - count({v}) AS missing, avg(CASE WHEN {v} IS NULL THEN y END) AS rate FROM m" for v in NUMBERS) + """
), er AS (
  SELECT p.*, missing, p50, lb, ub, (ln(greatest(least(rate, 0.9999::DOUBLE), 0.0001::DOUBLE) / (1 - greatest(least(rate, 0.9999::DOUBLE), 0.0001::DOUBLE))) - intercept) / slope AS goal
  FROM picked p JOIN gone USING (variable) JOIN bounds USING (variable) WHERE place = 1
), best AS (
  SELECT variable, transform, wald, CASE WHEN missing < 500 OR abs(wald) < 1.959963984540054 THEN p50 ELSE
    greatest(least(CASE transform WHEN '' THEN goal WHEN 'SQ_' THEN sqrt(greatest(goal, 0)) WHEN 'SR_' THEN goal * goal ELSE exp(goal) END, ub), lb) END AS impute
  FROM er
)"""


@query(_BEST + f" SELECT variable, transform, round({_two_sided('wald')}, 6) AS p, round(impute, 4) AS impute FROM best")
def best_transform(spark, d):
    found = numeric.process(model_table(spark, d), NUMBERS, "y", binary=True, method="ER", transforms=True, min_size=500)
    return spark.createDataFrame([(v, s.prefix, round(s.fit.p, 6), round(s.impute, 4)) for v, s in found.items()], "variable string, transform string, p double, impute double")


@query(_BEST + " SELECT rid, y, round(coalesce(x1, impute), 4) AS \"R1_x1\" FROM m, best WHERE variable = 'x1'")
def er_impute(spark, d):
    m = model_table(spark, d)
    roles = Roles(id="rid", dep_var="y", cont_vars=("x1",))
    return _r(fit_recode(m, roles, RecodeConfig(impmethodC="ER", profiling=False)).apply(m, roles), 4)


#: final: levels of n1 with their final group, and each group's mean.
_COLLAPSE = _M.replace("WITH b", "WITH RECURSIVE b", 1) + """, whole AS (SELECT count(*) AS nobs, avg(y) AS a, CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT) AS least FROM m
), lv AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY dmean, level NULLS LAST) AS rn FROM (SELECT n1 AS level, count(*) AS dcount, avg(y) AS dmean, var_samp(y) AS dvar FROM m GROUP BY 1)
), bc AS (
  SELECT rn, 1 AS g, dcount AS size, dcount AS seen FROM lv WHERE rn = 1
  UNION ALL
  SELECT l.rn, CASE WHEN size <= least OR seen >= nobs - least THEN g ELSE g + 1 END, CASE WHEN size <= least OR seen >= nobs - least THEN size + dcount ELSE dcount END, seen + dcount
  FROM bc JOIN lv l ON l.rn = bc.rn + 1, whole
), grp AS MATERIALIZED (SELECT g, sum(dcount)::DOUBLE AS n, arg_min(dmean, rn) AS mean, arg_min(dvar, rn) AS var FROM bc JOIN lv USING (rn) GROUP BY g
), tt AS (
  SELECT g, 1 AS fg, n, mean, var FROM grp WHERE g = 1
  UNION ALL
  SELECT g, CASE WHEN apart THEN fg + 1 ELSE fg END, CASE WHEN apart THEN n ELSE fn + n END, CASE WHEN apart THEN mean ELSE (fn * fmean + n * mean) / (fn + n) END, CASE WHEN apart THEN var ELSE pooled END
  FROM (
    -- The upper 5 % point of Student's t, expanded around the normal one.
    SELECT g, fg, n, mean, var, fn, fmean, pooled, abs(fmean - mean) / sqrt(pooled * (1 / fn + 1 / n)) >= 1.6448536269514722 + (1.6448536269514722 ^ 3 + 1.6448536269514722) / (4 * df) + (5 * 1.6448536269514722 ^ 5 + 16 * 1.6448536269514722 ^ 3 + 3 * 1.6448536269514722) / (96 * df * df) AS apart
    FROM (SELECT q.g, tt.fg, q.n, q.mean, q.var, tt.n AS fn, tt.mean AS fmean, tt.n + q.n - 2 AS df, ((tt.n - 1) * tt.var + (q.n - 1) * q.var) / (tt.n + q.n - 2) AS pooled FROM tt JOIN grp q ON q.g = tt.g + 1))
), final AS MATERIALIZED (SELECT level, rn, fg, dcount, dmean, sum(dcount * dmean) OVER f / sum(dcount) OVER f AS fmean FROM bc JOIN lv USING (rn) JOIN tt USING (g) WINDOW f AS (PARTITION BY fg))
"""


@query(_COLLAPSE + "SELECT fg AS fgroup, level, round(fmean, 6) AS mean FROM final")
def nominal_collapse(spark, d):
    m = model_table(spark, d)
    n, mean = profiles.overall(m, "y")
    made = nominal.collapse(profiles.level_stats(m, "n1", "y"), n, mean)
    return _r(spark.createDataFrame([(i, v, x) for i, (g, x) in enumerate(zip(made.groups, made.means), 1) for v in g], "fgroup int, level string, mean double"))


@query(_COLLAPSE + "SELECT rid, y, round(fmean / a * 100, 6) AS \"R1_n1\" FROM m JOIN final ON n1 IS NOT DISTINCT FROM level, whole")
def nominal_recode(spark, d):
    m = model_table(spark, d)
    roles = Roles(id="rid", dep_var="y", nom_vars=("n1",))
    return _r(fit_recode(m, roles, RecodeConfig(profiling=False)).apply(m, roles))


def many_level_table(spark: SparkSession, d: str) -> DataFrame:
    """The modelling rows with the part a line item is of as a nominal variable; every seventh row's part is one and the same."""
    li = _t(spark, d, "lineitem")
    part = F.when(F.col("l_partkey") % 7 == 0, "common").when(F.col("l_partkey") % 11 != 0, F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    high = F.col("l_extendedprice") + 1000 * F.col("l_quantity") + 37 * (F.col("l_partkey") % 500) > 86000
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", part.alias("pk"), high.cast("int").alias("y"))


_MANY = _COLLAPSE[_COLLAPSE.index(", whole AS"):].replace("n1 AS level", "pk AS level")
_MANY = """WITH RECURSIVE m AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 7 = 0 THEN 'common' WHEN l_partkey % 11 <> 0 THEN 'p' || l_partkey END AS pk,
    CAST(l_extendedprice + 1000 * l_quantity + 37 * (l_partkey % 500) > 86000 AS INTEGER) AS y FROM lineitem
)""" + _MANY


@query(_MANY + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, y, round(fmean / a * 100, 6) AS \"R1_pk\" FROM m JOIN final ON pk IS NOT DISTINCT FROM level, whole")
def nominal_many_levels(spark, d):
    m = many_level_table(spark, d)
    roles = Roles(id="l_orderkey", dep_var="y", nom_vars=("pk",), keep_list=("l_linenumber", "l_partkey", "l_suppkey"))
    return _r(fit_recode(m, roles, RecodeConfig(profiling=False, valcnt=0, many_levels=500)).apply(m, roles))


@query(_COLLAPSE + ", prof AS (SELECT string_agg(coalesce(level, 'Missing'), ',' ORDER BY rn) AS category, CAST(sum(dcount) AS BIGINT) AS xcount, sum(dcount * dmean) / sum(dcount) AS xmean FROM final GROUP BY fg)" + _REPORT.format(var="n1"))
def nominal_profile(spark, d):
    return _r(fit_recode(model_table(spark, d), Roles(id="rid", dep_var="y", nom_vars=("n1",))).profile)


@query(_QCUT + """, g AS (SELECT bin, min(x1) AS lo, max(x1) AS hi, count(*) AS xcount, avg(y) AS xmean FROM c GROUP BY 1
), prof AS (SELECT CASE WHEN bin IS NULL THEN 'Missing' WHEN bin = 1 THEN 'Low to ' || hi WHEN bin = (SELECT max(bin) FROM g) THEN lo || ' to High' ELSE lo || ' to ' || hi END AS category, xcount, xmean FROM g)""" + _REPORT.format(var="x1"))
def profile_labels(spark, d):
    return _r(fit_recode(model_table(spark, d), Roles(id="rid", dep_var="y", cont_vars=("x1",))).profile)


@query("""SELECT CAST(floor(CASE WHEN resp >= 2000 THEN resp ELSE 2000 END / 0.1::DOUBLE) AS BIGINT) AS size, CAST(floor(CASE WHEN resp >= 100 THEN resp ELSE 100 END / 0.25::DOUBLE) AS BIGINT) AS small
FROM (SELECT count(*) * avg(CAST(o_orderstatus = 'P' AS INTEGER)) AS resp FROM orders)""")
def bootstrap_size(spark, d):
    n, rate = profiles.overall(_t(spark, d, "orders").withColumn("resp", (F.col("o_orderstatus") == "P").cast("int")), "resp")
    return spark.createDataFrame([(sampling.bootstrap_size(n, rate, 0.1, 2000), sampling.bootstrap_size(n, rate, 0.25, 100))], "size long, small long")


@query(f"""WITH yes AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), no AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), more AS ({_TOP.format(t='yes', n='(SELECT count(*) FROM orders)')})
SELECT * FROM more UNION ALL SELECT o_orderkey, 0 FROM (SELECT o_orderkey FROM no {_TAKE} (SELECT count(*) // 2 FROM orders))""")
def stratified_topup(spark, d):
    df = _t(spark, d, "orders").withColumn("resp", (F.col("o_orderstatus") == "P").cast("int"))
    n = df.count()
    part = lambda want, value: sampling.resize(df.where(F.col("resp") == value), ["o_orderkey"], want, SEED)
    return part(n, 1).unionByName(part(n // 2, 0)).select("o_orderkey", F.col(sampling.COPY).alias("copy"))


@query(_BOUNDS + ", v AS (SELECT max(CASE WHEN variable = 'x1' THEN lb END) AS a1, max(CASE WHEN variable = 'x1' THEN ub END) AS z1, max(CASE WHEN variable = 'x1' THEN p50 END) AS m1, max(CASE WHEN variable = 'x2' THEN lb END) AS a2, max(CASE WHEN variable = 'x2' THEN ub END) AS z2 FROM bounds) SELECT rid, y, round(greatest(least(coalesce(x1, m1), z1), a1), 4) AS \"R1_x1\", round(greatest(least(CAST(x2 AS DOUBLE), z2), a2), 4) AS \"R1_x2\" FROM m, v")
def continuous_recode(spark, d):
    m = model_table(spark, d)
    roles = Roles(id="rid", dep_var="y", cont_vars=("x1", "x2"))
    return _r(fit_recode(m, roles, RecodeConfig(profiling=False, cap_flrC=True, transformationC=False)).apply(m, roles), 4)


_ORD = "CASE WHEN o1 < 7 THEN CAST(o1 AS DOUBLE) END"
_ORDINAL = _BOUNDS.replace("CAST(o1 AS DOUBLE) AS o1", _ORD + " AS o1") + ", src AS (SELECT 'o' AS k, greatest(least(v, ub), lb) AS x, y FROM (SELECT " + _ORD + " AS v, y FROM m WHERE o1 < 7), (SELECT * FROM bounds WHERE variable = 'o1')), " + _newton("src") + """
, imp AS (SELECT CASE WHEN (SELECT count(*) FROM m WHERE o1 = 7) < 500 OR abs(wald) < 1.959963984540054 THEN p50 ELSE greatest(least((SELECT avg(o1) FROM m WHERE o1 < 7), ub), lb) END AS impute FROM fit, (SELECT * FROM bounds WHERE variable = 'o1'))
"""


@query(_ORDINAL + " SELECT rid, y, round(coalesce(" + _ORD + ", impute), 6) AS \"R1_o1\" FROM m, imp")
def ordinal_recode(spark, d):
    m = model_table(spark, d).withColumn("o1", F.expr("CASE WHEN o1 < 7 THEN o1 END"))
    roles = Roles(id="rid", dep_var="y", ord_vars=("o1",))
    return _r(fit_recode(m, roles, RecodeConfig(profiling=False)).apply(m, roles))


@query(_M + " UNION ALL ".join(f"SELECT '{n}' AS variable, coalesce(min(CASE WHEN {c} IS NOT NULL THEN y END) <> max(CASE WHEN {c} IS NOT NULL THEN y END), false) AS varies FROM m" for n, c in (("x1", "x1"), ("b1", "b1"), ("only", "(CASE WHEN y = 1 THEN x2 END)"))))
def varying_target(spark, d):
    m = model_table(spark, d).withColumn("only", F.when(F.col("y") == 1, F.col("x2")))
    return spark.createDataFrame(list(profiles.varying_target(m, ["x1", "b1", "only"], "y").items()), "variable string, varies boolean")


# Forward selection by t tests on what the chosen variables leave of all others; a step takes the residuals of the one before.
def _forward(steps: int) -> str:
    every = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [*NUMBERS, "y"])
    some = " AND ".join(f"{c} IS NOT NULL" for c in NUMBERS)
    out = [f"r0 AS MATERIALIZED (SELECT rid, variable, value - avg(value) OVER (PARTITION BY variable) AS v FROM (SELECT rid, {every} FROM m WHERE {some}) UNPIVOT (value FOR variable IN ({', '.join([*NUMBERS, 'y'])})))",
           "full_size AS MATERIALIZED (SELECT variable, sum(v * v) AS s FROM r0 GROUP BY 1)", "n AS (SELECT count(*) AS n FROM r0 WHERE variable = 'y')"]
    for i in range(1, steps + 1):
        t = "b * sqrt(sxx) / sqrt(greatest(syy - b * sxy, 0) / df)"
        out.append(f"""c{i} AS MATERIALIZED (SELECT variable, df, sxx, {t} AS t, row_number() OVER (ORDER BY CASE WHEN abs({t}) > 39 THEN 1e9 ELSE abs({t}) END DESC, variable) AS place
  FROM (SELECT a.variable, any_value(n) - {i + 1} AS df, sum(a.v * a.v) AS sxx, sum(a.v * b.v) AS sxy, sum(a.v * b.v) / sum(a.v * a.v) AS b, sum(b.v * b.v) AS syy, any_value(s) AS s FROM r{i - 1} a JOIN r{i - 1} b ON b.rid = a.rid AND b.variable = 'y' JOIN full_size f ON f.variable = a.variable, n WHERE a.variable <> 'y' GROUP BY 1)
  WHERE sxx > 1e-10 * s)""")
        out.append(f"p{i} AS MATERIALIZED (SELECT variable, {i} AS step, {_two_sided('(abs(t) * (1 - 1 / (4 * df)) / sqrt(1 + t * t / (2 * df)))')} AS p FROM c{i} WHERE place = 1)")
        out.append(f"""r{i} AS MATERIALIZED (SELECT rid, a.variable, a.v - k * c.v AS v FROM r{i - 1} a JOIN (SELECT rid, v FROM r{i - 1} WHERE variable = (SELECT variable FROM p{i})) c USING (rid)
  JOIN (SELECT a.variable, sum(a.v * c.v) / sum(c.v * c.v) AS k FROM r{i - 1} a JOIN (SELECT rid, v FROM r{i - 1} WHERE variable = (SELECT variable FROM p{i})) c USING (rid) GROUP BY 1) USING (variable) WHERE a.variable <> (SELECT variable FROM p{i}))""")
    steps_sql = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, steps + 1))
    return _M + ", " + ", ".join(out) + f", al AS ({steps_sql}) SELECT variable, CAST(step AS INTEGER) AS step, round(p, 4) AS p FROM al WHERE step < coalesce((SELECT min(step) FROM al WHERE p > 0.05), 99)"


@query(_forward(4))
def stepwise_linear(spark, d):
    return _r(spark.createDataFrame([(v, s, float(p)) for v, s, p in stepwise.stepwise_linear(model_table(spark, d), NUMBERS, "y", 0.05)], "variable string, step int, p double"), 4)


@query(_M.replace("WITH b", "WITH RECURSIVE b", 1) + ", pair AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, abs(corr({a}, {b})) > 0.7::DOUBLE AS high FROM m" for i, a in enumerate(NUMBERS, 1) for j, b in enumerate(NUMBERS, 1) if i != j) + """
), g AS MATERIALIZED (SELECT list(partners ORDER BY i) AS partners FROM (SELECT i, coalesce(list(j ORDER BY j) FILTER (high), []) AS partners FROM pair GROUP BY i)
), st AS MATERIALIZED (SELECT [""" + ", ".join(f"coalesce(abs(corr(y, {v})), -1)" for v in NUMBERS) + "] AS strength FROM m), walk AS (SELECT 0 AS turn, [" + ", ".join(str(i) for i in range(1, len(NUMBERS) + 1)) + """] AS there
  UNION ALL
  SELECT turn + 1, list_filter(there, lambda x: NOT list_contains(partners[keep], x)) FROM (
    SELECT turn, there, partners, CAST(list_max(list_transform(many, lambda x: [strength[x], -x]))[2] * -1 AS INTEGER) AS keep FROM (
      SELECT turn, there, partners, strength, list_filter(there, lambda x: len(list_intersect(partners[x], there)) > 1) AS many FROM walk, g, st) WHERE len(many) > 0)
) SELECT variable, CASE WHEN list_contains((SELECT arg_max(there, turn) FROM walk), place) THEN '' ELSE 'Y' END AS drop_corr FROM (VALUES """ + ", ".join(f"('{v}', {i})" for i, v in enumerate(NUMBERS, 1)) + ") v(variable, place)")
def corr_prune(spark, d):
    m = model_table(spark, d)
    dropped = voting.prune(NUMBERS, [(i, j) for i, j, _ in moments.strong_pairs(m, NUMBERS, 0.7)], moments.correlation_with(m, NUMBERS, "y"))
    return spark.createDataFrame([(v, "Y" if v in dropped else "") for v in NUMBERS], "variable string, drop_corr string")


#: The first component by power steps from the correlation matrix; vectors as lists.
_POWER = ["x1", "x2", "x3", "x5"]


@query(_M.replace("WITH b", "WITH RECURSIVE b", 1) + ", s AS (SELECT * FROM m WHERE " + " AND ".join(f"{v} IS NOT NULL" for v in _POWER) + "), r AS MATERIALIZED (SELECT [" + ", ".join("[" + ", ".join("1.0::DOUBLE" if a == b else f"corr({a}, {b})" for b in _POWER) + "]" for a in _POWER) + """] AS c FROM s
), pw AS (
  SELECT 0 AS turn, [1.0::DOUBLE, 0.7, 0.5, 0.3] AS v
  UNION ALL
  SELECT turn + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT turn, list_transform(c, lambda row: list_dot_product(row, v)) AS w FROM pw, r) WHERE turn < 400
), top AS (SELECT v, list_dot_product(v, list_transform(c, lambda row: list_dot_product(row, v))) AS value FROM pw, r WHERE turn = 400)
SELECT unnest([""" + ", ".join(f"'{v}'" for v in _POWER) + "]) AS variable, round(unnest(list_transform(v, lambda x: abs(x) * sqrt(value))), 6) AS factor FROM top")
def first_component(spark, d):
    return _r(spark.createDataFrame(list(principal(model_table(spark, d), _POWER, 1, 0.5).items()), "variable string, factor double"))


def _leading(source: str, k: int, tag: str) -> str:
    """CTEs that end in ``<tag>factor`` (grp, i, factor): each variable's largest correlation with the first k components.

    ``source`` has (grp, ids, c): a group's variables and its correlation matrix as
    lists.  A matrix squared again and again is the product of its first vector
    with itself; what that explains is taken off, and the rest gives the next one.
    """
    out, names = [f"{tag}d1 AS MATERIALIZED (SELECT grp, ids, c FROM {source})"], []
    for j in range(1, k + 1):
        d, q, e = f"{tag}d{j}", f"{tag}q{j}", f"{tag}e{j}"
        square = "list_transform(p, lambda r: list_transform(p, lambda s: list_dot_product(r, s)))"
        out.append(f"""{q} AS (
  SELECT grp, 0 AS turn, c AS p FROM {d}
  UNION ALL
  SELECT grp, turn + 1, list_transform(w, lambda r: list_transform(r, lambda x: x / list_sum(list_transform(w, lambda z: list_max(list_transform(z, lambda y: abs(y)))))))
  FROM (SELECT grp, turn, {square} AS w FROM {q} WHERE turn < 14)
)""")
        out.append(f"""{e} AS MATERIALIZED (
  SELECT grp, ids, c, v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS value FROM (
    SELECT grp, ids, c, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM (
      SELECT {d}.grp, ids, c, list_transform(p, lambda r: list_sum(list_transform(r, lambda x, i: x / (i + 0.37)))) AS w FROM {d} JOIN {q} ON {d}.grp = {q}.grp AND turn = 14))
)""")
        out.append(f"{tag}d{j + 1} AS MATERIALIZED (SELECT grp, ids, list_transform(c, lambda r, i: list_transform(r, lambda x, k: x - value * v[i] * v[k])) AS c FROM {e})")
        names.append(f"SELECT grp, unnest(ids) AS i, unnest(list_transform(v, lambda x: abs(x) * sqrt(greatest(value, 0)))) AS part FROM {e}")
    return ", ".join([*out, f"{tag}factor AS MATERIALIZED (SELECT grp, i, max(part) AS factor FROM ({' UNION ALL '.join(names)}) GROUP BY 1, 2)"])


@query(_M.replace("WITH b", "WITH RECURSIVE b", 1) + ", s AS (SELECT * FROM m WHERE " + " AND ".join(f"{v} IS NOT NULL" for v in NUMBERS) + "), r AS MATERIALIZED (SELECT 1 AS grp, [" + ", ".join(f"'{v}'" for v in NUMBERS) + "] AS ids, [" + ", ".join("[" + ", ".join("1.0::DOUBLE" if a == b else f"corr({a}, {b})" for b in NUMBERS) + "]" for a in NUMBERS) + "] AS c FROM s), " + _leading("r", 2, "t") + " SELECT i AS variable, round(factor, 6) AS factor FROM tfactor")
def pca_screen(spark, d):
    return _r(spark.createDataFrame(list(principal(model_table(spark, d), NUMBERS, 2, 0.5).items()), "variable string, factor double"))


_MATRIX = "SELECT grp, list(i ORDER BY i) AS ids, list(c ORDER BY i) AS c FROM (SELECT grp, i, list(r ORDER BY k) AS c FROM {pairs} GROUP BY 1, 2) GROUP BY 1"


@query("""WITH RECURSIVE e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings
), pairs AS MATERIALIZED (SELECT a.i AS i, b.i AS k, CASE WHEN a.i = b.i THEN 1 ELSE corr(a.x, b.x) END AS r FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2
), near AS (SELECT i // 16 AS grp, i, k, r FROM pairs WHERE i // 16 = k // 16
), first AS MATERIALIZED (""" + _MATRIX.format(pairs="near") + "), " + _leading("first", 4, "t") + """
, alive AS (SELECT 1 AS grp, p.i, p.k, r FROM pairs p JOIN tfactor f ON f.i = p.i AND f.factor >= 0.2 JOIN tfactor g ON g.i = p.k AND g.factor >= 0.2
), second AS MATERIALIZED (""" + _MATRIX.format(pairs="alive") + "), " + _leading("second", 4, "u") + " SELECT 'e' || i AS variable, round(factor, 6) AS factor FROM ufactor")
def embedding_components(spark, d):
    e = _t(spark, d, "embeddings").select(*[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(64)])
    return _r(spark.createDataFrame(list(principal(e, e.columns, 4, 0.2).items()), "variable string, factor double"))


_STEPS = ["x2", "x4", "x5", "o1"]
_CENTRED = _M + ", src AS (SELECT rid, k, x - avg(x) OVER (PARTITION BY k) AS x, y FROM (SELECT rid, y, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _STEPS) + " FROM m) UNPIVOT (x FOR k IN (" + ", ".join(_STEPS) + "))), "


@query(_CENTRED + _newton("src") + f""", one AS (
  SELECT k, sum(x * (y - a)) ^ 2 / (any_value(a) * (1 - any_value(a)) * sum(x * x)) AS chi FROM src, (SELECT avg(y) AS a FROM m) GROUP BY k
), entered AS (SELECT arg_max(k, chi) AS k, max(chi) AS chi FROM one
), model AS (SELECT s.rid, s.x AS b, s.y, 1 / (1 + exp(-(f.intercept + f.slope * s.x))) AS mu FROM src s JOIN fit f ON f.k = s.k WHERE s.k = (SELECT k FROM entered)
), two AS (
  SELECT s.k, sum(s.x * (s.y - mu)) AS u, sum(v) AS s0, sum(v * b) AS s1, sum(v * b * b) AS s2, sum(v * x) AS c0, sum(v * x * b) AS c1, sum(v * x * x) AS h
  FROM (SELECT *, mu * (1 - mu) AS v FROM model) JOIN src s USING (rid) WHERE s.k <> (SELECT k FROM entered) GROUP BY 1
), tested AS (SELECT k, u * u / (h - (c0 * c0 * s2 - 2 * c0 * c1 * s1 + c1 * c1 * s0) / (s0 * s2 - s1 * s1)) AS chi FROM two
), steps AS (SELECT k AS variable, 1 AS step, chi FROM entered UNION ALL SELECT arg_max(k, chi), 2, max(chi) FROM tested)
SELECT variable, step, round({_two_sided('sqrt(chi)')}, 6) AS p FROM steps WHERE chi >= 3.841458820694124""")
def stepwise_logistic(spark, d):
    return _r(spark.createDataFrame([(v, s, float(p)) for v, s, p in stepwise.stepwise_logistic(model_table(spark, d), _STEPS, "y", 0.05)], "variable string, step int, p double"))


# Iterative: checked against plain code in the tests.


@query()
def var_clusters(spark, d):
    return spark.createDataFrame([(v, c, float(r)) for v, c, r in clusters(model_table(spark, d), NUMBERS, 4, 0.5)], "variable string, cluster int, ratio double")


@query()
def full_pipeline(spark, d):
    roles = Roles(id="rid", dep_var="y", bin_vars=("b1",), nom_vars=("n1",), ord_vars=("o1",), cont_vars=("x1", "x2", "x3", "x4"))
    labelled, _ = sample(model_table(spark, d), roles, SampleConfig())
    made = fit_recode(labelled, roles, RecodeConfig(profiling=False))
    return reduce_variables(made.apply(labelled, roles), roles, ReduceConfig(samplesize=None, sources=2, decile=10))[0]
