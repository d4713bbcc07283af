"""Profiles: how the target's mean goes with a variable's levels or bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import TRUE_PROFILE, TRUE_RECODE, index, is_true, star
from .quantiles import edges_bin, quantile_edges, quantiles, width_bin
from .rows import unpivoted

REPORT = "variable string, category string, average_dv double, count bigint, percent double, idx double, star string"


def overall(df: DataFrame, dep_var: str) -> tuple[int, float | None]:
    """(rows, mean target)."""
    return tuple(df.agg(F.count("*"), F.avg(dep_var)).first())


def column_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, miss_cnt, uniq_cnt, max_cnt): nulls, levels (null counts as one), rows of the largest level."""
    levels = unpivoted(df, columns).groupBy("variable", "value").agg(F.count("*").alias("n"))
    return levels.groupBy("variable").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("miss_cnt"), F.count("*").alias("uniq_cnt"), F.max("n").alias("max_cnt"))


def missing_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict() if columns else {}


def varying_target(df: DataFrame, columns: list[str], dep_var: str) -> dict[str, bool]:
    """Whether the target differs among the rows where the variable is present."""
    if not columns:
        return {}
    tests = [F.min(F.when(F.col(c).isNotNull(), F.col(dep_var))) != F.max(F.when(F.col(c).isNotNull(), F.col(dep_var))) for c in columns]
    return {c: bool(v) for c, v in zip(columns, df.agg(*tests).first())}


def basic_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, count, minimum, maximum, mean)."""
    long = unpivoted(df, columns, kind="double")
    return long.groupBy("variable").agg(F.count("value").alias("count"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"))


def level_stats(df: DataFrame, var: str, dep_var: str) -> DataFrame:
    """(level, dcount, dmean, dvar) of each level, null one of them."""
    return df.groupBy(F.col(var).alias("level")).agg(F.count("*").alias("dcount"), F.avg(dep_var).alias("dmean"), F.var_samp(dep_var).alias("dvar"))


def bin_stats(df: DataFrame, x: Column, bin_of: Column, dep_var: str) -> DataFrame:
    """(bin, lo, hi, xcount, xmean); the null bin holds the missing values."""
    return df.select(bin_of.cast("long").alias("bin"), x.cast("double").alias("x"), F.col(dep_var).alias("y")).groupBy("bin").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("xcount"), F.avg("y").alias("xmean"))


def profile_levels(df: DataFrame, var: str, dep_var: str) -> DataFrame:
    """Each value a bin of its own, with a row for missing values."""
    x = F.col(var).cast("double")
    return df.select(x.alias("x"), F.col(dep_var).alias("y")).groupBy("x").agg(F.count("*").alias("xcount"), F.avg("y").alias("xmean")).select(F.col("x").alias("lo"), F.col("x").alias("hi"), "xcount", "xmean")


def bins_of(df: DataFrame, variables: list[str], k: int = 10, equal_width: bool = False) -> dict[str, Column]:
    """Each variable's bin number: of equal frequency, or of equal width between the 1st and 99th percentile. One pass finds all edges."""
    if equal_width:
        found = {r.variable: (r.q0, r.q1) for r in quantiles(df, variables, [0.01, 0.99], "linear").collect()} if variables else {}
        return {v: width_bin(F.col(v).cast("double"), *found.get(v, (0.0, 0.0)), k) for v in variables}
    edges = quantile_edges(df, variables, k) if variables else {}
    return {v: edges_bin(F.col(v).cast("double"), edges.get(v, [])) for v in variables}


def profile_bins(df: DataFrame, var: str, dep_var: str, k: int = 10, equal_width: bool = False) -> DataFrame:
    """Equal-frequency bins, or equal-width bins between the 1st and 99th percentile."""
    return bin_stats(df, F.col(var).cast("double"), bins_of(df, [var], k, equal_width)[var], dep_var)


def bin_labels(bins: DataFrame) -> DataFrame:
    """Adds category: Missing, Low to b, a to b, a to High."""
    last = bins.agg(F.max("bin").alias("_last"))
    text = F.when(F.col("bin").isNull(), "Missing").when(F.col("bin") == 1, F.concat(F.lit("Low to "), F.col("hi").cast("string"))).when(F.col("bin") == F.col("_last"), F.concat(F.col("lo").cast("string"), F.lit(" to High")))
    text = text.otherwise(F.concat(F.col("lo").cast("string"), F.lit(" to "), F.col("hi").cast("string")))
    return bins.join(F.broadcast(last)).withColumn("category", text).drop("_last")


def report(rows: DataFrame, var: str, nobs: int, mean: float | None) -> DataFrame:
    """Report rows of (category, xcount, xmean), the overall row first among equals."""
    spark = rows.sparkSession
    schema = T.StructType.fromDDL(REPORT)
    top = spark.createDataFrame([(var, "Overall", mean, nobs, 1.0, 100.0, "")], schema)
    idx = index(F.col("xmean"), F.lit(mean).cast("double"))
    body = rows.select(F.lit(var).alias("variable"), "category", F.col("xmean").alias("average_dv"), F.col("xcount").alias("count"), F.try_divide(F.col("xcount").cast("double"), F.lit(nobs)).alias("percent"), idx.alias("idx"), star(idx).alias("star"))
    return top.unionByName(body)


def report_rows(spark, groups: list[tuple[str, str, int, float | None]], nobs: int, mean: float | None) -> DataFrame:
    """Report rows of groups (variable, category, count, mean target) that are known already, each variable's overall row first."""
    table = spark.createDataFrame(groups, "variable string, category string, xcount bigint, xmean double")
    idx = index(F.col("xmean"), F.lit(mean).cast("double"))
    body = table.select("variable", "category", F.col("xmean").alias("average_dv"), F.col("xcount").alias("count"), F.try_divide(F.col("xcount").cast("double"), F.lit(nobs)).alias("percent"), idx.alias("idx"), star(idx).alias("star"))
    top = spark.createDataFrame([(v, "Overall", mean, nobs, 1.0, 100.0, "") for v in dict.fromkeys(g[0] for g in groups)], T.StructType.fromDDL(REPORT))
    return top.unionByName(body)


@dataclass
class Profile:
    """What a variable's report rows are grouped by: text, and numbers if its rows are bins or levels of them."""

    variable: str
    group: Column
    value: Column | None = None
    bins: bool = False  # numbered bins, named after their extremes
    with_target: bool = False  # count rows with a target only


def report_all(df: DataFrame, parts: list[Profile], dep_var: str, nobs: int, mean: float | None) -> DataFrame | None:
    """Report rows of many variables by one aggregate over one long form of the table."""
    if not parts:
        return None
    no_value = F.lit(None).cast("double")
    items = [F.struct(F.lit(p.variable).alias("variable"), F.lit(p.bins).alias("bins"), F.lit(p.with_target).alias("with_target"), p.group.cast("string").alias("group"), (no_value if p.value is None else p.value.cast("double")).alias("x")) for p in parts]
    long = df.select(F.col(dep_var).alias("y"), F.explode(F.array(*items)).alias("i")).select("y", "i.*")
    rows = long.groupBy("variable", "bins", "with_target", "group").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("rows"), F.count("y").alias("targets"), F.avg("y").alias("xmean"))
    last = F.max(F.col("group").try_cast("int")).over(Window.partitionBy("variable"))
    number = lambda c: F.col(c).cast("string")
    between = F.when(F.col("at") == 1, F.concat(F.lit("Low to "), number("hi"))).when(F.col("at") == F.col("last"), F.concat(number("lo"), F.lit(" to High"))).otherwise(F.concat(number("lo"), F.lit(" to "), number("hi")))
    category = F.when(~F.col("bins"), F.col("group")).when(F.col("group").isNull(), "Missing").otherwise(between)
    rows = rows.withColumns({"last": last, "at": F.col("group").try_cast("int")}).withColumn("category", category)
    idx = index(F.col("xmean"), F.lit(mean).cast("double"))
    count = F.when(F.col("with_target"), F.col("targets")).otherwise(F.col("rows"))
    body = rows.select("variable", "category", F.col("xmean").alias("average_dv"), count.alias("count"), F.try_divide(count.cast("double"), F.lit(nobs)).alias("percent"), idx.alias("idx"), star(idx).alias("star"))
    top = df.sparkSession.createDataFrame([(p.variable, "Overall", mean, nobs, 1.0, 100.0, "") for p in parts], T.StructType.fromDDL(REPORT))
    return top.unionByName(body)


def binary_recode(var: str, dtype: str) -> Column:
    """1 for a true value, else 0; null gives 0."""
    return is_true(F.col(var), dtype, TRUE_RECODE).cast("int")


def binary_group(var: str, dtype: str) -> Column:
    """0 or 1 as text; reads more spellings of true than the recode."""
    return is_true(F.col(var), dtype, TRUE_PROFILE).cast("int").cast("string")
