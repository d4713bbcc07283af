"""Information value, Gini and KS of many variables over rank bins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import Cuts, bin_edges, parted_values, rank_cuts, tied_bins
from .rows import distinct_counts


#: A sketch counts so few distinct values exactly enough to tell that there are more than half of them.
_FEW = 4


_SUMS = pa.schema([("variable", pa.string()), ("bin", pa.float64()), ("n", pa.int64()), *((c, pa.float64()) for c in ("w", "sy", "my", "syw", "sx", "lx", "hx"))])


def _binned(names: list[str], cuts: list[Cuts | None]):
    """Sums of a task's rows (y, w, one column a variable) by variable and bin; a variable without cuts has its values for bins. Rows of parted values are left out."""
    points = [None if c is None else np.array(c.points) for c in cuts]
    bins = [None if c is None else np.array([np.nan if b is None else b for b in c.bins]) for c in cuts]

    def sums(y, w, x, made) -> np.ndarray:
        """Rows (bin, n, w, sy, my, syw, sx, lx, hx)."""
        values, at = np.unique(made, return_inverse=True)
        most, low, high = np.full(len(values), -np.inf), np.full(len(values), np.inf), np.full(len(values), -np.inf)
        np.maximum.at(most, at, y)
        np.minimum.at(low, at, x)
        np.maximum.at(high, at, x)
        count = lambda v=None: np.bincount(at, v, len(values))
        return np.column_stack([values, count(), count(w), count(y), most, count(y * w), count(x), low, high])

    def run(batches):
        held: list[np.ndarray | None] = [None] * len(names)
        for batch in batches:
            y, w = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (0, 1))
            for k in range(len(names)):
                x = batch.column(2 + k).to_numpy(zero_copy_only=False)
                made = x if points[k] is None else bins[k][np.searchsorted(points[k], x, "right")]
                there = ~np.isnan(x) & ~np.isnan(made)
                new = sums(y[there], w[there], x[there], made[there])
                if held[k] is not None:
                    both = np.concatenate([held[k], new])
                    values, at = np.unique(both[:, 0], return_inverse=True)
                    new = np.column_stack([values, *(np.bincount(at, both[:, c], len(values)) for c in range(1, 9))])
                    for c, best, start in ((4, np.maximum, -np.inf), (7, np.minimum, np.inf), (8, np.maximum, -np.inf)):
                        new[:, c] = start
                        best.at(new[:, c], at, both[:, c])
                held[k] = new
        for name, table in zip(names, held):
            if table is not None and len(table):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(table)), pa.array(table[:, 0]), pa.array(table[:, 1].astype(np.int64)), *(pa.array(table[:, c]) for c in range(2, 9))], schema=_SUMS)

    return run


def bin_tables(df: DataFrame, variables: list[str], dep_var: str, keys: list[str], decile: int = 10, weight: str | None = None) -> DataFrame:
    """(variable, bin, mean_dv, max_dv, mean_var, min_var, max_var, cnt, sum_dv) of rows with variable, target and weight.

    More than ``decile`` distinct values are cut by rank (or running weight);
    fewer are bins themselves.  The bins' edges come from a sketch and one count;
    then all variables go through one pass in long form, which sums rows by bin;
    only rows of values that a bin's edge parts are looked at one by one, in the
    order of draws from ``keys``.
    """
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    some = df.na.drop(subset=[dep_var, *([weight] if weight else [])])
    base = some.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{dep_var}`").cast("double").alias("y"), w.alias("w"), *[F.col(f"`{v}`").cast("double").alias(f"v{i}") for i, v in enumerate(variables)])
    base = base.withColumns({f"v{i}": F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")) for i in range(len(variables))})
    columns, order = [f"v{i}" for i in range(len(variables))], [f"k{i}" for i in range(len(keys))]
    spreads = bin_edges(base, columns, decile, "w" if weight else None)
    maybe = [v for v, s in spreads.items() if s.about_distinct <= _FEW * decile]
    few = {v for v, n in distinct_counts(base, maybe).items() if n <= decile}
    known = [v for v in columns if v in spreads]
    cuts = list(rank_cuts({v: spreads[v] for v in known}, decile).values())

    def summed(rows: DataFrame, *by: str) -> DataFrame:
        x = F.col("x")
        return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum("y").alias("sy"), F.max("y").alias("my"), F.sum(F.col("y") * F.col("w")).alias("syw"), F.sum(x).alias("sx"), F.min(x).alias("lx"), F.max(x).alias("hx"))

    if not cuts:
        return df.sparkSession.createDataFrame([], "variable string, bin double, mean_dv double, max_dv double, mean_var double, min_var double, max_var double, cnt double, sum_dv double")
    by_value = [None if v in few else c for v, c in zip(known, cuts)]
    rows = base.select("y", "w", *known).mapInArrow(_binned([variables[int(v[1:])] for v in known], by_value), "variable string, bin double, n long, w double, sy double, my double, syw double, sx double, lx double, hx double")
    parts = rows.groupBy("variable", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "w", "sy")], F.max("my").alias("my"), F.sum("syw").alias("syw"), F.sum("sx").alias("sx"), F.min("lx").alias("lx"), F.max("hx").alias("hx"))
    # Values that an edge parts: their rows, by draws.
    parted = [c for c in cuts if c.parted and c.variable not in few]
    if parted:
        items = F.array(*[F.struct(F.lit(c.variable).alias("variable"), F.when(F.col(c.variable).isin(*[x.value for x in c.parted]), F.col(c.variable)).alias("value")) for c in parted])
        rows = base.select(*order, "y", "w", F.explode(items).alias("_i")).select(*order, "y", "w", "_i.*").where("value is not null")
        tied = summed(tied_bins(rows, parted_values(df.sparkSession, parted), order, decile).withColumn("x", F.col("value")), "variable", "bin")
        real = F.create_map(*[F.lit(z) for c in parted for z in (c.variable, variables[int(c.variable[1:])])])
        parts = parts.unionByName(tied.withColumn("variable", real[F.col("variable")]).withColumn("bin", F.col("bin").cast("double")))
    total = F.sum("n")
    return parts.groupBy("variable", "bin").agg((F.sum("sy") / total).alias("mean_dv"), F.max("my").alias("max_dv"), (F.sum("sx") / total).alias("mean_var"), F.min("lx").alias("min_var"), F.max("hx").alias("max_var"), F.sum("w").alias("cnt"), F.sum("syw").alias("sum_dv"))


def bin_table(df: DataFrame, var: str, dep_var: str, keys: list[str], decile: int = 10, weight: str | None = None) -> DataFrame:
    """The bins of one variable."""
    return bin_tables(df, [var], dep_var, keys, decile, weight).drop("variable")


def with_total(bins: DataFrame) -> DataFrame:
    """The bins and a row without bin for all of them together."""
    total = bins.agg(F.lit(None).cast("double").alias("bin"), F.try_divide(F.sum("sum_dv"), F.sum("cnt")).alias("mean_dv"), F.max("max_dv").alias("max_dv"), *[F.lit(None).cast("double").alias(c) for c in ("mean_var", "min_var", "max_var")], F.sum("cnt").alias("cnt"), F.sum("sum_dv").alias("sum_dv"))
    return total.unionByName(bins)


def bin_metrics(bins: DataFrame, set_size: int = 1) -> DataFrame:
    """Adds to (variable, bin, mean_dv, max_dv, cnt, sum_dv): shares br, gr, contribution, and running Gini and KS terms.

    The windows run over the few bins of each variable.
    """
    per = Window.partitionBy("variable")
    order = per.orderBy("bin")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = bins.withColumns({"_total": F.sum("sum_dv").over(per), "_resp": F.sum(F.col("cnt") * F.col("mean_dv")).over(per), "_n": F.sum("cnt").over(per), "_max": F.max("max_dv").over(per)})
    resp = F.col("cnt") * F.col("mean_dv")
    b = b.withColumn("br", F.try_divide(resp, F.col("_resp"))).withColumn("gr", F.try_divide(F.col("cnt") - F.try_divide(resp, F.col("_max")), F.col("_n") - F.try_divide(F.col("_resp"), F.col("_max"))))
    both, either = F.col("br") * F.col("gr") != 0, F.col("br") + F.col("gr") != 0
    gain = F.when(both, (F.col("br") - F.col("gr")) * F.ln(F.greatest(F.try_divide(F.col("br"), F.col("gr")), F.lit(1e-5)))).when(either, F.col("cnt") / F.lit(float(set_size)) * F.greatest("br", "gr")).otherwise(F.when(F.col("br").isNotNull() & F.col("gr").isNotNull(), F.lit(0.0)))
    b = b.withColumns({"contribution": gain, "cr": F.sum("br").over(upto), "cf": F.sum(F.col("cnt") / F.col("_n")).over(upto), "cg": F.sum("gr").over(upto)})
    b = b.withColumns({"_cr": F.lag("cr").over(order), "_cf": F.lag("cf").over(order)})
    area = F.coalesce(2 * ((F.col("cf") + F.col("_cf")) / 2 - (F.col("cr") + F.col("_cr")) / 2) * (F.col("cf") - F.col("_cf")), F.lit(0.0))
    return b.withColumns({"area": area, "gap": F.abs(F.col("cr") - F.col("cg"))})


def information(df: DataFrame, variables: list[str], dep_var: str, keys: list[str], decile: int = 10, set_size: int = 1, weight: str | None = None) -> DataFrame:
    """(variable, infv, gini, ks); all null when no row responds or every row does."""
    if not variables:
        return df.sparkSession.createDataFrame([], "variable string, infv double, gini double, ks double")
    parts = bin_tables(df, variables, dep_var, keys, decile, weight)
    m = bin_metrics(parts, set_size)
    found = m.groupBy("variable").agg(F.sum("contribution").alias("infv"), F.sum(F.when(F.col("br").isNotNull() & F.col("gr").isNotNull(), F.col("area"))).alias("gini"), F.max("gap").alias("ks"))
    return found
