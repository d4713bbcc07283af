"""Exact quantiles and rank bins of many variables at once, by successive narrowing.

A quantile is a value at which the running weight of the sorted values passes a
threshold.  One scan sketches all variables and brackets every threshold between
two values; a second counts what lies below and between the brackets and keeps
only the values inside, summed by value.  These few are ordered, so a threshold's
value is exact.  Where a bracket still holds many values, or a sketch has missed,
the bracket alone is sketched and counted again.  No scan shuffles the distinct
values of a variable.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import SPAN, draw

#: Accuracy of sketches: a sketch's value is off by a 10,000th of the rows at most.
ACCURACY = 10_000
#: A bracket reaches so many such errors to both sides.
MARGIN = 2
#: A bracket of more rows than this is narrowed again before its values are ordered.
FINAL_ROWS = 1_000_000
#: Cut points that narrow a bracket where ranks are not known beforehand.
SPLITS = 32
#: Variables of one sketch or one scan.
TOGETHER = 40
#: Tied rows that a bin edge parts are numbered in ranges of their draws of about so many rows.
ROWS_A_RANGE = 50_000
#: Seed of the draws that put tied rows in order.
TIE_SEED = 0
_BEFORE = (Window.unboundedPreceding, -1)


@dataclass
class Crossing:
    """The value at which a threshold is passed: weight of smaller values, of this one, and its rows."""

    value: float
    before: float
    weight: float
    rows: int


@dataclass
class Spread:
    """What is known of a variable: rows, weight, about how many distinct values, and the crossings of its thresholds."""

    rows: int = 0
    total: float = 0
    about_distinct: int = 0
    at: dict[float, Crossing] = field(default_factory=dict)


@dataclass
class _Open:
    """A bracket [low, high) of a variable in which thresholds lie: weight below it, its rows if known."""

    low: float
    high: float
    before: float
    rows: int
    wanted: list[float]


def _numbers(df: DataFrame, columns: list[str], weight: str | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """w, one double a column, nan as null, and the kept columns, which must have other names."""
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1).cast("long")
    made = df.select(w.alias("w"), *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)], *keep)
    made = made.where("w is not null") if weight else made
    return made.select("w", *[F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")).alias(f"v{i}") for i in range(len(columns))], *keep)


def _after(x: float) -> float:
    return float(np.nextafter(x, math.inf))


_COUNTED = pa.schema([("i", pa.int32()), ("cell", pa.int32()), ("value", pa.float64()), ("n", pa.int64()), ("w", pa.float64())])
#: Values inside brackets that a task holds before it sums equal ones.
PENDING = 1 << 18


def _summed_values(x: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and weights of equal values together."""
    values, at = np.unique(x, return_inverse=True)
    return values, np.bincount(at, n, len(values)).astype(np.int64), np.bincount(at, w, len(values))


def _cells(data: DataFrame, cuts: dict[int, list[float]], inside: dict[int, set[int]]) -> DataFrame:
    """Rows (i, cell, value, n, w): rows and weight by the number of a variable's cut points that are at most the value; by value too in the cells ``inside``.

    A task counts in numpy and returns one row a cell, and one a value inside.
    """
    points = {i: np.array(c, np.float64) for i, c in cuts.items()}
    kept = {i: np.isin(np.arange(len(c) + 1), list(inside.get(i, ()))) for i, c in cuts.items()}
    names = sorted(cuts)

    def run(batches):
        rows, weights = ({i: np.zeros(len(kept[i])) for i in names} for _ in range(2))
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {i: [] for i in names}
        pending = dict.fromkeys(names, 0)
        for batch in batches:
            w = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            for k, i in enumerate(names, 1):
                x = batch.column(k).to_numpy(zero_copy_only=False)
                there = ~np.isnan(x)
                x, own = x[there], w[there]
                cell = np.searchsorted(points[i], x, "right")
                rows[i] += np.bincount(cell, minlength=len(rows[i]))
                weights[i] += np.bincount(cell, own, len(rows[i]))
                some = kept[i][cell]
                if some.any():
                    held[i].append(_summed_values(x[some], np.ones(int(some.sum())), own[some]))
                    pending[i] += len(held[i][-1][0])
                    if pending[i] > PENDING:
                        held[i] = [_summed_values(*(np.concatenate(p) for p in zip(*held[i])))]
                        # Only when the values have doubled is it worth another look.
                        pending[i] = 0 if len(held[i][0][0]) > PENDING // 2 else len(held[i][0][0])
        for i in names:
            out = np.flatnonzero(~kept[i] & (rows[i] > 0))
            parts = [(out, np.full(len(out), np.nan), rows[i][out], weights[i][out])]
            if held[i]:
                x, n, own = _summed_values(*(np.concatenate(p) for p in zip(*held[i])))
                parts.append((np.searchsorted(points[i], x, "right"), x, n, own))
            for cell, x, n, own in parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(cell.astype(np.int32)), pa.array(x, from_pandas=True), pa.array(n.astype(np.int64)), pa.array(own)], schema=_COUNTED)

    return data.select(F.col("w").cast("double").alias("w"), *[f"v{i}" for i in names]).mapInArrow(run, "i int, cell int, value double, n long, w double").groupBy("i", "cell", "value").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def _sketch(data: DataFrame, asked: list[tuple[int, float, float, list[float]]], also: list[Column] = ()) -> tuple[list[list[float]], list, list]:
    """Approximate values of (variable, low, high, shares of the rows in [low, high)); each variable's rows, weight and distinct values; and the aggregates ``also`` of the same scan."""
    out, facts, more = [], [], []
    for at in range(0, max(len(asked), 1), TOGETHER):
        exprs = []
        for i, low, high, shares in asked[at : at + TOGETHER]:
            x = F.col(f"v{i}")
            whole = low == -math.inf and high == math.inf
            some = x if whole else F.when((x >= low) & ((x < high) if high < math.inf else F.lit(True)), x)
            there = F.when(x.isNotNull(), F.col("w"))
            exprs += [F.percentile_approx(some, shares, ACCURACY), *((F.count(x), F.sum(there), F.approx_count_distinct(x)) if whole else (F.lit(0), F.lit(0), F.lit(0)))]
        size = len(exprs)
        row = data.agg(*[e.alias(f"e{k}") for k, e in enumerate([*exprs, *(also if at == 0 else ())])]).first()
        out += [row[k] or [] for k in range(0, size, 4)]
        facts += [row[k + 1 : k + 4] for k in range(0, size, 4)]
        more += row[size:]
    return out, facts, more


def crossings(df: DataFrame, columns: list[str], shares: list[float], exact: Callable[[float, int], list[float]], weight: str | None = None, also: list[Column] | None = None, keep: tuple[str, ...] = ()) -> dict[str, Spread]:
    """For each column with a value the crossings of the thresholds ``exact(total weight, rows)``: the value with before < threshold <= before + weight.

    ``shares`` says about where the thresholds lie, as shares of the rows; with
    weights they are found without that.  Null and nan values, and rows without
    weight, count for nothing.  Thresholds outside the total have no crossing.
    ``also`` are aggregates over the columns ``keep`` that the first scan answers
    too; their values take the place of the expressions in that list.
    """
    data = _numbers(df, columns, weight, keep)
    found: dict[str, Spread] = {}
    error = MARGIN / ACCURACY
    even = [k / SPLITS for k in range(1, SPLITS)]
    first = even if weight else sorted({min(max(q + d, 0.0), 1.0) for q in shares for d in (-error, error)})
    points, facts, more = _sketch(data, [(i, -math.inf, math.inf, first) for i in range(len(columns))], also or [])
    if also:
        also[:] = more
    cuts: dict[int, list[float]] = {}
    inside: dict[int, set[int]] = {}
    open_: dict[int, list[_Open]] = {}
    for i, (values, (rows, total, distinct)) in enumerate(zip(points, facts)):
        if not rows:
            continue
        s = found[columns[i]] = Spread(rows, total, distinct)
        wanted = sorted({t for t in exact(total, rows) if 0 < t <= total})
        if not wanted:
            continue
        open_[i] = [_Open(-math.inf, math.inf, 0, rows, wanted)]
        cuts[i] = sorted({y for x in values for y in (x, _after(x))})
        if not weight and 3 * error * rows < FINAL_ROWS:
            at = dict(zip(first, values))
            spans = [(-math.inf if q - error <= 0 else at[max(q - error, 0.0)], math.inf if q + error >= 1 else at[min(q + error, 1.0)]) for q in shares]
            edges = [-math.inf, *cuts[i]]
            inside[i] = {k for k, low in enumerate(edges) if any(a <= low <= b or (a == -math.inf and low == -math.inf) for a, b in spans)}
        elif rows <= FINAL_ROWS:
            # So few rows that they are ordered whole.
            cuts[i], inside[i] = [], {0}
    while open_:
        _settle(data, columns, cuts, inside, open_, found, weight)
        cuts, inside = _narrower(data, open_, even)
    return found


def _settle(data: DataFrame, columns: list[str], cuts: dict, inside: dict, open_: dict[int, list[_Open]], found: dict[str, Spread], weight: str | None) -> None:
    """Count cells, answer what lies in cells whose values are known, and leave the rest open in narrower brackets."""
    names = sorted(open_)
    for at in range(0, len(names), TOGETHER):
        part = names[at : at + TOGETHER]
        counts = _cells(data, {i: cuts[i] for i in part}, {i: inside.get(i, set()) for i in part}).persist()
        try:
            cells: dict[int, dict[int, tuple[int, float, bool]]] = {i: {} for i in part}
            for r in counts.groupBy("i", "cell").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("value").alias("known")).collect():
                cells[r.i][r.cell] = (r.n, r.w, r.known > 0)
            asked = []
            for i in part:
                edges, still = [-math.inf, *cuts[i], math.inf], []
                below = dict(zip(sorted(cells[i]), np.concatenate([[0], np.cumsum([cells[i][k][1] for k in sorted(cells[i])])]).tolist()))
                for t in (t for o in open_[i] for t in o.wanted):
                    reached = [k for k in sorted(cells[i]) if below[k] < t]
                    k = reached[-1]
                    n, w, known = cells[i][k]
                    low, high = edges[k], edges[k + 1]
                    if known:
                        asked.append((i, k, t, t - below[k], below[k]))
                    elif high == _after(low):
                        found[columns[i]].at[t] = Crossing(low, below[k], w, n)
                    elif still and (still[-1].low, still[-1].high) == (low, high):
                        still[-1].wanted.append(t)
                    else:
                        still.append(_Open(low, high, below[k], n, [t]))
                open_[i] = still
            if asked:
                spark = data.sparkSession
                goals = spark.createDataFrame([(i, k, float(t), float(here), float(base)) for i, k, t, here, base in asked], "i int, cell int, goal double, here double, base double")
                mine = counts.join(F.broadcast(goals.select("i", "cell").distinct()), ["i", "cell"], "left_semi")
                upto = mine.withColumn("before", F.coalesce(F.sum("w").over(Window.partitionBy("i", "cell").orderBy("value").rowsBetween(*_BEFORE)), F.lit(0)).cast("double"))
                last = upto.withColumn("_next", F.lead("value").over(Window.partitionBy("i", "cell").orderBy("value")))
                hit = (F.col("before") < F.col("here")) & ((F.col("here") <= F.col("before") + F.col("w")) | F.col("_next").isNull())
                for r in last.join(F.broadcast(goals), ["i", "cell"]).where(hit).collect():
                    s = found[columns[r.i]]
                    if r.goal not in s.at or s.at[r.goal].value > r.value:
                        s.at[r.goal] = Crossing(r.value, r.base + r.before if weight else int(r.base + r.before), r.w, r.n)
        finally:
            counts.unpersist()
    for i in [i for i in open_ if not open_[i]]:
        del open_[i]


def _narrower(data: DataFrame, open_: dict[int, list[_Open]], even: list[float]) -> tuple[dict, dict]:
    """Cut points of the next scan: small brackets are kept whole, with their values; others are sketched."""
    large = [(i, o.low, o.high, even) for i, some in open_.items() for o in some if o.rows > FINAL_ROWS]
    points = _sketch(data, large)[0] if large else []
    cuts: dict[int, set[float]] = {i: set() for i in open_}
    for (i, _, _, _), values in zip(large, points):
        cuts[i] |= {y for x in values for y in (x, _after(x))}
    for i, some in open_.items():
        cuts[i] |= {x for o in some for x in (o.low, o.high) if math.isfinite(x)}
    made = {i: sorted(c) for i, c in cuts.items()}
    keep = {i: {k for k, low in enumerate([-math.inf, *made[i]]) if any(o.rows <= FINAL_ROWS and o.low <= low < o.high for o in some)} for i, some in open_.items()}
    return made, keep


def ranks(n: int, probs: list[float], method: str) -> list[tuple[int, int, float]]:
    """(lower rank, upper rank, part of the way between) of quantiles of n values, ranks from 0."""
    at = [float(q) * (n - 1) for q in probs]
    return [(round(x), round(x), 0.0) if method == "nearest" else (math.floor(x), math.ceil(x), x - math.floor(x)) for x in at]


def thresholds(n: int, probs: list[float], method: str) -> list[float]:
    """Running weights, a row weighing 1, at which those ranks are reached."""
    return [r + 1.0 for low, high, _ in ranks(n, probs, method) for r in (low, high)]


def picked(s: Spread, probs: list[float], method: str) -> list[float]:
    """Quantiles from the crossings of their thresholds."""
    found = [(s.at[low + 1.0].value, s.at[high + 1.0].value, part) for low, high, part in ranks(s.rows, probs, method)]
    return [a if a == b else a + (b - a) * part for a, b, part in found]


def quantiles(df: DataFrame, columns: list[str], probs: list[float], method: str = "nearest") -> DataFrame:
    """(variable, n, q0, q1, ...) of each column's values; columns without any have no row.

    ``nearest``: the value at rank q (n - 1), rounded half to even.  ``linear``:
    between the two neighbours of that rank.
    """
    spreads = crossings(df, columns, [float(q) for q in probs], lambda _, n: thresholds(n, probs, method)) if columns else {}
    rows = [(c, s.rows, *picked(s, probs, method)) for c, s in spreads.items()]
    return df.sparkSession.createDataFrame(rows, "variable string, n long" + "".join(f", q{i} double" for i in range(len(probs))))


@dataclass
class Cuts:
    """Where the rank bins of a variable change: cut values and the bin of each cell between them; a parted value's cell has none."""

    variable: str
    total: float
    points: list[float]
    bins: list[int | None]
    parted: list[Crossing]


def rank_cuts(spreads: dict[str, Spread], bins: int) -> dict[str, Cuts]:
    """Bins 0..bins-1 by running weight * bins div (total weight + 1), from the crossings of ``bin_edges``."""
    out = {}
    for v, s in spreads.items():
        number = lambda x, s=s: math.floor(x * bins / (s.total + 1))
        values = {c.value: c for c in s.at.values()}
        points, cells, parted = [], [0], []
        for x in sorted(values):
            c = values[x]
            first, last = number(c.before), number(c.before + c.weight)
            whole = first == last or c.rows == 1
            # Up to here nothing has changed since the last cut; the value itself has the bin its last row gets, if one row has it or all get the same.
            points += [x, _after(x)]
            cells += [last if whole else None, last]
            if not whole:
                parted.append(c)
        out[v] = Cuts(v, s.total, points, cells, parted)
    return out


def bin_edges(df: DataFrame, columns: list[str], bins: int, weight: str | None = None) -> dict[str, Spread]:
    """Crossings of the running weights at which rank bins change."""
    return crossings(df, columns, [b / bins for b in range(1, bins)], lambda total, _: [b * (total + 1) / bins for b in range(1, bins)], weight)


def tied_bins(long: DataFrame, cut: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Rows (variable, value, w, keys, ...) of the values in ``cut`` (variable, value, n, before, total), with their bins.

    Tied rows stand in the order of draws from their keys.  They are summed by
    ranges of the draws, then ordered inside each range, so a value that most
    rows share spreads over many tasks.  At most ``bins`` - 1 values of a
    variable are cut, so they are broadcast.
    """
    facts = cut.select("variable", "value", F.col("before").alias("_before"), F.col("total").alias("_total"), F.greatest(F.ceil(F.col("n") / ROWS_A_RANGE), F.lit(1)).alias("_ranges"))
    rows = long.join(F.broadcast(facts), ["variable", "value"]).withColumn("_draw", draw(TIE_SEED, *[F.col(k) for k in keys]))
    rows = rows.withColumn("_range", F.floor(F.col("_draw") * F.col("_ranges") / F.lit(float(SPAN))))
    part = ["variable", "value", "_range"]
    sums = rows.groupBy(*part).agg(F.sum("w").alias("_sum"))
    below = F.coalesce(F.sum("_sum").over(Window.partitionBy("variable", "value").orderBy("_range").rowsBetween(*_BEFORE)), F.lit(0))
    sums = sums.select(*part, below.alias("_below"))
    upto = F.sum("w").over(Window.partitionBy(*part).orderBy("_draw", *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_upto", upto).join(sums, part)
    made = F.floor((F.col("_before") + F.col("_below") + F.col("_upto")) * bins / (F.col("_total") + 1)).cast("long")
    return rows.withColumn("bin", made).drop("_before", "_total", "_ranges", "_draw", "_range", "_below", "_upto")


def parted_values(spark, cuts: list[Cuts]) -> DataFrame:
    """(variable, value, n, before, total) of the values that a bin's edge parts."""
    rows = [(c.variable, x.value, x.rows, float(x.before), float(c.total)) for c in cuts for x in c.parted]
    return spark.createDataFrame(rows, "variable string, value double, n long, before double, total double")


def rank_bins(df: DataFrame, column: str, keys: list[str], bins: int, weight: str | None = None, name: str = "bin") -> DataFrame:
    """Adds rank bins of one column; null values get a null bin. Ties stand in the order of draws from ``keys``."""
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    cuts = rank_cuts(bin_edges(df.where(w.isNotNull()), [column], bins, weight), bins).get(column)
    if cuts is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    x = F.col(f"`{column}`").cast("double")
    cell = sum((F.when(x >= F.lit(p), 1).otherwise(0) for p in cuts.points), F.lit(0))
    bin_of = F.when(x.isNotNull() & ~F.isnan(x), F.array(*[F.lit(b).cast("long") for b in cuts.bins])[cell])
    if not cuts.parted:
        return df.withColumn(name, bin_of)
    apart = F.coalesce(x.isin(*[c.value for c in cuts.parted]), F.lit(False))
    long = df.where(apart).select(F.lit(column).alias("variable"), x.alias("value"), w.alias("w"), *keys, F.struct(*df.columns).alias("_row"))
    tied = tied_bins(long, parted_values(df.sparkSession, [cuts]), keys, bins)
    return df.where(~apart).withColumn(name, bin_of).unionByName(tied.select("_row.*", F.col("bin").alias(name)))


def edges_bin(x: Column, edges: list[float]) -> Column:
    """1-based bin of right-closed intervals between increasing edges, the lowest included."""
    out = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(edges[1:], 1):
        out = out.when(x <= F.lit(float(edge)), i)
    return out.otherwise(F.lit(None).cast("int"))


def quantile_edges(df: DataFrame, columns: list[str], q: int) -> dict[str, list[float]]:
    """Distinct equal-frequency edges (linear quantiles) of each column."""
    rows = quantiles(df, columns, [i / q for i in range(q + 1)], "linear").collect()
    return {r.variable: sorted({r[f"q{i}"] for i in range(q + 1) if r[f"q{i}"] is not None}) for r in rows}


def width_bin(x: Column, low: Column | float, high: Column | float, k: int) -> Column:
    """1-based equal-width bins between low and high; below is 1, from high on is k."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    inner = F.floor(F.try_divide(x - low, (high - low) / k)) + 1
    return F.when(x.isNull(), None).when(x < low, 1).when(x >= high, k).otherwise(inner).cast("int")


def weighted_quantiles(df: DataFrame, column: str, weight: str, probs: list[float]) -> list[float | None]:
    """Values where the running weight reaches the shares ``probs`` of all weight, between neighbours by straight lines.

    Below the first value's own weight that value holds.  Rows without value or
    weight are left out; without any row every answer is None.
    """
    spread = crossings(df, [column], [], lambda total, _: [q * total for q in probs], weight).get(column)
    if spread is None:
        return [None] * len(probs)
    x, w = F.col(f"`{column}`").cast("double"), F.col(f"`{weight}`").cast("double")
    there = w.isNotNull() & ~F.isnan(x)
    starts = sorted({c.value for c in spread.at.values()})
    row = df.where(there).agg(F.min(x), *[F.max(F.when(x < v, x)) for v in starts]).first()
    lower = dict(zip(starts, row[1:]))
    out = []
    for q in probs:
        at = q * spread.total
        c = spread.at.get(at)
        if c is None:
            out.append(row[0])
        elif lower[c.value] is None or at == c.before + c.weight:
            out.append(c.value)
        else:
            out.append(lower[c.value] + (c.value - lower[c.value]) * (at - c.before) / c.weight)
    return out
