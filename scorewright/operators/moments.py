"""Sums of products of many columns: one pass, one small matrix per task, added up by position."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 16_384
_SUMS = pa.schema([("k", pa.int32()), ("v", pa.float64())])


def summed(df: DataFrame, columns: list[str], size: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``add(block)``, a vector of ``size``; block: rows x columns in double, null as nan.

    Each task returns ``size`` numbers, which are added up by position in a
    shuffle with map-side combine; the driver gets ``size`` rows.
    """

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                block = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns])
                total += add(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], schema=_SUMS)

    data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = data.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[rows.column("k").to_numpy()] = rows.column("v").to_numpy()
    return out


@contextlib.contextmanager
def batches_for(spark: SparkSession, columns: int) -> Iterator[None]:
    """While a pass over a wide table runs: no more rows in a batch to Python than make some 4 million numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before) if int(before) > 0 else BATCH_ROWS, max(64, (1 << 22) // max(columns, 1)))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def means(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Means of present values, 0 where there are none; they only centre later sums."""
    found: list[float | None] = []
    for at in range(0, len(columns), 500):
        found += df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns[at : at + 500])]).first()
    return np.array([0.0 if v is None or v != v else v for v in found])


@dataclass
class Pairs:
    """Sums over rows where both columns of a pair are present (p x p each), around fixed centres."""

    names: list[str]
    n: np.ndarray
    sx: np.ndarray  # sum of the row's column
    sxx: np.ndarray
    sxy: np.ndarray

    def covariance(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.sxy / self.n - (self.sx / self.n) * (self.sx.T / self.n)

    def correlation(self) -> np.ndarray:
        """Pairwise-complete Pearson correlation; nan for constants or fewer than two rows."""
        with np.errstate(invalid="ignore", divide="ignore"):
            var = self.sxx / self.n - (self.sx / self.n) ** 2
            floor = 1e-13 * np.maximum(self.sxx / self.n, 1e-300)
            var = np.where(var > floor, var, np.nan)
            out = self.covariance() / np.sqrt(var * var.T)
        out[self.n < 2] = np.nan
        return np.clip(out, -1, 1)


def pairwise(df: DataFrame, columns: list[str]) -> Pairs:
    """Moments of all pairs, each over the rows where both are present."""
    p, centre = len(columns), means(df, columns)

    def add(x: np.ndarray) -> np.ndarray:
        m = ~np.isnan(x)
        z = np.where(m, x - centre, 0.0)
        m = m.astype(np.float64)
        return np.concatenate([(m.T @ m).ravel(), (z.T @ m).ravel(), ((z * z).T @ m).ravel(), (z.T @ z).ravel()])

    s = summed(df, columns, 4 * p * p, add).reshape(4, p, p)
    return Pairs(list(columns), *s)


#: Variables of a block; a tile holds the moments of the pairs of two blocks.
BLOCK = 128
#: Numbers that a task holds at once; more tiles take more passes.
HELD = 1 << 24
_TILE = "tile int, slice int, v binary"
_TILE_ROWS = pa.schema([("tile", pa.int32()), ("slice", pa.int32()), ("v", pa.binary())])


def strong_pairs(df: DataFrame, columns: list[str], least: float) -> list[tuple[int, int, float]]:
    """(i, j, r) of the pairs i < j of columns whose absolute correlation, each over the rows where both are present, exceeds ``least``.

    The triangle of pairs is cut into tiles of two blocks of columns.  A task adds
    up its rows' moments tile by tile and returns each row of a tile as one packed
    vector; those of one row meet in a shuffle, where the correlations are made,
    and only strong ones go on.  Neither a task nor the driver holds all pairs.
    """
    p, width = len(columns), BLOCK
    blocks = math.ceil(p / width)
    tiles = [(a, b) for a in range(blocks) for b in range(a, blocks)]
    centre, spark, out = means(df, columns), df.sparkSession, []
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def add(part: list[int]):
        def run(batches):
            totals = {t: 0.0 for t in part}
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
                there = ~np.isnan(x)
                z, m = np.where(there, x - centre, 0.0), there.astype(np.float64)
                for t in part:
                    a, b = (slice(k * width, (k + 1) * width) for k in tiles[t])
                    za, ma, zb, mb = z[:, a].T, m[:, a].T, z[:, b], m[:, b]
                    totals[t] = totals[t] + np.stack([ma @ mb, za @ mb, (za * za) @ mb, ma @ zb, ma @ (zb * zb), za @ zb], 1)
            for t in part:
                if not np.isscalar(totals[t]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(totals[t]), t, np.int32)), pa.array(np.arange(len(totals[t]), dtype=np.int32)), pa.array([row.tobytes() for row in totals[t]], pa.binary())], schema=_TILE_ROWS)

        return run

    def decide(table: pa.Table) -> pa.Table:
        t, i = table.column("tile")[0].as_py(), table.column("slice")[0].as_py()
        n, sx, sxx, sy, syy, sxy = sum(np.frombuffer(v.as_py(), np.float64) for v in table.column("v")).reshape(6, -1)
        i, j = tiles[t][0] * width + i, tiles[t][1] * width + np.arange(len(n))
        r = _correlation(n, sx, sxx, sy, syy, sxy)
        hit = np.flatnonzero((j > i) & (np.abs(np.nan_to_num(r)) > least))
        return pa.table({"i": pa.array(np.full(len(hit), i, np.int32)), "j": pa.array(j[hit].astype(np.int32)), "r": pa.array(r[hit])})

    step = max(1, HELD // (6 * width * width))
    with batches_for(spark, p):
        for at in range(0, len(tiles), step):
            sums = data.mapInArrow(add(list(range(at, min(at + step, len(tiles))))), _TILE)
            out += [tuple(r) for r in sums.groupBy("tile", "slice").applyInArrow(decide, "i int, j int, r double").collect()]
    return sorted(out)


def _correlation(n, sx, sxx, sy, syy, sxy) -> np.ndarray:
    """Pearson correlations from sums around fixed centres; nan for constants or fewer than two rows."""
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = (np.where(q / n - (s / n) ** 2 > 1e-13 * np.maximum(q / n, 1e-300), q / n - (s / n) ** 2, np.nan) for s, q in ((sx, sxx), (sy, syy)))
        r = (sxy / n - (sx / n) * (sy / n)) / np.sqrt(vx * vy)
    return np.clip(np.where(n < 2, np.nan, r), -1, 1)


def correlation_products(df: DataFrame, columns: list[str], weight: str | None = None) -> tuple[float, Callable[[np.ndarray], np.ndarray]]:
    """(weight of the rows where every column is present, a function that multiplies their correlation matrix by a block).

    The matrix itself is never made: a pass sums z' w (z Q) of standardised rows z,
    as many numbers a task as the block has.  Constants have a correlation of 0.
    """
    p = len(columns)
    used = [*columns, *([weight] if weight else [])]
    full = df.na.drop(subset=used).select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(used)])
    centre, weigh = means(full, [f"c{i}" for i in range(p)]), weight is not None

    def rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :p] - centre, x[:, p] if weigh else np.ones(len(x))

    def moments(x: np.ndarray) -> np.ndarray:
        z, w = rows(x)
        return np.concatenate([[w.sum()], w @ z, w @ (z * z)])

    names = [f"c{i}" for i in range(len(used))]
    with batches_for(df.sparkSession, p):
        s = summed(full, names, 1 + 2 * p, moments)
    total = float(s[0])
    mean = s[1 : 1 + p] / total if total else np.zeros(p)
    var = s[1 + p :] / total - mean**2 if total else np.zeros(p)
    varies = var > 1e-24 * np.maximum(centre**2, 1e-300)
    scale = np.where(varies, np.sqrt(np.where(varies, var, 1.0)), np.inf)

    def multiply(block: np.ndarray) -> np.ndarray:
        k = block.shape[1]

        def add(x: np.ndarray) -> np.ndarray:
            z, w = rows(x)
            z = (z - mean) / scale
            return (z.T @ (w[:, None] * (z @ block))).ravel()

        with batches_for(df.sparkSession, p):
            return summed(full, names, p * k, add).reshape(p, k) / total

    return total, multiply


@dataclass
class Gram:
    """Weighted moments over complete rows: rows, weight, means, centred products; ``seen`` counts all rows, complete or not."""

    names: list[str]
    rows: float
    weight: float
    mean: np.ndarray
    products: np.ndarray
    seen: float = 0.0

    def correlation(self) -> np.ndarray:
        """Correlation matrix; rows and columns of constants are 0."""
        cov = self.products / self.weight if self.weight else self.products
        var = np.diag(cov)
        varies = var > 1e-24 * np.maximum(self.mean**2, 1e-300)
        inverse = np.where(varies, 1 / np.sqrt(np.where(varies, var, 1.0)), 0.0)
        return cov * inverse[:, None] * inverse

    def part(self, names: list[str]) -> Gram:
        i = [self.names.index(n) for n in names]
        return Gram(list(names), self.rows, self.weight, self.mean[i], self.products[np.ix_(i, i)], self.seen)


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> Gram:
    """Moments of the rows where every column, and the weight, is present."""
    p = len(columns)
    centre = means(df, columns)

    def add(x: np.ndarray) -> np.ndarray:
        seen = len(x)
        x = x[~np.isnan(x).any(1)]
        w = x[:, p] if weight else np.ones(len(x))
        z = x[:, :p] - centre
        return np.concatenate([[seen, len(x), w.sum()], (z * w[:, None]).sum(0), ((z * w[:, None]).T @ z).ravel()])

    s = summed(df, [*columns, *([weight] if weight else [])], 3 + p + p * p, add)
    seen, rows, total, first, second = s[0], s[1], s[2], s[3 : 3 + p], s[3 + p :].reshape(p, p)
    shift = first / total if total else first
    return Gram(list(columns), rows, total, centre + shift, second - total * np.outer(shift, shift), seen)


def signed_correlation_with(df: DataFrame, columns: list[str], dep_var: str) -> dict[str, float | None]:
    """Pearson correlation of each column with the target; None where it isn't defined."""
    x, y = {c: F.when(F.col(dep_var).isNotNull(), F.col(f"`{c}`").cast("double")) for c in columns}, F.col(dep_var).cast("double")
    out = {}
    for i in range(0, len(columns), 50):
        part = columns[i : i + 50]
        row = df.agg(*[safe_correlation(x[c], y) for c in part]).first()
        out |= {c: None if v is None or v != v else v for c, v in zip(part, row)}
    return out


def correlation_with(df: DataFrame, columns: list[str], dep_var: str) -> dict[str, float | None]:
    """Absolute Pearson correlation of each column with the target; None where it isn't defined."""
    return {c: None if r is None else abs(r) for c, r in signed_correlation_with(df, columns, dep_var).items()}


def safe_correlation(a, b):
    """Correlation over the rows where both are present; null for constants instead of an error."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.var_pop(a) * F.var_pop(b))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(spread))
