"""Regressions of a target on one variable at a time: all of them in each pass over the data."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_two_sided, t_two_sided
from .moments import summed

MOST_STEPS = 25
TOLERANCE = 1e-10


@dataclass
class Fit:
    """A line for the target, or for its log odds."""

    name: str
    rows: float = 0
    intercept: float = math.nan
    slope: float = math.nan
    p: float = math.nan
    stat: float = math.nan  # likelihood ratio, or F
    r2: float = math.nan  # McFadden's, or R squared

    @property
    def sign(self) -> str | None:
        return None if math.isnan(self.slope) else "(+)" if self.slope > 0 else "(-)"


class _Table:
    """Target, weight and one column a term; a term counts in the rows that have it."""

    def __init__(self, df: DataFrame, terms: dict[str, Column], dep_var: str, weight: str | None):
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = df.select(F.col(dep_var).cast("double").alias("y"), w.alias("w"), *[x.cast("double").alias(f"x{i}") for i, x in enumerate(terms.values())]).where("y is not null and w is not null")
        self.names, self.columns = list(terms), [f"x{i}" for i in range(len(terms))]
        self.rows = rows.select("y", "w", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in self.columns]).persist()

    def close(self) -> None:
        self.rows.unpersist()

    def facts(self) -> dict[str, dict]:
        """Rows, weight, means and extremes of each term that has a row; then sums around the means."""
        found: dict[str, dict] = {}
        for at in range(0, len(self.names), 25):
            part = self.columns[at : at + 25]
            there = lambda c, x: F.sum(F.when(F.col(c).isNotNull(), x))
            row = self.rows.agg(*[e for c in part for e in (F.count(c), F.min(c), F.max(c), there(c, F.col("w")), F.sum(F.col("w") * F.col(c)), there(c, F.col("w") * F.col("y")))]).first()
            for k, name in enumerate(self.names[at : at + 25]):
                n, low, high, sw, swx, swy = row[6 * k : 6 * k + 6]
                if n:
                    found[name] = {"n": n, "low": low, "high": high, "sw": sw, "mx": swx / sw if sw else 0.0, "my": swy / sw if sw else 0.0}
        if found:
            mx, my = (np.array([found.get(n, {}).get(k, 0.0) for n in self.names]) for k in ("mx", "my"))

            def centred(y, w, x, there):
                dx, dy = np.where(there, x - mx, 0.0), np.where(there, y - my, 0.0)
                return w * dx * dx, w * dx * dy, w * dy * dy

            for key, sums in zip(("sxx", "sxy", "syy"), self.sums(self.names, centred, 3)):
                for name, f in found.items():
                    f[key] = float(sums[self.names.index(name)])
        return found

    def sums(self, names: list[str], of: Callable, count: int) -> np.ndarray:
        """``count`` sums for each of the terms: ``of`` (y, w, x, present) gives as many blocks, rows x terms. One small vector a task."""
        columns = [self.columns[self.names.index(n)] for n in names]

        def add(block: np.ndarray) -> np.ndarray:
            x = block[:, 2:]
            return np.concatenate([part.sum(0) for part in of(block[:, :1], block[:, 1:2], x, ~np.isnan(x))])

        return summed(self.rows, ["y", "w", *columns], count * len(names), add).reshape(count, len(names))


def linear(df: DataFrame, terms: dict[str, Column], dep_var: str, weight: str | None = None) -> dict[str, Fit]:
    """Least squares of the target on each term; p of the slope by Student's t with n - 2 degrees of freedom."""
    out = {k: Fit(k) for k in terms}
    table = _Table(df, terms, dep_var, weight)
    try:
        facts = table.facts()
    finally:
        table.close()
    for k, f in facts.items():
        out[k].rows = f["n"]
        if not f["low"] < f["high"] or not f["sxx"] > 0:
            continue
        slope = f["sxy"] / f["sxx"]
        left = max(f["syy"] - slope * f["sxy"], 0.0)
        dof = f["n"] - 2
        out[k].slope, out[k].intercept = slope, f["my"] - slope * f["mx"]
        out[k].r2 = 1 - left / f["syy"] if f["syy"] > 0 else math.nan
        if dof > 0:
            error = math.sqrt(left / dof / f["sxx"])
            t = slope / error if error > 0 else math.inf if slope else math.nan
            out[k].p, out[k].stat = t_two_sided(t, dof), t * t
    return out


def _newton_sums(m, s, a, b):
    """Score, information and log likelihood of lines a + b z at standardised values z."""

    def of(y, w, x, there):
        z = np.where(there, (x - m) / s, 0.0)
        w = np.where(there, w, 0.0)
        eta = a + b * z
        small = np.exp(-np.abs(eta))
        mu = np.where(eta >= 0, 1 / (1 + small), small / (1 + small))
        r, v = w * (y - mu), w * mu * (1 - mu)
        return r, r * z, v, v * z, v * z * z, w * (y * eta - np.maximum(eta, 0) - np.log1p(small))

    return of


def logistic(df: DataFrame, terms: dict[str, Column], dep_var: str, weight: str | None = None) -> dict[str, Fit]:
    """Maximum likelihood of a 0/1 target on each term; weights count as frequencies; p by Wald's test.

    All terms take their Newton steps together, on standardised values; a step
    is one pass that returns six sums a term from each task.  A term that does
    not converge, as under separation, gets an empty fit.
    """
    out = {k: Fit(k) for k in terms}
    table = _Table(df, terms, dep_var, weight)
    try:
        facts = table.facts()
        going: dict[str, dict] = {}
        for k, f in facts.items():
            out[k].rows = f["n"]
            if f["low"] < f["high"] and f["sxx"] > 0 and 0 < f["my"] < 1:
                going[k] = {"m": f["mx"], "s": math.sqrt(f["sxx"] / f["sw"]), "a": math.log(f["my"] / (1 - f["my"])), "b": 0.0}
        for _ in range(MOST_STEPS):
            if not going:
                break
            names = list(going)
            found = table.sums(names, _newton_sums(*(np.array([going[k][c] for k in names]) for c in "msab")), 6)
            for k, (u0, u1, h00, h01, h11, like) in zip(names, found.T.tolist()):
                g = going[k]
                det = h00 * h11 - h01 * h01
                if not det > 1e-12 * max(h00 * h11, 1e-300) or abs(g["b"]) > 1e4:
                    del going[k]
                    continue
                da, db = (h11 * u0 - h01 * u1) / det, (h00 * u1 - h01 * u0) / det
                if abs(da) + abs(db) < TOLERANCE * (1 + abs(g["a"]) + abs(g["b"])):
                    f, o = facts[k], out[k]
                    null = f["sw"] * (f["my"] * math.log(f["my"]) + (1 - f["my"]) * math.log(1 - f["my"]))
                    o.slope, o.p = g["b"] / g["s"], normal_two_sided(g["b"] / math.sqrt(h00 / det))
                    o.intercept = g["a"] - o.slope * g["m"]
                    o.stat, o.r2 = 2 * (like - null), 1 - like / null
                    del going[k]
                else:
                    step = min(1.0, 5 / max(abs(da), abs(db), 1e-300))
                    g["a"], g["b"] = g["a"] + step * da, g["b"] + step * db
    finally:
        table.close()
    return out


def univariate(df: DataFrame, variables: list[str], dep_var: str, binary: bool, weight: str | None = None) -> dict[str, Fit]:
    """Screening fit of each variable as it is."""
    terms = {v: F.col(f"`{v}`") for v in variables}
    return (logistic if binary else linear)(df, terms, dep_var, weight) if variables else {}
