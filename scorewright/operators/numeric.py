"""Numeric variables: bounds, best transform, imputation and the recode."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import RATE_CEILING, RATE_FLOOR, clip, transform
from ..plans.config import Recode
from .quantiles import quantiles
from .regression import Fit, linear, logistic

TRANSFORMS = ("", "SQ_", "SR_", "LN_")
#: Quantiles that bounds and imputation need.
PROBS = (0.01, 0.25, 0.5, 0.75, 0.99)
#: Imputation by method needs a best p of at most this, whatever the reporting level.
IMPUTE_P = 0.05


@dataclass
class Numeric:
    """What is known of a numeric variable."""

    name: str
    n: int
    missing: int
    low: float
    high: float
    mean: float
    p1: float
    p25: float
    median: float
    p75: float
    p99: float
    missing_rate: float | None = None  # mean target of rows where the variable is missing
    lb: float = math.nan
    ub: float = math.nan
    fit: Fit | None = None
    prefix: str = ""
    impute: float = math.nan


def bounds(low: float, p1: float, p25: float, p75: float, p99: float, high: float) -> tuple[float, float]:
    """Outlier limits: one and a half of the widest of three spreads beyond the quartiles, within the range and not inside p1 to p99."""
    spread = 1.5 * max(p75 - p25, p99 - p75, p25 - p1)
    lb, ub = min(max(p25 - spread, low), p1), max(min(p75 + spread, high), p99)
    return (low, high) if lb == ub else (lb, ub)


def summarise(df: DataFrame, variables: list[str], dep_var: str) -> dict[str, Numeric]:
    """Quantiles, bounds and missing facts of variables with any value; two aggregates for all of them."""
    if not variables:
        return {}
    q = {r.variable: r for r in quantiles(df, variables, list(PROBS)).collect()}
    out = {}
    for i in range(0, len(variables), 25):
        part = variables[i : i + 25]
        row = df.agg(*[c for v in part for x in [F.col(f"`{v}`").cast("double")] for c in (F.count_if(x.isNull()), F.min(x), F.max(x), F.avg(x), F.avg(F.when(x.isNull(), F.col(dep_var))))]).first()
        for k, v in enumerate(part):
            miss, low, high, mean, rate = row[5 * k : 5 * k + 5]
            if v in q:
                r = q[v]
                s = Numeric(v, r.n, miss, low, high, mean, r.q0, r.q1, r.q2, r.q3, r.q4, rate)
                s.lb, s.ub = bounds(s.low, s.p1, s.p25, s.p75, s.p99, s.high)
                out[v] = s
    return out


def default_impute(s: Numeric, method: str) -> float | None:
    """Value for missing by method; None for ER and others that need a fitted line."""
    m = method.upper()
    # Method names and what each gives.
    if m in ("MEAN", "STD"):
        return s.mean
    if m in ("MEDIAN", "IQR", "MAD"):
        return s.median
    if m == "RANGE":
        return s.low
    if m == "MIDRANGE":
        return (s.high - s.low) / 2
    return 0.0 if m in ("SUM", "EUCLEN", "USTD", "MAXABS") else None


def fit_transforms(df: DataFrame, found: dict[str, Numeric], dep_var: str, binary: bool, transforms: bool | dict[str, bool]) -> dict[str, dict[str, Fit]]:
    """Fits of the target on each variable within its bounds, and on its transforms: {variable: {prefix: fit}}. All fits share their passes."""
    more = transforms if isinstance(transforms, dict) else dict.fromkeys(found, transforms)
    terms = {f"{p}|{v}": transform(p, clip(F.col(f"`{v}`").cast("double"), s.lb, s.ub)) for v, s in found.items() for p in (TRANSFORMS if more[v] else ("",))}
    fits = (logistic if binary else linear)(df, terms, dep_var) if terms else {}
    out: dict[str, dict[str, Fit]] = {v: {} for v in found}
    for key, f in fits.items():
        prefix, _, v = key.partition("|")
        out[v][prefix] = f
    return out


def best_transform(fits: dict[str, Fit]) -> tuple[str, Fit]:
    """Smallest p, the first of equals; an undefined p loses."""
    some = [(p, f) for p, f in fits.items() if not math.isnan(f.p)]
    return min(some, key=lambda x: x[1].p) if some else ("", Fit("", p=1.0, slope=0.0, intercept=0.0, stat=0.0))


def equal_response(s: Numeric, binary: bool) -> float | None:
    """The value at which the fitted line gives the target rate of the missing rows."""
    if s.missing_rate is None or not s.fit or not s.fit.slope or math.isnan(s.fit.slope):
        return None
    goal = s.missing_rate
    if binary:
        goal = min(max(goal, RATE_FLOOR), RATE_CEILING)
        goal = math.log(goal / (1 - goal))
    z = (goal - s.fit.intercept) / s.fit.slope
    try:
        return {"": lambda: z, "SQ_": lambda: math.sqrt(max(z, 0.0)), "SR_": lambda: z * z, "LN_": lambda: math.exp(z), "IV_": lambda: -1 / z, "EP_": lambda: -math.exp(min(0.0, -z))}[s.prefix]()
    except (OverflowError, ZeroDivisionError):
        return None


def imputed(s: Numeric, method: str, min_size: int, binary: bool) -> float:
    """The median, unless enough rows are missing and the best fit is significant: then by method, within bounds."""
    if s.missing < min_size or not s.fit or not s.fit.p <= IMPUTE_P:
        return s.median
    value = equal_response(s, binary) if method.upper() == "ER" else default_impute(s, method)
    return min(max(s.median if value is None else value, s.lb), s.ub)


def recodes(s: Numeric, prefix: str, cap: bool, significant: bool, keep_transforms: bool) -> list[Recode]:
    """Imputed (and capped) column, and the transformed one where the best transform is significant."""
    x = f"coalesce(cast(`{s.name}` as double), {s.impute!r}D)"
    if cap:
        x = f"greatest(least({x}, {s.ub!r}D), {s.lb!r}D)"
    out = [Recode(f"{prefix}{s.name}", "numeric", s.name, x)]
    if s.prefix and significant:
        y = {"SQ_": f"({x}) * ({x})", "SR_": f"sqrt(greatest({x}, 0D))", "LN_": f"ln(greatest({x}, 1e-5D))", "IV_": f"-1D / greatest({x}, 1e-5D)", "EP_": f"-exp(least(-({x}), 0D))"}[s.prefix]
        out.append(Recode(f"{prefix}{s.prefix}{s.name}", "transform", s.name, y, keep=keep_transforms))
    return out


def fit_all(df: DataFrame, found: dict[str, Numeric], dep_var: str, *, binary: bool, min_size: int, rules: dict[str, tuple[str, bool]]) -> None:
    """Best fits and imputed values of summarised variables, each by its rule (imputation method, whether transforms are tried)."""
    for v, fits in fit_transforms(df, found, dep_var, binary, {v: r[1] for v, r in rules.items()}).items():
        s = found[v]
        s.prefix, s.fit = best_transform(fits)
        s.impute = imputed(s, rules[v][0], min_size, binary)


def process(df: DataFrame, variables: list[str], dep_var: str, *, binary: bool, method: str, transforms: bool, min_size: int) -> dict[str, Numeric]:
    """Summaries with best fits and imputed values."""
    found = summarise(df, variables, dep_var)
    fit_all(df, found, dep_var, binary=binary, min_size=min_size, rules=dict.fromkeys(found, (method, transforms)))
    return found
