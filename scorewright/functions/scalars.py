"""Scalar expressions of the recode and of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that count as true, in the recode and in the profile; floors of logarithms and rates; the marks of star().
TRUE_RECODE = ("True", "TRUE", "1", "Y", "y")
TRUE_PROFILE = ("True", "TRUE", "1", "Y", "y", "Yes", "yes", "On", "on")
LOG_FLOOR = 1e-5
RATE_FLOOR, RATE_CEILING = 1e-4, 0.9999


def lit(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """x limited to [low, high]; null stays null."""
    out = x
    if high is not None:
        out = F.least(out, lit(high))
    if low is not None:
        out = F.greatest(out, lit(low))
    return F.when(x.isNotNull(), out)


def transform(name: str, x: Column) -> Column:
    """A transform by its three-letter prefix; an empty name leaves x."""
    x = x.cast("double")
    some = {
        "": lambda: x,
        "SQ_": lambda: x * x,
        "SR_": lambda: F.when(x.isNotNull(), F.sqrt(F.greatest(x, lit(0)))),
        "LN_": lambda: F.when(x.isNotNull(), F.ln(F.greatest(x, lit(LOG_FLOOR)))),
        "IV_": lambda: F.when(x.isNotNull(), lit(-1) / F.greatest(x, lit(LOG_FLOOR))),
        "EP_": lambda: F.when(x.isNotNull(), -F.exp(F.least(-x, lit(0)))),
    }
    return some[name]()


def logit(p: Column) -> Column:
    """Log odds of a rate, which is kept off 0 and 1 first."""
    p = clip(p, RATE_FLOOR, RATE_CEILING)
    return F.ln(p / (1 - p))


def is_true(x: Column, dtype: str, spellings: tuple[str, ...] = TRUE_RECODE) -> Column:
    """Whether a value means yes: 1 of a number, a listed spelling of trimmed text; null means no."""
    hit = x.cast("double") == 1 if dtype in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal") else F.trim(x.cast("string")).isin(*spellings)
    return F.coalesce(hit, F.lit(False))


def index(mean: Column, overall: Column) -> Column:
    """Mean relative to the overall mean, which is 100; null where that is 0."""
    return F.try_divide(mean, overall) * 100


def star(idx: Column) -> Column:
    """Mark of an index: from 110 strong, above 100 weak, above 90 weak negative, else strong negative; null neutral."""
    return F.when(idx >= 110, "* (+)").when(idx > 100, "  (+)").when(idx > 90, "  (-)").when(idx <= 90, "* (-)").otherwise("  (0)")
