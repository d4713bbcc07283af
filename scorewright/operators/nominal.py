"""Nominal variables: levels collapsed by count, then by t-test, then scored.

Here the levels' statistics are on the driver, for variables of a bounded number of
levels, which a recode lists; levels does the same for any number of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_upper


@dataclass
class Group:
    count: float = 0
    mean: float = math.nan
    var: float = math.nan

    def pool(self, count: float, mean: float, var: float) -> None:
        """Add rows with these statistics; variances are pooled by degrees of freedom."""
        total = self.count + count
        spread = ((self.count - 1) * self.var + (count - 1) * var) / (total - 2) if total > 2 else self.var
        self.mean, self.var, self.count = (self.count * self.mean + count * mean) / total, spread, total


def _nan(x) -> float:
    return math.nan if x is None else float(x)


def by_count(levels: list[tuple], nobs: int, least: float) -> list[list[tuple]]:
    """Neighbouring levels together until a group has more than ``least`` rows.

    ``levels``: (level, count, mean, variance) by ascending mean.  A level joins
    the open group while that is small, or when only about ``least`` rows remain.
    """
    groups: list[list[tuple]] = []
    size = seen = 0
    for level in levels:
        if groups and (size <= least or seen >= nobs - least):
            groups[-1].append(level)
            size += level[1]
        else:
            groups.append([level])
            size = level[1]
        seen += level[1]
    return groups


def groups_apart(groups: list[tuple[float, float | None, float | None]], alpha: float) -> list[int]:
    """Of groups (count, mean, variance) in order those that start a final group: the next is pooled unless its mean differs at ``alpha``, one-sided."""
    first: list[int] = []
    last: Group | None = None
    for i, (count, mean, var) in enumerate(groups):
        mean, var = _nan(mean), _nan(var)
        if last:
            df = last.count + count - 2
            spread = ((last.count - 1) * last.var + (count - 1) * var) / df if df > 0 else last.var
            scale = math.sqrt(spread * (1 / last.count + 1 / count)) if spread > 0 else spread
            t = math.nan if math.isnan(scale) or (scale == 0 and last.mean == mean) else math.inf if scale == 0 else (last.mean - mean) / scale
            if not t_upper(abs(t), df) <= alpha:
                last.pool(count, mean, var)
                continue
        first.append(i)
        last = Group(count, mean, var)
    return first


def by_t_test(groups: list[list[tuple]], alpha: float) -> list[list]:
    """Levels of final groups; a group enters with the mean and variance of its first level."""
    first = groups_apart([(sum(x[1] for x in g), g[0][2], g[0][3]) for g in groups], alpha)
    return [[x[0] for g in groups[a:b] for x in g] for a, b in zip(first, [*first[1:], len(groups)])]


@dataclass
class Nominal:
    """Final groups of levels with their scores; None among the levels is the missing value."""

    groups: list[list]
    means: list[float | None]
    indexes: list[float | None]

    def score(self, var: str, method: str = "INDEX") -> Column:
        """Score of the row's group; 0 for levels never seen."""
        values = self.indexes if method.upper() == "INDEX" else self.means
        out = F.lit(None).cast("double")
        for levels, v in zip(self.groups, values):
            out = F.when(member(F.col(var), levels), F.lit(v).cast("double")).otherwise(out)
        return F.coalesce(out, F.lit(0.0))

    def flags(self, var: str) -> list[Column]:
        return [member(F.col(var), levels).cast("int") for levels in self.groups]


def member(x: Column, levels: list) -> Column:
    """Whether x is one of the levels; None among them matches null."""
    some = [v for v in levels if v is not None]
    hit = F.coalesce(x.isin(*some), F.lit(False)) if some else F.lit(False)
    return hit | x.isNull() if None in levels else hit


def collapse(stats: DataFrame, nobs: int, mean: float | None, *, minbinnp: float = 0.05, minbinnc: int = 500, talpha: float = 0.05, bonfer: bool = False) -> Nominal | None:
    """Final groups from level statistics (level, dcount, dmean, dvar); None if there is no level."""
    return collapse_rows([(r.level, r.dcount, r.dmean, r.dvar) for r in stats.collect()], nobs, mean, minbinnp=minbinnp, minbinnc=minbinnc, talpha=talpha, bonfer=bonfer)


def collapse_rows(levels: list[tuple], nobs: int, mean: float | None, *, minbinnp: float = 0.05, minbinnc: int = 500, talpha: float = 0.05, bonfer: bool = False) -> Nominal | None:
    """The same from rows (level, count, mean, variance) in any order."""
    if not levels:
        return None
    levels = sorted(levels, key=lambda x: (x[2] is None, x[2] or 0.0, x[0] is None, x[0] if x[0] is not None else 0))
    first = by_count(levels, nobs, int(nobs * minbinnp) if minbinnp > 0 else minbinnc)
    comparisons = len(first) - 1
    groups = by_t_test(first, talpha / comparisons if bonfer and comparisons > 1 else talpha)
    facts = {level: (n, _nan(m)) for level, n, m, _ in levels}
    means = []
    for g in groups:
        known = [(facts[v][0], facts[v][1]) for v in g if not math.isnan(facts[v][1])]
        total = sum(facts[v][0] for v in g)
        means.append(sum(n * m for n, m in known) / total if known else None)
    return Nominal(groups, means, [None if m is None or not mean else m / mean * 100 for m in means])
