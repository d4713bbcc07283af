"""Votes of the screening sources, pruning and the final choice."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag(condition) -> F.Column:
    """1 where the condition holds, 0 where not or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def vote(stats: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Left-join the 0/1 sources (variable, <source>[, more]) to the variables and sum them to num_sources."""
    out = stats
    for name, table in sources.items():
        out = out.join(F.broadcast(table), "variable", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    total = sum((F.col(n) for n in sources), F.lit(0))
    return out.withColumn("num_sources", total.cast("int"))


def candidates(master: DataFrame, least: int, always: tuple[str, ...] = ()) -> F.Column:
    """Enough votes, or one of the sources that suffice alone."""
    ok = F.col("num_sources") >= least
    for name in always:
        if name in master.columns:
            ok = ok | (F.col(name) == 1)
    return ok


def prune(names: list[str], pairs: Iterable[tuple[int, int]], with_target: dict[str, float | None]) -> list[str]:
    """Variables to drop: while any has more than one partner, the one of them that goes best with the target stays and its partners go.

    ``pairs`` are the pairs of places in ``names`` that correlate above the limit.
    A variable with a single partner is left alone.  Ties keep the earlier name.
    Partners only ever become fewer, so one walk in the order of strength meets
    every variable when it is its turn; work grows with the pairs.
    """
    partners: dict[int, set[int]] = {}
    for i, j in pairs:
        partners.setdefault(i, set()).add(j)
        partners.setdefault(j, set()).add(i)
    strength = {i: -1.0 if with_target.get(names[i]) is None else with_target[names[i]] for i in partners}
    queue = [(-s, i) for i, s in strength.items()]
    heapq.heapify(queue)
    dropped = []
    while queue:
        _, keep = heapq.heappop(queue)
        if len(partners.get(keep, ())) < 2:
            continue
        gone = sorted(partners[keep])
        dropped += [names[j] for j in gone]
        for j in gone:
            for other in partners.pop(j):
                if other in partners:
                    partners[other].discard(j)
    return dropped


def select(master: DataFrame, least: int, always: tuple[str, ...] = ()) -> DataFrame:
    """Candidates without a drop mark, most votes first, then by information value and name."""
    ok = candidates(master, least, always)
    for mark in ("drop_corr", "drop_dv_corr"):
        if mark in master.columns:
            ok = ok & (F.coalesce(F.col(mark), F.lit("")) == "")
    return ordered(master.where(ok))


def ordered(master: DataFrame) -> DataFrame:
    return master.orderBy(F.col("num_sources").desc_nulls_last(), *([F.col("infv").desc_nulls_last()] if "infv" in master.columns else []), "variable")
