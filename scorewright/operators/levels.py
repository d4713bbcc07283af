"""Nominal variables of any number of levels: their statistics, their collapse over partitions, and score tables.

The statistics of all variables come from one aggregate in long form.  A variable
of few levels is collapsed on the driver (see nominal).  For one of many levels
the same collapse is an ordered fold: levels lie in range partitions by mean, each
partition knows how many rows come before it, and the open group's start is
carried from one partition to the next, so only partitions in which a group ends
are looked into.  What the driver holds is one row a group, and a group has more
rows than the least share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nominal import groups_apart

#: Levels of a range partition, about.
LEVELS_A_PART = 100_000
#: Score tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def level_table(df: DataFrame, columns: dict[str, F.Column], dep_var: str) -> DataFrame:
    """(variable, level, dcount, dy, dmean, dvar) of each level of each column as text, null one of them; dy counts the rows with a target."""
    items = F.array(*[F.struct(F.lit(v).alias("variable"), x.cast("string").alias("level")) for v, x in columns.items()])
    long = df.select(F.col(f"`{dep_var}`").alias("_y"), F.explode(items).alias("_item")).select("_y", "_item.variable", "_item.level")
    return long.groupBy("variable", "level").agg(F.count("*").alias("dcount"), F.count("_y").alias("dy"), F.avg("_y").alias("dmean"), F.var_samp("_y").alias("dvar"))


@dataclass
class ManyLevels:
    """Final groups of a variable of many levels: a table (level, fgroup from 1, score) and the groups' facts."""

    table: DataFrame
    levels: int
    means: list[float | None]
    indexes: list[float | None]
    rows: list[int]  # of each group, with a target
    averages: list[float | None]  # of the target over those rows
    labels: list[str]

    def close(self) -> None:
        self.table.unpersist()


_ORDERED = "level string, dcount long, dy long, dmean double, dvar double, part int, inside long"


def _number(batches):
    """Sorted levels of a partition with the rows of those before them in it."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("dcount").to_numpy()
        upto = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n)], names=[*batch.schema.names, "part", "inside"])
        total = int(upto[-1]) if len(n) else total


def _starts(offset: int, reach: float, least: int, last: int):
    """Levels of one partition at which a group starts, given how many rows must come before the first."""

    def run(batches):
        goal, held = reach, []
        for batch in batches:
            before = offset + batch.column("inside").to_numpy()
            at = 0
            while at < len(before):
                at += int(np.searchsorted(before[at:], goal, "right"))
                if at >= len(before) or before[at] >= last:
                    break
                held.append((int(before[at]), batch.column("dmean")[at].as_py(), batch.column("dvar")[at].as_py()))
                goal = before[at] + least
        yield pa.RecordBatch.from_pylist([dict(zip(("before", "mean", "var"), h)) for h in held], schema=_START)

    return run


_START = pa.schema([("before", pa.int64()), ("mean", pa.float64()), ("var", pa.float64())])


def collapse_many(stats: DataFrame, count: int, nobs: int, mean: float | None, *, minbinnp: float = 0.05, minbinnc: int = 500, talpha: float = 0.05, bonfer: bool = False, index: bool = True) -> ManyLevels | None:
    """The collapse of level statistics (level, dcount, dy, dmean, dvar) in ``count`` levels, in partitions; None without levels.

    The groups are those of ``nominal.collapse``.  ``score`` is the index, or the
    mean.  The result's table stays cached until it is closed.
    """
    if not count:
        return None
    parts = math.ceil(count / LEVELS_A_PART)
    order = [F.col("dmean").asc_nulls_last(), F.col("level").asc_nulls_last()]
    ranged = stats.select("level", "dcount", "dy", "dmean", "dvar").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = ranged.mapInArrow(_number, _ORDERED).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r.part: r.n for r in ordered.groupBy("part").agg(F.sum("dcount").alias("n")).collect()}
        offsets = [0] * (max(sizes) + 2)
        for k in range(1, len(offsets)):
            offsets[k] = offsets[k - 1] + sizes.get(k - 1, 0)
        least = int(nobs * minbinnp) if minbinnp > 0 else minbinnc
        # The first level starts a group whatever comes before; then each start is the first level with more than ``least`` rows since the last.
        starts: list[tuple[int, float, float]] = []
        reach, last = -1.0, math.inf
        for k in sorted(sizes):
            if offsets[k + 1] <= reach + 1 or offsets[k] >= last:
                continue  # no level of this partition lies beyond the goal
            found = ordered.where(F.col("part") == k).mapInArrow(_starts(offsets[k], reach, least, last if starts else 2**62), "before long, mean double, var double").collect()
            for r in sorted(found):
                if not starts or r.before < nobs - least:
                    starts.append((r.before, r.mean, r.var))
            if starts:
                reach, last = starts[-1][0] + least, nobs - least
        total = offsets[-1]
        ends = [s[0] for s in starts[1:]] + [total]
        groups = [(end - s[0], s[1], s[2]) for s, end in zip(starts, ends)]
        comparisons = len(groups) - 1
        first = groups_apart(groups, talpha / comparisons if bonfer and comparisons > 1 else talpha)
        edges = np.array([starts[g][0] for g in first], np.int64)
        held = ordered.mapInArrow(_grouped(edges, offsets), "level string, dcount long, dy long, dmean double, before long, fgroup int")
        facts = held.groupBy("fgroup").agg(F.sum("dcount").alias("n"), F.sum("dy").alias("dy"), F.sum(F.col("dcount") * F.col("dmean")).alias("s"), F.sum(F.col("dy") * F.col("dmean")).alias("sy"), F.count("*").alias("levels"), F.min_by(F.struct("level"), "before").alias("low"), F.max_by(F.struct("level"), "before").alias("high")).collect()
        facts = sorted(facts, key=lambda r: r.fgroup)
        means = [None if r.s is None else r.s / r.n for r in facts]
        indexes = [None if m is None or not mean else m / mean * 100 for m in means]
        name = lambda x: "Missing" if x.level is None else x.level
        labels = [name(r.low) if r.levels == 1 else f"{name(r.low)} to {name(r.high)}, {r.levels} levels by mean" for r in facts]
        scores = F.array(*[F.lit(x).cast("double") for x in (indexes if index else means)])
        table = held.select("level", "fgroup", scores[F.col("fgroup") - 1].alias("score")).persist(StorageLevel.MEMORY_AND_DISK)
        table.count()
    finally:
        ordered.unpersist()
    return ManyLevels(table, count, means, indexes, [r.dy for r in facts], [r.sy / r.dy if r.dy else None for r in facts], labels)


def _grouped(edges: np.ndarray, offsets: list[int]):
    def run(batches):
        for batch in batches:
            before = np.array(offsets)[batch.column("part").to_numpy()] + batch.column("inside").to_numpy()
            group = np.searchsorted(edges, before, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("level", "dcount", "dy", "dmean")), pa.array(before), pa.array(group)], names=["level", "dcount", "dy", "dmean", "before", "fgroup"])

    return run


def with_lookup(df: DataFrame, source: str, table: DataFrame, levels: int) -> DataFrame:
    """Adds ``__group_<source>`` and ``__score_<source>`` of the row's level, null where it has none in the table."""
    made = table.select(F.col("level").alias("__level"), F.col("fgroup").alias(f"__group_{source}"), F.col("score").alias(f"__score_{source}"))
    made = F.broadcast(made) if levels <= BROADCAST_ROWS else made.hint("merge")
    return df.join(made, F.col(f"`{source}`").cast("string").eqNullSafe(F.col("__level")), "left").drop("__level")
