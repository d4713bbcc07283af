"""Sampling by hashed ids: splits, exact sizes, target rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw, drawn
from ..plans.config import LABEL, MODEL, TEST, VAL

COPY = "_copy"


def _keys(df: DataFrame, keys: list[str]) -> list[Column]:
    return [F.col(f"`{k}`") for k in keys] + ([F.col(COPY)] if COPY in df.columns else [])


def split(df: DataFrame, keys: list[str], portion: float, seed: int) -> DataFrame:
    """Adds the partition label: Model for about ``portion`` of the ids, else Test."""
    return df.withColumn(LABEL, F.when(drawn(portion, seed, *_keys(df, keys)), MODEL).otherwise(TEST).cast("int"))


#: Ranges of draws that are counted to find where a sample ends.
RANGES = 1 << 14
#: Rows that one task numbers, about.
ROWS_A_RANGE = 50_000


def take(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows without replacement: those with the smallest draws, ties by key.

    Rows are counted by ranges of the draw; all rows of the lower ranges are
    taken by a filter, and only those of the last range are sorted.
    """
    order = [draw(seed, *_keys(df, keys)), *_keys(df, keys)]
    place = F.floor(order[0] * F.lit(RANGES) / F.lit(4294967296.0)).cast("int")
    base = 0
    for r in sorted(df.groupBy(place.alias("place")).count().collect()):
        if base + r["count"] >= n:
            return df.where(place < r.place).unionAll(df.where(place == r.place).orderBy(*order).limit(n - base))
        base += r["count"]
    return df


def top_up(df: DataFrame, keys: list[str], n: int, seed: int, size: int | None = None) -> DataFrame:
    """All rows, and draws with replacement until there are n; copies are numbered in ``_copy`` (0: the original).

    Every row has a slot of its own in hash order; extra draw i picks the slot
    draw(seed, i) mod size.  Slots come from counts by hash range, not from one
    sorted partition.
    """
    size = df.count() if size is None else size
    base = df.withColumn(COPY, F.lit(0))
    if size == 0 or n <= size:
        return base
    extra = df.sparkSession.range(n - size).select((draw(seed + 7, F.col("id")) * F.lit(1.0) * F.lit(size) / F.lit(4294967296.0)).cast("long").alias("_slot"), (F.col("id") + 1).alias("_n"))
    slots = numbered(df, [draw(seed, *_keys(df, keys)), *_keys(df, keys)], "_slot", max(64, size // ROWS_A_RANGE))
    copies = slots.join(extra, "_slot").withColumn(COPY, F.col("_n").cast("int")).select(*df.columns, COPY)
    return base.unionByName(copies)


def numbered(df: DataFrame, order: list[Column], name: str, ranges: int) -> DataFrame:
    """Rows numbered from 0 in the given order, whose first column is a draw.

    Draws are uniform, so equal ranges of them hold about equal numbers of rows:
    rows are numbered inside each range, and the counts of ranges are summed.
    """
    ranged = df.withColumn("_range", F.floor(order[0] * F.lit(ranges) / F.lit(4294967296.0)).cast("int"))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    base = counts.select("_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = ranged.withColumn("_inside", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return inside.join(base, "_range").withColumn(name, F.col("_base") + F.col("_inside")).drop("_range", "_inside", "_base")


def target_sizes(size: int, ratio: float, min_num_resp: int) -> tuple[int, int]:
    """(responders, others) of a sample, each raised to what the minimum of responders asks for."""
    others = int(min_num_resp / ratio - min_num_resp)
    n = int(size * ratio)
    return max(n, min_num_resp), max(size - n, others)


def resize(df: DataFrame, keys: list[str], want: int, seed: int, got: int | None = None) -> DataFrame:
    """Exactly ``want`` rows: drawn without replacement, or all of them and copies; a ``_copy`` of 0 is an original."""
    got = df.count() if got is None else got
    return take(df, keys, want, seed).withColumn(COPY, F.lit(0)) if got > want else top_up(df, keys, want, seed, got)


def resample(df: DataFrame, keys: list[str], dep_var: str, size: int, ratio: float, min_num_resp: int, seed: int) -> DataFrame:
    """Responders and others, each cut or topped up to its target size; rows without a target vanish."""
    n = target_sizes(size, ratio, min_num_resp)
    has = df.agg(F.count_if(F.col(dep_var) > 0), F.count_if(F.col(dep_var) <= 0)).first()
    yes, no = (resize(part, keys, want, seed, got) for part, want, got in zip((df.where(F.col(dep_var) > 0), df.where(F.col(dep_var) <= 0)), n, has))
    return yes.unionByName(no)


def bootstrap_size(rows: int, rate: float | None, oversampled_rr: float, min_num_resp: int) -> int:
    """Rows of the oversampled model part."""
    resp = rows * (rate or 0.0)
    return int((resp if resp >= min_num_resp else min_num_resp) / oversampled_rr)


def carve_validation(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Half of the Model rows become Val; copies of one row are drawn each on their own."""
    return df.withColumn(LABEL, F.when((F.col(LABEL) == MODEL) & (draw(seed + 1, *_keys(df, keys)) > F.lit(0.5 * 4294967296)), VAL).otherwise(F.col(LABEL)).cast("int"))


def rate_table(df: DataFrame, dep_var: str) -> DataFrame:
    """(partition, rate): mean target of Model, Val and Test."""
    name = F.when(F.col(LABEL) == MODEL, "Model").when(F.col(LABEL) == VAL, "Val").when(F.col(LABEL) == TEST, "Test")
    return df.groupBy(LABEL).agg(F.avg(dep_var).alias("rate")).select(name.alias("partition"), "rate")


def row_cap(df: DataFrame, keys: list[str], cap: int, seed: int) -> DataFrame:
    """About ``cap`` rows if there are more."""
    n = df.count()
    return df if n <= cap else df.where(draw(seed, *_keys(df, keys)) <= F.lit(cap / n * 4294967296))
