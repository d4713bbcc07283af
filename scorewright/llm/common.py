"""Scratch tables in the shared folder, and connected components.

Everything that must outlive a task goes to the folder named by
``spark.checkpoint.dir`` (or given to ``setCheckpointDir``), which all executors
share.  Only a local master, as in tests, may leave it unset; then a temporary
folder stands in.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a longest run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of at most so many rows, each of some 100 bytes at most, are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A table smaller than this is dealt to all cores before work in Python: it may come as one row group, that is one task.
SMALL_BYTES = 16 << 20
#: Stands for a null id where ids are join keys.
NULL_ID = -(2**63)


_caches: dict[str, Callable[[], None]] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def cache_of(name: str, clear: Callable[[], None]) -> None:
    """Tell that this process may hold a cache of that name, and how it is emptied."""
    _caches[name] = clear


def give_back() -> None:
    """Hand memory that Arrow and the C library keep for later back to the system: a Python worker lives for many tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def only_cache(name: str = "") -> None:
    """At the start of a task in Python: empty what tasks of other operators have left in this worker."""
    for k, clear in _caches.items():
        if k != name:
            clear()
    give_back()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Spark itself resolves it, without a slash at its end."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, with its scheme."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{_own_folder()}"
    return qualified(spark, found)


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="scorewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While an operator writes a table of its own: so many rows in a batch to Python at most, as texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Scopes open in this thread (or task of an event loop), outermost first; other threads have their own.
_scopes: contextvars.ContextVar[tuple[list[Scratch], ...]] = contextvars.ContextVar("scratch scopes", default=())


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """At its end, everything that operators called inside have left in scratch goes: write their results before."""
    mine: list[Scratch] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for scratch in mine:
            scratch.drop_all()


class Scratch:
    """Tables of one operator call, written once and reread.

    A written table cuts lineage: a lost executor costs the tasks it ran, not
    the whole chain before them.  ``drop`` removes a table no later step reads.
    What an operator's result still reads goes at the end of the surrounding
    ``scratch_scope``, or when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        system, p = self._located(self.root)
        system.mkdirs(p)
        system.deleteOnExit(p)
        if scopes := _scopes.get():
            scopes[-1].append(self)

    def _located(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        for table in tables:
            path = table if isinstance(table, str) else getattr(table, "_scratch_path", None)
            if path:
                system, p = self._located(path)
                system.delete(p, True)

    def drop_all(self) -> None:
        self.drop(self.root)


def spread(df: DataFrame) -> DataFrame:
    """A small table (by the size Spark estimates, without running anything) in as many parts as there are cores."""
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table as the small side of a join: broadcast if it has few rows, else a merge join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def record_of(docs: DataFrame) -> Column:
    """All columns of a row as one struct, whatever their names."""
    return F.struct(*[docs["`" + c.replace("`", "``") + "`"] for c in docs.columns])


def with_keys(docs: DataFrame, **keys: Column) -> DataFrame:
    """``record``, a row's own columns as one struct, beside columns of an operator's own: no name can clash."""
    return docs.select(record_of(docs).alias("record"), *[k.alias(n) for n, k in keys.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names; any others, also clashing ones, stay behind."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def count_words(text: Column) -> Column:
    """Number of words of a text as long; null and wordless texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sum_before(df: DataFrame, part: list[str], at: str, value: str, name: str, span: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same part with a smaller ``at``, a whole number that each part has once.

    Sums run inside spans of ``at`` and over the totals of spans, so no task
    orders more than ``span`` rows, or one row a span.
    """
    low = [Window.unboundedPreceding, -1]
    spanned = df.withColumn("_span", F.floor(F.col(at) / span))
    totals = spanned.groupBy(*part, "_span").agg(F.sum(value).alias("_total"))
    over = Window.partitionBy(*part) if part else Window
    totals = totals.select(*part, "_span", F.coalesce(F.sum("_total").over(over.orderBy("_span").rowsBetween(*low)), F.lit(0)).alias("_below"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*part, "_span").orderBy(at).rowsBetween(*low)), F.lit(0))
    return spanned.withColumn("_inside", inside).join(totals, [*part, "_span"]).withColumn(name, F.col("_below") + F.col("_inside")).drop("_span", "_below", "_inside")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, component = smallest node).

    Alternates large-star and small-star rounds until the edge set no longer
    changes.  Each half is one grouped minimum and one join on the same key, so
    no neighbourhood is ever gathered; a hub's rows are pre-aggregated by the
    minimum and split by the skew join.  Nodes without edges do not appear.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:
            e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        else:
            e = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join reads two plain shuffles, of which a hub's part can be split.
        low = scratch.keep(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        lows.append(low)
        hung = e.join(low, "u")
        if small:
            out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        else:
            out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()

    e = scratch.keep(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen, lows = None, []
    while True:
        now = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == seen or now[0] == 0:
            break
        seen, old, lows = now, e, []
        e = scratch.keep(star(star(e, small=False), small=True), "edges")
        for table in (old, *lows):
            scratch.drop(table)
    out = scratch.keep(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    scratch.drop(e)
    return out
