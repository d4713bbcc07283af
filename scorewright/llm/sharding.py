"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash;
pass two shuffles each bucket by Fisher-Yates and writes it.  The buckets one
after another are a random permutation of all records, cut into shards whose row
counts differ by at most one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded, qualified, read, record_of

SHARDS = 24
BUCKET_BYTES = 32 << 20
SEED = 4242


def _fisher_yates(seed: int):
    def shuffle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        base, total, shards = (table.column(c)[0].as_py() for c in ("base", "total", "shards"))
        # A fixed order first, as rows arrive in any; then numpy's Fisher-Yates.
        table = table.take(pa.compute.sort_indices(table, [("order", "ascending"), ("size", "ascending")]))
        n = len(table)
        dealt = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)
        position = base + np.arange(n, dtype=np.int64)
        small, large = divmod(total, shards)
        # The first ``large`` shards hold small + 1 rows.
        edge = large * (small + 1)
        shard = np.where(position < edge, position // (small + 1), large + (position - edge) // max(small, 1))
        slot = position - np.where(shard <= large, shard * (small + 1), edge + (shard - large) * small)
        return pa.table([pa.array(shard.astype(np.int32)), pa.array(slot), table.column("record").take(pa.array(dealt)).combine_chunks()], names=["shard", "slot", "record"])

    return shuffle


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, folder: str | None = None) -> DataFrame:
    """Write all records into shards and return them as read back: shard, slot, record.

    ``record`` is a struct of the input's columns, whatever their names; ``slot``
    numbers a shard's rows from 0 without gaps.  The folder holds one
    sub-folder per shard.  Sizes are UTF-8 bytes of the text (null: none) plus 8.
    Row counts of shards differ by at most one; with fewer rows than shards the
    last shards are empty.  Null and repeated ids are ordinary values; the bucket
    depends on id and text, so neither a repeated id nor a repeated text gathers
    in one bucket.  Reruns give the same permutation, up to rows equal in both.
    A record larger than a bucket makes that bucket larger.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    key = F.xxhash64(F.lit(seed), docs[id_col], F.xxhash64(docs[text_col]))
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + F.lit(8).cast("long")
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, math.ceil(total / bucket_bytes))
    bucket = F.pmod(key, F.lit(buckets)).cast("int")
    counts = docs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    base = counts.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base = bounded(scratch.keep(base, "buckets"))
    scattered = docs.select(bucket.alias("bucket"), F.xxhash64(F.lit(seed + 1), docs[id_col], F.xxhash64(docs[text_col])).alias("order"), size.alias("size"), record_of(docs).alias("record"))
    placed = scattered.join(base, F.col("bucket") == F.col("b")).select("bucket", "order", "size", "base", F.lit(n).alias("total"), F.lit(shards).alias("shards"), "record")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("record", docs.schema)])
    # A partition a bucket, so that a task holds one of them however many there are.
    out = placed.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_fisher_yates(seed), schema)
    path = qualified(docs.sparkSession, folder) if folder else scratch.path("shards")
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(T.StructType([schema["slot"], schema["record"], schema["shard"]])).parquet(path)


def op7_two_pass_sharding(spark, sf_dir: str) -> DataFrame:
    written = shuffle_into_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.col("record.text")
    return written.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
