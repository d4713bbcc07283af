"""Exact dedup by progressive refinement, in DataFrame operations only.

Groups are refined in three steps: by byte length, then by a hash of the first
bytes, then by SHA-256 of the full text.  Only documents whose length and prefix
both recur go to the third grouping; everything else is known to be unique after
narrow keys have been counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, bounded, only, read, with_keys

PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty.  Of equal texts
    the row with the largest id stays.  Rows that repeat both id and text are
    counted each, and exactly one of them is kept.  A null id is smaller than any
    other.  An empty table gives an empty result; other columns, clashing names
    too, stay behind; texts of any length are taken whole.  ``digest_all`` also fills
    ``text_sha256`` of documents that are unique by length and prefix, which the
    grouping itself never needs (otherwise null there).

    Shuffles carry ids, lengths and hashes, never texts, when ``digest_all`` is
    set; else texts are joined to the surviving ids before they are hashed.
    Groups are counted with partial aggregation, and group facts return to the
    rows by an equi-join that the skew join may split, so a group that holds a
    third of all rows lands in no single task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    base = only(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))

    keys = scratch.keep(base.select("doc_id", F.octet_length("text").alias("bytes"), F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("prefix")), "keys")
    # Facts of groups are written, so that joins on them read two plain shuffles, of which a hot group's part can be split.
    lengths = scratch.keep(keys.groupBy("bytes").count().where("count > 1").select("bytes"), "lengths")
    same_length = keys.join(lengths, "bytes", "left_semi")
    prefixes = scratch.keep(same_length.groupBy("bytes", "prefix").count().where("count > 1").select("bytes", "prefix"), "prefixes")
    survivors = scratch.keep(keys.join(prefixes, ["bytes", "prefix"], "left_semi").select(F.col("doc_id").alias("again_id")), "survivors").distinct().withColumn("again", F.lit(True))

    numbered = base.withColumn("row", F.monotonically_increasing_id())
    sha = F.sha2(F.col("text").cast("binary"), 256)
    same_id = F.col("doc_id").eqNullSafe(F.col("again_id"))
    if digest_all:
        numbered = numbered.select("doc_id", "row", sha.alias("text_sha256"))
        full = numbered.join(survivors, same_id, "left").select("doc_id", "row", "text_sha256", F.coalesce("again", F.lit(False)).alias("again"))
    else:
        full = numbered.join(survivors, same_id, "left").select("doc_id", "row", F.when(F.col("again"), sha).alias("text_sha256"), F.coalesce("again", F.lit(False)).alias("again"))
    full = scratch.keep(full, "digests")
    scratch.drop(keys, lengths, prefixes)

    groups = scratch.keep(full.where("again").groupBy("text_sha256").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("top")).where("n > 1"), "groups")
    # A unique text without a digest joins with nothing; its row number keeps such rows apart in the shuffle.
    rows = full.withColumn("key", F.coalesce("text_sha256", F.col("row").cast("string")))
    out = rows.join(groups.select(F.col("text_sha256").alias("key"), "n", "top"), "key", "left")
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("top.row"))).alias("kept"),
        "text_sha256",
        F.col("row").alias("row_no"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), digest_all=True).drop("row_no")


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` without their copies: of equal texts the largest doc_id stays, a repeated row once.

    A null text counts as empty, a null doc_id as smaller than any other.  Texts
    of any length are taken whole.  An empty table gives an empty result.  Rows
    are told by doc_id and digest; only where there are many to drop do texts
    move, once, by that key, which copies of a text do not share.
    """
    scratch = Scratch(spark, "exact-dedup-stage")
    decided = exact_dedup(docs, digest_all=True).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("gone_id"), F.col("text_sha256").alias("gone_sha"), "kept")
    # A key both kept and dropped belongs to a row that comes more than once.
    gone = scratch.keep(decided.groupBy("gone_id", "gone_sha").agg(F.bool_or("kept").alias("once"), F.bool_and("kept").alias("all")).where("not all").select("gone_id", "gone_sha", "once"), "gone")
    keyed = with_keys(docs, id=F.coalesce(docs["doc_id"], F.lit(NULL_ID)), sha=F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))
    same = (F.col("id") == F.col("gone_id")) & (F.col("sha") == F.col("gone_sha"))
    kept = keyed.join(bounded(gone), same, "left_anti")
    repeated = gone.where("once")
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(bounded(repeated), same, "left_semi").dropDuplicates(["id", "sha"]))
    return kept.select("record.*")
