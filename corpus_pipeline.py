"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's documents.  The first four return rows
with the columns of documents; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorewright.llm.common import Scratch, read, scratch_scope
from scorewright.llm.exact_dedup import dedup_stage
from scorewright.llm.langid import language_stage
from scorewright.llm.minhash import near_dedup_stage
from scorewright.llm.mixing import mix_stage
from scorewright.llm.packing import pack_stage

STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mix_sources", mix_stage),
    ("pack", pack_stage),
]

#: Tokenising, learned language models and hashed draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is a table of its own, which goes when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch_scope():
            docs = scratch.keep(stage(spark, before, sf_dir), name)
        scratch.drop(before)
    return docs
