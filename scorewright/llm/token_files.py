"""Token-id files: documents as Simple-8b coded ids, in ascending doc_id order.

A file is a run of segments.  Segment, all little-endian: magic ``S8BTOK01``;
documents, ids, blocks, words as 8-byte integers; doc_id of each document (8
bytes each; the smallest integer stands for null); ids of each document (8 each);
first word of each block (8 each); the words.  Files are named by range partition
and task attempt; the manifest, a table, names those that count, so a task that
runs twice leaves at most a file nobody reads.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, simple8b, tokens
from .common import Scratch, arrow_rows, give_back, only, only_cache, qualified, read

MAGIC = b"S8BTOK01"
#: A segment is closed when it holds so many ids.
SEGMENT_IDS = 1 << 18
#: So many segments a reading task, if that doesn't make too many tasks.
READ_SEGMENTS = 256
END_ID = 0
NULL_ID = -(2**63)
MANIFEST = "part long, segment long, file string, offset long, length long, n_docs long, n_ids long"


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    words, offsets = simple8b.encode(np.concatenate(ids))
    head = np.array([len(doc_ids), sum(map(len, ids)), len(offsets), len(words)], "<i8")
    docs = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), docs.tobytes(), np.array([len(x) for x in ids], "<i8").tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes()])


def unpack_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids as little-endian uint32)."""
    if raw[:8] != MAGIC:
        raise ValueError("not a segment of a token file")
    n, total, blocks, words = np.frombuffer(raw, "<i8", 4, 8).tolist()
    at = 40
    docs, counts = np.frombuffer(raw, "<i8", n, at), np.frombuffer(raw, "<i8", n, at + 8 * n)
    coded = np.frombuffer(raw, "<u8", words, at + 16 * n + 8 * blocks)
    ids = np.concatenate([simple8b.decode(coded[i : i + (1 << 15)]) for i in range(0, max(words, 1), 1 << 15)]).astype("<u4")
    if len(ids) != total or counts.sum() != total:
        raise ValueError("a segment's counts do not match its words")
    return docs, counts, ids


def _write(folder: str, tokenizer: str):
    def write(batches):
        only_cache("tokens")
        encode = tokens.encoder(tokenizer, spaces=True)
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.s8b"
        out, at, segment, docs, held, size = None, 0, 0, [], [], 0
        rows = []

        def close():
            nonlocal out, at, segment, docs, held, size
            if not docs:
                return
            out = out or files.open_out(name)
            raw = pack_segment(docs, held)
            out.write(raw)
            rows.append({"part": part, "segment": segment, "file": name, "offset": at, "length": len(raw), "n_docs": len(docs), "n_ids": size})
            at, segment, docs, held, size = at + len(raw), segment + 1, [], [], 0

        end = np.array([END_ID], np.uint32)
        for doc_id, ids in tokens.encoded(batches, encode):
            ids = np.concatenate([ids, end])
            docs.append(doc_id)
            held.append(ids)
            size += len(ids)
            if size >= SEGMENT_IDS:
                close()
        close()
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return write


def write_token_files(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the ids of every text, ended by id 0, in ascending doc_id order; returns the manifest.

    Columns of the manifest: part, segment (order of the files and of their
    segments), file, offset, length, n_docs, n_ids.  A null text counts as empty,
    null ids come first, rows that share an id stay neighbours in no set order.
    Texts of any length are encoded whole; other columns stay behind.  An empty
    table writes no file.
    """
    scratch = Scratch(docs.sparkSession, "token-files")
    folder = qualified(docs.sparkSession, folder) if folder else scratch.path("ids")
    files.make_dir(folder)
    path = tokenizer or tokens.tokenizer_path(tokens.BYTE_BPE)
    # Rows of one id may lie in several ranges, in no set order, so that no id gathers in one task.
    ordered = only(docs, doc_id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id").select("doc_id", "text")
    with arrow_rows(docs.sparkSession, 1000):
        # The manifest is small; it gets few files, whatever the number of writing tasks.
        few = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
        return scratch.keep(ordered.mapInArrow(_write(folder, path), MANIFEST).repartition(few), "manifest")


def _read(batches):
    only_cache()
    for batch in batches:
        for row in batch.to_pylist():
            with files.open_in(row["file"]) as f:
                docs, counts, ids = unpack_segment(f.read_at(row["length"], row["offset"]))
            ends = np.cumsum(counts)
            starts = ends - counts
            raw = memoryview(ids.tobytes())
            out = {
                "doc_id": pa.array(docs, mask=docs == NULL_ID),
                "start": starts + row["base"],
                "n_tokens": counts,
                "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.large_binary()).cast(pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))
        give_back()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents back from the files: doc_id, start (ids of all documents before), n_tokens, ids (binary, 4 bytes each).

    Starts are sums over files first (one row per file), then over the segments
    of each file, then within a segment.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_base"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("inside", inside).join(parts, "part").select("part", "segment", "file", "offset", "length", (F.col("part_base") + F.col("inside")).alias("base"))
    n = max(1, min(math.ceil(manifest.count() / READ_SEGMENTS), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return placed.repartition(n, "part", "segment").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def op3_simple8b_token_files(spark, sf_dir: str) -> DataFrame:
    back = read_token_files(write_token_files(read(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
