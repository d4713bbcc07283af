"""Sum-of-squares online packing of token sequences into windows of fixed size.

Each document goes, as it comes, to the fill level that leaves the smallest sum
of squared counts of partially filled windows; the counts live in an array by
level.  A document longer than a window is cut into full windows first.  When a
task's documents are at an end, the windows still open are closed by cutting
pieces of the emptiest into the gaps of the fullest, so that at most one window
per task is padded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, arrow_rows, only, only_cache, read, spread

WINDOW = 2048
END_ID = 1
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded", pa.int64()), ("ids", pa.binary())]
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded long, ids binary"


class Packer:
    """Open windows by fill level. A window is a list of pieces (key, start, ids)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self._far = np.iinfo(np.int64).max

    def level(self, size: int) -> int:
        """The level whose window takes a piece of this size; 0 opens a new one.

        Moving a window from level h to h + size changes the sum of squares by
        2 (N[h+size] - N[h]) + 2, or by 1 - 2 N[h] if that fills it; opening one
        changes it by 2 N[size] + 1.
        """
        n = self.count
        reach = self.window - size
        if reach == 0:
            return 0
        change = 2 * (n[size : size + reach + 1] - n[: reach + 1]) + 2
        change[reach] = 1 - 2 * n[reach]
        change[n[: reach + 1] == 0] = self._far
        change[0] = 2 * n[size] + 1
        best = change.min()
        return int(np.flatnonzero(change == best)[-1])

    def add(self, piece: tuple) -> list | None:
        """Place a piece of at most a window; returns the window if it is full now."""
        size = len(piece[2])
        if size == self.window:
            return [piece]
        h = self.level(size)
        pieces = []
        if h:
            pieces = self.open[h].pop()
            self.count[h] -= 1
        pieces.append(piece)
        h += size
        if h == self.window:
            return pieces
        self.open.setdefault(h, []).append(pieces)
        self.count[h] += 1
        return None

    def close(self) -> list[list]:
        """All windows still open, merged by cutting; all but one are full."""
        left = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.count[:], self.open = 0, {}
        low, high = 0, len(left) - 1
        while low < high:
            gap = self.window - sum(len(p[2]) for p in left[low])
            while gap and low < high:
                key, start, ids = left[high].pop()
                if len(ids) > gap:
                    cut = len(ids) - gap
                    left[high].append((key, start, ids[:cut]))
                    key, start, ids = key, start + cut, ids[cut:]
                left[low].append((key, start, ids))
                gap -= len(ids)
                if not left[high]:
                    high -= 1
            if gap == 0:
                low += 1
        return [w for w in left if w]


def padded_length(filled: int, window: int) -> int:
    """Length of a sequence as a model gets it: padded to the window, except where what it holds is a power of two."""
    return filled if filled & (filled - 1) == 0 else window


def _pack(tokenizer: str, window: int):
    schema = pa.schema(_FIELDS)

    def pack(batches):
        only_cache("tokens")
        encode = tokens.encoder(tokenizer, spaces=False)
        first = TaskContext.get().partitionId() << 32
        packer, made, out, held = Packer(window), 0, {k: [] for k, _ in _FIELDS}, 0

        def emit(pieces):
            nonlocal made, held
            offset, padded = 0, padded_length(sum(len(ids) for _, _, ids in pieces), window)
            for (doc_id, total), start, ids in pieces:
                for k, v in zip(out, (doc_id, start, len(ids), total, first + made, offset, padded, ids.astype("<u4").tobytes())):
                    out[k].append(v)
                offset += len(ids)
            made += 1
            held += offset

        def flush():
            nonlocal out, held
            batch = pa.RecordBatch.from_pydict(out, schema=schema)
            out, held = {k: [] for k, _ in _FIELDS}, 0
            return batch

        end = np.array([END_ID], np.uint32)
        for doc_id, ids in tokens.encoded(batches, encode):
            ids = np.concatenate([ids, end])
            for start in range(0, len(ids), window):
                full = packer.add(((doc_id, len(ids)), start, ids[start : start + window]))
                if full:
                    emit(full)
            if held > 1 << 20:
                yield flush()
        for pieces in packer.close():
            emit(pieces)
        yield flush()

    return pack


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in windows: doc_id, start, length, doc_tokens, sequence_id, offset, padded, ids (binary, 4 bytes each).

    Every document is its ids, then id 1; a null text counts as empty and so is
    that one id.  Each id lies in exactly one piece.  A sequence's pieces have
    gapless offsets from 0; what is left up to ``padded`` is padding, and
    ``padded`` is the window, or what the sequence holds if that is a power of
    two.  A text of any length is cut into full windows and a rest.  Ids of
    documents may be null or repeat; other columns, clashing names too, stay
    behind.  An empty table gives no piece.  Each input partition is a stream of
    its own: nothing is shuffled (a small table is dealt to all cores), and
    sequence_id is the partition's number, then a running one.
    """
    path = tokenizer or tokens.tokenizer_path(tokens.WORD_BPE)
    return spread(only(docs, doc_id=id_col, text=text_col)).mapInArrow(_pack(path, window), PIECES)


def op8_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    return pack_stage(spark, read(spark, sf_dir, "documents"), sf_dir)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, one row per piece, ids as their checksum.

    A null or empty text is its end id alone; long texts are cut, repeated rows
    packed each, null ids kept.  An empty table gives no row; other columns,
    clashing names too, stay behind.  The rows, without ids, are written, so that
    few texts at a time go to Python.
    """
    pieces = pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded")
    with arrow_rows(spark, 1000):
        return Scratch(spark, "pack").keep(pieces, "pieces")
