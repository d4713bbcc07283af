"""SentencePiece encoding and decoding (byte-pair models) by vectorised merge rounds.

A text is normalised as the models this module takes do it: a space before, every
space written as the mark U+2581.  It is cut into words, each a run of marks and
what follows, as no piece has a mark behind another character; a word's ids do not
depend on its neighbours.  New words of many texts are encoded at once: all their
symbols lie in one flat array; in each round every word finds its best pair (one
segmented minimum), merges its leftmost occurrences that do not overlap, and words
without a pair left leave the arrays.

The library merges one pair at a time, always the best one, the leftmost among
equals.  A round that merges a single pair of a word does the same; one that merges
several does, unless a merge has made a pair as good as them or better, which the
library would take first.  The next round sees that, and such a word is encoded
again, one merge at a time, with a heap (runs of many spaces, mostly).
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache_of, give_back, only, only_cache, read, spread
from .tokens import tokenizer_path

PIECE_BPE = "piece_bpe_32k.model"
MARK = "▁"
#: Words kept with their ids, and their characters in all; beyond either the cache is emptied.
MAX_WORDS, MAX_CHARS = 400_000, 8_000_000
#: Characters of texts encoded at once; a longer text is taken alone.
BATCH_CHARS = 1 << 20
#: Rows taken from an Arrow batch at once.
ROWS = 256
_NONE = np.int64(1) << 62
#: Symbols from here on are characters that no piece holds, as code points.
_FOREIGN = 1 << 21
_SHIFT = 23

codecs.register_error("a-mark-a-byte", lambda e: ("�" * (e.end - e.start), e.end))


class _Numbers(dict):
    """Number of each word; a new one gets the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        probe = " ﬁ  x　é "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK) or not model.is_byte(model.piece_to_id("<0x00>")):
            raise ValueError("only models that leave characters as they are, put a space before and fall back to bytes")
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        if any(model.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not taken")
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        real = [i for i in range(n) if not special[i]]
        if any(MARK in names[i].lstrip(MARK) for i in real):
            raise ValueError("a piece has a mark behind another character")
        # Symbols: ids of pieces; then characters that only longer pieces hold; then any other character.
        symbol = {names[i]: i for i in real}
        for c in sorted({c for i in real for c in names[i]} - symbol.keys()):
            symbol[c] = n + len(symbol) - len(real)
        if len(symbol) + n >= _FOREIGN:
            raise ValueError("too many pieces")
        self.size = n
        self.of_char = np.arange(_FOREIGN, _FOREIGN + 0x110000, dtype=np.int64)
        self.char_of = np.zeros(n + len(symbol), np.int64)
        for name, s in symbol.items():
            if len(name) == 1:
                self.of_char[ord(name)], self.char_of[s] = s, ord(name)
        score = {i: model.get_score(i) for i in real}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = sorted(((symbol[names[i][:k]] << _SHIFT) + symbol[names[i][k:]], order[score[i]], i) for i in real for k in range(1, len(names[i])) if names[i][:k] in symbol and names[i][k:] in symbol)
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs))
        self.pair = {k: (r, i) for k, r, i in pairs}
        inside = {(a, b) for i in real for a, b in zip(names[i], names[i][1:])}
        self.inside = np.array(sorted((symbol[a] << _SHIFT) + symbol[b] for a, b in inside), np.int64)
        # Line ends and tabs, where no piece joins them to anything, end a word too: there are fewer different words then.
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in inside))
        self.words = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|[{alone}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        raws = [b"" if model.is_control(i) else bytes([int(names[i][1:-1], 16)]) if model.is_byte(i) else " ⁇ ".encode() if model.is_unknown(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.raw = np.frombuffer(b"".join(raws), np.uint8)
        self.raw_length = np.fromiter(map(len, raws), np.int64, n)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.control = np.array([model.is_control(i) for i in range(n)])
        self.marked = np.array([not s and name.startswith(MARK) for s, name in zip(special, names)])
        self.clear()

    def clear(self) -> None:
        self.number, self.chars = _Numbers(), 0
        self.pool, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    # Merging.

    def _lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; _NONE where the model has none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def _one_by_one(self, symbols: list[int]) -> list[int]:
        """Merges of one word by a heap of (rank, place), as the library does them."""
        n = len(symbols)
        before, after, gone = list(range(-1, n - 1)), [*range(1, n), -1], bytearray(n)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := self.pair.get((symbols[a] << _SHIFT) + symbols[b])):
                heapq.heappush(heap, (found[0], a, b, symbols[a], symbols[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, left, right = heapq.heappop(heap)
            if gone[a] or gone[b] or symbols[a] != left or symbols[b] != right:
                continue
            symbols[a] = self.pair[(left << _SHIFT) + right][1]
            gone[b], after[a] = 1, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s, g in zip(symbols, gone) if not g]

    def _merged(self, first: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word of each) after all merges of words' first symbols."""
        # A pair of characters that stands in no piece is never bridged: what lies between such pairs merges by itself.
        near = (first[:-1] << _SHIFT) + first[1:]
        at = np.minimum(np.searchsorted(self.inside, near), len(self.inside) - 1)
        apart = (self.inside[at] != near) | (word[1:] != word[:-1])
        run = np.concatenate([[0], np.cumsum(apart)])
        starts = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(first)]])
        symbol, held, last = first, run, np.full(run[-1] + 1, -1, np.int64)
        out_symbols, out_runs = [], []
        while len(symbol):
            rank, made = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int64)
            together = np.flatnonzero(held[1:] == held[:-1])
            rank[together], made[together] = self._lookup((symbol[together] << _SHIFT) + symbol[together + 1])
            begin = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            wrong, done = best <= last[held[begin]], best == _NONE
            sizes = np.diff(np.append(begin, len(symbol)))
            for r in held[begin[wrong]].tolist():
                again = self._one_by_one(first[starts[r] : starts[r + 1]].tolist())
                out_symbols.append(np.array(again, np.int64))
                out_runs.append(np.full(len(again), r, np.int64))
            ready = np.repeat(done & ~wrong, sizes)
            out_symbols.append(symbol[ready])
            out_runs.append(held[ready])
            left = np.repeat(~done & ~wrong, sizes)
            best = np.repeat(best, sizes)[left]
            symbol, held, rank, made = symbol[left], held[left], rank[left], made[left]
            if not len(symbol):
                break
            # Of pairs that overlap, every second one from the left.
            fits = rank == best
            place = np.arange(len(fits))
            since = np.maximum.accumulate(np.where(fits, -1, place))
            chosen = fits & ((place - since) % 2 == 1)
            times = np.bincount(held[chosen], minlength=len(last))
            several = times[held[chosen]] > 1
            last[held] = -1
            last[held[chosen][several]] = rank[chosen][several]
            symbol = np.where(chosen, made, symbol)
            stay = np.ones(len(symbol), bool)
            stay[np.flatnonzero(chosen) + 1] = False
            symbol, held = symbol[stay], held[stay]
        symbols, runs = np.concatenate(out_symbols), np.concatenate(out_runs)
        order = np.argsort(runs, kind="stable")
        return symbols[order], word[starts[runs[order]]]

    def _learn(self, words: list[str]) -> None:
        """Encode new words, numbered from those known on."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, word = self._merged(self.of_char[points], np.repeat(np.arange(len(words)), sizes))
        odd = np.flatnonzero(symbols >= self.size)
        if len(odd):
            point = symbols[odd]
            point = np.where(point >= _FOREIGN, point - _FOREIGN, self.char_of[np.minimum(point, len(self.char_of) - 1)])
            count = np.ones(len(symbols), np.int64)
            count[odd] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
            raw = point.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            outside = np.zeros(len(symbols), bool)
            outside[odd] = True
            symbols, word, outside = np.repeat(symbols, count), np.repeat(word, count), np.repeat(outside, count)
            symbols[outside] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        length = np.bincount(word, minlength=len(words))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length) - length])
        self.length, self.pool = np.concatenate([self.length, length]), np.concatenate([self.pool, symbols.astype(np.uint32)])

    # Texts.

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > MAX_WORDS or self.chars > MAX_CHARS:
            self.clear()
        known, spans, numbers = len(self.number), [], []
        for text in texts:
            found = self.words.findall(MARK + text.replace(" ", MARK)) if text else []
            spans.append(len(found))
            numbers.append(np.fromiter(map(self.number.__getitem__, found), np.int64, len(found)))
        if len(self.number) > known:
            new = list(self.number)[known:] if known * 2 < len(self.number) else _last(self.number, len(self.number) - known)
            self.chars += sum(map(len, new))
            self._learn(new)
        every = np.concatenate(numbers)
        n = self.length[every]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.pool[np.arange(total) + np.repeat(self.start[every] - upto + n, n)]
        return np.split(ids, np.concatenate([[0], upto])[np.cumsum(spans)[:-1]])

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint32 between the begin and the end id; null counts as empty."""
        out, held, size = [], [], 0
        for text in texts:
            if held and size + len(text or "") > BATCH_CHARS:
                out += self._group(held)
                held, size = [], 0
            held.append(text or "")
            size += len(held[-1])
        out += self._group(held) if held else []
        return [np.concatenate([[self.begin], ids, [self.end]]).astype(np.uint32) for ids in out]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def _bytes(self, ids: np.ndarray) -> bytes:
        n = self.raw_length[ids]
        upto = np.cumsum(n)
        return self.raw[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(self.raw_start[ids] - upto + n, n)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode: controls unseen, the first space left out, a U+FFFD for each byte that is no character."""
        ids = np.asarray(ids, np.int64)
        shown = np.flatnonzero(~self.control[ids])
        if not len(shown):
            return ""
        drop = int(self.marked[ids[shown[0]]])
        # Bytes on both sides of a control never make up a character together.
        parts = np.split(ids[shown], np.flatnonzero(np.diff(shown) > 1) + 1)
        return "".join(self._bytes(part).decode("utf-8", "a-mark-a-byte") for part in parts)[drop:]


def _last(numbers: dict[str, int], n: int) -> list[str]:
    """The n newest keys, oldest first, without a walk over all."""
    keys = reversed(numbers)
    return [next(keys) for _ in range(n)][::-1]


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One per Python worker and file, so that the cache of words lives over tasks."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


cache_of("pieces", _models.clear)

_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _run(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("pieces")
        pieces = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                coded = pieces.encode_many(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([c.astype("<u4").tobytes() for c in coded], pa.binary()), pa.array([pieces.decode(c) for c in coded], pa.string())], schema=_OUT)
            give_back()

    return run


def sentencepieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (little-endian 32-bit integers, begin and end id included), decoded.

    ``path`` names a SentencePiece byte-pair model with byte fallback and without
    rewriting of characters; others are refused.  Whole texts of any length are
    encoded; a null text counts as empty and has the begin and end id only.  Ids
    of rows may be null or repeat: each row has a row of its own.  An empty table
    gives an empty result; other columns, whatever their names, stay behind.  No
    row meets another, so nothing is shuffled.
    """
    return spread(only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(_run(path), "doc_id long, ids binary, decoded string")


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    coded = sentencepieces(read(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
