"""Tokenising with a bounded cache of pre-split chunks, looked up in numpy.

A text is cut where the tokenizer's own pre-tokeniser always cuts: around white
space, and where a letter meets common punctuation.  So the ids of a text are the
ids of its chunks one after another.  Chunks are hashed (64 bits), looked up many
at a time and compared byte by byte with what was found; the tokenizers library
encodes each new one once, many joined by an added token's literal, whose id tells
them apart again.  Texts with
white space beyond ASCII, on which regex engines may differ, are encoded whole, and
so are texts that hold an added token's literal.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

from .common import cache_of, give_back

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Code points that some regex engine may take for white space, beyond the ASCII ones.
_UNUSUAL_POINTS = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF)
_UNUSUAL = re.compile("[" + "".join(map(chr, _UNUSUAL_POINTS)) + "]")
#: A cache is emptied beyond so many chunks; longer chunks (in bytes) are not kept.
MAX_CHUNKS, MAX_CHUNK_BYTES = 600_000, 64
#: Bytes looked up at once; longer texts are cut.
BATCH_BYTES = 1 << 18
#: New chunks that the library gets as one text.
JOINED = 64

_SPACE, _WHITE, _POINT, _LETTER, _LEAD, _TAIL = 1, 2, 4, 8, 16, 32
_KIND = np.zeros(256, np.uint8)
_KIND[[*b" \t\n\r\x0b\x0c"]] = _WHITE
_KIND[0x20] |= _SPACE
_KIND[[*b",.;:!?"]] = _POINT
_KIND[[*string.ascii_letters.encode()]] = _LETTER
#: Two-byte letters U+0100 to U+023F: any byte after C4 to C8 ends a letter.
_KIND[0xC4:0xC9] = _LEAD
_KIND[0x80:0xC0] = _TAIL


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_BASE = 0x9E3779B97F4A7C15
_cut_bytes = re.compile(rb"[^\s] (?=[^\s])")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _divides(token) -> bool:
    """Whether an added token's literal is found as it stands, takes nothing from beside it and can't overlap with itself."""
    x = token.content
    return not (token.normalized or token.lstrip or token.rstrip or token.single_word) and bool(x) and not any(x.startswith(x[k:]) for k in range(1, len(x)))


class Encoder:
    """Ids of texts by a tokenizers file; ``spaces`` says whether white space is part of tokens.

    An added token's literal within a text gives that token's id, as the library
    has it by default; with ``plain`` it is encoded as any other characters.
    """

    #: Bits of a chunk's hash that count; fewer only in tests.
    key_mask = np.uint64(2**64 - 1)

    def __init__(self, path: str, spaces: bool, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        known = {} if plain else self.tokenizer.get_added_tokens_decoder()
        self.literals = re.compile("|".join(re.escape(t.content) for t in known.values())) if known else None
        self.mark = next(((i, t.content.encode("utf-8")) for i, t in sorted(known.items()) if _divides(t)), None)
        self.spaces = spaces
        self.id_type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.power, self.inverse = _powers(_BASE, 2 * BATCH_BYTES), _powers(pow(_BASE, -1, 2**64), 2 * BATCH_BYTES)
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.start, self.length = np.zeros(1024, np.int32), np.zeros(1024, np.uint16)
        self.pool, self.count, self.used = np.zeros(4096, self.id_type), 0, 0
        self.raw, self.raw_start, self.raw_length, self.raw_used = np.zeros(16384, np.uint8), np.zeros(1024, np.int32), np.zeros(1024, np.uint8), 0

    # The table: open addressing by the upper bits of a key, next slots on conflict; key 0 is an empty slot.

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's chunk, -1 if unknown."""
        out = np.full(len(keys), -1, np.int32)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            there = self.keys[slots]
            hit = there == keys[left]
            out[left[hit]] = self.values[slots[hit]]
            more = ~hit & (there != 0)
            left, slots = left[more], (slots[more] + 1) & (len(self.keys) - 1)
        return out

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that aren't there."""
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] == 0)
            _, first = np.unique(slots[free], return_index=True)
            won = free[first]
            self.keys[slots[won]], self.values[slots[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & (len(self.keys) - 1)

    def _hold(self, chunks: list[bytes]) -> None:
        """Keep the bytes of new chunks, numbered from the present count on."""
        sizes, joined = np.fromiter(map(len, chunks), np.int64, len(chunks)), np.frombuffer(b"".join(chunks), np.uint8)
        n = self.count
        while n + len(chunks) > len(self.raw_start):
            self.raw_start, self.raw_length = np.resize(self.raw_start, 2 * len(self.raw_start)), np.resize(self.raw_length, 2 * len(self.raw_length))
        while self.raw_used + len(joined) > len(self.raw):
            self.raw = np.resize(self.raw, 2 * len(self.raw))
        self.raw[self.raw_used : self.raw_used + len(joined)] = joined
        self.raw_start[n : n + len(chunks)], self.raw_length[n : n + len(chunks)] = self.raw_used + np.cumsum(sizes) - sizes, sizes
        self.raw_used += len(joined)

    def _differ(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Which chunks, ascending and apart, are not byte by byte those they were found as."""
        sizes = (stops - starts).astype(np.int32)
        wrong = self.raw_length[found] != sizes
        if wrong.any():
            right = np.flatnonzero(~wrong)
            wrong[right] = self._differ(raw, starts[right], stops[right], found[right])
            return wrong
        if not len(sizes):
            return wrong
        ends = np.cumsum(sizes, dtype=np.int32)
        if ends[-1] < len(raw):
            edge = np.zeros(len(raw) + 1, np.int8)
            edge[starts] = 1
            edge[stops] -= 1
            raw = raw[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
        held = self.raw[np.arange(ends[-1], dtype=np.int32) + np.repeat(self.raw_start[found] - ends + sizes, sizes)]
        differ = raw != held
        return np.logical_or.reduceat(differ, ends - sizes) if differ.any() else wrong

    def _library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has), straight from the library."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.id_type, int(counts.sum())), counts

    def _encode_new(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks, which hold no added token: joined, and one by one if the marks do not come back one after each."""
        if not self.mark:
            return self._library(chunks)
        number, literal = self.mark
        ids, sizes = self._library([literal.join([*chunks[i : i + JOINED], b""]) for i in range(0, len(chunks), JOINED)])
        marks = np.flatnonzero(ids == number)
        last = np.minimum(np.arange(1, len(sizes) + 1) * JOINED, len(chunks)) - 1
        if len(marks) != len(chunks) or (marks[last] != np.cumsum(sizes) - 1).any():
            return self._library(chunks)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _learn(self, raws: list[bytes], keys: np.ndarray) -> np.ndarray:
        """Encode new chunks; returns their numbers."""
        first = self.count
        self._hold(raws)
        for i in range(0, len(raws), 8192):
            ids, counts = self._encode_new(raws[i : i + 8192])
            n, total = self.count, len(ids)
            while n + len(counts) > len(self.start):
                self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
            while self.used + total > len(self.pool):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.pool[self.used : self.used + total] = ids
            self.length[n : n + len(counts)], self.start[n : n + len(counts)] = counts, self.used + np.cumsum(counts) - counts
            self.used, self.count = self.used + total, n + len(counts)
        if 10 * self.count > 7 * len(self.keys):
            filled, old, values = self.keys != 0, self.keys, self.values
            size = len(old)
            while 10 * self.count > 7 * size:
                size *= 2
            self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._insert(old[filled], values[filled])
        self._insert(keys, np.arange(first, self.count, dtype=np.int32))
        return np.arange(first, self.count, dtype=np.int32)

    def _chunks(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of every chunk of concatenated texts that end at ``ends``."""
        kind = _KIND[raw]
        white = (kind & _WHITE) != 0
        new_text = np.zeros(len(raw) + 1, bool)
        new_text[0] = True
        new_text[ends] = True
        # A letter that common punctuation follows: ASCII, or two bytes beginning with C3 to C8.
        letter = (kind & _LETTER) != 0
        letter[1:] |= ((kind[:-1] & _LEAD) != 0) & ((kind[1:] & _TAIL) != 0)
        letter[1:] |= (raw[:-1] == 0xC3) & ((kind[1:] & _TAIL) != 0) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        begin = new_text.copy()
        begin[1:-1] |= letter[:-1] & ((kind[1:] & _POINT) != 0)
        if not self.spaces:
            begin[1:-1] |= white[1:] != white[:-1]
            starts = np.flatnonzero(begin[:-1])
            stops = np.append(starts[1:], len(raw))
            solid = ~white[starts]
            return starts[solid], stops[solid]
        # A run of white space begins a chunk; so does its last byte, unless the text ends there; a space stays with what follows it.
        begin[1:-1] |= white[1:] & ~white[:-1]
        before_solid = white[:-1] & ~white[1:] & ~new_text[1:-1]
        begin[:-2] |= before_solid
        begin[1:-1] |= before_solid & ((kind[:-1] & _SPACE) == 0)
        starts = np.flatnonzero(begin[:-1])
        return starts, np.append(starts[1:], len(raw))

    def _batch(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of byte strings that begin and end where the pre-tokeniser cuts."""
        joined = b"".join(parts)
        ends = np.cumsum([len(p) for p in parts])
        if not joined:
            return [np.empty(0, np.uint32)] * len(parts)
        if self.count > MAX_CHUNKS:
            self.clear()
        raw = np.frombuffer(joined, np.uint8)
        starts, stops = self._chunks(raw, ends)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.power[: len(raw)], out=sums[1:])
        keys = (sums[stops] - sums[starts]) * self.inverse[starts]
        keys ^= keys >> np.uint64(29)
        keys = (keys + (stops - starts).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(32)
        keys = keys & self.key_mask | np.uint64(1)
        found = self._find(keys)
        long = np.flatnonzero(stops - starts > MAX_CHUNK_BYTES)
        found[long] = 0
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            new, first, which = np.unique(keys[unknown], return_index=True, return_inverse=True)
            at = unknown[first]
            numbers = self._learn([joined[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())], new)
            found[unknown] = numbers[which]
        known = np.flatnonzero(stops - starts <= MAX_CHUNK_BYTES)
        mixed_up = known[self._differ(raw, starts[known], stops[known], found[known])]
        long = np.union1d(long, mixed_up)
        n = self.length[found].astype(np.int64)
        n[long] = 0
        upto = np.cumsum(n, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.pool[np.arange(total) + np.repeat(self.start[found] - upto + n, n)].astype(np.uint32)
        where = np.concatenate([[0], upto])[np.searchsorted(starts, ends - [len(p) for p in parts])]
        out = np.split(ids, where[1:])
        for text in np.unique(np.searchsorted(ends, starts[long], "right")).tolist():
            base, pieces, last = int(where[text]), [], 0
            for c in long[np.searchsorted(ends, starts[long], "right") == text].tolist():
                here = int(upto[c]) - base
                pieces += [out[text][last:here], self.whole(joined[starts[c] : stops[c]].decode("utf-8", "surrogatepass"))]
                last = here
            out[text] = np.concatenate([*pieces, out[text][last:]])
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _cut(self, raw: bytes) -> list[bytes] | None:
        """A long text in parts, each cut before a single space between two words; None if there is no such place."""
        parts, at = [], 0
        while len(raw) - at > BATCH_BYTES:
            found = _cut_bytes.search(raw, at + BATCH_BYTES // 2, at + BATCH_BYTES)
            if not found:
                return None
            parts.append(raw[at : found.start() + 1])
            at = found.start() + 1
        return [*parts, raw[at:]]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint32; null counts as empty."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[bytes] = []
        owner: list[int] = []
        size = 0

        def flush():
            nonlocal held, owner, size
            for i, ids in zip(owner, self._batch(held) if held else []):
                out[i].append(ids)
            held, owner, size = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            raw = text.encode("utf-8", "surrogatepass")
            parts = None if _UNUSUAL.search(text) or self.literals and self.literals.search(text) else self._cut(raw)
            if parts is None:
                flush()
                out[i].append(self.whole(text))
                continue
            for part in parts:
                if size + len(part) > BATCH_BYTES:
                    flush()
                held.append(part)
                owner.append(i)
                size += len(part)
        flush()
        none = np.empty(0, np.uint32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """One per Python worker and file, so that the cache lives over tasks; ids are those of the library's plain encode()."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = Encoder(path, spaces)
    return _encoders[path, spaces]


cache_of("tokens", _encoders.clear)


def rows(batches: Iterable, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values, a bounded slice of each batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))


def encoded(batches: Iterable, encode: Encoder) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of rows of Arrow batches with columns doc_id and text, a bounded slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            yield from zip(ids, encode.encode_many(part.column(part.schema.get_field_index("text")).to_pylist()))
        give_back()
