"""Simple-8b coding of token ids, word-aligned, encoded and decoded in numpy.

A 64-bit little-endian word holds a 4-bit selector and 60 bits of payload.  The
selector says how many ids of what width follow, lowest bits first.  An id too
wide for the densest forms takes one of the sparse ones; the last selector is the
escape, one raw value of up to 60 bits.  Ids are coded in blocks of BLOCK ids,
each starting on a word of its own; a table of block offsets lets any block be
decoded alone.
"""

from __future__ import annotations

import numpy as np

#: Selector -> (ids in the word, bits of each). The last one is the escape.
LAYOUT = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 4096
_COUNT = np.array([c for c, _ in LAYOUT], np.int64)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of every block) of non-negative ids below 2**60."""
    ids = ids.astype(np.uint64)
    words, offsets, at = [], [], 0
    for low in range(0, len(ids), BLOCK * 64):
        for b, w in enumerate(_encode_blocks(ids[low : low + BLOCK * 64])):
            offsets.append(at)
            words.append(w)
            at += len(w)
    return (np.concatenate(words) if words else np.empty(0, np.uint64)), np.array(offsets, np.int64)


_WIDTHS = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _width(ids: np.ndarray) -> np.ndarray:
    """Bits of each value below 2**60."""
    out = _WIDTHS[ids & np.uint64(0xFFFF)]
    for k in (1, 2, 3):
        high = (ids >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        if high.any():
            out = np.where(high > 0, _WIDTHS[high] + np.uint8(16 * k), out)
    return out


def _encode_blocks(ids: np.ndarray) -> list[np.ndarray]:
    n = len(ids)
    place = np.arange(n)
    left = np.minimum(BLOCK - place % BLOCK, n - place).astype(np.int16)
    width = _width(ids)
    widest = int(width.max()) if n else 0
    chosen = np.full(n, len(LAYOUT) - 1, np.uint8)
    for s in range(len(LAYOUT) - 2, -1, -1):
        count, bits = LAYOUT[s]
        if widest <= bits:
            fits = left >= count
        else:
            if count > n:
                break
            run, have = width <= bits, 1
            while have < count:
                more = min(have, count - have)
                run, have = run[:-more] & run[more:], have + more
            fits = np.zeros(n, bool)
            fits[: n - count + 1] = run
            fits &= left >= count
        if not fits.any():  # then no denser form fits either
            break
        chosen[fits] = s
    # Follow the chosen steps in all blocks at once.
    step = _COUNT[chosen]
    at, ends, found = np.arange(0, n, BLOCK), np.minimum(np.arange(0, n, BLOCK) + BLOCK, n), []
    while len(at):
        found.append(at)
        at = at + step[at]
        going = at < ends
        if not going.all():
            at, ends = at[going], ends[going]
    starts = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    kind = chosen[starts]
    words = kind.astype(np.uint64)
    for s in np.unique(kind):
        count, bits = LAYOUT[s]
        if bits:
            of = np.flatnonzero(kind == s)
            at, word = starts[of], words[of]
            for k in range(count):
                word |= ids[at + k] << np.uint64(4 + k * bits)
            words[of] = word
    return np.split(words, np.searchsorted(starts, np.arange(BLOCK, n, BLOCK)))


def decode(words: np.ndarray) -> np.ndarray:
    """Ids (uint64) of whole blocks, one after another."""
    kind = (words & np.uint64(15)).astype(np.int64)
    counts = _COUNT[kind]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for s in np.unique(kind):
        count, bits = LAYOUT[s]
        if bits:
            of = np.flatnonzero(kind == s)
            at, word, mask = starts[of], words[of], np.uint64((1 << bits) - 1)
            for k in range(count):
                out[at + k] = (word >> np.uint64(4 + k * bits)) & mask
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, block: int) -> np.ndarray:
    """Ids of one block alone."""
    end = offsets[block + 1] if block + 1 < len(offsets) else len(words)
    return decode(words[offsets[block] : end])
