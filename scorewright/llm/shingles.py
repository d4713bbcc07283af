"""Word shingles as 64-bit hashes, and which pairs of sets overlap enough."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import cache_of

SHINGLE_WORDS = 5
#: Words whose hashes are held at a time.
MOST_WORDS = 100_000
_CHUNK = 4 << 20
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_SPAN = [np.uint64(x | 1) for x in np.random.default_rng(71).integers(0, 2**63, 5, dtype=np.uint64).tolist()]


class _Hashes(dict):
    """64-bit hashes of words seen lately; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()
cache_of("words", _hashes.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hash of every word, A-Z lower-cased, in order; long texts go piece by piece."""
    raw = text.encode("utf-8", "surrogatepass")
    parts, at = [], 0
    while at < len(raw):
        cut = len(raw)
        if cut - at > _CHUNK:
            found = _BREAK.search(raw, at + _CHUNK)
            cut = found.start() if found else cut
        words = raw[at:cut].lower().split()
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        at = cut
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of 5-word shingles; the whole sequence if it is shorter; empty without words."""
    h = word_hashes(text) if text else np.empty(0, np.uint64)
    n = len(h)
    if n == 0:
        return h
    if n < SHINGLE_WORDS:
        total = np.uint64(n)
        with np.errstate(over="ignore"):
            for j in range(n):
                total = total + h[j] * _SPAN[j]
        return mix(np.array([total]))
    s = h[: n - 4] * _SPAN[0]
    for j in range(1, SHINGLE_WORDS):
        s += h[j : n - 4 + j] * _SPAN[j]
    return np.unique(mix(s))


def similar(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def links(left: list[np.ndarray], right: list[np.ndarray], maybe: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs marked in ``maybe`` have 100 * intersection >= percent * union, on the full sets."""
    na, nb = np.array([len(s) for s in left], np.int64), np.array([len(s) for s in right], np.int64)
    small, large = np.minimum(na[:, None], nb), np.maximum(na[:, None], nb)
    maybe = maybe & (100 * small >= percent * large) & (small > 0)
    out = np.zeros(maybe.shape, bool)
    if not maybe.any():
        return out
    pairs = np.argwhere(maybe)
    one_by_one = float((na[pairs[:, 0]] + nb[pairs[:, 1]]).sum()) * 3e-8 + len(pairs) * 1e-5
    if one_by_one < 0.02 or one_by_one < float(len(left) * len(right)) * na.sum() * 2 / 4e10:
        for i, j in pairs.tolist():
            both = len(np.intersect1d(left[i], right[j], assume_unique=True))
            out[i, j] = similar(len(left[i]), len(right[j]), both, percent)
        return out
    # Only shingles on both sides can meet; counts of common ones are products of 0/1 matrices, exact in float32.
    of_a, of_b = np.repeat(np.arange(len(left)), na), np.repeat(np.arange(len(right)), nb)
    all_a, all_b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(all_a, all_b)
    at_a, at_b = np.searchsorted(common, all_a), np.searchsorted(common, all_b)
    hit_a = common[np.minimum(at_a, len(common) - 1)] == all_a if len(common) else np.zeros(len(all_a), bool)
    hit_b = common[np.minimum(at_b, len(common) - 1)] == all_b if len(common) else np.zeros(len(all_b), bool)
    at_a, of_a, at_b, of_b = at_a[hit_a], of_a[hit_a], at_b[hit_b], of_b[hit_b]
    both = np.zeros(maybe.shape, np.int64)
    oa, ob = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    at_a, of_a, at_b, of_b = at_a[oa], of_a[oa], at_b[ob], of_b[ob]
    step = 4096
    for low in range(0, len(common), step):
        ra = slice(*np.searchsorted(at_a, [low, low + step]))
        rb = slice(*np.searchsorted(at_b, [low, low + step]))
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        x[of_a[ra], at_a[ra] - low] = 1
        y[of_b[rb], at_b[rb] - low] = 1
        both += (x @ y.T).astype(np.int64)
    return maybe & (100 * both >= percent * (na[:, None] + nb - both))


def similar_sets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets overlap enough; sizes too far apart are told without a look at the items."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    return similar(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), percent)


#: After so many pairs that prove unlike, the rest of a tile is decided by matrix products.
MOST_MISSES = 1000


def linked_labels(left: np.ndarray, right: np.ndarray, maybe: np.ndarray, label: np.ndarray, sets: dict[int, np.ndarray], percent: int):
    """Yield linked pairs (i, j) of rows that connect all labels that any pair in ``maybe`` connects, a forest.

    Pairs whose labels are connected by then are passed over.
    """
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    misses = 0
    for at in np.flatnonzero(maybe.any(1)).tolist():
        i = int(left[at])
        if misses > MOST_MISSES:
            break
        for j in right[maybe[at]].tolist():
            x, y = root(int(label[i])), root(int(label[j]))
            if x == y:
                continue
            if similar_sets(sets[i], sets[j], percent):
                top[max(x, y)] = min(x, y)
                yield i, j
            else:
                misses += 1
        maybe[at] = False
    rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    if not len(rows):
        return
    linked = links([sets[int(i)] for i in left[rows]], [sets[int(j)] for j in right[cols]], maybe[np.ix_(rows, cols)], percent)
    for r, c in np.argwhere(linked).tolist():
        i, j = int(left[rows[r]]), int(right[cols[c]])
        x, y = root(int(label[i])), root(int(label[j]))
        if x != y:
            top[max(x, y)] = min(x, y)
            yield i, j


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links that keep apart what all of ``linked`` (rows x columns) keep apart.

    Breadth-first, whole frontiers at a time; at most rows + columns links.
    """
    rows, cols = linked.any(1), linked.any(0)
    out_r, out_c = [], []
    while rows.any():
        front = np.array([np.argmax(rows)])
        rows[front] = False
        while len(front):
            part = linked[front] & cols
            new = np.flatnonzero(part.any(0))
            out_r.append(front[part[:, new].argmax(0)])
            out_c.append(new)
            cols[new] = False
            part = linked[:, new] & rows[:, None]
            front = np.flatnonzero(part.any(1))
            out_r.append(front)
            out_c.append(new[part[front].argmax(1)] if len(front) else front)
            rows[front] = False
    empty = np.empty(0, np.int64)
    return (np.concatenate(out_r), np.concatenate(out_c)) if out_r else (empty, empty)
