"""Principal components and variable clusters, from the correlation matrix alone or from products with it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EIGEN_LIMIT = 1.0
#: Correlation matrices of at most so many variables are decomposed whole for their first component.
DECOMPOSED = 40


def best_component_correlation(corr: np.ndarray, k: int) -> np.ndarray:
    """For each variable the largest absolute correlation with the first k components: root of the eigenvalue times the loading."""
    if not len(corr):
        return np.zeros(0)
    values, vectors = np.linalg.eigh(corr)
    top = np.argsort(values)[::-1][:k]
    return np.abs(vectors[:, top] * np.sqrt(np.maximum(values[top], 0))).max(1)


def leading_pairs(products: Callable[[np.ndarray], np.ndarray], p: int, k: int, seed: int = 0, tolerance: float = 1e-9, most_passes: int = 40) -> tuple[np.ndarray, np.ndarray, float]:
    """(k largest eigenvalues, their vectors, bound of the error) of a symmetric positive matrix of which only products with a block are known.

    A random block is multiplied by the matrix over and over; all blocks, made
    orthogonal, span the space in which the eigenvectors are sought.  ``products``
    is one pass over the data.  It ends when no residual exceeds ``tolerance``
    times the largest eigenvalue: an eigenvalue lies that near to each value found.
    """
    width = min(k + 10, p)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((p, width)))[0]
    basis, image = np.zeros((p, 0)), np.zeros((p, 0))
    for _ in range(most_passes):
        found = products(block)
        basis, image = np.column_stack([basis, block]), np.column_stack([image, found])
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][:k]
        values, vectors = values[top], vectors[:, top]
        error = float(np.linalg.norm(image @ vectors - (basis @ vectors) * values, axis=0).max(initial=0.0))
        if error <= tolerance * max(float(values[0]), 1e-300) or basis.shape[1] >= p:
            break
        # What the new products add to the space, twice cleaned of what is there.
        for _ in range(2):
            found = found - basis @ (basis.T @ found)
        q, r = np.linalg.qr(found)
        keep = np.abs(np.diag(r)) > 1e-12 * max(float(values[0]), 1e-300)
        block = q[:, keep][:, : p - basis.shape[1]]
        if not block.shape[1]:
            break
    return values, basis @ vectors, error


def first_component(corr: np.ndarray) -> np.ndarray:
    """Loadings of the first component, the largest one positive."""
    values, vectors = np.linalg.eigh(corr)
    v = vectors[:, np.argmax(values)]
    return v if v[np.argmax(np.abs(v))] >= 0 else -v


class _Cluster:
    """A cluster's members with what follows from them, worked out once and again only after they change."""

    def __init__(self, corr: np.ndarray, members: list[int]):
        self.corr, self.members = corr, members
        self._second: float | None = None
        self._fit: np.ndarray | None = None
        self._loadings: np.ndarray | None = None

    def _block(self) -> np.ndarray:
        return self.corr[np.ix_(self.members, self.members)]

    @property
    def second(self) -> float:
        """The second largest eigenvalue."""
        if self._second is None:
            self._second = float(np.linalg.eigvalsh(self._block())[-2]) if len(self.members) > 1 else -np.inf
        return self._second

    @property
    def loadings(self) -> np.ndarray:
        """Of the first component, the largest one positive; of a large cluster by a few products instead of a whole decomposition."""
        if self._loadings is None:
            block = self._block()
            if len(block) > DECOMPOSED:
                _, vectors, error = leading_pairs(lambda q: block @ q, len(block), 1, tolerance=1e-12)
                v = vectors[:, 0]
                self._loadings = (v if v[np.argmax(np.abs(v))] >= 0 else -v) if error <= 1e-10 else first_component(block)
            else:
                self._loadings = first_component(block)
        return self._loadings

    @property
    def fit(self) -> np.ndarray:
        """Squared correlation of every variable with the cluster's first component: one matrix product."""
        if self._fit is None:
            shared = self.corr[:, self.members] @ self.loadings
            var = float(self.loadings @ shared[self.members])
            self._fit = np.where(np.diag(self.corr) > 0, np.minimum(shared * shared / var, 1.0), 0.0) if var > 0 else np.zeros(len(self.corr))
        return self._fit


def cluster(corr: np.ndarray, most: int, limit: float = EIGEN_LIMIT) -> list[tuple[int, int, float]]:
    """(variable, cluster from 1, (1 - r2 own) / (1 - r2 next)).

    The cluster with the largest second eigenvalue is split by the sign of its
    first loadings while that value is above ``limit`` and there are fewer than
    ``most``; after a split, variables move one at a time to the cluster that
    explains them best, for a bounded number of moves.  A split or move touches
    two clusters; components and fits of the others stay as they are.
    """
    if not len(corr):
        return []
    groups = [_Cluster(corr, list(range(len(corr))))]
    while len(groups) < most:
        worst = max(range(len(groups)), key=lambda k: groups[k].second)
        if groups[worst].second <= limit:
            break
        g = groups.pop(worst)
        plus = g.loadings >= 0
        halves = [v for v, s in zip(g.members, plus) if s], [v for v, s in zip(g.members, plus) if not s]
        if not all(halves):
            half = len(g.members) // 2
            halves = g.members[:half], g.members[half:]
        groups = _settled(corr, groups + [_Cluster(corr, h) for h in halves])
    fits = np.column_stack([g.fit for g in groups])
    out = []
    for c, g in enumerate(groups):
        for v in g.members:
            others = np.delete(fits[v], c)
            other = float(others.max()) if len(others) else 0.0
            out.append((v, c + 1, (1 - float(fits[v, c])) / (1 - other) if other < 1 else 0.0))
    return out


def _settled(corr: np.ndarray, groups: list[_Cluster]) -> list[_Cluster]:
    """Groups after moves: always the first variable, in the order of groups and members, that another cluster explains better."""
    fits = np.column_stack([g.fit for g in groups])
    for _ in range(10 * len(corr)):
        best = fits.argmax(1)
        gain = fits[np.arange(len(corr)), best]
        move = None
        for c, g in enumerate(groups):
            members = np.array(g.members)
            better = members[gain[members] > fits[members, c] + 1e-12]
            if len(better):
                move = int(better[0]), c, int(best[better[0]])
                break
        if not move:
            break
        v, c, k = move
        groups[c], groups[k] = _Cluster(corr, [x for x in groups[c].members if x != v]), _Cluster(corr, [*groups[k].members, v])
        for j in (c, k):
            if groups[j].members:
                fits[:, j] = groups[j].fit
        if not groups[c].members:
            del groups[c]
            fits = np.delete(fits, c, 1)
    return groups
