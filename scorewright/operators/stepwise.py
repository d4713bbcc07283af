"""Forward selection: linear from one Gram matrix, logistic by score tests with one pass a step."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_upper, t_two_sided
from .moments import Gram, gram, means, summed

NEWTON_STEPS = 25


def forward_linear(moments: Gram, dep_var: str, alpha: float) -> list[tuple[str, int, float]]:
    """(variable, step, p): each step adds the variable with the smallest p, while that is at most ``alpha``.

    p of a candidate is that of its coefficient beside those selected; all come
    from centred products by sweeping in the selected variables.
    """
    names = [n for n in moments.names if n != dep_var]
    i = [moments.names.index(n) for n in names] + [moments.names.index(dep_var)]
    a = moments.products[np.ix_(i, i)].copy()
    full, n = np.diag(a).copy(), moments.rows
    left, out = list(range(len(names))), []
    while left:
        dof = n - len(out) - 2
        best, best_p = None, 1.0
        if a[-1, -1] <= 1e-13 * full[-1]:  # nothing left to explain
            break
        for k in left:
            if dof <= 0 or a[k, k] <= 1e-10 * max(full[k], 1e-300):
                continue
            slope = a[k, -1] / a[k, k]
            rest = max(a[-1, -1] - slope * a[k, -1], 0.0)
            t = slope / math.sqrt(rest / dof / a[k, k]) if rest > 1e-14 * max(full[-1], 1e-300) else math.inf
            p = t_two_sided(t, dof)
            if p < best_p:
                best, best_p = k, p
        if best is None or best_p > alpha:
            break
        out.append((names[best], len(out) + 1, best_p))
        left.remove(best)
        column = a[:, best].copy()
        a -= np.outer(column, column) / column[best]
    return out


def stepwise_linear(df: DataFrame, variables: list[str], dep_var: str, alpha: float, weight: str | None = None, known: Gram | None = None) -> list[tuple[str, int, float]]:
    """Forward linear selection on the rows where all variables are present; ``known`` are their moments, if there are any already."""
    if not variables:
        return []
    return forward_linear(known.part([*variables, dep_var]) if known else gram(df, [*variables, dep_var], weight), dep_var, alpha)


class _Logit:
    """Newton's method over distributed sums, on standardised columns. Weights count as frequencies or as precisions alike in every sum used here."""

    def __init__(self, df: DataFrame, variables: list[str], dep_var: str, weight: str | None):
        self.names, self.weight = variables, weight
        self.columns = [*variables, dep_var, *([weight] if weight else [])]
        self.df = df.na.drop(subset=self.columns).select(*self.columns).persist()
        self.centre = means(self.df, variables)
        row = self.df.agg(*[F.coalesce(F.stddev_pop(F.col(f"`{v}`").cast("double")), F.lit(0.0)) for v in variables]).first()
        self.scale = np.array([s if s > 0 else 1.0 for s in row])
        self.constant = {v for v, s in zip(variables, row) if not s > 1e-12}

    def close(self) -> None:
        self.df.unpersist()

    def sums(self, beta: np.ndarray, inside: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        """(log likelihood, gradient, information) over intercept and all variables, at a model of those inside."""
        p, centre, scale, weighted = len(self.names), self.centre, self.scale, self.weight is not None

        def add(x: np.ndarray) -> np.ndarray:
            z = np.column_stack([np.ones(len(x)), (x[:, :p] - centre) / scale])
            y, w = x[:, p], x[:, p + 1] if weighted else np.ones(len(x))
            eta = z[:, [0, *[i + 1 for i in inside]]] @ beta
            mu = np.where(eta >= 0, 1 / (1 + np.exp(-np.abs(eta))), np.exp(-np.abs(eta)) / (1 + np.exp(-np.abs(eta))))
            like = (w * (y * eta - np.maximum(eta, 0) - np.log1p(np.exp(-np.abs(eta))))).sum()
            v = w * mu * (1 - mu)
            return np.concatenate([[like], z.T @ (w * (y - mu)), ((z * v[:, None]).T @ z).ravel()])

        q = p + 1
        s = summed(self.df, self.columns, 1 + q + q * q, add)
        return s[0], s[1 : 1 + q], s[1 + q :].reshape(q, q)

    def trials(self, beta: np.ndarray, inside: list[int], candidates: list[int]) -> dict[int, tuple[np.ndarray, float]]:
        """{candidate: (beta, log likelihood)} of the models with one more variable each, all fitted in the same passes.

        A candidate's information matrix is an arrow: the block of the model so
        far at its own means, one more row, and a diagonal term.  A pass returns
        for each candidate its likelihood, gradient and that matrix, whatever the
        number of candidates.  Fits that don't converge are left out.
        """
        p, centre, scale, weighted = len(self.names), self.centre, self.scale, self.weight is not None
        base, q = [0, *[i + 1 for i in inside]], len(inside) + 1
        pairs = [(a, b) for a in range(q) for b in range(a, q)]
        going = {c: np.append(beta, 0.0) for c in candidates}
        done: dict[int, tuple[np.ndarray, float]] = {}
        for _ in range(NEWTON_STEPS):
            if not going:
                break
            order = list(going)
            b = np.array([going[c] for c in order]).T

            def add(x: np.ndarray) -> np.ndarray:
                total = 0.0
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    z = np.column_stack([np.ones(len(part)), (part[:, :p] - centre) / scale])
                    own, more = z[:, base], z[:, [c + 1 for c in order]]
                    y, w = part[:, p : p + 1], part[:, p + 1 : p + 2] if weighted else 1.0
                    eta = own @ b[:q] + more * b[q]
                    small = np.exp(-np.abs(eta))
                    mu = np.where(eta >= 0, 1 / (1 + small), small / (1 + small))
                    r, v = w * (y - mu), w * mu * (1 - mu)
                    like = (w * (y * eta - np.maximum(eta, 0) - np.log1p(small))).sum(0)
                    both = np.column_stack([own[:, i] * own[:, j] for i, j in pairs])
                    total = total + np.concatenate([like, (own.T @ r).ravel(), (more * r).sum(0), (own.T @ (v * more)).ravel(), (v * more * more).sum(0), (both.T @ v).ravel()])
                return total if len(x) else np.zeros(size)

            m = len(order)
            size = m * (1 + q + 1 + q + 1 + len(pairs))
            s = np.split(summed(self.df, self.columns, size, add), np.cumsum([m, q * m, m, q * m, m]))
            for k, c in enumerate(order):
                u = np.append(s[1].reshape(q, m)[:, k], s[2][k])
                h = np.zeros((q + 1, q + 1))
                for (i, j), value in zip(pairs, s[5].reshape(len(pairs), m)[:, k]):
                    h[i, j] = h[j, i] = value
                h[q, :q] = h[:q, q] = s[3].reshape(q, m)[:, k]
                h[q, q] = s[4][k]
                try:
                    step = np.linalg.solve(h, u)
                except np.linalg.LinAlgError:
                    step = np.full(q + 1, np.nan)
                now = going[c]
                if not np.isfinite(step).all() or np.abs(now).max() > 1e3:
                    del going[c]
                elif np.abs(step).max() < 1e-9 * (1 + np.abs(now).max()):
                    done[c] = now, float(s[0][k])
                    del going[c]
                else:
                    going[c] = now + step * min(1.0, 5 / max(np.abs(step).max(), 1e-300))
        return done

    def fit(self, beta: np.ndarray, inside: list[int]) -> tuple[np.ndarray, float, np.ndarray, np.ndarray] | None:
        """(beta, log likelihood, gradient, information) at the maximum; None if there is none."""
        at = [0, *[i + 1 for i in inside]]
        for _ in range(NEWTON_STEPS):
            like, u, h = self.sums(beta, inside)
            try:
                step = np.linalg.solve(h[np.ix_(at, at)], u[at])
            except np.linalg.LinAlgError:
                return None
            if not np.isfinite(step).all() or np.abs(beta).max() > 1e3:
                return None
            if np.abs(step).max() < 1e-9 * (1 + np.abs(beta).max()):
                return beta, like, u, h
            beta = beta + step * min(1.0, 5 / max(np.abs(step).max(), 1e-300))
        return None


def stepwise_logistic(df: DataFrame, variables: list[str], dep_var: str, alpha: float, weight: str | None = None, likelihood_ratio: bool = False) -> list[tuple[str, int, float]]:
    """(variable, step, p): forward selection by the score test of each candidate, or by likelihood ratio.

    The sums of the last Newton step of the current model hold the score
    statistics of all candidates at once, so a step costs the passes of one fit;
    with likelihood ratios all candidates' models are fitted in the same passes.
    The largest statistic enters: on many rows p is 0 in double for several.
    """
    if not variables:
        return []
    model = _Logit(df, variables, dep_var, weight)
    try:
        inside: list[int] = []
        out: list[tuple[str, int, float]] = []
        at = model.fit(np.zeros(1), inside)
        while at and len(inside) < len(variables):
            beta, like, u, h = at
            base = [0, *[i + 1 for i in inside]]
            left = [i for i, name in enumerate(variables) if i not in inside and name not in model.constant]
            found: dict[int, float] = {}
            if likelihood_ratio:
                trials = model.trials(beta, inside, left)
                found = {i: 2 * (trials[i][1] - like) for i in left if i in trials}
            else:
                trials = {}
                for i in left:
                    k = i + 1
                    spread = h[k, k] - h[k, base] @ np.linalg.solve(h[np.ix_(base, base)], h[base, k])
                    if spread > 1e-10 * h[k, k]:
                        found[i] = u[k] ** 2 / spread
            best = max(found, key=lambda i: (found[i], -i), default=None)
            p = 1.0 if best is None else chi2_upper(found[best])
            if best is None or not p < 1.0 or p > alpha:
                break
            inside.append(best)
            out.append((variables[best], len(out) + 1, p))
            at = model.fit(trials[best][0] if best in trials else np.append(beta, 0.0), inside)
        return out
    finally:
        model.close()
