"""Gradient-boosted trees in numpy: histogram splits, log loss, monotonic constraints, and flat
node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray  # a value <= threshold goes left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches; all rows and trees walk down together."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(left, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 48,
    min_rows: int = 8,
    ridge: float = 1.0,
) -> FlatTrees:
    """``monotone``: +1, -1 or 0 a feature; the score never falls (+1) or rises (-1) with it.

    A split against a constraint is refused, and the middle of the two sides bounds the leaves
    below it, so the constraint holds over the whole tree. One class only, or no rows, gives a
    constant.
    """
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node() -> int:
        k = len(nodes["feature"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", 0.0)):
            nodes[name].append(v)
        return k

    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            root = node()
            roots.append(root)
            todo = [(root, np.arange(n), 0, -np.inf, np.inf)]
            while todo:
                k, rows, level, low, high = todo.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                best = None
                if level < depth and len(rows) >= 2 * min_rows:
                    for f in range(width):
                        m = len(cuts[f])
                        if not m:
                            continue
                        b = binned[rows, f]
                        gl = np.cumsum(np.bincount(b, grad[rows], m + 1))[:m]
                        hl = np.cumsum(np.bincount(b, hess[rows], m + 1))[:m]
                        nl = np.cumsum(np.bincount(b, minlength=m + 1))[:m]
                        vl = np.clip(-gl / (hl + ridge), low, high)
                        vr = np.clip(-(g - gl) / (h - hl + ridge), low, high)
                        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                        ok = (nl >= min_rows) & (len(rows) - nl >= min_rows)
                        if monotone[f]:
                            ok &= monotone[f] * (vr - vl) >= 0
                        gain = np.where(ok, gain, -np.inf)
                        c = int(gain.argmax())
                        if gain[c] > 1e-6 and (best is None or gain[c] > best[0]):
                            best = (gain[c], f, c, vl[c], vr[c])
                if best is None:
                    nodes["value"][k] = v = rate * float(np.clip(-g / (h + ridge), low, high))
                    margin[rows] += v
                    continue
                _, f, c, vl, vr = best
                nodes["feature"][k], nodes["threshold"][k] = f, float(cuts[f][c])
                nodes["left"][k], nodes["right"][k] = a, b = node(), node()
                left = binned[rows, f] <= c
                mid = (vl + vr) / 2
                bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}.get(int(monotone[f]), ((low, high), (low, high)))
                todo.append((a, rows[left], level + 1, *bounds[0]))
                todo.append((b, rows[~left], level + 1, *bounds[1]))
    return FlatTrees(
        np.array(nodes["feature"], dtype=np.int64),
        np.array(nodes["threshold"], dtype=np.float64),
        np.array(nodes["left"], dtype=np.int64),
        np.array(nodes["right"], dtype=np.int64),
        np.array(nodes["value"], dtype=np.float64),
        np.array(roots, dtype=np.int64),
        base,
        depth,
    )
