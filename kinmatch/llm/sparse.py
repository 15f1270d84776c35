"""Sparse rows in numpy: bags of hashed terms and products with dense matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Rows of (column, value) pairs, one after the other; ``ptr`` has a last entry."""

    ptr: np.ndarray
    col: np.ndarray
    val: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.ptr)[rows]
        ptr = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.ptr[rows] - ptr[:-1], size) + np.arange(ptr[-1])
        return Rows(ptr, self.col[at], self.val[at])

    def transposed(self, width: int) -> Rows:
        order = np.argsort(self.col, kind="stable")
        ptr = np.concatenate([[0], np.cumsum(np.bincount(self.col, minlength=width))])
        return Rows(ptr, self.row_of()[order], self.val[order])

    def dot(self, dense: np.ndarray, block: int = 100_000) -> np.ndarray:
        """Rows times a dense matrix, about ``block`` pairs at a time."""
        out = np.zeros((len(self), dense.shape[1]), dtype=dense.dtype)
        at = 0
        while at < len(self):
            end = max(at + 1, int(np.searchsorted(self.ptr, self.ptr[at] + block, side="right")) - 1)
            lo, hi = self.ptr[at], self.ptr[end]
            some = np.flatnonzero(np.diff(self.ptr[at : end + 1])) + at
            if len(some):
                part = dense[self.col[lo:hi]] * self.val[lo:hi, None].astype(dense.dtype)
                out[some] = np.add.reduceat(part, self.ptr[some] - lo, axis=0)
            at = end
        return out


def from_lists(cols: list[np.ndarray], vals: list[np.ndarray]) -> Rows:
    ptr = np.concatenate([[0], np.cumsum([len(c) for c in cols])]).astype(np.int64)
    if not cols:
        return Rows(ptr, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))
    return Rows(ptr, np.concatenate(cols), np.concatenate(vals).astype(np.float32))
