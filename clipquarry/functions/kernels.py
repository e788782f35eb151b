"""NumPy kernels for what columns cannot express well: dynamic time warping, token similarity, nearest centroids."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np


def unit_rows(m) -> np.ndarray:
    """Rows of a matrix scaled to length 1; zero rows stay."""
    m = np.asarray(m, np.float64)
    if m.ndim != 2 or not len(m):
        raise ValueError("a sequence is a matrix with at least one row")
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def window_for(n: int, m: int, fraction: float = 0.2) -> int:
    """The band's half width for sequences of n and m rows."""
    if not 0 <= fraction <= 1:
        raise ValueError("the window's fraction lies between 0 and 1")
    return max(math.ceil(max(n, m) * fraction), abs(n - m))


def _band(n: int, m: int, window: int | None) -> int:
    if window is None:
        return max(n, m)
    if window < 0:
        raise ValueError("a window is not negative")
    return max(window, abs(n - m))


def warp_costs(a, b, window: int | None = None) -> np.ndarray:
    """Accumulated cosine costs of aligning a with b, (n + 1) x (m + 1), infinite outside the band.

    Filled by anti-diagonals: all cells of one depend only on the two before it.
    """
    a, b = unit_rows(a), unit_rows(b)
    n, m = len(a), len(b)
    w = _band(n, m, window)
    local = 1.0 - a @ b.T
    acc = np.full((n + 1, m + 1), np.inf)
    acc[0, 0] = 0.0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m, -(-(d - w) // 2)), min(n, d - 1, (d + w) // 2) + 1)
        j = d - i
        acc[i, j] = local[i - 1, j - 1] + np.minimum(np.minimum(acc[i - 1, j], acc[i, j - 1]), acc[i - 1, j - 1])
    return acc


def dtw_distance(a, b, window: int | None = None) -> float:
    return float(warp_costs(a, b, window)[-1, -1])


def dtw_path(a, b, window: int | None = None) -> list[tuple[int, int]]:
    """The aligned pairs (row of a, row of b) in order. Of equal predecessors a step back in a comes first, then in b, then in both."""
    acc = warp_costs(a, b, window)
    i, j = acc.shape[0] - 1, acc.shape[1] - 1
    out = []
    while i and j:
        out.append((i - 1, j - 1))
        before = (acc[i - 1, j], acc[i, j - 1], acc[i - 1, j - 1])
        k = before.index(min(before))
        i, j = i - (k != 1), j - (k != 0)
    return out[::-1]


def envelope_bound(a, b, window: int, aligned: bool = False) -> float:
    """A lower bound of dtw_distance(a, b, window): half the squared distance of a's rows from the envelopes of b's.

    Envelopes are taken over the band that the warping may use, so the bound holds for unequal lengths
    too. With aligned=True they are centred on evenly spread rows of b instead, which is tighter but no bound
    if the lengths differ.
    """
    a, b = unit_rows(a), unit_rows(b)
    if window < 0:
        raise ValueError("a window is not negative")
    n, m = len(a), len(b)
    if aligned:
        centre = np.rint(np.linspace(0, m - 1, n)).astype(int) if n > 1 else np.zeros(1, int)
        w = window
    else:
        centre, w = np.arange(n), _band(n, m, window)
    total = 0.0
    for point, c in zip(a, centre.tolist(), strict=True):
        band = b[max(0, c - w) : c + w + 1]
        if len(band):
            off = np.maximum(point - band.max(0), 0) + np.maximum(band.min(0) - point, 0)
            total += float(off @ off) / 2
    return total


def maxsim(query, candidate) -> float:
    """For each row of query its best cosine in candidate, summed."""
    return float((unit_rows(query) @ unit_rows(candidate).T).max(axis=1).sum())


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid nearest to each point by squared distance; the first of equal ones."""
    points, centroids = np.asarray(points, np.float64), np.asarray(centroids, np.float64)
    out = np.empty(len(points), np.int64)
    half = (centroids**2).sum(1) / 2
    step = max(1, (16 << 20) // max(1, 8 * len(centroids)))
    for at in range(0, len(points), step):
        out[at : at + step] = (half - points[at : at + step] @ centroids.T).argmin(1)
    return out


def pack2(levels: np.ndarray) -> np.ndarray:
    """Levels 0 to 3 (rows x width), four to a byte, the first in the lowest bits."""
    x = np.asarray(levels, np.uint8)
    if x.shape[-1] % 4:
        raise ValueError("the width must be a multiple of 4")
    x = x.reshape(*x.shape[:-1], -1, 4)
    return (x << np.array([0, 2, 4, 6], np.uint8)).sum(-1).astype(np.uint8)


def unpack2(packed: np.ndarray, width: int) -> np.ndarray:
    x = np.asarray(packed, np.uint8)[..., None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    return x.reshape(*packed.shape[:-1], -1)[..., :width]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Doubles rounded as Spark's round does: half up, away from zero, of the shortest decimal form."""
    scale = 10.0**digits
    t = np.abs(x) * scale
    whole = np.floor(t)
    out = np.copysign((whole + (t - whole >= 0.5)) / scale, x)
    for i in np.flatnonzero(np.abs(t - whole - 0.5) < 1e-6).tolist():  # too near to a half for products
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out + 0.0  # no -0.0


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The dot product of each row of a with the same row of b, added up in the order of functions.vectors.dot."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


class Nearest:
    """The k rows most similar to each of the queries, of rows that come in batches: unit vectors, and whole numbers as keys.

    Scores rank rounded, equal ones by key, as SQL ranks them: NaN first. Matrix products in single precision only rule rows out that are below a query's
    k-th score by more than they can err; what is left is added up in double precision.
    """

    ROWS, QUERIES = 2048, 4096

    def __init__(self, queries: np.ndarray, k: int, digits: int) -> None:
        self.q, self.k, self.digits = queries, k, digits
        self.finite = np.isfinite(queries).all(1)
        self.q32 = np.where(self.finite[:, None], queries, 0).astype(np.float32)
        self.margin = 4e-7 * (queries.shape[1] + 4) + 2 * 10.0**-digits
        self.least = np.full(len(queries), -np.inf)  # of the k-th row found so far
        self.at, self.keys, self.score, self.rank = (np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.float64))
        self.nan = np.empty(0, np.int64)  # the first keys of rows that are not finite, whose score is NaN
        self.all = np.empty(0, np.int64)  # the first keys of all rows, for queries that are not finite
        self.more: list[tuple[np.ndarray, np.ndarray]] = []  # both, of rows that are for some queries only

    def _first(self, held: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.sort(np.r_[held, keys])[: self.k]

    def add(self, keys: np.ndarray, rows: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Rows for all queries, or for those whose numbers are given."""
        odd = ~np.isfinite(rows).all(1)
        if asked is None:
            self.nan, self.all = self._first(self.nan, keys[odd]), self._first(self.all, keys)
        else:
            for some, of in ((asked[self.finite[asked]], np.sort(keys[odd])[: self.k]), (asked[~self.finite[asked]], np.sort(keys)[: self.k])):
                if len(some) and len(of):
                    self.more.append((np.repeat(some, len(of)), np.tile(of, len(some))))
        if odd.any():
            keys, rows = keys[~odd], rows[~odd]
        if not len(keys):
            return
        keys, rows = self._different(keys, rows)
        rows32 = rows.astype(np.float32)
        numbers = np.flatnonzero(self.finite) if asked is None else asked[self.finite[asked]]
        for a in range(0, len(numbers), self.QUERIES):
            part = numbers[a : a + self.QUERIES]
            q32 = np.ascontiguousarray(self.q32[part])
            for b in range(0, len(keys), self.ROWS):
                s = q32 @ rows32[b : b + self.ROWS].T
                least = self.least[part]
                new = np.isneginf(least)
                if new.any() and s.shape[1] > self.k:
                    least[new] = np.partition(s[new], s.shape[1] - self.k, 1)[:, s.shape[1] - self.k]
                i, j = np.nonzero(s >= (least - self.margin).astype(np.float32)[:, None])
                if len(i):
                    self._take(part[i], keys[b + j], rows, b + j)

    def _different(self, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of equal rows those with the k first keys: no others can be among the k nearest."""
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], np.ascontiguousarray(rows[order]) + 0.0
        _, group, n = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True, return_counts=True)
        if len(n) == len(keys) or n.max() <= self.k:
            return keys, rows
        by = np.argsort(group, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[by] = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
        return keys[place < self.k], rows[place < self.k]

    def _take(self, at: np.ndarray, keys: np.ndarray, rows: np.ndarray, which: np.ndarray) -> None:
        score = np.concatenate([dots(self.q[at[c : c + 65_536]], rows[which[c : c + 65_536]]) for c in range(0, len(at), 65_536)])
        touched = np.zeros(len(self.q), bool)
        touched[at] = True
        old = touched[self.at]
        at, keys, score = np.r_[self.at[old], at], np.r_[self.keys[old], keys], np.r_[self.score[old], score]
        rank = np.r_[self.rank[old], rounded(score[np.count_nonzero(old) :], self.digits)]
        order = np.lexsort((keys, -rank, at))
        n = np.bincount(at, minlength=len(self.q))
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        kept = order[place < self.k]
        full = order[place == self.k - 1]
        self.least[at[full]] = rank[full]
        self.at, self.keys, self.score, self.rank = (np.r_[held[~old], new[kept]] for held, new in ((self.at, at), (self.keys, keys), (self.score, score), (self.rank, rank)))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, key, score), at least k rows for each if there are so many."""
        whole, odd = np.flatnonzero(self.finite), np.flatnonzero(~self.finite)
        at = np.concatenate([self.at, np.repeat(whole, len(self.nan)), np.repeat(odd, len(self.all)), *(x for x, _ in self.more)])
        keys = np.concatenate([self.keys, np.tile(self.nan, len(whole)), np.tile(self.all, len(odd)), *(x for _, x in self.more)])
        return at, keys, np.r_[self.score, np.full(len(at) - len(self.at), np.nan)]
