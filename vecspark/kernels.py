"""NumPy kernels with the engine's float rules, for Arrow-batched operators.

A float dot product rounds each product to single precision and adds them from left to
right in double precision; here that runs over all rows at once, one dimension at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

INT8_ONE = np.float32(16129)
#: Rows, and pairs of a row and a query, that are compared at once; rows found that wait to be merged.
ROWS = 1024
CELLS = 1 << 20
WAITING = 1 << 18


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as rows of equal length; raises ValueError otherwise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), np.float32)
    size = np.diff(np.asarray(column.offsets))
    if column.null_count or (size != size[0]).any():
        raise ValueError("vectors must be present and of one dimension")
    return np.asarray(column.flatten()).reshape(len(column), int(size[0]))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Similarities of all rows of x and q, as single-precision numbers."""
    if x.shape[1:] != q.shape[1:]:
        raise ValueError(f"dimensions differ: {x.shape[1:]} and {q.shape[1:]}")
    if x.dtype == np.int8:
        # sums of int8 products are whole numbers and exact in double precision
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.float32) / INT8_ONE
    if len(q) == 1 and 0 < len(x) <= 256 and x.shape[1]:  # the same sums, without a call for each dimension
        return (np.cumsum(x * q, axis=1, dtype=np.float64)[:, -1:] + 0.0).astype(np.float32)
    total = np.zeros((len(x), len(q)))
    for i in range(x.shape[1]):
        total += np.multiply.outer(x[:, i], q[:, i])
    return total.astype(np.float32)


def pair_scores(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """scores() of the pairs (i, j) alone; x and q have a vector a column."""
    whole = x.dtype == np.int8
    if whole:
        x = x.astype(np.float64)
    total = np.zeros(len(i))
    for a, b in zip(x, q, strict=True):
        total += a[i] * b[j]
    return total.astype(np.float32) / INT8_ONE if whole else total.astype(np.float32)


class Best:
    """The best k rows for each vector of q, of rows that come in parts: by similarity, then by order.

    A product of matrices in single precision, which is within `slack` of the similarity, leaves the few rows that may be
    among the best; these get their similarity as scores() has it. Vectors for which such a bound does not hold
    (not finite, or huge) are scored in full. NaN is no match, or above every number if nan_first.
    """

    def __init__(self, q: np.ndarray, k: int, threshold: float = -np.inf, nan_first: bool = False):
        self.q, self.k, self.nan_first = q, k, nan_first
        self.columns, self.single = np.ascontiguousarray(q.T), q.astype(np.float32)
        self.norm, self.plain = self._norms(q)
        # what the k best so far are known to reach
        self.bound = np.full(len(q), float(np.float32(threshold)))
        none = np.zeros(0, np.int64)
        self.kept, self.waiting, self.n = (none, none, none, np.zeros(0, np.float32)), [], 0

    @staticmethod
    def _norms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        return norm, norm < 1e15

    def add(self, ids: np.ndarray, order: np.ndarray, x: np.ndarray, own: np.ndarray | None = None) -> None:
        """Takes rows, for the vectors at `own` in q or for all."""
        if x.shape[1:] != self.q.shape[1:]:
            raise ValueError(f"dimensions differ: {x.shape[1:]} and {self.q.shape[1:]}")
        if self.k <= 0:
            return
        for at in range(0, len(x), ROWS):
            part = slice(at, at + ROWS)
            norm, plain = self._norms(x[part])
            for kind in (True, False):
                rows = np.flatnonzero(plain == kind)
                if len(rows):
                    self._rows(ids[part][rows], order[part][rows], x[part][rows], float(norm[rows].max()), kind, own)

    def _rows(self, ids: np.ndarray, order: np.ndarray, x: np.ndarray, norm: float, plain: bool, own: np.ndarray | None) -> None:
        columns, single = np.ascontiguousarray(x.T), x.astype(np.float32)
        n, step = len(self.q) if own is None else len(own), max(1, CELLS // len(x))
        for at in range(0, n, step):
            some = np.arange(at, min(n, at + step)) if own is None else own[at : at + step]
            fine = self.plain[some]
            for kind in (True, False):
                of = some[fine == kind]
                if not len(of):
                    continue
                if plain and kind and x.dtype != np.int8:
                    slack = (x.shape[1] + 8) * 2.0**-22 * self.norm[of] * norm + 1e-36
                    s = (self.single[at : at + step] if own is None and fine.all() else self.single[of]) @ single.T
                else:
                    slack = np.zeros(len(of))
                    with np.errstate(over="ignore", invalid="ignore"):
                        s = scores(x, self.q[of]).T
                    s[np.isnan(s)] = np.inf if self.nan_first else -np.inf
                hit = s >= self._need(of, slack)
                if len(x) > self.k and np.count_nonzero(hit) > 4 * self.k * len(of):
                    reached = np.partition(s, len(x) - self.k, axis=1)[:, len(x) - self.k]
                    self.bound[of] = np.maximum(self.bound[of], reached - slack)
                    hit = s >= self._need(of, slack)
                i, j = np.nonzero(hit)
                with np.errstate(over="ignore", invalid="ignore"):
                    sim = pair_scores(columns, self.columns, j, of[i])
                    good = sim >= self.bound[of[i]]
                good |= np.isnan(sim) & self.nan_first
                i, j = i[good], j[good]
                self.waiting.append((of[i], ids[j], order[j], sim[good]))
                self.n += len(i)
                if self.n > max(WAITING, 2 * len(self.kept[0])):
                    self._merge()

    def _need(self, of: np.ndarray, slack: np.ndarray) -> np.ndarray:
        return np.nextafter((self.bound[of] - slack).astype(np.float32), np.float32(-np.inf))[:, None]

    def _merge(self) -> None:
        at, ids, order, sim = (np.concatenate(c) for c in zip(self.kept, *self.waiting, strict=True))
        nan = np.isnan(sim)
        sort = np.lexsort((order, -np.where(nan, np.float32(np.inf), sim), ~nan, at))
        at, ids, order, sim = at[sort], ids[sort], order[sort], sim[sort]
        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        last = place == self.k - 1
        reached = np.where(np.isnan(sim[last]), np.inf, sim[last].astype(np.float64))
        self.bound[at[last]] = np.maximum(self.bound[at[last]], reached)
        keep = place < self.k
        self.kept, self.waiting, self.n = (at[keep], ids[keep], order[keep], sim[keep]), [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in q, id, order, similarity), by place and best first."""
        self._merge()
        return self.kept


def dot(a: np.ndarray, b: np.ndarray) -> np.float32:
    if a.dtype != np.float32 or b.dtype != np.float32 or a.shape != b.shape or not a.size:
        return scores(a[None, :], b[None, :])[0, 0]
    return np.float32(np.cumsum(a * b, dtype=np.float64)[-1] + 0.0)


def quantize(x: np.ndarray) -> np.ndarray:
    if np.isnan(x).any():
        raise ValueError("a vector with NaN cannot be quantised")
    whole = np.floor((np.asarray(x, np.float32) * np.float32(127)).astype(np.float64) + 0.5)
    return ((whole.astype(np.int64) + 128) % 256 - 128).astype(np.int8)


def dequantize(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) / np.float32(127)


def normalize(x: np.ndarray) -> np.ndarray:
    """Divides by the norm; its square is summed from left to right in single precision. A zero vector gives NaN."""
    x = np.asarray(x, np.float32)
    square = np.cumsum(x * x, axis=0)[-1] if len(x) else np.float32(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt(square)


def update_prototype(p: np.ndarray, new: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The prototype of n items after more items (the rows of new)."""
    if not len(new):
        raise ValueError("no new embeddings")
    total = np.zeros(len(p), np.float32)
    for row in new:
        total = total + row
    base = np.float32(n) * p if n > 0 else np.zeros(len(p), np.float32)
    return normalize((base + total) / np.float32(n + len(new))), n + len(new)
