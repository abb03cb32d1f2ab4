"""The nearest of one block of vectors for one block of queries, by one matrix product and exact distances of what is close."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distances that are held at once.
_CELLS = 1 << 21


def _matrices(lists: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: which rows have so many, none null, and their values."""
    sizes, out = np.asarray(pc.fill_null(pc.list_value_length(lists), -1)), {}
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == n)
        flat = pc.list_flatten(pc.take(lists, pa.array(at)))
        whole = ~np.asarray(pc.is_null(flat)).reshape(len(at), n).any(axis=1)
        out[int(n)] = at[whole], np.asarray(flat).astype(np.float64).reshape(len(at), n)[whole]
    return out


def _codes(table: pa.Table, by: list[str]) -> np.ndarray:
    """A number for each row's values of by."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for c in by:
        _, here = np.unique(np.asarray(pc.dictionary_encode(table[c], null_encoding="encode").combine_chunks().indices), return_inverse=True)
        _, code = np.unique(code * (here.max(initial=0) + 1) + here, return_inverse=True)
    return code


def _first_copies(v: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """Rows but those that have k equal ones with the same code before them."""
    whole = np.ascontiguousarray(np.c_[code.astype(np.float64), v])
    _, kind = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.argsort(kind, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(kind[order]) > 0])
    return np.sort(order[np.arange(len(v)) - np.repeat(begins, np.diff(np.r_[begins, len(v)])) < k])


class _Product:
    """What is close to queries by one matrix product of vectors and queries, both less the vectors' mean; exact up to a stated error."""

    def __init__(self, v: np.ndarray, q: np.ndarray, real: type) -> None:
        top = float(np.finfo(real).max) / 16  # larger squares are left to the exact distances
        fits = np.square(v).sum(1) < top
        mean = v[fits].mean(axis=0) if fits.any() else np.zeros(v.shape[1])
        v, q = v - mean, q - mean
        v2, self.q2 = np.square(v).sum(1), np.square(q).sum(1)
        self.far, self.far_q = ~(v2 < top), ~(self.q2 < top)
        v[self.far], v2[self.far], q[self.far_q], self.q2[self.far_q] = 0, np.inf, 0, 0
        self.v2 = v2
        self.left, self.right = np.c_[-2 * q, np.ones(len(q))].astype(real), np.c_[v, v2].astype(real).T
        self.error, self.least, self.real = 4 * (v.shape[1] + 4) * float(np.finfo(real).eps), 64 * (v.shape[1] + 4) * float(np.finfo(real).tiny), real

    def close(self, some: slice, cuts: list[int], k: int, unit: float) -> tuple[np.ndarray, np.ndarray]:
        """For each of some queries, which vectors may be among the k nearest between two cuts; and the product.

        The product errs by at most e (q² + v²), and v² <= 2 q² + 2 d for a squared distance d.
        """
        p, q2, e = self.left[some] @ self.right, self.q2[some], self.error
        mark = np.empty(p.shape, dtype=bool)
        for a, b in zip(cuts, cuts[1:]):
            d = (_kth(p[:, a:b], k).astype(np.float64) + q2 + 3 * e * q2 + self.least) / (1 - 2 * e)
            most = (d + unit) * (1 + 2 * e) + 3 * e * q2 - q2 + self.least
            np.less_equal(p[:, a:b], np.nextafter(most.astype(self.real), self.real(np.inf))[:, None], out=mark[:, a:b])
        mark[:, self.far] = True
        mark[self.far_q[some]] = True
        return mark, p

    def rough(self, some: slice, p: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the rows i of some queries and j of the vectors by their product, and how far these may be out; infinite for those left out of it."""
        q2, v2 = self.q2[some][i], self.v2[j]
        known = np.isfinite(v2) & ~self.far_q[some][i]
        return np.where(known, p[i, j] + q2, np.inf), np.where(known, 2 * self.error * (q2 + v2) + self.least, np.inf)


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """A value that at least k of each row don't exceed, infinite if there are fewer: the k-th of the least values of parts."""
    if x.shape[1] < k:
        return np.full(len(x), np.inf)
    parts = max(1, x.shape[1] // (8 * k))
    if parts > 1:
        wide = x.shape[1] // parts
        x = x[:, : parts * wide].reshape(len(x), parts, wide).min(axis=1)
    return np.partition(x, k - 1, axis=1)[:, k - 1]


def _distances(v: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the rows i of q and j of v, added from the first to the last component, as an SQL expression does."""
    out, step = np.zeros(len(i)), max(1, _CELLS // max(1, v.shape[1]))
    for at in range(0, len(i) if v.shape[1] else 0, step):
        out[at : at + step] = np.square(v[j[at : at + step]] - q[i[at : at + step]]).cumsum(axis=1)[:, -1]
    return out


def _snapped(d: np.ndarray, digits: int, out: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Distances, known but for out, rounded to so many places where there is no doubt which way, else as they are; and which are rounded."""
    y = d * 10.0**digits
    doubt = out * 10.0**digits + 8 * np.finfo(float).eps * (np.abs(y) + 1)
    low, high = np.floor(y + 0.5 - doubt), np.floor(y + 0.5 + doubt)
    sure = (low == high) & np.isfinite(y)
    return np.where(sure, low / 10.0**digits, d), sure


def _first(group: np.ndarray, d: np.ndarray, k: int, unit: float, equal_stay: np.ndarray | bool = False) -> np.ndarray:
    """Rows, sorted by group, that may be among the k nearest of their group once distances are rounded to units; of equal distances the first k rows, and those marked equal_stay."""
    stay = np.broadcast_to(equal_stay, len(d))
    order = np.lexsort((stay, d, group))
    group, d, stay, place = group[order], d[order], stay[order], np.arange(len(order))
    new = np.r_[True, np.diff(group) != 0]
    begins = np.flatnonzero(new)
    ends = np.r_[begins[1:], len(order)]
    begin, last = (np.repeat(x, ends - begins) for x in (begins, np.minimum(begins + k, ends) - 1))
    equal = np.maximum.accumulate(np.where(new | np.r_[True, (d[1:] != d[:-1]) | (stay[1:] != stay[:-1])], place, 0))
    return order[(place - begin < k) | ((d <= d[last] + unit) & (stay | (place - equal < k)))]


def _thinned(group: np.ndarray, d: np.ndarray, out_by: np.ndarray, k: int, unit: float, digits: int) -> np.ndarray:
    """Rows, sorted by group, that may be among the k nearest by distances known but for out_by; of those that surely round to one distance the first k rows, in order.

    Whichever way a doubtful distance rounds, it stays.
    """
    known = np.isfinite(out_by)
    if not known.any():
        return np.arange(len(d))
    d, sure = _snapped(d, digits, out_by)
    few = _first(group[known], d[known], k, unit + 4 * out_by[known].max(initial=0), ~sure[known])
    return np.sort(np.r_[np.flatnonzero(known)[few], np.flatnonzero(~known)])


def nearest(vectors: pa.Table, queries: pa.Table, k: int, by: list[str], digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of vectors, rows of queries, squared distances): for each query and each of by's values all rows that may be among its k nearest.

    vectors (chunk_id, embedding, ...), sorted by chunk_id; queries (q).  Rows with a null or with
    another number of components than a query have no distance to it.  The product has short
    floats; where these can't tell many vectors apart, long ones.
    """
    held, code, unit, out = _matrices(vectors["embedding"]), _codes(vectors, by), 1.01 * 10.0**-digits, []
    with np.errstate(all="ignore"):
        for n, (qs, q) in _matrices(queries["q"]).items():
            if n not in held or not len(held[n][0]) or not len(qs):
                continue
            rows, v = held[n]
            order = np.argsort(code[rows], kind="stable")
            order = order[_first_copies(v[order], code[rows][order], k)]
            rows, v, group = rows[order], v[order], code[rows][order]
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(rows)]
            short, long = _Product(v, q, np.float32), None
            step = max(1, _CELLS // len(rows))
            for at in range(0, len(qs), step):
                some = slice(at, at + step)
                mark, p = short.close(some, cuts, k, unit)
                if crowded := np.count_nonzero(mark) > len(mark) * (8 * k * (len(cuts) - 1)):
                    long = long or _Product(v, q, np.float64)
                    mark, p = long.close(some, cuts, k, unit)
                i, j = np.divmod(np.flatnonzero(mark), len(rows))
                of = i * (len(cuts) - 1) + np.searchsorted(cuts, j, side="right") - 1
                if crowded:
                    d, out_by = long.rough(some, p, i, j)
                    few = _thinned(of, d, out_by, k, unit, digits)
                    i, j, of = i[few], j[few], of[few]
                d = _distances(v, q, at + i, j)
                best = _first(of, _snapped(d, digits)[0], k, unit)
                out.append((rows[j[best]], qs[at + i[best]], d[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
