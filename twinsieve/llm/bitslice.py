"""Exact top-k by inner product over a bit-sliced index.

A block of rows keeps, for each attribute, one bitmap for each bit of its quantised values. A
query's weighted sum is made of those bitmaps alone: each signed binary digit of a weight adds
the attribute's slices at that place, by full adders over whole bitmaps. The lowest slices are
left out first; bounds on what they can add tell which rows could still be among the k largest.
Those are found from the most significant slice of the sum downward and resolved exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .blocks import CHUNK, blocked, packed, searched, unpacked
from .common import written

ROWS = 1 << 16
#: Rows whose quantised vector is of this length or more are no part of the slices: the product of two shorter ones is under 2**62, whatever the dimension. The others are scored with integers of any length.
LIMIT = 2.0**31
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(x: np.ndarray, scale: float = 256.0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(scale * x)


def narrow(x: np.ndarray) -> np.ndarray:
    """Which rows the slices can hold."""
    with np.errstate(over="ignore"):
        return np.sqrt((quantised(x) ** 2).sum(axis=1)) < LIMIT


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as Python integers; a double of 2**53 or more is whole before it is multiplied."""
    return np.array([[int(v) * 256 if abs(v) >= 2.0**53 else int(np.floor(256.0 * v)) for v in row] for row in x.tolist()], object).reshape(x.shape)


def sliced_block(ids: np.ndarray, x: np.ndarray) -> bytes:
    """The bytes of the sliced rows, their number first, and then the other rows as they are."""
    fine = narrow(x)
    first = _slices(ids[fine], quantised(x[fine]).astype("i8")) if fine.any() else b""
    return np.array([len(first)], "<i8").tobytes() + first + packed(ids[~fine], x[~fine])


def _slices(ids: np.ndarray, q: np.ndarray) -> bytes:
    """ids in ascending order, then for each attribute its offset, and the bitmaps of values less the offset."""
    order = np.argsort(ids, kind="stable")
    ids, q = ids[order], q[order]
    low = q.min(axis=0)
    u = (q - low).astype("u8")
    slices = max(1, int(u.max()).bit_length())
    words = -(-len(ids) // 64)
    planes = np.zeros((q.shape[1], slices, words * 8), "u1")
    for s in range(slices):
        bits = np.packbits((u >> np.uint64(s) & np.uint64(1)).astype("u1").T, axis=1, bitorder="little")
        planes[:, s, : bits.shape[1]] = bits
    return np.array([len(ids), slices], "<i8").tobytes() + ids.astype("<i8").tobytes() + low.astype("<i8").tobytes() + planes.tobytes()


def best_whole(ids: np.ndarray, q: np.ndarray, w: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
    """(score, vec_id) of the k best rows by integers of any length. A score beyond 64 bits counts as the nearest that they hold.

    Doubles tell first which rows can be among them, with the bound on their error; the others are not scored.
    """
    other = np.flatnonzero(ids != own)
    wf, qf = w.astype(float), q[other].astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        about, reach = qf @ wf, np.abs(qf) @ np.abs(wf) * 2.0**-40
    if len(other) > k and np.isfinite(about).all() and np.isfinite(reach).all():
        kth = min(np.sort(about - reach)[-k], float(_MOST))  # equal ones at the end of 64 bits are told apart by id
        other = other[about + reach >= kth * (1 - 2.0**-40) - 1]
    scores = [(max(_LEAST, min(_MOST, int(q[i] @ w))), int(ids[i])) for i in other]
    return sorted(scores, key=lambda x: (-x[0], x[1]))[:k]


class Block:
    def __init__(self, dim: int, data: bytes) -> None:
        n, self.slices = (int(x) for x in np.frombuffer(data, "<i8", 2))
        self.ids = np.frombuffer(data, "<i8", n, 16)
        self.low = np.frombuffer(data, "<i8", dim, 16 + 8 * n)
        self.planes = np.frombuffer(data, "<u8", -1, 16 + 8 * n + 8 * dim).reshape(dim, self.slices, -1)
        full = np.zeros(self.planes.shape[2] * 64, "u1")
        full[:n] = 1
        self.full = np.packbits(full, bitorder="little").view("<u8")

    def exact(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of these rows, from all slices."""
        bits = self.planes[:, :, rows >> 6] >> (rows & 63).astype("u8") & np.uint64(1)
        values = np.tensordot(bits.astype("i8"), np.int64(1) << np.arange(self.slices, dtype="i8"), axes=(1, 0))
        return weights @ (values + self.low[:, None])

    def values(self) -> np.ndarray:
        """All rows' quantised values."""
        at = np.arange(len(self.ids))
        bits = self.planes[:, :, at >> 6] >> (at & 63).astype("u8") & np.uint64(1)
        return (np.tensordot(bits.astype("i8"), np.int64(1) << np.arange(self.slices, dtype="i8"), axes=(1, 0)) + self.low[:, None]).T

    def summed(self, weights: np.ndarray, drop: int) -> list[np.ndarray]:
        """Slices of the sum of weights times values, lowest first, without the values' lowest `drop` slices and up to a constant."""
        columns: list[list[np.ndarray]] = []
        held: dict[tuple[int, int], np.ndarray] = {}

        def put(place: int, plane: np.ndarray) -> None:
            while len(columns) <= place:
                columns.append([])
            columns[place].append(plane)

        for j, w in enumerate(weights.tolist()):
            place = 0
            while w:
                if w & 1:
                    digit = 2 - (w & 3)  # of the non-adjacent form: 1 or -1
                    for s in range(drop, self.slices):
                        if digit > 0:
                            put(place + s, self.planes[j, s])
                        else:
                            if (j, s) not in held:
                                held[j, s] = ~self.planes[j, s]
                            put(place + s, held[j, s])
                    w -= digit
                w >>= 1
                place += 1
        out, at = [], 0
        while at < len(columns):
            planes = columns[at]
            while len(planes) > 1:
                a, b = planes.pop(), planes.pop()
                t = a ^ b
                if planes:
                    c = planes.pop()
                    planes.append(t ^ c)
                    put(at + 1, (a & b) | (t & c))
                else:
                    put(at + 1, a & b)
                    planes.append(t)
            out.append(planes[0] if planes else np.zeros_like(self.full))
            at += 1
        return out

    def best(self, weights: np.ndarray, k: int, own: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k best rows other than the query's own, by score and then id."""
        drop = min(drop, self.slices - 1)
        inside = self.full
        mine = np.arange(np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right"))
        if len(mine):
            inside = inside.copy()
            np.bitwise_and.at(inside, mine >> 6, ~(np.uint64(1) << (mine & 63).astype("u8")))
        slices = self.summed(weights, drop)
        left, certain, threshold, need = inside, 0, 0, k
        for s in range(len(slices) - 1, -1, -1):  # the k-th largest sum, from the most significant slice downward
            ones = left & slices[s]
            n = int(np.bitwise_count(ones).sum())
            if n >= need:
                left, threshold = ones, threshold | 1 << s
            else:
                certain, need = certain + n, need - n
                left = left & ~slices[s]
        reach = int(np.abs(weights).sum()) * ((1 << drop) - 1)
        floor = max(0, threshold - reach)
        above, equal = np.zeros_like(inside), inside
        for s in range(len(slices) - 1, -1, -1):  # rows whose sum is at least floor
            if floor >> s & 1:
                equal = equal & slices[s]
            else:
                above |= equal & slices[s]
                equal = equal & ~slices[s]
        rows = np.flatnonzero(np.unpackbits((above | equal).view("u1"), bitorder="little"))
        score = np.concatenate([self.exact(rows[i : i + 8192], weights) for i in range(0, len(rows), 8192)]) if len(rows) else np.empty(0, "i8")
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][order], score[order]


def top_k(rows: DataFrame, k: int = 5, every: int = 50, drop: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id divides by `every`, its k best others by integer inner product.

    Vectors are quantised to floor(256 x). Those that are null, empty, or hold a null or a component
    that isn't finite take no part; nor do null ids. A score beyond a long counts as the nearest long.
    Vectors of other lengths than a query's are no candidates of it. Rows that repeat an id are
    candidates each, but never of a query with that id; a repeated query is answered once. An empty table gives no rows.
    """
    index = written(blocked(rows, id_col, vec_col, ROWS, sliced_block), "bit-slices", "none", 1)
    queries = written(blocked(rows, id_col, vec_col, CHUNK, packed, where=f"`{id_col}` % {every} = 0", coalesce=False), "queries", "none")

    def opened(dim: int, data: bytes) -> Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size = int(np.frombuffer(data, "<i8", 1)[0])
        block = Block(dim, data[8 : 8 + size]) if size else None
        wide_ids, wide = unpacked(data[8 + size :], dim)
        wide = whole(wide)

        def search(chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            owns, x = unpacked(chunk, dim)
            every_id = every_q = None
            found: list[tuple[int, int, int]] = []
            for own, v, fits in zip(owns.tolist(), x, narrow(x)):
                if fits:
                    w = quantised(v).astype("i8")
                    hits = list(zip(*(a.tolist() for a in block.best(w, k, own, drop)[::-1]))) if block else []
                    hits += best_whole(wide_ids, wide, w.astype(object), k, own) if len(wide_ids) else []
                else:
                    if every_id is None:
                        every_id = np.concatenate([block.ids, wide_ids]) if block else wide_ids
                        every_q = np.concatenate([block.values().astype(object), wide]) if block else wide
                    hits = best_whole(every_id, every_q, whole(v[None])[0], k, own)
                found += [(own, i, s) for s, i in sorted(hits, key=lambda h: (-h[0], h[1]))[:k]]
            return tuple(np.array(c, "i8") for c in zip(*found)) if found else (np.empty(0, "i8"),) * 3

        return search

    return searched(index, queries, k, opened, "long")
