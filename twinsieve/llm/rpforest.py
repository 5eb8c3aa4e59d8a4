"""Approximate nearest neighbours by a forest of random-projection trees.

Rows lie in shards; a shard has a forest of its own over all its rows. The nodes of one level of
a tree share a random direction and split at their medians. A query descends all trees through
one priority queue: the branch not taken waits with the smallest margin on its way, and the best
waiting branch of any tree is next, until enough distinct rows are found. Those are ranked exactly. How
many are enough is measured: the share of a shard at which a sample of queries finds its nearest.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import CHUNK, blocked, packed, searched, unpacked
from .common import trim, written

ROWS = 1 << 15
#: Products of queries with points that a search holds before those that are not among the best are dropped.
HITS = 1 << 17
#: Pairs whose scores are added up at once.
PAIRS = 1 << 14
#: Shares of a shard that a search may look at.
SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def fixed_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last: the same bits for a pair wherever it is computed."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a, more than two ways to add up its product with a row of b can differ by."""
    with np.errstate(over="ignore", invalid="ignore"):
        largest = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1).max(initial=0.0))
    return np.where(np.isfinite(largest), largest, 0.0) * a.shape[1] * 2.0**-50


class Forest:
    """Trees over distinct vectors; equal vectors are one point with all their ids. saved() and loaded() make bytes of a grown one, so it grows once."""

    PARTS = ("x", "ids", "ends", "directions", "cuts", "order", "bounds")

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int, leaf: int, seed: int = 1) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.x, point = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(point.ravel(), kind="stable")
        self.ids, self.ends = ids[by], np.r_[0, np.cumsum(np.bincount(point.ravel(), minlength=len(self.x)))]
        n, dim = self.x.shape
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((trees, self.depth, dim))
        self.cuts, self.order, self.bounds = np.zeros((trees, 1 << self.depth)), np.zeros((trees, n), "i4"), np.zeros((trees, (1 << self.depth) + 1), "i4")
        for t in range(trees):
            at, bounds = np.arange(n), np.array([0, n])
            for level in range(self.depth):
                p = self.x[at] @ self.directions[t, level]
                node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                rank = np.lexsort((p, node))
                at, p = at[rank], p[rank]
                middle = (bounds[:-1] + bounds[1:]) // 2
                self.cuts[t, 1 << level : 2 << level] = p[np.minimum(middle, n - 1)]  # a heap: node i of a level is at 2**level + i
                bounds = np.sort(np.concatenate([bounds, middle]))
            self.order[t], self.bounds[t] = at, bounds

    def saved(self) -> bytes:
        out = io.BytesIO()
        single = self.x.astype("f4")
        np.savez(out, **{p: getattr(self, p) for p in self.PARTS} | {"x": single if (single == self.x).all() else self.x})
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> "Forest":
        self, held = cls.__new__(cls), np.load(io.BytesIO(data))
        for p in cls.PARTS:
            setattr(self, p, held[p])
        self.x, self.depth = self.x.astype("f8"), self.directions.shape[1]
        return self

    def leaves(self, q: np.ndarray, wanted: int) -> list[list[int]]:
        """For each query, the leaves (tree << depth | leaf) that its queue yields until they hold `wanted` distinct points."""
        return [found for found, _ in self._yielded(q, wanted)]

    def needed(self, own: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """How many distinct points a query's queue has yielded before the leaf with each of its k nearest points, for all queries."""
        score = q @ self.x.T
        score[np.arange(len(q)), own] = -np.inf
        k = min(k, len(self.x) - 1)
        near = np.argpartition(-score, k - 1, axis=1)[:, :k] if k else np.zeros((len(q), 0), int)
        leaf = np.empty(self.order.shape, "i8")
        for t, rows in enumerate(self.order):
            leaf[t, rows] = t << self.depth | np.repeat(np.arange(1 << self.depth), np.diff(self.bounds[t]))
        out = []
        for points, (found, before) in zip(near, self._yielded(q, len(self.x))):
            first = np.full(len(self.order) << self.depth, len(self.x))
            first[found[::-1]] = before[::-1]
            out.append(first[leaf[:, points]].min(axis=0))
        return np.concatenate(out) if out else np.empty(0, "i8")

    def _yielded(self, q: np.ndarray, wanted: int) -> list[tuple[list[int], list[int]]]:
        """For each query its leaves in order, and how many distinct points came before each."""
        depth, trees = self.depth, len(self.order)
        margins = np.einsum("tld,qd->qtl", self.directions, q)
        cuts = self.cuts.tolist()
        out = []
        for m in margins.tolist():
            seen, queue, found, before, count = np.zeros(len(self.x), bool), [(-np.inf, t, 0, 0) for t in range(trees)], [], [], 0
            while queue and count < wanted:
                gap, t, level, node = heapq.heappop(queue)
                mt, ct = m[t], cuts[t]
                while level < depth:
                    d = mt[level] - ct[(1 << level) + node]
                    near = 2 * node + (d >= 0)
                    heapq.heappush(queue, (max(gap, abs(d)), t, level + 1, near ^ 1))
                    node, level = near, level + 1
                found.append(t << depth | node)
                before.append(count)
                rows = self.order[t][self.bounds[t][node] : self.bounds[t][node + 1]]
                count += len(rows) - int(np.count_nonzero(seen[rows]))
                seen[rows] = True
            out.append((found, before))
        return out

    def _cut(self, hits: Hits, own: np.ndarray, q: np.ndarray, k: int, slack: np.ndarray, exact: bool) -> Hits:
        """Of (query, point, product) those that can be among each query's k nearest, each once; exact: with the scores, k at most."""
        who, point, score = hits
        order = np.lexsort((point, who))
        who, point, score = who[order], point[order], score[order]
        new = np.r_[True, (who[1:] != who[:-1]) | (point[1:] != point[:-1])][: len(who)]
        who, point, score = who[new], point[new], score[new]
        if exact:
            score = np.concatenate([np.empty(0), *(fixed_products(q[who[i : i + PAIRS]], self.x[point[i : i + PAIRS]]) for i in range(0, len(who), PAIRS))])
        least = self.ids[self.ends[point]]
        for i in np.flatnonzero(least == own[who]):
            least[i] = self.ids[self.ends[point[i]] + np.searchsorted(self.ids[self.ends[point[i]] : self.ends[point[i] + 1]], own[who[i]], "right")]
        order = np.lexsort((least, -score, who))
        who, point, score = who[order], point[order], score[order]
        starts = np.searchsorted(who, np.arange(len(own)))
        if exact:
            keep = np.arange(len(who)) - starts[who] < k
        else:
            keep = score >= self._floor((who, point, score), len(own), k)[who] - slack[who]
        return who[keep], point[keep], score[keep]

    @staticmethod
    def _floor(hits: Hits, n: int, k: int) -> np.ndarray:
        """The k-th product of each query; hits are in order, each once."""
        who, _, score = hits
        kth = np.searchsorted(who, np.arange(n)) + k - 1
        floor = np.full(n, -np.inf)
        full = np.flatnonzero(kth < np.searchsorted(who, np.arange(n), "right"))
        floor[full] = score[kth[full]]
        return floor

    def search(self, own: np.ndarray, q: np.ndarray, k: int, share: float) -> Hits:
        """(query ids, vec_ids, scores): the k best of each query among the points of its leaves, the query's own id left out.

        What can't be among the k best of the leaves so far is dropped on the way, so that little is held at once.
        """
        wanted = max(k + 1, int(np.ceil(share * len(self.x))))
        visits: dict[int, list[int]] = {}
        for i, found in enumerate(self.leaves(q, wanted)):
            for leaf in found:
                visits.setdefault(leaf, []).append(i)
        slack, floor = _slack(q, self.x), np.full(len(own), -np.inf)
        low, high = self.ids[self.ends[:-1]], self.ids[self.ends[1:] - 1]
        held: list[Hits] = []
        count, most = 0, max(HITS, 4 * k * len(own))
        for leaf, visitors in visits.items():
            t, node = leaf >> self.depth, leaf & ((1 << self.depth) - 1)
            rows, who = self.order[t][self.bounds[t][node] : self.bounds[t][node + 1]], np.asarray(visitors)
            s = q[who] @ self.x[rows].T
            others = (low[rows] != own[who][:, None]) | (high[rows] != own[who][:, None])  # not points of the query's own id alone
            edge = floor[who]
            if len(rows) > k and not np.isfinite(edge).all():
                edge = np.maximum(edge, -np.partition(-np.where(others, s, -np.inf), k - 1, axis=1)[:, k - 1])
            a, b = np.nonzero((s >= (edge - slack[who])[:, None]) & others)  # ties with the last are kept
            held.append((who[a], rows[b], s[a, b]))
            count += len(a)
            if count > most:
                held = [self._cut(tuple(map(np.concatenate, zip(*held))), own, q, k, slack, False)]
                if len(held[0][0]) > most // 2:  # many ties
                    held = [self._cut(held[0], own, q, k, slack, True)]
                floor, count = self._floor(held[0], len(own), k), len(held[0][0])
        if not held:
            return (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))
        who, point, score = self._cut(tuple(map(np.concatenate, zip(*held))), own, q, k, slack, True)
        out: list[Hits] = []
        starts = np.searchsorted(who, np.arange(len(own) + 1))
        for i, (a, b) in enumerate(zip(starts, starts[1:])):
            if a == b:
                continue
            ids = []
            for p in point[a:b]:
                every = self.ids[self.ends[p] : self.ends[p + 1]]
                lo, hi = np.searchsorted(every, own[i], "left"), np.searchsorted(every, own[i], "right")
                ids.append(np.concatenate([every[: min(lo, k)], every[hi : hi + k]]))
            s, ids = np.repeat(score[a:b], [len(x) for x in ids]), np.concatenate(ids)
            top = np.lexsort((ids, -s))[:k]
            out.append((np.full(len(top), own[i]), ids[top], s[top]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))


def measured_share(index: DataFrame, k: int, least: float, blocks: int = 4, asked: int = 48) -> float:
    """The smallest of SHARES at which a sample's queries find `least` of their k nearest: `asked` points of each of about `blocks` shards, each sought in its own shard.

    The nearest of all rows are among the nearer ones of their shards, so a search of all shards finds no smaller part of them. Each shard of the sample gives one row.
    """
    n = index.count()
    picked = index.where(F.pmod(F.xxhash64("block"), F.lit(max(1, n // blocks))) == 0) if n > blocks else index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                forest = Forest.loaded(data.as_py())
                at = np.unique(np.linspace(0, len(forest.x) - 1, asked).astype(int))
                before = forest.needed(at, forest.x[at], k)
                hit = [int((before < max(k + 1, int(np.ceil(share * len(forest.x))))).sum()) for share in SHARES]
                yield pa.RecordBatch.from_pydict({"share": list(SHARES), "hit": hit, "wanted": [len(before)] * len(SHARES)})
        trim()

    told = picked.select("data").mapInArrow(run, "share double, hit long, wanted long").groupBy("share").agg(F.sum("hit").alias("hit"), F.sum("wanted").alias("wanted")).collect()
    return min((r.share for r in told if r.hit >= least * r.wanted), default=1.0)


def neighbours(rows: DataFrame, k: int = 20, every: int = 20, trees: int = 8, leaf: int = 256, share: float | None = None, least: float = 0.96, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (double): for each row whose id divides by `every`, its k nearest found by inner product.

    Vectors that are null, empty, zero or hold a null or a component that isn't finite take no
    part; nor do null ids. Vectors of other lengths than a query's are no candidates of it. Rows
    that repeat an id are candidates each, but never of a query with that id. Every row is indexed.
    share is the part of a shard's distinct vectors that the queue yields; 1 is exact. Without it, it is the smallest at which a sample finds `least` of its nearest.
    Components so large that a product isn't finite may give scores that aren't. An empty table gives no rows.
    """

    def nonzero(ids: np.ndarray, x: np.ndarray) -> bytes | None:
        fine = x.any(axis=1)
        return packed(ids[fine], x[fine]) if fine.any() else None

    def grown(ids: np.ndarray, x: np.ndarray) -> bytes | None:
        fine = x.any(axis=1)
        return Forest(ids[fine], x[fine], trees, leaf).saved() if fine.any() else None

    index = written(blocked(rows, id_col, vec_col, ROWS, grown), "shards", "none", 1)
    queries = written(blocked(rows, id_col, vec_col, CHUNK, nonzero, where=f"`{id_col}` % {every} = 0", coalesce=False), "queries", "none")
    share = measured_share(index, k, least) if share is None else share

    def opened(dim: int, data: bytes) -> Callable[[bytes], Hits]:
        forest = Forest.loaded(data)
        return lambda chunk: forest.search(*unpacked(chunk, dim), k, share)

    return searched(index, queries, k, opened, "double")
