"""Hard negatives by branch and bound over ball trees.

Rows lie in blocks with ball trees of their own, one for each label that a block has often. A ball
bounds the inner products of its rows from both sides: the centre's, give or take the query's
length times the radius. A chunk of queries goes down a tree together; a query leaves the way
at a node that lies outside all its windows of scores, or wholly below the k-th best of each so far.

First each anchor's nearest rows of its own label are sought, its positives. Each gives a window of
scores, and the second search finds the best rows of other labels in each window. Blocks are
written once in the shared folder; a task takes a chunk of anchors and reads the blocks of its share
one by one, so that neither blocks nor chunks are shuffled against each other, and it sends only its best.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .bitslice import whole
from .blocks import BLOCK_BYTES, vectors
from .common import batch_of, open_fs, prepare, trim, written

#: Rows of a block, of a leaf, and anchors of a chunk.
ROWS, LEAF, CHUNK = 1 << 14, 64, 1 << 10
#: Hits that a search holds for each window, times the number wanted, before it drops those that are not among the best.
HELD = 4
#: Quantised vectors of this length or more are scored with integers of any length, and no ball holds them.
WIDE = 2.0**31
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(256.0 * x)


def lengths(q: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((q.astype("f8") ** 2).sum(axis=1))


def within(v: int) -> int:
    return max(_LEAST, min(_MOST, v))


def products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of rows of whole numbers. largest: of the products of their lengths. Beyond a long, the nearest long."""
    if a.dtype == object or b.dtype == object:
        exact = a.astype(object) @ b.T.astype(object)
        return np.array([[within(int(v)) for v in row] for row in exact.tolist()], "i8").reshape(len(a), len(b))
    if largest < 2.0**53:  # no partial sum is larger
        return (a.astype("f8") @ b.T.astype("f8")).astype("i8")
    return a.astype("i8") @ b.T.astype("i8")


def saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def narrowest(q: np.ndarray) -> np.ndarray:
    most = np.abs(q).max(initial=0)
    return q.astype("i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8")


def planted(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int) -> bytes:
    """A block: its rows in the order of the trees' leaves, and the trees' nodes. Labels with fewer rows than a leaf share a tree."""
    q = quantised(x)
    wide = lengths(q) >= WIDE
    far = saved(ids=ids[wide], labels=labels[wide], x=x[wide])
    ids, labels, q = ids[~wide], labels[~wide], q[~wide]
    kinds, of, count = np.unique(labels, return_inverse=True, return_counts=True)
    tree = np.where(count[of] >= leaf, of, len(kinds))
    order = np.argsort(tree, kind="stable")
    nodes: list[list] = []  # first row, end, left child, right child
    centres, radii = [], []

    def grow(a: int, b: int) -> int:
        rows = q[order[a:b]]
        centre = rows.mean(axis=0)
        away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        nodes.append([a, b, -1, -1])
        centres.append(centre)
        radii.append(away.max())
        own = len(nodes) - 1
        if b - a > leaf and radii[own] > 0:
            one = rows[np.argmax(away)]
            other = rows[np.argmax(((rows - one) ** 2).sum(axis=1))]
            middle = (a + b) // 2
            order[a:b] = order[a:b][np.argpartition(rows @ (one - other), middle - a)]
            nodes[own][2:] = grow(a, middle), grow(middle, b)
        return own

    edges = np.flatnonzero(np.diff(tree[order], prepend=-1)).tolist() + [len(order)]
    roots = [(grow(a, b), int(tree[order[a]] < len(kinds)), int(labels[order[a]])) for a, b in zip(edges, edges[1:])]
    return saved(
        ids=ids[order], labels=labels[order], q=narrowest(q[order]), nodes=np.array(nodes, "i8").reshape(-1, 4), centres=np.array(centres).reshape(len(nodes), -1), radii=np.array(radii),
        roots=np.array(roots, "i8").reshape(-1, 3), far=np.frombuffer(far, "u1"),
    )


class Search:
    """The k best rows, by score and then id, for each query and each of its windows of scores; low and high have a column for each window."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.q, self.k, self.same = ids, labels, q, k, same
        self.lengths = lengths(q) if q.dtype != object else np.full(len(q), np.inf)
        self.float = q.astype("f8") if q.dtype != object else None
        self.low, self.high = low.copy(), high
        self.best = (np.empty(0, "i8"),) * 3  # window (query and column), id, score
        self.new: list[tuple[np.ndarray, ...]] = []
        self.count = self.visits = 0

    def open(self, who: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
        if self.float is None:
            return who
        about = self.float[who] @ centre
        reach = self.lengths[who] * radius
        reach = reach + 2.0**-40 * (self.lengths[who] * np.sqrt(centre @ centre) + reach) + 1e-6
        return who[(((about + reach)[:, None] >= self.low[who]) & ((about - reach)[:, None] <= self.high[who])).any(axis=1)]

    def take(self, who: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, longest: float) -> None:
        self.visits += len(who) * len(ids)
        score = products(self.q[who], q, self.lengths[who].max(initial=0.0) * longest)
        fine = (ids != self.ids[who][:, None]) & ((labels == self.labels[who][:, None]) == self.same)
        for j in range(self.low.shape[1]):
            a, b = np.nonzero(fine & (score >= self.low[who, j][:, None]) & (score <= self.high[who, j][:, None]))
            self.new.append((who[a] * self.low.shape[1] + j, ids[b], score[a, b]))
            self.count += len(a)
        if self.count > HELD * self.k * self.low.size + 256:
            self.settle()

    def settle(self) -> None:
        """Drops what isn't among the best, and raises the windows' lower ends to the k-th best."""
        window, ids, score = (np.concatenate(x) for x in zip(self.best, *self.new))
        order = np.lexsort((ids, ~score, window))
        window, ids, score = window[order], ids[order], score[order]
        nth = np.arange(len(window)) - np.searchsorted(window, window)
        keep = nth < self.k
        self.best = window[keep], ids[keep], score[keep]
        full = nth == self.k - 1
        self.low.reshape(-1)[window[full]] = np.maximum(self.low.reshape(-1)[window[full]], score[full])
        self.new, self.count = [], 0


class Block:
    def __init__(self, data: bytes) -> None:
        held = np.load(io.BytesIO(data))
        self.ids, self.labels, self.q, self.centres, self.radii = (held[n] for n in ("ids", "labels", "q", "centres", "radii"))
        self.nodes, self.roots = held["nodes"].tolist(), held["roots"].tolist()
        self.longest = lengths(self.q).max(initial=0.0)
        far = np.load(io.BytesIO(held["far"].tobytes()))
        self.far = far["ids"], far["labels"], whole(far["x"])

    def search(self, s: Search) -> None:
        everyone = np.arange(len(s.ids))
        for root, single, label in self.roots:
            self._down(s, root, everyone[(s.labels == label) == s.same] if single else everyone)
        if len(self.far[0]):
            s.take(everyone, *self.far, np.inf)
        s.settle()

    def _down(self, s: Search, node: int, who: np.ndarray) -> None:
        who = s.open(who, self.centres[node], self.radii[node])
        if not len(who):
            return
        a, b, left, right = self.nodes[node]
        if left < 0:
            for i in range(a, b, 4 * LEAF):  # a leaf of equal rows may be large
                z = min(b, i + 4 * LEAF)
                s.take(who, self.ids[i:z], self.labels[i:z], self.q[i:z], self.longest)
            return
        if s.float is not None and (s.float[who].mean(axis=0) @ (self.centres[right] - self.centres[left])) > 0:
            left, right = right, left  # where more is to be had comes first
        self._down(s, left, who)
        self._down(s, right, who)


def blocks_of(rows: DataFrame, id_col: str, label_col: str, vec_col: str, most: int, make, where: str | None = None, coalesce: bool = True) -> DataFrame:
    """block (unique long), dim, data: rows that take part, in blocks of `most` of one dimension, fewer if they are wide, made into bytes. No shuffle."""
    prepare(rows.sparkSession)
    picked = rows.where(where) if where else rows
    picked = picked.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vector")).where("id is not null and label is not null")
    if coalesce:
        picked = picked.coalesce(max(1, -(-rows.count() // most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        nth, part = 0, TaskContext.get().partitionId()

        def out(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal nth
            room = max(1, min(most, BLOCK_BYTES // (8 * dim)))
            while (n := sum(len(h[0]) for h in held[dim])) >= max(1, min(least, room)):
                ids, labels, x = (np.concatenate(c) for c in zip(*held[dim]))
                held[dim] = [(ids[room:], labels[room:], x[room:])]
                nth += 1
                yield batch_of(pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("data", pa.binary())]), block=[part << 24 | nth], dim=[dim], data=[make(ids[:room], labels[:room], x[:room])])
                if n <= room:
                    break

        for b in batches:
            ids, labels = (b.column(c).to_numpy() for c in (0, 1))
            for at, x in vectors(pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(2)], ["id", "vector"])):
                held.setdefault(x.shape[1], []).append((ids[at], labels[at], x))
                yield from out(x.shape[1], most)
        for dim in held:
            yield from out(dim, 1)
        trim()

    return picked.mapInArrow(run, "block long, dim int, data binary")


def share_of(at: str, nth: int, of: int, dim: int) -> Iterator[bytes]:
    """The blocks of this dimension in every of-th file of a table in the shared folder."""
    files, path = open_fs(at)
    for f in sorted(f.path for f in files.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet"))[nth::of]:
        for b in pq.ParquetFile(f, filesystem=files).iter_batches(1, columns=["dim", "data"]):
            if b.num_rows and b.column(0)[0].as_py() == dim:
                yield b.column(1)[0].as_py()


def split_queries(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the chunk, ids, labels, quantised) of the queries that fit 64 bits, and of the others."""
    held = np.load(io.BytesIO(data))
    q = quantised(held["x"])
    wide = lengths(q) >= WIDE
    for of in (~wide, wide):
        if of.any():
            yield np.flatnonzero(of), held["ids"][of], held["labels"][of], q[of].astype("i8") if of is not wide else whole(held["x"][of])


def mined(rows: DataFrame, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), every: int = 50, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row whose id divides by `every`, an anchor, and
    each of its `positives` best rows of the same label, the `negatives` best rows of other labels whose score is from low to high (as
    fractions) of the positive's.

    Components become floor(256 x); a score is the whole inner product with the anchor, beyond a long the nearest long.
    Higher scores come first, ties by smaller id. Labels and ids are whole numbers. Rows with a null id or label, and vectors that are null, empty or hold
    a null or a component that isn't finite take no part. Vectors of other lengths than an anchor's are no candidates of it. Rows that
    repeat an id are candidates each, but never of an anchor with that id; each anchor row is answered on its own. A positive
    of a negative score has an empty window where low is less than high. An empty table gives no rows.
    """
    spark = rows.sparkSession
    index = written(blocks_of(rows, id_col, label_col, vec_col, ROWS, lambda i, n, x: planted(i, n, x, LEAF)), "balls", "none", 1)
    chunks = written(blocks_of(rows, id_col, label_col, vec_col, CHUNK, lambda i, n, x: saved(ids=i, labels=n, x=x), where=f"`{id_col}` % {every} = 0"), "anchors", "none", 1)
    at = index.written_at
    number, files = chunks.count(), len(index.inputFiles())
    shares = max(1, min(files, -(-4 * spark.sparkContext.defaultParallelism // max(1, number))))

    def found(asked: DataFrame, k: int, same: bool) -> DataFrame:
        """block, place, window, anchor_id, positive_id, positive_score, id, score: each share's k best of every window."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    block, dim, nth = (b.column(c)[row].as_py() for c in (0, 1, 3))
                    given = None if same else b.column(4)[row].values
                    for place, ids, labels, q in split_queries(b.column(2)[row].as_py()):
                        width = 1 if same else positives
                        lows, highs = np.full((len(ids), width), _LEAST if same else _MOST), np.full((len(ids), width), _MOST if same else _LEAST)
                        positive = np.zeros((len(ids), width, 2), "i8")
                        if not same:
                            back = np.full(CHUNK, -1)
                            back[place] = np.arange(len(place))
                            for p, j, i, s in zip(*(given.field(n).to_pylist() for n in ("place", "nth", "id", "score"))):
                                if (mine := back[p]) >= 0:
                                    lows[mine, j], highs[mine, j] = within(-(-low[0] * s // low[1])), within(high[0] * s // high[1])
                                    positive[mine, j] = i, s
                        search = Search(ids, labels, q, lows, highs, k, same)
                        for data in share_of(at, nth, shares, dim):
                            Block(data).search(search)
                        window, id_, score = search.best
                        of, j = window // width, window % width
                        yield batch_of(FOUND, block=np.full(len(of), block), place=place[of], nth=j, anchor_id=ids[of], positive_id=positive[of, j, 0], positive_score=positive[of, j, 1], id=id_, score=score)
            trim()

        dealt = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        columns = ["block", "dim", "data", "share"] + ([] if same else ["given"])
        hits = dealt.select(*columns).repartition(max(1, min(number * shares, 1 << 16))).mapInArrow(run, ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in FOUND))
        best = Window.partitionBy("block", "place", "nth").orderBy(F.desc("score"), "id")
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = found(chunks, positives, True)
    given = first.groupBy("block").agg(F.collect_list(F.struct("place", (F.col("rank") - 1).alias("nth"), "id", "score")).alias("given"))
    second = found(chunks.join(given, "block"), negatives, False)
    return second.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


FOUND = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("nth", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
