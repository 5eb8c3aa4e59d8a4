"""Similarity self-joins on vectors: threshold, top-k and mutual neighbours, and statistics over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import FEW, beside, reachable
from . import cells

#: Vectors that a task holds at once, and products that it makes at once: 32 MB of each.
BLOCK, PRODUCTS = 1 << 16, 1 << 22


def _cells(vectors: DataFrame, block: int, upper: bool) -> DataFrame:
    """Vectors in cells of two blocks. No row, batch or task grows with the table: blocks are dealt by a hash of the id and vectors travel one by one."""
    rows = vectors.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("v"))
    return cells.alone(rows, cells.parts_for(vectors.count(), block), upper, "id", "v")


def _matrix(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, v = ((c.chunk(0) if isinstance(c, pa.ChunkedArray) else c) for c in rows.columns)
    return ids.to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _products(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Where a slice of x begins, and its products with y."""
    step = max(1, PRODUCTS // max(1, len(y)))
    for at in range(0, len(x), step):
        yield at, x[at : at + step] @ y.T


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def pairs_at_least(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """i, j, cosine for pairs i < j of (id, vec) with dot product >= threshold. Unit vectors of one length; null vectors take no part.

    A block meets slices of another as matrix products, and only pairs over the threshold leave the task.
    """
    kind = dict(vectors.dtypes)["id"]

    def meet(held: tuple, asked: pa.RecordBatch, same: bool) -> Iterator[pa.RecordBatch]:
        (j, y), (i, x) = held, _matrix(asked)
        for at, s in _products(x, y):
            a, c = _where(s >= threshold)
            p, q, score = i[at + a], j[c], s[a, c]
            if same:  # each pair of the block comes both ways
                once = p < q
                p, q, score = p[once], q[once], score[once]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(score)], ["i", "j", "cosine"])

    return _cells(vectors, block, True).mapInArrow(lambda batches: cells.met(batches, _matrix, meet), f"i {kind}, j {kind}, cosine double")


def _best(s: np.ndarray, k: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest of each row of s by rounded scores, ties by the smaller place.

    The k-th largest of the maxima of stretches of a row can't be over its k-th largest, so what is under it needs no sorting.
    """
    n, width = s.shape
    edge = np.full(n, -np.inf)
    if width > k:
        stretch = max(1, min(128, width // (4 * k)))
        tops = s[:, : width // stretch * stretch].reshape(n, -1, stretch).max(axis=2)
        edge = np.partition(tops, tops.shape[1] - k, axis=1)[:, -k] - 1e-9  # ties are broken by rounded scores
    a, c = _where((s >= edge[:, None]) & (s > -np.inf))
    order = np.lexsort((place[c], -np.round(s[a, c], 9), a))
    a, c = a[order], c[order]
    first = np.searchsorted(a, np.arange(n))
    kept = np.arange(len(a)) - first[a] < k
    return a[kept], c[kept]


def neighbours(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """i, j, cosine, rank: the k nearest others of each row, ties to the smaller id. Each block keeps its own k first."""
    kind = dict(vectors.dtypes)["id"]

    def held_of(rows: pa.Table) -> tuple:
        j, y = _matrix(rows)
        order = np.argsort(j)
        return j[order], y[order], np.arange(len(j))

    def meet(held: tuple, asked: pa.RecordBatch, same: bool) -> Iterator[pa.RecordBatch]:
        (j, y, place), (i, x) = held, _matrix(asked)
        for at, s in _products(x, y):
            if same:
                s[np.arange(len(s)), np.searchsorted(j, i[at : at + len(s)])] = -np.inf
            a, c = _best(s, k, place)
            yield pa.RecordBatch.from_arrays([pa.array(i[at + a]), pa.array(j[c]), pa.array(s[a, c])], ["i", "j", "cosine"])

    found = _cells(vectors, block, False).mapInArrow(lambda batches: cells.met(batches, held_of, meet), f"i {kind}, j {kind}, cosine double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc(F.round("cosine", 9)), "j"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_pairs(vectors: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Pairs that the smaller id sees among its k nearest; one that only the larger id sees is left out on purpose."""
    found = neighbours(vectors, k).where("j > i")
    return (found.where(F.col("cosine") >= threshold) if threshold is not None else found).select("i", "j", "cosine")


def mutual_pairs(vectors: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Pairs that are each other's k nearest."""
    near = neighbours(vectors, k).select(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("i") < F.col("j"), "cosine").toDF("lo", "hi", "up", "cosine")
    both = near.groupBy("lo", "hi").agg(F.max(F.when(F.col("up"), F.col("cosine"))).alias("cosine"), F.count_if("up").alias("there"), F.count_if(~F.col("up")).alias("back"))
    found = both.where("there > 0 and back > 0").withColumnsRenamed({"lo": "i", "hi": "j"})
    return (found.where(F.col("cosine") >= threshold) if threshold is not None else found).select("i", "j", "cosine")


def capped(pairs: DataFrame, most: int) -> DataFrame:
    """The best pairs, ties to the smaller ids: a report's limit."""
    return pairs.orderBy(F.desc("cosine"), "i", "j").limit(most)


def with_pages(pairs: DataFrame, panels: DataFrame) -> DataFrame:
    """page_a, page_b, same_page and gap of pairs (i, j); a missing page is the same as none."""
    pages = beside(panels.select("panel_id", "page"))
    a = pages.select(F.col("panel_id").alias("i"), F.col("page").alias("page_a"))
    b = pages.select(F.col("panel_id").alias("j"), F.col("page").alias("page_b"))
    return (
        pairs.join(a, "i", "left").join(b, "j", "left").withColumn("same_page", F.coalesce(F.col("page_a") == F.col("page_b"), F.lit(False))).withColumn("gap", F.abs(F.col("page_a") - F.col("page_b")))
    )


def suppressed(pairs: DataFrame, same_page: bool = False, adjacent_gap: int | None = None) -> DataFrame:
    """Pairs (as of with_pages) without those on one page, or at most adjacent_gap pages apart."""
    kept = pairs.where(~F.col("same_page")) if same_page else pairs
    return kept.where(~F.coalesce(F.col("gap") <= adjacent_gap, F.lit(False))) if adjacent_gap is not None else kept


def page_breakdown(pairs: DataFrame) -> DataFrame:
    n = F.count("*")
    same = F.count_if("same_page")
    return pairs.agg(n.alias("pairs"), same.alias("same_page"), (n - same).alias("cross_page"), F.round(F.coalesce(100.0 * same / F.nullif(n, F.lit(0)), F.lit(0.0)), 6).alias("same_page_pct"))


def similarity_stats(vectors: DataFrame) -> DataFrame:
    """id, mu, sd: mean and population deviation of each row's dot products with all others, without the pairs.

    The sums over all others follow from the sum of all vectors and their second moments, so this is linear in rows.
    """
    reachable(vectors.sparkSession)
    vs = vectors.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("v"))
    kind = dict(vectors.dtypes)["id"]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, second = 0, None, None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                n, total, second = n + len(x), x.sum(0) + (0 if total is None else total), x.T @ x + (0 if second is None else second)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([second.ravel().tolist()])], ["n", "total", "second"])

    parts = vs.select("v").mapInArrow(moments, "n long, total array<double>, second array<double>").toArrow().to_pylist()
    if not parts:
        return vs.selectExpr("id", "cast(null as double) mu", "cast(null as double) sd")
    n = sum(p["n"] for p in parts)
    total = np.sum([p["total"] for p in parts], axis=0)
    second = np.sum([p["second"] for p in parts], axis=0).reshape(len(total), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                own = np.einsum("ij,ij->i", x, x)
                mu = (x @ total - own) / max(1, n - 1)
                square = (np.einsum("ij,jk,ik->i", x, second, x) - own * own) / max(1, n - 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mu), pa.array(np.maximum(np.sqrt(np.maximum(square - mu * mu, 0)), 1e-6))], ["id", "mu", "sd"])

    stats = vs.mapInArrow(run, f"id {kind}, mu double, sd double")
    return F.broadcast(stats) if n <= FEW else stats


def z_global(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Pairs with clip_z: the smaller of the two ends' z-scores of the pair's cosine."""
    a = stats.select(F.col("id").alias("i"), F.col("mu").alias("mu_a"), F.col("sd").alias("sd_a"))
    b = stats.select(F.col("id").alias("j"), F.col("mu").alias("mu_b"), F.col("sd").alias("sd_b"))
    z = F.least((F.col("cosine") - F.col("mu_a")) / F.col("sd_a"), (F.col("cosine") - F.col("mu_b")) / F.col("sd_b"))
    return pairs.join(a, "i").join(b, "j").select("i", "j", "cosine", z.alias("clip_z"))


def z_approximate(pairs: DataFrame) -> DataFrame:
    """Pairs with clip_z from the pairs alone: mean and sample deviation of each side, averaged over the sides that have one."""
    a = pairs.groupBy("i").agg(F.avg("cosine").alias("mu_a"), F.stddev_samp("cosine").alias("sd_a"))
    b = pairs.groupBy("j").agg(F.avg("cosine").alias("mu_b"), F.stddev_samp("cosine").alias("sd_b"))

    def mean(x: str, y: str):
        return F.coalesce((F.col(x) + F.col(y)) / 2, F.col(x), F.col(y))

    sd = mean("sd_a", "sd_b")
    z = (F.col("cosine") - mean("mu_a", "mu_b")) / F.when(sd > 0, sd).otherwise(1.0)
    return pairs.join(a, "i", "left").join(b, "j", "left").select("i", "j", "cosine", z.alias("clip_z"))
