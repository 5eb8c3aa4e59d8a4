"""Inverted lists over unit vectors, with bounds on angles.

Centres are fitted to a bounded sample; every row goes to the list of its nearest centre. A list
keeps its rows by their angle to the centre, and its radius, the largest of them. By the triangle
inequality of angles a row within the angle `a` of a query can only be in a list whose centre is at
most a + radius from the query, and there only at an angle within `a` of the query's own. Probing all such lists finds
every pair; probing a few near ones is the approximate search. The same bounds make an exact self-join that copies a
row to the lists it can reach, and to no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import reachable, workspace
from . import similarity

#: Rows that centres are fitted to at most (about), rows of one part of a list, most centres, queries that meet a part at once.
SAMPLE, LIST, CELLS, QUERIES = 1 << 13, 4096, 4096, 256
#: Least number of rows for which a self-join looks at its lists at all, and the most share of all pairs that it may then compare.
WORTH, SHARE = 20_000, 0.3
#: What rounding may do to lengths and angles.
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ centres.T, -1.0, 1.0))


def limit(threshold: float) -> float:
    """The largest angle at which a cosine can be `threshold`."""
    return float(np.arccos(np.clip(threshold - SLACK, -1.0, 1.0))) + SLACK


def rows_of(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))


def sampled(vectors: DataFrame, n: int, most: int = SAMPLE) -> np.ndarray:
    """About `most` rows by a hash of the id, on the driver."""
    share = max(1, -(-n // most))
    held = rows_of(vectors).where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(share)) == 0).select("vec").toArrow()
    return _matrix(held.column(0).combine_chunks(), held.num_rows) if held.num_rows else np.empty((0, 0))


def fitted(sample: np.ndarray, cells: int, seed: int = 42, rounds: int = 8) -> np.ndarray:
    """Unit centres by k-means on the sphere, from starts that lie far apart."""
    x, rng = _unit(sample), np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    nearest = x @ centres[0]
    for _ in range(1, min(cells, len(x))):
        weight = np.maximum(1 - nearest, 0)
        if weight.sum() <= 1e-9:
            break
        centres.append(x[rng.choice(len(x), p=weight / weight.sum())])
        nearest = np.maximum(nearest, x @ centres[-1])
    at = np.array(centres)
    for _ in range(rounds):
        home = (x @ at.T).argmax(axis=1)
        total = np.zeros_like(at)
        np.add.at(total, home, x)
        full = np.sqrt((total * total).sum(axis=1)) > 1e-9
        at[full] = _unit(total[full])
    return at


def reached(theta: np.ndarray, most: float, radius: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For angles of rows to centres, which lists may hold rows within the angle `most`."""
    return (theta <= most + radius + SLACK) & (count > 0)


@dataclass
class Index:
    """Lists on disk under `at`; the centres, their radii and the lists' sizes and parts, a few thousand at most, are on the driver."""

    spark: SparkSession
    at: str
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    parts: np.ndarray

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/lists")

    def share(self, sample: np.ndarray, threshold: float) -> float:
        """The part of all rows that a row of the sample meets on average in a search by bounds."""
        theta = angles(sample, self.centres)
        return float((reached(theta, limit(threshold), self.radius, self.count) * self.count).sum(axis=1).mean() / max(1, self.count.sum()))

    def _met(self, queries: DataFrame, threshold: float, probes: int | None, own: bool, tally=None) -> DataFrame:
        """query id, id, cosine >= threshold; own: the queries are the index's rows and each pair comes once."""
        reachable(self.spark)
        kind = dict(queries.dtypes)["id"]
        most, centres, parts, radius, count, dim = limit(threshold), self.centres, self.parts, self.radius, self.count, self.centres.shape[1]

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(1), b.num_rows)
                theta = angles(x, centres)
                home = theta.argmin(axis=1)
                if probes is None:
                    go = reached(theta, most, radius, count)
                    if own:
                        go &= np.arange(len(centres)) >= home[:, None]
                else:
                    filled = np.where(count > 0, theta, np.inf)
                    go = np.zeros_like(theta, bool)
                    take = min(probes, len(centres))
                    np.put_along_axis(go, np.argpartition(filled, take - 1, axis=1)[:, :take], True, axis=1)
                row, cell = np.nonzero(go)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype("i4")), pa.array(parts[cell].astype("i4")), pa.array(home[row] == cell), pa.array(theta[row, cell]), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))],
                    ["cell", "parts", "same", "angle", "id", "vec"],
                )

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: tuple = ()
            for b in batches:
                key = np.stack([b.column(c).to_numpy() for c in (0, 1, 2)], axis=1)
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
                for a, z in zip(cuts, cuts[1:]):
                    if key[a, 2] == 0:
                        for r in range(a, z):
                            held = (tuple(key[r, :2]), b.column(5)[r].values, b.column(6)[r].values.to_numpy(zero_copy_only=False).reshape(-1, dim), b.column(7)[r].values.to_numpy(zero_copy_only=False))
                        continue
                    if not held or held[0] != tuple(key[a, :2]):
                        continue
                    for f in range(a, z, QUERIES):
                        g = min(z, f + QUERIES)
                        part = b.slice(f, g - f)
                        theta = part.column(4).to_numpy()
                        lo, hi = np.searchsorted(held[3], theta.min() - most - SLACK, "left"), np.searchsorted(held[3], theta.max() + most + SLACK, "right")
                        ids, own_ids = held[1].slice(lo, hi - lo), part.column(5).flatten()
                        s = _matrix(part.column(6), g - f) @ held[2][lo:hi].T
                        if tally is not None:
                            tally.add(int(s.size))
                        p, q = np.nonzero(s >= threshold)
                        i, j = own_ids.take(pa.array(p)), ids.take(pa.array(q))
                        fine = pa.compute.not_equal(i, j)
                        if own:
                            fine = pa.compute.and_(fine, pa.compute.or_(pa.compute.less(i, j), pa.array(~part.column(3).to_numpy(zero_copy_only=False)[p])))
                        yield pa.RecordBatch.from_arrays([i, j, pa.array(s[p, q])], ["i", "j", "cosine"]).filter(fine)

        asked = rows_of(queries).mapInArrow(probe, f"cell int, parts int, same boolean, angle double, id {kind}, vec array<double>")
        asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "same", "angle", F.array("id").alias("ids"), "vec", F.lit(None).cast("array<double>").alias("angles"))
        held = self.lists().select("cell", "part", F.lit(0).alias("kind"), F.lit(False).alias("same"), F.lit(0.0).alias("angle"), "ids", F.col("vecs").alias("vec"), "angles")
        dealt = held.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "angle")
        return dealt.mapInArrow(meet, f"i {kind}, j {kind}, cosine double")

    def search(self, queries: DataFrame, threshold: float, k: int | None = None, probes: int | None = None, tally=None) -> DataFrame:
        """query_id, id, cosine of the rows (other than itself) whose cosine with a query (id, vec) is at least the threshold; the k best of each, if given.

        probes: only so many of the nearest lists are read, and rows elsewhere are missed; without it none is.
        """
        found = self._met(queries, threshold, probes, False, tally).withColumnsRenamed({"i": "query_id", "j": "id"})
        if k is None:
            return found
        best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")

    def pairs(self, threshold: float, rows: DataFrame | None = None, tally=None) -> DataFrame:
        """i, j, cosine of all pairs i < j of the index's rows with a cosine of at least the threshold, each once."""
        inlined = self.lists().select(F.explode(F.arrays_zip("ids", F.sequence(F.lit(0), F.size("ids") - 1))).alias("r"), "vecs")
        dim = self.centres.shape[1]
        rows = rows if rows is not None else inlined.select(F.col("r.ids").alias("id"), F.slice("vecs", F.col("r.1") * dim + 1, F.lit(dim)).alias("vec"))
        found = self._met(rows, threshold, None, True, tally)
        return found.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "cosine")


def build(vectors: DataFrame, at: str | None = None, cells: int | None = None, seed: int = 42) -> Index:
    """An index of all rows (id, vec) with a vector, unit vectors of one length; centres are fitted to about SAMPLE rows.

    A list is dealt by a hash of the id into as many parts as its share of the sample says, so a list that holds a third of all rows is
    no task's alone. Without `at` the lists lie in the shared folder and go with the application. A table without vectors has an empty index.
    """
    spark = vectors.sparkSession
    reachable(spark)
    at = at or workspace(spark, "lists")
    rows, kind = rows_of(vectors), dict(vectors.dtypes)["id"]
    n = rows.count()
    sample = sampled(vectors, n)
    centres = fitted(sample, cells or min(CELLS, max(1, int(2 * n**0.5)))) if len(sample) else np.ones((1, 1))
    guess = np.bincount((_unit(sample) @ centres.T).argmax(axis=1), minlength=len(centres)) if len(sample) else np.zeros(1)
    parts = np.maximum(1, np.ceil((guess + np.sqrt(guess)) * (n / max(1, len(sample))) / LIST)).astype("i8")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                theta = angles(_matrix(b.column(1), b.num_rows), centres)
                home = theta.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype("i4")), pa.array(parts[home].astype("i4")), pa.array(theta[np.arange(len(home)), home]), b.column(0), b.column(1)], ["cell", "parts", "angle", "id", "vec"])

    placed = rows.mapInArrow(place, f"cell int, parts int, angle double, id {kind}, vec array<double>")
    held = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("angle", "id", "vec"))).alias("r"))
    held.select("cell", "part", F.size("r").alias("n"), F.col("r.id").alias("ids"), F.flatten("r.vec").alias("vecs"), F.col("r.angle").alias("angles")).write.mode("overwrite").parquet(f"{at}/lists")
    sizes = spark.read.parquet(f"{at}/lists").groupBy("cell").agg(F.sum("n").alias("n"), F.max(F.element_at("angles", -1)).alias("radius"))
    known = {r.cell: r for r in sizes.collect()}
    cell = range(len(centres))
    table = [(c, centres[c].tolist(), known[c].radius if c in known else 0.0, known[c].n if c in known else 0, int(parts[c])) for c in cell]
    spark.createDataFrame(table, "cell int, centre array<double>, radius double, n long, parts int").coalesce(1).write.mode("overwrite").parquet(f"{at}/cells")
    return opened(spark, at)


def opened(spark: SparkSession, at: str) -> Index:
    """The index that build() wrote there."""
    cells = sorted(spark.read.parquet(f"{at}/cells").collect(), key=lambda r: r.cell)
    return Index(spark, at, np.array([r.centre for r in cells]), np.array([r.radius for r in cells]), np.array([r.n for r in cells]), np.array([r.parts for r in cells]))


def sample_share(sample: np.ndarray, n: int, threshold: float) -> float:
    """Index.share() as the sample alone tells it, before any row is placed. Lists of all rows are no narrower than those of a sample."""
    centres = fitted(sample, min(CELLS, max(1, int(2 * n**0.5))))
    theta = angles(sample, centres)
    home, near = theta.argmin(axis=1), theta.min(axis=1)
    count, radius = np.bincount(home, minlength=len(centres)), np.zeros(len(centres))
    np.maximum.at(radius, home, near)
    asking = theta[:1024]
    return float((reached(asking, limit(threshold), radius, count) * count).sum(axis=1).mean() / max(1, count.sum()))


def adaptive_pairs(vectors: DataFrame, threshold: float, worth: int = WORTH, share: float = SHARE, tally=None) -> DataFrame:
    """i, j, cosine of all pairs i < j with a cosine of at least the threshold, by the way that suits the rows.

    Few rows are compared block by block. Else the rows of a sample tell how much of the table a row meets at this threshold in lists around
    centres; if that is little, rows are copied only to the lists they can reach, and if not, blocks are cheaper again. All ways are exact.
    """
    n = rows_of(vectors).count()
    if n >= worth:
        if sample_share(sampled(vectors, n), n, threshold) > share:
            return similarity.pairs_at_least(vectors, threshold)
        index = build(vectors)
        if index.share(sampled(vectors, n, 1024), threshold) <= share:
            return index.pairs(threshold, vectors, tally)
    return similarity.pairs_at_least(vectors, threshold)
