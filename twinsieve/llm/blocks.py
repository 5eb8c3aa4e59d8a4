"""A stated query set against all rows, in blocks: rows become blocks of vectors in files, and tasks read them for their chunks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import open_fs, prepare, trim

#: Queries of a chunk, and chunks that a task takes at most, about.
CHUNK, GROUP = 128, 16
#: Bytes of doubles in a block, whatever number of rows it may have.
BLOCK_BYTES = 1 << 25


def vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of doubles) for each dimension in a batch of (id, vector). Null ids, null vectors, empty vectors and
    those with a null or a component that isn't finite take no part."""
    ids, held = batch.column(0), batch.column(1)
    held = held.cast(pa.list_(pa.float64()))
    flat = held.flatten()
    bad = np.isnan(flat.fill_null(np.nan).to_numpy(zero_copy_only=False)) | ~np.isfinite(flat.fill_null(0.0).to_numpy(zero_copy_only=False))
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    size = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
    start = np.cumsum(size) - size
    wrong = np.bincount(np.repeat(np.arange(len(size)), size), weights=bad, minlength=len(size)) > 0
    fine = ~wrong & (size > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    whole = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
    for dim in np.unique(size[fine]):
        at = np.flatnonzero(fine & (size == dim))
        yield whole[at], values[start[at][:, None] + np.arange(dim)]


def blocked(rows: DataFrame, id_col: str, vec_col: str, most: int, make: Callable[[np.ndarray, np.ndarray], bytes | None], where: str | None = None, coalesce: bool = True) -> DataFrame:
    """block (unique long), dim, data: rows in blocks of `most` vectors of one dimension, fewer if they are wide, each made into bytes.

    No shuffle: a task makes blocks of the rows that it reads; few rows are read by few tasks, so that blocks are full.
    """
    prepare(rows.sparkSession)
    picked = rows.where(where) if where else rows
    picked = picked.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector"))
    if coalesce:
        picked = picked.coalesce(max(1, -(-rows.count() // most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        nth, part = 0, TaskContext.get().partitionId()

        def room(dim: int) -> int:
            return max(1, min(most, BLOCK_BYTES // (8 * dim)))

        def out(dim: int) -> pa.RecordBatch | None:
            nonlocal nth
            most = room(dim)
            ids, x = np.concatenate([i for i, _ in held[dim]]), np.concatenate([v for _, v in held[dim]])
            held[dim] = [(ids[most:], x[most:])] if len(ids) > most else []
            data = make(ids[:most], x[:most])
            nth += 1
            return data and pa.RecordBatch.from_arrays([pa.array([(part << 24) + nth]), pa.array([dim], pa.int32()), pa.array([data], pa.binary())], ["block", "dim", "data"])

        for b in batches:
            for ids, x in vectors(b):
                dim = x.shape[1]
                held.setdefault(dim, []).append((ids, x))
                while sum(len(i) for i, _ in held[dim]) >= room(dim):
                    if (made := out(dim)) is not None:
                        yield made
        for dim in held:
            if sum(len(i) for i, _ in held[dim]) and (made := out(dim)) is not None:
                yield made

    return picked.mapInArrow(run, "block long, dim int, data binary")


def packed(ids: np.ndarray, x: np.ndarray) -> bytes:
    return ids.astype("<i8").tobytes() + x.astype("<f8").tobytes()


def unpacked(data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (8 + 8 * dim)
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<f8", n * dim, 8 * n).reshape(n, dim)


def files_of(at: str, nth: int, of: int) -> Iterator[tuple[int, int, bytes]]:
    """(block, dim, data) of the rows in every of-th file of a table of blocks in the shared folder, one by one."""
    files, path = open_fs(at)
    for f in sorted(f.path for f in files.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet"))[nth::of]:
        for b in pq.ParquetFile(f, filesystem=files).iter_batches(1, columns=["block", "dim", "data"]):
            for i in range(b.num_rows):
                yield tuple(b.column(c)[i].as_py() for c in range(3))


def best_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each query, ties to the smaller id."""
    q, v, s = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((v, ~s if s.dtype.kind == "i" else -s, q))
    q, v, s = q[order], v[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], v[keep], s[keep]


def searched(index: DataFrame, queries: DataFrame, k: int, opened: Callable[[int, bytes], Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]], kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest scores of each query over all blocks, ties to the smaller vec_id.

    index has blocks in a table, one in a file; queries has chunks as of blocked(packed) in another. opened(dim, block) gives a search of that block: for
    a chunk the query ids, vec_ids and scores of the block's own best for each query. A task takes up to GROUP chunks and reads the blocks of
    its share of the files one after another, so neither is shuffled against the other; it holds one block, and k rows a query leave it.
    """
    cores = index.sparkSession.sparkContext.defaultParallelism
    at, chunks, files = index.written_at, queries.count(), max(1, index.count())
    group = max(1, min(GROUP, chunks * files // (4 * cores)))
    groups = max(1, -(-chunks // group))
    shares = max(1, min(files, -(-4 * cores // groups)))
    kind_pa = pa.int64() if kind == "long" else pa.float64()
    dealt = queries.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("at", (F.pmod(F.xxhash64("block"), F.lit(groups)) * shares + F.col("share")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[bytes]] = {}
        for b in batches:
            for share, dim, data in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault((share, dim), []).append(data)
        for share in sorted({s for s, _ in held}):
            best: dict[tuple[int, int], tuple] = {}
            for _, dim, data in files_of(at, share, shares):
                own = held.get((share, dim), [])
                search = opened(dim, data) if own else None
                for n, chunk in enumerate(own):
                    found = search(chunk)
                    best[dim, n] = best_of([best[dim, n], found], k) if (dim, n) in best else found
            for q, v, s in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, kind_pa)], ["query_id", "vec_id", "score"])
        trim()

    found = dealt.select("share", "dim", "data", "at").repartitionById(groups * shares, F.col("at")).select("share", "dim", "data").mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
