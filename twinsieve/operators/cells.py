"""Rows that meet all others of their key in cells of bounded size.

A key's rows are dealt into parts by a hash of the id. A cell is a pair of parts; a row goes to the cells of its part, once to be held and
elsewhere to be asked about what is held. Rows travel one by one, sorted by cell, so a task holds one part at a time however large the key is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import reachable

#: Least parts of a table of more than `FEW` rows for each of them, so that there are cells for all cores.
LEAST, FEW = 8, 2048


def parts_for(n: int, block: int) -> int:
    """Parts of about `block` rows, more of them for a table that would fill few."""
    return max(1, -(-n // block), min(LEAST, n // FEW))


def dealt(rows: DataFrame, parts: Column, upper: bool, *payload: Column | str) -> DataFrame:
    """key, p, q, asks and the payload of rows (key, id, ...), sorted for met(). upper: each pair of parts is one cell; else (p, q) and (q, p) are two.

    A row of part q is held in cells (p, q), and asks in cells (q, other). In cell (q, q) what is held meets itself.
    """
    reachable(rows.sparkSession)
    own = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")

    def cell(k: Column) -> Column:
        held = k <= F.col("_own") if upper else F.lit(True)
        return F.struct(F.when(held, k).otherwise(F.col("_own")).alias("p"), F.when(held, F.col("_own")).otherwise(k).alias("q"), (~held).alias("asks"))

    every = F.sequence(F.lit(0), F.col("_parts") - 1)
    to = F.transform(every, cell)
    if not upper:
        others = F.transform(F.filter(every, lambda k: k != F.col("_own")), lambda k: F.struct(F.col("_own").alias("p"), k.alias("q"), F.lit(True).alias("asks")))
        to = F.concat(to, others)
    return rows.withColumn("_parts", parts.cast("int")).withColumn("_own", own).select("key", F.explode(to).alias("_cell"), F.struct(*payload).alias("_row")).select("key", "_cell.*", "_row.*")


def shuffled(dealt_rows: DataFrame, partitions: int) -> DataFrame:
    """The rows of a cell together, those that are held first."""
    return dealt_rows.repartition(partitions, "key", "p", "q").sortWithinPartitions("key", "p", "q", "asks")


def alone(rows: DataFrame, parts: int, upper: bool, *payload: str) -> DataFrame:
    """dealt() for a table that is one key: a partition for each cell."""
    at = F.col("q") * (F.col("q") + 1) / 2 + F.col("p") if upper else F.col("p") * parts + F.col("q")
    made = dealt(rows.withColumn("key", F.lit(0)), F.lit(parts), upper, *payload).withColumn("_at", at.cast("int"))
    return made.repartitionById(parts * (parts + 1) // 2 if upper else parts * parts, "_at").sortWithinPartitions("p", "q", "asks").drop("_at")


def met(batches: Iterator[pa.RecordBatch], held_of: Callable, meet: Callable, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """For the rows of shuffled() or alone(): what meet(held, asked, same) yields, held being held_of(payload) of a cell's held rows and asked the payload of
    some of those that ask, `rows` at most; same: asked are of the held rows themselves."""
    cell, kept, held = None, [], None

    def own() -> Iterator[pa.RecordBatch]:
        if cell is not None and cell[1] == cell[2] and kept:
            there = held_of(_joined(kept))
            for part in kept:
                for at in range(0, part.num_rows, rows):
                    yield from meet(there, part.slice(at, rows), True)

    for b in batches:
        if not b.num_rows:
            continue
        key, p, q, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        change = (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (asks[1:] != asks[:-1])
        cuts = [0, *(change.nonzero()[0] + 1).tolist(), b.num_rows]
        payload = pa.RecordBatch.from_arrays(b.columns[4:], b.schema.names[4:])
        for a, z in zip(cuts, cuts[1:]):
            at = (key[a], p[a], q[a])
            if at != cell:
                yield from own()
                cell, kept, held = at, [], None
            if not asks[a]:
                kept.append(payload.slice(a, z - a))
            elif kept:
                if held is None:
                    held = held_of(_joined(kept))
                for f in range(a, z, rows):
                    yield from meet(held, payload.slice(f, min(rows, z - f)), False)
    yield from own()


def _joined(kept: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(kept).combine_chunks()
