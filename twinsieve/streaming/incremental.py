"""Incremental hash matching: new records of a stream against a table of known hashes, and windowed counts of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def bands(hashes: DataFrame, most: int) -> DataFrame:
    """id, hash and one row for each of most + 1 bands of bits; close hashes share one."""
    cuts = [64 * k // (most + 1) for k in range(most + 2)]
    rows = F.array(*[F.struct(F.lit(n).alias("band"), F.call_function("shiftrightunsigned", F.col("hash"), F.lit(lo)).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1).cast("bigint")).alias("key")) for n, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])
    return hashes.select("*", F.explode(rows).alias("b")).select("*", "b.band", "b.key").drop("b")


def matches(stream: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """A stream-static join: arriving (id, hash, ts) with known (id, hash) within the distance. A pair may come once for each band that it shares."""
    new = bands(stream, most).withColumnRenamed("id", "new_id").withColumnRenamed("hash", "x")
    old = bands(known, most).select(F.col("id").alias("known_id"), F.col("hash").alias("y"), "band", "key")
    d = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return new.join(old, ["band", "key"]).where(d <= most).select("ts", "new_id", "known_id", d.alias("hamming"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Rows of (ts, kind) by window and kind, late rows dropped behind the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"))


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch, without the pairs that it repeats, into its own folder: a batch that runs again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["new_id", "known_id"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
