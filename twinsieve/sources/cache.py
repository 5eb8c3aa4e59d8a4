"""A cache of computed columns by key: its fingerprint, its place, and reads of a subset.

A table lies in folders by a hash bucket of the key, and its files are sorted by key and carry a Bloom filter of it. A
read of some keys opens the buckets that those fall into; keys that are not held are computed and appended.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 256


def fingerprint(files: DataFrame) -> DataFrame:
    """One digest over (path, modificationTime, length) of all files, whatever their order: of their number and of sums of two hashes of each."""
    told = [F.col("path"), F.col("modificationTime").cast("string"), F.col("length").cast("string")]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *told).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) for seed in (1, 2)]
    return files.agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), *[s.cast("string") for s in sums])).alias("fingerprint"))


def key_of(kind: str, print_: str, **settings) -> str:
    """A key by what a table was made from and how: its kind, the files' fingerprint and the settings, in any order."""
    return hashlib.md5(json.dumps([kind, print_, settings], sort_keys=True).encode()).hexdigest()[:16]


def paths(root: str, key: str, kinds: tuple[str, ...] = ("vectors", "hashes", "signatures", "meta")) -> dict[str, str]:
    """Where the tables of one key lie."""
    return {k: f"{root.rstrip('/')}/{k}/key={key}" for k in kinds}


def _bucket(col: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write(rows: DataFrame, path: str, key: str = "key", buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Rows by bucket of their key, each bucket's sorted."""
    rows = rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").sortWithinPartitions("bucket", key)
    rows.write.mode(mode).partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def subset(spark: SparkSession, path: str, keys: DataFrame, key: str = "key", buckets: int = BUCKETS) -> DataFrame:
    """The held rows of these keys (a column `key`). Only the folders of their buckets are listed and read; at most `buckets` numbers come to the driver."""
    wanted = keys.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("bucket", _bucket(key, buckets))
    need = sorted(r.bucket for r in wanted.select("bucket").distinct().collect())
    held = spark.read.parquet(path)
    return held.where(F.col("bucket").isin(need) if need else F.lit(False)).join(wanted, ["bucket", key], "left_semi").drop("bucket")


def completed(spark: SparkSession, path: str, keys: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key", buckets: int = BUCKETS) -> DataFrame:
    """The rows of all these keys: held ones from the cache, the others computed from `keys` once and appended to it."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        write(compute(keys), path, key, buckets)
    else:
        missing = keys.join(subset(spark, path, keys, key, buckets).select(key), key, "left_anti")
        if not missing.isEmpty():
            write(compute(missing), path, key, buckets, "append")
    return subset(spark, path, keys, key, buckets)
