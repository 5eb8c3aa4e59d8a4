"""SimHash near-duplicates found by covering locality-sensitive hashing.

A fingerprint has 64 bits. For a radius r every bit gets a non-zero vector of r + 1 bits;
each non-zero vector v of r + 1 bits gives a mask of the bits whose vectors have an odd
product with v. Any r positions leave some v orthogonal to all their vectors, so two
fingerprints that differ in r bits at most agree under that mask: every such pair meets in
one of the 2**(r+1) - 1 tables, and no other step is needed to be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import discard, prepare, sliced, written
from .components import components

#: Distinct fingerprints of a bucket up to which its members are compared with each other; beyond it the bucket is split again.
BUCKET = 256
#: Buckets with two members or more up to which their table (24 bytes each) is broadcast; more are joined by shuffle.
SENT_BUCKETS = 500_000
_STEP = 1 << 15


def _majority(hashes: bytes, counts: np.ndarray) -> None:
    bits = np.unpackbits(np.frombuffer(hashes, "u1").reshape(-1, 8), axis=1)
    counts += bits.sum(axis=0, dtype=np.int64)


def fingerprint(raw: bytes | None, width: int = 3, distinct: bool = False) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text. Null or without words: 0.

    distinct: every different shingle counts once.
    """
    words = (raw or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    counts, total, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_digest
    if n <= width:
        grams: list[bytes] | set[bytes] = [b" ".join(words)]
        if distinct and width == 1:
            grams = set(words)
        _majority(b"".join([digest(g, 42) for g in grams]), counts)
        total = len(grams)
    elif distinct:
        grams = set(words) if width == 1 else {b" ".join(words[i : i + width]) for i in range(n - width + 1)}
        _majority(b"".join([digest(g, 42) for g in grams]), counts)
        total = len(grams)
    else:
        total = n - width + 1
        for at in range(0, total, _STEP):
            part = words[at : min(at + _STEP, total) + width - 1]
            text, ends = b" ".join(part), np.cumsum([len(w) + 1 for w in part]) - 1
            begins = [0, *(ends[: len(part) - width] + 1).tolist()]
            _majority(b"".join([digest(text[i:j], 42) for i, j in zip(begins, ends[width - 1 :].tolist())]), counts)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distinct: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) for each row; other columns are left out."""
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.array([fingerprint(x, width, distinct) for x in b.column(1).to_pylist()], dtype="u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_raw")).mapInArrow(run, schema)


def masks(radius: int, bits: list[int]) -> list[int]:
    """The covering family over these bit positions, as unsigned masks."""
    top = (1 << (radius + 1)) - 1
    return [sum(1 << bit for i, bit in enumerate(bits) if ((i % top + 1) & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(fps: DataFrame, radius: int = 2, bucket: int | None = BUCKET) -> DataFrame:
    """mask, key, fp: the tables' buckets with two members or more, of distinct fingerprints (column fp, each once).

    Every two fingerprints within the radius share one. A bucket with more members than `bucket` is covered again over the
    bits that its mask leaves free, until it is small or at most 12 bits are free (4,096 fingerprints): nothing is dropped.
    Without `bucket` no bucket is split.
    """
    spark = fps.sparkSession
    family = {0: masks(radius, list(range(64)))}
    level = fps.select(F.lit(0).cast("long").alias("mask"), "fp").where("fp is not null")
    found: list[DataFrame] = []
    while True:
        tables = spark.createDataFrame([(_signed(m), [_signed(m | x) for x in sub]) for m, sub in family.items()], "mask long, next array<long>")
        keyed = level.join(F.broadcast(tables), "mask").select(F.explode("next").alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        keyed = keyed.distinct() if found else keyed
        shared = written(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "shared-buckets")
        live = written(keyed.join(F.broadcast(shared) if shared.count() <= SENT_BUCKETS else shared, ["mask", "key"]), "bucket-members")
        free = min(64 - (m | x).bit_count() for m, sub in family.items() for x in sub)
        whole = bucket is None or free <= 12
        discard(shared)
        found.append((live if whole else live.where(F.col("n") <= bucket)).select("mask", "key", "fp"))
        if whole or not (hot := live.where(F.col("n") > bucket)).head(1):
            break
        level = hot.select("mask", "fp")
        used = {m | x for m, sub in family.items() for x in sub}
        family = {m: masks(radius, [i for i in range(64) if not m >> i & 1]) for m in used}
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_links(fps: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """a, b: every pair of distinct fingerprints (column fp, each once) that differ in 1 to radius bits."""
    small = buckets(fps, radius, bucket)
    x, y = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return x.join(y, ["mask", "key"]).where((F.col("a") < F.col("b")) & (apart <= radius)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach) for each row.

    Texts that are null, empty or white space have fingerprint 0 and link like any other.
    Repeated rows each give a row. A null doc_id gets the component of its fingerprint, which
    is null if no row of it has an id. An empty table gives no rows; extra columns are left out.
    """
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    first = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = written(components(near_links(first.select("fp"), radius, bucket)), "roots")
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    comps = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(rooted.join(comps, "root").select("fp", "component_id"), "components")
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(labels, "fp").select("doc_id", hex16.alias("fingerprint"), "component_id")
