"""Near-duplicate removal: every pair of texts with similar five-word shingles is found, and one text of each connected group stays.

Links that are cheap to find come first: each text is compared with the first of its fingerprint, and with the first and the
last of its buckets of covering LSH on fingerprints over distinct words. Fingerprints of similar texts can lie too far apart for
that, so a prefix-filter join follows. Of a set of n shingles at least least * n are in any similar set; with all
shingles in one order, rare ones first, two similar sets therefore share one of their first n - ceil(least * n) + 1.
Pairs whose texts are joined already need no comparison, so groups of copies don't cost their square.
Links are closed into components; the text with the smallest order (doc_id, then a hash of its words) stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import discard, prepare, sliced, trim, unused, written
from .components import components
from .polyhash import mix
from .simhash import buckets, fingerprint

#: Ids up to which they are broadcast to fetch their rows; more are joined by shuffle.
SENT_IDS = 1_000_000
#: Bins in which all texts' shingles are counted, to tell common ones from rare ones. Any order finds the same pairs; rare ones first makes fewer candidates.
COUNTS = 1 << 20
#: Bins of a text's sketch; more of them rule out more pairs before their sets are fetched.
BINS = 2048
#: Prefix entries that a task brings together, about.
PART_ENTRIES = 1 << 19
#: t, id, n, pos of a prefix entry.
_ENTRY = ("<u4", "<i8", "<i4", "<i4")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text as 32-bit hashes, ascending; a text with fewer words is one shingle, without words none.

    Each word is hashed once (XXH64); the hashes of a shingle's words are added up with powers of an odd number and mixed.
    """
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, "u4")
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(w, 42) for w in words]), ">u8").astype("u8")
    width = min(width, len(words))
    n = len(words) - width + 1
    made = h[:n] + np.uint64(width)
    for i in range(1, width):
        made = made * _STEP + h[i : i + n]
    return np.unique((mix(made) >> np.uint64(32)).astype("u4"))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed_rows(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            raw = b.column(1).to_pylist()
            norm = [xxhash.xxh3_128_digest(b" ".join((x or b"").lower().split())) for x in raw]
            fp = np.array([fingerprint(x, 1, True) for x in raw], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(norm, pa.binary()), pa.array(fp)], ["doc_id", "norm", "fp"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("norm", T.BinaryType()), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", F.col("text").cast("binary").alias("_raw")).mapInArrow(run, schema)


def _sketches(sets: DataFrame) -> DataFrame:
    """id, n (size of the set), p: for each of BINS bins of hashes, whether the set has an odd number in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            every = [np.frombuffer(x, "u4") for x in b.column(1).to_pylist()]
            odd = [np.packbits((np.bincount(s % BINS, minlength=BINS) & 1).astype("u1")).tobytes() for s in every]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in every], pa.int32()), pa.array(odd, pa.binary())], ["id", "n", "p"])

    return written(sets.select("id", "s").mapInArrow(run, "id long, n int, p binary"), "sketches")


def _of(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of held (by id) that a pair needs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return held.join(F.broadcast(ids) if pairs.count() * 2 <= SENT_IDS else ids, "id", "left_semi")


def _possible(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs whose sketches allow a similarity of least: bins that differ are at most the shingles only one text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "u1").reshape(b.num_rows, -1) for i in (3, 5))
                n = b.column(2).to_numpy().astype(float) + b.column(4).to_numpy()
                keep = np.bitwise_count(x ^ y).sum(axis=1, dtype=int) <= n * (1 - least) / (1 + least) + 1e-6
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    own = _of(pairs, sketches)
    x, y = (own.select(F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("p").alias(f"p_{i}")) for i in "ab")
    met = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "n_a", "p_a", "n_b", "p_b")
    return written(met.mapInArrow(run, "a long, b long"), "possible-pairs")


def _similar(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs of texts (id) that are similar."""
    pairs = written(pairs, "candidate-pairs")
    left = _possible(pairs, sketches, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            keep = [i for i in range(b.num_rows) if similarity(np.frombuffer(x[i].as_buffer(), "u4"), np.frombuffer(y[i].as_buffer(), "u4")) >= least]
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).take(pa.array(keep))

    own = _of(left, sets)
    x, y = own.select(F.col("id").alias("a"), F.col("s").alias("x")), own.select(F.col("id").alias("b"), F.col("s").alias("y"))
    links = written(left.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    discard(pairs, left)
    return links


def _shingle_sets(docs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """norm, s (the shingles' hashes, ascending), id (a number that needs less room than norm) of each text."""
    n = texts.count()
    ids = texts.select(F.col("least").alias("_w")).distinct()
    source = docs.select("doc_id", F.col("text").cast("binary").alias("_raw"))
    source = source.join(F.broadcast(ids) if n <= SENT_IDS else ids, F.col("doc_id").eqNullSafe(F.col("_w")), "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            raw = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(b" ".join((x or b"").lower().split())) for x in raw], pa.binary()), pa.array([shingles(x, width).tobytes() for x in raw], pa.binary())], ["norm", "s"])

    def numbered(sets: DataFrame) -> DataFrame:
        return written(sets.withColumn("id", F.monotonically_increasing_id()), "shingle-sets", "none")

    sets = numbered(source.select("_raw").mapInArrow(make, "norm binary, s binary"))
    if sets.count() != n:  # rows that repeat a doc_id
        whole = sets
        sets = numbered(whole.select("norm", "s").dropDuplicates(["norm"]))
        discard(whole)
    return sets


def _counts(sets: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have a shingle in each of COUNTS bins, over all texts; the number of all shingles of all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, "i8")
        for b in sliced(batches):
            np.add.at(total, np.frombuffer(b"".join(b.column(0).to_pylist()), "u4") % COUNTS, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], ["bin", "n"])

    few = sets.select("s").coalesce(sets.sparkSession.sparkContext.defaultParallelism)  # a task sends up to COUNTS rows, whatever it has read
    made = few.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTS, "i8")
    counts[made.column(0).to_numpy()] = made.column(1).to_numpy()
    return np.minimum(counts, np.iinfo("i4").max).astype("i4"), int(counts.sum())


def prefix(s: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The shingles of a set, rare ones first, of which every similar set has one among its own."""
    if not len(s):
        return s
    often = counts[s % len(counts)].astype("u8")
    key = np.sort(often << np.uint64(32) | s)[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]
    return key.astype("u4")


def dealt(t: np.ndarray, ids: np.ndarray, n: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, entries as bytes): entries by range of t. The bytes of a kind stand together, so that those that hardly change take little room."""
    order = np.argsort(t, kind="stable")
    part = ((t[order].astype("u8") * np.uint64(parts)) >> np.uint64(32)).astype("i4")
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
        at = order[i:j]
        yield int(part[i]), b"".join([np.ascontiguousarray(x[at].astype(kind)).view("u1").reshape(j - i, -1).T.tobytes() for x, kind in zip((t, ids, n, pos), _ENTRY)])


def gathered(records: list[bytes]) -> list[np.ndarray]:
    """t, ids, n, pos of what dealt() has made bytes of."""
    size = sum(np.dtype(kind).itemsize for kind in _ENTRY)
    raw = [np.frombuffer(x, "u1").reshape(size, -1) for x in records]
    out, at = [], 0
    for kind in _ENTRY:
        wide = np.dtype(kind).itemsize
        out.append(np.concatenate([np.empty(0, kind), *(np.ascontiguousarray(x[at : at + wide].T).view(kind).ravel() for x in raw)]))
        at += wide
    return out


def meeting(t: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Places of the entries whose shingle another text has, too, that isn't too large or too small to be similar; by shingle and size."""
    order = np.lexsort((n, t))
    t, n = t[order], n[order].astype(float)
    next_ = (t[1:] == t[:-1]) & (n[:-1] >= n[1:] * least - 1e-6)
    return order[(np.r_[False, next_] | np.r_[next_, False])[: len(order)]]


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """t, n, pos, id, central: the prefix shingles that several texts have, the size of the text's set, the place in it, the text,
    and the part of its prefix that others share: all of it in a text from which others were made, less in those, which have shingles of their own.

    All entries are dealt once by ranges of t, packed; only those that meet become rows.
    """
    spark = sets.sparkSession
    counts, total = _counts(sets)
    sent = spark.sparkContext.broadcast(counts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (1 - least) / PART_ENTRIES), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            every = [np.frombuffer(x, "u4") for x in b.column(1).to_pylist()]
            first = [prefix(s, sent.value, least) for s in every]
            size = np.array([len(f) for f in first])
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            made = list(dealt(np.concatenate(first), np.repeat(b.column(0).to_numpy(), size), np.repeat(np.array([len(s) for s in every]), size), pos, parts))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], ["part", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, ids, n, pos = gathered([x for b in batches for x in b.column(1).to_pylist()])
        found = meeting(t, n, least)
        for i in range(0, len(found), 1 << 16):
            at = found[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (t.view("i4"), n, pos, ids)], ["t", "n", "pos", "id"])
        trim()

    packed = sets.select("id", "s").mapInArrow(run, "part int, data binary")
    met = written(packed.repartitionById(parts, F.col("part")).mapInArrow(meet, "t int, n int, pos int, id long"), "shared-prefixes")
    part = F.count("*").over(Window.partitionBy("id")) / (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1)
    out = written(met.withColumn("central", part), "central-prefixes")
    discard(met)
    return out


def _rooted(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries with root, the text's component so far or itself; only under shingles that lie in several components."""
    out = entries.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    each = Window.partitionBy("t")
    return out.withColumn("lo", F.min("root").over(each)).withColumn("hi", F.max("root").over(each)).where("lo < hi").drop("lo", "hi")


def _labels(links: DataFrame) -> DataFrame:
    """node, root: the smallest node within two links. Equal roots are connected; the two ends of a star's links have the same."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return written(both.join(near, "a").groupBy(F.col("b").alias("node")).agg(F.least(F.min("m"), F.col("b")).alias("root")), "roots")


def similar_links(texts: DataFrame, sets: DataFrame, radius: int, least: float) -> DataFrame:
    """node, root of each text that is similar to another: the components of all similar pairs of texts (id, fp, o)."""
    sketches = _sketches(sets)
    # by fingerprint: each text with the first of its own, the first of each with the first and the last of its buckets
    sizes = written(texts.groupBy("fp").agg(F.count("*").alias("n"), F.min("o").alias("first")), "fingerprints")
    equal = texts.join(sizes.where("n > 1").select("fp", "first"), "fp").where("o > first").select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    held = buckets(sizes.select("fp"), radius, None)
    members = written(held.join(sizes.select("fp", "first"), "fp"), "bucket-texts")
    ends = members.groupBy("mask", "key").agg(F.min(F.struct("first", "fp")).alias("lo"), F.max(F.struct("first", "fp")).alias("hi"))
    each = members.join(ends, ["mask", "key"]).select("fp", "first", F.explode(F.array("lo", "hi")).alias("h"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("h.fp")))
    near = each.where((apart > 0) & (apart <= radius)).select(F.least("first.id", "h.first.id").alias("a"), F.greatest("first.id", "h.first.id").alias("b"))
    links = _similar(equal.unionByName(near).distinct(), sets, sketches, least)
    roots = _labels(links)
    discard(sizes, members)

    # by prefix: each text with the most central of its shingle and size, then all that aren't joined yet
    entries = _prefixes(sets, least)
    sized = _rooted(entries, roots).withColumn("size", F.round(F.log("n") / math.log(1 / least)))
    head = F.max(F.struct("central", "id", "root")).over(Window.partitionBy("t", "size"))
    pairs = sized.withColumn("h", head).where("root != h.root").select(F.col("h.id").alias("a"), F.col("id").alias("b")).distinct()
    more = _similar(pairs, sets, sketches, least)
    discard(roots)
    roots = written(components(links.unionByName(more)), "roots")

    now = written(_rooted(entries, roots), "open-prefixes")
    x, y = (now.select("t", F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("pos").alias(f"pos_{i}"), F.col("root").alias(f"root_{i}")) for i in "ab")
    close = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least) - 1e-6
    # the shingles from this one on are all that the two can share, if it is the first that they share
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= (F.col("n_a") + F.col("n_b")) * F.lit(least / (1 + least)) - 1e-6
    pairs = x.join(y, (x.t == y.t) & (F.col("root_a") < F.col("root_b")) & close & room).select("a", "b").distinct()
    rest = _similar(pairs, sets, sketches, least)
    known = roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    found = written(components(known.unionByName(rest)), "roots")
    discard(entries, now, links, more, rest, sketches, roots)
    return found


def duplicates(docs: DataFrame, radius: int = 4, width: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows, gone): doc_id, norm, fp of every row, and the norms of texts that go because their component has a smaller one."""
    prepare(docs.sparkSession)
    rows = written(_signed_rows(docs), "signed-rows")
    distinct = written(rows.groupBy("norm", "fp").agg(F.min("doc_id").alias("least")), "distinct-texts")
    sets = _shingle_sets(docs, distinct, width)
    texts = written(distinct.join(sets.select("norm", "id"), "norm"), "numbered-texts")
    roots = similar_links(texts.select("id", "fp", F.struct("least", "id").alias("o")), sets.select("id", "s"), radius, least)
    grouped = written(texts.select("norm", "id", F.struct("least", "norm").alias("o")).join(roots.withColumnRenamed("node", "id"), "id"), "groups")
    discard(distinct, sets, texts)
    first = grouped.groupBy("root").agg(F.min("o").alias("first"))
    return rows, written(grouped.join(first, "root").where("norm != first.norm").select("norm"), "gone")


def deduplicated(docs: DataFrame, radius: int = 4, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each group.

    Texts that have the same words after A-Z are lower-cased are one text and leave the row with
    the smallest doc_id; null, empty and white texts are one such text. Of texts that similar pairs join one stays, as above.
    A null doc_id is smaller than others. If rows repeat a doc_id and a text that stays, the one with the smallest hash of
    all its columns is kept. An empty table gives no rows.
    """
    rows, gone = duplicates(docs, radius, width, least)
    names, kinds = docs.columns, docs.schema
    id_name, norm_name = unused(names, "_id"), unused(names, "_norm")
    texts = rows.groupBy("norm").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))).alias("m"))
    keep = written(texts.join(gone, "norm", "left_anti").select(F.col("m.id").alias(id_name), F.col("norm").alias(norm_name)), "keepers")
    total = rows.agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("d")).first()
    discard(rows, gone)
    sent = F.broadcast(keep) if keep.count() <= SENT_IDS else keep
    if total.n == total.d:
        return docs.join(sent.select(id_name), F.col("doc_id").eqNullSafe(F.col(id_name)), "left_semi")
    at = names.index("text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            raw = [(x or "").encode() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([xxhash.xxh3_128_digest(b" ".join(x.lower().split())) for x in raw], pa.binary())], [*names, norm_name])

    signed = docs.mapInArrow(sign, T.StructType([*kinds, T.StructField(norm_name, T.BinaryType())]))
    other = unused([*names, norm_name, id_name], "_other")
    keys = keep.withColumnRenamed(norm_name, other)
    held = signed.join(keys, (F.col(norm_name) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(id_name)), "left_semi")
    whole = [F.col(f"`{c}`") for c in names]
    hashable = [F.col(f"`{f.name}`") for f in kinds if "map<" not in f.dataType.simpleString()]
    first = held.groupBy(norm_name).agg(F.min_by(F.struct(*whole), F.xxhash64(*hashable)).alias("row"))
    return first.select("row.*")
