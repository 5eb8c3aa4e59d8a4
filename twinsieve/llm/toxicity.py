"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct buckets of its words, word pairs and pairs with one word
between. Training is per-coordinate FTRL-proximal; its L1 term leaves few non-zero weights, and
only those are sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import prepare, sliced, unused
from .polyhash import mix, spans

_WORD = np.zeros(256, bool)
_WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = True
_PAIR, _SKIP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Bytes of text that are hashed at once.
_BYTES = 1 << 20


@dataclass(frozen=True)
class Ftrl:
    """max_rows and max_bytes (of text) bound the labelled rows that train the model: the first by a hash of doc_id.

    alpha, l1 and epochs were chosen on permitted rows alone: trained on those with remainder 0, measured on those with 2.
    """

    bits: int = 22
    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0
    epochs: int = 6
    batch: int = 32
    max_rows: int = 20_000
    max_bytes: int = 256 << 20
    threshold: float = 0.7


def hashed_features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, pair and skip pair of the texts, with repeats, in no order of kind. Null: none."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
    if not len(raw):
        return np.empty(0, "i8"), np.empty(0, "i8")
    offsets = offsets - offsets[0]
    word = _WORD[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(word & (cut[:-1] | ~np.r_[False, word[:-1]]))
    ends = np.flatnonzero(word & (cut[1:] | ~np.r_[word[1:], False])) + 1
    h = mix(spans(raw.astype("u8") + np.uint64(1), starts, ends))
    row = np.searchsorted(offsets, starts, "right") - 1
    row = np.minimum(row, len(offsets) - 2)
    shift = np.uint64(64 - bits)
    one, two = row[:-1] == row[1:], row[:-2] == row[2:]
    pair = mix(h[:-1] * _PAIR + h[1:])[one]
    skip = mix(h[:-2] * _SKIP + h[2:])[two]
    return np.concatenate([row, row[:-1][one], row[:-2][two]]), (np.concatenate([h, pair, skip]) >> shift).astype("i8")


def distinct_features(texts: pa.Array, bits: int) -> list[np.ndarray]:
    """The distinct buckets of each row, ascending."""
    row, bucket = hashed_features(texts, bits)
    both = np.unique((row << bits) | bucket)
    at = np.searchsorted(both, np.arange(len(texts) + 1) << bits)
    both &= (1 << bits) - 1
    return [both[i:j].astype("u4") for i, j in zip(at, at[1:])]


class FtrlModel:
    """State of one training run: z and n for each bucket, the last of them for the bias."""

    def __init__(self, p: Ftrl) -> None:
        self.p, self.z, self.n = p, np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, p = self.z[at], self.n[at], self.p
        w = (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
        return np.where(np.abs(z) > p.l1, w, 0.0)

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.p.beta + np.sqrt(self.n[-1])) / self.p.alpha))

    def step(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        sizes = np.array([len(r) for r in rows])
        at, back = np.unique(np.concatenate(rows), return_inverse=True)
        of = np.repeat(np.arange(len(rows)), sizes)
        w = self.weights(at)
        score = self.bias() + np.bincount(of, weights=w[back], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(score, -35, 35))) - labels
        at = np.append(at.astype("i8"), len(self.z) - 1)
        w = np.append(w, self.bias())
        g = np.append(np.bincount(back, weights=error[of], minlength=len(at) - 1), error.sum())
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.p.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> FtrlModel:
        order = np.random.default_rng(7)
        for _ in range(self.p.epochs):
            mixed = order.permutation(len(rows))
            for i in range(0, len(mixed), self.p.batch):
                part = mixed[i : i + self.p.batch]
                self.step([rows[j] for j in part], labels[part])
        return self

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(slice(0, -1))
        at = np.flatnonzero(w)
        return at, w[at]


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of doc_id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), label: str = "toxic") -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, buckets, weights): the model from the labelled rows that aren't held out, max_rows of them and max_bytes of text at most.

    Rows without label or doc_id teach nothing; a repeated doc_id is toxic if any of its labels
    is. Without any labelled row the model has no weights and scores everything 0.01.
    Features are made on all executors; one task then trains, over these rows alone.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out("_id"))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(params.max_rows)
    own = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    sizes = own.join(F.broadcast(known), "_id").groupBy("_id").agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0))).alias("n"), F.first("_y").alias("_y"))
    held = sizes.orderBy(F.xxhash64("_id"), "_id").toArrow()  # max_rows at most
    within = np.cumsum(held.column("n").to_numpy()) <= params.max_bytes
    taught = held.filter(pa.array(within)).select(["_id", "_y"]) if len(within) else held.select(["_id", "_y"])
    texts = own.join(F.broadcast(docs.sparkSession.createDataFrame(taught, sizes.select("_id", "_y").schema)), "_id").select("_y", "_text")
    p = params

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, _BYTES):
            rows = distinct_features(b.column(1), p.bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["y", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys = [], []
        for b in batches:
            rows += [np.frombuffer(x, "u4") for x in b.column(1).to_pylist()]
            ys.append(b.column(0).to_numpy(zero_copy_only=False))
        if rows:
            y = np.concatenate(ys)
            order = np.array(sorted(range(len(rows)), key=lambda i: (y[i], rows[i].tobytes())))  # the same model whatever order rows arrive in
            model = FtrlModel(p).fit([rows[i] for i in order], y[order].astype(float))
            at, w = model.sparse()
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, model.bias()))], ["bucket", "weight"])

    made = texts.mapInArrow(extract, "y int, features binary").repartition(1).mapInArrow(fit, "bucket long, weight double").toArrow()
    at, w = made.column(0).to_numpy(), made.column(1).to_numpy()
    if not len(at):
        return float(np.log(0.01 / 0.99)), np.empty(0, "i8"), np.empty(0)
    assert len(at) <= 1 << 20, "weights are too many to broadcast; raise l1"
    return float(w[at == -1][0]), at[at >= 0], w[at >= 0]


def scored(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], text_col: str = "text", params: Ftrl = Ftrl(), name: str = "score") -> DataFrame:
    """docs with a column of scores between 0 and 1, from the whole text alone. Null and empty texts get the score of no words.

    All other columns stay as they are; a column that is called as the new one is replaced.
    """
    from pyspark.sql import types as T

    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    schema = T.StructType([*(docs.select(*[f"`{c}`" for c in kept]).schema), T.StructField(name, T.DoubleType())])
    bits, at_text = params.bits, kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, w = sent.value
        dense = np.zeros(1 << bits, "f4")
        dense[at] = w
        for b in sliced(batches, _BYTES):
            row, bucket = hashed_features(b.column(at_text), bits)
            hit = np.flatnonzero(dense[bucket])
            both = np.unique((row[hit] << bits) | bucket[hit])
            total = bias + np.bincount(both >> bits, weights=dense[both & ((1 << bits) - 1)], minlength=b.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, name])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on) for each row; repeated rows each give one."""
    rows = scored(docs.select("doc_id", "text"), train(docs, labels, params), params=params).drop("text")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl()) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    name = unused(docs.columns, "_toxicity")
    return scored(docs, train(docs, labels, params), params=params, name=name).where(F.col(name) < params.threshold).drop(name)
