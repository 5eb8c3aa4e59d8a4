"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Words have names; a stretch of 2**(j+1) words is named by the pair of the names of its halves. A
run of period q has 4 q words or more, so it holds a whole block of 2 q words of the grid that
starts at multiples of 2 q: only blocks whose halves are equal, which two names tell, are
candidates. They are extended to both sides by the longest common extension of a place and the
place q words on, going down the levels of names. Texts of like length share one array, each
ended by a word that is nowhere else, so nothing reaches over an end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_of, prepare, sliced
from .words import Words, texts_of

#: Words that share one array, and candidates looked at together. A longer text has an array of its own.
TOGETHER, CANDIDATES = 1 << 17, 1 << 20
EXPONENT, LEAST = 4, 6


class Names:
    """Names of all stretches of 2**j words, j = 0 to top; past the end stands a name of its own, -1."""

    def __init__(self, words: np.ndarray, top: int) -> None:
        self.levels = [self._padded(words, len(words))]
        for j in range(top):
            below, n = self.levels[-1], len(words)
            right = np.full(n, -1, "i8")
            right[: n - (1 << j)] = below[1 << j : n]
            self.levels.append(self._padded(self._ranks(below[:n].astype("i8") << 32 | (right + 1)), n))

    @staticmethod
    def _padded(names: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n + 1, -1, "i4")
        out[:n] = names
        return out

    @staticmethod
    def _ranks(pairs: np.ndarray) -> np.ndarray:
        order = np.argsort(pairs)
        held = pairs[order]
        out = np.empty(len(pairs), "i4")
        out[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))
        return out

    def extended(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many words are the same from a and from b on (step 1), or before a and before b (step -1); a < b."""
        n, top = len(self.levels[0]) - 1, len(self.levels) - 1
        out = np.zeros(len(a), "i8")
        active = np.arange(len(a))
        j = top
        while j >= 0:
            size, names = 1 << j, self.levels[j]
            x, y = a[active] + step * out[active], b[active] + step * out[active]
            if step < 0:
                x, y = x - size, y - size
            fits = (x >= 0) & (y + size <= n)
            same = fits & (names[np.where(fits, x, 0)] == names[np.where(fits, y, 0)])
            out[active[same]] += size
            if j == top and same.any():  # the largest stretch may fit more than once
                active = active[same]
                continue
            active = np.arange(len(a))
            j -= 1
        return out


def runs_of(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of an array of word names, in which no run is longer than `longest`. By start, then period."""
    none = (np.empty(0, "i8"),) * 3
    n, most = len(words), longest // EXPONENT
    if most < 1:
        return none
    names = Names(words, most.bit_length())
    starts, periods = [], []
    q = 1
    while q <= most:
        count, last = 0, q
        while last <= most and (count == 0 or count + n // (2 * last) + 1 <= CANDIDATES):
            count += n // (2 * last) + 1
            last = min(last + max(1, last // 8), most + 1)
        period = np.arange(q, last)
        blocks = n // (2 * period)
        p = np.repeat(period, blocks)
        at = 2 * p * (np.arange(len(p)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        level = np.repeat(np.frexp(period)[1] - 1, blocks)
        for j in np.unique(level):
            held, of = names.levels[j], level == j
            i, r = at[of], p[of]
            same = held[i] == held[i + r]
            i, r = i[same], r[same]
            same = held[i + r - (1 << j)] == held[i + 2 * r - (1 << j)]
            starts.append(i[same])
            periods.append(r[same])
        q = last
    i, q = np.concatenate(starts), np.concatenate(periods)
    start = i - names.extended(i, i + q, -1)
    length = i + q + names.extended(i, i + q, 1) - start
    fits = length >= np.maximum(LEAST, EXPONENT * q)
    start, length, q = start[fits], length[fits], q[fits]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.ones(len(start), bool)  # a stretch counts by its smallest period
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def together(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of texts that share an array: at most about TOGETHER words, none more than twice as long as another."""
    order = np.argsort(counts, kind="stable")
    size = counts[order]
    a = int(np.searchsorted(size, LEAST))  # shorter texts have no runs
    while a < len(order):
        b = min(int(np.searchsorted(size, 2 * size[a], "right")), a + max(1, TOGETHER // int(size[a])))
        yield order[a:b]
        a = b


def runs_by_text(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, by text, start and period; names: of the words of texts of counts[0], counts[1], ... words."""
    bounds, unlike = np.concatenate([[0], np.cumsum(counts)]), int(names.max(initial=0)) + 1
    found = []
    for texts in together(counts):
        size = counts[texts]
        at = np.cumsum(size + 1) - size - 1
        held = np.empty(int(at[-1] + size[-1]) + 1, "i8")
        held[at + size] = unlike + np.arange(len(texts))
        own = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        held[own] = names[np.repeat(bounds[texts] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        start, length, period = runs_of(held, int(size.max()))
        which = np.searchsorted(at, start, "right") - 1
        found.append((texts[which], start - at[which], length, period))
    if not found:
        return (np.empty(0, "i8"),) * 4
    text, start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def looped(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Word numbers of texts, some of which repeat words from a place on: where h % 10 = 0, with g = h // 10, word i >= a = g % n is word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8)."""
    bounds = np.cumsum(counts) - counts
    out = np.arange(counts.sum())
    for t in np.flatnonzero((h >= 0) & (h % 10 == 0) & (counts > 0)):
        n, g = int(counts[t]), int(h[t]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[bounds[t] + a : bounds[t] + n] = bounds[t] + a + np.arange(n - a) % p
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loops: bool = False, outputs: bool = False) -> DataFrame:
    """One row per document: id, n_runs, start, length, period and exponent_milli of its most periodic run, runs_sha256, collapsed_sha256.

    A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no
    neighbour extends. The most periodic one has the greatest length / period, then the smallest
    start, then the smallest period; without a run the four columns are null. Words of a run after its first q go in the
    collapsed text. outputs adds runs (array of start, length, period) and collapsed (the text).
    loops: texts are first changed by looped(), by the crc32 of the id's digits; a text whose id is null is left as it is.

    A null or empty text has no words and no runs, and the digests of nothing. Rows that repeat an id have a row each; other
    columns take no part. An empty table gives no rows. Nothing is shuffled; a text is one task's work.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[next(c for c in docs.columns if c.lower() == id_col.lower())]
    h = F.crc32(F.col(id_col).cast("string").cast("binary")) if loops else F.lit(-1)
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(h, F.lit(-1)).cast("long").alias("h"), F.col(text_col).alias("text"))
    fields = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    named = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if outputs:
        fields += [("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())]
        named += ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4 << 20):
            words = Words(*texts_of(b.column(2)))
            order, counts, n = looped(b.column(1).to_numpy(), words.counts), words.counts, b.num_rows
            text, start, length, period = runs_by_text(words.names()[order], counts)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            edge = np.zeros(bounds[-1] + 1, "i8")
            np.add.at(edge, bounds[text] + start + period, 1)
            np.add.at(edge, bounds[text] + start + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(kept)])[bounds]
            texts = list(words.joined(order[kept], np.diff(left)))
            at = np.searchsorted(text, np.arange(n + 1)).tolist()
            rows = list(zip(start.tolist(), length.tolist(), period.tolist()))
            best, said = [None] * n, [rows[x:y] for x, y in zip(at, at[1:])]
            for i in np.unique(text).tolist():
                best[i] = max(said[i], key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            columns = {
                "n_runs": np.diff(at), "start": [x and x[0] for x in best], "length": [x and x[1] for x in best], "period": [x and x[2] for x in best], "exponent_milli": [x and 1000 * x[1] // x[2] for x in best],
                "runs_sha256": [hashlib.sha256("".join("%d,%d,%d\n" % r for r in x).encode()).hexdigest() for x in said], "collapsed_sha256": [hashlib.sha256(x).hexdigest() for x in texts],
            }
            if outputs:
                columns |= {"runs": [[dict(zip(("start", "length", "period"), r)) for r in x] for x in said], "collapsed": [bytes(x).decode() for x in texts]}
            yield batch_of(pa.schema([(id_col, b.schema.field(0).type), *fields]), **{id_col: b.column(0)}, **columns)

    return picked.mapInArrow(run, f"`{id_col}` {kind}, {named}")
