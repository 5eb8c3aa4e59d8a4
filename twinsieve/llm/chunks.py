"""Encoding texts chunk by chunk, each distinct chunk once for a worker.

A chunk is what stands between spaces and line feeds. Chunks are found, hashed and looked up for
a whole batch at a time on its bytes, and every hit is compared byte by byte; only those never seen become strings and are encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash

from .polyhash import spans

#: Distinct chunks that a worker remembers; beyond it keeps those that it has met again, and none if they are too many.
REMEMBERED = 1 << 20
#: Chunks of this length or more are hashed one by one; the polynomial hash is for shorter ones.
LONG = 512
Laid = tuple[np.ndarray, np.ndarray]
_rows = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype="u8")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of strings; null is empty."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def split(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each chunk that isn't empty."""
    inner = (raw != 32) & (raw != 10)
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inner & (cut[:-1] | ~np.r_[False, inner[:-1]]))
    end = np.flatnonzero(inner & (cut[1:] | ~np.r_[inner[1:], False])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = spans(_rows[raw], start, end)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + (end - start).astype("u8")
    for i in np.flatnonzero(end - start >= LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return h ^ (h >> np.uint64(28))


def padded(raw: np.ndarray) -> np.ndarray:
    """raw with the eight bytes behind it that same_spans may look at."""
    return np.concatenate([raw, np.zeros(8, "u1")])


def same_spans(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes of a from at equal those of b from bt, for each pair of spans; eight bytes at a time, of padded arrays."""
    out = np.ones(len(size), bool)
    for i in np.flatnonzero(size >= LONG):
        out[i] = a[at[i] : at[i] + size[i]].tobytes() == b[bt[i] : bt[i] + size[i]].tobytes()
    x, y = (np.ndarray((len(v) - 7,), "<u8", v, strides=(1,)) for v in (a, b))
    live, done = np.flatnonzero(size < LONG), 0
    while len(live):
        left = size[live] - done
        apart = x[at[live] + done] ^ y[bt[live] + done]
        end = np.flatnonzero(left < 8)
        apart[end] &= (np.uint64(1) << (8 * left[end]).astype("u8")) - np.uint64(1)
        out[live[apart != 0]] = False
        live, done = live[(left > 8) & (apart == 0)], done + 8
    return out


def gathered(held: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of held, one after another."""
    return held[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The spans of raw (padded), in which no line feed is, as strings."""
    size = end - start + 1
    joined = gathered(raw, start, size)
    joined[np.cumsum(size) - 1] = 10
    return joined.tobytes().decode().split("\n")[:-1]


def laid(parts: list[np.ndarray], kind: np.dtype) -> Laid:
    """Arrays one after another, and the size of each."""
    return np.concatenate([np.empty(0, kind), *parts]).astype(kind, copy=False), np.array([len(x) for x in parts], "i8")


class ChunkTable:
    """ids of chunks by hash and bytes. fresh(list of strings) gives the ids of each as an array, or all of them laid()."""

    def __init__(self, fresh: Callable[[list[str]], list[np.ndarray] | Laid], kind: str, room: int = REMEMBERED) -> None:
        self.fresh, self.kind, self.room = fresh, np.dtype(kind), room
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.empty(0, "u8"), np.empty(0, "i8"), np.empty(0, "i8")
        self.text_at, self.text_size = np.empty(0, "i8"), np.empty(0, "i8")
        self.met = np.empty(0, bool)
        self.flat, self.used = np.empty(1 << 16, self.kind), 0
        self.text, self.text_used = np.empty(1 << 16, "u1"), 0

    def find(self, keys: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each chunk of raw (padded); -1 if its key isn't there, -2 if the key is that of another chunk."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        place = np.where(self.keys[at] == keys, at, -1)
        hit = np.flatnonzero(place >= 0)
        size, held = (end - start)[hit], place[hit]
        same = self.text_size[held] == size
        same[same] = same_spans(self.text, self.text_at[held[same]], raw, start[hit[same]], size[same])
        place[hit[~same]] = -2
        return place

    def put(self, keys: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray, ids: list[np.ndarray] | Laid) -> None:
        """Adds chunks of raw; one whose key is there, or is that of an earlier one of them, is left out."""
        keys, first = np.unique(keys, return_index=True)
        if len(self.keys):
            new = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys
            keys, first = keys[new], first[new]
        flat, size = ids if isinstance(ids, tuple) else laid(ids, self.kind)
        flat_at, size, start, text_size = (np.cumsum(size) - size)[first], size[first], start[first], (end - start)[first]
        self.flat, self.used, at = self._more(self.flat, self.used, gathered(flat, flat_at, size), size)
        self.text, self.text_used, text_at = self._more(self.text, self.text_used, gathered(raw, start, text_size), text_size)
        into = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, into, keys), np.insert(self.at, into, at), np.insert(self.size, into, size)
        self.text_at, self.text_size = np.insert(self.text_at, into, text_at), np.insert(self.text_size, into, text_size)
        self.met = np.insert(self.met, into, False)

    def make_room(self, wanted: int) -> None:
        """Forgets what wasn't met again since the last time, or everything, so that wanted more chunks fit."""
        kept = np.flatnonzero(self.met)
        if len(kept) + wanted > self.room:
            return self.clear()
        ids, text = self.get(kept), gathered(self.text, self.text_at[kept], self.text_size[kept])
        keys, size, text_size = self.keys[kept], self.size[kept], self.text_size[kept]
        self.clear()
        self.keys, self.size, self.text_size, self.met = keys, size, text_size, np.zeros(len(kept), bool)
        self.at, self.text_at = np.cumsum(size) - size, np.cumsum(text_size) - text_size
        self.flat, self.used = np.concatenate([ids, np.empty(1 << 16, self.kind)]), len(ids)
        self.text, self.text_used = np.concatenate([text, np.empty(1 << 16, "u1")]), len(text)

    @staticmethod
    def _more(held: np.ndarray, used: int, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """held with flat, parts of these sizes, behind what is used, the place after them, and where each part lies."""
        while used + len(flat) + 8 > len(held):
            held = np.concatenate([held, np.empty_like(held)])
        held[used : used + len(flat)] = flat
        return held, used + len(flat), used + np.cumsum(size) - size

    def get(self, place: np.ndarray) -> np.ndarray:
        """The ids at these places, one after another."""
        return gathered(self.flat, self.at[place], self.size[place])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        offsets, raw = buffers(texts)
        start, end, row = split(offsets, raw)
        if not len(start):
            return np.empty(0, self.kind), np.zeros(len(texts), "i8")
        raw, keys = padded(raw), hashed(raw, start, end)
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        back = back.ravel()
        place = self.find(keys, raw, start[first], end[first])
        new = np.flatnonzero(place == -1)
        self.met[place[place >= 0]] = True
        if len(new) and len(self.keys) + len(new) > self.room:
            self.make_room(len(new))
            place = self.find(keys, raw, start[first], end[first])
            new = np.flatnonzero(place == -1)
        if len(new):
            at = first[new]
            self.put(keys[new], raw, start[at], end[at], self.fresh(strings(raw, start[at], end[at])))
            place = self.find(keys, raw, start[first], end[first])
        like, size = first[back], end - start
        same = size == size[like]
        same &= place[back] >= 0
        same[same] = same_spans(raw, start[same], raw, start[like[same]], size[same])
        if same.all():
            place = place[back]
            return self.get(place), np.bincount(row, weights=self.size[place], minlength=len(texts)).astype("i8")
        odd = np.flatnonzero(~same)  # a hash that is also another chunk's
        words = strings(raw, start[odd], end[odd])
        distinct = list(dict.fromkeys(words))
        ids = self.fresh(distinct)
        made = dict(zip(distinct, np.split(ids[0], np.cumsum(ids[1])[:-1]) if isinstance(ids, tuple) else ids))
        own = dict(zip(odd.tolist(), (made[w] for w in words)))
        place = self.find(keys, raw, start[first], end[first])[back]  # fresh may have added to the table
        parts = [own[i] if i in own else self.flat[self.at[p] : self.at[p] + self.size[p]] for i, p in enumerate(place.tolist())]
        return np.concatenate(parts).astype(self.kind), np.bincount(row, weights=[len(x) for x in parts], minlength=len(texts)).astype("i8")


def binaries(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An array of binaries: each row's ids."""
    ends = np.r_[0, np.cumsum(sizes * ids.itemsize)]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype("i8").tobytes()), pa.py_buffer(np.ascontiguousarray(ids).tobytes())]).cast(pa.binary())


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an id after each row."""
    return np.insert(ids, np.cumsum(sizes), end), sizes + 1
