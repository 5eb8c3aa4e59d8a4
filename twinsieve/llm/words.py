"""Words of many texts at once: a word is a stretch of bytes other than the space and the controls 9 to 13, in UTF-8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import polyhash


class Words:
    """The words of some texts: where in `buf` they start and end, and how many each text has. buf has one byte more than the texts."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        """buf: the texts' bytes, one after another; text i is buf[offsets[i]:offsets[i + 1]]."""
        n = len(buf)
        self.buf = np.empty(n + 1, "u1")
        self.buf[:n] = buf
        self.buf[n] = 32
        inside = (self.buf != 32) & ((self.buf - np.uint8(9)) > 4)
        first, last = inside.copy(), inside[:-1].copy()
        first[1:] &= ~inside[:-1]
        last &= ~inside[1:]
        edges = offsets[1:-1]
        first[edges] = inside[edges]  # a text starts and ends a word
        ends = edges[edges > 0] - 1
        last[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # of each text's words
        self.counts = np.diff(self.bounds)

    def names(self) -> np.ndarray:
        """A number for each word, the same for equal words: exact, by a dictionary of the words."""
        size = self.end - self.start
        at = np.concatenate([[0], np.cumsum(size)])
        letters = self.buf[np.repeat(self.start - at[:-1], size) + np.arange(at[-1])]
        held = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype("i8")), pa.py_buffer(letters)])
        return held.dictionary_encode().indices.to_numpy()

    def joined(self, order: np.ndarray, counts: np.ndarray, most: int = 1 << 22) -> Iterator[memoryview]:
        """Texts of counts[0], counts[1], ... words, by number in `order`, with one space between them; made about `most` bytes at a time."""
        bounds = np.concatenate([[0], np.cumsum(counts)])
        size = (self.end - self.start)[order] + 1
        at = np.concatenate([[0], np.cumsum(size)])
        edges = at[bounds]
        a = 0
        while a < len(counts):
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + most, "right")) - 1)
            x, y = bounds[a], bounds[b]
            base = at[x]
            out = self.buf[np.repeat(self.start[order[x:y]] - (at[x:y] - base), size[x:y]) + np.arange(at[y] - base)]
            out[at[x + 1 : y + 1] - base - 1] = 32
            whole, cuts = memoryview(out), (edges[a : b + 1] - base).tolist()
            for i, j in zip(cuts, cuts[1:]):
                yield whole[i : max(i, j - 1)]
            a = b


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    held = column.cast(pa.large_string()).fill_null("")
    if not len(held):
        return np.empty(0, "u1"), np.zeros(1, "i8")
    offsets = np.frombuffer(held.buffers()[1], "i8")[held.offset : held.offset + len(held) + 1]
    data = held.buffers()[2]
    buf = np.frombuffer(data, "u1")[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, "u1")
    return buf, offsets - offsets[0]


def hashes(words: Words, most: int = polyhash.KEPT) -> np.ndarray:
    """A 64-bit hash of each word, about `most` bytes at a time."""
    out = np.empty(len(words.start), "u8")
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(words.end, words.start[a] + most, "right")))
        base = words.start[a]
        letters = words.buf[base : words.end[b - 1]].astype("u8") + np.uint64(1)
        out[a:b] = polyhash.mix(polyhash.spans(letters, words.start[a:b] - base, words.end[a:b] - base))
        a = b
    return out
