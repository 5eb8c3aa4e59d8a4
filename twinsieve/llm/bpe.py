"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

Each piece of a text starts as symbols; a segment tree over its adjacent pairs holds, in every
node, the smallest (rank, position) below. The root is thus the leftmost pair of lowest rank:
it is merged, three leaves change, and their paths are updated, until the root is empty.
Many pieces of one padded length advance together, one merge each in a step.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from .chunks import ChunkTable
from .common import prepare, sliced, trim

#: Distinct chunks that a worker remembers within a task.
ROOM = 1 << 20
_NONE = np.iinfo("i8").max
_held: dict[str, SegmentTreeBpe] = {}


class SegmentTreeBpe:
    """Encoder and decoder for one tokenizer file of the BPE kind with an end-of-word suffix or none."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        assert model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("byte_fallback"), "unsupported BPE options"
        self.library = Tokenizer.from_file(path)
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for word, i in [*self.vocab.items(), *self.added.items()]:
            self.strings[i] = word.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = size
        pair = np.array([self.vocab[a] * size + self.vocab[b] for a, b in merges], "i8")
        made = np.array([self.vocab[a + b] for a, b in merges], "i8")
        self.made = made
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks = pair[order], order.astype("i8")
        self.first = {c: self.vocab[c] for c in self.vocab if len(c) == 1}
        self.last = {c: self.vocab[c + self.suffix] for c in self.first if c + self.suffix in self.vocab}
        self.known = ChunkTable(self.fresh, "<u4", ROOM)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE)

    def merge(self, pieces: list[list[int]]) -> list[np.ndarray]:
        """The ids of each piece after all merges."""
        out: list[np.ndarray] = [np.empty(0, "i8")] * len(pieces)
        if not len(self.pairs):
            return [np.array(p, "i8") for p in pieces]
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) < 2:
                out[i] = np.array(p, "i8")
            else:
                groups.setdefault(1 << (len(p) - 2).bit_length(), []).append(i)
        for width, members in groups.items():
            step = max(1, (1 << 16) // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge_padded([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge_padded(self, pieces: list[list[int]], width: int) -> list[np.ndarray]:
        """width: leaves of each tree, a power of two, at least the number of pairs of each piece."""
        n, shift, size = len(pieces), max(1, width.bit_length() - 1), np.array([len(p) for p in pieces])
        sym = np.full((n, width + 2), -1, "i8")
        inside = np.arange(width + 2) < size[:, None]
        sym[inside] = np.concatenate([np.array(p, "i8") for p in pieces])
        alive = inside.copy()
        right = np.broadcast_to(np.arange(1, width + 3), sym.shape).copy()
        left = np.broadcast_to(np.arange(-1, width + 1), sym.shape).copy()
        tree = np.full((n, 2 * width), _NONE, "i8")
        rank = np.where(np.arange(1, width + 1) < size[:, None], self.rank(sym[:, :width], sym[:, 1 : width + 1]), _NONE)
        tree[:, width:] = np.where(rank == _NONE, _NONE, (rank << shift) | np.arange(width))
        at = width >> 1
        while at:
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
            at >>= 1
        row = np.flatnonzero(tree[:, 1] != _NONE)
        while len(row):
            top = tree[row, 1]
            pos = top & ((1 << shift) - 1)
            new = self.made[top >> shift]
            gone = right[row, pos]
            sym[row, pos] = new
            alive[row, gone] = False
            after = right[row, gone]
            right[row, pos] = after
            left[row, np.minimum(after, width + 1)] = pos
            before = left[row, pos]
            has_after, has_before = after < size[row], before >= 0
            r = np.where(has_after, self.rank(new, sym[row, np.minimum(after, width + 1)]), _NONE)
            l = np.where(has_before, self.rank(sym[row, np.maximum(before, 0)], new), _NONE)
            tree[row, width + pos] = np.where(r == _NONE, _NONE, (r << shift) | pos)
            g = gone < width
            tree[row[g], width + gone[g]] = _NONE
            b = has_before
            tree[row[b], width + before[b]] = np.where(l[b] == _NONE, _NONE, (l[b] << shift) | before[b])
            for rows, leaf in ((row, pos), (row[g], gone[g]), (row[b], before[b])):
                node = (leaf + width) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
            row = row[tree[row, 1] != _NONE]
        flat, ends = sym[alive], np.cumsum(alive.sum(axis=1))
        return np.split(flat, ends[:-1])

    def pieces(self, chunk: str) -> list[list[int] | int]:
        """Symbols of each piece of a chunk without white space at its ends; an added token is its id."""
        out: list[list[int] | int] = []
        while chunk:
            hits = [(at, -len(c), c) for c in self.added if (at := chunk.find(c)) >= 0]
            at, _, found = min(hits, default=(len(chunk), 0, ""))
            if segment := chunk[:at]:
                if segment.isascii() and segment.isalpha():
                    words = [segment.lower()]
                else:
                    norm = self.library.normalizer.normalize_str(segment) if self.library.normalizer else segment
                    words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
                for w in words:
                    out.append([*(self.first[c] for c in w[:-1]), self.last[w[-1]] if self.suffix else self.first[w[-1]]])
            if found:
                out.append(self.added[found])
            chunk = chunk[at + len(found) :]
        return out

    def fresh(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk."""
        made = [self.pieces(c) for c in chunks]
        merged = iter(self.merge([p for parts in made for p in parts if isinstance(p, list)]))
        return [np.concatenate([np.empty(0, "u4"), *(next(merged) if isinstance(p, list) else [p] for p in parts)]).astype("u4") if len(parts) != 1 or not isinstance(parts[0], list) else next(merged).astype("u4") for parts in made]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each).

        Space and line feed never lie within a piece and never change what stands beside them,
        so a text is encoded chunk by chunk between them.
        """
        return self.known.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids, special tokens included, as the library joins tokens without a decoder."""
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def loaded(path: str) -> SegmentTreeBpe:
    """One encoder for each worker and file."""
    if path not in _held:
        _held[path] = SegmentTreeBpe(path)
    return _held[path]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text; with outputs also ids (binary) and decoded (text).

    Null counts as the empty text, which has no ids and decodes to the empty text; repeated
    rows each give a row, null ids stay null, extra columns are left out.
    """
    prepare(docs.sparkSession)
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())] if outputs else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in sliced(batches, 3 << 17):
            flat, sizes = bpe.encode(b.column(1))
            raw, ends = flat.astype("<u4", copy=False).tobytes(), (4 * np.cumsum(sizes)).tolist()
            ids = [raw[i:j] for i, j in zip([0, *ends], ends)]
            texts = [bpe.decode(x) for x in ids]
            columns = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
            columns += [pa.array(ids, pa.binary()), pa.array([x.decode() for x in texts], pa.string())] if outputs else []
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        bpe.known.clear()  # the worker lives on beside other stages
        trim()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, T.StructType(fields))
