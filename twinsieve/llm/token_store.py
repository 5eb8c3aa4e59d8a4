"""Token ids in files: canonical length-limited Huffman codes, read back by table.

A file holds the payload, an index and a tail. The payload is a row of blocks; a block holds
up to BLOCK ids of one document and starts at a byte. Every LANE ids there is a checkpoint:
the index has the number of bits of each such lane, so any lane of any block can be decoded by
itself, and many lanes are decoded side by side, one id of each in a step.

    payload | index, zlib | tail: length of payload, length of index, MAGIC

The index is one JSON line and then arrays: code lengths (u1 for each id), doc_id (i8), whether
it is null (u1), number of ids (i8), bits of each lane (u2).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from .chunks import ChunkTable, Laid, binaries, gathered, hashed, padded, same_spans, with_end
from .common import fresh_dir, make_dir, open_fs, prepare, sliced

MAGIC = b"TOKHUF1\n"
BLOCK, LANE = 1 << 14, 64
#: Payload at which a file is closed, and ids that are decoded at once.
FILE_BYTES, GROUP_IDS = 256 << 20, 2 << 20
_held: dict[str, ChunkTable] = {}


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal prefix-code lengths, none above the limit (16, or what the alphabet needs), by package-merge. Unused ids: 0."""
    lengths = np.zeros(len(counts), "u1")
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    need = int(len(used) - 1).bit_length()
    limit = limit or max(16, need)
    if not need <= limit <= 24:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits; 24 at most can be read")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype("f8")
    merged, packs = coins, [np.zeros(len(coins), bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, pairs])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        packs.append(rank >= len(coins))
    take, total = 2 * len(coins) - 2, np.zeros(len(coins), "i8")
    for is_pack in reversed(packs):
        inside = int(is_pack[:take].sum())
        total[: take - inside] += 1
        take = 2 * inside
    lengths[order] = total
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: ids in order of length and then number get consecutive codes."""
    codes, code, last = np.zeros(len(lengths), "u4"), 0, 0
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    by = lengths[order]
    for bits in np.unique(by):
        code <<= int(bits) - last
        at = order[by == bits]
        codes[at] = code + np.arange(len(at), dtype="u4")
        code, last = code + len(at), int(bits)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits looked at, id and code length for each such prefix)."""
    bits = max(1, int(lengths.max(initial=1)))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    each = 1 << (bits - lengths[order].astype("i8"))
    ids, sizes = np.zeros(1 << bits, "u4"), np.ones(1 << bits, "u1")
    ids[: each.sum()] = np.repeat(order, each)
    sizes[: each.sum()] = np.repeat(lengths[order], each)
    return bits, ids, sizes


def _blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and number of ids of each block."""
    each = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    return doc, np.minimum(BLOCK, sizes[doc] - nth * BLOCK)


def pack(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of documents that follow each other in ids: (payload, bytes of each document, bits of each lane, lanes of each document)."""
    doc, block = _blocks(sizes)
    bits = lengths[ids].astype("i8")
    if not len(ids):
        return b"", np.zeros(len(sizes), "i8"), np.empty(0, "u2"), np.zeros(len(sizes), "i8")
    before = np.cumsum(bits) - bits
    first = np.cumsum(block) - block
    block_bits = np.add.reduceat(bits, first)
    block_bytes = (block_bits + 7) >> 3
    at = before + np.repeat(((np.cumsum(block_bytes) - block_bytes) << 3) - before[first], block)
    room = np.left_shift(codes[ids].astype("u8"), (64 - bits - (at & 31)).astype("u8"))
    word, size = at >> 5, int(block_bytes.sum())
    total = np.bincount(word, weights=(room >> np.uint64(32)).astype("f8"), minlength=(size >> 2) + 2)
    low = (room & np.uint64(0xFFFFFFFF)).astype("f8")
    total[1:] += np.bincount(word, weights=low, minlength=len(total))[: len(total) - 1]
    lanes = -(-block // LANE)
    lane_first = np.repeat(first, lanes) + (np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
    return total.astype(">u4").tobytes()[:size], np.bincount(doc, weights=block_bytes, minlength=len(sizes)).astype("i8"), np.add.reduceat(bits, lane_first).astype("u2"), np.bincount(doc, weights=lanes, minlength=len(sizes)).astype("i8")


def unpack(payload: bytes, sizes: np.ndarray, lane_bits: np.ndarray, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of documents whose blocks follow each other in payload, by table, all lanes side by side."""
    bits, symbol, length = table
    _, block = _blocks(sizes)
    lanes = -(-block // LANE)
    if not len(block):
        return np.empty(0, "u4")
    lane = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    count = np.minimum(LANE, np.repeat(block, lanes) - lane * LANE)
    ends = np.cumsum(lane_bits.astype("i8"))
    first = np.cumsum(lanes) - lanes
    block_bits = np.add.reduceat(lane_bits.astype("i8"), first)
    block_bytes = (block_bits + 7) >> 3
    at = ends - lane_bits + np.repeat(((np.cumsum(block_bytes) - block_bytes) << 3) - (ends[first] - lane_bits[first]), lanes)
    raw = payload + b"\0" * 8
    words = np.ndarray((len(raw) - 3,), ">u4", raw, 0, (1,))
    out = np.zeros((len(at), LANE), "u4")
    order = np.argsort(-count, kind="stable")
    at, left = at[order], count[order]
    made = np.zeros_like(out)
    for step in range(LANE):
        n = int(np.searchsorted(-left, -step, "left"))
        if not n:
            break
        here = at[:n]
        seen = (words[here >> 3].astype("u4") << (here & 7).astype("u4")) >> np.uint32(32 - bits)
        made[:n, step] = symbol[seen]
        here += length[seen]
    out[order] = made
    return out[np.arange(LANE) < count[:, None]]


#: Marks that never join a word.
_MARKS = ".,;:!?"
_IS_MARK = np.isin(np.arange(256), np.frombuffer(_MARKS.encode(), "u1"))
_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_LOWER = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], "u1")


def folded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a byte is of a letter of ASCII or of À to ÿ, the bytes with these letters lower-cased) of UTF-8."""
    letter, low = _LETTER[raw], _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    second = raw[lead + 1]
    fine = (second != 0x97) & (second != 0xB7)  # the signs × and ÷
    letter[lead[fine]] = letter[lead[fine] + 1] = True
    upper = lead[fine & (second < 0x9F)] + 1
    low[upper] = raw[upper] + 0x20
    return letter, low


def _table(path: str) -> ChunkTable:
    """The worker's remembered chunks for one tokenizer file.

    No piece of a text reaches over a space or a line feed, and neither changes what stands
    beside it; so the library encodes chunks. A chunk of Latin letters and one mark is its lower-cased
    letters and the mark, which the library also takes apart; so it encodes each such word once.
    """
    if path in _held:
        return _held[path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    kind = id_kind(library.get_vocab_size())

    def plain(words: list[str]) -> Laid:
        out: list[list[int]] = []
        for i in range(0, len(words), 4096):
            out += [e.ids for e in library.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
        return np.array(list(chain.from_iterable(out)), kind), np.array([len(x) for x in out], "i8")

    final = np.zeros(library.get_vocab_size() + 1, bool)
    ends = [i for token, i in library.get_vocab().items() if token.endswith("</w>")]
    final[ends] = True

    def letters(spaced: np.ndarray, stop: np.ndarray) -> Laid:
        """Words of letters alone, each with a space behind it up to stop, are one piece each, and the last id of a piece is one of those that end a word."""
        made: list[Laid] = []
        for i in range(0, len(stop), 4096):
            n = len(stop[i : i + 4096])
            part = spaced[stop[i - 1] if i else 0 : stop[i + n - 1] - 1].tobytes().decode()
            ids = np.array(library.encode_batch_fast([part], add_special_tokens=False)[0].ids, kind)
            ends = np.flatnonzero(final[ids]) + 1
            if len(ends) != n or ends[-1] != len(ids):  # an alphabet that the library takes apart
                made.append(plain(part.split(" ")))
            else:
                made.append((ids, np.diff(ends, prepend=0)))
        return np.concatenate([np.empty(0, kind), *(x for x, _ in made)]), np.concatenate([np.empty(0, "i8"), *(x for _, x in made)])

    def ids_of(word: str) -> list[int]:
        return plain([word])[0].tolist()

    folds = ids_of("Äé") == ids_of("äé") and ids_of("Ab") == ids_of("ab") and ids_of("ab.") == ids_of("ab") + ids_of(".") and ids_of("é,") == ids_of("é") + ids_of(",")
    marks, mark_size = plain(list(_MARKS))
    mark_at, nth_mark = np.cumsum(mark_size) - mark_size, np.zeros(256, "i8")
    nth_mark[np.frombuffer(_MARKS.encode(), "u1")] = np.arange(len(_MARKS))

    def fresh(chunks: list[str]) -> Laid:
        if not folds:
            return plain(chunks)
        raw = np.frombuffer("\n".join(chunks).encode(), "u1")
        stop = np.r_[np.flatnonzero(raw == 10), len(raw)]
        start = np.r_[0, stop[:-1] + 1]
        letter, low = folded(raw)
        marked = _IS_MARK[raw[stop - 1]]
        end, other = stop - marked, np.r_[0, np.cumsum(~letter)]
        simple = np.flatnonzero((other[end] == other[start]) & (end > start))
        at, size = start[simple], (end - start)[simple]
        keys = hashed(low, at, at + size)
        low = padded(low)
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        like = first[back.ravel()]
        same = size == size[like]
        same[same] = same_spans(low, at[same], low, at[like[same]], size[same])
        simple, back = simple[same], back.ravel()[same]
        at, size = at[first], size[first]
        place = table.find(keys, low, at, at + size)
        there, missing = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        known, known_size = table.get(place[there]), table.size[place[there]]
        spaced, ends = gathered(low, at[missing], size[missing] + 1), np.cumsum(size[missing] + 1)
        spaced[ends - 1] = 32
        made, made_size = letters(spaced, ends)
        table.put(keys[missing], low, at[missing], (at + size)[missing], (made, made_size))
        rest = np.setdiff1d(np.arange(len(chunks)), simple, assume_unique=True)
        plainly, plain_size = plain([chunks[i] for i in rest])
        # what a chunk is made of lies in these one after another
        source, sizes = np.concatenate([known, made, plainly, marks]), np.zeros((len(chunks), 2), "i8")
        begin, of = np.zeros_like(sizes), np.zeros(len(keys), "i8")
        of[np.r_[there, missing]] = np.arange(len(keys))
        every = np.concatenate([known_size, made_size, plain_size])
        every_at = np.cumsum(every) - every
        nth = np.zeros(len(chunks), "i8")
        nth[simple], nth[rest] = of[back], len(keys) + np.arange(len(rest))
        sizes[:, 0], begin[:, 0] = every[nth], every_at[nth]
        mark = nth_mark[raw[stop[simple] - 1]]
        sizes[simple, 1], begin[simple, 1] = mark_size[mark] * marked[simple], len(source) - len(marks) + mark_at[mark]
        return gathered(source, begin.ravel(), sizes.ravel()), sizes.sum(axis=1)

    table = _held[path] = ChunkTable(fresh, kind)
    return table


def id_kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _index(head: dict, lengths: np.ndarray, docs: list, lanes: list[bytes]) -> bytes:
    ids = np.array([0 if d is None else d for d, _ in docs], "<i8")
    nulls = np.array([d is None for d, _ in docs], "u1")
    sizes = np.array([n for _, n in docs], "<i8")
    bits = b"".join(lanes)
    head = head | {"vocabulary": len(lengths), "documents": len(docs), "lanes": len(bits) // 2}
    return zlib.compress(json.dumps(head).encode() + b"\n" + lengths.tobytes() + ids.tobytes() + nulls.tobytes() + sizes.tobytes() + bits, 1)


def write_store(docs: DataFrame, path: str, out_dir: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the ids of every whole text in ascending id order; returns the files in that order.

    Null is the empty text; end_id follows each document. Null ids come first; rows that repeat
    an id each give a document, in the order of their bits, and may lie in neighbouring files.
    An empty table writes no file. Ids are integers. A file's name is new in each attempt, and
    only files of tasks that ended are returned, so a lost executor leaves nothing behind that is read.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = Tokenizer.from_file(path).get_vocab_size()
    size = max(size, (end_id or 0) + 1)
    kind = id_kind(size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 3 << 19):
            ids, sizes = _table(path).encode(b.column(1))
            ids, sizes = (ids, sizes) if end_id is None else with_end(ids.astype(kind, copy=False), sizes, end_id)
            yield pa.RecordBatch.from_arrays([b.column(0), binaries(ids.astype(kind, copy=False), sizes)], ["doc_id", "ids"])

    at = fresh_dir(spark, "ids")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(encode, "doc_id long, ids binary").write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(at)
    rows = spark.read.schema("doc_id long, ids binary").parquet(at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(size, "i8"), 0
        for b in batches:
            column = b.column(0)
            for x in column.to_pylist():
                total += np.bincount(np.frombuffer(x, kind), minlength=size) if len(x) > 1 << 16 else 0
            short = b"".join([x for x in column.to_pylist() if len(x) <= 1 << 16])
            total += np.bincount(np.frombuffer(short, kind), minlength=size)
            held += len(column)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counted = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, "i8")
    counts[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    lengths = code_lengths(counts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) * 2 // (128 << 20)))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts)).alias("q")).first().q or []
    edges = np.array(cuts if parts > 1 else [], "i8")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = canonical(lengths), 0
        for b in sliced(batches, 3 << 19):
            blobs = b.column(1).to_pylist()
            sizes = np.array([len(x) for x in blobs]) // np.dtype(kind).itemsize
            payload, used, bits, lanes = pack(np.frombuffer(b"".join(blobs), kind), sizes, codes, lengths)
            ids = b.column(0).fill_null(np.iinfo("i8").min).to_numpy()
            low, high = np.searchsorted(edges, ids, "left"), np.searchsorted(edges, ids, "right")
            bucket = low + (seen + np.arange(len(ids))) % (high - low + 1)
            seen += len(ids)
            ends, lane_ends, raw = np.cumsum(used).tolist(), (np.cumsum(lanes) * 2).tolist(), bits.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), b.column(0), pa.array(sizes, pa.int64()), pa.array([payload[i:j] for i, j in zip([0, *ends], ends)], pa.binary()), pa.array([raw[i:j] for i, j in zip([0, *lane_ends], lane_ends)], pa.binary())],
                ["bucket", "doc_id", "n", "payload", "lanes"],
            )

    make_dir(out_dir)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(out_dir)
        part, nth, out, held, lanes, docs_, uri, bucket = TaskContext.get().partitionId(), 0, None, 0, [], [], "", 0

        def closed() -> pa.RecordBatch:
            index = _index({"block": BLOCK, "lane": LANE}, lengths, docs_, lanes)
            out.write(index)
            out.write(struct.pack("<QQ", held, len(index)) + MAGIC)
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([nth], pa.int32()), pa.array([uri]), pa.array([len(docs_)], pa.int64()), pa.array([sum(n for _, n in docs_)], pa.int64())], ["bucket", "nth", "file", "documents", "n_tokens"])

        for b in batches:
            for k, d, n, payload, bits in zip(*(b.column(i).to_pylist() for i in range(5))):
                if out is None:
                    name = f"part-{part:05d}-{nth:03d}-{uuid.uuid4().hex}.tokhuf"
                    uri, out, held, lanes, docs_, bucket = f"{out_dir}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None), 0, [], [], k
                out.write(payload)
                held += len(payload)
                lanes.append(bits)
                docs_.append((d, n))
                if held >= FILE_BYTES:
                    yield closed()
                    out, nth = None, nth + 1
        if out is not None:
            yield closed()

    packed = rows.mapInArrow(squeeze, "bucket int, doc_id long, n long, payload binary, lanes binary")
    made = packed.repartitionById(parts, F.col("bucket")).sortWithinPartitions("doc_id", "payload").mapInArrow(write, "bucket int, nth int, file string, documents long, n_tokens long")
    files = sorted((r.asDict() for r in made.collect()), key=lambda r: (r["bucket"], r["nth"]))
    start = 0
    for f in files:
        f["start"], start = start, start + f["n_tokens"]
    return files


class StoredFile:
    """One file: its index is read at once, its documents on demand."""

    def __init__(self, uri: str) -> None:
        fs, path = open_fs(uri)
        self.at = fs.open_input_file(path)
        end = self.at.size()
        self.at.seek(end - 16 - len(MAGIC))
        tail = self.at.read(16 + len(MAGIC))
        assert tail[16:] == MAGIC, f"{uri} isn't a whole token file"
        payload, index = struct.unpack("<QQ", tail[:16])
        self.at.seek(payload)
        raw = zlib.decompress(self.at.read(index))
        line, _, rest = raw.partition(b"\n")
        self.head = json.loads(line)
        assert (self.head["block"], self.head["lane"]) == (BLOCK, LANE), "other block sizes"
        v, d = self.head["vocabulary"], self.head["documents"]
        self.table = decoding_table(np.frombuffer(rest, "u1", v))
        self.doc_ids = np.frombuffer(rest, "<i8", d, v)
        self.null = np.frombuffer(rest, "u1", d, v + 8 * d).astype(bool)
        self.sizes = np.frombuffer(rest, "<i8", d, v + 9 * d)
        self.lanes = np.frombuffer(rest, "<u2", self.head["lanes"], v + 17 * d)
        doc, block = _blocks(self.sizes)
        each = -(-block // LANE)
        first = np.cumsum(each) - each
        block_bytes = (np.add.reduceat(self.lanes.astype("i8"), first) + 7) >> 3 if len(block) else np.empty(0, "i8")
        self.bytes_to = np.r_[0, np.cumsum(np.bincount(doc, weights=block_bytes, minlength=d).astype("i8"))]
        self.lanes_to = np.r_[0, np.cumsum(np.bincount(doc, weights=each, minlength=d).astype("i8"))]
        self.tokens_to = np.r_[0, np.cumsum(self.sizes)]

    def read(self, i: int, j: int) -> np.ndarray:
        """The ids of documents i to j - 1, one after another."""
        self.at.seek(int(self.bytes_to[i]))
        payload = self.at.read(int(self.bytes_to[j] - self.bytes_to[i]))
        return unpack(payload, self.sizes[i:j], self.lanes[self.lanes_to[i] : self.lanes_to[j]], self.table)

    def groups(self) -> Iterator[tuple[int, int]]:
        i, d = 0, len(self.sizes)
        while i < d:
            j = max(i + 1, int(np.searchsorted(self.tokens_to, self.tokens_to[i] + GROUP_IDS, "right")) - 1)
            yield i, min(j, d)
            i = min(j, d)


def read_store(spark: SparkSession, files: list[dict], ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit integers) of each document in the files."""
    prepare(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = StoredFile(uri)
                for i, j in f.groups():
                    raw, base = memoryview(f.read(i, j).astype("<u4").tobytes()), int(f.tokens_to[i])
                    at = [4 * (int(x) - base) for x in f.tokens_to[i : j + 1]]
                    parts = [raw[x:y] for x, y in zip(at, at[1:])]
                    columns = [pa.array(f.doc_ids[i:j], mask=f.null[i:j]), pa.array(start + f.tokens_to[i:j]), pa.array(f.sizes[i:j]), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(x) for x in parts], pa.binary())] * ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    listed = spark.createDataFrame([(f["file"], f["start"]) for f in files], "file string, start long")
    return listed.repartition(max(1, len(files))).mapInArrow(read, schema)
