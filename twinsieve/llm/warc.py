"""WARC archives of pages and a two-level capture index over them.

Archives are gzip members, one a record. The capture index sorts entries by reversed-host URL
key into compressed blocks; a sparse directory has the first key, the last key and the place of each block. A directory
of more than one block's lines is put into blocks in the same way, until the top is small enough to be sent to every task.
A lookup bisects the top, reads a block's range, bisects that, down to the captures, and reads the records' ranges.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_dir, make_dir, open_fs, prepare, sliced, written

DATE = "1970-01-01T00:00:00Z"
FILE_BYTES, GAP, SPAN = 1 << 30, 64 << 10, 8 << 20
#: Revisits up to which the table of them is broadcast; more are joined by shuffle.
SENT_ROWS = 200_000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then port, path and query; scheme, fragment and A-Z in the host don't count."""
    rest = re.sub(r"#.*", "", (url or ""), flags=re.S)
    scheme, found, rest = rest.partition("://")
    if not found:
        return scheme
    host, path = re.match(r"([^/?]*)(.*)", rest, re.S).groups()
    host = host.rpartition("@")[2].lower()
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + (path or "/")


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, revisit_of: int | None, is_revisit: bool) -> tuple[bytes, str]:
    """(one gzip member, payload digest): a response with the payload, or a revisit that refers to the response's record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(revisit_of)}", f"X-Refers-To-Page-Id: {revisit_of}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"), digest


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("the record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:] if ": " in x), payload


def write_archives(pages: DataFrame, out_dir: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes a record for each row; returns the capture entries: key, url, page_id, file, offset, length, digest, record_type.

    Of rows with equal payloads (null: empty) of at least min_revisit_bytes, those with the
    smallest page_id are responses and the others revisit them. A null page_id is never the
    smallest unless no row with the payload has an id; a row that repeats the smallest id is a response again.
    An empty table writes no archive. A file's name is new in each attempt; only entries of
    tasks that ended are returned.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("raw"))
    seen = written(rows.select("page_id", F.unhex(F.sha1("raw")).alias("sha"), F.length("raw").alias("n")).where(F.col("n") >= min_revisit_bytes), "digests")
    groups = seen.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null")
    later = written(seen.join(groups, "sha").where("page_id is null or page_id > first").select("page_id", "sha", "first").distinct(), "revisits")
    small = later.count() <= SENT_ROWS
    rows = rows.withColumn("sha", F.unhex(F.sha1("raw")))
    later = later.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first")
    rows = rows.join(F.broadcast(later) if small else later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "raw", "first")
    make_dir(out_dir)
    schema = "key string, url string, page_id long, file string, offset long, length long, digest string, record_type string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(out_dir)
        part, out, uri, at, nth = TaskContext.get().partitionId(), None, "", 0, 0
        for b in sliced(batches):
            found = []
            for page, url, raw, first in zip(*(b.column(i).to_pylist() for i in range(4))):
                if out is None:
                    name = f"part-{part:05d}-{nth:03d}-{uuid.uuid4().hex}.warc.gz"
                    uri, out, nth = f"{out_dir}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None), nth + 1
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name)}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n"
                    info = _member(info.encode())
                    out.write(info)
                    at = len(info)
                member, digest = record(page, url, raw, first, first is not None)
                out.write(member)
                found.append((surt(url), url, page, uri, at, len(member), digest, "response" if first is None else "revisit"))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["key", "url", "page_id", "file", "offset", "length", "digest", "record_type"])
        if out is not None:
            out.close()

    return written(rows.mapInArrow(write, schema), "captures")


_CAPTURE = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
_CAPTURE_NAMES = ["key", "url", "page_id", "file", "offset", "length", "digest", "record_type"]
_CAPTURE_SCHEMA = "key string, url string, page_id long, file string, offset long, length long, digest string, record_type string"
_PLACE_SCHEMA = "first string, last string, file string, offset long, length long, n long"


def _blocks(dealt: DataFrame, out_dir: str, lines: int, last: int) -> DataFrame:
    """Puts sorted rows into compressed blocks of so many lines; returns each block's place. A row's first key is its column 0, its last key column `last`."""
    make_dir(out_dir)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(out_dir)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.cdx"
        out, at, held, made = None, 0, [], []

        def flush() -> None:
            nonlocal out, at, held
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            raw = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            out.write(raw)
            made.append((held[0][0], held[-1][last], f"{out_dir}/{name}", at, len(raw), len(held)))
            at, held = at + len(raw), []

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns)):
                held.append(x)
                if len(held) >= lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["first", "last", "file", "offset", "length", "n"])

    return written(dealt.mapInArrow(write, _PLACE_SCHEMA), "directory")


def build_index(entries: DataFrame, out_dir: str, lines: int = 3000) -> DataFrame:
    """Sorts entries by key into compressed blocks of so many lines; returns the directory: first, last, file, offset, length, n.

    Equal keys may fill several blocks. The sort deals by (key, file, offset), so one hot key spreads over tasks.
    """
    prepare(entries.sparkSession)
    return _blocks(entries.select(*_CAPTURE_NAMES).orderBy("key", "file", "offset"), out_dir, lines, 0)


def _block(uri: str, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(read_range(uri, offset, length)).decode().split("\n")]


def read_range(uri: str, offset: int, length: int) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


@dataclass(frozen=True)
class SparseDirectory:
    """top: places (first, last, file, offset, length) in order; levels: how many levels of directory blocks lie below them."""

    top: tuple[tuple[str, str, str, int, int], ...]
    levels: int

    def places(self, key: str, held: dict | None = None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of each capture block that can hold the key, by bisection of every level. held remembers blocks read."""
        found = list(_covering(self.top, key))
        for _ in range(self.levels):
            below = []
            for _, _, *at in found:
                if held is None or tuple(at) not in held:
                    read = _block(*at)
                    if held is not None:
                        if len(held) >= 64:
                            held.clear()
                        held[tuple(at)] = read
                else:
                    read = held[tuple(at)]
                below += [x[:5] for x in _covering(read, key)]
            found = below
        return [(x[2], x[3], x[4]) for x in found]


def _covering(places, key: str) -> Iterator:
    i = bisect.bisect_left(places, key, key=lambda x: x[1])
    while i < len(places) and places[i][0] <= key:
        yield places[i]
        i += 1


def sparse_directory(directory: DataFrame, out_dir: str, lines: int = 3000) -> SparseDirectory:
    """The directory as a search tree. Its top, of `lines` places at most, is all that comes to the driver."""
    order, levels = ["first", "last", "file", "offset"], 0
    while directory.count() > lines:
        directory = _blocks(directory.select("first", "last", "file", "offset", "length", "n").orderBy(*order), f"{out_dir}/level-{levels}", lines, 1)
        levels += 1
    return SparseDirectory(tuple((r.first, r.last, r.file, r.offset, r.length) for r in directory.orderBy(*order).collect()), levels)


def _matching(lines: list[list], key: str) -> list[list]:
    return lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]


def lookup(index: SparseDirectory, url: str) -> list[dict]:
    """Every capture of a URL, with its payload (None for a revisit): directory, block range, search, record range."""
    key, found = surt(url), []
    for place in index.places(key):
        for x in _matching(_block(*place), key):
            fields, _, payload = parsed(read_range(x[3], x[4], x[5]))
            found.append({"page_id": x[2], "url": x[1], "record_type": fields["WARC-Type"], "digest": x[6], "payload": payload if fields["WARC-Type"] == "response" else None})
    return found


def captures(index: SparseDirectory, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """All captures of the URLs' keys, each once. A task bisects the directory for its keys; the blocks it names are then dealt, so a hot key's blocks spread."""
    prepare(urls.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(x) for x in b.column(0).to_pylist()], pa.string())], ["key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            rows = [(key, *at) for key in b.column(0).to_pylist() for at in index.places(key, held)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lines = None, []
        for b in batches:
            rows = []
            for key, *place in zip(*(c.to_pylist() for c in b.columns)):
                if place != at:
                    at, lines = place, _block(*place)
                rows += _matching(lines, key)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CAPTURE)], _CAPTURE_NAMES)

    keys = urls.select(F.col(url_col).alias("url")).mapInArrow(keyed, "key string").distinct()
    named = keys.mapInArrow(search, "key string, file string, offset long, length long")
    return named.repartition("file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(read, _CAPTURE_SCHEMA)


def read_archives(entries: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of the record of each capture.

    Entries are dealt by archive and span, and a task reads neighbouring records as one range.
    A payload that doesn't have its digest raises.
    """
    prepare(entries.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def rows(uri: str, run: list[tuple[int, int]]) -> Iterator[tuple]:
        raw, base = read_range(uri, run[0][0], run[-1][0] + run[-1][1] - run[0][0]), run[0][0]
        for offset, length in run:
            fields, http, payload = parsed(raw[offset - base : offset - base + length])
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{uri} at {offset}: the payload doesn't have its digest")
            page, of = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
            yield (page and int(page), int(http["Content-Length"]), digest, kind, of and int(of), payload if kind == "response" else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uri, run, made = None, [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds[: len(names)])], names)

            for u, offset, length in [*zip(*(b.column(i).to_pylist() for i in range(3))), (None, 0, 0)]:
                if run and (u != uri or offset > run[-1][0] + run[-1][1] + GAP or offset + length > run[0][0] + SPAN):
                    made += [r[: len(names)] for r in rows(uri, run)]
                    run = []
                    if len(made) >= 2000 or payloads:
                        yield out()
                        made = []
                uri = u
                run.append((offset, length))
            if made:
                yield out()

    entries = entries.select("file", "offset", "length").withColumn("span", (F.col("offset") / SPAN).cast("long"))
    dealt = entries.repartition("file", "span").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages to new archives in the shared folder, indexes them, looks the key of every page up and reads the records it finds."""
    at = fresh_dir(spark, "warc")
    entries = write_archives(pages, f"{at}/archives")
    index = sparse_directory(build_index(entries, f"{at}/index"), f"{at}/directory")
    return read_archives(captures(index, pages))
