import base64
import gzip
import hashlib

from twinsieve.llm import warc
from twinsieve.llm.common import fresh_dir, open_fs

SCHEMA = "page_id long, url string, html string, file string"


def brute(rows):
    first = {}
    for p, _, h, _ in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        lead = first.get(h or "")
        again = lead is not None and p != lead
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=repr)


ROWS = [
    (3, "http://B.example.org/x?q=1#f", "<p>same</p>", "a"), (1, "http://a.example.org/", "<p>same</p>", "b"), (1, "http://a.example.org/", "<p>same</p>", "b"), (7, None, None, None), (8, "no scheme\r\n", "", ""), (None, "http://n/", "<p>same</p>", "n"),
    (None, "http://n/", "<p>alone</p>", "n"), (9, "http://long.example/" + "y" * 3000, "é" * 200_000, "l"), *[(100 + i, f"http://h{i % 5}.example.net/{i}", f"<p>{i % 11}</p>", "z") for i in range(60)],
]


def test_round_trip(spark):
    got = warc.archive(spark, spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(ROWS)


def test_empty(spark):
    assert warc.archive(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_and_lookup(spark):
    at = fresh_dir(spark, "warc-test")
    entries = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(2), f"{at}/a")
    directory = warc.build_index(entries, f"{at}/i", lines=7)
    blocks = sorted((r.first, r.last) for r in directory.collect())
    assert all(a <= b for a, b in blocks) and all(x[1] <= y[0] for x, y in zip(blocks, blocks[1:]))
    for lines in (3, 3000):  # several levels, and one
        index = warc.sparse_directory(directory, f"{at}/d{lines}", lines)
        assert (index.levels > 0) == (lines == 3) and len(index.top) <= lines
        hit = warc.lookup(index, "http://b.EXAMPLE.org/x?q=1")
        assert [(h["page_id"], h["record_type"]) for h in hit] == [(3, "revisit")]
        assert [h["payload"] for h in warc.lookup(index, "http://a.example.org/")] == [b"<p>same</p>"] * 2
        assert warc.lookup(index, "http://absent.example/") == [] and warc.lookup(index, "zzz://zzz.zzz/") == []
        all_urls = spark.createDataFrame([(r[1],) for r in ROWS] * 2 + [("http://absent.example/",)], "url string")
        found = warc.captures(index, all_urls)
        assert sorted(r.key for r in found.collect()) == sorted(warc.surt(r[1]) for r in ROWS)
        assert warc.captures(index, all_urls.where("url = 'http://h1.example.net/1'")).count() == 1
        texts = {r.page_id: r.payload for r in warc.read_archives(found, payloads=True).where("record_type = 'response'").collect()}
        assert bytes(texts[9]) == ("é" * 200_000).encode()


def test_one_key_over_many_blocks(spark):
    rows = [(i, "http://hot.example/", f"<p>{i}</p>", "") for i in range(50)] + [(100, "http://z.example/", "z", "")]
    at = fresh_dir(spark, "warc-test")
    directory = warc.build_index(warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{at}/a"), f"{at}/i", lines=4)
    index = warc.sparse_directory(directory, f"{at}/d", 4)
    assert len(index.places(warc.surt(rows[0][1]))) >= 13 and len(warc.lookup(index, rows[0][1])) == 50
    got = warc.read_archives(warc.captures(index, spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_files_are_gzip_warc(spark):
    at = fresh_dir(spark, "warc-test")
    entries = warc.write_archives(spark.createDataFrame(ROWS[:5], SCHEMA).coalesce(1), f"{at}/a")
    fs, path = open_fs(entries.first().file)
    with fs.open_input_stream(path, compression=None) as f:
        raw = gzip.decompress(f.read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and raw.count(b"WARC/1.1\r\nWARC-Type: re") == 5
    assert b"no scheme%0D%0A" in raw


def test_surt():
    assert warc.surt("HTTP://user@WWW.Example.org:8080/A/b?x=1#z") == "org,example,www:8080)/A/b?x=1"
    assert warc.surt("http://example.org") == "org,example)/"
    assert warc.surt(None) == "" and warc.surt("abc") == "abc"
