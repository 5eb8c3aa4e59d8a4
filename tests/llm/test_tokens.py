import cProfile
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from twinsieve.llm import bpe, token_store as ts
from twinsieve.llm.chunks import hashed
from twinsieve.llm.common import fresh_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "a", "Hello  WORLD\n\tfoo", "it's we're I'LL 'd x'S", "é é ́x ΑΣ ΌΣ. İstanbul ŉ", "<|endoftext|>abc<|startoftext|> <|endoftext|><|endoftext|>x", "日本語テスト。。。 123456 ½ ⅷ 😀😀", "a b c　d\x1cz\x85y", "x" * 3000, "ab" * 2001 + "!" * 300,
    "ﬁ Å Å ẛ̣", "don't'll've", "mixed中文english123", "a\rb\x0bc\x0cd", "Äb, äb. É; ß! ªº µ", "q" * 600 + " " + "q" * 600,
]


def texts():
    rng = random.Random(3)
    alphabet = "abc defghi 'stlvrdé́Σ中1 2!?\n 힣가.,"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(800)]


def split(flat, sizes):
    ends = np.cumsum(sizes)
    return [flat[i:j].tolist() for i, j in zip(np.r_[0, ends], ends)]


def test_segment_tree_equals_library():
    xs, own = texts(), bpe.SegmentTreeBpe(PATH)
    for _ in range(2):  # the second time from memory
        for x, ids in zip(xs, split(*own.encode(pa.array(xs)))):
            want = LIBRARY.encode(x, add_special_tokens=False).ids
            assert ids == want
            assert own.decode(np.array(ids, "<u4").tobytes()).decode() == LIBRARY.decode(want, skip_special_tokens=False)


def test_library_chunks_equal_whole_texts():
    xs = texts()
    assert split(*ts._table(PATH).encode(pa.array(xs))) == [LIBRARY.encode(x, add_special_tokens=False).ids for x in xs]


@pytest.mark.parametrize("room", [1, 40, 400])
def test_ids_stay_right_when_memory_is_full(room, monkeypatch):
    monkeypatch.setattr(bpe, "ROOM", room)
    xs, own = texts(), bpe.SegmentTreeBpe(PATH)
    want = [LIBRARY.encode(x, add_special_tokens=False).ids for x in xs]
    for k in (7, 31, len(xs)):
        for i in range(0, len(xs), k):
            assert split(*own.encode(pa.array(xs[i : i + k]))) == want[i : i + k]


def test_what_was_met_again_stays():
    own = bpe.SegmentTreeBpe(PATH)
    own.encode(pa.array(["red green blue", "red"]))
    own.encode(pa.array(["red blue"]))
    own.known.make_room(1)
    assert len(own.known.keys) == 2
    assert split(*own.encode(pa.array(["blue green red"]))) == [LIBRARY.encode("blue green red", add_special_tokens=False).ids]


def colliding(a, b):
    """Two strings of 128 letters with one polynomial hash modulo 2**64, whatever its base."""
    x = [bin(i).count("1") % 2 for i in range(128)]
    return "".join(b if i else a for i in x), "".join(a if i else b for i in x)


def test_chunks_with_one_hash_keep_their_own_ids():
    pairs = [colliding(*p) for p in ("aR", "bN", "WH")]
    one, two = ("".join(p[i] for p in pairs) for i in (0, 1))
    raw = np.frombuffer((one + two).encode(), "u1")
    keys = hashed(raw, np.array([0, len(one)]), np.array([len(one), len(raw)]))
    assert keys[0] == keys[1] and one != two
    want = [LIBRARY.encode(x, add_special_tokens=False).ids for x in (one, two)]
    lower = [LIBRARY.encode(x, add_special_tokens=False).ids for x in (one.lower(), two.lower())]
    assert want[0] != want[1]
    for make in (lambda: bpe.SegmentTreeBpe(PATH).encode, lambda: (ts._held.clear(), ts._table(PATH).encode)[1]):
        together, apart = make(), make()
        assert split(*together(pa.array([one, two, f"{two} x {one}"]))) == [*want, want[1] + LIBRARY.encode("x", add_special_tokens=False).ids + want[0]]
        for x, ids in zip([one, two, two, one], [want[0], want[1], want[1], want[0]]):  # one batch after another
            assert split(*apart(pa.array([x]))) == [ids]
        assert split(*apart(pa.array([one.lower(), two.lower()]))) == lower


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(x):
    assert split(*bpe.loaded(PATH).encode(pa.array([x, None, x]))) == [LIBRARY.encode(y, add_special_tokens=False).ids for y in (x, "", x)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(9, 16))
def test_lengths_are_optimal_prefix_codes(counts, limit):
    lengths = ts.code_lengths(np.array(counts), limit).astype(int)
    used = np.flatnonzero(counts)
    assert (lengths[np.array(counts) == 0] == 0).all() and lengths.max(initial=0) <= limit
    if len(used) > 1:
        assert sum(2.0 ** -lengths[used]) == pytest.approx(1.0)
        order = sorted(used, key=lambda i: counts[i])
        assert all(lengths[a] >= lengths[b] or counts[a] == counts[b] for a, b in zip(order, order[1:]))


def test_limit_that_binds():
    counts = np.array([2**i for i in range(20)])
    assert ts.code_lengths(counts, 6).max() == 6 and ts.code_lengths(counts).max() == 16
    with pytest.raises(ValueError):
        ts.code_lengths(np.ones(100, "i8"), 5)


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    counts = np.zeros(1000, "i8")
    counts[:900] = rng.zipf(1.3, 900).clip(max=10**9)
    lengths = ts.code_lengths(counts, 12)
    sizes = np.array([0, 5, 1, 0, 50_000, 64, 63, 65, 128, 16384, 16385, 0, 3])
    ids = rng.integers(0, 900, sizes.sum()).astype("<u2")
    payload, size, bits, lanes = ts.pack(ids, sizes, ts.canonical(lengths), lengths)
    assert size.sum() == len(payload) and lanes.sum() == len(bits)
    assert (ts.unpack(payload, sizes, bits, ts.decoding_table(lengths)) == ids).all()


DOCS = [(5, "b c"), (3, "Hello there"), (3, "Hello there"), (None, "no id"), (9, None), (8, ""), (1, "long text " * 9000), *[(20 + i, f"doc {i} of words") for i in range(40)]]


@pytest.mark.parametrize("end", [1, None, 49500])
def test_store(spark, end):
    docs = spark.createDataFrame([(i, x, 0) for i, x in DOCS], "doc_id long, text string, n int").repartition(3)
    files = ts.write_store(docs, PATH, fresh_dir(spark, "t"), end)
    got = sorted(ts.read_store(spark, files).collect(), key=lambda r: r.start if r.n_tokens else (r.start, 0)[0])
    want = {}
    for i, x in DOCS:
        ids = LIBRARY.encode(x or "", add_special_tokens=False).ids + ([] if end is None else [end])
        want.setdefault(i, []).append(np.array(ids, "<u4").tobytes())
    assert len(got) == len(DOCS) and sum(r.n_tokens for r in got) == sum(len(b) // 4 for v in want.values() for b in v)
    at, last = 0, None
    for r in sorted(got, key=lambda r: (r.start, r.n_tokens > 0)):
        assert bytes(r.ids) in want[r.doc_id] and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        assert r.start == at
        at += r.n_tokens
    if end is not None:
        order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order)
    del last


def test_store_random_access_and_many_files(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 5)) for i in range(50)], "doc_id long, text string")
    files = ts.write_store(docs, PATH, fresh_dir(spark, "t"), 1)
    f = ts.StoredFile(files[0]["file"])
    i = int(f.doc_ids[2])
    assert f.read(2, 3).tolist() == LIBRARY.encode(f"text number {i} " * (i % 5), add_special_tokens=False).ids + [1]


def test_store_empty(spark):
    files = ts.write_store(spark.createDataFrame([], "doc_id long, text string"), PATH, fresh_dir(spark, "t"), 1)
    assert files == [] and ts.read_store(spark, files).count() == 0


def test_round_trip_query(spark):
    import hashlib

    docs = spark.createDataFrame([(i, x, 1) for i, x in DOCS], "doc_id long, text string, n_tokens int")
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == len(DOCS)
    by = dict(DOCS)
    for r in got:
        ids = LIBRARY.encode(by[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_new_chunks_equal_the_library_one_by_one():
    rng = np.random.default_rng(5)
    signs = list("abzABZ") + list("àéÀÉÞþßÿ×÷ªµº") + list(".,;:!?") + list("ŁłİıΣσя0_-'\t") + ["</w>", "€"]
    words = [*signs, "ab", "Ab.", "ab.", "AB,", "ab..", "É,", "é,", "×,", "ab×", "a" * 700, "A" * 700 + ".", "Straße!", "ÀÞ", "ŸÿŸ"]
    words += ["".join(rng.choice(signs, rng.integers(1, 6))) for _ in range(4000)]
    words = list(dict.fromkeys(words))
    ts._held.clear()
    table = ts._table(PATH)
    for part in (words[:7], words[:500], words):  # some are known by then
        ids, sizes = table.encode(pa.array(part))
        assert split(ids, sizes) == [LIBRARY.encode(w, add_special_tokens=False).ids for w in part]
    raw = np.frombuffer("".join(map(chr, range(1, 256))).encode(), "u1")
    low = ts.folded(raw)[1].tobytes().decode()
    assert low == "".join(map(chr, range(1, 256))).lower()


def test_new_chunks_cost_few_calls():
    """Words that a worker hasn't met are looked at together: no Python call for each of them but what the library's ids need."""
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) + mark for i in range(20_000) for mark in ("", ".")]
    ts._held.clear()
    table = ts._table(PATH)
    calls = cProfile.Profile()
    calls.runcall(table.encode, pa.array([" ".join(words)]))
    assert sum(x.callcount for x in calls.getstats()) < len(words)
