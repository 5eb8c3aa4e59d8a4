"""Substring dedup and periodic runs against plain versions."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.llm import runs, substrings
from twinsieve.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_repeats(docs, window):
    """docs: (id, text) with distinct ids."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            if key in seen:
                gone[at : at + window] = [True] * window
            seen.add(key)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def texts(seed, n=120):
    rng = np.random.default_rng(seed)
    shared = [" ".join(f"w{x}" for x in rng.integers(0, 300, k)) for k in (8, 30, 45)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(0, 5)):
            kind = rng.integers(0, 4)
            parts.append(shared[rng.integers(0, 3)] if kind == 0 else " ".join(f"v{x}" for x in rng.integers(0, 3, rng.integers(1, 60))) if kind == 1 else " ".join(f"é{x}" for x in rng.integers(0, 5000, rng.integers(1, 90))))
        out.append("\t\x0b ".join(parts))
    return out


@pytest.mark.parametrize(("window", "chunk", "group"), [(20, 1 << 23, 1 << 19), (8, 2000, 64), (5, 700, 16)])
def test_substrings_equal_a_plain_version(spark, monkeypatch, window, chunk, group):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "OWNED", 4000)
    monkeypatch.setattr(substrings, "GROUP", group)
    data = list(enumerate(texts(3)))
    data += [(None, texts(3)[7]), (500, None), (501, ""), (502, " \n\x0c "), (503, texts(3)[7]), (504, "solo"), (-4, texts(3)[9]), (505, "a b c d")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, chunk string, size int").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substrings.without_repeats(df, window, outputs=True).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == plain_repeats(data, window)
    assert sum(r[2] for r in got) > 500


def test_spans_are_the_removed_words(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x b c d y b c d")], "doc_id long, text string")
    rows = {r.doc_id: r for r in substrings.without_repeats(df, 3, outputs=True).collect()}
    assert [tuple(s) for s in rows[2].spans] == [(1, 4), (5, 8)] and rows[2].kept == "x y" and rows[1].spans == []


def test_rows_that_repeat_an_id_and_empty_tables(spark):
    text = " ".join(map(str, range(25)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string").coalesce(1)
    assert sorted(r.n_removed for r in substrings.without_repeats(df).collect()) == [0, 25, 25]
    assert substrings.without_repeats(df.limit(0)).count() == 0 and runs.periodic_runs(df.limit(0)).count() == 0


def test_a_subtree_parts_where_words_differ():
    codes = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 3], [9, 9, 9], [1, 2, 3]], "u1")
    tree = substrings.Subtree(codes, np.array([5, 6, 5, 7, 8], "u8"))
    assert tree.parts.tolist() == [3, 2, 2, 0] and tree.later(3).tolist() == [2]


def test_packing_is_a_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 1 << 32, n))
        assert substrings.unpacked(substrings.packed(x)).tolist() == x.tolist()


def plain_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text, loops):
    w = WORD.findall(text or "")
    if loops and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in found)), sha(kept)


def row(r):
    return r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256


def key(r):
    return r[0] is not None, r[0] or 0, r[6]


@pytest.mark.parametrize("loops", [False, True])
def test_runs_equal_a_plain_version(spark, loops):
    rng = np.random.default_rng(5)
    data = [(i, " ".join(f"ü{x}" for x in np.resize(rng.integers(0, rng.integers(1, 6), rng.integers(1, 40)), rng.integers(0, 200)))) for i in range(200)]
    data += list(zip(range(1000, 1120), texts(8)))
    data += [(None, "a a a a a a a"), (None, None), (7, "a a a a a"), (7, "b b b b b b"), (300, ""), (301, "a b " * 3), (302, "a b " * 4), (303, "x\x0ba b " * 9)]
    df = spark.createDataFrame([(*d, "z") for d in data], "doc_id long, text string, START string").repartition(3)
    got = sorted(map(row, runs.periodic_runs(df, loops=loops).collect()), key=key)
    assert got == sorted((plain_row(i, t, loops) for i, t in data), key=key)


def test_runs_of_the_given_texts(spark, sf):
    docs = table(spark, sf, "documents")
    got = sorted(map(row, runs.periodic_runs(docs, loops=True).collect()))
    short = {r.doc_id: r.text for r in docs.where(F.length("text") < 6000).collect()}
    assert [r for r in got if r[0] in short] == sorted(plain_row(i, t, True) for i, t in short.items()) and len(got) == docs.count()
    assert sum(r[1] > 0 for r in got) >= 10


def test_long_texts_and_many_periods(monkeypatch):
    monkeypatch.setattr(runs, "CANDIDATES", 500)
    monkeypatch.setattr(runs, "TOGETHER", 300)
    rng = np.random.default_rng(2)
    w = np.concatenate([rng.integers(0, 50, 3000), np.resize(rng.integers(0, 50, 211), 900), rng.integers(0, 2, 800)])
    text, start, length, period = runs.runs_by_text(w, np.array([3000, len(w) - 3000]))
    for t, part in enumerate((w[:3000], w[3000:])):
        of = text == t
        assert list(zip(start[of].tolist(), length[of].tolist(), period[of].tolist())) == sorted(plain_runs(part.tolist()), key=lambda r: (r[0], r[2]))


def test_runs_outputs(spark):
    df = spark.createDataFrame([(1, "s a b a b a b a b t")], "doc_id long, text string")
    r = runs.periodic_runs(df, outputs=True).first()
    assert [tuple(x) for x in r.runs] == [(1, 8, 2)] and r.collapsed == "s a b t"
