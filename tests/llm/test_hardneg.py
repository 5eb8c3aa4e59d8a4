"""Hard negatives against a plain version in Python's integers."""

from fractions import Fraction

import numpy as np
import pytest

from twinsieve.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, Score double"


def rows(n, dim, labels, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 : n // 2 + n // 10] = x[n // 2]  # one vector many times
    lab = rng.integers(0, labels, n)
    lab[: n // 3] = 0
    return [(i, v.tolist(), int(k), "r", 0.0) for i, (v, k) in enumerate(zip(x, lab))]


def odd(dim):
    bad = [(50_000, None, 1), (50_050, [], 1), (50_100, [None] * dim, 1), (50_150, [float("nan")] + [0.1] * (dim - 1), 1), (50_200, [float("inf")] * dim, 1), (None, [0.1] * dim, 1), (50_250, [0.1] * dim, None), (50_300, [0.5, 0.5], 1), (50_301, [0.5, 0.5], 1), (50_302, [0.3, 0.4], 2), (50_350, [0.0] * dim, 1)]
    return [(*b, "r", 0.0) for b in bad]


def plain(data, positives=5, negatives=3, every=50):
    usable = [(i, n, [int(Fraction(c) * 256 // 1) for c in v]) for i, v, n, *_ in data if i is not None and n is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, n, q in usable:
        if i % every:
            continue
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, w)))), j, m) for j, m, w in usable if j != i and len(w) == len(q))
        for p, j, m in [s for s in scored if s[2] == n][:positives]:
            fits = [(s, o) for s, o, m in scored if m != n and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(i, j, r + 1, o, -p, -s) for r, (s, o) in enumerate(fits)]
    return sorted(out)


def got(df, **more):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hardneg.mined(df, **more).collect())


@pytest.mark.parametrize(("labels", "spread", "size"), [(4, 1.0, 1 << 14), (4, 0.1, 150), (300, 0.4, 400)])
def test_mined_equal_a_plain_version(spark, monkeypatch, labels, spread, size):
    monkeypatch.setattr(hardneg, "ROWS", size)
    monkeypatch.setattr(hardneg, "CHUNK", 7)
    data = rows(900, 12, labels, labels) + odd(12)
    want = plain(data)
    assert len(want) > (100 if labels < 50 else 20)
    assert got(spark.createDataFrame(data, SCHEMA).repartition(3)) == want


def test_wide_vectors_and_long_sums(spark):
    rng = np.random.default_rng(4)
    data = [(int(i), (10.0 ** rng.uniform(-1, 12) * np.abs(rng.standard_normal(3))).tolist(), int(i) % 2, "", 0.0) for i in range(200)]
    data += [(1000, [1e300, 1.0, 1.0], 0, "", 0.0), (1001, [1e300, 1.0, 2.0], 1, "", 0.0), (1050, [2e5] * 3, 1, "", 0.0)]
    assert got(spark.createDataFrame(data, SCHEMA)) == plain(data)
    wide = [(50, [2e5] * 4096, 0, "", 0.0), (1, [1.9e5] * 4096, 0, "", 0.0), (2, [1.8e5] * 4096, 1, "", 0.0), (3, [1e5] * 4096, 1, "", 0.0)]
    assert got(spark.createDataFrame(wide, SCHEMA)) == plain(wide)


def test_repeated_ids_few_rows_and_none(spark):
    data = [(50, [1.0, 0.0], 0, "", 0.0), (50, [0.0, 1.0], 0, "", 0.0), (1, [1.0, 1.0], 0, "", 0.0), (1, [1.0, 1.0], 0, "", 0.0), (2, [0.9, 0.6], 1, "", 0.0), (3, [0.7, 0.7], 1, "", 0.0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert got(df) == plain(data) and len(got(df)) > 4
    assert hardneg.mined(df.limit(0)).count() == 0
    assert hardneg.mined(df.where("label = 0")).count() == 0


def test_balls_prune_and_bound():
    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((40, 16)), 100, axis=0) + 0.05 * rng.standard_normal((4000, 16))
    ids, labels = np.arange(4000), np.zeros(4000, "i8")
    block = hardneg.Block(hardneg.planted(ids, labels, x, 32))
    for (a, b, left, right), centre, radius in zip(block.nodes, block.centres, block.radii):
        assert np.sqrt(((block.q[a:b] - centre) ** 2).sum(axis=1)).max() <= radius * (1 + 1e-12) and (left < 0 or block.nodes[left][1] == block.nodes[right][0])
    q = hardneg.quantised(x[::80]).astype("i8")
    low = np.full((50, 1), -(1 << 63))
    s = hardneg.Search(ids[::80], labels[::80], q, low, np.full((50, 1), (1 << 63) - 1), 5, True)
    block.search(s)
    assert s.visits < 50 * 4000 * 0.3  # the others lie beneath the k-th
    exact = q @ hardneg.quantised(x).astype("i8").T
    exact[np.arange(50), ids[::80]] = -(1 << 62)
    want = [i for row in exact for i in np.lexsort((ids, -row))[:5]]
    assert s.best[1].tolist() == want
    t = hardneg.Search(ids[::80], labels[::80] + 1, q, np.full((50, 1), 10**9), np.full((50, 1), 2 * 10**9), 5, False)
    block.search(t)
    assert t.visits == 0  # no score is in the window
