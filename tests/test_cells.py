"""Cells: every two rows of a key meet, no task holds more than a part, and what leaves it is bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.operators import ann, cells, hashing, merge, similarity, tiles


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((330, 8))
    x[200:260] = x[0]  # copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").cache()


@pytest.mark.parametrize("upper", [True, False])
def test_a_row_of_a_cell_is_one_vector(vectors, upper):
    """A row once was two whole blocks, and a task's batch all pairs of blocks with a common one."""
    _, df = vectors
    rows = similarity._cells(df, 60, upper).toPandas()
    assert {len(v) for v in rows.v} == {8}
    parts = rows.q.max() + 1
    assert parts == 6 and rows[~rows.asks].groupby(["p", "q"]).size().max() < 100
    met = {}
    for (p, q), g in rows.groupby(["p", "q"]):
        held, asks = g[~g.asks].id.tolist(), g[g.asks].id.tolist()
        for a in held if p == q else asks:
            for b in held:
                met[a, b] = met.get((a, b), 0) + 1
    for a in range(330):
        for b in range(a):
            assert (met.get((a, b), 0), met.get((b, a), 0)) in ([(1, 0), (0, 1), (1, 1)] if upper else [(1, 1)])


def test_equal_scores_leave_a_block_k_times(vectors):
    """All rows that shared the k-th score once left each block."""
    a, c = similarity._best(np.ones((5, 400)), 3, np.arange(400)[::-1])
    assert a.tolist() == np.repeat(range(5), 3).tolist() and c.tolist() == [399, 398, 397] * 5


@pytest.mark.parametrize("block", [60, 1000])
def test_neighbours_and_mutual_pairs_as_by_brute_force(vectors, block):
    x, df = vectors
    s = np.round(x @ x.T, 9)
    near = {i: sorted((j for j in range(330) if j != i), key=lambda j: (-s[i, j], j))[:5] for i in range(330)}
    got = {}
    for r in similarity.neighbours(df, 5, block).collect():
        got.setdefault(r.i, {})[r.rank] = r.j
    assert {i: [g[n] for n in range(1, 6)] for i, g in got.items()} == near
    want = {(i, j) for i in near for j in near[i] if i < j and i in near[j]}
    assert {(r.i, r.j) for r in similarity.mutual_pairs(df, 5).collect()} == want


def test_a_key_of_any_size_is_dealt(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 450, 7).otherwise(8).cast("long").alias("key"), "id")
    parts = F.when(F.col("key") == 7, 5).otherwise(1)
    got = cells.shuffled(cells.dealt(rows, parts, False, "id"), 4).toPandas()
    assert got[~got.asks].groupby(["key", "p", "q"]).size().max() < 140 and len(got[got.key == 8]) == 50
    assert len(got[got.key == 7]) == 450 * (5 + 4)


@pytest.fixture(scope="module")
def bundles(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((150, 64))
    for k in range(50):  # a turned or mirrored copy with some signs changed
        x[100 + k] = x[k][hashing._permutation(hashing.TRANSFORMS[k % 8])]
        x[100 + k, rng.choice(64, k % 6, replace=False)] *= -1
    x[20:40] = x[0]
    b = hashing.bundle(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")).cache()
    held = {}
    for r in b.collect():
        held.setdefault(r.id, [0] * 8)[r.ord] = r.hash & ((1 << 64) - 1)
    return b, held


def least(held, i, j):
    return min(((held[i][0] ^ w).bit_count(), k) for k, w in enumerate(held[j]))


@pytest.mark.parametrize("block", [1 << 15, 40])
def test_orbits_by_cells(bundles, block, monkeypatch):
    """Half the cells do, whichever of two rows asks."""
    b, held = bundles
    monkeypatch.setattr(hashing, "BLOCK", block)
    want = {}
    for i in range(150):
        for j in range(i + 1, 150):
            d, k = least(held, i, j)
            if d <= 20:
                want[i, j] = (d, f"{hashing.TRANSFORMS[0]} vs {hashing.TRANSFORMS[k]}")
    rows = hashing.orbit_pairs(b, 20, hashing.Plan((), (), 0, 0.0)).collect()
    assert len(rows) == len(want) and {(r.i, r.j): (r.hamming, r.transform) for r in rows} == want


@pytest.mark.parametrize("block", [1 << 12, 10])
def test_bundles_of_a_prefix_meet_in_cells(bundles, block):
    """Once in all, though two bundles share several prefixes and a prefix has more rows than a cell."""
    b, held = bundles
    want = {}
    for i in range(150):
        for j in range(i + 1, 150):
            d, k = least(held, i, j)
            if d <= 22 and {w >> 56 for w in held[i]} & {w >> 56 for w in held[j]}:
                want[i, j] = (d, f"{hashing.TRANSFORMS[0]} vs {hashing.TRANSFORMS[k]}")
    rows = hashing.bundle_pairs(b, 2, 22, block).collect()
    assert len(rows) == len(want) > 200 and {(r.i, r.j): (r.hamming, r.transform) for r in rows} == want


@pytest.mark.parametrize("block", [1 << 13, 9])
def test_all_panels_of_a_modality_meet(spark, block):
    """Only pairs that a similarity join had found once met; an unknown page is no other page."""
    rows = [(i, None if i == 50 else i // 4, "confocal" if i % 3 else "gel") for i in range(90)]
    df = spark.createDataFrame(rows, "panel_id long, page long, modality string")
    want = sorted((i, j) for i, p, m in rows for j, q, o in rows if i < j and m == o == "confocal" and None not in (p, q) and p != q)
    assert sorted((r.pair_lo, r.pair_hi) for r in tiles.same_modality_panels(df, block=block).collect()) == want


def test_tiles_become_rows_after_the_joins(spark):
    df = spark.createDataFrame([(1, 300, 260), (2, 500, 256), (3, 60, 60), (4, 256, 256)], "panel_id long, w int, h int")
    n = {r.panel_id: r.tiles for r in tiles.tile_numbers(df).collect()}
    assert n == {r.panel_id: r["count"] for r in tiles.micro_tiles(df).groupBy("panel_id").count().collect()} and 3 not in n
    pairs = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "pair_lo long, pair_hi long")
    got = sorted(tuple(r) for r in tiles.products(pairs, tiles.tile_numbers(df)).collect())
    assert got == [(a, b, x, y) for a, b in ((1, 2), (2, 4)) for x in range(n[a]) for y in range(n[b])]


def test_no_lists_are_built_where_a_sample_tells_that_blocks_are_cheaper(spark, vectors, monkeypatch):
    """The whole table was put into lists first, to learn that."""
    _, df = vectors
    monkeypatch.setattr(ann, "build", lambda *a, **k: pytest.fail("built"))
    assert ann.adaptive_pairs(df, 0.1, worth=10).count() == similarity.pairs_at_least(df, 0.1).count()


def test_sources_meet_in_one_grouping(spark):
    s = spark.createDataFrame([(2, 1, 0.5), (1, 2, 0.7), (3, 4, 0.1)], "i long, j long, cosine double")
    h = spark.createDataFrame([(1, 2, 9), (5, 6, 3)], "i long, j long, hamming int")
    g = spark.createDataFrame([(6, 5, 7), (8, 7, 1)], "i long, j long, orb_inliers int")
    out = merge.merged(s, h, g)
    assert {(r.pair_lo, r.pair_hi, r.cosine, r.hamming, r.orb_inliers, r.source) for r in out.collect()} == {
        (1, 2, 0.7, 9, None, "CLIP+pHash"), (3, 4, 0.1, None, None, "CLIP"), (5, 6, None, 3, 7, "pHash+ORB"), (7, 8, None, None, 1, "ORB")
    }
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
