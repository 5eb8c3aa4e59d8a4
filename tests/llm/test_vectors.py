from fractions import Fraction

import tracemalloc

import numpy as np

from twinsieve.llm import bitslice, blocks, rpforest

SCHEMA = "vec_id long, embedding array<float>, score int"


def rows(n=700, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:160] = x[100]  # one vector many times
    out = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(10000, None, 0), (10050, [], 0), (10100, [None] * dim, 0), (10150, [float("nan")] + [0.1] * (dim - 1), 0), (10200, [float("inf")] * dim, 0), (10250, [0.5, 0.5], 0), (None, [0.1] * dim, 0), (10300, [0.0] * dim, 0), (50, x[50].tolist(), 0), (10350, [1e9] * dim, 0)]
    return out + odd


def usable(data, zero=False):
    fine = [(i, np.array(v, "f8")) for i, v, _ in data if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    return [(i, v) for i, v in fine if zero or v.any()]


def brute(data, k, every, score):
    out = {}
    for i, q in data:
        if i % every == 0:
            found = sorted(((-score(q, v), j) for j, v in data if j != i and len(v) == len(q)))
            out[i] = [(j, -s) for s, j in found[:k]]
    return {i: v for i, v in out.items() if v}


def whole_score(a, b):
    """By Python's integers; beyond a long, the nearest long."""
    q = [[int(Fraction(float(x)) * 256 // 1) for x in v] for v in (a, b)]
    return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(*q))))


def test_wide_vectors_take_part(spark):
    rng = np.random.default_rng(9)
    data = [(0, [1e6, 0.0], 0), (50, [1.0, 2.0], 0), (3, [0.5, 0.5], 0), (4, [-1e6, 3.0], 0), (100, [3e38, -1e30], 0), (150, [1e12, 1e12], 0), (5, [1e18, 2.0], 0), (6, [2e18, 2.0], 0)]
    data += [(1000 + i, (10.0 ** rng.uniform(-2, 20) * rng.standard_normal(2)).astype("f4").tolist(), 0) for i in range(120)]
    got = {}
    for r in sorted(bitslice.top_k(spark.createDataFrame(data, SCHEMA).repartition(2), 5, 50).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    single = [(i, np.array(v, "f4").astype("f8")) for i, v, _ in data]
    assert got == brute(single, 5, 50, whole_score)


def test_sums_over_many_components(spark):
    dim = 4096
    data = [(50, [2e5] * dim, 0), (1, [1e5] * dim, 0), (2, [1.8e5] * dim, 0), (3, [-2e5] * dim, 0), (100, [3e3] * dim, 0), (4, [3.1e3] * dim, 0), (5, [1.3e5] + [0.0] * (dim - 1), 0)]
    got = {}
    for r in sorted(bitslice.top_k(spark.createDataFrame(data, SCHEMA), 5, 50).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute([(i, np.array(v, "f4").astype("f8")) for i, v, _ in data], 5, 50, whole_score)
    assert got[50][0] == (2, (1 << 63) - 1)


def test_bit_slices_are_exact(spark):
    data = rows()
    got = {}
    for r in sorted(bitslice.top_k(spark.createDataFrame(data, SCHEMA).repartition(3), 5, 50).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(usable(data, True), 5, 50, whole_score)
    assert {k: sorted(v, key=lambda x: (-x[1], x[0])) for k, v in want.items() if k != 50} == {k: v for k, v in got.items() if k != 50}
    assert len(got[50]) == 5 and 50 not in {j for j, _ in got[50]}


def test_any_drop_is_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 9)) / 256.0
    ids = rng.permutation(500) * 3
    block = bitslice.Block(9, bitslice.sliced_block(ids, x)[8:])
    q = np.floor(256 * x).astype("i8")
    for i in range(0, 500, 50):
        score = q @ q[i]
        want = sorted((-s, j) for s, j in zip(score.tolist(), ids.tolist()) if j != ids[i])[:7]
        for drop in (0, 2, 5, 20):
            got = block.best(q[i], 7, int(ids[i]), drop)
            assert [(-s, j) for j, s in zip(got[0].tolist(), got[1].tolist())] == want


def test_fewer_candidates_than_k(spark):
    data = [(0, [1.0, 0.0], 0), (50, [0.0, 1.0], 0), (3, [0.5, 0.5], 0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert bitslice.top_k(df).groupBy("query_id").count().collect() and {r["count"] for r in bitslice.top_k(df).groupBy("query_id").count().collect()} == {2}
    assert rpforest.neighbours(df.withColumn("vec_id", df.vec_id * 2)).count() == 4
    assert bitslice.top_k(df.limit(0)).count() == 0 and rpforest.neighbours(df.limit(0)).count() == 0


def test_forest_recall_scores_and_ties(spark):
    data = rows(3000, 32, 3)
    want = brute(usable(data), 20, 20, lambda a, b: float(a @ b))
    got = {}
    for r in sorted(rpforest.neighbours(spark.createDataFrame(data, SCHEMA).repartition(2)).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    own = dict(usable(data))
    recall = []
    for i, w in want.items():
        if i == 50:
            continue
        assert [x for x in got[i]] == sorted(got[i], key=lambda x: (-round(x[1], 12), x[0]))
        assert all(abs(own[j] @ own[i] - s) <= 1e-12 * max(1, abs(s)) for j, s in got[i]) and i not in {j for j, _ in got[i]}
        recall.append(len({j for j, _ in w} & {j for j, _ in got[i]}) / len(w))
    assert np.mean(recall) > 0.9
    hot = [j for j, _ in got[120]]
    assert hot == [j for j, _ in want[120]]


def test_scores_do_not_depend_on_the_number_of_queries():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 24))
    ids = np.arange(900)
    forest = rpforest.Forest(ids, x, 4, 64)
    alone = forest.search(ids[:1], x[:1], 20, 1.0)
    among = forest.search(ids[:100], x[:100], 20, 1.0)
    assert alone[2].tolist() == among[2][:20].tolist() and alone[1].tolist() == among[1][:20].tolist()
    assert among[2].tolist() == [float(sum((np.float64(a) * b for a, b in zip(x[i], x[j])), np.float64(0))) for i, j in zip(among[0], among[1])]


def test_the_share_is_measured(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "ROWS", 2000)
    rng = np.random.default_rng(11)
    for x, most in ((np.repeat(rng.standard_normal((80, 32)), 75, axis=0) + 0.2 * rng.standard_normal((6000, 32)), 0.2), (rng.standard_normal((4000, 32)), 1.0)):
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score int").repartition(2)
        index = rpforest.written(rpforest.blocked(df, "vec_id", "embedding", 2000, lambda i, v: rpforest.Forest(i, v, 8, 64).saved()), "shards", "none", 1)
        assert rpforest.measured_share(index, 20, 0.96) <= most
        forest = rpforest.Forest(np.arange(2000), x[:2000], 8, 64)
        at = np.arange(0, 2000, 97)
        before, own, q = forest.needed(at, forest.x[at], 20), forest.ids[forest.ends[at]], forest.x[at]
        for share in (0.1, 0.4):
            exact, some = (forest.search(own, q, 20, y) for y in (1.0, share))
            both = set(zip(exact[0].tolist(), exact[1].tolist())) & set(zip(some[0].tolist(), some[1].tolist()))
            assert len(both) == int((before < share * 2000).sum())
        found = {}
        for r in rpforest.neighbours(df).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        recall = []
        for i in found:
            s = x @ x[i]
            s[i] = -np.inf
            recall.append(len(set(np.argsort(-s)[:20]) & found[i]) / 20)
        assert len(found) == len(x) // 20 and np.mean(recall) >= 0.9


def test_a_forest_is_saved_and_loaded():
    rng = np.random.default_rng(3)
    for x in (rng.standard_normal((500, 8)), rng.standard_normal((500, 8)).astype("f4").astype("f8")):
        a = rpforest.Forest(np.arange(500), x, 3, 16)
        b = rpforest.Forest.loaded(a.saved())
        for share in (0.1, 1.0):
            assert all((p == q).all() for p, q in zip(a.search(np.arange(9), x[:9], 5, share), b.search(np.arange(9), x[:9], 5, share)))


def test_recall_on_clustered_vectors_at_a_small_share():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((60, 32)), 100, axis=0) + 0.3 * rng.standard_normal((6000, 32))
    ids = np.arange(6000)
    forest = rpforest.Forest(ids, x, 8, 64)
    who, found, _ = forest.search(ids[::100], x[::100], 20, 0.1)
    recall = []
    for i in ids[::100]:
        s = x @ x[i]
        s[i] = -np.inf
        recall.append(len(set(np.argsort(-s)[:20]) & set(found[who == i])) / 20)
    assert np.mean(recall) >= 0.9


def test_a_search_holds_little():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((16_000, 64))
    ids = np.arange(16_000)
    forest = rpforest.Forest(ids, x, 8, 64)
    tracemalloc.start()
    forest.search(ids[::125], x[::125], 20, 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20


def test_dropping_on_the_way_loses_nothing(monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.integers(-2, 3, (2000, 6)).astype("f8")  # many equal products and equal vectors
    x = x[x.any(axis=1)]
    ids = rng.permutation(len(x))
    ids[7] = ids[8] = 40  # ids that rows repeat, with other vectors too
    monkeypatch.setattr(rpforest, "HITS", 50)
    monkeypatch.setattr(rpforest, "PAIRS", 64)
    queries = np.flatnonzero(ids % 20 == 0)
    who, found, score = rpforest.Forest(ids, x, 4, 16).search(ids[queries], x[queries], 20, 1.0)
    at = 0
    for i in queries:
        s = x @ x[i]
        want = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:20]
        assert (who[at : at + 20] == ids[i]).all() and found[at : at + 20].tolist() == ids[want].tolist() and score[at : at + 20].tolist() == s[want].tolist()
        at += 20
    assert at == len(who)


def test_each_block_is_sent_once_and_wide_vectors_make_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "ROWS", 100)
    data = [r for r in rows(3000, 16, 5) if r[0] is not None]
    want = brute(usable(data), 20, 20, lambda a, b: float(a @ b))
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = rpforest.neighbours(df, share=1.0)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()  # which repeats a block for each chunk
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(got[i] == {j for j, _ in w} for i, w in want.items() if i != 50)
    wide = spark.createDataFrame([(i, [float(i + 1)] * 5000, 0) for i in range(40)], SCHEMA)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 400_000)
    assert {r.n for r in blocks.blocked(wide.coalesce(1), "vec_id", "embedding", 1 << 15, blocks.packed).selectExpr("length(data) div (8 + 8 * dim) n").collect()} == {10}
