"""Inverted lists with bounds: exact where they say so, few comparisons where vectors cluster."""

import numpy as np
import pytest

from twinsieve.operators import ann, similarity


def clustered(spark, n=4000, centres=60, dim=24, spread=0.15, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((centres, dim))[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dim))
    x[: n // 3] = x[0] + 0.02 * rng.standard_normal((n // 3, dim))  # a hot place
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, None)], "id long, vec array<double>").repartition(4)


@pytest.fixture(scope="module")
def held(spark):
    x, df = clustered(spark)
    return x, df.cache(), ann.build(df, cells=60)


def test_every_row_is_in_a_list_and_hot_lists_have_parts(held, spark, monkeypatch):
    x, df, index = held
    assert index.count.sum() == len(x)
    monkeypatch.setattr(ann, "LIST", 200)
    small = ann.build(df, cells=60)
    sizes = [r.n for r in small.lists().select("n").collect()]
    assert small.parts.max() >= 6 and max(sizes) < 400 and sum(sizes) == len(x)
    assert small.pairs(0.97).count() == index.pairs(0.97).count()


def test_bounds_lose_nothing_and_reopened_indexes_answer_alike(held, spark):
    x, df, index = held
    s = x @ x.T
    np.fill_diagonal(s, -2)
    queries = df.where("id % 100 = 0")
    for t in (0.9, 0.5):
        got = {(r.query_id, r.id) for r in ann.opened(spark, index.at).search(queries, t).collect()}
        assert got == {(i, j) for i in range(0, len(x), 100) for j in np.flatnonzero(s[i] >= t)}


def test_few_probes_find_most(held):
    x, df, index = held
    s = x @ x.T
    np.fill_diagonal(s, -2)
    got = index.search(df.where("id % 100 = 0"), -1.0, k=20, probes=4).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.id)
    recall = [len(set(np.argsort(-s[i])[:20]) & found[i]) / 20 for i in found]
    assert len(found) == 40 and np.mean(recall) >= 0.9


def test_the_self_join_compares_a_tenth(held, spark):
    x, df, index = held
    tally = spark.sparkContext.accumulator(0)
    got = {(r.i, r.j) for r in index.pairs(0.97, df, tally).collect()}
    want = {(r.i, r.j) for r in similarity.pairs_at_least(df, 0.97).collect()}
    hot = len(x) // 3  # the rows of the hot place are all pairs of the result
    assert got == want and tally.value - hot * hot <= len(x) * len(x) / 2 / 10
    assert index.pairs(0.97).count() == len(want)


def test_the_dispatch_takes_both_ways(held, spark):
    x, df, _ = held
    tally = spark.sparkContext.accumulator(0)
    near = ann.adaptive_pairs(df, 0.97, worth=1000, tally=tally)
    assert near.count() == similarity.pairs_at_least(df, 0.97).count() and tally.value > 0
    tally = spark.sparkContext.accumulator(0)
    assert ann.adaptive_pairs(df, 0.0, worth=1000, tally=tally).count() > 0 and tally.value == 0
    assert ann.adaptive_pairs(df.where("id < 300"), 0.97).count() == similarity.pairs_at_least(df.where("id < 300"), 0.97).count()


def test_no_rows_and_equal_rows(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert ann.build(none).pairs(0.5).count() == 0 and ann.build(none).search(none, 0.5).count() == 0
    same = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(5)], "id long, vec array<double>")
    assert ann.build(same).pairs(1.0 - 1e-9).count() == 10
