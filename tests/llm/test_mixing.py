import hashlib
import math
from collections import Counter

import pytest

from twinsieve.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string"


def brute(rows, weights=None, seed=42):
    size = Counter()
    for _, x, s, _ in rows:
        size[s] += len(x or "")
    size = {s: n for s, n in size.items() if n}
    w = {s: math.sqrt(n) for s, n in size.items()} if weights is None else {s: weights.get(s, 0) for s in size}
    out = Counter()
    for i, _, s, _ in rows:
        if s not in size:
            continue
        rate = w[s] / sum(w.values()) * sum(size.values()) / size[s]
        draws = max(1, math.ceil(rate / 64))
        for j in range(1, draws + 1):
            key = f"{seed}:{'null' if i is None else i}:{j}"
            u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            k, p, c, lam = 0, math.exp(-rate / draws), math.exp(-rate / draws), rate / draws
            while c < u and k < 400:
                k += 1
                p *= lam / k
                c += p
            out[i, s] += k
    return +out


ROWS = [(i, "word " * (1 + i % 9), f"s{0 if i % 3 else i % 5}", "own") for i in range(300)] + [(None, "abc", None, None), (7, "dup", "s0", None), (7, "dup", "s0", None), (900, None, "empty", None), (901, "", "empty", None)]


def test_counts_equal_brute_force(spark):
    got = mixing.mixed(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    assert Counter((r.doc_id, r.source) for r in got) == brute(ROWS)
    keys = [r.shuffle_key for r in got]
    assert all(r.copy >= 1 for r in got) and len(set(keys)) >= len(keys) - 20


@pytest.mark.parametrize("weights", [{"s0": 1.0, "s4": 9.0}, {"s1": 5000.0, "s0": 0.5}])
def test_given_weights_and_large_rates(spark, weights):
    table = spark.createDataFrame([*weights.items(), ("absent", 3.0), ("s2", None)], "source string, weight double")
    total = 200_000.0 if "s4" in weights else None
    got = mixing.mixed(spark.createDataFrame(ROWS, SCHEMA), table, total=total).groupBy("source").count().collect()
    assert {r.source for r in got} <= set(weights)
    if total:
        sizes = Counter()
        for r in mixing.mixed(spark.createDataFrame(ROWS, SCHEMA), table, total=total).collect():
            sizes[r.source] += len(r.text)
        assert sizes["s4"] / sum(sizes.values()) == pytest.approx(0.9, abs=0.03) and sum(sizes.values()) == pytest.approx(total, rel=0.1)
    else:
        assert Counter({r.source: r["count"] for r in got}) == sum((Counter({s: n}) for (_, s), n in brute(ROWS, weights).items()), Counter())


def test_empty_and_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(empty).count() == 0
    plan = mixing.mixed(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_names_stay(spark):
    rows = [(i, "some words", f"s{i % 3}", 9, 8, 7, 6, 5, 4) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _n int, _source int, _cdf int, _DRAWS int, size int, rate int")
    got = mixing.mixed(df)
    assert got.columns == [*df.columns, "copy", "shuffle_key"]
    out = got.collect()
    assert out and {tuple(r)[3:9] for r in out} == {(9, 8, 7, 6, 5, 4)}
