"""Orders over whole tables: running numbers, quantiles, intervals, suppression; each with one hot key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.config import Boxes
from twinsieve.operators import boxes as bx, ordering


def test_numbers_run_over_ranges_and_ties(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(v) if v else None) for i, v in enumerate(rng.choice([0, 0.5, 0.5, 0.5, 0.9], 3000))]
    df = spark.createDataFrame(data, "id long, c double").repartition(6)
    got = ordering.numbered(df, [F.col("c").desc_nulls_last(), F.col("id")], "no")
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.c) for r in sorted(got.collect(), key=lambda r: r.no)] == want
    assert sorted(r.no for r in got.collect()) == list(range(1, 3001)) and ordering.numbered(df.limit(0), ["id"], "no").count() == 0


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantiles_are_exact(spark, monkeypatch, q):
    monkeypatch.setattr(ordering, "LISTED", 40)
    monkeypatch.setattr(ordering, "BINS", 16)
    rng = np.random.default_rng(4)
    for x in (rng.standard_normal(2000), np.concatenate([np.full(700, 0.25), rng.random(1300) * 1e-12, [1e300, -1e300]]), np.full(50, 3.0), np.array([5.0]), np.array([-1.7e308, 1.7e308] + list(range(100)))):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        got = ordering.quantile(df, "x", q)
        at = q * (len(x) - 1)
        s = np.sort(x)
        a, b = s[int(at)], s[min(int(at) + 1, len(x) - 1)]
        assert got == float(a + (b - a) * (at - int(at)))
    assert ordering.quantile(df.limit(0), "x", q) is None


def plain_islands(rows, gap):
    out = {}
    for i, s, e in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        held = out.setdefault(i, [])
        if held and s <= held[-1][1] + gap:
            held[-1][1], held[-1][2] = max(held[-1][1], e), held[-1][2] + 1
        else:
            held.append([s, e, 1])
    return sorted((i, *x) for i, xs in out.items() for x in xs)


@pytest.mark.parametrize("spread", [2000, 40_000])
def test_intervals_of_one_hot_id(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(0, int(s), int(s + d)) for s, d in zip(rng.integers(0, spread, 2500), rng.integers(0, 9, 2500))] + [(0, 10, spread // 3)]
    rows += [(int(i), int(s), int(s) + 2) for i, s in zip(rng.integers(1, 5, 100), rng.integers(0, 300, 100))]
    df = spark.createDataFrame(rows + [(None, 1, 2), (9, None, 3)], "id long, start long, end long").repartition(5)
    got = sorted((r.id, r.start, r.end, r.parts) for r in ordering.merged_intervals(df, 5).collect())
    assert got == plain_islands(rows, 5) and len(got) > 3
    assert ordering.merged_intervals(df.limit(0)).count() == 0


def random_boxes(spark, n, pages, span, seed):
    rng = np.random.default_rng(seed)
    x, y, w, h = rng.integers(0, span, n), rng.integers(0, span, n), rng.integers(20, 200, n), rng.integers(20, 200, n)
    k = n // 5  # shifted copies, and equal ones
    x[:k], y[:k], w[:k], h[:k] = x[k : 2 * k] + rng.integers(0, 12, k), y[k : 2 * k], w[k : 2 * k], h[k : 2 * k]
    x[: k // 4], w[: k // 4] = x[k : k + k // 4], w[k : k + k // 4]
    page = rng.integers(0, pages, n)
    page[:k] = page[k : 2 * k]
    return spark.createDataFrame([(int(p), i, int(a), int(b), int(c), int(d)) for i, (p, a, b, c, d) in enumerate(zip(page, x, y, w, h))] + [(0, n + 1, 5, 5, 0, 10), (0, n + 2, 5, 5, 0, 10)], "page long, id long, x long, y long, w long, h long").cache()


@pytest.mark.parametrize("limit", [0.3, 0.5, 0.8])
def test_rounds_keep_what_the_fold_keeps(spark, limit):
    df, b = random_boxes(spark, 700, 3, 900, int(limit * 10)), Boxes(nms_iou=limit)
    want = sorted(map(tuple, bx.suppressed(df, b).collect()))
    assert sorted(map(tuple, bx.suppressed(df, b, small=0).collect())) == want and len(want) < 640
    mixed = bx.suppressed(df.withColumn("page", F.when(F.col("id") % 7 > 0, 0).otherwise(F.col("page"))), b, small=150)
    assert mixed.count() == bx.suppressed(df.withColumn("page", F.when(F.col("id") % 7 > 0, 0).otherwise(F.col("page"))), b).count()


def test_one_page_of_200_000_boxes(spark):
    grid = spark.range(100_000).select(F.lit(1).alias("page"), (F.col("id") * 2).alias("id"), (F.col("id") % 400 * 120).alias("x"), (F.col("id") / 400).cast("long").alias("k"))
    one = grid.select("page", "id", "x", (F.col("k") * 120).alias("y"), F.lit(100).cast("long").alias("w"), F.lit(100).cast("long").alias("h"))
    two = one.select("page", (F.col("id") + 1).alias("id"), F.col("x") + 3, "y", "w", (F.col("h") - 1).alias("h"))  # a little smaller, nearly on top
    got = bx.suppressed(one.unionByName(two.toDF(*one.columns)), Boxes(nms_iou=0.5))
    assert got.agg(F.count("*"), F.sum(F.col("id") % 2)).first() == (100_000, 0)
