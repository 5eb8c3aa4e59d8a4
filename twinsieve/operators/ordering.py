"""Order over a whole table without one task that sees it all: running numbers, exact quantiles, merged intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import workspace

#: Bins of a histogram, and distinct values that may be listed.
BINS, LISTED = 2048, 10_000


def numbered(rows: DataFrame, order: list[Column | str], name: str, first: int = 1) -> DataFrame:
    """rows with a running number in this order, from `first`. Rows are dealt by ranges of the order and written; each range counts from the sizes of those before it."""
    spark = rows.sparkSession
    at = workspace(spark, "numbered")
    place = "_place"
    while place in rows.columns:
        place += "_"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()).write.parquet(at)
    held = spark.read.parquet(at)
    part = F.shiftright(F.col(place), 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row for each range
    return held.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, (F.col("_before") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + first).cast("long")).drop(place, "_part", "_before")


def quantile(rows: DataFrame, col: str, q: float) -> float | None:
    """The q-quantile of a numeric column, interpolated between neighbours, exactly. Nulls and NaN don't count; no values: none.

    Histograms of BINS bins narrow the range in which the wanted places lie; when few distinct values are left, those are listed. Each pass
    sends at most BINS or LISTED rows to the driver, whatever the table.
    """
    x = rows.select(F.col(col).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, lo, hi = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    at = q * (n - 1)
    k = math.floor(at)
    value = _placed(x, k, lo, hi)
    if at == k or k + 1 == n:
        return value
    upto, after = x.agg(F.count_if(F.col("x") <= value), F.min(F.when(F.col("x") > value, F.col("x")))).first()
    after = value if upto > k + 1 else after
    return float(value + (after - value) * (at - k))


def _placed(x: DataFrame, k: int, lo: float, hi: float) -> float:
    """The value at place k from 0 in the order of x, all of which lie from lo to hi."""
    below = 0  # values under lo
    while lo < hi:
        inside = x.where((F.col("x") >= lo) & (F.col("x") <= hi))
        values = sorted(inside.groupBy("x").count().limit(LISTED + 1).collect(), key=lambda r: r.x)
        if len(values) <= LISTED:
            for r in values:
                below += r["count"]
                if below > k:
                    return float(r.x)
        # halves, so that a range wider than a double holds has a width
        width = (hi / 2 - lo / 2) / BINS
        bin_ = F.least(F.floor((F.col("x") / 2 - lo / 2) / width), F.lit(BINS - 1)) if width > 0 else F.when(F.col("x") > lo, 1).otherwise(0)
        for r in sorted(inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda r: r.bin):
            if below + r.n > k:
                lo, hi = r.lo, r.hi
                break
            below += r.n
    return float(lo)


def merged_intervals(lanes: DataFrame, gap: int = 5, parts: int = 64) -> DataFrame:
    """id, start, end, parts: intervals (id, start, end; start <= end) of each id joined where the next starts at most `gap` after the end so far.

    Starts are dealt by ranges, whose cuts are quantiles, and each range keeps the furthest end of its own; the furthest ends of the ranges before it
    then tell every range how far the ground is covered when it begins. So an id that has all intervals is many tasks' work.
    Rows with a null take no part.
    """
    held = lanes.where("id is not null and start is not null and end is not null").groupBy("id", "start").agg(F.max("end").alias("end"), F.count("*").alias("parts"))
    cuts = held.agg(F.percentile_approx("start", [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    above = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array()
    dealt = held.withColumn("_r", F.size(F.filter(above, lambda c: c < F.col("start"))))
    before = Window.partitionBy("id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    covered = dealt.groupBy("id", "_r").agg(F.max("end").alias("_e")).select("id", "_r", F.max("_e").over(before).alias("_covered"))  # `parts` rows of an id at most
    inside = Window.partitionBy("id", "_r").orderBy("start")
    reach = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_covered"))
    marked = dealt.join(covered, ["id", "_r"]).withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)).withColumn("_own", F.sum("_new").over(inside))
    opened = marked.groupBy("id", "_r").agg(F.sum("_new").alias("_n")).select("id", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    island = marked.join(opened, ["id", "_r"]).withColumn("_island", F.col("_own") + F.col("_o"))
    return island.groupBy("id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("parts").alias("parts")).drop("_island")
