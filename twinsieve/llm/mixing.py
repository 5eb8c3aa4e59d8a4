"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean rate of repetition, target size / own size. A document's uniform number
comes from a hash of the seed and its id; inverting the Poisson distribution at that number
gives its count of copies. Copies are dealt to partitions by a hash of their own and sorted by it: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import unused, written

#: Rate above which a count is the sum of several draws, so that exp(-rate) stays far from zero.
SPLIT = 64.0
#: Sources up to which their rates are broadcast (some 1 KB each); more are joined by shuffle.
SENT_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1): the first 52 bits of an md5 of the parts, joined by colons."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 2.0, total: float | None = None) -> DataFrame:
    """source, size, rate, draws, cdf: one row for each source that has any text.

    weights (source, weight) gives targets; they are scaled to one, a source without one, or
    with null or a negative one, gets none. Without weights a source's target is its size to the power 1 / temperature.
    Sizes are characters of whole texts, total (all of them) is the size of the mixture to expect. A null source is a source.
    """
    size = docs.groupBy(F.col("source").alias("_source")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size")).where("size > 0")
    size = written(size, "sizes")
    if weights is None:
        size = size.withColumn("w", F.pow("size", F.lit(1 / temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("_given")).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("w"))
        size = size.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left").select("_source", "size", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = size.agg(F.sum("w").alias("w"), F.sum("size").alias("size")).first()
    whole, all_size = float(sums.w or 0.0), float(total if total is not None else sums.size or 0.0)
    rate = F.col("w") / F.lit(whole or 1.0) * F.lit(all_size) / F.col("size")
    found = size.select("_source", "size", rate.alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT)).cast("int"))
    each = F.col("rate") / F.col("draws")
    steps = F.sequence(F.lit(1), (F.ceil(each) + F.ceil(12 * F.sqrt(each)) + 40).cast("int"))
    start = F.array(F.struct(F.exp(-each).alias("p"), F.exp(-each).alias("c")))

    def more(held: Column, k: Column) -> Column:
        last = F.element_at(held, -1)
        p = last["p"] * each / k
        return F.concat(held, F.array(F.struct(p.alias("p"), (last["c"] + p).alias("c"))))

    return written(found.withColumn("cdf", F.transform(F.aggregate(steps, start, more), lambda x: x["c"])), "rates")


def mixed(docs: DataFrame, weights: DataFrame | None = None, seed: int = 42, temperature: float = 2.0, total: float | None = None) -> DataFrame:
    """The rows of docs, each as often as its count says, in globally shuffled order, with copy (from 1) and shuffle_key.

    Rows that repeat a doc_id have its count each; a null doc_id counts as the text "null".
    A source of no text has no rate and no rows. Columns of docs called copy or shuffle_key are replaced; all others stay.
    An empty table gives no rows.
    """
    own = docs.drop("copy", "shuffle_key")
    table = rates(docs, weights, temperature, total)
    few = table.count() <= SENT_SOURCES
    of, draws, cdf, n = (unused([*own.columns, "copy", "shuffle_key"], x) for x in ("_source", "_draws", "_cdf", "_n"))
    table = table.select(F.col("_source").alias(of), F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    joined = own.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col(of)))
    seeded = F.lit(str(seed))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda k, j: k + F.size(F.filter(cdf, lambda c: c < uniform(seeded, name, j.cast("string"))))
    )
    copies = joined.withColumn(n, drawn).where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), name, F.col("copy").cast("string"))))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id").select(*[f"`{c}`" for c in own.columns], "copy", "shuffle_key")
