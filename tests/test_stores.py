"""The append-only log, the cache and run metrics."""

import glob

import pytest
from pyspark.sql import functions as F

from twinsieve.plans.metrics import Metrics
from twinsieve.sources import append_log, cache


def truth(spark, names, kind):
    return spark.createDataFrame([(kind, f"{n}_a", f"{n}_b") for n in names], "category string, path_a string, path_b string").repartition(3)


def test_appends_failures_and_repeats_give_each_row_once(spark, tmp_path):
    at = str(tmp_path / "log")
    append_log.append(truth(spark, "dbca", "true_positive"), at, "first", "pair_id", ["path_a"])

    @F.udf("string")
    def broken(name):
        if name == "g_a":
            raise ValueError("lost")
        return name

    half = truth(spark, "efgh", "hard_negative").withColumn("path_a", broken("path_a"))
    with pytest.raises(Exception, match="lost"):
        append_log.append(half, at, "second", "pair_id")
    append_log.append(truth(spark, "efgh", "hard_negative"), at, "second", "pair_id", ["path_a"])
    append_log.append(truth(spark, "efgh", "hard_negative"), at, "second", "pair_id", ["path_a"])  # a repeat
    append_log.append(truth(spark, "", "none"), at, "empty", "pair_id")
    append_log.append(truth(spark, "i", "true_positive"), at, None, "pair_id")
    rows = sorted(tuple(r) for r in append_log.read(spark, at).collect())
    assert [(r[0], r[2]) for r in rows] == [(i, f"{n}_a") for i, n in enumerate("abcdefghi")]
    assert sorted(r.pair_id for r in append_log.read(spark, at, last=3).collect()) == [6, 7, 8]
    assert append_log.read(spark, at).where("category = 'hard_negative'").count() == 4
    append_log.swept(at)
    assert append_log.read(spark, at).count() == 9 and append_log.swept(at) == 0
    with pytest.raises(Exception, match="columns"):
        append_log.append(spark.range(3), at)
    with pytest.raises(Exception, match="only appended"):
        truth(spark, "z", "x").write.format("append_log").mode("overwrite").option("path", at).save()


def test_a_fingerprint_has_no_order(spark):
    files = spark.createDataFrame([(f"f{i}", i, i * 7) for i in range(50)], "path string, modificationTime long, length long")
    one = cache.fingerprint(files.repartition(7)).first()[0]
    assert one == cache.fingerprint(files.orderBy(F.desc("path"))).first()[0]
    assert one != cache.fingerprint(files.where("length > 0")).first()[0] and one != cache.fingerprint(files.withColumn("length", F.col("length") + 1)).first()[0]
    assert one != cache.fingerprint(files.unionByName(files.limit(1))).first()[0]
    assert "collect_list" not in cache.fingerprint(files)._jdf.queryExecution().toString()
    assert cache.fingerprint(files.limit(0)).count() == 1


def test_keys_and_paths():
    a = cache.key_of("vectors", "f1", model="m", dim=64)
    assert a == cache.key_of("vectors", "f1", dim=64, model="m") != cache.key_of("vectors", "f2", model="m", dim=64)
    assert cache.paths("/c/", a)["hashes"] == f"/c/hashes/key={a}"


def test_a_subset_reads_few_files_and_missing_keys_are_computed_once(spark, tmp_path):
    at, asked = str(tmp_path / "cache"), []
    keys = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("key"))

    def compute(rows):
        asked.append(rows.count())
        return rows.select("key", F.length("key").alias("n"))

    first = cache.completed(spark, at, keys.where("key < 'p5'"), compute, buckets=64)
    n = first.count()
    assert asked == [n] and len(glob.glob(f"{at}/bucket=*")) == 64
    few = keys.where("key in ('p1', 'p10', 'p1000')")
    got = cache.subset(spark, at, few, buckets=64)
    assert sorted(r.key for r in got.collect()) == ["p1", "p10", "p1000"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert got.select(F.input_file_name()).distinct().count() <= 3
    every = cache.completed(spark, at, keys, compute, buckets=64)
    assert every.count() == 2000 and asked[1:] == [2000 - n]
    cache.completed(spark, at, keys, compute, buckets=64)
    assert len(asked) == 2
    assert cache.subset(spark, at, keys.limit(0), buckets=64).count() == 0


def test_metrics_are_taken_by_the_run_itself(spark):
    m = Metrics(spark, slow=0.0)
    a = m.run("load", spark.range(1000))
    b = m.run("filter", a.where("id % 4 = 0"), ("load",), most=F.max("id"))
    c = m.run("join", b.join(a, "id"), ("filter", "load"))
    rows = {r.stage: r for r in m.table().collect()}
    assert (rows["load"].n_out, rows["filter"].n_in, rows["filter"].n_out, rows["join"].n_in) == (a.count(), a.count(), b.count(), 1250)
    assert rows["filter"].reduction_pct == 75.0 and rows["join"].n_out == c.count() == 250 and '"most": 996' in rows["filter"].more
    assert rows["filter"].throughput == pytest.approx(250 / rows["filter"].seconds) and sum(r.pct_of_total for r in rows.values()) == pytest.approx(100)
    assert m.bottlenecks().count() == 3 and Metrics(spark, slow=1e9).table().count() == 0
