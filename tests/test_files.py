"""Readers, writers, whole runs and streams."""

import glob
import json
import math
from urllib.parse import urlparse

import duckdb
from pyspark.sql import functions as F

from twinsieve import cli
from twinsieve.config import Config
from twinsieve.operators import hashing, merge, similarity
from twinsieve.plans.engine import Engine
from twinsieve.queries import ORACLE, QUERIES
from twinsieve.session import workspace
from twinsieve.sources import append_log, cache, files
from twinsieve.streaming import incremental


def panels(spark):
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    base = unit([math.sin(i * i) + 0.01 for i in range(64)])
    near = unit([x + 0.001 * ((i * 7) % 5 - 2) for i, x in enumerate(base)])
    far = unit([math.cos(3 * i) for i in range(64)])
    rows = [(1, 1, 1, "page_1_panel01.png", "confocal", base), (2, 5, 1, "page_5_panel01.png", "confocal", near), (3, 2, 1, "page_2_panel01.png", "gel", far)]
    return spark.createDataFrame(rows, "panel_id long, page long, panel_num long, path string, modality string, vec array<double>")


def test_engine_and_report(spark, tmp_path):
    result = Engine(spark).run(panels(spark), annotate=lambda p: p.withColumns({"ssim": F.lit(0.97), "patch_min": F.lit(0.9), "patch_topk": F.lit(0.95)}))
    rows = result.pairs.collect()
    assert [(r.pair_lo, r.pair_hi, r.tier) for r in rows] == [(1, 2, "A")] and rows[0].source.startswith("CLIP")
    result.save(f"{tmp_path}/r")
    back = files.read_tsv(spark, f"{tmp_path}/r").first()
    assert (back.Image_A, back.Tier, back.Source) == ("page_1_panel01.png", "A", rows[0].source)
    assert files.from_report(files.read_tsv(spark, f"{tmp_path}/r")).first().tier == "A"


def test_no_semantic_pair_is_cut(spark):
    """500 equal vectors are 124,750 pairs; a run once kept the best 120,000."""
    unit = F.array(F.lit(1.0), *[F.lit(0.0)] * 63)
    p = spark.range(500).select(F.col("id").alias("panel_id"), F.col("id").alias("page"), F.lit(1).alias("panel_num"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit("tem").alias("modality"), unit.alias("vec"))
    assert Engine(spark).semantic(p).count() == 124_750
    capped = Config.from_environment({"TWINSIEVE_PAIRING_MAX_PAIRS": "7"})
    assert Engine(spark, capped).semantic(p).count() == 7


def near_copies(spark):
    """240 unit vectors in ten groups."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.sin(k * k + F.floor(F.col("id") / 24)) + 0.12 * F.sin(F.col("id") * 31 + k * 17))
    unit = F.transform("x", lambda v: v / F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, u: s + u * u))).cast("array<float>")
    return spark.range(240).withColumn("x", parts).select(F.col("id").alias("vec_id"), unit.alias("embedding"), (F.col("id") % 7).cast("int").alias("label"))


def test_engine_run_as_its_sql_on_near_copies(spark, tmp_path):
    """The given vectors have no near copies, for which a run once had further paths and a tier B that its SQL doesn't have."""
    near_copies(spark).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["engine_run"](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(ORACLE["engine_run"])
    text = lambda rows: sorted(tuple(repr(x) for x in r) for r in rows)
    rows = want.select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall()
    assert text(tuple(r) for r in got.collect()) == text(rows)
    assert any(r[3] in (4, 5) and r[2] >= 0.965 and r[6] is None for r in rows)


def test_pairs_meet_as_in_the_merge_of_sources(spark):
    """A run doesn't group its sources' rows, as each has a pair once; what comes out is the same."""
    vectors = near_copies(spark).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    semantic = similarity.pairs_at_least(vectors, 0.97).withColumn("ssim", (F.col("i") + F.col("j")) % 50 / 50.0).persist()
    hashes = hashing.orbit_pairs(hashing.bundle(vectors), 4).persist()
    near = hashing.with_distance(semantic, hashing.bundle(vectors), 4)
    both = near.where("hamming is not null").select("i", "j", F.lit(True).alias("met"))
    found, checked = merge.apart(near, hashes.join(both, ["i", "j"], "left")), merge.worth(0.975, 3)
    there = found.where(checked).where("(pair_lo + pair_hi) % 3 > 0").select(F.col("pair_lo").alias("i"), F.col("pair_hi").alias("j"), ((F.col("pair_lo") * 17 + F.col("pair_hi")) % 60).cast("int").alias("orb_inliers"), F.lit(0.5).alias("inlier_ratio"))
    geometry = there.union(there.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("orb_inliers") + 1, "inlier_ratio")).persist()
    want, got = merge.merged(semantic, hashes, geometry), merge.with_geometry(found, checked, geometry)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = [sorted(map(repr, df.select(*cols).collect())) for df in (got, want)]
    assert rows[0] == rows[1] and {r.source for r in want.select("source").distinct().collect()} >= {"CLIP", "pHash", "CLIP+pHash", "CLIP+ORB", "CLIP+pHash+ORB"}


def test_a_run_keeps_no_stage_that_nothing_reads(spark):
    p = panels(spark)
    geometry = lambda w: w.select(F.col("pair_lo").alias("i"), F.col("pair_hi").alias("j"), F.lit(40).alias("orb_inliers"))
    root = urlparse(workspace(spark, "x").rpartition("/")[0]).path
    before = set(glob.glob(f"{root}/stages-*"))
    result = Engine(spark).run(p, geometry=geometry)
    assert [s["stage"] for s in result.metrics.stages] == ["panels", "semantic", "hashes", "triggers", "geometry", "merge", "tiers"]
    assert len(set(glob.glob(f"{root}/stages-*")) - before) == 2 and result.pairs.count() == 1


def test_empty_report_keeps_its_header(spark, tmp_path):
    result = Engine(spark).run(panels(spark).limit(0))
    assert result.pairs.count() == 0
    result.save(f"{tmp_path}/e")
    assert files.read_tsv(spark, f"{tmp_path}/e").count() == 0


def test_tsv_with_blanks_and_other_columns(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("Path_B\tPath_A\tSSIM\tHamming_Distance\textra\nb\ta\t\tx\t1\nd\tc\t0.5\t4\t2\n")
    got = [(r.Path_A, r.SSIM, r.Hamming_Distance, r.Tier) for r in files.read_tsv(spark, f"{tmp_path}/x.tsv").collect()]
    assert got == [("a", None, None, None), ("c", 0.5, 4, None)]


def test_pdfs_pairs_truth_cache(spark, tmp_path):
    for folder in ("duplicates", "non_duplicates"):
        (tmp_path / "i" / folder).mkdir(parents=True)
        for n in range(3):
            (tmp_path / "i" / folder / f"{n}.png").write_bytes(b"x")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"no")
    assert files.pdfs(spark, f"{tmp_path}/*.pdf").count() == 1
    found = files.images(spark, f"{tmp_path}/i", "*.png")
    assert sorted((r.path_a[-5:], r.path_b[-5:], r.should_detect) for r in files.labelled_pairs(found).collect()) == [("0.png", "1.png", False), ("0.png", "1.png", True)]
    key = cache.fingerprint(found).first().fingerprint
    assert key == cache.fingerprint(found.repartition(3)).first().fingerprint
    made = []
    for _ in range(2):
        assert files.cached(spark, lambda: made.append(1) or spark.range(3), f"{tmp_path}/c", key).count() == 3
    assert len(made) == 1
    (tmp_path / "t.json").write_text(json.dumps({"total_pairs": 1, "pairs": [{"pair_id": 4, "category": "x", "path_a": "a", "path_b": "b", "label": "l", "should_detect": True}]}))
    r = files.read_truth(spark, f"{tmp_path}/t.json").first()
    assert (r.pair_id, r.should_detect, r.modality) == (4, True, None)


def test_truth_is_appended_and_told(spark, tmp_path):
    at = f"{tmp_path}/truth"
    rows = spark.createDataFrame([("true_positive", "b", "c", True), ("true_positive", "a", "c", True)], "category string, path_a string, path_b string, should_detect boolean")
    files.append_truth(rows, at, "one")
    files.append_truth(rows.withColumns({"category": F.lit("hard_negative"), "should_detect": F.lit(False)}), at, "two")
    files.append_truth(rows, at, "one")
    held = append_log.read(spark, at)
    assert [(r.pair_id, r.category[:4], r.path_a) for r in sorted(held.collect())] == [(0, "true", "a"), (1, "true", "b"), (2, "hard", "a"), (3, "hard", "b")]
    assert tuple(files.truth_summary(held).first()) == (4, 2, 2) and held.columns[0] == "pair_id" and "transform_type" in held.columns
    assert files.missing_columns(rows, ["path_a", "label"]) == ["label"] and files.missing_columns(files.report(Engine(spark).run(panels(spark)).pairs)) == []


def test_results_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "l", True, False, 0.5, None, 3, None)], files.RESULTS)
    files.write_csv(rows, f"{tmp_path}/r")
    assert files.read_csv(spark, f"{tmp_path}/r").collect() == rows.collect()


def test_a_measured_run(spark, tmp_path):
    p = panels(spark).withColumn("modality", F.lit("confocal"))
    asked = []

    def geometry(worth):
        asked.append(worth.count())
        return worth.select(F.col("pair_hi").alias("i"), F.col("pair_lo").alias("j"), F.lit(35).alias("orb_inliers"), F.lit(0.5).alias("inlier_ratio"), F.lit(1.0).alias("reproj_error"), F.lit(0.9).alias("crop_coverage"))

    def matches(pairs):
        return pairs.select("pair_lo", "pair_hi", F.lit(0.96).alias("ssim"), F.lit(2).alias("hamming"), "cosine", F.lit(0.9).alias("confidence"), F.explode(F.array(F.lit("ECC"), F.lit("pHash"))).alias("method"))

    annotate = lambda s: s.withColumns({"ssim": F.lit(0.97), "patch_min": F.lit(None).cast("double"), "patch_topk": F.lit(0.95)})
    result = Engine(spark).run(p, annotate, geometry, matches, gate_near_pages=True)
    r = result.pairs.collect()
    assert len(r) == 1 and asked == [1] and r[0].tile_count == 2 and r[0].tier == "A" and r[0].orb_inliers == 35
    told = {m.stage: m for m in result.metrics.table().collect()}
    assert list(told) == ["panels", "semantic", "hashes", "triggers", "geometry", "merge", "tiers", "tiles"]
    assert (told["panels"].n_out, told["semantic"].n_in, told["merge"].n_out, told["tiles"].n_out) == (3, 3, 1, result.pairs.count()) and told["semantic"].seconds > 0
    result.save(f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m_metrics").count() == 8
    for run in ("a", "b", "a"):
        result.log(f"{tmp_path}/h", run)
    assert [(x.run_no, x.run, x.tier_a) for x in sorted(append_log.read(spark, f"{tmp_path}/h").collect())] == [(0, "a", 1), (1, "b", 1)]
    lazy = Engine(spark).run(p, annotate, measure=False)
    assert lazy.metrics is None and lazy.ordered().count() == 1
    table = spark.createDataFrame([(2, 1, 40), (1, 3, 50)], "i long, j long, orb_inliers int")
    assert {(x.pair_lo, x.pair_hi) for x in Engine(spark).run(p, annotate, table).pairs.collect()} == {(1, 2)}


def test_tiles_first_and_cached_vectors(spark, tmp_path):
    p = panels(spark)
    cells = p.select((F.col("panel_id") * 10).alias("id"), "panel_id", "vec").unionByName(p.select((F.col("panel_id") * 10 + 1).alias("id"), "panel_id", F.transform("vec", lambda x: -x).alias("vec")))
    result = Engine(spark).tiles_first(p, cells, lambda m: m.withColumns({"ssim": F.lit(0.97), "hamming": F.lit(9), "confidence": F.lit(0.9), "method": F.lit("ECC")}))
    assert [(r.pair_lo, r.pair_hi, r.tile_count, r.tier) for r in result.pairs.collect()] == [(1, 2, 2, "A")] and [m["stage"] for m in result.metrics.stages] == ["cells", "candidates", "verified", "rollup"]
    made = []

    def compute(paths):
        made.append(paths.count())
        return paths.join(p.select("path", "vec"), "path")

    for n in (2, 3, 3):
        assert Engine(spark).vectors(p.drop("vec").where(f"panel_id <= {n}"), compute, f"{tmp_path}/v", "k").count() == n
    assert made == [2, 1]


def test_cli(spark, tmp_path):
    panels(spark).write.parquet(f"{tmp_path}/p")
    cli.main([f"{tmp_path}/p", f"{tmp_path}/o", "--preset", "balanced", "--similarity", "0.9"])
    meta = spark.read.json(f"{tmp_path}/o/metadata").first()
    assert Config.from_json(meta.config).pairing.similarity == 0.9 and files.read_tsv(spark, f"{tmp_path}/o/report").count() == 1


def test_stream(spark, tmp_path):
    known = spark.createDataFrame([(1, 0b1111), (2, -1)], "id long, hash long")
    new = spark.createDataFrame([(10, 0b1011), (11, 123456789)], "id long, hash long").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    new.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
    q = incremental.append_batches(incremental.matches(stream, known), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert [(r.new_id, r.known_id, r.hamming) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(10, 1, 1)]
    assert hashing.banded_pairs(known.unionByName(new.select("id", "hash")), 3).count() == 1
    assert {(r.new_id, r.known_id) for r in incremental.matches(new, known.unionByName(new.select("id", "hash")), 0).collect()} == {(10, 10), (11, 11)}
    counts = incremental.windowed_counts(spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in").select("ts", F.lit("match").alias("kind")))
    w = counts.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.sql("select sum(n) from w").first()[0] == 2
