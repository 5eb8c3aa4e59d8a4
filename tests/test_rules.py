"""Rules at and beside their thresholds, with missing signals, and the properties that results must have."""

import math

import pytest
from pyspark.sql import functions as F

from twinsieve.config import Config, Tiers, preset
from twinsieve.functions import scalars as sc
from twinsieve.operators import boxes, evaluate, hashing, merge, ordering, refine, similarity, tiering, tiles

SIGNALS = "pair_lo long, pair_hi long, cosine double, ssim double, hamming int, orb_inliers int, inlier_ratio double, reproj_error double, crop_coverage double, clip_z double, patch_min double, patch_topk double"


def pair(spark, **v):
    names = [x.split()[0] for x in SIGNALS.split(", ")]
    return spark.createDataFrame([tuple({"pair_lo": 1, "pair_hi": 2, **v}.get(n) for n in names)], SIGNALS)


def below(x):
    return math.nextafter(x, -math.inf)


@pytest.mark.parametrize(
    ("signals", "tier", "path"),
    [
        ({"hamming": 3}, "A", "Exact"), ({"hamming": 4}, "B", None), ({"hamming": 5}, "B", None), ({"hamming": 6}, None, None), ({}, None, None),
        ({"cosine": 0.99, "ssim": 0.95, "clip_z": 3.0, "patch_min": 0.85}, "A", "Strict"), ({"cosine": 0.99, "ssim": 0.95, "clip_z": below(3.0), "patch_min": 0.85}, "A", "Relaxed"),
        ({"orb_inliers": 30, "inlier_ratio": 0.3, "reproj_error": 4.0, "crop_coverage": 0.85}, "A", "ORB"), ({"orb_inliers": 29, "inlier_ratio": 0.3, "reproj_error": 4.0, "crop_coverage": 0.85}, None, None), ({"orb_inliers": 30, "inlier_ratio": 0.3, "crop_coverage": 0.85}, None, None),
        ({"cosine": 0.94, "ssim": 0.68}, "A", "Relaxed"), ({"cosine": below(0.94), "ssim": 0.7}, None, None), ({"cosine": 0.95, "ssim": 0.65}, "A", "Western"),
        ({"cosine": 0.97, "ssim": 0.3}, "B", None), ({"cosine": 0.97, "ssim": 0.3, "patch_topk": 0.78}, "A", "Confocal-A"), ({"cosine": 0.96, "ssim": 0.3, "patch_topk": 0.72}, "B", "Confocal-B"), ({"cosine": 0.96, "ssim": 0.3}, None, None),
    ],
)
def test_universal(spark, signals, tier, path):
    r = tiering.tiered(pair(spark, **signals)).first()
    assert (r.tier, r.tier_path) == (tier, path)


def test_missing_patch_is_a_false_positive(spark):
    assert tiering.tiered(pair(spark, cosine=0.97, ssim=0.5)).first().confocal_fp
    assert not tiering.tiered(pair(spark, cosine=0.97, ssim=0.5, patch_topk=0.72)).first().confocal_fp
    assert not tiering.tiered(pair(spark, cosine=0.97, ssim=0.5, hamming=10)).first().confocal_fp


def test_package_keeps_flagged_and_names_by_the_last_path(spark):
    r = tiering.tiered_package(pair(spark, hamming=2, cosine=0.96, ssim=0.75)).first()
    assert (r.tier, r.tier_path) == ("A", "Western Blot")
    assert tiering.tiered_package(pair(spark, cosine=0.99, ssim=0.95)).first().tier_path == "Western Blot"


def test_relaxed_orb_needs_its_switch(spark):
    s = {"cosine": 0.98, "ssim": 0.1, "patch_topk": 0.70, "orb_inliers": 25, "crop_coverage": 0.70, "inlier_ratio": 0.30, "reproj_error": 5.0}
    assert tiering.tiered(pair(spark, **s), Tiers(orb_relax=True)).first().tier_path == "ORB-Relaxed"
    assert tiering.tiered(pair(spark, **s)).first().tier_path == "Confocal-A"


def test_refinements(spark):
    base = pair(spark, cosine=0.97, ssim=0.5).withColumns({"tier": F.lit("A"), "path_a": F.lit("page_2_panel01.png"), "path_b": F.lit("page_2_panel02.png")})
    r = refine.stricter_fp(base).first()
    assert (r.tier, r.downgrade_reason) == ("B", "Confocal FP (high CLIP, low SSIM, no evidence)")
    assert refine.ssim_gate(base).count() == 0
    r = refine.same_page_context(base).first()
    assert (r.tier, r.is_adjacent) == ("B", True)
    lost = base.withColumns({"path_a": F.lit("x.png"), "path_b": F.lit("y.png")})
    assert refine.same_page_context(lost).first().tier == "A"  # an unknown page is no page


def test_merge_orientation_and_sources(spark):
    s = spark.createDataFrame([(1, 2, 0.9), (4, 3, 0.8)], "i int, j int, cosine double")
    h = spark.createDataFrame([(2, 1, 3), (5, 6, 1)], "i int, j int, hamming int")
    g = spark.createDataFrame([(2, 1, 40), (8, 7, 30), (6, 5, 9)], "i int, j int, orb_inliers int")
    got = {(r.pair_lo, r.pair_hi): (r.source, r.cosine, r.hamming, r.orb_inliers) for r in merge.merged(s, h, g).collect()}
    assert got == {(1, 2): ("CLIP+pHash+ORB", 0.9, 3, 40), (3, 4): ("CLIP", 0.8, None, None), (5, 6): ("pHash+ORB", None, 1, 9), (7, 8): ("ORB", None, None, 30)}
    again = merge.merged(s.union(s), h.union(h), g)
    assert again.count() == 4


def test_banding_finds_what_prefixes_miss(spark):
    h = spark.createDataFrame([(1, 0), (2, (1 << 62) | 3)], "id int, hash long")
    assert hashing.prefix_pairs(h, 4, 3).count() == 0 and hashing.banded_pairs(h, 3).count() == 1


def test_bundle_is_invariant(spark):
    import random

    rng = random.Random(1)
    v = [rng.uniform(-1, 1) for _ in range(64)]
    for name in hashing.TRANSFORMS:
        moved = [v[s] for s in hashing._permutation(name)]
        b = hashing.bundle(spark.createDataFrame([(1, v), (2, moved)], "id int, vec array<double>"))
        d = hashing.bundle_distance(spark.createDataFrame([(1, 2)], "i int, j int"), b).first()
        assert d.hamming == 0
    one = hashing.bundle(spark.createDataFrame([(1, v)], "id int, vec array<double>"))
    assert one.where("ord = 0").first().hash == spark.createDataFrame([(v,)], "vec array<double>").select(hashing.sign_hash("vec").alias("h")).first().h


def test_small_panel_tables(spark):
    for rows, n in (([], 0), ([(1, [1.0, 0.0])], 0), ([(1, [1.0, 0.0]), (2, [1.0, 0.0])], 1), ([(1, [1.0, 0.0]), (2, None)], 0)):
        v = spark.createDataFrame(rows, "id int, vec array<double>")
        assert similarity.pairs_at_least(v, 0.9).count() == n
        assert similarity.top_k_pairs(v, 3).count() == n
        assert similarity.similarity_stats(v).count() == len([r for r in rows if r[1]])


def test_blocks_do_not_change_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)]
    v = spark.createDataFrame(rows, "id int, vec array<double>")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and sum(p * q for p, q in zip(x, y)) >= 6}
    for block in (1000, 7):
        assert {(r.i, r.j) for r in similarity.pairs_at_least(v, 6.0, block).collect()} == want
    near = {(r.i, r.j) for r in similarity.neighbours(v, 3, 7).collect()}
    assert near == {(r.i, r.j) for r in similarity.neighbours(v, 3, 1000).collect()} and len(near) == 270


def test_intervals(spark):
    rows = [(1, 0, 10), (1, 15, 20), (1, 26, 30), (1, 27, 28), (2, 5, 6)]
    got = sorted((r.id, r.start, r.end) for r in ordering.merged_intervals(spark.createDataFrame(rows, "id int, start int, end int")).collect())
    assert got == [(1, 0, 20), (1, 26, 30), (2, 5, 6)]


def test_confusion_of_nothing(spark):
    r = evaluate.confusion(spark.createDataFrame([], "should_detect boolean, was_detected boolean")).first()
    assert (r.precision, r.recall, r.f1, r.fpr, r.accuracy) == (0, 0, 0, 0, 0)


def test_first_winner_of_a_grid(spark):
    rows = spark.createDataFrame([(True, 0.99, 0), (False, 0.1, 60)], "should_detect boolean, ssim double, hamming int")
    best = evaluate.grid_search(rows, [0.85, 0.9], [3, 4]).where("rank = 1").first()
    assert (best.ssim_t, best.hamming_t) == (0.85, 3)


def test_micro_tiles(spark):
    got = tiles.micro_tiles(spark.createDataFrame([(1, 256, 256), (2, 300, 256), (3, 100, 500), (4, 2000, 2000)], "panel_id int, w int, h int"))
    by = {r.panel_id: r["count"] for r in got.groupBy("panel_id").count().collect()}
    assert by == {1: 1, 2: 2, 4: 20}


def test_scalars(spark):
    df = spark.createDataFrame([("page_12_panel03.png", "a/b/c-7_x.png", None)], "p string, q string, z string")
    r = df.select(sc.page_number("p").alias("a"), sc.page_number("q").alias("b"), sc.panel_number("p").alias("c"), sc.first_number_token("q").alias("d"), sc.base_name("q").alias("e"), sc.stem("q").alias("f"), sc.page_number("z").alias("g"), sc.modality_from_path("q").alias("h")).first()
    assert tuple(r) == (12, None, 3, 7, "c-7_x.png", "c-7_x", None, "unknown")


def test_config():
    c = preset("thorough")
    assert Config.from_json(c.to_json()) == c and c.dpi == 200 and c.pairing.hamming == 5
    assert c.with_values(pairing={"hamming": 2}).tiers == c.tiers
    for bad in ({"pairing": {"similarity": 1.5}}, {"boxes": {"min_area": 10**9}}):
        with pytest.raises(ValueError):
            Config().with_values(**bad)
    with pytest.raises(ValueError):
        preset("none")


def test_config_from_elsewhere():
    c = Config.from_environment({"TWINSIEVE_PAIRING_SIMILARITY": "0.9", "TWINSIEVE_TIERS_ORB_RELAX": "true", "TWINSIEVE_DPI": "200", "OTHER": "x"})
    assert (c.pairing.similarity, c.tiers.orb_relax, c.dpi) == (0.9, True, 200)
    assert c.flat()["PAIRING_SIMILARITY"] == 0.9 and "0.9" in c.methods()
    yaml = pytest.importorskip("yaml")
    assert Config.from_yaml(c.to_yaml()) == c and yaml


def test_names_sizes_and_pages(spark):
    names = spark.createDataFrame([("brightness_+20",), ("brightness_-15",), ("crop_15pct",), ("rotate_270",), ("mirror_h",), ("odd_7x",), (None,)], "n string")
    got = [tuple(r) for r in names.select(sc.transform_kind("n"), sc.transform_amount("n"), sc.crop_margin("n", F.lit(400), F.lit(207))).collect()]
    assert got == [("brightness", 20, None), ("brightness", -15, None), ("crop", 15, 15), ("rotate", 270, None), ("mirror", None, None), ("other", None, None), ("other", None, None)]
    sizes = [0, 99, 100, 499, 500, 999, 1000, 4999, 5000, 20_000]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select(sc.prefix_digits("n"), sc.expected_seconds("n"), sc.run_size("n")).collect()
    assert [r[0] for r in rows] == [sc.adaptive_prefix(n) for n in sizes] and [round(r[1], 9) for r in rows] == [round(sc.cost_seconds(n), 9) for n in sizes]
    assert [r[2] for r in rows] == ["small"] * 4 + ["medium"] * 2 + ["large"] * 2 + ["very large"] * 2
    pages = spark.createDataFrame([("page_3",), ("3",), ("x",), (None,)], "p string").select(sc.page_of(F.col("p"))).collect()
    assert [r[0] for r in pages] == [3, 3, None, None]
