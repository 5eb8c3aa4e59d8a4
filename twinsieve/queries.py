"""The queries of the pair engine and their SQL, by name. Thresholds fit the vectors at hand, whose largest cosine is near 0.6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import scalars as sc
from .kernels import udfs as ud
from .operators import ann, boxes as bx, evaluate as ev, hashing as hs, merge as mg, ordering, pixels as px, refine as rf, similarity as sm, tiering as tr, tiles as tl, tuning
from .plans import tables as tb
from .plans.tables import BOXES_SQL, EVIDENCE_SQL, JUDGED_SQL, PANEL_SQL, PIXELS_SQL
from .registry import ORACLE, QUERIES, query
from .session import workspace

T, T_CAP, K, H = 0.35, 100, 10, 24


# --- similarity ---------------------------------------------------------------------------

PAIRS_SQL = f"WITH {PANEL_SQL}, allp AS (SELECT a.panel_id AS i, b.panel_id AS j, list_inner_product(a.vec, b.vec) AS cosine FROM panel a JOIN panel b ON a.panel_id < b.panel_id), pairs AS (SELECT * FROM allp WHERE cosine >= {T})"
R6 = "round(cosine, 6) AS cosine"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return tb.panel(spark, d).select(F.col("panel_id").alias("id"), "vec")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return sm.pairs_at_least(vectors(spark, d), T)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"{PAIRS_SQL} SELECT i, j, {R6} FROM pairs")
def sim_pairs_threshold(spark, d):
    return _rounded(_pairs(spark, d), "cosine")


NEAR_SQL = f"WITH {PANEL_SQL}, s AS (SELECT a.panel_id AS i, b.panel_id AS j, list_inner_product(a.vec, b.vec) AS cosine FROM panel a JOIN panel b ON a.panel_id <> b.panel_id), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(cosine, 9) DESC, j) AS rank FROM s) WHERE rank <= {K})"


@query(f"{NEAR_SQL} SELECT i, j, {R6}, rank::INTEGER AS rank FROM near")
def knn(spark, d):
    return _rounded(sm.neighbours(vectors(spark, d), K), "cosine")


@query(f"{NEAR_SQL} SELECT i, j, {R6} FROM near WHERE j > i AND cosine >= 0.25")
def sim_pairs_topk(spark, d):
    return _rounded(sm.top_k_pairs(vectors(spark, d), K, 0.25), "cosine")


@query(f"{NEAR_SQL} SELECT a.i, a.j, round(a.cosine, 6) AS cosine FROM near a JOIN near b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j AND a.cosine >= 0.25")
def sim_pairs_mutual_nn(spark, d):
    return _rounded(sm.mutual_pairs(vectors(spark, d), K, 0.25), "cosine")


@query(f"{PAIRS_SQL} SELECT i, j, {R6} FROM pairs ORDER BY cosine DESC, i, j LIMIT {T_CAP}")
def sim_pairs_cap(spark, d):
    return _rounded(sm.capped(_pairs(spark, d), T_CAP), "cosine")


STATS_SQL = "stats AS (SELECT id, avg(c) AS mu, greatest(stddev_pop(c), 1e-6) AS sd FROM (SELECT i AS id, cosine AS c FROM allp UNION ALL SELECT j, cosine FROM allp) GROUP BY id)"


@query(f"{PAIRS_SQL}, {STATS_SQL} SELECT id, round(mu, 6) AS mu, round(sd, 6) AS sd FROM stats")
def sim_stats_global(spark, d):
    return _rounded(sm.similarity_stats(vectors(spark, d)), "mu", "sd")


@query(f"{PAIRS_SQL}, {STATS_SQL} SELECT i, j, {R6}, round(least((cosine - a.mu) / a.sd, (cosine - b.mu) / b.sd), 5) AS clip_z FROM pairs JOIN stats a ON i = a.id JOIN stats b ON j = b.id")
def clip_z_global(spark, d):
    return _rounded(sm.z_global(_pairs(spark, d), sm.similarity_stats(vectors(spark, d))), "cosine").withColumn("clip_z", F.round("clip_z", 5))


@query(
    f"""{PAIRS_SQL}, a AS (SELECT i, avg(cosine) AS mu, stddev_samp(cosine) AS sd FROM pairs GROUP BY i), b AS (SELECT j, avg(cosine) AS mu, stddev_samp(cosine) AS sd FROM pairs GROUP BY j),
m AS (SELECT p.*, coalesce((a.mu + b.mu) / 2, a.mu, b.mu) AS mu, coalesce((a.sd + b.sd) / 2, a.sd, b.sd) AS sd FROM pairs p LEFT JOIN a ON p.i = a.i LEFT JOIN b ON p.j = b.j)
SELECT i, j, {R6}, round((cosine - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 5) AS clip_z FROM m"""
)
def clip_z_approx(spark, d):
    return _rounded(sm.z_approximate(_pairs(spark, d)), "cosine").withColumn("clip_z", F.round("clip_z", 5))


PAGED_SQL = f"{PAIRS_SQL}, paged AS (SELECT p.*, a.page AS page_a, b.page AS page_b, coalesce(a.page = b.page, false) AS same_page, abs(a.page - b.page) AS gap FROM pairs p LEFT JOIN panel a ON i = a.panel_id LEFT JOIN panel b ON j = b.panel_id)"


def _paged(spark, d):
    return sm.with_pages(_pairs(spark, d), tb.panel(spark, d))


@query(f"{PAGED_SQL} SELECT count(*) AS pairs, count(*) FILTER (same_page) AS same_page, count(*) FILTER (NOT same_page) AS cross_page, round(100e0 * count(*) FILTER (same_page) / count(*), 6) AS same_page_pct FROM paged")
def same_page_breakdown(spark, d):
    return sm.page_breakdown(_paged(spark, d))


@query(f"{PAGED_SQL} SELECT i, j, {R6} FROM paged WHERE NOT same_page")
def suppress_same_page(spark, d):
    return _rounded(sm.suppressed(_paged(spark, d), same_page=True), "cosine").select("i", "j", "cosine")


@query(f"{PAGED_SQL} SELECT i, j, {R6} FROM paged WHERE NOT coalesce(gap <= 1, false)")
def suppress_adjacent_page(spark, d):
    return _rounded(sm.suppressed(_paged(spark, d), adjacent_gap=1), "cosine").select("i", "j", "cosine")


# --- hashes -------------------------------------------------------------------------------

TRANSFORMS_SQL = ", ".join(f"({n}, '{name}', {hs._permutation(name)})" for n, name in enumerate(hs.TRANSFORMS))
BUNDLE_SQL = f"""WITH {PANEL_SQL}, t AS (SELECT * FROM (VALUES {TRANSFORMS_SQL}) AS v(ord, transform, perm)),
bits AS (SELECT panel_id AS id, ord, transform, list_transform(perm, lambda s: CASE WHEN vec[s + 1] > 0 THEN 1 ELSE 0 END) AS b FROM panel, t),
bundle AS (SELECT id, ord, transform, b, list_sum(list_transform(range(1, 33), lambda k: b[k] * (1::BIGINT << (k - 1))))::BIGINT AS lo, list_sum(list_transform(range(1, 33), lambda k: b[k + 32] * (1::BIGINT << (k - 1))))::BIGINT AS hi FROM bits),
named AS (SELECT *, lower(lpad(to_hex(hi), 8, '0')) || lower(lpad(to_hex(lo), 8, '0')) AS hex FROM bundle)"""


def _bundles(spark, d):
    return hs.bundle(vectors(spark, d))


def _hashes(spark, d):
    return vectors(spark, d).select("id", hs.sign_hash("vec").alias("hash"))


@query(f"{BUNDLE_SQL} SELECT id, ord, transform, hex FROM named")
def hash_bundle(spark, d):
    return _bundles(spark, d).select("id", "ord", "transform", F.lower(F.lpad(F.hex("hash"), 16, "0")).alias("hex"))


@query(f"{BUNDLE_SQL}, h AS (SELECT * FROM named WHERE ord = 0) SELECT a.id AS i, b.id AS j, (bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)))::INTEGER AS hamming FROM h a JOIN h b ON a.id < b.id AND substr(a.hex, 1, 2) = substr(b.hex, 1, 2) WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= {H}")
def hash_prefix_pairs(spark, d):
    return hs.prefix_pairs(_hashes(spark, d), 2, H)


@query(f"{BUNDLE_SQL}, h AS (SELECT * FROM named WHERE ord = 0) SELECT a.id AS i, b.id AS j, (bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)))::INTEGER AS hamming FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= 18")
def hash_banded_pairs(spark, d):
    return hs.banded_pairs(_hashes(spark, d), 18)


MIN_SQL = """best AS (SELECT p.i, p.j, min({'d': bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)), 'o': a.ord * 8 + b.ord, 't': a.transform || ' vs ' || b.transform}) AS m FROM met p JOIN named a ON p.i = a.id JOIN named b ON p.j = b.id GROUP BY p.i, p.j)"""


@query(f"{BUNDLE_SQL}, keys AS (SELECT DISTINCT id, substr(hex, 1, 3) AS p FROM named), met AS (SELECT DISTINCT a.id AS i, b.id AS j FROM keys a JOIN keys b ON a.p = b.p AND a.id < b.id), {MIN_SQL} SELECT i, j, m.d::INTEGER AS hamming, m.t AS transform FROM best WHERE m.d <= 22")
def hash_bundle_pairs(spark, d):
    return hs.bundle_pairs(_bundles(spark, d), 3, 22)


@query(f"{BUNDLE_SQL}, met AS (SELECT a.panel_id AS i, b.panel_id AS j FROM panel a JOIN panel b ON a.panel_id < b.panel_id AND a.page = b.page), {MIN_SQL} SELECT i, j, m.d::INTEGER AS hamming, m.t AS transform FROM best")
def hash_min_transform(spark, d):
    p = tb.panel(spark, d)
    met = p.select("page", F.col("panel_id").alias("i")).join(p.select("page", F.col("panel_id").alias("j")), "page").where("i < j").select("i", "j")
    return hs.bundle_distance(met, _bundles(spark, d))


@query(f"{BUNDLE_SQL}, met AS (SELECT a.panel_id AS i, b.panel_id AS j FROM panel a JOIN panel b ON a.panel_id < b.panel_id), {MIN_SQL} SELECT i, j, m.d::INTEGER AS hamming, m.t AS transform FROM best WHERE m.d <= 16")
def hash_orbit_pairs(spark, d):
    return hs.orbit_pairs(_bundles(spark, d), 16)


@query(f"{BUNDLE_SQL}, s AS (SELECT substr(hex, 1, 2) AS p, count(*) AS n FROM named WHERE ord = 0 GROUP BY 1) SELECT sum(n)::BIGINT AS records, count(*) AS buckets, sum(n * (n - 1) / 2e0) AS comparisons, round(1 - sum(n * (n - 1) / 2e0) / (sum(n) * (sum(n) - 1) / 2e0), 6) AS avoided FROM s")
def hash_bucket_stats(spark, d):
    return hs.bucket_stats(_hashes(spark, d), 2)


# --- merge --------------------------------------------------------------------------------

SOURCES_SQL = f"""{PAIRS_SQL}, h AS (SELECT panel_id AS id, list_transform(vec, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM panel),
hx AS (SELECT x.id AS i, y.id AS j, list_sum(list_transform(range(1, 65), lambda k: CASE WHEN x.b[k] <> y.b[k] THEN 1 ELSE 0 END))::INTEGER AS hamming FROM h x JOIN h y ON x.id < y.id),
hashes AS (SELECT * FROM hx WHERE hamming <= 18),
geometry AS (SELECT i, j, ((i * 17 + j) % 60)::INTEGER AS orb_inliers FROM pairs WHERE (i + j) % 3 = 0 UNION ALL SELECT j, i, ((i * 17 + j) % 60)::INTEGER FROM hashes WHERE (i + j) % 2 = 0)"""


def _sources(spark, d):
    """Pairs by cosine, by hash and by geometry; the first two are written once, as the third is made of them."""

    def once(df, label):
        at = workspace(spark, label)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    pairs, hashes = once(_pairs(spark, d), "pairs"), once(hs.banded_pairs(_hashes(spark, d), 18), "hashes")
    inl = ((F.col("i") * 17 + F.col("j")) % 60).cast("int").alias("orb_inliers")
    turned = hashes.where((F.col("i") + F.col("j")) % 2 == 0).select(F.col("j").alias("i"), F.col("i").alias("j"), inl)
    return pairs, hashes, pairs.where((F.col("i") + F.col("j")) % 3 == 0).select("i", "j", inl).unionByName(turned)


KEY = "least(i, j) AS pair_lo, greatest(i, j) AS pair_hi"
MERGE_SQL = f"""{SOURCES_SQL}, s AS (SELECT {KEY}, max(cosine) AS cosine FROM pairs GROUP BY 1, 2), hh AS (SELECT {KEY}, max(hamming) AS hamming FROM hashes GROUP BY 1, 2), g AS (SELECT {KEY}, max(orb_inliers) AS orb_inliers FROM geometry GROUP BY 1, 2),
keys AS (SELECT pair_lo, pair_hi FROM s UNION SELECT pair_lo, pair_hi FROM hh UNION SELECT pair_lo, pair_hi FROM g),
merged AS (SELECT k.pair_lo, k.pair_hi, round(s.cosine, 6) AS cosine, hh.hamming, g.orb_inliers, concat_ws('+', CASE WHEN s.pair_lo IS NOT NULL THEN 'CLIP' END, CASE WHEN hh.pair_lo IS NOT NULL THEN 'pHash' END, CASE WHEN g.pair_lo IS NOT NULL THEN 'ORB' END) AS source
  FROM keys k LEFT JOIN s ON k.pair_lo = s.pair_lo AND k.pair_hi = s.pair_hi LEFT JOIN hh ON k.pair_lo = hh.pair_lo AND k.pair_hi = hh.pair_hi LEFT JOIN g ON k.pair_lo = g.pair_lo AND k.pair_hi = g.pair_hi)"""


@query(f"{MERGE_SQL} SELECT * FROM merged")
def merge_evidence(spark, d):
    return _rounded(mg.merged(*_sources(spark, d)), "cosine").select("pair_lo", "pair_hi", "cosine", "hamming", "orb_inliers", "source")


@query(f"{MERGE_SQL} SELECT pair_lo, pair_hi, cosine, hamming, CASE WHEN cosine IS NOT NULL AND hamming IS NOT NULL THEN 'CLIP+pHash' WHEN cosine IS NOT NULL THEN 'CLIP' ELSE 'pHash' END AS source FROM merged WHERE source <> 'ORB'")
def merge_simple(spark, d):
    s, h, _ = _sources(spark, d)
    return mg.report_order(_rounded(mg.merged(s, h), "cosine")).select("pair_lo", "pair_hi", "cosine", "hamming", "source")


@query(f"{SOURCES_SQL} SELECT DISTINCT {KEY} FROM (SELECT i, j FROM pairs WHERE cosine >= 0.4 UNION ALL SELECT i, j FROM hashes WHERE hamming <= 17)")
def trigger_pairs(spark, d):
    s, h, _ = _sources(spark, d)
    return mg.trigger_pairs(s, h, 0.4, 17)


@query(f"{PAIRS_SQL} SELECT panel_id AS id, page FROM panel WHERE panel_id IN (SELECT i FROM pairs WHERE cosine >= 0.4 UNION SELECT j FROM pairs WHERE cosine >= 0.4)")
def needed_signatures(spark, d):
    met = sm.pairs_at_least(vectors(spark, d), 0.4).select(F.col("i").alias("pair_lo"), F.col("j").alias("pair_hi"))
    return mg.needed(tb.panel(spark, d).select(F.col("panel_id").alias("id"), "page"), met)


EV = f"WITH {EVIDENCE_SQL}"


@query(f"{EV} SELECT pair_lo, pair_hi FROM evidence WHERE NOT coalesce(abs(page_a - page_b) <= 2, false) OR coalesce(hamming <= 4, false) OR coalesce(orb_inliers >= 30, false)")
def near_page_gate(spark, d):
    e = tb.evidence(spark, d).withColumn("gap", F.abs(F.col("page_a") - F.col("page_b")))
    return mg.near_page_gate(e, 4).select("pair_lo", "pair_hi")


@query(f"{EV} SELECT pair_lo, pair_hi, cosine FROM evidence WHERE pair_lo % 2 = 0 UNION ALL SELECT pair_lo, pair_hi, 0.95e0 FROM evidence WHERE pair_lo % 3 = 0 AND pair_lo % 2 <> 0")
def anti_append(spark, d):
    e = tb.evidence(spark, d)
    return mg.appended(e.where("pair_lo % 2 = 0").select("pair_lo", "pair_hi", "cosine"), e.where("pair_lo % 3 = 0").select("pair_lo", "pair_hi", F.lit(0.95).alias("cosine")), ["pair_lo", "pair_hi"])


@query(f"{EV} SELECT path_a, path_b, pair_lo FROM (SELECT *, row_number() OVER (PARTITION BY path_a, path_b ORDER BY cosine DESC NULLS LAST, pair_lo) AS n FROM evidence) WHERE n = 1")
def dedupe_keep_first(spark, d):
    return mg.first_of(tb.evidence(spark, d), ["path_a", "path_b"], [F.col("cosine").desc_nulls_last(), F.col("pair_lo")]).select("path_a", "path_b", "pair_lo")


# --- tiers --------------------------------------------------------------------------------

SIG_SQL = f"""{EV}, sig AS (SELECT *, coalesce(cosine, 0) AS c, coalesce(ssim, 0) AS s, coalesce(hamming, 999) AS h, coalesce(orb_inliers, 0) AS n, coalesce(inlier_ratio, 0) AS r, coalesce(reproj_error, 999) AS e, coalesce(crop_coverage, 0) AS v,
  coalesce(clip_z, 0) AS z, coalesce(patch_min, 0) AS pm, coalesce(patch_topk, patch_min, ssim, 0) AS p FROM evidence)"""
FLAG = "(c >= 0.96e0 AND s < 0.6e0 AND h > {h} AND NOT (p >= 0.72e0 OR (n >= 20 AND v >= 0.65e0 AND e <= 5)))"
TIER_SQL = f"""{SIG_SQL}, f AS (SELECT *, {FLAG.format(h=10)} AS flagged FROM sig),
g AS (SELECT *, flagged AND (coalesce(deep_ssim >= 0.9e0 AND deep_ncc >= 0.985e0, false) OR coalesce(deep_hamming <= 5, false)) AS deep, c >= 0.96e0 AND s < 0.88e0 AND (coalesce(ihc_ssim >= 0.88e0 AND ihc_ncc >= 0.98e0, false) OR coalesce(ihc_hamming <= 6, false)) AS ihc FROM f),
p1 AS (SELECT *, flagged AND NOT deep AS wrong, CASE WHEN h <= 3 THEN 'Exact' WHEN c >= 0.99e0 AND s >= 0.95e0 AND z >= 3 AND pm >= 0.85e0 THEN 'Strict' WHEN n >= 30 AND r >= 0.3e0 AND e <= 4 AND v >= 0.85e0 THEN 'ORB' WHEN c >= 0.94e0 AND s >= 0.65e0 AND c + s >= 1.62e0 THEN 'Relaxed'
  WHEN c >= 0.95e0 AND s >= 0.65e0 AND c + s >= 1.6e0 THEN 'Western' WHEN c >= 0.965e0 AND (p >= 0.78e0 OR (n >= 25 AND v >= 0.7e0 AND e <= 5) OR h <= 5) THEN 'Confocal-A' WHEN deep THEN 'Confocal-DeepVerify' WHEN ihc THEN 'IHC-DeepVerify' END AS path,
  c >= 0.955e0 AND (p >= 0.72e0 OR (n >= 20 AND v >= 0.65e0 AND e <= 6) OR h <= 6) AS cb FROM g),
tiered AS (SELECT * REPLACE (hamming AS hamming), flagged AS confocal_fp, CASE WHEN path IS NOT NULL AND NOT wrong THEN 'A' WHEN h BETWEEN 4 AND 5 OR (c >= 0.985e0 AND c < 0.99e0 AND s >= 0.92e0 AND s < 0.95e0) OR cb OR (wrong AND c >= 0.97e0) THEN 'B' END AS tier,
  CASE WHEN path IS NOT NULL AND NOT wrong THEN path WHEN cb THEN 'Confocal-B' END AS tier_path FROM p1)"""


def _tiered(spark, d):
    return tr.tiered(tb.evidence(spark, d))


@query(f"{TIER_SQL} SELECT pair_lo, pair_hi, confocal_fp, tier, tier_path FROM tiered")
def tier_universal(spark, d):
    return _tiered(spark, d).select("pair_lo", "pair_hi", "confocal_fp", "tier", "tier_path")


@query(
    f"""{SIG_SQL}, q AS (SELECT *, {FLAG.format(h=3)} AS confocal_fp, CASE WHEN c >= 0.95e0 AND s >= 0.6e0 AND c + s >= 1.55e0 THEN 'Western Blot' WHEN c >= 0.94e0 AND s >= 0.7e0 AND c + s >= 1.64e0 THEN 'Relaxed' WHEN n >= 30 AND r >= 0.3e0 AND e <= 4 AND v >= 0.85e0 THEN 'ORB-RANSAC'
  WHEN c >= 0.99e0 AND s >= 0.95e0 AND z >= 3 AND pm >= 0.85e0 THEN 'Strict (CLIP+SSIM)' WHEN h <= 3 THEN 'Exact (pHash)' END AS path, h BETWEEN 4 AND 5 AS bh, c BETWEEN 0.985e0 AND 0.99e0 AS bc, s BETWEEN 0.92e0 AND 0.95e0 AS bs FROM sig)
SELECT pair_lo, pair_hi, confocal_fp, CASE WHEN path IS NOT NULL THEN 'A' WHEN bh OR (bc AND bs) THEN 'B' END AS tier, CASE WHEN path IS NOT NULL THEN path WHEN (bh OR (bc AND bs)) AND bc THEN 'Borderline (CLIP+SSIM)' WHEN bh THEN 'Borderline (pHash)' END AS tier_path FROM q"""
)
def tier_package(spark, d):
    return tr.tiered_package(tb.evidence(spark, d)).select("pair_lo", "pair_hi", "confocal_fp", "tier", "tier_path")


def _modality_sql(unknown: str) -> str:
    return f"""{SIG_SQL}, rules AS (SELECT * FROM (VALUES ('western_blot', 0.94e0, 0.60e0, 1.55e0, 3, 0.92e0, 0.50e0, 1.45e0, 4, NULL::DOUBLE, NULL::DOUBLE), ('confocal', 0.95e0, 0.75e0, 1.70e0, 3, 0.92e0, 0.65e0, 1.60e0, 4, 0.96e0, 0.50e0), ('tem', 0.95e0, 0.85e0, 1.80e0, 2, 0.93e0, 0.75e0, 1.70e0, 3, NULL, NULL),
  ('bright_field', 0.93e0, 0.75e0, 1.68e0, 4, 0.90e0, 0.65e0, 1.58e0, 5, NULL, NULL), ('gel', 0.94e0, 0.70e0, 1.64e0, 3, 0.91e0, 0.60e0, 1.54e0, 4, NULL, NULL), ({unknown}, NULL, NULL)) AS t(m, ac, a_s, ab, ah, bc, bs, bb, bh, fc, fs)),
ruled AS (SELECT * FROM sig JOIN rules ON m = CASE WHEN modality_a = modality_b THEN modality_a ELSE 'unknown' END)"""


@query(
    f"""{_modality_sql("'unknown', 0.96e0, 0.85e0, 1.81e0, 3, 0.94e0, 0.75e0, 1.69e0, 4")}, w AS (SELECT *, coalesce(c >= fc AND s < fs, false) AS wrong FROM ruled),
a AS (SELECT *, (h <= ah OR (c >= ac AND s >= a_s AND c + s >= ab)) AND NOT wrong AS is_a FROM w)
SELECT pair_lo, pair_hi, wrong AS confocal_fp, CASE WHEN is_a THEN 'A' WHEN h BETWEEN ah AND bh OR (c >= bc AND s >= bs AND c + s >= bb) THEN 'B' END AS tier, CASE WHEN is_a AND h <= ah THEN 'Exact' WHEN is_a THEN modality_a || '_specific' END AS tier_path FROM a"""
)
def tier_modality(spark, d):
    return tr.tiered_by_modality(tb.evidence(spark, d)).select("pair_lo", "pair_hi", "confocal_fp", "tier", "tier_path")


@query(
    f"""{_modality_sql("'unknown', 0.95e0, 0.65e0, 1.65e0, 3, 0.92e0, 0.40e0, 1.50e0, 4")}, w AS (SELECT *, modality_a = modality_b AS same FROM ruled),
a AS (SELECT *, CASE WHEN h <= 2 THEN 'Exact (pHash)' WHEN same AND ((c >= ac AND s >= a_s AND c + s >= ab) OR h <= ah) THEN (CASE modality_a WHEN 'western_blot' THEN 'Western Blot' WHEN 'confocal' THEN 'Confocal' WHEN 'tem' THEN 'Tem' WHEN 'bright_field' THEN 'Bright Field' WHEN 'gel' THEN 'Gel' ELSE 'Unknown' END) || '-Specific'
  WHEN same AND c >= bc AND s >= bs THEN (CASE modality_a WHEN 'western_blot' THEN 'Western Blot' WHEN 'confocal' THEN 'Confocal' WHEN 'tem' THEN 'Tem' WHEN 'bright_field' THEN 'Bright Field' WHEN 'gel' THEN 'Gel' ELSE 'Unknown' END) || '-Borderline'
  WHEN (modality_a = 'unknown' OR modality_b = 'unknown' OR NOT same) AND c >= 0.95e0 AND s >= 0.65e0 AND c + s >= 1.65e0 THEN 'Universal-Fallback' WHEN c >= 0.92e0 AND s >= 0.4e0 THEN 'Universal-Borderline' WHEN same AND modality_a = 'confocal' AND c >= 0.96e0 AND s < 0.5e0 THEN 'Confocal-FP-Filtered' END AS tier_path FROM w)
SELECT pair_lo, pair_hi, CASE WHEN tier_path LIKE 'Exact%' OR tier_path LIKE '%-Specific' OR tier_path = 'Universal-Fallback' THEN 'A' WHEN tier_path LIKE '%Borderline' THEN 'B' END AS tier, tier_path FROM a"""
)
def tier_modality_package(spark, d):
    return tr.tiered_by_modality_package(tb.evidence(spark, d)).select("pair_lo", "pair_hi", "tier", "tier_path")


@query(f"{SIG_SQL} SELECT pair_lo, pair_hi FROM sig WHERE {FLAG.format(h=10)}")
def confocal_fp(spark, d):
    return tb.evidence(spark, d).where(tr.confocal_fp()).select("pair_lo", "pair_hi")


GATE_SQL = f"{TIER_SQL}, gated AS (SELECT *, coalesce(patch_topk, 0) >= 0.72e0 AS has_patch_evidence, n >= 30 AND r >= 0.3e0 AND v >= 0.85e0 AND e <= 4 AS has_orb_evidence, h <= 5 AS has_phash_evidence FROM tiered)"
KEPT = "(s >= 0.75e0 OR has_patch_evidence OR has_orb_evidence OR has_phash_evidence)"
WRONG = "(c >= 0.96e0 AND s < 0.6e0 AND h > 5 AND NOT coalesce(patch_topk, 0) >= 0.72e0 AND NOT n >= 30)"


@query(f"{GATE_SQL} SELECT pair_lo, pair_hi, has_patch_evidence, has_orb_evidence, has_phash_evidence FROM gated WHERE {KEPT}")
def ssim_gate(spark, d):
    return rf.ssim_gate(tb.evidence(spark, d)).select("pair_lo", "pair_hi", "has_patch_evidence", "has_orb_evidence", "has_phash_evidence")


@query(f"{TIER_SQL} SELECT pair_lo, pair_hi, {WRONG} AS confocal_fp_enhanced, CASE WHEN {WRONG} AND tier = 'A' THEN 'B' WHEN {WRONG} THEN NULL ELSE tier END AS tier FROM tiered")
def fp_enhanced(spark, d):
    return rf.stricter_fp(_tiered(spark, d)).select("pair_lo", "pair_hi", "confocal_fp_enhanced", "tier")


NEXT = "(page_a = page_b AND abs(panel_num_a - panel_num_b) = 1)"
SOFT = "NOT (h <= 3 OR n >= 30)"


@query(f"{TIER_SQL} SELECT pair_lo, pair_hi, {NEXT} AS is_adjacent, CASE WHEN {NEXT} AND tier = 'A' AND {SOFT} THEN 'B' ELSE tier END AS tier FROM tiered")
def same_page_downgrade(spark, d):
    return rf.same_page_context(_tiered(spark, d).drop("page_a", "page_b", "panel_num_a", "panel_num_b")).select("pair_lo", "pair_hi", "is_adjacent", "tier")


@query(
    f"""{GATE_SQL}, x AS (SELECT *, CASE WHEN {WRONG} AND tier = 'A' THEN 'B' WHEN {WRONG} THEN NULL ELSE tier END AS t2, CASE WHEN {WRONG} AND tier = 'A' THEN 'Confocal FP (high CLIP, low SSIM, no evidence)' END AS r2 FROM gated WHERE {KEPT})
SELECT pair_lo, pair_hi, CASE WHEN {NEXT} AND t2 = 'A' AND {SOFT} THEN 'B' ELSE t2 END AS tier, CASE WHEN {NEXT} AND t2 = 'A' AND {SOFT} THEN 'Adjacent same-page without hard evidence' ELSE r2 END AS downgrade_reason FROM x"""
)
def refine_chain(spark, d):
    return rf.refined(_tiered(spark, d).drop("page_a", "page_b", "panel_num_a", "panel_num_b")).select("pair_lo", "pair_hi", "tier", "downgrade_reason")


@query(f"{TIER_SQL} SELECT tier, tier_path, count(*) AS n FROM tiered GROUP BY ALL")
def tier_path_counts(spark, d):
    return tr.path_counts(_tiered(spark, d))


@query(f"{TIER_SQL} SELECT coalesce(tier, 'Other') AS tier, count(*) AS n FROM tiered GROUP BY ALL")
def tier_counts(spark, d):
    return tr.tier_counts(_tiered(spark, d))


@query(f"{TIER_SQL} SELECT pair_lo, pair_hi, tier FROM tiered WHERE coalesce(tier, 'Other') IN ('B', 'Other')")
def tier_filter(spark, d):
    return tr.of_tiers(_tiered(spark, d), ["B", "Other"]).select("pair_lo", "pair_hi", "tier")


@query(f"{SIG_SQL} SELECT pair_lo, pair_hi, h <= 4 OR s >= 0.95e0 AS was_detected, CASE WHEN h <= 4 THEN 'pHash' WHEN s >= 0.95e0 THEN 'SSIM' END AS method_triggered FROM sig")
def baseline_detector(spark, d):
    return tr.detected(tb.evidence(spark, d)).select("pair_lo", "pair_hi", "was_detected", "method_triggered")


# --- tiles --------------------------------------------------------------------------------

SIZED_SQL = "sized AS (SELECT l_orderkey * 8 + l_linenumber AS panel_id, (min(l_partkey) % 900 + 60)::INTEGER AS w, (min(l_suppkey) * 7 % 800 + 60)::INTEGER AS h FROM lineitem GROUP BY 1)"
TILES_SQL = f"""WITH {SIZED_SQL}, p AS (SELECT *, least(w, h, 256) AS size FROM sized WHERE least(w, h, 256) >= 128), q AS (SELECT *, greatest(8, floor(size * 0.7e0)::INTEGER) AS stride FROM p),
r AS (SELECT *, list_transform(range(0, 200), lambda k: k * stride) AS steps FROM q),
s AS (SELECT panel_id, w, h, size, list_filter(steps, lambda v: v <= w - size) AS xs, list_filter(steps, lambda v: v <= h - size) AS ys FROM r),
rows AS (SELECT panel_id, size, 0 AS part, unnest(ys) AS y, xs, ys, w, h FROM s),
inner_ AS (SELECT panel_id, size, 0 AS part, y, unnest(xs) AS x FROM rows),
bottom AS (SELECT panel_id, size, 1 AS part, h - size AS y, unnest(xs) AS x FROM s WHERE ys[len(ys)] + size < h),
right_ AS (SELECT panel_id, size, 2 AS part, unnest(ys) AS y, w - size AS x FROM s WHERE xs[len(xs)] + size < w),
every AS (SELECT * FROM inner_ UNION ALL SELECT * FROM bottom UNION ALL SELECT * FROM right_),
tiles AS (SELECT panel_id, (row_number() OVER (PARTITION BY panel_id ORDER BY part, y, x) - 1)::INTEGER AS n, x::INTEGER AS x, y::INTEGER AS y, size FROM every)"""


def _sized(spark, d):
    rows = tb.load(spark, d, "lineitem")
    return rows.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("panel_id")).agg((F.min("l_partkey") % 900 + 60).cast("int").alias("w"), (F.min("l_suppkey") * 7 % 800 + 60).cast("int").alias("h"))


@query(f"{TILES_SQL} SELECT * FROM tiles WHERE n < 20")
def micro_tiles(spark, d):
    return tl.micro_tiles(_sized(spark, d))


@query(f"{TILES_SQL} SELECT * FROM tiles WHERE n < 20 ORDER BY md5(panel_id::VARCHAR || ':' || n::VARCHAR), panel_id, n LIMIT 200")
def tile_cap(spark, d):
    return tl.capped(tl.micro_tiles(_sized(spark, d)))


@query(f"{PAIRS_SQL} SELECT i, j, {R6}, least(i // 4, j // 4) AS pair_lo, greatest(i // 4, j // 4) AS pair_hi FROM pairs WHERE i // 4 <> j // 4")
def tile_pairs(spark, d):
    return tl.cross_panel(_rounded(_pairs(spark, d), "cosine"), vectors(spark, d).select("id", F.floor(F.col("id") / 4).alias("panel_id")))


MATCHES_SQL = f"{EV}, matches AS (SELECT pair_lo // 3 AS pair_lo, pair_lo // 3 + 1 AS pair_hi, ssim, hamming, cosine, coalesce(cosine, 0) AS confidence, CASE WHEN pair_lo % 2 = 0 THEN 'ECC' ELSE 'pHash' END AS method FROM evidence), rolled AS (SELECT pair_lo, pair_hi, count(*) AS tile_count, round(avg(ssim), 6) AS avg_ssim, min(hamming) AS min_hamming, round(avg(cosine), 6) AS avg_cosine, (list(method ORDER BY confidence DESC, method))[1] AS tile_method FROM matches GROUP BY ALL)"


def _matches(spark, d):
    k = F.floor(F.col("pair_lo") / 3)
    return tb.evidence(spark, d).select(k.alias("lo"), (k + 1).alias("pair_hi"), "ssim", "hamming", "cosine", F.coalesce("cosine", F.lit(0.0)).alias("confidence"), F.when(F.col("pair_lo") % 2 == 0, "ECC").otherwise("pHash").alias("method")).withColumnRenamed("lo", "pair_lo")


@query(f"{MATCHES_SQL} SELECT * FROM rolled")
def tile_rollup(spark, d):
    return tl.rolled_up(_matches(spark, d))


@query(f"{MATCHES_SQL} SELECT pair_lo, pair_hi, CASE WHEN coalesce(tile_count >= 2 AND (avg_ssim >= 0.95e0 OR min_hamming <= 3), false) THEN 'A' ELSE 'B' END AS tier FROM rolled")
def tile_first_tier(spark, d):
    return tl.tile_first_tier(tl.rolled_up(_matches(spark, d))).select("pair_lo", "pair_hi", "tier")


@query(
    f"""{TIER_SQL}, u AS (SELECT *, modality_a = 'confocal' AND modality_b = 'confocal' AS both_, CASE WHEN pair_lo % 2 = 0 THEN tile_n ELSE 0 END AS k FROM tiered),
w AS (SELECT *, both_ AND k >= 2 AND coalesce(tier <> 'A', false) AS up, both_ AND k < 2 AND coalesce(tier = 'A', false) AND NOT coalesce(tier_path IN ('Exact', 'ORB', 'Confocal-DeepVerify', 'IHC-DeepVerify'), false) AS down FROM u)
SELECT pair_lo, pair_hi, k::BIGINT AS tile_count, CASE WHEN up THEN 'A' WHEN down THEN 'B' ELSE tier END AS tier, CASE WHEN up THEN 'Multi-Tile-Confirmed-' || k::VARCHAR WHEN down THEN 'Confocal-NeedsTileEvidence-' || k::VARCHAR ELSE tier_path END AS tier_path FROM w"""
)
def tile_evidence_apply(spark, d):
    e = tb.evidence(spark, d).where("pair_lo % 2 = 0").select("pair_lo", "pair_hi", F.col("tile_n").alias("tile_count"), F.lit("ECC").alias("tile_method"))
    return rf.with_tile_evidence(_tiered(spark, d), e).select("pair_lo", "pair_hi", "tile_count", "tier", "tier_path")


@query(f"WITH {PANEL_SQL} SELECT a.panel_id AS pair_lo, b.panel_id AS pair_hi FROM panel a JOIN panel b ON a.panel_id < b.panel_id AND a.page <> b.page AND a.modality = 'confocal' AND b.modality = 'confocal'")
def same_modality_panels(spark, d):
    return tl.same_modality_panels(tb.panel(spark, d))


# --- evaluation ---------------------------------------------------------------------------

PROXY = "(confocal_fp OR (coalesce(ssim < 0.6e0, false) AND (hamming IS NULL OR hamming > 8) AND n < 15))"
ANCHOR = "(coalesce(hamming <= 3, false) OR (n >= 40 AND r >= 0.35e0 AND e <= 4))"


@query(
    f"""{TIER_SQL}, a AS (SELECT count(*) AS total_pairs, count(*) FILTER ({ANCHOR}) AS anchors, count(*) FILTER ({ANCHOR} AND tier = 'A') AS anchors_a, count(*) FILTER (tier = 'A') AS tier_a, count(*) FILTER (tier = 'B') AS tier_b, count(*) FILTER ({PROXY}) AS fp_proxy, count(*) FILTER (page_a <> page_b) AS cross_page FROM tiered),
m AS (SELECT *, fp_proxy / total_pairs::DOUBLE AS f, cross_page / total_pairs::DOUBLE AS x, tier_a / total_pairs::DOUBLE AS t, anchors_a / anchors::DOUBLE AS p FROM a)
SELECT total_pairs, anchors, anchors_a, tier_a, tier_b, fp_proxy, round(f, 3) AS fp_rate, round(x, 3) AS cross_page_ratio, round(t, 3) AS tier_a_ratio, round(p, 3) AS anchor_precision, f <= 0.35e0 AS pass_fp, x >= 0.4e0 AS pass_cross_page, t >= 0.05e0 AS pass_tier_a, p >= 0.9e0 AS pass_anchor,
  f <= 0.35e0 AND x >= 0.4e0 AND t >= 0.05e0 AND p >= 0.9e0 AS overall_pass FROM m"""
)
def policy_eval(spark, d):
    return ev.policy(_tiered(spark, d))


@query(
    f"""{TIER_SQL}, w AS (SELECT * FROM tiered WHERE {PROXY}) SELECT round(greatest(0.96e0, (SELECT quantile_cont(c, 0.95) FROM w) + 0.003e0), 3) AS sim_threshold, round(greatest(0.9e0, (SELECT quantile_cont(ssim, 0.95) FROM w WHERE ssim IS NOT NULL) + 0.01e0), 3) AS ssim_threshold,
CASE WHEN (SELECT count(*) FROM tiered WHERE {ANCHOR} AND h > 4) > 0 THEN 4 END AS phash_max_dist"""
)
def quantile_suggest(spark, d):
    return ev.suggestions(_tiered(spark, d))


@query(
    f"""{TIER_SQL}, best AS (SELECT * FROM tiered ORDER BY cosine DESC NULLS LAST, pair_lo, pair_hi LIMIT 6)
SELECT count(*) AS pairs_total, count(*) FILTER (tier = 'A') AS tier_a, count(*) FILTER (tier = 'B') AS tier_b, round(100e0 * count(*) FILTER (page_a <> page_b) / count(*), 6) AS cross_page_pct, count(*) FILTER (c >= 0.96e0 AND s < 0.6e0 AND h >= 10) AS fp_proxy_count,
round(100e0 * count(*) FILTER (c >= 0.96e0 AND s < 0.6e0 AND h >= 10) / count(*), 6) AS fp_proxy_pct, (SELECT round(100e0 * count(*) FILTER (tier = 'A') / count(*), 6) FROM best) AS anchor_precision FROM tiered"""
)
def run_score(spark, d):
    return ev.run_score(_tiered(spark, d))


@query(f"{TIER_SQL}, x AS (SELECT tier, page_a AS page FROM tiered UNION ALL SELECT tier, page_b FROM tiered WHERE page_b <> page_a) SELECT page, count(*) AS pairs, count(*) FILTER (tier = 'A') AS tier_a FROM x WHERE page IN (3, 7, 11) GROUP BY page")
def focus_pages(spark, d):
    return ev.focus_pages(_tiered(spark, d), [3, 7, 11])


@query(
    f"""{TIER_SQL} SELECT modality_a AS modality, count(*) AS pairs, count(*) FILTER (tier = 'A') AS tier_a, count(*) FILTER (tier = 'B') AS tier_b, round(100e0 * count(*) FILTER (tier = 'A') / count(*), 6) AS tier_a_pct, count(*) FILTER (c >= 0.96e0 AND s < 0.6e0) AS fp_proxy, count(*) FILTER (confocal_fp) AS flagged,
count(deep_ssim) AS deep_ran, count(*) FILTER (deep_ssim >= 0.9e0 AND deep_ncc >= 0.985e0) AS deep_passed, round(avg(CASE WHEN deep_ssim >= 0.9e0 THEN deep_ssim END), 6) AS avg_deep_ssim FROM tiered WHERE modality_a = modality_b GROUP BY modality_a"""
)
def modality_kpi(spark, d):
    return ev.modality_kpi(_tiered(spark, d))


JU = f"WITH {JUDGED_SQL}, det AS (SELECT *, hamming <= 4 OR ssim >= 0.95e0 AS hit FROM judged)"
CONF = """count(*) FILTER (should_detect AND hit) AS tp, count(*) FILTER (NOT should_detect AND hit) AS fp, count(*) FILTER (should_detect AND NOT hit) AS fn, count(*) FILTER (NOT should_detect AND NOT hit) AS tn"""
RATES = """tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) * coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) / nullif(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) + coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 0), 0), 6) AS f1,
round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 6) AS fpr, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy"""


def _hit(spark, d):
    return tr.detected(tb.judged(spark, d).withColumns({c: F.lit(None) for c in ("cosine", "orb_inliers", "inlier_ratio", "reproj_error", "crop_coverage", "clip_z", "patch_min", "patch_topk")}))


@query(f"{JU}, c AS (SELECT {CONF} FROM det) SELECT {RATES} FROM c")
def confusion(spark, d):
    return ev.confusion(_hit(spark, d))


@query(f"{JU}, c AS (SELECT category, {CONF} FROM det GROUP BY category) SELECT category, {RATES} FROM c")
def confusion_by_category(spark, d):
    return ev.confusion(_hit(spark, d), ["category"])


CURVE_SQL = f"""WITH {JUDGED_SQL}, pts AS (SELECT score, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM judged GROUP BY score), run AS (SELECT score AS threshold, sum(p) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY score DESC)::BIGINT AS fp, sum(p) OVER () AS total FROM pts),
curve AS (SELECT threshold, tp, fp, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / total::DOUBLE, 6) AS recall FROM run)"""


@query(f"{CURVE_SQL} SELECT * FROM curve")
def pr_curve(spark, d):
    return ev.pr_curve(tb.judged(spark, d))


@query(
    f"""{CURVE_SQL}, s AS (SELECT tp / (tp + fp)::DOUBLE AS now, lag(tp / (tp + fp)::DOUBLE, 1, 1e0) OVER w AS last, (tp - lag(tp, 1, 0) OVER w) / total::DOUBLE AS step FROM run WINDOW w AS (ORDER BY threshold DESC))
SELECT round(sum(step * now), 6) AS average_precision, round(sum(step * (now + last) / 2), 6) AS pr_auc FROM s"""
)
def average_precision(spark, d):
    return ev.average_precision(tb.judged(spark, d))


@query(f"{CURVE_SQL} SELECT recall, threshold FROM curve WHERE precision >= 0.7e0 ORDER BY recall DESC, threshold DESC LIMIT 1")
def recall_at_precision(spark, d):
    return ev.recall_at_precision(ev.pr_curve(tb.judged(spark, d)), 0.7)


@query(f"WITH {JUDGED_SQL} SELECT count(*) FILTER (label = 0 AND score >= 0.5e0) AS fp, count(*) FILTER (label = 0) AS negatives, round(count(*) FILTER (label = 0 AND score >= 0.5e0) / (count(*) FILTER (label = 0))::DOUBLE, 6) AS fpr FROM judged")
def fpr_at_threshold(spark, d):
    return ev.fpr_at(tb.judged(spark, d), 0.5)


GRID = ([0.85, 0.87, 0.89, 0.91, 0.93, 0.95, 0.97], [3, 4, 5, 6])


@query(
    f"""WITH {JUDGED_SQL}, grid AS (SELECT * FROM (VALUES {", ".join(f"({k}, {s}e0, {h})" for k, (s, h) in enumerate((s, h) for s in GRID[0] for h in GRID[1]))}) AS g(ord, ssim_t, hamming_t)),
det AS (SELECT ord, ssim_t, hamming_t, should_detect, ssim >= ssim_t OR hamming <= hamming_t AS hit FROM judged, grid), c AS (SELECT ord, ssim_t, hamming_t, {CONF} FROM det GROUP BY ALL), f AS (SELECT ord, ssim_t, hamming_t, {RATES} FROM c)
SELECT *, (row_number() OVER (ORDER BY CASE WHEN precision >= 0.8e0 THEN 0 ELSE 1 END, recall DESC, ord))::INTEGER AS rank FROM f"""
)
def grid_search(spark, d):
    return ev.grid_search(tb.judged(spark, d), *GRID, floor=0.8)


@query(f"{SIG_SQL} SELECT pair_lo, pair_hi, round(greatest((least(greatest(c, 0), 1) + least(greatest(s, 0), 1)) * 0.5e0, tanh(n / 50e0)), 6) AS score FROM sig")
def unified_score(spark, d):
    return tb.evidence(spark, d).select("pair_lo", "pair_hi", F.round(sc.unified_score("cosine", "ssim", "orb_inliers"), 6).alias("score"))


@query(f"WITH {JUDGED_SQL}, p AS (SELECT label, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM judged) SELECT round(-avg(label * ln(p) + (1 - label) * ln(1 - p)), 6) AS log_loss, count(*) AS n FROM p")
def log_loss(spark, d):
    return ev.log_loss(tb.judged(spark, d))


@query(f"{EV}, v AS (SELECT 'zscore' AS method, ssim AS value FROM evidence UNION ALL SELECT 'clahe', patch_topk FROM evidence) SELECT method, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS least FROM v GROUP BY method")
def ab_stats(spark, d):
    e = tb.evidence(spark, d)
    return ev.ab_stats(e.select(F.lit("zscore").alias("method"), F.col("ssim").alias("value")).unionByName(e.select(F.lit("clahe").alias("method"), F.col("patch_topk").alias("value"))))


@query("SELECT run, passes, fp_pct, (row_number() OVER (ORDER BY passes DESC, fp_pct, run))::INTEGER AS rank FROM (SELECT p_partkey AS run, (p_size % 5)::INTEGER AS passes, (p_partkey * 13 % 100) / 100e0 AS fp_pct FROM part) ORDER BY passes DESC, fp_pct, run LIMIT 20")
def sweep_rank(spark, d):
    return ev.sweep_rank(tb.load(spark, d, "part").select(F.col("p_partkey").alias("run"), (F.col("p_size") % 5).cast("int").alias("passes"), ((F.col("p_partkey") * 13 % 100) / 100.0).alias("fp_pct")))


@query(f"WITH {JUDGED_SQL} SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id::VARCHAR), id) - 1) % 5)::INTEGER AS fold FROM judged")
def k_folds(spark, d):
    return ev.k_folds(tb.judged(spark, d).select("id", "label"))


@query(f"WITH {JUDGED_SQL}, f AS (SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id::VARCHAR), id) - 1) % 5)::INTEGER AS fold FROM judged), det AS (SELECT *, hamming <= 4 OR ssim >= 0.95e0 AS hit FROM f), c AS (SELECT fold, {CONF} FROM det GROUP BY fold) SELECT fold, {RATES} FROM c")
def cross_validation(spark, d):
    return ev.confusion(tr.detected(ev.k_folds(_hit(spark, d).drop("was_detected", "method_triggered"))), ["fold"])


@query("SELECT event_type AS stage, round(sum(value), 6) AS seconds, count(*) AS n_in, count(*) FILTER (user_id % 3 = 0) AS n_out, round(100e0 * (1 - count(*) FILTER (user_id % 3 = 0) / count(*)::DOUBLE), 6) AS reduction_pct, round(sum(value), 6) >= 5 AS bottleneck FROM events GROUP BY event_type")
def stage_metrics(spark, d):
    s = tb.load(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 6).alias("seconds"), F.count("*").alias("n_in"), F.count_if(F.col("user_id") % 3 == 0).alias("n_out"))
    return ev.stage_metrics(s).drop("throughput")


@query("SELECT run, epoch_us(ts) AS ts_us FROM (SELECT event_id AS run, ts, row_number() OVER (ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 50")
def last_runs(spark, d):
    return ev.last_runs(tb.load(spark, d, "events").select(F.col("event_id").alias("run"), "ts")).select("run", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query(f"{JU}, c AS (SELECT category, {CONF} FROM det GROUP BY category), m AS (SELECT category, {RATES} FROM c) SELECT category, CASE WHEN fpr <= 0.005e0 AND recall >= 0.9e0 AND precision >= 0.95e0 THEN 'EXCELLENT' WHEN fpr <= 0.01e0 AND recall >= 0.8e0 AND precision >= 0.9e0 THEN 'GOOD' WHEN fpr <= 0.05e0 AND recall >= 0.7e0 THEN 'ACCEPTABLE' ELSE 'NEEDS_IMPROVEMENT' END AS grade FROM m")
def grades(spark, d):
    return ev.grades(ev.confusion(_hit(spark, d), ["category"])).select("category", "grade")


@query()
def platt_calibration(spark, d):
    rows = tb.judged(spark, d).select("id", "label", "score")
    return tuning.Calibrator(method="platt").fit(rows).transform(rows)


@query()
def isotonic_calibration(spark, d):
    rows = tb.judged(spark, d).select("id", "label", "score")
    return tuning.Calibrator(method="isotonic").fit(rows).transform(rows)


# --- boxes --------------------------------------------------------------------------------

BOX = f"WITH {BOXES_SQL}, ok AS (SELECT * FROM boxes WHERE w * h BETWEEN 80000 AND 10000000 AND w / h::DOUBLE BETWEEN 0.2e0 AND 5e0)"
IOU_SQL = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def _ok(spark, d):
    return bx.of_size(tb.boxes(spark, d))


@query(f"{BOX} SELECT page, id, x, y, w, h FROM ok")
def panel_filter(spark, d):
    return _ok(spark, d)


@query(f"{BOX}, p AS (SELECT a.page, a.id AS a, b.id AS b, {IOU_SQL} AS both_, a.w * a.h + b.w * b.h AS total FROM ok a JOIN ok b ON a.page = b.page AND a.id < b.id) SELECT page, a, b, round(both_ / (total - both_)::DOUBLE, 6) AS iou FROM p WHERE both_ > 0")
def iou_pairs(spark, d):
    return _rounded(bx.iou_pairs(_ok(spark, d)), "iou")


@query(
    f"""{BOX.replace("WITH ", "WITH RECURSIVE ", 1)}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, id) AS k FROM ok),
hit AS (SELECT a.page, a.k AS ka, b.k AS kb FROM o a JOIN o b ON a.page = b.page AND a.k < b.k WHERE {IOU_SQL} >= 0.5e0 * (a.w * a.h + b.w * b.h - {IOU_SQL})),
walk(page, k, kept) AS (SELECT page, 1::BIGINT, [1::BIGINT] FROM o WHERE k = 1 UNION ALL SELECT w.page, w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM hit h WHERE h.page = w.page AND h.kb = w.k + 1 AND list_contains(w.kept, h.ka)) THEN w.kept ELSE list_append(w.kept, w.k + 1) END FROM walk w JOIN o ON o.page = w.page AND o.k = w.k + 1),
fin AS (SELECT page, kept FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k DESC) AS n FROM walk) WHERE n = 1)
SELECT o.page, o.id, o.x, o.y, o.w, o.h FROM o JOIN fin ON o.page = fin.page AND list_contains(fin.kept, o.k)"""
)
def nms(spark, d):
    return bx.suppressed(_ok(spark, d))


@query(f"{BOX} SELECT page, id, x, y, w, h, (row_number() OVER (PARTITION BY page ORDER BY y, x, id))::INTEGER AS panel_num FROM ok")
def reading_order(spark, d):
    return bx.reading_order(_ok(spark, d))


QUAD = {"x1": "0e0 - x % 50", "y1": "0e0 + y % 40", "x2": "0e0 + w - x % 90", "y2": "0e0 - y % 30", "x3": "0e0 + w + x % 60", "y3": "0e0 + h - y % 70", "x4": "0e0 + x % 80", "y4": "0e0 + h + y % 20"}


@query(
    f"""{BOX}, q AS (SELECT page, id, w, h, {", ".join(f"{e} AS {c}" for c, e in QUAD.items())} FROM ok), s AS (SELECT *, {" + ".join(f"CASE WHEN x{k} BETWEEN 0 AND w AND y{k} BETWEEN 0 AND h THEN 1e0 ELSE 0e0 END" for k in range(1, 5))} AS n,
abs(x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y4 - x4 * y3 + x4 * y1 - x1 * y4) / 2 AS area FROM q) SELECT page, id, round(least(n / 4, area / (w * h)), 6) AS coverage FROM s"""
)
def crop_coverage(spark, d):
    return _rounded(bx.crop_coverage(_ok(spark, d).selectExpr("page", "id", "w", "h", *[f"{e} AS {c}" for c, e in QUAD.items()])), "coverage").select("page", "id", "coverage")


@query(
    """WITH l AS (SELECT l_suppkey % 50 AS id, (l_partkey * 7 % 5000)::BIGINT AS s, (l_partkey * 7 % 5000 + 3 + l_linenumber)::BIGINT AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT id, min(s) AS start, max(e) AS "end", count(*) AS parts FROM i GROUP BY id, k"""
)
def interval_merge(spark, d):
    k = F.col("l_partkey") * 7 % 5000
    lanes = tb.load(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("id"), k.cast("long").alias("start"), (k + 3 + F.col("l_linenumber")).cast("long").alias("end"))
    return ordering.merged_intervals(lanes)


MATCH = "((l_partkey * 31 + l_suppkey * 17) % 97)"


@query(f"WITH m AS (SELECT DISTINCT l_orderkey AS pair, l_linenumber // 4 AS q, l_partkey AS t, {MATCH}::INTEGER AS d FROM lineitem), r AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS second FROM m WINDOW w AS (PARTITION BY pair, q ORDER BY d, t)) SELECT pair, q, t, d FROM r WHERE k = 1 AND d < 0.75e0 * second")
def ratio_test(spark, d):
    m = tb.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair"), F.floor(F.col("l_linenumber") / 4).cast("int").alias("q"), F.col("l_partkey").alias("t"), F.expr(f"cast({MATCH} as int)").alias("d")).distinct()
    return bx.ratio_test(m)


# --- pixels -------------------------------------------------------------------------------

PX = f"WITH {PIXELS_SQL}"
IMG_PAIRS = "met AS (SELECT a.img AS a, b.img AS b, a.y, a.x, a.v::DOUBLE AS va, b.v::DOUBLE AS vb FROM pixels a JOIN pixels b ON a.y = b.y AND a.x = b.x AND b.img = a.img + 1)"
SSIM_SQL = "((2 * avg(va) * avg(vb) + 6.5025e0) * (2 * covar_samp(va, vb) + 58.5225e0)) / ((avg(va) * avg(va) + avg(vb) * avg(vb) + 6.5025e0) * (var_samp(va) + var_samp(vb) + 58.5225e0))"


def _met(spark, d):
    p = tb.pixels(spark, d)
    n = p.select("img").distinct()
    pairs = n.select(F.col("img").alias("a"), (F.col("img") + 1).alias("b")).join(n.withColumnRenamed("img", "b"), "b")  # each image and the next
    return px.pairs_of(p, pairs)


@query(f"{PX} SELECT img, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, min(v) AS least, max(v) AS most FROM pixels GROUP BY img")
def image_stats(spark, d):
    return px.stats(tb.pixels(spark, d))


@query(f"{PX}, e AS (SELECT img, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY img) SELECT p.img, y, x, (CASE WHEN hi > lo THEN floor((v - lo) * 255e0 / (hi - lo) + 0.5e0) ELSE v END)::INTEGER AS v FROM pixels p JOIN e ON p.img = e.img")
def autocontrast(spark, d):
    return px.autocontrast(tb.pixels(spark, d))


@query(f"{PX} " + " UNION ALL ".join(f"SELECT img, '{n}' AS transform, ({y})::INTEGER AS y, ({x})::INTEGER AS x, ({v})::INTEGER AS v FROM pixels" for n, y, x, v in (("rotate_90", "x", "47 - y", "v"), ("rotate_180", "47 - y", "47 - x", "v"), ("rotate_270", "47 - x", "y", "v"), ("mirror_h", "y", "47 - x", "v"), ("mirror_v", "47 - y", "x", "v"), ("brightness_+20", "y", "x", "least(v + 20, 255)"))))
def transforms(spark, d):
    return px.transformed(tb.pixels(spark, d), 48)


@query(f"{PX}, {IMG_PAIRS} SELECT a, b, round(CASE WHEN stddev_pop(va) = 0 OR stddev_pop(vb) = 0 THEN 0 ELSE corr(va, vb) END, 6) AS ncc FROM met GROUP BY a, b")
def ncc(spark, d):
    return px.ncc(_met(spark, d))


@query(f"{PX}, {IMG_PAIRS} SELECT a, b, round({SSIM_SQL}, 6) AS ssim FROM met GROUP BY a, b")
def ssim_global(spark, d):
    return px.ssim_global(_met(spark, d))


@query(
    f"""{PX}, {IMG_PAIRS}, e AS (SELECT a, b, least(y // 16, 2) * 3 + least(x // 16, 2) AS cell, {SSIM_SQL} AS s FROM met GROUP BY 1, 2, 3), p AS (SELECT a, b, min(s) AS lo, list(s ORDER BY s DESC) AS l, count(*) AS patches FROM e GROUP BY a, b), g AS (SELECT a, b, {SSIM_SQL} AS g FROM met GROUP BY a, b)
SELECT p.a, p.b, round(lo, 6) AS patch_min, round((l[1] + l[2] + l[3] + l[4]) / 4, 6) AS patch_topk, patches, round(0.4e0 * g + 0.6e0 * (l[1] + l[2] + l[3] + l[4]) / 4, 6) AS ssim FROM p JOIN g ON p.a = g.a AND p.b = g.b"""
)
def patch_ssim(spark, d):
    return px.patch_ssim(_met(spark, d), 48)


@query(
    f"""{PX}, m AS (SELECT unnest([-1, 0, 1]) AS dy), mm AS (SELECT m.dy, k.dy AS dx FROM m, m k), s AS (SELECT img, y - dy AS y, x - dx AS x, sum(v * dx * (2 - abs(dy))) AS gx, sum(v * dy * (2 - abs(dx))) AS gy, count(*) AS k FROM pixels, mm GROUP BY 1, 2, 3)
SELECT img, round(avg(abs(gx)), 6) AS gx, round(avg(abs(gy)), 6) AS gy, round(avg(abs(gx)) / (avg(abs(gy)) + 1e-6), 6) AS anisotropy, round(avg(CASE WHEN abs(gx) + abs(gy) > 255 THEN 1e0 ELSE 0e0 END), 6) AS edge_density FROM s WHERE k = 9 GROUP BY img"""
)
def sobel_texture(spark, d):
    return px.texture(tb.pixels(spark, d))


FEATURES = {"edge": "((k * 7) % 41) / 100e0", "anisotropy": "0.8e0 + ((k * 11) % 90) / 100e0", "mid": "((k * 13) % 170) * 1e0", "high": "((k * 17) % 140) * 1e0"}


@query(
    f"""WITH f AS (SELECT k, {", ".join(f"{e} AS {c}" for c, e in FEATURES.items())} FROM (SELECT o_orderkey AS k FROM orders)), r AS (SELECT *, CASE WHEN anisotropy > 1.4e0 AND edge > 0.08e0 AND edge < 0.2e0 THEN 1 WHEN mid > 80 AND edge > 0.12e0 AND edge < 0.25e0 THEN 2 WHEN edge > 0.28e0 AND high > 100 THEN 3 WHEN edge < 0.08e0 THEN 4 WHEN anisotropy > 0.9e0 AND anisotropy < 1.1e0 AND edge > 0.08e0 THEN 5 ELSE 6 END AS m FROM f),
s AS (SELECT *, CASE m WHEN 1 THEN least(anisotropy - 1, 1) WHEN 2 THEN least(mid / 150, 1) WHEN 3 THEN least(edge / 0.35e0, 1) WHEN 4 THEN 1 - edge / 0.08e0 WHEN 5 THEN 0.7e0 ELSE 0 END AS sure FROM r)
SELECT k, CASE WHEN sure < 0.15e0 THEN 'unknown' ELSE (['western_blot', 'confocal', 'tem', 'bright_field', 'gel', 'unknown'])[m] END AS modality, round(sure, 6) AS confidence FROM s"""
)
def modality_rules(spark, d):
    f = tb.load(spark, d, "orders").selectExpr("o_orderkey AS k").selectExpr("k", *[f"{e} AS {c}" for c, e in FEATURES.items()])
    return px.modality(f).select("k", "modality", "confidence")


@query(
    f"""{PX}, t AS (SELECT img, y // 8 AS y, x // 8 AS x, quantile_cont(v, 0.5) AS v FROM pixels GROUP BY 1, 2, 3), nb AS (SELECT a.img, a.y, a.x, a.v, b.v AS w FROM t a JOIN t b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x)),
m AS (SELECT img, y, x, v, quantile_cont(w, 0.5) AS m FROM nb GROUP BY ALL), s AS (SELECT nb.img, nb.y, nb.x, nb.v, m.m, quantile_cont(abs(w - m.m), 0.5) AS mad FROM nb JOIN m ON nb.img = m.img AND nb.y = m.y AND nb.x = m.x GROUP BY ALL)
SELECT img, y, x, v AS median, round(abs(v - m) / (1.4826e0 * mad + 1e-6), 4) AS z, abs(v - m) / (1.4826e0 * mad + 1e-6) >= 4 AS outlier FROM s"""
)
def brightness_mad(spark, d):
    return px.brightness_outliers(tb.pixels(spark, d), 8)


_U = [(i, j) for i in range(4) for j in range(4) if i or j]
DCT_SQL = f"""{PX}, c AS (SELECT img, y // 8 AS by_, x // 8 AS bx, {", ".join(f"sum(v * cos((2 * (y % 8) + 1) * {i} * pi() / 16) * cos((2 * (x % 8) + 1) * {j} * pi() / 16)) AS d{n}" for n, (i, j) in enumerate(_U))} FROM pixels GROUP BY 1, 2, 3),
l AS (SELECT *, sqrt({" + ".join(f"d{n} * d{n}" for n in range(15))}) AS len FROM c), blocks AS (SELECT img, by_, bx, [{", ".join(f"d{n} / len" for n in range(15))}] AS d FROM l)"""


@query(f"{DCT_SQL} SELECT img, by_ AS by, bx, {', '.join(f'round(d[{n + 1}], 5) + 0e0 AS d{n}' for n in range(15))} FROM blocks")
def dct_blocks(spark, d):
    return px.dct_blocks(tb.pixels(spark, d)).select("img", "by", "bx", *[(F.round(F.element_at("d", n + 1), 5) + 0.0).alias(f"d{n}") for n in range(15)])


@query(f"{DCT_SQL} SELECT a.img, a.by_ AS ya, a.bx AS xa, b.by_ AS yb, b.bx AS xb, round(list_inner_product(a.d, b.d), 5) AS cosine FROM blocks a JOIN blocks b ON a.img = b.img AND (a.by_ < b.by_ OR (a.by_ = b.by_ AND a.bx < b.bx)) WHERE list_inner_product(a.d, b.d) >= 0.95e0 AND sqrt((a.by_ - b.by_) ** 2 + (a.bx - b.bx) ** 2) >= 2")
def clone_candidates(spark, d):
    return px.clone_candidates(px.dct_blocks(tb.pixels(spark, d))).withColumn("cosine", F.round("cosine", 5))


@query(f"{PX} SELECT img, x // 12 AS lane, y, round(avg(v), 6) AS mean FROM pixels GROUP BY 1, 2, 3")
def lane_profiles(spark, d):
    lanes = tb.pixels(spark, d).select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("lane")).withColumns({"start": F.col("lane") * 12, "end": F.col("lane") * 12 + 12})
    return px.lane_profiles(tb.pixels(spark, d), lanes)


# --- image kernels ------------------------------------------------------------------------


@query()
def kernel_hash_bundles(spark, d):
    return ud.bundle_rows(ud.hash_bundles(tb.image_files(spark)))


@query()
def kernel_hash_pairs(spark, d):
    return hs.bundle_pairs(ud.bundle_rows(ud.hash_bundles(tb.image_files(spark))), 2, 8)


@query()
def kernel_ssim(spark, d):
    return ud.ssim_scores(tb.image_pairs(spark), tb.image_files(spark), 160)


@query()
def kernel_geometry(spark, d):
    return ud.geometry_scores(tb.image_pairs(spark), tb.image_files(spark))


@query()
def kernel_deep_verify(spark, d):
    return ud.deep_scores(tb.image_pairs(spark), tb.image_files(spark))


@query()
def kernel_texture(spark, d):
    return px.modality(ud.texture(tb.image_files(spark)))


@query()
def kernel_lane_distance(spark, d):
    return ud.lane_distances(tb.image_pairs(spark), tb.image_files(spark))


# --- the rest -----------------------------------------------------------------------------


@query(f"{PAIRS_SQL} SELECT i, j, {R6} FROM pairs")
def ivf_pairs(spark, d):
    return _rounded(ann.build(vectors(spark, d), cells=16).pairs(T), "cosine")


@query(f"WITH {PANEL_SQL}, s AS (SELECT a.panel_id AS query_id, b.panel_id AS id, list_inner_product(a.vec, b.vec) AS cosine FROM panel a JOIN panel b ON a.panel_id <> b.panel_id WHERE a.panel_id % 100 = 0) SELECT query_id, id, {R6} FROM s WHERE cosine >= 0.3e0")
def ann_search(spark, d):
    v = vectors(spark, d)
    return _rounded(ann.build(v, cells=16).search(v.where("id % 100 = 0"), 0.3), "cosine")


@query(f"{PAIRS_SQL} SELECT i, j, {R6} FROM pairs")
def sim_pairs_adaptive(spark, d):
    return _rounded(ann.adaptive_pairs(vectors(spark, d), T), "cosine")


@query(f"{EV} SELECT pair_lo, pair_hi, (row_number() OVER (ORDER BY coalesce(cosine, 0) DESC, pair_lo, pair_hi))::INTEGER AS report_no FROM evidence")
def report_numbers(spark, d):
    return mg.numbered(tb.evidence(spark, d)).select("pair_lo", "pair_hi", "report_no")


@query(f"WITH {PANEL_SQL}, p AS (SELECT DISTINCT page // 10 AS doc_id, page FROM panel) SELECT a.doc_id, a.page AS page_a, b.page AS page_b FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.page < b.page")
def page_pairs(spark, d):
    return mg.page_pairs(tb.panel(spark, d).select(F.floor(F.col("page") / 10).alias("doc_id"), "page").distinct())


@query(
    f"""WITH {PANEL_SQL}, {EVIDENCE_SQL}, c AS (SELECT path, modality, (panel_id % 10) / 10e0 AS confidence FROM panel WHERE panel_id % 7 <> 0), m AS (SELECT path, CASE WHEN confidence >= 0.15e0 THEN modality ELSE 'unknown' END AS m FROM c)
SELECT pair_lo, coalesce(a.m, 'unknown') AS modality_a, coalesce(b.m, 'unknown') AS modality_b FROM evidence e LEFT JOIN m a ON e.path_a = a.path LEFT JOIN m b ON e.path_b = b.path"""
)
def modality_join(spark, d):
    cache = tb.panel(spark, d).where("panel_id % 7 <> 0").select("path", "modality", ((F.col("panel_id") % 10) / 10.0).alias("confidence"))
    return mg.with_modalities(tb.evidence(spark, d), cache).select("pair_lo", "modality_a", "modality_b")


@query(f"{TILES_SQL}, t AS (SELECT * FROM tiles WHERE n < 20), own AS (SELECT DISTINCT panel_id FROM t), pairs AS (SELECT a.panel_id AS pair_lo, b.panel_id AS pair_hi FROM own a JOIN own b ON b.panel_id = a.panel_id + 1) SELECT pair_lo, pair_hi, a.n AS tile_a, b.n AS tile_b FROM pairs JOIN t a ON a.panel_id = pair_lo JOIN t b ON b.panel_id = pair_hi")
def tile_products(spark, d):
    t = tl.tile_numbers(_sized(spark, d))
    p = t.select("panel_id")
    return tl.products(p.select(F.col("panel_id").alias("pair_lo"), (F.col("panel_id") + 1).alias("pair_hi")), t)


@query(f"WITH {SIZED_SQL}, s AS (SELECT panel_id, list_filter(list_transform(range(0, 50), lambda k: k * 249), lambda v: v <= w - 384) AS xs, list_filter(list_transform(range(0, 50), lambda k: k * 249), lambda v: v <= h - 384) AS ys FROM sized WHERE w >= 384 AND h >= 384), r AS (SELECT panel_id, unnest(ys) AS y, xs FROM s), e AS (SELECT panel_id, y, unnest(xs) AS x FROM r) SELECT panel_id, (row_number() OVER (PARTITION BY panel_id ORDER BY y, x) - 1)::INTEGER AS n, x::INTEGER AS x, y::INTEGER AS y, 384 AS size FROM e")
def regular_tiles(spark, d):
    return tl.regular_tiles(_sized(spark, d))


@query(f"{JU}, p AS (SELECT id AS pair_id, hit AS was_detected FROM det WHERE id % 4 <> 0), v AS (SELECT j.should_detect, coalesce(p.was_detected, false) AS hit FROM judged j LEFT JOIN p ON j.id = p.pair_id), c AS (SELECT {CONF} FROM v) SELECT {RATES} FROM c")
def ground_truth_join(spark, d):
    truth = tb.judged(spark, d).select(F.col("id").alias("pair_id"), "should_detect")
    found = ev.run_detector(_hit(spark, d), lambda x: x.select(F.col("id").alias("pair_id"), "should_detect", "was_detected")).where("pair_id % 4 <> 0")
    return ev.confusion(ev.validated(truth, found))


@query("SELECT p_brand AS preset, count(*) AS runs, round(avg(p_retailprice), 6) AS avg_seconds, min(p_retailprice) AS min_seconds, max(p_retailprice) AS max_seconds FROM part GROUP BY p_brand")
def benchmark_presets(spark, d):
    return ev.benchmark(tb.load(spark, d, "part").select(F.col("p_brand").alias("preset"), F.col("p_retailprice").alias("seconds")))


@query(f"WITH {PANEL_SQL} SELECT modality, count(*) AS n, round(avg((panel_id % 10) / 10e0), 6) AS confidence FROM panel GROUP BY modality")
def modality_counts(spark, d):
    return ev.value_shares(tb.panel(spark, d).withColumn("c", (F.col("panel_id") % 10) / 10.0), "modality", "c")


@query(f"WITH m AS (SELECT DISTINCT l_suppkey AS pair, l_linenumber AS q, l_partkey AS t, {MATCH}::INTEGER AS d FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY d, q, t) AS k, count(*) OVER (PARTITION BY pair) AS n FROM m) SELECT pair, q, t, d FROM r WHERE k <= floor(n * 0.15e0)")
def best_matches(spark, d):
    m = tb.load(spark, d, "lineitem").select(F.col("l_suppkey").alias("pair"), F.col("l_linenumber").alias("q"), F.col("l_partkey").alias("t"), F.expr(f"cast({MATCH} as int)").alias("d")).distinct()
    return ev.best_share(m)


GRID3 = ([0.92, 0.95, 0.98], [0.6, 0.8], [20, 40])


@query(
    f"""{EV}, t AS (SELECT *, coalesce(hamming <= 8, false) AS should_detect FROM evidence), grid AS (SELECT * FROM (VALUES {", ".join(f"({k}, {c}e0, {s}e0, {n})" for k, (c, s, n) in enumerate((c, s, n) for c in GRID3[0] for s in GRID3[1] for n in GRID3[2]))}) AS g(ord, cosine_t, ssim_t, inliers_t)),
det AS (SELECT ord, cosine_t, ssim_t, inliers_t, should_detect, (coalesce(cosine >= cosine_t, false) AND coalesce(ssim >= ssim_t, false)) OR coalesce(orb_inliers >= inliers_t, false) AS hit FROM t, grid), c AS (SELECT ord, cosine_t, ssim_t, inliers_t, {CONF} FROM det GROUP BY ALL), f AS (SELECT ord, cosine_t, ssim_t, inliers_t, {RATES} FROM c)
SELECT *, (row_number() OVER (ORDER BY CASE WHEN precision >= 0.3e0 THEN 0 ELSE 1 END, recall DESC, ord))::INTEGER AS rank FROM f"""
)
def grid_search_three(spark, d):
    return ev.two_signal_grid(tb.evidence(spark, d).withColumn("should_detect", F.coalesce(F.col("hamming") <= 8, F.lit(False))), *GRID3, floor=0.3)


@query(f"{JU}, c AS (SELECT category, {CONF} FROM det GROUP BY category), m AS (SELECT category, {RATES} FROM c), f AS (SELECT category, concat_ws(',', CASE WHEN NOT fpr <= 0.005e0 THEN 'fpr' END, CASE WHEN NOT recall >= 0.9e0 THEN 'recall' END, CASE WHEN NOT precision >= 0.95e0 THEN 'precision' END) AS failed FROM m) SELECT category, failed, failed = '' AS ready FROM f")
def production_readiness(spark, d):
    return ev.readiness(ev.confusion(_hit(spark, d), ["category"])).select("category", "failed", "ready")


@query(
    f"""{PX}, {IMG_PAIRS}, e AS (SELECT a, b, least(y // 16, 2) * 3 + least(x // 16, 2) AS cell, {SSIM_SQL} AS s FROM met GROUP BY 1, 2, 3)
SELECT a, b, round(min(s), 6) AS least, round(max(s), 6) AS most, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(stddev_pop(s), 6) AS sd, round((list(s ORDER BY s DESC)[1] + list(s ORDER BY s DESC)[2] + list(s ORDER BY s DESC)[3] + list(s ORDER BY s DESC)[4]) / 4, 6) AS topk, count(*) AS patches FROM e GROUP BY a, b"""
)
def patch_stats(spark, d):
    return px.patch_stats(_met(spark, d), 48)


@query(f"{PX}, p AS (SELECT img, y, avg(v) AS m FROM pixels GROUP BY 1, 2), b AS (SELECT img, quantile_cont(m, 0.5) AS base FROM p GROUP BY img), l AS (SELECT p.img, y, y - row_number() OVER (PARTITION BY p.img ORDER BY y) AS k FROM p JOIN b ON p.img = b.img WHERE m < base - 2) SELECT img, ((min(y) + max(y)) // 2)::INTEGER AS middle, count(*)::INTEGER AS width FROM l GROUP BY img, k HAVING count(*) >= 2")
def projection_valleys(spark, d):
    return px.profile_valleys(tb.pixels(spark, d), "y", 2, 2)


@query(f"WITH s AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b, unnest(range(0, 5)) AS scale FROM orders), c AS (SELECT *, (['0.0448', '0.2856', '0.3001', '0.2363', '0.1333'])[scale + 1]::DOUBLE AS w, 0.5e0 + ((a * 7 + scale * 3) % 50) / 100e0 AS c FROM s) SELECT a, b, round(exp(sum(w * ln(c))), 6) AS ms_ssim FROM c GROUP BY a, b")
def ms_ssim(spark, d):
    s = tb.load(spark, d, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("scale"))
    return px.ms_ssim(s.withColumn("c", F.lit(0.5) + ((F.col("a") * 7 + F.col("scale") * 3) % 50) / F.lit(100.0)))


@query(
    f"""WITH {PANEL_SQL}, n AS (SELECT path, panel_id, CASE WHEN panel_id % 3 = 0 THEN 'dir/' || modality || '-' || page::VARCHAR || '_x.png' ELSE path END AS p FROM panel)
SELECT panel_id, TRY_CAST(nullif(regexp_extract(lower(p), 'page[_-]?([0-9]+)', 1), '') AS INTEGER) AS page_number, TRY_CAST(nullif(regexp_extract(p, 'panel([0-9]+)', 1), '') AS INTEGER) AS panel_number,
TRY_CAST(list_filter(string_split(replace(p, '-', '_'), '_'), lambda x: regexp_matches(x, '^[0-9]+$'))[1] AS INTEGER) AS first_number, list_extract(string_split(p, '/'), -1) AS base, regexp_replace(list_extract(string_split(p, '/'), -1), '\\.[^.]*$', '') AS stem, regexp_replace(p, '[^A-Za-z0-9._-]', '_', 'g') AS safe,
CASE WHEN contains(lower(p), 'confocal') OR contains(lower(p), 'fluor') THEN 'confocal' WHEN contains(lower(p), 'ihc') OR contains(lower(p), 'dab') OR contains(lower(p), 'hema') THEN 'bright_field' WHEN contains(lower(p), 'gel') OR contains(lower(p), 'blot') THEN 'gel' WHEN contains(lower(p), 'tem') OR contains(lower(p), 'electron') THEN 'tem' ELSE 'unknown' END AS modality FROM n"""
)
def name_functions(spark, d):
    p = tb.panel(spark, d)
    n = p.select("panel_id", F.when(F.col("panel_id") % 3 == 0, F.concat(F.lit("dir/"), "modality", F.lit("-"), F.col("page").cast("string"), F.lit("_x.png"))).otherwise(F.col("path")).alias("p"))
    return n.select("panel_id", sc.page_number("p").alias("page_number"), sc.panel_number("p").alias("panel_number"), sc.first_number_token("p").alias("first_number"), sc.base_name("p").alias("base"), sc.stem("p").alias("stem"), sc.safe_name("p").alias("safe"), sc.modality_from_path("p").alias("modality"))


@query(f"WITH {PANEL_SQL} SELECT panel_id, round(sqrt(list_inner_product(vec, vec)), 6) AS length, round(list_inner_product(vec, vec) / greatest(sqrt(list_inner_product(vec, vec)), 1e-12) ** 2, 6) AS unit_square FROM panel")
def vector_functions(spark, d):
    v = tb.panel(spark, d).withColumn("u", sc.unit("vec"))
    return v.select("panel_id", F.round(sc.norm("vec"), 6).alias("length"), F.round(sc.dot("u", "u"), 6).alias("unit_square"))


@query()
def kernel_baseline(spark, d):
    found = ud.detected(tb.image_pairs(spark), tb.image_files(spark))
    return tr.detected(found.withColumns({c: F.lit(None) for c in ("cosine", "orb_inliers", "inlier_ratio", "reproj_error", "crop_coverage", "clip_z", "patch_min", "patch_topk")})).select("path_a", "path_b", "hamming", "ssim", "was_detected", "method_triggered")


@query()
def kernel_page_panels(spark, d):
    return ud.page_panels(tb.page_images(spark), tb.SMALL_BOXES)


from . import queries_engine, queries_tuning  # noqa: E402,F401  register their queries
