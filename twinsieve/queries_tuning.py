"""Queries of threshold search and calibration, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import tuning
from .plans import tables as tb
from .plans.tables import EVIDENCE_SQL
from .registry import query

FLOOR = 0.8


def rated(spark, d):
    """Evidence with a label: a high sum of cosine and SSIM, or many inliers."""
    e = tb.evidence(spark, d).withColumn("should_detect", F.coalesce(F.col("cosine") + F.col("ssim") >= 1.7505, F.lit(False)) | F.coalesce(F.col("orb_inliers") >= 27, F.lit(False)))
    return e.select(F.col("pair_lo").alias("id"), "should_detect", F.col("should_detect").cast("int").alias("label"), "cosine", "ssim", "orb_inliers", "hamming")


RATED = f"{EVIDENCE_SQL}, rated AS (SELECT pair_lo AS id, coalesce(cosine + ssim >= 1.7505e0, false) OR coalesce(orb_inliers >= 27, false) AS y, coalesce(cosine, 0) AS cosine, coalesce(ssim, 0) AS ssim, coalesce(orb_inliers, 0) AS n FROM evidence)"


def _grid(grid: tuning.Grid) -> str:
    cells = [(c, s, n) for c in grid["cosine"] for s in grid["ssim"] for n in grid["orb_inliers"]]
    return f"(SELECT * FROM (VALUES {', '.join(f'({k}, {c}e0, {s}e0, {n})' for k, (c, s, n) in enumerate(cells))}) AS g(ord, cosine_t, ssim_t, inliers_t))"


HIT = "(cosine >= cosine_t AND ssim >= ssim_t) OR n >= inliers_t"
R = "coalesce({} / nullif({}, 0)::DOUBLE, 0)"


@query(
    f"""WITH {RATED}, f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id::VARCHAR), id) - 1) % 5 AS fold FROM rated), grid AS {_grid(tuning.FOLDED)},
c AS (SELECT fold, ord, cosine_t, ssim_t, inliers_t, count(*) FILTER (y AND ({HIT})) AS tp, count(*) FILTER (NOT y AND ({HIT})) AS fp, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS neg FROM f, grid GROUP BY ALL),
t AS (SELECT *, sum(tp) OVER w - tp AS ttp, sum(fp) OVER w - fp AS tfp, sum(p) OVER w - p AS tpos FROM c WINDOW w AS (PARTITION BY ord)),
r AS (SELECT *, CASE WHEN {R.format("ttp", "ttp + tfp")} >= {FLOOR}e0 THEN {R.format("ttp", "tpos")} ELSE 0 END AS score FROM t),
best AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, ord) AS k, max(score) OVER (PARTITION BY fold) AS top FROM r),
won AS (SELECT fold, cosine_t, ssim_t, inliers_t, {R.format("tp", "tp + fp")} AS precision, {R.format("tp", "p")} AS recall, {R.format("fp", "neg")} AS fpr FROM best WHERE (top > 0 AND k = 1) OR (top = 0 AND cosine_t = 0.96e0 AND ssim_t = 0.9e0 AND inliers_t = 30))
SELECT fold::INTEGER AS fold, cosine_t::DOUBLE AS cosine_t, ssim_t::DOUBLE AS ssim_t, inliers_t::INTEGER AS inliers_t, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, row_number() OVER (ORDER BY recall DESC, fold) = 1 AS chosen,
  round(avg(recall) OVER (), 6) AS recall_mean, round(stddev_pop(recall) OVER (), 6) AS recall_sd, round(avg(precision) OVER (), 6) AS precision_mean, round(stddev_pop(precision) OVER (), 6) AS precision_sd, round(avg(fpr) OVER (), 6) AS fpr_mean, round(stddev_pop(fpr) OVER (), 6) AS fpr_sd FROM won"""
)
def fold_search(spark, d):
    found = tuning.fold_search(rated(spark, d), floor=FLOOR)
    return found.withColumns({c: F.round(c, 6) for c in found.columns if dict(found.dtypes)[c] == "double" and not c.endswith("_t")})


def _pass(grid: str, name: str) -> str:
    return f"""{name}_c AS (SELECT ord, cosine_t, ssim_t, inliers_t, count(*) FILTER (y AND ({HIT})) AS tp, count(*) FILTER (NOT y AND ({HIT})) AS fp, count(*) FILTER (y) AS p FROM rated, {grid} GROUP BY ALL),
{name} AS (SELECT '{name}' AS pass, cosine_t, ssim_t, inliers_t, tp, fp, tp / (tp + fp)::DOUBLE AS precision, tp / p::DOUBLE AS recall FROM {name}_c WHERE tp > 0 AND tp / (tp + fp)::DOUBLE >= {FLOOR}e0 ORDER BY recall DESC, ord LIMIT 1)"""


@query(
    f"""WITH {RATED}, grid AS {_grid(tuning.COARSE)}, {_pass("grid", "coarse")},
near AS (SELECT round(1000 * cosine_t)::INTEGER AS c, round(1000 * ssim_t)::INTEGER AS s, inliers_t AS i FROM coarse),
finer AS (SELECT row_number() OVER (ORDER BY ck, sk, inl) AS ord, ck / 1000e0 AS cosine_t, sk / 1000e0 AS ssim_t, inl AS inliers_t FROM (SELECT unnest(range(greatest(900, c - 10), least(995, c + 10), 2)) AS ck FROM near),
  (SELECT unnest(range(greatest(850, s - 20), least(960, s + 20), 5)) AS sk FROM near), (SELECT DISTINCT unnest([greatest(0, i - 10), i, i + 10]) AS inl FROM near)), {_pass("finer", "fine")}
SELECT pass, cosine_t::DOUBLE AS cosine_t, ssim_t::DOUBLE AS ssim_t, inliers_t::INTEGER AS inliers_t, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM coarse UNION ALL SELECT pass, cosine_t, ssim_t, inliers_t::INTEGER, tp, fp, round(precision, 6), round(recall, 6) FROM fine"""
)
def coarse_to_fine(spark, d):
    found = tuning.coarse_to_fine(rated(spark, d), floor=FLOOR)
    return found.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query()
def tuned_pipeline(spark, d):
    return tuning.tuned(rated(spark, d), floor=FLOOR)[1]


@query()
def calibration_loss(spark, d):
    """Log loss before and after each kind of calibration."""
    rows = tb.judged(spark, d).select("label", "score")
    out = None
    for method in ("platt", "isotonic"):
        after = tuning.evaluate.log_loss(tuning.Calibrator(method=method).fit(rows).transform(rows).select("label", F.col("calibrated").alias("score")))
        row = tuning.evaluate.log_loss(rows).select(F.lit(method).alias("method"), F.col("log_loss").alias("before"), "n").join(after.select(F.col("log_loss").alias("after")), F.lit(True))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def pair_classifier(spark, d):
    e = tb.evidence(spark, d)
    model = tuning.fitted_classifier(e.withColumn("label", (F.coalesce("hamming", F.lit(99)) <= 5).cast("int")))
    return tuning.classified(e, model).select("pair_lo", "pair_hi", "classifier_score", "classifier_hit")
