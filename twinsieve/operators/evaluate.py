"""Evaluation of reports: policy, scores, confusion, curves, threshold search. Rows in, one aggregate out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import holds
from . import ordering
from .tiering import Signals


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for nothing."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def fp_proxy() -> Column:
    low = holds(F.col("ssim") < 0.60)
    far = F.col("hamming").isNull() | (F.col("hamming") > 8)
    return holds(F.col("confocal_fp")) | (low & far & (F.coalesce(F.col("orb_inliers"), F.lit(0)) < 15))


def anchor() -> Column:
    s = Signals()
    return holds(F.col("hamming") <= 3) | ((s.inliers >= 40) & (s.ratio >= 0.35) & (s.error <= 4.0))


def policy(pairs: DataFrame) -> DataFrame:
    """Rates and pass marks of a report (page_a, page_b, tier, signals); anchors that are missing pass."""
    n, a_, anchors = F.count("*"), holds(F.col("tier") == "A"), F.count_if(anchor())
    hit = F.count_if(anchor() & a_)
    got = pairs.agg(
        n.alias("total_pairs"), anchors.alias("anchors"), hit.alias("anchors_a"), F.count_if(a_).alias("tier_a"), F.count_if(holds(F.col("tier") == "B")).alias("tier_b"), F.count_if(fp_proxy()).alias("fp_proxy"),
        F.count_if(~F.col("page_a").eqNullSafe(F.col("page_b"))).alias("cross_page"),
    )
    rate = lambda c: share(F.col(c), F.col("total_pairs"))
    precision = F.col("anchors_a") / F.nullif(F.col("anchors").cast("double"), F.lit(0.0))
    passes = [rate("fp_proxy") <= 0.35, rate("cross_page") >= 0.40, rate("tier_a") >= 0.05, F.coalesce(precision, F.lit(1.0)) >= 0.90]
    return got.select(
        "total_pairs", "anchors", "anchors_a", "tier_a", "tier_b", "fp_proxy", F.round(rate("fp_proxy"), 3).alias("fp_rate"), F.round(rate("cross_page"), 3).alias("cross_page_ratio"), F.round(rate("tier_a"), 3).alias("tier_a_ratio"),
        F.round(precision, 3).alias("anchor_precision"), passes[0].alias("pass_fp"), passes[1].alias("pass_cross_page"), passes[2].alias("pass_tier_a"), passes[3].alias("pass_anchor"), (passes[0] & passes[1] & passes[2] & passes[3]).alias("overall_pass"),
    )


def suggestions(pairs: DataFrame, cosine: float = 0.96, ssim: float = 0.90, hamming: int = 4) -> DataFrame:
    """Thresholds just over the 95th percentile of the suspected false positives; null with fewer than ten of them."""
    wrong = pairs.where(fp_proxy())
    n, m = wrong.agg(F.count("*"), F.count("ssim")).first()
    missed = pairs.where(anchor() & (F.coalesce(F.col("hamming"), F.lit(999)) > hamming)).limit(1).count()
    pc = ordering.quantile(wrong.select(F.coalesce("cosine", F.lit(0.0)).alias("x")), "x", 0.95) if n >= 10 else None
    ps = ordering.quantile(wrong, "ssim", 0.95) if m >= 10 else None
    values = [None if v is None else max(base, v + more) for v, base, more in ((pc, cosine, 0.003), (ps, ssim, 0.01))]
    named = [F.round(F.lit(v).cast("double"), 3).alias(c) for v, c in zip(values, ("sim_threshold", "ssim_threshold"))]
    return pairs.sparkSession.range(1).select(*named, F.lit(max(hamming, 4) if missed else None).cast("int").alias("phash_max_dist"))


def run_score(pairs: DataFrame, top: int = 6) -> DataFrame:
    """Totals, cross-page share, suspected false positives, and the share of tier A among the best by cosine."""
    s, n, a = Signals(), F.count("*"), holds(F.col("tier") == "A")
    wrong = F.count_if((s.cosine >= 0.96) & (s.ssim < 0.60) & (s.hamming >= 10))
    whole = F.greatest(n, F.lit(1)).cast("double")
    all_ = pairs.agg(
        n.alias("pairs_total"), F.count_if(a).alias("tier_a"), F.count_if(holds(F.col("tier") == "B")).alias("tier_b"),
        F.round(100.0 * F.count_if(~F.col("page_a").eqNullSafe(F.col("page_b"))) / whole, 6).alias("cross_page_pct"), wrong.alias("fp_proxy_count"), F.round(100.0 * wrong / whole, 6).alias("fp_proxy_pct"),
    )
    best = pairs.orderBy(F.col("cosine").desc_nulls_last(), "pair_lo", "pair_hi").limit(top)
    return all_.join(best.agg(F.round(100.0 * F.count_if(a) / F.greatest(n, F.lit(1)).cast("double"), 6).alias("anchor_precision")), F.lit(True))


def focus_pages(pairs: DataFrame, pages: list[int]) -> DataFrame:
    """page, pairs, tier_a of each of these pages, for pairs with either side on it."""
    sides = pairs.select("tier", F.explode(F.array_distinct(F.array("page_a", "page_b"))).alias("page")).where(F.col("page").isin(pages))
    return sides.groupBy("page").agg(F.count("*").alias("pairs"), F.count_if(holds(F.col("tier") == "A")).alias("tier_a"))


def modality_kpi(pairs: DataFrame) -> DataFrame:
    """Counts and shares by the two sides' common modality; mixed pairs are left out."""
    n = F.count("*")
    a, b = F.count_if(holds(F.col("tier") == "A")), F.count_if(holds(F.col("tier") == "B"))
    s = Signals()
    ran = F.count("deep_ssim")
    done = holds((F.col("deep_ssim") >= 0.90) & (F.col("deep_ncc") >= 0.985))
    return (
        pairs.where("modality_a = modality_b").groupBy(F.col("modality_a").alias("modality")).agg(
            n.alias("pairs"), a.alias("tier_a"), b.alias("tier_b"), F.round(100.0 * a / n, 6).alias("tier_a_pct"), F.count_if((s.cosine >= 0.96) & (s.ssim < 0.60)).alias("fp_proxy"), F.count_if(holds(F.col("confocal_fp"))).alias("flagged"),
            ran.alias("deep_ran"), F.count_if(done).alias("deep_passed"), F.round(F.avg(F.when(F.col("deep_ssim") >= 0.90, F.col("deep_ssim"))), 6).alias("avg_deep_ssim"),
        )
    )


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and rates of rows (should_detect, was_detected), 0 where nothing could be counted; by groups or as a whole."""
    y, p = holds(F.col("should_detect")), holds(F.col("was_detected"))
    counts = rows.groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    c = {x: F.col(x) for x in ("tp", "fp", "fn", "tn")}
    precision, recall = share(c["tp"], c["tp"] + c["fp"]), share(c["tp"], c["tp"] + c["fn"])
    r = lambda x: F.round(x, 6)
    return counts.select(
        *(by or []), "tp", "fp", "fn", "tn", r(precision).alias("precision"), r(recall).alias("recall"), r(share(2 * precision * recall, precision + recall)).alias("f1"), r(share(c["fp"], c["fp"] + c["tn"])).alias("fpr"),
        r(share(c["tp"] + c["tn"], c["tp"] + c["fp"] + c["fn"] + c["tn"])).alias("accuracy"),
    )


def _curve(rows: DataFrame, parts: int = 64) -> DataFrame:
    """threshold, p and n (labels 1 and 0 at it), tp, fp, all (labels 1) at each distinct score of rows (label 0 or 1, score).

    Counts per score come first. Running sums are taken within ranges of scores, whose cuts are quantiles, and each range
    adds the totals of those above: no task has all scores.
    """
    at = rows.groupBy("score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n"))
    cuts = at.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    above = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    spread = at.withColumn("part", F.size(F.filter(above, lambda c: c > F.col("score"))))
    sums = spread.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("op"), F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("on"), F.sum("sp").over(Window.partitionBy()).alias("all"))
    w = Window.partitionBy("part").orderBy(F.desc("score"))
    run = spread.withColumns({"cp": F.sum("p").over(w), "cn": F.sum("n").over(w)}).join(F.broadcast(offsets), "part")
    return run.select(F.col("score").alias("threshold"), "p", "n", (F.col("cp") + F.col("op")).alias("tp"), (F.col("cn") + F.col("on")).alias("fp"), "all")


def pr_curve(rows: DataFrame) -> DataFrame:
    """threshold, tp, fp, precision, recall at each distinct score of rows (label 0 or 1, score)."""
    tp, fp = F.col("tp"), F.col("fp")
    return _curve(rows).select("threshold", "tp", "fp", F.round(share(tp, tp + fp), 6).alias("precision"), F.round(share(tp, F.col("all")), 6).alias("recall"))


def average_precision(rows: DataFrame) -> DataFrame:
    """The sum of precision times the step in recall over all thresholds, and the area under the curve by trapezoids, from precision 1 at no recall."""
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    now = share(tp, tp + fp)
    last = F.when(tp + fp == p + n, 1.0).otherwise(share(tp - p, tp - p + fp - n))
    step = share(p, F.col("all"))
    return _curve(rows).agg(F.round(F.sum(step * now), 6).alias("average_precision"), F.round(F.sum(step * (now + last) / 2), 6).alias("pr_auc"))


def recall_at_precision(curve: DataFrame, floor: float) -> DataFrame:
    """The best recall with precision of at least the floor, and its threshold, the higher of equals; no row passes: nulls."""
    best = F.max(F.struct("recall", "threshold"))
    return curve.where(F.col("precision") >= floor).agg(best["recall"].alias("recall"), best["threshold"].alias("threshold"))


def fpr_at(rows: DataFrame, threshold: float) -> DataFrame:
    wrong = F.count_if((F.col("label") == 0) & (F.col("score") >= threshold))
    return rows.agg(wrong.alias("fp"), F.count_if(F.col("label") == 0).alias("negatives"), F.round(share(wrong, F.count_if(F.col("label") == 0)), 6).alias("fpr"))


def grid_search(rows: DataFrame, ssim: list[float], hamming: list[int], floor: float = 0.95) -> DataFrame:
    """The confusion of each (ssim, hamming) of a grid over rows (should_detect, ssim, hamming), and which wins: best recall with
    precision of at least the floor, the first in grid order among equals.

    One pass: each row adds to the cells that detect it; the grid is small, the rows aren't joined with each other.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(s).alias("ssim_t"), F.lit(h).alias("hamming_t")) for k, (s, h) in enumerate((s, h) for s in ssim for h in hamming)])
    spread = rows.select("should_detect", "ssim", "hamming", F.explode(cells).alias("g")).select("should_detect", "g.*", (holds(F.col("ssim") >= F.col("g.ssim_t")) | holds(F.col("hamming") <= F.col("g.hamming_t"))).alias("was_detected"))
    found = confusion(spread, ["ord", "ssim_t", "hamming_t"])
    rank = F.row_number().over(Window.orderBy(F.when(F.col("precision") >= floor, 0).otherwise(1), F.desc("recall"), "ord"))
    return found.withColumn("rank", rank)


def log_loss(rows: DataFrame, eps: float = 1e-6) -> DataFrame:
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    return rows.agg(F.round(-F.avg(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p)), 6).alias("log_loss"), F.count("*").alias("n"))


def ab_stats(rows: DataFrame) -> DataFrame:
    """method, n, mean, population deviation, least of rows (method, value)."""
    return rows.groupBy("method").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.min("value").alias("least"))


def sweep_rank(runs: DataFrame, most: int = 20) -> DataFrame:
    """Runs (run, passes, fp_pct) by passes from high, then false positives from low."""
    return runs.orderBy(F.desc("passes"), "fp_pct", "run").limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("passes"), "fp_pct", "run")))


def k_folds(rows: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """fold of each row (id, label): each class is dealt evenly in the order of an md5 of seed and id.

    Places are counted within 256 ranges of the md5 and each range adds the sizes of those before it, so no task has a whole class.
    """
    keyed = rows.withColumn("_k", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))).withColumn("_r", F.substring("_k", 1, 2))
    before = Window.partitionBy("_l").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy(F.col("label").alias("_l"), F.col("_r").alias("_q")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_l", "_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("label", "_r").orderBy("_k", "id"))
    dealt = keyed.withColumn("_p", place).join(offsets, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_r") == F.col("_q")))
    return dealt.select(*rows.columns, F.pmod(F.col("_p") + F.col("_o") - 1, F.lit(folds)).cast("int").alias("fold"))


def stage_metrics(stages: DataFrame, slow: float = 5.0) -> DataFrame:
    """reduction_pct, throughput and whether a stage (stage, seconds, n_in, n_out) is a bottleneck."""
    return stages.select(
        "stage", "seconds", "n_in", "n_out", F.round(100.0 * (1 - share(F.col("n_out"), F.col("n_in"))), 6).alias("reduction_pct"), F.round(share(F.col("n_in"), F.col("seconds")), 6).alias("throughput"), (F.col("seconds") >= slow).alias("bottleneck")
    )


def last_runs(history: DataFrame, most: int = 50) -> DataFrame:
    """The latest runs (run, ts): each task keeps as many, and these meet in one."""
    return history.orderBy(F.desc("ts"), "run").limit(most)


def grades(metrics: DataFrame) -> DataFrame:
    """EXCELLENT, GOOD, ACCEPTABLE or NEEDS_IMPROVEMENT of (fpr, recall, precision)."""
    f, r, p = F.col("fpr"), F.col("recall"), F.col("precision")
    grade = F.when((f <= 0.005) & (r >= 0.90) & (p >= 0.95), "EXCELLENT").when((f <= 0.01) & (r >= 0.80) & (p >= 0.90), "GOOD").when((f <= 0.05) & (r >= 0.70), "ACCEPTABLE").otherwise("NEEDS_IMPROVEMENT")
    return metrics.withColumn("grade", grade)


def validated(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ground truth (pair_id, should_detect, ...) with predictions (pair_id, was_detected, ...); a pair without one was not detected."""
    return truth.join(predictions.drop("should_detect"), "pair_id", "left").withColumn("was_detected", F.coalesce("was_detected", F.lit(False)))


def run_detector(pairs: DataFrame, detector) -> DataFrame:
    """pairs with the columns that a detector adds: a function of a DataFrame."""
    return detector(pairs)


def benchmark(runs: DataFrame) -> DataFrame:
    """Mean, least and most seconds of the runs (preset, seconds) of each preset."""
    return runs.groupBy("preset").agg(F.count("*").alias("runs"), F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"))


def value_shares(rows: DataFrame, name: str, confidence: str) -> DataFrame:
    """Count and mean confidence of each value."""
    return rows.groupBy(name).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("confidence"))


def best_share(matches: DataFrame, part: float = 0.15) -> DataFrame:
    """The nearest matches (pair, q, t, d) of each pair: the integer part of this share of them."""
    w = Window.partitionBy("pair")
    ranked = matches.withColumns({"_r": F.row_number().over(w.orderBy("d", "q", "t")), "_n": F.count("*").over(w)})
    return ranked.where(F.col("_r") <= F.floor(F.col("_n") * part)).drop("_r", "_n")


def two_signal_grid(rows: DataFrame, cosine: list[float], ssim: list[float], inliers: list[int], floor: float = 0.95) -> DataFrame:
    """The grid over (cosine and ssim) or inliers, ranked as grid_search is."""
    cells = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(c).alias("cosine_t"), F.lit(s).alias("ssim_t"), F.lit(n).alias("inliers_t")) for k, (c, s, n) in enumerate((c, s, n) for c in cosine for s in ssim for n in inliers)])
    hit = (holds(F.col("cosine") >= F.col("g.cosine_t")) & holds(F.col("ssim") >= F.col("g.ssim_t"))) | holds(F.col("orb_inliers") >= F.col("g.inliers_t"))
    spread = rows.select("should_detect", "cosine", "ssim", "orb_inliers", F.explode(cells).alias("g")).select("should_detect", "g.*", hit.alias("was_detected"))
    found = confusion(spread, ["ord", "cosine_t", "ssim_t", "inliers_t"])
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.when(F.col("precision") >= floor, 0).otherwise(1), F.desc("recall"), "ord")))


def readiness(metrics: DataFrame) -> DataFrame:
    """Whether a detector (fpr, recall, precision) may go into production, and what fails."""
    checks = {"fpr": F.col("fpr") <= 0.005, "recall": F.col("recall") >= 0.90, "precision": F.col("precision") >= 0.95}
    wrong = F.concat_ws(",", *[F.when(~c, F.lit(n)) for n, c in checks.items()])
    return metrics.withColumns({"failed": wrong, "ready": wrong == ""})


def validation_report(rows: DataFrame) -> DataFrame:
    """confusion() of rows (should_detect, was_detected, category) with the number of pairs, as a whole ("overall") and by category."""
    whole = confusion(rows).select(F.lit("overall").alias("category"), "*")
    both = whole.unionByName(confusion(rows, ["category"]))
    return both.select("category", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("pairs"), *[c for c in both.columns if c != "category"])


def ab_report(rows: DataFrame, baseline: str, variant: str) -> DataFrame:
    """One row: numbers and means of two methods of rows (method, value), the variant's mean less the baseline's, and that in percent of it (0 where it is not above 0)."""
    of = lambda m: F.when(F.col("method") == m, F.col("value"))
    got = rows.agg(F.count(of(baseline)).alias("n_baseline"), F.count(of(variant)).alias("n_variant"), F.avg(of(baseline)).alias("a"), F.avg(of(variant)).alias("b"))
    delta = F.col("b") - F.col("a")
    return got.select(
        F.lit(baseline).alias("baseline"), F.lit(variant).alias("variant"), "n_baseline", "n_variant", F.round("a", 6).alias("mean_baseline"), F.round("b", 6).alias("mean_variant"), F.round(delta, 6).alias("delta"),
        F.round(F.when(F.col("a") > 0, delta / F.col("a") * 100).otherwise(0.0), 6).alias("pct_change"),
    )
