"""Rules that put a pair into tier A, tier B or none. Missing signals are read as worthless here and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import MODALITY_TIERS, PACKAGE_TIERS, PACKAGE_UNKNOWN, Tiers
from ..functions.scalars import holds, title_label


class Signals:
    """The signals of a pair with the values that stand for missing ones."""

    def __init__(self) -> None:
        c = lambda name, missing: F.coalesce(F.col(name).cast("double"), F.lit(float(missing)))
        self.cosine, self.ssim, self.hamming = c("cosine", 0), c("ssim", 0), c("hamming", 999)
        self.inliers, self.ratio, self.error, self.coverage = c("orb_inliers", 0), c("inlier_ratio", 0), c("reproj_error", 999), c("crop_coverage", 0)
        self.z, self.patch_min = c("clip_z", 0), c("patch_min", 0)
        #: a missing patch score falls back to the smallest patch, then to SSIM, pair by pair
        self.patch = F.coalesce(F.col("patch_topk").cast("double"), F.col("patch_min").cast("double"), self.ssim)

    def geometry(self, inliers: float, coverage: float, error: float, ratio: float = 0.0) -> Column:
        return (self.inliers >= inliers) & (self.ratio >= ratio) & (self.coverage >= coverage) & (self.error <= error)

    def summed(self, cosine: float, ssim: float, both: float) -> Column:
        return (self.cosine >= cosine) & (self.ssim >= ssim) & (self.cosine + self.ssim >= both)


def _strict(s: Signals, t: Tiers) -> Column:
    out = (s.cosine >= t.a_cosine) & (s.ssim >= t.a_ssim)
    out = out & (s.z >= t.a_z) if t.require_z else out
    return out & (s.patch_min >= t.a_patch_min) if t.require_patch_min else out


def _relaxed_orb(s: Signals, t: Tiers) -> Column:
    if not t.orb_relax:
        return F.lit(False)
    return (s.cosine >= t.relax_cosine) & (s.patch >= t.relax_patch) & s.geometry(t.relax_inliers, t.relax_coverage, t.relax_error, t.relax_ratio)


def confocal_fp(t: Tiers = Tiers()) -> Column:
    """High cosine, low SSIM, far hash, and no support from patches or geometry."""
    s = Signals()
    supported = (s.patch >= 0.72) | s.geometry(20, 0.65, 5.0)
    return (s.cosine >= t.fp_cosine) & (s.ssim < t.fp_ssim) & (s.hamming > t.fp_hamming) & ~supported


def deep_verified(t: Tiers = Tiers()) -> Column:
    """From deep_ssim, deep_ncc, deep_hamming where a pair was verified."""
    return holds((F.col("deep_ssim") >= t.deep_ssim) & (F.col("deep_ncc") >= t.deep_ncc)) | holds(F.col("deep_hamming") <= t.deep_hamming)


def ihc_verified(t: Tiers = Tiers()) -> Column:
    return holds((F.col("ihc_ssim") >= t.ihc_ssim) & (F.col("ihc_ncc") >= t.ihc_ncc)) | holds(F.col("ihc_hamming") <= t.ihc_hamming)


def _paths(s: Signals, t: Tiers) -> dict[str, Column]:
    """The paths by hash, cosine, SSIM and geometry alone, the first of which that holds names the pair."""
    return {
        "Exact": s.hamming <= t.a_hamming,
        "Strict": _strict(s, t),
        "ORB": s.geometry(t.orb_inliers, t.orb_coverage, t.orb_error, t.orb_ratio),
        "Relaxed": s.summed(t.relaxed_cosine, t.relaxed_ssim, t.relaxed_sum),
        "Western": s.summed(t.western_cosine, t.western_ssim, t.western_sum),
    }


def _first(paths: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in paths.items()])


def tiered_plain(pairs: DataFrame, t: Tiers = Tiers()) -> DataFrame:
    """tier and tier_path by those paths and no other rule: no pair is flagged, and none is B."""
    first = _first(_paths(Signals(), t))
    return pairs.withColumns({"confocal_fp": F.lit(False), "tier": F.when(first.isNotNull(), "A"), "tier_path": first})


def tiered(pairs: DataFrame, t: Tiers = Tiers()) -> DataFrame:
    """Universal tiering: confocal_fp, tier, tier_path. The first path that holds names the pair.

    Verified candidates need deep_* and ihc_* columns; without them no pair is verified.
    """
    s = Signals()
    flagged = confocal_fp(t)
    deep = flagged & deep_verified(t) if "deep_ssim" in pairs.columns else F.lit(False)
    ihc = (s.cosine >= t.fp_cosine) & (s.ssim < t.ihc_pre_ssim) & ihc_verified(t) if "ihc_ssim" in pairs.columns else F.lit(False)
    wrong = flagged & ~deep
    paths = _paths(s, t) | {
        "ORB-Relaxed": _relaxed_orb(s, t),
        "Confocal-A": (s.cosine >= 0.965) & ((s.patch >= 0.78) | s.geometry(25, 0.70, 5.0) | (s.hamming <= 5)),
        "Confocal-DeepVerify": deep,
        "IHC-DeepVerify": ihc,
    }
    first = _first(paths)
    a = first.isNotNull() & ~wrong
    confocal_b = (s.cosine >= 0.955) & ((s.patch >= 0.72) | s.geometry(20, 0.65, 6.0) | (s.hamming <= 6))
    b = (
        s.hamming.between(t.b_hamming_min, t.b_hamming_max)
        | ((s.cosine >= t.b_cosine_min) & (s.cosine < t.b_cosine_max) & (s.ssim >= t.b_ssim_min) & (s.ssim < t.b_ssim_max))
        | confocal_b
        | (wrong & (s.cosine >= t.fp_to_b_cosine))
    )
    return pairs.withColumns({"confocal_fp": flagged, "tier": F.when(a, "A").when(b, "B"), "tier_path": F.when(a, first).when(confocal_b, "Confocal-B")})


def tiered_package(pairs: DataFrame, t: Tiers = PACKAGE_TIERS) -> DataFrame:
    """The package dialect: flagged pairs stay in A, the last path that holds names the pair, B bands are closed."""
    s = Signals()
    strict = _strict(s, t)
    paths = {
        "Exact (pHash)": s.hamming <= t.a_hamming,
        "Strict (CLIP+SSIM)": strict,
        "ORB-RANSAC": s.geometry(t.orb_inliers, t.orb_coverage, t.orb_error, t.orb_ratio),
        "Relaxed": s.summed(t.relaxed_cosine, t.relaxed_ssim, t.relaxed_sum),
        "Western Blot": s.summed(t.western_cosine, t.western_ssim, t.western_sum),
        "ORB-Relaxed": _relaxed_orb(s, t),
    }
    last = F.coalesce(*[F.when(c, F.lit(name)) for name, c in reversed(paths.items())])
    by_hash = s.hamming.between(t.b_hamming_min, t.b_hamming_max)
    by_cosine = s.cosine.between(t.b_cosine_min, t.b_cosine_max)
    b = by_hash | (by_cosine & s.ssim.between(t.b_ssim_min, t.b_ssim_max))
    path = F.when(last.isNotNull(), last).when(b & by_cosine, "Borderline (CLIP+SSIM)").when(b & by_hash, "Borderline (pHash)")
    return pairs.withColumns({"confocal_fp": confocal_fp(t), "tier": F.when(last.isNotNull(), "A").when(b, "B"), "tier_path": path})


def _rules(pairs: DataFrame, table: tuple) -> DataFrame:
    """pairs with the row of the modality table that both sides share, or the one of unknown."""
    names = "m string, ac double, a_s double, ab double, ah int, bc double, bs double, bb double, bh int, fc double, fs double"
    rules = F.broadcast(pairs.sparkSession.createDataFrame(list(table), names))
    shared = F.when(F.coalesce(F.col("modality_a") == F.col("modality_b"), F.lit(False)) & F.col("modality_a").isin([r[0] for r in table]), F.col("modality_a")).otherwise("unknown")
    return pairs.withColumn("_m", shared).join(rules, F.col("_m") == F.col("m"))


def tiered_by_modality(pairs: DataFrame, table: tuple = MODALITY_TIERS) -> DataFrame:
    """Tiers by the two sides' common modality; mixed and unnamed pairs use the rules of unknown."""
    s = Signals()
    near = s.hamming <= F.col("ah")
    wrong = holds((s.cosine >= F.col("fc")) & (s.ssim < F.col("fs")))
    a = (near | ((s.cosine >= F.col("ac")) & (s.ssim >= F.col("a_s")) & (s.cosine + s.ssim >= F.col("ab")))) & ~wrong
    b = s.hamming.between(F.col("ah"), F.col("bh")) | ((s.cosine >= F.col("bc")) & (s.ssim >= F.col("bs")) & (s.cosine + s.ssim >= F.col("bb")))
    path = F.when(a & near, "Exact").when(a, F.concat(F.coalesce(F.col("modality_a"), F.lit("unknown")), F.lit("_specific")))
    return _rules(pairs, table).select(*pairs.columns, wrong.alias("confocal_fp"), F.when(a, "A").when(b, "B").alias("tier"), path.alias("tier_path"))


def tiered_by_modality_package(pairs: DataFrame, table: tuple = (*MODALITY_TIERS[:-1], PACKAGE_UNKNOWN)) -> DataFrame:
    """The package dialect: exact hashes first, then the modality's rules, then rules for unknown and mixed pairs."""
    s = Signals()
    exact = s.hamming <= 2
    ruled = F.coalesce(F.col("modality_a") == F.col("modality_b"), F.lit(False)) & F.col("modality_a").isin([r[0] for r in table])
    a = ruled & (((s.cosine >= F.col("ac")) & (s.ssim >= F.col("a_s")) & (s.cosine + s.ssim >= F.col("ab"))) | (s.hamming <= F.col("ah")))
    b = ruled & (s.cosine >= F.col("bc")) & (s.ssim >= F.col("bs"))
    wrong = ruled & (F.col("modality_a") == "confocal") & holds((s.cosine >= F.col("fc")) & (s.ssim < F.col("fs")))
    open_ = holds(F.col("modality_a") == "unknown") | holds(F.col("modality_b") == "unknown") | ~F.coalesce(F.col("modality_a") == F.col("modality_b"), F.lit(False))
    wide_a = open_ & s.summed(0.95, 0.65, 1.65)
    wide_b = (s.cosine >= 0.92) & (s.ssim >= 0.40)
    label = F.initcap(F.replace(F.col("modality_a"), F.lit("_"), F.lit(" ")))
    tier = F.when(exact | a, "A").when(b, "B").when(wide_a, "A").when(wide_b, "B")
    path = (
        F.when(exact, "Exact (pHash)").when(a, title_label("modality_a")).when(b, F.concat(label, F.lit("-Borderline"))).when(wide_a, "Universal-Fallback").when(wide_b, "Universal-Borderline").when(wrong, "Confocal-FP-Filtered")
    )
    return _rules(pairs, table).select(*pairs.columns, tier.alias("tier"), path.alias("tier_path"))


def detected(pairs: DataFrame, hamming: int = 4, ssim: float = 0.95) -> DataFrame:
    """The baseline detector: was_detected and the method that found the pair."""
    s = Signals()
    by_hash, by_ssim = s.hamming <= hamming, s.ssim >= ssim
    return pairs.withColumns({"was_detected": by_hash | by_ssim, "method_triggered": F.when(by_hash, "pHash").when(by_ssim, "SSIM")})


def path_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("tier", "tier_path").agg(F.count("*").alias("n"))


def tier_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.coalesce("tier", F.lit("Other")).alias("tier")).agg(F.count("*").alias("n"))


def of_tiers(pairs: DataFrame, tiers: list[str]) -> DataFrame:
    """Pairs of these tiers; Other is no tier."""
    return pairs.where(F.coalesce("tier", F.lit("Other")).isin(tiers))
