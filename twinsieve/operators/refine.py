"""Refinements of tiered pairs: the conditional gate, the stricter false-positive filter, same-page context, tile evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import holds, page_number, panel_number
from .tiering import Signals


def ssim_gate(pairs: DataFrame) -> DataFrame:
    """Keeps pairs with a high SSIM or evidence of patches, geometry or hash, and says which."""
    s = Signals()
    patch = F.coalesce(F.col("patch_topk"), F.lit(0.0)) >= 0.72
    orb = s.geometry(30, 0.85, 4.0, 0.30)
    near = s.hamming <= 5
    return pairs.withColumns({"has_patch_evidence": patch, "has_orb_evidence": orb, "has_phash_evidence": near}).where((s.ssim >= 0.75) | patch | orb | near)


def stricter_fp(pairs: DataFrame) -> DataFrame:
    """Flags false positives and moves them one tier down: A to B, B to none. downgrade_reason says why an A became B."""
    s = Signals()
    flagged = (s.cosine >= 0.96) & (s.ssim < 0.60) & (s.hamming > 5) & ~(F.coalesce(F.col("patch_topk"), F.lit(0.0)) >= 0.72) & ~(s.inliers >= 30)
    was_a = flagged & holds(F.col("tier") == "A")
    held = F.col("downgrade_reason") if "downgrade_reason" in pairs.columns else F.lit(None).cast("string")
    return pairs.withColumns(
        {
            "confocal_fp_enhanced": flagged,
            "downgrade_reason": F.when(was_a, "Confocal FP (high CLIP, low SSIM, no evidence)").otherwise(held),
            "tier": F.when(was_a, "B").when(flagged, F.lit(None)).otherwise(F.col("tier")),
        }
    )


def same_page_context(pairs: DataFrame) -> DataFrame:
    """Pages and panel numbers from paths; neighbours on one page without hard evidence go from A to B. An unknown page is no page."""
    s = Signals()
    tiles = F.coalesce(F.col("tile_count"), F.lit(0)) if "tile_count" in pairs.columns else F.lit(0)
    hard = (s.hamming <= 3) | (s.inliers >= 30) | (tiles >= 2)
    pages = pairs.withColumns({"page_a": page_number("path_a", r"page_(\d+)"), "page_b": page_number("path_b", r"page_(\d+)"), "panel_num_a": panel_number("path_a"), "panel_num_b": panel_number("path_b")})
    seen = pages.withColumn("same_page", holds(F.col("page_a") == F.col("page_b"))).withColumn("is_adjacent", F.col("same_page") & holds(F.abs(F.col("panel_num_a") - F.col("panel_num_b")) == 1))
    down = F.col("is_adjacent") & holds(F.col("tier") == "A") & ~hard
    held = F.col("downgrade_reason") if "downgrade_reason" in pairs.columns else F.lit(None).cast("string")
    return seen.withColumns({"downgrade_reason": F.when(down, "Adjacent same-page without hard evidence").otherwise(held), "tier": F.when(down, "B").otherwise(F.col("tier"))})


def refined(pairs: DataFrame) -> DataFrame:
    """Gate, then the stricter filter, then page context."""
    return same_page_context(stricter_fp(ssim_gate(pairs)))


def with_tile_evidence(pairs: DataFrame, evidence: DataFrame, confirm: int = 2) -> DataFrame:
    """Pairs of two confocal panels: enough matching tiles make a B an A, an A without them becomes B unless its path is proof enough.

    Pairs without a tier stay as they are.
    evidence has pair_lo, pair_hi, tile_count, tile_method; a pair without a row has no tiles.
    """
    joined = pairs.drop("tile_count", "tile_method").join(evidence.select("pair_lo", "pair_hi", "tile_count", "tile_method"), ["pair_lo", "pair_hi"], "left")
    n = F.coalesce(F.col("tile_count"), F.lit(0))
    both = holds((F.col("modality_a") == "confocal") & (F.col("modality_b") == "confocal"))
    up = both & (n >= confirm) & holds(F.col("tier") != "A")
    proof = holds(F.col("tier_path").isin("Exact", "ORB", "Confocal-DeepVerify", "IHC-DeepVerify"))
    down = both & (n < confirm) & holds(F.col("tier") == "A") & ~proof
    return joined.withColumns(
        {
            "tile_count": n.cast("long"),
            "tier_path": F.when(up, F.concat(F.lit("Multi-Tile-Confirmed-"), n.cast("string"))).when(down, F.concat(F.lit("Confocal-NeedsTileEvidence-"), n.cast("string"))).otherwise(F.col("tier_path")),
            "tier": F.when(up, "A").when(down, "B").otherwise(F.col("tier")),
        }
    )
