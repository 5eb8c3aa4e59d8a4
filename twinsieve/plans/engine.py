"""The whole run: candidates from vectors and hashes, geometry where it is worth it, evidence, tiers, refinements, tiles."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..operators import ann, evaluate, hashing, merge, refine, similarity, tiering, tiles, tuning
from ..session import beside
from ..sources import append_log, cache, files
from .metrics import Metrics

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Result:
    """Tables of a run, and what its stages counted."""

    pairs: DataFrame
    config: Config = field(default_factory=Config)
    metrics: Metrics | None = None

    def tier_a(self) -> DataFrame:
        return self.pairs.where("tier = 'A'")

    def tier_b(self) -> DataFrame:
        return self.pairs.where("tier = 'B'")

    def counts(self) -> DataFrame:
        return tiering.tier_counts(self.pairs)

    def score(self) -> DataFrame:
        return evaluate.run_score(self.pairs)

    def ordered(self) -> DataFrame:
        """Tier A, then B, then the others, each by cosine from high."""
        return merge.tier_order(self.pairs)

    def save(self, path: str) -> None:
        """The report as TSV, and beside it the stages' metrics where the run was measured."""
        files.write_tsv(files.report(self.pairs), path)
        if self.metrics and self.metrics.stages:
            self.metrics.save(f"{path}_metrics")

    def log(self, path: str, run: str) -> None:
        """Adds the run to a history that is only appended to; a run of that name is added once."""
        spark = self.pairs.sparkSession
        n = {r.tier: r.n for r in self.counts().collect()}
        row = [(run, time.time(), self.metrics.total() if self.metrics else None, sum(n.values()), n.get("A", 0), n.get("B", 0), self.config.to_json())]
        append_log.append(spark.createDataFrame(row, "run string, at double, seconds double, pairs long, tier_a long, tier_b long, config string").coalesce(1), path, run, "run_no")


class Engine:
    """Engine(spark, config).run(panels): panels has panel_id, page, panel_num, path, modality and vec (a unit vector of 64 components or more)."""

    def __init__(self, spark: SparkSession, config: Config | None = None) -> None:
        self.spark, self.config = spark, config or Config()

    def vectors(self, panels: DataFrame, compute: Step, root: str, key: str) -> DataFrame:
        """panels (path, ...) with vec: from the cache under root for this key (see cache.key_of); compute makes (path, vec) of those paths that it lacks, once."""
        held = cache.completed(self.spark, cache.paths(root, key)["vectors"], panels.select("path").distinct(), compute, "path")
        return panels.join(held, "path")

    def semantic(self, panels: DataFrame) -> DataFrame:
        p = self.config.pairing
        vectors = panels.select(F.col("panel_id").alias("id"), "vec")
        pairs = similarity.mutual_pairs(vectors, p.top_k, p.similarity) if p.mutual else ann.adaptive_pairs(vectors, p.similarity)
        kept = similarity.suppressed(similarity.with_pages(pairs, panels), p.suppress_same_page, p.adjacent_gap if p.suppress_adjacent else None)
        kept = kept.select("i", "j", "cosine")
        best = kept if p.max_pairs is None else similarity.capped(kept, p.max_pairs)
        return similarity.z_global(best, similarity.similarity_stats(vectors))

    def bundles(self, panels: DataFrame) -> DataFrame:
        return hashing.bundle(panels.select(F.col("panel_id").alias("id"), "vec"))

    def hashed(self, panels: DataFrame) -> DataFrame:
        """All pairs whose bundles come within the distance in any two of the symmetries; none is lost."""
        return hashing.orbit_pairs(self.bundles(panels), self.config.pairing.hamming)

    def run(
        self, panels: DataFrame, annotate: Step | None = None, geometry: DataFrame | Step | None = None, tile_matches: Step | None = None, by_modality: bool = False, gate_near_pages: bool = False,
        classifier: PipelineModel | None = None, measure: bool = True, plain: bool = False,
    ) -> Result:
        """annotate adds ssim, patch_min, patch_topk to semantic pairs (i, j, cosine, clip_z), a row for each.

        geometry: a function of the pairs worth a check (pair_lo, pair_hi; close by cosine or hash) that gives (i, j, orb_inliers, ...), or such a table; of either those pairs are taken.
        tile_matches: a function of the pairs that gives their tiles' matches (pair_lo, pair_hi, ssim, hamming, cosine, confidence, method); called if enough panels are confocal.
        by_modality: tiers by the pair's modality instead of the universal ones; plain: by the paths of tiering.tiered_plain() alone. gate_near_pages drops pairs on near pages without support.
        classifier: one of tuning.fitted_classifier() or load_classifier(). measure: each stage is written, counted and timed as it runs, and deleted when no
        later one reads it; else all is lazy.
        """
        p, metrics = self.config.pairing, Metrics(self.spark)
        stage = metrics.run if measure else (lambda name, df, after=(), **more: df)
        panels = stage("panels", panels)
        semantic = self.semantic(panels)
        semantic = (annotate(semantic) if annotate else semantic).withColumns({"i": F.least("i", "j"), "j": F.greatest("i", "j")})
        semantic = stage("semantic", hashing.with_distance(semantic, self.bundles(panels), p.hamming), ("panels",))
        both = semantic.where("hamming is not null").select("i", "j", F.lit(True).alias("met"))
        hashed = stage("hashes", self.hashed(panels).join(both, ["i", "j"], "left"), ("panels",))
        sources, found, checked = ("semantic", "hashes"), merge.apart(semantic, hashed), merge.worth(p.trigger_cosine, p.trigger_hamming)
        if geometry is not None:
            worth = stage("triggers", found.where(checked).select("pair_lo", "pair_hi"), sources)
            asked = geometry.withColumns({"pair_lo": F.least("i", "j"), "pair_hi": F.greatest("i", "j")}).join(worth, ["pair_lo", "pair_hi"], "left_semi").drop("pair_lo", "pair_hi") if isinstance(geometry, DataFrame) else geometry(worth)
            geometry, sources = stage("geometry", asked, ("triggers",)), (*sources, "geometry")
            metrics.forget("triggers")
        pairs = merge.with_geometry(found, checked, geometry)
        if gate_near_pages:
            pairs = merge.near_page_gate(similarity.with_pages(pairs.withColumnsRenamed({"pair_lo": "i", "pair_hi": "j"}), panels), p.trigger_hamming, near=p.near_gap)
            pairs = pairs.drop("page_a", "page_b", "same_page", "gap").withColumnsRenamed({"i": "pair_lo", "j": "pair_hi"})
        pairs = stage("merge", pairs, sources)
        metrics.forget(*sources)
        names = beside(panels.select("panel_id", "path", "modality"))
        side = lambda k, s: names.toDF(k, f"path_{s}", f"modality_{s}")
        merged = pairs.join(side("pair_lo", "a"), "pair_lo", "left").join(side("pair_hi", "b"), "pair_hi", "left")
        tiered = tiering.tiered_by_modality(merged) if by_modality else (tiering.tiered_plain if plain else tiering.tiered)(merged, self.config.tiers)
        a, b = F.count_if(F.col("tier") == "A"), F.count_if(F.col("tier") == "B")
        out, last = stage("tiers", refine.refined(tiered), ("merge",), tier_a=a, tier_b=b), "tiers"
        metrics.forget("merge")
        if tile_matches is not None and tiles.use_tiles(panels):
            out, last = stage("tiles", refine.with_tile_evidence(out, tiles.rolled_up(tile_matches(out)), self.config.tiles.confirm), (last,), tier_a=a, tier_b=b), "tiles"
        if classifier is not None:
            out = stage("classifier", tuning.classified(out, classifier), (last,))
        return Result(out, self.config, metrics if measure else None)

    def tiles_first(self, panels: DataFrame, cells: DataFrame, verify: Step) -> Result:
        """Tiles first: candidate pairs of tiles (cells: id, panel_id, vec) of different panels by cosine, verified (verify adds ssim, hamming, confidence,
        method), rolled up to panels, tier A where enough tiles agree well."""
        t, metrics = self.config.tiles, Metrics(self.spark)
        cells = metrics.run("cells", cells.join(panels.select("panel_id"), "panel_id", "left_semi"))
        found = metrics.run("candidates", tiles.cross_panel(ann.adaptive_pairs(cells.select("id", "vec"), t.cosine), cells), ("cells",))
        matched = metrics.run("verified", verify(found), ("candidates",))
        return Result(metrics.run("rollup", tiles.tile_first_tier(tiles.rolled_up(matched), t), ("verified",)), self.config, metrics)
