"""Evidence from several sources on one unordered pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ordering

#: Signals of each source: name and type; a source without one has nulls.
SEMANTIC = {"cosine": "double", "clip_z": "double", "ssim": "double", "patch_min": "double", "patch_topk": "double", "global_ssim": "double"}
HASHES = {"hamming": "int", "transform": "string"}
GEOMETRY = {"orb_inliers": "int", "inlier_ratio": "double", "reproj_error": "double", "crop_coverage": "double", "homography_type": "string"}


def gathered(*sources: tuple[DataFrame, dict[str, str], str]) -> DataFrame:
    """pair_lo, pair_hi, the signals of all sources and a flag for each: rows (i, j and signals) of a source that repeat a pair become one with the
    largest of each signal. The sources' rows meet in one grouping, so a pair is shuffled once whatever sources it has."""
    every = {c: t for _, signals, _ in sources for c, t in signals.items()}

    def rows(pairs: DataFrame, signals: dict[str, str], source: str) -> DataFrame:
        typed = [(F.col(c) if c in signals and c in pairs.columns else F.lit(None)).cast(t).alias(c) for c, t in every.items()]
        flags = [F.lit(True if n == source else None).cast("boolean").alias(f"from_{n}") for _, _, n in sources]
        return pairs.select(F.least("i", "j").alias("pair_lo"), F.greatest("i", "j").alias("pair_hi"), *typed, *flags)

    out = rows(*sources[0])
    for s in sources[1:]:
        out = out.union(rows(*s))
    return out.groupBy("pair_lo", "pair_hi").agg(*[F.max(c).alias(c) for c in every], *[F.max(f"from_{n}").alias(f"from_{n}") for _, _, n in sources])


def merged(semantic: DataFrame, hashes: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    """The sources (rows i, j and signals) by pair, all pairs that any has; source is CLIP, pHash, ORB, joined by + in that order."""
    sources = [(semantic, SEMANTIC, "CLIP"), (hashes, HASHES, "pHash"), *([(geometry, GEOMETRY, "ORB")] if geometry is not None else [])]
    names = [n for _, _, n in sources]
    source = F.concat_ws("+", *[F.when(F.col(f"from_{n}"), F.lit(n)) for n in names])
    return gathered(*sources).withColumn("source", source).drop(*[f"from_{n}" for n in names])


def apart(semantic: DataFrame, hashes: DataFrame) -> DataFrame:
    """pair_lo, pair_hi and the signals of semantic pairs (i, j, signals, and hamming and transform of those that are in hashes too), and of hashes (i, j,
    hamming, transform, met) that have not met a semantic pair: no pair is twice in it, and none is shuffled. from_CLIP and from_pHash say where it is."""
    every = SEMANTIC | HASHES

    def rows(pairs: DataFrame, semantic: bool) -> DataFrame:
        typed = [(F.col(c) if c in pairs.columns else F.lit(None)).cast(t).alias(c) for c, t in every.items()]
        return pairs.select(F.least("i", "j").alias("pair_lo"), F.greatest("i", "j").alias("pair_hi"), *typed, F.lit(semantic).alias("from_CLIP"), F.col("hamming").isNotNull().alias("from_pHash"))

    return rows(semantic, True).union(rows(hashes.where("met is null"), False))


def worth(cosine: float, hamming: int) -> Column:
    """Whether a pair is worth a geometric check: close by cosine or by hash."""
    return F.coalesce(F.col("cosine") >= cosine, F.lit(False)) | F.coalesce(F.col("hamming") <= hamming, F.lit(False))


def with_geometry(pairs: DataFrame, checked: Column, geometry: DataFrame | None = None) -> DataFrame:
    """Pairs of apart() with the signals of geometry (i, j, signals) and source, as of merged(). Only the checked ones meet geometry's rows; the largest of
    each signal counts if it repeats a pair, and rows of pairs that were not to be checked are left out."""
    out, told = pairs.withColumn("from_ORB", F.lit(False)), {}
    if geometry is not None:
        told = {c: t for c, t in GEOMETRY.items() if c in geometry.columns}
        keyed = geometry.select(F.least("i", "j").alias("pair_lo"), F.greatest("i", "j").alias("pair_hi"), *[F.col(c).cast(t).alias(c) for c, t in told.items()])
        # dealt before it is grouped: nearly all pairs come once, and a grouping ahead of the shuffle would only fill memory
        once = keyed.repartition("pair_lo", "pair_hi").groupBy("pair_lo", "pair_hi").agg(*[F.max(c).alias(c) for c in told], F.lit(True).alias("from_ORB"))
        out = pairs.where(checked).join(once, ["pair_lo", "pair_hi"], "left").unionByName(pairs.where(~checked), allowMissingColumns=True)
    source = F.concat_ws("+", *[F.when(F.col(f"from_{n}"), F.lit(n)) for n in ("CLIP", "pHash", "ORB")])
    lacking = {c: F.lit(None).cast(t) for c, t in GEOMETRY.items() if c not in told}
    return out.withColumns(lacking | {"source": source}).drop("from_CLIP", "from_pHash", "from_ORB")


def trigger_pairs(semantic: DataFrame, hashes: DataFrame, cosine: float = 0.985, hamming: int = 4) -> DataFrame:
    """Pairs worth a geometric check: close by cosine or by hash."""
    a = semantic.where(F.col("cosine") >= cosine).select(F.least("i", "j").alias("pair_lo"), F.greatest("i", "j").alias("pair_hi"))
    b = hashes.where(F.col("hamming") <= hamming).select(F.least("i", "j").alias("pair_lo"), F.greatest("i", "j").alias("pair_hi"))
    return a.union(b).distinct()


def needed(signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    """The signatures (id, ...) of records in a pair."""
    ids = pairs.select(F.explode(F.array("pair_lo", "pair_hi")).alias("id"))
    return signatures.join(ids, "id", "left_semi")


def near_page_gate(pairs: DataFrame, hamming: int, inliers: int = 30, near: int = 2) -> DataFrame:
    """Drops pairs on near pages that neither the hash nor geometry supports; an unknown gap is far."""
    close = F.coalesce(F.col("gap") <= near, F.lit(False))
    supported = F.coalesce(F.col("hamming") <= hamming, F.lit(False)) | F.coalesce(F.col("orb_inliers") >= inliers, F.lit(False))
    return pairs.where(~close | supported)


def appended(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """rows and those of more whose keys, in this order, rows don't have."""
    return rows.unionByName(more.join(rows, keys, "left_anti"), allowMissingColumns=True)


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in this order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def report_order(pairs: DataFrame) -> DataFrame:
    """By source, then cosine from high (missing: -1), then distance (missing: 99)."""
    return pairs.orderBy("source", F.coalesce("cosine", F.lit(-1.0)).desc(), F.coalesce("hamming", F.lit(99)), "pair_lo", "pair_hi")


def numbered(pairs: DataFrame) -> DataFrame:
    """report_no from 1 in the order of cosine from high, missing as 0."""
    return ordering.numbered(pairs, [F.coalesce("cosine", F.lit(0.0)).desc(), F.col("pair_lo"), F.col("pair_hi")], "report_no").withColumn("report_no", F.col("report_no").cast("int"))


def page_pairs(pages: DataFrame) -> DataFrame:
    """Every two pages (doc_id, page) of a document, the smaller first, for a whole-page scan."""
    a, b = pages.select("doc_id", F.col("page").alias("page_a")), pages.select("doc_id", F.col("page").alias("page_b"))
    return a.join(b, "doc_id").where("page_a < page_b")


def with_modalities(pairs: DataFrame, cache: DataFrame, least: float = 0.15) -> DataFrame:
    """modality_a and modality_b from (path, modality, confidence); an unknown path or a low confidence is unknown."""
    m = cache.select("path", F.when(F.col("confidence") >= least, F.col("modality")).otherwise("unknown").alias("m"))
    out = pairs.drop("modality_a", "modality_b")
    for s in ("a", "b"):
        out = out.join(m.select(F.col("path").alias(f"path_{s}"), F.col("m").alias(f"modality_{s}")), f"path_{s}", "left").withColumn(f"modality_{s}", F.coalesce(f"modality_{s}", F.lit("unknown")))
    return out


def _by_tier() -> list:
    place = F.when(F.col("tier") == "A", 0).when(F.col("tier") == "B", 1).otherwise(2)
    return [place, F.coalesce("cosine", F.lit(0.0)).desc(), F.col("pair_lo"), F.col("pair_hi")]


def tier_order(pairs: DataFrame) -> DataFrame:
    """By tier, A before B before the others, then cosine from high (missing: 0), then the pair."""
    return pairs.orderBy(*_by_tier())


def tier_numbered(pairs: DataFrame) -> DataFrame:
    """position from 1 in the order of tier_order()."""
    return ordering.numbered(pairs, _by_tier(), "position")


def merged_package(semantic: DataFrame, hashes: DataFrame, geometry: DataFrame, structural: DataFrame) -> DataFrame:
    """The package's merge: cosine, hamming and orb_inliers by pair, and ssim, patch_min and patch_topk of pairs that another source has.

    source is CLIP, CLIP+pHash or pHash, and ORB only for a pair that geometry alone has; of geometry only the inliers are kept. Of rows that repeat a pair the
    largest value counts. structural: (i, j, ssim, patch_min, patch_topk).
    """
    structure = (structural, {"ssim": "double", "patch_min": "double", "patch_topk": "double"}, "SSIM")
    out = gathered((semantic, {"cosine": "double"}, "CLIP"), (hashes, {"hamming": "int"}, "pHash"), (geometry, {"orb_inliers": "int"}, "ORB"), structure).where("from_CLIP or from_pHash or from_ORB")
    source = F.coalesce(F.nullif(F.concat_ws("+", F.when(F.col("from_CLIP"), "CLIP"), F.when(F.col("from_pHash"), "pHash")), F.lit("")), F.lit("ORB"))
    return out.select("pair_lo", "pair_hi", "cosine", "ssim", "patch_min", "patch_topk", "hamming", "orb_inliers", source.alias("source"))
