"""Virtual tables of the engine over the star schema and the vectors, each with its SQL.

Signals called synthetic_* or standing in `evidence` are arithmetic on keys, made so that every rule gets rows; they measure nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Boxes

MODALITIES = ("western_blot", "confocal", "tem", "bright_field", "gel", "unknown")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modality_of(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MODALITIES]), (key % 6 + 1).cast("int"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel_id, page, panel_num, path, modality, vec: four panels a page."""
    k = F.col("vec_id")
    page, num = F.floor(k / 4) + 1, k % 4 + 1
    path = F.concat(F.lit("page_"), page.cast("string"), F.lit("_panel"), F.lpad(num.cast("string"), 2, "0"), F.lit(".png"))
    return load(spark, sf_dir, "embeddings").select(k.alias("panel_id"), page.cast("long").alias("page"), num.cast("long").alias("panel_num"), path.alias("path"), modality_of(F.col("label")).alias("modality"), F.col("embedding").cast("array<double>").alias("vec"))


PANEL_SQL = """panel AS (SELECT vec_id AS panel_id, vec_id // 4 + 1 AS page, vec_id % 4 + 1 AS panel_num,
  'page_' || (vec_id // 4 + 1)::VARCHAR || '_panel' || lpad((vec_id % 4 + 1)::VARCHAR, 2, '0') || '.png' AS path,
  (['western_blot', 'confocal', 'tem', 'bright_field', 'gel', 'unknown'])[label % 6 + 1] AS modality, embedding::DOUBLE[] AS vec FROM embeddings)"""

#: name: (expression of k in Spark SQL, the same in DuckDB)
_EVIDENCE = {
    "cosine": ("if(k % 11 = 0, null, 0.9D + ((k * 7) % 101) / 1000D)", "CASE WHEN k % 11 <> 0 THEN 0.9e0 + ((k * 7) % 101) / 1000e0 END"),
    "ssim": ("if(k % 13 = 0, null, 0.4D + ((k * 13) % 61) / 100D)", "CASE WHEN k % 13 <> 0 THEN 0.4e0 + ((k * 13) % 61) / 100e0 END"),
    "hamming": ("if(k % 5 = 0, null, cast((k * 3 + k div 16) % 23 as int))", "CASE WHEN k % 5 <> 0 THEN ((k * 3 + k // 16) % 23)::INTEGER END"),
    "orb_inliers": ("if(k % 6 = 0, null, cast((k * 17) % 60 as int))", "CASE WHEN k % 6 <> 0 THEN ((k * 17) % 60)::INTEGER END"),
    "inlier_ratio": ("((k * 19) % 100) / 100D", "((k * 19) % 100) / 100e0"),
    "reproj_error": ("((k * 23) % 70) / 10D", "((k * 23) % 70) / 10e0"),
    "crop_coverage": ("((k * 29) % 101) / 100D", "((k * 29) % 101) / 100e0"),
    "clip_z": ("((k * 41) % 60) / 10D", "((k * 41) % 60) / 10e0"),
    "patch_min": ("if(k % 7 = 0, null, 0.6D + ((k * 31) % 41) / 100D)", "CASE WHEN k % 7 <> 0 THEN 0.6e0 + ((k * 31) % 41) / 100e0 END"),
    "patch_topk": ("if(k % 4 = 0, null, 0.6D + ((k * 37) % 41) / 100D)", "CASE WHEN k % 4 <> 0 THEN 0.6e0 + ((k * 37) % 41) / 100e0 END"),
    "deep_ssim": ("if(k % 3 = 0, 0.85D + ((k * 43) % 16) / 100D, null)", "CASE WHEN k % 3 = 0 THEN 0.85e0 + ((k * 43) % 16) / 100e0 END"),
    "deep_ncc": ("if(k % 3 = 0, 0.97D + ((k * 47) % 31) / 1000D, null)", "CASE WHEN k % 3 = 0 THEN 0.97e0 + ((k * 47) % 31) / 1000e0 END"),
    "deep_hamming": ("if(k % 3 = 0, cast((k * 53) % 20 as int), null)", "CASE WHEN k % 3 = 0 THEN ((k * 53) % 20)::INTEGER END"),
    "ihc_ssim": ("if(k % 7 = 1, 0.8D + ((k * 59) % 21) / 100D, null)", "CASE WHEN k % 7 = 1 THEN 0.8e0 + ((k * 59) % 21) / 100e0 END"),
    "ihc_ncc": ("if(k % 7 = 1, 0.96D + ((k * 61) % 41) / 1000D, null)", "CASE WHEN k % 7 = 1 THEN 0.96e0 + ((k * 61) % 41) / 1000e0 END"),
    "ihc_hamming": ("if(k % 7 = 1, cast((k * 67) % 24 as int), null)", "CASE WHEN k % 7 = 1 THEN ((k * 67) % 24)::INTEGER END"),
    "page_a": ("cast((k * 3) % 20 + 1 as int)", "((k * 3) % 20 + 1)::INTEGER"),
    "page_b": ("cast((k * 5) % 20 + 1 as int)", "((k * 5) % 20 + 1)::INTEGER"),
    "panel_num_a": ("cast(k % 4 + 1 as int)", "(k % 4 + 1)::INTEGER"),
    "panel_num_b": ("cast((k div 3) % 4 + 1 as int)", "((k // 3) % 4 + 1)::INTEGER"),
    "tile_n": ("cast(k % 4 as int)", "(k % 4)::INTEGER"),
}


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic pair for each order: pair_lo, pair_hi, all signals, modalities, pages and paths."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    out = rows.select(F.col("k").alias("pair_lo"), (F.col("k") + 1 + F.col("k") % 7).alias("pair_hi"), *[F.expr(s).alias(c) for c, (s, _) in _EVIDENCE.items()], modality_of(F.col("k")).alias("modality_a"), modality_of(F.when(F.col("k") % 3 == 0, F.floor(F.col("k") / 6)).otherwise(F.col("k"))).alias("modality_b"))
    path = lambda s: F.concat(F.lit("page_"), F.col(f"page_{s}").cast("string"), F.lit("_panel"), F.lpad(F.col(f"panel_num_{s}").cast("string"), 2, "0"), F.lit(".png"))
    return out.withColumns({"path_a": path("a"), "path_b": path("b")})


EVIDENCE_SQL = (
    "evidence AS (SELECT *, 'page_' || page_a::VARCHAR || '_panel' || lpad(panel_num_a::VARCHAR, 2, '0') || '.png' AS path_a, 'page_' || page_b::VARCHAR || '_panel' || lpad(panel_num_b::VARCHAR, 2, '0') || '.png' AS path_b FROM (SELECT k AS pair_lo, k + 1 + k % 7 AS pair_hi, "
    + ", ".join(f"{s} AS {c}" for c, (_, s) in _EVIDENCE.items())
    + ", (['western_blot', 'confocal', 'tem', 'bright_field', 'gel', 'unknown'])[k % 6 + 1] AS modality_a, (['western_blot', 'confocal', 'tem', 'bright_field', 'gel', 'unknown'])[CASE WHEN k % 3 = 0 THEN (k // 6) % 6 + 1 ELSE k % 6 + 1 END] AS modality_b FROM (SELECT o_orderkey AS k FROM orders)))"
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic boxes on pages, from line items: page, id, x, y, w, h."""
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return rows.groupBy("id", "page").agg(F.min("p").alias("p"), F.min("s").alias("s")).select(
        "page", "id", (F.col("p") % 1500).cast("long").alias("x"), (F.col("s") * 37 % 1200).cast("long").alias("y"), (F.col("p") * 7 % 900 + 100).cast("long").alias("w"), (F.col("s") * 11 % 700 + 100).cast("long").alias("h")
    )


BOXES_SQL = """boxes AS (SELECT page, id, (p % 1500)::BIGINT AS x, (s * 37 % 1200)::BIGINT AS y, (p * 7 % 900 + 100)::BIGINT AS w, (s * 11 % 700 + 100)::BIGINT AS h
  FROM (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS page, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 48 x 48 pixels made of 36 vectors each: img, y, x, v. A texture by formula, and on it noise from the components; vectors that fill no image are left over."""
    held = load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 36).cast("int").alias("img"), ((F.col("vec_id") % 36) * 64).alias("first"), F.posexplode("embedding").alias("pos", "c"))
    full = load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 36).cast("int").alias("img")).groupBy("img").count().where("count = 36").select("img")
    k = F.col("first") + F.col("pos")
    rows = held.join(full, "img").select("img", F.floor(k / 48).cast("int").alias("y"), (k % 48).cast("int").alias("x"), (F.floor(F.abs(F.col("c").cast("double")) * 2000) % 8).cast("int").alias("noise"))
    return rows.select("img", "y", "x", ((F.col("y") * 31 + F.col("x") * 17 * (1 + F.col("img") % 3) + F.col("img") * 7 + F.floor(F.col("y") * F.col("x") / 5) * (F.col("img") % 2) + F.col("noise")) % 256).cast("int").alias("v"))


PIXELS_SQL = """pixels AS (SELECT img, y, x, ((y * 31 + x * 17 * (1 + img % 3) + img * 7 + ((y * x) // 5) * (img % 2) + noise) % 256)::INTEGER AS v
  FROM (SELECT img, (k // 48)::INTEGER AS y, (k % 48)::INTEGER AS x, (floor(abs(c::DOUBLE) * 2000)::BIGINT % 8)::INTEGER AS noise
    FROM (SELECT (vec_id // 36)::INTEGER AS img, (vec_id % 36) * 64 + generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding) AS c, count(*) OVER (PARTITION BY vec_id // 36) AS n FROM embeddings) WHERE n = 36))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth and scores: id, label, score, should_detect, ssim, hamming, category, from labels and documents."""
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id")
    score = ((F.col("doc_id") * 37 + F.col("quality") * 41) % 101) / F.lit(100.0)
    return rows.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), score.alias("score"), (F.col("quality") == 1).alias("should_detect"), (F.lit(0.8) + ((F.col("doc_id") * 13 + F.col("quality") * 5) % 20) / F.lit(100.0)).alias("ssim"), ((F.col("doc_id") * 7 + (1 - F.col("quality")) * 9) % 12).cast("int").alias("hamming"), F.col("lang").alias("category"))


JUDGED_SQL = """judged AS (SELECT l.doc_id AS id, quality::INTEGER AS label, ((l.doc_id * 37 + quality * 41) % 101) / 100e0 AS score, quality = 1 AS should_detect,
  0.8e0 + ((l.doc_id * 13 + quality * 5) % 20) / 100e0 AS ssim, ((l.doc_id * 7 + (1 - quality) * 9) % 12)::INTEGER AS hamming, lang AS category FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def image_files(spark: SparkSession, size: int = 160) -> DataFrame:
    """Synthetic panels as encoded files (path, content): six textures, and each turned by a quarter, mirrored and brightened."""
    import numpy as np

    from ..kernels.images import encoded, resized

    rows = []
    for i in range(6):
        rng = np.random.default_rng(i)
        g = np.clip(resized(rng.integers(0, 256, (size // 8, size // 8)), size, size) + rng.normal(0, 4, (size, size)), 0, 255)
        g[(i * 20) % 90 : (i * 20) % 90 + 25, :] = 70
        for name, x in (("plain", g), ("rot90", np.rot90(g)), ("mirror", g[:, ::-1]), ("bright", np.clip(g + 20, 0, 255))):
            rows.append((f"page_{i + 1}_panel{len(rows) % 4 + 1:02d}_{name}.pgm", encoded(np.ascontiguousarray(x))))
    return spark.createDataFrame(rows, "path string, content binary")


def image_pairs(spark: SparkSession) -> DataFrame:
    """Each plain image with its variants and with the next plain image."""
    names = [r.path for r in image_files(spark).select("path").collect()]
    plain = names[::4]
    return spark.createDataFrame([(plain[i], n) for i in range(6) for n in (*names[4 * i + 1 : 4 * i + 4], plain[(i + 1) % 6])], "path_a string, path_b string")


#: Size limits that fit the synthetic pages.
SMALL_BOXES = Boxes(min_area=2_000, max_area=200_000)


def page_images(spark: SparkSession) -> DataFrame:
    """Synthetic pages (page, content) of two to six panels between white gutters."""
    import numpy as np

    from ..kernels.images import encoded

    rows = []
    for p in range(1, 5):
        page = np.full((420, 320), 255.0)
        for k in range(p + 2):
            y, x = 20 + (k // 2) * 130, 20 + (k % 2) * 150
            page[y : y + 110, x : x + 120] = 40 + (np.arange(110)[:, None] * 7 + np.arange(120) * 3 + k * 11) % 150
        rows.append((p, encoded(page)))
    return spark.createDataFrame(rows, "page long, content binary")
