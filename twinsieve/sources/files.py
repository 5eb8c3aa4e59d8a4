"""Readers and writers of the engine's files. All go through Spark, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import append_log

MANIFEST = "Panel_Path string, Panel_Name string, Page string, Panel_Num int, X int, Y int, Width int, Height int, Area bigint"
REPORT = (
    "Image_A string, Image_B string, Path_A string, Path_B string, Cosine_Similarity double, SSIM double, Hamming_Distance int, Transform_Matched string, ORB_Inliers int, Inlier_Ratio double, Reproj_Error double, Crop_Coverage double, "
    "Homography_Type string, Source string, CLIP_Z double, Patch_SSIM_Min double, Patch_SSIM_TopK double, Tier string, Tier_Path string, Confocal_FP boolean"
)
TRUTH = "pair_id int, category string, path_a string, path_b string, label string, should_detect boolean, original_a string, original_b string, modality string, transform_type string"
RESULTS = "pair_id int, category string, label string, should_detect boolean, was_detected boolean, clip_score double, ssim_score double, phash_distance int, method_triggered string"
#: Column of the report for each column of the engine.
NAMES = {
    "path_a": "Path_A", "path_b": "Path_B", "cosine": "Cosine_Similarity", "ssim": "SSIM", "hamming": "Hamming_Distance", "transform": "Transform_Matched", "orb_inliers": "ORB_Inliers", "inlier_ratio": "Inlier_Ratio", "reproj_error": "Reproj_Error",
    "crop_coverage": "Crop_Coverage", "homography_type": "Homography_Type", "source": "Source", "clip_z": "CLIP_Z", "patch_min": "Patch_SSIM_Min", "patch_topk": "Patch_SSIM_TopK", "tier": "Tier", "tier_path": "Tier_Path", "confocal_fp": "Confocal_FP",
}


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, length of files whose first bytes are a PDF's; content is read but not kept."""
    return spark.read.format("binaryFile").load(path).where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("path", "length")


def images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def labelled_pairs(files: DataFrame) -> DataFrame:
    """Consecutive files (path) of one folder as pairs; the folder duplicates or non_duplicates is the label. A last odd file is left out."""
    named = files.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"))
    w = Window.partitionBy("folder").orderBy("path")
    ranked = named.withColumns({"n": F.row_number().over(w), "path_b": F.lead("path").over(w)})
    return ranked.where("n % 2 = 1 and path_b is not null").select(F.col("path").alias("path_a"), "path_b", (F.col("folder") == "duplicates").alias("should_detect"))


def read_tsv(spark: SparkSession, path: str, schema: str = REPORT) -> DataFrame:
    """A report with a header: columns by name, those that the file lacks are null, values that don't parse are null."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    kinds = [x.strip().split(" ") for x in schema.split(",")]
    return raw.select(*[(F.col(f"`{n}`") if n in raw.columns else F.lit(None).cast("string")).try_cast(t).alias(n) for n, t in kinds])


def write_tsv(df: DataFrame, path: str) -> None:
    """With a header, for an empty result too."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str = RESULTS) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of a ground-truth manifest, a JSON object with an array."""
    whole = spark.read.option("multiLine", True).schema(f"pairs array<struct<{TRUTH.replace(' ', ': ').replace(',:', ',')}>>").json(path)
    return whole.select(F.inline("pairs"))


def append_truth(pairs: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds pairs to a ground truth that is only appended to, numbered on as pair_id, in the order of category and paths. A batch of that name is added once."""
    kinds = [x.strip().split(" ") for x in TRUTH.split(",")][1:]
    rows = pairs.select(*[(F.col(n) if n in pairs.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds])
    append_log.append(rows, path, batch, "pair_id", ["category", "path_a", "path_b"])


def truth_summary(truth: DataFrame) -> DataFrame:
    """total_pairs, true_positives and hard_negatives of a ground truth."""
    return truth.agg(F.count("*").alias("total_pairs"), F.count_if(F.col("should_detect")).alias("true_positives"), F.count_if(~F.col("should_detect")).alias("hard_negatives"))


def missing_columns(rows: DataFrame, wanted: list[str] | None = None) -> list[str]:
    """Of the columns that a report must have, those that rows lack, in order."""
    have = set(rows.columns)
    return [c for c in (wanted or [x.strip().split(" ")[0] for x in REPORT.split(",")]) if c not in have]


def write_metadata(spark: SparkSession, path: str, config: str, results: dict, seconds: float) -> None:
    """One JSON row: time, run time, settings, versions, results."""
    row = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(float(seconds)).alias("runtime_seconds"), F.lit(config).alias("config"), F.create_map(F.lit("spark"), F.lit(spark.version)).alias("versions"),
        F.create_map(*[F.lit(str(x)) for kv in (results or {"none": ""}).items() for x in kv]).alias("results"),
    )
    row.coalesce(1).write.mode("overwrite").json(path)


def report(pairs: DataFrame) -> DataFrame:
    """pairs under the report's column names, all of them, missing ones null."""
    kinds = dict(x.strip().split(" ") for x in REPORT.split(","))
    back = {v: k for k, v in NAMES.items()}
    cols = []
    for name, kind in kinds.items():
        own = back.get(name)
        if name in ("Image_A", "Image_B"):
            p = f"path_{name[-1].lower()}"
            cols.append(F.element_at(F.split(F.col(p), "/"), -1).alias(name))
        else:
            cols.append((F.col(own) if own in pairs.columns else F.lit(None)).cast(kind).alias(name))
    return pairs.select(*cols)


def from_report(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(v).alias(k) for k, v in NAMES.items()])


def cached(spark: SparkSession, compute, path: str, key: str) -> DataFrame:
    """The table under path/key=..., computed and written if it isn't there. The key names what it was made from, and the version of what made it."""
    at = f"{path}/key={key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        compute().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
