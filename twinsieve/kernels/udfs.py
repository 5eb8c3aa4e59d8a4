"""The kernels over tables of encoded images, in Arrow batches. A file that can't be read gives nulls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import reachable
from . import geometry, images


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mapped(df: DataFrame, inputs: list[str], keep: list[str], schema: str, kernel: Callable[..., dict | None]) -> DataFrame:
    """df's keep columns and those of schema, from kernel(decoded inputs); a kernel's None is a row of nulls."""
    reachable(df.sparkSession)
    kinds = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}
    kept = ", ".join(f"{c} {t}" for c, t in df.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                got = [images.decoded(b.column(len(keep) + k)[i].as_py()) for k in range(len(inputs))]
                rows.append((kernel(*got) if all(g is not None for g in got) else None) or {})
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array([r.get(n) for r in rows], t) for n, t in kinds.items()]], [*keep, *kinds])

    return df.select(*keep, *inputs).mapInArrow(run, f"{kept}, {schema}")


def hash_bundles(files: DataFrame) -> DataFrame:
    """path and the eight hashes of its image."""

    def kernel(x: np.ndarray) -> dict:
        return {"bundle": [(k, _signed(v)) for k, v in images.phash_bundle(images.grey_of(x)).items()]}

    return mapped(files, ["content"], ["path"], "bundle map<string,bigint>", kernel)


def bundle_rows(bundles: DataFrame) -> DataFrame:
    """id, ord, transform, hash, as the Hamming joins take them."""
    from ..operators.hashing import TRANSFORMS

    order = F.array_position(F.array(*[F.lit(t) for t in TRANSFORMS]), F.col("transform")) - 1
    return bundles.select(F.col("path").alias("id"), F.explode("bundle").alias("transform", "hash")).select("id", order.cast("int").alias("ord"), "transform", "hash")


def texture(files: DataFrame) -> DataFrame:
    return mapped(files, ["content"], ["path"], "edge double, anisotropy double, mid double, high double, vertical double", lambda x: images.texture_features(images.grey_of(x)))


def _with_contents(pairs: DataFrame, files: DataFrame) -> DataFrame:
    a, b = files.select(F.col("path").alias("path_a"), F.col("content").alias("content_a")), files.select(F.col("path").alias("path_b"), F.col("content").alias("content_b"))
    return pairs.select("path_a", "path_b").join(a, "path_a").join(b, "path_b")


def ssim_scores(pairs: DataFrame, files: DataFrame, height: int = 512) -> DataFrame:
    return mapped(_with_contents(pairs, files), ["content_a", "content_b"], ["path_a", "path_b"], "global_ssim double, patch_min double, patch_topk double, patches int, ssim double", lambda a, b: images.patch_scores(a, b, height=height))


def geometry_scores(pairs: DataFrame, files: DataFrame) -> DataFrame:
    return mapped(
        _with_contents(pairs, files), ["content_a", "content_b"], ["path_a", "path_b"], "orb_inliers int, inlier_ratio double, reproj_error double, crop_coverage double, homography_type string, is_partial boolean, reason string",
        lambda a, b: geometry.verified(images.grey_of(a), images.grey_of(b)),
    )


def deep_scores(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Only for the pairs given: filter to the suspected false positives first."""
    return mapped(_with_contents(pairs, files), ["content_a", "content_b"], ["path_a", "path_b"], "deep_ssim double, deep_ncc double, deep_hamming int, ok boolean", images.deep_verified)


def lane_distances(pairs: DataFrame, files: DataFrame) -> DataFrame:
    def kernel(a: np.ndarray, b: np.ndarray) -> dict:
        return {"distance": images.lanes_distance(images.lane_profiles(images.grey_of(a), []), images.lane_profiles(images.grey_of(b), []))}

    return mapped(_with_contents(pairs, files), ["content_a", "content_b"], ["path_a", "path_b"], "distance double", kernel)


def grid_tiles(files: DataFrame) -> DataFrame:
    """path, n, x, y, w, h of the cells of images that are grids."""
    found = mapped(files, ["content"], ["path"], "cells array<array<int>>", lambda x: {"cells": [list(c) for c in images.grid_cells(images.grey_of(x))]})
    return found.select("path", F.posexplode("cells").alias("n", "c")).select("path", "n", *[F.col("c")[k].alias(v) for k, v in enumerate("xywh")])


def page_panels(pages: DataFrame, limits=None) -> DataFrame:
    """The manifest of panels of pages (page, content): panel_id, page, panel_num, name, x, y, w, h, area; boxes are filtered by size, suppressed and put into reading order."""
    from ..config import Boxes
    from ..operators import boxes as bx

    limits = limits or Boxes()
    found = mapped(pages, ["content"], ["page"], "boxes array<array<int>>", lambda x: {"boxes": [list(b) for b in images.panel_boxes(images.grey_of(x))]})
    rows = found.select("page", F.posexplode("boxes").alias("id", "b")).select("page", "id", *[F.col("b")[k].cast("long").alias(v) for k, v in enumerate("xywh")])
    ordered = bx.reading_order(bx.suppressed(bx.of_size(rows, limits), limits))
    name = F.concat(F.lit("page_"), F.col("page").cast("string"), F.lit("_panel"), F.lpad(F.col("panel_num").cast("string"), 2, "0"))
    return ordered.select((F.col("page") * 1000 + F.col("panel_num")).alias("panel_id"), "page", "panel_num", name.alias("name"), "x", "y", "w", "h", (F.col("w") * F.col("h")).alias("area"))


def detected(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """The baseline detector's signals from pixels: hamming and ssim of each pair, as tiering.detected takes them."""
    def kernel(a: np.ndarray, b: np.ndarray) -> dict:
        p, q = images.fitted(images.grey_of(a), images.grey_of(b), 256)
        return {"hamming": images.bundle_distance(images.phash_bundle(images.grey_of(a)), images.phash_bundle(images.grey_of(b)))[0], "ssim": images.ssim(p, q)}

    return mapped(_with_contents(pairs, files), ["content_a", "content_b"], ["path_a", "path_b"], "hamming int, ssim double", kernel)
