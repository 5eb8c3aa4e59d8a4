"""Boxes of panels, geometry of homographies, intervals of lanes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Boxes
from ..session import workspace

#: Boxes of a page that are folded in one row at most.
FOLDED = 2000


def of_size(boxes: DataFrame, b: Boxes = Boxes()) -> DataFrame:
    """Boxes (x, y, w, h) within the limits of area and aspect, both ends included."""
    return boxes.where((F.col("w") * F.col("h")).between(b.min_area, b.max_area) & (F.col("w") / F.col("h")).between(b.min_aspect, b.max_aspect))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs x, y, w, h; 0 for an empty union."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = w * h
    return F.coalesce(both / F.nullif(a["w"] * a["h"] + b["w"] * b["h"] - both, F.lit(0)), F.lit(0.0))


def iou_pairs(boxes: DataFrame) -> DataFrame:
    """page, a, b, iou of boxes on one page that overlap."""
    s = F.struct("x", "y", "w", "h")
    a, b = boxes.select("page", F.col("id").alias("a"), s.alias("p")), boxes.select("page", F.col("id").alias("b"), s.alias("q"))
    return a.join(b, "page").where("a < b").select("page", "a", "b", iou(F.col("p"), F.col("q")).alias("iou")).where("iou > 0")


def suppressed(boxes: DataFrame, b: Boxes = Boxes(), small: int = FOLDED) -> DataFrame:
    """Greedy non-maximum suppression by page: the largest first, ties to the smaller id; a box stays if its IoU with every kept one is under the limit.

    Pages with at most `small` boxes are folded each in one row; larger ones go through rounds(). Both give the same boxes. Ids are unique on a page.
    """
    sizes = boxes.groupBy("page").agg(F.count("*").alias("_n"))
    crowded = sizes.where(F.col("_n") > small).select("page")
    if crowded.isEmpty():
        return _folded(boxes, b)
    return _folded(boxes.join(crowded, "page", "left_anti"), b).unionByName(rounds(boxes.join(crowded, "page", "left_semi"), b))


def _folded(boxes: DataFrame, b: Boxes) -> DataFrame:
    ordered = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct((-F.col("w") * F.col("h")).alias("k"), "id", "x", "y", "w", "h"))).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", none, lambda held, x: F.when(F.exists(held, lambda y: iou(x, y) >= b.nms_iou), held).otherwise(F.concat(held, F.array(x))))
    return ordered.select("page", F.explode(kept).alias("b")).select("page", "b.id", "b.x", "b.y", "b.w", "b.h")


def overlaps(boxes: DataFrame, least: float) -> DataFrame:
    """page, a, b of boxes on one page with IoU >= least > 0, a before b in the order of suppression; found in cells of a grid.

    A box lies on the level of powers of two that holds its longer side. Boxes with that IoU differ in each side by the factor 1 / least at most, so
    they lie on near levels. A box takes the cell of its corner on its level and the levels above that could ask for it; a box asks its
    own level's cells from which another can reach it.
    """
    up = math.ceil(math.log2(1 / least)) + 1
    level = F.ceil(F.log2(F.greatest("w", "h", F.lit(1)).cast("double"))).cast("int")
    s = F.struct("id", "x", "y", "w", "h")
    leveled = boxes.where("w > 0 and h > 0").select("page", s.alias("s"), level.alias("level"))
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level")))
    held = leveled.select("page", F.col("s").alias("q"), F.explode(F.sequence(F.col("level"), F.col("level") + up)).alias("level")).select("page", "q", "level", cell(F.col("q.x")).alias("cx"), cell(F.col("q.y")).alias("cy"))
    size = F.pow(F.lit(2.0), F.col("level"))
    reach = lambda v, d: F.sequence(cell(F.col(f"s.{v}") - size), cell(F.col(f"s.{v}") + F.col(f"s.{d}")))
    asks = leveled.select("page", F.col("s").alias("p"), "level", F.explode(reach("x", "w")).alias("cx"), reach("y", "h").alias("ys")).select("page", "p", "level", "cx", F.explode("ys").alias("cy"))
    rank = lambda c: F.struct((-F.col(f"{c}.w") * F.col(f"{c}.h")).alias("k"), F.col(f"{c}.id").alias("id"))
    met = asks.join(held, ["page", "level", "cx", "cy"]).where(F.col("p.id") != F.col("q.id")).where(iou(F.col("p"), F.col("q")) >= least)
    first = rank("p") < rank("q")
    return met.select("page", F.when(first, F.col("p.id")).otherwise(F.col("q.id")).alias("a"), F.when(first, F.col("q.id")).otherwise(F.col("p.id")).alias("b")).distinct()


def rounds(boxes: DataFrame, b: Boxes = Boxes()) -> DataFrame:
    """suppressed() for pages of any number of boxes: in each round every open box that comes before all its open neighbours is kept, and its
    neighbours go. That is the greedy choice, as none that comes before a kept box is open. Boxes that are equal but for the id count once.

    Each round's open overlaps are written, so lineage stays short. There are as many rounds as boxes that must wait for one another, a few unless they lie in a long chain.
    """
    spark = boxes.sparkSession
    same = Window.partitionBy("page", "x", "y", "w", "h").orderBy("id")
    ranked = boxes.withColumn("_n", F.row_number().over(same)).where("_n = 1 or w <= 0 or h <= 0").drop("_n")

    def kept_as(df: DataFrame, label: str) -> DataFrame:
        at = workspace(spark, f"nms-{label}")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    ranked = kept_as(ranked, "boxes")
    open_ = kept_as(overlaps(ranked, b.nms_iou), "overlaps")
    out = ranked
    while not open_.isEmpty():
        nodes = open_.select("page", F.col("a").alias("id")).distinct()
        winners = nodes.join(open_.select("page", F.col("b").alias("id")).distinct(), ["page", "id"], "left_anti")
        losers = kept_as(open_.join(winners.withColumnRenamed("id", "a"), ["page", "a"], "left_semi").select("page", F.col("b").alias("id")).distinct(), "gone")
        out = out.join(losers, ["page", "id"], "left_anti")
        left = open_.join(losers.withColumnRenamed("id", "b"), ["page", "b"], "left_anti").join(losers.withColumnRenamed("id", "a"), ["page", "a"], "left_anti")
        open_ = kept_as(left.select("page", "a", "b"), "overlaps")
    return out.select("page", "id", "x", "y", "w", "h")


def reading_order(boxes: DataFrame) -> DataFrame:
    """panel_num from 1 by (y, x) on each page."""
    return boxes.withColumn("panel_num", F.row_number().over(Window.partitionBy("page").orderBy("y", "x", "id")))


def crop_coverage(corners: DataFrame) -> DataFrame:
    """coverage: the smaller of the share of the four corners (x1, y1, ... y4) inside the target (w, h) and the quadrilateral's share of its area."""
    xs, ys = [F.col(f"x{k}") for k in range(1, 5)], [F.col(f"y{k}") for k in range(1, 5)]
    inside = sum((F.when(x.between(0, F.col("w")) & y.between(0, F.col("h")), 1.0).otherwise(0.0) for x, y in zip(xs, ys)), F.lit(0.0)) / 4
    shoelace = sum((xs[k] * ys[(k + 1) % 4] - xs[(k + 1) % 4] * ys[k] for k in range(4)), F.lit(0.0))
    return corners.withColumn("coverage", F.least(inside, F.abs(shoelace) / 2 / (F.col("w") * F.col("h"))))


def ratio_test(matches: DataFrame, ratio: float = 0.75) -> DataFrame:
    """The best match of each query point (pair, q, t, d), kept if it is clearly nearer than the second best."""
    w = Window.partitionBy("pair", "q").orderBy("d", "t")
    ranked = matches.withColumns({"r": F.row_number().over(w), "second": F.lead("d").over(w)})
    return ranked.where((F.col("r") == 1) & (F.col("d") < ratio * F.col("second"))).select("pair", "q", "t", "d")
