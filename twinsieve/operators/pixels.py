"""Image measures on a long table of pixels (img, y, x, v): relational twins of the array kernels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def stats(pixels: DataFrame) -> DataFrame:
    """The audit row of each image: size, mean, population deviation, least and greatest value."""
    return pixels.groupBy("img").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))


def autocontrast(pixels: DataFrame) -> DataFrame:
    """Values stretched to 0..255 by image; a flat image stays as it is."""
    ends = pixels.groupBy("img").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")) + 0.5)).otherwise(F.col("v"))
    return pixels.join(ends, "img").select("img", "y", "x", v.cast("int").alias("v"))


def transformed(pixels: DataFrame, size: int) -> DataFrame:
    """transform and moved pixels of square images: quarter turns and mirrors, and 20 added, cut at 255."""
    y, x, v, last = F.col("y"), F.col("x"), F.col("v"), F.lit(size - 1)
    s = lambda n, a, b, c=v: F.struct(F.lit(n).alias("transform"), a.alias("y"), b.alias("x"), c.alias("v"))
    every = F.array(s("rotate_90", x, last - y), s("rotate_180", last - y, last - x), s("rotate_270", last - x, y), s("mirror_h", y, last - x), s("mirror_v", last - y, x), s("brightness_+20", y, x, F.least(v + 20, F.lit(255))))
    return pixels.select("img", F.explode(every).alias("t")).select("img", "t.*")


def pairs_of(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, y, x, va, vb of image pairs (a, b) at equal places."""
    p, q = pixels.select(F.col("img").alias("a"), "y", "x", F.col("v").cast("double").alias("va")), pixels.select(F.col("img").alias("b"), "y", "x", F.col("v").cast("double").alias("vb"))
    return pairs.join(p, "a").join(q, ["b", "y", "x"])


def _ssim():
    ma, mb = F.avg("va"), F.avg("vb")
    va, vb, cov = F.var_samp("va"), F.var_samp("vb"), F.covar_samp("va", "vb")
    return ((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def ncc(met: DataFrame) -> DataFrame:
    """Correlation of two images, 0 if one is flat."""
    flat = (F.stddev_pop("va") == 0) | (F.stddev_pop("vb") == 0)
    return met.groupBy("a", "b").agg(F.round(F.when(flat, 0.0).otherwise(F.corr("va", "vb")), 6).alias("ncc"))


def ssim_global(met: DataFrame) -> DataFrame:
    """One window over the whole image, with sample moments."""
    return met.groupBy("a", "b").agg(F.round(_ssim(), 6).alias("ssim"))


def patch_ssim(met: DataFrame, size: int, grid: int = 3, top: int = 4, weight: float = 0.6) -> DataFrame:
    """patch_min, patch_topk (mean of the best), patches and the mix with the global score, over a grid of patches."""
    step = size // grid
    cell = F.least(F.floor(F.col("y") / step), F.lit(grid - 1)) * grid + F.least(F.floor(F.col("x") / step), F.lit(grid - 1))
    each = met.groupBy("a", "b", cell.alias("cell")).agg(_ssim().alias("s"))
    best = F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, top)
    mean = F.aggregate(best, F.lit(0.0), lambda acc, v: acc + v) / F.size(best)
    patches = each.groupBy("a", "b").agg(F.round(F.min("s"), 6).alias("patch_min"), mean.alias("m"), F.count("*").alias("patches"))
    whole = met.groupBy("a", "b").agg(_ssim().alias("g"))
    return patches.join(whole, ["a", "b"]).select("a", "b", "patch_min", F.round("m", 6).alias("patch_topk"), "patches", F.round((1 - weight) * F.col("g") + weight * F.col("m"), 6).alias("ssim"))


def neighbours_of(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Each pixel's values at all offsets of up to the radius: img, y, x, dy, dx, v of the neighbour."""
    span = range(-radius, radius + 1)
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in span for dx in span])
    return pixels.select("img", "y", "x", "v", F.explode(moves).alias("m")).select("img", (F.col("y") - F.col("m.dy")).alias("y"), (F.col("x") - F.col("m.dx")).alias("x"), "m.dy", "m.dx", "v")


def texture(pixels: DataFrame) -> DataFrame:
    """Edges by 3 x 3 gradients inside the border: mean absolute gradients, their ratio (anisotropy) and the share of strong edges."""
    near = neighbours_of(pixels)
    gx = F.sum(F.col("v") * F.col("dx") * (F.lit(2) - F.abs("dy")))
    gy = F.sum(F.col("v") * F.col("dy") * (F.lit(2) - F.abs("dx")))
    each = near.groupBy("img", "y", "x").agg(gx.alias("gx"), gy.alias("gy"), F.count("*").alias("k")).where("k = 9")
    mx, my = F.avg(F.abs("gx")), F.avg(F.abs("gy"))
    return each.groupBy("img").agg(F.round(mx, 6).alias("gx"), F.round(my, 6).alias("gy"), F.round(mx / (my + 1e-6), 6).alias("anisotropy"), F.round(F.avg(F.when(F.abs("gx") + F.abs("gy") > 255, 1.0).otherwise(0.0)), 6).alias("edge_density"))


def modality(features: DataFrame) -> DataFrame:
    """modality and confidence from (edge, anisotropy, mid, high): the first rule that fits, unknown under 0.15."""
    e, a, m, h = (F.col(c) for c in ("edge", "anisotropy", "mid", "high"))
    one = F.lit(1.0)
    rules = [
        ("western_blot", (a > 1.4) & (e > 0.08) & (e < 0.20), F.least(a - 1, one)),
        ("confocal", (m > 80) & (e > 0.12) & (e < 0.25), F.least(m / 150, one)),
        ("tem", (e > 0.28) & (h > 100), F.least(e / 0.35, one)),
        ("bright_field", e < 0.08, 1 - e / 0.08),
        ("gel", (a > 0.9) & (a < 1.1) & (e > 0.08), F.lit(0.7)),
    ]
    name, sure = F.lit("unknown"), F.lit(0.0)
    for n, c, s in reversed(rules):
        name, sure = F.when(c, n).otherwise(name), F.when(c, s).otherwise(sure)
    out = features.withColumns({"_n": name, "_s": sure})
    return out.select(*features.columns, F.when(F.col("_s") < 0.15, "unknown").otherwise(F.col("_n")).alias("modality"), F.round("_s", 6).alias("confidence"))


def brightness_outliers(pixels: DataFrame, tile: int, z: float = 4.0) -> DataFrame:
    """Tiles whose median is far from the medians of their 3 x 3 neighbourhood, in units of its median absolute deviation."""
    tiles = pixels.groupBy("img", F.floor(F.col("y") / tile).alias("y"), F.floor(F.col("x") / tile).alias("x")).agg(F.expr("percentile(v, 0.5)").alias("v"))
    near = neighbours_of(tiles).where("dy <> 0 or dx <> 0").select("img", "y", "x", F.col("v").alias("w"))
    middle = near.groupBy("img", "y", "x").agg(F.expr("percentile(w, 0.5)").alias("m"))
    spread = near.join(middle, ["img", "y", "x"]).groupBy("img", "y", "x", "m").agg(F.expr("percentile(abs(w - m), 0.5)").alias("mad"))
    score = F.abs(F.col("v") - F.col("m")) / (1.4826 * F.col("mad") + 1e-6)
    return tiles.join(spread, ["img", "y", "x"]).select("img", "y", "x", F.col("v").alias("median"), F.round(score, 4).alias("z"), (score >= z).alias("outlier"))


def dct_blocks(pixels: DataFrame, block: int = 8, keep: int = 4) -> DataFrame:
    """img, by, bx and the unit vector of low cosine coefficients (the constant one left out) of each block."""
    u = [(i, j) for i in range(keep) for j in range(keep) if i or j]
    r, c = F.pmod("y", F.lit(block)), F.pmod("x", F.lit(block))
    wave = lambda k, at: F.cos((2 * at + 1) * F.lit(k * math.pi / (2 * block)))
    sums = [F.sum(F.col("v") * wave(i, r) * wave(j, c)).alias(f"d{n}") for n, (i, j) in enumerate(u)]
    each = pixels.groupBy("img", F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")).agg(*sums)
    length = F.sqrt(sum((F.col(f"d{n}") * F.col(f"d{n}") for n in range(len(u))), F.lit(0.0)))
    return each.select("img", "by", "bx", F.array(*[F.col(f"d{n}") / F.greatest(length, F.lit(1e-9)) for n in range(len(u))]).alias("d"))


def clone_candidates(blocks: DataFrame, cosine: float = 0.95, least: float = 2.0) -> DataFrame:
    """Pairs of blocks of one image that look alike and lie apart; images are small, so the blocks of one all meet."""
    k = F.row_number().over(Window.partitionBy("img").orderBy("by", "bx"))
    b = blocks.withColumn("k", k)
    p, q = b.select("img", F.col("k").alias("a"), F.col("by").alias("ya"), F.col("bx").alias("xa"), F.col("d").alias("da")), b.select("img", F.col("k").alias("b"), F.col("by").alias("yb"), F.col("bx").alias("xb"), F.col("d").alias("db"))
    s = F.aggregate(F.zip_with("da", "db", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    gap = F.sqrt(F.pow(F.col("ya") - F.col("yb"), 2) + F.pow(F.col("xa") - F.col("xb"), 2))
    return p.join(q, "img").where("a < b").where(gap >= least).withColumn("cosine", s).where(F.col("cosine") >= cosine).select("img", "ya", "xa", "yb", "xb", "cosine")


def lane_profiles(pixels: DataFrame, lanes: DataFrame) -> DataFrame:
    """img, lane, y, mean value of each row of each lane (img, lane, start, end; end excluded)."""
    met = pixels.join(lanes, "img").where((F.col("x") >= F.col("start")) & (F.col("x") < F.col("end")))
    return met.groupBy("img", "lane", "y").agg(F.round(F.avg("v"), 6).alias("mean"))


def patch_stats(met: DataFrame, size: int, grid: int = 3, top: int = 4) -> DataFrame:
    """least, most, mean, median, deviation, mean of the best and number of patch scores of each image pair."""
    step = size // grid
    cell = F.least(F.floor(F.col("y") / step), F.lit(grid - 1)) * grid + F.least(F.floor(F.col("x") / step), F.lit(grid - 1))
    each = met.groupBy("a", "b", cell.alias("cell")).agg(_ssim().alias("s"))
    best = F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, top)
    r = lambda x, n: F.round(x, 6).alias(n)
    return each.groupBy("a", "b").agg(
        r(F.min("s"), "least"), r(F.max("s"), "most"), r(F.avg("s"), "mean"), r(F.expr("percentile(s, 0.5)"), "median"), r(F.stddev_pop("s"), "sd"), r(F.aggregate(best, F.lit(0.0), lambda acc, v: acc + v) / F.size(best), "topk"), F.count("*").alias("patches")
    )


def profile_valleys(pixels: DataFrame, axis: str = "y", depth: float = 10, width: int = 3) -> DataFrame:
    """img, middle, width of runs of rows (or columns) whose mean lies `depth` under the median of them, by gaps and islands."""
    profile = pixels.groupBy("img", F.col(axis).alias("at")).agg(F.avg("v").alias("m"))
    base = profile.groupBy("img").agg(F.expr("percentile(m, 0.5)").alias("base"))
    low = profile.join(base, "img").where(F.col("m") < F.col("base") - depth)
    run = low.withColumn("island", F.col("at") - F.row_number().over(Window.partitionBy("img").orderBy("at")))
    return run.groupBy("img", "island").agg(F.floor((F.min("at") + F.max("at")) / 2).cast("int").alias("middle"), F.count("*").cast("int").alias("width")).where(F.col("width") >= width).drop("island")


def ms_ssim(scores: DataFrame, weights: tuple[float, ...] = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)) -> DataFrame:
    """The weighted geometric mean of scale scores (a, b, scale from 0, c); 0 if any isn't positive."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("scale") + 1)
    good = F.min("c") > 0
    return scores.groupBy("a", "b").agg(F.round(F.when(good, F.exp(F.sum(w * F.log(F.greatest(F.col("c"), F.lit(1e-12)))))).otherwise(0.0), 6).alias("ms_ssim"))
