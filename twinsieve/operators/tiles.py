"""Tiles of panels: boxes, candidate pairs, roll-up to panel pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import Tiles
from ..session import beside
from . import cells


def _starts(length: Column, size: Column, stride: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.lit(0), length - size), stride)


def micro_tiles(panels: DataFrame, t: Tiles = Tiles()) -> DataFrame:
    """panel_id, n, x, y, size: overlapping squares of a panel (panel_id, w, h), rows first, then the bottom edge, then the right edge.

    A panel smaller than the size gets its own size, under the least size none; n counts from 0 and stops at the panel's limit.
    Squares that the edges repeat stay.
    """
    return _squares(panels, t).select("panel_id", "size", F.posexplode("every").alias("n", "b")).select("panel_id", "n", "b.x", "b.y", "size")


def tile_numbers(panels: DataFrame, t: Tiles = Tiles()) -> DataFrame:
    """panel_id, tiles: how many squares micro_tiles() makes of a panel, numbered from 0; a panel without any has no row."""
    return _squares(panels, t).select("panel_id", F.size("every").alias("tiles")).where("tiles > 0")


def _squares(panels: DataFrame, t: Tiles) -> DataFrame:
    sized = panels.withColumn("size", F.least("w", "h", F.lit(t.size))).where(F.col("size") >= t.least).withColumn("stride", F.greatest(F.lit(8), (F.col("size") * t.stride).cast("int")))
    xs, ys = _starts(F.col("w"), F.col("size"), F.col("stride")), _starts(F.col("h"), F.col("size"), F.col("stride"))
    inner = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))
    bottom = F.when(F.element_at(ys, -1) + F.col("size") < F.col("h"), F.transform(xs, lambda x: F.struct(x.alias("x"), (F.col("h") - F.col("size")).alias("y")))).otherwise(F.filter(inner, lambda z: F.lit(False)))
    right = F.when(F.element_at(xs, -1) + F.col("size") < F.col("w"), F.transform(ys, lambda y: F.struct((F.col("w") - F.col("size")).alias("x"), y.alias("y")))).otherwise(F.filter(inner, lambda z: F.lit(False)))
    every = F.slice(F.concat(inner, bottom, right), 1, t.per_panel)
    return sized.select("panel_id", "size", every.alias("every"))


def capped(tiles: DataFrame, t: Tiles = Tiles()) -> DataFrame:
    """At most the total number of tiles: the first by an md5 of panel and number."""
    return tiles.withColumn("k", F.md5(F.concat_ws(":", F.col("panel_id").cast("string"), F.col("n").cast("string")))).orderBy("k", "panel_id", "n").limit(t.total).drop("k")


def cross_panel(pairs: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs of tiles (i, j, ...) of different panels, with the two panels in order."""
    own = beside(tiles.select("id", "panel_id"))
    a, b = own.select(F.col("id").alias("i"), F.col("panel_id").alias("pa")), own.select(F.col("id").alias("j"), F.col("panel_id").alias("pb"))
    return pairs.join(a, "i").join(b, "j").where("pa <> pb").select(*pairs.columns, F.least("pa", "pb").alias("pair_lo"), F.greatest("pa", "pb").alias("pair_hi"))


def rolled_up(matches: DataFrame) -> DataFrame:
    """tile_count, averages and the best method of the tile matches of each panel pair, ties to the smaller method."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "method"))
    return matches.groupBy("pair_lo", "pair_hi").agg(
        F.count("*").alias("tile_count"), F.round(F.avg("ssim"), 6).alias("avg_ssim"), F.min("hamming").alias("min_hamming"), F.round(F.avg("cosine"), 6).alias("avg_cosine"), best["method"].alias("tile_method")
    )


def tile_first_tier(rolled: DataFrame, t: Tiles = Tiles()) -> DataFrame:
    a = (F.col("tile_count") >= t.confirm) & ((F.col("avg_ssim") >= t.ssim) | (F.col("min_hamming") <= t.hamming))
    return rolled.withColumn("tier", F.when(a, "A").otherwise("B"))


def use_tiles(panels: DataFrame, least: int = 3) -> bool:
    """Whether enough panels are confocal for tile mode."""
    return panels.where(F.col("modality") == "confocal").limit(least).count() >= least


def same_modality_panels(panels: DataFrame, modality: str = "confocal", block: int = 1 << 13) -> DataFrame:
    """All pairs of panels of one modality on different pages. Panels meet in cells of two blocks, so no task sees the whole modality."""
    p = panels.where(F.col("modality") == modality).select(F.col("panel_id").alias("id"), "page")
    kind = dict(p.dtypes)

    def columns(rows: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
        return [c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False) for c in rows.columns]

    def meet(held: list[np.ndarray], asked: pa.RecordBatch, same: bool) -> Iterator[pa.RecordBatch]:
        (j, q), (i, page) = held, columns(asked)
        other = page[:, None] != q
        a, c = np.nonzero(other & (i[:, None] < j) if same else other)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i[a], j[c])), pa.array(np.maximum(i[a], j[c]))], ["pair_lo", "pair_hi"])

    known = p.where("page is not null")  # an unknown page isn't known to be another
    dealt = cells.alone(known, cells.parts_for(known.count(), block), True, "id", "page")
    return dealt.mapInArrow(lambda batches: cells.met(batches, columns, meet, 64), f"pair_lo {kind['id']}, pair_hi {kind['id']}")


def bundle_min(matches: DataFrame, bundles: DataFrame) -> DataFrame:
    """pair columns and hamming: the least distance of tile a's plain hash to tile b's transforms, 999 if a tile has none.

    matches: (tile_a, tile_b, ...); bundles: (id, ord, hash).
    """
    plain = bundles.where("ord = 0").select(F.col("id").alias("tile_a"), F.col("hash").alias("_x"))
    eight = bundles.groupBy("id").agg(F.collect_set("hash").alias("_w")).select(F.col("id").alias("tile_b"), "_w")  # eight at most
    least = F.array_min(F.transform("_w", lambda y: F.bit_count(F.col("_x").bitwiseXOR(y))))
    return matches.join(plain, "tile_a", "left").join(eight, "tile_b", "left").withColumn("hamming", F.coalesce(least, F.lit(999)).cast("int")).drop("_x", "_w")


def products(panel_pairs: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every tile of one panel with every tile of the other, for each pair of panels; tiles: tile_numbers(). Tiles become rows only after the joins."""
    a = tiles.select(F.col("panel_id").alias("pair_lo"), F.col("tiles").alias("_a"))
    b = tiles.select(F.col("panel_id").alias("pair_hi"), F.col("tiles").alias("_b"))
    met = panel_pairs.select("pair_lo", "pair_hi").join(a, "pair_lo").join(b, "pair_hi")
    return met.select("pair_lo", "pair_hi", F.explode(F.sequence(F.lit(0), F.col("_a") - 1)).alias("tile_a"), "_b").select("pair_lo", "pair_hi", "tile_a", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("tile_b"))


def regular_tiles(panels: DataFrame, size: int = 384, stride: float = 0.65) -> DataFrame:
    """panel_id, n, x, y, size: full squares only, without edge cover, n counts from 0."""
    step = F.lit(max(1, int(size * stride)))
    fit = panels.where((F.col("w") >= size) & (F.col("h") >= size))
    xs, ys = _starts(F.col("w"), F.lit(size), step), _starts(F.col("h"), F.lit(size), step)
    every = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))
    return fit.select("panel_id", F.posexplode(every).alias("n", "b")).select("panel_id", "n", "b.x", "b.y", F.lit(size).alias("size"))
