"""Cutting frames into tiles and meeting tiles with rectangles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.numeric import col, explode_computed
from frameloom.model import FRAME_KEYS, TILE_EDGE


def tile_grid(frames: DataFrame, edge: int = TILE_EDGE, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Geometry of the tiles of each frame; tiles on the far edges are cut short."""
    across = F.sequence(F.lit(0), F.expr(f"(w - 1) div {edge}").cast("int"))
    down = F.sequence(F.lit(0), F.expr(f"(h - 1) div {edge}").cast("int"))
    columns = frames.select(*keys, "w", "h", "c", F.explode(down).alias("ty"), across.alias("_across"))
    grid = columns.select(*keys, "w", "h", "c", F.explode("_across").alias("tx"), "ty")
    return grid.select(
        *keys,
        "tx",
        "ty",
        (F.col("tx") * edge).alias("x0"),
        (F.col("ty") * edge).alias("y0"),
        F.least(F.lit(edge), F.col("w") - F.col("tx") * edge).alias("w"),
        F.least(F.lit(edge), F.col("h") - F.col("ty") * edge).alias("h"),
        "c",
    )


def split_frames(frames: DataFrame, edge: int = TILE_EDGE, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Cut whole frames into tile blocks by slicing rows of the packed array; nothing is shuffled."""
    down = F.sequence(F.lit(0), F.expr(f"(h - 1) div {edge}").cast("int"))
    across = F.sequence(F.lit(0), F.expr(f"(w - 1) div {edge}").cast("int"))
    tiles = F.flatten(F.transform(down, lambda ty: F.transform(across, lambda tx: _tile(tx, ty, edge))))
    return explode_computed(frames, tiles, "_t", [*keys, "c"]).select(
        *keys, "_t.tx", "_t.ty", "_t.x0", "_t.y0", "_t.w", "_t.h", "c", "_t.pixels"
    )


def _tile(tx: Column, ty: Column, edge: int) -> Column:
    x0, y0 = tx * edge, ty * edge
    w = F.least(F.lit(edge), F.col("w") - x0)
    h = F.least(F.lit(edge), F.col("h") - y0)
    rows = F.transform(
        F.sequence(y0, y0 + h - 1),
        lambda y: F.slice(F.col("pixels"), (y * F.col("w") + x0) * F.col("c") + 1, w * F.col("c")),
    )
    return F.struct(
        tx.alias("tx"),
        ty.alias("ty"),
        x0.alias("x0"),
        y0.alias("y0"),
        w.alias("w"),
        h.alias("h"),
        F.flatten(rows).alias("pixels"),
    )


def tiles_of_region(areas: DataFrame, region: str, edge: int = TILE_EDGE) -> DataFrame:
    """One row per tile key a rectangle touches, so that the overlap join is an equi-join."""
    r = F.col(region)
    solid = areas.where((r["x1"] > r["x0"]) & (r["y1"] > r["y0"]))
    ys = F.sequence(F.expr(f"{region}.y0 div {edge}").cast("int"), F.expr(f"({region}.y1 - 1) div {edge}").cast("int"))
    xs = F.sequence(F.expr(f"{region}.x0 div {edge}").cast("int"), F.expr(f"({region}.x1 - 1) div {edge}").cast("int"))
    return solid.withColumn("ty", F.explode(ys)).withColumn("tx", F.explode(xs))


def overlap(tiles: DataFrame, areas: DataFrame, region: str, edge: int = TILE_EDGE, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Tiles met by the rectangles of their frame, with the common part in tile coordinates."""
    met = tiles_of_region(areas, region, edge).join(tiles, [*keys, "tx", "ty"])
    return met.withColumn("common", common_part(region))


def common_part(region) -> Column:
    """Intersection of a rectangle with a tile, half-open, relative to the tile's corner."""
    r = col(region)
    return F.struct(
        (F.greatest(r["x0"], F.col("x0")) - F.col("x0")).alias("x0"),
        (F.greatest(r["y0"], F.col("y0")) - F.col("y0")).alias("y0"),
        (F.least(r["x1"], F.col("x0") + F.col("w")) - F.col("x0")).alias("x1"),
        (F.least(r["y1"], F.col("y0") + F.col("h")) - F.col("y0")).alias("y1"),
    )
