"""Row shapes. A *block* is a rectangle of one frame with its samples packed row-major,
bands interleaved. A whole small frame is one block at the origin; a large frame is many.

blocks : seq_id, frame, [x0, y0,] w, h, c, pixels ARRAY<FLOAT>
samples: seq_id, frame, y, x, band, v FLOAT
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME_KEYS = ("seq_id", "frame")
TILE_EDGE = 1024  # fixed value: grid step of the tiling


def origin(blocks: DataFrame) -> tuple[Column, Column]:
    """Offset of each block in its frame; whole frames start at 0,0."""
    if "x0" in blocks.columns:
        return F.col("x0"), F.col("y0")
    return F.lit(0), F.lit(0)


def packed(source: DataFrame, pixels: str, w: int, h: int, c: int, seq: str, frame: str) -> DataFrame:
    """Read an array column as frames of a fixed shape."""
    return source.select(
        F.col(seq).alias("seq_id"),
        F.col(frame).alias("frame"),
        F.lit(w).alias("w"),
        F.lit(h).alias("h"),
        F.lit(c).alias("c"),
        F.col(pixels).alias("pixels"),
    )


def to_samples(blocks: DataFrame, keys: Sequence[str] = FRAME_KEYS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per scalar. Only the keys, the kept columns and the position travel."""
    x0, y0 = origin(blocks)
    flat = blocks.select(
        *keys, *keep, x0.alias("_x0"), y0.alias("_y0"), "w", "c", F.posexplode("pixels").alias("_i", "v")
    )
    pixel = F.expr("_i div c").cast("int")
    return flat.select(
        *keys,
        (F.col("_y0") + F.expr("_i div (c * w)")).cast("int").alias("y"),
        (F.col("_x0") + pixel % F.col("w")).cast("int").alias("x"),
        (F.col("_i") % F.col("c")).cast("int").alias("band"),
        "v",
        *keep,
    )


def to_blocks(samples: DataFrame, edge: int, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Pack samples into tiles of at most ``edge`` x ``edge`` pixels (the group size is bounded by the tile)."""
    tx, ty = F.expr(f"x div {edge}").cast("int"), F.expr(f"y div {edge}").cast("int")
    cell = F.struct("y", "x", "band", "v")
    grouped = samples.groupBy(*keys, tx.alias("tx"), ty.alias("ty")).agg(
        F.array_sort(F.collect_list(cell)).alias("_cells"),
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        (F.max("x") - F.min("x") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"),
        (F.max("band") + 1).alias("c"),
    )
    return grouped.select(*keys, "tx", "ty", "x0", "y0", "w", "h", "c", F.col("_cells.v").alias("pixels"))
