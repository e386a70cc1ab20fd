"""Sequences share views, players and colormaps: star joins and the values derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.operators.spread import attach_by_key


def attach_settings(sequences: DataFrame, dims: Sequence[tuple[DataFrame, str]], spread_on: Sequence[str]) -> DataFrame:
    """Attach each (dimension, key) to the sequences; sequences without a match keep NULLs."""
    out = sequences
    for dim, key in dims:
        out = attach_by_key(out, dim, [key], spread_on, "left")
    return out


def player_bounds(sequences: DataFrame, player: str = "player_id") -> DataFrame:
    """Playback bounds of each player: from 1 to the longest attached collection."""
    return sequences.groupBy(player).agg(F.lit(1).alias("min_frame"), F.max("len").alias("max_frame"))


def rescale_factor(sequences: DataFrame, view: str = "view_id", spread_on: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Widest image of the shared view over this image's width, in float32."""
    widest = sequences.groupBy(view).agg(F.max("w").alias("_widest"))
    met = attach_by_key(sequences, widest, [view], spread_on)
    factor = (F.col("_widest").cast("float") / F.col("w").cast("float")).cast("float")
    return met.withColumn("factor", factor).drop("_widest")
