"""Side-car drawings that accompany frames: by name or by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.numeric import col
from frameloom.operators.spread import attach_by_key, hot_join

SIDECAR_SUFFIX = ".svg"  # fixed value


def sidecar_name(path) -> Column:
    """The frame's name up to its last dot plus the suffix; a name without a dot gives the bare suffix."""
    stem = F.regexp_extract(col(path), r"(?s)^(.+)\.[^.]*$", 1)
    return F.concat(stem, F.lit(SIDECAR_SUFFIX))


def sidecar_by_name(frames: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Frames with the side-car of the same name where one exists (``sidecars`` lists ``sidecar`` paths).

    All names without a dot share one side-car name, so that name may be hot.
    """
    named = frames.withColumn("sidecar", sidecar_name("path"))
    listed = sidecars.select("sidecar").distinct().withColumn("has_sidecar", F.lit(True))
    met = hot_join(named, listed, ["sidecar"], frames.columns, "left")
    return met.withColumn("has_sidecar", F.coalesce("has_sidecar", F.lit(False)))


def sidecar_by_position(frames: DataFrame, sidecars: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Frame f (0-based) gets entry f of its list, or the first entry when the list is shorter.

    Sequences with an empty list get none. The short-list case points many frames at one
    entry, so it is attached per key; the rest is an equi-join on (key, position).
    """
    firsts = sidecars.groupBy(*keys).agg(
        F.max(F.col("position") + 1).alias("_count"), F.min_by("sidecar", "position").alias("_first")
    )
    sized = attach_by_key(frames, firsts, keys, [*keys, "frame"])
    listed = sidecars.select(*keys, F.col("position").cast("bigint").alias("frame"), "sidecar")
    met = sized.join(listed, [*keys, "frame"], "left")
    return met.withColumn(
        "sidecar", F.when(F.col("frame") < F.col("_count"), F.col("sidecar")).otherwise(F.col("_first"))
    ).drop("_count", "_first")


def sidecars_after_drop(sidecars: DataFrame, dropped: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Lists after one frame per sequence (``dropped``: keys, ``drop_at``) was removed; one-entry lists stay."""
    counts = sidecars.groupBy(*keys).agg(F.max(F.col("position") + 1).alias("_count"))
    facts = attach_by_key(sidecars, counts.join(dropped, list(keys), "left"), keys, [*keys, "position"])
    affected = F.col("drop_at").isNotNull() & (F.col("_count") != 1) & (F.col("drop_at") < F.col("_count"))
    kept = facts.where(~F.coalesce(affected & (F.col("position") == F.col("drop_at")), F.lit(False)))
    moved = F.when(affected & (F.col("position") > F.col("drop_at")), F.col("position") - 1).otherwise(F.col("position"))
    return kept.withColumn("position", moved).drop("_count", "drop_at")
