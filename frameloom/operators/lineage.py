"""Keys that name where a frame came from, and recomputing only what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.numeric import col
from frameloom.operators.spread import hot_join

# Key prefixes and the editor numbers used inside edit keys.
IMAGE_PREFIX = "image:"
VIDEO_PREFIX = "video:"
EDIT_PREFIX = "edit:"
PIXEL_EDIT = 0
WHOLE_IMAGE_EDIT = 1


def image_key(path) -> Column:
    return F.concat(F.lit(IMAGE_PREFIX), col(path))


def video_key(path, index) -> Column:
    return F.concat(F.lit(VIDEO_PREFIX), col(path), F.lit(":"), col(index).cast("string"))


def edit_key(kind: int, program, input_keys: Sequence) -> Column:
    return F.concat(F.lit(f"{EDIT_PREFIX}{kind}"), col(program), *[col(k) for k in input_keys])


def images_by_key(requests: DataFrame, images: DataFrame) -> DataFrame:
    """Attach the image to each request for a ``key``; NULLs when there is none. One image may be
    asked for very often."""
    return hot_join(requests, images, ["key"], requests.columns, "left")


def changed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that are new, modified or gone between two listings (path, modified, length)."""
    state = ["path", "modified", "length"]
    fresh = new.select(*state).join(old.select(*state), state, "left_anti")
    gone = old.select("path").join(new.select("path"), "path", "left_anti")
    known = old.select("path").distinct().withColumn("_known", F.lit(True))
    told = fresh.join(known, "path", "left").select(
        "path", F.when(F.col("_known"), F.lit("modified")).otherwise(F.lit("new")).alias("change")
    )
    return told.unionByName(gone.select("path", F.lit("deleted").alias("change")))


def frames_to_redo(uses: DataFrame, changes: DataFrame) -> DataFrame:
    """Derived frames (``derived_key, source_path``, one row per input) with a changed input.

    A pinned source may be an input of very many derived frames.
    """
    changed = changes.select(F.col("path").alias("source_path")).distinct()
    return hot_join(uses, changed, ["source_path"], ["derived_key"]).select("derived_key").distinct()


def keep_unchanged(derived: DataFrame, redo: DataFrame) -> DataFrame:
    """Derived frames that stay valid."""
    return derived.join(redo, "derived_key", "left_anti")
