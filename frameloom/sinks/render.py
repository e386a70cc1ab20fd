"""Rendered frames: display range, tone map, bytes, files named by sequence and frame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.numeric import auto_center, auto_radius, bias_of, explode_computed, scale_of
from frameloom.functions.tone import apply_tone, to_byte
from frameloom.model import FRAME_KEYS
from frameloom.operators.histogram import with_range
from frameloom.operators.pixels import DEFAULT_BANDS
from frameloom.sources.codecs import png_bytes

NAME_PATTERN = "screenshot_%d_%d.png"  # fixed value: sequence and frame number


def with_display(blocks: DataFrame, ranges: DataFrame | None = None, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Add ``scale, bias`` from each frame's own finite range."""
    ranged = with_range(blocks, ranges, keys)
    radius, center = auto_radius("low", "high"), auto_center("low", "high")
    return ranged.withColumn("scale", scale_of(radius)).withColumn("bias", bias_of(center, radius))


def pixel_rows(blocks: DataFrame, bands: Sequence[int] = DEFAULT_BANDS, keep: Sequence[str] = ("scale", "bias")) -> DataFrame:
    """One row per pixel with the three selected raw band values (0 where a band is invalid).

    Pixels are cut out of the packed row, so bands never need to be joined back together.
    """
    whole = F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)
    vectors = F.transform(
        whole, lambda i: F.struct(i.alias("i"), F.slice("pixels", i * F.col("c") + 1, F.col("c")).alias("p"))
    )
    flat = explode_computed(blocks, vectors, "_at", dict.fromkeys([*FRAME_KEYS, *keep, "w"]))
    flat = flat.withColumn("_i", F.col("_at.i")).withColumn("_p", F.col("_at.p"))

    def band(b: int) -> Column:
        none = F.lit(0.0).cast("float")
        return F.coalesce(F.get("_p", F.lit(b)), none) if b >= 0 else none

    return flat.select(
        *FRAME_KEYS,
        F.expr("_i div w").cast("int").alias("y"),
        (F.col("_i") % F.col("w")).cast("int").alias("x"),
        *[band(b).alias(f"p{k}") for k, b in enumerate(bands)],
        *keep,
    )


def toned_pixels(blocks: DataFrame, name: str, bands: Sequence[int] = DEFAULT_BANDS) -> DataFrame:
    """``r, g, b`` in 0..1 of every pixel of blocks that carry ``scale, bias``."""
    rows = pixel_rows(blocks, bands)
    channels = apply_tone(name, (F.col("p0"), F.col("p1"), F.col("p2")), F.col("scale"), F.col("bias"))
    return rows.select(*FRAME_KEYS, "y", "x", *channels)


def byte_pixels(toned: DataFrame) -> DataFrame:
    return toned.select(*FRAME_KEYS, "y", "x", *[to_byte(k).alias(k) for k in ("r", "g", "b")])


def file_name(seq="seq_id", frame="frame") -> Column:
    """Name of a rendered frame; a function of its identity, so re-running a task writes the same name."""
    return F.format_string(NAME_PATTERN, F.col(seq).cast("bigint"), F.col(frame).cast("bigint"))


def rendered_pngs(frames: DataFrame, name: str, bands: Sequence[int] = DEFAULT_BANDS) -> DataFrame:
    """Whole frames as png files: ``seq_id, frame, name, content``. Packed rows in, packed rows out."""
    channel = F.transform(
        F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), lambda i: _colour(i, name, bands)
    )
    packed = frames.select(*FRAME_KEYS, "w", "h", file_name().alias("name"), F.flatten(channel).alias("rgb"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["content"] = [
                png_bytes(np.asarray(rgb, np.uint8).reshape(h, w, 3)) for rgb, h, w in zip(batch.rgb, batch.h, batch.w)
            ]
            yield batch.drop(columns=["w", "h", "rgb"])

    types = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    schema = f"seq_id {types['seq_id']}, frame {types['frame']}, name string, content binary"
    return packed.mapInPandas(encode, schema)


def _colour(i: Column, name: str, bands: Sequence[int]) -> Column:
    none = F.lit(0.0).cast("float")
    values = tuple(
        F.when(F.lit(b) < F.col("c"), F.get("pixels", i * F.col("c") + b)).otherwise(none) if b >= 0 else none
        for b in bands
    )
    return F.array(*[to_byte(v) for v in apply_tone(name, values, F.col("scale"), F.col("bias"))])


def write_rendered(rendered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store rendered frames as a table partitioned by sequence."""
    rendered.write.mode(mode).partitionBy("seq_id").parquet(path)
