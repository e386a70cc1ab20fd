"""Reading samples: point values, bands, regions, viewports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.numeric import col, finite
from frameloom.model import FRAME_KEYS, origin
from frameloom.operators.spread import hot_join

DEFAULT_BANDS = (0, 1, 2)  # fixed value: bands shown as red, green, blue


def pixel_values(x, y, depth) -> Column:
    """First ``depth`` bands of the pixel at (x, y) of a whole-frame row; zeros when outside.

    A ``depth`` past the last band reads on into the next pixel of the row-major data,
    and is zero-filled only after the last sample.
    """
    x, y, depth = col(x), col(y), col(depth)
    inside = (x >= 0) & (y >= 0) & (x < F.col("w")) & (y < F.col("h"))
    start = (F.col("w") * y + x) * F.col("c")
    zero = F.lit(0.0).cast("float")
    read = F.transform(F.sequence(F.lit(0), depth - 1), lambda k: F.coalesce(F.get("pixels", start + k), zero))
    return F.when(inside, read).otherwise(F.array_repeat(zero, depth))


def band_value(x, y, band) -> Column:
    """One selected band at (x, y) of a whole-frame row; NULL marks an invalid band or position."""
    x, y, band = col(x), col(y), col(band)
    ok = (
        (x >= 0) & (y >= 0) & (x < F.col("w")) & (y < F.col("h")) & (band >= 0) & (band < F.col("c"))
    )
    return F.when(ok, F.get("pixels", (F.col("w") * y + x) * F.col("c") + band))


def selected_bands(samples: DataFrame, bands: Sequence[int] = DEFAULT_BANDS, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Samples of the chosen bands only, numbered by display channel."""
    wanted = sorted({b for b in bands if b >= 0})
    channels = F.create_map(
        *[item for b in wanted for item in (F.lit(b), F.array(*[F.lit(i) for i, k in enumerate(bands) if k == b]))]
    )
    return samples.where(F.col("band").isin(wanted)).select(
        *keys, "y", "x", "band", "v", F.explode(channels[F.col("band")]).alias("channel")
    )


def mean_of_valid(values) -> Column:
    """Mean over the valid (non-NULL) bands in double; NULL when it is not a finite number."""
    kept = F.filter(col(values), lambda v: v.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    mean = total / F.nullif(F.size(kept), F.lit(0))
    return F.when(finite(mean), mean)


def inclusive_region(ax, ay, bx, by) -> Column:
    """Half-open rectangle of a drag from one corner to the other, both corner pixels included."""
    ax, ay, bx, by = col(ax), col(ay), col(bx), col(by)
    return F.struct(
        F.least(ax, bx).alias("x0"),
        F.least(ay, by).alias("y0"),
        (F.greatest(ax, bx) + 1).alias("x1"),
        (F.greatest(ay, by) + 1).alias("y1"),
    )


def corner_region(ax, ay, bx, by) -> Column:
    """The half-open variant used for fitting the display range: the far corner is left out."""
    ax, ay, bx, by = col(ax), col(ay), col(bx), col(by)
    return F.struct(
        F.least(ax, bx).alias("x0"),
        F.least(ay, by).alias("y0"),
        F.greatest(ax, bx).alias("x1"),
        F.greatest(ay, by).alias("y1"),
    )


def clip_region(region, w, h) -> Column:
    """A half-open rectangle cut to the image."""
    region, w, h = col(region), col(w), col(h)
    return F.struct(
        F.least(F.greatest(region["x0"], F.lit(0)), w).alias("x0"),
        F.least(F.greatest(region["y0"], F.lit(0)), h).alias("y0"),
        F.least(F.greatest(region["x1"], F.lit(0)), w).alias("x1"),
        F.least(F.greatest(region["y1"], F.lit(0)), h).alias("y1"),
    )


def in_region(region, x="x", y="y") -> Column:
    region, x, y = col(region), col(x), col(y)
    return (x >= region["x0"]) & (x < region["x1"]) & (y >= region["y0"]) & (y < region["y1"])


def blocks_touching(blocks: DataFrame, region) -> DataFrame:
    """Drop whole blocks outside the rectangle before any pixel is unpacked."""
    region = col(region)
    x0, y0 = origin(blocks)
    return blocks.where(
        (x0 < region["x1"]) & (x0 + F.col("w") > region["x0"]) & (y0 < region["y1"]) & (y0 + F.col("h") > region["y0"])
    )


def lookup_points(frames: DataFrame, points: DataFrame, on: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Every band at the requested positions of whole frames; zeros when outside.

    ``points`` has the key columns ``on`` plus ``point, x, y``. A frame that is asked for
    very many points is copied to several tasks, all others meet their points once.
    """
    met = hot_join(points, frames, on, [*on, "point"])
    return met.select(*FRAME_KEYS, "point", "x", "y", pixel_values("x", "y", F.col("c")).alias("values"))


def lookup_list(frames: DataFrame, xs: Sequence[int], ys: Sequence[int]) -> DataFrame:
    """The same short list of positions in every frame: read in place, nothing is joined."""
    asked = frames.select(*FRAME_KEYS, "w", "h", "c", "pixels", F.explode(point_list(xs, ys)).alias("_p"))
    return asked.select(*FRAME_KEYS, "_p.*", pixel_values("_p.x", "_p.y", F.col("c")).alias("values"))


def point_list(xs: Sequence[int], ys: Sequence[int]) -> Column:
    """Positions given by the caller as two equally long lists."""
    if len(xs) != len(ys):
        raise ValueError("inconsistent size between xs and ys")
    return F.array(
        *[
            F.struct(F.lit(i).alias("point"), F.lit(int(x)).alias("x"), F.lit(int(y)).alias("y"))
            for i, (x, y) in enumerate(zip(xs, ys))
        ]
    )
