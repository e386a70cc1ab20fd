"""Ranges, order statistics, sizes and pyramids over frames of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.functions.numeric import explode_computed, f32, finite, lit32
from frameloom.model import FRAME_KEYS
from frameloom.operators.spread import attach_by_key


def block_low(pixels: str = "pixels") -> Column:
    """Smallest finite sample of a packed row, NULL when there is none."""
    return F.array_min(F.filter(pixels, finite))


def block_high(pixels: str = "pixels") -> Column:
    return F.array_max(F.filter(pixels, finite))


def finite_range(blocks: DataFrame, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Finite minimum and maximum over all bands.

    Whole frames are one row each and need no shuffle; otherwise one pair per block reaches it.
    """
    if "x0" not in blocks.columns and set(FRAME_KEYS) <= set(keys):
        return blocks.select(*keys, block_low().alias("low"), block_high().alias("high"))
    return (
        blocks.select(*keys, block_low().alias("_low"), block_high().alias("_high"))
        .groupBy(*keys)
        .agg(F.min("_low").alias("low"), F.max("_high").alias("high"))
    )


def sample_range(samples: DataFrame, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Finite minimum and maximum of long-form samples (filter by band or region first)."""
    ordinary = F.when(finite("v"), F.col("v"))
    return samples.groupBy(*keys).agg(F.min(ordinary).alias("low"), F.max(ordinary).alias("high"))


def rank_low(q: float, n) -> Column:
    """Index of the low order statistic in float32 arithmetic, kept inside the data."""
    n = F.col(n) if isinstance(n, str) else n
    return F.least(f32(lit32(q) * f32(n)).cast("bigint"), n.cast("bigint") - 1)


def rank_high(q: float, n) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.least(f32(f32(lit32(1.0) - lit32(q)) * f32(n)).cast("bigint"), n.cast("bigint") - 1)


def block_quantiles(frames: DataFrame, fractions: Sequence[float], keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Saturation range of frames that fit one row: sort inside the row, no shuffle at all."""
    ordered = frames.select(*keys, F.sort_array(F.filter("pixels", finite)).alias("_s"))
    n = F.size("_s")
    rows = F.array(
        *[
            F.struct(
                F.lit(float(q)).alias("q"),
                F.get("_s", rank_low(q, n).cast("int")).alias("low"),
                F.get("_s", rank_high(q, n).cast("int")).alias("high"),
            )
            for q in fractions
        ]
    )
    return explode_computed(ordered, rows, "_r", keys).select(*keys, "_r.*")


def _coarse(v: Column) -> Column:
    """A monotone bucket of a float32: 256 buckets per octave of magnitude, mirrored for negatives.

    About 142,000 buckets cover every finite float32, and one bucket can hold at most
    some 45,000 different values, so both counting passes below stay bounded per group.
    """
    wide = v.cast("double")
    lift = F.lit(2.0**149)  # the smallest positive float32 becomes 1
    return (F.signum(wide) * F.floor(F.log2(F.lit(1.0) + F.abs(wide) * lift) * 256)).cast("int")


def saturation_range(
    samples: DataFrame,
    fractions: Sequence[float],
    keys: Sequence[str],
    spread_on: Sequence[str],
) -> DataFrame:
    """Exact low/high order statistics of groups of any size, by counting in two passes.

    Pass 1 counts coarse buckets and finds the bucket that holds each wanted rank. Pass 2
    counts the distinct values of those buckets only. Both are map-side combined counts:
    no group is ever sorted or collected, whatever its size. A group without finite samples has NULLs.
    """
    good = samples.where(finite("v")).withColumn("_b", _coarse(F.col("v")))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    counted = (
        good.groupBy(*keys, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_end", F.sum("_n").over(upto))
        .withColumn("_all", F.sum("_n").over(whole))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    )
    wanted = F.array(
        *[
            F.struct(F.lit(float(q)).alias("q"), F.lit(side).alias("side"), rank(q, "_all").alias("rank"))
            for q in fractions
            for side, rank in (("low", rank_low), ("high", rank_high))
        ]
    )
    targets = (
        counted.withColumn("_w", F.explode(wanted))
        .where((F.col("_w.rank") >= F.col("_begin")) & (F.col("_w.rank") < F.col("_end")))
        .groupBy(*keys, "_b")
        .agg(F.first("_begin").alias("_begin"), F.collect_list("_w").alias("_want"))
    )
    # Few buckets per group survive, so the second pass reads the samples but shuffles little.
    hit = attach_by_key(good, targets, [*keys, "_b"], spread_on)
    values = hit.groupBy(*keys, "_b", "v").agg(
        F.count("*").alias("_n"), F.first("_begin").alias("_begin"), F.first("_want").alias("_want")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("_to", F.col("_begin") + F.sum("_n").over(inside)).withColumn("_w", F.explode("_want"))
    picked = placed.where((F.col("_w.rank") >= F.col("_to") - F.col("_n")) & (F.col("_w.rank") < F.col("_to")))
    found = picked.groupBy(*keys, F.col("_w.q").alias("q")).agg(
        F.max(F.when(F.col("_w.side") == "low", F.col("v"))).alias("low"),
        F.max(F.when(F.col("_w.side") == "high", F.col("v"))).alias("high"),
    )
    empty = samples.groupBy(*keys).agg(F.max(finite("v")).alias("_any")).where("NOT coalesce(_any, false)")
    fractions_of = F.explode(F.array(*[F.lit(float(q)) for q in fractions])).alias("q")
    none = empty.select(*keys, fractions_of).withColumns({n: F.lit(None).cast(found.schema[n].dataType) for n in ("low", "high")})
    return found.unionByName(none)


def box_pyramid(samples: DataFrame, level: int, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Level ``level`` of the pyramid: the mean over boxes of 2^level x 2^level pixels."""
    return samples.groupBy(
        *keys,
        F.shiftright("y", level).alias("y"),
        F.shiftright("x", level).alias("x"),
        "band",
    ).agg(F.avg(F.col("v").cast("double")).alias("v"))


def box_blocks(blocks: DataFrame, level: int) -> DataFrame:
    """The same for packed rows, kept packed and never shuffled: float32 means of the boxes.

    Tiles must start at multiples of 2^level, as the tile grid does for any level below its step.
    """
    step = 1 << level
    others = [c for c in blocks.columns if c not in ("w", "h", "pixels", "x0", "y0")]
    half = {n: F.expr(f"({n} + {step - 1}) div {step}").cast("int") for n in ("w", "h")}
    moved = [F.expr(f"{n} div {step}").cast("int").alias(n) for n in ("x0", "y0") if n in blocks.columns]
    sized = blocks.withColumns({"_w": half["w"], "_h": half["h"]})

    def box(j: Column) -> Column:
        pixel = F.floor(j / F.col("c")).cast("int")
        left, top = (pixel % F.col("_w")) * step, F.floor(pixel / F.col("_w")).cast("int") * step
        across = F.least(F.lit(step), F.col("w") - left)
        down = F.least(F.lit(step), F.col("h") - top)
        inside = F.transform(
            F.sequence(F.lit(0), across * down - 1),
            lambda k: F.get(
                "pixels",
                ((top + F.floor(k / across).cast("int")) * F.col("w") + left + k % across) * F.col("c") + j % F.col("c"),
            ).cast("double"),
        )
        return F.aggregate(inside, F.lit(0.0), lambda acc, v: acc + v) / (across * down)

    means = F.transform(F.sequence(F.lit(0), F.expr("_w * _h * c - 1")), lambda j: f32(box(j)))
    # A separate step: new names must not be visible where the old sizes are still read.
    made = sized.withColumn("_means", means)
    return made.select(*others, *moved, F.col("_w").alias("w"), F.col("_h").alias("h"), F.col("_means").alias("pixels"))


def nearest_pyramid(samples: DataFrame, level: int, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """The nearest-neighbour variant: every 2^level-th pixel, a filter without a shuffle."""
    step = 1 << level
    return samples.where((F.col("x") % step == 0) & (F.col("y") % step == 0)).select(
        *keys, F.shiftright("y", level).alias("y"), F.shiftright("x", level).alias("x"), "band", "v"
    )


def pixel_bytes() -> Column:
    return F.col("w").cast("bigint") * F.col("h") * F.col("c") * 4


def frame_bytes(blocks: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Memory of the float32 samples per key."""
    return blocks.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.sum(pixel_bytes()).alias("bytes"))
