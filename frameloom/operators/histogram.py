"""256-bin histograms: exact, restricted to a region, and the smooth (bilinear-cell) variant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.functions.numeric import col, f32, finite, lit32
from frameloom.model import FRAME_KEYS, to_samples
from frameloom.operators import dense
from frameloom.operators.dense import BINS
from frameloom.operators.pixels import blocks_touching
from frameloom.operators.spread import attach_by_key
from frameloom.operators.stats import block_high, block_low

def bin_factor(low, high) -> Column:
    """Bins per unit in float32; 0 for a constant image, which puts every sample in bin 0."""
    span = f32(f32(high) - f32(low))
    wide = F.lit(float(BINS - 1)) / (col(high).cast("double") - col(low).cast("double"))
    return F.when(span == float("inf"), f32(wide)).when(span > 0, f32(lit32(BINS - 1) / span)).otherwise(lit32(0.0))


#: Bins per unit up to which a range is wider than float32 can tell; its bins are placed in double.
WIDE_FACTOR = (BINS - 1) / 3.4028234663852886e38


def bin_of(v, low, factor) -> Column:
    """Truncating bin number; only a sample equal to the maximum reaches the last bin. NULL far outside of the range.

    Whether to count in float32 or in double is the range's choice, told by its factor, so a sample is placed once.
    """
    wide = (col(v).cast("double") - col(low).cast("double")) * col(factor).cast("double")
    narrow = f32(f32(f32(v) - f32(low)) * f32(factor)).cast("double")
    return F.when((f32(factor) > 0) & (f32(factor) <= lit32(WIDE_FACTOR)), wide).otherwise(narrow).try_cast("int")


def with_range(blocks: DataFrame, ranges: DataFrame | None = None, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Add ``low, high`` to packed rows: from the row itself when it is a whole frame, else from ``ranges``."""
    if ranges is None:
        return blocks.withColumn("low", block_low()).withColumn("high", block_high())
    position = [c for c in ("x0", "y0") if c in blocks.columns] or list(keys)
    return attach_by_key(blocks, ranges, keys, [*keys, *position])


def count_bins(samples: DataFrame, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Exact histogram of samples that carry ``low, high``. Counts combine before the shuffle."""
    binned = samples.where(finite("v")).select(
        *keys, "band", bin_of("v", "low", bin_factor("low", "high")).alias("bin")
    )
    return (
        binned.where((F.col("bin") >= 0) & (F.col("bin") < BINS))
        .groupBy(*keys, "band", "bin")
        .agg(F.count("*").alias("n"))
    )


def count_bins_in_rows(frames: DataFrame, region: str | None = None, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """The same for whole frames: counted batch by batch as dense arrays, no shuffle. Without ``low, high`` a frame's own range counts."""
    return dense.counted(frames if region is None else frames.withColumn("_region", F.col(region)), keys)


def exact_histogram(
    blocks: DataFrame, ranges: DataFrame | None = None, region: Column | None = None, keys: Sequence[str] = FRAME_KEYS
) -> DataFrame:
    """Histogram per band over the frame's own finite range; a region narrows the samples, not the range.

    Whole frames are counted in place. Tiles need the ``ranges`` of their frames and add up
    their counts in a shuffle of at most 256 rows per band, frame and task.
    """
    framed = blocks if region is None else blocks.withColumn("_region", region)
    if ranges is None:
        return count_bins_in_rows(framed, None if region is None else "_region", keys)
    ranged = with_range(framed if region is None else blocks_touching(framed, "_region"), ranges, keys)
    return dense.merged(dense.counted(ranged, keys), keys, "n")


def _cells_on_seams(blocks: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Cells that straddle blocks. Only samples on block borders are shuffled.

    A border sample goes to the (at most four) cells it is a corner of; a cell is complete
    when all four corners meet and they come from more than one block.
    """
    sized = blocks.withColumn("_bw", F.col("w")).withColumn("_bh", F.col("h"))
    edge = to_samples(sized, keys, keep=(*keep, "x0", "y0", "_bw", "_bh")).where(
        (F.col("x") == F.col("x0"))
        | (F.col("y") == F.col("y0"))
        | (F.col("x") == F.col("x0") + F.col("_bw") - 1)
        | (F.col("y") == F.col("y0") + F.col("_bh") - 1)
    )
    corners = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)])
    offered = edge.withColumn("_d", F.explode(corners)).select(
        *keys,
        *keep,
        (F.col("y") - F.col("_d.dy")).alias("y"),
        (F.col("x") - F.col("_d.dx")).alias("x"),
        "band",
        "v",
        F.struct("x0", "y0").alias("_from"),
    )
    met = offered.groupBy(*keys, *keep, "y", "x", "band").agg(
        F.sort_array(F.collect_list("v")).alias("q"),
        F.min("_from").alias("_first"),
        F.max("_from").alias("_last"),
    )
    return met.where((F.size("q") == 4) & (F.col("_first") != F.col("_last"))).select(
        *keys, *keep, "y", "x", "band", "q"
    )


def smooth_jumps(cell_rows: DataFrame, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Second derivative of the density: four signed jumps per usable cell, summed per bin.

    A cell is unusable when two of its values tie or two of them share a bin. Values go to
    the nearest bin, halves to the even one.
    """
    span = f32(F.col("high") - F.col("low"))

    def nearest(k: int) -> Column:
        scaled = f32(f32(lit32(BINS - 1) * f32(F.col("q")[k] - F.col("low"))) / span)
        return F.rint(scaled).cast("int")

    q = F.col("q")
    strict = (q[0] < q[1]) & (q[1] < q[2]) & (q[2] < q[3]) & (q[0] >= F.col("low")) & (q[3] <= F.col("high"))
    placed = cell_rows.where(strict).select(*keys, "band", *[nearest(k).alias(f"b{k}") for k in range(4)])
    placed = placed.where("b0 < b1 and b1 < b2 and b2 < b3")
    height = F.lit(2.0) / (F.col("b2") + F.col("b3") - F.col("b1") - F.col("b0")).cast("double")
    rise, fall = height / (F.col("b1") - F.col("b0")), height / (F.col("b3") - F.col("b2"))
    four = F.array(
        F.struct(F.col("b0").alias("bin"), rise.alias("jump")),
        F.struct(F.col("b1").alias("bin"), (-rise).alias("jump")),
        F.struct(F.col("b2").alias("bin"), (-fall).alias("jump")),
        F.struct(F.col("b3").alias("bin"), fall.alias("jump")),
    )
    return (
        placed.select(*keys, "band", F.inline(four)).groupBy(*keys, "band", "bin").agg(F.sum("jump").alias("jump"))
    )


def smooth_histogram(
    blocks: DataFrame,
    ranges: DataFrame | None = None,
    region: Column | None = None,
    keys: Sequence[str] = FRAME_KEYS,
) -> DataFrame:
    """Density of the bilinearly interpolated image at 256 bins: the jumps, summed twice.

    Whole frames are done in place; tiles add up the jumps of their inner cells and of the cells on their seams. With a region, cells whose four pixels lie inside it are used. Bins are dense, and the
    two running sums run over exactly 256 rows per frame and band.
    """
    framed, keep = blocks, ("low", "high")
    if region is not None:
        framed, keep = blocks.withColumn("_region", region), ("low", "high", "_region")
    if "x0" not in blocks.columns:
        return dense.densities(framed if ranges is None else with_range(framed, ranges, keys), keys)
    ranged = with_range(framed, ranges, keys)
    seams = _cells_on_seams(ranged, keys, keep)
    if region is not None:
        r = F.col("_region")
        seams = seams.where(
            (F.col("x") >= r["x0"]) & (F.col("x") + 1 < r["x1"]) & (F.col("y") >= r["y0"]) & (F.col("y") + 1 < r["y1"])
        )
    found = dense.jumps(ranged, keys).unionByName(smooth_jumps(seams, keys))
    return integrate_twice(dense.merged(found, keys, "jump"), keys)


def integrate_twice(jumps: DataFrame, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Dense bins and two running sums per frame and band (256 rows each, packed in one row first)."""
    table = jumps.groupBy(*keys, "band").agg(F.map_from_entries(F.collect_list(F.struct("bin", "jump"))).alias("_j"))
    dense = table.select(
        *keys, "band", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"), "_j"
    ).withColumn("jump", F.coalesce(F.col("_j")[F.col("bin")], F.lit(0.0)))
    running = Window.partitionBy(*keys, "band").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    first = dense.select(*keys, "band", "bin", F.sum("jump").over(running).alias("slope"))
    return first.select(*keys, "band", "bin", F.sum("slope").over(running).alias("density"))


def whole_counts(density) -> Column:
    """The truncated integer form of a density."""
    return col(density).cast("bigint")


def range_markers(low, high, shown_low, shown_high) -> tuple[Column, Column]:
    """First and last histogram bin of the displayed range."""
    factor = bin_factor(low, high)
    first = F.floor(f32(f32(f32(shown_low) - f32(low)) * factor)).cast("int")
    last = F.ceil(f32(f32(f32(shown_high) - f32(low)) * factor)).cast("int")
    return first, last


def value_marker(v, low, high) -> Column:
    """Histogram bin of one pixel value."""
    return F.floor(f32(f32(f32(v) - f32(low)) * bin_factor(low, high))).cast("int")
