"""Float32 column arithmetic: display range, scale/bias, contrast steps, size literals.

Samples are float32 and results must keep float32 rounding. Spark widens
``float / float`` to double, so every division is cast back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-scale ranges tried when snapping, the saturation
# fractions offered by default, and the contrast step per wheel notch.
DYNAMIC_RANGES = (1.0, 255.0, 65535.0, 4294967295.0)
SATURATIONS = (0.001, 0.01, 0.1)
WHEEL_STEP = 1.0 / 255.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def f32(c) -> Column:
    return col(c).cast("float")


def lit32(value: float) -> Column:
    return F.lit(float(value)).cast("float")


def finite(v) -> Column:
    """True for ordinary numbers. NaN sorts above +inf in Spark, so one test is enough."""
    return F.abs(col(v)) < F.lit(float("inf"))


def explode_computed(df, array: Column, name: str, keep):
    """One row per element of a computed array, evaluating the array once.

    A plain explode makes the optimizer test the array's size in a filter of its own, which
    computes it a second time and inlines everything it is built from.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def scale_of(radius) -> Column:
    return f32(lit32(1.0) / f32(lit32(2.0) * f32(radius)))


def bias_of(center, radius) -> Column:
    return f32(f32(f32(radius) - f32(center)) * scale_of(radius))


def auto_radius(low, high) -> Column:
    low, high = f32(low), f32(high)
    return F.when(low < high, f32(f32(high - low) / lit32(2.0))).otherwise(lit32(0.5))


def auto_center(low, high) -> Column:
    return f32(f32(f32(high) + f32(low)) / lit32(2.0))


def widen_radius(radius, wheel) -> Column:
    """One contrast step: the radius after ``wheel`` notches, never negative."""
    keep = f32(lit32(1.0) - f32(lit32(2.0 * WHEEL_STEP) * f32(wheel)))
    return F.greatest(lit32(0.0), f32(f32(radius) / keep))


def slide_center(center, radius, wheel, low, high) -> Column:
    """One brightness step: the center after ``wheel`` notches, kept inside the data range."""
    moved = f32(f32(center) + f32(f32(lit32(2.0) * f32(radius)) * f32(lit32(WHEEL_STEP) * f32(wheel))))
    return F.least(F.greatest(moved, f32(low)), f32(high))


def clamp01(v) -> Column:
    return F.least(lit32(1.0), F.greatest(lit32(0.0), f32(v)))


def snap_full_scale(low, high) -> Column:
    """Smallest known full scale that can hold the range, 1 when none can."""
    low, high = col(low).cast("double"), col(high).cast("double")
    choice = F.lit(DYNAMIC_RANGES[0])
    for full in reversed(DYNAMIC_RANGES):
        fits = (low > F.lit(-full / 1.5)) & ((high - low) < F.lit(full * 2.0))
        choice = F.when(fits, F.lit(full)).otherwise(choice)
    return choice


def displayed_low(centers, radius, n) -> Column:
    return F.array_min(F.transform(F.slice(col(centers), 1, n), lambda m: f32(m - f32(radius))))


def displayed_high(centers, radius, n) -> Column:
    return F.array_max(F.transform(F.slice(col(centers), 1, n), lambda m: f32(m + f32(radius))))


def megabytes(text) -> Column:
    """Decimal megabytes of a literal such as ``2GB``, ``300MB`` or ``12.5KB``; NULL otherwise."""
    text = col(text)

    def number(unit: str) -> Column:
        return F.regexp_extract(text, rf"([0-9.]+){unit}", 1)

    return (
        F.when(number("GB") != "", number("GB").try_cast("double") * 1000)
        .when(number("MB") != "", number("MB").try_cast("double"))
        .when(number("KB") != "", number("KB").try_cast("double") / 1000)
    )
