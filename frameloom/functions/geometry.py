"""Coordinate transforms between image and window, viewport rectangle, zoom levels, region measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.numeric import col


def to_window(p, center, image_size, window_size, zoom, factor=1.0) -> Column:
    """Window coordinate of an image coordinate, along one axis. ``center`` is normalised."""
    p, center, image_size, window_size = col(p), col(center), col(image_size), col(window_size)
    gain = _number(zoom) * _number(factor)
    return (p - center * image_size) * gain + window_size / 2


def to_image(p, center, image_size, window_size, zoom, factor=1.0) -> Column:
    """Inverse of :func:`to_window`."""
    p, center, image_size, window_size = col(p), col(center), col(image_size), col(window_size)
    gain = _number(zoom) * _number(factor)
    return center * image_size + (p - window_size / 2) / gain


def fit_zoom(window_w, window_h, image_w, image_h, factor=1.0) -> Column:
    """Largest zoom that shows the whole image."""
    f = _number(factor)
    return F.least(col(window_w) / (col(image_w) * f), col(window_h) / (col(image_h) * f))


def _power_below(zoom) -> Column:
    """Exponent of the largest power of two not above the zoom. The logarithm may be off by
    one unit in the last place at exact powers, so it is checked against the powers themselves."""
    zoom = col(zoom).cast("double")
    guess = F.floor(F.log2(zoom))
    two = F.lit(2.0)
    return guess + F.when(F.pow(two, guess + 1) <= zoom, 1).when(F.pow(two, guess) > zoom, -1).otherwise(0)


def zoom_in(zoom) -> Column:
    """Next power of two above."""
    return F.pow(F.lit(2.0), _power_below(zoom) + 1)


def zoom_out(zoom) -> Column:
    """Next power of two below."""
    low = _power_below(zoom)
    return F.pow(F.lit(2.0), F.when(F.pow(F.lit(2.0), low) == col(zoom), low - 1).otherwise(low))


def visible_region(center_x, center_y, image_w, image_h, window_w, window_h, zoom, factor=1.0) -> Column:
    """Half-open pixel rectangle seen in the window: grown by one pixel, floored, cut to the image."""
    zero = F.lit(0.0)
    left = F.floor(to_image(zero, center_x, image_w, window_w, zoom, factor) - 1)
    top = F.floor(to_image(zero, center_y, image_h, window_h, zoom, factor) - 1)
    right = F.floor(to_image(col(window_w), center_x, image_w, window_w, zoom, factor) + 1)
    bottom = F.floor(to_image(col(window_h), center_y, image_h, window_h, zoom, factor) + 1)

    def cut(v: Column, size) -> Column:
        return F.least(F.greatest(v.cast("int"), F.lit(0)), col(size))

    return F.struct(
        cut(left, image_w).alias("x0"),
        cut(top, image_h).alias("y0"),
        cut(right, image_w).alias("x1"),
        cut(bottom, image_h).alias("y1"),
    )


def viewport_fit_region(left, top, right, bottom, image_w, image_h) -> Column:
    """Half-open pixel rectangle whose range fits the display to a viewport given in image coordinates.

    The near corner is cut to the last pixel, the far one to the image edge; pixels the
    viewport only partly covers count. NULL when nothing of the image is left.
    """
    def near(v, size) -> Column:
        return F.least(F.greatest(col(v).cast("double"), F.lit(0.0)), (col(size) - 1).cast("double"))

    def far(v, size) -> Column:
        return F.least(F.greatest(col(v).cast("double"), F.lit(0.0)), col(size).cast("double"))

    x0, y0, x1, y1 = near(left, image_w), near(top, image_h), far(right, image_w), far(bottom, image_h)
    area = F.struct(
        F.floor(x0).cast("int").alias("x0"),
        F.floor(y0).cast("int").alias("y0"),
        F.ceil(x1).cast("int").alias("x1"),
        F.ceil(y1).cast("int").alias("y1"),
    )
    return F.when((x0 != x1) & (y0 != y1), area)


def diagonal(width, height) -> Column:
    return F.sqrt(col(width).cast("double") * col(width) + col(height).cast("double") * col(height))


def _number(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))
