"""Tone maps: from band values to red, green, blue columns in 0..1, as plain column arithmetic.

A tone map is a function ``(bands, scale, bias) -> (r, g, b)`` where ``bands`` are three raw
band columns and ``scale``/``bias`` come from the display range. Users add their own by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.numeric import clamp01, f32

ToneMap = Callable[[tuple[Column, Column, Column], Column, Column], tuple[Column, Column, Column]]

# The names of the built-in maps, the jet ramp (input divisor and offset,
# peak height, slope, and the centres of red, green and blue) and the HSV sector width.
DEFAULT, GRAY, FLOW, JET = "default", "gray", "opticalFlow", "jet"
JET_DIVISOR, JET_OFFSET, JET_PEAK, JET_SLOPE = 1.15, 0.1, 1.5, 4.0
JET_CENTRES = (0.75, 0.50, 0.25)
SECTOR = 60.0
PI = 3.1415926535897932


def scaled(v, scale, bias) -> Column:
    """Display value of a sample: scaled, shifted and cut to 0..1, in float32."""
    return clamp01(f32(f32(f32(v) * f32(scale)) + f32(bias)))


def plain(bands, scale, bias):
    """Three bands as red, green, blue."""
    return tuple(scaled(v, scale, bias) for v in bands)


def gray(bands, scale, bias):
    """The first band in all three channels."""
    level = scaled(bands[0], scale, bias)
    return level, level, level


def jet(bands, scale, bias):
    """Blue-to-red ramp of the first band; the ramp itself is not cut to 0..1."""
    d = scaled(bands[0], scale, bias).cast("double") / JET_DIVISOR + JET_OFFSET
    return tuple(F.lit(JET_PEAK) - F.abs(d - centre) * JET_SLOPE for centre in JET_CENTRES)


def flow_angle(x: Column, y: Column) -> Column:
    """Angle in degrees, 0..360, of a displacement; straight along +x it is 0, not 360."""
    seam = (y == 0) & (x > 0)
    arc = F.when(seam, F.lit(-PI)).otherwise(F.atan2(y, -x))
    return (F.lit(180.0) / F.lit(PI)) * (F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(arc) + PI)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees (0..360), saturation and value to red, green, blue.

    Each channel dips by ``v * s`` away from its own sixth of the circle; the dip is a tent of
    the turn, cut to 0..1, which names the hue only once per channel. A hue of exactly 360
    falls in the first sixth with a fraction of 6, which lifts green above ``v``.
    """

    def channel(offset: int) -> Column:
        turn = F.pmod(h / SECTOR + offset, F.lit(6.0))
        dip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) - F.abs(turn - 2.0)))
        return v - v * s * dip

    return channel(5), F.when(h >= 360, v * (s * 5 + 1)).otherwise(channel(3)), channel(1)


def optical_flow(bands, scale, bias):
    """Direction as hue, length (scaled, cut to 0..1) as saturation and value. Works on raw values."""
    x, y = bands[0].cast("double"), bands[1].cast("double")
    length = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sqrt(x * x + y * y) * scale.cast("double")))
    return hsv_to_rgb(flow_angle(x, y), length, length)


_MAPS: dict[str, ToneMap] = {DEFAULT: plain, GRAY: gray, FLOW: optical_flow, JET: jet}


def register_tone_map(name: str, build: ToneMap) -> None:
    """Add or replace a tone map."""
    _MAPS[name] = build


def tone_map_names() -> list[str]:
    """All tone maps in name order, which is also the order of cycling."""
    return sorted(_MAPS)


def tone_map(name: str) -> ToneMap:
    return _MAPS[name]


def next_tone_map(name: str, step: int = 1) -> str:
    """The following (or, with -1, preceding) tone map, wrapping around."""
    names = tone_map_names()
    if name not in names:
        return names[0] if step > 0 else names[-1]
    return names[(names.index(name) + step) % len(names)]


def default_tone(channels) -> Column:
    """Name of the tone map chosen for an image by its number of bands."""
    channels = F.col(channels) if isinstance(channels, str) else channels
    return F.when(channels == 1, F.lit(GRAY)).when(channels == 2, F.lit(FLOW)).otherwise(F.lit(DEFAULT))


def apply_tone(name: str, bands, scale, bias) -> list[Column]:
    """The chosen map as three named columns ``r, g, b``."""
    channels = tone_map(name)(bands, scale, bias)
    return [value.alias(label) for value, label in zip(channels, ("r", "g", "b"))]


def to_byte(v) -> Column:
    """Nearest byte of a 0..1 colour value."""
    v = F.col(v) if isinstance(v, str) else v
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 255 + 0.5).cast("int")))
