"""Which frame is shown at the n-th tick, in closed form, and the fixed-rate frame clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.numeric import col

DEFAULT_FPS = 30.0  # fixed value: playback rate when none is given


def looping_frame(tick, start, low, high, step=1) -> Column:
    """Wrap around inside [low, high]; ``step`` is 1 or -1."""
    tick, start, low, high = col(tick), col(start), col(low), col(high)
    span = high - low + 1
    return low + F.pmod(start - low + tick * _step(step), span)


def clamped_frame(tick, start, low, high, step=1) -> Column:
    """Stop at the bounds."""
    tick, start, low, high = col(tick), col(start), col(low), col(high)
    return F.least(high, F.greatest(low, start + tick * _step(step)))


def bouncing_frame(tick, start, low, high, step=1) -> Column:
    """Go back and forth: a triangle wave with each turning point shown once."""
    tick, start, low, high = col(tick), col(start), col(low), col(high)
    reach = high - low
    period = F.greatest(reach * 2, F.lit(1))
    phase = F.pmod(start - low + tick * _step(step), period)
    return F.when(reach <= 0, low).otherwise(low + F.least(phase, period - phase))


def ticks_elapsed(elapsed_us, fps) -> Column:
    """Frame steps emitted after some microseconds at |fps|: a step needs strictly more than its period."""
    periods = col(elapsed_us).cast("double") * F.abs(_number(fps)) / F.lit(1e6)
    return F.greatest(F.ceil(periods) - 1, F.lit(0)).cast("bigint")


def direction(fps) -> Column:
    """Playback direction: negative rates run backwards."""
    return F.when(_number(fps) >= 0, F.lit(1)).otherwise(F.lit(-1))


def _step(step) -> Column:
    return step if isinstance(step, Column) else F.lit(int(step))


def _number(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))
