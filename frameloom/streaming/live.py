"""Streaming forms: newest version of changed sources, progressive histogram, frame clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.numeric import finite
from frameloom.operators.histogram import BINS, bin_factor, bin_of
from frameloom.operators.schedule import ticks_elapsed


def newest_versions(changes: DataFrame, payload: Sequence[str] = ("length",)) -> DataFrame:
    """Latest state of each path from a stream of (path, modified, ..., deleted) changes.

    Late older changes are ignored; a deletion is a row with ``deleted`` true. State is one
    row per path, combined before the shuffle.
    """
    state = F.struct("modified", "deleted", *payload)
    newest = changes.groupBy("path").agg(F.max_by(state, F.struct("modified", "deleted", *payload)).alias("_s"))
    return newest.select("path", "_s.*")


def progressive_histogram(samples: DataFrame, low, high, keys: Sequence[str]) -> DataFrame:
    """Counts per bin over a range fixed beforehand, growing as rows of the image arrive."""
    number = bin_of("v", low, bin_factor(low, high))
    binned = samples.where(finite("v")).select(*keys, "band", number.alias("bin"))
    return binned.where((F.col("bin") >= 0) & (F.col("bin") < BINS)).groupBy(*keys, "band", "bin").agg(
        F.count("*").alias("n")
    )


def rows_seen(samples: DataFrame, height: int, keys: Sequence[str]) -> DataFrame:
    """Progress of each image: share of its rows that has arrived (first band, first column stand for a row)."""
    starts = samples.where((F.col("x") == 0) & (F.col("band") == 0))
    return starts.groupBy(*keys).agg((F.count("*") / F.lit(height)).alias("progress"))


def clock_ticks(events: DataFrame, start: Column, fps: float) -> DataFrame:
    """Frame steps emitted by the time of each event, from the event's own timestamp. Stateless."""
    elapsed = F.unix_micros(F.col("ts")) - F.unix_micros(start)
    return events.withColumn("tick", ticks_elapsed(elapsed, fps))


def ticks_per_window(events: DataFrame, fps: float, keys: Sequence[str], late: str | None = None) -> DataFrame:
    """Events per frame period. All rows count, however late; ``late`` bounds the state and drops rows later than that."""
    period = f"{round(1_000_000 / abs(fps))} microseconds"
    timed = events.withWatermark("ts", late) if late else events
    return timed.groupBy(*keys, F.window("ts", period).alias("period")).agg(F.count("*").alias("n"))
