"""Histograms of packed rows as dense arrays: a batch of frames or tiles is counted by numpy, 256 cells a row and band.

A state is an array of counts, or of the jumps of a smooth histogram; states of tiles add up cell by cell in the shuffle,
with sums on the way. Samples never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.sources.batches import packed_rows, typed

BINS = 256  # fixed value: number of histogram bins
SLICE_SAMPLES = 1 << 20  # samples that are worked on at once; one row is never cut
SLICE_CELLS = 1 << 17  # cells of the rows that are worked on at once
_SHAPE = ("h", "w", "c")


class Stack:
    """Rows of one batch that share a shape: their samples, ranges and places."""

    def __init__(self, batch: pa.RecordBatch, rows: np.ndarray, shape: tuple[int, int, int], samples: list[np.ndarray]):
        self.rows, (self.h, self.w, self.c) = rows, shape
        self.v = np.concatenate([samples[r] for r in rows]).reshape(len(rows), *shape) if len(rows) else np.zeros((0, *shape), np.float32)
        self.low, self.high = self._ranges(batch)
        self.x0, self.y0 = (self._numbers(batch, n, 0) for n in ("x0", "y0"))
        self.region = None
        if "_region" in batch.schema.names:
            held = batch.column("_region").take(pa.array(rows))
            self.region = [pc.fill_null(held.field(n).cast(pa.float64()), np.nan).to_numpy()[:, None] for n in ("x0", "y0", "x1", "y1")]

    def _numbers(self, batch: pa.RecordBatch, name: str, missing: float) -> np.ndarray:
        if name not in batch.schema.names:
            return np.full(len(self.rows), missing)
        return pc.fill_null(batch.column(name).cast(pa.float64()), np.nan).to_numpy()[self.rows]

    def _ranges(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        if "low" in batch.schema.names:
            low, high = (pc.fill_null(batch.column(n).cast(pa.float32()), np.float32(np.nan)).to_numpy()[self.rows] for n in ("low", "high"))
        else:
            flat = self.v.reshape(len(self.rows), -1)
            kept = np.isfinite(flat)
            low = np.where(kept, flat, np.float32(np.inf)).min(axis=1, initial=np.float32(np.inf))
            high = np.where(kept, flat, np.float32(-np.inf)).max(axis=1, initial=np.float32(-np.inf))
            low, high = (np.where(np.isfinite(x), x, np.float32(np.nan)) for x in (low, high))
        return (x.astype(np.float32)[:, None, None, None] for x in (low, high))

    def inside(self, reach: int) -> np.ndarray | bool:
        """Where a pixel, with ``reach`` more to the right and below, lies in the region of its row."""
        if self.region is None:
            return True
        x0, y0, x1, y1 = self.region
        x, y = self.x0[:, None] + np.arange(self.w - reach), self.y0[:, None] + np.arange(self.h - reach)
        across, down = (x >= x0) & (x + reach < x1), (y >= y0) & (y + reach < y1)
        return (down[:, :, None] & across[:, None, :])[..., None]

    def cells(self, at: np.ndarray, number: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Sums per (row, band, bin) of the entries at ``at`` (flat places of (row, y, x, band))."""
        n, per_row = len(self.rows), at.shape[1] * at.shape[2] * self.c
        where = np.flatnonzero(at)
        code = ((where // per_row) * self.c + where % self.c) * BINS + number.ravel()[where]
        return np.bincount(code, None if weights is None else weights.ravel()[where], n * self.c * BINS).reshape(n, self.c, BINS)


def stacks(batch: pa.RecordBatch) -> Iterator[Stack]:
    """The rows of a batch by shape, in slices; rows without pixels are left out."""
    samples = packed_rows(batch.column("pixels"))
    there = pc.is_valid(batch.column("pixels")).to_numpy(zero_copy_only=False)
    shapes = np.stack([pc.fill_null(batch.column(n), 0).to_numpy() for n in _SHAPE], axis=1)
    for shape in np.unique(shapes[there], axis=0):
        size = int(shape.prod())
        rows = np.flatnonzero(there & (shapes == shape).all(axis=1))
        step = max(1, min(SLICE_SAMPLES // max(1, size), SLICE_CELLS // max(1, int(shape[2]) * BINS)))
        if size:
            for at in range(0, len(rows), step):
                yield Stack(batch, rows[at : at + step], tuple(int(n) for n in shape), samples)


def exact_counts(s: Stack) -> np.ndarray:
    """Samples per (row, band, bin): truncating bins over the row's range in float32; a constant image counts in bin 0."""
    with np.errstate(all="ignore"):
        span = s.high - s.low
        wide = (np.float64(BINS - 1) / (s.high.astype(np.float64) - s.low)).astype(np.float32)
        factor = np.where(np.isinf(span), wide, np.where(span > 0, np.float32(BINS - 1) / span, np.float32(0)))
        factor = np.where(np.isnan(span), np.float32(np.nan), factor)
        place = ((s.v - s.low) * factor).astype(np.float64)
        if np.isinf(span).any():
            place = np.where(np.isinf(s.v - s.low), (s.v.astype(np.float64) - s.low) * factor.astype(np.float64), place)
        counts = np.isfinite(s.v) & (place > -1) & (place < BINS) & s.inside(0)
    return s.cells(counts, np.where(counts, place, 0).astype(np.int64))


def smooth_jumps_of(s: Stack) -> np.ndarray:
    """Jumps of the slope per (row, band, bin) of all 2x2 cells inside the rows; bands without a usable cell stay NaN."""
    found = np.zeros((len(s.rows), s.c, BINS))
    if s.h < 2 or s.w < 2:
        return np.full_like(found, np.nan)
    q = np.sort(np.stack([s.v[:, :-1, :-1], s.v[:, :-1, 1:], s.v[:, 1:, :-1], s.v[:, 1:, 1:]]), axis=0)
    with np.errstate(all="ignore"):
        span = s.high - s.low
        used = (q[0] < q[1]) & (q[1] < q[2]) & (q[2] < q[3]) & (q[0] >= s.low) & (q[3] <= s.high) & s.inside(1)
        b = np.rint(np.float32(BINS - 1) * (q - s.low) / span)
        used &= (b[0] < b[1]) & (b[1] < b[2]) & (b[2] < b[3])
        b = np.where(used, b, 0)
        height = 2.0 / (b[2] + b[3] - b[1] - b[0]).astype(np.float64)
        rise, fall = height / (b[1] - b[0]), height / (b[3] - b[2])
    for number, weight in zip(b.astype(np.int64), (rise, -rise, -fall, fall)):
        found += s.cells(used, number, weight)
    found[s.cells(used, np.zeros_like(b[0], np.int64))[:, :, 0] == 0] = np.nan
    return found


def _rows(batch: pa.RecordBatch, keys: Sequence[str], rows: np.ndarray, band: np.ndarray, number: np.ndarray, value: np.ndarray, name: str) -> pa.RecordBatch:
    at = pa.array(rows)
    columns = [batch.column(k).take(at) for k in keys]
    return pa.RecordBatch.from_arrays([*columns, pa.array(band, pa.int32()), pa.array(number, pa.int32()), pa.array(value)], names=[*keys, "band", "bin", name])


def _counter(keys: list[str], state, dense: bool, name: str):
    """Rows of the cells of each state: those above zero, or all 256 of a band (summed twice) where it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in stacks(batch):
                cells = state(s)
                if dense:
                    row, band = np.nonzero(~np.isnan(cells[:, :, 0]))
                    value = cells[row, band].cumsum(axis=1).cumsum(axis=1).ravel()
                    row, band, number = np.repeat(row, BINS), np.repeat(band, BINS), np.tile(np.arange(BINS), len(row))
                else:
                    row, band, number = np.nonzero(np.nan_to_num(cells))
                    value = cells[row, band, number]
                yield _rows(batch, keys, s.rows[row], band, number, value, name)

    return run


def _read(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    wanted = [*keys, "low", "high", "x0", "y0", "_region", *_SHAPE, "pixels"]
    return blocks.select(*[c for c in dict.fromkeys(wanted) if c in blocks.columns])


def counted(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, band, bin, n)`` of every row of ``blocks`` by itself; its range is ``low, high`` or, without them, its own."""
    keys = list(keys)
    return _read(blocks, keys).mapInArrow(_counter(keys, exact_counts, False, "n"), f"{typed(blocks, keys)}, band int, bin int, n bigint")


def jumps(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, band, bin, jump)`` of the cells inside every row of ``blocks``."""
    keys = list(keys)
    return _read(blocks, keys).mapInArrow(_counter(keys, smooth_jumps_of, False, "jump"), f"{typed(blocks, keys)}, band int, bin int, jump double")


def densities(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, band, bin, density)`` of whole frames: all 256 bins of every band with a usable cell, without a shuffle."""
    keys = list(keys)
    return _read(frames, keys).mapInArrow(_counter(keys, smooth_jumps_of, True, "density"), f"{typed(frames, keys)}, band int, bin int, density double")


def merged(states: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The cells of several states of a key added up."""
    return states.groupBy(*keys, "band", "bin").agg(F.sum(value).alias(value))
