"""Arrow batches of images: packed rows in and out of tasks without per-value conversion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FLUSH_SAMPLES = 8 * 1024 * 1024
FLUSH_ROWS = 4096

IMAGE_SCHEMA = "local_frame bigint, w int, h int, c int, pixels array<float>, status string, error string"

Image = tuple  # (w, h, c, flat float32 samples or None, status, error)


def ok(image: np.ndarray) -> Image:
    h, w, c = image.shape
    return w, h, c, np.ascontiguousarray(image, dtype=np.float32).reshape(-1), "ok", None


def failed(message: str, status: str = "error") -> Image:
    return None, None, None, None, status, message


def typed(df: DataFrame, names: Sequence[str]) -> str:
    """Schema text of some columns of a table."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{n} {types[n]}" for n in names)


def packed_rows(column: pa.Array) -> list[np.ndarray]:
    """The samples of each row of an ARRAY<FLOAT> column, as views of one buffer."""
    flat = column.values.to_numpy(zero_copy_only=False)
    edges = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]


def float_lists(rows: Sequence[np.ndarray | None]) -> pa.Array:
    """An ARRAY<FLOAT> column of numpy rows; None becomes NULL."""
    sizes = np.array([0 if r is None else r.size for r in rows], dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    kept = [r for r in rows if r is not None]
    flat = np.concatenate(kept).astype(np.float32, copy=False) if kept else np.zeros(0, np.float32)
    empty = np.array([r is None for r in rows], dtype=bool)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat, pa.float32()), mask=pa.array(empty))


def image_batches(
    batch: pa.RecordBatch, keys: Sequence[str], produced: Iterable[tuple[int, int, Image]]
) -> Iterator[pa.RecordBatch]:
    """Output batches of ``(input row, frame in file, image)``, cut before they grow large."""
    held: list[tuple[int, int, Image]] = []
    samples = 0
    for item in produced:
        held.append(item)
        samples += 0 if item[2][3] is None else item[2][3].size
        if samples >= FLUSH_SAMPLES or len(held) >= FLUSH_ROWS:
            yield _image_batch(batch, keys, held)
            held, samples = [], 0
    if held:
        yield _image_batch(batch, keys, held)


def _image_batch(batch: pa.RecordBatch, keys: Sequence[str], held: list[tuple[int, int, Image]]) -> pa.RecordBatch:
    rows = pa.array([row for row, _, _ in held], pa.int64())
    w, h, c, pixels, status, error = zip(*[image for _, _, image in held])
    columns = {k: batch.column(k).take(rows) for k in keys}
    columns["local_frame"] = pa.array([frame for _, frame, _ in held], pa.int64())
    columns["w"], columns["h"], columns["c"] = (pa.array(v, pa.int32()) for v in (w, h, c))
    columns["pixels"] = float_lists(pixels)
    columns["status"], columns["error"] = pa.array(status, pa.string()), pa.array(error, pa.string())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
