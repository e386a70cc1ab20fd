"""From files to frames. Every failure stays in the table as ``status, error``.

Two ways in: ``decode_content`` for rows that already carry their bytes, and ``read_files``
for paths, which reads headers first and then spreads frame ranges of large array files
over tasks, each seeking to its own frames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators.spread import task_count
from frameloom.sources import codecs
from frameloom.sources.batches import IMAGE_SCHEMA, Image, failed, image_batches, ok, typed
from frameloom.sources.listing import UNREADABLE, open_source
from frameloom.sources.sniff import file_format

HEADER_BYTES = 4096
RANGE_BYTES = 64 * 1024 * 1024


def _header(source: BinaryIO) -> bytes:
    """The first bytes of a file, and the whole header of an npy file however long it says it is."""
    head = source.read(HEADER_BYTES)
    if head[:6] == b"\x93NUMPY" and len(head) >= 12:
        size = 10 + int.from_bytes(head[8:10], "little") if head[6] == 1 else 12 + int.from_bytes(head[8:12], "little")
        head += source.read(max(0, size - len(head)))
    return head


def _layout(head: bytes, length: int, kind: str) -> tuple[np.dtype, int, int, int, int, int]:
    """Element type, frames, h, w, c and data offset of an array file."""
    if kind == "vpp":
        return np.dtype("<f4"), *codecs.vpp_header(head, length), codecs.VPP_HEADER
    dtype, shape, offset = codecs.npy_header(head)
    return dtype, *codecs.frames_of_shape(shape), offset


def _one_frame(data: bytes, dtype: np.dtype, h: int, w: int, c: int, kind: str) -> Image:
    if len(data) != h * w * c * dtype.itemsize:
        return failed(f"{kind}: couldn't read frame")
    return ok(np.frombuffer(data, dtype).reshape(h, w, c))


def _images(content: bytes, kind: str) -> Iterator[tuple[int, Image]]:
    """All frames of one file's bytes, or one error."""
    try:
        if kind == "png":
            yield 0, ok(codecs.png_array(content))
        elif kind in ("npy", "vpp"):
            dtype, n, h, w, c, offset = _layout(content, len(content), kind)
            size = h * w * c * dtype.itemsize
            for i in range(n):
                yield i, _one_frame(content[offset + i * size : offset + (i + 1) * size], dtype, h, w, c, kind)
        else:
            yield 0, failed(f"unsupported format: {kind}", "unsupported")
    except codecs.DecodeError as problem:
        yield 0, failed(str(problem))


def decode_content(files: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """Decode rows of file bytes to frames; the frames of a file count from 0 in ``local_frame``."""
    keys = list(keys)

    def produced(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Image]]:
        for row, (kind, data) in enumerate(zip(batch.column("_kind"), batch.column("_content"))):
            for frame, image in _images(data.as_py() or b"", kind.as_py()):
                yield row, frame, image

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from image_batches(batch, keys, produced(batch))

    told = files.select(
        *keys, F.coalesce(file_format(content), F.lit("other")).alias("_kind"), F.col(content).alias("_content")
    )
    return told.mapInArrow(run, f"{typed(files, keys)}, {IMAGE_SCHEMA}")


def _heads(keys: list[str]):
    """Size and first bytes of each path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                try:
                    with open_source(row[-1]) as source:
                        head = _header(source)
                        rows.append((*row, source.seek(0, 2), head, None))
                except UNREADABLE as problem:  # a value, not a failed job
                    rows.append((*row, None, None, str(problem)))
            made = pd.DataFrame(rows, columns=[*keys, "path", "_size", "_head", "_problem"])
            made["_size"] = made["_size"].astype("Int64")
            yield made

    return run


def _ranges(keys: list[str], range_bytes: int):
    """Frame ranges of each file: one range for a picture, several for a long array file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                own, (path, size, head, problem, kind) = row[: len(keys)], row[len(keys) :]
                if isinstance(problem, str):
                    rows.append((*own, path, kind, 0, 0, problem))
                    continue
                try:
                    count, step = 1, 1
                    if kind in ("npy", "vpp"):
                        dtype, count, h, w, c, _ = _layout(bytes(head), int(size), kind)
                        step = max(1, range_bytes // max(1, h * w * c * dtype.itemsize))
                    rows.extend((*own, path, kind, s, min(step, count - s), None) for s in range(0, count, step))
                except codecs.DecodeError as failure:
                    rows.append((*own, path, kind, 0, 0, str(failure)))
            yield pd.DataFrame(rows, columns=[*keys, "path", "_kind", "_start", "_count", "_problem"])

    return run


def _read_range(path: str, kind: str, start: int, count: int) -> Iterator[tuple[int, Image]]:
    with open_source(path) as source:
        if kind not in ("npy", "vpp"):
            yield from _images(source.read(), kind)
            return
        dtype, _, h, w, c, offset = _layout(_header(source), source.seek(0, 2), kind)
        size = h * w * c * dtype.itemsize
        source.seek(offset + start * size)
        for i in range(start, start + count):
            yield i, _one_frame(source.read(size), dtype, h, w, c, kind)


def _range_images(path: str, kind: str, start: int, count: int, problem: str | None) -> Iterator[tuple[int, Image]]:
    if problem is not None:
        yield 0, failed(problem)
        return
    after = start
    try:
        for frame, image in _read_range(path, kind, start, count):
            yield frame, image
            after = frame + 1
    except UNREADABLE as failure:  # one row for every frame that was not read
        for frame in range(after, max(start + count, after + (after == start))):
            yield frame, failed(str(failure))


def _read(keys: list[str]):
    def produced(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Image]]:
        parts = [batch.column(n).to_pylist() for n in ("path", "_kind", "_start", "_count", "_problem")]
        for row, part in enumerate(zip(*parts)):
            for frame, image in _range_images(*part):
                yield row, frame, image

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from image_batches(batch, keys, produced(batch))

    return run


def read_files(paths: DataFrame, keys: Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Decode the files of a path table. Long array files are cut into frame ranges that
    separate tasks read by seeking, so one huge file does not become one task."""
    keys = list(keys)
    own = typed(paths, keys)
    heads = paths.select(*keys, "path").mapInPandas(
        _heads(keys), f"{own}, path string, _size bigint, _head binary, _problem string"
    )
    told = heads.withColumn("_kind", F.coalesce(file_format("_head"), F.lit("other")))
    ranges = told.mapInPandas(
        _ranges(keys, range_bytes), f"{own}, path string, _kind string, _start bigint, _count bigint, _problem string"
    )
    return ranges.repartition(task_count(paths.sparkSession), "path", "_start").mapInArrow(_read(keys), f"{own}, {IMAGE_SCHEMA}")


def load_sequences(lines: DataFrame, column: str = "expression") -> DataFrame:
    """Frames of every expression (``line_no``, text): list, number them end to end by their headers, read each once."""
    from frameloom.sources.frame_index import fetch, index_sequences

    return fetch(index_sequences(lines, column), ["seq_id"])


def read_images(spark: SparkSession, path: str | list[str], names: str | None = None) -> DataFrame:
    """JPEG and 8-bit PNG files through Spark's own image reader, as RGB frames with status; ``names`` is a pattern of file names."""
    reader = spark.read.format("image").option("dropInvalid", "false")
    image = (reader.option("pathGlobFilter", names) if names else reader).load(path).select("image.*")

    @F.pandas_udf("array<float>")
    def unpack(data: pd.Series, channels: pd.Series) -> pd.Series:
        """The reader stores blue first; put red first again."""
        out = []
        for raw, c in zip(data, channels):
            samples = np.frombuffer(raw or b"", np.uint8).astype(np.float32)
            if c >= 3:
                samples = samples.reshape(-1, c)[:, [2, 1, 0, *range(3, c)]].reshape(-1)
            out.append(samples)
        return pd.Series(out)

    good = F.col("width") > 0

    def when_good(value):
        return F.when(good, value)

    return image.select(
        F.col("origin").alias("path"),
        when_good(F.col("width")).alias("w"),
        when_good(F.col("height")).alias("h"),
        when_good(F.col("nChannels")).alias("c"),
        when_good(unpack("data", "nChannels")).alias("pixels"),
        F.when(good, "ok").otherwise("error").alias("status"),
        F.when(~good, "cannot decode image").alias("error"),
    )


def frames_from_arrays(spark: SparkSession, *arrays) -> DataFrame:
    """Frames of arrays ``([n,] h, w[, c])`` held by the caller; each array is one sequence."""
    rows = []
    for seq, array in enumerate(arrays):
        if type(array).__module__ == "torch":
            array = array.cpu().detach().numpy()
        array = np.asarray(array)
        n, h, w, c = codecs.frames_of_shape(array.shape)
        for i, image in enumerate(array.reshape(n, h, w, c).astype(np.float32)):
            rows.append({"seq_id": seq, "frame": i, "w": w, "h": h, "c": c, "pixels": image.reshape(-1)})
    schema = pa.schema(
        [
            ("seq_id", pa.int32()),
            ("frame", pa.int64()),
            ("w", pa.int32()),
            ("h", pa.int32()),
            ("c", pa.int32()),
            ("pixels", pa.list_(pa.float32())),
        ]
    )
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def good_frames(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("status") == "ok").drop("status", "error")


def quarantine(frames: DataFrame) -> DataFrame:
    """Rows that failed, with their reason and without pixels."""
    return frames.where(F.col("status") != "ok").drop("w", "h", "c", "pixels")

