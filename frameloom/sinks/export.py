"""Array files out of frame tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.operators.stats import pixel_bytes
from frameloom.sources.batches import packed_rows, typed
from frameloom.sources.codecs import npy_bytes, png_bytes, vpp_bytes

CHUNK_BYTES = 64 * 1024 * 1024

ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {
    "npy": npy_bytes,
    "vpp": vpp_bytes,
    "png": lambda frames: png_bytes(frames[0]),
}


def array_files(frames: DataFrame, kind: str = "npy", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Consecutive frames of one size packed into array files of about ``chunk_bytes`` each.

    Frames are dense per sequence. Rows are grouped by (sequence, size, chunk) and a chunk
    has a bounded size, so a long sequence becomes many files made by many tasks.
    Output: ``seq_id, w, h, c, chunk, first_frame, n, content``.
    """
    types = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    keys = ["seq_id", "w", "h", "c", "chunk"]

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame")
        head = part.iloc[:1]
        shape = (len(part), int(head.h.iloc[0]), int(head.w.iloc[0]), int(head.c.iloc[0]))
        data = np.stack([np.asarray(p, np.float32) for p in part.pixels]).reshape(shape)
        made = head[keys].copy()
        made["first_frame"] = head.frame
        made["n"] = len(part)
        made["content"] = [ENCODERS[kind](data)]
        return made

    per_chunk = F.greatest(F.lit(1), F.floor(F.lit(chunk_bytes) / pixel_bytes()))
    chunked = frames.select(
        *keys[:4], "frame", "pixels", F.floor(F.col("frame") / per_chunk).cast("bigint").alias("chunk")
    )
    return chunked.groupBy(*keys).applyInPandas(
        encode,
        f"seq_id {types['seq_id']}, w int, h int, c int, chunk bigint, first_frame bigint, n int, content binary",
    )


def frame_files(frames: DataFrame, kind: str, dtype: str = "float32") -> DataFrame:
    """One file per whole frame, encoded in place: ``seq_id, frame, content``. No shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(*[batch.column(n).to_numpy() for n in ("h", "w", "c")])
            files = [
                ENCODERS[kind](row.astype(dtype).reshape(1, h, w, c))
                for row, (h, w, c) in zip(packed_rows(batch.column("pixels")), sizes)
            ]
            columns = [batch.column("seq_id"), batch.column("frame"), pa.array(files, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "frame", "content"])

    own = frames.select("seq_id", "frame", "w", "h", "c", "pixels")
    return own.mapInArrow(encode, f"{typed(frames, ['seq_id', 'frame'])}, content binary")
