"""Frames without their pixels: where each one lies, and one fetch at the end.

An index has a row per frame with a ``place``: the file, the byte offset and length inside it, and the shape as far as the
header tells it. Listing, concatenating, shifting, pinning and aligning move places only. :func:`fetch` then reads the
bytes that the rows ask for, each file and frame once in a task, next to the rows that want them.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators.spread import join_keys, prefix_sum, settle
from frameloom.sources import codecs
from frameloom.sources.batches import FLUSH_ROWS, FLUSH_SAMPLES, Image, failed, float_lists, ok, typed
from frameloom.sources.ingest import RANGE_BYTES, _heads, _images, _layout, _one_frame, read_images
from frameloom.sources.listing import UNREADABLE, list_sources, open_source
from frameloom.sources.sniff import file_format

PLACE = "path string, kind string, offset bigint, length bigint, w int, h int, c int, dtype string, problem string"
_FIELDS = [f.split()[0] for f in PLACE.split(", ")]
CHUNK_FRAMES = 1 << 16  # frames of one file that one row unfolds to at once
OPEN_FILES = 16
CACHE_BYTES = 64 * 1024 * 1024
IMAGE = ("w int", "h int", "c int", "pixels array<float>", "status string", "error string")


def _told(head: bytes, size: int, kind: str) -> tuple:
    """Frames, offset, bytes a frame, w, h, c and element type of a file, by its header."""
    if kind in ("npy", "vpp"):
        dtype, n, h, w, c, offset = _layout(head, size, kind)
        return n, offset, h * w * c * dtype.itemsize, w, h, c, dtype.str
    if kind == "png" and len(head) >= 24:
        return 1, 0, size, int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big"), None, None
    return 1, 0, size, None, None, None, None


def _files(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                own, (path, size, head, problem, kind) = row[: len(keys)], row[len(keys) :]
                if not isinstance(problem, str):
                    try:
                        rows.append((*own, path, kind, *_told(bytes(head), int(size), kind), None))
                        continue
                    except codecs.DecodeError as failure:
                        problem = str(failure)
                rows.append((*own, path, kind, 1, 0, 0, None, None, None, None, problem))
            made = pd.DataFrame(rows, columns=[*keys, "path", "kind", "n", "offset", "length", "w", "h", "c", "dtype", "problem"])
            for name in ("w", "h", "c"):
                made[name] = made[name].astype("Int32")
            yield made

    return run


def file_table(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per file of ``paths(keys, path)``: its frames ``n`` and the layout of the first, from the header only.

    A file that cannot be opened or read has one frame with a ``problem``. An empty array file has none.
    """
    keys = list(keys)
    own = typed(paths, keys)
    heads = paths.select(*keys, "path").mapInPandas(_heads(keys), f"{own}, path string, _size bigint, _head binary, _problem string")
    told = heads.withColumn("kind", F.coalesce(file_format("_head"), F.lit("other")))
    schema = f"{own}, path string, kind string, n bigint, offset bigint, length bigint, w int, h int, c int, dtype string, problem string"
    return told.mapInPandas(_files(keys), schema)


def frames_of(files: DataFrame, keys: Sequence[str], first: Column | None = None) -> DataFrame:
    """Unfold files to frames: ``(keys, frame, place)``; ``first`` is the number of a file's first frame.

    Frames unfold in chunks, so that a file of a billion frames is many rows before it is one row a frame.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(CHUNK_FRAMES).cast("bigint"))
    chunks = files.where("n > 0").withColumn("_from", F.explode(starts)).withColumn("_first", F.lit(0).cast("bigint") if first is None else first)
    inside = F.sequence(F.col("_from"), F.least(F.col("_from") + (CHUNK_FRAMES - 1), F.col("n") - 1))
    each = chunks.withColumn("_k", F.explode(inside))
    at = (F.col("offset") + F.col("_k") * F.col("length")).alias("offset")
    place = F.struct(*[at if f == "offset" else F.col(f) for f in _FIELDS])
    return each.select(*keys, (F.col("_first") + F.col("_k")).alias("frame"), place.alias("place"))


def index_sequences(lines: DataFrame, column: str = "expression") -> DataFrame:
    """``(seq_id, frame, place)`` of every expression in ``lines(line_no, expression)``.

    Files are listed and their headers read once; the frames of an expression follow each other in the order of its files.
    """
    listed = list_sources(lines, column).select("line_no", F.col("frame").alias("file_no"), "path")
    files = settle(file_table(listed, ["line_no", "file_no"]), "files")
    starts = settle(prefix_sum(files.select("line_no", "file_no", "n"), ["line_no"], ["file_no"], F.col("n"), "first").drop("n"), "starts")
    placed = join_keys(files, starts, ["line_no", "file_no"])
    return frames_of(placed, ["line_no"], F.col("first")).withColumnRenamed("line_no", "seq_id")


class Reader:
    """Decoded frames of a task: a few open files, and the frames read last as far as they fit ``CACHE_BYTES``."""

    def __init__(self, opened: ExitStack, reads: Accumulator | None):
        self.opened, self.reads = opened, reads
        self.files: OrderedDict = OrderedDict()
        self.images: OrderedDict = OrderedDict()
        self.held = 0

    def image(self, place: dict | None) -> Image:
        if place is None:
            return (None, None, None, None, None, None)
        if place["problem"] is not None:
            return failed(place["problem"])
        key = place["path"], place["offset"]
        if key in self.images:
            self.images.move_to_end(key)
            return self.images[key]
        try:
            made = self._decode(place)
        except UNREADABLE as failure:
            made = failed(str(failure))
        if self.reads is not None:
            self.reads.add(1)
        self.images[key] = made
        self.held += 0 if made[3] is None else made[3].nbytes
        while self.held > CACHE_BYTES and len(self.images) > 1:
            _, old = self.images.popitem(last=False)
            self.held -= 0 if old[3] is None else old[3].nbytes
        return made

    def _decode(self, place: dict) -> Image:
        kind = place["kind"]
        if kind == "jpeg":
            return failed("unsupported format: jpeg", "unsupported")
        source = self._open(place["path"])
        source.seek(place["offset"])
        data = source.read(place["length"])
        if kind in ("npy", "vpp"):
            return _one_frame(data, np.dtype(place["dtype"]), place["h"], place["w"], place["c"], kind)
        return next(_images(data, kind))[1]

    def _open(self, path: str):
        if path not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.popitem(last=False)[1].close()
            one = ExitStack()
            one.source = one.enter_context(open_source(path))
            self.opened.callback(one.close)
            self.files[path] = one
        self.files.move_to_end(path)
        return self.files[path].source


def _fetcher(keep: list[str], places: list[str], names: list[list[str]], reads: Accumulator | None):
    def flushed(batch: pa.RecordBatch, rows: list[int], held: list[list[Image]]) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        columns = [batch.column(k).take(at) for k in keep]
        for k in range(len(places)):
            w, h, c, pixels, status, error = zip(*[images[k] for images in held])
            columns += [*(pa.array(v, pa.int32()) for v in (w, h, c)), float_lists(pixels), pa.array(status, pa.string()), pa.array(error, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, *[n for group in names for n in group]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as opened:
            reader = Reader(opened, reads)
            for batch in batches:
                asked = [batch.column(p).to_pylist() for p in places]
                rows, held, samples = [], [], 0
                for row, wanted in enumerate(zip(*asked)):
                    images = [reader.image(place) for place in wanted]
                    rows.append(row)
                    held.append(images)
                    samples += sum(0 if i[3] is None else i[3].size for i in images)
                    if samples >= FLUSH_SAMPLES or len(rows) >= FLUSH_ROWS:
                        yield flushed(batch, rows, held)
                        rows, held, samples = [], [], 0
                if rows:
                    yield flushed(batch, rows, held)

    return run


def tasks_for(spark: SparkSession, total_bytes: int) -> int:
    """Tasks for so many bytes to read: one for every ``RANGE_BYTES``, as many as there are cores where that is less work."""
    return max(min(spark.sparkContext.defaultParallelism, 1 + total_bytes // (RANGE_BYTES // 64)), -(-total_bytes // RANGE_BYTES), 1)


def fetch(
    refs: DataFrame, keys: Sequence[str], places: Sequence[str] = ("place",), suffixes: Sequence[str] = ("",), reads: Accumulator | None = None
) -> DataFrame:
    """Replace place columns by ``w, h, c, pixels, status, error`` (each with its suffix); other columns stay.

    Rows are laid out by keys and frame, so neighbours that want the same or the next frame of a file are read by one task
    one after the other. ``keys`` are the columns that tell sequences apart. A failure is a row with its reason; a NULL place
    gives NULLs. JPEG files go through the engine's image reader. ``reads`` counts the frames decoded.
    """
    spark = refs.sparkSession
    places, suffixes, keys = list(places), list(suffixes), list(keys)
    refs = settle(refs, "places")
    keep = [c for c in refs.columns if c not in places]
    told = refs.agg(*[F.sum(F.coalesce(F.col(p)["length"], F.lit(0))) for p in places], *[F.max(F.coalesce(F.col(p)["kind"] == "jpeg", F.lit(False))) for p in places]).first()
    total = sum(told[k] or 0 for k in range(len(places)))
    laid = refs.repartitionByRange(tasks_for(spark, total), *keys, "frame").sortWithinPartitions(*keys, "frame")
    names = [[f"{n.split()[0]}{s}" for n in IMAGE] for s in suffixes]
    types = [f"{n.split()[0]}{s} {n.split()[1]}" for s in suffixes for n in IMAGE]
    jpegs = [p for k, p in enumerate(places) if told[len(places) + k]]
    kept = [*keep, *jpegs]
    out = laid.mapInArrow(_fetcher(kept, places, names, reads), ", ".join([typed(refs, kept), *types]))
    if jpegs:
        listed = refs.select(F.explode(F.array(*jpegs)).alias("p")).where("p.kind = 'jpeg'").select(F.col("p.path").alias("path")).distinct()
        decoded = settle(read_jpegs(spark, listed), "jpegs")
        for p in jpegs:
            out = _with_jpegs(out, decoded, p, suffixes[places.index(p)])
    return out.select(*keep, *[n for group in names for n in group])


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def read_jpegs(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """``listed(path)`` of JPEG files -> ``(path, w, h, c, pixels, status, error)`` by the engine's image reader.

    The reader is asked for whole folders (it lists them on the driver anyway), restricted to the endings that occur.
    """
    folder, ending = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", r"(\.[^./]*)?$", 1)
    listed = settle(listed.select(F.col("path"), folder.alias("folder"), ending.alias("ending")), "jpeg-paths")
    folders = [r[0] for r in listed.select("folder").distinct().collect()]
    endings = sorted({r[0] for r in listed.select("ending").distinct().collect()})
    parts = [read_images(spark, folders, f"*{e}") for e in endings]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return listed.select("path").join(found.withColumn("_plain", _plain(F.col("path"))).drop("path").dropDuplicates(["_plain"]), _plain(F.col("path")) == F.col("_plain")).drop("_plain")


def _with_jpegs(out: DataFrame, decoded: DataFrame, place: str, suffix: str) -> DataFrame:
    names = [n.split()[0] for n in IMAGE]
    other = decoded.select(F.col("path").alias("_path"), F.struct(*names).alias("_jpeg"))
    met = out.join(other, (F.col(place)["kind"] == "jpeg") & (F.col(place)["path"] == F.col("_path")), "left")
    return met.withColumns({f"{n}{suffix}": F.when(F.col("_jpeg").isNotNull(), F.col("_jpeg")[n]).otherwise(F.col(f"{n}{suffix}")) for n in names}).drop("_jpeg", "_path")


def fetch_aligned(aligned: DataFrame, count: int, keys: Sequence[str] = ("seq_id",), reads: Accumulator | None = None) -> DataFrame:
    """Pixels of aligned indexes (``place_1 .. place_count``), in the columns that programs over aligned frames take."""
    numbers = range(1, count + 1)
    return fetch(aligned, keys, [f"place_{k}" for k in numbers], [f"_{k}" for k in numbers], reads)
