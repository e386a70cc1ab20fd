"""Programs over aligned frames: per pixel as SQL expressions, per image as numpy functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.program_text import PLACES, ProgramError, compile_text, evaluate
from frameloom.model import to_samples
from frameloom.operators.collections import align, pin, shift
from frameloom.sources.batches import IMAGE_SCHEMA, Image, failed, image_batches, ok, packed_rows, typed

_FRAME_PAYLOAD = ("w", "h", "c", "pixels")


def split_program(text: str) -> tuple[str, str]:
    """``"1,2@-1,3@0 x y + z -"`` as the list of inputs and the program."""
    inputs, _, program = text.lstrip().partition(" ")
    return inputs, program.strip(" ")


def pick_inputs(spec: str, sequences: Sequence[DataFrame]) -> list[DataFrame]:
    """Inputs named by ``"1,2@-1,3@0"``: sequence numbers from 1, ``@+k``/``@-k`` shifted, ``@k`` pinned (from 0).

    Numbers without a sequence are skipped; the list ends at its first blank or where no number follows.
    """
    chosen = []
    for part in split_program(spec)[0].split(","):
        named = re.match(r"(\d+)(?:@([+-]?)(\d+)|(@))?", part)
        if not named:
            break
        number, sign, at, broken = named.groups()
        index = int(number) - 1
        if 0 <= index < len(sequences):
            if broken:
                break
            frames = sequences[index]
            if at and sign:
                frames = shift(frames, int(sign + at))
            elif at:
                frames = pin(frames, int(at))
            chosen.append(frames)
    if not chosen:
        raise ValueError(f"no input sequence in {spec!r}")
    return chosen


def align_images(inputs: Sequence[DataFrame], keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Aligned whole frames, columns ``w_k, h_k, c_k, pixels_k``, and ``status_k, error_k`` when
    every input carries them."""
    told = all({"status", "error"} <= set(df.columns) for df in inputs)
    return align(inputs, (*_FRAME_PAYLOAD, "status", "error") if told else _FRAME_PAYLOAD, keys)


def failed_edits(aligned: DataFrame, count: int, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Aligned frames with a failed input, with the error of the first one."""
    numbers = range(1, count + 1)
    error = first_error([f"status_{k}" for k in numbers], [f"error_{k}" for k in numbers])
    return aligned.select(*keys, "frame", error.alias("error")).where(F.col("error").isNotNull())


def usable_edits(aligned: DataFrame, count: int) -> DataFrame:
    """Aligned frames all of whose inputs are good."""
    for k in range(1, count + 1):
        aligned = aligned.where(F.col(f"status_{k}") == "ok").drop(f"status_{k}", f"error_{k}")
    return aligned


def first_error(statuses: Sequence[str], errors: Sequence[str]) -> Column:
    """Error of the first failed input, NULL when all are good."""
    return F.coalesce(*[F.when(F.col(s) != "ok", F.col(e)) for s, e in zip(statuses, errors)])


def _fitted(k: int, one_for_all: bool = False) -> Column:
    """Samples of input ``k`` at the places of the first input; NULL where input ``k`` has no such pixel or band.

    ``one_for_all``: an input of one band has it for every band.
    """
    own = F.col(f"pixels_{k}")
    if k == 1:
        return own
    w, h, c = (F.col(f"{n}_1") for n in ("w", "h", "c"))
    w_k, h_k, c_k = (F.col(f"{n}_{k}") for n in ("w", "h", "c"))

    def sample(i: Column) -> Column:
        band, x, y = i % c, F.floor(i / c) % w, F.floor(i / (c * w))
        band = F.when(c_k == 1, F.lit(0)).otherwise(band) if one_for_all else band
        return F.when((x < w_k) & (y < h_k) & (band < c_k), F.get(own, ((y * w_k + x) * c_k + band).cast("int")))

    moved = F.transform(F.sequence(F.lit(0), w * h * c - 1), sample)
    return F.when(own.isNull() | ((w == w_k) & (h == h_k) & (c == c_k)), own).otherwise(moved)


def run_scalar_program(aligned: DataFrame, program: str, count: int, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Evaluate a SQL expression over ``x1..xN`` for every sample, giving long-form samples.

    The samples of all inputs are unpacked side by side from one row, so nothing is joined
    per pixel. The result has the size of the first input; an input has NULL where it has no such sample.
    """
    flat = aligned.select(
        *keys, "frame", F.col("w_1").alias("w"), F.col("c_1").alias("c"),
        F.posexplode_outer(F.arrays_zip(*[_fitted(k).alias(f"x{k}") for k in range(1, count + 1)])).alias("_i", "_v"),
    ).select(*keys, "frame", "w", "c", "_i", "_v.*")
    kept = flat.where(F.col("x1").isNotNull()).withColumn("v", F.expr(program).cast("float"))
    return kept.select(
        *keys,
        "frame",
        F.expr("_i div (c * w)").cast("int").alias("y"),
        (F.expr("_i div c") % F.col("w")).cast("int").alias("x"),
        (F.col("_i") % F.col("c")).cast("int").alias("band"),
        "v",
    )


def _sample_places(count: int, one_for_all: bool) -> list[Column]:
    return [_fitted(k, one_for_all).alias(f"x{k}") for k in range(1, count + 1)]


def run_program_text(aligned: DataFrame, text: str, count: int, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Samples of a postfix program (see ``functions.program_text``) over aligned frames.

    Programs that treat bands alike are evaluated sample by sample, those that look at bands together pixel by pixel with
    as many output bands as they leave. Raises ``ProgramError`` if the variables do not match the number of images.
    """
    program = compile_text(text, count)
    if program.bands:
        def place(i: Column) -> dict[str, Column]:
            return {":i": i % F.col("w_1"), ":j": F.floor(i / F.col("w_1")), ":w": F.col("w_1"), ":h": F.col("h_1")}

        return to_samples(run_vector_program(aligned, lambda *images, at=None: evaluate(program, images, place(at)), count, keys, placed=True), [*keys, "frame"])
    widest = F.greatest(*[F.col(f"c_{k}") for k in range(1, count + 1)], F.lit(1))
    spread = aligned.withColumn("_c", widest).withColumn("pixels_1", F.when(F.col("c_1") == F.col("_c"), F.col("pixels_1")).otherwise(_widened(F.col("pixels_1"), F.col("_c"))))
    spread = spread.withColumn("c_1", F.when(F.col("c_1") == 1, F.col("_c")).otherwise(F.col("c_1")))
    flat = spread.select(
        *keys, "frame", F.col("w_1").alias("w"), F.col("h_1").alias("h"), F.col("c_1").alias("c"),
        F.posexplode_outer(F.arrays_zip(*_sample_places(count, True))).alias("_i", "_v"),
    ).select(*keys, "frame", "w", "h", "c", "_i", "_v.*").where(F.col("x1").isNotNull())
    y, x = F.expr("_i div (c * w)").cast("int"), (F.expr("_i div c") % F.col("w")).cast("int")
    value = evaluate(program, [F.col(f"x{k}") for k in range(1, count + 1)], {":i": x, ":j": y, ":w": F.col("w"), ":h": F.col("h")})
    return flat.select(*keys, "frame", y.alias("y"), x.alias("x"), (F.col("_i") % F.col("c")).cast("int").alias("band"), value.cast("float").alias("v"))


def _widened(pixels: Column, c: Column) -> Column:
    """The samples of a one-band image once for every band; other images as they are."""
    return F.when(F.col("c_1") == 1, F.flatten(F.transform(pixels, lambda v: F.array_repeat(v, c)))).otherwise(pixels)


def program_errors(aligned: DataFrame, text: str, count: int, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """``(keys, frame, status, error)`` of every aligned frame: the message of a program that cannot run, else ``ok``."""
    try:
        program = compile_text(text, count)
        evaluate(program, [F.col(f"pixels_{k}") for k in range(1, count + 1)], {p: F.lit(0) for p in PLACES})
        message = None
    except ProgramError as problem:
        message = str(problem)
    return aligned.select(*keys, "frame", F.lit("ok" if message is None else "error").alias("status"), F.lit(message).cast("string").alias("error"))


def run_packed_program(aligned: DataFrame, program: Callable[..., Column], count: int, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """The same for a function of N value columns, keeping frames packed."""
    zipped = F.arrays_zip(*[_fitted(k).alias(f"x{k}") for k in range(1, count + 1)])
    pixels = F.transform(zipped, lambda t: program(*[t[f"x{k}"] for k in range(1, count + 1)]).cast("float"))
    size = [F.col(f"{n}_1").alias(n) for n in ("w", "h", "c")]
    return aligned.select(*keys, "frame", *size, pixels.alias("pixels"))


def run_vector_program(
    aligned: DataFrame, program: Callable[..., Column], count: int, keys: Sequence[str] = ("seq_id",), placed: bool = False
) -> DataFrame:
    """A program over the band vectors of each pixel (ARRAY<FLOAT> columns) returning a band vector.

    The number of output bands is decided by the program. ``placed``: it also takes the pixel's number as ``at``.
    """
    def vector(k: int, i: Column) -> Column:
        x, y = i % F.col("w_1"), F.floor(i / F.col("w_1")).cast("int")
        own = F.slice(F.col(f"pixels_{k}"), (y * F.col(f"w_{k}") + x) * F.col(f"c_{k}") + 1, F.col(f"c_{k}"))
        return F.when((x < F.col(f"w_{k}")) & (y < F.col(f"h_{k}")), own)

    pixel_numbers = F.sequence(F.lit(0), F.col("w_1") * F.col("h_1") - 1)
    out = F.transform(
        pixel_numbers,
        lambda i: program(*[vector(k, i) for k in range(1, count + 1)], **({"at": i} if placed else {})).cast("array<float>"),
    )
    return aligned.select(*keys, "frame", F.col("w_1").alias("w"), F.col("h_1").alias("h"), out.alias("_v")).select(
        *keys, "frame", "w", "h", F.size(F.col("_v")[0]).alias("c"), F.flatten("_v").alias("pixels")
    )


def run_image_function(
    aligned: DataFrame,
    function: Callable[..., np.ndarray],
    count: int,
    keys: Sequence[str] = ("seq_id",),
) -> DataFrame:
    """A function of N arrays (h, w, c) giving one array of any size, one call per aligned frame.

    Frames arrive in Arrow batches; each row is already complete, so no grouping is needed.
    A failing call becomes an error row and its siblings continue.
    """
    keys = list(keys)
    numbers = range(1, count + 1)

    def call(images: list[np.ndarray]) -> Image:
        try:
            made = np.asarray(function(*images), dtype=np.float32)
            return ok(made[:, :, None] if made.ndim == 2 else made)
        except Exception as problem:  # an error is a value here
            return failed(str(problem))

    def produced(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Image]]:
        pixels = [packed_rows(batch.column(f"pixels_{k}")) for k in numbers]
        shapes = [list(zip(*[batch.column(f"{n}_{k}").to_pylist() for n in ("h", "w", "c")])) for k in numbers]
        frames = batch.column("frame").to_pylist()
        for row, frame in enumerate(frames):
            yield row, frame, call([p[row].reshape(s[row]) for p, s in zip(pixels, shapes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from image_batches(batch, keys, produced(batch))

    wanted = [f"{n}_{k}" for k in numbers for n in _FRAME_PAYLOAD]
    made = aligned.select(*keys, "frame", *wanted).mapInArrow(run, f"{typed(aligned, keys)}, {IMAGE_SCHEMA}")
    return made.withColumnRenamed("local_frame", "frame")
