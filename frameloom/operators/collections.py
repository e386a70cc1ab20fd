"""Algebra on ordered frame collections: concatenate, drop, pin, shift, align, play in step.

A collection is a table with key columns, a dense 0-based ``frame`` and any payload.
Order is data; nothing here relies on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.spread import HOT_ROWS, attach_by_key, hot_join, is_small, number_rows, prefix_sum, settle

SEQ = ("seq_id",)


def lengths(frames: DataFrame, keys: Sequence[str] = SEQ, out: str = "len") -> DataFrame:
    """Length of each collection, from the largest frame number."""
    return frames.groupBy(*keys).agg((F.max("frame") + 1).cast("bigint").alias(out))


def with_length(frames: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    return attach_by_key(frames, lengths(frames, keys), keys, [*keys, "frame"])


def concat(frames: DataFrame, part: str, keys: Sequence[str] = SEQ) -> DataFrame:
    """Join the parts of each collection end to end.

    ``frame`` is local to a part. Part offsets are a distributed running sum over the part
    lengths, so a collection made of a billion one-frame parts is no special case; frames
    themselves are neither sorted nor moved when the offsets are small.
    """
    parts = lengths(frames, [*keys, part])
    offsets = prefix_sum(parts, keys, [part], F.col("len"), "_offset").drop("len")
    placed = attach_by_key(frames, offsets, [*keys, part], [*keys, part, "frame"])
    return placed.withColumn("frame", F.col("_offset") + F.col("frame")).drop("_offset")


def drop_frame(frames: DataFrame, dropped: Column | int, keys: Sequence[str] = SEQ) -> DataFrame:
    """Remove one frame per collection and renumber; a collection of one frame stays as it is."""
    dropped = F.lit(dropped) if isinstance(dropped, int) else dropped
    sized = with_length(frames, keys).withColumn("_out", dropped)
    keep_all = F.col("len") <= 1
    kept = sized.where(keep_all | (F.col("frame") != F.col("_out")))
    moved = F.when(keep_all | (F.col("frame") < F.col("_out")), F.col("frame")).otherwise(F.col("frame") - 1)
    return kept.withColumn("frame", moved).drop("_out", "len")


def drop_frames(frames: DataFrame, dropped: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Remove any set of frames per collection, then number what is left."""
    left = frames.join(dropped.select(*keys, "frame"), [*keys, "frame"], "left_anti")
    return number_rows(left.withColumnRenamed("frame", "_was"), keys, ["_was"]).drop("_was")


def pin(frames: DataFrame, at: Column | int) -> DataFrame:
    """A one-frame collection holding frame ``at`` (0-based); empty when there is no such frame."""
    at = F.lit(at) if isinstance(at, int) else at
    return frames.where(F.col("frame") == at).withColumn("frame", F.lit(0).cast("bigint"))


def shift(frames: DataFrame, by: int, keys: Sequence[str] = SEQ) -> DataFrame:
    """Read ``by`` frames later (or earlier, repeating the first); the length changes by ``-by``.

    A forward shift past the end keeps the last frame.
    """
    if by >= 0:
        sized = with_length(frames, keys).withColumn("_by", F.least(F.lit(by).cast("bigint"), F.col("len") - 1))
        return (
            sized.where(F.col("frame") >= F.col("_by"))
            .withColumn("frame", F.col("frame") - F.col("_by"))
            .drop("_by", "len")
        )
    lead_in = F.when(F.col("frame") == 0, F.lit(-by)).otherwise(F.lit(0))
    repeated = frames.withColumn("_k", F.explode(F.sequence(F.lit(0), lead_in)))
    out = F.when(F.col("frame") == 0, F.col("_k").cast("bigint")).otherwise(F.col("frame") - by)
    return repeated.withColumn("frame", out).drop("_k")


def held_index(frame, length) -> Column:
    """Frame actually shown by a collection of that length: past the end it holds the last."""
    frame = F.col(frame) if isinstance(frame, str) else frame
    length = F.col(length) if isinstance(length, str) else length
    return F.least(frame, length - 1)


def align(inputs: Sequence[DataFrame], payload: Sequence[str], keys: Sequence[str] = SEQ) -> DataFrame:
    """Align N collections; shorter ones repeat their last frame up to the longest length.

    Output columns are the keys, ``frame`` and ``<payload>_<k>`` for input k = 1..N. Groups
    missing from an input are left out. The frame numbers of a group follow from its lengths; every input meets them by
    an equi-join on (key, frame), whose keys are unique, and which keeps them where they are: each input is shuffled once
    and what has met is not shuffled again. Only frames past an input's end need its last frame (a pinned input is held
    by every frame of a group), see :func:`_hold_last`.
    """
    keys = list(keys)
    numbers = range(1, len(inputs) + 1)
    sides = [
        df.select(*keys, F.col("frame").cast("bigint").alias("frame"), F.struct(*payload).alias(f"_p{k}"))
        for k, df in zip(numbers, inputs)
    ]
    present = lengths(sides[0], keys, "_len1")
    for k, side in zip(numbers[1:], sides[1:]):
        present = present.join(lengths(side, keys, f"_len{k}"), keys)
    present = settle(present.withColumn("_longest", _largest([F.col(f"_len{k}") for k in numbers])), "lengths")

    met = _numbers(present)
    for side in sides:
        met = met.join(side, [*keys, "frame"], "left")
    small = is_small(present)
    shorter = present.agg(*[F.max(F.col("_longest") > F.col(f"_len{k}")) for k in numbers]).first()
    for k, side in zip(numbers, sides):
        if shorter[k - 1]:
            met = _hold_last(met, side, present, k, keys, small)
    names = [f"_p{k}" for k in numbers]
    columns = [F.col(f"{name}.{p}").alias(f"{p}_{k}") for k, name in enumerate(names, start=1) for p in payload]
    return met.select(*keys, "frame", *columns)


def _numbers(present: DataFrame) -> DataFrame:
    """The frame numbers of every group up to its longest input, unfolded in two steps."""
    step = 1 << 16
    firsts = F.sequence(F.lit(0).cast("bigint"), F.col("_longest") - 1, F.lit(step).cast("bigint"))
    blocks = present.where("_longest > 0").withColumn("_first", F.explode(firsts))
    inside = F.sequence(F.col("_first"), F.least(F.col("_first") + (step - 1), F.col("_longest") - 1))
    return blocks.withColumn("frame", F.explode(inside)).drop("_first")


def _largest(columns: Sequence[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def _hold_last(met: DataFrame, side: DataFrame, present: DataFrame, k: int, keys: list[str], small: bool) -> DataFrame:
    """Fill input ``k`` past its end with its last frame.

    A frame that is not held looks for a key of its own that matches nothing, so it stays
    evenly spread; a held one looks for the last frame of its group. That frame is broadcast
    when all last frames together are small, else copied as often as the lengths ask for.
    """
    name, length = f"_p{k}", F.col(f"_len{k}")
    ends = present.where(F.col("_longest") > length).select(*keys, (length - 1).alias("frame"), "_longest", length.alias("_size"))
    if small:
        ends = F.broadcast(ends)
    last = settle(side.join(ends, [*keys, "frame"]).drop("frame").withColumnRenamed(name, "_last"), "last")
    if is_small(last):
        spare = F.broadcast(last.withColumn("_own", F.lit(-1).cast("bigint")))
        reps = F.lit(1)
    else:
        reps = F.ceil((F.col("_longest") - length) / HOT_ROWS)
        copies = F.sequence(F.lit(1).cast("bigint"), F.ceil((F.col("_longest") - F.col("_size")) / HOT_ROWS))
        spare = last.withColumn("_own", F.explode(F.transform(copies, lambda k: -k)))
    spare = spare.select(*keys, "_own", "_last")
    own = F.when(F.col("frame") >= length, -1 - F.pmod(F.col("frame"), reps)).otherwise(F.col("frame"))
    filled = met.withColumn("_own", own).join(spare, [*keys, "_own"], "left")
    return filled.withColumn(name, F.coalesce(name, "_last")).drop("_last", "_own")


def play_in_step(sequences: DataFrame, clock: DataFrame, on: Sequence[str]) -> DataFrame:
    """Frame shown by each sequence when the clocks of its player stand at ``frame`` (1-based).

    ``sequences`` has the player key and ``seq_id, len``; ``clock`` the player key and ``frame``.
    """
    met = hot_join(clock, sequences, on, [*on, "frame"])
    return met.withColumn("shown", F.least(F.col("frame").cast("bigint"), F.col("len")))
