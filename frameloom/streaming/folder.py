"""Sources that change while they are in use: every tick lists them again and tells which frames are new, changed or lost.

The state is one row per file with its version (time of change and size) and the layout of its frames. A tick lists all
sources, reads the headers of files whose version changed and compares with the tick before; the pixels of a file that did
not change are never read again. A file rewritten with the same size within the time step of its file system is not seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from frameloom.operators.spread import join_keys, prefix_sum, settle
from frameloom.sources.frame_index import fetch, file_table, frames_of
from frameloom.sources.listing import list_sources
from frameloom.streaming.sink import on_tick

VERSION = ["modified", "size"]
LAYOUT = ["kind", "n", "offset", "length", "w", "h", "c", "dtype", "problem"]


def listing(lines: DataFrame, column: str = "expression") -> DataFrame:
    """Files that ``lines(line_no, expression)`` name now: ``line_no, file_no, path, modified, size``; absent ones have no row."""
    found = list_sources(lines, column).where("status = 'ok'")
    modified = F.coalesce(F.unix_micros(F.col("modified").cast("timestamp")), F.lit(-1)).alias("modified")
    return found.select("line_no", F.col("frame").alias("file_no"), "path", modified, F.coalesce("length", F.lit(-1)).cast("bigint").alias("size"))


def file_states(listed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row per listed path: ``path``, its version and its layout.

    Rows of ``before`` are taken over where the version is the same; all other files, and those that could not be read
    before, have their headers read.
    """
    paths = listed.groupBy("path").agg(*[F.max(v).alias(v) for v in VERSION])
    columns = ["path", *VERSION, *LAYOUT]
    if before is None:
        return file_table(paths, VERSION).select(columns)
    whole = before.where("problem IS NULL")
    same = ["path", *VERSION]
    unread = paths.join(whole.select(same), same, "left_anti")
    return whole.join(paths, same, "left_semi").select(columns).unionByName(file_table(unread, VERSION).select(columns))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Frames that differ between two tables of states: ``path, frame, change, place``.

    ``frame`` counts inside the file. Every frame of a file with another version is ``changed``; frames that it has more or
    fewer than before, and those of files that came or went, are ``added`` or ``lost`` (with the place they had).
    """
    state = F.struct(*VERSION, *LAYOUT)
    met = before.select("path", state.alias("old")).join(after.select("path", state.alias("new")), "path", "full")
    met = met.where(~F.col("old").eqNullSafe(F.col("new")))
    zero = F.lit(0).cast("bigint")
    had, has = F.coalesce("old.n", zero), F.coalesce("new.n", zero)

    def part(change: str, start, end, of: str):
        return F.struct(F.lit(change).alias("change"), start.alias("first"), end.alias("end"), F.col(of).alias("state"))

    parts = F.array(part("changed", zero, F.least(had, has), "new"), part("added", had, has, "new"), part("lost", has, had, "old"))
    each = met.select("path", F.explode(parts).alias("p")).select("path", "p.*").where(F.col("first") < F.col("end"))
    shifted = {"n": F.col("end") - F.col("first"), "offset": F.col("state.offset") + F.col("first") * F.col("state.length")}
    files = each.select("path", "change", "first", *[shifted.get(f, F.col("state")[f]).alias(f) for f in LAYOUT])
    return frames_of(files, ["path", "change"], F.col("first")).select("path", "frame", "change", "place")


def all_frames(states: DataFrame) -> DataFrame:
    """The first tick: every frame is ``added``."""
    return changes(states.limit(0), states)


def refresh(frames: DataFrame | None, changed: DataFrame) -> DataFrame:
    """``frames(path, frame, w, h, c, pixels, status, error)`` with lost and old frames taken out and new ones read."""
    changed = settle(changed, "changes")
    read = fetch(changed.where("change <> 'lost'").drop("change"), ["path"])
    if frames is None:
        return read
    return frames.join(changed.select("path", "frame"), ["path", "frame"], "left_anti").unionByName(read)


def index_of(listed: DataFrame, states: DataFrame) -> DataFrame:
    """The sequences as they are now, ``seq_id, frame, place``: frames follow each other in the order of the files listed."""
    placed = settle(listed.select("line_no", "file_no", "path").join(states.select("path", *LAYOUT), "path"), "files")
    numbers = placed.select("line_no", "file_no", "n")
    starts = settle(prefix_sum(numbers, ["line_no"], ["file_no"], F.col("n"), "first").drop("n"), "starts")
    return frames_of(join_keys(placed, starts, ["line_no", "file_no"]), ["line_no"], F.col("first")).withColumnRenamed("line_no", "seq_id")


def tick(spark: SparkSession, lines: DataFrame, folder: str, number: int, column: str = "expression") -> DataFrame:
    """One look at the sources: the frames that differ from tick ``number - 1``, all of them at tick 0.

    Two tables of states take turns below ``folder``, so a tick that runs again after a failure compares with the same one.
    Use the result before the next tick but one, which writes over its tables, or store it.
    """
    slots = [f"{folder}/files/{(number - back) % 2}" for back in (0, 1)]
    before = spark.read.parquet(slots[1]) if number else None
    file_states(listing(lines, column), before).write.mode("overwrite").parquet(slots[0])
    after = spark.read.parquet(slots[0])
    return all_frames(after) if before is None else changes(before, after)


def watch(
    spark: SparkSession, lines: Callable[[], DataFrame], folder: str, on_change: Callable[[DataFrame, int], None], every: str = "1 second", column: str = "expression"
) -> StreamingQuery:
    """Look at the sources again and again and call ``on_change(changes, number)``; ``lines`` is asked anew each time.

    A restart on the same ``folder`` goes on with the number and the states it had; the tick it failed in runs again.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def step(_: DataFrame, number: int) -> None:
        on_change(tick(spark, lines(), folder, number, column), number)

    return on_tick(clock, step, folder, every)
