"""Shuffle helpers that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from frameloom.session import delete_folder, fresh_folder

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 1024 * 1024
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of the tables that the innermost :func:`passing` block has settled so far.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def task_count(spark: SparkSession) -> int:
    """Number of tasks for rows that are small but stand for much work, such as paths to read.

    An explicit number keeps adaptive execution from merging them into a few tasks.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _written(df: DataFrame, stem: str) -> DataFrame:
    """The table in a new shared folder; the shuffle files of its making go as soon as it is written."""
    spark, path = df.sparkSession, fresh_folder(df.sparkSession, stem)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    held = spark.read.schema(df.schema).parquet(path)
    held.settled_at = path
    return held


def _noted(held: DataFrame) -> DataFrame:
    made = _passing.get()
    if made is not None:
        made.append(held.settled_at)
    return held


def settle(df: DataFrame, stem: str = "settled") -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Its size is then known before the next join is planned, its lineage is cut, and a
    lost executor does not recompute it.
    """
    return _noted(_written(df, stem))


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted when the block ends well; nothing lazy that reads them may leave it."""
    made: list[str] = []
    outer = _passing.set(made)
    try:
        yield
    finally:
        _passing.reset(outer)
    for path in made:
        delete_folder(spark, path)


def settle_alone(spark: SparkSession, stem: str, make: Callable[[], DataFrame]) -> DataFrame:
    """:func:`settle` of what ``make`` returns; the tables that it settled on its way are deleted once that is written."""
    with passing(spark):
        held = _written(make(), stem)
    return _noted(held)


def discard(*settled: DataFrame) -> None:
    """Delete settled tables early: nothing reads them any more, nor a DataFrame made from them that is not yet written."""
    for held in settled:
        delete_folder(held.sparkSession, held.settled_at)


def _plain_fields(schema: StructType, above: str = "") -> Iterator[tuple[str, str]]:
    """Path and type of every field, those of structs instead of the struct."""
    for f in schema.fields:
        name = f"{above}`{f.name}`"
        if isinstance(f.dataType, StructType):
            yield from _plain_fields(f.dataType, f"{name}.")
        else:
            yield name, f.dataType.typeName()


def is_small(settled: DataFrame) -> bool:
    """Size check on a settled table by rows and bytes of its texts, as they are in memory; files may be packed tightly.

    Tables with pixels or other values of any length are never small.
    """
    flat = list(_plain_fields(settled.schema))
    if {"array", "map", "binary", "variant"} & {kind for _, kind in flat}:
        return False
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in flat if kind == "string"]
    told = settled.agg(F.count("*"), F.sum(sum(texts, F.lit(0).cast("bigint")))).first()
    return told[0] <= BROADCAST_ROWS and (told[1] or 0) <= BROADCAST_BYTES


def join_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys of the left side stay. ``small``: broadcast the right side."""
    named = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(F.broadcast(named) if small else named, same, how).drop(*[f"_on_{c}" for c in on])


def attach_by_key(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    spread_on: Sequence[str],
    how: str = "inner",
    settled: bool = False,
) -> DataFrame:
    """Join a narrow one-row-per-key table to facts without moving the facts when that is possible.

    ``dim`` is settled first (unless it already is). When it is measured to be small it is broadcast and the facts
    stay where they are; otherwise :func:`hot_join` shuffles both sides.
    """
    if not settled:
        dim = settle(dim, "dim")
    if is_small(dim):
        return join_keys(facts, dim, list(on), how, small=True)
    return hot_join(facts, dim, on, spread_on, how)


def hot_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    spread_on: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shuffle join of many facts to one ``dim`` row per key that survives hot keys.

    Keys with more than ``hot_rows`` facts are found by a combined count. Their facts are
    salted by a hash of ``spread_on`` (the fact's own position) and only their ``dim`` rows
    are copied, once per salt. All other rows join as usual. The list of hot keys has at
    most (number of facts / hot_rows) rows.
    """
    on = list(on)
    hot = settle(
        facts.groupBy(*on)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_reps")),
        "hot",
    )
    if hot.isEmpty():
        return join_keys(facts, dim, on, how)
    reps = F.coalesce(F.col("_reps"), F.lit(1))
    salted = join_keys(facts, hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_on), reps).cast("int"))
    copies = join_keys(dim, hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), reps - 1)))
    return join_keys(salted.drop("_reps"), copies.drop("_reps"), [*on, "_salt"], how).drop("_salt")


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str = "frame",
) -> DataFrame:
    """Exclusive running sum inside each key, without putting a key in one task.

    Rows are cut into range slabs over (key, order) and written with their slab number,
    because range bounds may differ when an exchange is computed twice.
    Each slab then needs only the total of the slabs before it (one row per key and
    slab) plus a running sum over its own rows.
    ``order`` must be unique inside a key.
    """
    ranged = df.withColumn("_val", value.cast("bigint")).repartitionByRange(*keys, *order)
    cut = settle(ranged.withColumn("_slab", F.spark_partition_id()), "slabs")
    earlier = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys, "_slab")
        .agg(F.sum("_val").alias("_total"))
        .select(*keys, "_slab", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        join_keys(cut, starts, [*keys, "_slab"])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_val").over(inside), F.lit(0)))
        .drop("_slab", "_val", "_start")
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "frame", keep: Sequence[str] | None = None
) -> DataFrame:
    """Dense 0-based numbers inside each key, in ``order``; of the other columns all stay, or those in ``keep``.

    The rows move once: a range slab is sorted and its rows are numbered as they are written. What a key's rows in a slab
    need is one number, by the slab's first row and the rows of the slabs before. ``order`` must be unique inside a key.
    """
    keys = list(keys)
    stay = df.columns if keep is None else list(dict.fromkeys([*keys, *keep]))
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    cut = settle(ranged.select(*stay, F.spark_partition_id().alias("_slab"), F.monotonically_increasing_id().alias("_at")), "slabs")
    earlier = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = cut.groupBy(*keys, "_slab").agg(F.count("*").alias("_total"), F.min("_at").alias("_first"))
    starts = slabs.select(*keys, "_slab", (F.coalesce(F.sum("_total").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"))
    starts = settle(starts, "starts")
    met = join_keys(cut, starts, [*keys, "_slab"], small=is_small(starts))
    return met.withColumn(out, F.col("_start") + F.col("_at")).drop("_slab", "_at", "_start")
