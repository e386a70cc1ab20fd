"""Running a stream to its current end and reading its result as a table.

Update-mode results go to files, one folder per micro-batch; a re-run batch overwrites its
own folder, and readers take the newest row per key. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from frameloom.session import fresh_folder, make_folder


def write_updates(stream: DataFrame, folder: str) -> StreamingQuery:
    """Start an update-mode query that stores each micro-batch below ``folder/rows``."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def latest(folder: str, stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of a stored update stream."""
    values = [c for c in stream.columns if c not in keys]
    rows = make_folder(stream.sparkSession, f"{folder}/rows")  # a stream without any input has stored no batch
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    stored = stream.sparkSession.read.schema(schema).option("basePath", rows).parquet(rows)
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")


def run_to_table(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Process all input available now and return the final state per key."""
    folder = fresh_folder(stream.sparkSession, "stream")
    query = write_updates(stream, folder)
    query.awaitTermination()
    return latest(folder, stream, keys)


def on_tick(stream: DataFrame, hook: Callable[[DataFrame, int], None], folder: str, every: str = "100 milliseconds") -> StreamingQuery:
    """Call ``hook(batch, number)`` on a fixed schedule with what arrived since the last call."""
    return (
        stream.writeStream.option("checkpointLocation", f"{folder}/state")
        .trigger(processingTime=every)
        .foreachBatch(hook)
        .start()
    )
