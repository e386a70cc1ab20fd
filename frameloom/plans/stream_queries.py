"""Streams over the given tables, run to their current end; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.model import packed, to_samples
from frameloom.plans.registry import query
from frameloom.plans.views import IMG, table
from frameloom.streaming.live import clock_ticks, newest_versions, progressive_histogram, rows_seen, ticks_per_window
from frameloom.streaming.sink import run_to_table


def _stream(spark, folder, name):
    """The table as a streaming source, be it one file or a folder of files; the pattern matches its name alone."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


@query(
    "stream_reload",
    """SELECT user_id || '/' || event_type AS path, max(ts)::TIMESTAMP IS NOT NULL AS seen, arg_max(event_id, (ts, event_id)) AS version,
       arg_max(event_type = 'error' AND user_id % 2 = 0, (ts, event_id)) AS deleted FROM events GROUP BY 1""",
)
def stream_reload(spark, folder):
    """Events as changes of files: the newest version of each path wins, deletions included."""
    events = _stream(spark, folder, "events")
    changes = events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"),
        F.struct(F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("n")).alias("modified"),
        ((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0)).alias("deleted"),
        F.col("event_id").alias("length"),
    )
    newest = run_to_table(newest_versions(changes), ["path"])
    return newest.select("path", F.col("modified.at").isNotNull().alias("seen"), F.col("length").alias("version"), "deleted")


def _streamed_samples(spark, folder):
    return to_samples(packed(_stream(spark, folder, "embeddings"), "embedding", 8, 8, 1, "label", "vec_id"))


@query(
    "stream_hist",
    f"""SELECT seq_id, band, trunc((v - -1::FLOAT) * (255::FLOAT / 2::FLOAT)::FLOAT)::INT AS bin, count(*) AS n
        FROM {IMG} WHERE v >= -1 AND v <= 1 GROUP BY ALL""",
)
def stream_hist(spark, folder):
    """Histogram of each sequence over the fixed range -1..1, growing with the stream."""
    counted = progressive_histogram(_streamed_samples(spark, folder), F.lit(-1.0), F.lit(1.0), ["seq_id"])
    return run_to_table(counted, ["seq_id", "band", "bin"])


@query("stream_progress", "SELECT label AS seq_id, vec_id AS frame, 1::DOUBLE AS progress FROM embeddings")
def stream_progress(spark, folder):
    """Share of each image's rows that has arrived."""
    seen = rows_seen(_streamed_samples(spark, folder), 8, ["seq_id", "frame"])
    return run_to_table(seen, ["seq_id", "frame"])


@query(
    "stream_clock",
    """SELECT event_id, user_id, greatest(ceil((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE * 30::DOUBLE / 1000000::DOUBLE) - 1, 0)::BIGINT AS tick
       FROM events""",
)
def stream_clock(spark, folder):
    """Steps of a 30 frames/s clock that started with the year, at each event."""
    events = _stream(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ticked = clock_ticks(events, start, 30.0).drop("ts")
    return run_to_table(ticked, ["event_id"]).select("event_id", "user_id", "tick")


@query(
    "stream_windows",
    """SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS period_start, count(*) AS n FROM events GROUP BY ALL""",
)
def stream_windows(spark, folder):
    """Events per period of a very slow clock (one frame per hour)."""
    events = _stream(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    counted = ticks_per_window(events, 1 / 3600, ["event_type"])
    flat = counted.select("event_type", F.unix_micros("period.start").alias("period_start"), "n")
    return run_to_table(flat, ["event_type", "period_start"])
