"""Array files written from the given tables that change between two ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.model import to_samples
from frameloom.operators.spread import settle
from frameloom.plans.loading_queries import _stored
from frameloom.plans.registry import query
from frameloom.plans.views import DENSE, IMG4, img4, numbered
from frameloom.session import fresh_folder
from frameloom.sinks.export import array_files
from frameloom.sources.ingest import good_frames
from frameloom.streaming.folder import index_of, listing, refresh, tick

_NAME = "'s' || seq_id || '_' || (frame // 7) || '.npy' AS name, frame % 7 AS frame"
_LOST = "(seq_id % 3 = 0 AND frame BETWEEN 4 AND 6)"
_REWRITTEN = "(seq_id % 2 = 1 AND frame BETWEEN 7 AND 13)"


def _ticks(spark, folder):
    """Files of 7 frames; between the ticks sequence 0 leaves, 9 comes, every third one's first file loses its last three
    frames, and the second file of the odd ones is rewritten with its values negated."""
    root = fresh_folder(spark, "live")
    frames = settle(numbered(img4(spark, folder)), "frames")

    def store(part):
        files = array_files(part, "npy", chunk_bytes=7 * 256)
        _stored(files.withColumn("path", F.format_string(root + "/s%s_%s.npy", "seq_id", "chunk")))

    def lines(first, last):
        numbers = spark.range(first, last + 1)
        return numbers.select(F.col("id").alias("line_no"), F.format_string(root + "/s%s_*.npy", "id").alias("expression"))

    store(frames)
    yield tick(spark, lines(0, 8), f"{root}/watch", 0), lines(0, 8), f"{root}/watch/files/0"
    store(frames.where("seq_id % 3 = 0 AND frame < 4"))
    negated = F.transform("pixels", lambda v: -v)
    store(frames.where("seq_id % 2 = 1 AND frame BETWEEN 7 AND 13").withColumn("pixels", negated))
    yield tick(spark, lines(1, 9), f"{root}/watch", 1), lines(1, 9), f"{root}/watch/files/1"


def _named(rows):
    return rows.withColumn("name", F.substring_index("path", "/", -1))


@query(
    "live_changes",
    f"""SELECT {_NAME}, CASE WHEN seq_id = 0 THEN 'lost' WHEN seq_id = 9 THEN 'added' WHEN {_LOST} THEN 'lost' ELSE 'changed' END AS change
        FROM {DENSE} WHERE seq_id = 0 OR (seq_id = 9 AND NOT {_LOST}) OR (seq_id <> 9 AND (seq_id % 3 = 0 AND frame < 7 OR {_REWRITTEN}))""",
)
def live_changes(spark, folder):
    """What the second look at a folder tells of every frame that is not as it was."""
    *_, (changed, _, _) = _ticks(spark, folder)
    return _named(changed).select("name", "frame", "change")


@query(
    "live_reload",
    f"""SELECT 's' || d.seq_id || '_' || (d.frame // 7) || '.npy' AS name, d.frame % 7 AS frame, y, x, band,
               CASE WHEN d.seq_id % 2 = 1 AND d.frame BETWEEN 7 AND 13 THEN -v ELSE v END AS v
        FROM {DENSE} d JOIN {IMG4} i ON i.seq_id = d.seq_id AND i.frame = d.source
        WHERE d.seq_id <> 0 AND NOT (d.seq_id % 3 = 0 AND d.frame BETWEEN 4 AND 6)""",
)
def live_reload(spark, folder):
    """Pixels after the second look: only the frames it names were read anew."""
    frames = None
    for changed, _, _ in _ticks(spark, folder):
        frames = settle(refresh(frames, changed), "pixels")
    return _named(to_samples(good_frames(frames), ["path", "frame"])).drop("path")


@query(
    "live_lengths",
    f"SELECT seq_id, count(*) AS n, max(d.place) AS last FROM (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - 1 AS place FROM {DENSE} WHERE seq_id <> 0 AND NOT {_LOST}) d GROUP BY 1",
)
def live_lengths(spark, folder):
    """Lengths of the sequences after the second look, whose frames are numbered anew."""
    *_, (_, lines, states) = _ticks(spark, folder)
    now = index_of(listing(lines), spark.read.parquet(states))
    return now.groupBy(F.col("seq_id").cast("int").alias("seq_id")).agg(F.count("*").alias("n"), F.max("frame").alias("last"))
