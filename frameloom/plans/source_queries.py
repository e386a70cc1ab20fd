"""Files made from the given tables and read back: codecs, archives, sniffing, quarantine, rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from frameloom.functions import tone
from frameloom.model import to_samples
from frameloom.operators.programs import first_error
from frameloom.plans.registry import query
from frameloom.plans.views import DENSE, IMG, IMG4, img, img4, numbered, table
from frameloom.session import fresh_folder
from frameloom.sinks.export import array_files, frame_files
from frameloom.sinks.render import rendered_pngs, with_display, write_rendered
from frameloom.sources.archive import members, ordered_members, zip_bytes
from frameloom.sources.ingest import decode_content, good_frames, quarantine
from frameloom.sources.sniff import file_format


def _read_back(decoded):
    """Samples of decoded one-frame files under their own keys."""
    return to_samples(good_frames(decoded).drop("local_frame"))


def _levels(frames, full: int):
    """Frames with whole-number samples 0..full."""
    level = F.transform("pixels", lambda v: F.floor(F.abs(v.cast("double")) * full).cast("float"))
    return frames.withColumn("pixels", level)


def _level_sql(view: str, full: int) -> str:
    return f"SELECT seq_id, frame, y, x, band, floor(abs(v::DOUBLE) * {full})::FLOAT AS v FROM {view}"


@query("ingest_png", _level_sql(IMG4, 255))
def ingest_png(spark, folder):
    """8-bit png files of four bands, decoded again."""
    files = frame_files(_levels(img4(spark, folder), 255), "png", "uint8")
    return _read_back(decode_content(files, ["seq_id", "frame"]))


@query("ingest_png16", _level_sql(IMG, 65535))
def ingest_png16(spark, folder):
    """16-bit gray png files, decoded without losing the low byte."""
    files = frame_files(_levels(img(spark, folder), 65535), "png", "uint16")
    return _read_back(decode_content(files, ["seq_id", "frame"]))


_DENSE_SAMPLES = f"SELECT s.seq_id, d.frame, s.y, s.x, s.band, s.v FROM {{0}} s JOIN {DENSE} d ON d.source = s.frame"


def _through_arrays(frames, kind: str):
    """Sequences packed into array files of a few frames each and decoded to dense frames."""
    files = array_files(frames, kind, chunk_bytes=7 * 256)
    decoded = decode_content(files, ["seq_id", "first_frame"])
    placed = good_frames(decoded).withColumn("frame", F.col("first_frame") + F.col("local_frame"))
    return to_samples(placed)


@query("ingest_npy", _DENSE_SAMPLES.format(IMG4))
def ingest_npy(spark, folder):
    return _through_arrays(numbered(img4(spark, folder)), "npy")


@query("ingest_vpp", _DENSE_SAMPLES.format(IMG4))
def ingest_vpp(spark, folder):
    return _through_arrays(numbered(img4(spark, folder)), "vpp")


@query(
    "npy_export",
    f"""SELECT seq_id, frame // 7 AS chunk, count(*)::INT AS n, (128 + count(*) * 256)::BIGINT AS bytes,
        '934E554D5059' AS signature FROM {DENSE} GROUP BY 1, 2""",
)
def npy_export(spark, folder):
    """Array files of seven frames: sizes and signatures."""
    files = array_files(numbered(img(spark, folder)), "npy", chunk_bytes=7 * 256)
    return files.select(
        "seq_id",
        "chunk",
        "n",
        F.octet_length("content").cast("bigint").alias("bytes"),
        F.hex(F.substring("content", 1, 6)).alias("signature"),
    )


def _archives(spark, folder):
    """Small zip files of page texts: one archive per hundred pages, with folders inside."""
    pages = table(spark, folder, "pages").select((F.col("page_id") / 100).cast("bigint").alias("archive"), "page_id", "html")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        named = [("in/", b"")] + [
            (f"in/p{page}_{'a' if page % 2 else 'b'}{page % 10}.html", text.encode()) for page, text in zip(part.page_id, part.html)
        ]
        return pd.DataFrame({"archive": [part.archive.iloc[0]], "content": [zip_bytes(named)]})

    return pages.groupBy("archive").applyInPandas(pack, "archive bigint, content binary")


@query(
    "zip_members",
    """SELECT page_id // 100 AS archive, 'in/p' || page_id || '_' || CASE WHEN page_id % 2 = 1 THEN 'a' ELSE 'b' END || page_id % 10 || '.html' AS member,
       row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) - 1 AS frame, octet_length(encode(html))::BIGINT AS bytes FROM pages""",
)
def zip_members(spark, folder):
    found = ordered_members(members(_archives(spark, folder), ["archive"]), ["archive"])
    return found.select("archive", "member", "frame", F.octet_length("content").cast("bigint").alias("bytes"))


_KINDS = "CASE vec_id % 5 WHEN 0 THEN 'npy' WHEN 1 THEN 'vpp' WHEN 2 THEN 'png' WHEN 3 THEN 'other' ELSE 'png' END"


def _mixed_files(spark, folder):
    """Files of several formats, text among them and every tenth png cut short."""
    frames = _levels(img(spark, folder), 255)
    kind = F.col("frame") % 5
    npy = frame_files(frames.where(kind == 0), "npy")
    vpp = frame_files(frames.where(kind == 1), "vpp")
    png = frame_files(frames.where((kind == 2) | (kind == 4)), "png", "uint8")
    cut = F.when(F.col("frame") % 5 == 4, F.substring("content", F.lit(1), F.octet_length("content") - 30))
    png = png.withColumn("content", cut.otherwise(F.col("content")))
    other = frames.where(kind == 3).select("seq_id", "frame", F.encode(F.lit("no picture at all"), "utf-8").alias("content"))
    return npy.unionByName(vpp).unionByName(png).unionByName(other)


@query("sniff_format", f"SELECT vec_id AS frame, {_KINDS} AS kind FROM embeddings")
def sniff_format(spark, folder):
    return _mixed_files(spark, folder).select("frame", file_format("content").alias("kind"))


@query(
    "quarantine",
    """SELECT label AS seq_id, vec_id AS frame, CASE vec_id % 5 WHEN 3 THEN 'unsupported' ELSE 'error' END AS status,
       CASE vec_id % 5 WHEN 3 THEN 'unsupported format: other' ELSE 'truncated file?' END AS error FROM embeddings WHERE vec_id % 5 IN (3, 4)""",
)
def quarantine_query(spark, folder):
    decoded = decode_content(_mixed_files(spark, folder), ["seq_id", "frame"])
    return quarantine(decoded).select("seq_id", "frame", "status", "error")


@query(
    "mixed_ingest",
    f"SELECT seq_id, frame, y, x, band, floor(abs(v::DOUBLE) * 255)::FLOAT AS v FROM {IMG} WHERE frame % 5 < 3",
)
def mixed_ingest(spark, folder):
    """The good siblings of the failed files."""
    return _read_back(decode_content(_mixed_files(spark, folder), ["seq_id", "frame"]))


@query(
    "edit_error",
    """SELECT vec_id AS frame, CASE WHEN vec_id % 5 = 3 THEN 'unsupported format: other' WHEN vec_id % 5 = 4 THEN 'truncated file?'
         WHEN vec_id % 5 = 2 THEN 'unsupported format: other' END AS error
       FROM embeddings WHERE vec_id + 1 < (SELECT count(*) FROM embeddings)""",
)
def edit_error(spark, folder):
    """An edit of a frame and its successor fails with the first failed input's error."""
    state = decode_content(_mixed_files(spark, folder), ["seq_id", "frame"]).select("frame", "status", "error")
    after = state.select((F.col("frame") - 1).alias("frame"), F.col("status").alias("s2"), F.col("error").alias("e2"))
    return state.join(after, "frame").select("frame", first_error(["status", "s2"], ["error", "e2"]).alias("error"))


@query(
    "render_sink",
    "SELECT label AS seq_id, vec_id AS frame, 'screenshot_' || label || '_' || vec_id || '.png' AS name FROM embeddings",
)
def render_sink(spark, folder):
    """Rendered frames written as png rows by sequence, and listed again."""
    target = fresh_folder(spark, "rendered")
    write_rendered(rendered_pngs(with_display(img4(spark, folder)), tone.DEFAULT), target)
    return spark.read.parquet(target).select("seq_id", "frame", "name")


@query(
    "render_roundtrip",
    f"""WITH s AS {IMG}, r AS (SELECT seq_id, frame, min(v) AS low, max(v) AS high FROM s GROUP BY 1, 2),
        k AS (SELECT *, ((high - low) / 2::FLOAT)::FLOAT AS radius, ((high + low) / 2::FLOAT)::FLOAT AS center FROM r),
        b AS (SELECT *, (1::FLOAT / (2::FLOAT * radius))::FLOAT AS scale FROM k),
        t AS (SELECT s.*, least(1::FLOAT, greatest(0::FLOAT, ((v * scale)::FLOAT + ((radius - center) * scale)::FLOAT)::FLOAT)) AS t FROM s JOIN b USING (seq_id, frame))
        SELECT seq_id, frame, y, x, c.band, floor(t::DOUBLE * 255 + 0.5)::FLOAT AS v FROM t, unnest([0, 1, 2]) c(band)""",
)
def render_roundtrip(spark, folder):
    """The rendered png of every frame, decoded again: three equal bands of bytes."""
    pngs = rendered_pngs(with_display(img(spark, folder)), tone.GRAY)
    return _read_back(decode_content(pngs, ["seq_id", "frame"]))
