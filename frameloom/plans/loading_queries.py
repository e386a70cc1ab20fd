"""The loading path over files made from the given tables: list, index, align places, read at the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.model import to_samples
from frameloom.operators import collections as seqs
from frameloom.operators import programs
from frameloom.operators.spread import settle
from frameloom.plans.collection_queries import _ALIGNED, _neighbour, _side_by_side
from frameloom.plans.registry import query
from frameloom.plans.source_queries import _DENSE_SAMPLES, _levels
from frameloom.plans.views import DENSE, IMG, IMG4, img, img4, numbered
from frameloom.session import fresh_folder
from frameloom.sinks.export import array_files, frame_files
from frameloom.sources.frame_index import fetch_aligned, index_sequences
from frameloom.sources.ingest import good_frames, load_sequences
from frameloom.sources.listing import file_system, list_from_file


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    made = set()
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            fs, local, _ = file_system(path)
            above = path.rsplit("/", 1)[0]
            if above not in made:
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                made.add(above)
            with fs.open_output_stream(local) as out:
                out.write(content)
        yield batch[["path"]]


def _stored(files: DataFrame) -> DataFrame:
    """Files of ``(path, content)`` written to the shared folder; a task that runs again writes the same again."""
    return settle(files.select("path", "content").mapInPandas(_write, "path string"), "written")


def _expressions(files: DataFrame, text) -> DataFrame:
    return files.select(F.col("seq_id").cast("long").alias("line_no"), text.alias("expression")).distinct()


@query("load_glob", _DENSE_SAMPLES.format(IMG4))
def load_glob(spark, folder):
    """One expression a sequence, ``.../s3/f*.npy``; files in natural order of their names."""
    root = fresh_folder(spark, "glob")
    files = frame_files(img4(spark, folder), "npy").withColumn("path", F.format_string(root + "/s%s/f%s.npy", "seq_id", "frame"))
    _stored(files)
    loaded = load_sequences(_expressions(files, F.format_string(root + "/s%s/f*.npy", "seq_id")))
    return to_samples(good_frames(loaded)).withColumn("seq_id", F.col("seq_id").cast("int"))


@query(
    "load_tree",
    f"""WITH o AS (SELECT label AS seq_id, vec_id AS frame, row_number() OVER (ORDER BY label, vec_id) - 1 AS place FROM embeddings)
        SELECT o.place AS frame, y, x, band, floor(abs(v::DOUBLE) * 255)::FLOAT AS v FROM {IMG} JOIN o USING (seq_id, frame)""",
)
def load_tree(spark, folder):
    """A whole folder as one sequence: three formats, sub-folders one after the other, hidden names left out."""
    root = fresh_folder(spark, "tree")
    frames = _levels(img(spark, folder), 255)
    for kind, dtype in (("npy", "float32"), ("vpp", "float32"), ("png", "uint8")):
        part = frames.where(F.col("frame") % 3 == ("npy", "vpp", "png").index(kind))
        named = frame_files(part, kind, dtype).withColumn("path", F.format_string(root + "/s%s/f%s." + kind, "seq_id", "frame"))
        _stored(named)
        _stored(named.where(F.col("frame") % 7 == 0).withColumn("path", F.format_string(root + "/s%s/.f%s." + kind, "seq_id", "frame")))
    line = spark.range(1).select(F.col("id").alias("line_no"), F.lit(root).alias("expression"))
    return to_samples(good_frames(load_sequences(line))).drop("seq_id")


@query(
    "load_list_file",
    """WITH n AS (SELECT label, vec_id FROM embeddings), l AS (SELECT DISTINCT label FROM embeddings),
        p AS (SELECT label AS line, 0 AS part, label AS s, vec_id FROM n UNION ALL
              SELECT l.label, 1, n.label, vec_id FROM l JOIN n ON n.label = (l.label + 1) % 10 WHERE vec_id % 10 = 3)
        SELECT 's' || s || '/f' || vec_id || '.vpp' AS name, row_number() OVER (ORDER BY line, part, vec_id) - 1 AS frame, 'ok' AS status FROM p""",
)
def load_list_file(spark, folder):
    """A text file with one expression a line, ``.../s1/f*.vpp::.../s2/f*3.vpp``."""
    root = fresh_folder(spark, "lists")
    files = frame_files(img4(spark, folder), "vpp").withColumn("path", F.format_string(root + "/s%s/f%s.vpp", "seq_id", "frame"))
    _stored(files)
    text = F.format_string(root + "/s%s/f*.vpp::" + root + "/s%s/f*3.vpp", "seq_id", F.pmod(F.col("seq_id") + 1, F.lit(10)))
    lines = _expressions(files, text).orderBy("line_no").select(F.col("expression").alias("value"))
    lines.coalesce(1).write.text(f"{root}/list.txt")
    listed = list_from_file(spark, f"{root}/list.txt")
    return listed.select(F.regexp_extract("path", "(s[0-9]+/f[0-9]+[.]vpp)$", 1).alias("name"), "frame", "status")


@query(
    "load_npy_ranges",
    f"""WITH {_ALIGNED}, {_side_by_side("w", 3)}
        SELECT seq_id, frame, (i // 8)::INT AS y, (i % 8)::INT AS x, 0 AS band, (v1 - v2 + 2 * v3)::FLOAT AS v FROM z""",
)
def load_npy_ranges(spark, folder):
    """A program over three inputs that are aligned as an index of array files; pixels are read by byte range afterwards."""
    root = fresh_folder(spark, "ranges")
    files = array_files(numbered(img(spark, folder)), "npy", chunk_bytes=7 * 256)
    named = files.withColumn("path", F.format_string(root + "/s%s_%s.npy", "seq_id", "chunk"))
    _stored(named)
    index = index_sequences(_expressions(files, F.format_string(root + "/s%s_*.npy", "seq_id")))
    index = settle(index.withColumn("seq_id", F.col("seq_id").cast("int")), "index")
    inputs = [index, _neighbour(index, 1), _neighbour(seqs.pin(index, 2), 2)]
    pixels = fetch_aligned(seqs.align(inputs, ["place"]), 3)
    return programs.run_scalar_program(pixels, "x1 - x2 + cast(2 as float) * x3", 3)


@query("load_frame_shapes", f"SELECT seq_id, frame, 4::INT AS w, 4::INT AS h, 4::INT AS c, 'npy' AS kind, 256::BIGINT AS length, (frame % 7) * 256 + 128 AS offset FROM {DENSE}")
def load_frame_shapes(spark, folder):
    """What the index tells of frames before any pixel is read."""
    root = fresh_folder(spark, "shapes")
    files = array_files(numbered(img4(spark, folder)), "npy", chunk_bytes=7 * 256)
    _stored(files.withColumn("path", F.format_string(root + "/s%s_%s.npy", "seq_id", "chunk")))
    index = index_sequences(_expressions(files, F.format_string(root + "/s%s_*.npy", "seq_id")))
    return index.select(F.col("seq_id").cast("int").alias("seq_id"), "frame", *[F.col("place")[f].alias(f) for f in ("w", "h", "c", "kind", "length", "offset")])
