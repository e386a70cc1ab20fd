"""Frames, samples and paths read out of the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.model import packed
from frameloom.operators.spread import number_rows, settle


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(spark: SparkSession, folder: str, w: int, h: int, c: int) -> DataFrame:
    return packed(table(spark, folder, "embeddings"), "embedding", w, h, c, "label", "vec_id")


def img(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as one 8x8 gray frame."""
    return vectors(spark, folder, 8, 8, 1)


def img4(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as a 4x4 frame of 4 bands."""
    return vectors(spark, folder, 4, 4, 4)


def flow(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as an 8x4 frame of 2 bands."""
    return vectors(spark, folder, 8, 4, 2)


def numbered(frames: DataFrame) -> DataFrame:
    """Frames with dense 0-based numbers per sequence; the old number stays as ``source``.

    Only the keys are sorted; the pixels meet their numbers by an equi-join on unique keys.
    """
    keys = frames.select("seq_id", F.col("frame").alias("source"))
    dense = settle(number_rows(keys, ["seq_id"], ["source"]), "numbers")
    return frames.withColumnRenamed("frame", "source").join(dense, ["seq_id", "source"])


def big(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as samples of one large frame per supplier."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("seq_id"),
        F.col("l_linenumber").alias("band"),
        F.col("l_extendedprice").cast("float").alias("v"),
        F.col("l_orderkey").alias("place"),
    )


def urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.col("url").alias("path"))


def _exploded(y: str, x: str, band: str) -> str:
    return (
        f"(SELECT label AS seq_id, vec_id AS frame, ({y})::INT AS y, ({x})::INT AS x, ({band})::INT AS band, v "
        "FROM (SELECT label, vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))"
    )


IMG = _exploded("i // 8", "i % 8", "0")
IMG4 = _exploded("i // 16", "(i // 4) % 4", "i % 4")
FLOW = _exploded("i // 16", "(i // 2) % 8", "i % 2")
BIG = "(SELECT l_suppkey AS seq_id, l_linenumber AS band, l_extendedprice::FLOAT AS v FROM lineitem)"
DENSE = (
    "(SELECT label AS seq_id, vec_id AS source, "
    "row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings)"
)
