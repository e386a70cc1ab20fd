"""What several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"  # fixed: what separates words, everything else is part of one


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text, empty for NULL: what the Python side of an operator reads."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("binary"), F.lit(b""))


def words_of(text: str | Column) -> Column:
    """The words of a text as an array, empty for NULL."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(column, F.lit("")), WORD_GAP), lambda w: w != "")


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the decimal doc_id modulo ``by``; a NULL id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % by


def document_key(doc_id: str, text: str) -> Column:
    """Tells apart rows that share a doc_id but not a text; never NULL."""
    return F.xxhash64(F.lit(11), F.col(doc_id), F.col(text))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Narrow a table, so that extra columns of any name cannot clash with an operator's own."""
    return df.select(*names)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id and document key are not in ``gone(doc_id, doc_key)``; columns as they were.

    ``gone`` is narrow; the engine chooses by its size whether the texts have to move.
    """
    gone_id, gone_key = free_name(docs, "gone_id"), free_name(docs, "gone_key")
    listed = gone.select(F.col("doc_id").alias(gone_id), F.col("doc_key").alias(gone_key))
    same = (document_key(doc_id, text) == F.col(gone_key)) & F.col(doc_id).eqNullSafe(F.col(gone_id))
    return docs.join(listed, same, "left_anti")
