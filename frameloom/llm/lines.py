"""Removal of passages that repeat line by line: overlapping windows of consecutive lines, compared over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import document_key
from frameloom.operators.spread import settle

WINDOW_LINES = 3


def line_windows(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """``docs(doc_id, doc_key, text)`` -> a 128-bit hash and the line numbers of every window.

    Windows run over the lines that hold more than white space; blank lines are no part of one.
    """
    filled = F.filter(
        F.transform(F.split("text", "\n"), lambda line, at: F.struct(at.alias("at"), line.alias("line"))),
        lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"),
    )
    listed = docs.select("doc_id", "doc_key", filled.alias("filled")).where(F.size("filled") >= lines)
    listed = listed.select("doc_id", "doc_key", F.col("filled.at").alias("at"), F.col("filled.line").alias("line"))

    def window(i):
        parts = [F.get("line", i + k) for k in range(lines)]
        return F.struct(
            F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(lines), *parts).alias("h2"), F.slice("at", i + 1, lines).alias("at")
        )

    starts = F.sequence(F.lit(0), F.size("line") - lines)
    return listed.select("doc_id", "doc_key", F.inline(F.transform(starts, window)))


def repeated_positions(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """Line numbers covered by a window that occurred before, in order of doc_id (NULL last), document key and line.

    The first occurrence of a window is a combined minimum; only windows that repeat are joined back, and adaptive
    execution can split that join where one window makes up much of the table.
    """
    windows = line_windows(docs, lines)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_key", F.col("at")[0].alias("line"))
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("doc_id", "doc_key", F.explode("at").alias("line")).groupBy("doc_id", "doc_key").agg(F.collect_set("line").alias("gone"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = WINDOW_LINES) -> DataFrame:
    """All rows and columns of ``docs`` with later occurrences of repeated windows cut out of ``text``.

    Adds ``n_lines`` and ``n_removed``. Line k of a text is removed exactly if a window that covers it occurred before;
    the earliest place of any line is therefore always kept. Rows that agree in id and text are one document: both keep
    or lose the same lines. A NULL text stays NULL with no lines; fewer than three filled lines are never removed; a
    text may become empty. Columns of ``docs`` named like the added ones are replaced.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), document_key(doc_id, text).alias("doc_key"), F.col(text).alias("text"))
    gone = settle(repeated_positions(narrow, lines), "repeated-lines").select(F.col("doc_id").alias("id"), F.col("doc_key").alias("key"), "gone")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), document_key(doc_id, text).alias("own_key"))
    joined = own.join(gone.hint("merge"), (F.col("own_key") == F.col("key")) & F.col("row")[doc_id].eqNullSafe(F.col("id")), "left")
    split = joined.select("row", "gone", F.split(F.col("row")[text], "\n").alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    cut = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    made = {
        text: F.when(F.col("gone").isNull(), F.col("row")[text]).otherwise(cut),
        "n_lines": F.when(F.col("row")[text].isNull(), 0).otherwise(F.size("lines")).cast("bigint"),
        "n_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint"),
    }
    names = [*docs.columns, *[n for n in ("n_lines", "n_removed") if n not in docs.columns]]
    return split.select(*[made.get(c, F.col("row")[c]).alias(c) for c in names])
