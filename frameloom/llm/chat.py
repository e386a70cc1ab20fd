r"""Conversations as training text, with a round trip as proof; DataFrame functions only.

Every turn is ``<|role|>text<|end|>``. A control string inside a text would be read as a mark, so it gets a backslash
before it (before the backslashes that already stand there), and the parser takes one away. Escaping is not applied
blindly: a conversation is rendered, parsed again and compared to its source, and only if the two differ is its
conflicting content escaped and the comparison repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grammar: a mark is a control string without a backslash before it; no control string lies inside another one. Roles
# are percent-encoded inside their mark.
END = "<|end|>"
CONTROL = r"<\|[^|<>\[\]]*\|>|</?s>|\[/?INST\]|<</?SYS>>"
TURN = rf"(?s)<\|role=[^|<>]*\|>.*?(?<!\\)(?:{CONTROL})"  # any mark ends a text, so one inside of it reads back as another text
HEAD = rf"(?s)^<\|role=([^|<>]*)\|>(.*?)(?<!\\)(?:{CONTROL})$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", r"$1$2")


def render(turns: Column, escaped: bool) -> Column:
    """An array of ``struct(role, text)`` as one text. A backslash that ends a text is kept off the mark by a space."""

    def one(t: Column) -> Column:
        body = escape(t["text"]) if escaped else t["text"]
        return F.concat(F.lit("<|role="), F.url_encode(t["role"]), F.lit("|> "), body, F.lit(" " + END))

    return F.array_join(F.transform(turns, one), "\n")


def parse(rendered: Column) -> Column:
    """The turns of a rendered text, control strings restored. What is between turns is not part of any."""

    def one(turn: Column) -> Column:
        body = F.regexp_extract(turn, HEAD, 2)
        role = F.url_decode(F.regexp_extract(turn, HEAD, 1))
        return F.struct(role.alias("role"), unescape(F.substring(body, F.lit(2), F.length(body) - 2)).alias("text"))

    return F.transform(F.regexp_extract_all(rendered, F.lit(TURN), F.lit(0)), one)


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, turns, escaped, round_trip``.

    ``turns`` is read back from ``formatted``. Turns are ordered by turn, NULL last, ties by role and text; repeated
    rows are turns of their own. A NULL role or text is empty. Rows with a NULL conv_id are one conversation. A
    conversation is one text and has to fit a row. ``round_trip`` says that the turns read back equal the source; the
    grammar makes it true for every text once escaped.
    """
    said = F.struct(
        F.col(turn).isNull().alias("no_turn"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    grouped = rows.select(F.col(conv_id).alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    source = grouped.select("conv_id", F.transform("said", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    plain = source.withColumn("plain", render(F.col("source"), False))
    first = plain.withColumn("first", parse(F.col("plain")))
    chosen = first.withColumn("escaped", ~F.col("first").eqNullSafe(F.col("source")))
    written = chosen.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("plain")))
    back = written.withColumn("turns", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("first")))
    return back.select("conv_id", "formatted", "turns", "escaped", F.col("turns").eqNullSafe(F.col("source")).alias("round_trip"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """The text a model is trained on: that role's texts in order, nothing between them."""
    own = F.filter(turns, lambda t: t["role"] == role)
    return F.array_join(F.transform(own, lambda t: t["text"]), "")
