"""Strings: natural order keys, source expressions, titles, program parameters, settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.numeric import col

# The expression separator, remote schemes, the largest parameter number.
SEPARATOR = "::"
MAX_PARAMETERS = 10
OBJECT_STORE_SCHEME = "s3://"
OBJECT_STORE_READER = "s3a://"
# Remote schemes and the virtual-file prefixes that stand for them in source names.
VIRTUAL_PREFIXES = {"s3://": "/vsis3/", "https://": "/vsicurl/https://", "http://": "/vsicurl/http://"}

_WIDTH = 20
_DIGITS_MARK = "\u0001"
_LEVEL_MARK = "\u0000"


def natural_key(text) -> Column:
    """A string whose plain order is the natural order: digit runs compare as numbers and
    come before any other character; leading zeros do not count.

    A run becomes a mark and 20 digits. Longer numbers, which are rare, follow all of those:
    a colon, the number of digits, the digits.
    """
    text = col(text)
    zeros = "0" * _WIDTH
    padded = F.regexp_replace(text, r"([0-9]+)", f"{_DIGITS_MARK}{zeros}$1")
    short = F.regexp_replace(padded, f"{_DIGITS_MARK}0*?([0-9]{{{_WIDTH}}})(?![0-9])", f"{_DIGITS_MARK}$1")

    def encode(piece: Column) -> Column:
        digits = F.regexp_replace(piece, r"^0+(?=[0-9])", "")
        size = F.length(digits)
        long = F.concat(F.lit(f"{_DIGITS_MARK}:"), F.lpad(size.cast("string"), 9, "0"), digits)
        number = F.when(size <= _WIDTH, F.concat(F.lit(_DIGITS_MARK), F.lpad(digits, _WIDTH, "0"))).otherwise(long)
        return F.when(piece.rlike(r"^[0-9]"), number).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    any_length = F.array_join(F.transform(pieces, encode), "")
    return F.when(text.rlike(f"[0-9]{{{_WIDTH + 1}}}"), any_length).otherwise(short)


def tree_key(path) -> Column:
    """Order of a recursive walk: natural order level by level, a directory's content in its place."""
    levels = F.split(col(path), "/")
    return F.array_join(F.transform(levels, lambda name: natural_key(name)), _LEVEL_MARK)


def sources_of(expression) -> Column:
    """Parts of a source expression, in order."""
    return F.split(col(expression), SEPARATOR)


def readable_path(path) -> Column:
    """Rewrite an object-store address to the scheme Spark's reader knows."""
    path = col(path)
    return F.when(
        path.startswith(OBJECT_STORE_SCHEME), F.regexp_replace(path, f"^{OBJECT_STORE_SCHEME}", OBJECT_STORE_READER)
    ).otherwise(path)


def virtual_path(path) -> Column:
    """The same rewrite with virtual-file prefixes, as used in source names. Every occurrence of
    the scheme the path starts with is replaced."""
    path = col(path)
    out = F.when(F.lit(False), path)
    for scheme, prefix in VIRTUAL_PREFIXES.items():
        out = out.when(path.startswith(scheme), F.replace(path, F.lit(scheme), F.lit(prefix)))
    return out.otherwise(path)


def last_characters(name, n: int) -> Column:
    """The last n characters; all of them when n is -1 or more than there are."""
    name = col(name)
    return name if n == -1 else F.when(F.length(name) <= n, name).otherwise(F.right(name, F.lit(n)))


def frame_title(seq_number, frame, length, name, n: int = -1) -> Column:
    """``#id [shown/length] name`` with a 1-based frame number."""
    head = F.concat(
        F.lit("#"), col(seq_number).cast("string"), F.lit(" ["), col(frame).cast("string"),
        F.lit("/"), col(length).cast("string"), F.lit("]"),
    )
    tail = last_characters(name, n)
    return F.when(F.length(tail) > 0, F.concat(head, F.lit(" "), tail)).otherwise(head)


def size_text(w, h, c) -> Column:
    return F.concat_ws("x", col(w).cast("string"), col(h).cast("string"), col(c).cast("string"))


def parameter_count(program) -> Column:
    """How many of ``$1, $2, ...`` occur without a gap, at most ten."""
    program = col(program)
    gaps = [F.when(~F.contains(program, F.lit(f"${k}")), F.lit(k - 1)) for k in range(1, MAX_PARAMETERS + 1)]
    return F.coalesce(*gaps, F.lit(MAX_PARAMETERS))


def fill_parameters(program, values: Sequence) -> Column:
    """Put numbers, written with six decimals, in place of ``$1, $2, ...``.

    Parameters are filled in order as plain text, so ``$1`` also fills the start of ``$10``.
    A parameter after a gap is replaced by itself.
    """
    count = parameter_count(program)
    out = col(program)
    for k, value in enumerate(values[:MAX_PARAMETERS], start=1):
        mark = F.lit(f"${k}")
        text = F.format_string("%.6f", col(value).cast("double"))
        out = F.replace(out, mark, F.when(count >= k, text).otherwise(mark))
    return out


def fill_names(command, names: Sequence) -> Column:
    """Put file names in place of ``#1, #2, ...``, the highest number first."""
    out = col(command)
    for k in range(len(names), 0, -1):
        out = F.replace(out, F.lit(f"#{k}"), col(names[k - 1]))
    return out


def band_setting(text) -> Column:
    """``c:bands:i,j,k`` as three band numbers; missing ones are -1; NULL for other text."""
    text = col(text)
    numbers = F.regexp_extract(text, r"^c:bands:((?:\s*[+-]?\d+)(?:,\s*[+-]?\d+){0,2})?", 1)
    parts = F.filter(F.split(numbers, ","), lambda p: F.length(p) > 0)
    filled = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.coalesce(F.get(parts, k).try_cast("int"), F.lit(-1)))
    return F.when(text.startswith("c:bands:"), filled)


def playback_setting(text) -> Column:
    """``p:<name>[:<value>]`` as a (name, value) struct; NULL when it is not accepted."""
    text = col(text)
    number = F.regexp_extract(text, r"^p:[a-z]+:\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1)
    whole = F.regexp_extract(text, r"^p:[a-z]+:\s*([+-]?\d+)", 1).try_cast("int")
    value = number.try_cast("double")

    def made(name: str, v: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), v.cast("double").alias("value"))

    return (
        F.when(text.startswith("p:fps:") & value.isNotNull(), made("fps", value))
        .when(text == "p:play", made("play", F.lit(1)))
        .when(text.startswith("p:looping:") & whole.isNotNull(), made("looping", whole))
        .when(text.startswith("p:bouncing:") & whole.isNotNull(), made("bouncing", whole))
        .when(text.startswith("p:direction:") & whole.isin(-1, 1), made("direction", whole))
        .when(text.startswith("p:frame:") & (whole >= 1), made("frame", whole))
    )


def view_setting(text) -> Column:
    """``v:<name>:<x>[,<y>]`` as a (name, x, y) struct; NULL when it is not accepted."""
    text = col(text)
    one = r"([+-]?(?:\d+\.?\d*|\.\d+))"
    x = F.regexp_extract(text, rf"^v:[a-z]+:{one}", 1).try_cast("double")
    y = F.regexp_extract(text, rf"^v:[a-z]+:{one},{one}", 2).try_cast("double")

    def made(name: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), a.cast("double").alias("x"), b.cast("double").alias("y"))

    nothing = F.lit(None)
    return (
        F.when(text.startswith("v:zoom:") & x.isNotNull(), made("zoom", x, nothing))
        .when(text.startswith("v:center:") & y.isNotNull(), made("center", x, y))
        .when(text.startswith("v:svgoffset:") & y.isNotNull(), made("svgoffset", x, y))
        .when(text == "v:s", made("rescale", nothing, nothing))
    )
