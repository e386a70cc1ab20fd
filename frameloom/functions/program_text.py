"""Pixel programs as text in postfix notation, compiled to columns.

A program is a list of words: numbers, variables, ``x[1]`` for one band, functions, and the places ``:i :j :w :h``. Words
that are none of these are variables; they stand for the images in alphabetical order. A program without any variable gets
one for every image, pushed in front. Every step is rounded to float32.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.numeric import f32, lit32


def _truth(test: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(test(a, b), 1.0).otherwise(0.0)


def _by_zero(b: Column, function: Callable[[Column], Column], at_zero: Column) -> Column:
    """A function of a divisor as floating point has it, with a value instead of an error at zero."""
    return F.when(b == 0, at_zero).otherwise(function(F.nullif(b, lit32(0.0))))


def _log(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda a: F.when(a == 0, float("-inf")).when(a < 0, float("nan")).otherwise(function(a.cast("double")))


# The words of the language.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: _by_zero(b, lambda d: a / d, F.when(a == 0, float("nan")).otherwise(F.signum(a) * float("inf"))),
    "^": lambda a, b: F.pow(a, b),
    "fmod": lambda a, b: _by_zero(b, lambda d: a % d, F.lit(float("nan"))),
    "atan2": lambda a, b: F.atan2(a, b),
    "hypot": lambda a, b: F.hypot(a, b),
    "fmin": lambda a, b: F.least(a, b),
    "fmax": lambda a, b: F.greatest(a, b),
    "<": _truth(lambda a, b: a < b),
    ">": _truth(lambda a, b: a > b),
    "<=": _truth(lambda a, b: a <= b),
    ">=": _truth(lambda a, b: a >= b),
    "=": _truth(lambda a, b: a == b),
}
UNARY: dict[str, Callable[[Column], Column]] = {
    "sqrt": F.sqrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "fabs": F.abs, "rint": lambda a: F.rint(a.cast("double")),
    "floor": lambda a: F.floor(a.cast("double")).cast("double"), "ceil": lambda a: F.ceil(a.cast("double")).cast("double"),
    "log": _log(F.ln), "log10": _log(F.log10), "log2": _log(F.log2),
}
STACK = ("dup", "rot", "del")
OF_BANDS = ("join", "vnorm", "vavg")
CONSTANTS = {"pi": 3.141592653589793}
PLACES = (":i", ":j", ":w", ":h")

_BAND = re.compile(r"^([A-Za-z_]\w*)\[(\d+)\]$")
_NAME = re.compile(r"^[A-Za-z_]\w*$")


class ProgramError(ValueError):
    """A program that cannot be run; its message is the error of every frame."""


def _number(word: str) -> float | None:
    try:
        return float(word)
    except ValueError:
        return None


@dataclass(frozen=True)
class Program:
    words: tuple[str, ...]
    variables: tuple[str, ...]  # in the order of the images
    bands: bool  # whether words look at bands of a pixel together


def compile_text(text: str, count: int) -> Program:
    """Find the variables of a program and check them against the number of images.

    Without variables, as many hidden ones as there are images are put in front.
    """
    words, names = text.split(), set()
    known = {*BINARY, *UNARY, *STACK, *OF_BANDS, *CONSTANTS, *PLACES}
    for word in words:
        band = _BAND.match(word)
        if word in known or _number(word) is not None:
            continue
        if not band and not _NAME.match(word):
            raise ProgramError(f"unknown word {word!r}")
        names.add(band[1] if band else word)
    if not names:
        hidden = [f"_hidden{k:06d}" for k in range(count)]
        words, names = [*hidden, *words], set(hidden)
    if len(names) != count:
        raise ProgramError(f"the program expects {len(names)} variables but {count} images were given")
    return Program(tuple(words), tuple(sorted(names)), any(w in OF_BANDS or _BAND.match(w) for w in words))


def _each(value, function: Callable[[Column], Column]):
    kind, column = value
    return (kind, F.transform(column, lambda v: f32(function(v)))) if kind == "bands" else (kind, f32(function(column)))


def _both(left, right, function: Callable[[Column, Column], Column]):
    """Band by band; one value, or an image of one band, meets every band of the other."""
    (k1, a), (k2, b) = left, right
    if k1 == k2 == "one":
        return "one", f32(function(a, b))
    if k1 == "one":
        return "bands", F.transform(b, lambda v: f32(function(a, v)))
    if k2 == "one":
        return "bands", F.transform(a, lambda v: f32(function(v, b)))
    pairs = F.zip_with(a, b, lambda v, w: f32(function(v, w)))
    first, second = F.get(a, 0), F.get(b, 0)
    return "bands", F.when(F.size(a) == F.size(b), pairs).when(
        F.size(a) == 1, F.transform(b, lambda w: f32(function(first, w)))
    ).when(F.size(b) == 1, F.transform(a, lambda v: f32(function(v, second))))


def _as_bands(value) -> Column:
    kind, column = value
    return column if kind == "bands" else F.array(column)


def evaluate(program: Program, images: Sequence[Column], places: dict[str, Column]) -> Column:
    """The column that a program gives for the columns of its images, in order.

    With ``program.bands`` images and result are band vectors, else single samples.
    """
    kind = "bands" if program.bands else "one"
    of = {name: (kind, column) for name, column in zip(program.variables, images)}
    stack: list = []

    def pop():
        if not stack:
            raise ProgramError("stack underflow")
        return stack.pop()

    for word in program.words:
        band = _BAND.match(word)
        if word in BINARY:
            right, left = pop(), pop()
            stack.append(_both(left, right, BINARY[word]))
        elif word in UNARY:
            stack.append(_each(pop(), UNARY[word]))
        elif word == "dup":
            stack.append(pop())
            stack.append(stack[-1])
        elif word == "rot":
            right, left = pop(), pop()
            stack += [right, left]
        elif word == "del":
            pop()
        elif word == "join":
            right, left = pop(), pop()
            stack.append(("bands", F.concat(_as_bands(left), _as_bands(right))))
        elif word in ("vnorm", "vavg"):
            vector = _as_bands(pop())
            total = F.aggregate(vector, F.lit(0.0), lambda s, v: s + (v.cast("double") * v if word == "vnorm" else v.cast("double")))
            stack.append(("one", f32(F.sqrt(total) if word == "vnorm" else total / F.size(vector))))
        elif word in PLACES:
            stack.append(("one", f32(places[word])))
        elif word in CONSTANTS or _number(word) is not None:
            stack.append(("one", lit32(CONSTANTS.get(word) or _number(word))))
        elif band:
            stack.append(("one", F.get(of[band[1]][1], int(band[2]))))
        else:
            stack.append(of[word])
    if len(stack) != 1:
        raise ProgramError(f"{len(stack)} values left on the stack")
    return _as_bands(stack[0]) if program.bands else stack[0][1]
