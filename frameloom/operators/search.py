"""Fuzzy search over names: subsequence match, score, matched positions, ordered top results."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.numeric import col
from frameloom.functions.text import natural_key

# Points of the affine-gap subsequence score. A name that starts with the
# pattern wins over one that has it after a slash, and that over one after another separator.
MATCH_POINTS = 16
START_POINTS = 16
SLASH_POINTS = 8
SEPARATOR_POINTS = 7
CAMEL_POINTS = 6
RUN_POINTS = 4
GAP_OPEN = -3
GAP_EXTEND = -1

_SLASHES = frozenset("/\\")
_SEPARATORS = frozenset(" _-.:,;|") | _SLASHES


def may_match(text, pattern: str) -> Column:
    """Cheap JVM-side test that the pattern's letters occur in order, in one pass without going back."""
    flags = "(?s)" if _case_matters(pattern) else "(?isu)"
    letters = [re.escape(letter) if letter != "^" else r"\^" for letter in pattern]
    return col(text).rlike(flags + "^" + "".join(f"[^{letter}]*+{letter}" for letter in letters))


def _case_matters(pattern: str) -> bool:
    return pattern != pattern.lower()


def _starting_points(text: str) -> list[int]:
    """Bonus of each position for standing at the start of the text or of a word."""
    points, before = [], None
    for letter in text:
        if before is None:
            points.append(START_POINTS)
        elif letter in _SEPARATORS:
            points.append(0)
        elif before in _SLASHES:
            points.append(SLASH_POINTS)
        elif before in _SEPARATORS:
            points.append(SEPARATOR_POINTS)
        elif before.islower() and letter.isupper():
            points.append(CAMEL_POINTS)
        else:
            points.append(0)
        before = letter
    return points


def best_alignment(text: str, pattern: str) -> tuple[int, list[int]] | None:
    """Highest-scoring way to find the pattern's letters in order, or None.

    Each letter earns match points plus its position's bonus; a letter right after the
    previous one earns at least the run points; skipped characters between letters cost an
    opening penalty and an extending one per character.
    """
    if not pattern:
        return 0, []
    source, wanted = (text, pattern) if _case_matters(pattern) else (text.lower(), pattern.lower())
    if len(source) != len(text):  # lower-casing changed the length; compare as written
        source, wanted = text, pattern
    bonus = _starting_points(text)
    n = len(source)
    previous: list[int | None] = [None] * n
    trails: list[list[int | None]] = []
    for k, letter in enumerate(wanted):
        scores: list[int | None] = [None] * n
        trail: list[int | None] = [None] * n
        gap_score, gap_from = None, None  # best earlier placement with its gap cost so far
        for i in range(n):
            if gap_score is not None:
                gap_score += GAP_EXTEND
            if k and i >= 2 and previous[i - 2] is not None:
                opened = previous[i - 2] + GAP_OPEN + GAP_EXTEND
                if gap_score is None or opened >= gap_score:
                    gap_score, gap_from = opened, i - 2
            if source[i] != letter:
                continue
            if k == 0:
                scores[i] = MATCH_POINTS + bonus[i]
                continue
            options = []
            if i and previous[i - 1] is not None:
                options.append((previous[i - 1] + MATCH_POINTS + max(bonus[i], RUN_POINTS), i - 1))
            if gap_score is not None:
                options.append((gap_score + MATCH_POINTS + bonus[i], gap_from))
            if options:
                scores[i], trail[i] = max(options, key=lambda option: option[0])
        trails.append(trail)
        previous = scores
    ends = [i for i in range(n) if previous[i] is not None]
    if not ends:
        return None
    end = max(ends, key=lambda i: (previous[i], -i))
    spots, at = [], end
    for trail in reversed(trails):
        spots.append(at)
        at = trail[at]
    return previous[end], spots[::-1]


def scored(names: DataFrame, column: str, pattern: str) -> DataFrame:
    """Matching rows with ``score`` and the 0-based ``positions`` of the pattern's letters."""
    if not pattern:
        return names.withColumn("score", F.lit(0).cast("bigint")).withColumn(
            "positions", F.array().cast("array<int>")
        )

    @F.pandas_udf("score bigint, positions array<int>")
    def rate(texts: pd.Series) -> pd.DataFrame:
        found = [best_alignment(text, pattern) or (None, None) for text in texts]
        return pd.DataFrame(
            {"score": pd.array([f[0] for f in found], dtype="Int64"), "positions": [f[1] for f in found]}
        )

    once = rate.asNondeterministic()  # or the filter on the score would score a second time
    hits = names.where(may_match(column, pattern)).withColumn("_hit", once(F.col(column)))
    return hits.where("_hit.score is not null").select(*names.columns, "_hit.score", "_hit.positions")


def find_paths(paths: DataFrame, pattern: str, skip: int, take: int, column: str = "path") -> DataFrame:
    """Best paths first, equal scores in natural order; an empty pattern lists all paths in natural order."""
    ranked = scored(paths, column, pattern).orderBy(F.desc("score"), natural_key(column), column, *paths.columns)
    return ranked.offset(skip).limit(take)


def find_in_list(values: DataFrame, pattern: str, column: str, index: str) -> DataFrame:
    """All matches of an indexed list, best first, equal scores by index."""
    return scored(values, column, pattern).orderBy(F.desc("score"), index)
