"""Learned decision lists for text quality, in DataFrame functions only.

Statistics of every text become a few shares. Sequential covering learns ordered conjunctions of thresholds on them from
labelled rows: each rule is grown on one part of the rows and pruned on another, and the rows it covers leave before the
next one. The list is a Spark conditional expression that reads like a filter written by hand.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import document_key, words_of
from frameloom.operators.spread import settle

SYMBOLS = r"[#*$%&|<>]"  # fixed: the characters that count as symbols
UPPER = r"[A-Z]"
MARKS = r"[!?;:]"

CUTS = 40  # thresholds that are tried for a share and class, at quantiles of the labelled rows
MAX_RULES = 10
MAX_CONDITIONS = 3
MIN_COVER = 4  # labelled rows that a rule must catch in the part it was not grown on
MIN_PRECISION = 0.8


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts over the whole text of every document; NULL counts as empty.

    Repeated three-word windows are found inside the row: windows are hashed to 64 bits, and only a text with equal
    hashes sorts them together with their places.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    listed = docs.select(
        F.col(doc_id).alias("doc_id"), document_key(doc_id, text).alias("doc_key"), body.alias("body"), words_of(text).alias("w"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("filled"),
    )
    starts = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    hashed = listed.select(
        "doc_id", "doc_key", F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        *[
            F.regexp_count("body", F.lit(characters)).cast("bigint").alias(name)
            for name, characters in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_marks", MARKS))
        ],
        F.size("filled").cast("bigint").alias("n_lines"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("bigint").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))).alias("h"),
    )
    kept = [c for c in hashed.columns if c != "h"]
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    ordered = hashed.select(*kept, F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).alias("s"))
    same = lambda i, j: F.get("s", i)["x"] == F.get("s", j)["x"]
    twice = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda i: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.get("s", i)["i"] + k))))
    return ordered.select(*kept, F.when(F.col("s").isNull(), 0).otherwise(F.size(covered)).cast("bigint").alias("n_repeat_words"))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def shares() -> dict[str, Column]:
    """What rules may ask about, by name, as expressions over :func:`text_statistics`."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "marks_per_word": _share("n_marks", "n_words"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "repeated_lines": _share("n_dup_lines", "n_lines"),
        "words_per_line": _share("n_words", "n_lines"),
    }


class Condition(NamedTuple):
    share: str
    above: bool
    cut: float

    def test(self, value: Column) -> Column:
        return value >= self.cut if self.above else value < self.cut

    def __str__(self) -> str:
        return f"{self.share} {'>=' if self.above else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, value: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.test(value[c.share]) for c in rule], F.lit(True))


def decision(rules: list[Rule], value: dict[str, Column]) -> Column:
    """The list as one expression: false from the first rule that holds, true if none does."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(_holds(rule, value), F.lit(False))
    return out.otherwise(F.lit(True))


def _cuts(rows: DataFrame, names: list[str]) -> dict[str, list[float]]:
    steps = [(i + 0.5) / CUTS for i in range(CUTS)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in names]).collect()
    return {n: sorted({float(v) for row in found for v in row[n] or []}) for n in names}


def _best(rows: DataFrame, cuts: dict[str, list[float]], rule: Rule) -> tuple[float, Condition] | None:
    """The condition with the largest information gain over the rule, from one count per share and interval."""
    interval = lambda n: F.size(F.filter(F.array(*map(F.lit, cuts[n])), lambda c: c <= F.col(n)))
    names = [n for n in cuts if cuts[n]]
    if not names:
        return None
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("share"), interval(n).alias("at")) for n in names]))
    counted = rows.select("bad", pairs.alias("p")).groupBy("p.share", "p.at").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
    best: tuple[float, Condition] | None = None
    for n in names:
        own = {r["at"]: (r["bad"], r["n"] - r["bad"]) for r in counted if r["share"] == n}
        all_bad, all_good = (sum(v[i] for v in own.values()) for i in (0, 1))
        if not all_bad:
            return None
        before = math.log2(all_bad / (all_bad + all_good))
        bad = good = 0
        for at, cut in enumerate(cuts[n]):
            bad, good = bad + own.get(at, (0, 0))[0], good + own.get(at, (0, 0))[1]
            for above, p, q in ((False, bad, good), (True, all_bad - bad, all_good - good)):
                if p and (p, q) != (all_bad, all_good):
                    option = p * (math.log2(p / (p + q)) - before), Condition(n, above, cut)
                    if option[1] not in rule and (best is None or option > best):
                        best = option
    return best if best and best[0] > 0 else None


def learn_rules(labelled: DataFrame, max_rules: int = MAX_RULES) -> list[Rule]:
    """``labelled(doc_key, bad 0/1, one column per share)`` -> ordered rules for bad rows.

    Two thirds of the rows, by hash, grow the rules; the others cut each rule back to the prefix that tells most and
    decide whether it is good enough. The driver sees counts per share and interval only, whatever the number of rows.
    """
    value = {n: F.col(n) for n in shares()}
    names = list(value)
    rows = labelled.withColumn("grow", F.pmod(F.xxhash64(F.lit(3), "doc_key"), F.lit(3)) < 2)
    cuts = _cuts(rows, names)
    rules: list[Rule] = []
    for _ in range(max_rules):
        left = rows.where(decision(rules, value))
        rule: Rule = ()
        for _ in range(MAX_CONDITIONS):
            found = _best(left.where("grow").where(_holds(rule, value)), cuts, rule)
            if found is None:
                break
            rule += (found[1],)
        if not rule:
            break
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        tested = left.where("NOT grow").agg(
            *[F.sum(F.when(_holds(p, value) & (F.col("bad") == b), 1).otherwise(0)).alias(f"{k}_{b}") for k, p in enumerate(prefixes) for b in (0, 1)]
        ).first()
        scored = [((tested[f"{k}_1"] or 0), (tested[f"{k}_0"] or 0)) for k in range(len(prefixes))]
        worth = [(p - q) / (p + q) if p + q else -1.0 for p, q in scored]
        best = worth.index(max(worth))
        bad, good = scored[best]
        if bad < MIN_COVER or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(prefixes[best])
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[Rule]]:
    """One row per document with its statistics, ``base_failed`` and ``kept``; and the rules learned.

    ``labels(doc_id, quality)`` teach with 0 for bad and 1 for good; NULL ids and labels teach nothing, an id with
    several labels has the smallest. Texts that fail the base test teach nothing: the list decides among the others.
    Without labelled bad rows there are no rules and all that pass the base test are kept.
    """
    counted = settle(text_statistics(docs, doc_id, text), "statistics").withColumn("base_failed", base_failed())
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    taught = counted.where("NOT base_failed").join(known, "doc_id").select(
        "doc_key", (F.col("quality") == 0).cast("int").alias("bad"), *[v.alias(n) for n, v in shares().items()]
    )
    rules = learn_rules(settle(taught, "labelled"))
    return counted.withColumn("kept", ~F.col("base_failed") & decision(rules, shares())), rules
