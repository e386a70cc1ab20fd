"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source is wanted the same number of times, in general not a whole number. The fractions are rounded
in pairs: a pair moves words from one document to the other, in a random direction with the expectations kept, until
one of the two counts is whole. The other one goes on. Each source thus takes its target up to one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.llm.common import document_key, words_of
from frameloom.operators.spread import settle

WEIGHTS = 5, 2, 1
MOST_COPIES = 3
FAN_IN = 32  # undecided documents that meet in one node of the reduction tree, on average
SEED = 17
DEAL_ROWS = 1 << 14  # equal rows that one row unfolds to at once


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes(source, size)`` -> one row per source: ``source, source_no, source_size, target``.

    Sources in order of code points, NULL last, have the weights in turn and share the sum of all sizes. A target ends
    at ``most`` times its source's size; what is over is shared by weight among the others. With sources in order of
    size per weight, those that end there come first, so running sums decide it. The windows see one row per source.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    onwards, before = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    share = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    full = most * F.col("source_size") * F.sum("weight").over(onwards) <= share * F.col("weight")
    marked = weighed.withColumn("total", F.sum("source_size").over(everything)).withColumn("full", full)
    held = most * F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    return marked.withColumns({"held": held, "open_weight": open_weight}).select(
        "source", "source_no", "source_size",
        F.when(F.col("full"), (most * F.col("source_size")).cast("double"))
        .otherwise((F.col("total") - F.col("held")).cast("double") * F.col("weight") / F.col("open_weight")).alias("target"),
    )


UNIT = "struct<size:bigint,doc_id:{id},doc_key:bigint,rows:bigint,base:bigint,part:double>"
DONE = "struct<size:bigint,doc_id:{id},doc_key:bigint,rows:bigint,copies:bigint>"
NEARLY = 1e-9


def _chance(*parts: Column | int) -> Column:
    """A number in [0, 1) that depends on the arguments alone."""
    bits = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.pmod(bits, F.lit(1 << 52)) / float(1 << 52)


def _with(value: Column, body):
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def _duel(a: Column, b: Column, done: Column, seed: int, unit: str, result: str) -> Column:
    """Move words between two undecided units until one is whole; it joins ``done``, the other is carried on."""

    def settled(x: Column, up: bool) -> Column:
        return F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["doc_key"].alias("doc_key"), x["rows"].alias("rows"), (x["base"] + int(up)).alias("copies")).cast(result)

    def left(x: Column, part: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["doc_key"].alias("doc_key"), x["rows"].alias("rows"), x["base"].alias("base"), part.alias("part")).cast(unit)

    def after(d: Column) -> Column:
        def end(whole: Column, up: bool, other: Column, part: Column) -> Column:
            return F.struct(left(other, part).alias("carry"), F.concat(done, F.array(settled(whole, up))).alias("done"))

        return (
            F.when(d["to_a"] & (d["a_up"] <= d["b_down"]), end(a, True, b, b["part"] - d["a_up"] / b["size"]))
            .when(d["to_a"], end(b, False, a, a["part"] + d["b_down"] / a["size"]))
            .when(d["a_down"] <= d["b_up"], end(a, False, b, b["part"] + d["a_down"] / b["size"]))
            .otherwise(end(b, True, a, a["part"] - d["b_up"] / a["size"]))
        )

    room = F.struct(
        ((1 - a["part"]) * a["size"]).alias("a_up"), (a["part"] * a["size"]).alias("a_down"),
        ((1 - b["part"]) * b["size"]).alias("b_up"), (b["part"] * b["size"]).alias("b_down"),
        _chance(seed, a["doc_id"], a["doc_key"], b["doc_id"], b["doc_key"]).alias("chance"),
    )

    def choose(r: Column) -> Column:
        gain, loss = F.least(r["a_up"], r["b_down"]), F.least(r["a_down"], r["b_up"])
        return F.struct(
            r["a_up"].alias("a_up"), r["a_down"].alias("a_down"), r["b_up"].alias("b_up"), r["b_down"].alias("b_down"),
            (r["chance"] * (gain + loss) < loss).alias("to_a"),
        )

    return _with(room, lambda r: _with(choose(r), after))


def _rounds(units: Column, seed: int, unit: str, result: str) -> Column:
    """Pivotal rounding along an ordered array of units -> ``struct(carry, done)``."""
    start = F.struct(F.lit(None).cast(unit).alias("carry"), F.array().cast(f"array<{result}>").alias("done"))

    def step(state: Column, x: Column) -> Column:
        carry, done = state["carry"], state["done"]
        whole = (carry["part"] <= NEARLY) | (carry["part"] >= 1 - NEARLY)
        closed = F.struct(
            carry["size"].alias("size"), carry["doc_id"].alias("doc_id"), carry["doc_key"].alias("doc_key"), carry["rows"].alias("rows"),
            (carry["base"] + F.round(carry["part"]).cast("bigint")).alias("copies"),
        ).cast(result)
        return (
            F.when(carry.isNull(), F.struct(x.alias("carry"), done.alias("done")))
            .when(whole, F.struct(x.alias("carry"), F.concat(done, F.array(closed)).alias("done")))
            .otherwise(_duel(carry, x, done, seed, unit, result))
        )

    return F.aggregate(units, start, step)


def round_copies(units: DataFrame, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """``units(source_no, doc_id, doc_key, size, wanted)`` -> the same rows with whole ``copies`` instead of ``wanted``.

    The reduction tree: documents of a source and of similar size meet in blocks of about ``fan_in``; each block hands
    on one undecided document; blocks merge ``fan_in`` at a time until a size class has one, and at last the classes of
    a source merge, large ones first. The document that then is left is rounded to the nearer side. No node sees more
    than a block, however many rows a source has. Depth is the logarithm of the largest class. Rows that agree in all
    columns are counted first and are one unit with that many rows: it wants their copies together, has one fraction to
    round, and deals its copies out evenly at the end. Choices depend on ids, texts and the seed, so a rerun agrees.
    """
    kind = units.schema["doc_id"].dataType.simpleString()
    unit, result = UNIT.format(id=kind), DONE.format(id=kind)
    together = units.groupBy("source_no", "doc_id", "doc_key", "size").agg(F.count("*").alias("rows"), F.max("wanted").alias("each"))
    together = together.withColumn("wanted", F.col("each") * F.col("rows"))
    based = together.withColumn("base", F.floor("wanted").cast("bigint")).withColumn("part", F.col("wanted") - F.col("base"))
    based = based.withColumn("open", (F.col("part") > NEARLY) & (F.col("part") < 1 - NEARLY) & (F.col("size") > 0))
    own = F.when(F.col("part") >= 1 - NEARLY, 1).when(F.col("part") <= NEARLY, 0).otherwise((_chance(seed, F.col("doc_id"), F.col("doc_key")) < F.col("part")).cast("int"))
    outcome = based.where(~F.col("open")).select("source_no", "doc_id", "doc_key", "size", "rows", (F.col("base") + own).alias("copies"))

    level = based.where("open").withColumn("class", F.floor(F.log2("size") * 2).cast("int"))
    counts = settle(level.groupBy("source_no", "class").agg(F.count("*").alias("n")), "class-counts")
    largest = counts.agg(F.max("n")).first()[0] or 0
    blocks = F.ceil(F.col("n") / fan_in)
    level = level.join(counts, ["source_no", "class"]).select(
        "source_no", "class", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_key"), blocks).alias("block"),
        F.struct("size", "doc_id", "doc_key", "rows", "base", "part").cast(unit).alias("unit"),
    )

    def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
        listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        nodes = settle(listed.select(*keys, _rounds(F.col("units"), seed, unit, result).alias("node")), "rounding")
        return nodes.select(*keys, "node.carry", "node.done")

    def finished(nodes: DataFrame) -> DataFrame:
        return nodes.select("source_no", F.inline("done")).select("source_no", "doc_id", "doc_key", "size", "rows", "copies")

    most = -(-largest // fan_in)
    while True:
        nodes = merged(level, ["source_no", "class", "block"])
        outcome = outcome.unionByName(finished(nodes))
        level = nodes.select("source_no", "class", F.floor(F.col("block") / fan_in).alias("block"), F.col("carry").alias("unit"))
        if most <= 1:
            break
        most = -(-most // fan_in)
    last = merged(level, ["source_no"])
    final = last.select("source_no", "carry.doc_id", "carry.doc_key", "carry.size", "carry.rows", (F.col("carry.base") + F.round("carry.part").cast("bigint")).alias("copies"))
    return _dealt(outcome.unionByName(finished(last)).unionByName(final))


def _dealt(units: DataFrame) -> DataFrame:
    """One row per row again: the copies of a unit as evenly as whole numbers allow, in steps for units of very many rows."""
    chunks = units.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, F.lit(DEAL_ROWS).cast("bigint"))))
    few, many = chunks.where(F.col("rows") <= DEAL_ROWS), chunks.where(F.col("rows") > DEAL_ROWS)
    spread = few.unionByName(many.repartition("doc_id", "start"))
    each = spread.withColumn("row", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + (DEAL_ROWS - 1), F.col("rows") - 1))))
    more = (F.col("row") < F.col("copies") % F.col("rows")).cast("bigint")
    return each.select("source_no", "doc_id", "doc_key", "size", (F.floor(F.col("copies") / F.col("rows")) + more).alias("copies"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, doc_key, source, size, source_size, target, copies, taken``.

    ``size`` counts the words of the whole text, 0 for NULL; ``taken`` is ``copies`` times that and never more than
    ``most`` times. NULL sources are one source. An empty table, or one without words, takes nothing. ``doc_key`` tells
    apart texts that share a doc_id; rows that repeat both share their copies as evenly as whole numbers allow.
    """
    units = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"), document_key(doc_id, text).alias("doc_key"), F.col(source).alias("source"),
            F.size(words_of(text)).cast("bigint").alias("size"),
        ),
        "units",
    )
    targets = settle(source_targets(units, weights, most), "targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    numbered = units.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rounded = round_copies(numbered.select("source_no", "doc_id", "doc_key", "size", F.least(wanted, F.lit(float(most))).alias("wanted")), seed=seed)
    return rounded.join(targets, "source_no").select(
        "doc_id", "doc_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
