"""Merkle manifest of a dataset as a postorder append log.

Leaves of a tree are numbered from 0. The node (k, j) covers the leaves from ``j * 2^k`` on, ``2^k`` of them or as many as
there are, and is done with its last leaf. Written in the order in which they are done, nodes have positions that follow
from the sizes of the subtrees before them: before leaf i come the ``2 * i - bits(i)`` nodes of the whole subtrees over the
leaves 0 to i - 1, and the nodes that are done with a leaf follow it level by level. So the place of a sibling is
arithmetic, and blocks of leaves that start at multiples of ``2^BLOCK_LEVELS`` can be written side by side.

The log is a table of segments ``(tree, first, n_nodes, digests)``: a run of nodes with positions from ``first`` on, 32
bytes each. Blocks write one segment each; builders one layer up take the last nodes of the blocks as their leaves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.spread import attach_by_key, join_keys, number_rows, settle

BLOCK_LEVELS = 8  # a builder takes up to 256 leaves
LOG_SCHEMA = "tree long, layer int, block long, n_leaves long, first long, n_nodes long, digests binary, last string"
STEP_SCHEMA = "tree long, layer int, block long, path array<string>"


def digest(*parts: str) -> str:
    """Lower-case hex SHA-256 of texts one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def position(level: int, index: int, n_leaves: int) -> int:
    """Place in the log of a tree's node."""
    last = min((index + 1) << level, n_leaves) - 1
    return 2 * last - last.bit_count() + level


def height(n_leaves: int) -> int:
    """Levels above the leaves: one leaf alone is the root."""
    return max(n_leaves - 1, 0).bit_length()


def append(leaves: list[str], levels: int) -> list[str]:
    """A builder: takes leaves one after the other and writes each node as soon as it is done, up to ``levels`` levels.

    Nodes at the right edge have fewer leaves; one child alone is hashed as well.
    """
    log: list[str] = []
    open_nodes: list[list[str]] = [[] for _ in range(levels + 1)]
    for i, leaf in enumerate(leaves):
        last, done, k = i == len(leaves) - 1, leaf, 0
        log.append(done)
        while k < levels:
            open_nodes[k].append(done)
            if len(open_nodes[k]) < 2 and not last:
                break
            done = digest(*open_nodes[k])
            open_nodes[k] = []
            log.append(done)
            k += 1
    return log


def siblings(index: int, n_leaves: int, levels: int) -> list[tuple[str, int | None]]:
    """Side and position of the sibling on each level of a leaf's way up; a node alone has none."""
    way: list[tuple[str, int | None]] = []
    for k in range(levels):
        other = (index >> k) ^ 1
        there = other << k < n_leaves
        way.append(("<" if other < index >> k else ">", position(k, other, n_leaves)) if there else ("=", None))
    return way


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path give. A step is ``<`` or ``>`` with the sibling on that side, or ``=``."""
    for step in path:
        leaf = digest(step[1:], leaf) if step[0] == "<" else digest(leaf, step[1:])
    return leaf


def _segment(digests: bytes, at: int) -> str:
    return digests[32 * at : 32 * at + 32].hex()


def _build(layer: int, levels: int):
    """One builder per (tree, block): its segment of the log and its last node."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, block = int(key[0]), int(key[1])
        rows = rows.sort_values("index")
        n = int(rows["n"].iloc[0])
        log = append(rows["digest"].tolist(), min(levels, height(n)))
        first = position(0, int(rows["index"].iloc[0]), n)
        packed = b"".join(bytes.fromhex(d) for d in log)
        return pd.DataFrame({"tree": [tree], "layer": [layer], "block": [block], "n_leaves": [n], "first": [first], "n_nodes": [len(log)], "digests": [packed], "last": [log[-1]]})

    return run


def build_log(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """``leaves(tree, index, n, digest)``, numbered from 0 to n - 1 in every tree -> the layers of the log.

    Each layer holds one row per builder, is written to the shared folder, and feeds the next one with its last nodes until
    every tree has one builder. There are as many layers as the largest tree needs, each a 256th of the one before.
    A tree of one leaf has it as its only node. An empty table gives one empty layer.
    """
    layers: list[DataFrame] = []
    while True:
        blocks = leaves.withColumn("block", F.shiftright("index", levels)).groupBy("tree", "block")
        layers.append(settle(blocks.applyInPandas(_build(len(layers), levels), LOG_SCHEMA), "log"))
        built = layers[-1]
        left = built.where(F.col("n_leaves") > (1 << levels)).select(
            "tree", F.col("block").alias("index"), F.shiftright(F.col("n_leaves") + ((1 << levels) - 1), levels).alias("n"), F.col("last").alias("digest")
        )
        if left.isEmpty():
            return layers
        leaves = left


def whole_log(layers: list[DataFrame], levels: int = BLOCK_LEVELS) -> DataFrame:
    """The log as one table ``(tree, first, n_nodes, digests)`` whose segments, by ``first``, hold all nodes in order.

    A builder of an upper layer adds one run of nodes behind the segment of each of its leaves; its leaves themselves are
    the last nodes of segments below.
    """
    parts = layers[0].select("tree", "first", "n_nodes", "digests")
    for layer, built in enumerate(layers[1:], 1):
        lower = layers[0].groupBy("tree").agg(F.first("n_leaves").alias("all"))

        def runs(frames, layer=layer):
            for rows in frames:
                for r in rows.itertuples():
                    base, n = int(r.block) << levels, int(r.n_leaves)
                    local = min(n - base, 1 << levels)
                    found = []
                    for i in range(local):
                        start = position(0, base + i, n) - int(r.first)
                        stop = position(0, base + i + 1, n) - int(r.first) if i + 1 < local else int(r.n_nodes)
                        if stop - start > 1:
                            last = min((base + i + 1) << (levels * layer), int(r.all)) - 1
                            first = 2 * last - last.bit_count() + levels * layer + 1
                            found.append((int(r.tree), first, stop - start - 1, r.digests[32 * (start + 1) : 32 * stop]))
                    yield pd.DataFrame(found, columns=["tree", "first", "n_nodes", "digests"])

        parts = parts.unionByName(built.join(lower, "tree").mapInPandas(runs, "tree long, first long, n_nodes long, digests binary"))
    return parts


def _steps(levels: int):
    """The steps inside a segment for each of its leaves: siblings looked up by position."""

    def path(digests: bytes, first: int, index: int, n: int) -> list[str]:
        way = siblings(index, n, min(levels, height(n)))
        return [side if at is None else side + _segment(digests, at - first) for side, at in way]

    return path


def _upper_paths(layers: list[DataFrame], levels: int) -> DataFrame | None:
    """``(tree, block, above)``: for each builder of the lowest layer the path from its last node to the root of its tree."""
    above: DataFrame | None = None
    for built in reversed(layers[1:]):
        step = _steps(levels)

        def expand(frames, step=step):
            for rows in frames:
                found = []
                for r in rows.itertuples():
                    base, n = int(r.block) << levels, int(r.n_leaves)
                    more = [] if r.above is None else list(r.above)
                    found += [(int(r.tree), i, step(r.digests, int(r.first), i, n) + more) for i in range(base, min(n, base + (1 << levels)))]
                yield pd.DataFrame(found, columns=["tree", "block", "above"])

        held = built.select("tree", "block", "n_leaves", "first", "digests")
        held = join_keys(held, above, ["tree", "block"], "left") if above is not None else held.withColumn("above", F.lit(None).cast("array<string>"))
        above = settle(held.mapInPandas(expand, "tree long, block long, above array<string>"), "paths")
    return above


def tree_roots(layers: list[DataFrame], levels: int = BLOCK_LEVELS) -> DataFrame:
    """``(tree, root)``: the last node of the one builder that a tree ends with."""
    ends = [built.where(F.col("n_leaves") <= (1 << levels)).select("tree", F.col("last").alias("root")) for built in layers]
    return ends[0] if len(ends) == 1 else ends[0].unionByName(_union(ends[1:]))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _prove(levels: int):
    """For the rows of one block: the path of each, its digest, and the root that the row's claimed leaf leads to."""
    step = _steps(levels)

    def run(key: tuple, rows: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        s = segment.iloc[0]
        above = ([] if s["above"] is None else list(s["above"])) + ([] if s["top"] is None else list(s["top"]))
        paths = [step(s["digests"], int(s["first"]), int(i), int(s["n_leaves"])) + above for i in rows["index"]]
        return pd.DataFrame({
            "row": rows["row"], "subroot": s["subroot"],
            "path": paths, "proof_sha256": [digest(*[p[1:] for p in path]) for path in paths],
            "folded_root": [fold(claim, path) for claim, path in zip(rows["claim"], paths)],
        })

    return run


def leaf_text(columns: list[Column], kinds: list[str]) -> Column:
    """What a leaf hashes: each value as ``-`` if NULL, else its UTF-8 byte count, a colon and the value."""
    shown = [c if kind == "binary" else c.cast("string") for c, kind in zip(columns, kinds)]
    parts = [F.when(s.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.octet_length(s).cast("string").cast("binary"), F.lit(":").cast("binary"), s.cast("binary"))) for s in shown]
    return F.concat(*parts)


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, claims: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS) -> tuple[DataFrame, DataFrame, str | None]:
    """Build the log over ``docs`` and prove every row: ``(rows, log, root)``.

    Leaves hash ``columns``; the rows of each value of ``group`` form a tree in ascending order of ``order`` (NULL first),
    and the roots of the trees, by value (NULL first, bytewise), are the leaves of the top tree, number -1 in the log.
    ``rows`` has ``doc_id`` (the order column), ``leaf, subroot, root, path, proof_sha256, folded_root, verified``.
    ``claims`` gives other values for some columns, as someone might present the row: ``folded_root`` follows from the
    claimed leaf and the siblings of the log.

    Every row of ``docs`` is a leaf. Rows with equal order values follow each other by their digests; rows that repeat
    everything are leaves of their own with proofs of their own. NULL values are allowed in every column. An empty table
    has no rows, an empty log and no root. Extra columns are not read.
    """
    kinds = {f.name: f.dataType.typeName() for f in docs.schema.fields}
    own = [F.col(c) for c in columns]
    told = [(claims or {}).get(c, F.col(c)) for c in columns]
    hashed = F.sha2(leaf_text(own, [kinds[c] for c in columns]), 256)
    claimed = F.sha2(leaf_text(told, [kinds[c] for c in columns]), 256) if claims else hashed
    changed = F.lit(False)
    for c in claims or {}:
        changed = changed | ~claims[c].eqNullSafe(F.col(c))
    read = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(group).alias("_group"), F.col(order).alias("_order"), hashed.alias("digest"),
        F.when(changed, claimed).alias("claim"),
    )
    leaves = settle(read, "leaves")

    values = leaves.groupBy("_group").agg(F.count("*").alias("n")).withColumn("_all", F.lit(0))
    trees = settle(number_rows(values, ["_all"], ["_group"], "tree").select("_group", "tree", "n"), "trees")
    numbered = number_rows(leaves, ["_group"], ["_order", "digest", "row"], "index")
    placed = settle(attach_by_key(numbered, trees, ["_group"], ["row"], settled=True).drop("_group"), "placed")

    layers = build_log(placed.select("tree", "index", "n", "digest"), levels)
    roots = settle(tree_roots(layers, levels), "roots")
    count = roots.count()
    if not count:
        empty = placed.limit(0).select(F.col("_order").alias("doc_id"), F.col("digest").alias("leaf"), F.lit("").alias("subroot"), F.lit("").alias("root"), F.array(F.lit("")).alias("path"), F.lit("").alias("proof_sha256"), F.lit("").alias("folded_root"), F.lit(True).alias("verified"))
        return empty, whole_log(layers, levels), None
    top_leaves = roots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(count).cast("long").alias("n"), F.col("root").alias("digest"))
    top_layers = build_log(top_leaves, levels)
    root = tree_roots(top_layers, levels).first()["root"]
    log = whole_log(layers, levels).unionByName(whole_log(top_layers, levels))

    # One row per tree: its root and the path from there to the root of all.
    tops = _all_paths(top_layers, levels).withColumnRenamed("path", "top").join(roots.withColumnRenamed("root", "subroot"), "tree")
    above = _upper_paths(layers, levels)
    segments = layers[0].select("tree", "block", "n_leaves", "first", "digests")
    segments = join_keys(segments, above, ["tree", "block"], "left") if above is not None else segments.withColumn("above", F.lit(None).cast("array<string>"))
    segments = settle(attach_by_key(segments, tops, ["tree"], ["block"]), "segments")

    asked = placed.select("tree", "row", "index", F.coalesce("claim", "digest").alias("claim"), F.shiftright("index", levels).alias("block"))
    proved = asked.groupBy("tree", "block").cogroup(segments.groupBy("tree", "block")).applyInPandas(
        _prove(levels), "row long, subroot string, path array<string>, proof_sha256 string, folded_root string"
    )
    rows = placed.select("row", F.col("_order").alias("doc_id"), F.col("digest").alias("leaf")).join(proved, "row").select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "path", "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
    return rows, log, root


def _all_paths(layers: list[DataFrame], levels: int) -> DataFrame:
    """``(tree, path)`` of every leaf of the top tree, whose leaves are the other trees."""
    whole = _upper_paths([layers[0], *layers], levels)
    return whole.select(F.col("block").alias("tree"), F.col("above").alias("path"))


def read_nodes(log: DataFrame, wanted: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``wanted(tree, position)`` -> with ``digest``, from the segments that hold these positions.

    A segment of a block has at most ``2^(levels + 1)`` nodes, so each position meets the segments of its own stretch
    of the log and of the one before.
    """
    span = 1 << (levels + 1)
    segments = log.withColumn("_stretch", F.floor(F.col("first") / span))
    asked = wanted.select("tree", "position", F.explode(F.array(F.floor(F.col("position") / span), F.floor(F.col("position") / span) - 1)).alias("_stretch"))
    inside = (F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n_nodes"))
    at = (F.col("position") - F.col("first")) * 32 + 1
    return asked.join(segments, ["tree", "_stretch"]).where(inside).select("tree", "position", F.lower(F.hex(F.substring("digests", at.cast("int"), F.lit(32)))).alias("digest"))
