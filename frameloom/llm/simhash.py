"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks.

Fingerprints of one document are computed in numpy from XXH64 shingle hashes. Blocks, links and groups are DataFrame
work on distinct fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import as_bytes, document_key
from frameloom.llm.components import components
from frameloom.operators.spread import settle, settle_alone

BITS = 64
SHINGLE_WORDS = 3
SHINGLE_SEED = 42
SLICE = 1 << 16  # shingles whose bits are unpacked at once
PAIR_BUCKET = 64  # buckets up to this size compare their members; larger ones meet over one-bit neighbours


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text: a bit is set if it is set in over half of the shingle hashes."""
    tokens = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, SHINGLE_SEED)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = len(tokens) - words + 1
    votes = np.zeros(BITS, np.int64)
    for at in range(0, count, SLICE):
        stop = min(at + SLICE, count)
        spans = zip(starts[at:stop].tolist(), ends[at + words - 1 : stop + words - 1].tolist())
        hashes = np.array([digest(joined[a:b], SHINGLE_SEED) for a, b in spans], dtype=">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > count).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprint_column(text: str) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")

    return run(as_bytes(text))


def _masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of every choice of ``blocks - distance`` blocks: two fingerprints within the distance agree on one."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    spans = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:])]
    return [sum(chosen) for chosen in combinations(spans, blocks - distance)]


def close_links(prints: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints ``fp`` (distinct, one column) at most ``distance`` bits apart.

    With ``blocks`` blocks, a pair within the distance agrees on ``blocks - distance`` of them, so every choice of so
    many blocks is a join key. Buckets of up to ``PAIR_BUCKET`` members compare their members and keep verified pairs.
    A larger bucket never pairs its members: for a distance of 2, two members are close exactly if they share a value
    at most one bit away from both. Each member names those values, at most 65 rows, and the few members that share a
    value (never more than 65) are linked to the smallest. Both ways connect the same fingerprints, so the row count
    is linear in the fingerprints however they crowd.
    """
    if distance != 2:
        raise ValueError("one-bit neighbours decide a distance of 2")
    masks = _masks(blocks, distance)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    entries = prints.select("fp", F.inline(keys))
    sizes = entries.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(entries.join(sizes, ["choice", "key"]), "blocks")

    members = shared.where(F.col("n") <= PAIR_BUCKET).groupBy("choice", "key").agg(F.collect_list("fp").alias("all"))
    pairs = members.select("all", F.explode("all").alias("a")).select(
        "a", F.explode(F.filter("all", lambda y: (y > F.col("a")) & (F.bit_count(y.bitwiseXOR(F.col("a"))) <= distance))).alias("b")
    )

    bits = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    near = shared.where(F.col("n") > PAIR_BUCKET).select(
        "choice", "key", "fp", F.explode(F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b))).alias("value")
    )
    met = near.groupBy("choice", "key", "value").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, blocks: int = 4) -> DataFrame:
    """One row per document: ``(doc_id, doc_key, fp, root, component_id, stays)``.

    ``root`` is a fingerprint that names the component, ``component_id`` is the smallest doc_id reachable, and ``stays``
    marks the document that stands for the component.
    A NULL text has no words, texts without words have fingerprint zero and are linked like any other. A NULL doc_id
    keeps its row and counts as larger than any other. Among rows that share a doc_id, ``doc_key`` decides; rows that
    repeat id and text are the same document and stay or go together.
    """
    prints = settle(
        docs.select(F.col(doc_id).alias("doc_id"), document_key(doc_id, text).alias("doc_key"), fingerprint_column(text).alias("fp")),
        "prints",
    )
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_key")
    smallest = settle(prints.groupBy("fp").agg(F.min(place).alias("first")), "distinct-prints")
    found = settle_alone(docs.sparkSession, "groups", lambda: components(close_links(smallest.select("fp"), distance, blocks)))
    rooted = smallest.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    return prints.join(rooted.join(heads, "root").select("fp", "root", "head"), "fp").select(
        "doc_id", "doc_key", "fp", "root", F.col("head.doc_id").alias("component_id"), place.eqNullSafe(F.col("head")).alias("stays")
    )
