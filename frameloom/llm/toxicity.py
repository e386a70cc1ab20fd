"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.llm.common import as_bytes, document_key
from frameloom.llm.decontaminate import folded
from frameloom.operators.spread import passing, settle

SAMPLE_ROWS = 12_000  # labelled documents that are learned from, at most
SAMPLE_BYTES = 128 * 1024 * 1024  # and bytes of their texts, at most
SHARDS = 8  # parts of the sample that learn side by side in an epoch
EPOCHS = 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2.0, 1.0
COUNT_RANGES = 16  # ranges of hashes whose features are counted one after the other
MIN_DOCS = 3  # a feature enters a shard's model if so many of its documents have it
STEM_BYTES = 4, 5  # beginnings of a word that stand for its inflected and compound forms

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BIAS = np.uint64(1)
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes


def _join(left: np.ndarray, right: np.ndarray, kind: int) -> np.ndarray:
    mixed = (left * _MIX + right) * _MIX + np.uint64(kind)
    return mixed ^ (mixed >> np.uint64(29))


def _words(text: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """A hash of every word, and of its beginnings: computed for all words at once, eight bytes at a time.

    The hash covers the length and all bytes; what lies past the sixteenth of a word of over 24 is added up with powers
    of a constant, so that its order counts.
    """
    body = np.frombuffer(b" " + folded(text) + b" " * 16, np.uint8)
    blank = body == 32
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stop = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    size = stop - start
    eight = np.ndarray(len(body) - 7, "<u8", body, strides=(1,))
    head = eight[start]
    first, second = head & _KEEP[np.minimum(size, 8)], eight[np.minimum(start + 8, stop)] & _KEEP[np.clip(size - 8, 0, 8)]
    last = np.where(size > 16, eight[np.maximum(stop - 8, 0)], np.uint64(0))
    whole = _join(_join(first, second, 5), last, 6) + size.astype(np.uint64)
    long = np.flatnonzero(size > 24)
    if len(long):
        groups = (size[long] - 9) // 8  # groups of eight bytes from the seventeenth on
        turn = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
        at = np.repeat(start[long] + 16, groups) + 8 * turn
        held = eight[at] & _KEEP[np.minimum(np.repeat(stop[long], groups) - at, 8)]
        powers = np.multiply.accumulate(np.full(int(groups.max()), _MIX, np.uint64))
        whole[long] = _join(whole[long], np.add.reduceat((held ^ (held >> np.uint64(31))) * powers[turn], np.cumsum(groups) - groups), 8)
    stems = [_join(head & _KEEP[np.minimum(size, n)], np.zeros(len(size), np.uint64), 6 + n) for n in STEM_BYTES]
    return _join(whole, whole, 1), stems


def features(text: bytes) -> np.ndarray:
    """Hashes of words, stems, word pairs, word triples and pairs with one word between, repeats included."""
    one, stems = _words(text)
    two = _join(one[:-1], one[1:], 2)
    return np.concatenate([one, *stems, two, _join(two[:-1], one[2:], 3), _join(one[:-2], one[2:], 4)])


class Weights(NamedTuple):
    """Sorted feature hashes with what the learner holds of each; zero for all others."""

    feature: np.ndarray
    z: np.ndarray
    n: np.ndarray

    def values(self) -> np.ndarray:
        return _weight(self.z, self.n)


def _weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal closed form: zero inside the L1 band, a per-coordinate rate outside."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def _entered(start: Weights, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features of a shard's rows that are known or that enough of them have, and which ones are known.

    Features are counted by ranges of their hash, so that only a range's are held and sorted at once, besides the rows.
    """
    edges = np.linspace(0, 2.0**64, COUNT_RANGES + 1)[1:-1].astype(np.uint64)
    cuts = [np.searchsorted(r[:-1], edges) for r in rows]  # the bias is last
    found, told = [], []
    for k in range(COUNT_RANGES):
        parts = [r[:-1][(c[k - 1] if k else 0) : (c[k] if k < len(edges) else None)] for r, c in zip(rows, cuts)]
        parts.append(np.full(len(rows), _BIAS) if k == 0 else np.zeros(0, np.uint64))
        feature, seen = np.unique(np.concatenate(parts), return_counts=True)
        at = np.minimum(np.searchsorted(start.feature, feature), max(0, len(start.feature) - 1))
        known = start.feature[at] == feature if len(start.feature) else np.zeros(len(feature), bool)
        entered = known | (seen >= MIN_DOCS)
        found.append(feature[entered])
        told.append(known[entered])
    return np.concatenate(found), np.concatenate(told)


def _learn_shard(start: Weights, bodies: list[bytes], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over a shard, document by document; returns the features that moved, and by how much."""
    rows = [np.append(np.unique(features(b)), _BIAS) for b in bodies]
    feature, known = _entered(start, rows)
    for k, row in enumerate(rows):  # a few of a document's features enter: places instead of hashes, one row at a time
        at = np.minimum(np.searchsorted(feature, row), max(0, len(feature) - 1))
        rows[k] = at[feature[at] == row].astype(np.int32) if len(feature) else np.zeros(0, np.int32)
    at = np.searchsorted(start.feature, feature[known])
    z, n = np.zeros(len(feature)), np.zeros(len(feature))
    z[known], n[known] = start.z[at], start.n[at]
    z0, n0 = z.copy(), n.copy()
    for own, label in zip(rows, labels):
        w = _weight(z[own], n[own])
        gradient = _sigmoid(w.sum()) - label
        step = (np.sqrt(n[own] + gradient * gradient) - np.sqrt(n[own])) / ALPHA
        z[own] += gradient - step * w
        n[own] += gradient * gradient
    moved = np.flatnonzero(n > n0)
    return feature[moved], z[moved] - z0[moved], n[moved] - n0[moved]


def _shard_pass(shared: Broadcast) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "label", "body"])
        feature, dz, dn = _learn_shard(shared.value, list(rows["body"]), list(rows["label"]))
        return pd.DataFrame({"feature": feature.view(np.int64), "shard": rows["shard"].iloc[0], "dz": dz, "dn": dn})

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` with their label: by hash order, at most ``sample_rows`` documents of as many ids of
    ``labels(doc_id, label)``, and no more of them than ``sample_bytes`` hold together.

    The ids, and then the documents told by id and key, are at most ``sample_rows`` narrow rows, so they may be broadcast.
    NULL ids and labels teach nothing; an id with several labels has the largest; rows that repeat id and text teach once,
    and different texts of one id are documents of their own, each in a shard by its key.
    """
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    named = docs.join(F.broadcast(chosen), "doc_id").withColumn("doc_key", document_key("doc_id", "text"))
    sized = named.select("doc_id", "doc_key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    first = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("doc_key")]
    taken = sized.dropDuplicates(["doc_id", "doc_key"]).orderBy(*first).limit(sample_rows)
    upto = Window.orderBy(*first).rowsBetween(Window.unboundedPreceding, 0)
    taken = taken.withColumn("upto", F.sum("bytes").over(upto)).where(F.col("upto") <= sample_bytes).select("doc_id", "doc_key")
    taken = settle(taken, "taken")
    place = F.xxhash64("doc_id", F.lit(5))
    shard = F.xxhash64("doc_id", F.lit(5), F.when(F.col("several"), F.col("doc_key")))
    several = settle(taken.groupBy("doc_id").agg((F.count("*") > 1).alias("several")), "taken-ids")
    joined = named.join(F.broadcast(taken), ["doc_id", "doc_key"]).dropDuplicates(["doc_id", "doc_key"]).join(F.broadcast(several), "doc_id").select(
        F.pmod(F.when(F.col("several"), shard).otherwise(place), F.lit(SHARDS)).cast("int").alias("shard"), place.alias("place"), "label", as_bytes("text").alias("body")
    )
    return settle(joined.repartition(SHARDS, "shard"), "labelled")


def learn(sample: DataFrame, epochs: int = EPOCHS) -> Weights:
    """Epochs of parallel passes. After each, a coordinate moves by the mean of the shards that moved it.

    What reaches the driver is the state of the features that entered some shard: bounded by the bounded sample.
    """
    spark = sample.sparkSession
    state = Weights(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    for _ in range(epochs):
        run = _shard_pass(spark.sparkContext.broadcast(state))
        moved = sample.groupBy("shard").applyInPandas(run, "feature long, shard int, dz double, dn double")
        parts = F.array_sort(F.collect_list(F.struct("shard", "dz", "dn")))
        total = lambda name: F.aggregate("parts", F.lit(0.0), lambda s, p: s + p[name]) / F.size("parts")
        step = moved.groupBy("feature").agg(parts.alias("parts")).select("feature", total("dz").alias("dz"), total("dn").alias("dn")).toPandas()
        feature = np.concatenate([state.feature, step["feature"].to_numpy(np.int64).view(np.uint64)])
        names, code = np.unique(feature, return_inverse=True)
        z = np.bincount(code, np.concatenate([state.z, step["dz"]]), len(names))
        n = np.bincount(code, np.concatenate([state.n, step["dn"]]), len(names))
        state = Weights(names, z, n)
    return state


class Scorer:
    """The non-zero weights, with a small bitmap that rules out most features before the search."""

    def __init__(self, weights: Weights):
        w = weights.values()
        kept = w != 0
        self.feature, self.weight = weights.feature[kept], w[kept]
        bias = np.flatnonzero(self.feature == _BIAS)
        self.bias = float(self.weight[bias].sum())
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.feature & np.uint64((1 << 20) - 1)] = True

    def score(self, text: bytes) -> float:
        found = features(text)
        found = np.unique(found[self.maybe[found & np.uint64((1 << 20) - 1)]])
        if not len(found) or not len(self.feature):
            return float(_sigmoid(self.bias))
        at = np.minimum(np.searchsorted(self.feature, found), len(self.feature) - 1)
        return float(_sigmoid(self.bias + self.weight[at][self.feature[at] == found].sum()))


def score_column(weights: Weights, text: Column, df: DataFrame) -> Column:
    """Probability of label 1 for a column of UTF-8 bytes; a text without features has that of the bias."""
    shared = df.sparkSession.sparkContext.broadcast(Scorer(weights))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return run(text)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """All rows and columns of ``docs`` with a ``score`` learned from ``labels(doc_id, label)``.

    Whole texts are scored; NULL and empty texts have the score of the bias. Without any label every score is 0.5.
    A column named ``score`` is replaced.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with passing(docs.sparkSession):
        weights = learn(labelled_sample(narrow, labels, sample_rows))
    return docs.withColumn("score", score_column(weights, as_bytes(text), docs))
