"""Benchmark passages in training text, found over a positional inverted index of the training tokens.

The index is a stored table of shards. A shard holds a bounded run of whole documents and, for every test term, the
ascending positions at which it occurs there. A search reads each shard once and intersects offset-adjusted lists,
beginning with the term that is rarest in the shard. Documents never move: there is no shuffle by term.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import as_bytes, document_key, only
from frameloom.operators.spread import settle

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 4 << 20  # test text that is searched for in one pass over the index

# Fixed: ASCII characters that are no part of a word become blanks, A-Z become a-z; every other character is kept.
_FOLD = bytes(
    (b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32
    for b in range(256)
)


def folded(text: bytes) -> bytes:
    return text.translate(_FOLD)


def words(text: bytes) -> list[bytes]:
    return folded(text).split()


class Phrases(NamedTuple):
    """What one pass looks for: terms by number and the distinct windows with the items they come from."""

    terms: dict[bytes, int]
    windows: list[tuple[int, ...]]
    items: list[list[str]]
    reach: int  # words by which neighbouring documents are kept apart


def phrases(items: list[tuple[str, bytes]], window: int = WINDOW, slop: int = 0) -> Phrases:
    """Windows of the given items; an item shorter than a window is one window, one without words has none."""
    terms: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for name, text in items:
        ids = [terms.setdefault(w, len(terms)) for w in words(text)]
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            owners[tuple(ids[at : at + window])].add(name)
    ordered = sorted(owners)
    return Phrases(terms, ordered, [sorted(owners[w]) for w in ordered], max(map(len, ordered), default=1) + slop)


INDEX = (
    "shard bigint, doc_id {id}, doc_key array<bigint>, base array<bigint>, n_words array<bigint>, "
    "term array<int>, first array<int>, position array<int>"
)


def build_index(docs: DataFrame, wanted: Broadcast, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Postings of the wanted terms in ``docs(doc_id, text)``, one row per shard of at least ``shard_words`` words.

    Whole documents only: a document longer than a shard is a shard. Positions count all words, with a gap between
    documents that no match can span. NULL texts and texts without words are listed with no words.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = INDEX.format(id=f"array<{id_type}>")
    prepared = docs.select("doc_id", document_key("doc_id", "text").alias("doc_key"), as_bytes("text").alias("body"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, gap = wanted.value.terms.get, wanted.value.reach
        number = TaskContext.get().partitionId() << 32
        ids, keys, bases, sizes, tokens, end = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            stream = np.concatenate(tokens, axis=1)
            order = np.argsort(stream[0], kind="stable")
            term, first = np.unique(stream[0][order], return_index=True)
            columns = [
                [number], [ids], [keys], [bases], [sizes], [term.astype(np.int32)],
                [np.append(first, len(order)).astype(np.int32)], [stream[1][order].astype(np.int32)],
            ]
            names = [part.strip().split(" ")[0] for part in INDEX.split(",")]
            types = [pa.int64(), None, *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.int32())] * 3]
            made = [pa.array(c, t) if t else pa.array(c, pa.list_(batch.schema.field(0).type)) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            for doc_id, key, body in zip(*(c.to_pylist() for c in batch.columns)):
                found = [look(w, -1) for w in words(body)]
                here = np.array(found, np.int64)
                at = np.flatnonzero(here >= 0)
                tokens.append(np.stack([here[at], at + end]))
                ids.append(doc_id), keys.append(key), bases.append(end), sizes.append(len(found))
                end += len(found) + gap
                if end >= shard_words:
                    yield flush()
                    ids, keys, bases, sizes, tokens, end, number = [], [], [], [], [], 0, number + 1
        if ids:
            yield flush()

    return prepared.mapInArrow(shards, schema)


class Shard:
    """One shard of the index, in memory."""

    def __init__(self, n_terms: int, term: np.ndarray, first: np.ndarray, position: np.ndarray):
        self.start, self.stop = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        self.start[term], self.stop[term] = first[:-1], first[1:]
        self.count, self.position = self.stop - self.start, position

    def postings(self, term: int) -> np.ndarray:
        return self.position[self.start[term] : self.stop[term]]

    def exact(self, window: tuple[int, ...]) -> np.ndarray:
        """Where the phrase begins: the rarest term's list, moved back by its offset, cut by the others in turn."""
        order = sorted(range(len(window)), key=lambda k: self.count[window[k]])
        found = self.postings(window[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            found = found[_member(found + k, self.postings(window[k]))]
        return found

    def near(self, window: tuple[int, ...], reach: int) -> np.ndarray:
        """Occurrences of the rarest term that have every other term within ``reach`` words on either side."""
        order = sorted(set(window), key=lambda t: (self.count[t], window.index(t)))
        found = self.postings(order[0])
        for term in order[1:]:
            if not len(found):
                break
            other = self.postings(term)
            after = np.searchsorted(other, found - reach)
            found = found[(after < len(other)) & (other[np.minimum(after, len(other) - 1)] <= found + reach)]
        return found


def _member(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_list, values), len(sorted_list) - 1)
    return sorted_list[at] == values


FOUND = "doc_id {id}, doc_key bigint, n_words bigint, spans array<struct<begin:bigint,stop:bigint>>, items array<string>, near_items array<string>"


def search(index: DataFrame, wanted: Broadcast, slop: int | None = None) -> DataFrame:
    """One row per document of the index: merged spans of exact matches, the items matched, items only near by.

    With ``slop``, an item is near by if some window of it has all its terms within ``slop`` words more than its own
    length around an occurrence of its rarest term.
    """
    id_type = index.schema["doc_id"].dataType.elementType.simpleString()
    schema = FOUND.format(id=id_type)
    span = pa.struct([("begin", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Phrases = wanted.value
        lengths = [len(w) for w in plan.windows]
        padded = np.array([w + (w[0],) * (max(lengths) - len(w)) for w in plan.windows], np.int64) if lengths else np.zeros((0, 1), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {n: batch.column(n)[row].values for n in batch.schema.names if n != "shard"}
                base, sizes = cell["base"].to_numpy(), cell["n_words"].to_numpy()
                shard = Shard(len(plan.terms), *(cell[n].to_numpy() for n in ("term", "first", "position")))
                spans: dict[int, list] = defaultdict(list)
                items: dict[int, set] = defaultdict(set)
                near: dict[int, set] = defaultdict(set)
                for w in np.flatnonzero(shard.count[padded].min(axis=1) > 0) if len(padded) else ():
                    begin = shard.exact(plan.windows[w])
                    for doc, at in zip((np.searchsorted(base, begin, side="right") - 1).tolist(), begin.tolist()):
                        spans[doc].append((at - int(base[doc]), at - int(base[doc]) + lengths[w]))
                        items[doc].update(plan.items[w])
                    if slop is not None:
                        by = shard.near(plan.windows[w], lengths[w] - 1 + slop)
                        for doc in np.unique(np.searchsorted(base, by, side="right") - 1).tolist():
                            near[doc].update(plan.items[w])
                count = len(base)
                columns = [
                    cell["doc_id"], cell["doc_key"], cell["n_words"],
                    pa.array([_merged(spans.get(d, ())) for d in range(count)], pa.list_(span)),
                    pa.array([sorted(items.get(d, ())) for d in range(count)], pa.list_(pa.string())),
                    pa.array([sorted(near.get(d, set()) - items.get(d, set())) for d in range(count)], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc_key", "n_words", "spans", "items", "near_items"])

    return index.mapInArrow(run, schema)


def _merged(spans) -> list[dict]:
    out: list[dict] = []
    for begin, stop in sorted(spans):
        if out and begin <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], stop)
        else:
            out.append({"begin": begin, "stop": stop})
    return out


def matches(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, slop: int | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact phrase (and with ``slop`` proximity) matches of all items in all documents, one row per document row.

    Items are measured first and searched for in blocks of about ``block_bytes``: a block is what is broadcast, and
    each takes one pass over the documents. NULL texts have no words; a NULL item_id is reported as ``null``; items
    that share an id count as one; repeated document rows each get their row.
    """
    spark = docs.sparkSession
    tests = only(items, item_id, item_text).select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"), as_bytes(item_text).alias("body")
    )
    total = tests.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("name", "body"), F.lit(blocks))
    narrow = only(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = None
    for number in range(blocks):
        listed = [(r["name"], bytes(r["body"])) for r in tests.where(block == number).toLocalIterator()]
        wanted = spark.sparkContext.broadcast(phrases(listed, window, slop or 0))
        part = search(settle(build_index(narrow, wanted), "postings"), wanted, slop)
        found = part if found is None else found.unionByName(part)
    if blocks == 1:
        return found
    merged = found.groupBy("doc_id", "doc_key").agg(
        F.count("*").alias("rows"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("maybe"),
    )
    joined = F.aggregate(
        "all", F.array().cast("array<struct<begin:bigint,stop:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["begin"] <= F.element_at(done, -1)["stop"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["begin"].alias("begin"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    copies = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / blocks).cast("int"))))
    return copies.select("doc_id", "doc_key", "n_words", joined.alias("spans"), "items", F.array_except("maybe", "items").alias("near_items"))


def contamination(found: DataFrame) -> DataFrame:
    """Counts per document from :func:`matches`."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["begin"])
    return found.select(
        "doc_id", "doc_key", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
