"""Alignment of two tokenizers over a corpus: where their tokens end together, and which ids meet there.

A batch of texts is worked on as Arrow tables: token lists are flattened with the index of their text, byte ends are
running sums inside a text, and an Acero hash join on (text, end) finds the shared ends. Counts of id pairs are summed per
batch by ``Table.group_by`` and merged by Spark.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.operators.spread import settle

#: Fixed: how a byte-level vocabulary splits a text before it merges bytes.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"  # fixed: how the second vocabulary writes a space
BATCH_BYTES = 1 << 21  # texts worked on at once; one text is never split
LISTED = 1 << 17  # id pairs whose counts every task holds; all others meet their counts in a join
LEVELS = 8  # steps of counts in a factor of two, by which the listed pairs are chosen
PARTIAL = 1 << 20  # rows of partial counts merged at once in a task

DOC_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level(path: str):
    """``(encode, bytes by id)`` of a byte-level vocabulary file whose ids are in order of merging.

    Its special tokens are left out, so that their strings in a text are plain text.
    """
    import tiktoken

    letters = _byte_letters()
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    special = {t["content"] for t in told["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    by_id = {i: b for b, i in ranks.items()}
    encoding = tiktoken.Encoding("byte-level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, [by_id.get(i, b"") for i in range(max(by_id) + 1)]


@lru_cache(maxsize=2)
def piece_level(path: str):
    """``(encode, bytes by id)`` of a piece vocabulary file with byte fallback; it adds the space in front itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    as_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    return (lambda text: model.encode(text, num_threads=1)), as_bytes


class Side:
    """Token ids of several texts one after the other: the ids, the text of each, and the byte where each ends in its text."""

    def __init__(self, lists: list[list[int]], table: pa.Array, lengths: np.ndarray):
        tokens = pa.array(lists, pa.list_(pa.int32()))
        self.ids = pc.list_flatten(tokens).to_numpy()
        self.text = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
        self.counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
        running = np.concatenate([[0], np.cumsum(lengths[self.ids])])
        first = np.cumsum(self.counts) - self.counts
        before = running[first]  # bytes of all texts before this one
        self.ends = running[1:] - before[self.text]
        joined = table.take(pa.array(self.ids))
        self.joined, self.spans = joined.buffers()[2], np.append(before, running[-1])

    def bytes_of(self, i: int) -> bytes:
        return self.joined[int(self.spans[i]) : int(self.spans[i + 1])].to_pybytes() if self.spans[i] < self.spans[i + 1] else b""

    def keep(self, kept: np.ndarray) -> None:
        """Leave texts that are not ``kept`` without tokens."""
        stay = kept[self.text]
        self.ids, self.text, self.ends = self.ids[stay], self.text[stay], self.ends[stay]
        self.counts = np.where(kept, self.counts, 0)

    def table(self, name: str) -> pa.Table:
        return pa.table({"text": self.text, "end": self.ends, name: self.ids, f"{name}_at": np.arange(len(self.ids))})


class Aligner:
    """Both vocabularies with their tables of bytes and rendered ids, made once in a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.encode_a, bytes_a = byte_level(path_a)
        self.encode_b, bytes_b = piece_level(path_b)
        self.size_b = len(bytes_b)
        self.table_a, self.table_b = pa.array(bytes_a, pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        self.len_a, self.len_b = (np.array([len(t) for t in side], np.int64) for side in (bytes_a, bytes_b))
        shown = [b"%d%s" % (i, mark) for mark, size in ((b",", len(bytes_a)), (b"|", len(bytes_a)), (b",", len(bytes_b)), (b";", len(bytes_b))) for i in range(size)]
        self.shown, self.shown_len = pa.array(shown, pa.large_binary()), np.array([len(t) for t in shown], np.int64)

    def align(self, texts: list[str | None]) -> tuple[pa.Table, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Links ``(text, a, b)`` of a batch, the digest of each text's groups, and its numbers of tokens and of groups."""
        lists = [(self.encode_a(" " + t), self.encode_b(t)) if t else ([], []) for t in texts]
        a = Side([x for x, _ in lists], self.table_a, self.len_a)
        b = Side([y for _, y in lists], self.table_b, self.len_b)
        whole = [(" " + t).encode() if t else b"" for t in texts]
        kept = np.array([bool(w) and a.bytes_of(i) == w and b.bytes_of(i) == w for i, w in enumerate(whole)], bool)
        a.keep(kept), b.keep(kept)
        links = a.table("a").join(b.table("b"), ["text", "end"], join_type="inner", use_threads=False)
        digests, n_groups = self._groups(a, b, links, len(texts))
        return links, digests, a.counts, b.counts, n_groups

    def _groups(self, a: Side, b: Side, links: pa.Table, n: int) -> tuple[list[str], np.ndarray]:
        """Groups are cut after every shared end; ids, commas and marks are laid out by their place and hashed per text."""
        cut = links.group_by(["text", "end"], use_threads=False).aggregate([("a_at", "max"), ("b_at", "max")])
        last_a, last_b = np.sort(cut["a_at_max"].to_numpy()), np.sort(cut["b_at_max"].to_numpy())
        n_groups = np.bincount(cut["text"].to_numpy(), minlength=n)
        through_a, through_b = last_a + 1, last_b + 1  # tokens up to the end of each group
        group_a = np.repeat(np.arange(len(last_a)), np.diff(through_a, prepend=0))
        group_b = np.repeat(np.arange(len(last_b)), np.diff(through_b, prepend=0))
        size_a = len(self.table_a)
        marks = np.empty(len(a.ids) + len(b.ids), np.int64)
        ends_a, ends_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
        ends_a[last_a], ends_b[last_b] = True, True
        marks[np.arange(len(a.ids)) + np.concatenate([[0], through_b])[group_a]] = a.ids + size_a * ends_a
        marks[np.arange(len(b.ids)) + through_a[group_b]] = 2 * size_a + b.ids + self.size_b * ends_b
        laid = self.shown.take(pa.array(marks)).buffers()[2]
        running = np.concatenate([[0], np.cumsum(self.shown_len[marks])])
        stops = running[np.cumsum(a.counts + b.counts)]
        starts = running[np.cumsum(a.counts + b.counts) - a.counts - b.counts]
        told = ["" if s == e else hashlib.sha256(laid[int(s) : int(e) - 1]).hexdigest() for s, e in zip(starts, stops)]
        return told, n_groups

    def rows(self, rows: list[int], ids: list, texts: list) -> pa.RecordBatch:
        links, digests, n_a, n_b, n_groups = self.align(texts)
        n = len(texts)
        code = pc.add(pc.multiply(links["a"].cast(pa.int64()), self.size_b), links["b"].cast(pa.int64()))
        counted = pa.table({"text": links["text"], "code": code}).group_by(["text", "code"], use_threads=False).aggregate([([], "count_all")])
        counted = counted.sort_by([("text", "ascending"), ("code", "ascending")])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(counted["text"].to_numpy(), minlength=n))]).astype(np.int32)
        listed = lambda name: pa.ListArray.from_arrays(pa.array(offsets), counted[name].combine_chunks())
        n_links = np.bincount(links["text"].to_numpy(), minlength=n)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)],
             pa.array(digests, pa.string()), listed("code"), listed("count_all")],
            names=[f.strip().split()[0] for f in DOC_SCHEMA.split(", ")],
        )


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of up to ``BATCH_BYTES`` each, one row at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > BATCH_BYTES:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _encoder(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(path_a, path_b)
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()
            for start, stop in _slices(sizes):
                part = batch.slice(start, stop - start)
                yield aligner.rows(part["row"].to_pylist(), part["doc_id"].to_pylist(), part["text"].to_pylist())

    return run


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per id pair; a task holds up to ``PARTIAL`` rows beyond its distinct pairs, and hands them on when these are many."""
    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("code", use_threads=False).aggregate([("n", "sum")]).rename_columns(["code", "n"])

    held, rows = [], 0
    for batch in batches:
        held.append(pa.table({"code": pc.list_flatten(batch["codes"]), "n": pc.list_flatten(batch["times"])}))
        rows += len(held[-1])
        if rows > PARTIAL:
            held = [merged(held)]
            rows = len(held[0])
            if rows > PARTIAL // 2:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from merged(held).to_batches()


def pair_counts(encoded: DataFrame, size_b: int) -> DataFrame:
    """``(code, n, best)`` of every id pair that is linked: its links in the corpus, and whether no pair with its B id has more.

    The window of a B id holds at most one row for each A id, however large the corpus.
    """
    summed = encoded.select("codes", "times").mapInArrow(_partial_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("code") % size_b)
    return summed.withColumn("best", F.col("n") == F.max("n").over(of_b))


def _listed(counts: DataFrame, most: int) -> tuple[pd.DataFrame, float]:
    """At most ``most`` pairs, those of the highest counts, chosen by levels; also the level that they exceed.

    The levels are at most ``64 * LEVELS`` rows on the driver.
    """
    level = F.floor(F.log2("n") * LEVELS)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, held = float("inf"), 0
    for at, size in sizes:
        if held + size > most:
            break
        least, held = at, held + size
    frame = counts.where(level >= F.lit(least)).toPandas() if held else pd.DataFrame({"code": [], "n": [], "best": []}).astype({"code": "int64", "n": "int64", "best": bool})
    return frame.sort_values("code"), least


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = shared.value
        for batch in batches:
            of, times = pc.list_flatten(batch["codes"]).to_numpy(), pc.list_flatten(batch["times"]).to_numpy()
            text = pc.list_parent_indices(batch["codes"]).to_numpy()
            at = np.minimum(np.searchsorted(codes, of), max(len(codes) - 1, 0))
            found = codes[at] == of if len(codes) else np.zeros(len(of), bool)
            best_sum, count_sum = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(count_sum, text[found], times[found] * n[at[found]])
            np.add.at(best_sum, text[found], times[found] * best[at[found]])
            rest = np.concatenate([[0], np.cumsum(np.bincount(text[~found], minlength=len(batch)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~found])) for x in (of, times)]
            told = [batch[c] for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "codes", "times"]
            yield pa.RecordBatch.from_arrays([*told, pa.array(best_sum), pa.array(count_sum), *lists], names=names)

    return run


def encode_texts(docs: DataFrame, paths: tuple[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its token and group counts, the digest of its groups and its links as id pairs with their
    numbers; written to the shared folder, so that no text is encoded twice.
    """
    path_a, path_b = paths or default_paths()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return settle(rows.mapInArrow(_encoder(path_a, path_b), DOC_SCHEMA), "encoded")


def align_tokenizers(
    docs: DataFrame, paths: tuple[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", listed: int = LISTED
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per row of ``docs``.

    Each text is encoded with a space in front by a byte-level vocabulary (A) and a piece vocabulary (B), whole and without
    special tokens. A link is a pair of an A and a B token that end at the same byte. ``n_best`` counts a row's links whose
    id pair has as many links in the corpus as any pair with its B id (ties included), ``count_sum`` adds up the counts of
    its links' pairs. ``groups_sha256`` digests the runs of ids between shared ends.

    A NULL or empty text, and one that either vocabulary does not give back byte by byte (such as one with U+2581), has no
    tokens: zeros and an empty digest. Repeated rows and rows that share a doc_id are rows of their own, and a NULL doc_id
    stays NULL. An empty table gives an empty table; other columns of ``docs`` are not read.

    Each text is encoded once. The counts of at most ``listed`` pairs are sent to every task; links of other pairs meet
    their exact counts in a join on the pair, so the listing changes no result.
    """
    paths = paths or default_paths()
    encoded = encode_texts(docs, paths, doc_id, text)
    size_b = len(piece_level(paths[1])[1])
    counts = settle(pair_counts(encoded, size_b), "pair-counts")
    frame, level = _listed(counts, listed)
    shared = docs.sparkSession.sparkContext.broadcast((frame["code"].to_numpy(), frame["n"].to_numpy(), frame["best"].to_numpy(dtype=np.int64)))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, codes array<long>, times array<long>"
    scored = encoded.mapInArrow(_scorer(shared), schema)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    unlisted = counts.where(F.floor(F.log2("n") * LEVELS) < F.lit(level))
    if unlisted.isEmpty():
        return scored.select(*out)
    scored = settle(scored, "scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("codes", "times")).alias("pair")).select("row", F.col("pair.codes").alias("code"), F.col("pair.times").alias("times"))
    rest = pairs.join(unlisted, "code").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")
    )
    whole = scored.drop("codes", "times").join(rest, "row", "left")
    return whole.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn(
        "count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0))
    ).select(*out)
