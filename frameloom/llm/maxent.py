"""A hashed maximum-entropy language model with class-factored softmax.

P(word | context) = P(class | context) P(word | class, context). Features of a context are the word before, the word
before that (a skip) and both together, hashed into rows of weights. The most frequent words have classes in which the
context decides; all other words, known or not, fall into ranges of the alphabet inside which their counts decide. So the
model has a fixed size, while every count comes from all training documents.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import as_bytes
from frameloom.operators.spread import settle

SMOOTH = 0.1
END = b""  # the end of a text; no word is empty
HEADS, MEMBERS = 64, 64  # classes of frequent words, and words in each
TAILS = 64  # ranges of all other words
CLASSES = HEADS + TAILS
LISTED = 1 << 17  # words whose counts are broadcast; all others meet their counts in a join
WORD_ROWS, PAIR_ROWS, MEMBER_ROWS = 1 << 13, 1 << 14, 1 << 15
ROUNDS = 2  # the training documents are dealt into so many parts, one for each round of parallel updates
STEP = 0.15
TOKENS = 4096  # tokens of a batch
CHUNK = 512  # tokens whose rows are worked on together, so that they stay in a core's own cache
SHORT_RUN = 16
HUGE_PAGE = 1 << 21
SAFE = 60.0  # powers of numbers up to here, and sums of them, stay inside single precision
BLOCK_ROWS = 1024  # rows of weights that travel together
MERGE_FAN_IN = 32
HELD_WORDS = 400_000  # different words that a task counts before it hands the counts on

SHAPES = {"word": (WORD_ROWS, CLASSES), "skip": (WORD_ROWS, CLASSES), "pair": (PAIR_ROWS, CLASSES), "member_word": (MEMBER_ROWS, MEMBERS), "member_skip": (MEMBER_ROWS, MEMBERS)}
Tables = dict[str, np.ndarray]


def tokens(text: bytes) -> list[bytes]:
    found = text.lower().split()
    found.append(END)
    return found


def count_tokens(docs: DataFrame) -> DataFrame:
    """``docs(body)`` -> ``(word, n)`` over all tokens; tasks hand on sums, never single tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter[bytes] = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                held.update(tokens(body))
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return docs.select("body").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon(NamedTuple):
    """Everything fixed before training. Codes below HEADS * MEMBERS are frequent words, in alphabetical classes."""

    codes: dict[bytes, int]
    log_count: np.ndarray  # log10(c + SMOOTH) by code
    group: np.ndarray  # class by code
    bucket: np.ndarray  # row of the word features by code
    edges: list[bytes]  # first words of the ranges after the first
    total: int
    kinds: int
    group_bias: np.ndarray
    member_bias: np.ndarray
    tail_norm: np.ndarray  # log10 of the smoothed mass of each range


def _buckets(words: list[bytes]) -> np.ndarray:
    half = WORD_ROWS // 2
    return half + (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(half)).astype(np.int64)


def _most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most LISTED words, from the most frequent down to where the next level of counts would not fit; descending.

    Levels are fixed steps of the logarithm, so the driver sees a few hundred sums and then the words it keeps.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["level"]: r["kinds"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("kinds")).collect()}
    room, lowest = LISTED, None
    for at in sorted(sizes, reverse=True):
        room -= sizes[at]
        if room < 0:
            break
        lowest = at
    if lowest is None:
        return []
    kept = counts.where(level >= lowest).select("word", "n").toArrow()
    found = zip(kept.column("word").to_pylist(), kept.column("n").to_pylist())
    return sorted(found, key=lambda x: (-x[1], x[0]))


def build_lexicon(counts: DataFrame) -> Lexicon:
    """From the settled counts: what the driver and the tasks hold is bounded by LISTED words."""
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    total, kinds = int(sums[0] or 0), int(sums[1])
    listed = _most_frequent(counts)
    frequent = sorted(listed[: HEADS * MEMBERS])
    rest = sorted(listed[HEADS * MEMBERS :])
    mass = np.cumsum([n for _, n in rest]) if rest else np.zeros(0)
    cuts = [int(np.searchsorted(mass, mass[-1] * k / TAILS)) for k in range(1, TAILS)] if rest else []
    edges = sorted({rest[c][0] for c in cuts})

    known = {w for w, _ in frequent}

    @F.pandas_udf("int")
    def place(words: pd.Series) -> pd.Series:
        return pd.Series([-1 if bytes(w) in known else bisect_right(edges, bytes(w)) for w in words], dtype="int32")

    by_range = {r["at"]: (r["n"], r["kinds"]) for r in counts.groupBy(place("word").alias("at")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    tails = np.array([by_range.get(k, (0, 0)) for k in range(TAILS)], np.float64)
    codes = {w: i for i, (w, _) in enumerate(frequent)} | {w: HEADS * MEMBERS + i for i, (w, _) in enumerate(rest)}
    size = HEADS * MEMBERS + len(rest)
    log_count, group, bucket = np.zeros(size), np.zeros(size, np.int32), np.zeros(size, np.int32)
    own = np.full((HEADS, MEMBERS), 1e-9)
    per_class = max(1, -(-len(frequent) // HEADS))
    for i, (_, n) in enumerate(frequent):
        log_count[i], group[i], bucket[i] = np.log10(n + SMOOTH), i // per_class, i
        own[i // per_class, i % per_class] = n
    for i, (w, n) in enumerate(rest, HEADS * MEMBERS):
        log_count[i], group[i] = np.log10(n + SMOOTH), HEADS + bisect_right(edges, w)
    bucket[HEADS * MEMBERS :] = _buckets([w for w, _ in rest])
    smoothed = tails[:, 0] + SMOOTH * (tails[:, 1] + 1)
    heads = np.where(own > 1e-9, own, 0).sum(axis=1)
    prior = np.concatenate([heads + 1e-3, np.where(np.arange(TAILS) <= len(edges), smoothed, 1e-3)])
    return Lexicon(
        codes, log_count, group, bucket, edges, total, kinds, np.log(prior / prior.sum()).astype(np.float32),
        np.log(own / own.sum(axis=1, keepdims=True)).astype(np.float32), np.log10(smoothed),
    )


class Stream(NamedTuple):
    """Tokens of some documents in a row, with the rows of their features."""

    code: np.ndarray  # -1: not listed
    group: np.ndarray
    word: np.ndarray
    skip: np.ndarray
    pair: np.ndarray
    begin: np.ndarray  # first token of each document
    unlisted: list[list[bytes]]  # by document


def _encoded(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The :func:`tokens` of all texts as places in their distinct words, the number of each text's tokens, and those words; END is last."""
    texts = pa.array(bodies, pa.binary()).view(pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.values.dictionary_encode()
    place = coded.indices.to_numpy()
    _, offsets, data = coded.dictionary.buffers()
    ends, held = np.frombuffer(offsets, np.int32)[: len(coded.dictionary) + 1], data.to_pybytes() if data else b""
    word = np.diff(ends)[place] > 0  # white space at the ends of a text leaves empty parts
    sizes = np.diff(np.append(0, np.cumsum(word))[split.offsets.to_numpy()]) + 1
    out = np.full(int(sizes.sum()), len(ends) - 1, np.int64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = place[word]
    cuts = ends.tolist()
    return out, sizes, [*(held[a:b] for a, b in zip(cuts, cuts[1:])), END]


def stream(lexicon: Lexicon, bodies: list[bytes]) -> Stream:
    """Each distinct word is looked up once; its tokens take over what was found."""
    place, sizes, words = _encoded(bodies)
    begin = np.cumsum(sizes) - sizes
    look = lexicon.codes.get
    codes = np.fromiter(map(look, words, repeat(-1)), np.int64, len(words))
    groups, buckets = lexicon.group[codes], lexicon.bucket[codes]
    missing = np.flatnonzero(codes < 0)
    rare = [words[at] for at in missing.tolist()]
    groups[missing] = HEADS + np.fromiter(map(bisect_right, repeat(lexicon.edges), rare), np.int64, len(rare))
    buckets[missing] = _buckets(rare)
    code, group, bucket = codes[place], groups[place], buckets[place]
    at = np.flatnonzero(code < 0)
    found, ends = [words[k] for k in place[at].tolist()], np.append(np.searchsorted(at, begin), len(at)).tolist()
    unlisted = [found[a:b] for a, b in zip(ends, ends[1:])]
    end = lexicon.bucket[look(END, 0)]
    first = np.zeros(len(code), bool)
    first[begin] = True
    word = np.where(first, end, np.roll(bucket, 1)).astype(np.int64)
    skip = np.where(first, end, np.roll(word, 1)).astype(np.int64)
    pair = ((word * 0x9E3779B1 + skip * 0x85EBCA77) >> 7) % PAIR_ROWS
    return Stream(code, group, word, skip, pair, begin, unlisted)


def _member_rows(bucket: np.ndarray, group: np.ndarray) -> np.ndarray:
    return ((bucket * 0xC2B2AE3D + group * 0x27D4EB2F) >> 5) % MEMBER_ROWS


def _powers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """``exp(x - top)`` in place of ``x``, its sum by row, and ``top``: zero where no power leaves the range, else each row's largest."""
    top = 0.0
    if len(x) and (x.max() > SAFE or x.min() < -SAFE):
        top = x.max(axis=1)
        x -= top[:, None]
    np.exp(x, out=x)
    return x, np.einsum("ij->i", x), top


def _room(shapes: dict[str, tuple[int, int]]) -> Tables:
    """Arrays in one block, so that it can have huge pages; rows of whole cache lines begin at one."""
    sizes = {name: rows * width for name, (rows, width) in shapes.items()}
    block = np.empty(4 * sum(sizes.values()) + HUGE_PAGE, np.uint8)
    begin = -block.ctypes.data % HUGE_PAGE
    flat = block[begin : begin + 4 * sum(sizes.values())].view(np.float32)
    ends = dict(zip(sizes, np.cumsum(list(sizes.values())).tolist()))
    return {name: flat[ends[name] - sizes[name] : ends[name]].reshape(shape) for name, shape in shapes.items()}


def zero_tables() -> Tables:
    tables = _room(SHAPES)
    for t in tables.values():
        t.fill(0)
    return tables


def _unpacked(sent: Tables) -> Tables:
    """Weights as they are worked on."""
    tables = _room(SHAPES)
    for name, t in sent.items():
        tables[name][:] = t
    return tables


def _summed(tables: Tables, rows: dict[str, np.ndarray], names: tuple[str, ...], bias: np.ndarray) -> np.ndarray:
    x = np.take(tables[names[0]], rows[names[0]], axis=0, mode="clip")  # the rows are in range; this mode copies without a check
    for name in names[1:]:
        x += np.take(tables[name], rows[name], axis=0, mode="clip")
    x += bias
    return x


def _batch(lexicon: Lexicon, tables: Tables, s: Stream, part: slice):
    """Logits of all classes, and of the members of the right class for frequent words."""
    rows = {"word": s.word[part], "skip": s.skip[part], "pair": s.pair[part]}
    classes = _summed(tables, rows, ("word", "skip", "pair"), lexicon.group_bias)
    group, code = s.group[part], s.code[part]
    head = np.flatnonzero(group < HEADS)
    rows["member_word"] = _member_rows(rows["word"][head], group[head])
    rows["member_skip"] = _member_rows(rows["skip"][head], group[head])
    members = _summed(tables, rows, ("member_word", "member_skip"), lexicon.member_bias[group[head]])
    return rows, classes, members, group, head, code


def _log_share(x: np.ndarray, column: np.ndarray) -> np.ndarray:
    """log10 of the softmax of each row at its column; ``x`` is used up."""
    own = x[np.arange(len(x)), column]
    _, total, top = _powers(x)
    return (own - top - np.log(total)).astype(np.float64) / np.log(10)


class Space:
    """Room for the rows of a batch, used again by the next: asking the system for fresh pages costs more than the sums."""

    def __init__(self) -> None:
        self.held = _room(dict.fromkeys(("sum", "term", "gradient", "total", "moved"), (TOKENS, CLASSES)))

    def __call__(self, use: str, rows: int, width: int) -> np.ndarray:
        return self.held[use].reshape(-1)[: rows * width].reshape(rows, width)

    def take(self, use: str, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The rows are in range; this mode copies without a check."""
        return np.take(table, rows, axis=0, mode="clip", out=self(use, len(rows), table.shape[1]))


def _gradient(tables: list[np.ndarray], rows: list[np.ndarray], bias: np.ndarray, column: np.ndarray, space: Space) -> np.ndarray:
    """Softmax of the sums of each token's rows and ``bias``, less one at its column."""
    out = space("gradient", len(column), tables[0].shape[1])
    for at in range(0, len(out), CHUNK):
        part = slice(at, at + CHUNK)
        x = space.take("sum", tables[0], rows[0][part])
        for table, row in zip(tables[1:], rows[1:]):
            x += space.take("term", table, row[part])
        x += bias if bias.ndim == 1 else bias[part]
        _, total, _ = _powers(x)
        np.einsum("ij,i->ij", x, 1 / total, out=out[part])
    out.reshape(-1)[np.arange(len(out)) * out.shape[1] + column] -= 1
    return out


class Powers(NamedTuple):
    """Weights as factors: the share of a class is a product of rows, without a power for each token."""

    tables: Tables  # the factors of the words hold those of the classes
    member: np.ndarray


def powers_of(lexicon: Lexicon, tables: Tables) -> Powers | None:
    """None where some product of factors could leave the range of single precision."""
    for names, bias in ((("word", "skip", "pair"), lexicon.group_bias), (("member_word", "member_skip"), lexicon.member_bias)):
        if sum(float(tables[n].max()) for n in names) + bias.max() > SAFE or sum(float(tables[n].min()) for n in names) + bias.min() < -SAFE:
            return None
    raised = _room(SHAPES)
    for n, t in tables.items():
        np.exp(t, out=raised[n])
    raised["word"] *= np.exp(lexicon.group_bias)
    return Powers(raised, np.exp(lexicon.member_bias))


def _log_products(tables: list[np.ndarray], rows: list[np.ndarray], column: np.ndarray) -> np.ndarray:
    """log10 of the share that the product of each token's rows, one of each table, has at its column.

    Tokens are worked on in the order of the first two rows; equal rows have one product and one sum.
    """
    if not len(column):
        return np.zeros(0)
    order = np.argsort(rows[1].astype(np.uint16), kind="stable")  # short integers are sorted by radix; every table has fewer rows
    order = order[np.argsort(rows[0][order].astype(np.uint16), kind="stable")]
    rows, column = [r[order] for r in rows], column[order]
    new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1]))
    first = np.flatnonzero(new)
    place = np.cumsum(new) - 1
    share = np.empty(len(order))
    for at in range(0, len(first), CHUNK):
        names = [r[first[at : at + CHUNK]] for r in rows]
        part = slice(first[at], first[at + CHUNK] if at + CHUNK < len(first) else len(order))
        x, y, third = (np.take(t, n, axis=0, mode="clip") for t, n in zip(tables, names))
        x *= y
        where = place[part] - at
        share[part] = x[where, column[part]].astype(np.float64) * third[where, column[part]] / np.einsum("ij,ij->i", x, third)[where]
    out = np.empty(len(order))
    out[order] = np.log10(share)
    return out


def _log_shares(lexicon: Lexicon, powers: Powers, s: Stream) -> np.ndarray:
    """log10 P(class) of every token, for the frequent ones P(class) P(word | class)."""
    tables = powers.tables
    out = _log_products([tables[n] for n in ("word", "skip", "pair")], [s.word, s.skip, s.pair], s.group)
    head = np.flatnonzero(s.group < HEADS)
    group = s.group[head]
    rows = [_member_rows(at[head], group) for at in (s.word, s.skip)]
    out[head] += _log_products([tables["member_word"], tables["member_skip"], powers.member], [*rows, group], s.code[head] % _per_class(lexicon))
    return out


def score_stream(lexicon: Lexicon, tables: Tables, s: Stream, powers: Powers | None = None) -> np.ndarray:
    """log10 P of every token; words that are not listed lack their count's part. ``powers`` of the tables spare work."""
    if powers:
        out = _log_shares(lexicon, powers, s)
    else:
        out, per_class = np.zeros(len(s.code)), _per_class(lexicon)
        for at in range(0, len(out), TOKENS):
            part = slice(at, min(at + TOKENS, len(out)))
            _, classes, members, group, head, code = _batch(lexicon, tables, s, part)
            own = _log_share(classes, group)
            own[head] += _log_share(members, code[head] % per_class)
            out[part] = own
    tail = np.flatnonzero(s.group >= HEADS)
    code = s.code[tail]
    out[tail] += np.where(code >= 0, lexicon.log_count[code], 0.0) - lexicon.tail_norm[s.group[tail] - HEADS]
    return out


def _per_class(lexicon: Lexicon) -> int:
    frequent = min(len(lexicon.codes), HEADS * MEMBERS)
    return max(1, -(-frequent // HEADS))


def _row_sums(row: np.ndarray, gradient: np.ndarray, space: Space | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a batch, most frequent first, and the sums of their gradients: long runs one by one, short ones side by side."""
    space = space or Space()
    order = np.argsort(row.astype(np.uint16), kind="stable")  # short integers are sorted by radix; every table has fewer rows
    sorted_rows = row[order]
    first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    size = np.diff(np.append(first, len(row)))
    by_size = np.argsort((len(row) - size).astype(np.uint16), kind="stable")
    first, size = first[by_size], size[by_size]
    total = space.take("total", gradient, order[first])
    longer = len(size) - np.searchsorted(size[::-1], np.arange(SHORT_RUN + 1), side="right")  # runs longer than so many
    many = int(longer[SHORT_RUN])
    for run in range(many):
        np.add.reduce(space.take("term", gradient, order[first[run] : first[run] + size[run]]), axis=0, out=total[run])
    for done in range(1, SHORT_RUN):
        end = int(longer[done])
        if end <= many:
            break
        total[many:end] += space.take("term", gradient, order[first[many:end] + done])
    return sorted_rows[first], total


def _descend(table: np.ndarray, seen: np.ndarray, row: np.ndarray, gradient: np.ndarray, space: Space) -> None:
    """One step for the rows of a batch, each at its own rate."""
    names, total = _row_sums(row, gradient, space)
    sums = seen[names] + np.einsum("ij,ij->i", total, total) / total.shape[1]
    seen[names] = sums
    moved = np.einsum("ij,i->ij", total, -STEP / np.sqrt(sums + 1e-8), out=space("moved", *total.shape))
    moved += space.take("term", table, names)
    table[names] = moved


def train_stream(lexicon: Lexicon, tables: Tables, seen: Tables, s: Stream) -> None:
    per_class, space = _per_class(lexicon), Space()

    def learn(rows: dict[str, np.ndarray], bias: np.ndarray, column: np.ndarray) -> None:
        gradient = _gradient([tables[name] for name in rows], list(rows.values()), bias, column, space)
        for name, row in rows.items():
            _descend(tables[name], seen[name], row, gradient, space)

    for at in range(0, len(s.code), TOKENS):
        part = slice(at, min(at + TOKENS, len(s.code)))
        word, skip, group = s.word[part], s.skip[part], s.group[part]
        learn({"word": word, "skip": skip, "pair": s.pair[part]}, lexicon.group_bias, group)
        head = np.flatnonzero(group < HEADS)
        if len(head):
            group = group[head]
            rows = {"member_word": _member_rows(word[head], group), "member_skip": _member_rows(skip[head], group)}
            learn(rows, lexicon.member_bias[group], s.code[part][head] % per_class)


def _packed(values: np.ndarray) -> bytes:
    """Half precision on the way: the moves of one round are small."""
    return np.clip(values, -6e4, 6e4).astype(np.float16).tobytes()


def _moves(table: np.ndarray, start: np.ndarray | None, seen: np.ndarray, at: int) -> dict[str, bytes] | None:
    """The rows of a block that a task moved: their numbers, weights and moves, these in steps of a 127th of the row's largest."""
    part = slice(at, at + BLOCK_ROWS)
    row = np.flatnonzero(seen[part])
    if not len(row):
        return None
    delta = table[part][row] if start is None else table[part][row] - start[part][row].astype(np.float32)
    step = np.abs(delta).max(axis=1) / 127
    values = np.rint(delta / np.maximum(step, 1e-12)[:, None]).astype(np.int8)
    weight = np.sqrt(seen[part][row])
    return {"rows": row.astype(np.int16).tobytes(), "weights": weight.astype(np.float32).tobytes(), "steps": step.astype(np.float32).tobytes(), "moves": values.tobytes()}


def _sum_of_moves(rows: pd.DataFrame) -> np.ndarray:
    """Per row of a block the weights and the weighted moves of all tasks, in the order of their content."""
    width = SHAPES[rows["name"].iloc[0]][1]
    total = np.zeros((BLOCK_ROWS, width + 1), np.float32)
    for r in rows.sort_values(["weights", "moves"]).itertuples():
        row, weight, step = np.frombuffer(r.rows, np.int16), np.frombuffer(r.weights, np.float32), np.frombuffer(r.steps, np.float32)
        total[row, 0] += weight
        total[row, 1:] += np.frombuffer(r.moves, np.int8).reshape(-1, width) * (step * weight)[:, None]
    return total


def _update(docs: DataFrame, lexicon: Broadcast, start: Broadcast | None) -> DataFrame:
    """One round: every task learns from its documents, beginning at the shared weights, and hands on the rows it moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = start.value if start else {}
        tables = _unpacked(begun) if begun else zero_tables()
        seen = {n: np.zeros(len(t), np.float32) for n, t in tables.items()}
        count = 0
        for batch in batches:
            bodies = batch.column(0).to_pylist()
            for group in _portions(bodies):
                s = stream(lexicon.value, group)
                train_stream(lexicon.value, tables, seen, s)
                count += len(s.code)
        part = TaskContext.get().partitionId() // MERGE_FAN_IN
        for name, table in tables.items() if count else ():
            for at in range(0, len(table), BLOCK_ROWS):
                moved = _moves(table, begun.get(name), seen[name], at)
                if moved:
                    yield pa.RecordBatch.from_pylist([{"name": name, "block": at, "part": part, **moved}], schema=sent)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        total = _sum_of_moves(rows) / MERGE_FAN_IN  # a mean needs no scale, and half precision has no room for sums
        return pd.DataFrame({"name": rows["name"].iloc[:1], "block": rows["block"].iloc[:1], "part": rows["part"].iloc[:1], "sums": [_packed(total)]})

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["sums"].iloc[0]) // 2, np.float32)
        for packed in sorted(rows["sums"]):
            total += np.frombuffer(packed, np.float16) / MERGE_FAN_IN
        return pd.DataFrame({"name": rows["name"].iloc[:1], "block": rows["block"].iloc[:1], "part": rows["part"].iloc[:1], "sums": [_packed(total)]})

    sent = pa.schema([("name", pa.string()), ("block", pa.int32()), ("part", pa.int32()), *[(n, pa.binary()) for n in ("rows", "weights", "steps", "moves")]])
    moves = docs.select("body").mapInArrow(run, "name string, block int, part int, rows binary, weights binary, steps binary, moves binary")
    schema = "name string, block int, part int, sums binary"
    first = moves.groupBy("name", "block", "part").applyInPandas(merged, schema)
    return first.groupBy("name", "block").applyInPandas(again, schema)


def _portions(bodies: list[bytes], most: int = 1 << 21) -> Iterator[list[bytes]]:
    held, size = [], 0
    for body in bodies:
        held.append(body)
        size += len(body)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(docs: DataFrame, lexicon: Broadcast, rounds: int = ROUNDS) -> Tables:
    """``docs(body, place)``: each round deals with its share of all documents, and rows move by the weighted mean of the tasks.

    The weights are sent out in half precision, not at all while they are zero, and taken back after the round.
    """
    spark = docs.sparkSession
    tables = zero_tables()
    for number in range(rounds):
        start = spark.sparkContext.broadcast(halves(tables)) if number else None
        share = docs.where(F.pmod("place", F.lit(rounds)) == number)
        tables = {n: t.astype(np.float16).astype(np.float32) for n, t in tables.items()}
        for row in _update(share, lexicon, start).collect():
            table = tables[row["name"]]
            block = table[row["block"] : row["block"] + BLOCK_ROWS]
            sums = np.frombuffer(row["sums"], np.float16).astype(np.float32).reshape(-1, table.shape[1] + 1)[: len(block)]
            block += sums[:, 1:] / np.maximum(sums[:, :1], 1e-6)
        if start:
            start.destroy()
    return tables


def halves(tables: Tables) -> Tables:
    return {n: np.clip(t, -6e4, 6e4).astype(np.float16) for n, t in tables.items()}


def _rare_words(unlisted: list[list[bytes]]) -> pa.ListArray:
    """The different words of each document and how often it has them."""
    counts = [Counter(words) for words in unlisted]
    words = pa.array([w for c in counts for w in c], pa.binary())
    times = pa.array([n for c in counts for n in c.values()], pa.int32())
    ends = np.cumsum([0, *map(len, counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words, times], ["word", "times"]))


def score_documents(docs: DataFrame, learns: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``learns`` marks the documents learned from; a NULL text is empty and has one token, its end. Rows that repeat an id
    are scored one by one. Without any training document every count is zero and the model is its prior.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("body"), learns.alias("learns"), F.xxhash64(F.lit(9), doc_id).alias("place"))
    taught = named.where("learns")
    counts = settle(count_tokens(taught), "counts")
    lexicon = spark.sparkContext.broadcast(build_lexicon(counts))
    total = lexicon.value.total
    weights = spark.sparkContext.broadcast(halves(train(taught, lexicon)))
    kind = named.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tables = lexicon.value, _unpacked(weights.value)
        powers = powers_of(known, tables)
        norm = np.log10(known.total + SMOOTH * (known.kinds + 1))
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for group in _portions(batch.column(1).to_pylist()):
                s = stream(known, group)
                model = np.add.reduceat(score_stream(known, tables, s, powers), s.begin)
                base = np.add.reduceat(np.where(s.code >= 0, known.log_count[s.code], 0.0) - norm, s.begin)
                sizes = np.diff(np.append(s.begin, len(s.code)))
                listed = np.add.reduceat((s.code >= 0).astype(np.int64), s.begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(number, number + len(group)), pa.int64()), batch.column(0).slice(at, len(group)),
                        pa.array(sizes), pa.array(listed), pa.array(base), pa.array(model),
                        _rare_words(s.unlisted),
                    ],
                    names=["row", "doc_id", "n_tokens", "listed", "base", "model", "rare"],
                )
                at, number = at + len(group), number + len(group)

    schema = f"row bigint, doc_id {kind}, n_tokens bigint, listed bigint, base double, model double, rare array<struct<word:binary,times:int>>"
    scored = settle(named.select("doc_id", "body").mapInArrow(run, schema), "scored")
    weights.destroy()
    lexicon.destroy()
    met = scored.select("row", F.inline("rare")).join(counts, "word", "left")
    found = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("met")
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare").join(found, "row", "left").select(
        "doc_id", "n_tokens", (F.col("listed") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
