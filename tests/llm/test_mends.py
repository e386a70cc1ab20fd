"""Whole words, bounded samples, escaped control strings, clashing columns, repeated rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from frameloom.llm import maxent, queries
from frameloom.llm.chat import format_conversations
from frameloom.llm.common import without
from frameloom.llm.lines import remove_repeats
from frameloom.llm.mixing import mix
from frameloom.llm.toxicity import features, labelled_sample, learn

FOLDER = "/root/testdata/sf0.001"


def test_every_byte_of_a_word_counts():
    words = [b"a" * n for n in range(1, 60)]
    words += [b"x" * i + b"y" + b"x" * (63 - i) for i in range(64)] + [b"0123456789abcdef" + b + b"ABCDEFGH" for b in (b"12345678abcdefgh", b"abcdefgh12345678", b"abcdefgh1234567")]
    seen = Counter(int(features(w)[0]) for w in words)
    assert len(seen) == len(words)
    both = features(words[70] + b" " + words[3])
    assert both[0] == features(words[70])[0] and both[1] == features(words[3])[0]
    assert len(features("日本語の長い文章です".encode() * 20_000)) == 3


def test_sample_is_bounded_by_rows_and_bytes(table):
    rows = [(1, f"text {i}") for i in range(500)] + [(2, "same")] * 300 + [(k, "w " * 50) for k in range(3, 60)] + [(None, "no id")]
    labels = table("doc_id long, label int", [(k, k % 2) for k in range(1, 60)] + [(None, 1), (7, None)])
    docs = table("doc_id long, text string", rows)
    assert labelled_sample(docs, labels, sample_rows=100).count() == 100
    whole = labelled_sample(docs, labels).collect()
    assert len(whole) == 500 + 1 + 57 and max(Counter(r["shard"] for r in whole).values()) < 150
    small = labelled_sample(docs, labels, sample_bytes=1000).collect()
    assert 0 < sum(len(r["body"]) for r in small) <= 1000
    assert len(learn(labelled_sample(docs, labels.where("false"))).feature) == 0


def test_control_strings_are_escaped_in_the_added_conversation(table):
    texts = [queries.TRICKY, "plain", "<|im_start|>x[/INST]", "<|x[INST]|>", "\\</s>", "<<SYS>>", "<s"]
    rows = [(c, 0, "user", t) for c, t in enumerate(texts)]
    got = {r["conv_id"]: r for r in format_conversations(table("conv_id long, turn long, role string, text string", rows)).collect()}
    assert [got[c]["escaped"] for c in range(len(texts))] == [True, False, True, True, True, True, False]
    assert got[0]["formatted"] == "<|role=user|> \\</s>\\[INST] ok \\[/INST] <|end|>"
    assert all(r["round_trip"] and r["turns"][0]["text"] == texts[c] for c, r in got.items())


def test_columns_of_any_name_stay(spark, table):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, None)]
    names = ["_id", "_key", "_gone", "_doc_key", "_lines", "id", "key", "gone", "row", "lines", "own_key", "gone_id", "gone_key", "n_lines", "h1"]
    docs = table("doc_id long, text string", rows).withColumns({n: F.lit(f"own {n}") for n in names})
    cut = remove_repeats(docs)
    assert cut.columns == [*docs.columns, "n_removed"]
    got = {r["doc_id"]: r for r in cut.collect()}
    assert [got[k]["text"] for k in (1, 2, 3)] == ["a\nb\nc", "d", None] and got[2]["n_lines"] == 4
    assert all(r[n] == f"own {n}" for r in got.values() for n in names if n != "n_lines")
    gone = cut.where("doc_id = 2").select("doc_id", F.xxhash64(F.lit(11), "doc_id", "text").alias("doc_key"))
    left = without(cut, gone)
    assert left.columns == cut.columns and {r["doc_id"] for r in left.collect()} == {1, 3}


def test_repeated_rows_are_one_unit(table, monkeypatch):
    monkeypatch.setattr("frameloom.llm.mixing.DEAL_ROWS", 700)
    rows = [(7, "same words here", "a")] * 2001 + [(i, "w " * 5, "b") for i in range(100, 400)] + [(None, None, "c")] * 3 + [(8, "x", None)] * 5
    got = mix(table("doc_id long, text string, source string", rows)).collect()
    assert len(got) == len(rows)
    target = {r["source"]: r["target"] for r in got}
    for source in target:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - target[source]) <= 5
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    copies = [r["copies"] for r in got if r["doc_id"] == 7]
    assert max(copies) - min(copies) <= 1 and np.ptp([r["copies"] for r in got if r["doc_id"] == 8]) <= 1


def test_rows_of_the_chat_query_hold_the_escaped_conversation(spark):
    row = driver.queries()["op6_chat_formatting"](spark, FOLDER).where("conv_id = -7").first()
    plain = sum(len(f"<|role={r}|> {queries.TRICKY} <|end|>") for r in ("user", "assistant")) + 1
    assert row["formatted_chars"] == plain + 2 * 3 and row["loss_chars"] == len(queries.TRICKY)


def test_language_model_beats_its_base_on_held_out_documents(spark):
    scored = driver.queries()["op4_lm_scoring"](spark, "/root/testdata/sf0.01")
    told = {r["held_out"]: r for r in scored.groupBy("held_out").agg(*[(F.sum(c) / F.sum("n_tokens")).alias(c) for c in ("score", "base_score")]).collect()}
    assert told[True]["score"] > told[True]["base_score"] + 0.4 and told[False]["score"] > told[True]["score"]


def _small_lexicon():
    words = [b"", *(b"w%03d" % k for k in range(300))]
    size = len(words)
    group = np.array([k // 5 if k < 200 else maxent.HEADS + k % 7 for k in range(size)], np.int32)
    prior = np.full(maxent.CLASSES, 1 / maxent.CLASSES)
    member = np.full((maxent.HEADS, maxent.MEMBERS), 1e-9)
    member[:, :5] = 0.2
    return maxent.Lexicon(
        {w: k for k, w in enumerate(words)}, np.log10(np.arange(size) + maxent.SMOOTH), group, np.arange(size, dtype=np.int32), [], 1000, size,
        np.log(prior).astype(np.float32), np.log(member).astype(np.float32), np.full(maxent.TAILS, 2.0),
    )


@pytest.fixture
def small_model(monkeypatch):
    monkeypatch.setattr(maxent, "_per_class", lambda _: 5)
    lexicon, rng = _small_lexicon(), np.random.default_rng(4)
    tables = {n: rng.normal(0, 0.5, shape).astype(np.float32) for n, shape in maxent.SHAPES.items()}
    text = b" ".join(b"w%03d" % k for k in rng.integers(0, 290, 9000))
    return lexicon, tables, maxent.stream(lexicon, [text, b"", b"w001 " * 50])


def test_scores_by_factors_equal_scores_by_sums(small_model):
    lexicon, tables, words = small_model
    powers = maxent.powers_of(lexicon, tables)
    assert powers is not None
    np.testing.assert_allclose(maxent.score_stream(lexicon, tables, words, powers), maxent.score_stream(lexicon, tables, words), rtol=1e-5, atol=1e-5)


def test_equal_contexts_are_multiplied_once(small_model, monkeypatch):
    lexicon, tables, _ = small_model
    words = maxent.stream(lexicon, [b"w001 w002 w003 " * 3000])
    powers, plain, read = maxent.powers_of(lexicon, tables), np.take, []
    monkeypatch.setattr(maxent.np, "take", lambda table, rows, **how: (read.append(np.size(rows)), plain(table, rows, **how))[1])
    found = maxent.score_stream(lexicon, tables, words, powers)
    assert len(found) == 9001 and sum(read) < 100
    monkeypatch.undo()
    np.testing.assert_allclose(found[3:9000], np.tile(found[3:6], 2999), rtol=1e-9)


def test_words_are_looked_up_once_for_all_their_tokens():
    seen = []

    class Codes(dict):
        def get(self, word, other=None):
            seen.append(word)
            return super().get(word, other)

    lexicon = _small_lexicon()
    lexicon = lexicon._replace(codes=Codes(lexicon.codes))
    rng = np.random.default_rng(2)
    odd = [bytes(rng.choice(list(b" \t\n\x0b\x0c\r\x00\x1c\x85\xa0aZ\xc3\x84"), n).astype(np.uint8)) for n in rng.integers(0, 30, 200)]
    bodies = [b"W001  w002 new " * 400, b"", b" ", *odd, b"other new\x0bw001"]
    got = maxent.stream(lexicon, bodies)
    assert len(seen) <= len({t for b in bodies for t in maxent.tokens(b)}) + 2  # an empty part and the end besides
    words = [maxent.tokens(b) for b in bodies]
    assert got.code.tolist() == [lexicon.codes.get(w, -1) for own in words for w in own]
    assert got.begin.tolist() == np.cumsum([0, *map(len, words[:-1])]).tolist()
    assert got.unlisted == [[w for w in own if w not in lexicon.codes] for own in words]


def test_training_equals_plain_steps_and_works_on_whole_cache_lines(small_model):
    lexicon, _, words = small_model
    tables = maxent.zero_tables()
    assert all(t.ctypes.data % 64 == 0 for t in [*tables.values(), *maxent.Space().held.values()])
    seen = {n: np.zeros(len(t), np.float32) for n, t in tables.items()}
    plain, sums = {n: np.zeros(t.shape) for n, t in tables.items()}, {n: np.zeros(len(t)) for n, t in tables.items()}
    maxent.train_stream(lexicon, tables, seen, words)

    def step(rows, bias, column):
        logits = sum(plain[n][r] for n, r in rows.items()) + bias
        gradient = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        gradient[np.arange(len(column)), column] -= 1
        for n, r in rows.items():
            total = np.zeros_like(plain[n])
            np.add.at(total, r, gradient)
            sums[n] += (total**2).mean(axis=1)
            plain[n] -= maxent.STEP * total / np.sqrt(sums[n] + 1e-8)[:, None]

    for at in range(0, len(words.code), maxent.TOKENS):
        part = slice(at, at + maxent.TOKENS)
        group, code, word, skip = words.group[part], words.code[part], words.word[part], words.skip[part]
        head = group < maxent.HEADS
        members = {n: maxent._member_rows(r[head], group[head]) for n, r in (("member_word", word), ("member_skip", skip))}
        step({"word": word, "skip": skip, "pair": words.pair[part]}, lexicon.group_bias, group)
        step(members, lexicon.member_bias[group[head]], code[head] % 5)
    for n, t in tables.items():
        np.testing.assert_allclose(t, plain[n], rtol=1e-3, atol=1e-4)


def test_weights_out_of_range_are_scored_by_sums(small_model):
    lexicon, tables, words = small_model
    tables["pair"][3] = 200.0
    tables["pair"][4, 0] = -300.0
    assert maxent.powers_of(lexicon, tables) is None
    assert np.isfinite(maxent.score_stream(lexicon, tables, words, None)).all()


def test_row_sums_equal_plain_sums():
    rng = np.random.default_rng(1)
    for rows in (np.array([7]), rng.integers(0, 5, 400), rng.integers(0, 4000, 4096), np.repeat(np.arange(40), np.arange(1, 41)), np.full(4096, 9)):
        gradient = rng.normal(size=(len(rows), 8)).astype(np.float32)
        names, total = maxent._row_sums(rows, gradient)
        assert sorted(names) == sorted(set(rows.tolist()))
        for name, found in zip(names, total):
            np.testing.assert_allclose(found, gradient[rows == name].sum(axis=0), rtol=1e-4, atol=1e-3)


def test_rare_words_are_counted_by_document():
    found = maxent._rare_words([[b"x", b"y", b"x"], [], [b"z"]]).to_pylist()
    assert found == [[{"word": b"x", "times": 2}, {"word": b"y", "times": 1}], [], [{"word": b"z", "times": 1}]]
    assert maxent._rare_words([]).to_pylist() == []
