"""Corpus operators against brute force, on small tables with NULLs, ties, repeats, empty and long texts, odd columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from frameloom.llm import maxent
from frameloom.llm.chat import format_conversations
from frameloom.llm.components import components
from frameloom.llm.decontaminate import contamination, matches, words
from frameloom.llm.lines import remove_repeats
from frameloom.llm.mixing import mix, source_targets
from frameloom.llm.rules import base_failed, judge, text_statistics
from frameloom.llm.simhash import PAIR_BUCKET, close_links, fingerprint, near_duplicates
from frameloom.llm.toxicity import score_toxicity
from frameloom.llm.warc import archive_pages, page_records, read_archives
from frameloom.llm.wrapper import align, expression, extract, main_text, observe, rules

NO_RULES = {"inside": "", "template": []}


def some_words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture
def docs(table):
    """NULLs in any column, empty and blank texts, a long text, a repeated row, a repeated id, clashing extra columns."""
    rng = random.Random(3)
    long = some_words(rng, 30_000)
    rows = [
        (1, "one two three\nfour five\nsix seven\nend", "a", 7), (2, "start\none two three\nfour five\nsix seven", "b", 7),
        (3, None, "a", None), (None, "one two three\nfour five\nsix seven", None, 7), (5, "", "a", 7), (6, " \n\t\n", "b", 7),
        (7, long, "a", 7), (8, long + " more", "b", 7), (9, "x\nx\nx\nx\nx", None, 7), (10, "same row", "a", 7), (10, "same row", "a", 7),
        (10, "same id, other text", "a", 7), (11, "Été ÉTÉ A-Z", "c", 7),
    ]
    return table("doc_id long, text string, source string, fp long", rows).withColumns({"doc_key": F.lit("x"), "hi": F.lit(1), "word": F.lit("w"), "line": F.lit(0), "n": F.lit(1)})


@pytest.fixture
def nothing(docs):
    return docs.where("false")


# SimHash -------------------------------------------------------------------------------------------------------------


def slow_print(text):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force(docs):
    for text in ["", " ", "a", "a b", "A b C d", "é É x y\x0bz", "r r r r r r r"]:
        assert fingerprint(text.encode()) == slow_print(text)
    got = {(r["doc_id"], r["doc_key"]): r["fp"] for r in near_duplicates(docs).collect()}
    assert len(got) == docs.distinct().count()


def slow_groups(values, distance=2):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_links_connect_like_brute_force_also_in_crowded_blocks(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    crowd = {centre ^ (1 << a) ^ (1 << b) for a in range(0, 16) for b in range(16)}
    assert len(crowd) > PAIR_BUCKET
    loose = {rng.getrandbits(64) for _ in range(150)}
    chain = {centre ^ sum(1 << k for k in range(20, 20 + 2 * i)) for i in range(9)}
    values = crowd | loose | chain | {0, 1, 1 << 63, (1 << 64) - 1}
    links = close_links(spark.createDataFrame([(signed(v),) for v in values], "fp long"))
    assert all(bin((r["a"] ^ r["b"]) & ((1 << 64) - 1)).count("1") <= 2 for r in links.collect())
    got = {r["node"]: r["root"] for r in components(links).collect()}
    parts = {}
    for v, r in slow_groups(values).items():
        parts.setdefault(r, set()).add(v)
    for part in parts.values():
        assert {got.get(signed(v), signed(v)) for v in part} == {min(map(signed, part))}


def test_components_ignore_self_links_nulls_and_order(table):
    links = table("a long, b long", [(1, 2), (3, 2), (3, 3), (9, 8), (None, 4), (8, 9), (20, 21), (22, 21), (22, 23), (24, 23)])
    assert {r["node"]: r["root"] for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{k: 20 for k in range(20, 25)}}
    assert components(links.where("false")).count() == 0


def test_groups_of_documents(docs, nothing):
    got = near_duplicates(docs)
    rows = {(r["doc_id"], r["fp"]): r for r in got.collect()}
    assert got.count() == docs.count()
    empty = [r for r in rows.values() if r["fp"] == 0]
    assert {r["doc_id"] for r in empty} == {3, 5, 6} and {r["component_id"] for r in empty} == {3}
    long = [r for r in rows.values() if r["doc_id"] in (7, 8)]
    assert {r["component_id"] for r in long} == {7} and [r["doc_id"] for r in long if r["stays"]] == [7]
    assert near_duplicates(nothing).count() == 0


# Line windows --------------------------------------------------------------------------------------------------------


def slow_lines(rows):
    seen, gone = {}, {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        filled = [i for i, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line)]
        for spot in zip(filled, filled[1:], filled[2:]):
            window = tuple(lines[i] for i in spot)
            if seen.setdefault(window, (key, spot[0])) != (key, spot[0]):
                gone.setdefault(key, set()).update(spot)
    return {key: None if text is None else "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone.get(key, ())) for key, text in rows}


def test_line_windows_match_brute_force(table, docs, nothing):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(100, "q\nw\ne\nr"), (101, "z\nq\nw\ne\ny"), (102, "w\ne\nr"), (103, None), (104, "\n".join("k" * 5))]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(table("doc_id long, text string", rows)).collect()}
    assert got == slow_lines(rows)
    cut = remove_repeats(docs)
    assert cut.count() == docs.count() and set(docs.columns) <= set(cut.columns)
    texts = {r["doc_id"]: (r["text"], r["n_removed"]) for r in cut.collect()}
    assert texts[None] == ("", 3) and texts[2] == ("start", 3) and texts[9] == ("x", 4) and texts[3] == (None, 0)
    assert remove_repeats(nothing).count() == 0


# Decontamination -----------------------------------------------------------------------------------------------------


def slow_hits(text, items, window=10):
    found = words((text or "").encode())
    hit, ids = set(), set()
    for name, item in items:
        own = words((item or "").encode())
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for j in range(len(found) - n + 1):
                if found[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    ids.add(name)
    return len(found), len(hit), ids


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_matches_brute_force(table, docs, nothing, block_bytes):
    rng = random.Random(4)
    passage = some_words(rng, 25, 30)
    items = [("1", passage), ("2", "w1, W2; w3!"), ("3", None), ("4", "..."), ("5", some_words(rng, 12, 4)), ("10", passage.upper()), ("null", "w5 w5")]
    rows = [(i, some_words(rng, 60, 12) + " - " + passage[i : i + 120] + some_words(rng, 5, 4)) for i in range(25)]
    rows += [(50, None), (51, ""), (52, "w1 w2 w3 w1 w2 w3"), (53, passage + passage), (54, passage), (54, passage)]
    source = table("doc_id long, text string", rows)
    tests = table("item_id string, text string", [(None if n == "null" else n, t) for n, t in items])
    got = contamination(matches(source, tests, block_bytes=block_bytes)).collect()
    assert len(got) == len(rows)
    want = {key: slow_hits(text, items) for key, text in rows}
    for r in got:
        n, hit, ids = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(ids), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    assert contamination(matches(docs, tests, block_bytes=block_bytes)).count() == docs.count()
    assert matches(nothing, tests).count() == 0
    assert {r["n_hit"] for r in contamination(matches(docs, tests.where("false"))).collect()} == {0}


def test_proximity_finds_scattered_terms(table):
    source = table("doc_id long, text string", [(1, "red x blue y green"), (2, "red blue green"), (3, "red " + "x " * 40 + "blue green"), (4, "red"), (5, "blue green")])
    found = matches(source, table("item_id long, text string", [(1, "red blue green")]), slop=3).collect()
    assert {r["doc_id"]: (r["items"], r["near_items"]) for r in found} == {1: ([], ["1"]), 2: (["1"], []), 3: ([], []), 4: ([], []), 5: ([], [])}


# Toxicity ------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_scores_every_row(spark, table, docs, nothing):
    rng = random.Random(2)
    rows = [(i, some_words(rng, 40) + (" vile beast " if i % 5 == 0 else " ") + some_words(rng, 40)) for i in range(800)]
    labels = table("doc_id long, label int", [(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (3, None), (5, 0)])
    scored = score_toxicity(table("doc_id long, text string", rows), labels).collect()
    held = [(r["score"] >= 0.3, r["doc_id"] % 5 == 0) for r in scored if r["doc_id"] >= 600]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    odd = score_toxicity(docs, labels)
    assert odd.count() == docs.count() and all(0 <= r["score"] <= 1 for r in odd.collect())
    assert {r["score"] for r in score_toxicity(docs, labels.where("false")).collect()} == {0.5}
    assert score_toxicity(nothing, labels).count() == 0


# Language model ------------------------------------------------------------------------------------------------------


def test_language_model_scores(table, docs, nothing, monkeypatch):
    rng = random.Random(6)
    follow = {w: [rng.randrange(60) for _ in range(3)] for w in range(60)}

    def text(n):
        out = [rng.randrange(60)]
        for _ in range(n):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(f"W{w}" for w in out) + (f" rare{rng.randrange(500)}" if rng.random() < 0.5 else "")

    rows = [(i, text(120)) for i in range(400)] + [(900, None), (901, ""), (902, "unseen words only")]
    monkeypatch.setattr(maxent, "LISTED", 100)  # most rare words then meet their counts in the join
    source = table("doc_id long, text string", rows)
    got = maxent.score_documents(source, F.col("doc_id") % 10 != 0).collect()
    counts = Counter(t for i, body in rows if i % 10 for t in maxent.tokens((body or "").encode()))
    total, kinds = sum(counts.values()), len(counts)
    for r in got:
        own = maxent.tokens((dict(rows)[r["doc_id"]] or "").encode())
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
    assert len(got) == len(rows) and all(r["score"] < 0 for r in got)
    assert maxent.score_documents(docs, F.lit(True)).count() == docs.count()
    assert {r["n_known"] for r in maxent.score_documents(docs, F.lit(False)).collect()} == {0}
    assert maxent.score_documents(nothing, F.lit(True)).count() == 0


def test_context_decides_for_4096_words(table):
    source = table("body string", [(" ".join(f"w{i}" for i in range(6000)),)]).select(F.col("body").cast("binary").alias("body"))
    lexicon = maxent.build_lexicon(maxent.count_tokens(source).cache())
    assert (lexicon.group < maxent.HEADS).sum() == 4096 and len(np.unique(lexicon.bucket)) > 4096


def test_language_model_is_a_distribution(table):
    rng = random.Random(1)
    rows = [(i, some_words(rng, 50, 5000)) for i in range(200)]
    source = table("doc_id long, text string", rows).select(F.col("text").cast("binary").alias("body"), F.xxhash64("doc_id").alias("place"))
    counts = maxent.count_tokens(source).cache()
    lexicon = maxent.build_lexicon(counts)
    tables = maxent.zero_tables()
    for t in tables.values():
        t += np.random.default_rng(0).normal(size=t.shape).astype(np.float32) / 3
    every = [bytes(r["word"]) for r in counts.collect()]
    total = 0.0
    for word in every:  # the second token, after w1; the end of a text alone is scored as the second token of "w1"
        body = b"w1 " + word
        s = maxent.stream(lexicon, [body])
        total += 10 ** maxent.score_stream(lexicon, tables, s)[1]
    unknown = 0.0
    for low in [b"\x01", *lexicon.edges]:
        s = maxent.stream(lexicon, [b"w1 " + low + b"\x01?"])
        unknown += 10 ** (maxent.score_stream(lexicon, tables, s)[1] + math.log10(0.1))
    assert total + unknown == pytest.approx(1.0, abs=2e-3)


# Mixing --------------------------------------------------------------------------------------------------------------


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_match_brute_force(table):
    rng = random.Random(0)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 5, 100, 10_000]) + rng.randrange(50) for s in ["b", "a", None, "B", "é", "zz", ""]}
        got = {r["source"]: r["target"] for r in source_targets(table("source string, size long", list(sizes.items()))).collect()}
        assert got == pytest.approx(slow_targets(sizes))


def test_mix_hits_targets_and_reruns_agree(table, docs, nothing):
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([1, 3, 10, 40, 200]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(6000)]
    source = table("doc_id long, text string, source string", rows)
    got = mix(source).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        wanted = r["target"] / r["source_size"]
        assert math.floor(wanted) <= r["copies"] <= math.ceil(wanted)
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 200
    again = mix(source.repartition(5, "text")).collect()
    assert {r["doc_id"]: r["copies"] for r in again} == {r["doc_id"]: r["copies"] for r in got}
    assert mix(docs).count() == docs.count() and mix(nothing).count() == 0
    assert {r["taken"] for r in mix(docs.where("doc_id IN (3, 5, 6)")).collect()} == {0}


# Chat ----------------------------------------------------------------------------------------------------------------


def test_chat_round_trip_of_conflicting_texts(table):
    rng = random.Random(9)
    parts = ["<|end|>", "<|role=user|>", "\\", "\\\\<|end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\n", " ", "a", "<|", "|>", "é", "<|x", "$1", "<s", ">"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a|b\n%", None, ""]), "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for c in range(150) for t in range(3)]
    rows += [(None, 1, "user", "x"), (None, None, "user", None), (900, 1, "user", None), (901, 0, "user", "t"), (901, 0, "user", "t"), (901, 0, "assistant", "y" * 200_000)]
    got = {r["conv_id"]: r for r in format_conversations(table("conv_id long, turn long, role string, text string", rows).withColumn("said", F.lit(1))).collect()}
    assert all(r["round_trip"] for r in got.values())
    for c, r in got.items():
        want = sorted(((t is None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c), key=lambda x: x)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[2:] for x in want]
    assert not got[901]["escaped"] and any(r["escaped"] for r in got.values())


def test_chat_escapes_every_mark(table):
    texts = ["a <|im_start|> b", "<|role=assistant|>", "x <|role=user|> y <|end|>", "\\<|z|>", "plain <| |"]
    rows = [(c, t, "user", text if t else "first") for c, text in enumerate(texts) for t in range(2)]
    got = {r["conv_id"]: r for r in format_conversations(table("conv_id long, turn long, role string, text string", rows)).collect()}
    assert [got[c]["escaped"] for c in range(5)] == [True, True, True, True, False] and all(r["round_trip"] for r in got.values())
    assert "a \\<|im_start|> b" in got[0]["formatted"] and "\\\\<|z|>" in got[3]["formatted"]


# WARC ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 7])
def test_warc_round_trip(spark, table, chunk_bytes):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 40
    rows = [(5, "http://a/b c\r\nX: y", big), (3, None, big), (9, "u", big), (3, "u", big), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", None), (None, "u", big), (8, "u", ""), (-2, "é", "z")]
    pages = table("page_id long, url string, html string", rows).withColumns({"payload": F.lit(1), "digest": F.lit("d"), "path": F.lit(2)})
    archives = archive_pages(spark, pages, chunk_bytes=chunk_bytes)
    chunks = read_archives(archives, chunk_bytes=chunk_bytes)
    got = page_records(chunks).collect()
    assert len(got) == len(rows) and archives.agg(F.sum("records")).first()[0] == len(rows)
    for r in got:
        body = next((h or "").encode() for p, _, h in rows if p == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        revisit = len(body) >= 100 and r["page_id"] != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
    stored = chunks.where("page_id = 3").orderBy("chunk_no").collect()
    body = big.encode()
    assert {r["chunk_no"] for r in stored} == set(range(-(-len(body) // chunk_bytes))) and len(stored) == 2 * -(-len(body) // chunk_bytes)
    first = min(r["chunk_no"] for r in stored)
    assert all(bytes(r["chunk"]) == body[(r["chunk_no"] - first) * chunk_bytes :][:chunk_bytes] for r in stored)
    assert page_records(read_archives(archive_pages(spark, pages.where("false")))).count() == 0


# Wrappers ------------------------------------------------------------------------------------------------------------


def test_wrapper_alignment():
    pages = [f"<body><ul><li>a{i}</li>{'<li>b</li>' * i}</ul>{'<div>note</div>' if i == 2 else ''}<p>text {i}</p><em>same</em></body>" for i in range(4)]
    wrapper = observe(pages[0])
    for page in pages[1:]:
        wrapper = align(wrapper, observe(page))
    assert expression(wrapper["root"]) == "<body><ul>(<li>#</li>)+</ul>(<div>text</div>)?<p>#</p><em>text</em></body>"


def test_texts_of_one_page_are_no_template():
    pages = [f"<article><p>own text {i} of this page</p><p>and more {i} of it</p><div>Read more stories</div></article>" for i in range(6)]
    rare = "<article><p>A has a few words</p><blockquote>Q</blockquote><p>B has a few words</p><div>Read more stories</div></article>"
    wrapper = observe(rare)
    for page in pages:
        wrapper = align(wrapper, observe(page))
    assert extract(rare, rules(wrapper)) == "A has a few words\nQ\nB has a few words"
    assert extract(pages[0], rules(wrapper)) == "own text 0 of this page\nand more 0 of it"
    again = align(observe(rare), observe(rare))
    assert "Q" in extract(rare, rules(align(wrapper, again)))


def test_text_beside_the_body_stays():
    page = "<body><div class='intro'><h1>Head {0}</h1><p>lead {0}</p></div><div class='text'><p>{1}</p><p>end {0}</p></div><div class='end'><p>All rights</p></div></body>"
    pages = [page.format(i, f"words{i} " * 40) for i in range(5)]
    wrapper = observe(pages[0])
    for p in pages[1:]:
        wrapper = align(wrapper, observe(p))
    assert extract(pages[2], rules(wrapper)).split("\n")[:2] == ["Head 2", "lead 2"] and "All rights" not in extract(pages[2], rules(wrapper))
    assert extract(pages[0], rules(observe(pages[0]))).startswith("Head 0\nlead 0\n")


def test_extract_keeps_the_article_only():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header>no</header><nav><ul><li>no</li></ul></nav><div class="cookie-notice">no</div><!-- no --><div class="layout sidebar-left"><article>
    <header><h1>T &amp; U</h1></header><p>a&nbsp;b <b>c</b>d<br>e<script>no()</script>f<p>x &lt;y<form>no</form></p><div class="ad">no</div><ul><li>i<li>j</ul>
    <section id="comments"><article class="comment"><p>no</p></article></section></article></div><aside>no</aside><footer>no</footer></body></html>"""
    assert extract(page, NO_RULES) == "T & U\na b cd ef\nx <y\ni\nj"
    assert extract("", NO_RULES) == "" and extract("plain", NO_RULES) == "plain" and extract("<p>a<", NO_RULES) == "a<"
    assert extract("<div>" * 3000 + "deep", NO_RULES) == "deep"


def test_template_texts_of_a_host_go(table):
    body = "<body><div class='box'><p>{0} own words of page number {0} and more of them</p><p>other {0}</p><div>Read more of our stories</div></div></body>"
    rows = [(i, "http://h.example/x", body.format(i)) for i in range(6)] + [(20, "http://one.example", body.format(9)), (21, None, "<p>x"), (22, "http://h.example", None)]
    rows += [(30 + i, "http://copies.example", "<article><p>all the same</p></article>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in main_text(table("page_id long, url string, html string", rows).withColumn("host", F.lit(1))).collect()}
    assert got[0] == "0 own words of page number 0 and more of them\nother 0"
    assert got[20].endswith("Read more of our stories") and got[21] == "x" and got[22] == "" and got[31] == "all the same"
    assert main_text(table("page_id long, url string, html string", [])).count() == 0
    assert rules(observe(""))["template"] == []


# Quality rules -------------------------------------------------------------------------------------------------------


def slow_statistics(text):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(table, docs):
    rng = random.Random(3)
    rows = [(i, some_words(rng, rng.randrange(60), 4) + rng.choice(["", "\n", " x", " #*$", "\nl\nl\n \n", "\U0001f600 \x0b"]) * rng.randrange(4)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a b"), (503, "a a a a"), (504, " \t ")]
    got = text_statistics(table("doc_id long, text string", rows)).withColumn("bad", base_failed())
    for r in got.collect():
        want = slow_statistics(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["bad"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert text_statistics(docs).count() == docs.count()


def test_rules_are_learned_and_pruned(table, docs, nothing):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" + ("***" if i % 6 == 0 and rng.random() < 0.8 else "") for _ in range(80))) for i in range(900)]
    labels = table("doc_id long, quality int", [(i, int(i % 6 != 0)) for i in range(700)] + [(None, 0), (1, None)])
    judged, learned = judge(table("doc_id long, text string", rows), labels)
    assert 1 <= len(learned) <= 3 and learned[0][0].share == "symbols_per_word" and learned[0][0].above
    kept = {r["doc_id"]: r["kept"] for r in judged.collect()}
    assert all(kept[i] == (i % 6 != 0) for i in kept if i >= 700)
    plain, none = judge(docs, labels.where("false"))
    assert none == [] and plain.count() == docs.count() and plain.where("kept = base_failed").count() == 0
    assert judge(nothing, labels)[0].count() == 0
