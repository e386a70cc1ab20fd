"""Tokenizer alignment, URL rules and the Merkle manifest against brute force."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from frameloom.llm import align
from frameloom.llm.merkle import height, leaf_text, manifest, position, read_nodes
from frameloom.llm.urls import host_of, judge_urls, look_up, path_of, rule_index, url_tokens

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

# Alignment -----------------------------------------------------------------------------------------------------------


def slow_alignment(texts):
    """Per text: tokens of both kinds, groups as text, links; by the tokenizers' own calls."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = align.default_paths()
    first = Tokenizer.from_file(path_a)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = align._byte_letters()
    found = []
    for text in texts:
        if not text:
            found.append((0, 0, "", []))
            continue
        a = first.encode(" " + text, add_special_tokens=False)
        b = second.encode(text)
        bytes_a = [bytes(letters[c] for c in t) for t in a.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append((0, 0, "", []))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for i, t in zip(a.ids, bytes_a):
            at += len(t)
            ends_a[at] = i
        at = 0
        for i, t in zip(b, bytes_b):
            at += len(t)
            ends_b[at] = i
        groups, links, start = [], [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(i) for e, i in ends.items() if start < e <= end) for ends in (ends_a, ends_b)))
            links.append((ends_a[end], ends_b[end]))
            start = end
        found.append((len(a.ids), len(b), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    return found


@pytest.mark.parametrize("listed", [align.LISTED, 40, 0])
def test_alignment_matches_the_tokenizers(spark, table, listed):
    rng = random.Random(5)
    words = ["the", "Straße", "naïve", "日本語", "12345", "don't", "</s>", "<|endoftext|>", "[INST]", "é", "a\u0301", "😀", "\t", "\n\n", "  ", "x" * 40, "\x00", "ﬁ", "Ａ", "\u00a0", "\u3000", "it's"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "\n", "a▁b", "▁", "same text again", "same text again", "word " * 20_000, "y" * 9_000]
    rows = [(None if i % 17 == 0 else i // 2, t, i) for i, t in enumerate(texts)]
    docs = table("doc_id long, text string, row int", rows).withColumns({"codes": F.lit(1), "n_a": F.lit("x")}).repartition(5)
    told = slow_alignment(texts)
    counts = Counter(link for _, _, _, links in told for link in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = sorted(
        (repr(row[0]), n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for row, (n_a, n_b, digest, links) in zip(rows, told)
    )
    got = align.align_tokenizers(docs, listed=listed).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == want
    assert align.align_tokenizers(docs.where("false")).count() == 0


def test_byte_level_encoder_matches_on_every_letter():
    from tokenizers import Tokenizer

    path, _ = align.default_paths()
    slow, (fast, _) = Tokenizer.from_file(path), align.byte_level(path)
    slow.encode_special_tokens = True
    letters = [chr(c) for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f" a{c}1{c} {c}b{c}'s {c}{c}" for c in letters]
    assert [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)] == [fast(t) for t in texts]


# URL rules -----------------------------------------------------------------------------------------------------------


def test_parts_and_given_rules(table):
    rows = [
        ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/"), ("http://net/", "net", "/", "net/"), ("http://net", "net", "", None),
        ("http://anet/x", "anet", "/x", None), ("https://b.org/fr/#a", "b.org", "/fr/", "org/fr/"), ("https://b.org/fr", "b.org", "/fr", None),
        ("x://example.com/de/?u=http://net/", "example.com", "/de/", "example.com/de/"), ("http://example.net/EN/", "example.net", "/EN/", "net/"),
        ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("http://", "", "", None), ("a://b.net?x/y", "b.net", "", None),
        ("http://c.net:80/x", "c.net:80", "/x", None), ("http://É.net/\n/x", "É.net", "/\n/x", "net/"), ("a#b://d.org/fr/", "d.org", "/fr/", "org/fr/"),
    ]
    pages = table("n int, url string", [(i, r[0]) for i, r in enumerate(rows)]).withColumns({"host": F.lit(1), "row": F.lit("r"), "tokens": F.lit(2), "told": F.lit(3)})
    judged, _ = judge_urls(pages, RULES)
    got = {r["n"]: r for r in judged.collect()}
    for i, (_, host, path, rule) in enumerate(rows):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), rows[i]
        if rule:
            assert got[i]["verdict"] == dict((r, v) for v, r in RULES)[rule]
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"} and got[0]["tokens"] == 2
    assert judge_urls(pages.where("false"), RULES)[0].count() == 0
    assert {r["verdict"] for r in judge_urls(pages.where("n in (2, 3, 9)"), RULES)[0].collect()} == {"allow"}
    parts = pages.select(host_of("url"), path_of("url"), url_tokens("url").alias("t")).collect()
    assert parts[0]["t"] == ["s:http", "h:net", "h:example.net", "h:a.example.net", "w:a", "w:example", "w:net", "p:en", "p:x", "q:y"]


def test_mined_verdicts_match_brute_force(spark, table):
    """All combinations of tokens of each labelled URL, counted one by one."""
    from itertools import combinations

    rng = random.Random(11)
    pick = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(['a', 'b', 'shop', 'spam'])}.{rng.choice(['com', 'org'])}/{rng.choice(['en', 'de', 'buy', 'news'])}{rng.choice(['', '/1', '/x?p=1'])}"
    learned = [(u, "block" if ("spam" in u or "buy" in u) != (rng.random() < 0.1) else "allow") for u in (pick() for _ in range(150))]
    learned += [("http://same.com/" + "/".join(f"w{i}" for i in range(40)), "block")] * 30 + [(None, "allow"), ("", "allow"), ("x" * 5000, "block"), (pick(), None)]
    asked = [pick() for _ in range(80)] + ["http://same.com/w3", "http://zzz.info/", None, ""]
    labels = table("url string, label string", learned)
    pages = table("n int, url string", list(enumerate(asked)))
    judged, mined = judge_urls(pages, [], labels=labels, min_support=0.05, min_confidence=0.7)
    tokens = lambda df: {r[0]: frozenset(r[1]) for r in df.distinct().select("url", url_tokens("url")).collect()}
    of_learned, of_asked = tokens(labels.select("url")), tokens(pages.select("url"))
    known = [(of_learned[u], v) for u, v in learned if v is not None]
    least = 0.05 * len(known)
    single = Counter(t for held, _ in known for t in held)
    # The forty words of the repeated URL stand for one another: one of them is enough here.
    alike = defaultdict(set)
    for t, n in single.items():
        if n >= least:
            alike[frozenset(i for i, (held, _) in enumerate(known) if t in held)].add(t)
    item = {t: min(ts) for ts in alike.values() for t in ts}
    reduced = [(sorted({item[t] for t in held if t in item}), v) for held, v in known]
    all_n, label_n = Counter(), Counter()
    for held, v in reduced:
        for size in range(1, len(held) + 1):
            for c in combinations(held, size):
                all_n[c] += 1
                label_n[c, v] += 1
    rules = {(c, v): (n / all_n[c], n) for (c, v), n in label_n.items() if n >= least and n / all_n[c] >= 0.7}
    usual = Counter(v for _, v in known).most_common(1)[0][0]
    for r in judged.collect():
        own = {item[t] for t in of_asked[r["url"]] if t in item}
        fitting = [(*rank, v == "block", v) for (c, v), rank in rules.items() if own.issuperset(c)]
        assert r["verdict"] == (max(fitting)[3] if fitting else usual), r
    left = [(tuple(r["items"]), r["verdict"]) for r in mined.collect()]
    assert set(left) <= set(rules) and 0 < len(left) < len(rules)
    assert all(not any(set(o) < set(c) and (rules[o, w], w == "block") >= (rules[c, v], v == "block") for o, w in rules) for c, v in left)


def test_index_finds_each_rule(table):
    rules = table("items array<string>, verdict string, support long, confidence double", [(["a"], "allow", 9, 0.9), (["a", "b"], "block", 5, 1.0), (["b", "c"], "allow", 5, 1.0)])
    items = table("token string, item string, n long", [("a", "a", 10), ("b", "b", 7), ("c", "c", 8), ("cc", "c", 8)])
    sets = table("items array<string>", [(["a"],), (["a", "b"],), (["b", "c"],), (["a", "b", "c"],), (["c"],), (["b"],)])
    got = {tuple(r["items"]): r["best"]["verdict"] for r in look_up(sets, rule_index(rules, items)).collect()}
    assert got == {("a",): "allow", ("a", "b"): "block", ("b", "c"): "allow", ("a", "b", "c"): "block"}


# Manifest ------------------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings_of(levels, i):
    found = []
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            found.append((i & 1, level[i ^ 1]))
        else:
            found.append((None, ""))
        i >>= 1
    return found


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_matches_plain_trees(spark, table, levels):
    rng = random.Random(2)
    langs = [None, "", "de", "en", "é", "zz"]
    rows = [(i, rng.choice(langs + ["en"] * 12), rng.choice(["s", None]), rng.choice([None, 3, 70]), "tä" * rng.randrange(4) if i % 9 else None) for i in range(150)]
    rows += [(7, "en", "s", 3, "same")] * 5 + [(None, "en", None, None, None), (-4, "only", "s", 1, "x" * 100_000)]
    docs = table("doc_id long, lang string, source string, n_chars long, text string", rows).repartition(3).withColumns({"tree": F.lit(1), "index": F.lit(2), "digest": F.lit("d"), "leaf": F.lit(0)})
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    claims = {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    proved, log, root = manifest(docs, columns, "lang", "doc_id", claims, levels)

    def leaf(r, more=0):
        return sha("".join(field(v) for v in (r[0], r[2], r[1], None if r[3] is None else r[3] + more, r[4])))

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = slow_tree([leaf(r) for r in groups[g]])
    top = slow_tree([trees[g][-1][0] for g in order])
    assert root == top[-1][0]
    want = []
    for t, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            way = siblings_of(trees[g], i) + siblings_of(top, t)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            claim = leaf(r, int(tampered))
            for side, other in way:
                claim = sha(other, claim) if side == 1 else sha(claim, other)
            assert (claim == root) is not tampered
            want.append((repr(r[0]), leaf(r), trees[g][-1][0], root, sha(*[d for _, d in way]), claim, not tampered))
    got = [(repr(r["doc_id"]), *[r[c] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]) for r in proved.collect()]
    assert sorted(got) == sorted(want)

    # The log holds every node exactly once, at its position.
    segments = sorted((r["tree"], r["first"], r["n_nodes"], bytes(r["digests"])) for r in log.collect())
    for t, tree in [(-1, top), *((i, trees[g]) for i, g in enumerate(order))]:
        own = [s for s in segments if s[0] == t]
        assert [s[1] for s in own] == [sum(x[2] for x in own[:i]) for i in range(len(own))]
        whole = b"".join(s[3] for s in own)
        for k, level in enumerate(tree):
            for j, d in enumerate(level):
                at = position(k, j, len(tree[0]))
                assert whole[32 * at : 32 * at + 32].hex() == d
        assert len(whole) == 32 * sum(map(len, tree)) and len(tree) == height(len(tree[0])) + 1
    wanted = table("tree long, position long", [(s[0], s[1] + k) for s in segments for k in range(s[2])])
    read = {(r["tree"], r["position"]): r["digest"] for r in read_nodes(log, wanted, levels).collect()}
    assert read == {(s[0], s[1] + k): s[3][32 * k : 32 * k + 32].hex() for s in segments for k in range(s[2])}


def test_manifest_of_nothing_and_of_one_row(table):
    docs = table("doc_id long, lang string, text string", [(None, None, None)])
    rows, log, root = manifest(docs, ["doc_id", "text"], "lang", "doc_id")
    only = rows.first()
    assert only["root"] == only["leaf"] == root == sha("--") and only["proof_sha256"] == sha() and only["verified"] and log.count() == 2
    rows, log, root = manifest(docs.where("false"), ["doc_id", "text"], "lang", "doc_id")
    assert (rows.count(), log.count(), root) == (0, 0, None)
    assert docs.select(leaf_text([F.lit("é:1")], ["string"]).cast("string")).first()[0] == "4:é:1"


def test_vocabulary_files_are_a_parameter(tmp_path):
    path, _ = align.default_paths()
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    copy = tmp_path / "other.json"
    copy.write_text(json.dumps(told), encoding="utf-8")
    assert align.byte_level(str(copy))[0](" some text") == align.byte_level(path)[0](" some text")
