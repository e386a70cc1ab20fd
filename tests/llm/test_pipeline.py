"""The pipeline's stages on small tables."""

import random

import __spark_entry__ as driver
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_hand_on_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        own = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert own and own <= ids, name
        ids = own
        assert docs.columns[:5] == corpus_pipeline.COLUMNS
    assert docs.columns[5:] == ["size", "source_size", "target", "copies", "taken"]


def test_stages_take_odd_rows_and_none(spark, table):
    rows = [(1, None, None, None, None), (None, "a b c", "en", "x", 5), (2, "", "en", "x", 0), (3, "a\nb\nc\nd", "en", "y", 7), (4, "q\na\nb\nc", "en", "y", 7), (4, "q\na\nb\nc", "en", "y", 7)]
    docs = table("doc_id long, text string, lang string, source string, n_chars long", rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
        stage(spark, docs, FOLDER).collect()
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, docs, FOLDER).collect()}
    assert cut[4] == ("q", 1) and cut[3] == ("a\nb\nc\nd", 7)
    left = [r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, FOLDER).collect()]
    assert sorted(left, key=str) == [1, 3, 4, 4, None]


def test_near_copies_with_changed_words_go(spark, table):
    """All pairs of a similarity of 0.8 or more by brute force, also in a crowd and between two crowds."""
    rng = random.Random(11)

    def changed(words, spots):
        return [f"n{rng.randrange(10**6)}" if i in spots else w for i, w in enumerate(words)]

    bases = [[f"w{rng.randrange(3000)}" for _ in range(200)] for _ in range(12)]
    texts = [changed(b, rng.sample(range(200), k)) for b in bases[2:] for k in (0, 1, 2, 3, 5, 8)]
    texts += [changed(bases[0], rng.sample(range(200), 1)) for _ in range(150)]
    texts += [changed(bases[1], {3 * k % 200}) for k in range(80)] + [changed(bases[1], range(60, 76)) for _ in range(2)]
    rows = [(i, " ".join(t), "en", "x", 1) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    docs = table("doc_id long, text string, lang string, source string, n_chars long", rows)
    left = {r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, FOLDER).collect()}
    assert left == {find(i) for i in range(len(rows))} and len(left) < len(rows) // 4


def test_query_is_registered():
    assert "pipeline" in driver.queries()
    assert {n.split("_")[0] for n in driver.queries() if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
