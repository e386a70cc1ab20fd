"""Shuffle helpers: exact with hot keys and with tables too large to broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import collections as seqs
from frameloom.operators import spread


@pytest.fixture
def skewed(spark):
    """30,000 facts, a third of them under one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 100)
    return spark.range(30_000).select(key.cast("int").alias("k"), F.col("id").alias("place"), (F.col("id") * 7 % 101).alias("v"))


def _expected(skewed):
    return sorted(tuple(r) for r in skewed.withColumn("label", F.concat(F.lit("d"), "k")).collect())


def test_attach_broadcasts_small(skewed):
    dim = skewed.select("k").distinct().withColumn("label", F.concat(F.lit("d"), "k"))
    joined = spread.attach_by_key(skewed, dim, ["k"], ["place"])
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in joined.collect()) == _expected(skewed)


def test_attach_without_broadcast(skewed, monkeypatch):
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 0)
    dim = skewed.select("k").distinct().withColumn("label", F.concat(F.lit("d"), "k"))
    joined = spread.attach_by_key(skewed, dim, ["k"], ["place"])
    assert sorted(tuple(r) for r in joined.collect()) == _expected(skewed)


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_hot_join_splits_hot_keys(skewed, monkeypatch, broadcast_rows):
    monkeypatch.setattr(spread, "BROADCAST_ROWS", broadcast_rows)
    dim = skewed.select("k").distinct().withColumn("label", F.concat(F.lit("d"), "k"))
    joined = spread.hot_join(skewed, dim, ["k"], ["place"], hot_rows=500)
    assert "_salt" in joined._jdf.queryExecution().analyzed().toString()
    assert sorted(tuple(r) for r in joined.collect()) == _expected(skewed)


def test_hot_join_left_keeps_unmatched(skewed):
    dim = skewed.select("k").where("k <> 0 and k <> 5").distinct().withColumn("label", F.lit("x"))
    joined = spread.hot_join(skewed, dim, ["k"], ["place"], "left", hot_rows=500)
    assert joined.count() == 30_000
    assert joined.where("label is null").count() == skewed.where("k in (0, 5)").count()


def test_prefix_sum_matches_plain_running_sum(spark):
    rows = [(random.Random(i).randrange(3) if i % 3 else 0, i, i * 13 % 17) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, o int, v int").repartition(5)
    got = {(r.k, r.o): r.s for r in spread.prefix_sum(df, ["k"], ["o"], F.col("v"), "s").collect()}
    sums = {}
    for k, o, v in sorted(rows):
        assert got[(k, o)] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v


def test_number_rows_is_dense(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), (F.col("id") * 31 % 5003).alias("o"))
    got = spread.number_rows(df, ["k"], ["o"]).collect()
    for k in (0, 1):
        ordered = sorted((r.o, r.frame) for r in got if r.k == k)
        assert [frame for _, frame in ordered] == list(range(2500))


def _frames(spark, lengths):
    rows = [(s, f, f"{s}.{f}") for s, n in lengths.items() for f in range(n)]
    return spark.createDataFrame(rows, "seq_id int, frame bigint, name string")


@pytest.mark.parametrize("hot_rows, broadcast_rows", [(1_000_000, 500_000), (4, 0)])
def test_align_holds_last_frame(spark, monkeypatch, hot_rows, broadcast_rows):
    """The held frame is copied to several join keys when many frames hold it."""
    monkeypatch.setattr(seqs, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(spread, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(spread, "BROADCAST_ROWS", broadcast_rows)
    a, b = {0: 23, 1: 2, 2: 5, 3: 1}, {0: 1, 1: 9, 2: 5, 4: 3}
    got = {(r.seq_id, r.frame): (r.name_1, r.name_2) for r in seqs.align([_frames(spark, a), _frames(spark, b)], ["name"]).collect()}
    want = {
        (s, f): (f"{s}.{min(f, a[s] - 1)}", f"{s}.{min(f, b[s] - 1)}")
        for s in a.keys() & b.keys()
        for f in range(max(a[s], b[s]))
    }
    assert got == want


def test_concat_is_associative(spark):
    parts = spark.createDataFrame([(0, p, f, f"{p}{f}") for p, n in ((0, 3), (1, 1), (2, 4)) for f in range(n)],
                                  "seq_id int, part int, frame bigint, name string")
    whole = [r.name for r in seqs.concat(parts, "part").orderBy("frame").collect()]
    first = seqs.concat(parts.where("part < 2"), "part").withColumn("part", F.lit(0))
    again = first.unionByName(parts.where("part = 2"))
    assert [r.name for r in seqs.concat(again, "part").orderBy("frame").collect()] == whole
    assert len(whole) == 8


def test_drop_frame_never_empties(spark):
    frames = _frames(spark, {0: 1, 1: 3})
    left = seqs.drop_frame(frames, 0).orderBy("seq_id", "frame").collect()
    assert [(r.seq_id, r.frame, r.name) for r in left] == [(0, 0, "0.0"), (1, 0, "1.1"), (1, 1, "1.2")]


def test_shift_and_pin(spark):
    frames = _frames(spark, {0: 4})
    def names(df):
        return [r.name for r in df.orderBy("frame").collect()]

    assert names(seqs.shift(frames, 1)) == ["0.1", "0.2", "0.3"]
    assert names(seqs.shift(frames, -2)) == ["0.0", "0.0", "0.0", "0.1", "0.2", "0.3"]
    assert names(seqs.shift(frames, 9)) == ["0.3"]
    assert names(seqs.pin(frames, 2)) == ["0.2"]
    assert names(seqs.pin(frames, 7)) == []


def test_package_is_shipped_once(spark):
    from frameloom.session import ship_package

    ship_package(spark)
    ship_package(spark)
    assert [p for p in spark.sparkContext._python_includes if p == "frameloom.zip"] == ["frameloom.zip"]
