"""Work that used to grow by row or by batch: numbering, listing, histograms of packed rows."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from frameloom.operators import dense, spread
from frameloom.sources import listing


def test_numbering_moves_rows_once(spark):
    """Only keys and columns that are asked for are written; the written rows are not dealt out again."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 7 != 1, F.col("id") % 50)
    rows = spark.range(20_000).select(key.alias("k"), F.col("id").alias("place"), (F.col("id") * 37 % 20_011).alias("o"))
    done = spread.number_rows(rows, ["k"], ["o"], keep=["place"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert done.columns == ["k", "place", "frame"] and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["o"]):
        want[r["place"]] = (r["k"], seen.setdefault(r["k"], 0))
        seen[r["k"]] += 1
    assert {r["place"]: (r["k"], r["frame"]) for r in done.collect()} == want and None in seen


def test_numbers_hold_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spread, "is_small", lambda _: False)
    rows = spark.range(3000).select((F.col("id") % 4).alias("k"), F.col("id").alias("o"))
    assert all(r["frame"] == r["o"] // 4 for r in spread.number_rows(rows, ["k"], ["o"]).collect())


def _entries(n):
    made = pd.DataFrame({"line_no": 0, "part_no": 0, "root": "r", "path": [f"/none/f{i}.npy" for i in range(n)], "kind": "file", "length": 5.0, "modified": pd.Timestamp("2024-01-01")})
    return made[listing._COLUMNS]


def test_plain_files_pass_a_listing_step_together():
    batch = _entries(500)
    batch.loc[7, ["kind", "length"]] = "missing", None
    for step in (listing._open_folders(False), listing._open_folders(True), listing._replace_rows(listing._open_archives, listing._are_archives)):
        (out,) = step(iter([batch]))
        assert list(out["path"]) == list(batch["path"]) and out["length"].isna().sum() == 1 and str(out["length"].dtype) == "Int64"


def test_folders_of_a_batch_open_together(tmp_path):
    for k in range(30):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}/one.npy").write_bytes(b"12345")
    folders = _entries(40)
    folders.loc[:29, "path"], folders.loc[:29, "kind"], folders.loc[:29, "length"] = [f"{tmp_path}/d{k}" for k in range(30)], "dir", None
    plain, opened = listing._open_folders(False)(iter([folders]))
    assert len(plain) == 10 and sorted(opened["path"]) == sorted(f"{tmp_path}/d{k}/one.npy" for k in range(30))
    assert list(opened["length"]) == [5] * 30


def test_histograms_of_a_batch_take_bounded_memory():
    rng = np.random.default_rng(1)
    n = 10_000
    pixels = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64, dtype=np.int32)), pa.array(rng.normal(size=64 * n).astype(np.float32)))
    whole = [pa.array(np.full(n, v, np.int32)) for v in (8, 8, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *whole, pixels], names=["frame", "h", "w", "c", "pixels"])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    most = rows = 0
    for out in dense._counter(["frame"], dense.smooth_jumps_of, True, "density")(iter([batch])):
        most, rows = max(most, pa.total_allocated_bytes() - before), rows + out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 256 * n and peak + most < 60_000_000
