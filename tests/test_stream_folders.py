"""Streams over tables that are folders of several files, as larger tables are."""

import pytest

from frameloom.plans import catalog
from frameloom.streaming.live import rows_seen
from frameloom.streaming.sink import run_to_table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def folders(spark, tmp_path):
    """Embeddings and events, each as a folder of three files."""
    for name in ("embeddings", "events"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["stream_hist", "stream_progress", "stream_reload", "stream_clock", "stream_windows"])
def test_folders_stream_like_files(spark, folders, name):
    got, want = (catalog.QUERIES[name](spark, f) for f in (folders, SMALL))
    assert got.count() and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_stream_without_files_ends_in_no_rows(spark, tmp_path):
    """No batch runs then, so nothing was ever stored."""
    (tmp_path / "none").mkdir()
    schema = "seq_id int, frame long, y int, x int, band int, v float"
    samples = spark.readStream.schema(schema).parquet(str(tmp_path / "none"))
    got = run_to_table(rows_seen(samples, 8, ["seq_id", "frame"]), ["seq_id", "frame"])
    assert got.columns == ["seq_id", "frame", "progress"] and got.collect() == []
