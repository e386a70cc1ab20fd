"""Folders that change between ticks: what is told, what is read, and what a failed tick leaves behind."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.sources.codecs import npy_bytes, png_bytes
from frameloom.streaming import folder as live


class Box:
    """A folder of small array files, and the ticks of a watcher on it."""

    def __init__(self, spark, root):
        self.spark, self.root, self.stamp = spark, root, 1_700_000_000
        (root / "data").mkdir()

    def put(self, name, n, value, again=True):
        data = npy_bytes(np.full((n, 2, 3, 1), value, np.float32))
        return self.raw(name, data, again)

    def raw(self, name, data, again=True):
        """``again=False`` leaves the time of the file's last change as it was."""
        path = self.root / "data" / name
        self.stamp += again
        stamp = self.stamp if again else path.stat().st_mtime
        path.write_bytes(data)
        os.utime(path, (stamp, stamp))
        return path

    def lines(self, *expressions):
        named = expressions or (f"{self.root}/data",)
        return self.spark.createDataFrame(list(enumerate(named)), "line_no long, expression string")

    def tick(self, number, *expressions):
        return live.tick(self.spark, self.lines(*expressions), f"{self.root}/state", number)

    def told(self, number, *expressions):
        rows = self.tick(number, *expressions).collect()
        return sorted((os.path.basename(r.path), r.frame, r.change) for r in rows)

    def states(self, number):
        return self.spark.read.parquet(f"{self.root}/state/files/{number % 2}")


@pytest.fixture
def box(spark, tmp_path):
    return Box(spark, tmp_path)


def test_first_tick_adds_everything_and_a_quiet_one_tells_nothing(box):
    box.put("a.npy", 2, 1.0)
    box.put("b.npy", 1, 2.0)
    assert box.told(0) == [("a.npy", 0, "added"), ("a.npy", 1, "added"), ("b.npy", 0, "added")]
    assert box.told(1) == []


def test_longer_shorter_new_and_deleted_files(box):
    for name in ("grows.npy", "shrinks.npy", "goes.npy", "stays.npy"):
        box.put(name, 2, 1.0)
    box.tick(0)
    box.put("grows.npy", 3, 1.0)
    box.put("shrinks.npy", 1, 1.0)
    box.put("comes.npy", 1, 1.0)
    (box.root / "data" / "goes.npy").unlink()
    assert box.told(1) == [
        ("comes.npy", 0, "added"), ("goes.npy", 0, "lost"), ("goes.npy", 1, "lost"), ("grows.npy", 0, "changed"),
        ("grows.npy", 1, "changed"), ("grows.npy", 2, "added"), ("shrinks.npy", 0, "changed"), ("shrinks.npy", 1, "lost"),
    ]


def test_a_tick_that_runs_again_tells_the_same(box):
    box.put("a.npy", 1, 1.0)
    box.tick(0)
    box.put("a.npy", 2, 1.0)
    expected = [("a.npy", 0, "changed"), ("a.npy", 1, "added")]
    assert box.told(1) == expected
    assert box.told(1) == expected
    assert box.told(2) == []


def test_headers_of_files_with_the_same_version_are_not_read(box):
    kept = box.put("a.npy", 2, 1.0)
    box.tick(0)
    box.raw("a.npy", b"x" * kept.stat().st_size, again=False)
    assert box.told(1) == []
    assert box.states(1).first()["problem"] is None


def test_a_broken_file_is_one_failed_frame_until_it_is_mended(box):
    box.raw("a.npy", b"\x93NUMPY\x01\x00")
    frames = live.refresh(None, box.tick(0))
    assert [(r.frame, r.status != "ok", r.pixels) for r in frames.collect()] == [(0, True, None)]
    box.put("a.npy", 2, 5.0)
    changed = box.tick(1)
    assert sorted((r.frame, r.change) for r in changed.collect()) == [(0, "changed"), (1, "added")]
    mended = live.refresh(frames, changed).orderBy("frame").collect()
    assert [(r.status, list(r.pixels)) for r in mended] == [("ok", [5.0] * 6)] * 2


def test_only_named_frames_are_read_again(box):
    box.put("a.npy", 1, 1.0)
    old = box.put("b.npy", 1, 2.0)
    box.raw("c.png", png_bytes(np.full((2, 2, 1), 7, np.uint8)))
    frames = live.settle(live.refresh(None, box.tick(0)))
    box.raw("b.npy", b"x" * old.stat().st_size, again=False)  # unreadable now, yet with the version it had
    box.put("a.npy", 1, 9.0)
    after = {os.path.basename(r.path): (r.status, r.pixels[0]) for r in live.refresh(frames, box.tick(1)).collect()}
    assert after == {"a.npy": ("ok", 9.0), "b.npy": ("ok", 2.0), "c.png": ("ok", 7.0)}


def test_sources_that_name_a_file_twice_or_none(box):
    box.put("a.npy", 2, 1.0)
    box.put("b.npy", 1, 2.0)
    here = f"{box.root}/data"
    lines = (f"{here}/b.npy::{here}/a.npy::{here}/b.npy", f"{here}/none*.npy")
    assert box.told(0, *lines) == [("a.npy", 0, "added"), ("a.npy", 1, "added"), ("b.npy", 0, "added")]
    now = live.index_of(live.listing(box.lines(*lines)), box.states(0)).orderBy("seq_id", "frame").collect()
    assert [(r.seq_id, r.frame, os.path.basename(r.place.path)) for r in now] == [(0, 0, "b.npy"), (0, 1, "a.npy"), (0, 2, "a.npy"), (0, 3, "b.npy")]


def test_an_empty_folder_then_files_then_none_again(box):
    assert box.told(0) == []
    path = box.put("a.npy", 1, 1.0)
    assert box.told(1) == [("a.npy", 0, "added")]
    path.unlink()
    assert box.told(2) == [("a.npy", 0, "lost")]


def test_watch_reports_a_change_and_goes_on_after_a_restart(box):
    box.put("a.npy", 1, 1.0)
    told = []

    def note(changed, number):
        told.append((number, sorted((os.path.basename(r.path), r.frame, r.change) for r in changed.select("path", "frame", "change").collect())))

    def until(found):
        end = time.time() + 60
        while time.time() < end and not any(found in rows for _, rows in told):
            time.sleep(0.2)
        assert any(found in rows for _, rows in told), told

    def started():
        return live.watch(box.spark, box.lines, f"{box.root}/watch", note, "500 milliseconds")

    query = started()
    try:
        until(("a.npy", 0, "added"))
        box.put("a.npy", 2, 1.0)
        until(("a.npy", 1, "added"))
    finally:
        query.stop()
    last = max(n for n, _ in told)
    box.put("b.npy", 1, 1.0)
    told.clear()
    query = started()
    try:
        until(("b.npy", 0, "added"))
    finally:
        query.stop()
    assert min(n for n, _ in told) >= last
    assert sum(rows.count(("a.npy", 0, "added")) for _, rows in told) == 0


def test_frames_of_a_change_lie_where_the_header_says(box):
    box.put("a.npy", 2, 1.0)
    box.tick(0)
    box.put("a.npy", 4, 1.0)
    added = box.tick(1).where("change = 'added'").select("frame", F.col("place.offset").alias("at"), F.col("place.length").alias("length"))
    rows = sorted((r.frame, r.at, r.length) for r in added.collect())
    assert [(f, length) for f, _, length in rows] == [(2, 24), (3, 24)]
    assert rows[1][1] - rows[0][1] == 24 and rows[0][1] == 128 + 2 * 24
