"""Frame schedules against a step-by-step clock, tone maps against scalar arithmetic, programs, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import geometry, tone
from frameloom.operators import pixels, programs, schedule
from frameloom.sources.ingest import frames_from_arrays
from frameloom.streaming import live, sink


def _walk(start, low, high, step, ticks, looping=True, bouncing=False):
    """One frame per tick, kept by hand."""
    frame, way, seen = start, 1, []
    for _ in range(ticks):
        seen.append(frame)
        frame += step * way
        if bouncing and not low <= frame <= high:
            frame = low + 1 if frame < low else high - 1
            way = -way
        if frame > high:
            frame = low if looping else high
        elif frame < low:
            frame = high if looping else low
    return seen


@pytest.mark.parametrize("low, high, start", [(1, 5, 1), (2, 9, 4), (1, 2, 2), (3, 3, 3)])
@pytest.mark.parametrize("step", [1, -1])
def test_schedules(spark, low, high, start, step):
    ticks = spark.range(40).select(F.col("id").alias("n"))

    def frames(rule):
        return [r[0] for r in ticks.orderBy("n").select(rule("n", F.lit(start), F.lit(low), F.lit(high), step)).collect()]

    assert frames(schedule.looping_frame) == _walk(start, low, high, step, 40)
    assert frames(schedule.clamped_frame) == _walk(start, low, high, step, 40, looping=False)
    assert frames(schedule.bouncing_frame) == _walk(start, low, high, step, 40, bouncing=True)


def test_clock_needs_more_than_a_period(table):
    df = table("us bigint", [(0,), (99_999,), (100_000,), (100_001,), (200_000,), (1_000_001,)])
    got = [r[0] for r in df.select(schedule.ticks_elapsed("us", -10.0)).collect()]
    assert got == [0, 0, 0, 1, 1, 10]


@pytest.mark.parametrize("x, y, degrees", [(0, 0, 180), (-1, 0, 180), (0, 1, 270), (0, -1, 90), (1, 0, 0), (1, 1, 315), (1, -1, 45), (-1, 1, 225)])
def test_flow_angle(table, x, y, degrees):
    df = table("x double, y double", [(float(x), float(y))])
    assert df.select(tone.flow_angle(F.col("x"), F.col("y"))).first()[0] == pytest.approx(degrees)


def test_hsv_primaries(table):
    df = table("h double", [(0.0,), (60.0,), (120.0,), (180.0,), (240.0,), (300.0,)])
    one = F.lit(1.0)
    got = [tuple(round(v, 9) for v in r) for r in df.select(*tone.hsv_to_rgb(F.col("h"), one, one)).collect()]
    assert got == [(1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 1, 1), (0, 0, 1), (1, 0, 1)]
    grey = df.select(*tone.hsv_to_rgb(F.col("h"), F.lit(0.0), F.lit(0.25))).distinct().collect()
    assert [tuple(r) for r in grey] == [(0.25, 0.25, 0.25)]


def test_tone_maps_cycle_in_name_order():
    names = tone.tone_map_names()
    assert names == sorted(names) and {"default", "gray", "jet", "opticalFlow"} <= set(names)
    assert tone.next_tone_map(names[-1]) == names[0] and tone.next_tone_map(names[0], -1) == names[-1]


def test_zoom_steps_at_exact_powers(spark):
    df = spark.range(-20, 40).select(F.pow(F.lit(2.0), F.col("id")).alias("z"), "id")
    for r in df.select("id", geometry.zoom_in("z").alias("i"), geometry.zoom_out("z").alias("o")).collect():
        assert (r.i, r.o) == (2.0 ** (r.id + 1), 2.0 ** (r.id - 1))


def test_view_round_trip(table):
    df = table("p double", [(12.5,), (-3.0,)])
    there = geometry.to_window("p", F.lit(0.3), F.lit(640.0), F.lit(800.0), 2.5, 1.5)
    back = df.withColumn("w", there).select("p", geometry.to_image("w", F.lit(0.3), F.lit(640.0), F.lit(800.0), 2.5, 1.5).alias("q"))
    assert all(math.isclose(r.p, r.q) for r in back.collect())


def test_pixel_values_read_on_past_the_last_band(spark):
    frames = frames_from_arrays(spark, np.arange(1, 13, dtype=np.float32).reshape(1, 2, 3, 2))
    def at(x, y, d):
        return frames.select(pixels.pixel_values(F.lit(x), F.lit(y), F.lit(d))).first()[0]

    assert at(1, 0, 2) == [3, 4] and at(1, 0, 3) == [3, 4, 5]
    assert at(2, 1, 4) == [11, 12, 0, 0] and at(3, 0, 2) == [0, 0] and at(0, -1, 2) == [0, 0]


def test_points_need_equal_lists(spark):
    with pytest.raises(ValueError, match="inconsistent size"):
        pixels.point_list([1, 2], [3])


def test_mean_of_valid_bands(table):
    df = table("a array<float>", [([1.0, None, 3.0],), ([None, None],), ([float("inf"), 1.0],)])
    assert [r[0] for r in df.select(pixels.mean_of_valid("a")).collect()] == [2.0, None, None]


def test_image_function_errors_are_values(spark):
    frames = frames_from_arrays(spark, np.zeros((2, 3, 4, 1), np.float32), np.ones((1, 2, 2, 1), np.float32))
    aligned = programs.align_images([frames])

    def halve(image):
        if image.shape[0] == 2:
            raise RuntimeError("too small")
        return image[::2, ::2, 0] + 1

    rows = programs.run_image_function(aligned, halve, 1).orderBy("seq_id", "frame").collect()
    assert [(r.seq_id, r.frame, r.status, r.error) for r in rows] == [(0, 0, "ok", None), (0, 1, "ok", None), (1, 0, "error", "too small")]
    assert (rows[0].w, rows[0].h, rows[0].c, list(rows[0].pixels)) == (2, 2, 1, [1.0] * 4)


def test_an_edit_fails_with_its_first_failed_input(spark):
    schema = "seq_id int, frame bigint, w int, h int, c int, pixels array<float>, status string, error string"
    good, bad = (1, 1, 1, [5.0], "ok", None), (None, None, None, None, "error", "broken")
    one = spark.createDataFrame([(0, 0, *good), (0, 1, *bad), (0, 2, *good)], schema)
    two = spark.createDataFrame([(0, 0, *good), (0, 1, *bad[:5], "late")], schema)
    aligned = programs.align_images([one, two])
    failed = programs.failed_edits(aligned, 2).orderBy("frame").collect()
    assert [(r.frame, r.error) for r in failed] == [(1, "broken"), (2, "late")]
    values = programs.run_scalar_program(programs.usable_edits(aligned, 2), "x1 + x2", 2).collect()
    assert [(r.frame, r.v) for r in values] == [(0, 10.0)]


def test_unknown_sources_are_skipped(spark):
    frames = frames_from_arrays(spark, np.zeros((4, 2, 2, 1), np.float32))
    assert len(programs.pick_inputs("1,5,1@0,1@+1", [frames])) == 3
    with pytest.raises(ValueError):
        programs.pick_inputs("4", [frames])


def _change_file(spark, folder, name, rows):
    schema = "path string, modified bigint, deleted boolean, length bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def test_reload_ignores_late_changes_and_sees_deletions(spark, tmp_path):
    folder = str(tmp_path / "changes")
    _change_file(spark, folder, "n=1", [("a", 10, False, 1), ("b", 10, False, 2), ("c", 5, False, 3)])
    schema = "path string, modified bigint, deleted boolean, length bigint"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    newest = live.newest_versions(stream)
    out = str(tmp_path / "out")
    sink.write_updates(newest, out).awaitTermination()
    _change_file(spark, folder, "n=2", [("a", 8, False, 9), ("b", 11, False, 7), ("c", 6, True, 0)])
    sink.write_updates(newest, out).awaitTermination()
    rows = {r.path: (r.modified, r.deleted, r.length) for r in sink.latest(out, newest, ["path"]).collect()}
    assert rows == {"a": (10, False, 1), "b": (11, False, 7), "c": (6, True, 0)}


def test_streamed_histogram_over_batches_equals_batch(spark, tmp_path):
    values = [(i % 3, i % 2, float(np.sin(i))) for i in range(500)]
    data = spark.createDataFrame(values, "seq_id int, band int, v float")
    folder = str(tmp_path / "samples")
    data.repartition(4, "v").write.parquet(folder)
    whole = spark.read.parquet(folder)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    low, high = F.lit(-1.0), F.lit(1.0)
    got = sink.run_to_table(live.progressive_histogram(stream, low, high, ["seq_id"]), ["seq_id", "band", "bin"])
    want = live.progressive_histogram(whole, low, high, ["seq_id"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_hook_runs_on_schedule(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(5).write.parquet(folder)
    seen = []
    stream = spark.readStream.schema("id bigint").parquet(folder)
    hook = sink.on_tick(stream, lambda batch, number: seen.append((number, batch.count())), str(tmp_path / "hook"))
    hook.processAllAvailable()
    hook.stop()
    assert sum(n for _, n in seen) == 5


def test_program_text_is_compiled_and_checked(spark):
    from frameloom.functions.program_text import ProgramError, compile_text

    assert compile_text("zeta alpha -", 2).variables == ("alpha", "zeta")
    assert compile_text("+", 2).words[2] == "+" and len(compile_text("+", 2).variables) == 2
    assert compile_text("x[0] x[1] join", 1).bands and not compile_text("x 2 ^ :i +", 1).bands
    for text, count in (("x y +", 3), ("x", 2), ("x ?", 1)):
        with pytest.raises(ProgramError):
            compile_text(text, count)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(1, 3, 4, 3)).astype(np.float32), rng.normal(size=(1, 3, 4, 1)).astype(np.float32)
    frames = frames_from_arrays(spark, a, b)
    one, two = (frames.where(F.col("seq_id") == k).withColumn("seq_id", F.lit(0)) for k in (0, 1))

    def run(text, *inputs):
        rows = programs.run_program_text(programs.align_images(list(inputs)), text, len(inputs)).collect()
        made = np.full((3, 4, 1 + max(r.band for r in rows)), np.nan, np.float32)
        for r in rows:
            made[r.y, r.x, r.band] = r.v
        return made

    x, y = a[0], b[0]
    f = np.float32
    np.testing.assert_array_equal(run("p q -", one, two), x - y)
    np.testing.assert_array_equal(run("p q - p rot -", two, one), y - (y - x))
    np.testing.assert_array_equal(run("-", one, one), x - x)
    np.testing.assert_array_equal(run("p[2] p[0] join q +", one, two), x[:, :, [2, 0]] + y)
    np.testing.assert_array_equal(run("p 0 > 3 * dup +", one), np.where(x > 0, f(6), f(0)))
    np.testing.assert_array_equal(run("p 0 * 0 /", one), np.full_like(x, np.nan))
    np.testing.assert_allclose(run("p vnorm", one)[:, :, 0], np.sqrt((x.astype(float) ** 2).sum(2)), rtol=1e-6)
    np.testing.assert_array_equal(run(":i :j 10 * + p 0 * +", two)[:, :, 0], np.arange(4)[None, :] + 10 * np.arange(3)[:, None])
    told = programs.program_errors(programs.align_images([one, two]), "x +", 2).first()
    assert told["status"] == "error" and "2 images" in told["error"]
    assert "stack" in programs.program_errors(programs.align_images([one, two]), "x y + +", 2).first()["error"]
    assert programs.program_errors(programs.align_images([one, two]), "x y +", 2).first()["status"] == "ok"


def test_list_of_inputs_ends_where_no_number_follows(spark):
    seqs = [frames_from_arrays(spark, np.full((n, 2, 2, 1), n, np.float32)) for n in (1, 2)]
    assert len(programs.pick_inputs("2,1 x 1 -", seqs)) == 2
    assert len(programs.pick_inputs("1,9,2@+1 3 *", seqs)) == 2
    assert len(programs.pick_inputs("1,x2", seqs)) == 1
    with pytest.raises(ValueError):
        programs.pick_inputs("x1,2", seqs)
