"""Statistics against numpy on frames with NaN, infinities, constants and nothing at all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions.numeric import auto_center, auto_radius
from frameloom.model import to_blocks, to_samples
from frameloom.operators import histogram, stats, tiles
from frameloom.sources.ingest import frames_from_arrays


def _images():
    rng = np.random.default_rng(7)
    noisy = rng.normal(size=(9, 11, 2)).astype(np.float32)
    spoiled = noisy.copy()
    spoiled[0, 0, 0], spoiled[1, 1, 1], spoiled[2, 2, 0] = np.nan, np.inf, -np.inf
    return {
        0: noisy,
        1: spoiled,
        2: np.full((6, 5, 2), 3.5, np.float32),
        3: np.full((4, 4, 2), np.nan, np.float32),
        4: rng.integers(0, 255, (7, 13, 2)).astype(np.float32),
        5: np.float32([[[1.0, 2.0]]]),
    }


@pytest.fixture(scope="module")
def images():
    return _images()


@pytest.fixture(scope="module")
def frames(spark, images):
    # a leading axis of one frame keeps (h, w, c) unambiguous
    return frames_from_arrays(spark, *[image[None] for image in images.values()])


def _finite(image):
    return image[np.isfinite(image)]


def test_range(frames, images):
    got = {r.seq_id: (r.low, r.high) for r in stats.finite_range(frames).collect()}
    for k, image in images.items():
        kept = _finite(image)
        want = (kept.min(), kept.max()) if kept.size else (None, None)
        assert got[k] == want


def _numpy_histogram(image):
    kept = _finite(image)
    if not kept.size:
        return {}
    low, high = kept.min(), kept.max()
    factor = np.float32(255) / np.float32(high - low) if high > low else np.float32(0)
    out = {}
    for band in range(image.shape[2]):
        values = _finite(image[:, :, band])
        for b in ((values - low) * factor).astype(np.int32):
            out[(band, int(b))] = out.get((band, int(b)), 0) + 1
    return out


@pytest.mark.parametrize("edge", [None, 4])
def test_exact_histogram(frames, images, edge):
    if edge:
        blocks = tiles.split_frames(frames, edge)
        got_rows = histogram.exact_histogram(blocks, stats.finite_range(blocks)).collect()
    else:
        got_rows = histogram.exact_histogram(frames).collect()
    for k, image in images.items():
        got = {(r.band, r.bin): r.n for r in got_rows if r.seq_id == k}
        assert got == _numpy_histogram(image)
        assert sum(got.values()) == _finite(image).size


def _numpy_smooth(image, band):
    kept = _finite(image)
    low, high = kept.min(), kept.max()
    density = np.zeros(256)
    h, w, _ = image.shape
    used = False
    for y in range(h - 1):
        for x in range(w - 1):
            q = np.sort(image[y : y + 2, x : x + 2, band].reshape(-1))
            if not np.isfinite(q).all() or len(set(q.tolist())) < 4:
                continue
            b = np.rint(np.float32(255) * (q - low) / (high - low)).astype(int)
            if len(set(b.tolist())) < 4:
                continue
            used = True
            top = 2.0 / (b[2] + b[3] - b[1] - b[0])
            density[b[0]] += top / (b[1] - b[0])
            density[b[1]] -= top / (b[1] - b[0])
            density[b[2]] -= top / (b[3] - b[2])
            density[b[3]] += top / (b[3] - b[2])
    return np.cumsum(np.cumsum(density)) if used else None


@pytest.mark.parametrize("edge", [None, 4, 1])
def test_smooth_histogram(frames, images, edge):
    blocks = tiles.split_frames(frames, edge) if edge else frames
    ranges = stats.finite_range(blocks) if edge else None
    rows = histogram.smooth_histogram(blocks, ranges).collect()
    for k in (0, 1, 4):
        for band in (0, 1):
            want = _numpy_smooth(images[k], band)
            got = sorted((r.bin, r.density) for r in rows if r.seq_id == k and r.band == band)
            assert len(got) == 256
            np.testing.assert_allclose([d for _, d in got], want, atol=1e-9)
    assert not [r for r in rows if r.seq_id in (2, 3, 5)]


def _numpy_quantiles(values, q):
    ordered, n = np.sort(values), np.float32(len(values))
    low = int(np.float32(q) * n)
    high = min(int((np.float32(1) - np.float32(q)) * n), len(values) - 1)
    return ordered[low], ordered[high]


@pytest.mark.parametrize("fraction", [0.001, 0.01, 0.1, 0.25])
def test_quantiles(frames, images, fraction):
    packed = {r.seq_id: (r.low, r.high) for r in stats.block_quantiles(frames, [fraction]).collect()}
    counted = {
        r.seq_id: (r.low, r.high)
        for r in stats.saturation_range(to_samples(frames), [fraction], ["seq_id"], ["frame", "y", "x"]).collect()
    }
    for k, image in images.items():
        kept = _finite(image)
        if kept.size:
            assert packed[k] == _numpy_quantiles(kept, fraction)
            assert counted[k] == packed[k]
        else:
            assert packed[k] == (None, None)
            assert counted[k] == (None, None)


def test_counting_quantiles_over_extreme_values(spark):
    """Subnormal to huge, both signs, many repeats, one group with a third of the rows."""
    rng = np.random.default_rng(3)
    values = np.concatenate(
        [
            np.float32(2.0) ** rng.integers(-149, 127, 4000).astype(np.float32) * rng.choice([-1, 1], 4000),
            np.float32(1000) + rng.random(4000).astype(np.float32),
            np.zeros(500),
            np.repeat(np.float32(-7.25), 1500),
        ]
    ).astype(np.float32)
    rows = [(0 if i % 3 == 0 else 1 + i % 4, i, float(v)) for i, v in enumerate(values)]
    samples = spark.createDataFrame(rows, "k int, i int, v float")
    for r in stats.saturation_range(samples, [0.01, 0.3], ["k"], ["i"]).collect():
        group = np.array([v for k, _, v in rows if k == r.k], np.float32)
        assert (r.low, r.high) == _numpy_quantiles(group, r.q)


def test_empty_range_gives_default_radius(table):
    df = table("low float, high float", [(None, None), (2.0, 2.0), (1.0, 4.0)])
    got = df.select(auto_radius("low", "high").alias("r"), auto_center("low", "high").alias("c")).collect()
    assert [tuple(r) for r in got] == [(0.5, None), (0.5, 2.0), (1.5, 2.5)]


def test_tiles_round_trip(frames):
    want = sorted(map(tuple, to_samples(frames).fillna(-9.0).collect()))
    split = tiles.split_frames(frames, 4)
    assert sorted(map(tuple, to_samples(split).fillna(-9.0).collect())) == want
    packed = to_blocks(to_samples(split), 5)
    assert sorted(map(tuple, to_samples(packed).fillna(-9.0).collect())) == want
    grid = tiles.tile_grid(frames, 4).drop("c")
    cut = split.select(*grid.columns)
    assert sorted(map(tuple, grid.collect())) == sorted(map(tuple, cut.collect()))


def test_whole_histogram_counts_are_truncated(table):
    df = table("d double", [(2.9,), (-0.4,), (0.0,)])
    assert [r[0] for r in df.select(histogram.whole_counts("d")).collect()] == [2, 0, 0]


def test_range_reads_only_needed_columns(spark):
    from frameloom.plans.views import img

    plan = stats.finite_range(img(spark, "/root/testdata/sf0.001").where("seq_id = 3"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in text
    pixels_free = to_samples(img(spark, "/root/testdata/sf0.001")).groupBy("seq_id").agg(F.max("v"))
    assert "vec_id" not in pixels_free._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
