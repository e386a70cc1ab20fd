"""Ranges, quantiles, display settings, tone maps, pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import geometry, tone
from frameloom.functions.numeric import (
    SATURATIONS,
    auto_center,
    auto_radius,
    bias_of,
    clamp01,
    f32,
    megabytes,
    scale_of,
    slide_center,
    snap_full_scale,
    widen_radius,
)
from frameloom.model import to_samples
from frameloom.operators import pixels
from frameloom.operators.histogram import count_bins, count_bins_in_rows, range_markers, value_marker, with_range
from frameloom.operators.spread import attach_by_key
from frameloom.operators.stats import (
    block_high,
    block_low,
    block_quantiles,
    box_blocks,
    box_pyramid,
    finite_range,
    frame_bytes,
    nearest_pyramid,
    rank_high,
    rank_low,
    sample_range,
    saturation_range,
)
from frameloom.plans.registry import query
from frameloom.plans.views import BIG, FLOW, IMG, IMG4, big, flow, img, img4, table
from frameloom.sinks.render import byte_pixels, toned_pixels, with_display

_RANGE = "r AS (SELECT seq_id, frame, min(v) AS low, max(v) AS high FROM s GROUP BY 1, 2)"
_DISPLAY = f"""{_RANGE},
    d AS (SELECT seq_id, frame, low, high, CASE WHEN low < high THEN ((high - low) / 2::FLOAT)::FLOAT ELSE 0.5::FLOAT END AS radius,
          ((high + low) / 2::FLOAT)::FLOAT AS center FROM r),
    k AS (SELECT *, (1::FLOAT / (2::FLOAT * radius))::FLOAT AS scale FROM d),
    b AS (SELECT *, ((radius - center) * scale)::FLOAT AS bias FROM k)"""


@query("finite_minmax", f"SELECT seq_id, frame, min(v) AS low, max(v) AS high FROM {IMG4} GROUP BY 1, 2")
def finite_minmax(spark, folder):
    return finite_range(img4(spark, folder))


@query(
    "finite_minmax_spoiled",
    f"""SELECT label AS seq_id, vec_id AS frame, min(v) FILTER (WHERE abs(v) <= 0.2::FLOAT) AS low, max(v) FILTER (WHERE abs(v) <= 0.2::FLOAT) AS high
        FROM (SELECT label, vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2""",
)
def finite_minmax_spoiled(spark, folder):
    """Samples beyond 0.2 are turned into NaN and infinities, which must not count."""
    limit = F.lit(0.2).cast("float")
    spoil = F.transform(
        "pixels",
        lambda v: F.when(v > limit, F.lit(float("nan")).cast("float"))
        .when(v < -limit, F.lit(float("-inf")).cast("float"))
        .otherwise(v),
    )
    return finite_range(img(spark, folder).withColumn("pixels", spoil))


@query(
    "hist_exact_big",
    f"""WITH s AS {BIG}, r AS (SELECT seq_id, min(v) AS low, max(v) AS high FROM s GROUP BY 1)
        SELECT seq_id, band, trunc((v - low) * (255::FLOAT / (high - low))::FLOAT)::INT AS bin, count(*) AS n
        FROM s JOIN r USING (seq_id) GROUP BY 1, 2, 3""",
)
def hist_exact_big(spark, folder):
    """One very large frame per supplier: ranges are attached without moving the samples."""
    samples = big(spark, folder)
    ranged = attach_by_key(samples, sample_range(samples, ["seq_id"]), ["seq_id"], ["place", "band", "v"])
    return count_bins(ranged, ["seq_id"])


def _quantile_sql(view: str, keys: str) -> str:
    return f"""WITH s AS (SELECT {keys}, list_sort(list(v)) AS a, count(*) AS n FROM {view} GROUP BY ALL),
        q(q) AS (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE))
        SELECT {keys}, q, a[1 + least(n - 1, trunc((q::FLOAT * n::FLOAT)::FLOAT)::BIGINT)] AS low,
               a[1 + least(n - 1, trunc(((1::FLOAT - q::FLOAT)::FLOAT * n::FLOAT)::FLOAT)::BIGINT)] AS high FROM s CROSS JOIN q"""


@query("sat_quantiles", _quantile_sql(IMG, "seq_id, frame"))
def sat_quantiles(spark, folder):
    """Per frame, inside the packed row."""
    return block_quantiles(img(spark, folder), SATURATIONS)


@query("sat_quantiles_big", _quantile_sql(BIG, "seq_id"))
def sat_quantiles_big(spark, folder):
    """Per supplier, by two counting passes."""
    return saturation_range(big(spark, folder), SATURATIONS, ["seq_id"], ["place", "band", "v"])


@query("sat_quantiles_sequence", _quantile_sql(IMG, "seq_id"))
def sat_quantiles_sequence(spark, folder):
    """Over all frames of a sequence; values of both signs."""
    return saturation_range(to_samples(img(spark, folder)), SATURATIONS, ["seq_id"], ["frame", "y", "x"])


@query(
    "sat_quantiles_bands",
    _quantile_sql(f"(SELECT * FROM {IMG4} WHERE band IN (3, 1) AND x >= 1 AND x < 3 AND y >= 0 AND y < 3)", "seq_id, frame"),
)
def sat_quantiles_bands(spark, folder):
    """Of the selected bands inside a region whose far corner is left out."""
    area = pixels.corner_region(F.lit(3), F.lit(3), F.lit(1), F.lit(0))
    samples = to_samples(img4(spark, folder)).withColumn("_r", area).where(pixels.in_region("_r")).drop("_r")
    chosen = pixels.selected_bands(samples, (3, 1, 9)).drop("channel")
    return saturation_range(chosen, SATURATIONS, ["seq_id", "frame"], ["y", "x", "band"])


@query(
    "viewport_contrast",
    f"""WITH p AS (SELECT vec_id, 1.5::DOUBLE + vec_id % 5 AS z, (vec_id % 9) * 0.25::DOUBLE - 0.5::DOUBLE AS cx FROM embeddings),
        q AS (SELECT vec_id, least(greatest(cx * 4 - 3 / z, 0), 3) AS x0, least(greatest(2 - 2.5::DOUBLE / z, 0), 3) AS y0,
              least(greatest(cx * 4 + 3 / z, 0), 4) AS x1, least(greatest(2 + 2.5::DOUBLE / z, 0), 4) AS y1 FROM p)
        SELECT seq_id, frame, min(v) AS low, max(v) AS high FROM {IMG4} s JOIN q ON q.vec_id = s.frame
        WHERE band IN (1, 3) AND x0 <> x1 AND y0 <> y1 AND x >= floor(x0) AND x < ceil(x1) AND y >= floor(y0) AND y < ceil(y1) GROUP BY 1, 2""",
)
def viewport_contrast(spark, folder):
    """Range of two bands inside what a 6x5 window shows; some views miss the image altogether."""
    f = F.col("frame")
    zoom = (F.lit(1.5) + f % 5).cast("double")
    center = (f % 9) * F.lit(0.25) - F.lit(0.5)

    def edge(at: int, middle, window: int):
        return geometry.to_image(F.lit(float(at)), middle, F.lit(4.0), F.lit(float(window)), zoom)

    area = geometry.viewport_fit_region(
        edge(0, center, 6), edge(0, F.lit(0.5), 5), edge(6, center, 6), edge(5, F.lit(0.5), 5), F.col("w"), F.col("h")
    )
    seen = img4(spark, folder).withColumn("_r", area).where(F.col("_r").isNotNull())
    samples = to_samples(pixels.blocks_touching(seen, "_r"), keep=("_r",)).where(pixels.in_region("_r"))
    return sample_range(samples.where(F.col("band").isin(1, 3)))


@query(
    "band_roi_minmax",
    f"""SELECT seq_id, frame, min(v) AS low, max(v) AS high FROM {IMG4}
        WHERE band IN (0, 2) AND x >= 1 AND x < 4 AND y >= 1 AND y < 3 GROUP BY 1, 2""",
)
def band_roi_minmax(spark, folder):
    area = pixels.clip_region(
        pixels.corner_region(F.lit(1), F.lit(3), F.lit(7), F.lit(1)), F.lit(4), F.lit(4)
    )
    frames = img4(spark, folder).withColumn("_r", area)
    samples = to_samples(pixels.blocks_touching(frames, "_r"), keep=("_r",)).where(pixels.in_region("_r"))
    return sample_range(samples.where(F.col("band").isin(0, 2)))


@query(
    "snap_range",
    f"""WITH r AS (SELECT seq_id, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM {BIG} GROUP BY 1)
        SELECT seq_id, CASE WHEN low > -1 / 1.5::DOUBLE AND high - low < 2 THEN 1::DOUBLE
            WHEN low > -255 / 1.5::DOUBLE AND high - low < 510 THEN 255
            WHEN low > -65535 / 1.5::DOUBLE AND high - low < 131070 THEN 65535
            WHEN low > -4294967295 / 1.5::DOUBLE AND high - low < 8589934590 THEN 4294967295 ELSE 1 END AS full_scale FROM r""",
)
def snap_range(spark, folder):
    ranges = sample_range(big(spark, folder), ["seq_id"])
    return ranges.select("seq_id", snap_full_scale("low", "high").alias("full_scale"))


@query(
    "snap_range_frames",
    f"""WITH s AS (SELECT seq_id, frame, (v * (1 + frame % 4) * 900)::FLOAT AS v FROM {IMG}),
        r AS (SELECT seq_id, frame, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM s GROUP BY 1, 2)
        SELECT seq_id, frame, CASE WHEN low > -1 / 1.5::DOUBLE AND high - low < 2 THEN 1::DOUBLE
            WHEN low > -255 / 1.5::DOUBLE AND high - low < 510 THEN 255
            WHEN low > -65535 / 1.5::DOUBLE AND high - low < 131070 THEN 65535
            WHEN low > -4294967295 / 1.5::DOUBLE AND high - low < 8589934590 THEN 4294967295 ELSE 1 END AS full_scale FROM r""",
)
def snap_range_frames(spark, folder):
    """Frames stretched by up to 3600, so that several full scales occur."""
    gain = (F.lit(1) + F.col("frame") % 4).cast("float")
    stretched = F.transform("pixels", lambda v: f32(f32(v * gain) * F.lit(900.0).cast("float")))
    ranges = finite_range(img(spark, folder).withColumn("pixels", stretched))
    return ranges.select("seq_id", "frame", snap_full_scale("low", "high").alias("full_scale"))


@query(
    "scale_bias",
    f"WITH s AS {IMG4}, {_DISPLAY} SELECT seq_id, frame, radius, center, scale, bias FROM b",
)
def scale_bias(spark, folder):
    ranged = with_range(img4(spark, folder))
    shown = ranged.select("seq_id", "frame", auto_radius("low", "high").alias("radius"), auto_center("low", "high").alias("center"))
    return shown.withColumn("scale", scale_of("radius")).withColumn("bias", bias_of("center", "radius"))


@query(
    "contrast_step",
    f"""WITH s AS {IMG}, {_DISPLAY}, w AS (SELECT *, (frame % 7 - 3)::FLOAT AS wheel FROM b)
        SELECT seq_id, frame, greatest(0::FLOAT, (radius / (1::FLOAT - (2.0 / 255)::FLOAT * wheel))::FLOAT) AS radius,
          least(greatest((center + (2::FLOAT * radius) * ((1.0 / 255)::FLOAT * wheel))::FLOAT, low), high) AS center FROM w""",
)
def contrast_step(spark, folder):
    """Contrast and brightness after -3..3 wheel notches."""
    ranged = with_range(img(spark, folder))
    shown = ranged.select(
        "seq_id", "frame", "low", "high", auto_radius("low", "high").alias("_r"), auto_center("low", "high").alias("_c"),
        (F.col("frame") % 7 - 3).cast("float").alias("_w"),
    )
    return shown.select(
        "seq_id",
        "frame",
        widen_radius("_r", "_w").alias("radius"),
        slide_center("_c", "_r", "_w", "low", "high").alias("center"),
    )


@query(
    "bin_markers",
    f"""WITH s AS {IMG}, {_DISPLAY}, p AS (SELECT frame, v FROM s WHERE x = 3 AND y = 5)
        SELECT seq_id, b.frame, floor(((center - radius / 2::FLOAT - low) * (255::FLOAT / (high - low))::FLOAT)::FLOAT)::INT AS first_bin,
          ceil(((center + radius / 2::FLOAT - low) * (255::FLOAT / (high - low))::FLOAT)::FLOAT)::INT AS last_bin,
          floor(((p.v - low) * (255::FLOAT / (high - low))::FLOAT)::FLOAT)::INT AS value_bin FROM b JOIN p USING (frame)""",
)
def bin_markers(spark, folder):
    """Histogram bins of the middle half of the range and of the pixel at (3, 5)."""
    ranged = with_range(img(spark, folder))
    half = f32(auto_radius("low", "high") / F.lit(2.0).cast("float"))
    center = auto_center("low", "high")
    first, last = range_markers("low", "high", f32(center - half), f32(center + half))
    pixel = pixels.band_value(F.lit(3), F.lit(5), F.lit(0))
    return ranged.select(
        "seq_id", "frame", first.alias("first_bin"), last.alias("last_bin"), value_marker(pixel, "low", "high").alias("value_bin")
    )


@query(
    "pyramid_avg",
    f"""SELECT seq_id, frame, (y // 2)::INT AS y, (x // 2)::INT AS x, band, round(avg(v::DOUBLE) + 3.7e-13, 9) AS v
        FROM {IMG4} GROUP BY ALL""",
)
def pyramid_avg(spark, folder):
    level = box_pyramid(to_samples(img4(spark, folder)), 1)
    return level.withColumn("v", F.round(F.col("v") + F.lit(3.7e-13), 9))


@query(
    "pyramid_packed",
    f"""SELECT seq_id, frame, (y // 4)::INT AS y, (x // 4)::INT AS x, band, avg(v::DOUBLE)::FLOAT AS v FROM {IMG} GROUP BY ALL""",
)
def pyramid_packed(spark, folder):
    """Two levels down, packed frames in and out."""
    return to_samples(box_blocks(img(spark, folder), 2))


@query(
    "pyramid_nearest",
    f"SELECT seq_id, frame, (y // 4)::INT AS y, (x // 4)::INT AS x, band, v FROM {IMG} WHERE x % 4 = 0 AND y % 4 = 0",
)
def pyramid_nearest(spark, folder):
    return nearest_pyramid(to_samples(img(spark, folder)), 2)


@query(
    "frame_bytes_total",
    "SELECT label AS seq_id, count(*) AS n_frames, (count(*) * 8 * 4 * 2 * 4)::BIGINT AS bytes FROM embeddings GROUP BY 1",
)
def frame_bytes_total(spark, folder):
    return frame_bytes(flow(spark, folder))


@query(
    "scalemap",
    f"""WITH s AS {IMG4}, {_DISPLAY}
        SELECT seq_id, frame, y, x, band, least(1::FLOAT, greatest(0::FLOAT, ((v * (scale * 1.5::FLOAT)::FLOAT)::FLOAT + bias)::FLOAT)) AS v
        FROM s JOIN b USING (seq_id, frame)""",
)
def scalemap(spark, folder):
    """Display values at one and a half times the fitted contrast, so both ends are cut."""
    steep = f32(F.col("scale") * F.lit(1.5).cast("float"))
    samples = to_samples(with_display(img4(spark, folder)).withColumn("scale", steep), keep=("scale", "bias"))
    value = clamp01(f32(f32(F.col("v") * F.col("scale")) + F.col("bias")))
    return samples.select("seq_id", "frame", "y", "x", "band", value.alias("v"))


def _tone_sql(view: str, bands: tuple[int, int, int], colours: str) -> str:
    picks = ", ".join(f"coalesce(max(v) FILTER (WHERE band = {b}), 0::FLOAT) AS p{k}" for k, b in enumerate(bands))
    return f"""WITH s AS {view}, {_DISPLAY},
        p AS (SELECT seq_id, frame, y, x, {picks} FROM s GROUP BY 1, 2, 3, 4),
        t AS (SELECT p.*, scale, bias, {', '.join(
            f"least(1::FLOAT, greatest(0::FLOAT, ((p{k} * scale)::FLOAT + bias)::FLOAT)) AS t{k}" for k in range(3))}
            FROM p JOIN b USING (seq_id, frame))
        {colours}"""


@query("tone_plain", _tone_sql(IMG4, (3, 1, 0), "SELECT seq_id, frame, y, x, t0 AS r, t1 AS g, t2 AS b FROM t"))
def tone_plain(spark, folder):
    return toned_pixels(with_display(img4(spark, folder)), tone.DEFAULT, (3, 1, 0))


@query("tone_gray", _tone_sql(IMG, (0, 1, 2), "SELECT seq_id, frame, y, x, t0 AS r, t0 AS g, t0 AS b FROM t"))
def tone_gray(spark, folder):
    return toned_pixels(with_display(img(spark, folder)), tone.GRAY)


_JET = """, j AS (SELECT *, t0::DOUBLE / 1.15::DOUBLE + 0.1::DOUBLE AS d FROM t)
    SELECT seq_id, frame, y, x, 1.5::DOUBLE - abs(d - 0.75::DOUBLE) * 4 AS r, 1.5::DOUBLE - abs(d - 0.5::DOUBLE) * 4 AS g,
           1.5::DOUBLE - abs(d - 0.25::DOUBLE) * 4 AS b FROM j"""


@query("tone_jet", _tone_sql(IMG, (0, 1, 2), _JET))
def tone_jet(spark, folder):
    return toned_pixels(with_display(img(spark, folder)), tone.JET)


_FLOW = """, a AS (SELECT *, -p0::DOUBLE AS u, p1::DOUBLE AS w, least(1, sqrt(p0::DOUBLE * p0 + p1::DOUBLE * p1) * scale::DOUBLE) AS l FROM t),
    h AS (SELECT *, (180 / pi()) * (CASE WHEN u > 0 THEN atan(w / u) WHEN u < 0 AND w > 0 THEN atan(w / u) + pi()
          WHEN u < 0 THEN atan(w / u) - pi() WHEN w > 0 THEN pi() / 2 WHEN w < 0 THEN -pi() / 2 ELSE 0 END + pi()) AS hue FROM a),
    c AS (SELECT *, floor(hue / 60) % 6 AS n, hue / 60 - floor(hue / 60) % 6 AS f FROM h),
    e AS (SELECT *, l * (1 - l) AS low, l * (1 - f * l) AS falling, l * (1 - (1 - f) * l) AS rising FROM c),
    o AS (SELECT *, CASE WHEN l = 0 THEN l WHEN n IN (0, 5) THEN l WHEN n = 1 THEN falling WHEN n = 4 THEN rising ELSE low END AS r,
            CASE WHEN l = 0 THEN l WHEN n IN (1, 2) THEN l WHEN n = 3 THEN falling WHEN n = 0 THEN rising ELSE low END AS g,
            CASE WHEN l = 0 THEN l WHEN n IN (3, 4) THEN l WHEN n = 5 THEN falling WHEN n = 2 THEN rising ELSE low END AS b FROM e)
    SELECT seq_id, frame, y, x, round(r + 3.7e-10, 6) AS r, round(g + 3.7e-10, 6) AS g, round(b + 3.7e-10, 6) AS b FROM o"""


@query("tone_flow", _tone_sql(FLOW, (0, 1, 2), _FLOW))
def tone_flow(spark, folder):
    """Direction as hue. Angles go through library arctangents, so colours are compared at six decimals."""
    toned = toned_pixels(with_display(flow(spark, folder)), tone.FLOW)
    return toned.select("seq_id", "frame", "y", "x", *[F.round(F.col(k) + F.lit(3.7e-10), 6).alias(k) for k in "rgb"])


_INVERTED = "SELECT seq_id, frame, y, x, 1::FLOAT - t0 AS r, 1::FLOAT - t1 AS g, 1::FLOAT - t2 AS b FROM t"


@query("tone_user", _tone_sql(IMG4, (0, 1, 2), _INVERTED))
def tone_user(spark, folder):
    """A tone map added by the user: inverted colours."""
    one = F.lit(1.0).cast("float")
    tone.register_tone_map(
        "inverted", lambda bands, scale, bias: tuple(one - v for v in tone.plain(bands, scale, bias))
    )
    return toned_pixels(with_display(img4(spark, folder)), "inverted")


@query(
    "default_tone",
    """SELECT p_partkey, (1 + p_size % 5)::INT AS c, CASE 1 + p_size % 5 WHEN 1 THEN 'gray' WHEN 2 THEN 'opticalFlow' ELSE 'default' END AS tone
       FROM part""",
)
def default_tone(spark, folder):
    sized = table(spark, folder, "part").select("p_partkey", (1 + F.col("p_size") % 5).cast("int").alias("c"))
    return sized.withColumn("tone", tone.default_tone("c"))


@query(
    "render_bytes",
    _tone_sql(
        IMG4,
        (0, 1, 2),
        "SELECT seq_id, frame, y, x, "
        + ", ".join(f"floor(t{k}::DOUBLE * 255 + 0.5)::INT AS {n}" for k, n in enumerate("rgb"))
        + " FROM t",
    ),
)
def render_bytes(spark, folder):
    return byte_pixels(toned_pixels(with_display(img4(spark, folder)), tone.DEFAULT))


@query(
    "size_literal",
    """SELECT p_partkey, p_size || CASE p_partkey % 4 WHEN 0 THEN 'GB' WHEN 1 THEN 'MB' WHEN 2 THEN '.5KB' ELSE 'TB' END AS literal,
       CASE p_partkey % 4 WHEN 0 THEN p_size * 1000::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN (p_size + 0.5::DOUBLE) / 1000 END AS mb FROM part""",
)
def size_literal(spark, folder):
    kind = F.col("p_partkey") % 4
    unit = F.when(kind == 0, "GB").when(kind == 1, "MB").when(kind == 2, ".5KB").otherwise("TB")
    told = table(spark, folder, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("literal"))
    return told.withColumn("mb", megabytes("literal"))


@query(
    "display_histogram",
    f"""WITH s AS {IMG}, {_RANGE},
        a AS (SELECT seq_id, frame, list_sort(list(v)) AS a, count(*) AS n FROM s GROUP BY 1, 2),
        q AS (SELECT seq_id, frame, a[1 + least(n - 1, trunc((0.01::FLOAT * n::FLOAT)::FLOAT)::BIGINT)] AS sat_low,
              a[1 + least(n - 1, trunc(((1::FLOAT - 0.01::FLOAT)::FLOAT * n::FLOAT)::FLOAT)::BIGINT)] AS sat_high FROM a),
        d AS (SELECT *, CASE WHEN sat_low < sat_high THEN ((sat_high - sat_low) / 2::FLOAT)::FLOAT ELSE 0.5::FLOAT END AS radius,
              ((sat_high + sat_low) / 2::FLOAT)::FLOAT AS center FROM q),
        h AS (SELECT seq_id, frame, band, trunc((v - low) * (255::FLOAT / (high - low))::FLOAT)::INT AS bin, count(*) AS n
              FROM s JOIN r USING (seq_id, frame) GROUP BY 1, 2, 3, 4)
        SELECT seq_id, frame, band, bin, n, low, high, (1::FLOAT / (2::FLOAT * radius))::FLOAT AS scale,
               ((radius - center) * (1::FLOAT / (2::FLOAT * radius))::FLOAT)::FLOAT AS bias
        FROM h JOIN r USING (seq_id, frame) JOIN d USING (seq_id, frame)""",
)
def display_histogram(spark, folder):
    """Per frame: finite range, 1 % saturation range, display scale and bias, 256-bin histogram.

    Everything is evaluated inside the packed row: one scan, no shuffle.
    """
    frames = img(spark, folder)
    ordered = F.sort_array(F.filter("pixels", lambda v: F.abs(v) < F.lit(float("inf"))))
    ranged = frames.withColumn("low", block_low()).withColumn("high", block_high()).withColumn("_s", ordered)
    n = F.size("_s")
    saturated = ranged.select(
        "seq_id", "frame", "w", "h", "c", "pixels", "low", "high",
        F.get("_s", rank_low(0.01, n).cast("int")).alias("_a"), F.get("_s", rank_high(0.01, n).cast("int")).alias("_b"),
    )
    radius, center = auto_radius("_a", "_b"), auto_center("_a", "_b")
    shown = saturated.withColumn("scale", scale_of(radius)).withColumn("bias", bias_of(center, radius))
    return count_bins_in_rows(shown, keys=["seq_id", "frame", "low", "high", "scale", "bias"])
