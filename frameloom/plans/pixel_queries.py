"""Samples, bands, regions, tiles, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import geometry, text
from frameloom.functions.numeric import displayed_high, displayed_low, finite
from frameloom.model import to_samples
from frameloom.operators import pixels, tiles
from frameloom.operators.histogram import exact_histogram, smooth_histogram
from frameloom.operators.stats import finite_range
from frameloom.plans.registry import query
from frameloom.plans.views import IMG, IMG4, img, img4, numbered, table, urls
from frameloom.sinks.render import pixel_rows


@query("flatten_samples", f"SELECT seq_id, frame, y, x, band, v FROM {IMG4}")
def flatten_samples(spark, folder):
    return to_samples(img4(spark, folder))


@query(
    "pixel_at",
    f"""SELECT e.label AS seq_id, e.vec_id AS frame, (e.vec_id % 5)::INT AS x, (e.vec_id % 6)::INT AS y,
        coalesce(max(v) FILTER (WHERE band = 0), 0::FLOAT) AS b0, coalesce(max(v) FILTER (WHERE band = 1), 0::FLOAT) AS b1,
        coalesce(max(v) FILTER (WHERE band = 2), 0::FLOAT) AS b2, coalesce(max(v) FILTER (WHERE band = 3), 0::FLOAT) AS b3
        FROM embeddings e LEFT JOIN {IMG4} s ON s.frame = e.vec_id AND s.x = e.vec_id % 5 AND s.y = e.vec_id % 6
        GROUP BY 1, 2, 3, 4""",
)
def pixel_at(spark, folder):
    x, y = (F.col("frame") % 5).cast("int"), (F.col("frame") % 6).cast("int")
    values = pixels.pixel_values(x, y, F.col("c"))
    found = img4(spark, folder).select("seq_id", "frame", x.alias("x"), y.alias("y"), values.alias("_v"))
    return found.select("seq_id", "frame", "x", "y", *[F.col("_v")[k].alias(f"b{k}") for k in range(4)])


@query(
    "bands_select",
    f"""SELECT seq_id, frame, y, x, band, v, CASE band WHEN 3 THEN 0 WHEN 1 THEN 2 END AS channel
        FROM {IMG4} WHERE band IN (3, 1)""",
)
def bands_select(spark, folder):
    return pixels.selected_bands(to_samples(img4(spark, folder)), (3, -1, 1))


@query(
    "bands_display",
    f"""SELECT seq_id, frame, y, x, max(v) FILTER (WHERE band = 2) AS p0, 0::FLOAT AS p1,
        max(v) FILTER (WHERE band = 0) AS p2 FROM {IMG4} GROUP BY 1, 2, 3, 4""",
)
def bands_display(spark, folder):
    return pixel_rows(img4(spark, folder), (2, 7, 0), keep=())


@query(
    "band_valid_at",
    f"""SELECT e.label AS seq_id, e.vec_id AS frame, max(v) FILTER (WHERE band = 3) AS r,
        max(v) FILTER (WHERE band = e.vec_id % 6) AS b, count(*) FILTER (WHERE band = 3) > 0 AS r_valid
        FROM embeddings e LEFT JOIN {IMG4} s ON s.frame = e.vec_id AND s.x = e.vec_id % 5 AND s.y = 2
        GROUP BY 1, 2""",
)
def band_valid_at(spark, folder):
    x = (F.col("frame") % 5).cast("int")
    red = pixels.band_value(x, F.lit(2), F.lit(3))
    blue = pixels.band_value(x, F.lit(2), (F.col("frame") % 6).cast("int"))
    return img4(spark, folder).select(
        "seq_id", "frame", red.alias("r"), blue.alias("b"), red.isNotNull().alias("r_valid")
    )


@query(
    "roi_filter",
    f"""SELECT seq_id, frame, y, x, band, v FROM {IMG}
        WHERE x >= least(frame % 8, frame % 3) AND x <= greatest(frame % 8, frame % 3)
        AND y >= least(frame % 5, frame % 11) AND y <= greatest(frame % 5, frame % 11)""",
)
def roi_filter(spark, folder):
    frames = img(spark, folder)
    drag = pixels.inclusive_region(*[(F.col("frame") % m).cast("int") for m in (8, 5, 3, 11)])
    area = pixels.clip_region(drag, F.col("w"), F.col("h"))
    samples = to_samples(frames.withColumn("_r", area), keep=("_r",))
    return samples.where(pixels.in_region("_r")).drop("_r")


@query(
    "finite_filter",
    f"""SELECT seq_id, frame, y, x, band, v FROM {IMG} WHERE v >= -0.2::FLOAT AND v <= 0.2::FLOAT""",
)
def finite_filter(spark, folder):
    """Samples beyond 0.2 become NaN or infinite, then only finite ones are kept."""
    limit = F.lit(0.2).cast("float")
    spoiled = F.when(F.col("v") > limit, F.lit(float("inf")).cast("float")).when(
        F.col("v") < -limit, F.lit(float("nan")).cast("float")
    )
    samples = to_samples(img(spark, folder)).withColumn("v", spoiled.otherwise(F.col("v")))
    return samples.where(finite("v"))


@query(
    "viewport_samples",
    f"""WITH r AS (SELECT label, vec_id, 2.0 + (vec_id % 3) AS z, 0.25 + (vec_id % 4) * 0.125 AS cx FROM embeddings),
        q AS (SELECT *, floor(cx * 8 + (0 - 8.0) / z - 1)::INT AS x0, floor(cx * 8 + (16 - 8.0) / z + 1)::INT AS x1,
              floor(0.5 * 8 + (0 - 6.0) / z - 1)::INT AS y0, floor(0.5 * 8 + (12 - 6.0) / z + 1)::INT AS y1 FROM r)
        SELECT s.seq_id, s.frame, s.y, s.x, s.band, s.v FROM {IMG} s JOIN q ON q.vec_id = s.frame
        WHERE s.x >= q.x0 AND s.x < q.x1 AND s.y >= q.y0 AND s.y < q.y1""",
)
def viewport_samples(spark, folder):
    """Samples seen in a 16x12 window; zoom and center differ per frame."""
    zoom = (F.lit(2) + F.col("frame") % 3).cast("double")
    center = F.lit(0.25) + (F.col("frame") % 4) * F.lit(0.125)
    seen = geometry.visible_region(center, F.lit(0.5), F.col("w"), F.col("h"), F.lit(16), F.lit(12), zoom)
    blocks = pixels.blocks_touching(img(spark, folder).withColumn("_r", seen), "_r")
    return to_samples(blocks, keep=("_r",)).where(pixels.in_region("_r")).drop("_r")


@query(
    "view_transform",
    """SELECT vec_id AS frame, ((vec_id % 8) - 4::DOUBLE) * ((1 + vec_id % 4) * 1.5::DOUBLE) + 50 AS wx,
       4::DOUBLE + ((vec_id % 100) - 50) / ((1 + vec_id % 4) * 1.5::DOUBLE) AS ix,
       least(100 / (8 * 1.5::DOUBLE), 60 / ((1 + vec_id % 9) * 1.5::DOUBLE)) AS fit FROM embeddings""",
)
def view_transform(spark, folder):
    zoom = (F.lit(1) + F.col("frame") % 4).cast("double")
    size, window, center = F.lit(8.0), F.lit(100.0), F.lit(0.5)
    tall = (F.lit(1) + F.col("frame") % 9).cast("double")
    return img(spark, folder).select(
        "frame",
        geometry.to_window((F.col("frame") % 8).cast("double"), center, size, window, zoom, 1.5).alias("wx"),
        geometry.to_image((F.col("frame") % 100).cast("double"), center, size, window, zoom, 1.5).alias("ix"),
        geometry.fit_zoom(window, F.lit(60.0), size, tall, 1.5).alias("fit"),
    )


@query(
    "zoom_levels",
    """SELECT p_partkey, p_retailprice AS zoom, pow(2, floor(log2(p_retailprice) + 1)) AS zoomed_in,
       pow(2, ceil(log2(p_retailprice) - 1)) AS zoomed_out FROM part""",
)
def zoom_levels(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_retailprice").alias("zoom"),
        geometry.zoom_in("p_retailprice").alias("zoomed_in"),
        geometry.zoom_out("p_retailprice").alias("zoomed_out"),
    )


@query(
    "region_measure",
    """SELECT vec_id AS frame, (abs(vec_id % 13 - vec_id % 7) + 1)::INT AS width, (abs(vec_id % 5 - vec_id % 17) + 1)::INT AS height,
       sqrt(pow(abs(vec_id % 13 - vec_id % 7) + 1, 2) + pow(abs(vec_id % 5 - vec_id % 17) + 1, 2)) AS diagonal
       FROM embeddings""",
)
def region_measure(spark, folder):
    area = pixels.inclusive_region(*[(F.col("frame") % m).cast("int") for m in (13, 5, 7, 17)])
    r = F.col("_r")
    sized = img(spark, folder).select("frame", area.alias("_r")).select(
        "frame", (r["x1"] - r["x0"]).alias("width"), (r["y1"] - r["y0"]).alias("height")
    )
    return sized.withColumn("diagonal", geometry.diagonal("width", "height"))


_TILE_SQL = """SELECT label AS seq_id, vec_id AS frame, tx::INT AS tx, ty::INT AS ty, (tx * 3)::INT AS x0,
    (ty * 3)::INT AS y0, least(3, 8 - tx * 3)::INT AS w, least(3, 8 - ty * 3)::INT AS h, 1 AS c
    FROM embeddings, unnest(range(3)) a(tx), unnest(range(3)) b(ty)"""


@query("tile_grid", _TILE_SQL)
def tile_grid(spark, folder):
    return tiles.tile_grid(img(spark, folder), edge=3)


@query(
    "tile_split",
    f"""SELECT seq_id, frame, (x // 3)::INT AS tx, (y // 3)::INT AS ty, y, x, band, v FROM {IMG}""",
)
def tile_split(spark, folder):
    """Frames cut into 3x3 tiles and read back as samples with their tile."""
    blocks = tiles.split_frames(img(spark, folder), edge=3)
    return to_samples(blocks, keep=("tx", "ty")).select("seq_id", "frame", "tx", "ty", "y", "x", "band", "v")


@query(
    "tile_overlap",
    f"""WITH t AS ({_TILE_SQL}),
        a AS (SELECT vec_id, (vec_id % 4)::INT AS ax0, (vec_id % 3)::INT AS ay0, (4 + vec_id % 5)::INT AS ax1, (3 + vec_id % 6)::INT AS ay1
              FROM embeddings)
        SELECT seq_id, frame, tx, ty, greatest(ax0, x0) - x0 AS cx0, greatest(ay0, y0) - y0 AS cy0,
               least(ax1, x0 + w) - x0 AS cx1, least(ay1, y0 + h) - y0 AS cy1
        FROM t JOIN a ON a.vec_id = t.frame
        WHERE ax0 < x0 + w AND ax1 > x0 AND ay0 < y0 + h AND ay1 > y0""",
)
def tile_overlap(spark, folder):
    frames = img(spark, folder)
    f = F.col("frame")
    area = F.struct(
        (f % 4).cast("int").alias("x0"),
        (f % 3).cast("int").alias("y0"),
        (F.lit(4) + f % 5).cast("int").alias("x1"),
        (F.lit(3) + f % 6).cast("int").alias("y1"),
    )
    met = tiles.overlap(tiles.tile_grid(frames, edge=3), frames.select("seq_id", "frame", area.alias("area")), "area", 3)
    return met.select("seq_id", "frame", "tx", "ty", *[F.col(f"common.{k}").alias(f"c{k}") for k in ("x0", "y0", "x1", "y1")])


@query(
    "tile_cull",
    f"""SELECT seq_id, frame, tx, ty FROM ({_TILE_SQL})
        WHERE (x0 - 4) * 3 + 6 <= 12 AND (x0 + w - 4) * 3 + 6 >= 0 AND (y0 - 4) * 3 + 5 <= 10 AND (y0 + h - 4) * 3 + 5 >= 0""",
)
def tile_cull(spark, folder):
    """Tiles that show in a 12x10 window at zoom 3."""
    grid = tiles.tile_grid(img(spark, folder), edge=3)
    left = geometry.to_window("x0", F.lit(0.5), F.lit(8), F.lit(12), 3.0)
    right = geometry.to_window(F.col("x0") + F.col("w"), F.lit(0.5), F.lit(8), F.lit(12), 3.0)
    top = geometry.to_window("y0", F.lit(0.5), F.lit(8), F.lit(10), 3.0)
    bottom = geometry.to_window(F.col("y0") + F.col("h"), F.lit(0.5), F.lit(8), F.lit(10), 3.0)
    shown = grid.where((left <= 12) & (right >= 0) & (top <= 10) & (bottom >= 0))
    return shown.select("seq_id", "frame", "tx", "ty")


@query(
    "point_lookup",
    f"""WITH p AS (SELECT event_id AS point, event_id % n.n AS frame, (user_id % 9)::INT AS x, (event_id % 9)::INT AS y
                   FROM events, (SELECT count(*) AS n FROM embeddings) n),
        s AS {IMG}
        SELECT e.label AS seq_id, p.frame, p.point, p.x, p.y, coalesce(s.v, 0::FLOAT) AS v
        FROM p JOIN embeddings e ON e.vec_id = p.frame LEFT JOIN s ON s.frame = p.frame AND s.x = p.x AND s.y = p.y""",
)
def point_lookup(spark, folder):
    """Each event asks for one pixel of one frame; positions 8 are outside."""
    count = table(spark, folder, "embeddings").count()
    asked = table(spark, folder, "events").select(
        F.col("event_id").alias("point"),
        (F.col("event_id") % count).alias("frame"),
        (F.col("user_id") % 9).cast("int").alias("x"),
        (F.col("event_id") % 9).cast("int").alias("y"),
    )
    found = pixels.lookup_points(img(spark, folder), asked, ["frame"])
    return found.select("seq_id", "frame", "point", "x", "y", F.col("values")[0].alias("v"))


@query(
    "point_list",
    f"""WITH p(point, x, y) AS (VALUES (0, 0, 0), (1, 3, 2), (2, 9, 1))
        SELECT e.label AS seq_id, e.vec_id AS frame, p.point, p.x, p.y,
        coalesce(max(v) FILTER (WHERE band = 0), 0::FLOAT) AS b0, coalesce(max(v) FILTER (WHERE band = 3), 0::FLOAT) AS b3
        FROM embeddings e CROSS JOIN p LEFT JOIN {IMG4} s ON s.frame = e.vec_id AND s.x = p.x AND s.y = p.y
        GROUP BY 1, 2, 3, 4, 5""",
)
def point_list(spark, folder):
    found = pixels.lookup_list(img4(spark, folder), [0, 3, 9], [0, 2, 1])
    return found.select(
        "seq_id", "frame", "point", "x", "y", F.col("values")[0].alias("b0"), F.col("values")[3].alias("b3")
    )


@query(
    "valid_band_mean",
    f"""SELECT seq_id, frame, y, x, (coalesce(max(v) FILTER (WHERE band = 1), 0)::DOUBLE
        + coalesce(max(v) FILTER (WHERE band = 3), 0)::DOUBLE) / 2 AS mean FROM {IMG4} GROUP BY 1, 2, 3, 4""",
)
def valid_band_mean(spark, folder):
    """Mean over bands 1 and 3; the third selected band does not exist."""
    rows = pixel_rows(img4(spark, folder), (1, 3, 5), keep=("c",))
    none = F.lit(None).cast("float")
    chosen = [F.when(F.lit(b) < F.col("c"), F.col(f"p{k}")).otherwise(none) for k, b in enumerate((1, 3, 5))]
    return rows.select("seq_id", "frame", "y", "x", pixels.mean_of_valid(F.array(*chosen)).alias("mean"))


@query(
    "displayed_range",
    f"""WITH r AS (SELECT seq_id, frame, min(v) AS low, max(v) AS high FROM {IMG4} GROUP BY 1, 2),
        d AS (SELECT *, ((high - low) / 2::FLOAT)::FLOAT AS radius FROM r)
        SELECT seq_id, frame, least(low - radius, high - radius) AS shown_low, greatest(low + radius, high + radius) AS shown_high FROM d""",
)
def displayed_range(spark, folder):
    """Range shown by a display whose two channel centers are the frame's extremes."""
    ranges = finite_range(img4(spark, folder))
    shown = ranges.withColumn("radius", ((F.col("high") - F.col("low")).cast("float") / 2).cast("float"))
    centers = F.array("low", "high", F.lit(99.0).cast("float"))
    return shown.select(
        "seq_id",
        "frame",
        displayed_low(centers, F.col("radius"), 2).alias("shown_low"),
        displayed_high(centers, F.col("radius"), 2).alias("shown_high"),
    )


def _named_frames(spark, folder):
    """Every frame with the address of its page; frames without one are named by their number."""
    paths = urls(spark, folder).withColumnRenamed("page_id", "frame")
    named = img(spark, folder).join(paths, "frame", "left")
    return named.withColumn("path", F.coalesce("path", F.concat(F.lit("unnamed "), F.col("frame").cast("string"))))


@query(
    "frame_title",
    """WITH d AS (SELECT e.label AS seq_id, e.vec_id, coalesce(p.url, 'unnamed ' || e.vec_id) AS url,
         row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) AS f, count(*) OVER (PARTITION BY e.label) AS n
         FROM embeddings e LEFT JOIN pages p ON p.page_id = e.vec_id)
       SELECT seq_id, vec_id AS source, '#' || (seq_id + 1) || ' [' || f || '/' || n || '] ' || right(url, 12) AS title,
              '8x8x1' AS size FROM d""",
)
def frame_title(spark, folder):
    named = _named_frames(spark, folder)
    dense = numbered(named)
    from frameloom.operators.collections import with_length

    return with_length(dense).select(
        "seq_id",
        "source",
        text.frame_title(F.col("seq_id") + 1, F.col("frame") + 1, "len", "path", 12).alias("title"),
        text.size_text("w", "h", "c").alias("size"),
    )


@query(
    "frame_listing",
    """WITH d AS (SELECT e.label AS seq_id, coalesce(p.url, 'unnamed ' || e.vec_id) AS path,
         row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) - 1 AS frame, count(*) OVER (PARTITION BY e.label) AS n
         FROM embeddings e LEFT JOIN pages p ON p.page_id = e.vec_id)
       SELECT seq_id, frame, path, frame = least(3, n - 1) AS is_current FROM d""",
)
def frame_listing(spark, folder):
    """File of every frame; the player stands at the fourth frame or the last."""
    from frameloom.operators.collections import held_index, with_length

    named = _named_frames(spark, folder)
    return with_length(numbered(named)).select(
        "seq_id", "frame", "path", (F.col("frame") == held_index(F.lit(3), "len")).alias("is_current")
    )


def _hist_sql(where: str = "TRUE", view: str = IMG) -> str:
    return f"""WITH s AS {view}, r AS (SELECT seq_id, frame, min(v) AS low, max(v) AS high FROM s GROUP BY 1, 2)
        SELECT seq_id, frame, band, trunc((v - low) * (255::FLOAT / (high - low))::FLOAT)::INT AS bin, count(*) AS n
        FROM s JOIN r USING (seq_id, frame) WHERE {where} GROUP BY 1, 2, 3, 4"""


@query("hist_exact", _hist_sql(view=IMG4))
def hist_exact(spark, folder):
    return exact_histogram(img4(spark, folder))


@query("hist_tiled", _hist_sql())
def hist_tiled(spark, folder):
    """The same over frames cut into tiles: the range comes from all tiles of a frame."""
    blocks = tiles.split_frames(img(spark, folder), edge=3)
    return exact_histogram(blocks, finite_range(blocks))


@query(
    "hist_roi",
    _hist_sql("x >= frame % 3 AND x <= 4 + frame % 6 AND y >= frame % 4 AND y <= 3 + frame % 4"),
)
def hist_roi(spark, folder):
    f = F.col("frame")
    drag = pixels.inclusive_region(
        (F.lit(4) + f % 6).cast("int"), (f % 4).cast("int"), (f % 3).cast("int"), (F.lit(3) + f % 4).cast("int")
    )
    return exact_histogram(img(spark, folder), region=pixels.clip_region(drag, F.col("w"), F.col("h")))


def _smooth_sql(w: int, c: int, inside: str = "TRUE") -> str:
    row = w * c
    return f"""WITH r AS (SELECT label AS seq_id, vec_id AS frame, embedding AS e, list_min(embedding) AS low, list_max(embedding) AS high FROM embeddings),
        i AS (SELECT *, unnest(range(64)) AS i FROM r),
        a AS (SELECT *, (i % {c})::INT AS band, (i // {c}) % {w} AS x, i // {row} AS y FROM i),
        c AS (SELECT seq_id, frame, band, low, high, list_sort([e[i + 1], e[i + 1 + {c}], e[i + 1 + {row}], e[i + 1 + {row + c}]]) AS q
              FROM a WHERE x < {w - 1} AND y < {64 // row - 1} AND {inside}),
        p AS (SELECT seq_id, frame, band, [round_even(((255::FLOAT * (v - low)) / (high - low))::DOUBLE, 0)::INT FOR v IN q] AS k
              FROM c WHERE q[1] < q[2] AND q[2] < q[3] AND q[3] < q[4]),
        g AS (SELECT *, 2::DOUBLE / (k[3] + k[4] - k[2] - k[1]) AS t FROM p WHERE k[1] < k[2] AND k[2] < k[3] AND k[3] < k[4]),
        j AS (SELECT seq_id, frame, band, k[1] AS bin, t / (k[2] - k[1]) AS jump FROM g
              UNION ALL SELECT seq_id, frame, band, k[2], -t / (k[2] - k[1]) FROM g
              UNION ALL SELECT seq_id, frame, band, k[3], -t / (k[4] - k[3]) FROM g
              UNION ALL SELECT seq_id, frame, band, k[4], t / (k[4] - k[3]) FROM g),
        m AS (SELECT seq_id, frame, band, bin, sum(jump) AS jump FROM j GROUP BY 1, 2, 3, 4),
        e AS (SELECT k.seq_id, k.frame, k.band, b.bin::INT AS bin, coalesce(m.jump, 0) AS jump
              FROM (SELECT DISTINCT seq_id, frame, band FROM m) k CROSS JOIN unnest(range(256)) b(bin)
              LEFT JOIN m ON m.seq_id = k.seq_id AND m.frame = k.frame AND m.band = k.band AND m.bin = b.bin),
        f AS (SELECT seq_id, frame, band, bin, sum(jump) OVER (PARTITION BY seq_id, frame, band ORDER BY bin) AS slope FROM e)
        SELECT seq_id, frame, band, bin,
               round(sum(slope) OVER (PARTITION BY seq_id, frame, band ORDER BY bin) + 3.7e-10, 6) AS density FROM f"""


def _rounded(histogram):
    """Densities are sums whose last bits depend on the order of adding, so they are compared at
    six decimals; the small shift keeps values such as 1/640 away from the rounding edge."""
    return histogram.withColumn("density", F.round(F.col("density") + F.lit(3.7e-10), 6))


@query("hist_smooth", _smooth_sql(4, 4))
def hist_smooth(spark, folder):
    return _rounded(smooth_histogram(img4(spark, folder)))


@query("hist_smooth_tiled", _smooth_sql(8, 1))
def hist_smooth_tiled(spark, folder):
    """Frames cut into 3x3 tiles: inner cells in place, cells on the seams from border samples."""
    blocks = tiles.split_frames(img(spark, folder), edge=3)
    return _rounded(smooth_histogram(blocks, finite_range(blocks)))


@query("hist_smooth_roi", _smooth_sql(8, 1, "x >= 1 AND x + 1 < 7 AND y >= 2 AND y + 1 < 8"))
def hist_smooth_roi(spark, folder):
    area = F.struct(F.lit(1).alias("x0"), F.lit(2).alias("y0"), F.lit(7).alias("x1"), F.lit(8).alias("y1"))
    return _rounded(smooth_histogram(img(spark, folder), region=area))
