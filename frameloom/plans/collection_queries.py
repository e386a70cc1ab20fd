"""Collection algebra, programs over aligned frames, playback, shared settings, side-cars, changes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from frameloom.model import to_samples
from frameloom.operators import collections as seqs
from frameloom.operators import lineage, programs, schedule, sidecar
from frameloom.operators.attach import attach_settings, player_bounds, rescale_factor
from frameloom.operators.spread import attach_by_key, number_rows, prefix_sum
from frameloom.plans.registry import query
from frameloom.plans.views import DENSE, IMG, flow, img, numbered, table, urls

_GROUPED = f"""d AS {DENSE}, n AS (SELECT seq_id, count(*) AS len FROM d GROUP BY 1)"""


@query(
    "concat_frames",
    f"""WITH {_GROUPED}, o AS (SELECT seq_id, sum(len) OVER (PARTITION BY seq_id % 3 ORDER BY seq_id) - len AS start FROM n)
        SELECT (seq_id % 3)::INT AS seq_id, seq_id AS part, source, (start + frame)::BIGINT AS frame FROM d JOIN o USING (seq_id)""",
)
def concat_frames(spark, folder):
    """Three collections, each the concatenation of every third sequence."""
    parts = numbered(img(spark, folder)).select(
        (F.col("seq_id") % 3).cast("int").alias("seq_id"), F.col("seq_id").alias("part"), "source", "frame"
    )
    return seqs.concat(parts, "part").select("seq_id", "part", "source", "frame")


@query(
    "number_null_keys",
    """WITH e AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN user_id % 7 END AS key FROM events)
       SELECT event_id, key, CAST(row_number() OVER (PARTITION BY key ORDER BY event_id) - 1 AS BIGINT) AS frame FROM e""",
)
def number_null_keys(spark, folder):
    """Frame numbers inside a key that is NULL for a third of the rows."""
    events = table(spark, folder, "events").select("event_id", F.expr("CASE WHEN user_id % 3 > 0 THEN user_id % 7 END").alias("key"))
    return number_rows(events, ["key"], ["event_id"])


@query(
    "part_offsets",
    """SELECT l_suppkey AS seq_id, l_orderkey AS part, (sum(count(*)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - count(*))::BIGINT AS start
       FROM lineitem GROUP BY 1, 2""",
)
def part_offsets(spark, folder):
    """Running sum of part lengths: every order is a part of its supplier's collection."""
    items = table(spark, folder, "lineitem")
    parts = items.groupBy(F.col("l_suppkey").alias("seq_id"), F.col("l_orderkey").alias("part")).agg(F.count("*").alias("len"))
    return prefix_sum(parts, ["seq_id"], ["part"], F.col("len"), "start").select("seq_id", "part", "start")


@query(
    "mask_frame",
    f"""WITH d AS {DENSE}, k AS (SELECT *, seq_id % 7 AS cut FROM d)
        SELECT seq_id, source, (frame - (frame > cut)::INT)::BIGINT AS frame FROM k WHERE frame <> cut""",
)
def mask_frame(spark, folder):
    """Drop frame (sequence mod 7) of each sequence."""
    cut = (F.col("seq_id") % 7).cast("bigint")
    return seqs.drop_frame(numbered(img(spark, folder)), cut).select("seq_id", "source", "frame")


@query(
    "mask_many",
    f"""WITH d AS {DENSE} SELECT seq_id, source, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - 1 AS frame
        FROM d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.seq_id AND e.event_id = d.source)""",
)
def mask_many(spark, folder):
    """Drop every frame whose source number is an event of the user with the sequence's number."""
    frames = numbered(img(spark, folder)).select("seq_id", "source", "frame")
    events = table(spark, folder, "events").select(
        F.col("user_id").cast("int").alias("seq_id"), F.col("event_id").alias("source")
    )
    dropped = frames.join(events, ["seq_id", "source"], "left_semi")
    return seqs.drop_frames(frames, dropped)


@query(
    "pin_frame",
    f"""WITH d AS {DENSE} SELECT s.seq_id, 0::BIGINT AS frame, s.y, s.x, s.band, s.v FROM {IMG} s JOIN d ON d.source = s.frame
        WHERE d.frame = d.seq_id % 4""",
)
def pin_frame(spark, folder):
    pinned = seqs.pin(numbered(img(spark, folder)), (F.col("seq_id") % 4).cast("bigint"))
    return to_samples(pinned)


@query(
    "shift_frames",
    f"""WITH {_GROUPED} SELECT 'later' AS kind, seq_id, source, frame - least(45, len - 1) AS frame FROM d JOIN n USING (seq_id)
        WHERE frame >= least(45, len - 1)
        UNION ALL SELECT 'earlier', seq_id, source, frame + 2 FROM d
        UNION ALL SELECT 'earlier', seq_id, source, k FROM d, unnest([0, 1]) u(k) WHERE frame = 0""",
)
def shift_frames(spark, folder):
    """45 frames later (past the end of short sequences) and 2 frames earlier."""
    frames = numbered(img(spark, folder)).select("seq_id", "source", "frame")
    later = seqs.shift(frames, 45).select(F.lit("later").alias("kind"), "seq_id", "source", "frame")
    earlier = seqs.shift(frames, -2).select(F.lit("earlier").alias("kind"), "seq_id", "source", "frame")
    return later.unionByName(earlier)


def _side_by_side(pairs: str, count: int) -> str:
    """SQL that reads the vectors of ``count`` sources next to each other, sample by sample."""
    values = ", ".join(f"unnest(e{k}.embedding) AS v{k}" for k in range(1, count + 1))
    joins = " ".join(f"JOIN embeddings e{k} ON e{k}.vec_id = source_{k}" for k in range(1, count + 1))
    return f"z AS (SELECT {pairs}.seq_id, {pairs}.frame, unnest(range(64)) AS i, {values} FROM {pairs} {joins})"


_ALIGNED = f"""{_GROUPED},
    g AS (SELECT a.seq_id, (a.seq_id + 1) % 10 AS other, (a.seq_id + 2) % 10 AS third FROM n a),
    l AS (SELECT g.*, a.len AS len1, b.len AS len2, greatest(a.len, b.len) AS longest FROM g
          JOIN n a ON a.seq_id = g.seq_id JOIN n b ON b.seq_id = g.other),
    f AS (SELECT l.*, unnest(range(longest)) AS frame FROM l),
    w AS (SELECT f.seq_id, f.frame, d1.source AS source_1, d2.source AS source_2, d3.source AS source_3 FROM f
          JOIN d d1 ON d1.seq_id = f.seq_id AND d1.frame = least(f.frame, len1 - 1)
          JOIN d d2 ON d2.seq_id = f.other AND d2.frame = least(f.frame, len2 - 1)
          JOIN d d3 ON d3.seq_id = f.third AND d3.frame = 2)"""


def _neighbour(frames, step: int):
    """The sequence ``step`` places further on, under this sequence's number."""
    moved = F.pmod(F.col("seq_id") - step, F.lit(10)).cast("int")
    return frames.withColumn("seq_id", moved)


def _three(frames):
    """Each sequence, the next one, and frame 2 of the one after."""
    return [frames, _neighbour(frames, 1), _neighbour(seqs.pin(frames, 2), 2)]


@query("align_hold", f"WITH {_ALIGNED} SELECT seq_id, frame, source_1, source_2, source_3 FROM w")
def align_hold(spark, folder):
    """Sequences of different lengths and a pinned frame, side by side."""
    frames = numbered(img(spark, folder)).select("seq_id", "frame", "source")
    return seqs.align(_three(frames), ["source"])


@query(
    "pixel_program_diff",
    f"""WITH {_ALIGNED}, {_side_by_side("w", 3)}
        SELECT seq_id, frame, (i // 8)::INT AS y, (i % 8)::INT AS x, 0 AS band, (v1 - v2 + 2 * v3)::FLOAT AS v FROM z""",
)
def pixel_program_diff(spark, folder):
    frames = numbered(img(spark, folder))
    aligned = programs.align_images(_three(frames))
    return programs.run_scalar_program(aligned, "x1 - x2 + cast(2 as float) * x3", 3)


@query(
    "pixel_program_packed",
    f"""WITH {_ALIGNED}, {_side_by_side("w", 2)}
        SELECT seq_id, frame, (i // 8)::INT AS y, (i % 8)::INT AS x, 0 AS band, greatest(v1, v2) AS v FROM z""",
)
def pixel_program_packed(spark, folder):
    """The same kind of program over packed frames, two inputs picked by a source list."""
    frames = numbered(img(spark, folder))
    inputs = programs.pick_inputs("1,2,7", [frames, _neighbour(frames, 1)])
    packed = programs.run_packed_program(programs.align_images(inputs), lambda a, b: F.greatest(a, b), 2)
    return to_samples(packed)


@query(
    "pixel_program_shifted",
    f"""WITH {_GROUPED}, w AS (SELECT d.seq_id, d.frame, d.source AS source_1, e.source AS source_2, p.source AS source_3
          FROM d JOIN d e ON e.seq_id = d.seq_id AND e.frame = greatest(0, d.frame - 1) JOIN d p ON p.seq_id = d.seq_id AND p.frame = 0
          UNION ALL SELECT d.seq_id, n.len, d.source, d.source, p.source FROM d JOIN n USING (seq_id) JOIN d p ON p.seq_id = d.seq_id AND p.frame = 0
          WHERE d.frame = n.len - 1), {_side_by_side("w", 3)}
        SELECT seq_id, frame, (i // 8)::INT AS y, (i % 8)::INT AS x, 0 AS band, (v1 - v2 + v3)::FLOAT AS v FROM z""",
)
def pixel_program_shifted(spark, folder):
    """Difference to the frame before, plus the first frame: inputs ``1,1@-1,1@0``."""
    frames = numbered(img(spark, folder))
    inputs = programs.pick_inputs("1,1@-1,1@0", [frames])
    return programs.run_scalar_program(programs.align_images(inputs), "x1 - x2 + x3", 3)


@query(
    "program_text",
    f"""WITH {_ALIGNED}, {_side_by_side("w", 3)}
        SELECT seq_id, frame, (i // 8)::INT AS y, (i % 8)::INT AS x, 0 AS band,
               greatest((((v1 - v2)::FLOAT * 2::FLOAT)::FLOAT + ((i % 8)::FLOAT * v3)::FLOAT)::FLOAT, v1) AS v FROM z""",
)
def program_text(spark, folder):
    """A program as text over three inputs; its variables a, b and c stand for them in alphabetical order."""
    frames = numbered(img(spark, folder))
    inputs, text = programs.split_program("1,2,3 a b - 2 * :i c * + a fmax")
    aligned = programs.align_images(programs.pick_inputs(inputs, _three(frames)))
    return programs.run_program_text(aligned, text, 3)


@query(
    "program_text_hidden",
    f"""WITH {_ALIGNED}, {_side_by_side("w", 2)}
        SELECT seq_id, frame, (i // 8)::INT AS y, (i % 8)::INT AS x, 0 AS band, (v1 * v2)::FLOAT AS v FROM z""",
)
def program_text_hidden(spark, folder):
    """A program without variables works on its inputs in order."""
    frames = numbered(img(spark, folder))
    return programs.run_program_text(programs.align_images([frames, _neighbour(frames, 1)]), "*", 2)


@query(
    "program_text_bands",
    f"""WITH p AS (SELECT d.seq_id, d.frame, unnest(range(32)) AS i, embedding AS e FROM embeddings JOIN {DENSE} d ON d.source = vec_id),
        o AS (SELECT *, unnest([0, 1, 2]) AS band FROM p)
        SELECT seq_id, frame, (i // 8)::INT AS y, (i % 8)::INT AS x, band,
        CASE band WHEN 0 THEN (e[2 * i + 1] + 1::FLOAT)::FLOAT WHEN 1 THEN (e[2 * i + 2] + 1::FLOAT)::FLOAT ELSE (e[2 * i + 2] - e[2 * i + 1])::FLOAT END AS v FROM o""",
)
def program_text_bands(spark, folder):
    """Bands taken apart and joined: two bands in, three out."""
    aligned = programs.align_images([numbered(flow(spark, folder))])
    return programs.run_program_text(aligned, "p 1 + p[1] p[0] - join", 1)


@query(
    "program_wrong_count",
    f"""WITH d AS {DENSE} SELECT seq_id, frame, 'error' AS status, 'the program expects 3 variables but 2 images were given' AS error FROM d""",
)
def program_wrong_count(spark, folder):
    """Three variables for two images: every frame has the error."""
    frames = numbered(img(spark, folder))
    return programs.program_errors(programs.align_images([frames, frames]), "x y z + +", 2)


@query(
    "vector_program",
    f"""WITH p AS (SELECT d.seq_id, d.frame, unnest(range(32)) AS i, embedding AS e FROM embeddings JOIN {DENSE} d ON d.source = vec_id),
        o AS (SELECT *, unnest([0, 1, 2]) AS band FROM p)
        SELECT seq_id, frame, (i // 8)::INT AS y, (i % 8)::INT AS x, band,
        CASE band WHEN 0 THEN (e[2 * i + 1] + e[2 * i + 2])::FLOAT WHEN 1 THEN (e[2 * i + 1] * e[2 * i + 2])::FLOAT ELSE e[2 * i + 1] END AS v FROM o""",
)
def vector_program(spark, folder):
    """A program over band vectors: two bands in, three bands out."""
    aligned = programs.align_images([numbered(flow(spark, folder))])
    made = programs.run_vector_program(aligned, lambda p: F.array(p[0] + p[1], p[0] * p[1], p[0]), 1)
    return to_samples(made)


@query(
    "whole_image_fn",
    f"""WITH {_ALIGNED}, p AS (SELECT w.seq_id, w.frame, unnest(range(64)) AS i, e1.embedding AS a, e2.embedding AS b
          FROM w JOIN embeddings e1 ON e1.vec_id = source_1 JOIN embeddings e2 ON e2.vec_id = source_2)
        SELECT seq_id, frame, ((i // 2) % 8)::INT AS y, (i // 16)::INT AS x, (i % 2)::INT AS band,
               (a[i + 1] - b[(3 - i // 16) * 16 + i % 16 + 1])::FLOAT AS v FROM p""",
)
def whole_image_fn(spark, folder):
    """Difference with the upside-down neighbour, transposed: a function of two whole images."""
    frames = numbered(flow(spark, folder))
    aligned = programs.align_images([frames, _neighbour(frames, 1)])
    made = programs.run_image_function(aligned, lambda a, b: np.transpose(a - b[::-1], (1, 0, 2)), 2)
    return to_samples(made.where("status = 'ok'"))


@query(
    "sync_playback",
    f"""WITH {_GROUPED}, p AS (SELECT seq_id % 3 AS player_id, max(len) AS longest FROM n GROUP BY 1)
        SELECT p.player_id::INT AS player_id, c.frame, n.seq_id, least(c.frame, n.len) AS shown
        FROM p, unnest(range(1, p.longest + 1)) c(frame), n WHERE n.seq_id % 3 = p.player_id""",
)
def sync_playback(spark, folder):
    """Every sequence of a player at every frame of the player's clock (1-based)."""
    frames = numbered(img(spark, folder)).select("seq_id", "frame")
    player = (F.col("seq_id") % 3).cast("int").alias("player_id")
    sequences = seqs.lengths(frames).select(player, "seq_id", "len")
    clock = frames.select(player, (F.col("frame") + 1).alias("frame")).distinct()
    return seqs.play_in_step(sequences, clock, ["player_id"]).select("player_id", "frame", "seq_id", "shown")


_SEQUENCES = """(SELECT c_custkey AS seq_id, c_nationkey AS player_id, (c_custkey % 11)::INT AS view_id, (1 + c_custkey % 97) AS len,
    (100 + (c_custkey * 37) % 500)::INT AS w FROM customer)"""


def _sequences(spark, folder):
    """Customers as sequences with a player, a view, a length and a width."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("seq_id"),
        F.col("c_nationkey").alias("player_id"),
        (key % 11).cast("int").alias("view_id"),
        (1 + key % 97).alias("len"),
        (100 + (key * 37) % 500).cast("int").alias("w"),
    )


@query("player_bounds", f"SELECT player_id, 1 AS min_frame, max(len) AS max_frame FROM {_SEQUENCES} GROUP BY 1")
def player_bounds_query(spark, folder):
    return player_bounds(_sequences(spark, folder))


@query(
    "rescale_factor",
    f"SELECT seq_id, view_id, w, (max(w) OVER (PARTITION BY view_id)::FLOAT / w::FLOAT)::FLOAT AS factor FROM {_SEQUENCES}",
)
def rescale_factor_query(spark, folder):
    return rescale_factor(_sequences(spark, folder)).select("seq_id", "view_id", "w", "factor")


@query(
    "star_attach",
    f"""SELECT s.seq_id, n.n_name AS player, r.r_name AS colormap, n.n_regionkey AS colormap_id
        FROM {_SEQUENCES} s LEFT JOIN nation n ON n.n_nationkey = s.player_id LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
)
def star_attach(spark, folder):
    """Nations stand for players and regions for colormaps."""
    players = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("player_id"), F.col("n_name").alias("player"), F.col("n_regionkey").alias("colormap_id")
    )
    colormaps = table(spark, folder, "region").select(F.col("r_regionkey").alias("colormap_id"), F.col("r_name").alias("colormap"))
    star = attach_settings(_sequences(spark, folder), [(players, "player_id"), (colormaps, "colormap_id")], ["seq_id"])
    return star.select("seq_id", "player", "colormap", "colormap_id")


_TICKS = """(SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick,
    1 + user_id % 3 AS low, 1 + user_id % 3 + user_id % 10 AS high, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS step FROM events)"""


def _ticks(spark, folder):
    """Each event is one clock tick of its user's player."""
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    ticks = number_rows(events, ["user_id"], ["ts", "event_id"], "tick")
    user = F.col("user_id")
    return ticks.select(
        "event_id",
        "user_id",
        "tick",
        (1 + user % 3).alias("low"),
        (1 + user % 3 + user % 10).alias("high"),
        F.when(user % 2 == 0, 1).otherwise(-1).alias("step"),
    )


def _scheduled(spark, folder, rule):
    ticks = _ticks(spark, folder)
    frame = rule("tick", "low", "low", "high", F.col("step"))
    return ticks.select("event_id", "user_id", "tick", frame.cast("bigint").alias("frame"))


@query(
    "frame_schedule_loop",
    f"""SELECT event_id, user_id, tick, low + ((tick * step) % (high - low + 1) + (high - low + 1)) % (high - low + 1) AS frame FROM {_TICKS}""",
)
def frame_schedule_loop(spark, folder):
    return _scheduled(spark, folder, schedule.looping_frame)


@query(
    "frame_schedule_clamp",
    f"SELECT event_id, user_id, tick, least(high, greatest(low, low + tick * step)) AS frame FROM {_TICKS}",
)
def frame_schedule_clamp(spark, folder):
    return _scheduled(spark, folder, schedule.clamped_frame)


@query(
    "frame_schedule_bounce",
    f"""SELECT event_id, user_id, tick, CASE WHEN high = low THEN low
            WHEN tick % (2 * (high - low)) <= high - low THEN low + tick % (2 * (high - low))
            ELSE high - (tick % (2 * (high - low)) - (high - low)) END AS frame FROM {_TICKS}""",
)
def frame_schedule_bounce(spark, folder):
    return _scheduled(spark, folder, schedule.bouncing_frame)


_CLOCK = """(SELECT event_id, user_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS elapsed FROM events)"""


@query(
    "tick_clock",
    f"""SELECT event_id, user_id, greatest(ceil(elapsed::DOUBLE * 0.25::DOUBLE / 1000000::DOUBLE) - 1, 0)::BIGINT AS tick FROM {_CLOCK}""",
)
def tick_clock(spark, folder):
    """Frame steps emitted since each user's first event, at a quarter frame per second backwards."""
    events = table(spark, folder, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    starts = events.groupBy("user_id").agg(F.min("at").alias("start"))
    met = attach_by_key(events, starts, ["user_id"], ["event_id"])
    return met.select("event_id", "user_id", schedule.ticks_elapsed(F.col("at") - F.col("start"), -0.25).alias("tick"))


@query(
    "sidecar_auto",
    """SELECT page_id, url AS path, coalesce(nullif(regexp_extract(url, '^(.+)\\.[^.]*$', 1), ''), '') || '.svg' AS sidecar,
       EXISTS (SELECT 1 FROM pages p WHERE p.page_id % 2 = 0 AND regexp_extract(p.url, '^(.+)\\.[^.]*$', 1) = regexp_extract(pages.url, '^(.+)\\.[^.]*$', 1)) AS has_sidecar
       FROM pages""",
)
def sidecar_auto(spark, folder):
    """Side-cars exist for the names of even pages."""
    pages = urls(spark, folder)
    existing = pages.where("page_id % 2 = 0").select(sidecar.sidecar_name("path").alias("sidecar"))
    return sidecar.sidecar_by_name(pages, existing).select("page_id", "path", "sidecar", "has_sidecar")


_LISTS = "(SELECT p_size % 10 AS seq_id, p_partkey, row_number() OVER (PARTITION BY p_size % 10 ORDER BY p_partkey) - 1 AS position, p_name || p_partkey AS sidecar FROM part)"


def _lists(spark, folder):
    parts = table(spark, folder, "part").select(
        (F.col("p_size") % 10).alias("seq_id"), "p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("sidecar")
    )
    return number_rows(parts, ["seq_id"], ["p_partkey"], "position").drop("p_partkey")


@query(
    "sidecar_positional",
    f"""WITH d AS {DENSE}, l AS {_LISTS}, n AS (SELECT seq_id, count(*) AS n FROM l GROUP BY 1)
        SELECT d.seq_id, d.source, d.frame, l.sidecar FROM d JOIN n USING (seq_id)
        JOIN l ON l.seq_id = d.seq_id AND l.position = CASE WHEN d.frame < n THEN d.frame ELSE 0 END""",
)
def sidecar_positional(spark, folder):
    """Lists of different lengths; frames past the end of a list get its first entry."""
    frames = numbered(img(spark, folder)).select("seq_id", "source", "frame")
    return sidecar.sidecar_by_position(frames, _lists(spark, folder)).select("seq_id", "source", "frame", "sidecar")


@query(
    "sidecar_after_drop",
    f"""WITH l AS {_LISTS}, n AS (SELECT seq_id, count(*) AS n FROM l GROUP BY 1),
        k AS (SELECT l.*, n.n > 1 AND l.seq_id % 4 < n.n AS hit, l.seq_id % 4 AS cut FROM l JOIN n USING (seq_id))
        SELECT seq_id, CASE WHEN hit AND position > cut THEN position - 1 ELSE position END AS position, sidecar
        FROM k WHERE NOT (hit AND position = cut)""",
)
def sidecar_after_drop(spark, folder):
    lists = _lists(spark, folder)
    dropped = lists.select("seq_id", (F.col("seq_id") % 4).alias("drop_at")).distinct()
    return sidecar.sidecars_after_drop(lists, dropped).select("seq_id", "position", "sidecar")


_OLD = "(SELECT page_id || ':' || url AS path, page_id AS modified, length(html) AS length FROM pages WHERE page_id % 7 <> 3)"
_NEW = """(SELECT page_id || ':' || url AS path, page_id + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS modified,
    length(html) AS length FROM pages WHERE page_id % 6 <> 1)"""
_CHANGES = f"""(SELECT n.path, CASE WHEN o.path IS NULL THEN 'new' ELSE 'modified' END AS change FROM {_NEW} n LEFT JOIN {_OLD} o USING (path)
    WHERE o.path IS NULL OR o.modified <> n.modified OR o.length <> n.length
    UNION ALL SELECT o.path, 'deleted' FROM {_OLD} o LEFT JOIN {_NEW} n USING (path) WHERE n.path IS NULL)"""


def _listings(spark, folder):
    """Two listings of the pages: some vanish, some appear, some are modified."""
    page = F.col("page_id")
    path = F.concat(page.cast("string"), F.lit(":"), "url").alias("path")
    pages = table(spark, folder, "pages").select(path, "page_id", F.length("html").alias("length"))
    old = pages.where(page % 7 != 3).select("path", page.alias("modified"), "length")
    new = pages.where(page % 6 != 1).select("path", (page + F.when(page % 5 == 0, 1).otherwise(0)).alias("modified"), "length")
    return old, new


@query("changed_sources", f"SELECT path, change FROM {_CHANGES}")
def changed_sources(spark, folder):
    return lineage.changed_sources(*_listings(spark, folder))


@query(
    "frames_to_redo",
    f"""WITH u AS (SELECT 'edit:0x-y' || 'image:' || a.page_id || ':' || a.url || 'image:' || b.page_id || ':' || b.url AS derived_key,
              a.page_id || ':' || a.url AS p1, b.page_id || ':' || b.url AS p2 FROM pages a JOIN pages b ON b.page_id = a.page_id + 1)
        SELECT derived_key FROM u WHERE p1 IN (SELECT path FROM {_CHANGES}) OR p2 IN (SELECT path FROM {_CHANGES})""",
)
def frames_to_redo(spark, folder):
    """Edits of two neighbouring pages with a changed input."""
    page = table(spark, folder, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(":"), "url").alias("p1"))
    nxt = page.select((F.col("page_id") - 1).alias("page_id"), F.col("p1").alias("p2"))
    key = lineage.edit_key(lineage.PIXEL_EDIT, F.lit("x-y"), [lineage.image_key("p1"), lineage.image_key("p2")])
    edits = page.join(nxt, "page_id").select(key.alias("derived_key"), F.explode(F.array("p1", "p2")).alias("source_path"))
    return lineage.frames_to_redo(edits, lineage.changed_sources(*_listings(spark, folder)))


@query(
    "lineage_key",
    """SELECT page_id, 'image:' || url AS image, 'video:' || url || ':' || page_id AS video,
       'edit:0x+1' || 'image:' || url || 'video:' || url || ':' || page_id AS edit FROM pages""",
)
def lineage_key(spark, folder):
    image, video = lineage.image_key("path"), lineage.video_key("path", "page_id")
    return urls(spark, folder).select(
        "page_id",
        image.alias("image"),
        video.alias("video"),
        lineage.edit_key(lineage.PIXEL_EDIT, F.lit("x+1"), [image, video]).alias("edit"),
    )


@query(
    "image_by_key",
    """SELECT event_id, 'image:' || (event_id // 2) AS key, p_name AS name FROM events LEFT JOIN part ON p_partkey = event_id // 2""",
)
def image_by_key(spark, folder):
    """Events ask for images by key, every key twice; not every key is known."""
    events, parts = table(spark, folder, "events"), table(spark, folder, "part")
    requests = events.select("event_id", lineage.image_key(F.floor(F.col("event_id") / 2).cast("string")).alias("key"))
    images = parts.select(lineage.image_key(F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("name"))
    return lineage.images_by_key(requests, images).select("event_id", "key", "name")
