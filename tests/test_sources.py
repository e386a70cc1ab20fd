"""Listing, sniffing, decoding and archives on generated files."""

import io
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import collections
from frameloom.sinks.export import array_files
from frameloom.sources import codecs, frame_index, ingest, listing
from frameloom.sources.archive import members, ordered_members, zip_bytes


@pytest.fixture
def tree(tmp_path):
    for name in (
        "img1.png", "img02.png", "img2.png", "img10.png", "img100.png", "_under.png", ".hidden.png",
        "a/x.png", "a-b.png", "a2/y1.png", "a10/y.png", ".git/no.png", "a/deep/er/z3.png", "a/deep/er/z20.png", "b.txt",
    ):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    return tmp_path


def _paths(df, root):
    return [os.path.relpath(r.path, root) for r in df.orderBy("frame").collect()]


def test_glob_is_in_natural_order(spark, tree):
    got = _paths(listing.list_expression(spark, f"{tree}/img*.png"), tree)
    assert got in (
        ["img1.png", "img02.png", "img2.png", "img10.png", "img100.png"],
        ["img1.png", "img2.png", "img02.png", "img10.png", "img100.png"],
    )


def test_braces_and_stars_in_folders(spark, tree):
    assert _paths(listing.list_expression(spark, f"{tree}/a{{2,10}}/y*.png"), tree) == ["a2/y1.png", "a10/y.png"]
    assert _paths(listing.list_expression(spark, f"{tree}/a?/y[0-9].png"), tree) == ["a2/y1.png"]


def test_directory_is_walked_level_by_level(spark, tree):
    got = _paths(listing.list_expression(spark, str(tree)), tree)
    assert got == [
        "_under.png", "a/deep/er/z3.png", "a/deep/er/z20.png", "a/x.png", "a2/y1.png", "a10/y.png", "a-b.png", "b.txt",
        "img1.png", "img02.png", "img2.png", "img10.png", "img100.png",
    ]


def test_concatenation_keeps_order_and_duplicates(spark, tree):
    one = _paths(listing.list_expression(spark, f"{tree}/a"), tree)
    two = _paths(listing.list_expression(spark, f"{tree}/img1*.png"), tree)
    both = _paths(listing.list_expression(spark, f"{tree}/a::{tree}/img1*.png::{tree}/a"), tree)
    assert both == one + two + one


def test_no_match_stays_as_missing_path(spark, tree):
    rows = listing.list_expression(spark, f"{tree}/nothing*.png::{tree}/b.txt::-").orderBy("frame").collect()
    assert [(os.path.basename(r.path), r.status) for r in rows] == [
        ("nothing*.png", "missing"), ("b.txt", "ok"), ("-", "missing"),
    ]


def test_symlinked_folder_is_followed(spark, tree):
    os.symlink(tree / "a2", tree / "a10" / "link")
    assert _paths(listing.list_expression(spark, f"{tree}/a10"), tree) == ["a10/link/y1.png", "a10/y.png"]


def test_list_from_text_file(spark, tree):
    source = tree / "list.lst"
    source.write_text(f"{tree}/img10*.png\n\n{tree}/a2::{tree}/b.txt\n{tree}/gone.png\n")
    rows = listing.list_from_file(spark, str(source)).orderBy("frame").collect()
    assert [os.path.basename(r.path) for r in rows] == ["img10.png", "img100.png", "y1.png", "b.txt", "gone.png"]
    assert [r.frame for r in rows] == list(range(5))


def test_archives_in_a_folder_are_opened(spark, tmp_path):
    video = np.arange(48, dtype=np.float32).reshape(3, 2, 4, 2)
    (tmp_path / "b.zip").write_bytes(
        zip_bytes([("d/f10.npy", codecs.npy_bytes(video)), ("d/", b""), ("d/f9.png", codecs.png_bytes(np.full((2, 4, 2), 3, np.uint8)))])
    )
    (tmp_path / "a.vpp").write_bytes(codecs.vpp_bytes(video[:1]))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    rows = listing.list_expression(spark, str(tmp_path)).orderBy("frame").collect()
    assert [os.path.relpath(r.path, tmp_path) for r in rows] == ["a.vpp", "b.zip!/d/f9.png", "b.zip!/d/f10.npy", "c.zip"]
    line = spark.createDataFrame([(0, str(tmp_path))], "line_no bigint, expression string")
    frames = ingest.load_sequences(line).orderBy("frame").collect()
    assert [(r.frame, r.status) for r in frames] == [(0, "ok"), (1, "ok"), (2, "ok"), (3, "ok"), (4, "ok"), (5, "unsupported")]
    np.testing.assert_array_equal(np.array(frames[4].pixels, np.float32), video[2].reshape(-1))


def test_paths_keep_their_scheme(spark, tree):
    rows = listing.list_expression(spark, f"file://{tree}/a2::file://{tree}/img1.png::file://{tree}/i*2.png").orderBy("frame").collect()
    assert [r.path for r in rows][:2] == [f"file://{tree}/a2/y1.png", f"file://{tree}/img1.png"]
    assert {r.path for r in rows[2:]} == {f"file://{tree}/img02.png", f"file://{tree}/img2.png"}


def test_a_file_named_twice_is_listed_twice(spark, tree):
    rows = listing.list_expression(spark, f"{tree}/{{b.txt,a-b.png,b.txt}}").orderBy("frame").collect()
    assert [os.path.basename(r.path) for r in rows] == ["a-b.png", "b.txt", "b.txt"]


def _decode(spark, **files):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "name string, content binary")
    return ingest.decode_content(df, ["name"])


def _arrays(decoded):
    return {
        (r.name, r.local_frame): np.array(r.pixels, np.float32).reshape(r.h, r.w, r.c)
        for r in decoded.where("status = 'ok'").collect()
    }


@pytest.mark.parametrize("dtype", ["uint8", "uint16"])
@pytest.mark.parametrize("bands", [1, 2, 3, 4])
def test_png_depths(spark, dtype, bands):
    image = np.random.default_rng(bands).integers(0, np.iinfo(dtype).max, (5, 7, bands)).astype(dtype)
    got = _arrays(_decode(spark, a=codecs.png_bytes(image)))
    np.testing.assert_array_equal(got[("a", 0)], image.astype(np.float32))


def _chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def _png(w, h, depth, colour, rows, extra=b"", interlace=0):
    header = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)
    return codecs.PNG_SIGNATURE + _chunk(b"IHDR", header) + extra + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def _filtered(image, kinds):
    """Encode 8-bit rows with the given filter per row, byte by byte."""
    h, w, c = image.shape
    raw = image.reshape(h, w * c).astype(int)
    out = b""
    for y in range(h):
        line = bytes([kinds[y]])
        for i in range(w * c):
            left = raw[y, i - c] if i >= c else 0
            up = raw[y - 1, i] if y else 0
            corner = raw[y - 1, i - c] if y and i >= c else 0
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(p - v))
            guess = [0, left, up, (left + up) // 2, paeth][kinds[y]]
            line += bytes([(raw[y, i] - guess) % 256])
        out += line
    return out


def test_png_row_filters():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (23, 9, 3)).astype(np.uint8)
    kinds = rng.integers(0, 5, 23)
    got = codecs.png_array(_png(9, 23, 8, 2, _filtered(image, kinds)))
    np.testing.assert_array_equal(got, image)


def test_png_palette_and_transparency():
    palette = _chunk(b"PLTE", bytes([10, 20, 30, 40, 50, 60, 70, 80, 90]))
    rows = b"\x00\x00\x01\x02" + b"\x00\x02\x01\x00"
    plain = codecs.png_array(_png(3, 2, 8, 3, rows, palette))
    assert plain.shape == (2, 3, 3) and plain[0, 2].tolist() == [70, 80, 90]
    clear = codecs.png_array(_png(3, 2, 8, 3, rows, palette + _chunk(b"tRNS", bytes([0, 128]))))
    assert clear.shape == (2, 3, 4) and clear[0, :, 3].tolist() == [0, 128, 255]
    gray = codecs.png_array(_png(3, 1, 8, 0, b"\x00\x05\x06\x07", _chunk(b"tRNS", struct.pack(">H", 6))))
    assert gray[0].tolist() == [[5, 255], [6, 0], [7, 255]]


def test_png_small_depths_are_stretched():
    one = codecs.png_array(_png(8, 1, 1, 0, b"\x00" + bytes([0b10110001])))
    assert one[0, :, 0].tolist() == [255, 0, 255, 255, 0, 0, 0, 255]
    two = codecs.png_array(_png(4, 1, 2, 0, b"\x00" + bytes([0b00011011])))
    assert two[0, :, 0].tolist() == [0, 85, 170, 255]
    four = codecs.png_array(_png(3, 1, 4, 0, b"\x00" + bytes([0x0F, 0x70])))
    assert four[0, :, 0].tolist() == [0, 255, 119]


@pytest.mark.parametrize("w, h", [(1, 1), (5, 3), (9, 17)])
def test_png_interlaced(w, h):
    image = np.random.default_rng(w).integers(0, 256, (h, w, 2)).astype(np.uint8)
    rows = b""
    for x0, y0, dx, dy in codecs.PNG_PASSES:
        part = image[y0::dy, x0::dx]
        if part.size:
            rows += _filtered(part, [y % 5 for y in range(part.shape[0])])
    np.testing.assert_array_equal(codecs.png_array(_png(w, h, 8, 4, rows, interlace=1)), image)


def test_bad_files_become_errors_and_siblings_continue(spark):
    good = codecs.png_bytes(np.arange(12, dtype=np.uint8).reshape(3, 4, 1))
    broken = good[:40] + bytes([good[40] ^ 1]) + good[41:]
    decoded = _decode(
        spark, good=good, cut=good[:-30], head=good[:20], broken=broken, text=b"hello", empty=b"",
        fortran=_npy(np.asfortranarray(np.ones((3, 4)))), objects=_npy(np.array([["a", "b"]])),
    )
    state = {r.name: r.status for r in decoded.collect()}
    assert state == {
        "good": "ok", "cut": "error", "head": "error", "broken": "error", "text": "unsupported",
        "empty": "unsupported", "fortran": "error", "objects": "error",
    }
    bad = ingest.quarantine(decoded)
    assert bad.columns == ["name", "local_frame", "status", "error"]
    assert bad.where("error is null").count() == 0 and bad.count() == 7


def _npy(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


@pytest.mark.parametrize(
    "shape, frames",
    [((4, 5), (1, 4, 5, 1)), ((6, 5, 3), (1, 6, 5, 3)), ((6, 5, 5), (6, 5, 5, 1)), ((2, 5, 6), (2, 5, 6, 1)), ((2, 3, 4, 5), (2, 3, 4, 5))],
)
@pytest.mark.parametrize("dtype", ["uint8", ">u2", "float32", "float64", "bool"])
def test_npy_shapes(spark, shape, frames, dtype):
    data = np.random.default_rng(1).integers(0, 2, shape).astype(dtype)
    got = _arrays(_decode(spark, a=_npy(data)))
    want = data.reshape(frames).astype(np.float32)
    assert len(got) == frames[0]
    for i in range(frames[0]):
        np.testing.assert_array_equal(got[("a", i)], want[i])


def test_our_npy_files_are_readable_by_numpy():
    data = np.random.default_rng(2).normal(size=(3, 4, 5, 2)).astype(np.float32)
    np.testing.assert_array_equal(np.load(io.BytesIO(codecs.npy_bytes(data))), data)


def test_vpp_ignores_a_cut_last_frame(spark):
    data = np.random.default_rng(4).normal(size=(3, 2, 5, 2)).astype(np.float32)
    got = _arrays(_decode(spark, a=codecs.vpp_bytes(data)[:-4]))
    assert len(got) == 2
    np.testing.assert_array_equal(got[("a", 1)], data[1])


def test_files_are_read_by_seeking_in_ranges(spark, tmp_path):
    video = np.random.default_rng(6).normal(size=(11, 3, 4, 2)).astype(np.float32)
    (tmp_path / "v10.npy").write_bytes(_npy(video))
    (tmp_path / "v9.vpp").write_bytes(codecs.vpp_bytes(video[:4]))
    (tmp_path / "v1.png").write_bytes(codecs.png_bytes(np.full((3, 4, 1), 7, np.uint8)))
    (tmp_path / "v11.png").write_bytes(b"\x89PNGnot")
    line = spark.createDataFrame([(5, f"{tmp_path}/v*::{tmp_path}/gone.npy")], "line_no bigint, expression string")
    frames = ingest.load_sequences(line)
    rows = frames.orderBy("frame").collect()
    assert [r.frame for r in rows] == list(range(1 + 4 + 11 + 1 + 1)) and {r.seq_id for r in rows} == {5}
    assert [r.status for r in rows] == ["ok"] * 16 + ["error"] * 2
    for k in range(4):
        np.testing.assert_array_equal(np.array(rows[1 + k].pixels, np.float32), video[k].reshape(-1))
    paths = spark.createDataFrame([(str(tmp_path / "v10.npy"),)], "path string").withColumn("k", F.lit(1))
    cut = ingest.read_files(paths, ["k"], range_bytes=2 * 3 * 4 * 2 * 4)
    got = sorted(cut.collect(), key=lambda r: r.local_frame)
    assert len(got) == 11
    for k, r in enumerate(got):
        np.testing.assert_array_equal(np.array(r.pixels, np.float32), video[k].reshape(-1))


def test_jpeg_and_png_through_the_image_reader(spark, tmp_path):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(6, 4, 1)
    for x in range(6):
        for y in range(4):
            picture.setRGB(x, y, 0xC83214)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "p.jpg")))
    (tmp_path / "q.png").write_bytes(codecs.png_bytes(np.dstack([np.full((4, 6), v, np.uint8) for v in (200, 50, 20)])))
    (tmp_path / "r.jpg").write_bytes(b"\xff\xd8\xffbroken")
    rows = {os.path.basename(r.path): r for r in ingest.read_images(spark, str(tmp_path)).collect()}
    assert rows["r.jpg"].status == "error" and rows["r.jpg"].w is None
    for name, slack in (("p.jpg", 6), ("q.png", 0)):
        r = rows[name]
        assert (r.w, r.h, r.c, r.status) == (6, 4, 3, "ok")
        image = np.array(r.pixels).reshape(4, 6, 3)
        assert np.abs(image - [200, 50, 20]).max() <= slack


def test_array_files_are_cut_into_chunks(spark):
    video = np.random.default_rng(8).normal(size=(10, 3, 4, 1)).astype(np.float32)
    frames = ingest.frames_from_arrays(spark, video, video[:1] * 2)
    files = array_files(frames, "npy", chunk_bytes=4 * 3 * 4 * 4).orderBy("seq_id", "chunk").collect()
    assert [(r.seq_id, r.chunk, r.first_frame, r.n) for r in files] == [(0, 0, 0, 4), (0, 1, 4, 4), (0, 2, 8, 2), (1, 0, 0, 1)]
    np.testing.assert_array_equal(np.load(io.BytesIO(bytes(files[1].content))), video[4:8])


def test_archive_members_in_natural_order(spark):
    data = zip_bytes([("d/f10.png", b"1"), ("d/", b""), ("d/f9.png", b"22"), ("d/f1.png", b"333")])
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("only", b"4" * 1000)
    df = spark.createDataFrame(
        [(1, bytearray(data)), (2, bytearray(other.getvalue())), (3, bytearray(b"no zip"))], "k int, content binary"
    )
    found = members(df, ["k"])
    assert [r.k for r in found.where("status = 'error'").collect()] == [3]
    got = ordered_members(found, ["k"]).orderBy("k", "frame").collect()
    assert [(r.k, r.frame, r.member, len(r.content)) for r in got] == [
        (1, 0, "d/f1.png", 3), (1, 1, "d/f9.png", 2), (1, 2, "d/f10.png", 1), (2, 0, "only", 1000),
    ]


def _jpeg(spark, path, rgb):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(6, 4, 1)
    for x in range(6):
        for y in range(4):
            picture.setRGB(x, y, rgb)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(path)))


def test_jpegs_are_frames_of_a_sequence(spark, tmp_path):
    _jpeg(spark, tmp_path / "f1.jpg", 0xC83214)
    _jpeg(spark, tmp_path / "f10.jpeg", 0x0A0A0A)
    (tmp_path / "f2.png").write_bytes(codecs.png_bytes(np.full((4, 6, 3), 9, np.uint8)))
    (tmp_path / "f3.jpg").write_bytes(b"\xff\xd8\xffbroken")
    (tmp_path / "other.jpg").write_bytes(b"\xff\xd8\xffnot asked for")
    line = spark.createDataFrame([(0, f"{tmp_path}/f*::{tmp_path}/f1.jpg")], "line_no bigint, expression string")
    rows = ingest.load_sequences(line).orderBy("frame").collect()
    assert [(r.frame, r.status) for r in rows] == [(0, "ok"), (1, "ok"), (2, "error"), (3, "ok"), (4, "ok")]
    for k, want in ((0, [200, 50, 20]), (1, [9, 9, 9]), (3, [10, 10, 10]), (4, [200, 50, 20])):
        assert (rows[k].w, rows[k].h, rows[k].c) == (6, 4, 3)
        assert np.abs(np.array(rows[k].pixels).reshape(4, 6, 3) - want).max() <= 6


def test_an_index_decodes_each_frame_once(spark, tmp_path):
    video = np.random.default_rng(9).normal(size=(40, 3, 4, 1)).astype(np.float32)
    for k in range(4):
        (tmp_path / f"a{k}.npy").write_bytes(_npy(video[10 * k : 10 * k + 10]))
    (tmp_path / "b.png").write_bytes(codecs.png_bytes(np.full((3, 4, 1), 5, np.uint8)))
    (tmp_path / "cut.npy").write_bytes(_npy(video[:3])[:-20])
    lines = [(0, f"{tmp_path}/a*.npy"), (1, f"{tmp_path}/b.png"), (2, f"{tmp_path}/cut.npy::{tmp_path}/gone.npy")]
    index = frame_index.index_sequences(spark.createDataFrame(lines, "line_no bigint, expression string")).cache()
    assert [r["n"] for r in index.groupBy("seq_id").agg(F.count("*").alias("n")).orderBy("seq_id").collect()] == [40, 1, 4]
    assert index.where("seq_id = 0 AND frame = 13").select("place.*").first()["offset"] == 128 + 3 * 48

    def of(k):
        return index.where(F.col("seq_id") == k).withColumn("seq_id", F.lit(0))

    aligned = collections.align([of(0), collections.shift(of(0), -1), of(1)], ["place"])
    reads = spark.sparkContext.accumulator(0)
    tasks = frame_index.tasks_for(spark, 0)
    rows = frame_index.fetch_aligned(aligned, 3, reads=reads).orderBy("frame").collect()
    assert len(rows) == 41 and 41 <= reads.value <= 41 + 2 * tasks  # 40 frames and one picture, and once more where tasks meet
    for r in rows:
        np.testing.assert_array_equal(np.array(r.pixels_1, np.float32), video[min(r.frame, 39)].reshape(-1))
        np.testing.assert_array_equal(np.array(r.pixels_2, np.float32), video[max(r.frame - 1, 0)].reshape(-1))
        assert set(r.pixels_3) == {5.0} and r.status_1 == r.status_2 == r.status_3 == "ok"
    failed = frame_index.fetch(of(2), ["seq_id"]).orderBy("frame").collect()
    assert [r.status for r in failed] == ["ok", "ok", "error", "error"]
    assert frame_index.fetch(of(7), ["seq_id"]).count() == 0
