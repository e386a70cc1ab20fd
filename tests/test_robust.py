"""Odd inputs: NULL keys, outliers, images of different size, unknown schemes, long headers."""

import io

import numpy as np

from frameloom.functions.numeric import megabytes
from frameloom.operators.histogram import count_bins
from frameloom.operators.programs import run_scalar_program
from frameloom.operators.search import find_paths, may_match
from frameloom.operators.spread import attach_by_key, hot_join, number_rows
from frameloom.sources.ingest import read_files
from frameloom.sources.listing import list_sources


def test_null_keys_are_numbered_and_joined(table):
    rows = table("k string, i int", [(None, 1), (None, 2), ("a", 3), ("a", 4)])
    assert sorted((r["i"], r["frame"]) for r in number_rows(rows, ["k"], ["i"]).collect()) == [(1, 0), (2, 1), (3, 0), (4, 1)]
    dim = table("k string, v int", [(None, 7), ("a", 8)])
    for joined in (attach_by_key(rows, dim, ["k"], ["i"]), hot_join(rows, dim, ["k"], ["i"], hot_rows=1), hot_join(rows, dim, ["k"], ["i"])):
        assert sorted((r["i"], r["v"]) for r in joined.collect()) == [(1, 7), (2, 7), (3, 8), (4, 8)]


def test_outliers_do_not_overflow_bins(table):
    rows = [(0, 0, 0, v, -1.0, 1.0) for v in (-1.0, 0.0, 1.0, 1e12, -1e30)] + [(0, 1, 0, v, -3e38, 3e38) for v in (-3e38, 0.0, 3e38)]
    samples = table("seq_id int, frame int, band int, v float, low float, high float", rows)
    got = {(r["frame"], r["bin"]): r["n"] for r in count_bins(samples).collect()}
    assert got == {(0, 0): 1, (0, 127): 1, (0, 255): 1, (1, 0): 1, (1, 127): 1, (1, 255): 1}


def test_programs_on_images_of_different_size(table):
    schema = "seq_id int, frame int, w_1 int, h_1 int, c_1 int, pixels_1 array<float>, w_2 int, h_2 int, c_2 int, pixels_2 array<float>"
    aligned = table(schema, [(0, 0, 3, 2, 1, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], 2, 2, 1, [10.0, 20.0, 30.0, 40.0])])
    got = {(r["y"], r["x"]): r["v"] for r in run_scalar_program(aligned, "x1 + x2", 2).collect()}
    assert got == {(0, 0): 10.0, (0, 1): 21.0, (0, 2): None, (1, 0): 33.0, (1, 1): 44.0, (1, 2): None}


def test_unknown_schemes_stay_as_missing(table):
    lines = table("line_no long, expression string", [(0, "gopher://x/*.png"), (1, "/nonexistent/y.png")])
    assert {r["line_no"] for r in list_sources(lines, "expression").collect()} == {0, 1}


def test_long_npy_headers_are_read(table, tmp_path):
    out = io.BytesIO()
    np.save(out, np.arange(6, dtype="<f4").reshape(2, 3))
    plain = out.getvalue()
    text = plain[10 : plain.index(b"}") + 1].ljust(6000 - 11) + b"\n"
    (tmp_path / "a.npy").write_bytes(plain[:8] + len(text).to_bytes(2, "little") + text + plain[-24:])
    got = read_files(table("k int, path string", [(1, str(tmp_path / "a.npy"))]), ["k"]).first()
    assert got["status"] == "ok" and got["pixels"] == [0, 1, 2, 3, 4, 5]


def test_literals_and_patterns_that_once_failed(spark, table):
    sizes = table("t string", [("1.2.3GB",), ("2MB",), ("..KB",)]).select(megabytes("t").alias("v"))
    assert [r["v"] for r in sizes.collect()] == [None, 2.0, None]
    names = table("path string, k int", [("a" * 3000, 1), ("xaaaaaab", 2), ("xaaaaaab", 1), ("A^.b", 3)])
    assert names.where(may_match("path", "aaaaaab")).count() == 2 and names.where(may_match("path", "^.")).count() == 1
    assert [r["k"] for r in find_paths(names, "aaaaaab", 0, 9).collect()] == [1, 2]
