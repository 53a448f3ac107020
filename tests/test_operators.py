import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharpfleet.functions import columns as fc
from sharpfleet.functions.quantiles import exact_quantiles
from sharpfleet.operators import evidence as ev
from sharpfleet.operators import focus as fo
from sharpfleet.operators import fusion as fu
from sharpfleet.operators import graph as gr
from sharpfleet.operators import pyramid as py
from sharpfleet.operators import ranking as rk
from sharpfleet.operators import registration as rg
from sharpfleet.operators import resample as rs
from sharpfleet.operators import stencil as st
from sharpfleet.plans import fuse
from sharpfleet.sources import images as im

ID = ["stack_id", "frame", "y", "x"]


def cube(df, v, size, frame=0):
    out = np.full((size, size), np.nan)
    for r in df.filter(F.col("frame") == frame).select("y", "x", v).collect():
        out[r.y, r.x] = r[v]
    return out


def reflect(a, r):
    return np.pad(a, r, mode="reflect")


@pytest.mark.parametrize("side", [7, 16, 64])
def test_blocks_do_not_change_a_box(formula, side):
    px = formula()
    got = cube(st.box(px, {"m": "v"}, 5, side=side), "m", 32)
    p = reflect(cube(px, "v", 32), 5)
    want = np.array([[p[y:y + 11, x:x + 11].mean() for x in range(32)] for y in range(32)])
    assert np.allclose(got, want)


def test_each_pixel_once_after_blocks(formula):
    px = formula(2)
    for side in (5, 8, 64):
        assert st.box(px, {"m": "v"}, 3, side=side).count() == px.count()


def test_disk_against_explicit_kernel(formula):
    px = formula()
    got = cube(st.disk(px, {"m": "v"}, 4, side=10), "m", 32)
    p = reflect(cube(px, "v", 32), 4)
    cells = [(a, b) for a in range(-4, 5) for b in range(-4, 5) if a * a + b * b <= 16]
    want = np.array([[np.mean([p[y + 4 + a, x + 4 + b] for a, b in cells]) for x in range(32)] for y in range(32)])
    assert np.allclose(got, want)


def test_sharp_beats_blurred(formula):
    px = formula()
    soft = st.gaussian(px, {"v": F.col("v").cast("double")}, 2.0)
    for m in fo.METHODS:
        a = fo.focus_measure(px, m).agg(F.avg("e")).first()[0]
        b = fo.focus_measure(soft, m).agg(F.avg("e")).first()[0]
        assert a > b


def test_pyramid_collapses_to_the_image(formula):
    px = formula()
    back = py.collapse(py.pyramid(px, ["v"], depth=4), ["v"], ("frame",), depth=4)
    diff = back.withColumnRenamed("v", "_v").join(px, ID).agg(F.max(F.abs(F.col("_v") - F.col("v")))).first()[0]
    assert diff < 1e-9


def test_odd_sizes_survive_the_pyramid(formula):
    px = formula(1, 27, 2)
    back = py.collapse(py.pyramid(px, ["v"], depth=3), ["v"], ("frame",), depth=3)
    assert back.count() == 27 * 27 * 2
    assert back.withColumnRenamed("v", "_v").join(px, ID).agg(F.max(F.abs(F.col("_v") - F.col("v")))).first()[0] < 1e-9


def colour(px):
    return px.withColumns({"b": F.col("v"), "g": (F.col("v") * 3) % 256, "r": 255 - F.col("v")})


def test_weights_sum_to_one(formula):
    w = fu.guided_weights(colour(formula()))
    lo, hi, least = w.groupBy("y", "x").agg(F.sum("wt").alias("s"), F.min("wt").alias("m")).agg(F.min("s"), F.max("s"), F.min("m")).first()
    assert lo > 0.99999 and hi < 1.00001 and least >= 0


def test_all_usable_changes_nothing(formula):
    px = colour(formula(1, 16, 3))
    a = fu.guided_weights(px).select(*ID, "wt")
    b = fu.guided_weights(px.withColumn("ok", F.lit(True)), usable="ok").select(*ID, F.col("wt").alias("w2"))
    assert a.join(b, ID).agg(F.max(F.abs(F.col("wt") - F.col("w2")))).first()[0] < 1e-6


def test_equal_frames_fuse_to_themselves(formula):
    px = colour(formula(1, 16, 1)).drop("frame").withColumn("frame", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    want = px.filter("frame = 0").select("stack_id", "y", "x", *[F.col(c).alias(f"_{c}") for c in "bgr"])
    for method, kw in (("max", {}), ("decision", {}), ("pyramid", {"depth": 3})):
        got = fuse.run(px, method, **kw)
        off = got.join(want, ["stack_id", "y", "x"]).agg(*[F.max(F.abs(F.col(c) - F.col(f"_{c}"))) for c in "bgr"]).first()
        assert max(off) <= 1, method


def test_bad_stacks_are_reported(spark):
    rows = [(1, 0, 8, 8, True), (1, 1, 8, 8, True), (2, 0, 8, 8, True), (3, 0, 8, 8, True), (3, 1, 8, 9, True), (4, 0, 8, 8, True), (4, 1, 8, 8, False)]
    s = {r.stack_id: r.reason for r in ev.stack_status(spark.createDataFrame(rows, "stack_id long, frame int, h int, w int, readable boolean")).collect()}
    assert s == {1: "", 2: "fewer than two frames", 3: "frames differ in size", 4: "unreadable frame"}


def test_quantiles_of_a_hot_key(spark):
    df = spark.range(60_000).select((F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7 + 1)).alias("k"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    got = {r.k: (r.a, r.b, r.c) for r in exact_quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.35, "c": 0.99}).collect()}
    pdf = df.toPandas()
    for k, g in pdf.groupby("k"):
        assert np.allclose(got[k], np.quantile(g.v, [0.0, 0.35, 0.99]))


def test_quantiles_with_ties(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 10 < 9, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    r = exact_quantiles(df, ["k"], "v", {"m": 0.5, "n": 0.95}).first()
    assert np.allclose((r.m, r.n), np.quantile(df.toPandas().v, [0.5, 0.95]))


def test_shift_is_recovered(formula):
    px = formula(1, 24, 1).drop("frame")
    moved = px.withColumns({"x": F.col("x") + 2, "y": F.col("y") - 1, "frame": F.lit(1)}).filter("x < 24 AND y >= 0")
    both = px.withColumn("frame", F.lit(0)).unionByName(moved)
    r = rg.translation(rg.shift_scores(both, 0, 3, F.lit(0)), 10).first()
    assert (round(r.dx), round(r.dy)) == (2, -1) and r.response > 0.999


def test_shift_above_the_limit_is_refused(formula):
    px = formula(1, 24, 1).drop("frame")
    both = px.withColumn("frame", F.lit(0)).unionByName(px.withColumns({"x": F.col("x") + 3, "frame": F.lit(1)}).filter("x < 24"))
    assert rg.translation(rg.shift_scores(both, 0, 3, F.lit(0)), 1.0).first().dx is None


def test_identity_warp_keeps_pixels(formula):
    px = formula(1, 16, 2)
    m = px.select("stack_id", "frame").distinct().withColumn("m", F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0)]))
    got = rs.warp(px, m, ["v"], side=5)
    bad = got.withColumnRenamed("v", "_v").join(px, ID).filter("abs(_v - v) > 1e-9 OR NOT valid")
    assert got.count() == px.count() and bad.isEmpty()


def test_crop_of_a_shifted_frame(spark):
    size = spark.range(120).select(F.col("id").cast("int").alias("y")).crossJoin(spark.range(160).select(F.col("id").cast("int").alias("x")))
    ok = size.withColumns({"stack_id": F.lit(0), "ok": (F.col("x") >= 14) & (F.col("y") < 111)})
    r = rk.largest_rectangle(ok, "ok").first()
    assert (r.y1 - r.y0, r.x1 - r.x0) == (111, 146)


def test_long_snake_is_one_component(spark):
    cells = []
    for row in range(0, 21, 2):
        cells += [(0, 0, row, x) for x in range(20)]
        if row < 20:
            cells.append((0, 0, row + 1, 19 if row % 4 == 0 else 0))
    df = spark.createDataFrame(cells, "stack_id int, frame int, y int, x int")
    assert gr.components(df).select("label").distinct().count() == 1


def test_hull_of_a_square(spark):
    pts = spark.createDataFrame([(0, float(x), float(y)) for x in range(5) for y in range(5)], "stack_id int, x double, y double")
    h = gr.hull(pts, ["stack_id"])
    assert h.first().area == 16.0
    probe = spark.createDataFrame([(0, 2.0, 2.0), (0, 4.0, 4.0), (0, 5.0, 2.0)], "stack_id int, x double, y double")
    assert gr.in_hull(probe, h, ["stack_id"]).count() == 2


def test_solvers(spark):
    r = spark.range(1).select(*[c.alias(n) for c, n in zip(fc.solve3([[F.lit(2.0), F.lit(1.0), F.lit(0.0)], [F.lit(1.0), F.lit(3.0), F.lit(1.0)], [F.lit(0.0), F.lit(1.0), F.lit(4.0)]], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]), "abc")]).first()
    assert np.allclose(tuple(r), np.linalg.solve([[2, 1, 0], [1, 3, 1], [0, 1, 4]], [1, 2, 3]))


def png(path, w, h, rgb):
    raw = b"".join(b"\x00" + bytes(rgb(x, y)[i] for x in range(w) for i in range(3)) for y in range(h))
    part = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_image_files(spark, tmp_path):
    for folder, n, w in (("one", 3, 6), ("two", 1, 6)):
        (tmp_path / folder).mkdir()
        for k in range(n):
            png(tmp_path / folder / f"f{k}.png", w, 4, lambda x, y, k=k: (10 + x, 20 + y, 30 + k))
    (tmp_path / "one" / "note.txt").write_text("no image")
    frames = im.read_frames(spark, str(tmp_path))
    assert frames.count() == 4
    px = im.frame_pixels(frames)
    row = px.filter("frame = 2 AND y = 1 AND x = 5").first()
    assert (row.b, row.g, row.r) == (32, 21, 15)
    assert px.count() == 4 * 24
    assert {r.frames: r.status for r in ev.stack_status(frames).collect()} == {3: "ok", 1: "refused"}
    good, _ = fuse.accepted(px)
    assert good.count() == 3 * 24
    assert im.list_images(spark, str(tmp_path)).count() == 4


def test_lineage_cut_uses_the_named_folder(spark):
    from sharpfleet.runtime import cut
    df = cut(spark.range(10).withColumn("a", F.col("id") + 1))
    assert df.agg(F.sum("a")).first()[0] == 55
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
