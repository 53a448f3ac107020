"""No silent caps: deep images, radii beyond the image, relations with gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharpfleet.operators import evidence as ev
from sharpfleet.operators import focus as fo
from sharpfleet.operators import fusion as fu
from sharpfleet.operators import grid
from sharpfleet.operators import pyramid as py
from sharpfleet.operators import stencil as st
from sharpfleet.operators import surfaces as sf


def test_deeper_images_than_planned_are_an_error(formula):
    with pytest.raises(Exception, match="pyramid levels"):
        py.pyramid(formula(size=32), ["v"], depth=3).count()


def test_requested_depth_beyond_the_usual_one_has_a_base(formula):
    px = formula(size=256, frames=1)
    top = py.pyramid(px, ["v"], levels=7).agg(F.max("level"), F.max("levels"), F.count(F.when(F.col("level") == F.col("levels"), 1))).first()
    assert tuple(top) == (7, 7, 4)


def test_fusion_does_not_depend_on_the_planned_depth(formula):
    from sharpfleet.operators import evidence as ev
    from sharpfleet.sources import derived as d

    px = ev.with_gray(d.colour(formula(size=32, frames=3)))
    rows = [sorted(map(tuple, fu.fuse_pyramid(px, depth=n).collect())) for n in (4, 5)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("r", [1, 5, 9, 20])
def test_box_equals_numpy_at_any_radius(formula, r):
    px = formula(size=8, frames=1)
    image = np.zeros((8, 8))
    for p in px.collect():
        image[p["y"], p["x"]] = p["v"]
    wide = np.pad(image, r, mode="reflect")
    got = {(p["y"], p["x"]): p["m"] for p in st.box(px, {"m": "v"}, r).collect()}
    for y in range(8):
        for x in range(8):
            assert abs(got[y, x] - wide[y : y + 2 * r + 1, x : x + 2 * r + 1].mean()) < 1e-9


@pytest.mark.parametrize("r", [2, 3, 4, 6])
def test_missing_pixels_count_as_zero_at_any_radius(formula, r):
    px = formula(size=16, frames=1).filter("NOT (x = 7 AND y = 9) AND NOT (x = 3)")
    image = np.zeros((16, 16))
    for p in px.collect():
        image[p["y"], p["x"]] = p["v"]
    wide = np.pad(image, r, mode="reflect")
    for p in st.box(px, {"s": "v"}, r, mean=False).collect():
        y, x = p["y"], p["x"]
        lines = [sum(wide[y + k + r, x : x + 2 * r + 1]) for k in range(-r, r + 1)]
        have = [0 if (x == 7 and yy == 9) else 1 for yy in np.pad(np.arange(16), r, mode="reflect")[y : y + 2 * r + 1]]
        assert abs(p["s"] - sum(a for a, h in zip(lines, have) if h)) < 1e-9


def test_sorts_ask_for_a_number_of_tasks(spark):
    """An explicit number of partitions, which adaptive execution does not pack, for blocks, ranks and fields."""
    from sharpfleet.operators import grid
    from sharpfleet.operators import metrics as me
    from sharpfleet.operators import resample as rs

    n = grid.TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    px = spark.range(64).selectExpr("id div 16 AS stack_id", "0 AS frame", "cast(id div 4 % 4 AS int) AS y", "cast(id % 4 AS int) AS x", "4 AS h", "4 AS w", "cast(id % 5 AS double) AS v", "cast(id % 3 AS double) AS u", "cast(id % 2 AS int) AS piece")
    m = px.select("stack_id", "frame", "piece").distinct().withColumn("m", F.expr("array(1D, 0D, cast(piece AS double), 0D, 1D, 0D)"))
    plans = [grid.Blocks(1).open(px), me.spearman(px, ["stack_id"], "v", "u"), rs.piecewise_field(px.drop("frame"), m), rs.blend_fields(px.withColumnsRenamed({"piece": "region", "v": "wt"}), m.withColumnRenamed("piece", "region"))]
    for d in plans:
        assert f", {n}), REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString()
    assert me.spearman(px, [], "v", "u").count() == 1


def boundary_in_parts(px, sigmas, k=9):
    """The definition, each part by its own operator."""
    g = []
    for s in sigmas:
        d, src = (st.gaussian(px, {"_s": "gray"}, s), "_s") if s else (px, "gray")
        g.append(ev.robust_normalize(st.gradient_magnitude(d, src, "_g").groupBy("stack_id", "y", "x").agg(F.max("_g").alias("_g")), "_g", out=f"_g{s}").drop("_g"))
    win = fo.winner(fo.content_aware(px, "gray", 8.0, k, "_e"), "_e").withColumn("winner", F.col("winner").cast("double"))
    win = win.join(px.filter("frame = 0").select("stack_id", "y", "x", "h", "w"), ["stack_id", "y", "x"])
    c = st.box(st.gradient_magnitude(win, "winner", "_c", by=()), {"_c": (F.col("_c") > 0).cast("double")}, 4, ())
    z = st.gradient_magnitude(fu.depth_from_focus(px, "gray"), "depth", "_z", by=())
    out = ev.robust_normalize(c, "_c", out="_c").select("stack_id", "y", "x", "_c").join(ev.robust_normalize(z, "_z", out="_z").select("stack_id", "y", "x", "_z"), ["stack_id", "y", "x"])
    for d in g:
        out = out.join(d, ["stack_id", "y", "x"])
    edges = F.greatest(*[F.col(f"`_g{s}`") for s in sigmas])
    return out.select("stack_id", "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * edges + 0.25 * F.col("_c") + 0.4 * F.col("_z"))).alias("boundary"))


def test_stack_boundary_goes_over_the_frames_once(formula, monkeypatch):
    """Also where frame 0 ends early: its pixels alone have a value. The frames are dealt into blocks once, not for each part."""
    px = formula(2, size=16, frames=3).withColumnRenamed("v", "gray").filter("frame > 0 OR y < 11 OR x < 5").localCheckpoint()
    dealt, open_ = [], grid.Blocks.open
    monkeypatch.setattr(grid.Blocks, "open", lambda self, d: dealt.append("frame" in d.columns) or open_(self, d))
    got = sf.stack_boundary(px, sigmas=(0.0, 2.0))
    assert sorted(dealt) == [False, True]
    got = {(r["stack_id"], r["y"], r["x"]): r["boundary"] for r in got.collect()}
    want = {(r["stack_id"], r["y"], r["x"]): r["boundary"] for r in boundary_in_parts(px, (0.0, 2.0)).collect()}
    assert len(got) == len(want) == 2 * (11 * 16 + 5 * 5) and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_many_taps_are_summed_over_one_list(formula):
    """A term for each tap made methods that the JVM does not compile; missing pixels still count as zero, a null makes the sum null."""
    px = formula(size=24, frames=1).filter("y % 5 > 0 OR x % 3 > 0").withColumn("v", F.when(F.col("y") * 24 + F.col("x") != 23 * 24 + 22, F.col("v"))).localCheckpoint()
    blurred = st.conv1d(px, {"m": "v"}, [0.5 + k for k in range(33)], "x")
    plan = blurred._jdf.queryExecution().executedPlan().toString()
    assert "lag(" not in plan and "lead(" not in plan
    v = {(r["y"], r["x"]): r["v"] for r in px.collect()}
    fold = lambda p: min(p % 46, 46 - p % 46)
    for r in blurred.collect():
        near = [(k, (r["y"], fold(r["x"] + k - 16))) for k in range(33) if (r["y"], fold(r["x"] + k - 16)) in v]
        if any(v[p] is None for _, p in near):
            assert r["m"] is None
        else:
            assert abs(r["m"] - sum((0.5 + k) * v[p] for k, p in near)) < 1e-6
