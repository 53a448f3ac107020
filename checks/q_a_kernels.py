"""K rows: neighbourhood arithmetic."""

from pyspark.sql import functions as F

from checks.registry import DXX, DYY, LAP1, LAP3, Q, SOBEL_X, SOBEL_Y, add, disk_kernel, r6, s6
from sharpfleet.functions.taps import disk_taps, gaussian_taps
from sharpfleet.operators import stencil as st
from sharpfleet.sources import derived as d

ID = ["stack_id", "frame", "y", "x"]
ids = ", ".join(ID)
px = lambda s, f, tiles=1: d.pixels(s, f, tiles)
one_px = lambda s, f, tiles=1: d.frames_as_stacks(px(s, f, tiles))
pair_px = lambda s, f, tiles=1: d.frame_pairs(px(s, f, tiles))


def taps1(values):
    r = len(values) // 2
    return {k - r: t for k, t in enumerate(values)}


def pad_query(s, f):
    return st.reflect_pad(px(s, f), "x", 3).select(*ID, "v")


add("K1_reflect_pad", pad_query, Q().pixels().select(f"""
SELECT p.stack_id, p.frame, p.y, CAST(t.c AS INT) AS x, p.v FROM px p JOIN (SELECT unnest(range(-3, 11)) AS c) t
ON p.x = CASE WHEN t.c < 0 THEN -t.c WHEN t.c > 7 THEN 14 - t.c ELSE t.c END"""))

add("K2_box_mean", lambda s, f: st.box(px(s, f, 5), {"m": F.col("v")}, 4, side=16).select(*ID, r6("m", "m")),
    Q().pixels(5).box("b", "px", 4, {"m": "v"}).select(f"SELECT {ids}, {s6('m', 'm')} FROM b"))
add("K2_box_sum", lambda s, f: st.box(px(s, f, 5), {"m": F.col("v")}, 2, mean=False, side=16).select(*ID, "m"),
    Q().pixels(5).box("b", "px", 2, {"m": "v"}, mean=False).select(f"SELECT {ids}, CAST(m AS BIGINT) AS m FROM b"))
add("K3_local_std", lambda s, f: st.local_std(px(s, f), "v", 7).select(*ID, r6("std", "std")),
    Q().pixels().add("p2", "SELECT *, v*v AS vv FROM px").box("b", "p2", 3, {"m": "v", "mm": "vv"})
    .select(f"SELECT {ids}, {s6('sqrt(greatest(mm - m*m, 0))', 'std')} FROM b"))
G1 = gaussian_taps(1.0)
add("K4_gaussian", lambda s, f: st.gaussian(px(s, f, 5), {"m": F.col("v")}, 1.0, side=16).select(*ID, r6("m", "m")),
    Q().pixels(5).sep("b", "px", taps1(G1), taps1(G1), {"m": "v"}).select(f"SELECT {ids}, {s6('m', 'm')} FROM b"))
add("K4_conv1d", lambda s, f: st.conv1d(px(s, f), {"m": F.col("v")}, [1.0, 4.0, 6.0, 4.0, 1.0], "y").select(*ID, r6("m", "m")),
    Q().pixels().gather("b", "px", "y", taps1([1, 4, 6, 4, 1]), {"m": "v"}).select(f"SELECT {ids}, {s6('m', 'm')} FROM b"))
K5 = {(-1, -1): 1.0, (-1, 0): -2.0, (-1, 1): 1.0, (0, -1): -2.0, (0, 0): 4.0, (0, 1): -2.0, (1, -1): 1.0, (1, 0): -2.0, (1, 1): 1.0}
add("K5_conv2d", lambda s, f: st.conv2d(px(s, f), "v", K5, "m").select(*ID, r6("m", "m")),
    Q().pixels().kernel("b", "px", K5, {"m": "v"}).select(f"SELECT {ids}, {s6('m', 'm')} FROM b"))


def disk_blur(s, f):
    """The radius-3 disk written out as a taps table, joined to the data's own frames."""
    taps = disk_taps(s, [1, 2, 3])
    frames = d.table(s, f, "embeddings").select((F.col("vec_id") % 3 + 1).cast("int").alias("radius")).groupBy("radius").agg(F.count("*").alias("frames"))
    return taps.join(F.broadcast(frames), "radius").select("radius", "dy", "dx", r6("weight", "weight"), "frames")


add("K6_disk_taps", disk_blur, """WITH g AS (SELECT r AS radius, a AS dy, b AS dx FROM (VALUES (1),(2),(3)) t(r), (SELECT unnest(range(-3,4)) AS a), (SELECT unnest(range(-3,4)) AS b)
 WHERE abs(a) <= r AND abs(b) <= r AND a*a + b*b <= r*r), n AS (SELECT radius, count(*) AS n FROM g GROUP BY 1),
 fr AS (SELECT vec_id % 3 + 1 AS radius, count(*) AS frames FROM embeddings GROUP BY 1)
 SELECT CAST(g.radius AS INT) AS radius, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, round(1.0/n::DOUBLE, 6) AS weight, frames FROM g JOIN n USING (radius) JOIN fr USING (radius)""")


def ladder_sql(q, rmax):
    for r in range(1, rmax + 1):
        q.kernel(f"d{r}", "px", disk_kernel(r), {"m": "v"}, carry=("v",))
    return q.add("lad", " UNION ALL ".join(
        [f"SELECT {ids}, v, 0 AS radius, CAST(v AS DOUBLE) AS blurred FROM px"] +
        [f"SELECT {ids}, v, {r} AS radius, m AS blurred FROM d{r}" for r in range(1, rmax + 1)]))


add("K7_disk_ladder", lambda s, f: st.ladder_rows(px(s, f, 2), "v", [0, 1, 2, 3], side=8).select(*ID, "radius", r6("blurred", "blurred")),
    ladder_sql(Q().pixels(2), 3).select(f"SELECT {ids}, radius, {s6('blurred', 'blurred')} FROM lad"))


def rung(s, f):
    p = px(s, f)
    want = p.select(*ID, (F.col("v") / 50.0).alias("radius"))
    return st.select_rung(st.ladder_rows(p, "v", [0, 1, 2, 3]), want).select(*ID, "radius", r6("blurred", "blurred"))


RUNG = ladder_sql(Q().pixels(), 3).select(f"""SELECT {ids}, radius, {s6('blurred', 'blurred')} FROM lad
    WHERE radius = least(3, greatest(0, CAST(round_even(v / 50.0, 0) AS INT)))""")
add("K8_select_rung", rung, RUNG)
add("K8_spatial_blur", lambda s, f: st.spatial_blur(px(s, f), "v", F.col("v") / 50.0, 3, "blurred").select(
    *ID, F.least(F.lit(3), F.greatest(F.lit(0), F.rint(F.col("v") / 50.0).cast("int"))).alias("radius"), r6("blurred", "blurred")), RUNG)
scharr = lambda t: {(dy, dx): w * (10 / 2 if 0 in (dy, dx) else 3) for (dy, dx), w in t.items()}
for op, tx, ty in (("sobel", SOBEL_X, SOBEL_Y), ("scharr", scharr(SOBEL_X), scharr(SOBEL_Y))):
    add(f"K9_{op}", lambda s, f, op=op: st.derivatives(px(s, f, 5), "v", ("gx", "gy"), op, side=16).select(
        *ID, "gx", "gy", r6("sqrt(cast(gx*gx + gy*gy as double))", "g")),
        Q().pixels(5).kernel("a", "px", tx, {"gx": "v"}).kernel("c", "px", ty, {"gy": "v"})
        .select(f"SELECT {ids}, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, {s6('sqrt(gx*gx+gy*gy)', 'g')} FROM a JOIN c USING ({ids})"))
add("K10_laplacian", lambda s, f: st.derivatives(px(s, f), "v", ("lap3", "lap1")).select(*ID, "lap3", "lap1"),
    Q().pixels().kernel("a", "px", LAP3, {"l3": "v"}).kernel("c", "px", LAP1, {"l1": "v"})
    .select(f"SELECT {ids}, CAST(l3 AS INT) AS lap3, CAST(l1 AS INT) AS lap1 FROM a JOIN c USING ({ids})"))
add("K11_second_diff", lambda s, f: st.derivatives(px(s, f), "v", ("dxx", "dyy")).select(*ID, "dxx", "dyy"),
    Q().pixels().kernel("a", "px", DXX, {"l3": "v"}).kernel("c", "px", DYY, {"l1": "v"})
    .select(f"SELECT {ids}, CAST(l3 AS INT) AS dxx, CAST(l1 AS INT) AS dyy FROM a JOIN c USING ({ids})"))
sq = lambda r: {(a, b): 1.0 for a in range(-r, r + 1) for b in range(-r, r + 1)}


def dil_ero(s, f):
    df = st.blocked(px(s, f, 5), 2, lambda p: st.erode(st.dilate(p, "v", 2), "v", 1), 16)
    return df.select(*ID, "dilated", "eroded")


add("K12_dilate_erode", dil_ero, Q().pixels(5).kernel("a", "px", sq(2), {"dilated": "v"}, border="none", agg="max")
    .kernel("c", "px", sq(1), {"eroded": "v"}, border="none", agg="min").select(f"SELECT {ids}, dilated, eroded FROM a JOIN c USING ({ids})"))
add("K13_dilate_disc", lambda s, f: st.dilate_disc(px(s, f, 5), "v", 3, side=16).select(*ID, "dilated"),
    Q().pixels(5).kernel("a", "px", disk_kernel(3), {"dilated": "v"}, border="none", agg="max").select(f"SELECT {ids}, dilated FROM a"))
add("K14_step_height", lambda s, f: st.step_height(px(s, f), "v", 1).select(*ID, "step"),
    Q().pixels().kernel("a", "px", sq(1), {"hi": "v"}, border="none", agg="max").kernel("c", "px", sq(1), {"lo": "v"}, border="none", agg="min")
    .select(f"SELECT {ids}, hi - lo AS step FROM a JOIN c USING ({ids})"))
add("K15_median_filter", lambda s, f: st.median_filter(px(s, f, 5), "v", 3, side=16).select(*ID, "median"),
    Q().pixels(5).kernel("a", "px", sq(1), {"m": "v"}, border="clamp", agg="median").select(f"SELECT {ids}, CAST(m AS INT) AS median FROM a"))
add("K16_central_diff", lambda s, f: st.central_diff(px(s, f), "v").select(*ID, r6("dx", "dx"), r6("dy", "dy")),
    Q().pixels().select(f"""SELECT p.stack_id, p.frame, p.y, p.x,
    round((r.v - l.v) / CAST(r.x - l.x AS DOUBLE), 6) + 0.0 AS dx, round((b.v - a.v) / CAST(b.y - a.y AS DOUBLE), 6) + 0.0 AS dy
    FROM px p JOIN px l ON l.stack_id=p.stack_id AND l.frame=p.frame AND l.y=p.y AND l.x=greatest(p.x-1,0)
    JOIN px r ON r.stack_id=p.stack_id AND r.frame=p.frame AND r.y=p.y AND r.x=least(p.x+1,7)
    JOIN px a ON a.stack_id=p.stack_id AND a.frame=p.frame AND a.x=p.x AND a.y=greatest(p.y-1,0)
    JOIN px b ON b.stack_id=p.stack_id AND b.frame=p.frame AND b.x=p.x AND b.y=least(p.y+1,7)"""))


def bnd(s, f):
    p = px(s, f).withColumn("m", (F.col("v") > 120).cast("int"))
    return st.blocked(p, 1, lambda q: st.label_boundary(st.boundary(q, "m", "edge"), "m", "change")).select(
        *ID, F.col("edge").cast("int").alias("edge"), F.col("change").cast("int").alias("change"))


add("K17_boundary", bnd, Q().pixels().add("p", "SELECT *, CAST(v > 120 AS INT) AS m FROM px")
    .kernel("a", "p", sq(1), {"lo": "m"}, border="none", agg="min", carry=("m",))
    .kernel("c", "p", {k: 1.0 for k in LAP1}, {"lo": "m"}, border="none", agg="min")
    .kernel("e", "p", {k: 1.0 for k in LAP1}, {"hi": "m"}, border="none", agg="max")
    .select(f"SELECT {ids}, CAST(m = 1 AND a.lo = 0 AS INT) AS edge, CAST(c.lo <> e.hi AS INT) AS change FROM a JOIN c USING ({ids}) JOIN e USING ({ids})"))
GH = gaussian_taps(0.6)


def hp_sql():
    q = Q().pixels().add("p", "SELECT *, CAST(v AS DOUBLE) AS u FROM px")
    q.sep("l1", "p", taps1(GH), taps1(GH), {"lo": "u"}, carry=("u",)).add("h1", "SELECT *, u - lo AS hp FROM l1")
    q.sep("l2", "h1", taps1(GH), taps1(GH), {"lo2": "hp"}, carry=("hp",))
    return q.select(f"SELECT {ids}, {s6('hp - lo2', 'high')} FROM l2")


add("K18_high_pass", lambda s, f: st.high_pass(px(s, f), "v", 0.6, 2).select(*ID, r6("high", "high")), hp_sql())


def psf(s, f):
    p = d.colour(px(s, f))
    radii = p.select("frame").distinct().select("frame", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(i).alias("k")) for i, c in enumerate("bgr")])).alias("c"))
    radii = radii.select("frame", "c.channel", ((F.col("frame") + F.col("c.k")) % 4).cast("double").alias("radius"))
    return st.psf_blur(p, ["b", "g", "r"], radii, 3).select(*ID, *[r6(f"{c}_blur", f"{c}_blur") for c in "bgr"])


def psf_sql():
    q = Q().pixels().colour()
    for r in (1, 2, 3):
        q.kernel(f"d{r}", "px3", disk_kernel(r), {"b": "b", "g": "g", "r": "r"})
    pick = lambda c, k: s6(f"CASE (p.frame + {k}) % 4 WHEN 0 THEN p.{c} WHEN 1 THEN d1.{c} WHEN 2 THEN d2.{c} ELSE d3.{c} END", f"{c}_blur")
    return q.select(f"SELECT {ids}, {pick('b', 0)}, {pick('g', 1)}, {pick('r', 2)} FROM px3 p JOIN d1 USING ({ids}) JOIN d2 USING ({ids}) JOIN d3 USING ({ids})")


add("K19_psf_blur", psf, psf_sql())


def oc(s, f):
    p = px(s, f, 5).withColumn("m", (F.col("v") > 110).cast("int"))
    return st.open_close(p, "m", 1, 1, side=16).select(*ID, "cleaned")


def square(q, name, src, kind):
    one = {-1: 1.0, 0: 1.0, 1: 1.0}
    return q.sep(name, src, one, one, {"m": "m"}, border="none", agg=kind)


add("K20_open_close", oc, square(square(square(square(Q().pixels(5).add("p0", "SELECT *, CAST(v > 110 AS INT) AS m FROM px"), "p1", "p0", "min"), "p2", "p1", "max"), "p3", "p2", "max"), "p4", "p3", "min")
    .select(f"SELECT {ids}, m AS cleaned FROM p4"))
