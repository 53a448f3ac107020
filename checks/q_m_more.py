"""Texture that a correction adds, and features of a thin matte."""

from pyspark.sql import functions as F

from checks.q_a_kernels import one_px, px, taps1
from checks.registry import SOBEL_X, SOBEL_Y, Q, add, disk_kernel, r6, s6
from sharpfleet.functions.taps import gaussian_taps
from sharpfleet.operators import ownership as ow
from sharpfleet.operators import stencil as st
from sharpfleet.sources import derived as d

G16, G07 = gaussian_taps(1.6), gaussian_taps(0.7)
RADIUS = 4.0


def plates(s, f):
    t = d.truth(px(s, f, 5))
    return t.select("stack_id", "y", "x", "h", "w", F.col("t").alias("base"), (F.col("t") + (F.col("x") * F.col("y")) % 5 - 2).alias("corrected"), ((F.col("x") + F.col("y")) % 3).alias("mask"))


def texture_sql():
    q = Q().pixels(5).truth().sep("sm", "px", taps1(G16), taps1(G16), {"m": "v"})
    q.add("mid", "SELECT stack_id, y, x, round(max(abs(v - m)), 9) AS mid FROM px JOIN sm USING (stack_id, frame, y, x) GROUP BY ALL")
    q.add("pl", "SELECT stack_id, y, x, h, w, CAST((x*y) % 5 - 2 AS DOUBLE) AS d, (x + y) % 3 AS mask, 30.0 + stack_id % 7 AS sigma FROM truth")
    q.sep("sd", "pl", taps1(G07), taps1(G07), {"s": "d"}, by=())
    q.add("al", "SELECT stack_id, mask > 0.05 AND mid <= 1.5*sigma AS calm, abs(d - s)/(sigma + 1e-6) AS n FROM pl JOIN sd USING (stack_id, y, x) JOIN mid USING (stack_id, y, x)")
    return q.select(f"SELECT stack_id, count(*) FILTER (WHERE calm) AS pixels, {s6('CASE WHEN count(*) FILTER (WHERE calm) >= 32 THEN avg(n) FILTER (WHERE calm) ELSE 0 END', 'score')} FROM al GROUP BY stack_id")


add("V23_unsupported_texture", lambda s, f: ow.unsupported_texture(px(s, f, 5), plates(s, f), 30.0 + F.col("stack_id") % 7).select("stack_id", "pixels", r6("score", "score")), texture_sql())

FEATURES = ["support", "dominance_in", "opaque", "edges_in", "veil", "rim_slope", "rim_edges"]


def matte(s, f):
    p = one_px(s, f, 5).withColumns({"alpha": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - 120) / 60.0)), "dominance": (F.col("v") % 7) / 7.0})
    return ow.thin_matte_features(st.gradient_magnitude(p, "v", "gradient"), RADIUS)


def matte_sql():
    q = Q().frames(5).add("al", "SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v - 120)/60.0::DOUBLE)) AS alpha, (v % 7)/7.0::DOUBLE AS dominance FROM px")
    for n, k in (("x", SOBEL_X), ("y", SOBEL_Y)):
        q.kernel(f"k{n}", "al", k, {f"g{n}": "v", f"a{n}": "alpha"})
    q.kernel("dk", "al", disk_kernel(max(1, round(0.7 * RADIUS))), {"ab": "alpha"})
    q.add("al2", """SELECT stack_id, alpha, dominance, sqrt(gx*gx+gy*gy) AS g, sqrt(ax*ax+ay*ay) AS ga, round(ab, 9) > 0.02 AND alpha < 0.98 AS band
        FROM al JOIN kx USING (stack_id, y, x) JOIN ky USING (stack_id, y, x) JOIN dk USING (stack_id, y, x)""")
    on, rim = "FILTER (WHERE alpha > 0.15)", "FILTER (WHERE alpha > 0.2 AND alpha < 0.8)"
    c = [f"count(*) {on} / count(*)", f"avg(dominance) {on}", f"count(*) FILTER (WHERE alpha > 0.6) / (count(*) {on} + 1e-6)", f"avg(g) {on} / (avg(g) + 1e-6)",
         "count(*) FILTER (WHERE band) / count(*)", f"coalesce(avg(ga) {rim}, 0)", f"coalesce(avg(g) {rim} / (avg(g) + 1e-6), 0)"]
    some = f"count(*) {on} > 0"
    cols = ", ".join(s6(f"CASE WHEN {some} THEN {e} END", n) for e, n in zip(c, FEATURES))
    return q.select(f"SELECT stack_id, {cols} FROM al2 GROUP BY stack_id")


add("V8_thin_matte", lambda s, f: matte(s, f).select("stack_id", *[r6(n, n) for n in FEATURES]), matte_sql())
