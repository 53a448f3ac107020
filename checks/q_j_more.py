"""Fits with several unknowns, surface agreement, layer states and the remaining joins."""

from pyspark.sql import functions as F

from checks.q_a_kernels import ID, ids, one_px, pair_px, px, sq
from checks.q_b_focus import PX, pxs
from checks.q_e_stats import KEY, key
from checks.registry import Q, SOBEL_X, SOBEL_Y, add, disk_kernel, r6, s6
from sharpfleet.functions import columns as fc
from sharpfleet.operators import fits as ft
from sharpfleet.operators import ownership as ow
from sharpfleet.operators import registration as rg
from sharpfleet.operators import surfaces as sf
from sharpfleet.sources import derived as d

obs, meas = d.observations, d.measures
add("A12_motion_model", lambda s, f: ft.fit_motion(obs(s, f), KEY, 480, 640).select(*KEY, "n", *[r6(F.element_at("beta", i + 1), n, 4) for i, n in enumerate(("wx", "wy", "wz", "tx", "ty", "tz", "s"))]))


def a13(s, f):
    o = obs(s, f)
    p = o.groupBy(*KEY).agg((F.array(*[F.avg("dx") * k for k in (0.01, 0.02, -0.01, 0.03, -0.02, 0.01, 0.005)])).alias("beta"), F.avg("depth").alias("origin"))
    return ft.motion_displacement(o, p, KEY, 480, 640).groupBy(*KEY).agg(r6(F.sum("mdx"), "sx"), r6(F.sum("mdy"), "sy"))


add("A13_motion_displacement", a13, Q().obs().add("p", f"SELECT {key}, avg(dx) AS k, avg(depth) AS o FROM obs GROUP BY ALL").add("e", f"SELECT stack_id, frame, (x-319.5)/800.0::DOUBLE AS x, (y-239.5)/800.0::DOUBLE AS y, depth-o AS u, k FROM obs JOIN p USING ({key})")
    .select(f"SELECT {key}, {s6('sum(800*k*(0.01*x*y-0.02*(1+x*x)-0.01*y+u*(0.01*x-0.03)+0.005*x))', 'sx')}, {s6('sum(800*k*(0.01*(1+y*y)-0.02*x*y+0.01*x+u*(0.01*y+0.02)+0.005*y))', 'sy')} FROM e GROUP BY ALL"))
add("A15_shared_scale", lambda s, f: ft.shared_scale(obs(s, f).withColumn("bin", F.col("x") % 3), KEY, 3, 319.5, 239.5).select(*KEY, "n", r6("scale", "scale"), r6("rotation", "rotation"), r6("tx0", "tx0", 4), r6("ty2", "ty2", 4)))
add("A16_viewpoint_motion", lambda s, f: ft.breathing(ft.shared_scale(obs(s, f).withColumn("bin", F.col("x") % 3), KEY, 3, 319.5, 239.5), KEY, 3).select(*KEY, *[r6(c, c, 4) for c in ("scale", "rotation", "spread_x", "spread_y", "median_x", "median_y")]))
KN = [0.0, 0.25, 0.5, 1.0]
curve = lambda s, f: ft.fit_curve(meas(s, f).withColumn("depth", (F.col("feature_id") % 101) / 100.0), ["stack_id"], KN)
add("A18_depth_curve", lambda s, f: curve(s, f).select("stack_id", "n", *[r6(F.element_at(c, i + 1), f"{c}{i}", 4) for c in ("cx", "cy") for i in range(4)]))


def a18e(s, f):
    """The curve evaluated with given knots values, so the SQL can interpolate by itself."""
    m = meas(s, f).withColumn("depth", (F.col("feature_id") % 101) / 100.0)
    c = m.select("stack_id").distinct().withColumns({"cx": F.array(*[F.col("stack_id") * k + 0.5 for k in (0.0, 1.0, -1.0, 2.0)]), "cy": F.array(*[F.lit(v) for v in (1.0, 0.0, 3.0, -2.0)])})
    return ft.evaluate_curve(m.select("stack_id", "feature_id", "frame", "depth"), c, ["stack_id"], KN).select("feature_id", "frame", r6("dx", "dx"), r6("dy", "dy"))


seg = lambda v: f"CASE WHEN d <= 0.25 THEN {v[0]} + ({v[1]}-({v[0]}))*d/0.25 WHEN d <= 0.5 THEN {v[1]} + ({v[2]}-({v[1]}))*(d-0.25)/0.25 ELSE {v[2]} + ({v[3]}-({v[2]}))*(d-0.5)/0.5 END"
add("A18_evaluate_curve", a18e, Q().measure().add("m", "SELECT *, (feature_id % 101)/100.0::DOUBLE AS d FROM measure").select(f"SELECT feature_id, frame, {s6(seg(['0.5', 'stack_id+0.5', '0.5-stack_id', '2*stack_id+0.5']), 'dx')}, {s6(seg(['1.0', '0.0', '3.0', '-2.0']), 'dy')} FROM m"))
add("G18_piece_affine", lambda s, f: ft.piece_affine(meas(s, f), KEY, 6).select(*KEY, "n", *[r6(F.element_at("beta", i + 1), f"b{i}", 4) for i in range(6)]))


def g19(s, f):
    o = obs(s, f)
    g = o.groupBy(*KEY).agg(F.avg("dx").alias("u"), F.avg("dy").alias("v"))
    m = lambda a, b, c: F.array(F.lit(1.0) + a, F.lit(0.0), b, F.lit(0.0), F.lit(1.0), c, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return ft.prior_walk(g.select(*KEY, m(F.col("u") / 100, F.col("u"), F.col("v")).alias("m")), g.select(*KEY, m(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("m")), o, KEY).select(*KEY, r6("walk", "walk"))


add("G19_prior_walk", g19, Q().obs().add("g", f"SELECT {key}, avg(dx) AS u, avg(dy) AS v, avg(x) AS cx FROM obs GROUP BY ALL").select(f"SELECT {key}, {s6('sqrt(power(u/100*cx+u, 2)+v*v)', 'walk')} FROM g"))


def g25(s, f):
    """Largest disagreement between a proposed and a fitted motion at the observations' centroid, per stack."""
    o = obs(s, f)
    g = o.groupBy(*KEY).agg(F.avg("dx").alias("u"), F.avg("dy").alias("v"), F.percentile("dx", F.lit(0.5)).alias("pu"), F.percentile("dy", F.lit(0.5)).alias("pv"))
    e = (F.col("u") - F.col("pu")) * (F.col("u") - F.col("pu")) + (F.col("v") - F.col("pv")) * (F.col("v") - F.col("pv"))
    return g.groupBy("stack_id").agg(r6(F.max(F.sqrt(e)), "worst"), F.count("*").alias("frames"))


add("G25_seed_agreement", g25, Q().obs().add("g", f"SELECT {key}, avg(dx) AS u, avg(dy) AS v, median(dx) AS pu, median(dy) AS pv FROM obs GROUP BY ALL").select(f"SELECT stack_id, {s6('max(sqrt(power(u-pu, 2)+power(v-pv, 2)))', 'worst')}, count(*) AS frames FROM g GROUP BY ALL"))


def g17(s, f):
    """Left-over motion of one plane: the masked translation, as a length."""
    p = px(s, f, 5)
    t = rg.translation(rg.shift_scores(p, 2, 1, F.when(F.col("y") < 20, F.lit(0)), side=20), 9.0)
    return t.select(*KEY, r6(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "leftover"))


from checks.q_g_registration import BEST, NCC, TRANS  # noqa: E402

add("G17_plane_residual", g17, NCC(Q().pixels(5), "px", 1, "CASE WHEN a.y < 20 THEN 0 END").add("s1", "SELECT * FROM sc WHERE region = 0").add("bs", BEST.replace("FROM sc", "FROM s1")).add("t", TRANS).select(f"SELECT {key}, {s6('sqrt(dx*dx+dy*dy)', 'leftover')} FROM t"))


def g28(s, f):
    p = px(s, f)
    pieces = p.select(*ID, (F.col("v") % 3).alias("rank"))
    sil = p.filter("v > 120").select("stack_id", "frame", "y", (F.col("x") + 1).alias("x"), (F.col("v") % 3).alias("rank"))
    return sf.occlusion_clause(pieces, sil).select(*ID, F.col("refused").cast("int").alias("refused"))


add("G28_occlusion_clause", g28, Q().pixels().select("SELECT a.stack_id, a.frame, a.y, a.x, CAST(coalesce(b.v > 120 AND b.v % 3 < a.v % 3, false) AS INT) AS refused FROM px a LEFT JOIN px b ON b.stack_id=a.stack_id AND b.frame=a.frame AND b.y=a.y AND b.x=a.x-1"))
add("E14_two_means", lambda s, f: ft.two_means(obs(s, f), KEY, 3).select(*KEY, r6("separation", "separation"), "n0", "n1"))
pair = lambda s, f, t: pair_px(s, f, t).filter("frame = 0").select(*PX, "h", "w", F.col("v").alias("a")).join(pair_px(s, f, t).filter("frame = 1").select(*PX, F.col("v").alias("b")), PX)
PAIR = "SELECT p.stack_id, p.y, p.x, p.h, p.w, p.v AS a, q.v AS b FROM px p JOIN px q ON q.stack_id=p.stack_id AND q.y=p.y AND q.x=p.x AND q.frame=1 WHERE p.frame=0"


def matched_sql():
    q = Q().pairs(2).add("pr", PAIR)
    for r in (1, 2):
        q.kernel(f"k{r}", "pr", disk_kernel(r), {"ka": "a", "kb": "b"}, by=())
    pick = lambda c, sel: f"CASE least(2, {sel}) WHEN 0 THEN p.{c} WHEN 1 THEN k1.k{c} ELSE k2.k{c} END"
    return q.add("lo", f"SELECT p.stack_id, p.y, p.x, p.h, p.w, {pick('a', '(p.y % 3)')} AS la, {pick('b', '(p.x % 2)')} AS lb FROM pr p JOIN k1 USING ({pxs}) JOIN k2 USING ({pxs})")


add("T10_match_blur", lambda s, f: sf.match_blur(pair(s, f, 2), "a", "b", F.col("x") % 2, F.col("y") % 3, 2).select(*PX, r6("a_low", "a_low"), r6("b_low", "b_low")),
    matched_sql().select(f"SELECT {pxs}, {s6('la', 'a_low')}, {s6('lb', 'b_low')} FROM lo"))
add("T11_surface_agreement", lambda s, f: sf.agreement(pair(s, f, 2), "a", "b", F.col("x") % 2, F.col("y") % 3, 2, 1.5, 3).select(*PX, "agree", F.col("unanimous").cast("int").alias("unanimous"), F.col("majority").cast("int").alias("majority")),
    matched_sql().kernel("sx", "lo", SOBEL_X, {"xa": "la", "xb": "lb"}, by=(), carry=("la", "lb")).kernel("sy", "lo", SOBEL_Y, {"ya": "la", "yb": "lb"}, by=())
    .add("ag", f"SELECT sx.*, CAST(round(abs(la-lb) - (1.5*greatest(sqrt(xa*xa+ya*ya), sqrt(xb*xb+yb*yb))/8 + 0.02*greatest(la, lb) + 1), 9) <= 0 AS INT) AS agree FROM sx JOIN sy USING ({pxs})")
    .kernel("mn", "ag", sq(1), {"u": "agree"}, by=(), border="none", agg="min", carry=("agree",)).kernel("bx", "ag", sq(1), {"s": "agree"}, by=())
    .select(f"SELECT {pxs}, agree, u AS unanimous, CAST(s*2 >= 9 AS INT) AS majority FROM mn JOIN bx USING ({pxs})"))


def v26(s, f):
    from checks.q_e_stats import mirrors
    p = px(s, f).select(*ID, "v")
    j = mirrors(s, f).join(p, ID).join(p.select(*PX, F.col("frame").alias("mirror"), F.col("v").alias("v2")), [*PX, "mirror"])
    return sf.contest(j.select(*PX, (F.abs(F.col("v") - F.col("v2")) <= 40).alias("agree"))).select(*PX, "pairs", "against", F.col("contested").cast("int").alias("contested"))


from checks.q_b_focus import FIELD, PEAK, energy_sql  # noqa: E402

add("V26_contest", v26, energy_sql(Q().pixels(), "laplacian").add("pk", PEAK).add("fld", FIELD)
    .add("m", "SELECT a.stack_id, a.y, a.x, abs(a.v-b.v) <= 40 AS ok FROM px a JOIN fld f ON f.stack_id=a.stack_id AND f.y=a.y AND f.x=a.x JOIN px b ON b.stack_id=a.stack_id AND b.y=a.y AND b.x=a.x AND b.frame = round_even(2*f.peak - a.frame, 0) WHERE a.frame < b.frame")
    .select(f"SELECT {pxs}, count(*) AS pairs, count(*) FILTER (NOT ok) AS against, CAST(count(*) FILTER (NOT ok)*2 > count(*) AS INT) AS contested FROM m GROUP BY ALL"))
lab = lambda s, f: one_px(s, f, 2).select(*PX, "h", "w", F.when(F.col("v") > 70, F.floor(F.col("x") / 6)).cast("int").alias("label"))
LAB = "SELECT stack_id, y, x, h, w, CASE WHEN v > 70 THEN x // 6 END AS label FROM px"
add("V38_trinary_state", lambda s, f: sf.trinary(lab(s, f), "label").select(*PX, "state"),
    Q().frames(2).add("l", LAB).add("lm", "SELECT *, coalesce(label, -1) AS lb FROM l").kernel("e", "lm", {(0, 0): 1, (0, 1): 1, (0, -1): 1, (1, 0): 1, (-1, 0): 1}, {"lo": "lb"}, by=(), border="none", agg="min").kernel("g", "lm", {(0, 0): 1, (0, 1): 1, (0, -1): 1, (1, 0): 1, (-1, 0): 1}, {"hi": "lb"}, by=(), border="none", agg="max")
    .add("ed", f"SELECT e.*, CAST(lo <> hi AS INT) AS ed FROM e JOIN g USING ({pxs})").kernel("nr", "ed", sq(1), {"n": "ed"}, by=(), border="none", agg="max")
    .select(f"SELECT {pxs}, CASE WHEN label IS NULL THEN 'UNKNOWN' WHEN n > 0 THEN 'BOUNDARY' ELSE 'OWNED' END AS state FROM l JOIN nr USING ({pxs})"))
add("V39_layer_extents", lambda s, f: sf.layer_extents(lab(s, f), "label", 4).select(*PX, "layer"),
    Q().frames(2).add("l", LAB).add("n", "SELECT p.stack_id, p.y, p.x, q.label FROM l p JOIN l q ON q.stack_id=p.stack_id AND q.label IS NOT NULL AND (q.y-p.y)*(q.y-p.y)+(q.x-p.x)*(q.x-p.x) <= 16 QUALIFY row_number() OVER (PARTITION BY p.stack_id, p.y, p.x ORDER BY (q.y-p.y)*(q.y-p.y)+(q.x-p.x)*(q.x-p.x), q.y, q.x) = 1")
    .add("t", "SELECT stack_id, max(label) AS tp FROM l GROUP BY ALL").select("SELECT n.stack_id, y, x, CAST(k AS INT) AS layer FROM n JOIN t USING (stack_id) JOIN (SELECT unnest(range(3)) AS k) ON k >= label AND k <= tp"))
add("V3_ordering_bit", lambda s, f: sf.ordering_bit(d.table(s, f, "lineitem").select(F.col("l_orderkey").alias("stack_id"), (F.col("l_returnflag") == "N").alias("low_is_near"))).select("stack_id", "votes", r6("share", "share"), F.col("low_is_near").cast("int").alias("low_is_near")),
    "SELECT l_orderkey AS stack_id, count(*) AS votes, round(avg(CAST(l_returnflag = 'N' AS INT)), 6) AS share, CAST(avg(CAST(l_returnflag = 'N' AS INT)) > 0.5 AS INT) AS low_is_near FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND abs(avg(CAST(l_returnflag = 'N' AS INT)) - 0.5) >= 0.1")


def j2(s, f):
    p = one_px(s, f, 5)
    t = p.withColumn("ty", F.explode(ow.tile_ids("h", "y", 16, 8))).withColumn("tx", F.explode(ow.tile_ids("w", "x", 16, 8)))
    return t.groupBy("stack_id", "ty", "tx").agg(F.count("*").alias("pixels"), F.sum("v").alias("total"))


add("J2_overlapping_tiles", j2, Q().frames(5).add("ts", "SELECT unnest([0, 8, 16, 24]) AS s").select("SELECT stack_id, CAST(a.s AS INT) AS ty, CAST(b.s AS INT) AS tx, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS total FROM px JOIN ts a ON y >= a.s AND y < a.s+16 JOIN ts b ON x >= b.s AND x < b.s+16 GROUP BY ALL"))


def t3(s, f):
    p = one_px(s, f, 5)
    from sharpfleet.operators import stats as sa
    t = j2(s, f).select("stack_id", "ty", "tx", ((F.col("ty") + F.col("tx")) / 8 % 2).cast("int").alias("place"), (F.col("total") / 1000.0).alias("weight"))
    return sf.tile_votes(t, p, 16, 8).select(*PX, "owner")


add("T3_ownership", t3)
add("T12_pair_refusal", lambda s, f: rg.occlusion(pair(s, f, 2).withColumns({"dispx": (F.col("a") - F.col("b")) / 60.0, "dispy": F.lit(0.0), "edge": F.col("a") > 170}), 1.5, 2, ()).select(*PX, F.col("occluded").cast("int").alias("occluded")),
    Q().pairs(2).add("pr", PAIR).add("dp", "SELECT *, a-b AS df, CAST(a > 170 AS INT) AS e FROM pr")
    .kernel("h1", "dp", sq(1), {"hi": "df", "e": "e"}, by=(), border="none", agg="max").kernel("l1", "dp", sq(1), {"lo": "df"}, by=(), border="none", agg="min").kernel("h2", "dp", sq(2), {"hi": "df", "e": "e"}, by=(), border="none", agg="max").kernel("l2", "dp", sq(2), {"lo": "df"}, by=(), border="none", agg="min")
    .select(f"SELECT {pxs}, CAST(((h1.hi-l1.lo)/60.0::DOUBLE > 1.5 AND h1.e > 0) OR ((h2.hi-l2.lo)/60.0::DOUBLE > 2 AND h2.e > 0) AS INT) AS occluded FROM h1 JOIN l1 USING ({pxs}) JOIN h2 USING ({pxs}) JOIN l2 USING ({pxs})"))
add("T14_route_report", lambda s, f: obs(s, f).groupBy("stack_id").agg(F.countDistinct("frame").alias("frames_used"), r6(F.max(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), "largest"), F.count_if(F.col("w") < 0.1).alias("refused"), (F.max(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))) <= 12).cast("int").alias("licensed")),
    Q().obs().select(f"SELECT stack_id, count(DISTINCT frame) AS frames_used, {s6('max(sqrt(dx*dx+dy*dy))', 'largest')}, count(*) FILTER (w < 0.1) AS refused, CAST(max(sqrt(dx*dx+dy*dy)) <= 12 AS INT) AS licensed FROM obs GROUP BY ALL"))
