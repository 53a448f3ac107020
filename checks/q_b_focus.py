"""F, P and W rows on pixel relations, with the exposure and selection aggregates."""

from pyspark.sql import functions as F

from checks.q_a_kernels import ID, ids, px, sq, taps1
from checks.registry import DXX, DYY, LAP1, LAP3, Q, SOBEL_X, SOBEL_Y, add, r6, s6
from sharpfleet.functions import columns as fc
from sharpfleet.functions.taps import gaussian_taps
from sharpfleet.operators import evidence as ev
from sharpfleet.operators import focus as fo
from sharpfleet.operators import stencil as st
from sharpfleet.sources import derived as d

PX = ["stack_id", "y", "x"]
pxs = ", ".join(PX)


def energy_sql(q, method, k=9, src="px", v="v", out="en"):
    """Adds a relation with the pooled energy ``e``."""
    c = (v,)
    if method == "laplacian":
        q.kernel("en_a", src, LAP3, {"a": v}).add("en_r", "SELECT *, abs(a) AS r FROM en_a")
    elif method == "mod_laplacian":
        q.kernel("en_a", src, DXX, {"a": v}).kernel("en_b", src, DYY, {"b": v}).add("en_r", f"SELECT en_a.*, abs(a) + abs(b) AS r FROM en_a JOIN en_b USING ({ids})")
    elif method == "content_aware":
        q.kernel("en_a", src, DXX, {"a": v}).kernel("en_b", src, DYY, {"b": v}).kernel("en_c", src, LAP3, {"c": v})
        q.add("en_p2", f"SELECT *, {v}*{v} AS vv FROM {src}").box("en_m", "en_p2", 3, {"m": v, "mm": "vv"})
        q.add("en_ref", f"SELECT {pxs}, max(sqrt(greatest(mm - m*m, 0))) AS ref FROM en_m GROUP BY ALL")
        q.add("en_r", f"""SELECT en_a.*, exp(-ref/8.0)*(abs(a)+abs(b)) + (1-exp(-ref/8.0))*abs(c) AS r FROM en_a JOIN en_b USING ({ids})
            JOIN en_c USING ({ids}) JOIN en_ref USING ({pxs})""")
    else:
        q.kernel("en_a", src, SOBEL_X, {"a": v}).kernel("en_b", src, SOBEL_Y, {"b": v})
        e = "a*a+b*b" if method == "tenengrad" else "sqrt(a*a+b*b)"
        q.add("en_r", f"SELECT en_a.*, {e} AS r FROM en_a JOIN en_b USING ({ids})")
    if k > 1:
        q.box("en_bx", "en_r", k // 2, {"e": "r"})
    else:
        q.add("en_bx", "SELECT *, r AS e FROM en_r")
    return q.add(out, f"SELECT {ids}, h, w, e FROM en_bx")


def winner_sql(q, src="en", e="e", out="wn", by=pxs):
    return q.add(out, f"SELECT {by}, frame AS winner, {e} AS e1, e2 FROM (SELECT {by}, frame, {e}, row_number() OVER (PARTITION BY {by} ORDER BY {e} DESC, frame) AS rn, lead({e}) OVER (PARTITION BY {by} ORDER BY {e} DESC, frame) AS e2 FROM {src}) WHERE rn = 1")


for i, m in enumerate(("laplacian", "gradient", "tenengrad", "mod_laplacian")):
    add(f"F{i + 1}_{m}", lambda s, f, m=m: fo.focus_measure(px(s, f, 5), m, side=16).select(*ID, r6("e", "e")),
        energy_sql(Q().pixels(5), m).select(f"SELECT {ids}, {s6('e', 'e')} FROM en"))
add("F5_content_aware", lambda s, f: fo.content_aware(px(s, f, 5), side=20).select(*ID, r6("e", "e")),
    energy_sql(Q().pixels(5), "content_aware").select(f"SELECT {ids}, {s6('e', 'e')} FROM en"))


def all_maps(s, f):
    p = d.colour(px(s, f)).withColumn("gray", fc.luminance())

    def body(q):
        want = ("lap3", "gx", "gy", "dxx", "dyy")
        q = st.derivatives(q, "gray", want)
        return st.box(q, {m: fo.response(m)[1].cast("double") for m in fo.METHODS}, 4)
    df = st.blocked(p, 5, body)
    return df.groupBy("stack_id", "frame").agg(*[r6(F.avg(m), m) for m in fo.METHODS])


def all_maps_sql():
    q = Q().pixels().colour().add("g0", "SELECT stack_id, frame, y, x, h, w, (b*114+g*587+r*299+500)//1000 AS v FROM px3")
    q.kernel("a", "g0", LAP3, {"a": "v"}).kernel("b", "g0", SOBEL_X, {"b": "v"}).kernel("c", "g0", SOBEL_Y, {"c": "v"}).kernel("d", "g0", DXX, {"d": "v"}).kernel("e", "g0", DYY, {"e": "v"})
    q.add("rs", f"SELECT a.*, abs(a) AS laplacian, sqrt(b*b+c*c) AS gradient, b*b+c*c AS tenengrad, abs(d)+abs(e) AS mod_laplacian FROM a JOIN b USING ({ids}) JOIN c USING ({ids}) JOIN d USING ({ids}) JOIN e USING ({ids})")
    q.box("bx", "rs", 4, {m: m for m in fo.METHODS})
    return q.select(f"SELECT stack_id, frame, {', '.join(s6(f'avg({m})', m) for m in fo.METHODS)} FROM bx GROUP BY ALL")


add("F6_all_measures", all_maps, all_maps_sql())

PEAK = f"""SELECT {pxs}, arg, con, la FROM (SELECT {pxs}, frame AS arg, row_number() OVER (PARTITION BY {pxs} ORDER BY e DESC, frame) AS rn,
  max(e) OVER (PARTITION BY {pxs}) - min(e) OVER (PARTITION BY {pxs}) AS con, max(frame) OVER (PARTITION BY {pxs}) AS la FROM en) WHERE rn = 1"""
FIELD = f"""SELECT {pxs}, con AS contrast, least(la, greatest(0, arg + CASE WHEN abs(a.e - 2*b.e + c.e) > 1e-9 THEN greatest(-0.5, least(0.5, 0.5*(a.e - c.e)/(a.e - 2*b.e + c.e))) ELSE 0 END)) AS peak
  FROM pk JOIN en b ON b.stack_id=pk.stack_id AND b.y=pk.y AND b.x=pk.x AND b.frame=arg
  JOIN en a ON a.stack_id=pk.stack_id AND a.y=pk.y AND a.x=pk.x AND a.frame=greatest(arg-1, 0)
  JOIN en c ON c.stack_id=pk.stack_id AND c.y=pk.y AND c.x=pk.x AND c.frame=least(arg+1, la)""".replace(f"SELECT {pxs}, con", "SELECT pk.stack_id, pk.y, pk.x, con")


def field_sql(q):
    return energy_sql(q, "content_aware").add("pk", PEAK).add("fld", FIELD)


def field(s, f, tiles=1):
    return fo.focal_field(fo.content_aware(px(s, f, tiles)))


add("F7_focal_field", lambda s, f: field(s, f).select(*PX, r6("peak", "peak"), r6("contrast", "contrast")),
    field_sql(Q().pixels()).select(f"SELECT {pxs}, {s6('peak', 'peak')}, {s6('contrast', 'contrast')} FROM fld"))


def feature_rows(s, f):
    """One feature per stack and part row: fixed position rule."""
    m = d.table(s, f, "part")
    n = d.table(s, f, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("stack_id")).distinct()
    return m.select((F.col("p_partkey") % 100).alias("stack_id"), F.col("p_partkey").alias("feature_id"),
                    (F.col("p_partkey") % 8).cast("double").alias("x"), (F.floor(F.col("p_partkey") / 8) % 8).cast("double").alias("y")).join(n, "stack_id", "left_semi")


FEAT = "SELECT p_partkey % 100 AS stack_id, p_partkey AS feature_id, p_partkey % 8 AS x, (p_partkey // 8) % 8 AS y FROM part WHERE p_partkey % 100 IN (SELECT vec_id // 5 FROM embeddings)"
add("F8_feature_focal_frame", lambda s, f: fo.feature_focal_frame(fo.focus_measure(px(s, f)), feature_rows(s, f), 2).select("stack_id", "feature_id", "focal", r6("energy", "energy")),
    energy_sql(Q().pixels(), "laplacian").add("ft", FEAT).add("pe", """SELECT ft.stack_id, feature_id, frame, round(avg(e), 9) AS energy FROM ft JOIN en ON en.stack_id=ft.stack_id AND abs(en.y-ft.y)<=2 AND abs(en.x-ft.x)<=2 GROUP BY ALL""")
    .select(f"SELECT stack_id, feature_id, frame AS focal, {s6('energy', 'energy')} FROM pe QUALIFY row_number() OVER (PARTITION BY stack_id, feature_id ORDER BY energy DESC, frame) = 1"))


def sharpest(s, f):
    p = px(s, f)
    members = p.select(*PX).distinct().select(*PX, (F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)).cast("int").alias("cell"))
    return fo.sharpest_frame(fo.focus_measure(p), members, "cell").select("stack_id", "cell", "frame", r6("total", "total"))


add("F9_sharpest_frame", sharpest, energy_sql(Q().pixels(), "laplacian").add("t", "SELECT stack_id, (y//4)*2 + x//4 AS cell, frame, sum(e) AS total FROM en GROUP BY ALL")
    .select(f"SELECT stack_id, CAST(cell AS INT) AS cell, frame, {s6('total', 'total')} FROM t QUALIFY row_number() OVER (PARTITION BY stack_id, cell ORDER BY round(total, 6) DESC, frame) = 1"))
add("F10_sharpness", lambda s, f: fo.sharpness(px(s, f)).select("stack_id", "frame", r6("sharp", "sharp")),
    Q().pixels().kernel("a", "px", LAP1, {"a": "v"}).select(f"SELECT stack_id, frame, {s6('avg(abs(a))', 'sharp')} FROM a GROUP BY ALL"))
N1 = taps1([1, -2, 1])
add("F11_noise_sigma", lambda s, f: fo.noise_sigma(px(s, f, 5), side=16).select("stack_id", r6("sigma", "sigma")),
    Q().pixels(5).sep("n", "px", N1, N1, {"resp": "v"}, border="clamp").kernel("a", "px", SOBEL_X, {"a": "v"}).kernel("b", "px", SOBEL_Y, {"b": "v"})
    .add("g", f"SELECT stack_id, frame, abs(resp) AS resp, sqrt(a*a+b*b) AS g FROM n JOIN a USING ({ids}) JOIN b USING ({ids})")
    .add("c", "SELECT stack_id, frame, quantile_cont(g, 0.35) AS cut FROM g GROUP BY ALL")
    .add("m", "SELECT stack_id, frame, median(resp) AS med FROM g JOIN c USING (stack_id, frame) WHERE g.g <= cut GROUP BY ALL")
    .select(f"SELECT stack_id, {s6('least(20, greatest(1.5, min(med / (0.67448975*6))))', 'sigma')} FROM m GROUP BY ALL"))

# ---- P rows
add("P1_luminance", lambda s, f: ev.with_gray(d.colour(px(s, f))).select(*ID, "gray"),
    Q().pixels().colour().select(f"SELECT {ids}, CAST(floor((b*114+g*587+r*299+500)/1000) AS INT) AS gray FROM px3"))


def statuses(s, f):
    """Orders as stacks, line items as frames: sizes follow the line status, so some stacks mix sizes."""
    li = d.table(s, f, "lineitem")
    fr = li.select(F.col("l_orderkey").alias("stack_id"), F.when(F.col("l_linestatus") == "O", 480).otherwise(360).alias("h"), F.lit(640).alias("w"), (F.col("l_quantity") > 1).alias("readable"))
    return ev.stack_status(fr)


add("P2_stack_status", statuses, """WITH g AS (SELECT l_orderkey AS stack_id, count(*) AS frames, count(DISTINCT l_linestatus = 'O') AS shapes, bool_and(l_quantity > 1) AS ok FROM lineitem GROUP BY 1),
 r AS (SELECT *, CASE WHEN NOT ok THEN 'unreadable frame' WHEN shapes > 1 THEN 'frames differ in size' WHEN frames < 2 THEN 'fewer than two frames' ELSE '' END AS reason FROM g)
 SELECT stack_id, frames, shapes, CASE WHEN reason = '' THEN 'ok' ELSE 'refused' END AS status, reason FROM r""")
add("P3_normalize_map", lambda s, f: ev.normalize_map(px(s, f), "v").select(*ID, "view"),
    Q().pixels().select(f"SELECT {ids}, CASE WHEN hi - lo < 1e-9 THEN 0 ELSE CAST(floor(round((v-lo)/(hi-lo)::DOUBLE*255, 6)) AS INT) END AS view FROM (SELECT *, min(v) OVER (PARTITION BY stack_id, frame) AS lo, max(v) OVER (PARTITION BY stack_id, frame) AS hi FROM px)"))
add("P4_selection_index", lambda s, f: fo.winner(fo.focus_measure(px(s, f))).select(*PX, ev.selection_index("winner", F.lit(5)).alias("index")),
    winner_sql(energy_sql(Q().pixels(), "laplacian")).select(f"SELECT {pxs}, CAST(floor(winner*255/4) AS INT) AS index FROM wn"))
add("P5_robust_normalize", lambda s, f: ev.robust_normalize(fo.focus_measure(px(s, f)), "e").select(*ID, r6("norm", "norm")),
    energy_sql(Q().pixels(), "laplacian").add("q", "SELECT stack_id, quantile_cont(e, 0.99) AS t FROM en GROUP BY ALL").select(f"SELECT {ids}, {s6('least(1, greatest(0, e/(t+1e-6)))', 'norm')} FROM en JOIN q USING (stack_id)"))
add("P6_soft_threshold", lambda s, f: st.derivatives(px(s, f), "v", ("lap1",)).select(*ID, r6(fc.soft_threshold("lap1", F.lit(40)), "shrunk")),
    Q().pixels().kernel("a", "px", LAP1, {"a": "v"}).select(f"SELECT {ids}, sign(a)*greatest(abs(a)-40, 0) + 0.0 AS shrunk FROM a"))
USABLE = "((x + y + frame) % 3 <> 0) AND NOT (x = 3 AND y = 3)"


def usability(s, f):
    e = fo.focus_measure(px(s, f)).withColumn("usable", F.expr(USABLE))
    return ev.apply_usability(e).select(*ID, r6("e", "e"))


add("P7_usability", usability, energy_sql(Q().pixels(), "laplacian").select(f"SELECT {ids}, CASE WHEN bool_or({USABLE}) OVER (PARTITION BY {pxs}) AND NOT ({USABLE}) THEN -1.0 ELSE {s6('e')} END AS e FROM en"))


def uweights(s, f):
    w = px(s, f).withColumn("usable", F.expr(USABLE)).withColumn("wt", (F.col("v") + 1) / 1000.0)
    return ev.usability_weights(w).select(*ID, r6("wt", "wt"))


add("P8_usability_weights", uweights, Q().pixels().add("m", f"SELECT *, CASE WHEN bool_or({USABLE}) OVER (PARTITION BY {pxs}) AND NOT ({USABLE}) THEN 0 ELSE (v+1)/1000.0::DOUBLE END AS wt FROM px")
    .select(f"SELECT {ids}, {s6(f'wt / (sum(wt) OVER (PARTITION BY {pxs}) + 1e-8)', 'wt')} FROM m"))
add("P9_dominance", lambda s, f: fo.best_two(fo.focus_measure(px(s, f))).select(*PX, "winner", r6("dominance", "dominance")),
    winner_sql(energy_sql(Q().pixels(), "laplacian")).select(f"SELECT {pxs}, winner, {s6('(e1-e2)/(e1+1e-6)', 'dominance')} FROM wn"))
DEC = "SELECT wn.*, (e1-e2)/(e1+1e-6) > 0.3 AND e1 > median(e1) OVER (PARTITION BY stack_id) AS decisive FROM wn"
add("P10_decisive", lambda s, f: ev.decisive(fo.best_two(fo.focus_measure(px(s, f), k=3))).select(*PX, F.col("decisive").cast("int").alias("decisive")),
    winner_sql(energy_sql(Q().pixels(), "laplacian", 3)).add("dc", DEC).select(f"SELECT {pxs}, CAST(decisive AS INT) AS decisive FROM dc"))
add("P11_saturated", lambda s, f: d.colour(px(s, f)).select(*ID, ev.saturated().cast("int").alias("saturated")),
    Q().pixels().colour().select(f"SELECT {ids}, CAST(greatest(b,g,r) >= 254 OR least(b,g,r) <= 1 AS INT) AS saturated FROM px3"))
GA, GB = taps1(gaussian_taps(1.0, 4)), taps1(gaussian_taps(3.0, 7))
add("P12_quiet", lambda s, f: ev.quiet(px(s, f), "v", F.lit(10.0)).select(*ID, F.col("quiet").cast("int").alias("quiet")),
    Q().pixels().sep("a", "px", GA, GA, {"a": "v"}).sep("b", "px", GB, GB, {"b": "v"}).add("q", f"SELECT a.*, abs(a-b) <= 20 AS q FROM a JOIN b USING ({ids})")
    .select(f"SELECT {ids}, CAST(q AND count_if(q) OVER (PARTITION BY stack_id, frame) >= 32 AS INT) AS quiet FROM q"))
add("P13_flank", lambda s, f: ev.flank(px(s, f), level=130, spread=31.0, k=3).select(*ID, F.col("flank").cast("int").alias("flank")),
    Q().pixels().add("p2", "SELECT *, v*v AS vv FROM px").box("b", "p2", 1, {"m": "v", "mm": "vv"}, carry=("v",)).select(f"SELECT {ids}, CAST(v > 130 AND sqrt(greatest(mm-m*m, 0)) < 31 AS INT) AS flank FROM b"))
add("P14_bin_texture", lambda s, f: ev.bin_texture(px(s, f), F.col("v") > 150, floor=150).select("stack_id", "frame", r6("gradient", "gradient"), F.col("textured").cast("int").alias("textured")),
    Q().pixels().kernel("a", "px", SOBEL_X, {"a": "v"}, carry=("v",)).kernel("b", "px", SOBEL_Y, {"b": "v"})
    .add("g", f"SELECT stack_id, frame, avg(sqrt(a*a+b*b)) FILTER (v > 150) AS g FROM a JOIN b USING ({ids}) GROUP BY ALL").select(f"SELECT stack_id, frame, {s6('g', 'gradient')}, CAST(coalesce(g >= 150, false) AS INT) AS textured FROM g"))
add("P15_shift_licence", lambda s, f: ev.shift_licence(d.observations(s, f).withColumn("stack_id", F.col("y")), F.lit(120), F.lit(240), "dx").select("stack_id", r6("largest", "largest"), r6("limit", "limit"), F.col("licensed").cast("int").alias("licensed")),
    Q().obs().select(f"SELECT y AS stack_id, {s6('max(abs(dx))', 'largest')}, {s6('0.015*sqrt(120*120+240*240)', 'limit')}, CAST(max(abs(dx)) <= 0.015*sqrt(120*120+240*240) AS INT) AS licensed FROM obs GROUP BY y"))


def licensed(s, f):
    li = d.table(s, f, "lineitem")
    c = li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).cast("double").alias("score"), (1 - F.col("l_tax")).cast("double").alias("purity"),
                  (1 - F.col("l_discount")).cast("double").alias("area_fit"), F.col("l_quantity").cast("double").alias("before"),
                  F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise((F.col("l_partkey") % 50).cast("double")).alias("after"))
    return c.select("l_orderkey", "l_linenumber", ev.candidate_licensed().cast("int").alias("licensed"))


add("P16_candidate_licence", licensed, """SELECT l_orderkey, l_linenumber, CAST(l_linenumber <> 7 AND CAST(l_quantity AS DOUBLE)/50 > 0.5 AND CAST(1-l_tax AS DOUBLE) > 0.85 AND CAST(1-l_discount AS DOUBLE) > 0.9
 AND (l_partkey % 50) / greatest(CAST(l_quantity AS DOUBLE), 1e-6) < 0.85 AS INT) AS licensed FROM lineitem""")


def strata(s, f):
    o = d.table(s, f, "orders")
    names = F.array(*[F.lit(n) for n in ev.STRATA])
    c = o.select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("stratum"), ((F.col("o_custkey") % 100) / 100.0).alias("core_fraction"),
                 (F.col("o_custkey") * 7 % 9000).alias("core_pixels"), (F.col("o_custkey") * 5 % 4000).alias("inner_veil_pixels"))
    return c.select("o_orderkey", "stratum", ev.stratum_matches("stratum").cast("int").alias("matches"))


add("P17_stratum", strata, """WITH c AS (SELECT o_orderkey, o_orderkey % 6 AS k, (o_custkey % 100) / 100.0::DOUBLE AS cf, o_custkey*7 % 9000 AS cp, o_custkey*5 % 4000 AS iv FROM orders)
 SELECT o_orderkey, CASE k WHEN 0 THEN 'primary' WHEN 1 THEN 'boundary' WHEN 2 THEN 'all_veil' WHEN 3 THEN 'solid' WHEN 4 THEN 'mixed' ELSE 'thin' END AS stratum,
 CAST(CASE k WHEN 0 THEN cf >= 0.75 AND cp >= 5000 WHEN 1 THEN cf >= 0.25 AND cf < 0.6 AND cp >= 1500 WHEN 2 THEN cf < 0.15 AND iv >= 2500
 WHEN 3 THEN cf >= 0.55 AND cp >= 2500 WHEN 4 THEN cf >= 0.15 AND cf < 0.55 AND cp >= 800 ELSE cf < 0.15 AND iv >= 2500 END AS INT) AS matches FROM c""")
add("P18_coverage_class", lambda s, f: px(s, f).select(*ID, ev.coverage_class(F.when(F.col("x") < 4, F.col("v") / 120).otherwise(F.col("v") / 4000), F.col("v") / 180).alias("class")),
    Q().pixels().add("c", "SELECT *, CASE WHEN x < 4 THEN v/120.0::DOUBLE ELSE v/4000.0::DOUBLE END AS a, v/180.0::DOUBLE AS c FROM px").select(f"""SELECT {ids}, CASE WHEN a >= 0.95 AND c >= 0.95 THEN 'core' WHEN a >= 0.95 AND c > 0.05 AND c < 0.95 THEN 'inner_veil'
    WHEN a < 0.05 AND c > 0.05 THEN 'outer_veil' ELSE 'none' END AS class FROM c"""))


def routes(s, f):
    o = d.table(s, f, "orders").join(d.table(s, f, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("frames"), F.count_if(F.col("l_returnflag") == "R").alias("overridden")), "o_orderkey")
    ok, why = ev.composite_route(F.when(F.col("o_orderstatus") == "F", "perband").otherwise("max"), "frames", "overridden")
    return o.select("o_orderkey", ok.cast("int").alias("routed"), why.alias("reason"))


add("P19_route", routes, """WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS o FROM lineitem GROUP BY 1)
 SELECT o_orderkey, CAST(o_orderstatus = 'F' AND n >= 3 AND o >= 1 AS INT) AS routed, CASE WHEN o_orderstatus <> 'F' THEN 'method does not fuse per band' WHEN n < 3 THEN 'fewer than three frames'
 WHEN o < 1 THEN 'no motion group was overridden' ELSE 'stranded object' END AS reason FROM orders JOIN l USING (o_orderkey)""")


def budget(s, f):
    g = st.gradient_magnitude(px(s, f), "v", "g", scale=8.0).select(*ID, "v", "g")
    a, b = g.filter("frame < 4").withColumn("_k", F.col("frame") + 1), g.select("stack_id", F.col("frame").alias("_k"), "y", "x", F.col("v").alias("v2"), F.col("g").alias("g2"))
    return a.join(b, ["stack_id", "_k", "y", "x"]).select(*ID, r6(ev.agreement_budget("g", "g2", "v", "v2", 1.0), "budget"))


add("P20_agreement_budget", budget, Q().pixels().kernel("a", "px", SOBEL_X, {"a": "v"}, carry=("v",)).kernel("b", "px", SOBEL_Y, {"b": "v"}).add("g", f"SELECT {ids}, v, sqrt(a*a+b*b)/8 AS g FROM a JOIN b USING ({ids})")
    .select(f"SELECT p.stack_id, p.frame, p.y, p.x, {s6('greatest(p.g, q.g) + 0.02*greatest(p.v, q.v) + 1', 'budget')} FROM g p JOIN g q ON q.stack_id=p.stack_id AND q.y=p.y AND q.x=p.x AND q.frame=p.frame+1"))
add("P21_blur_radius", lambda s, f: field(s, f).join(px(s, f).select(*ID), PX).select(*ID, r6(ev.blur_radius("peak", "frame", 1.4), "radius")),
    field_sql(Q().pixels()).select(f"SELECT px.stack_id, frame, px.y, px.x, {s6('1.4*abs(frame - peak)', 'radius')} FROM px JOIN fld USING ({pxs})"))


def points(s, f):
    o = d.observations(s, f)
    m = F.array(F.lit(1.0), F.lit(0.01), F.col("dx"), F.lit(-0.01), F.lit(1.0), F.col("dy"))
    u, v = fc.map_point(fc.homogeneous(m), "x", "y")
    return o.select("stack_id", "frame", "x", "y", "dx", "dy", r6(u, "sx"), r6(v, "sy")).withColumn("dx", F.round("dx", 6)).withColumn("dy", F.round("dy", 6))


add("P22_map_point", points, Q().obs().select(f"SELECT stack_id, frame, x, y, round(dx, 6) AS dx, round(dy, 6) AS dy, {s6('x + 0.01::DOUBLE*y + dx', 'sx')}, {s6('-0.01::DOUBLE*x + y + dy', 'sy')} FROM obs"))
add("W1_argmax", lambda s, f: fo.winner(fo.focus_measure(px(s, f), "tenengrad")).select(*PX, "winner"),
    winner_sql(energy_sql(Q().pixels(), "tenengrad")).select(f"SELECT {pxs}, winner FROM wn"))
add("W2_best_two", lambda s, f: fo.best_two(fo.focus_measure(px(s, f), "tenengrad")).select(*PX, "winner", r6("e1", "e1"), r6("e2", "e2")),
    winner_sql(energy_sql(Q().pixels(), "tenengrad")).select(f"SELECT {pxs}, winner, {s6('e1', 'e1')}, {s6('e2', 'e2')} FROM wn"))
