"""G, J and I rows: displacements, fields, refusals, components."""

from pyspark.sql import functions as F

from checks.q_a_kernels import ID, ids, one_px, pair_px, px, sq, taps1
from checks.q_b_focus import PX, pxs
from checks.q_e_stats import KEY, key
from checks.registry import Q, add, r6, s6
from sharpfleet.functions.taps import gaussian_taps
from sharpfleet.operators import graph as gr
from sharpfleet.operators import registration as rg
from sharpfleet.sources import derived as d

NCC = lambda q, src, reach, region: q.add("sh", f"SELECT a.stack_id, b.frame, {region} AS region, b.y-a.y AS dy, b.x-a.x AS dx, a.v AS a, b.v AS b FROM {src} a JOIN {src} b ON b.stack_id=a.stack_id AND abs(b.y-a.y)<={reach} AND abs(b.x-a.x)<={reach} AND b.frame<>2 WHERE a.frame=2")\
    .add("sc", "SELECT stack_id, frame, region, dy, dx, count(*) AS n, round((count(*)*sum(a*b)-sum(a)*sum(b))/sqrt((count(*)*sum(a*a)-sum(a)*sum(a))::DOUBLE*(count(*)*sum(b*b)-sum(b)*sum(b))), 9) AS ncc FROM sh GROUP BY ALL")
region = lambda: (F.floor(F.col("y") / 20) * 2 + F.floor(F.col("x") / 20)).cast("int")
RSQL = "CAST((a.y//20)*2 + a.x//20 AS INT)"
add("J12_shift_search", lambda s, f: rg.shift_scores(px(s, f, 5), 2, 1, region(), side=20).withColumn("ncc", F.round("ncc", 6)),
    NCC(Q().pixels(5), "px", 1, RSQL).select("SELECT stack_id, frame, region, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, n, round(ncc, 6) + 0.0 AS ncc FROM sc"))
BEST = "SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY stack_id, frame, region ORDER BY ncc DESC, dy, dx) = 1"
PAR = lambda l, r: f"CASE WHEN {l}.ncc IS NULL OR {r}.ncc IS NULL OR abs({l}.ncc-2*b.ncc+{r}.ncc) <= 1e-9 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5*({l}.ncc-{r}.ncc)/({l}.ncc-2*b.ncc+{r}.ncc))) END"
nb = lambda n, oy, ox: f"LEFT JOIN sc {n} ON {n}.stack_id=b.stack_id AND {n}.frame=b.frame AND {n}.region=b.region AND {n}.dy=b.dy+({oy}) AND {n}.dx=b.dx+({ox})"
TRANS = f"SELECT b.stack_id, b.frame, b.region, b.dx + {PAR('l', 'r')} AS dx, b.dy + {PAR('u', 'd')} AS dy, b.ncc AS response FROM bs b {nb('l', 0, -1)} {nb('r', 0, 1)} {nb('u', -1, 0)} {nb('d', 1, 0)}"
add("G1_translation", lambda s, f: rg.translation(rg.shift_scores(px(s, f, 5), 2, 1, region()), 1.2).select(*KEY, "region", r6("dx", "dx"), r6("dy", "dy"), r6("response", "response")),
    NCC(Q().pixels(5), "px", 1, RSQL).add("bs", BEST).add("t", TRANS).select(f"SELECT {key}, region, {s6('CASE WHEN sqrt(dx*dx+dy*dy) <= 1.2 THEN dx END', 'dx')}, {s6('CASE WHEN sqrt(dx*dx+dy*dy) <= 1.2 THEN dy END', 'dy')}, {s6('response', 'response')} FROM t"))


def tiles(s, f):
    p = px(s, f, 5)
    depth = p.filter("frame = 0").select(*PX, (F.col("v") / 255.0).alias("depth"))
    return rg.tile_field(p, 2, 1, 20, depth, response=0.0)


add("G3_tile_field", lambda s, f: tiles(s, f).select(*KEY, "x", "y", *[r6(c, c) for c in ("depth", "dx", "dy", "response")]),
    NCC(Q().pixels(5), "px", 1, "CAST((a.y//20)*65536 + a.x//20 AS INT)").add("bs", BEST).add("t", TRANS).add("md", "SELECT stack_id, CAST((y//20)*65536 + x//20 AS INT) AS region, median(v/255.0::DOUBLE) AS depth FROM px WHERE frame = 0 GROUP BY ALL")
    .select(f"SELECT t.stack_id, frame, (region%65536)*20+9.5::DOUBLE AS x, (region//65536)*20+9.5::DOUBLE AS y, {s6('depth', 'depth')}, {s6('dx', 'dx')}, {s6('dy', 'dy')}, {s6('response', 'response')} FROM t JOIN md USING (stack_id, region) WHERE response >= 0 AND sqrt(dx*dx+dy*dy) <= 1"))
add("G2_affine", lambda s, f: rg.affine_from_tiles(d.observations(s, f).withColumn("response", F.col("w"))).select(*KEY, "tiles", F.col("failed").cast("int").alias("failed"), *[r6(F.element_at("m", i + 1), f"m{i}") for i in range(6)]),
    Q().obs().add("c", f"SELECT {key}, x, y, dx, dy, w, sum(w*x) OVER g / sum(w) OVER g AS mx, sum(w*y) OVER g / sum(w) OVER g AS my, sum(w*dx) OVER g / sum(w) OVER g AS mu, sum(w*dy) OVER g / sum(w) OVER g AS mv FROM obs WINDOW g AS (PARTITION BY {key})")
    .add("s", f"SELECT {key}, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, sum(w*(x-mx)*(x-mx)) AS xx, sum(w*(x-mx)*(y-my)) AS xy, sum(w*(y-my)*(y-my)) AS yy, sum(w*(x-mx)*(dx-mu)) AS xu, sum(w*(y-my)*(dx-mu)) AS yu, sum(w*(x-mx)*(dy-mv)) AS xv, sum(w*(y-my)*(dy-mv)) AS yv FROM c GROUP BY {key}")
    .add("t", "SELECT *, (yy*xu-xy*yu)/(xx*yy-xy*xy) AS a, (xx*yu-xy*xu)/(xx*yy-xy*xy) AS b, (yy*xv-xy*yv)/(xx*yy-xy*xy) AS c, (xx*yv-xy*xv)/(xx*yy-xy*xy) AS d FROM s")
    .select(f"SELECT {key}, n AS tiles, 0 AS failed, {s6('1+a', 'm0')}, {s6('b', 'm1')}, {s6('mu-a*mx-b*my', 'm2')}, {s6('c', 'm3')}, {s6('1+d', 'm4')}, {s6('mv-c*mx-d*my', 'm5')} FROM t"))
dep = lambda s, f: px(s, f, 5).filter("frame = 0").select(*PX, (F.when(F.col("v") > 140, 0.5 + F.col("v") / 512.0).otherwise(F.col("v") / 512.0)).alias("depth"))
DEP = "SELECT stack_id, y, x, CASE WHEN v > 140 THEN 0.5 + v/512.0::DOUBLE ELSE v/512.0::DOUBLE END AS depth FROM px WHERE frame = 0"


def bins_sql():
    from sharpfleet.functions.taps import gaussian_taps
    q = Q().pixels(5).add("dp", DEP).add("hs", "SELECT stack_id, CAST(least(95, floor(depth*96)) AS INT) AS bin, count(*) AS n FROM dp GROUP BY ALL")
    q.add("hc", "SELECT g.stack_id, g.bin, coalesce(n, 0) AS n FROM (SELECT stack_id, bin FROM (SELECT DISTINCT stack_id FROM dp), (SELECT unnest(range(96)) AS bin)) g LEFT JOIN hs USING (stack_id, bin)")
    rows = ", ".join(f"({k-4}, {t!r}::DOUBLE)" for k, t in enumerate(gaussian_taps(2.0, 4)))
    q.add("sm", f"SELECT p.stack_id, p.bin, sum(t.k*q.n) AS s FROM hc p, (VALUES {rows}) t(o, k), hc q WHERE q.stack_id=p.stack_id AND q.bin = CASE WHEN p.bin+t.o < 0 THEN -(p.bin+t.o) WHEN p.bin+t.o > 95 THEN 190-(p.bin+t.o) ELSE p.bin+t.o END GROUP BY ALL")
    q.add("ex", "SELECT stack_id, bin, s, round(least(max(s) OVER (PARTITION BY stack_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(s) OVER (PARTITION BY stack_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) - s, 9) AS p, lag(s) OVER (PARTITION BY stack_id ORDER BY bin) AS a, lead(s) OVER (PARTITION BY stack_id ORDER BY bin) AS c FROM sm")
    q.add("va", "SELECT stack_id, (bin+0.5)/96::DOUBLE AS e FROM ex WHERE s <= a AND s <= c AND p > 0 QUALIFY row_number() OVER (PARTITION BY stack_id ORDER BY p DESC, bin DESC) <= 2")
    q.add("ed", "SELECT stack_id, e FROM va UNION SELECT stack_id, unnest([0.0::DOUBLE, 1.0::DOUBLE]) FROM (SELECT DISTINCT stack_id FROM va)")
    q.add("bn", "SELECT stack_id, row_number() OVER (PARTITION BY stack_id ORDER BY e) - 1 AS bin, e AS lo, lead(e) OVER (PARTITION BY stack_id ORDER BY e) AS hi, count(*) OVER (PARTITION BY stack_id) AS n FROM ed")
    return q.select("SELECT dp.stack_id, CAST(bin AS INT) AS bin, count(*) AS pixels FROM dp JOIN bn ON bn.stack_id=dp.stack_id AND depth >= lo AND (depth < hi OR (bin = n-2 AND depth <= hi)) WHERE hi IS NOT NULL GROUP BY ALL")


add("G4_depth_bins", lambda s, f: rg.assign_bins(dep(s, f), rg.depth_bins(dep(s, f), 3)).groupBy("stack_id", "bin").agg(F.count("*").alias("pixels")), bins_sql())


def g7(s, f):
    """Displacement linear in depth per frame, evaluated at every observation."""
    from sharpfleet.operators import stats as sa
    from sharpfleet.operators.grid import attach
    o = d.observations(s, f)
    line = sa.straight_line(o, KEY, "dx", "depth").select(*KEY, "slope", "intercept")
    return attach(o, line, KEY).select(*KEY, "x", "y", r6("depth", "depth"), r6(F.col("slope") * F.col("depth") + F.col("intercept"), "field"))


add("G7_linear_depth_field", g7, Q().obs().add("l", f"SELECT {key}, regr_slope(dx, depth) AS a, regr_intercept(dx, depth) AS b FROM obs GROUP BY ALL").select(f"SELECT {key}, x, y, {s6('depth', 'depth')}, {s6('a*depth+b', 'field')} FROM obs JOIN l USING ({key})"))
fieldpx = lambda s, f, t=2: px(s, f, t).withColumns({"sx": F.col("x") + F.col("v") / 100.0, "sy": F.col("y") - F.col("v") / 200.0})


def cd(q, src, c, out, w):
    return q.add(out, f"""SELECT p.stack_id, p.frame, p.y, p.x, (r.{c}-l.{c})/(r.x-l.x)::DOUBLE AS gx, (b.{c}-a.{c})/(b.y-a.y)::DOUBLE AS gy FROM {src} p
    JOIN {src} l ON l.stack_id=p.stack_id AND l.frame=p.frame AND l.y=p.y AND l.x=greatest(p.x-1,0) JOIN {src} r ON r.stack_id=p.stack_id AND r.frame=p.frame AND r.y=p.y AND r.x=least(p.x+1,{w-1})
    JOIN {src} a ON a.stack_id=p.stack_id AND a.frame=p.frame AND a.x=p.x AND a.y=greatest(p.y-1,0) JOIN {src} b ON b.stack_id=p.stack_id AND b.frame=p.frame AND b.x=p.x AND b.y=least(p.y+1,{w-1})""")


add("G11_field_stretch", lambda s, f: rg.field_stretch(fieldpx(s, f)).select(*KEY, r6("stretch", "stretch")),
    cd(cd(Q().pixels(2).add("fp", "SELECT *, x + v/100.0::DOUBLE AS sx, y - v/200.0::DOUBLE AS sy FROM px"), "fp", "sx", "ca", 16), "fp", "sy", "cb", 16)
    .select(f"SELECT {key}, {s6('quantile_cont(greatest(abs(ca.gx-1), abs(ca.gy), abs(cb.gx), abs(cb.gy-1)), 0.999)', 'stretch')} FROM ca JOIN cb USING ({ids}) GROUP BY ALL"))
disp = lambda s, f: px(s, f, 2).withColumns({"dispx": F.col("v") / 40.0, "dispy": F.col("v") / 80.0, "edge": F.col("v") > 190, "dom": F.col("v") / 200.0})


def limited(s, f):
    """A slope below the tolerance with the image's own texture on it: some pixels stay, some are mixed, some are smoothed outright."""
    field = px(s, f, 2).withColumns({"dispx": F.col("x") * 0.05 + F.col("v") / 400.0, "dispy": F.col("y") * 0.05 - F.col("v") / 800.0})
    return rg.limit_stretch(field, rounds=2, sigma=0.6).select(*ID, r6("dispx", "dispx"), r6("dispy", "dispy"))


def limited_sql(rounds=2, tolerance=0.1):
    q = Q().pixels(2).add("ls0", "SELECT *, x*0.05::DOUBLE + v/400.0::DOUBLE AS dispx, y*0.05::DOUBLE - v/800.0::DOUBLE AS dispy FROM px")
    taps, near = taps1(gaussian_taps(0.6, 2)), lambda t, ax, k: f"LEFT JOIN {{0}} {t} ON {t}.stack_id=p.stack_id AND {t}.frame=p.frame AND {t}.y=p.y{k if ax == 'y' else ''} AND {t}.x=p.x{k if ax == 'x' else ''}"
    joins = " ".join(near(*t) for t in (("l", "x", "-1"), ("r", "x", "+1"), ("a", "y", "-1"), ("b", "y", "+1")))
    step = lambda c, lo, hi, ax, size: f"abs(coalesce({hi}.{c}, p.{c}) - coalesce({lo}.{c}, p.{c})) / CASE WHEN p.{ax} IN (0, p.{size}-1) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END"
    steps = ", ".join(step(c, *t) for c in ("dispx", "dispy") for t in (("l", "r", "x", "w"), ("a", "b", "y", "h")))
    for i in range(rounds):
        q.add(f"le{i}", f"SELECT p.*, least(1, greatest(0, (greatest({steps}) - {tolerance}::DOUBLE) / {tolerance}::DOUBLE)) AS ex FROM ls{i} p {joins.format(f'ls{i}')}")
        q.sep(f"lg{i}", f"le{i}", taps, taps, {"ex": "ex", "sx": "dispx", "sy": "dispy"}, carry=("dispx", "dispy"))
        q.add(f"ls{i + 1}", f"SELECT {ids}, h, w, (1-ex)*dispx + ex*sx AS dispx, (1-ex)*dispy + ex*sy AS dispy FROM lg{i}")
    return q.select(f"SELECT {ids}, {s6('dispx', 'dispx')}, {s6('dispy', 'dispy')} FROM ls{rounds}")


add("G10_limit_stretch", limited, limited_sql())


def occ_sql():
    q = Q().pixels(2).add("dp", "SELECT *, CAST(v > 190 AS INT) AS e FROM px")
    for r in (1, 2, 4):
        one = {o: 1.0 for o in range(-r, r + 1)}
        q.sep(f"hi{r}", "dp", one, one, {"hi": "v"} , border="none", agg="max") if False else None
        q.kernel(f"hi{r}", "dp", sq(r), {"hi": "v", "e": "e"}, border="none", agg="max").kernel(f"lo{r}", "dp", sq(r), {"lo": "v"}, border="none", agg="min")
    cond = " OR ".join(f"(({'hi%d.hi' % r} - lo{r}.lo)/40.0::DOUBLE > greatest({float(r)}, 1.5) AND hi{r}.e > 0)" for r in (1, 2, 4))
    joins = "".join(f" JOIN hi{r} USING ({ids}) JOIN lo{r} USING ({ids})" for r in (1, 2, 4))
    return q.select(f"SELECT {ids}, CAST({cond} AS INT) AS occluded FROM px{joins}")


add("G12_occlusion", lambda s, f: rg.occlusion(disp(s, f), 1.5, 4).select(*ID, F.col("occluded").cast("int").alias("occluded")), occ_sql())
add("G13_transition_refusal", lambda s, f: rg.transition_refusal(disp(s, f), "dom", r=2, spread=3.01).select(*ID, F.col("refused").cast("int").alias("refused")),
    Q().pixels(2).kernel("hi", "px", sq(2), {"hi": "v"}, border="none", agg="max", carry=("v",)).kernel("lo", "px", sq(2), {"lo": "v"}, border="none", agg="min")
    .select(f"SELECT {ids}, CAST(v/200.0::DOUBLE < 0.9 AND greatest((hi-lo)/40.0::DOUBLE, (hi-lo)/80.0::DOUBLE) > 3.01 AS INT) AS refused FROM hi JOIN lo USING ({ids})"))
add("G14_footprint_crop", lambda s, f: rg.footprint_crop(px(s, f).withColumn("ok", F.col("v") > 75), "ok", ["v"]).groupBy("stack_id").agg((F.max("h") * F.max("w")).alias("area"), F.count("*").alias("rows")),
    Q().pixels().add("nf", "SELECT stack_id, count(DISTINCT frame) AS frames FROM px GROUP BY ALL").add("al", f"SELECT {pxs}, bool_and(v > 75) AS ok FROM px GROUP BY ALL").add("r", "SELECT *, CASE WHEN ok THEN y - coalesce(max(CASE WHEN NOT ok THEN y END) OVER (PARTITION BY stack_id, x ORDER BY y), -1) ELSE 0 END AS run FROM al")
    .add("c", "SELECT a.stack_id, a.y, a.x AS xa, b.x AS xb, min(c.run) AS mh FROM r a JOIN r b ON b.stack_id=a.stack_id AND b.y=a.y AND b.x >= a.x JOIN r c ON c.stack_id=a.stack_id AND c.y=a.y AND c.x BETWEEN a.x AND b.x GROUP BY ALL")
    .select('SELECT stack_id, CAST(max((xb-xa+1)*mh) AS INT) AS area, CAST(max(frames)*max((xb-xa+1)*mh) AS BIGINT) AS "rows" FROM c JOIN nf USING (stack_id) GROUP BY stack_id HAVING max((xb-xa+1)*mh) > 0'))


def overridden(s, f):
    p = px(s, f)
    base = p.select(*ID, (F.col("x") * 1.0).alias("sx"), (F.col("y") * 1.0).alias("sy"))
    prop = p.filter("x >= 3").select(*ID, (F.col("x") + 2.0).alias("sx"), (F.col("y") - 1.0).alias("sy"), (F.col("v") / 200.0).alias("own"), (F.col("v") % 5).alias("amb"))
    return rg.override(base, prop, "own", "amb").select(*ID, "sx", "sy", "state")


add("G16_override", overridden, Q().pixels().add("o", "SELECT *, CASE WHEN x >= 3 THEN v/200.0::DOUBLE ELSE 0 END AS own, CASE WHEN x >= 3 THEN v % 5 END AS amb FROM px")
    .select(f"SELECT {ids}, CASE WHEN own >= 0.9 THEN x+2.0::DOUBLE ELSE x::DOUBLE END AS sx, CASE WHEN own >= 0.9 THEN y-1.0::DOUBLE ELSE y::DOUBLE END AS sy, CASE WHEN own >= 0.9 THEN 'replaced' WHEN own > 0.1 AND amb > 2 THEN 'refused' ELSE 'kept' END AS state FROM o"))


def series(s, f):
    o = d.observations(s, f)
    fits = o.groupBy(*KEY).agg(F.array(F.avg("dx"), F.avg("dy")).alias("delta"), F.sum("w").alias("weight")).filter(F.col("delta")[0] > 0)  # no evidence elsewhere
    frames = o.select(*KEY).distinct()
    return rg.motion_series(fits, ["stack_id"], 2, frames, F.lit(0.5), 4).select(*KEY, "entry", r6("value", "value"))


add("G20_motion_series", series, Q().obs().add("f", f"SELECT {key}, avg(dx) AS dx, avg(dy) AS dy, sum(w) AS w FROM obs GROUP BY ALL").add("e", f"SELECT {key}, 0 AS entry, dx AS d, w, dx FROM f UNION ALL SELECT {key}, 1, dy, w, dx FROM f")
    .add("s", "SELECT stack_id, entry, sum(w*(frame-4)*d)/sum(w*(frame-4)*(frame-4)) AS a FROM e WHERE dx > 0 GROUP BY ALL HAVING sum(w*(frame-4)*(frame-4)) > 0")
    .select(f"SELECT e.stack_id, e.frame, e.entry, {s6('coalesce(a*(e.frame-4), 0) + 0.5', 'value')} FROM e LEFT JOIN s ON s.stack_id=e.stack_id AND s.entry=e.entry"))


def gaps(s, f):
    o = d.observations(s, f)
    g = o.groupBy(*KEY).agg(F.avg("dx").alias("u"), F.avg("dy").alias("v"))
    mk = lambda k: g.select(*KEY, F.array(F.lit(1.0) + F.col("u") / 100 * k, F.lit(0.0), F.col("u"), F.lit(0.0), F.lit(1.0), F.col("v") * k).alias("m"))
    return rg.affine_gap(mk(1), mk(2), o, KEY).select(*KEY, r6("shift_gap", "shift_gap"), r6("scale_gap", "scale_gap"))


add("G21_affine_gap", gaps, Q().obs().add("g", f"SELECT {key}, avg(dx) AS u, avg(dy) AS v, avg(x) AS cx, avg(y) AS cy FROM obs GROUP BY ALL").select(f"SELECT {key}, {s6('sqrt(power(u/100*cx, 2) + v*v)', 'shift_gap')}, {s6('abs(sqrt(abs(1+u/100)) - sqrt(abs(1+u/50)))', 'scale_gap')} FROM g"))
flags = lambda s, f: px(s, f).withColumns({"footprint": F.col("x") == 0, "occlusion": F.col("v") > 180, "gate": F.col("v") % 3 == 0})
add("G24_gap_ledger", lambda s, f: rg.gap_ledger(flags(s, f), ["footprint", "occlusion", "gate"]).select("stack_id", "frame", "pixels", *[r6(c, c) for c in ("footprint", "occlusion", "gate", "kept")]),
    Q().pixels().add("f", "SELECT stack_id, frame, CASE WHEN x = 0 THEN 1 WHEN v > 180 THEN 2 WHEN v % 3 = 0 THEN 3 ELSE 0 END AS c FROM px").select("SELECT stack_id, frame, count(*) AS pixels, " + ", ".join(s6(f"avg(CAST(c = {i} AS INT))", n) for i, n in ((1, "footprint"), (2, "occlusion"), (3, "gate"), (0, "kept"))) + " FROM f GROUP BY ROLLUP (stack_id, frame) HAVING stack_id IS NOT NULL"))
add("G27_monotone_check", lambda s, f: rg.monotone_violations(px(s, f).withColumns({"a": F.col("v") > 50, "b": F.col("v") > 90, "c": F.col("v") > 85}), ["a", "b", "c"]),
    Q().pixels().select(f"SELECT {key}, count(*) FILTER (v > 85 AND v <= 90) AS violations FROM px GROUP BY ALL"))

# ---- I rows
CCQ = lambda q, src, extra="": q.add("cc", f"""SELECT stack_id, y, x, min(root) AS root FROM (
   WITH RECURSIVE walk(stack_id, y, x, root) AS (SELECT stack_id, y, x, y*100+x FROM {src} UNION SELECT n.stack_id, n.y, n.x, w.root FROM walk w JOIN {src} n ON n.stack_id=w.stack_id AND (abs(n.y-w.y)+abs(n.x-w.x) = 1 {extra})) SELECT * FROM walk) GROUP BY ALL""")
one = lambda s, f: one_px(s, f)
add("I1_components", lambda s, f: gr.component_table(gr.components(one(s, f).filter("v > 115"))).select("stack_id", "area", "y0", "x0", "y1", "x1"),
    CCQ(Q().frames().add("onp", "SELECT * FROM px WHERE v > 115"), "onp").select("SELECT stack_id, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM cc GROUP BY stack_id, root"))
add("V24_fill_holes", lambda s, f: gr.fill_holes(one(s, f).withColumn("m", F.col("v") > 100), "m").select(*PX, F.col("filled").cast("int").alias("filled")),
    CCQ(Q().frames().add("onp", "SELECT * FROM px WHERE v <= 100"), "onp").add("op", "SELECT stack_id, root, bool_or(y IN (0,7) OR x IN (0,7)) AS o FROM cc GROUP BY ALL")
    .select("SELECT px.stack_id, px.y, px.x, CAST(px.v > 100 OR NOT o AS INT) AS filled FROM px LEFT JOIN cc ON cc.stack_id=px.stack_id AND cc.y=px.y AND cc.x=px.x LEFT JOIN op ON op.stack_id=cc.stack_id AND op.root=cc.root"))


def clusters(s, f):
    from sharpfleet.functions.quantiles import exact_quantiles
    p = one(s, f)
    return gr.residual_clusters(p, "v", exact_quantiles(p, ["stack_id"], "v", {"cutoff": 0.7}), ["stack_id"], 3, 2).select("stack_id", "area", "mass", "peak", r6("mean", "mean"), "place")


add("I3_residual_clusters", clusters, CCQ(Q().frames().add("q", "SELECT stack_id, quantile_cont(v, 0.7) AS c FROM px GROUP BY ALL").add("onp", "SELECT px.* FROM px JOIN q USING (stack_id) WHERE v > c"), "onp", "OR (abs(n.y-w.y) = 1 AND abs(n.x-w.x) = 1)")
    .add("g", "SELECT cc.stack_id, root, count(*) AS area, CAST(sum(v) AS BIGINT) AS mass, max(v) AS peak, avg(v) AS mean FROM cc JOIN on_ o USING (stack_id, y, x) GROUP BY ALL".replace("on_ o", 'onp o').replace("cc.stack_id, root", "stack_id, root"))
    .select(f"SELECT stack_id, area, mass, peak, {s6('mean', 'mean')}, CAST(row_number() OVER (PARTITION BY stack_id ORDER BY mass DESC, root) AS INT) AS place FROM g WHERE area >= 3 QUALIFY place <= 2"))
add("E15_coherence", lambda s, f: gr.coherent(gr.components(one(s, f).filter("v > 130"), ("stack_id",)), ["stack_id"]).select("stack_id", r6("share", "share"), F.col("coherent").cast("int").alias("coherent")),
    CCQ(Q().frames().add("onp", "SELECT * FROM px WHERE v > 130"), "onp").add("a0", "SELECT stack_id, root, count(*) AS n FROM cc GROUP BY ALL").add("a", "SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY n DESC, root) AS k FROM a0")
    .add("g", "SELECT stack_id, (sum(n) FILTER (k <= 3))/sum(n)::DOUBLE AS s FROM a GROUP BY ALL").select(f"SELECT stack_id, {s6('s', 'share')}, CAST(s >= 0.6 AS INT) AS coherent FROM g"))
def hull_sql():
    """Upper and lower chain from left to right: the next corner is that of the steepest (flattest) way, the farthest of equal ones."""
    q = Q().obs().add("pt", f"SELECT {key}, CAST(x AS DOUBLE) AS x, CAST(min(y) AS DOUBLE) AS lo, CAST(max(y) AS DOUBLE) AS hi FROM obs GROUP BY {key}, x")
    for name, v, way in (("up", "hi", "arg_max"), ("dn", "lo", "arg_min")):
        far = "n.x" if way == "arg_max" else "-n.x"
        q.parts.append(f"""{name} AS (SELECT {key}, x, {v} AS y FROM pt QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY x) = 1 UNION ALL
            SELECT stack_id, frame, g.x, g.y FROM (SELECT c.stack_id, c.frame, {way}({{'x': n.x, 'y': n.{v}}}, {{'s': (n.{v}-c.y)/(n.x-c.x), 'f': {far}}}) AS g
            FROM {name} c JOIN pt n ON n.stack_id = c.stack_id AND n.frame = c.frame AND n.x > c.x GROUP BY c.stack_id, c.frame))""")
    q.add("ud", f"SELECT {key}, x, y, true AS up FROM up UNION ALL SELECT {key}, x, y, false FROM dn")
    q.add("ar", f"SELECT *, (y + lag(y) OVER w) * (x - lag(x) OVER w) / 2 * (CASE WHEN up THEN 1 ELSE -1 END) AS a FROM ud WINDOW w AS (PARTITION BY {key}, up ORDER BY x)")
    return q.select(f"SELECT {key}, count(DISTINCT (x, y)) AS corners, {s6('sum(a)', 'area')} FROM ar GROUP BY ALL")


add("I4_hull", lambda s, f: gr.hull(d.observations(s, f), KEY).select(*KEY, F.size("ring").cast("long").alias("corners"), r6("area", "area")), hull_sql())