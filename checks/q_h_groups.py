"""E, T and J rows on features, V rows on masks and pixels."""

from pyspark.sql import functions as F

from checks.q_a_kernels import ID, ids, one_px, pair_px, px, sq
from checks.q_b_focus import DEC, FIELD, PEAK, PX, energy_sql, field_sql, pxs, winner_sql
from checks.q_c_resample import sample_sql
from checks.q_e_stats import KEY, SUMS, TR, key, otsu_sql
from checks.registry import Q, SOBEL_X, SOBEL_Y, add, r6, s6
from sharpfleet.operators import evidence as ev
from sharpfleet.operators import focus as fo
from sharpfleet.operators import groups as gp
from sharpfleet.operators import masks as ma
from sharpfleet.operators import ownership as ow
from sharpfleet.operators import ranking as rk
from sharpfleet.operators import stats as sa
from sharpfleet.operators import stencil as st
from sharpfleet.sources import derived as d

meas = d.measures
MOT = lambda s, f: sa.normal_translation(meas(s, f), KEY, "score").select(*KEY, "mx", "my")
mot_q = lambda: Q().measure().add("sm", f"SELECT {key}, {SUMS} FROM measure GROUP BY ALL").add("tr", TR)
RES = "SELECT m.stack_id, feature_id, nx, ny, sqrt(avg(power(mx*nx+my*ny-shift, 2))) AS rms, count(*) AS frames FROM measure m JOIN tr ON tr.stack_id=m.stack_id AND tr.frame=m.frame GROUP BY ALL HAVING count(*) >= 3"
add("E3_residuals", lambda s, f: gp.residuals(meas(s, f), MOT(s, f)).select("stack_id", "feature_id", "frames", r6("rms", "rms")),
    mot_q().add("re", RES).select(f"SELECT stack_id, feature_id, frames, {s6('rms', 'rms')} FROM re"))


def cons(s, f):
    m = MOT(s, f).withColumn("mx", F.col("mx") * 3)
    return gp.consensus(gp.residuals(meas(s, f), m), m, inlier=3.0).select("stack_id", "feature_id", r6("rms", "rms"), r6("seen", "seen"))


add("E4_consensus", cons, mot_q().add("tq", f"SELECT {key}, mx*3 AS mx, my FROM tr").add("re", RES.replace(" tr ", " tq ").replace("tr.", "tq.")).add("mg", "SELECT stack_id, max(sqrt(mx*mx+my*my)) AS mag FROM tq GROUP BY ALL")
    .add("se", "SELECT re.stack_id, feature_id, rms, max(abs(mx*nx+my*ny)) AS seen FROM re JOIN tq ON tq.stack_id=re.stack_id WHERE rms < 3 GROUP BY ALL").select(f"SELECT se.stack_id, feature_id, {s6('rms', 'rms')}, {s6('seen', 'seen')} FROM se JOIN mg USING (stack_id) WHERE mag < 3 OR seen >= 3"))
focal = lambda s, f: meas(s, f).select("stack_id", "feature_id", (F.col("feature_id") % 7 + 1).alias("focal")).distinct()
add("E7_group_motion", lambda s, f: gp.group_motion(meas(s, f), focal(s, f), meas(s, f).select(*KEY).distinct(), ["stack_id"], 88.0).select(*KEY, r6("mx", "mx"), r6("my", "my"), F.col("trusted").cast("int").alias("trusted")),
    Q().measure().add("mw", "SELECT *, score*exp(-0.5*power((frame-(feature_id % 7 + 1))/2.5, 2)) AS fw FROM measure").add("sm", f"SELECT {key}, {SUMS.replace('score', 'fw')}, sum(fw) AS wt FROM mw GROUP BY ALL").add("tr", TR).add("t2", f"SELECT tr.*, wt FROM tr JOIN sm USING ({key}) WHERE tr.n >= 3")
    .add("pr", "SELECT a.stack_id, a.frame, b.frame AS f, b.mx, b.my FROM t2 a JOIN t2 b ON b.stack_id=a.stack_id AND b.wt >= 88 QUALIFY row_number() OVER (PARTITION BY a.stack_id, a.frame ORDER BY abs(b.frame-a.frame), b.frame) <= 4")
    .add("g", "SELECT stack_id, frame, max(mx) FILTER (f = frame) AS ox, max(my) FILTER (f = frame) AS oy, count(*) AS n, regr_slope(mx, f)*any_value(frame) + regr_intercept(mx, f) AS lx, regr_slope(my, f)*any_value(frame) + regr_intercept(my, f) AS ly FROM pr GROUP BY stack_id, frame")
    .select(f"SELECT {key}, {s6('coalesce(ox, lx)', 'mx')}, {s6('coalesce(oy, ly)', 'my')}, CAST(ox IS NOT NULL AS INT) AS trusted FROM g WHERE ox IS NOT NULL OR n >= 2"))
add("E2_confident", lambda s, f: gp.confident(meas(s, f), 0.5, 3.5).select("feature_id", "frame", r6("shift", "shift"), r6("score", "score")),
    Q().measure().select(f"SELECT feature_id, frame, {s6('shift', 'shift')}, {s6('score', 'score')} FROM measure WHERE score >= 0.5 AND abs(shift) < 3.5"))
DIS = "SELECT m.*, abs(shift-(mx*nx+my*ny)) AS d FROM measure m JOIN tr ON tr.stack_id=m.stack_id AND tr.frame=m.frame"
add("E11_screen", lambda s, f: gp.screen(meas(s, f), MOT(s, f)), mot_q().add("di", DIS).select("SELECT stack_id, count(DISTINCT feature_id) AS disagreeing FROM di WHERE d > 2 GROUP BY ALL HAVING count(DISTINCT feature_id) >= 4"))


def elected(s, f):
    m = meas(s, f)
    members = m.select("stack_id", "feature_id", (F.col("feature_id") % 5).alias("group_id")).distinct()
    areas = members.groupBy("stack_id", "group_id").agg((F.countDistinct("feature_id") % 10 / 20.0).alias("share"))
    return gp.elect(m, members, MOT(s, f), areas, ["stack_id", "group_id"], 2.0).select("stack_id", "group_id", r6("disagreement", "disagreement"), F.col("elected").cast("int").alias("elected"))


add("E10_election", elected, mot_q().add("di", DIS).add("md", f"SELECT stack_id, feature_id % 5 AS group_id, frame, quantile_cont(d, 0.5) AS m FROM di GROUP BY ALL").add("ar", "SELECT stack_id, feature_id % 5 AS group_id, (count(DISTINCT feature_id) % 10)/20.0::DOUBLE AS share FROM measure GROUP BY ALL")
    .add("x", "SELECT stack_id, group_id, max(m) AS dg FROM md GROUP BY ALL").select(f"SELECT stack_id, group_id, {s6('dg', 'disagreement')}, CAST(dg >= 2 AND share <= 0.35 AS INT) AS elected FROM x JOIN ar USING (stack_id, group_id)"))
add("E12_claims", lambda s, f: gp.claims(px(s, f).withColumn("support", F.col("v") / 400.0)).select(*ID, r6("claim", "claim")),
    Q().pixels().add("p", f"SELECT *, v/400.0::DOUBLE AS s, max(v/400.0::DOUBLE) OVER (PARTITION BY {pxs}) AS pk FROM px").add("q", "SELECT *, CASE WHEN pk > 1e-6 THEN power(s/pk, 6) ELSE 0 END AS sh FROM p")
    .select(f"SELECT {ids}, {s6(f'CASE WHEN sum(sh) OVER (PARTITION BY {pxs}) > 1e-6 THEN sh/sum(sh) OVER (PARTITION BY {pxs}) ELSE 0 END*least(1, pk/0.45)', 'claim')} FROM q"))


def unexpl(s, f):
    pts = meas(s, f).withColumns({"x": F.col("x") % 8, "y": F.col("y") % 8})
    owned = px(s, f).filter("frame = 0").select(*PX, (F.col("v") / 128.0).alias("claim"), (F.col("v") % 2).alias("group_id"))
    motion = MOT(s, f).withColumn("group_id", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("mx", F.col("mx") + F.col("group_id"))
    return gp.unexplained(pts, owned, motion).select("stack_id", "feature_id", "frame")


add("E13_unexplained", unexpl, mot_q().pixels().add("ow", "SELECT stack_id, y, x, v % 2 AS g FROM px WHERE frame = 0 AND v/128.0 >= 0.9")
    .select("SELECT m.stack_id, feature_id, m.frame FROM measure m LEFT JOIN ow ON ow.stack_id=m.stack_id AND ow.y=m.y % 8 AND ow.x=m.x % 8 LEFT JOIN tr ON tr.stack_id=m.stack_id AND tr.frame=m.frame WHERE ow.g IS NULL OR NOT (abs(shift-((mx+g)*nx+my*ny)) < 3)"))
T5BY = ["stack_id", "frame"]


def t5(s, f):
    m = meas(s, f).withColumn("wt", F.col("score") * rk.focal_weight("frame", F.col("feature_id") % 7 + 1))
    return gp.robust_translation(m, T5BY)


def t5_sql():
    q = Q().measure().add("mw", f"SELECT *, score*exp(-0.5*power((frame-(feature_id % 7 + 1))/2.5, 2)) AS wt FROM measure").add("m0", "SELECT *, wt AS a FROM mw WHERE wt > 1e-3")
    q.add("ok", f"SELECT {key}, count(*) AS n, sum(wt) AS weight, sqrt(sum(wt*shift*shift)/sum(wt)) AS rms FROM m0 GROUP BY ALL HAVING count(*) >= 6 AND sum(wt) >= 2.5")
    for k in range(3):
        q.add(f"n{k}", f"SELECT {key}, sum(a*nx*nx) AS aa, sum(a*nx*ny) AS ab, sum(a*ny*ny) AS bb, sum(a*nx*shift) AS p, sum(a*ny*shift) AS q FROM m{k} GROUP BY ALL")
        q.add(f"f{k}", f"SELECT {key}, (bb*p-ab*q)/(aa*bb-ab*ab) AS mx, (aa*q-ab*p)/(aa*bb-ab*ab) AS my FROM n{k}")
        q.add(f"r{k}", f"SELECT m.*, abs(mx*nx+my*ny-shift) AS r FROM m{k} m JOIN f{k} USING ({key})")
        q.add(f"c{k}", f"SELECT {key}, greatest(2.5*quantile_cont(r, 0.5), 0.5) AS c FROM r{k} GROUP BY ALL")
        q.add(f"m{k+1}", f"SELECT r.* EXCLUDE (r, a), wt*least(1, c/greatest(r, 1e-9)) AS a FROM r{k} r JOIN c{k} USING ({key})")
    q.add("mo", f"SELECT {key}, sum(a*nx*nx)/any_value(weight) AS xx, sum(a*nx*ny)/any_value(weight) AS xy, sum(a*ny*ny)/any_value(weight) AS yy, any_value(n) AS n, any_value(weight) AS weight, any_value(rms) AS rms FROM m3 JOIN ok USING ({key}) GROUP BY {key}")
    return q.add("t5", f"SELECT mo.*, mx, my, (xx+yy)/2 - sqrt(power((xx-yy)/2, 2)+xy*xy) AS lo, (xx+yy)/2 + sqrt(power((xx-yy)/2, 2)+xy*xy) AS hi FROM mo JOIN f2 USING ({key})")


add("T5_robust_translation", lambda s, f: t5(s, f).select(*KEY, "n", *[r6(c, c) for c in ("mx", "my", "weight", "rms", "eig_low", "eig_high")]),
    t5_sql().select(f"SELECT {key}, n, {s6('mx', 'mx')}, {s6('my', 'my')}, {s6('weight', 'weight')}, {s6('rms', 'rms')}, {s6('lo', 'eig_low')}, {s6('hi', 'eig_high')} FROM t5"))
# both axes are seen here, so the observable length is the whole length
add("T6_gate", lambda s, f: gp.gate(t5(s, f), tol=0.1).select(*KEY, "status", "reason", r6("residual", "residual")),
    t5_sql().select(f"SELECT {key}, CASE WHEN weight < 2 THEN 'unverifiable' WHEN sqrt(mx*mx+my*my) <= 0.1 THEN 'verified' ELSE 'contradicted' END AS status, CASE WHEN weight < 2 THEN 'thin support' WHEN lo < 0.1 THEN 'one axis only' ELSE 'both axes' END AS reason, {s6('sqrt(mx*mx+my*my)', 'residual')} FROM t5"))


def rigid(s, f):
    """A fitted matrix replaced by the shift it makes at the centroid of its mask."""
    from sharpfleet.functions.columns import map_point
    o = d.observations(s, f)
    c = o.groupBy(*KEY).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("dx").alias("u"))
    m = F.array(F.lit(1.0) + F.col("u") / 50, F.lit(0.1), F.col("u"), F.lit(-0.1), F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    c = c.withColumn("m", m)
    sx, sy = map_point("m", "cx", "cy")
    return c.select(*KEY, r6(sx - F.col("cx"), "tx"), r6(sy - F.col("cy"), "ty"))


add("T8_rigid_collapse", rigid, Q().obs().add("c", f"SELECT {key}, avg(x) AS cx, avg(y) AS cy, avg(dx) AS u FROM obs GROUP BY ALL").select(f"SELECT {key}, {s6('u/50*cx + 0.1*cy + u', 'tx')}, {s6('-0.1*cx + 2', 'ty')} FROM c"))


def geometry(s, f):
    o = d.observations(s, f)
    c = o.withColumn("name", F.explode(F.array(F.lit("affine"), F.lit("rigid")))).withColumn("e", F.when(F.col("name") == "affine", F.abs("dx")).otherwise(F.abs("dy")))
    g = c.groupBy(*KEY, "name").agg(F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 9).alias("cost")).withColumn("position", (F.col("name") == "rigid").cast("int"))
    return ow.cheapest(g, KEY).select(*KEY, "name", r6("cost", "cost"))


GEO = f"SELECT {key}, sqrt(avg(dx*dx)) AS a, sqrt(avg(dy*dy)) AS b FROM obs GROUP BY ALL"
add("T9_geometry_choice", geometry, Q().obs().add("g", GEO).select(f"SELECT {key}, CASE WHEN round(a, 9) <= round(b, 9) THEN 'affine' ELSE 'rigid' END AS name, {s6('least(a, b)', 'cost')} FROM g"))
add("V42_geometry_menu", lambda s, f: geometry(s, f).groupBy("name").agg(F.count("*").alias("chosen"), r6(F.avg("cost"), "cost")),
    Q().obs().add("g", GEO).select(f"SELECT CASE WHEN round(a, 9) <= round(b, 9) THEN 'affine' ELSE 'rigid' END AS name, count(*) AS chosen, {s6('avg(least(a, b))', 'cost')} FROM g GROUP BY 1"))
feats = lambda s, f: meas(s, f).select("stack_id", "feature_id", "x", "y").distinct()
FT = "SELECT DISTINCT stack_id, feature_id, x, y FROM measure"
seeds = lambda s, f: rk.top_k(feats(s, f).withColumn("k", (F.col("feature_id") * 37) % 1000), ["stack_id"], "k", 6, "feature_id").select("stack_id", F.col("feature_id").alias("seed_id"), F.col("x").alias("sx"), F.col("y").alias("sy"))
SEED = "SELECT stack_id, feature_id AS seed_id, x AS sx, y AS sy FROM ft QUALIFY row_number() OVER (PARTITION BY stack_id ORDER BY (feature_id*37) % 1000 DESC, feature_id) <= 6"
add("J3_radius_join", lambda s, f: gp.within(feats(s, f), seeds(s, f), 120.0).select("stack_id", "seed_id", "feature_id"),
    Q().measure().add("ft", FT).add("sd", SEED).select("SELECT ft.stack_id, seed_id, feature_id FROM ft JOIN sd ON sd.stack_id=ft.stack_id AND (x-sx)*(x-sx)+(y-sy)*(y-sy) < 14400"))


def chain(s, f):
    ft = feats(s, f)
    start = seeds(s, f).select("stack_id", F.col("seed_id").alias("feature_id"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    return gp.attach_chain(ft, start, 26.0, rounds=6).select("stack_id", "feature_id")


def chain_sql():
    q = Q().measure().add("ft", FT).add("sd", SEED).add("h0", "SELECT stack_id, seed_id AS feature_id, sx AS x, sy AS y FROM sd")
    for k in range(6):
        q.add(f"h{k+1}", f"SELECT * FROM h{k} UNION SELECT ft.* FROM ft JOIN h{k} h ON h.stack_id=ft.stack_id AND (ft.x-h.x)*(ft.x-h.x)+(ft.y-h.y)*(ft.y-h.y) < 676")
    return q.select("SELECT stack_id, feature_id FROM h6")


add("J4_chain_join", chain, chain_sql())


def hand_features(s, f):
    st_ = px(s, f, 5).select("stack_id").distinct()
    spec = [(0, 12.0, 14.0, 1.0, 0.0), (1, 20.5, 18.0, 0.6, 0.8), (2, 30.0, 9.0, 0.0, 1.0), (3, 3.0, 37.0, 0.8, 0.6)]
    return st_.select("stack_id", F.explode(F.array(*[F.struct(F.lit(i).alias("feature_id"), *[F.lit(v).alias(n) for n, v in zip(("x", "y", "nx", "ny"), r)]) for i, *r in spec])).alias("_f")).select("stack_id", "_f.*")


def profile_sql(q, half=3, span=2):
    q.add("hf", "SELECT stack_id, fid, x, y, nx, ny FROM (SELECT DISTINCT stack_id FROM px), (VALUES (0,12.0::DOUBLE,14.0::DOUBLE,1.0::DOUBLE,0.0::DOUBLE),(1,20.5,18.0,0.6,0.8),(2,30.0,9.0,0.0,1.0),(3,3.0,37.0,0.8,0.6)) t(fid,x,y,nx,ny)")
    q.add("sp", f"SELECT stack_id, frame, fid, o, s, greatest(0, least(39, x - s*ny + o*nx)) AS sx, greatest(0, least(39, y + s*nx + o*ny)) AS sy FROM hf, (SELECT unnest(range(5)) AS frame), (SELECT unnest(range({-half},{half+1})) AS o), (SELECT unnest(range({-span},{span+1})) AS s)")
    q.add("sv", "SELECT p.stack_id, p.frame, p.fid, p.o, p.s, sum((1-abs(p.sx-q.x))*(1-abs(p.sy-q.y))*q.v) AS v FROM sp p, (SELECT unnest([0,1]) AS o) a, (SELECT unnest([0,1]) AS o) b, px q WHERE q.stack_id=p.stack_id AND q.frame=p.frame AND q.x=floor(p.sx)+a.o AND q.y=floor(p.sy)+b.o GROUP BY ALL")
    return q.add("pf", "SELECT stack_id, frame, fid, o, avg(v) AS m FROM sv GROUP BY ALL")


add("J10_profiles", lambda s, f: gp.profiles(px(s, f, 5), hand_features(s, f), 3, 2).select("stack_id", "feature_id", "frame", F.posexplode("profile").alias("o", "m")).filter("m IS NOT NULL").select("stack_id", "feature_id", "frame", (F.col("o") - 3).alias("o"), r6("m", "m")),
    profile_sql(Q().pixels(5)).select(f"SELECT stack_id, CAST(fid AS INT) AS feature_id, CAST(frame AS INT) AS frame, CAST(o AS INT) AS o, {s6('m', 'm')} FROM pf"))


def match_sql(q):
    profile_sql(q).add("gd", "SELECT stack_id, frame, fid, o, CASE WHEN o = -3 THEN lead(m) OVER w - m WHEN o = 3 THEN m - lag(m) OVER w ELSE (lead(m) OVER w - lag(m) OVER w)/2 END AS g FROM pf WINDOW w AS (PARTITION BY stack_id, frame, fid ORDER BY o)")
    q.add("nm", "SELECT stack_id, frame, fid, sum(g*g) AS n FROM gd GROUP BY ALL")
    q.add("co", "SELECT a.stack_id, b.frame, a.fid, b.o-a.o AS lag, sum(a.g*b.g) AS d FROM gd a JOIN gd b ON b.stack_id=a.stack_id AND b.fid=a.fid AND b.frame<>2 WHERE a.frame=2 GROUP BY ALL")
    q.add("cn", "SELECT co.*, round(d/(sqrt(x.n*y.n)+1e-12), 9) AS c FROM co JOIN nm x ON x.stack_id=co.stack_id AND x.fid=co.fid AND x.frame=2 JOIN nm y ON y.stack_id=co.stack_id AND y.fid=co.fid AND y.frame=co.frame")
    q.add("nb", "SELECT *, lag(c) OVER w AS cl, lead(c) OVER w AS cr FROM cn WINDOW w AS (PARTITION BY stack_id, frame, fid ORDER BY lag)")
    return q.add("bm", "SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY stack_id, frame, fid ORDER BY c DESC, lag) = 1")


def matched(s, f):
    p = gp.profiles(px(s, f, 5), hand_features(s, f), 3, 2)
    base = p.filter("frame = 2").select("stack_id", "feature_id", F.col("profile").alias("base"))
    return gp.match(p.filter("frame <> 2").join(base, ["stack_id", "feature_id"]), "base", "profile", 7).select("stack_id", "feature_id", "frame", r6("shift", "shift", 4), r6("score", "score"))


OFF = "CASE WHEN cl IS NULL OR cr IS NULL OR abs(cl-2*c+cr) <= 1e-9 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5*(cl-cr)/(cl-2*c+cr))) END"
add("J11_profile_match", matched, match_sql(Q().pixels(5)).select(f"SELECT stack_id, CAST(fid AS INT) AS feature_id, CAST(frame AS INT) AS frame, {s6('lag + ' + OFF, 'shift', 4)}, {s6('c', 'score')} FROM bm"))
add("E2_measure", lambda s, f: gp.measure(px(s, f, 5), hand_features(s, f), 2, 3, 2).select("stack_id", "feature_id", "frame", r6("shift", "shift", 4), r6("score", "score")),
    match_sql(Q().pixels(5)).select(f"SELECT stack_id, CAST(fid AS INT) AS feature_id, CAST(frame AS INT) AS frame, {s6('lag + ' + OFF, 'shift', 4)}, {s6('c', 'score')} FROM bm WHERE c >= 0.5 AND abs(lag) < 40"))

# ---- two-frame election
fieldpx = lambda s, f: fo.focal_field(fo.focus_measure(px(s, f, 5))).withColumns({"h": F.lit(40), "w": F.lit(40)})
FLD5 = lambda: energy_sql(Q().pixels(5), "laplacian").add("pk", PEAK).add("fld", FIELD)


def tiles_sql(q):
    q.add("ts", "SELECT unnest([0, 8, 16, 24]) AS s").add("tl", "SELECT stack_id, a.s AS ty, b.s AS tx, y, x, peak, contrast FROM fld JOIN ts a ON y >= a.s AND y < a.s+16 JOIN ts b ON x >= b.s AND x < b.s+16")
    q.add("th", "SELECT stack_id, ty, tx, CAST(floor((peak+0.25)/0.25) AS INT) AS bin, sum(contrast) AS weight FROM tl GROUP BY ALL").add("tw", "SELECT stack_id, ty, tx, sum(weight) AS weight FROM th GROUP BY ALL HAVING sum(weight) > 1e-6")
    q.add("ha", "SELECT *, bin*0.25 - 0.125::DOUBLE AS xc, weight/sum(weight) OVER w AS p FROM th SEMI JOIN tw USING (stack_id, ty, tx) WINDOW w AS (PARTITION BY stack_id, ty, tx)")
    q.add("hb", "SELECT *, sum(p*xc) OVER w AS mean, sum(p) OVER (w ORDER BY bin) AS w0, sum(p*xc) OVER (w ORDER BY bin) AS m0, lead(xc) OVER (w ORDER BY bin) AS nx FROM ha WINDOW w AS (PARTITION BY stack_id, ty, tx)".replace("OVER (w ORDER BY bin)", "OVER (PARTITION BY stack_id, ty, tx ORDER BY bin)"))
    q.add("hc", "SELECT *, sum(p*(xc-mean)*(xc-mean)) OVER (PARTITION BY stack_id, ty, tx) AS var FROM hb")
    q.add("hd", "SELECT *, round(w0*(1-w0)*power(m0/w0-(mean-m0)/(1-w0), 2)/var, 9) AS quality FROM hc WHERE w0 >= 0.12 AND 1-w0 >= 0.12 AND var >= 1e-9 AND nx IS NOT NULL")
    q.add("ht", "SELECT stack_id, ty, tx, (xc+nx)/2 AS th, quality FROM hd QUALIFY row_number() OVER (PARTITION BY stack_id, ty, tx ORDER BY quality DESC, bin) = 1")
    q.add("te", "SELECT tl.stack_id, tl.ty, tl.tx, en.frame, round(sum(e), 6) AS al, round(sum(CASE WHEN NOT peak > th THEN e ELSE 0 END), 6) AS ne, round(sum(CASE WHEN peak > th THEN e ELSE 0 END), 6) AS fa FROM tl LEFT JOIN ht ON ht.stack_id=tl.stack_id AND ht.ty=tl.ty AND ht.tx=tl.tx JOIN en ON en.stack_id=tl.stack_id AND en.y=tl.y AND en.x=tl.x GROUP BY ALL")
    for c in ("al", "ne", "fa"):
        q.add("t" + c, f"SELECT stack_id, ty, tx, frame AS f FROM te QUALIFY row_number() OVER (PARTITION BY stack_id, ty, tx ORDER BY {c} DESC, frame) = 1")
    on = "USING (stack_id, ty, tx)"
    return q.add("tp", f"SELECT tw.stack_id, tw.ty, tw.tx, coalesce(quality, 0) AS quality, weight, CASE WHEN quality >= 0.45 AND abs(tne.f-tfa.f) >= 1.5 THEN least(tne.f, tfa.f) ELSE tal.f END AS near, CASE WHEN quality >= 0.45 AND abs(tne.f-tfa.f) >= 1.5 THEN greatest(tne.f, tfa.f) ELSE tal.f END AS far FROM tw LEFT JOIN ht {on} JOIN tal {on} JOIN tne {on} JOIN tfa {on}")


TP = lambda s, f: ow.tile_pairs(fieldpx(s, f), fo.focus_measure(px(s, f, 5)), 5, 16, 8)
add("T1_tile_pairs", lambda s, f: TP(s, f).select("stack_id", "ty", "tx", "near", "far", r6("quality", "quality"), r6("weight", "weight", 3)),
    tiles_sql(FLD5()).select(f"SELECT stack_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, near, far, {s6('quality', 'quality')}, {s6('weight', 'weight', 3)} FROM tp"))
asked = lambda s, f: d.observations(s, f).select("stack_id", "x", "y", F.col("frame").alias("near"), (F.col("frame") + F.col("x") % 3).alias("far"), F.lit(1.0).alias("weight"))


def kept_sql():
    """Pairs kept by taking the heaviest and dropping its neighbours, six times at most, and the nearest kept of every pair."""
    q = Q().obs().add("ask", "SELECT stack_id, x, y, frame AS near, frame + x % 3 AS far, 1.0::DOUBLE AS weight FROM obs")
    q.add("cnt", "SELECT stack_id, near, far, sum(weight) AS weight FROM ask GROUP BY ALL")
    q.parts.append("""greedy AS (SELECT stack_id, 0 AS place, list({'near': near, 'far': far} ORDER BY round(weight, 6) DESC, near, far) AS rest FROM cnt GROUP BY stack_id
        UNION ALL SELECT stack_id, place + 1, [p FOR p IN rest IF abs(p.near - rest[1].near) > 1 OR abs(p.far - rest[1].far) > 1] FROM greedy WHERE len(rest) > 0 AND place < 5)""")
    q.add("kp", "SELECT stack_id, place, rest[1].near AS kept_near, rest[1].far AS kept_far FROM greedy WHERE len(rest) > 0")
    return q.add("nk", """SELECT stack_id, near, far, weight, kept_near, kept_far FROM cnt JOIN kp USING (stack_id)
        QUALIFY row_number() OVER (PARTITION BY stack_id, near, far ORDER BY abs(kept_near - near) + abs(kept_far - far), place) = 1""")


add("T2_merge_pairs", lambda s, f: ow.merge_pairs(asked(s, f)).select("stack_id", "near", "far", "weight", "kept_near", "kept_far"), kept_sql().select("SELECT * FROM nk"))
add("J5_nearest_kept", lambda s, f: ow.nearest_kept(asked(s, f)).select("stack_id", "x", "y", "near", "far", "kept_near", "kept_far"),
    kept_sql().select("SELECT stack_id, x, y, near, far, kept_near, kept_far FROM ask JOIN nk USING (stack_id, near, far)"))
grad5 = lambda s, f: st.gradient_magnitude(px(s, f, 5).filter("frame = 2"), "v", "gradient").select(*PX, "gradient")


def layers(s, f):
    pairs = px(s, f, 5).select("stack_id").distinct().select("stack_id", F.lit(1).alias("near"), F.lit(3).alias("far"))
    return ow.layer_masks(fo.focus_measure(px(s, f, 5)), pairs, grad5(s, f)).select(*PX, "supplier", F.col("votes").cast("int").alias("votes"))


add("T4_layer_masks", layers, energy_sql(Q().pixels(5), "laplacian").kernel("ga", "px", SOBEL_X, {"a": "v"}).kernel("gb", "px", SOBEL_Y, {"b": "v"})
    .add("cn", f"SELECT {pxs}, max(e) FILTER (frame = 1) AS near, max(e) FILTER (frame = 3) AS far FROM en WHERE frame IN (1, 3) GROUP BY ALL")
    .select("SELECT p.stack_id, p.y, p.x, CASE WHEN far IS NULL OR near >= far THEN 1 ELSE 3 END AS supplier, CAST(sqrt(ga.a*ga.a+gb.b*gb.b) >= 1 AS INT) AS votes FROM cn p JOIN ga ON ga.stack_id=p.stack_id AND ga.y=p.y AND ga.x=p.x AND ga.frame=2 JOIN gb ON gb.stack_id=p.stack_id AND gb.y=p.y AND gb.x=p.x AND gb.frame=2"))


# ---- V rows
def cand7(s, f):
    p = px(s, f)
    dec = ev.decisive(fo.best_two(fo.focus_measure(p, k=3)), 0.1).join(p.filter("frame = 0").select(*PX, "h", "w"), PX)
    m = d.masks(p).filter("frame = 0")
    return ow.mask_candidates(m, dec, 2, 10, 5, 3).select("stack_id", "mask_id", "frame", "area", *[r6(c, c) for c in ("score", "purity", "area_fit", "ring_other", "area_share")])


def cand7_sql():
    q = winner_sql(energy_sql(Q().pixels().masks(), "laplacian", 3)).add("dc", DEC.replace("> 0.3", "> 0.1")).add("m0", "SELECT * FROM masks WHERE frame = 0")
    q.add("nr", "SELECT DISTINCT d.stack_id, m.mask_id, d.y, d.x FROM dc d JOIN m0 m ON m.stack_id=d.stack_id AND abs(m.y-d.y) <= 2 AND abs(m.x-d.x) <= 2")
    q.add("st", "SELECT nr.stack_id, nr.mask_id, winner, count(m.y) AS ar, count(*) FILTER (m.y IS NOT NULL AND decisive) AS sk, count(*) FILTER (m.y IS NULL AND decisive) AS rk FROM nr JOIN dc ON dc.stack_id=nr.stack_id AND dc.y=nr.y AND dc.x=nr.x LEFT JOIN m0 m ON m.stack_id=nr.stack_id AND m.mask_id=nr.mask_id AND m.y=nr.y AND m.x=nr.x GROUP BY ALL")
    q.add("f0", "SELECT i.stack_id, i.mask_id, f.frame AS winner, coalesce(sk, 0) AS sk, coalesce(rk, 0) AS rk, coalesce(ar, 0) AS ar, st.winner IS NOT NULL OR EXISTS (SELECT 1 FROM dc WHERE dc.stack_id=i.stack_id AND dc.winner=f.frame) AS seen FROM (SELECT DISTINCT stack_id, mask_id FROM m0) i, (SELECT unnest(range(5)) AS frame) f LEFT JOIN st ON st.stack_id=i.stack_id AND st.mask_id=i.mask_id AND st.winner=f.frame")
    q.add("tt", "SELECT *, sum(ar) OVER g AS area, sum(sk) OVER g AS tot, sum(rk) OVER g AS rtot FROM f0 WINDOW g AS (PARTITION BY stack_id, mask_id)")
    q.add("sc", "SELECT *, sk/tot AS purity, least(1, sk/area*4) AS af, CASE WHEN rtot > 3 THEN (rtot-rk)/rtot ELSE 0 END AS ro FROM tt WHERE area >= 10 AND tot >= 5 AND seen")
    q.add("so", "SELECT *, round(purity*sqrt(af)*ro, 9) AS score FROM sc WHERE ro >= 0.5 QUALIFY row_number() OVER (PARTITION BY stack_id, mask_id ORDER BY round(purity*sqrt(af)*ro, 9) DESC, winner) = 1")
    return q.select(f"SELECT stack_id, mask_id, CAST(winner AS INT) AS frame, CAST(area AS BIGINT) AS area, {s6('score', 'score')}, {s6('purity', 'purity')}, {s6('af', 'area_fit')}, {s6('ro', 'ring_other')}, {s6('area/64', 'area_share')} FROM so")


add("V7_mask_candidates", cand7, cand7_sql())
GATE = ([0.1 * i for i in range(9)], [1.0 + 0.5 * i for i in range(9)], [0.3 - 0.1 * i for i in range(9)] + [0.25])
li3 = lambda s, f: d.table(s, f, "lineitem").select("l_orderkey", "l_linenumber", F.array((F.col("l_quantity") / 50).cast("double"), F.col("l_tax").cast("double"), F.col("l_discount").cast("double")).alias("f"))
G9 = " + ".join(f"(({e})-{m!r})/{sd!r}*({w!r})" for e, m, sd, w in zip(("a", "b", "c", "a*a", "a*b", "a*c", "b*b", "b*c", "c*c"), *GATE))
add("V9_gate_score", lambda s, f: li3(s, f).select("l_orderkey", "l_linenumber", r6(ow.gate_score(F.col("f"), *GATE), "gain", 9)),
    f"WITH q AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE)/50 AS a, CAST(l_tax AS DOUBLE) AS b, CAST(l_discount AS DOUBLE) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, {s6('0.25::DOUBLE + ' + G9, 'gain', 9)} FROM q")


def gate10(s, f):
    p = one_px(s, f).select(*PX, "v")
    fire = p.groupBy("stack_id").agg((F.max("v") > 225).alias("fire"))
    return ow.gated(p, p.withColumn("v", 255 - F.col("v")), fire, ["v"])


add("V10_gated", gate10, Q().frames().select(f"SELECT {pxs}, CASE WHEN max(v) OVER (PARTITION BY stack_id) > 225 THEN 255-v ELSE v END AS v FROM px"))
add("V11_chromatic_radii", lambda s, f: px(s, f).select("stack_id", "frame").distinct().crossJoin(F.broadcast(s.createDataFrame([("b", 1.02), ("g", 1.0), ("r", 0.97)], "channel string, scale double"))).select("stack_id", "frame", "channel", r6(F.abs(F.col("frame") - 2) * 3.0 * F.col("scale"), "radius")),
    Q().pixels().select(f"SELECT DISTINCT stack_id, frame, c AS channel, {s6('abs(frame-2)*3.0::DOUBLE*k', 'radius')} FROM px, (VALUES ('b',1.02::DOUBLE),('g',1.0),('r',0.97)) t(c,k)"))


def geo15(s, f):
    m = d.masks(one_px(s, f))
    pairs = ma.overlaps(m, m, same=True)
    p = m.groupBy("stack_id", "mask_id").agg(F.count("*").alias("area")).withColumns({"owner": (F.col("mask_id") >= 3).cast("int"), "residual": ((F.col("area") * 7 + F.col("mask_id")) % 23) / 10.0})
    return ow.select_geometry(p, pairs, 0.5, 0.05).select("stack_id", "mask_id", "owner", r6("residual", "residual"), "area", "family", r6("margin", "margin"), F.col("accepted").cast("int").alias("accepted"), "reason")


add("V15_owner_geometry", geo15, Q().frames().masks().add("m0", "SELECT * FROM masks").add("pr", "SELECT stack_id, mask_id, count(*) AS area, CAST(mask_id >= 3 AS INT) AS owner, ((count(*)*7+mask_id) % 23)/10.0::DOUBLE AS residual FROM m0 GROUP BY stack_id, mask_id")
    .add("ov", f"SELECT a.stack_id, a.mask_id AS a, b.mask_id AS b, count(*) AS n FROM m0 a JOIN m0 b USING ({pxs}) GROUP BY ALL")
    .add("kin", "SELECT p.stack_id, p.mask_id AS a, q.mask_id AS b FROM pr p JOIN pr q ON q.stack_id=p.stack_id LEFT JOIN ov ON ov.stack_id=p.stack_id AND ov.a=p.mask_id AND ov.b=q.mask_id WHERE p.owner=q.owner AND (p.mask_id=q.mask_id OR n/(p.area+q.area-n)::DOUBLE >= 0.5 OR n/least(p.area, q.area)::DOUBLE >= 0.9)")
    .add("be", "SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY stack_id ORDER BY residual, mask_id) = 1")
    .add("fa", "SELECT pr.*, count(*) OVER (PARTITION BY pr.stack_id) AS family FROM be JOIN kin ON kin.stack_id=be.stack_id AND kin.a=be.mask_id JOIN pr ON pr.stack_id=be.stack_id AND pr.mask_id=kin.b WHERE pr.residual <= be.residual+0.5")
    .add("ch", "SELECT * FROM fa QUALIFY row_number() OVER (PARTITION BY stack_id ORDER BY area DESC, residual, mask_id) = 1")
    .add("ri", "SELECT ch.stack_id, min(p.residual) AS rv FROM ch JOIN pr p ON p.stack_id=ch.stack_id WHERE NOT EXISTS (SELECT 1 FROM kin WHERE kin.stack_id=ch.stack_id AND kin.a=ch.mask_id AND kin.b=p.mask_id) GROUP BY ALL")
    .select(f"SELECT ch.stack_id, ch.mask_id, owner, {s6('residual', 'residual')}, area, family, {s6('rv-residual', 'margin')}, CAST(coalesce(rv-residual > 0.05, false) AS INT) AS accepted, CASE WHEN rv-residual > 0.05 THEN 'selected' ELSE 'ambiguous_competitor' END AS reason FROM ch LEFT JOIN ri USING (stack_id)"))
m01 = lambda s, f, k: d.masks(pair_px(s, f)).filter(f"frame = {k}")
add("V16_satellites", lambda s, f: ow.satellites(m01(s, f, 0), m01(s, f, 1), 0.4).select("stack_id", "mask_a", "mask_b", r6("iou", "iou"), F.col("supported").cast("int").alias("supported")),
    Q().pairs().masks().add("a", "SELECT * FROM masks WHERE frame = 0").add("b", "SELECT * FROM masks WHERE frame = 1").add("sa", "SELECT stack_id, mask_id, count(*) AS n FROM a GROUP BY ALL").add("sb", "SELECT stack_id, mask_id, count(*) AS n FROM b GROUP BY ALL")
    .add("j", f"SELECT stack_id, a.mask_id AS mask_a, b.mask_id AS mask_b, count(*) AS n FROM a JOIN b USING ({pxs}) GROUP BY ALL").add("k", "SELECT j.stack_id, mask_a, mask_b, j.n/(sa.n+sb.n-j.n)::DOUBLE AS iou, j.n/sa.n::DOUBLE AS ain FROM j JOIN sa ON sa.stack_id=j.stack_id AND sa.mask_id=mask_a JOIN sb ON sb.stack_id=j.stack_id AND sb.mask_id=mask_b")
    .select(f"SELECT stack_id, mask_a, mask_b, {s6('iou', 'iou')}, CAST(iou >= 0.4 OR ain >= 0.9 AS INT) AS supported FROM k QUALIFY row_number() OVER (PARTITION BY stack_id, mask_a ORDER BY round(iou, 9) DESC, mask_b) = 1"))
c17 = lambda s, f: d.table(s, f, "lineitem").select(F.col("l_orderkey").alias("stack_id"), ((F.col("l_partkey") * 8 + F.col("l_linenumber")) * 64 + F.col("l_quantity").cast("int")).alias("mask_id"), (F.col("l_quantity") / 50).cast("double").alias("score"), (F.col("l_partkey") % 97 / 10.0).alias("after"), F.col("l_tax").cast("double").alias("tax"))
add("V17_licensed_candidate", lambda s, f: ow.licensed_candidate(c17(s, f), (F.col("score") > 0.3) & (F.col("tax") < 0.07)).select("stack_id", "mask_id", "after"),
    "WITH t AS (SELECT l_orderkey AS stack_id, (l_partkey*8+l_linenumber)*64+CAST(l_quantity AS INT) AS mask_id, (l_partkey % 97)/10.0::DOUBLE AS after, CAST(l_quantity AS DOUBLE)/50 AS score, CAST(l_tax AS DOUBLE) AS tax FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, (l_partkey*8+l_linenumber)*64+CAST(l_quantity AS INT)) <= 4), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY stack_id ORDER BY after, mask_id) = 1) SELECT stack_id, mask_id, after FROM b WHERE score > 0.3 AND tax < 0.07")
add("V18_stable_correction", lambda s, f: ow.stable_correction(px(s, f).withColumn("delta", (F.col("v") - 110).cast("double"))).select(*PX, r6("retained", "retained"), F.col("stable").cast("int").alias("stable"), r6("spread", "spread")),
    Q().pixels().select(f"SELECT {pxs}, {s6('CASE WHEN min(v) > 110 OR max(v) < 110 THEN sign(avg(v-110))*min(abs(v-110)) ELSE 0 END', 'retained')}, CAST(min(v) > 110 OR max(v) < 110 AS INT) AS stable, {s6('stddev_pop(v-110)', 'spread')} FROM px GROUP BY ALL"))


def cons20(s, f):
    m = d.masks(one_px(s, f))
    ref = d.masks(one_px(s, f)).filter("mask_id = 2").select(*PX)
    return ow.owner_consensus(m, ref, 0.6).select(*PX, F.col("consensus").cast("int").alias("consensus"))


add("V20_owner_consensus", cons20, Q().frames().masks().add("m", "SELECT * FROM masks ").add("ar", "SELECT stack_id, mask_id, count(*) AS n FROM m GROUP BY ALL").add("rf", f"SELECT {pxs} FROM m WHERE mask_id = 2")
    .add("gd", "SELECT a.stack_id, a.mask_id FROM ar a JOIN ar r ON r.stack_id=a.stack_id AND r.mask_id=2 WHERE least(a.n, r.n)/greatest(a.n, r.n)::DOUBLE >= 0.6 AND a.n/r.n::DOUBLE BETWEEN 0.5 AND 1.5").add("en", "SELECT stack_id, count(*) AS k FROM gd GROUP BY ALL HAVING count(*) >= 2")
    .select(f"SELECT {pxs}, 1 AS consensus FROM m JOIN gd USING (stack_id, mask_id) JOIN en USING (stack_id) GROUP BY {pxs}, k HAVING count(*) >= 0.75*k UNION ALL SELECT {pxs}, 0 FROM rf WHERE stack_id NOT IN (SELECT stack_id FROM en)"))
add("V22_forward_residual", lambda s, f: ow.forward_residual(one_px(s, f), F.col("v"), F.lit(128), F.col("v") > 118).select("stack_id", "pixels", r6(F.when(F.col("residual") < 1e300, F.col("residual")), "residual")),
    Q().frames().select(f"SELECT stack_id, count(*) FILTER (v > 118) AS pixels, {s6('CASE WHEN count(*) FILTER (v > 118) >= 32 THEN avg(least(abs(v-128), 30)) FILTER (v > 118) END', 'residual')} FROM px GROUP BY ALL"))
own = lambda s, f: one_px(s, f).select(*PX, "v", F.when(F.col("v") < 90, "UNKNOWN").when(F.col("v") < 110, "BOUNDARY").otherwise("OWNED").alias("state"), F.floor(F.col("v") / 64).alias("layer"))
add("V25_trinary_shares", lambda s, f: ow.trinary_shares(own(s, f)).select("stack_id", "state", "layer", "pixels", r6("share", "share")),
    Q().frames().add("o", "SELECT stack_id, CASE WHEN v < 90 THEN 'UNKNOWN' WHEN v < 110 THEN 'BOUNDARY' ELSE 'OWNED' END AS state, v // 64 AS layer, count(*) AS n FROM px GROUP BY ALL").select(f"SELECT stack_id, state, CAST(layer AS BIGINT) AS layer, n AS pixels, {s6('n/sum(n) OVER (PARTITION BY stack_id)', 'share')} FROM o"))
cert = lambda s, f, a: px(s, f).groupBy(*PX).agg(F.avg(F.abs(F.col("v") - a)).alias("error"), F.count_if(F.col("v") > a).alias("coverage"))
add("V30_differential", lambda s, f: ow.differential(cert(s, f, 100), cert(s, f, 120)).select(*PX, r6("difference", "difference")),
    Q().pixels().select(f"SELECT {pxs}, {s6('avg(abs(v-100)) - avg(abs(v-120))', 'difference')} FROM px GROUP BY ALL HAVING count(*) FILTER (v > 100) >= 2 AND count(*) FILTER (v > 120) >= 2"))
add("V31_region_verdicts", lambda s, f: ow.region_verdicts(one_px(s, f).withColumns({"label": F.floor(F.col("x") / 2), "covered": F.col("v") > 120, "gain": (F.col("v") - 145).cast("double")}), "gain").select("stack_id", "label", "area", "verdict"),
    Q().frames().add("g", "SELECT stack_id, x // 2 AS label, count(*) AS area, avg(CAST(v > 120 AS INT)) AS j, avg(v-145) FILTER (v > 120) AS g FROM px GROUP BY ALL").select("SELECT stack_id, CAST(label AS BIGINT) AS label, area, CASE WHEN j < 0.5 OR g IS NULL THEN 'unarbitrated' WHEN g < 0 THEN 'vetoed' ELSE 'kept' END AS verdict FROM g"))


def veto32(s, f):
    p = one_px(s, f, 2).withColumns({"m": F.col("v") > 100, "g": F.when(F.col("v") > 100, F.col("v") - 140).otherwise(0)})
    b = st.box(p, {"n": F.col("m").cast("int"), "s": "g"}, 2, mean=False)
    return b.select(*PX, ((F.col("n") >= 9) & (F.col("s") < 0)).cast("int").alias("vetoed"))


add("V32_local_veto", veto32, Q().frames(2).add("p", "SELECT *, CAST(v > 100 AS INT) AS m, CASE WHEN v > 100 THEN v-140 ELSE 0 END AS g FROM px").box("b", "p", 2, {"n": "m", "s": "g"}, mean=False).select(f"SELECT {pxs}, CAST(n >= 9 AND s < 0 AS INT) AS vetoed FROM b"))
add("V35_finalize", lambda s, f: ow.finalize(pair_px(s, f).filter("frame = 0").select(*PX, "v"), pair_px(s, f).filter("frame = 1").withColumn("keep", F.col("v") > 120), "keep", ["v"]),
    Q().pairs().select("SELECT a.stack_id, a.y, a.x, CASE WHEN b.v > 120 THEN b.v ELSE a.v END AS v FROM px a JOIN px b ON b.stack_id=a.stack_id AND b.y=a.y AND b.x=a.x AND b.frame=1 WHERE a.frame=0"))


def ev36(s, f):
    p = px(s, f)
    a, b = fo.focal_field(fo.focus_measure(p, "laplacian")), fo.focal_field(fo.focus_measure(p, "tenengrad"))
    return ow.evidenced(a, b, p.filter("frame = 0 AND v > 100")).select(*PX, r6("peak", "peak"))


def ev36_sql():
    q = energy_sql(Q().pixels(), "laplacian", out="e1").add("en", "SELECT * FROM e1").add("pk", PEAK).add("f1", FIELD)
    inner = energy_sql(Q(), "tenengrad", out="e2")
    q.parts += [part.replace("en_", "eo_") for part in inner.parts]
    q.add("p2", PEAK.replace("FROM en", "FROM e2")).add("f2", FIELD.replace("FROM pk", "FROM p2 pk").replace("JOIN en ", "JOIN e2 "))
    return q.select(f"SELECT f1.stack_id, f1.y, f1.x, {s6('f1.peak', 'peak')} FROM f1 JOIN f2 ON f2.stack_id=f1.stack_id AND f2.y=f1.y AND f2.x=f1.x JOIN px ON px.stack_id=f1.stack_id AND px.y=f1.y AND px.x=f1.x AND px.frame=0 AND px.v > 100 WHERE abs(f1.peak-f2.peak) <= 0.75 AND f1.contrast > 0 AND f2.contrast > 0")


add("V36_evidenced", ev36, ev36_sql())
add("V41_sharpest_agreeing", lambda s, f: ow.sharpest_agreeing(px(s, f).withColumn("radius", F.abs(F.col("frame") - F.col("x") % 5)), F.lit(30)).select(*PX, r6("v", "v"), "members", "refused"),
    Q().pixels().add("r", f"SELECT *, abs(frame - x % 5) AS rd, min(abs(frame - x % 5)) OVER (PARTITION BY {pxs}) AS mr FROM px").add("k", f"SELECT *, first_value(v) OVER (PARTITION BY {pxs} ORDER BY frame) AS fv FROM r WHERE rd = mr")
    .select(f"SELECT {pxs}, {s6('avg(v) FILTER (abs(v-fv) <= 30)', 'v')}, count(*) FILTER (abs(v-fv) <= 30) AS members, count(*) FILTER (abs(v-fv) > 30) AS refused FROM k GROUP BY ALL"))
