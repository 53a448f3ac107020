"""A, W, U and J rows on observations, masks and features."""

from pyspark.sql import functions as F

from checks.q_a_kernels import ID, ids, one_px, pair_px, px
from checks.q_b_focus import PX, energy_sql, pxs, winner_sql
from checks.registry import Q, add, r6, s6
from sharpfleet.functions.quantiles import exact_quantiles
from sharpfleet.operators import focus as fo
from sharpfleet.operators import masks as ma
from sharpfleet.operators import ranking as rk
from sharpfleet.operators import resample as rs
from sharpfleet.operators import stats as sa
from sharpfleet.sources import derived as d

obs = d.observations
KEY = ["stack_id", "frame"]
key = "stack_id, frame"
add("A3_masked_mean", lambda s, f: sa.masked_mean(px(s, f), KEY, "v", F.col("v") > 200).select(*KEY, r6("mean", "mean")),
    Q().pixels().select(f"SELECT {key}, {s6('avg(v) FILTER (v > 200)', 'mean')} FROM px GROUP BY ALL"))
add("A4_histogram", lambda s, f: sa.histogram(obs(s, f), ["stack_id"], "dx", -4.0, 4.0, 16, "w").select("stack_id", "bin", r6("weight", "weight")),
    Q().obs().select(f"SELECT stack_id, CAST(least(15, floor((dx + 4.0::DOUBLE)/8*16)) AS INT) AS bin, {s6('sum(w)', 'weight')} FROM obs WHERE dx >= -4 AND dx <= 4 GROUP BY ALL"))
MI = lambda q, src, a, b, n: q.add("mb", f"SELECT {key}, CAST(least({n-1}, floor(({a}-min({a}) OVER g)/(max({a}) OVER g - min({a}) OVER g)::DOUBLE*{n})) AS INT) AS ba, CAST(least({n-1}, floor(({b}-min({b}) OVER g)/(max({b}) OVER g - min({b}) OVER g)::DOUBLE*{n})) AS INT) AS bb FROM {src} WINDOW g AS (PARTITION BY {key})")\
    .add("mp", f"SELECT {key}, ba, bb, count(*) AS n FROM mb GROUP BY ALL").add("m1", f"SELECT {key}, ba, sum(n) AS n FROM mp GROUP BY ALL").add("m2", f"SELECT {key}, bb, sum(n) AS n FROM mp GROUP BY ALL").add("mt", f"SELECT {key}, sum(n) AS t FROM mp GROUP BY ALL")\
    .add("mi", f"SELECT {key}, (SELECT -sum(n/t*log2(n/t)) FROM m1 WHERE m1.stack_id=mt.stack_id AND m1.frame=mt.frame) AS ha, (SELECT -sum(n/t*log2(n/t)) FROM m2 WHERE m2.stack_id=mt.stack_id AND m2.frame=mt.frame) AS hb, (SELECT -sum(n/t*log2(n/t)) FROM mp WHERE mp.stack_id=mt.stack_id AND mp.frame=mt.frame) AS hab FROM mt")
add("A5_mutual_information", lambda s, f: sa.mutual_information(d.colour(px(s, f)), KEY, "v", "r", 16).select(*KEY, r6("h_a", "h_a"), r6("h_b", "h_b"), r6("mi", "mi"), r6("nmi", "nmi")),
    MI(Q().pixels().colour(), "px3", "v", "r", 16).select(f"SELECT {key}, {s6('ha', 'h_a')}, {s6('hb', 'h_b')}, {s6('ha+hb-hab', 'mi')}, {s6('2*(ha+hb-hab)/(ha+hb+1e-10)', 'nmi')} FROM mi"))
add("A6_percentiles", lambda s, f: exact_quantiles(obs(s, f).withColumn("m", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), ["stack_id"], "m", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}).select("stack_id", *[r6(p, p) for p in ("p50", "p90", "p99", "p999")]),
    Q().obs().select("SELECT stack_id, " + ", ".join(s6(f"quantile_cont(sqrt(x*x+y*y), {p})", n) for n, p in (("p50", .5), ("p90", .9), ("p99", .99), ("p999", .999))) + " FROM obs GROUP BY ALL"))
add("A7_weighted_median", lambda s, f: sa.weighted_median(obs(s, f).withColumn("wi", F.rint(F.col("w") * 50)), KEY, "x", "wi").select(*KEY, "median"),
    Q().obs().add("g", f"SELECT {key}, x, sum(round(w*50)) AS w FROM obs GROUP BY ALL").add("r", f"SELECT {key}, x, sum(w) OVER (PARTITION BY {key} ORDER BY x) AS r, sum(w) OVER (PARTITION BY {key}) AS t FROM g").select(f"SELECT {key}, min(x) AS median FROM r WHERE r >= 0.5*t GROUP BY ALL"))
SUMS = "sum(score*nx*nx) AS a, sum(score*nx*ny) AS b, sum(score*ny*ny) AS c, sum(score*nx*shift) AS p, sum(score*ny*shift) AS q, count(*) AS n"
TR = f"SELECT {key}, n, CASE WHEN abs(a*c-b*b) > 1e-9 THEN (c*p-b*q)/(a*c-b*b) END AS mx, CASE WHEN abs(a*c-b*b) > 1e-9 THEN (a*q-b*p)/(a*c-b*b) END AS my FROM sm"
add("A8_normal_translation", lambda s, f: sa.normal_translation(d.measures(s, f), KEY, "score").select(*KEY, "n", r6("mx", "mx"), r6("my", "my")),
    Q().measure().add("sm", f"SELECT {key}, {SUMS} FROM measure GROUP BY ALL").add("tr", TR).select(f"SELECT {key}, n, {s6('mx', 'mx')}, {s6('my', 'my')} FROM tr"))
add("A9_straight_line", lambda s, f: sa.straight_line(obs(s, f), KEY, "dx", "depth").select(*KEY, "n", r6("slope", "slope"), r6("intercept", "intercept")),
    Q().obs().select(f"SELECT {key}, count(*) AS n, {s6('regr_slope(dx, depth)', 'slope')}, {s6('regr_intercept(dx, depth)', 'intercept')} FROM obs GROUP BY ALL"))
add("A10_line_through_origin", lambda s, f: sa.line_through_origin(obs(s, f), KEY, "dx", "depth", "w").select(*KEY, r6("slope", "slope")),
    Q().obs().select(f"SELECT {key}, {s6('sum(w*depth*dx)/sum(w*depth*depth)', 'slope')} FROM obs GROUP BY ALL"))


def sim_sql(passes=4):
    q = Q().obs().add("s0", f"SELECT {key}, x, y, dx, dy, w AS w0, w AS wx, w AS wy FROM obs")
    for k in range(passes):
        q.add(f"n{k}", f"""SELECT {key}, sum(wx*(x-319.5)*(x-319.5)+wy*(y-239.5)*(y-239.5)) AS uu, sum(wx*(x-319.5)) AS ux, sum(wy*(y-239.5)) AS uy, sum(wx) AS sx, sum(wy) AS sy,
          sum(wx*(x-319.5)*dx+wy*(y-239.5)*dy) AS ud, sum(wx*dx) AS xd, sum(wy*dy) AS yd, 2*count(*) AS n FROM s{k} GROUP BY ALL""")
        # eliminate the translations: s = (ud - ux*xd/sx - uy*yd/sy) / (uu - ux^2/sx - uy^2/sy)
        q.add(f"f{k}", f"SELECT {key}, n, (ud-ux*xd/sx-uy*yd/sy)/(uu-ux*ux/sx-uy*uy/sy) AS sc, xd, ux, sx, yd, uy, sy FROM n{k} WHERE n >= 8")
        q.add(f"t{k}", f"SELECT {key}, n, sc, (xd-sc*ux)/sx AS tx, (yd-sc*uy)/sy AS ty FROM f{k}")
        if k + 1 < passes:
            q.add(f"e{k}", f"SELECT s.*, abs(sc*(x-319.5)+tx-dx) AS rx, abs(sc*(y-239.5)+ty-dy) AS ry FROM s{k} s JOIN t{k} USING ({key})")
            q.add(f"m{k}", f"SELECT {key}, greatest(2*quantile_cont(r, 0.5), 1e-6) AS cut FROM (SELECT {key}, rx AS r FROM e{k} UNION ALL SELECT {key}, ry FROM e{k}) GROUP BY ALL")
            q.add(f"s{k+1}", f"SELECT {key}, x, y, dx, dy, w0, w0*least(1, cut/greatest(rx, 1e-9)) AS wx, w0*least(1, cut/greatest(ry, 1e-9)) AS wy FROM e{k} JOIN m{k} USING ({key})")
    return q.select(f"SELECT {key}, n, {s6('sc', 'scale')}, {s6('tx', 'tx')}, {s6('ty', 'ty')} FROM t{passes-1}")


add("A11_similarity", lambda s, f: sa.fit_similarity(obs(s, f), KEY, 319.5, 239.5, "w").select(*KEY, "n", r6("scale", "scale"), r6("tx", "tx"), r6("ty", "ty")), sim_sql())


def invdepth(s, f):
    o = obs(s, f).withColumn("bin", F.col("frame") % 4)
    return sa.inverse_depth(o, ["stack_id"], "bin", F.lit(0.1), F.col("x") / 640.0 - 0.2, F.col("dx"), F.col("w")).select("stack_id", "bin", r6("inverse_depth", "inverse_depth"))


add("A14_inverse_depth", invdepth, Q().obs().add("g", "SELECT stack_id, frame % 4 AS bin, sum(w*(x/640.0::DOUBLE-0.2)*(dx-0.1))/sum(w*(x/640.0::DOUBLE-0.2)*(x/640.0::DOUBLE-0.2)) AS raw FROM obs GROUP BY ALL")
    .add("st", "SELECT stack_id, avg(raw) AS m, stddev_pop(raw) AS s, corr(raw, bin) AS r FROM g GROUP BY ALL").select(f"SELECT stack_id, bin, {s6('CASE WHEN r < 0 THEN -1 ELSE 1 END*(raw-m)/s', 'inverse_depth')} FROM g JOIN st USING (stack_id)"))
add("A17_quadrants", lambda s, f: sa.quadrant_signature(d.measures(s, f), KEY, 640).select(*KEY, r6("left", "left"), r6("right", "right")),
    Q().measure().add("g", f"SELECT {key}, avg(shift*nx) FILTER (x < 319.5) AS l, avg(shift*nx) FILTER (x > 319.5) AS r FROM measure WHERE abs(nx) > 0.7 GROUP BY ALL").select(f"SELECT {key}, {s6('l', 'left')}, {s6('r', 'right')} FROM g WHERE l IS NOT NULL AND r IS NOT NULL"))


def rep(s, f):
    r = sa.report(obs(s, f), ["stack_id"], "dx")
    return r.select("stack_id", "totals.observations", "totals.frames", r6("totals.largest", "largest"), r6(F.element_at("mean_by_frame", 3), "mean_frame_3"))


add("A19_report", rep, Q().obs().select(f"SELECT stack_id, count(*) AS observations, count(DISTINCT frame) AS frames, {s6('max(abs(dx))', 'largest')}, {s6('avg(dx) FILTER (frame = 3)', 'mean_frame_3')} FROM obs GROUP BY ALL"))
add("A20_rollup", lambda s, f: sa.rollup_scores(d.scores(s, f), "stratum", "method", "value").select("stratum", "method", "grain", "n", r6("mean", "mean", 4), r6("low", "low"), r6("high", "high")),
    Q().scores().select(f"SELECT stratum, method, CAST(GROUPING(stratum, method) AS BIGINT) AS grain, count(*) AS n, {s6('avg(value)', 'mean', 4)}, {s6('min(value)', 'low')}, {s6('max(value)', 'high')} FROM scores GROUP BY ROLLUP (stratum, method)"))
add("A21_scalar_gain", lambda s, f: sa.scalar_gain(d.colour(px(s, f)), KEY, "v", "g", lo=0.92, hi=1.08).select(*KEY, r6("gain", "gain")),
    Q().pixels().colour().select(f"SELECT {key}, {s6('least(1.08, greatest(0.92, sum(v*g)/sum(v*v)))', 'gain')} FROM px3 GROUP BY ALL"))
add("A22_disagreement", lambda s, f: sa.disagreement(obs(s, f), KEY, "dx", "dy").select(*KEY, "stranded", *[r6(c, c) for c in ("median", "p90", "wants_x", "wants_y")]),
    Q().obs().add("m", "SELECT *, sqrt(dx*dx+dy*dy) AS m FROM obs").add("q", f"SELECT {key}, quantile_cont(m, 0.5) AS md, quantile_cont(m, 0.9) AS p9 FROM m GROUP BY ALL")
    .select(f"SELECT {key}, count(*) FILTER (m > md) AS stranded, {s6('max(md)', 'median')}, {s6('max(p9)', 'p90')}, {s6('avg(dx) FILTER (m > md)', 'wants_x')}, {s6('avg(dy) FILTER (m > md)', 'wants_y')} FROM m JOIN q USING ({key}) GROUP BY ALL"))

# ---- W rows
cands = lambda s, f: d.masks(px(s, f)).groupBy("stack_id", "frame", "mask_id").agg(F.count("*").alias("area"))
CAND = "SELECT stack_id, frame, mask_id, count(*) AS area FROM masks GROUP BY ALL"
add("W3_top_k", lambda s, f: rk.top_k(cands(s, f).withColumn("id", F.col("frame") * 10 + F.col("mask_id")), ["stack_id"], "area", 4, "id").select("stack_id", "id", "area", "place"),
    Q().pixels().masks().add("c", CAND).select("SELECT stack_id, frame*10+mask_id AS id, area, CAST(row_number() OVER (PARTITION BY stack_id ORDER BY area DESC, frame*10+mask_id) AS INT) AS place FROM c QUALIFY place <= 4"))
add("W4_best_per_mask", lambda s, f: rk.best_per(cands(s, f), ["stack_id", "mask_id"], "area", "frame").select("stack_id", "mask_id", "frame", "area"),
    Q().pixels().masks().add("c", CAND).select("SELECT stack_id, mask_id, frame, area FROM c QUALIFY row_number() OVER (PARTITION BY stack_id, mask_id ORDER BY area DESC, frame) = 1"))


def nms(s, f):
    m = d.masks(one_px(s, f))
    pairs = ma.overlaps(m, m, same=True).filter("iou > 0.55").select("stack_id", F.col("mask_a").alias("a"), F.col("mask_b").alias("b"))
    c = m.groupBy("stack_id", "mask_id").agg(F.count("*").alias("area"))
    return rk.greedy_distinct(c, pairs, ["stack_id"], "mask_id", "area", 3)


# masks are nested, so the overlap graph is an interval order: recursion over the ranking in SQL
add("W5_greedy_distinct", nms, Q().frames().masks().add("m0", "SELECT * FROM masks").add("ar", "SELECT stack_id, mask_id, count(*) AS area FROM m0 GROUP BY ALL")
    .add("pr", "SELECT a.stack_id, a.mask_id AS a, b.mask_id AS b, count(*) AS n FROM m0 a JOIN m0 b ON a.stack_id=b.stack_id AND a.y=b.y AND a.x=b.x AND a.mask_id <> b.mask_id GROUP BY ALL")
    .add("cf", "SELECT pr.stack_id, a, b FROM pr JOIN ar x ON x.stack_id=pr.stack_id AND x.mask_id=a JOIN ar z ON z.stack_id=pr.stack_id AND z.mask_id=b WHERE n::DOUBLE/(x.area+z.area-n) > 0.55")
    .add("rk", "SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY area DESC, mask_id) AS rn FROM ar")
    .add("cl", "SELECT rk.stack_id, rk.mask_id, rn, list(cf.b) FILTER (cf.b IS NOT NULL) AS x FROM rk LEFT JOIN cf ON cf.stack_id=rk.stack_id AND cf.a=rk.mask_id GROUP BY ALL")
    .select("""SELECT stack_id, CAST(place AS INT) AS place, mask_id FROM (
      WITH RECURSIVE gr(stack_id, rn, kept) AS (SELECT stack_id, 1::BIGINT, [mask_id] FROM cl WHERE rn = 1 UNION ALL
        SELECT g.stack_id, g.rn + 1, CASE WHEN len(kept) < 3 AND NOT list_has_any(kept, coalesce(cl.x, [])) THEN list_append(kept, cl.mask_id) ELSE kept END FROM gr g JOIN cl ON cl.stack_id=g.stack_id AND cl.rn=g.rn+1)
      SELECT stack_id, generate_subscripts(kept, 1) AS place, unnest(kept) AS mask_id FROM (SELECT stack_id, kept FROM gr QUALIFY row_number() OVER (PARTITION BY stack_id ORDER BY rn DESC) = 1))""".replace("CAST(place AS INT)", "CAST(place AS INT)")))


def heat_sql(k):
    q = Q().frames().add("h0", f"SELECT {pxs}, v FROM px")
    for i in range(k):
        q.add(f"b{i}", f"SELECT * FROM h{i} QUALIFY row_number() OVER (PARTITION BY stack_id ORDER BY v DESC, y, x) = 1")
        q.add(f"h{i+1}", f"SELECT h.* FROM h{i} h JOIN b{i} b USING (stack_id) WHERE abs(h.y-b.y) > 2 OR abs(h.x-b.x) > 2")
    return q.select(" UNION ALL ".join(f"SELECT stack_id, {i} AS round, y, x, v FROM b{i}" for i in range(k)))


add("W6_heat_maxima", lambda s, f: rk.heat_maxima(one_px(s, f), "v", 3, 2), heat_sql(3))
HX = lambda q: q.add("hs", "SELECT stack_id, CAST(least(31, floor(x/640.0::DOUBLE*32)) AS INT) AS bin, CAST(sum(CASE WHEN (x // 64) % 2 = 0 THEN 3 ELSE 1 END) AS DOUBLE) AS weight FROM obs GROUP BY ALL")


def xhist(s, f):
    return sa.histogram(obs(s, f).withColumn("k", F.when(F.floor(F.col("x") / 64) % 2 == 0, 3.0).otherwise(1.0)), ["stack_id"], F.col("x").cast("double"), 0.0, 640.0, 32, "k")


def smooth_sql(q):
    from sharpfleet.functions.taps import gaussian_taps
    rows = ", ".join(f"({k-4}, {t!r}::DOUBLE)" for k, t in enumerate(gaussian_taps(2.0, 4)))
    HX(q).add("hg", "SELECT stack_id, bin FROM (SELECT DISTINCT stack_id FROM hs), (SELECT unnest(range(32)) AS bin)")
    q.add("hc", "SELECT stack_id, CAST(bin AS INT) AS bin, coalesce(weight, 0) AS weight FROM hg LEFT JOIN hs USING (stack_id, bin)")
    q.add("sm", f"SELECT p.stack_id, p.bin, sum(t.k*q.weight) AS smooth FROM hc p, (VALUES {rows}) t(o, k), hc q WHERE q.stack_id=p.stack_id AND q.bin = CASE WHEN p.bin+t.o < 0 THEN -(p.bin+t.o) WHEN p.bin+t.o > 31 THEN 62-(p.bin+t.o) ELSE p.bin+t.o END GROUP BY ALL")
    return q.add("ex", "SELECT *, max(smooth) OVER (PARTITION BY stack_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lm, max(smooth) OVER (PARTITION BY stack_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rm, sum(smooth) OVER (PARTITION BY stack_id ORDER BY bin) AS run, lag(smooth) OVER (PARTITION BY stack_id ORDER BY bin) AS a, lead(smooth) OVER (PARTITION BY stack_id ORDER BY bin) AS c FROM sm")


add("W7_valleys", lambda s, f: rk.valleys(xhist(s, f), ["stack_id"], 32, 3).select("stack_id", "bin", r6("prominence", "prominence"), "place"),
    smooth_sql(Q().obs()).add("v", "SELECT stack_id, bin, round(least(lm, rm) - smooth, 9) AS prominence FROM ex WHERE smooth <= a AND smooth <= c AND round(least(lm, rm) - smooth, 9) > 0")
    .select(f"SELECT stack_id, bin, {s6('prominence', 'prominence')}, CAST(row_number() OVER (PARTITION BY stack_id ORDER BY prominence DESC, bin DESC) AS INT) AS place FROM v QUALIFY place <= 3"))
add("W8_running_extremes", lambda s, f: rk.running_extremes(rk.smooth_histogram(xhist(s, f), ["stack_id"], 32), ["stack_id"]).select("stack_id", "bin", *[r6(c, c) for c in ("smooth", "left_max", "right_max", "running")]),
    smooth_sql(Q().obs()).select(f"SELECT stack_id, bin, {s6('smooth', 'smooth')}, {s6('lm', 'left_max')}, {s6('rm', 'right_max')}, {s6('run', 'running')} FROM ex"))


def otsu_sql(q, src, by, out, least=0.12):
    q.add(out + "a", f"SELECT *, bin + 0.5::DOUBLE AS xc, weight / sum(weight) OVER (PARTITION BY {by}) AS p, lead(bin + 0.5::DOUBLE) OVER (PARTITION BY {by} ORDER BY bin) AS nx FROM {src}")
    q.add(out + "b", f"SELECT *, sum(p*xc) OVER (PARTITION BY {by}) AS mean, sum(p) OVER (PARTITION BY {by} ORDER BY bin) AS w0, sum(p*xc) OVER (PARTITION BY {by} ORDER BY bin) AS m0 FROM {out}a")
    q.add(out + "c", f"SELECT *, sum(p*(xc-mean)*(xc-mean)) OVER (PARTITION BY {by}) AS var FROM {out}b")
    q.add(out + "d", f"SELECT *, round(w0*(1-w0)*power(m0/w0 - (mean-m0)/(1-w0), 2)/var, 9) AS quality FROM {out}c WHERE w0 >= {least} AND 1-w0 >= {least} AND var >= 1e-9 AND nx IS NOT NULL")
    return q.add(out, f"SELECT {by}, (xc+nx)/2 AS threshold, quality FROM {out}d QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY quality DESC, bin) = 1")


add("W9_otsu_split", lambda s, f: rk.otsu_split(xhist(s, f), ["stack_id"], F.col("bin") + 0.5).select("stack_id", r6("threshold", "threshold"), r6("quality", "quality")),
    otsu_sql(HX(Q().obs()), "hs", "stack_id", "ot").select(f"SELECT stack_id, {s6('threshold', 'threshold')}, {s6('quality', 'quality')} FROM ot"))


def ladder_sql():
    q = HX(Q().obs()).add("l0", "SELECT *, 0 AS seg FROM hs")
    for k in range(2):
        otsu_sql(q, f"l{k}", "stack_id, seg", f"o{k}")
        q.add(f"l{k+1}", f"SELECT l.stack_id, l.bin, l.weight, l.seg*2 + CASE WHEN o.threshold IS NOT NULL AND l.bin + 0.5 > o.threshold THEN 1 ELSE 0 END AS seg FROM l{k} l LEFT JOIN (SELECT * FROM o{k} WHERE quality >= 0.45) o ON o.stack_id=l.stack_id AND o.seg=l.seg")
    return q.select(f"SELECT stack_id, bin, {s6('weight', 'weight')}, CAST(dense_rank() OVER (PARTITION BY stack_id ORDER BY seg) - 1 AS INT) AS layer FROM l2")


add("W10_otsu_ladder", lambda s, f: rk.otsu_ladder(xhist(s, f), ["stack_id"], F.col("bin") + 0.5, 2).select("stack_id", "bin", r6("weight", "weight"), "layer"), ladder_sql())
one = lambda s, f: one_px(s, f).withColumn("m", F.col("v") > 100)
RUNS = "SELECT *, CASE WHEN v > 100 THEN y - coalesce(max(CASE WHEN v <= 100 THEN y END) OVER (PARTITION BY stack_id, x ORDER BY y), -1) ELSE 0 END AS run FROM px"
add("W11_column_runs", lambda s, f: rk.column_runs(one(s, f), "m").select(*PX, "run"), Q().frames().add("r", RUNS).select(f"SELECT {pxs}, CAST(run AS INT) AS run FROM r"))
add("W12_largest_rectangle", lambda s, f: rk.largest_rectangle(one(s, f), "m").select("stack_id", "area"),
    Q().frames().add("r", RUNS).add("c", "SELECT a.stack_id, a.y, a.x AS xa, b.x AS xb, min(c.run) AS mh FROM r a JOIN r b ON b.stack_id=a.stack_id AND b.y=a.y AND b.x >= a.x JOIN r c ON c.stack_id=a.stack_id AND c.y=a.y AND c.x BETWEEN a.x AND b.x GROUP BY ALL")
    .select("SELECT stack_id, CAST(max((xb-xa+1)*mh) AS BIGINT) AS area FROM c GROUP BY ALL"))


def prop(s, f):
    m = sa.normal_translation(d.measures(s, f), KEY, "score")
    return rk.propagate(m, ["stack_id"], ["mx", "my"], "weight", PROP, m).select(*KEY, r6("mx", "mx"), r6("my", "my"), F.col("trusted").cast("int").alias("trusted"))


PROP = 142.0
add("W13_propagate", prop, Q().measure().add("sm", f"SELECT {key}, {SUMS}, sum(score) AS wt FROM measure GROUP BY ALL").add("tr", TR).add("t2", f"SELECT tr.*, wt FROM tr JOIN sm USING ({key})")
    .add("pr", f"SELECT a.stack_id, a.frame, b.frame AS f, b.mx, b.my FROM t2 a JOIN t2 b ON b.stack_id=a.stack_id AND b.wt >= {PROP} QUALIFY row_number() OVER (PARTITION BY a.stack_id, a.frame ORDER BY abs(b.frame-a.frame), b.frame) <= 4")
    .add("g", f"SELECT {key}, max(mx) FILTER (f = frame) AS ox, max(my) FILTER (f = frame) AS oy, count(*) AS n, regr_slope(mx, f)*any_value(frame) + regr_intercept(mx, f) AS lx, regr_slope(my, f)*any_value(frame) + regr_intercept(my, f) AS ly FROM pr GROUP BY stack_id, frame")
    .select(f"SELECT {key}, {s6('coalesce(ox, lx)', 'mx')}, {s6('coalesce(oy, ly)', 'my')}, CAST(ox IS NOT NULL AS INT) AS trusted FROM g WHERE ox IS NOT NULL OR n >= 2"))


def mirrors(s, f):
    p = px(s, f)
    pk = fo.focal_field(fo.focus_measure(p)).select(*PX, "peak")
    return rk.mirror_frames(p.select(*PX, "frame"), pk, PX)


from checks.q_b_focus import FIELD, PEAK  # noqa: E402

add("W14_mirror_frames", mirrors, energy_sql(Q().pixels(), "laplacian").add("pk", PEAK).add("fld", FIELD)
    .select(f"SELECT a.stack_id, a.y, a.x, a.frame, b.frame AS mirror FROM px a JOIN fld f ON f.stack_id=a.stack_id AND f.y=a.y AND f.x=a.x JOIN px b ON b.stack_id=a.stack_id AND b.y=a.y AND b.x=a.x AND b.frame = round_even(2*f.peak - a.frame, 0) WHERE a.frame < b.frame"))
add("W15_focal_weight", lambda s, f: d.measures(s, f).select("feature_id", "frame", r6(rk.focal_weight("frame", F.col("feature_id") % 7 + 1), "wt")),
    Q().measure().select(f"SELECT feature_id, frame, {s6('exp(-0.5*power((frame - (feature_id % 7 + 1))/2.5, 2))', 'wt')} FROM measure"))


def travel(s, f):
    p = d.measures(s, f).groupBy("stack_id", (F.col("feature_id") % 50).alias("piece")).agg(F.sum(F.rint(F.abs("shift"))).alias("travel"))
    return rk.travel_order(p, ["stack_id"], "travel", 3.0).select("stack_id", "piece", "travel", "rank", "group")


add("W16_travel_order", travel, Q().measure().add("p", "SELECT stack_id, feature_id % 50 AS piece, sum(round_even(abs(shift), 0)) AS travel FROM measure GROUP BY ALL")
    .add("o", "SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY travel DESC, piece) AS rank, CAST(coalesce(lag(travel) OVER (PARTITION BY stack_id ORDER BY travel DESC, piece) - travel > 3, false) AS INT) AS gap FROM p")
    .select('SELECT stack_id, piece, travel, CAST(rank AS INT) AS rank, CAST(sum(gap) OVER (PARTITION BY stack_id ORDER BY rank) AS BIGINT) AS "group" FROM o'))

# ---- U rows
mk = lambda s, f: d.masks(px(s, f))
MK = lambda: Q().pixels().masks()
mk2 = lambda s, f: d.masks(pair_px(s, f))
MK2 = lambda: Q().pairs().masks()


def u1(s, f):
    m = px(s, f).filter("v > 90")
    n = px(s, f).groupBy("stack_id").agg(F.countDistinct("frame").alias("n"))
    return ma.intersection_over_frames(m, n)


add("U1_intersection", u1, Q().pixels().select(f"SELECT {pxs} FROM px GROUP BY ALL HAVING bool_and(v > 90)"))
sub = lambda s, f, i, fr=0: mk2(s, f).filter(f"mask_id = {i} AND frame = {fr}")
add("U2_union", lambda s, f: ma.union_of(sub(s, f, 2, 0), sub(s, f, 3, 1)), MK2().select(f"SELECT {pxs} FROM masks WHERE (mask_id = 2 AND frame = 0) OR (mask_id = 3 AND frame = 1) GROUP BY ALL"))
add("U3_difference", lambda s, f: ma.difference(sub(s, f, 1, 0), sub(s, f, 1, 1)).select(*PX),
    MK2().select(f"SELECT {pxs} FROM masks WHERE mask_id = 1 AND frame = 0 EXCEPT SELECT {pxs} FROM masks WHERE mask_id = 1 AND frame = 1"))
add("U4_vote", lambda s, f: ma.vote(mk(s, f).withColumn("m", F.col("frame") * 10 + F.col("mask_id")), "m", 0.75),
    MK().add("n", "SELECT stack_id, count(DISTINCT frame*10+mask_id) AS n FROM masks GROUP BY ALL").add("c", f"SELECT {pxs}, count(DISTINCT frame*10+mask_id) AS votes FROM masks GROUP BY ALL").select(f"SELECT {pxs}, votes FROM c JOIN n USING (stack_id) WHERE votes >= 0.75*n"))
IOU = f"SELECT stack_id, count(*) AS u, count(a.y) AS aa, count(b.y) AS ab, count(a.y + b.y) AS both FROM (SELECT {pxs} FROM masks WHERE mask_id = 2 AND frame = 0) a FULL OUTER JOIN (SELECT {pxs} FROM masks WHERE mask_id = 2 AND frame = 1) b USING ({pxs}) GROUP BY ALL"
IOU = f"SELECT coalesce(a.stack_id, b.stack_id) AS stack_id, count(*) AS u, count(a.y) AS aa, count(b.y) AS ab, count(a.y + b.y) AS n FROM (SELECT {pxs} FROM masks WHERE mask_id = 2 AND frame = 0) a FULL OUTER JOIN (SELECT {pxs} FROM masks WHERE mask_id = 2 AND frame = 1) b ON a.stack_id=b.stack_id AND a.y=b.y AND a.x=b.x GROUP BY ALL"
add("U5_agreement", lambda s, f: ma.agreement(sub(s, f, 2, 0), sub(s, f, 2, 1)).select("stack_id", "union", "both", *[r6(c, c) for c in ("iou", "precision", "recall")]),
    MK2().add("j", IOU).select(f'SELECT stack_id, u AS "union", n AS "both", {s6("n/u", "iou")}, {s6("n/aa", "precision")}, {s6("n/ab", "recall")} FROM j'))


def u6(s, f):
    p = one_px(s, f).select(*PX, (F.col("v") > 128).cast("int").alias("near"), F.when(F.col("v") % 5 < 4, F.floor(F.col("v") / 51)).alias("label"))
    return ma.contingency(p, "label", "near").select("stack_id", "near", "pixels", r6("claimed_right", "claimed_right"), r6("claimed_wrong", "claimed_wrong"))


add("U6_contingency", u6, Q().frames().add("p", "SELECT stack_id, CAST(v > 128 AS INT) AS near, CASE WHEN v % 5 < 4 THEN v // 51 END AS label FROM px").add("c", "SELECT stack_id, near, label, count(*) AS n FROM p GROUP BY ALL")
    .add("o", "SELECT stack_id, label, near AS own FROM c QUALIFY row_number() OVER (PARTITION BY stack_id, label ORDER BY n DESC, near) = 1")
    .select(f"SELECT c.stack_id, near, CAST(sum(n) AS BIGINT) AS pixels, {s6('coalesce(sum(n) FILTER (own = near), 0)/sum(n)', 'claimed_right')}, {s6('coalesce(sum(n) FILTER (own <> near), 0)/sum(n)', 'claimed_wrong')} FROM c LEFT JOIN o ON o.stack_id=c.stack_id AND o.label=c.label GROUP BY c.stack_id, near"))
add("U7_subset_violations", lambda s, f: ma.subset_violations(sub(s, f, 1, 0), sub(s, f, 1, 1)),
    MK2().add("v", f"SELECT {pxs} FROM masks WHERE mask_id = 1 AND frame = 0 EXCEPT SELECT {pxs} FROM masks WHERE mask_id = 1 AND frame = 1").select("SELECT stack_id, count(*) AS outside FROM v GROUP BY ALL"))

# ---- J rows
add("J1_gather_winner", lambda s, f: px(s, f).join(fo.winner(fo.focus_measure(px(s, f))), PX).filter("frame = winner").select(*PX, "frame", "v"),
    winner_sql(energy_sql(Q().pixels(), "laplacian")).select(f"SELECT {pxs}, frame, v FROM px JOIN wn USING ({pxs}) WHERE frame = winner"))
add("J6_mask_overlap", lambda s, f: ma.overlaps(mk2(s, f).filter("frame = 0"), mk2(s, f).filter("frame = 1")).select("stack_id", "mask_a", "mask_b", "both", *[r6(c, c) for c in ("iou", "a_in_b", "b_in_a")]),
    MK2().add("a", "SELECT * FROM masks WHERE frame = 0").add("b", "SELECT * FROM masks WHERE frame = 1").add("sa", "SELECT stack_id, mask_id, count(*) AS n FROM a GROUP BY ALL").add("sb", "SELECT stack_id, mask_id, count(*) AS n FROM b GROUP BY ALL")
    .add("j", f"SELECT stack_id, a.mask_id AS mask_a, b.mask_id AS mask_b, count(*) AS n FROM a JOIN b USING ({pxs}) GROUP BY ALL")
    .select(f'SELECT j.stack_id, mask_a, mask_b, j.n AS "both", {s6("j.n/(sa.n+sb.n-j.n)", "iou")}, {s6("j.n/sa.n", "a_in_b")}, {s6("j.n/sb.n", "b_in_a")} FROM j JOIN sa ON sa.stack_id=j.stack_id AND sa.mask_id=mask_a JOIN sb ON sb.stack_id=j.stack_id AND sb.mask_id=mask_b'))
lab = lambda s, f: one_px(s, f).withColumn("label", F.floor(F.col("v") / 64).cast("int"))
add("J7_adjacency", lambda s, f: ma.adjacency(lab(s, f), "label"), Q().frames().add("l", "SELECT *, v // 64 AS lb FROM px")
    .select("SELECT a.stack_id, CAST(least(a.lb, b.lb) AS INT) AS piece_a, CAST(greatest(a.lb, b.lb) AS INT) AS piece_b, count(*) AS border FROM l a JOIN l b ON b.stack_id=a.stack_id AND ((b.y=a.y AND b.x=a.x+1) OR (b.x=a.x AND b.y=a.y+1)) WHERE a.lb <> b.lb GROUP BY ALL"))


def j8(s, f):
    """Stacks whose validity check failed keep their rows unchanged, the others are inverted."""
    p = px(s, f)
    bad = p.groupBy("stack_id").agg(F.max("v").alias("m")).filter("m > 240").select("stack_id")
    return p.join(bad, "stack_id", "left_anti").withColumn("v", 255 - F.col("v")).unionByName(p.join(bad, "stack_id", "left_semi")).select(*ID, "v")


add("J8_refusal", j8, Q().pixels().add("b", "SELECT stack_id FROM px GROUP BY ALL HAVING max(v) > 240").select(f"SELECT {ids}, CASE WHEN stack_id IN (SELECT stack_id FROM b) THEN v ELSE 255 - v END AS v FROM px"))


def j9(s, f):
    """Every pixel of a stack, also where the reference frame is missing."""
    of = lambda k, ok=F.lit(True): F.max(F.when((F.col("frame") == k) & ok, F.col("v")))
    w = px(s, f).groupBy(*PX).agg(of(0, F.col("v") % 3 != 0).alias("first"), of(1, F.col("v") % 3 != 1).alias("second"), of(2).alias("ref"))
    return w.select(*PX, F.coalesce("first", "second", "ref").alias("v"), F.when(F.col("first").isNotNull(), 0).when(F.col("second").isNotNull(), 1).otherwise(2).alias("source"))


add("J9_fallback_chain", j9, Q().pixels().add("w", f"SELECT {pxs}, max(CASE WHEN frame = 0 AND v % 3 <> 0 THEN v END) AS a, max(CASE WHEN frame = 1 AND v % 3 <> 1 THEN v END) AS b, max(CASE WHEN frame = 2 THEN v END) AS c FROM px GROUP BY ALL")
    .select(f"SELECT {pxs}, coalesce(a, b, c) AS v, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 ELSE 2 END AS source FROM w"))
