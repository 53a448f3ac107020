"""Q rows: quality metrics and audits."""

from pyspark.sql import functions as F

from checks.q_a_kernels import ID, ids, one_px, pair_px, px, sq
from checks.q_b_focus import PX, pxs
from checks.q_c_resample import down_sql
from checks.q_e_stats import KEY, MI, key
from checks.registry import LAP1, LAP3, Q, SOBEL_X, SOBEL_Y, add, disk_kernel, r6, s6
from sharpfleet.operators import focus as fo
from sharpfleet.operators import metrics as me
from sharpfleet.sources import derived as d


def pair(s, f, tiles=1):
    """Source frames next to the stand-in reference as the fused image."""
    p = px(s, f, tiles)
    return p.join(d.truth(p).select(*PX, F.col("t").alias("f")), PX)


def single(s, f, tiles=1):
    """One row per pixel: frame 0, frame 1 and the reference."""
    p = pair_px(s, f, tiles)
    b = p.filter("frame = 1").select(*PX, F.col("v").alias("b"))
    return p.filter("frame = 0").select(*PX, "h", "w", F.col("v").alias("a")).join(b, PX).join(d.truth(p).select(*PX, "t"), PX)


pair_q = lambda tiles=1: Q().pixels(tiles).truth().add("pr", f"SELECT px.*, t AS f FROM px JOIN (SELECT {pxs}, t FROM truth) USING ({pxs})")
single_q = lambda tiles=1: Q().pairs(tiles).truth().add("sg", f"SELECT p.stack_id, p.y, p.x, p.h, p.w, p.v AS a, q.v AS b, t FROM px p JOIN px q ON q.stack_id=p.stack_id AND q.y=p.y AND q.x=p.x AND q.frame=1 JOIN truth tr ON tr.stack_id=p.stack_id AND tr.y=p.y AND tr.x=p.x WHERE p.frame = 0")


def qabf_sql(q, src="pr", out="qa"):
    q.kernel(out + "a", src, SOBEL_X, {"sx": "v", "fx": "f"}).kernel(out + "b", src, SOBEL_Y, {"sy": "v", "fy": "f"})
    q.add(out + "g", f"SELECT {ids}, sqrt(sx*sx+sy*sy) AS g, atan2(sy+0.0, sx+0.0) AS a, sqrt(fx*fx+fy*fy) AS gf, atan2(fy+0.0, fx+0.0) AS af FROM {out}a JOIN {out}b USING ({ids})")
    qg = "0.9994/(1+exp(-15.0*(least(g,gf)/(greatest(g,gf)+1e-10)-0.5)))"
    qa = "0.9879/(1+exp(-22.0*(abs(abs(a-af)-pi()/2)/(pi()/2)-0.8)))"
    return q.add(out, f"SELECT {ids}, {qg}*{qa}*g AS num, g AS den FROM {out}g")


add("Q1_gradient_transfer", lambda s, f: me.q_abf(pair(s, f)).select("stack_id", r6("q_abf", "q_abf")),
    qabf_sql(pair_q()).select(f"SELECT stack_id, {s6('sum(num)/(sum(den)+1e-10)', 'q_abf')} FROM qa GROUP BY ALL"))
add("Q1_transfer_map", lambda s, f: me.q_abf_map(pair(s, f)).select(*PX, r6("q_abf", "q_abf")),
    qabf_sql(pair_q()).select(f"SELECT {pxs}, {s6('sum(num)/(sum(den)+1e-10)', 'q_abf')} FROM qa GROUP BY ALL"))


def ms_sql():
    q = pair_q(5).add("z0", "SELECT stack_id, frame, y, x, h, w, CAST(v AS DOUBLE) AS v, CAST(f AS DOUBLE) AS f FROM pr")
    for k in range(3):
        qabf_sql(q, f"z{k}", f"qa{k}")
        if k < 2:
            down_sql(q, f"z{k+1}", f"z{k}", ["v", "f"])
    one = " UNION ALL ".join(f"SELECT stack_id, sum(num)/(sum(den)+1e-10) AS s FROM qa{k} GROUP BY ALL" for k in range(3))
    return q.add("al", one).select(f"SELECT stack_id, {s6('avg(s)', 'q_abf_ms')}, count(*) AS scales FROM al GROUP BY ALL")


add("Q2_multiscale_transfer", lambda s, f: me.q_abf_ms(pair(s, f, 5), levels=3, smallest=20).select("stack_id", r6("q_abf_ms", "q_abf_ms"), "scales"), ms_sql())
add("Q3_mutual_information", lambda s, f: me.q_mi(pair(s, f)).select("stack_id", r6("q_mi", "q_mi")),
    MI(pair_q(), "pr", "v", "f", 64).select(f"SELECT stack_id, {s6('avg(2*(ha+hb-hab)/(ha+hb+1e-10))', 'q_mi')} FROM mi GROUP BY ALL"))


def ssim_sql(q, src, a, b, by=("frame",), out="ss", carry=()):
    c = "".join(", " + k for k in carry)
    q.add(out + "p", f"SELECT *, {a}*{a} AS aa_, {b}*{b} AS bb_, {a}*{b} AS ab_ FROM {src}").box(out + "b", out + "p", 3, {"ma": a, "mb": b, "maa": "aa_", "mbb": "bb_", "mab": "ab_"}, by, carry=carry)
    return q.add(out, f"SELECT {', '.join(['stack_id', *by, 'y', 'x', 'h', 'w'])}{c}, ((2*ma*mb+6.5025)*(2*(mab-ma*mb)+58.5225))/((ma*ma+mb*mb+6.5025)*(maa-ma*ma+mbb-mb*mb+58.5225)+1e-12) AS ssim FROM {out}b")


add("Q4_ssim_map", lambda s, f: me.ssim_map(pair(s, f), "f", "v", ("frame",)).select(*ID, r6("ssim", "ssim")), ssim_sql(pair_q(), "pr", "f", "v").select(f"SELECT {ids}, {s6('ssim', 'ssim')} FROM ss"))
add("Q4_ref_ssim", lambda s, f: me.ref_ssim(pair(s, f, 5), "v", "f", ("frame",), side=16).select(*KEY, r6("ssim", "ssim")), ssim_sql(pair_q(5), "pr", "f", "v").select(f"SELECT {key}, {s6('avg(ssim)', 'ssim')} FROM ss GROUP BY ALL"))


def qssim_sql(q):
    q.kernel("lp", "pr", LAP1, {"l": "v"}).add("la", "SELECT *, abs(l) AS al FROM lp").box("lb", "la", 4, {"sh": "al"}, mean=False)
    ssim_sql(q, "pr", "f", "v")
    return q.add("qs", f"SELECT {pxs}, ssim FROM ss JOIN (SELECT {ids} FROM lb QUALIFY row_number() OVER (PARTITION BY {pxs} ORDER BY sh DESC, frame) = 1) USING ({ids})")


add("Q5_sharpest_ssim", lambda s, f: me.q_ssim_map(pair(s, f, 2)).select(*PX, r6("q_ssim", "q_ssim")), qssim_sql(pair_q(2)).select(f"SELECT {pxs}, {s6('ssim', 'q_ssim')} FROM qs"))
add("Q6_psnr", lambda s, f: me.psnr(pair(s, f), [("v", "f")], KEY).select(*KEY, r6("mse", "mse"), r6("psnr", "psnr")),
    pair_q().add("m", f"SELECT {key}, avg((v-f)*(v-f)) AS mse FROM pr GROUP BY ALL").select(f"SELECT {key}, {s6('mse', 'mse')}, {s6('CASE WHEN mse < 1e-9 THEN 100 ELSE 10*log10(65025.0/mse) END', 'psnr')} FROM m"))


def comp(s, f):
    p = pair(s, f, 2)
    long = me.q_abf(p).select("stack_id", F.lit("q_abf").alias("metric"), F.col("q_abf").alias("value")).unionByName(
        me.q_ssim(p).select("stack_id", F.lit("q_ssim").alias("metric"), F.col("q_ssim").alias("value")))
    return me.composite(long, {"q_abf": 0.297, "q_ssim": 0.697, "q_mi": 0.0}).select("stack_id", r6("composite", "composite"))


add("Q7_composite", comp, qssim_sql(qabf_sql(pair_q(2))).add("c1", "SELECT stack_id, sum(num)/(sum(den)+1e-10) AS a FROM qa GROUP BY ALL").add("c2", "SELECT stack_id, avg(ssim) AS b FROM qs GROUP BY ALL")
    .select(f"SELECT stack_id, {s6('0.297*a + 0.697*b', 'composite')} FROM c1 JOIN c2 USING (stack_id)"))
add("Q7_composite_map", lambda s, f: me.composite_map(pair(s, f, 2), {"q_abf": 0.3, "q_ssim": 0.7}).select(*PX, r6("quality", "quality")),
    qssim_sql(qabf_sql(pair_q(2))).add("c1", f"SELECT {pxs}, sum(num)/(sum(den)+1e-10) AS a FROM qa GROUP BY ALL").select(f"SELECT {pxs}, {s6('(0.3*a + 0.7*ssim)/(1+1e-12)', 'quality')} FROM c1 JOIN qs USING ({pxs})"))
add("Q8_tiled_ssim", lambda s, f: me.tiled_ssim(pair(s, f, 5), "v", "f", 8, ("frame",), side=20).select(*KEY, r6("mean", "mean"), r6("worst", "worst")),
    ssim_sql(pair_q(5), "pr", "f", "v").add("tl", f"SELECT {key}, y//5 AS ty, x//5 AS tx, avg(ssim) AS t FROM ss GROUP BY ALL").select(f"SELECT {key}, {s6('avg(t)', 'mean')}, {s6('min(t)', 'worst')} FROM tl GROUP BY ALL"))
REG = {"hard_owned_foreground": "a >= 128", "owned_foreground_core": "a >= 160", "hard_owned_soft_edge": "a >= 128 AND a < 160", "foreground_boundary": "a > 100 AND a < 160", "outer_veil": "a < 100 AND b > 120", "far_background": "b <= 120"}
add("Q9_partition_scores", lambda s, f: me.partition_scores(single(s, f), F.abs(F.col("a") - F.col("t")), F.abs(F.col("b") - F.col("t")), {n: F.expr(e) for n, e in REG.items()}).select(
    "stack_id", "region", "pixels", r6("mae_before", "mae_before"), r6("mae_after", "mae_after"), "changed", "closer", "worse"),
    single_q().add("u", " UNION ALL ".join(f"SELECT stack_id, '{n}' AS region, abs(a-t) AS e0, abs(b-t) AS e1 FROM sg WHERE {e}" for n, e in REG.items()))
    .select(f"SELECT stack_id, region, count(*) AS pixels, {s6('avg(e0)', 'mae_before')}, {s6('avg(e1)', 'mae_after')}, count(*) FILTER (e0 <> e1) AS changed, count(*) FILTER (e1 < e0) AS closer, count(*) FILTER (e1 > e0) AS worse FROM u GROUP BY ALL"))
add("Q10_scene_score", lambda s, f: me.scene_score(single(s, f), "a", "b", "t").select("stack_id", "changed", "closer", "worse", *[r6(f"{m}_delta", f"{m}_delta") for m in ("ssim", "mae", "mse")]),
    ssim_sql(ssim_sql(single_q(), "sg", "a", "t", (), "s0"), "sg", "b", "t", (), "s1").add("d", "SELECT stack_id, avg(ssim) AS d0 FROM s0 GROUP BY ALL").add("e", "SELECT stack_id, avg(ssim) AS d1 FROM s1 GROUP BY ALL")
    .add("g", "SELECT stack_id, count(*) FILTER (a <> b) AS changed, count(*) FILTER (abs(b-t) < abs(a-t)) AS closer, count(*) FILTER (abs(b-t) > abs(a-t)) AS worse, avg(abs(b-t))-avg(abs(a-t)) AS ma, avg((b-t)*(b-t))-avg((a-t)*(a-t)) AS ms FROM sg GROUP BY ALL")
    .select(f"SELECT stack_id, changed, closer, worse, {s6('d1-d0', 'ssim_delta')}, {s6('ma', 'mae_delta')}, {s6('ms', 'mse_delta')} FROM g JOIN d USING (stack_id) JOIN e USING (stack_id)"))


def bdist(s, f):
    p = single(s, f).withColumns({"ma": (F.col("a") > 120).cast("int"), "mb": (F.col("b") > 120).cast("int")})
    return me.boundary_distance(p, "ma", "mb", 7).select("stack_id", "way", r6("mean", "mean"), r6("p95", "p95"))


add("Q11_boundary_distance", bdist, single_q().add("m", "SELECT *, CAST(a > 120 AS INT) AS ma, CAST(b > 120 AS INT) AS mb FROM sg")
    .kernel("e", "m", sq(1), {"la": "ma", "lb": "mb"}, by=(), border="none", agg="min", carry=("ma", "mb"))
    .add("ea", f"SELECT {pxs} FROM e WHERE ma = 1 AND la = 0").add("eb", f"SELECT {pxs} FROM e WHERE mb = 1 AND lb = 0")
    .add("dd", "SELECT 'a_to_b' AS way, a.stack_id, min(sqrt((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))) AS dist FROM ea a JOIN eb b ON a.stack_id=b.stack_id GROUP BY a.stack_id, a.y, a.x UNION ALL SELECT 'b_to_a', a.stack_id, min(sqrt((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))) FROM eb a JOIN ea b ON a.stack_id=b.stack_id GROUP BY a.stack_id, a.y, a.x")
    .select(f"SELECT stack_id, way, {s6('avg(dist)', 'mean')}, {s6('quantile_cont(dist, 0.95)', 'p95')} FROM dd WHERE dist <= 7 GROUP BY ALL"))


def ownership(s, f):
    from sharpfleet.operators import masks as ma
    p = single(s, f).withColumn("region", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("t") >= 128, "front"), F.when(F.col("t") < 128, "rear")))))
    by = ("stack_id", "region")
    return ma.agreement(p.filter("a > 140"), p.filter("b > 140"), by).select(*by, "both", *[r6(c, c) for c in ("precision", "recall", "iou")])


add("Q12_ownership_audit", ownership, single_q().add("u", "SELECT *, 'all' AS region FROM sg UNION ALL SELECT *, CASE WHEN t >= 128 THEN 'front' ELSE 'rear' END FROM sg")
    .add("c", 'SELECT stack_id, region, count(*) FILTER (a > 140 AND b > 140) AS n, count(*) FILTER (a > 140) AS na, count(*) FILTER (b > 140) AS nb, count(*) FILTER (a > 140 OR b > 140) AS u FROM u GROUP BY ALL')
    .select(f'SELECT stack_id, region, n AS "both", {s6("n/CASE WHEN na > 0 THEN na END", "precision")}, {s6("n/CASE WHEN nb > 0 THEN nb END", "recall")}, {s6("n/u", "iou")} FROM c WHERE u > 0'))
COV = ("SUM", "a/180.0", "b/150.0")


def coverage(s, f):
    p = single(s, f).withColumns({"alpha": F.col("a") / 150.0, "cov": F.col("b") / 150.0})
    sharp = F.col("alpha") >= 0.95
    core, inner, outer = sharp & (F.col("cov") >= 0.95), sharp & (F.col("cov") > 0.05) & (F.col("cov") < 0.95), (F.col("alpha") < 0.05) & (F.col("cov") > 0.05)
    n = F.greatest(F.count_if(sharp), F.lit(1))
    return p.groupBy("stack_id").agg(F.count_if(sharp).alias("sharp_pixels"), F.count_if(core).alias("core_pixels"), F.count_if(inner).alias("inner_veil_pixels"), F.count_if(outer).alias("outer_veil_pixels"), r6(F.count_if(core) / n, "core_fraction"), r6(F.count_if(inner) / n, "inner_veil_fraction"))


add("Q13_coverage_stats", coverage, single_q().add("c", "SELECT stack_id, a/150.0::DOUBLE AS al, b/150.0::DOUBLE AS co FROM sg").add("g", "SELECT stack_id, count(*) FILTER (al >= 0.95) AS s, count(*) FILTER (al >= 0.95 AND co >= 0.95) AS c, count(*) FILTER (al >= 0.95 AND co > 0.05 AND co < 0.95) AS i, count(*) FILTER (al < 0.05 AND co > 0.05) AS o FROM c GROUP BY ALL")
    .select(f"SELECT stack_id, s AS sharp_pixels, c AS core_pixels, i AS inner_veil_pixels, o AS outer_veil_pixels, {s6('c/greatest(s,1)', 'core_fraction')}, {s6('i/greatest(s,1)', 'inner_veil_fraction')} FROM g"))


def audit(s, f):
    li = d.table(s, f, "lineitem").select(F.col("l_returnflag").alias("split"), (F.col("l_linestatus") == "F").alias("fired"), (F.col("l_tax") - 0.04).cast("double").alias("ssim_delta"),
                                          (F.col("l_discount") - 0.05).cast("double").alias("mae_delta"), (F.col("l_discount") - 0.06).cast("double").alias("mse_delta"), (F.col("l_quantity") % 10).cast("double").alias("iou"))
    return me.audit_summary(li, ["split"]).withColumn("mean_iou", F.round("mean_iou", 6))


add("Q14_audit_summary", audit, """WITH r AS (SELECT l_returnflag AS split, l_linestatus = 'F' AS fired, CAST(l_tax - 0.04 AS DOUBLE) AS sd, CAST(l_discount - 0.05 AS DOUBLE) AS ad, CAST(l_discount - 0.06 AS DOUBLE) AS qd, CAST(l_quantity % 10 AS DOUBLE) AS iou FROM lineitem)
 SELECT split, count(*) AS scenes, count(*) FILTER (fired) AS fired, count(*) FILTER (fired AND sd > 0) AS ssim_positive, count(*) FILTER (fired AND ad < 0) AS mae_positive, count(*) FILTER (fired AND qd < 0) AS mse_positive,
 count(*) FILTER (fired AND ad <= 0 AND qd <= 0) AS non_regressing, count(*) FILTER (iou = 0) AS zero_overlap, round(avg(iou), 6) AS mean_iou FROM r GROUP BY split""")
add("Q15_leaderboard", lambda s, f: me.leaderboard(d.scores(s, f), ["stratum"], "method", "value").select("stratum", "method", "n", "place", r6("score", "score", 4)),
    Q().scores().add("g", "SELECT stratum, method, avg(value) AS score, count(*) AS n FROM scores GROUP BY ALL").select(f"SELECT stratum, method, n, CAST(row_number() OVER (PARTITION BY stratum ORDER BY score DESC, method) AS INT) AS place, {s6('score', 'score', 4)} FROM g"))
add("Q16_method_disagreement", lambda s, f: me.method_disagreement(px(s, f, 5), "frame", "v", 3, side=16).select("stack_id", "method_a", "method_b", r6("heat", "heat")),
    Q().pixels(5).add("pr", "SELECT a.stack_id, a.y, a.x, a.h, a.w, a.frame AS ma, b.frame AS mb, abs(a.v-b.v) AS e FROM px a JOIN px b ON b.stack_id=a.stack_id AND b.y=a.y AND b.x=a.x AND a.frame < b.frame")
    .box("bx", "pr", 3, {"e": "e"}, ("ma", "mb")).select(f"SELECT stack_id, ma AS method_a, mb AS method_b, {s6('max(e)', 'heat')} FROM bx GROUP BY ALL"))
add("Q17_error_delta", lambda s, f: me.error_delta(single(s, f), "a", "b", "t").select(*PX, "outcome", r6("scaled", "scaled")),
    single_q().add("d", "SELECT *, abs(a-t)-abs(b-t) AS dl FROM sg").add("q", "SELECT stack_id, quantile_cont(abs(dl), 0.98) AS tp FROM d WHERE a <> b GROUP BY ALL")
    .select(f"SELECT d.stack_id, y, x, CASE WHEN a = b THEN 'unchanged' WHEN abs(b-t) < abs(a-t) THEN 'closer' WHEN abs(b-t) > abs(a-t) THEN 'worse' ELSE 'tied' END AS outcome, {s6('CASE WHEN a = b THEN 0 ELSE greatest(-1, least(1, dl/greatest(coalesce(tp, 1), 1e-3))) END', 'scaled')} FROM d LEFT JOIN q USING (stack_id)"))


def spear(s, f):
    li = d.table(s, f, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"))
    r = me.spearman(li, ["pair"], "a", "b").filter("n >= 3")
    return r.select("pair", "n", r6("spearman", "spearman"))


add("Q18_spearman", spear, """WITH r AS (SELECT l_orderkey AS pair, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1)/2.0::DOUBLE AS ra,
 rank() OVER (PARTITION BY l_orderkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_orderkey, l_discount) - 1)/2.0::DOUBLE AS rb FROM lineitem),
 g AS (SELECT pair, count(*) AS n, sum(ra) AS sa, sum(rb) AS sb, sum(ra*ra) AS saa, sum(rb*rb) AS sbb, sum(ra*rb) AS sab FROM r GROUP BY 1)
 SELECT pair, n, CASE WHEN n*saa-sa*sa > 1e-9 AND n*sbb-sb*sb > 1e-9 THEN round((n*sab-sa*sb)/sqrt((n*saa-sa*sa)*(n*sbb-sb*sb)), 6) + 0.0 END AS spearman FROM g WHERE n >= 3""")
add("Q18_z_statistics", lambda s, f: me.z_statistics(d.scores(s, f), ["method"], "value").select("method", r6("mean", "mean", 3), r6("std", "std", 3)),
    Q().scores().select(f"SELECT method, {s6('avg(value)', 'mean', 3)}, {s6('stddev_pop(value)', 'std', 3)} FROM scores GROUP BY ALL"))
add("Q19_held_out", lambda s, f: me.held_out(d.table(s, f, "orders").select("o_orderkey"), "o_orderkey", 0.3, 7).select("o_orderkey", F.col("held_out").cast("int").alias("held_out")),
    "SELECT o_orderkey, CAST(CAST('0x' || substr(md5('7:' || o_orderkey), 1, 8) AS BIGINT) % 10000 < 3000 AS INT) AS held_out FROM orders")


def boxes(s, f):
    e = fo.focus_measure(px(s, f))
    st = px(s, f).select("stack_id").distinct()
    b = st.select("stack_id", F.explode(F.array(*[F.struct(F.lit(n).alias("box"), *[F.lit(v).alias(k) for k, v in zip(("y0", "y1", "x0", "x1"), c)]) for n, c in (("knob", (0, 4, 0, 4)), ("flank", (2, 7, 3, 8)))])).alias("b")).select("stack_id", "b.*")
    return me.box_table(e, b).select("stack_id", "box", "frame", r6("energy", "energy"))


from checks.q_b_focus import energy_sql  # noqa: E402

add("Q20_box_energy", boxes, energy_sql(Q().pixels(), "laplacian").add("b", "SELECT * FROM (VALUES ('knob',0,4,0,4),('flank',2,7,3,8)) t(box,y0,y1,x0,x1)").select(f"SELECT stack_id, box, frame, {s6('avg(e)', 'energy')} FROM en JOIN b ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY ALL"))
add("Q21_formation_rollup", lambda s, f: d.table(s, f, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("scenes"), F.bool_and(F.col("l_quantity") > 0).cast("int").alias("invariant"), F.sum("l_linenumber").alias("total")),
    "SELECT l_returnflag, count(*) AS scenes, CAST(bool_and(l_quantity > 0) AS INT) AS invariant, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")


def alpha_scores(s, f):
    from sharpfleet.operators import masks as ma
    p = single(s, f)
    g = ma.agreement(p.filter("a >= 128").select(*PX), p.filter("t >= 128").select(*PX)).select("stack_id", r6("precision", "precision"), r6("recall", "recall"), r6("iou", "iou"))
    return g.join(p.groupBy("stack_id").agg(r6(F.avg(F.abs(F.col("a") - F.col("t")) / 255.0), "mae")), "stack_id")


add("Q22_alpha_scores", alpha_scores, single_q().add("c", "SELECT stack_id, count(*) FILTER (a >= 128 AND t >= 128) AS n, count(*) FILTER (a >= 128) AS na, count(*) FILTER (t >= 128) AS nb, count(*) FILTER (a >= 128 OR t >= 128) AS u, avg(abs(a-t)/255.0::DOUBLE) AS m FROM sg GROUP BY ALL")
    .select(f"SELECT stack_id, {s6('n/CASE WHEN na > 0 THEN na END', 'precision')}, {s6('n/CASE WHEN nb > 0 THEN nb END', 'recall')}, {s6('n/u', 'iou')}, {s6('m', 'mae')} FROM c WHERE u > 0"))


def three_way(s, f):
    p = single(s, f)
    m = p.select(*PX, "h", "w", "t", F.explode(F.array(F.struct(F.lit("base").alias("method"), F.col("a").alias("o")), F.struct(F.lit("tuned").alias("method"), F.col("b").alias("o")), F.struct(F.lit("mean").alias("method"), F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("o")))).alias("m")).select(*PX, "h", "w", "t", "m.*")
    return me.ref_ssim(m, "o", "t", ("method",)).groupBy("stack_id").pivot("method", ["base", "tuned", "mean"]).agg(F.max("ssim")).select("stack_id", *[r6(c, c) for c in ("base", "tuned", "mean")])


add("Q23_three_way", three_way, ssim_sql(single_q().add("m", "SELECT stack_id, y, x, h, w, t, 'base' AS method, a AS o FROM sg UNION ALL SELECT stack_id, y, x, h, w, t, 'tuned', b FROM sg UNION ALL SELECT stack_id, y, x, h, w, t, 'mean', (a+b)//2 FROM sg"), "m", "o", "t", ("method",))
    .select("SELECT stack_id, " + ", ".join(s6(f"avg(ssim) FILTER (method = '{m}')", m) for m in ("base", "tuned", "mean")) + " FROM ss GROUP BY ALL"))
