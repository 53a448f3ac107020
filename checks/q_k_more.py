"""Memberships, blur rate, box offsets, coverage growth, boundary map."""

from pyspark.sql import functions as F

from checks.q_a_kernels import ID, ids, one_px, pair_px, px
from checks.q_b_focus import PX, pxs
from checks.q_d_fusion import guided_sql, rgb
from checks.q_e_stats import KEY, SUMS, TR, key
from checks.q_h_groups import FT, MOT, SEED, feats, meas, mot_q, seeds
from checks.registry import Q, add, disk_kernel, r6, s6
from sharpfleet.operators import groups as gp
from sharpfleet.operators import registration as rg
from sharpfleet.operators import surfaces as sf


def members(s, f):
    p = one_px(s, f, 2).select(*PX, "h", "w", (F.col("v") / 255.0).alias("guide"), F.when(F.col("v") % 7 < 6, F.floor(F.col("v") / 90)).cast("int").alias("bin"))
    return rg.bin_memberships(p, 3, "guide", 2).select(*PX, "bin", r6("share", "share"))


add("G5_bin_memberships", members, guided_sql(Q().frames(2).add("b", "SELECT stack_id, y, x, h, w, v/255.0::DOUBLE AS gd, k AS bin, CAST(coalesce(v % 7 < 6 AND v // 90 = k, false) AS DOUBLE) AS raw FROM px, (SELECT unnest(range(3)) AS k)"), "gf_", "b", "gd", "raw", 2, by=("bin",))
    .add("sh", "SELECT stack_id, y, x, bin, greatest(0, least(1, gf)) AS s FROM gf_").add("nm", f"SELECT {pxs}, bin, s/greatest(sum(s) OVER (PARTITION BY {pxs}), 1) AS s FROM sh")
    .select(f"SELECT {pxs}, CAST(bin AS INT) AS bin, {s6('s', 'share')} FROM nm UNION ALL SELECT {pxs}, -1 AS bin, {s6('greatest(0, 1-sum(s))', 'share')} FROM nm GROUP BY {pxs}"))
pieces = lambda s, f: px(s, f, 2).withColumn("piece", F.floor(F.col("y") / 8).cast("int"))


def radii(s, f):
    pk = pieces(s, f).select("stack_id", "piece").distinct().withColumn("peak", F.lit(2))
    return rg.blur_rate(pieces(s, f), 2, pk, 3)


def radii_sql():
    q = Q().pixels(2).add("rf", "SELECT * FROM px WHERE frame = 2")
    for r in (1, 2, 3):
        q.kernel(f"k{r}", "rf", disk_kernel(r), {"b": "v"}, by=())
    q.add("al", "SELECT stack_id, y, x, 0 AS r, CAST(v AS DOUBLE) AS b FROM rf" + "".join(f" UNION ALL SELECT stack_id, y, x, {r}, b FROM k{r}" for r in (1, 2, 3)))
    q.add("er", "SELECT p.stack_id, p.y // 8 AS piece, p.frame, r, round(avg(abs(b-v)), 9) AS mae FROM px p JOIN al USING (stack_id, y, x) WHERE p.frame <> 2 GROUP BY ALL")
    return q.add("be", "SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY stack_id, piece, frame ORDER BY mae, r) = 1")


add("G23_blur_radius", lambda s, f: radii(s, f).select("stack_id", "piece", "frame", "radius", r6("mae", "mae"), "distance"), radii_sql().select(f"SELECT stack_id, CAST(piece AS INT) AS piece, frame, r AS radius, {s6('mae', 'mae')}, abs(frame-2) AS distance FROM be"))
add("G23_blur_rate", lambda s, f: rg.rate_of(radii(s, f)).select("stack_id", r6("rate", "rate")), radii_sql().select(f"SELECT stack_id, {s6('sum(r*abs(frame-2))/sum(abs(frame-2)*abs(frame-2))', 'rate')} FROM be GROUP BY ALL"))


def offset_sql():
    q = Q().pixels(5).add("pf", "SELECT stack_id, frame, x, avg(v) AS m FROM px WHERE y >= 5 AND y < 30 AND x >= 10 AND x < 21 GROUP BY ALL")
    q.add("gd", "SELECT stack_id, frame, x, CASE WHEN x = 10 THEN lead(m) OVER w - m WHEN x = 20 THEN m - lag(m) OVER w ELSE (lead(m) OVER w - lag(m) OVER w)/2 END AS g FROM pf WINDOW w AS (PARTITION BY stack_id, frame ORDER BY x)").add("nm", "SELECT stack_id, frame, sum(g*g) AS n FROM gd GROUP BY ALL")
    q.add("co", "SELECT a.stack_id, b.frame, b.x-a.x AS lag, sum(a.g*b.g) AS d FROM gd a JOIN gd b ON b.stack_id=a.stack_id AND b.frame<>2 WHERE a.frame=2 GROUP BY ALL")
    q.add("cn", "SELECT co.*, round(d/(sqrt(p.n*q.n)+1e-12), 9) AS c FROM co JOIN nm p ON p.stack_id=co.stack_id AND p.frame=2 JOIN nm q ON q.stack_id=co.stack_id AND q.frame=co.frame")
    q.add("nb", "SELECT *, lag(c) OVER w AS cl, lead(c) OVER w AS cr FROM cn WINDOW w AS (PARTITION BY stack_id, frame ORDER BY lag)").add("bm", "SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY stack_id, frame ORDER BY c DESC, lag) = 1")
    off = "CASE WHEN cl IS NULL OR cr IS NULL OR abs(cl-2*c+cr) <= 1e-9 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5*(cl-cr)/(cl-2*c+cr))) END"
    return q.select(f"SELECT stack_id, frame, {s6('lag + ' + off, 'shift', 4)}, {s6('c', 'score')} FROM bm")


add("G31_edge_offset", lambda s, f: rg.edge_offset(px(s, f, 5), (5, 30, 10, 21), 2).select(*KEY, r6("shift", "shift", 4), r6("score", "score")), offset_sql())


def grown(s, f):
    start = seeds(s, f).select("stack_id", F.col("seed_id").alias("feature_id"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    return gp.grow(meas(s, f), MOT(s, f), start, 52.0, 2.0).select("stack_id", "feature_id")


def grown_sql():
    told = "(mx*nx+my*ny)"
    q = mot_q().add("ft", FT).add("sd", SEED).add("fi", f"SELECT DISTINCT m.stack_id, feature_id, m.x, m.y FROM measure m JOIN tr ON tr.stack_id=m.stack_id AND tr.frame=m.frame WHERE m.score >= 0.5 AND abs(shift) <= 40 AND abs({told}) >= 2 AND abs(shift-{told}) < 2")
    q.parts.append("""h AS (SELECT stack_id, seed_id AS feature_id, CAST(sx AS DOUBLE) AS x, CAST(sy AS DOUBLE) AS y FROM sd
        UNION SELECT fi.stack_id, fi.feature_id, CAST(fi.x AS DOUBLE), CAST(fi.y AS DOUBLE) FROM h JOIN fi ON h.stack_id=fi.stack_id AND (fi.x-h.x)*(fi.x-h.x)+(fi.y-h.y)*(fi.y-h.y) < 2704)""")
    return q.select("SELECT stack_id, feature_id FROM h")


add("E8_coverage_growth", grown, grown_sql())
add("V1_stack_boundary", lambda s, f: sf.stack_boundary(rgb(s, f, 5)).select(*PX, r6("boundary", "boundary")))
