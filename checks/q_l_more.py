"""Edge sites, consensus groups, areas of point evidence."""

from pyspark.sql import functions as F

from checks.q_a_kernels import ID, ids, px, taps1
from checks.q_d_fusion import guided_sql
from checks.q_e_stats import SUMS, TR, key
from checks.q_h_groups import meas
from checks.registry import SOBEL_X, SOBEL_Y, Q, add, r6, s6
from sharpfleet.functions.taps import gaussian_taps
from sharpfleet.operators import groups as gp
from sharpfleet.operators import sites as si

G5 = gaussian_taps(1.1, 2)
stepped = lambda s, f: px(s, f, 5).withColumns({"depth": (F.floor(F.col("x") / 16) % 2) * 0.5, "ok": F.col("v") % 11 != 0})


def site_sql():
    q = Q().pixels(5).add("dp", "SELECT *, CAST((x // 16) % 2 AS DOUBLE)*0.5 AS depth FROM px").sep("sm", "px", taps1(G5), taps1(G5), {"m": "v"})
    q.kernel("kx", "sm", SOBEL_X, {"gx": "m"}).kernel("ky", "sm", SOBEL_Y, {"gy": "m"})
    q.add("gr", f"SELECT {ids}, kx.h, kx.w, round(gx, 9) AS gx, round(gy, 9) AS gy FROM kx JOIN ky USING ({ids})")
    q.add("fo", "SELECT *, round(abs(gx)+abs(gy), 9) AS f FROM gr")
    q.add("nb", f"SELECT p.stack_id, p.frame, p.y, p.x, map_from_entries(list((3*(q.y-p.y)+q.x-p.x, q.f))) AS m FROM fo p JOIN fo q ON q.stack_id=p.stack_id AND q.frame=p.frame AND abs(q.y-p.y) <= 1 AND abs(q.x-p.x) <= 1 GROUP BY ALL")
    at = lambda dy, dx: f"coalesce(m[{3 * dy + dx}], 0)"
    q.add("ri", f"""SELECT fo.*, CASE WHEN abs(gy) < abs(gx)*{si.TAN_LOW!r}::DOUBLE THEN f > {at(0, -1)} AND f >= {at(0, 1)} WHEN abs(gy) > abs(gx)*{si.TAN_HIGH!r}::DOUBLE THEN f > {at(-1, 0)} AND f >= {at(1, 0)}
        WHEN gx*gy < 0 THEN f > {at(-1, 1)} AND f > {at(1, -1)} ELSE f > {at(-1, -1)} AND f > {at(1, 1)} END AS ridge FROM fo JOIN nb USING ({ids})""")
    q.add("th", "SELECT * FROM ri WHERE ridge AND f > 40")
    q.parts.append(f"ed AS (SELECT {ids} FROM th WHERE f > 80 UNION SELECT t.stack_id, t.frame, t.y, t.x FROM ed, (SELECT unnest(range(-1, 2)) AS oy) a, (SELECT unnest(range(-1, 2)) AS ox) b JOIN th t ON t.stack_id=ed.stack_id AND t.frame=ed.frame AND t.y=ed.y+oy AND t.x=ed.x+ox)")
    q.add("sd", "SELECT p.stack_id, p.frame, p.y, p.x, max(q.depth)-min(q.depth) AS step FROM ed p JOIN dp q ON q.stack_id=p.stack_id AND q.frame=p.frame AND abs(q.y-p.y) <= 2 AND abs(q.x-p.x) <= 2 GROUP BY ALL")
    return q.add("si", f"""SELECT {ids}, gx/(sqrt(gx*gx+gy*gy)+1e-6) AS nx, gy/(sqrt(gx*gx+gy*gy)+1e-6) AS ny, step > 0.15 AS limb FROM th JOIN sd USING ({ids}) JOIN px USING ({ids})
        WHERE y % 2 = 0 AND x % 2 = 0 AND y >= 4 AND x >= 4 AND y < 36 AND x < 36 AND px.v % 11 <> 0""")


sites = lambda s, f, only="true": si.edge_sites(stepped(s, f).filter(only), "depth", valid="ok", weak=40.0, strong=80.0, stride=2, margin=4, probe=2, side=16)
add("E1_edge_sites", lambda s, f: sites(s, f).select(*ID, r6("nx", "nx"), r6("ny", "ny"), F.col("limb").cast("int").alias("limb")),
    site_sql().select(f"SELECT {ids}, {s6('nx', 'nx')}, {s6('ny', 'ny')}, CAST(limb AS INT) AS limb FROM si"))
# sites are found frame by frame, and only those of the reference frame become features
add("E1_sites_measured", lambda s, f: gp.measure(px(s, f, 5), si.features(sites(s, f, "frame = 2"), 2), 2, half=4, span=3, side=16).select("stack_id", "feature_id", "frame", r6("shift", "shift", 4), r6("score", "score", 4)))


def group_sql(rounds=6, seeds=24, near=120, least=8, inlier=2, reach=52):
    one = lambda by, src: f"SELECT {by}, m.frame, {SUMS.replace('score*', '')} FROM {src} GROUP BY ALL"
    trans = lambda by, src: TR.replace(key, f"{by}, frame").replace("FROM sm", f"FROM {src}")
    q = Q().measure().add("pool0", "SELECT DISTINCT stack_id, feature_id, x, y FROM measure")
    for k in range(rounds):
        q.add(f"pl{k}", f"SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY feature_id) - 1 AS place, count(*) OVER (PARTITION BY stack_id) AS n FROM pool{k}")
        q.add(f"ar{k}", f"SELECT s.stack_id, s.feature_id AS seed_id, p.feature_id FROM pl{k} s JOIN pl{k} p ON p.stack_id=s.stack_id AND (p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y) < {near * near} WHERE s.n >= {least} AND s.place % greatest(1, s.n // {seeds}) = 0")
        q.add(f"bg{k}", f"SELECT * FROM ar{k} QUALIFY count(*) OVER (PARTITION BY stack_id, seed_id) >= {least}")
        q.add(f"ow{k}", f"SELECT m.* FROM measure m JOIN pool{k} USING (stack_id, feature_id)")
        q.add(f"sm{k}", one("m.stack_id, seed_id", f"ow{k} m JOIN bg{k} b ON b.stack_id=m.stack_id AND b.feature_id=m.feature_id"))
        q.add(f"mo{k}", f"SELECT * FROM ({trans('stack_id, seed_id', f'sm{k}')}) WHERE n >= 4 AND mx IS NOT NULL")
        q.add(f"mg{k}", f"SELECT stack_id, seed_id, max(sqrt(mx*mx+my*my)) AS mag FROM mo{k} GROUP BY ALL")
        q.add(f"re{k}", f"SELECT m.stack_id, seed_id, feature_id, nx, ny FROM ow{k} m JOIN mo{k} o ON o.stack_id=m.stack_id AND o.frame=m.frame GROUP BY ALL HAVING count(*) >= 3 AND round(sqrt(avg(power(mx*nx+my*ny-shift, 2))), 9) < {inlier}")
        q.add(f"co{k}", f"SELECT r.stack_id, r.seed_id, feature_id FROM re{k} r JOIN mo{k} o ON o.stack_id=r.stack_id AND o.seed_id=r.seed_id JOIN mg{k} g ON g.stack_id=r.stack_id AND g.seed_id=r.seed_id GROUP BY r.stack_id, r.seed_id, feature_id, mag HAVING round(mag, 9) < {inlier} OR round(max(abs(mx*nx+my*ny)), 9) >= {inlier}")
        q.add(f"be{k}", f"SELECT stack_id, seed_id FROM (SELECT stack_id, seed_id, count(*) AS n FROM co{k} GROUP BY ALL) WHERE n >= {least} QUALIFY row_number() OVER (PARTITION BY stack_id ORDER BY n DESC, seed_id) = 1")
        q.add(f"cr{k}", f"SELECT stack_id, feature_id FROM co{k} JOIN be{k} USING (stack_id, seed_id)")
        q.add(f"s2{k}", one("m.stack_id", f"ow{k} m JOIN cr{k} b ON b.stack_id=m.stack_id AND b.feature_id=m.feature_id"))
        q.add(f"m2{k}", f"SELECT * FROM ({trans('stack_id', f's2{k}')}) WHERE n >= 4 AND mx IS NOT NULL")
        q.add(f"r2{k}", f"SELECT m.stack_id, feature_id, any_value(x) AS x, any_value(y) AS y FROM ow{k} m JOIN m2{k} o ON o.stack_id=m.stack_id AND o.frame=m.frame GROUP BY m.stack_id, feature_id HAVING count(*) >= 3 AND round(sqrt(avg(power(mx*nx+my*ny-shift, 2))), 9) < {inlier}")
        q.add(f"gr{k}", f"SELECT stack_id, feature_id, 1 AS core FROM cr{k} UNION ALL SELECT DISTINCT r.stack_id, r.feature_id, 0 FROM r2{k} r JOIN (SELECT * FROM cr{k} JOIN pool{k} USING (stack_id, feature_id)) c ON c.stack_id=r.stack_id AND (r.x-c.x)*(r.x-c.x)+(r.y-c.y)*(r.y-c.y) < {reach * reach} WHERE (r.stack_id, r.feature_id) NOT IN (SELECT (stack_id, feature_id) FROM cr{k})")
        q.add(f"pool{k + 1}", f"SELECT p.* FROM pool{k} p LEFT JOIN gr{k} g ON g.stack_id=p.stack_id AND g.feature_id=p.feature_id WHERE g.feature_id IS NULL")
    return q.select(" UNION ALL ".join(f"SELECT stack_id, CAST({k} AS INT) AS group_id, feature_id, CAST(core AS INT) AS informative FROM gr{k}" for k in range(rounds)))


add("E5_consensus_groups", lambda s, f: gp.consensus_groups(meas(s, f)).select("stack_id", "group_id", "feature_id", F.col("informative").cast("int").alias("informative")), group_sql())

bright = lambda s, f: px(s, f, 5).filter("v >= 205").select("stack_id", "y", "x").distinct()
PT = "SELECT DISTINCT stack_id, y, x FROM px WHERE v >= 205"
SIDES = "SELECT a.stack_id, a.{g} AS g, a.y AS ay, a.x AS ax, b.y AS by_, b.x AS bx FROM {p} a JOIN {p} b ON b.stack_id=a.stack_id AND b.{g}=a.{g} AND (b.y, b.x) >= (a.y, a.x)"
T = "greatest(0, least(1, ((p.x-ax)*(bx-ax)+(p.y-ay)*(by_-ay))/greatest((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay), 1e-12::DOUBLE)))"
NEAR = f"power(p.x-ax-{T}*(bx-ax), 2)+power(p.y-ay-{T}*(by_-ay), 2)"


def inside_sql(q, name, points, group):
    """Pixels in the hull: none where all points lie strictly on one side of a line through the pixel and a point."""
    q.add(f"{name}_pairs", f"SELECT p.stack_id, p.y, p.x, a.{group} AS g, atan2(a.y-p.y, a.x-p.x) AS t, a.y = p.y AND a.x = p.x AS same FROM (SELECT DISTINCT stack_id, y, x FROM px) p JOIN {points} a ON a.stack_id=p.stack_id")
    q.add(f"{name}_gaps", f"SELECT stack_id, y, x, g, t, same, coalesce(lead(t) OVER w, min(t) OVER v + 2*pi()) - t AS gap FROM {name}_pairs WINDOW w AS (PARTITION BY stack_id, y, x, g ORDER BY t), v AS (PARTITION BY stack_id, y, x, g)")
    return q.add(name, f"SELECT stack_id, y, x, g FROM {name}_gaps GROUP BY ALL HAVING bool_or(same) OR max(gap) <= pi() + 1e-9")


def area_sql():
    q = Q().pixels(5).add("pt", PT)
    q.parts.append("wk AS (SELECT stack_id, y, x, y*1000+x AS root FROM pt UNION SELECT n.stack_id, n.y, n.x, w.root FROM wk w JOIN pt n ON n.stack_id=w.stack_id AND (n.y-w.y)*(n.y-w.y)+(n.x-w.x)*(n.x-w.x) < 16)")
    q.add("cl", "SELECT stack_id, y, x, min(root) AS root FROM wk GROUP BY ALL").add("cn", "SELECT *, count(*) OVER (PARTITION BY stack_id, root) AS n FROM cl").add("mn", "SELECT * FROM cn WHERE n >= 3")
    q.add("sg", SIDES.format(g="root", p="mn"))
    inside_sql(q, "ins", "mn", "root")
    q.add("far", f"SELECT DISTINCT p.stack_id, p.y, p.x FROM (SELECT DISTINCT stack_id, y, x FROM px) p JOIN sg ON sg.stack_id=p.stack_id AND {NEAR} <= 4 + 1e-9")
    return q.add("ev", "SELECT stack_id, y, x FROM ins UNION SELECT * FROM far UNION SELECT p.stack_id, p.y, p.x FROM px p JOIN cn c ON c.stack_id=p.stack_id AND c.n < 3 AND (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y) <= 4")


def refused(s, f):
    p = px(s, f, 5)
    moving = p.select("stack_id", "frame").distinct().filter("frame <> 4")
    return si.refuse_unexplained(p, bright(s, f), moving, 2, 4.0, 2.0).select(*ID, F.col("refused").cast("int").alias("refused"))


add("G15_unexplained_refusal", refused, area_sql().select("SELECT px.stack_id, px.frame, px.y, px.x, CAST(ev.y IS NOT NULL AND px.frame NOT IN (2, 4) AS INT) AS refused FROM px LEFT JOIN ev ON ev.stack_id=px.stack_id AND ev.y=px.y AND ev.x=px.x"))


def support(s, f):
    p = px(s, f, 5)
    points = p.filter("v >= 205").select("stack_id", F.col("frame").alias("group_id"), "y", "x")
    guide = p.filter("frame = 2").select("stack_id", "y", "x", "h", "w", (F.col("v") / 255.0).alias("guide"))
    return si.group_support(guide, points, radius=1.5, smooth=3, side=16).select("stack_id", "group_id", "y", "x", r6("support", "support"))


def support_sql():
    q = Q().pixels(5).add("pt", "SELECT DISTINCT stack_id, frame AS g, y, x FROM px WHERE v >= 205")
    inside_sql(q, "ins", "pt", "g")
    q.add("bd", "SELECT * FROM ins UNION SELECT p.stack_id, p.y, p.x, c.g FROM px p JOIN pt c ON c.stack_id=p.stack_id AND (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y) <= 2.25")
    q.add("sd", "SELECT p.stack_id, g.g AS frame, p.y, p.x, p.h, p.w, p.v/255.0::DOUBLE AS gd, CAST(bd.y IS NOT NULL AS DOUBLE) AS raw FROM px p JOIN (SELECT DISTINCT stack_id, g FROM pt) g ON g.stack_id=p.stack_id LEFT JOIN bd ON bd.stack_id=p.stack_id AND bd.y=p.y AND bd.x=p.x AND bd.g=g.g WHERE p.frame = 2")
    return guided_sql(q, "gf_", "sd", "gd", "raw", 3).select(f"SELECT stack_id, frame AS group_id, y, x, {s6('gf', 'support')} FROM gf_")


add("E9_group_support", support, support_sql())
