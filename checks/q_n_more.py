"""Scene motion in turn with its objects, and pieces between depth jumps."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.q_a_kernels import px
from checks.q_h_groups import meas
from checks.registry import Q, add, r6, s6
from sharpfleet.operators import pieces as pc
from sharpfleet.operators import scene as sc
from sharpfleet.sources import derived as d

H, W, OBJECTS, TURNS = 480, 640, 3, 3


def scene(s, f):
    obs = meas(s, f)
    labels = obs.select("stack_id", "feature_id", (F.col("feature_id") % OBJECTS).alias("object_id")).distinct()
    depths = obs.select("stack_id").distinct().withColumn("object_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(OBJECTS - 1).cast("long"))))
    return sc.alternate(obs, labels, depths.withColumn("rho", 1.0 - 0.4 * F.col("object_id")), H, W, TURNS, members=2)


def solve_sql(q, src, name, n=4):
    """Coefficients t0, t1, ... of the normal equations in src (a00, a01, ..., b0, ...) by elimination."""
    for p in range(n - 1):
        keep = [f"a{i}{j}" for i in range(p + 1) for j in range(n)] + [f"b{i}" for i in range(p + 1)]
        new = [f"a{i}{j} - a{i}{p}*a{p}{j}/a{p}{p} AS a{i}{j}" for i in range(p + 1, n) for j in range(n)]
        new += [f"b{i} - a{i}{p}*b{p}/a{p}{p} AS b{i}" for i in range(p + 1, n)]
        q.add(f"{name}_{p}", f"SELECT stack_id, frame, {', '.join(keep + new)} FROM {src}")
        src = f"{name}_{p}"
    for i in reversed(range(n)):
        body = f"SELECT *, (b{i}{''.join(f' - a{i}{j}*t{j}' for j in range(i + 1, n))})/a{i}{i} AS t{i} FROM {src}"
        q.add(name if i == 0 else f"{name}_t{i}", body)
        src = f"{name}_t{i}"
    return q


def scene_sql():
    q = Q().measure().add("ob", f"SELECT *, (x-{(W - 1) / 2})*ny - (y-{(H - 1) / 2})*nx AS turn, (x-{(W - 1) / 2})*nx + (y-{(H - 1) / 2})*ny AS near FROM measure")
    q.add("lb0", f"SELECT DISTINCT stack_id, feature_id, feature_id % {OBJECTS} AS o FROM ob")
    q.add("dp0", f"SELECT stack_id, o, 1 - 0.4::DOUBLE*o AS rho FROM (SELECT DISTINCT stack_id FROM ob), (SELECT unnest(range({OBJECTS})) AS o)")
    for k in range(TURNS):
        q.add(f"de{k}", f"SELECT ob.*, turn AS d0, -rho*nx AS d1, -rho*ny AS d2, rho*near AS d3 FROM ob JOIN lb{k} USING (stack_id, feature_id) JOIN dp{k} USING (stack_id, o)")
        sums = [f"sum(score*d{i}*d{j}) AS a{i}{j}" for i in range(4) for j in range(4)] + [f"sum(score*d{i}*shift) AS b{i}" for i in range(4)]
        q.add(f"ne{k}", f"SELECT stack_id, frame, {', '.join(sums)} FROM de{k} GROUP BY ALL HAVING count(*) >= 8")
        solve_sql(q, f"ne{k}", f"mo{k}")
        q.add(f"ec{k}", f"SELECT stack_id, feature_id, score AS s, shift - t0*turn AS e, t3*near - t1*nx - t2*ny AS c FROM ob JOIN mo{k} USING (stack_id, frame)")
        q.add(f"nd{k}", f"SELECT stack_id, o, sum(s*c*e) AS num, sum(s*c*c) AS den FROM ec{k} JOIN lb{k} USING (stack_id, feature_id) GROUP BY ALL")
        q.add(f"rw{k}", f"SELECT stack_id, o, CASE WHEN den > 1e-9 THEN num/den ELSE rho END AS r FROM dp{k} LEFT JOIN nd{k} USING (stack_id, o)")
        q.add(f"ce{k}", f"SELECT *, avg(r) OVER w AS m, max(r) OVER w - min(r) OVER w AS span FROM rw{k} WINDOW w AS (PARTITION BY stack_id)")
        q.add(f"fi{k}", f"SELECT stack_id, o, CASE WHEN span > 1e-9 THEN (r-m)/avg(abs(r-m)) OVER (PARTITION BY stack_id) ELSE r END AS rho FROM ce{k}")
        q.add(f"co{k}", f"SELECT stack_id, feature_id, o, round(sum(s*(e - rho*c)*(e - rho*c)), 6) AS cost FROM ec{k} JOIN fi{k} USING (stack_id) GROUP BY ALL")
        q.add(f"be{k}", f"SELECT stack_id, feature_id, o FROM co{k} QUALIFY row_number() OVER (PARTITION BY stack_id, feature_id ORDER BY cost, o) = 1")
        q.add(f"lb{k + 1}", f"SELECT l.stack_id, l.feature_id, coalesce(b.o, l.o) AS o FROM lb{k} l LEFT JOIN be{k} b USING (stack_id, feature_id)")
        q.add(f"me{k}", f"SELECT stack_id, o, rho, count(feature_id) AS members FROM fi{k} LEFT JOIN lb{k + 1} USING (stack_id, o) GROUP BY ALL")
        q.add(f"to{k}", f"SELECT stack_id, rho AS top FROM me{k} QUALIFY row_number() OVER (PARTITION BY stack_id ORDER BY members DESC, o) = 1")
        q.add(f"dp{k + 1}", f"SELECT stack_id, o, CASE WHEN members < 2 THEN top ELSE rho END AS rho, members FROM me{k} JOIN to{k} USING (stack_id)")
    return q


add("E17_scene_labels", lambda s, f: scene(s, f).labels.select("stack_id", "feature_id", "object_id"), scene_sql().select(f"SELECT stack_id, feature_id, o AS object_id FROM lb{TURNS}"))
add("E17_scene_depths", lambda s, f: scene(s, f).depths.select("stack_id", "object_id", r6("rho", "rho"), "members"), scene_sql().select(f"SELECT stack_id, o AS object_id, {s6('rho', 'rho')}, members FROM dp{TURNS}"))


def terraces(s, f):
    tile = Window.partitionBy("stack_id", F.floor(F.col("y") / 8), F.floor(F.col("x") / 8))
    t = d.truth(px(s, f, 5)).withColumn("level", F.sum("t").over(tile) % 3)
    return t.select("stack_id", F.lit(0).alias("frame"), "y", "x", "h", "w", (F.col("level") / 2.0 + F.col("t") / 2550.0).alias("depth"))


def pieces_sql():
    q = Q().pixels(5).truth().add("dp", "SELECT stack_id, 0 AS frame, y, x, h, w, CAST(sum(t) OVER (PARTITION BY stack_id, y // 8, x // 8) % 3 AS DOUBLE)/2 + CAST(t AS DOUBLE)/2550 AS depth FROM truth")
    offs = "(SELECT unnest(range(-1, 2)) AS oy) a, (SELECT unnest(range(-1, 2)) AS ox) b"
    q.add("md", f"SELECT p.stack_id, p.y, p.x, median(q.depth) AS m FROM dp p, {offs}, dp q WHERE q.stack_id=p.stack_id AND q.y=greatest(0, least(p.h-1, p.y+oy)) AND q.x=greatest(0, least(p.w-1, p.x+ox)) GROUP BY ALL")
    q.add("rb", f"SELECT p.stack_id, p.y, p.x, round(max(q.m)-min(q.m), 9) >= 0.25 AS ribbon FROM md p, {offs}, md q WHERE q.stack_id=p.stack_id AND q.y=p.y+oy AND q.x=p.x+ox GROUP BY ALL")
    q.add("cr", "SELECT stack_id, y, x, x - row_number() OVER (PARTITION BY stack_id, y ORDER BY x) AS g FROM rb WHERE NOT ribbon")
    q.add("rn", "SELECT stack_id, y, g, min(x) AS x0, max(x) AS x1, y*1000 + min(x) AS id FROM cr GROUP BY stack_id, y, g")
    q.add("lk", "SELECT a.stack_id, a.id AS a, b.id AS b FROM rn a JOIN rn b ON b.stack_id=a.stack_id AND abs(b.y-a.y) = 1 AND b.x0 <= a.x1 AND b.x1 >= a.x0")
    q.parts.append("wk AS (SELECT stack_id, id, id AS root FROM rn UNION SELECT l.stack_id, l.b, w.root FROM wk w JOIN lk l ON l.stack_id=w.stack_id AND l.a=w.id)")
    q.add("cp", "SELECT stack_id, id, min(root) AS root FROM wk GROUP BY ALL")
    q.add("cx", "SELECT stack_id, y, cr.x, root, count(*) OVER (PARTITION BY stack_id, root) AS n FROM cr JOIN rn USING (stack_id, y, g) JOIN cp USING (stack_id, id)")
    q.add("kp", "SELECT stack_id, y, x, dense_rank() OVER (PARTITION BY stack_id ORDER BY root) - 1 AS piece FROM cx WHERE n >= 30")
    q.add("ne", "SELECT r.stack_id, r.y, r.x, arg_min(k.piece, ((k.y-r.y)*(k.y-r.y)+(k.x-r.x)*(k.x-r.x))*CAST(1000000 AS BIGINT) + k.y*1000 + k.x) AS piece FROM rb r JOIN kp k USING (stack_id) GROUP BY ALL")
    return q.select("SELECT stack_id, y, x, CAST(ribbon AS INT) AS ribbon, CAST(piece AS INT) AS piece FROM rb LEFT JOIN ne USING (stack_id, y, x)")


add("G29_pieces", lambda s, f: pc.cut_pieces(terraces(s, f), "depth", 0.25, 1, 30, side=16).select("stack_id", "y", "x", F.col("ribbon").cast("int").alias("ribbon"), F.col("piece").cast("int").alias("piece")), pieces_sql())
