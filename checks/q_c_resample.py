"""Y rows: pyramids, resizing, remapping, nearest pixels."""

from pyspark.sql import functions as F

from checks.q_a_kernels import ID, ids, px, taps1
from checks.registry import Q, add, r6, s6
from sharpfleet.functions import columns as fc
from sharpfleet.operators import pyramid as py
from sharpfleet.operators import resample as rs
from sharpfleet.sources import derived as d

T5 = taps1(py.TAPS)


def down_sql(q, name, src, cols, by=("frame",)):
    q.sep(name + "_c", src, T5, T5, {c: c for c in cols}, by)
    ks = ", ".join(["stack_id", *by])
    return q.add(name, f"SELECT {ks}, y//2 AS y, x//2 AS x, (h+1)//2 AS h, (w+1)//2 AS w, {', '.join(cols)} FROM {name}_c WHERE y%2=0 AND x%2=0")


def up_sql(q, name, src, grid, cols, by=("frame",)):
    """Expand src onto the pixels of grid."""
    rows = "(0,-1,0.125),(0,0,0.75),(0,1,0.125),(1,0,0.5),(1,1,0.5)"
    at = lambda a, size: f"CASE WHEN p.{a}//2 + t{a}.o < 0 THEN least(1, (p.{size}+1)//2 - 1) WHEN p.{a}//2 + t{a}.o > (p.{size}+1)//2 - 1 THEN (p.{size}+1)//2 - 1 ELSE p.{a}//2 + t{a}.o END"
    ks = ["stack_id", *by, "y", "x", "h", "w"]
    on = " AND ".join(f"s.{k} = p.{k}" for k in ("stack_id", *by))
    return q.add(name, f"""SELECT {', '.join('p.' + k for k in ks)}, {', '.join(f'sum(ty.k*tx.k*s.{c}) AS {c}' for c in cols)} FROM {grid} p
        JOIN (VALUES {rows}) ty(p, o, k) ON ty.p = p.y % 2 JOIN (VALUES {rows}) tx(p, o, k) ON tx.p = p.x % 2
        JOIN {src} s ON {on} AND s.y = {at('y', 'h')} AND s.x = {at('x', 'w')} GROUP BY {', '.join('p.' + k for k in ks)}""")


def pyramid_sql(q, src, levels, details, lows=(), by=("frame",), tag="py"):
    """Relations <tag>g<i> (low-pass) and <tag> (union with level)."""
    ks = ", ".join(["stack_id", *by, "y", "x", "h", "w"])
    cols = [*details, *lows]
    q.add(f"{tag}g0", f"SELECT {ks}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)} FROM {src}")
    parts = []
    for i in range(levels):
        down_sql(q, f"{tag}g{i+1}", f"{tag}g{i}", cols, by)
        if details:
            up_sql(q, f"{tag}u{i}", f"{tag}g{i+1}", f"{tag}g{i}", details, by)
            q.add(f"{tag}d{i}", f"SELECT {', '.join('g.' + k for k in ks.split(', '))}, {', '.join([f'g.{c} - u.{c} AS {c}' for c in details] + [f'g.{c}' for c in lows])} FROM {tag}g{i} g JOIN {tag}u{i} u USING ({', '.join(['stack_id', *by, 'y', 'x'])})")
        parts.append(f"SELECT {ks}, {i} AS level, {', '.join(cols)} FROM {tag}{'d' if details else 'g'}{i}")
    parts.append(f"SELECT {ks}, {levels} AS level, {', '.join(cols)} FROM {tag}g{levels}")
    return q.add(tag, " UNION ALL ".join(parts))


def collapse_sql(q, bands, levels, cols, out, by=()):
    ks = ", ".join(["stack_id", *by, "y", "x", "h", "w"])
    one = ", ".join(["stack_id", *by, "y", "x"])
    q.add(f"{out}{levels}", f"SELECT {ks}, {', '.join(cols)} FROM {bands} WHERE level = {levels}")
    for i in range(levels - 1, -1, -1):
        q.add(f"{out}b{i}", f"SELECT {ks}, {', '.join(cols)} FROM {bands} WHERE level = {i}")
        up_sql(q, f"{out}u{i}", f"{out}{i+1}", f"{out}b{i}", cols, by)
        q.add(f"{out}{i}", f"SELECT b.{ks.replace(', ', ', b.')}, {', '.join(f'b.{c} + u.{c} AS {c}' for c in cols)} FROM {out}b{i} b JOIN {out}u{i} u USING ({one})")
    return q


add("Y1_auto_levels", lambda s, f: d.observations(s, f).select("x", "y").distinct().select("x", "y", py.auto_levels("x", "y").alias("levels")),
    Q().obs().select("SELECT DISTINCT x, y, CAST(greatest(1, least(6, greatest(1, CAST(floor(log2(greatest(1, least(x, y)))) AS INT) - 1))) AS INT) AS levels FROM obs"))
add("Y2_pyr_down", lambda s, f: py.pyr_down(px(s, f, 5), ["v"], side=16).select(*ID, "h", r6("v", "v")),
    down_sql(Q().pixels(5), "dn", "px", ["v"]).select(f"SELECT {ids}, CAST(h AS INT) AS h, {s6('v', 'v')} FROM dn"))


def up(s, f):
    low = py.pyr_down(px(s, f, 5), ["v"], side=16)
    return py.pyr_up(low, ["v"], F.lit(40), F.lit(40), side=16).select(*ID, r6("v", "v"))


add("Y3_pyr_up", up, up_sql(down_sql(Q().pixels(5), "dn", "px", ["v"]), "up", "dn", "px", ["v"]).select(f"SELECT {ids}, {s6('v', 'v')} FROM up"))
add("Y4_laplacian_pyramid", lambda s, f: py.pyramid(px(s, f, 2), ["v"], depth=3, side=8).select("level", *ID, r6("v", "v")),
    pyramid_sql(Q().pixels(2), "px", 3, ["v"]).select(f"SELECT level, stack_id, frame, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {s6('v', 'v')} FROM py"))
add("Y5_collapse", lambda s, f: py.collapse(py.pyramid(px(s, f, 2), ["v"], depth=3), ["v"], ("frame",), depth=3).select(*ID, r6("v", "v")),
    Q().pixels(2).select(f"SELECT {ids}, CAST(v AS DOUBLE) AS v FROM px"))


def resize(s, f):
    p = px(s, f, 2)
    a = rs.area_down(p, ["v"], 2).select("stack_id", "frame", "y", "x", r6("v", "v")).withColumn("kind", F.lit("area"))
    n = rs.nearest_resize(p.select(*ID, "h", "w", "v"), 10, 24).select(*ID, F.col("v").cast("double").alias("v")).withColumn("kind", F.lit("nearest"))
    return a.unionByName(n)


add("Y6_resize", resize, Q().pixels(2).add("tg", "SELECT ty, tx FROM (SELECT unnest(range(10)) AS ty), (SELECT unnest(range(24)) AS tx)").select(f"""SELECT stack_id, frame, CAST(y//2 AS INT) AS y, CAST(x//2 AS INT) AS x, {s6('avg(v)', 'v')}, 'area' AS kind FROM px GROUP BY 1,2,3,4
 UNION ALL SELECT stack_id, frame, CAST(ty AS INT), CAST(tx AS INT), CAST(v AS DOUBLE), 'nearest' FROM px JOIN tg ON y = (ty*16)//10 AND x = (tx*16)//24"""))
FIELD = ("x + 0.3*y - 1.25 + frame", "y - 0.15*x + 0.5")


def sample_sql(q, src, field, cols, size, out):
    """Bilinear read with zero outside, gathered from four candidate pixels."""
    return q.add(out, f"""SELECT p.stack_id, p.frame, p.y, p.x, p.sx, p.sy, {', '.join(f'coalesce(sum((1-abs(p.sx-s.x))*(1-abs(p.sy-s.y))*s.{c}), 0) AS {c}' for c in cols)},
      (p.sx >= 0 AND p.sy >= 0 AND p.sx <= {size - 1} AND p.sy <= {size - 1}) AS valid
      FROM {field} p LEFT JOIN (SELECT unnest([0,1]) AS o) a ON true LEFT JOIN (SELECT unnest([0,1]) AS o) b ON true
      LEFT JOIN {src} s ON s.stack_id = p.stack_id AND s.frame = p.frame AND s.x = floor(p.sx) + a.o AND s.y = floor(p.sy) + b.o GROUP BY ALL""")


def remap(s, f):
    p = px(s, f, 2)
    fld = p.select(*ID, F.expr(FIELD[0]).cast("double").alias("sx"), F.expr(FIELD[1]).cast("double").alias("sy"))
    return rs.remap(p, fld, ["v"], side=8).select(*ID, r6("v", "v"), F.col("valid").cast("int").alias("valid"))


fsql = lambda q, a=FIELD[0], b=FIELD[1], src="px": q.add("fld", f"SELECT {ids}, CAST({a} AS DOUBLE) AS sx, CAST({b} AS DOUBLE) AS sy FROM {src}")
add("Y7_remap", remap, sample_sql(fsql(Q().pixels(2)), "px", "fld", ["v"], 16, "o").select(f"SELECT {ids}, {s6('v', 'v')}, CAST(valid AS INT) AS valid FROM o"))


def warps(p):
    fr = p.select("stack_id", "frame").distinct()
    return fr.select("stack_id", "frame", F.array(F.lit(1.0), F.lit(0.25), F.col("frame") * 0.5 - 1, F.lit(-0.125), F.lit(1.0), F.lit(0.75), F.lit(0.0), F.lit(0.0078125), F.lit(1.0)).alias("m"))


WARP = ("(x + 0.25*y + frame*0.5 - 1) / (0.0078125*y + 1)", "(-0.125*x + y + 0.75) / (0.0078125*y + 1)")
add("Y8_warp", lambda s, f: (lambda p: rs.warp(p, warps(p), ["v"]).select(*ID, r6("v", "v"), F.col("valid").cast("int").alias("valid")))(px(s, f, 2)),
    sample_sql(fsql(Q().pixels(2), *WARP), "px", "fld", ["v"], 16, "o").select(f"SELECT {ids}, {s6('v', 'v')}, CAST(valid AS INT) AS valid FROM o"))


def blend(s, f):
    p = px(s, f)
    w = p.select(*ID, F.explode(F.array(F.lit(0), F.lit(1))).alias("region"), "v").withColumn("wt", F.when(F.col("region") == 0, F.col("v") / 256).otherwise(1 - F.col("v") / 256))
    m = p.select("stack_id", "frame").distinct().withColumn("region", F.explode(F.array(F.lit(0), F.lit(1))))
    m = m.withColumn("m", F.array(F.lit(1.0), F.lit(0.0), F.col("region") * 2.0 - F.col("frame"), F.lit(0.0), F.lit(1.0), F.col("region") * 0.5))
    return rs.blend_fields(w, m).select(*ID, r6("sx", "sx"), r6("sy", "sy"))


add("Y9_blend_fields", blend, Q().pixels().select(f"SELECT {ids}, {s6('v/256.0::DOUBLE*(x-frame) + (1-v/256.0::DOUBLE)*(x+2-frame)', 'sx')}, {s6('v/256.0::DOUBLE*y + (1-v/256.0::DOUBLE)*(y+0.5)', 'sy')} FROM px"))


def piecewise(s, f):
    p = px(s, f)
    lab = p.filter("frame = 0").select("stack_id", "y", "x", (F.col("v") > 128).cast("int").alias("piece"))
    m = p.select("stack_id", "frame").distinct().withColumn("piece", F.explode(F.array(F.lit(0), F.lit(1))))
    m = m.withColumn("m", F.array(F.lit(1.0), F.lit(0.5), F.col("piece") * 2.0 - F.col("frame"), F.lit(0.0), F.lit(1.0), F.col("frame") * 1.0))
    return rs.piecewise_field(lab, m).select(*ID, r6("sx", "sx"), r6("sy", "sy"))


add("Y10_piecewise_field", piecewise, Q().pixels().select(f"SELECT p.stack_id, f.frame, p.y, p.x, {s6('p.x + 0.5*p.y + 2*CAST(p.v > 128 AS INT) - f.frame', 'sx')}, {s6('p.y + f.frame', 'sy')} FROM px p JOIN (SELECT DISTINCT stack_id, frame FROM px) f ON f.stack_id = p.stack_id WHERE p.frame = 0"))


def compose(s, f):
    p = px(s, f)
    outer = p.select(*ID, (F.col("x") + 0.5).alias("sx"), (F.col("y") * 1.0).alias("sy"))
    inner = p.select(*ID, "h", "w", (F.col("x") + F.col("v") / 64.0).alias("sx"), (F.col("y") - F.col("v") / 128.0).alias("sy"))
    return rs.compose_fields(outer, inner).select(*ID, r6("sx", "sx"), r6("sy", "sy"), F.col("valid").cast("int").alias("valid"))


add("Y11_compose_fields", compose, sample_sql(Q().pixels().add("inn", "SELECT stack_id, frame, y, x, x + v/64.0::DOUBLE AS cx, y - v/128.0::DOUBLE AS cy FROM px").add("fld", f"SELECT {ids}, x + 0.5::DOUBLE AS sx, CAST(y AS DOUBLE) AS sy FROM px"), "inn", "fld", ["cx", "cy"], 8, "o")
    .select(f"SELECT {ids}, {s6('cx', 'sx')}, {s6('cy', 'sy')}, CAST(valid AS INT) AS valid FROM o"))


def native(s, f):
    small = rs.area_down(px(s, f, 2), ["v"], 2)
    fld = small.select(*ID, "h", "w", (F.col("x") + F.col("v") / 64.0).alias("sx"), (F.col("y") * 1.0).alias("sy"))
    return rs.scale_field(fld, 2).select(*ID, r6("sx", "sx"), r6("sy", "sy"))


near = lambda a: f"greatest(0, least(7, floor((p.{a}+0.5)/2 - 0.5) + t{a}.o))"
wgt = lambda a: f"CASE WHEN t{a}.o = 0 THEN 1 - ((p.{a}+0.5)/2 - 0.5 - floor((p.{a}+0.5)/2 - 0.5)) ELSE (p.{a}+0.5)/2 - 0.5 - floor((p.{a}+0.5)/2 - 0.5) END"
add("Y12_native_field", native, Q().pixels(2).add("sm", "SELECT stack_id, frame, y//2 AS y, x//2 AS x, x//2 + avg(v)/64 AS sx, CAST(y//2 AS DOUBLE) AS sy FROM px GROUP BY stack_id, frame, y//2, x//2")
    .add("o", f"SELECT p.stack_id, p.frame, p.y, p.x, sum(({wgt('x')})*({wgt('y')})*s.sx) AS sx, sum(({wgt('x')})*({wgt('y')})*s.sy) AS sy FROM px p, (SELECT unnest([0,1]) AS o) tx, (SELECT unnest([0,1]) AS o) ty, sm s WHERE s.stack_id=p.stack_id AND s.frame=p.frame AND s.x={near('x')} AND s.y={near('y')} GROUP BY ALL")
    .select(f"SELECT {ids}, {s6('(sx+0.5)*2-0.5', 'sx')}, {s6('(sy+0.5)*2-0.5', 'sy')} FROM o"))
RECT = ("stack_id % 3", "stack_id % 2 + 1", "6", "7")


def rects(p):
    return p.select("stack_id").distinct().select("stack_id", *[F.expr(f"CAST({e} AS INT)").alias(n) for e, n in zip(RECT, ("y0", "x0", "y1", "x1"))])


def crop_place(s, f):
    p = px(s, f)
    r = rects(p)
    c = rs.crop(p, r)
    return rs.place(c, r, p, ["v"], -1).select(*ID, "v").join(c.select(*ID, F.col("v").alias("cropped"), "h", "w").drop("v"), ID, "left").select(*ID, "v", "cropped", F.col("h").alias("ch"), F.col("w").alias("cw"))


add("Y13_crop_place", crop_place, Q().pixels().add("c", f"SELECT stack_id, frame, y - {RECT[0]} AS y, x - ({RECT[1]}) AS x, v, 6 - {RECT[0]} AS ch, 7 - ({RECT[1]}) AS cw FROM px WHERE y >= {RECT[0]} AND y < 6 AND x >= {RECT[1]} AND x < 7")
    .select(f"SELECT px.stack_id, px.frame, px.y, px.x, CASE WHEN px.y >= px.stack_id%3 AND px.y < 6 AND px.x >= px.stack_id%2+1 AND px.x < 7 THEN px.v ELSE -1 END AS v, c.v AS cropped, CAST(ch AS INT) AS ch, CAST(cw AS INT) AS cw FROM px LEFT JOIN c USING ({ids})"))
NEAR = """SELECT p.stack_id, p.frame, p.y, p.x, p.v, (p.v > 150) AS k, q.v AS nv, (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y) AS d2 FROM px p LEFT JOIN px q ON q.stack_id=p.stack_id AND q.frame=p.frame AND q.v > 150 AND (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y) <= 9
  QUALIFY row_number() OVER (PARTITION BY p.stack_id, p.frame, p.y, p.x ORDER BY d2, q.y, q.x) = 1"""
known = lambda s, f, t=1: px(s, f, t).withColumn("known", F.col("v") > 150)
add("Y14_nearest_fill", lambda s, f: rs.nearest_fill(known(s, f, 2), "v", "known", 3, side=8).select(*ID, "v"),
    Q().pixels(2).add("n", NEAR).select(f"SELECT {ids}, CASE WHEN k THEN v ELSE nv END AS v FROM n"))
add("Y15_distance", lambda s, f: rs.distance(known(s, f), "known", 3).select(*ID, r6("dist", "dist")),
    Q().pixels().add("n", NEAR).select(f"SELECT {ids}, {s6('sqrt(d2)', 'dist')} FROM n"))


def sampled(s, f):
    p = px(s, f)
    fld = p.select(*ID, (F.col("x") + F.col("frame") * 0.75).alias("sx"), (F.col("y") - 0.25).alias("sy"))
    return rs.sample_mask(p.filter("v > 140"), fld).select(*ID, F.col("hit").cast("int").alias("hit"))


add("Y16_sample_mask", sampled, Q().pixels().select("SELECT p.stack_id, p.frame, p.y, p.x, CAST(q.v IS NOT NULL AS INT) AS hit FROM px p LEFT JOIN px q ON q.stack_id=p.stack_id AND q.frame=p.frame AND q.v > 140 AND q.x = round_even(p.x + p.frame*0.75, 0) AND q.y = round_even(p.y - 0.25, 0)"))
