"""M rows: fusion, with the exposure and selection aggregates A1 and A2."""

from pyspark.sql import functions as F

from checks.q_a_kernels import ID, ids, px
from checks.q_b_focus import PX, USABLE, energy_sql, pxs, winner_sql
from checks.q_c_resample import collapse_sql, down_sql, pyramid_sql
from checks.registry import Q, add, r6, s6
from sharpfleet.functions import columns as fc
from sharpfleet.operators import fusion as fu
from sharpfleet.operators import pyramid as py
from sharpfleet.operators import stats as sa
from sharpfleet.operators import evidence as ev
from sharpfleet.sources import derived as d

RGB = ["b", "g", "r"]
OUT = [*PX, *RGB]
rgb = lambda s, f, tiles=2: ev.with_gray(d.colour(px(s, f, tiles)))
grays = lambda tiles=2: Q().pixels(tiles).colour().add("gp", f"SELECT {ids}, h, w, b, g, r, CAST(floor((b*114+g*587+r*299+500)/1000) AS INT) AS v FROM px3")
u8 = lambda c: f"CAST(floor(greatest(0, least(255, round({c}, 6)))) AS INT) AS {c}"
image = lambda src: f"SELECT stack_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {u8('b')}, {u8('g')}, {u8('r')} FROM {src}"


def guided_sql(q, name, src, guide, p, r, eps="0.001", by=("frame",), carry=()):
    """Guided filter of column p along column guide; result column ``gf`` plus carried columns."""
    ks = ", ".join(["stack_id", *by, "y", "x"])
    q.add(f"{name}p", f"SELECT *, {guide} AS gi, {p} AS gs, {eps} AS ge, ({guide})*({guide}) AS gii, ({guide})*({p}) AS gip FROM {src}")
    q.box(f"{name}m", f"{name}p", r, {"mi": "gi", "mp": "gs", "mii": "gii", "mip": "gip"}, by, carry=("gi", "ge", *carry))
    q.add(f"{name}a", f"SELECT *, (mip - mi*mp)/(mii - mi*mi + ge) AS ga, mp - (mip - mi*mp)/(mii - mi*mi + ge)*mi AS gb FROM {name}m")
    q.box(f"{name}b", f"{name}a", r, {"a2": "ga", "b2": "gb"}, by, carry=("gi", *carry))
    return q.add(name, f"SELECT {ks}, h, w, a2*gi + b2 AS gf{''.join(', ' + c for c in carry)} FROM {name}b")


def weights_sql(q, method="content_aware", radius=8, k=9, harden=0.5, usable=None):
    energy_sql(q, method, k, "gp", "v")
    e = "en"
    if usable:
        q.add("enu", f"SELECT {ids}, h, w, CASE WHEN bool_or({usable}) OVER (PARTITION BY {pxs}) AND NOT ({usable}) THEN -1.0 ELSE e END AS e FROM en")
        e = "enu"
    winner_sql(q, e)
    q.add("wr", f"SELECT gp.*, gp.v/255.0::DOUBLE AS gd, CAST(gp.frame = winner AS DOUBLE) AS raw, (e1-e2)/(e1+1e-6) AS dom FROM gp JOIN wn USING ({pxs})")
    q.box("cf", "wr", 7, {"cf": "dom"})
    guided_sql(q, "gw", "wr", "gd", "raw", radius, carry=("raw", "b", "g", "r"))
    q.add("w1", f"SELECT gw.*, (1-c)*greatest(gf, 0) + c*raw AS w0 FROM gw JOIN (SELECT {ids}, least(1, greatest(0, cf*{harden})) AS c FROM cf) USING ({ids})")
    if usable:
        q.add("w2", f"SELECT * REPLACE (CASE WHEN bool_or({usable}) OVER (PARTITION BY {pxs}) AND NOT ({usable}) THEN 0 ELSE w0 END AS w0) FROM w1")
        q.add("w3", f"SELECT * REPLACE (w0 / (sum(w0) OVER (PARTITION BY {pxs}) + 1e-8) AS w0) FROM w2")
    return q.add("wts", f"SELECT {ids}, h, w, b, g, r, w0 / (sum(w0) OVER (PARTITION BY {pxs}) + 1e-8) AS wt FROM {'w3' if usable else 'w1'}")


def multiband_sql(q, src, levels, out="mb"):
    pyramid_sql(q, src, levels, RGB, ["wt"], tag=out + "p")
    q.add(out + "x", f"SELECT stack_id, level, y, x, h, w, {', '.join(f'sum(wt*{c})/(sum(wt)+1e-8) AS {c}' for c in RGB)} FROM {out}p GROUP BY ALL")
    return collapse_sql(q, out + "x", levels, RGB, out)


def exposed(q):
    q.add("mn", "SELECT stack_id, frame, avg(b) AS b, avg(g) AS g, avg(r) AS r FROM px3 GROUP BY ALL")
    q.add("md", "SELECT stack_id, median(b) AS b, median(g) AS g, median(r) AS r FROM mn GROUP BY ALL")
    scaled = ", ".join(f"CAST(floor(least(255, round(p.{c} * (md.{c} / greatest(mn.{c}, 1e-3)), 6))) AS INT) AS {c}" for c in RGB)
    return q.add("nx", f"SELECT {', '.join('p.' + c for c in ID)}, p.h, p.w, {scaled} FROM px3 p JOIN mn ON mn.stack_id=p.stack_id AND mn.frame=p.frame JOIN md ON md.stack_id=p.stack_id")


GRAY = "CAST(floor((b*114+g*587+r*299+500)/1000) AS INT) AS v"
add("M1_max_fusion", lambda s, f: fu.fuse_max(sa.normalize_exposure(d.colour(px(s, f)))).select(*OUT, "winner"),
    winner_sql(energy_sql(exposed(Q().pixels().colour()).add("gp", f"SELECT {ids}, h, w, b, g, r, {GRAY} FROM nx"), "laplacian", 9, "gp"))
    .select(f"SELECT {pxs}, b, g, r, winner FROM wn JOIN gp USING ({pxs}) WHERE frame = winner"))
add("A1_exposure", lambda s, f: sa.normalize_exposure(d.colour(px(s, f))).select(*ID, *RGB),
    exposed(Q().pixels().colour()).select(f"SELECT {ids}, b, g, r FROM nx"))


def shares(s, f):
    from sharpfleet.operators import focus as fo
    return sa.winner_share(fo.winner(fo.focus_measure(px(s, f)))).select("stack_id", "winner", "pixels", r6("share", "share"), F.col("owner").cast("int").alias("owner"))


add("A2_winner_share", shares, winner_sql(energy_sql(Q().pixels(), "laplacian")).add("c", "SELECT stack_id, winner, count(*) AS pixels FROM wn GROUP BY ALL")
    .select(f"SELECT stack_id, winner, pixels, {s6('pixels / sum(pixels) OVER (PARTITION BY stack_id)', 'share')}, CAST(row_number() OVER (PARTITION BY stack_id ORDER BY pixels DESC, winner) = 1 AS INT) AS owner FROM c"))


def m2_sql():
    q = pyramid_sql(grays(), "gp", 3, RGB)
    q.add("sq", "SELECT *, b*b + g*g + r*r AS e FROM py WHERE level < 3").box("bx", "sq", 3, {"e": "e"}, ("frame", "level"), mean=False, carry=("b", "g", "r"))
    q.add("mx", """SELECT stack_id, level, y, x, h, w, b, g, r FROM bx QUALIFY row_number() OVER (PARTITION BY stack_id, level, y, x ORDER BY e DESC, frame) = 1
      UNION ALL SELECT stack_id, level, y, x, h, w, avg(b), avg(g), avg(r) FROM py WHERE level = 3 GROUP BY ALL""")
    return collapse_sql(q, "mx", 3, RGB, "o").select(image("o0"))


add("M2_pyramid_fusion", lambda s, f: fu.fuse_pyramid(rgb(s, f), depth=3, side=16).select(*OUT), m2_sql())
add("M3_guided_filter", lambda s, f: fu.guided_filter(px(s, f, 5), F.col("v") / 255.0, (F.col("v") > 128).cast("double"), "gf", 5, side=20).select(*ID, r6("gf", "gf")),
    guided_sql(Q().pixels(5), "o", "px", "v/255.0::DOUBLE", "CAST(v > 128 AS DOUBLE)", 5).select(f"SELECT {ids}, {s6('gf', 'gf')} FROM o"))
add("M4_guided_weights", lambda s, f: fu.guided_weights(rgb(s, f)).select(*ID, r6("wt", "wt")), weights_sql(grays()).select(f"SELECT {ids}, {s6('wt', 'wt')} FROM wts"))
add("M4_usable_weights", lambda s, f: fu.guided_weights(rgb(s, f).withColumn("ok", F.expr(USABLE)), usable="ok").select(*ID, r6("wt", "wt")),
    weights_sql(grays(), usable=USABLE).select(f"SELECT {ids}, {s6('wt', 'wt')} FROM wts"))


def m5(s, f):
    w = fu.guided_weights(rgb(s, f, 5), scale=2, radius=4).groupBy("stack_id", "y", "x").agg(F.sum("wt").alias("total"), F.min("wt").alias("low"))
    return w.select("stack_id", "y", "x", r6("total", "total", 4), (F.col("low") >= 0).cast("int").alias("positive"))


add("M5_scaled_weights", m5, Q().pixels(5).select("SELECT DISTINCT stack_id, y, x, 1.0::DOUBLE AS total, 1 AS positive FROM px"))
add("M6_decision_fusion", lambda s, f: fu.fuse_decision(rgb(s, f)).select(*OUT),
    weights_sql(grays()).add("o", f"SELECT {pxs}, sum(wt*b) AS b, sum(wt*g) AS g, sum(wt*r) AS r FROM wts GROUP BY ALL").select(image("o")))


def m7(s, f):
    p = rgb(s, f).withColumn("wt", (F.col("v") + 1) / 300.0)
    return fu.multiband_blend(p, depth=3).select(*OUT)


add("M7_multiband_blend", m7, multiband_sql(grays().add("wsrc", "SELECT stack_id, frame, y, x, h, w, b, g, r, (b+1)/300.0::DOUBLE AS wt FROM gp"), "wsrc", 3).select(image("mb0")))
add("M8_blend_fusion", lambda s, f: fu.fuse_blend(rgb(s, f), depth=3).select(*OUT), multiband_sql(weights_sql(grays()), "wts", 3).select(image("mb0")))
HARD = f"SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY {pxs} ORDER BY wt DESC, frame) = 1 AS DOUBLE) AS wt) FROM wts"
add("M9_coherent_fusion", lambda s, f: fu.fuse_coherent(rgb(s, f), depth=3).select(*OUT), multiband_sql(weights_sql(grays()).add("hw", HARD), "hw", 3).select(image("mb0")))


def perband_sql(q, src="gp", usable=None, boundary=None, out="pb"):
    """Per-band weights and images of 16×16 stacks."""
    lows = ["v"] + (["ok"] if usable else []) + (["bd"] if boundary else [])
    pyramid_sql(q, src, 3, RGB, lows, tag=out)
    mixes = []
    for lv, (r, k) in enumerate(((2, 5), (1, 3), (1, 3))):
        t = f"{out}{lv}"
        guide, eps, bcol = "v/255.0::DOUBLE", "0.001", ""
        if boundary:
            bcol = f", bd / (max(bd) OVER (PARTITION BY stack_id) + 1e-6) AS bn"
            guide, eps = "(0.5*v/255.0::DOUBLE + 0.5*bn)", "(0.001*(1+4*(1-least(1, 3*bn))))"
        q.add(f"{t}s", f"SELECT *, b*b+g*g+r*r AS e{bcol} FROM {out} WHERE level = {lv}")
        carry = ["b", "g", "r", "v"] + (["ok"] if usable else []) + (["bn"] if boundary else [])
        q.box(f"{t}e", f"{t}s", k // 2, {"e": "e"}, carry=carry)
        ok = f"bool_or(ok > 0.5) OVER (PARTITION BY {pxs}) AND NOT (ok > 0.5)"
        e = f"CASE WHEN {ok} THEN -1.0 ELSE e END" if usable else "e"
        q.add(f"{t}f", f"SELECT * REPLACE ({e} AS e) FROM {t}e")
        winner_sql(q, f"{t}f", out=f"{t}n")
        q.add(f"{t}r", f"SELECT x.*, CAST(x.frame = winner AS DOUBLE) AS raw, least(1, greatest(0, (e1-e2)/(e1+1e-6))) AS cf FROM {t}f x JOIN {t}n USING ({pxs})")
        guided_sql(q, f"{t}g", f"{t}r", guide, "raw", r, eps, carry=("raw", "cf", "b", "g", "r") + (("ok",) if usable else ()))
        q.add(f"{t}w0", f"SELECT *, (1-cf)*greatest(gf, 0) + cf*raw AS wt FROM {t}g")
        if usable:
            q.add(f"{t}w1", f"SELECT * REPLACE (CASE WHEN {ok} THEN 0 ELSE wt END AS wt) FROM {t}w0")
            q.add(f"{t}w2", f"SELECT * REPLACE (wt / (sum(wt) OVER (PARTITION BY {pxs}) + 1e-8) AS wt) FROM {t}w1")
        q.add(f"{t}w", f"SELECT {ids}, h, w, b, g, r, wt / (sum(wt) OVER (PARTITION BY {pxs}) + 1e-8) AS wt FROM {t}{'w2' if usable else 'w0'}")
        mixes.append(f"SELECT stack_id, {lv} AS level, y, x, h, w, sum(wt*b) AS b, sum(wt*g) AS g, sum(wt*r) AS r FROM {t}w GROUP BY ALL")
    down_sql(q, f"{out}lo", f"{out}2w", ["wt"])
    q.add(f"{out}bw", f"SELECT p.*, greatest(l.wt, 0) AS wt0 FROM {out} p JOIN {out}lo l USING ({ids}) WHERE p.level = 3")
    q.add(f"{out}bn", f"SELECT *, wt0 / (sum(wt0) OVER (PARTITION BY {pxs}) + 1e-8) AS wt FROM {out}bw")
    mixes.append(f"SELECT stack_id, 3 AS level, y, x, h, w, sum(wt*b) AS b, sum(wt*g) AS g, sum(wt*r) AS r FROM {out}bn GROUP BY ALL")
    q.add(f"{out}x", " UNION ALL ".join(mixes))
    return collapse_sql(q, f"{out}x", 3, RGB, f"{out}o")


add("M10_perband_fusion", lambda s, f: fu.fuse_perband(rgb(s, f), depth=3).select(*OUT), perband_sql(grays()).select(image("pbo0")))
add("M10_usable_perband", lambda s, f: fu.fuse_perband(rgb(s, f).withColumn("ok", F.expr(USABLE)), depth=3, usable="ok").select(*OUT),
    perband_sql(grays().add("gq", f"SELECT *, CAST({USABLE} AS DOUBLE) AS ok FROM gp"), "gq", usable=True).select(image("pbo0")))
add("M11_boundary_perband", lambda s, f: fu.fuse_perband(rgb(s, f).withColumn("bd", F.least(F.lit(1.0), (F.col("v") + F.col("x")) / 260.0)), depth=3, boundary="bd").select(*OUT),
    perband_sql(grays().add("gq", "SELECT *, least(1.0, (b + x)/260.0::DOUBLE) AS bd FROM gp"), "gq", boundary=True).select(image("pbo0")))


def instab_sql(q, k=9):
    winner_sql(energy_sql(q, "content_aware", k, "gp"))
    q.add("hot", f"SELECT gp.{', gp.'.join(ID)}, h, w, CAST(frame = winner AS INT) AS hot, winner, (e1-e2)/(e1+1e-6) AS dom FROM gp JOIN wn USING ({pxs})")
    q.box("sh", "hot", 2, {"s": "hot"}, mean=False, carry=("winner", "dom"))
    return q.add("sc", "SELECT stack_id, avg(CAST(s < 12.5 AND least(1, greatest(0, dom)) < 0.25 AS INT)) AS score FROM sh WHERE frame = winner GROUP BY ALL")


add("M12_instability", lambda s, f: fu.instability(rgb(s, f)).select("stack_id", r6("score", "score")), instab_sql(grays()).select(f"SELECT stack_id, {s6('score', 'score')} FROM sc"))
def m13_sql():
    q = instab_sql(grays())
    # the energies of the score are those of the weights, so the weights reuse them
    q.add("wr", f"SELECT gp.*, gp.v/255.0::DOUBLE AS gd, CAST(gp.frame = winner AS DOUBLE) AS raw, (e1-e2)/(e1+1e-6) AS dom FROM gp JOIN wn USING ({pxs})")
    q.box("cf", "wr", 7, {"cf": "dom"})
    guided_sql(q, "gw", "wr", "gd", "raw", 8, carry=("raw", "b", "g", "r"))
    q.add("w1", f"SELECT gw.*, (1-c)*greatest(gf, 0) + c*raw AS w0 FROM gw JOIN (SELECT {ids}, least(1, greatest(0, cf*0.5)) AS c FROM cf) USING ({ids})")
    q.add("wts", f"SELECT {ids}, h, w, b, g, r, w0 / (sum(w0) OVER (PARTITION BY {pxs}) + 1e-8) AS wt FROM w1").add("hw", HARD)
    multiband_sql(q, "hw", 3)
    perband_sql(q)
    return q.select(f"SELECT i.*, 1 AS coherent FROM ({image('mb0')}) i JOIN sc USING (stack_id) WHERE score >= 0.35 UNION ALL SELECT i.*, 0 AS coherent FROM ({image('pbo0')}) i JOIN sc USING (stack_id) WHERE score < 0.35")


add("M13_routed_fusion", lambda s, f: fu.fuse_routed(rgb(s, f), depth=3, threshold=0.35).select(*OUT, F.col("coherent").cast("int").alias("coherent")), m13_sql())
DEPTH = lambda q: guided_sql(winner_sql(energy_sql(q, "content_aware", 9, "gp")).add("dw", f"SELECT gp.stack_id, gp.y, gp.x, h, w, v/255.0::DOUBLE AS gd, winner/4.0::DOUBLE AS dr FROM gp JOIN wn USING ({pxs}) WHERE frame = winner"), "dp", "dw", "gd", "dr", 8, by=())
add("M14_depth", lambda s, f: fu.depth_from_focus(rgb(s, f)).select(*PX, r6("depth", "depth")), DEPTH(grays()).select(f"SELECT {pxs}, {s6('least(1, greatest(0, gf))', 'depth')} FROM dp"))


def adaptive_inputs(s, f):
    """The five frames stand in for five candidate images; the local brightness stands in for the quality."""
    p = rgb(s, f)
    return p.withColumnRenamed("frame", "preset"), p.select("stack_id", F.col("frame").alias("preset"), "y", "x", F.col("v").cast("double").alias("q"))


add("M15_adaptive_fusion", lambda s, f: fu.fuse_adaptive(*adaptive_inputs(s, f), depth=3).select(*OUT),
    multiband_sql(guided_sql(winner_sql(grays(), "gp", "b").add("wr", f"SELECT gp.*, gp.v/255.0::DOUBLE AS gd, CAST(gp.frame = winner AS DOUBLE) AS raw FROM gp JOIN wn USING ({pxs})"), "gw", "wr", "gd", "raw", 8, carry=("b", "g", "r"))
    .add("wts", f"SELECT {ids}, h, w, b, g, r, greatest(gf, 0) / (sum(greatest(gf, 0)) OVER (PARTITION BY {pxs}) + 1e-8) AS wt FROM gw"), "wts", 3).select(image("mb0")))
