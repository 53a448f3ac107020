"""Edge sites as evidence, and the image areas that point evidence stands for."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharpfleet.functions.taps import gaussian_taps
from sharpfleet.operators import fusion as fu
from sharpfleet.operators import graph as gr
from sharpfleet.operators import stencil as st
from sharpfleet.operators.grid import FRAME, SIDE, STACK, X, Y, attach, blocked
from sharpfleet.runtime import cut

# Thresholds of the edge strength |gx| + |gy|, grid of the sites, margin that profiles need, silhouette step,
# distance that chains points of one object, and the radius a point stands for.
WEAK, STRONG, STRIDE, MARGIN, LIMB_STEP, PROBE, CHAIN, REACH = 60.0, 180.0, 6, 54, 0.15, 4, 52.0, 26.0
TAN_LOW, TAN_HIGH = 0.41421356237309503, 2.414213562373095  # 22.5 and 67.5 degrees


def thin_edges(px: DataFrame, v: str = "v", weak: float = WEAK, strong: float = STRONG, sigma: float = 1.1, by: Sequence[str] = (FRAME,), side: int = SIDE) -> DataFrame:
    """Gradient of the smoothed image (gx, gy, ``force`` = |gx| + |gy|) and whether a pixel is the ridge of an edge (``thin``, ``sure``).

    A ridge is larger than both neighbours along its quantised normal; of equal neighbours in a row or column the first
    counts. Forces are rounded to nine digits, so that equal ones compare as equal in every plan.
    """
    def at(dy: int, dx: int) -> Column:
        name = {-1: "_l", 0: "force", 1: "_r"}[dx]
        return F.coalesce(st.neighbour(name, dy, Y, by, "none"), F.lit(0.0))

    def body(d):
        d = st.separable(d, {"_sm": F.col(v).cast("double")}, gaussian_taps(sigma, 2), by)
        d = st.derivatives(d, "_sm", ("gx", "gy"), by=by)
        d = d.withColumns({"gx": F.round("gx", 9), "gy": F.round("gy", 9)})
        d = d.withColumn("force", F.round(F.abs("gx") + F.abs("gy"), 9))
        d = d.withColumns({n: F.coalesce(st.neighbour("force", k, X, by, "none"), F.lit(0.0)) for n, k in (("_l", -1), ("_r", 1))})
        f, ax, ay = F.col("force"), F.abs("gx"), F.abs("gy")
        across = (f > at(0, -1)) & (f >= at(0, 1))
        down = (f > at(-1, 0)) & (f >= at(1, 0))
        falling = (f > at(-1, -1)) & (f > at(1, 1))  # gx and gy of one sign
        rising = (f > at(-1, 1)) & (f > at(1, -1))
        ridge = F.when(ay < ax * TAN_LOW, across).when(ay > ax * TAN_HIGH, down).when(F.col("gx") * F.col("gy") < 0, rising).otherwise(falling)
        return d.withColumns({"thin": ridge & (f > weak), "sure": ridge & (f > strong)}).drop("_sm", "_l", "_r")
    return blocked(px, 4, body, side)


def edge_sites(px: DataFrame, depth: str, v: str = "v", valid: str | None = None, weak: float = WEAK, strong: float = STRONG, stride: int = STRIDE,
               margin: int = MARGIN, limb: float = LIMB_STEP, probe: int = PROBE, side: int = SIDE) -> DataFrame:
    """Sites of edges: stack_id, frame, y, x, unit normal (nx, ny) and ``limb`` (a silhouette: the depth steps around it).

    Weak ridges count where their 8-connected edge holds a strong one. Sites lie on a grid of ``stride`` pixels, at least
    ``margin`` from the border, on valid pixels. Silhouettes belong in no rigid fit, but show where an object reaches.
    """
    def body(d):
        return st.step_height(thin_edges(d, v, weak, strong), depth, probe, "_step")
    ridge = cut(blocked(px, max(4, probe), body, side).filter("thin"))
    edge = gr.components(ridge, (STACK, FRAME), diagonal=True)
    held = edge.filter("sure").select(STACK, FRAME, "label").distinct()
    d = edge.join(held, [STACK, FRAME, "label"], "left_semi")
    inside = (F.col(Y) >= margin) & (F.col(X) >= margin) & (F.col(Y) < F.col("h") - margin) & (F.col(X) < F.col("w") - margin)
    d = d.filter(inside & (F.col(Y) % stride == 0) & (F.col(X) % stride == 0))
    d = d.filter(F.col(valid).cast("boolean")) if valid else d
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) + 1e-6
    return d.select(STACK, FRAME, Y, X, (F.col("gx") / size).alias("nx"), (F.col("gy") / size).alias("ny"), (F.col("_step") > limb).alias("limb"))


def features(sites: DataFrame, frame: int) -> DataFrame:
    """Sites of one frame as features (feature_id, x, y, nx, ny), the input of profiles and measurements."""
    d = sites.filter((F.col(FRAME) == frame) & ~F.col("limb"))
    return d.select(STACK, (F.col(Y).cast("long") * (1 << 24) + F.col(X)).alias("feature_id"), F.col(X).cast("double").alias("x"), F.col(Y).cast("double").alias("y"), "nx", "ny")


def chain(points: DataFrame, reach: float = CHAIN, by: Sequence[str] = (STACK,)) -> DataFrame:
    """Points (whole pixels x, y) with ``label``: those joined by steps shorter than ``reach`` share one.

    Equal positions are one node. Only neighbours to the right in 3×3 buckets are paired; evidence lies on a grid of
    sites, so a node has at most as many partners as sites fit the reach.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    n = points.select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    n = cut(n.withColumn("node", F.col("y") * (1 << 24) + F.col("x")))
    a = n.select(*by, F.col("node").alias("a"), F.col("x").alias("_ax"), F.col("y").alias("_ay"), cell("x").alias("_cx"), F.explode(F.sequence(cell("y") - 1, cell("y") + 1)).alias("_cy"))
    b = n.select(*by, F.col("node").alias("b"), F.col("x").alias("_bx"), F.col("y").alias("_by"), F.explode(F.array(cell("x"), cell("x") - 1)).alias("_cx"), cell("y").alias("_cy"))
    dx, dy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
    edges = a.join(b, [*by, "_cy", "_cx"]).filter((dx * dx + dy * dy < reach * reach) & (F.col("a") != F.col("b")))
    label = gr.connected(n.select(*by, "node"), edges.select(*by, "a", "b"), by)
    return n.join(label, [*by, "node"]).drop("node")


def _tiles(lo: Column, hi: Column, side: int) -> Column:
    return F.sequence(F.floor(lo / side).cast("long"), F.floor(hi / side).cast("long"))


def near_points(px: DataFrame, points: DataFrame, radius: float, by: Sequence[str] = (STACK,)) -> DataFrame:
    """Pixels (keys of ``by``, y, x) within ``radius`` of a point. ``by`` may hold keys that only the points have."""
    side = max(1, int(radius))
    own = [c for c in by if c in px.columns]
    p = points.select(*by, F.col("x").alias("_px"), F.col("y").alias("_py")).distinct()
    p = p.withColumn("_ty", F.explode(_tiles(F.col("_py") - radius, F.col("_py") + radius, side))).withColumn("_tx", F.explode(_tiles(F.col("_px") - radius, F.col("_px") + radius, side)))
    q = px.select(*own, Y, X).distinct().withColumns({"_ty": F.floor(F.col(Y) / side).cast("long"), "_tx": F.floor(F.col(X) / side).cast("long")})
    dx, dy = F.col(X) - F.col("_px"), F.col(Y) - F.col("_py")
    return q.join(p, [*own, "_ty", "_tx"]).filter(dx * dx + dy * dy <= radius * radius).select(*by, Y, X).distinct()


def near_hulls(px: DataFrame, hulls: DataFrame, border: float, by: Sequence[str] = (STACK,), side: int = SIDE) -> DataFrame:
    """Pixels inside the ring of a hull or within ``border`` of it. A hull meets the pixels of the tiles that it touches."""
    own = [c for c in by if c in px.columns]
    end = lambda f, c: f(F.transform("ring", lambda r: r[c]))
    h = hulls.select(*by, "ring").withColumn("_ty", F.explode(_tiles(end(F.array_min, "py") - border, end(F.array_max, "py") + border, side)))
    h = h.withColumn("_tx", F.explode(_tiles(end(F.array_min, "px") - border, end(F.array_max, "px") + border, side)))
    q = px.select(*own, Y, X).distinct().withColumns({"_ty": F.floor(F.col(Y) / side).cast("long"), "_tx": F.floor(F.col(X) / side).cast("long")})
    j = q.join(h, [*own, "_ty", "_tx"])
    turned = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    x, y = F.col(X).cast("double"), F.col(Y).cast("double")
    inside = F.forall(F.zip_with("ring", turned, lambda a, b: (b["px"] - a["px"]) * (y - a["py"]) - (b["py"] - a["py"]) * (x - a["px"])), lambda c: c >= -1e-9)

    def apart(a, b):
        ex, ey = b["px"] - a["px"], b["py"] - a["py"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["px"]) * ex + (y - a["py"]) * ey) / F.greatest(ex * ex + ey * ey, F.lit(1e-12))))
        return F.pow(x - a["px"] - t * ex, F.lit(2)) + F.pow(y - a["py"] - t * ey, F.lit(2))
    close = F.exists(F.zip_with("ring", turned, apart), lambda s: s <= border * border + 1e-9)
    return j.filter((F.size("ring") > 2) & inside | close).select(*by, Y, X).distinct()


def unexplained_area(px: DataFrame, points: DataFrame, reach: float = CHAIN, radius: float = REACH, least: int = 3) -> DataFrame:
    """Pixels (stack_id, y, x) around motion that no model explains.

    Points are chained to objects. An object of ``least`` points or more covers its hull and ``radius`` around it, so that
    stretches without evidence between its points are covered too; single points cover a disc.
    """
    c = cut(chain(points, reach))
    many = c.groupBy(STACK, "label").agg((F.count("*") >= least).alias("_many"))
    c = c.join(many, [STACK, "label"])
    whole = near_hulls(px, gr.hull(c.filter("_many"), (STACK, "label")), radius, (STACK, "label"))
    single = near_points(px, c.filter("NOT _many"), radius)
    return whole.select(STACK, Y, X).unionByName(single).distinct()


def refuse_unexplained(px: DataFrame, points: DataFrame, moving: DataFrame, reference: int, reach: float = CHAIN, radius: float = REACH, least: int = 3) -> DataFrame:
    """``px`` with ``refused``: every frame of ``moving`` (stack_id, frame) but the reference gives up the unexplained area."""
    area = unexplained_area(px, points, reach, radius, least).withColumn("_area", F.lit(True))
    d = attach(px, moving.select(STACK, FRAME).distinct().withColumn("_moving", F.lit(True)), [STACK, FRAME], "left")
    d = d.join(area, [STACK, Y, X], "left")
    refused = F.col("_area").isNotNull() & F.col("_moving").isNotNull() & (F.col(FRAME) != reference)
    return d.withColumn("refused", refused).drop("_area", "_moving")


def group_support(guide: DataFrame, members: DataFrame, by: Sequence[str] = (STACK, "group_id"), radius: float = REACH, smooth: int = 24, eps: float = 1e-3, side: int = SIDE) -> DataFrame:
    """Body of every group: the hull of its points and a disc around each, snapped to the structure of ``guide``.

    ``guide`` has one row per pixel (stack_id, y, x, h, w, guide). Points are rounded to pixels. Returns keys, y, x, ``support``.
    """
    p = members.select(*by, F.rint("x").alias("x"), F.rint("y").alias("y"))
    body = near_hulls(guide, gr.hull(p, by), 0.0, by).unionByName(near_points(guide, p, radius, by)).distinct().withColumn("_seed", F.lit(1.0))
    d = attach(guide, p.select(*by).distinct(), [STACK])
    d = d.join(body, [*by, Y, X], "left").withColumn("_seed", F.coalesce("_seed", F.lit(0.0)))
    extra = [c for c in by if c != STACK]
    return fu.guided_filter(d, "guide", "_seed", "support", smooth, eps, by=tuple(extra), side=side).select(*by, Y, X, "support")
