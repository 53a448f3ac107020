"""Fusion of all frames of every stack into one all-sharp image per stack."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharpfleet.functions.columns import clip, col, dominance, first_max, truncate_u8
from sharpfleet.operators import evidence as ev
from sharpfleet.operators import focus as fo
from sharpfleet.operators import pyramid as py
from sharpfleet.operators import stencil as st
from sharpfleet.runtime import shared
from sharpfleet.operators.grid import BLK, FRAME, SIDE, STACK, X, Y, attach, blocked, keys

RGB = ("b", "g", "r")
INSTABILITY = 0.115  # fixed value: share of unstable pixels above which one decision serves all bands


def select_winner(px: DataFrame, score: str, cols: Sequence[str] = RGB, by=(STACK, Y, X)) -> DataFrame:
    """The columns of the best-scoring frame per pixel, as one partial and final aggregate."""
    by = [*by, *([BLK] if BLK in px.columns else [])]
    best = px.groupBy(*by).agg(F.max_by(F.struct(FRAME, *cols), first_max(score, FRAME)).alias("_w"))
    return best.select(*by, F.col(f"_w.{FRAME}").alias("winner"), *[F.col(f"_w.{c}").alias(c) for c in cols])


def fuse_max(px: DataFrame, method: str = "laplacian", k: int = 9, cols: Sequence[str] = RGB, side: int = SIDE) -> DataFrame:
    """Every pixel from its sharpest frame, and that frame's index."""
    def body(df):
        return fo.energy(df, method, "gray", k, "_e")
    halo = 1 + k // 2 if method != "content_aware" else 4 + k // 2
    if BLK in px.columns:
        return select_winner(body(px), "_e", cols)
    return blocked(ev.with_gray(px), halo, lambda df: select_winner(body(df), "_e", cols), side)


def fuse_pyramid(px: DataFrame, levels: int | None = None, k: int = 7, depth: int | None = None, side: int = SIDE) -> DataFrame:
    """Strongest coefficient per band and pixel, all channels from one frame; mean of the base band."""
    p = py.pyramid(px, RGB, (), levels, side=side, depth=depth)
    def body(df):
        df = st.box(df, {"_e": sum(F.col(c) * F.col(c) for c in RGB)}, k // 2, (FRAME, "level"), mean=False)
        return df.groupBy(STACK, BLK, "levels", "level", Y, X, "h", "w").agg(
            F.max_by(F.struct(*RGB), first_max("_e", FRAME)).alias("_w"), *[F.avg(c).alias(f"_{c}") for c in RGB])
    bands = blocked(p, k // 2, body, side)
    base = F.col("level") == F.col("levels")
    bands = bands.select(STACK, "levels", "level", Y, X, "h", "w", *[F.when(base, F.col(f"_{c}")).otherwise(F.col(f"_w.{c}")).alias(c) for c in RGB])
    return _image(py.collapse(bands, RGB, side=side, depth=py.planned(levels, depth)))


def _image(df: DataFrame) -> DataFrame:
    return df.select(STACK, Y, X, *[truncate_u8(c).alias(c) for c in RGB])


def guided_filter(df: DataFrame, guide: Column | str, src: Column | str, out: str, r: int = 8,
                  eps: float | Column = 1e-3, by=(FRAME,), side: int = SIDE) -> DataFrame:
    """Edge-preserving smoothing: local linear fit of ``src`` on ``guide`` in (2r+1)² windows, fits averaged."""
    def body(d):
        d = d.withColumns({"_gi": col(guide), "_gp": col(src), "_ge": F.lit(eps) if isinstance(eps, float) else eps})
        d = st.box(d, {"_mi": "_gi", "_mp": "_gp", "_mii": F.col("_gi") * F.col("_gi"), "_mip": F.col("_gi") * F.col("_gp")}, r, by)
        return _guided_tail(d, lambda x, o: st.box(x, o, r, by), out)
    return blocked(df, 2 * r, body, side)


def _guided_tail(d: DataFrame, smooth, out: str) -> DataFrame:
    a = (F.col("_mip") - F.col("_mi") * F.col("_mp")) / (F.col("_mii") - F.col("_mi") * F.col("_mi") + F.col("_ge"))
    d = d.withColumn("_ga", a).withColumn("_gb", F.col("_mp") - F.col("_ga") * F.col("_mi"))
    d = smooth(d, {"_ga": "_ga", "_gb": "_gb"})
    return d.withColumn(out, F.col("_ga") * F.col("_gi") + F.col("_gb")).drop("_gi", "_gp", "_ge", "_mi", "_mp", "_mii", "_mip", "_ga", "_gb")


def _contest(df: DataFrame, e: str, extra: Sequence[str] = ()) -> DataFrame:
    """Adds ``_win`` (index of the best frame) and ``_dom`` (dominance) to every row of a pixel."""
    w = Window.partitionBy(*keys(*extra), Y, X).orderBy(F.desc(e), F.asc(FRAME)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"_win": F.first(FRAME).over(w), "_e1": F.first(e).over(w), "_e2": F.nth_value(e, 2).over(w)})
    return df.withColumn("_dom", F.coalesce(dominance("_e1", "_e2"), F.lit(0.0))).drop("_e1", "_e2")


def adaptive_radius(side_px: int) -> tuple[int, int]:
    """Guided radius and pooling window for the longer image side: 1.2 % of it, at least 8 and 9."""
    auto = int(round(0.012 * side_px))
    return max(8, auto), max(9, auto | 1)


def guided_weights(px: DataFrame, method: str = "content_aware", radius: int = 8, eps: float = 1e-3, k: int = 9,
                   harden: float = 0.5, usable: str | None = None, out: str = "wt", side: int = SIDE,
                   scale: int = 1) -> DataFrame:
    """Edge-aware weights per frame that sum to 1 at every pixel.

    Energy, contest, one-hot, guided filter along each frame's own luminance, then a mix back towards the
    one-hot where one frame dominates. ``scale`` runs the guided step on the image reduced by that
    factor. Input has b, g, r (or a column gray).
    """
    px = px if "gray" in px.columns else ev.with_gray(px)

    def decide(df):
        df = fo.energy(df, method, "gray", k, "_e")
        if usable:
            df = ev.apply_usability(df, usable, "_e")
        df = _contest(df, "_e").withColumn("_raw", (F.col("_win") == F.col(FRAME)).cast("double"))
        if harden > 0:
            df = st.box(df, {"_conf": "_dom"}, 7)
            df = df.withColumn("_conf", clip(F.col("_conf") * harden, 0.0, 1.0))
        else:
            df = df.withColumn("_conf", F.lit(0.0))
        return df.drop("_e", "_win", "_dom")

    def finish(df):
        mixed = (1 - F.col("_conf")) * F.greatest(F.col("_wg"), F.lit(0.0)) + F.col("_conf") * F.col("_raw")
        df = df.withColumn(out, mixed).drop("_wg", "_conf", "_raw")
        if usable:
            df = ev.usability_weights(df, usable, out)
        pixel = Window.partitionBy(STACK, *([BLK] if BLK in df.columns else []), Y, X)
        return df.withColumn(out, F.col(out) / (F.sum(out).over(pixel) + 1e-8))
    guide = F.col("gray") / 255.0
    head = 4 + k // 2 + 7
    if scale == 1:
        return blocked(px, head + 2 * radius, lambda d: finish(guided_filter(decide(d), guide, "_raw", "_wg", radius, eps)), side)
    from sharpfleet.operators import resample as rs
    full = blocked(px, head, decide, side)
    small = rs.area_down(full.withColumn("_guide", guide), ["_guide", "_raw"], scale)
    small = guided_filter(small, "_guide", "_raw", "_wg", radius, eps, side=side).select(STACK, FRAME, Y, X, "h", "w", "_wg")
    return finish(full.join(rs.bilinear_up(small, ["_wg"], scale, side=side), [STACK, FRAME, Y, X]))


def fuse_decision(px: DataFrame, side: int = SIDE, **kw) -> DataFrame:
    """Weighted mean of the frames under guided weights."""
    w = guided_weights(px, side=side, **kw)
    sums = w.groupBy(STACK, Y, X).agg(*[F.sum(F.col("wt") * F.col(c)).alias(c) for c in RGB])
    return _image(sums)


def multiband_blend(px: DataFrame, weight: str = "wt", levels: int | None = None, depth: int | None = None,
                    by=(FRAME,), side: int = SIDE) -> DataFrame:
    """Laplacian bands mixed with the weights blurred to each band's scale, renormalised per band."""
    p = py.pyramid(px.select(STACK, *by, Y, X, "h", "w", *RGB, weight), RGB, [weight], levels, by=by, side=side, depth=depth)
    bands = p.groupBy(STACK, "levels", "level", Y, X, "h", "w").agg(
        *[(F.sum(F.col(weight) * F.col(c)) / (F.sum(weight) + 1e-8)).alias(c) for c in RGB])
    return _image(py.collapse(bands, RGB, side=side, depth=py.planned(levels, depth)))


def fuse_blend(px: DataFrame, levels: int | None = None, depth: int | None = None, side: int = SIDE, **kw) -> DataFrame:
    return multiband_blend(guided_weights(px, side=side, **kw), "wt", levels, depth, side=side)


def coherent_weights(px: DataFrame, side: int = SIDE, **kw) -> DataFrame:
    """Guided weights hardened to one frame per pixel."""
    w = guided_weights(px, side=side, **kw)
    best = F.max(first_max("wt", FRAME)).over(Window.partitionBy(STACK, Y, X))
    return w.withColumn("wt", (first_max("wt", FRAME) == best).cast("double"))


def fuse_coherent(px: DataFrame, levels: int | None = None, depth: int | None = None, side: int = SIDE, **kw) -> DataFrame:
    return multiband_blend(coherent_weights(px, side, **kw), "wt", levels, depth, side=side)


def perband_weights(p: DataFrame, radius: int = 6, eps: float = 1e-3, k: int = 7, harden: float = 0.5,
                    usable: str | None = None, boundary: str | None = None, b_mix: float = 0.5, b_gain: float = 4.0,
                    side: int = SIDE) -> DataFrame:
    """Weights of every detail band of a pyramid relation with b, g, r bands and low-pass gray.

    Windows shrink with the band: guided radius min(radius, side/6), energy window min(k, side/4 made odd).
    """
    small = F.least("h", "w")
    r_band = F.greatest(F.lit(1), F.least(F.lit(radius), F.floor(small / 6).cast("int")))
    k_band = F.greatest(F.lit(3), F.least(F.lit(k), F.floor(small / 4).cast("int").bitwiseOR(F.lit(1))))
    by = (FRAME, "level")
    d = p.filter("level < levels")
    guide, soft = F.col("gray") / 255.0, F.lit(eps)
    if boundary:
        top = d.groupBy(STACK, "level").agg(F.max(boundary).alias("_bmax"))
        d = attach(d, top, [STACK, "level"]).withColumn("_bd", F.col(boundary) / (F.col("_bmax") + 1e-6)).drop("_bmax")
        guide = (1 - b_mix) * guide + b_mix * F.col("_bd")
        soft = eps * (1 + b_gain * (1 - F.least(F.lit(1.0), 3 * F.col("_bd"))))

    def body(df):
        df = st.box_by(df, {"_e": sum(F.col(c) * F.col(c) for c in RGB)}, F.floor(k_band / 2).cast("int"), k // 2, by)
        if usable:
            df = df.withColumn("_ok", F.col(usable) > 0.5)
            some = F.bool_or("_ok").over(Window.partitionBy(*keys("level"), Y, X))
            df = df.withColumn("_e", F.when(some & ~F.col("_ok"), F.lit(-1.0)).otherwise(F.col("_e")))
        df = _contest(df, "_e", ("level",))
        df = df.withColumns({"_raw": (F.col("_win") == F.col(FRAME)).cast("double"), "_conf": clip("_dom", 0.0, 1.0) if harden > 0 else F.lit(0.0)})
        df = df.withColumns({"_gi": guide, "_gp": F.col("_raw"), "_ge": soft})
        df = st.box_by(df, {"_mi": "_gi", "_mp": "_gp", "_mii": F.col("_gi") * F.col("_gi"), "_mip": F.col("_gi") * F.col("_gp")}, r_band, radius, by)
        df = _guided_tail(df, lambda x, o: st.box_by(x, o, r_band, radius, by), "_wg")
        wt = (1 - F.col("_conf")) * F.greatest(F.col("_wg"), F.lit(0.0)) + F.col("_conf") * F.col("_raw")
        pixel = Window.partitionBy(*keys("level"), Y, X)
        df = df.withColumn("wt", wt)
        if usable:
            some = F.bool_or("_ok").over(pixel)
            df = df.withColumn("wt", F.when(some & ~F.col("_ok"), F.lit(0.0)).otherwise(F.col("wt")))
            df = df.withColumn("wt", F.col("wt") / (F.sum("wt").over(pixel) + 1e-8)).drop("_ok")
        df = df.withColumn("wt", F.col("wt") / (F.sum("wt").over(pixel) + 1e-8))
        return df.drop("_e", "_win", "_dom", "_raw", "_conf", "_wg", "_bd")
    return blocked(d, k // 2 + 2 * radius, body, side)


def fuse_perband(px: DataFrame, levels: int | None = None, depth: int | None = None, usable: str | None = None,
                 boundary: str | None = None, side: int = SIDE, **kw) -> DataFrame:
    """A decision per band with edge-aware weights; the base takes the coarsest weights, halved."""
    px = px if "gray" in px.columns else ev.with_gray(px)
    lows = ["gray"] + [c for c in (usable, boundary) if c]
    if usable:
        px = px.withColumn(usable, F.col(usable).cast("double"))
    p = py.pyramid(px.select(STACK, FRAME, Y, X, "h", "w", *RGB, *lows), RGB, lows, levels, side=side, depth=depth)
    w = shared(perband_weights(p, usable=usable, boundary=boundary, side=side, **kw))
    mix = lambda df: df.groupBy(STACK, "levels", "level", Y, X, "h", "w").agg(*[F.sum(F.col("wt") * F.col(c)).alias(c) for c in RGB])
    last = w.filter("level = levels - 1").select(STACK, FRAME, Y, X, "h", "w", "wt")
    low = py.pyr_down(last, ["wt"], side=side).select(STACK, FRAME, Y, X, F.greatest("wt", F.lit(0.0)).alias("wt"))
    base = p.filter("level = levels").join(low, [STACK, FRAME, Y, X])
    total = Window.partitionBy(STACK, Y, X)
    base = base.withColumn("wt", F.col("wt") / (F.sum("wt").over(total) + 1e-8))
    return _image(py.collapse(mix(w).unionByName(mix(base)), RGB, side=side, depth=py.planned(levels, depth)))


def instability(px: DataFrame, v: str = "gray", neighbourhood: int = 5, ceiling: float = 0.25, floor: float = 0.5,
                k: int = 9, side: int = SIDE) -> DataFrame:
    """Share of pixels whose winner is both isolated and weak."""
    if neighbourhood < 3 or neighbourhood % 2 == 0:
        raise ValueError("neighbourhood must be odd and at least 3")
    r = neighbourhood // 2

    def body(df):
        df = _contest(fo.content_aware(df, v, 8.0, k, "_e"), "_e")
        df = st.box(df, {"_share": (F.col("_win") == F.col(FRAME)).cast("int")}, r, mean=False)
        return df.filter(F.col("_win") == F.col(FRAME))
    one = blocked(px, 4 + k // 2 + r, body, side)
    bad = (F.col("_share") < floor * neighbourhood ** 2) & (clip("_dom", 0.0, 1.0) < ceiling)
    return one.groupBy(STACK).agg(F.avg(bad.cast("double")).alias("score"))


def consistency_route(px: DataFrame, v: str = "gray", threshold: float = INSTABILITY, **kw) -> DataFrame:
    """Whether the frames of a stack share one decision: from the threshold on, never with fewer than three frames."""
    n = px.groupBy(STACK).agg(F.countDistinct(FRAME).alias("_n"))
    score = instability(px, v, **kw).join(n, STACK)
    return score.select(STACK, "score", ((F.col("_n") >= 3) & (F.col("score") >= threshold)).alias("coherent"))


def fuse_routed(px: DataFrame, depth: int | None = None, threshold: float = INSTABILITY, coherent: dict | None = None,
                perband: dict | None = None, side: int = SIDE) -> DataFrame:
    """Unstable stacks share one decision over all bands, the others decide per band."""
    px = ev.with_gray(px)
    routed = attach(px, consistency_route(px, threshold=threshold, side=side).select(STACK, "coherent"), [STACK])
    a = fuse_coherent(routed.filter("coherent"), depth=depth, side=side, **(coherent or {}))
    b = fuse_perband(routed.filter("NOT coherent"), depth=depth, side=side, **(perband or {}))
    return a.withColumn("coherent", F.lit(True)).unionByName(b.withColumn("coherent", F.lit(False)))


def depth_from_focus(px: DataFrame, v: str = "gray", method: str = "content_aware", k: int = 9, radius: int = 8,
                     eps: float = 1e-3, side: int = SIDE) -> DataFrame:
    """Depth in 0..1: winning frame over the last frame, smoothed along the edges of the sharpest luminance."""
    n = px.groupBy(STACK).agg((F.countDistinct(FRAME) - 1).alias("_last"))

    def body(df):
        df = _contest(fo.energy(df, method, v, k, "_e"), "_e").filter(F.col("_win") == F.col(FRAME))
        df = df.withColumn("_raw", F.col("_win") / F.greatest(F.lit(1), F.col("_last")))
        df = guided_filter(df, F.col(v) / 255.0, "_raw", "depth", radius, eps, by=())
        return df.withColumn("depth", clip("depth", 0.0, 1.0)).drop("_e", "_win", "_dom", "_raw")
    out = blocked(attach(px, n, [STACK]), 4 + k // 2 + 2 * radius, body, side)
    return out.select(STACK, Y, X, "h", "w", "depth")


def fuse_adaptive(candidates: DataFrame, quality: DataFrame, radius: int = 8, eps: float = 1e-3, levels: int | None = None,
                  depth: int | None = None, side: int = SIDE) -> DataFrame:
    """Per-pixel choice between candidate images by a quality map, smoothed and blended over bands.

    ``candidates``: stack_id, preset, y, x, h, w, b, g, r; ``quality``: stack_id, preset, y, x, q.
    """
    c = ev.with_gray(candidates).join(quality.select(STACK, "preset", Y, X, "q"), [STACK, "preset", Y, X])
    c = c.withColumnRenamed("preset", FRAME)

    def body(df):
        df = _contest(df, "q").withColumn("_raw", (F.col("_win") == F.col(FRAME)).cast("double"))
        df = guided_filter(df, F.col("gray") / 255.0, "_raw", "wt", radius, eps)
        df = df.withColumn("wt", F.greatest("wt", F.lit(0.0)))
        return df.withColumn("wt", F.col("wt") / (F.sum("wt").over(Window.partitionBy(*keys(), Y, X)) + 1e-8))
    return multiband_blend(blocked(c, 2 * radius, body, side), "wt", levels, depth, side=side)
