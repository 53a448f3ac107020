"""Projections, predicates and validation on pixel relations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharpfleet.functions.columns import clip, col, luminance, truncate_u8
from sharpfleet.functions.quantiles import exact_quantiles
from sharpfleet.operators import stencil as st
from sharpfleet.operators.grid import BLK, FRAME, SIDE, STACK, X, Y, attach, blocked

MAX_SHIFT_SHARE = 0.015  # licence: largest shift as a share of the image diagonal


def with_gray(px: DataFrame, out: str = "gray") -> DataFrame:
    return px.withColumn(out, luminance())


def stack_status(frames: DataFrame) -> DataFrame:
    """One row per stack: ok or the reason it cannot be fused. ``frames`` has h, w and optionally ``readable``."""
    readable = F.col("readable") if "readable" in frames.columns else F.lit(True)
    g = frames.withColumn("_ok", readable).groupBy(STACK).agg(
        F.count("*").alias("frames"), F.countDistinct(F.struct("h", "w")).alias("shapes"), F.bool_and("_ok").alias("_ok"))
    reason = F.when(~F.col("_ok"), "unreadable frame").when(F.col("shapes") > 1, "frames differ in size").when(
        F.col("frames") < 2, "fewer than two frames")
    return g.select(STACK, "frames", "shapes", F.when(reason.isNull(), "ok").otherwise("refused").alias("status"),
                    F.coalesce(reason, F.lit("")).alias("reason"))


def normalize_map(df: DataFrame, v: str, by=(STACK, FRAME), out: str = "view") -> DataFrame:
    """Scale each image to 0..255; a constant image becomes 0."""
    lim = df.groupBy(*by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    df = attach(df, lim, by)
    scaled = F.floor(F.round((F.col(v) - F.col("_lo")) / span * 255.0, 6)).cast("int")
    return df.withColumn(out, F.when(span < 1e-9, F.lit(0)).otherwise(scaled)).drop("_lo", "_hi")


def selection_index(frame, n) -> Column:
    """Colour index of a winning frame: 255·frame/(n−1), truncated."""
    return F.floor(col(frame) * 255 / F.greatest(F.lit(1), col(n) - 1)).cast("int")


def robust_normalize(df: DataFrame, v: str, by=(STACK,), pct: float = 0.99, out: str = "norm") -> DataFrame:
    top = exact_quantiles(df, by, v, {"_top": pct})
    return attach(df, top, by).withColumn(out, clip(F.col(v) / (F.col("_top") + 1e-6), 0.0, 1.0)).drop("_top")


def _per_pixel(df: DataFrame) -> Window:
    return Window.partitionBy(STACK, *([BLK] if BLK in df.columns else []), Y, X)


def apply_usability(e: DataFrame, usable: str = "usable", value: str = "e") -> DataFrame:
    """Unusable frames get energy −1, unless no frame of the pixel is usable."""
    some = F.bool_or(usable).over(_per_pixel(e))
    return e.withColumn(value, F.when(some & ~F.col(usable), F.lit(-1.0)).otherwise(F.col(value)))


def usability_weights(w: DataFrame, usable: str = "usable", weight: str = "wt") -> DataFrame:
    """Zero the weights of unusable frames and renormalise; a pixel without a usable frame keeps its weights."""
    px = _per_pixel(w)
    some = F.bool_or(usable).over(px)
    w = w.withColumn(weight, F.when(some & ~F.col(usable), F.lit(0.0)).otherwise(F.col(weight)))
    return w.withColumn(weight, F.col(weight) / (F.sum(weight).over(px) + 1e-8))


def decisive(best: DataFrame, floor: float = 0.3) -> DataFrame:
    """Pixels whose dominance exceeds ``floor`` and whose best energy exceeds the stack median."""
    med = exact_quantiles(best, [STACK], "e1", {"_med": 0.5})
    return attach(best, med, [STACK]).withColumn("decisive", (F.col("dominance") > floor) & (F.col("e1") > F.col("_med"))).drop("_med")


def saturated(b="b", g="g", r="r") -> Column:
    return (F.greatest(col(b), col(g), col(r)) >= 254) | (F.least(col(b), col(g), col(r)) <= 1)


def quiet(px: DataFrame, v: str, sigma: Column, k: float = 2.0, minimum: int = 32, by=(FRAME,), side: int = SIDE) -> DataFrame:
    """Mid-band energy |G1 − G3| within k·sigma; images with fewer than ``minimum`` quiet pixels have none."""
    def body(df):
        df = st.gaussian(df, {"_g1": v}, 1.0, by, 4)
        return st.gaussian(df, {"_g3": v}, 3.0, by, 7)
    df = blocked(px, 7, body, side).withColumn("_q", F.abs(F.col("_g1") - F.col("_g3")) <= sigma * k)
    n = df.groupBy(STACK, *by).agg(F.count_if("_q").alias("_n"))
    return attach(df, n, [STACK, *by]).withColumn("quiet", F.col("_q") & (F.col("_n") >= minimum)).drop("_q", "_n", "_g1", "_g3")


def flank(px: DataFrame, v: str = "v", level: float = 170, spread: float = 4.0, k: int = 9, side: int = SIDE) -> DataFrame:
    """Bright ground without texture."""
    df = st.local_std(px, v, k, "_std", side=side)
    return df.withColumn("flank", (F.col(v) > level) & (F.col("_std") < spread)).drop("_std")


def bin_texture(px: DataFrame, mask: Column, v: str = "v", floor: float = 1.0, side: int = SIDE) -> DataFrame:
    """Mean gradient under the mask per image, and whether it is enough to register on."""
    g = st.gradient_magnitude(px, v, "_g", side=side)
    return g.groupBy(STACK, FRAME).agg(F.avg(F.when(mask, F.col("_g"))).alias("gradient")).withColumn(
        "textured", F.coalesce(F.col("gradient") >= floor, F.lit(False)))


def shift_licence(shifts: DataFrame, h="h", w="w", shift: str = "shift") -> DataFrame:
    """Whether the largest shift of a stack stays within its share of the diagonal."""
    limit = F.lit(MAX_SHIFT_SHARE) * F.sqrt((col(h) * col(h) + col(w) * col(w)).cast("double"))
    out = shifts.groupBy(STACK).agg(F.max(F.abs(shift)).alias("largest"), F.max(limit).alias("limit"))
    return out.withColumn("licensed", F.col("largest") <= F.col("limit"))


def candidate_licensed(score="score", purity="purity", area_fit="area_fit", before="before", after="after") -> Column:
    cols = [col(c).cast("double") for c in (score, purity, area_fit, before, after)]
    finite = F.lit(True)
    for c in cols:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    s, p, a, b, f = cols
    return finite & (s > 0.5) & (p > 0.85) & (a > 0.9) & (f / F.greatest(b, F.lit(1e-6)) < 0.85)


# Stratum -> (lowest core share, upper bound, counted pixels, minimum count)
STRATA = {
    "primary": (0.75, None, "core_pixels", 5000), "boundary": (0.25, 0.60, "core_pixels", 1500),
    "all_veil": (None, 0.15, "inner_veil_pixels", 2500), "solid": (0.55, None, "core_pixels", 2500),
    "mixed": (0.15, 0.55, "core_pixels", 800), "thin": (None, 0.15, "inner_veil_pixels", 2500),
}


def stratum_matches(stratum, core="core_fraction", scale: float = 1.0) -> Column:
    """Whether a scene's statistics fit its stratum; ``scale`` adapts the pixel minima to other image sizes."""
    out = None
    for name, (lo, hi, count, least) in STRATA.items():
        ok = F.col(count) >= least * scale
        if lo is not None:
            ok = ok & (col(core) >= lo)
        if hi is not None:
            ok = ok & (col(core) < hi)
        out = F.when(col(stratum) == name, ok) if out is None else out.when(col(stratum) == name, ok)
    return out


def coverage_class(alpha, coverage) -> Column:
    a, c = col(alpha), col(coverage)
    return (F.when((a >= 0.95) & (c >= 0.95), "core").when((a >= 0.95) & (c > 0.05) & (c < 0.95), "inner_veil")
            .when((a < 0.05) & (c > 0.05), "outer_veil").otherwise("none"))


def composite_route(method, frames, overridden) -> tuple[Column, Column]:
    """Whether a stack goes to the two-frame composite, and why."""
    m, n, o = col(method), col(frames), F.coalesce(col(overridden), F.lit(0))
    reason = (F.when(m != "perband", "method does not fuse per band").when(n < 3, "fewer than three frames")
              .when(o < 1, "no motion group was overridden").otherwise("stranded object"))
    return (m == "perband") & (n >= 3) & (o >= 1), reason


def agreement_budget(g1, g2, v1, v2, tol: float, gain: float = 0.02, noise: float = 1.0) -> Column:
    """Allowed disagreement in levels: position tolerance × gradient, a share of the level, and noise."""
    return F.lit(tol) * F.greatest(col(g1), col(g2)) + F.lit(gain) * F.greatest(col(v1), col(v2)) + F.lit(noise)


def blur_radius(peak, frame, rate: float) -> Column:
    return F.lit(rate) * F.abs(col(frame) - col(peak))
