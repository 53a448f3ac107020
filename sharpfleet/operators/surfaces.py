"""Whether two observations show one surface: common blur, agreement, layer states."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharpfleet.functions.columns import clip, first_max
from sharpfleet.functions.quantiles import exact_quantiles
from sharpfleet.operators import evidence as ev
from sharpfleet.operators import resample as rs
from sharpfleet.operators import stencil as st
from sharpfleet.operators.grid import FRAME, SIDE, STACK, X, Y, attach, blocked, keys
from sharpfleet.runtime import shared



def match_blur(px: DataFrame, a: str, b: str, radius_a: Column, radius_b: Column, rmax: int, sigma: float = 0.0,
               by: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """Each observation blurred by the other's disk, then both by a small Gaussian: columns <a>_low, <b>_low."""
    r = 0 if sigma <= 0 else max(1, int(round(sigma * 4)))

    def body(d):
        d = st.spatial_blur(d, a, F.greatest(radius_b, F.lit(0.0)), rmax, f"{a}_low", by)
        d = st.spatial_blur(d, b, F.greatest(radius_a, F.lit(0.0)), rmax, f"{b}_low", by)
        return st.gaussian(d, {f"{a}_low": f"{a}_low", f"{b}_low": f"{b}_low"}, sigma, by, r) if sigma > 0 else d
    return blocked(px, rmax + r, body, side)


def agreement(px: DataFrame, a: str, b: str, radius_a: Column, radius_b: Column, rmax: int, tol: float = 1.5, pool: int = 9,
              sigma: float = 0.0, by: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """Per pixel: within budget at common blur (``agree``), everywhere in the pool (``unanimous``), in half of it (``majority``)."""
    half = pool // 2

    def body(d):
        d = match_blur(d, a, b, radius_a, radius_b, rmax, sigma, by)
        la, lb = f"{a}_low", f"{b}_low"
        d = st.gradient_magnitude(d, la, "_g1", scale=8.0, by=by)
        d = st.gradient_magnitude(d, lb, "_g2", scale=8.0, by=by)
        over = F.abs(F.col(la) - F.col(lb)) - ev.agreement_budget("_g1", "_g2", la, lb, tol)
        ok = F.round(over, 9) <= 0  # a difference of exactly the budget agrees, in whatever order its means were summed
        d = st.fringe(d.withColumn("agree", ok.cast("int")), half, by, agree=None)  # the pool is a square, also around missing pixels
        d = st.extreme(d, {"_all": "agree"}, half, "erode", by)
        d = st.box(d, {"_some": "agree"}, half, by, mean=False)
        return st.unfringe(d).withColumns({"unanimous": F.col("_all") == 1, "majority": F.col("_some") * 2 >= pool * pool}).drop("_g1", "_g2", "_all", "_some")
    return blocked(px, rmax + (int(round(sigma * 4)) if sigma > 0 else 0) + 1 + half, body, side)


def contest(pairs: DataFrame) -> DataFrame:
    """Pixels where most of the compared mirror pairs disagree; ``pairs``: stack_id, y, x, agree (one row per pair)."""
    g = pairs.groupBy(STACK, Y, X).agg(F.count("*").alias("pairs"), F.count_if(~F.col("agree")).alias("against"))
    return g.withColumn("contested", F.col("against") * 2 > F.col("pairs"))


def tile_votes(tiles: DataFrame, px: DataFrame, tile: int, stride: int, by: str = "place", side: int = SIDE) -> DataFrame:
    """Pixel ownership: weights of the overlapping tiles per kept pair, smoothed, largest wins (lowest place on ties)."""
    from sharpfleet.functions.columns import first_max
    from sharpfleet.operators.ownership import tile_ids
    p = px.withColumn("ty", F.explode(tile_ids("h", Y, tile, stride))).withColumn("tx", F.explode(tile_ids("w", X, tile, stride)))
    votes = p.join(tiles.select(STACK, "ty", "tx", by, "weight"), [STACK, "ty", "tx"]).groupBy(STACK, by, Y, X).agg(F.sum(F.col("weight") + 1e-3).alias("vote"))
    places = tiles.select(STACK, by).distinct()
    full = px.select(STACK, Y, X, "h", "w").join(places, STACK).join(votes, [STACK, by, Y, X], "left").withColumn("vote", F.coalesce("vote", F.lit(0.0)))
    s = st.gaussian(full, {"vote": "vote"}, stride / 2.0, (by,), side=side)
    return s.groupBy(STACK, Y, X).agg(F.max_by(by, F.struct(F.round("vote", 6), -F.col(by))).alias("owner"))


def trinary(labels: DataFrame, label: str, band: int = 1, by: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """OWNED, BOUNDARY (within ``band`` of another label) or UNKNOWN (no label)."""
    def body(d):
        d = d.withColumn("_lab", F.coalesce(label, F.lit(-1)))
        d = st.label_boundary(d, "_lab", "_edge", by)
        d = st.extreme(d, {"_near": F.col("_edge").cast("int")}, band, "dilate", by)
        state = F.when(F.col(label).isNull(), "UNKNOWN").when(F.col("_near") > 0, "BOUNDARY").otherwise("OWNED")
        return d.withColumn("state", state).drop("_lab", "_edge", "_near")
    return blocked(labels, band + 1, body, side)


def layer_extents(labels: DataFrame, label: str, radius: int, by: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """Pixels each layer may cover: its own area and that of every nearer layer; unknown pixels follow the nearest layer.

    Layers are numbered from near (0) to far; a pixel belongs to the extents of all layers from its own to the farthest.
    """
    d = labels.withColumn("_known", F.col(label).isNotNull())
    d = rs.nearest_set(d, "_known", radius, [label], by, side)
    d = d.withColumn("_own", F.coalesce(label, f"near_{label}")).filter("_own IS NOT NULL")
    top = labels.groupBy(STACK).agg(F.max(label).alias("_top"))
    j = attach(d.select(STACK, *by, Y, X, "_own"), top, [STACK])
    return j.select(STACK, *by, Y, X, F.explode(F.sequence("_own", "_top")).alias("layer"))


def ordering_bit(contours: DataFrame, near: str = "low_is_near", least: int = 3, margin: float = 0.2) -> DataFrame:
    """One bit per stack from contour votes; stacks with few or divided votes have none."""
    g = contours.groupBy(STACK).agg(F.count("*").alias("votes"), F.avg(F.col(near).cast("double")).alias("share"))
    return g.filter((F.col("votes") >= least) & (F.abs(F.col("share") - 0.5) >= margin / 2)).withColumn("low_is_near", F.col("share") > 0.5)


def occlusion_clause(pieces: DataFrame, silhouettes: DataFrame, rank: str = "rank") -> DataFrame:
    """Pixels of a farther piece covered by the pushed silhouette of a nearer one.

    ``pieces``: stack, frame, y, x, rank; ``silhouettes``: stack, frame, y, x, rank of every moved and widened piece.
    Only the nearest silhouette of a pixel decides, so one row per pixel is joined.
    """
    front = silhouettes.groupBy(STACK, FRAME, Y, X).agg(F.min(rank).alias("_front"))
    j = pieces.join(front, [STACK, FRAME, Y, X], "left")
    return j.withColumn("refused", F.coalesce(F.col("_front") < F.col(rank), F.lit(False))).drop("_front")


def stack_boundary(px: DataFrame, gray: str = "gray", sigmas: Sequence[float] = (0.0, 2.0, 4.0), k: int = 9, side: int = SIDE) -> DataFrame:
    """Soft boundary map: gradients at several scales (largest over frames), density of winner changes, depth gradient.

    One pass over all frames leaves a row per pixel, a second one over these rows has the rest; all percentiles are found at once.
    A pixel that has no row in frame 0 gets no value and takes no part in the density.
    """
    from sharpfleet.operators import focus as fo
    from sharpfleet.operators import fusion as fu
    blurred = {f"_s{i}": s for i, s in enumerate(sigmas) if s > 0}
    reach = max([1] + [(int(round(s * 8 + 1)) | 1) // 2 + 1 for s in blurred.values()])
    edges = [f"_g{i}" for i in range(len(sigmas))]
    radius, smooth = 8, 4

    def over_frames(d):
        d = st.blurs_and_std(d, gray, blurred, 7, "_std")
        wants: dict = {n: {} for n in (gray, *blurred)}
        for i in range(len(sigmas)):
            wants[f"_s{i}" if f"_s{i}" in blurred else gray] |= {f"_x{i}": "gx", f"_y{i}": "gy"}
        wants[gray] |= {n: n for n in ("lap3", "dxx", "dyy")}
        d = st.derivatives_of(d, wants).drop(*blurred)
        size = lambda i: F.sqrt((F.col(f"_x{i}") * F.col(f"_x{i}") + F.col(f"_y{i}") * F.col(f"_y{i}")).cast("double"))
        d = d.withColumns({n: size(i) for i, n in enumerate(edges)}).drop(*[f"_{c}{i}" for c in "xy" for i in range(len(sigmas))])
        best = F.max_by(F.struct(FRAME, gray), first_max("_e", FRAME)).alias("_w")
        d = fo.content_mix(d, 8.0, k, "_e").groupBy(*keys(Y, X), "h", "w").agg(
            best, *[F.max(n).alias(n) for n in edges], F.bool_or(F.col(FRAME) == 0).alias("_shown"))
        return d.select("*", F.col(f"_w.{FRAME}").alias("_win"), F.col(f"_w.{gray}").alias("_guide")).drop("_w")
    p = blocked(px.select(STACK, FRAME, Y, X, "h", "w", gray), max(reach, 4 + k // 2), over_frames, side)
    n = px.groupBy(STACK).agg((F.countDistinct(FRAME) - 1).alias("_last"))

    def over_winners(d):
        d = st.gradient_magnitude(d.withColumn("_c", F.col("_win").cast("double")), "_c", "_c", by=("_shown",))
        d = st.box(d, {"_c": (F.col("_c") > 0).cast("double")}, smooth, ("_shown",))
        d = d.withColumn("_raw", F.col("_win") / F.greatest(F.lit(1), F.col("_last")))
        d = fu.guided_filter(d, F.col("_guide") / 255.0, "_raw", "_z", radius, 1e-3, by=())
        return st.gradient_magnitude(d.withColumn("_z", clip("_z", 0.0, 1.0)), "_z", "_z", by=())
    p = blocked(attach(p, n, [STACK]), max(1 + smooth, 1 + 2 * radius), over_winners, side)
    p = shared(p.select(STACK, Y, X, "_shown", *edges, F.when(F.col("_shown"), F.col("_c")).alias("_c"), "_z"))
    parts = [*edges, "_c", "_z"]
    long = p.select(STACK, F.explode(F.array(*[F.struct(F.lit(i).alias("_of"), F.col(c).alias("_is")) for i, c in enumerate(parts)])).alias("_p")).select(STACK, "_p.*")
    tops = exact_quantiles(long, [STACK, "_of"], "_is", {"_top": 0.99}).groupBy(STACK).agg(
        *[F.max(F.when(F.col("_of") == i, F.col("_top"))).alias(f"_top{c}") for i, c in enumerate(parts)])
    norm = {c: clip(F.col(c) / (F.col(f"_top{c}") + 1e-6), 0.0, 1.0) for c in parts}
    strongest = F.greatest(*[norm[n] for n in edges]) if len(edges) > 1 else norm[edges[0]]
    out = attach(p.filter("_shown"), tops, [STACK])
    return out.select(STACK, Y, X, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * strongest + 0.25 * norm["_c"] + 0.4 * norm["_z"])).alias("boundary"))
