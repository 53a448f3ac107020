"""Per-pixel sharpness and what follows from it directly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharpfleet.functions.columns import clip, dominance, first_max, parabola
from sharpfleet.functions.quantiles import exact_quantiles
from sharpfleet.operators import stencil as st
from sharpfleet.operators.grid import BLK, FRAME, SIDE, STACK, X, Y, attach, blocked
from sharpfleet.runtime import cut, shared

PIXEL = [STACK, Y, X]
METHODS = ("laplacian", "gradient", "tenengrad", "mod_laplacian")


def response(method: str) -> tuple[tuple[str, ...], Column]:
    """Needed derivatives and the unpooled response of a method."""
    sq = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")
    return {
        "laplacian": (("lap3",), F.abs("lap3")),
        "gradient": (("gx", "gy"), F.sqrt(sq.cast("double"))),
        "tenengrad": (("gx", "gy"), sq),
        "mod_laplacian": (("dxx", "dyy"), F.abs("dxx") + F.abs("dyy")),
    }[method]


def focus_measure(px: DataFrame, method: str = "laplacian", v: str = "v", k: int = 9, out: str = "e",
                  side: int = SIDE) -> DataFrame:
    """Focus energy of every pixel of every frame of every stack, pooled by a k×k mean."""
    want, expr = response(method)

    def body(df):
        df = st.derivatives(df, v, want).withColumn(out, expr.cast("double")).drop(*want)
        return st.box(df, {out: out}, k // 2) if k > 1 else df
    return blocked(px, 1 + (k // 2 if k > 1 else 0), body, side)


def content_aware(px: DataFrame, v: str = "v", tau: float = 8.0, k: int = 9, out: str = "e", side: int = SIDE) -> DataFrame:
    """Laplacian on textured ground, modified Laplacian on smooth ground, mixed by the best local contrast over frames."""
    def body(df):
        return content_mix(st.derivatives(st.local_std(df, v, 7, "_std"), v, ("lap3", "dxx", "dyy")), tau, k, out)
    return blocked(px, 4 + (k // 2 if k > 1 else 0), body, side)


def content_mix(df: DataFrame, tau: float, k: int, out: str) -> DataFrame:
    """The mix inside a block, from the columns ``_std``, ``lap3``, ``dxx`` and ``dyy``, which it drops."""
    best = F.max("_std").over(Window.partitionBy(*([STACK, BLK, Y, X])))
    df = df.withColumn("_mix", 1 - F.exp(-best / F.lit(tau)))
    flat = F.abs("dxx") + F.abs("dyy")
    df = df.withColumn(out, (1 - F.col("_mix")) * flat + F.col("_mix") * F.abs("lap3"))
    df = df.drop("_std", "_mix", "lap3", "dxx", "dyy")
    return st.box(df, {out: out}, k // 2) if k > 1 else df


def energy(px: DataFrame, method: str, v: str = "v", k: int = 9, out: str = "e", side: int = SIDE) -> DataFrame:
    return content_aware(px, v, 8.0, k, out, side) if method == "content_aware" else focus_measure(px, method, v, k, out, side)


def winner(e: DataFrame, value: str = "e", by=(STACK, Y, X)) -> DataFrame:
    """Frame with the largest value per pixel, lowest frame on ties."""
    by = [*by, *([BLK] if BLK in e.columns and BLK not in by else [])]
    return e.groupBy(*by).agg(F.max_by(FRAME, first_max(value, FRAME)).alias("winner"))


def best_two(e: DataFrame, value: str = "e", by=(STACK, Y, X)) -> DataFrame:
    """Winner, best and second-best value per pixel, and the dominance of the best."""
    by = [*by, *([BLK] if BLK in e.columns and BLK not in by else [])]
    w = Window.partitionBy(*by).orderBy(F.desc(value), F.asc(FRAME))
    top = e.withColumn("_rank", F.row_number().over(w)).filter("_rank <= 2")
    pick = lambda k, c: F.max(F.when(F.col("_rank") == k, F.col(c)))
    out = top.groupBy(*by).agg(pick(1, FRAME).alias("winner"), pick(1, value).alias("e1"), pick(2, value).alias("e2"))
    return out.withColumn("dominance", dominance("e1", "e2"))


def focal_field(e: DataFrame, value: str = "e") -> DataFrame:
    """Sub-frame focal peak by a parabola over the frame axis (ends use themselves), and focus contrast."""
    px = [*PIXEL, *([BLK] if BLK in e.columns else [])]
    w = Window.partitionBy(*px).orderBy(FRAME)
    df = e.withColumns({
        "_a": F.coalesce(F.lag(value).over(w), F.col(value)), "_c": F.coalesce(F.lead(value).over(w), F.col(value)),
    })
    out = df.groupBy(*px).agg(
        F.max_by(F.struct(FRAME, "_a", value, "_c"), first_max(value, FRAME)).alias("_p"),
        (F.max(value) - F.min(value)).alias("contrast"), F.max(FRAME).alias("_last"))
    peak = F.col(f"_p.{FRAME}") + parabola("_p._a", f"_p.{value}", "_p._c")
    return out.select(*px, F.least(F.greatest(peak, F.lit(0.0)), F.col("_last")).alias("peak"), "contrast")


def feature_focal_frame(e: DataFrame, features: DataFrame, radius: int = 9, value: str = "e") -> DataFrame:
    """Frame whose mean energy in the square patch around each feature is largest.

    Features on one pixel share their patch, so only distinct places are spread over patch pixels and read the energies.
    The patch rows are many times the features they come from, which size estimates don't see: they are merged, never broadcast.
    """
    at = {"_fy": F.floor(F.col("y") + 0.5).cast("int"), "_fx": F.floor(F.col("x") + 0.5).cast("int")}
    placed = features.select(STACK, "feature_id", *[c.alias(n) for n, c in at.items()])
    place = [STACK, "_fy", "_fx"]
    span = lambda c: F.explode(F.sequence(F.col(c) - radius, F.col(c) + radius))
    cells = placed.select(*place).distinct().withColumn(Y, span("_fy")).withColumn(X, span("_fx"))
    mean = cells.hint("merge").join(e.select(STACK, FRAME, Y, X, value), PIXEL).groupBy(*place, FRAME).agg(F.round(F.avg(value), 9).alias("energy"))
    best = mean.groupBy(*place).agg(F.max_by(FRAME, first_max("energy", FRAME)).alias("focal"), F.max("energy").alias("energy"))
    return placed.join(best, place).select(STACK, "feature_id", "focal", "energy")


def sharpest_frame(e: DataFrame, members: DataFrame, group: str, value: str = "e") -> DataFrame:
    """Sharpest frame of each pixel set, the first of those equal at six digits; ``members`` has stack_id, y, x and the group column."""
    total = e.join(members.select(*PIXEL, group), PIXEL).groupBy(STACK, group, FRAME).agg(F.sum(value).alias("total"))
    best = F.max_by(F.struct(FRAME, "total"), first_max(F.round("total", 6), FRAME))  # sums of the same terms differ by their order
    return total.groupBy(STACK, group).agg(best.alias("_b")).select(STACK, group, f"_b.{FRAME}", "_b.total")


def sharpness(px: DataFrame, v: str = "v", by=(FRAME,), side: int = SIDE) -> DataFrame:
    """Mean absolute four-neighbour Laplacian of each image."""
    lap = st.derivatives(px, v, ("lap1",), by=by, side=side)
    return lap.groupBy(STACK, *by).agg(F.avg(F.abs("lap1")).alias("sharp"))


def noise_sigma(px: DataFrame, v: str = "v", by=(FRAME,), side: int = SIDE, share: float = 0.35,
                scale: float = 0.67448975 * 6.0, bounds=(1.5, 20.0)) -> DataFrame:
    """Noise level per stack: median absolute high-pass on the flattest part of each image, smallest over images."""
    def body(df):
        for axis in (X, Y):  # [1 -2 1] along both axes, edge pixels repeated
            df = st.conv1d(df, {"_resp": v if axis == X else "_resp"}, [1.0, -2.0, 1.0], axis, by, border="clamp")
        return st.gradient_magnitude(df, v, "_g", by=by)
    df = shared(blocked(px, 1, body, side).select(STACK, *by, "_g", F.abs("_resp").alias("_resp"), Y, X))
    edge = exact_quantiles(df, [STACK, *by], "_g", {"_cut": share})
    calm = attach(df, cut(edge), [STACK, *by]).filter("_g <= _cut")  # one row per image
    med = exact_quantiles(calm, [STACK, *by], "_resp", {"_med": 0.5})
    return med.groupBy(STACK).agg(clip(F.min(F.col("_med") / scale), *bounds).alias("sigma"))
