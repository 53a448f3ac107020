"""Quality of fused images, with and without a reference, and audits over many scenes."""

from __future__ import annotations

import math
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharpfleet.functions.columns import col, first_max, safe_corr
from sharpfleet.functions.quantiles import exact_quantiles
from sharpfleet.operators import stats as sa
from sharpfleet.operators import stencil as st
from sharpfleet.operators.grid import BLK, FRAME, SIDE, STACK, X, Y, attach, blocked, spread

# Fixed values of the gradient-transfer sigmoids: amplitude, slope, midpoint
STRENGTH = (0.9994, -15.0, 0.5)
ANGLE = (0.9879, -22.0, 0.8)
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
COMPOSITE = {"q_abf_ms": 0.3, "q_ssim": 0.7}


def _edge_quality() -> Column:
    low, high = F.least("_g", "_gf"), F.greatest("_g", "_gf")
    ratio = low / (high + 1e-10)
    half = math.pi / 2
    angle = F.abs(F.abs(F.col("_a") - F.col("_af")) - half) / half
    sig = lambda v, p: F.lit(p[0]) / (1 + F.exp(F.lit(p[1]) * (v - p[2])))
    return sig(ratio, STRENGTH) * sig(angle, ANGLE)


def gradient_transfer(px: DataFrame, source: str = "v", fused: str = "f", by: Sequence[str] = (FRAME,), side: int = SIDE) -> DataFrame:
    """Per source pixel: ``num`` = edge preservation × strength and ``den`` = strength.

    Rows carry the source value and the fused value of the same pixel.
    """
    def body(d):
        d = st.derivatives(d, source, ("gx", "gy"), by=by)
        d = d.withColumns({"_g": F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")), "_a": F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double"))}).drop("gx", "gy")
        d = st.derivatives(d, fused, ("gx", "gy"), by=by)
        return d.withColumns({"_gf": F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")), "_af": F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double"))}).drop("gx", "gy")
    d = blocked(px, 1, body, side)
    return d.withColumn("num", _edge_quality() * F.col("_g")).withColumnRenamed("_g", "den").drop("_a", "_gf", "_af")


def q_abf_map(px: DataFrame, by=(FRAME,), **kw) -> DataFrame:
    g = gradient_transfer(px, by=by, **kw).groupBy(STACK, Y, X).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return g.select(STACK, Y, X, (F.col("num") / (F.col("den") + 1e-10)).alias("q_abf"))


def q_abf(px: DataFrame, by=(FRAME,), keys: Sequence[str] = (STACK,), **kw) -> DataFrame:
    g = gradient_transfer(px, by=by, **kw).groupBy(*keys).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return g.withColumn("q_abf", F.col("num") / (F.col("den") + 1e-10))


def q_abf_ms(px: DataFrame, levels: int = 4, pool: str = "mean", smallest: int = 32, side: int = SIDE) -> DataFrame:
    """Gradient transfer at several scales; an image stops after the first level smaller than ``smallest``."""
    from sharpfleet.operators.pyramid import pyr_down
    d = px.select(STACK, FRAME, Y, X, "h", "w", F.col("v").cast("double").alias("v"), F.col("f").cast("double").alias("f"))
    parts = None
    for k in range(max(1, levels)):
        one = q_abf(d, side=side).withColumn("level", F.lit(k))
        parts = one if parts is None else parts.unionByName(one)
        if k + 1 < levels:
            d = pyr_down(d.filter(F.least("h", "w") >= smallest), ["v", "f"], side=side)
    out = F.sum("num") / (F.sum("den") + 1e-10) if pool == "sum" else F.avg("q_abf")
    return parts.groupBy(STACK).agg(out.alias("q_abf_ms"), F.count("*").alias("scales"))


def q_mi(px: DataFrame, bins: int = 64) -> DataFrame:
    """Mean normalised mutual information between the fused image and every source."""
    one = sa.mutual_information(px, [STACK, FRAME], "v", "f", bins)
    return one.groupBy(STACK).agg(F.avg("nmi").alias("q_mi"))


def ssim_map(px: DataFrame, a: str, b: str, by: Sequence[str] = (), win: int = 7, out: str = "ssim", side: int = SIDE) -> DataFrame:
    """Structural similarity of two columns, all five window means in one pass."""
    x, y, n = F.col(a).cast("double"), F.col(b).cast("double"), float(win * win)

    def body(d):
        d = st.box(d, {"_sx": x, "_sy": y, "_sxx": x * x, "_syy": y * y, "_sxy": x * y}, win // 2, by, mean=False)
        mx, my = F.col("_sx") / n, F.col("_sy") / n
        vx, vy, cxy = F.col("_sxx") / n - mx * mx, F.col("_syy") / n - my * my, F.col("_sxy") / n - mx * my
        s = ((2 * mx * my + C1) * (2 * cxy + C2)) / ((mx * mx + my * my + C1) * (vx + vy + C2) + 1e-12)
        return d.withColumn(out, s).drop("_sx", "_sy", "_sxx", "_syy", "_sxy")
    return blocked(px, win // 2, body, side)


def ref_ssim(px: DataFrame, a: str, b: str, by: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    return ssim_map(px, a, b, by, side=side).groupBy(STACK, *by).agg(F.avg("ssim").alias("ssim"))


def q_ssim_map(px: DataFrame, side: int = SIDE) -> DataFrame:
    """SSIM of the fused value to the locally sharpest source; rows carry source v and fused f."""
    def body(d):
        d = st.derivatives(d, "v", ("lap1",))
        d = st.box(d, {"_sharp": F.abs("lap1").cast("double")}, 4)
        d = ssim_map(d, "f", "v", (FRAME,))
        best = d.groupBy(STACK, BLK, Y, X).agg(F.max_by("ssim", first_max("_sharp", FRAME)).alias("q_ssim"))
        return best
    return blocked(px, 5, body, side)


def q_ssim(px: DataFrame, side: int = SIDE) -> DataFrame:
    return q_ssim_map(px, side).groupBy(STACK).agg(F.avg("q_ssim").alias("q_ssim"))


def psnr(px: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = (STACK,)) -> DataFrame:
    """Peak signal to noise over the given column pairs; 100 where the error vanishes."""
    se = sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in pairs)
    g = px.groupBy(*by).agg((F.avg(se.cast("double")) / len(pairs)).alias("mse"))
    return g.withColumn("psnr", F.when(F.col("mse") < 1e-9, F.lit(100.0)).otherwise(10 * F.log10(F.lit(255.0 ** 2) / F.col("mse"))))


def composite(long: DataFrame, weights: Mapping[str, float] = COMPOSITE, by: Sequence[str] = (STACK,)) -> DataFrame:
    """Weighted sum of long scores (metric, value); metrics without a positive weight do not count."""
    w = {k: v for k, v in weights.items() if v > 0}
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in w.items() for x in kv]), F.col("metric"))
    return long.filter(F.col("metric").isin(list(w))).groupBy(*by).agg(F.sum(weight * F.col("value")).alias("composite"))


def composite_map(px: DataFrame, weights: Mapping[str, float], side: int = SIDE) -> DataFrame:
    """Per-pixel composite over the metrics that have a map, weights renormalised over those."""
    w = {k: v for k, v in weights.items() if k in ("q_abf", "q_ssim") and v > 0}
    total = sum(w.values()) + 1e-12
    a, s = q_abf_map(px, side=side), q_ssim_map(px, side)
    return a.join(s, [STACK, Y, X]).select(STACK, Y, X, sum(F.col(k) * (v / total) for k, v in w.items()).alias("quality"))


def tiled_ssim(px: DataFrame, a: str, b: str, grid: int = 8, by: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """Mean and worst SSIM over a grid of tiles."""
    s = ssim_map(px, a, b, by, side=side)
    ty, tx = F.floor(F.col(Y) / F.floor(F.col("h") / grid)).cast("int"), F.floor(F.col(X) / F.floor(F.col("w") / grid)).cast("int")
    s = s.withColumns({"ty": ty, "tx": tx}).filter((F.col("ty") < grid) & (F.col("tx") < grid))
    t = s.groupBy(STACK, *by, "ty", "tx").agg(F.avg("ssim").alias("_t"))
    return t.groupBy(STACK, *by).agg(F.avg("_t").alias("mean"), F.min("_t").alias("worst"))


def partition_scores(px: DataFrame, before: Column, after: Column, regions: Mapping[str, Column], by: Sequence[str] = (STACK,)) -> DataFrame:
    """Pixels, error before and after, and how many changed, came closer or got worse, per named region."""
    flags = F.array(*[F.when(c, F.lit(n)) for n, c in regions.items()])
    d = px.withColumns({"_b": before, "_a": after, "region": F.explode(F.array_compact(flags))})
    return d.groupBy(*by, "region").agg(
        F.count("*").alias("pixels"), F.avg("_b").alias("mae_before"), F.avg("_a").alias("mae_after"),
        F.count_if(F.col("_a") != F.col("_b")).alias("changed"), F.count_if(F.col("_a") < F.col("_b")).alias("closer"),
        F.count_if(F.col("_a") > F.col("_b")).alias("worse"))


def scene_score(px: DataFrame, base: str, result: str, truth: str, side: int = SIDE) -> DataFrame:
    """SSIM, MAE and MSE before and after with their deltas, and pixel outcomes."""
    s = blocked(px, 3, lambda d: ssim_map(ssim_map(d, base, truth, out="_s0"), result, truth, out="_s1"), side)
    e0, e1 = F.abs(F.col(base) - F.col(truth)), F.abs(F.col(result) - F.col(truth))
    g = s.groupBy(STACK).agg(
        F.avg("_s0").alias("ssim_before"), F.avg("_s1").alias("ssim_after"), F.avg(e0).alias("mae_before"), F.avg(e1).alias("mae_after"),
        F.avg(e0 * e0).alias("mse_before"), F.avg(e1 * e1).alias("mse_after"),
        F.count_if(F.col(base) != F.col(result)).alias("changed"), F.count_if(e1 < e0).alias("closer"), F.count_if(e1 > e0).alias("worse"))
    return g.withColumns({f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in ("ssim", "mae", "mse")})


def boundary_distance(px: DataFrame, a: str, b: str, radius: int, by: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """Mean and 95th percentile of the distance from each boundary to the other, both ways."""
    from sharpfleet.operators.resample import distance
    def body(d):
        d = st.boundary(st.boundary(d, a, "_ea", by), b, "_eb", by)
        return distance(distance(d, "_ea", radius, by, out="_da"), "_eb", radius, by, out="_db")
    d = blocked(px, radius + 1, body, side)
    ways = F.explode(F.array(F.struct(F.lit("a_to_b").alias("way"), F.when(F.col("_ea"), F.col("_db")).alias("dist")),
                             F.struct(F.lit("b_to_a").alias("way"), F.when(F.col("_eb"), F.col("_da")).alias("dist"))))
    d = d.select(STACK, *by, ways.alias("_w")).select(STACK, *by, "_w.*").filter("dist IS NOT NULL")
    q = exact_quantiles(d, [STACK, *by, "way"], "dist", {"p95": 0.95})
    return d.groupBy(STACK, *by, "way").agg(F.avg("dist").alias("mean")).join(q, [STACK, *by, "way"])


def audit_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts over scored scenes: fired, improved by each measure, and the mean overlap."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("scenes"), F.count_if("fired").alias("fired"),
        F.count_if(F.col("fired") & (F.col("ssim_delta") > 0)).alias("ssim_positive"),
        F.count_if(F.col("fired") & (F.col("mae_delta") < 0)).alias("mae_positive"),
        F.count_if(F.col("fired") & (F.col("mse_delta") < 0)).alias("mse_positive"),
        F.count_if(F.col("fired") & (F.col("mae_delta") <= 0) & (F.col("mse_delta") <= 0)).alias("non_regressing"),
        F.count_if(F.col("iou") == 0).alias("zero_overlap"), F.avg("iou").alias("mean_iou"))


def leaderboard(rows: DataFrame, by: Sequence[str], method: str, value: str) -> DataFrame:
    g = rows.groupBy(*by, method).agg(F.avg(value).alias("score"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(method))
    return g.withColumn("place", F.row_number().over(w))


def method_disagreement(px: DataFrame, method: str, v: str, r: int = 30, side: int = SIDE) -> DataFrame:
    """Pooled absolute difference of every pair of methods; the largest per stack and pair."""
    other = px.select(STACK, F.col(method).alias("_m"), Y, X, F.col(v).alias("_v"))
    pair = px.join(other, [STACK, Y, X]).filter(F.col(method) < F.col("_m"))  # a handful of methods per pixel
    pair = pair.select(STACK, Y, X, "h", "w", F.col(method).alias("method_a"), F.col("_m").alias("method_b"), F.abs(F.col(v) - F.col("_v")).cast("double").alias("heat"))
    heat = st.box(pair, {"heat": "heat"}, r, ("method_a", "method_b"), side=side)
    return heat.groupBy(STACK, "method_a", "method_b").agg(F.max("heat").alias("heat"))


def outcome(changed: Column, before: Column, after: Column) -> Column:
    return F.when(~changed, "unchanged").when(after < before, "closer").when(after > before, "worse").otherwise("tied")


def error_delta(px: DataFrame, base: str, result: str, truth: str, share: float = 0.98) -> DataFrame:
    """Gain of each pixel (error before − after) scaled by the 98th percentile over changed pixels, and its class."""
    e0, e1, changed = F.abs(F.col(base) - F.col(truth)), F.abs(F.col(result) - F.col(truth)), F.col(base) != F.col(result)
    d = px.withColumns({"delta": (e0 - e1).cast("double"), "outcome": outcome(changed, e0, e1)})
    q = exact_quantiles(d.filter(changed).withColumn("_abs", F.abs("delta")), [STACK], "_abs", {"_top": share})
    d = attach(d, q, [STACK], "left").withColumn("_top", F.greatest(F.coalesce("_top", F.lit(1.0)), F.lit(1e-3)))
    scaled = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("delta") / F.col("_top")))
    return d.withColumn("scaled", F.when(changed, scaled).otherwise(F.lit(0.0))).drop("_top")


def spearman(rows: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties, per key."""
    def rank(c):
        w = Window.partitionBy(*by)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0
    d = rows.select(*by, a, b)
    d = (spread(d, *by) if by else d).withColumns({"_ra": rank(a), "_rb": rank(b)})
    return d.groupBy(*by).agg(safe_corr("_ra", "_rb").alias("spearman"), F.count("*").alias("n"))


def z_statistics(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def held_out(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Fixed split by a seeded hash: the same id always falls on the same side, without ranking all rows."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(10_000))
    return rows.withColumn("held_out", bucket < int(round(share * 10_000)))


def box_table(e: DataFrame, boxes: DataFrame, value: str = "e") -> DataFrame:
    """Mean energy of each named box in every frame; ``boxes``: stack_id, box, y0, y1, x0, x1 (few per stack)."""
    j = attach(e, boxes, [STACK]).filter((F.col(Y) >= F.col("y0")) & (F.col(Y) < F.col("y1")) & (F.col(X) >= F.col("x0")) & (F.col(X) < F.col("x1")))
    return j.groupBy(STACK, "box", FRAME).agg(F.avg(value).alias("energy"))
