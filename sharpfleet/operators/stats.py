"""Aggregates: exposure, histograms, information, weighted fits and report roll-ups."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharpfleet.functions.columns import col, safe_corr, solve2, solve3, truncate_u8
from sharpfleet.functions.quantiles import exact_quantiles
from sharpfleet.operators.grid import FRAME, STACK, X, Y, attach, attach_few
from sharpfleet.runtime import cut

RGB = ("b", "g", "r")


def weight_of(weight: Column | str | None) -> Column:
    return F.lit(1.0) if weight is None else col(weight)


def exposure_gains(px: DataFrame, channels: Sequence[str] = RGB) -> DataFrame:
    """Gain per (stack, frame, channel): median of the channel means over the frames, by the own mean."""
    means = px.groupBy(STACK, FRAME).agg(*[F.avg(c).alias(c) for c in channels])
    med = means.groupBy(STACK).agg(*[F.percentile(c, F.lit(0.5)).alias(f"_{c}") for c in channels])
    return means.join(med, STACK).select(STACK, FRAME, *[(F.col(f"_{c}") / F.greatest(c, F.lit(1e-3))).alias(f"gain_{c}") for c in channels])


def normalize_exposure(px: DataFrame, channels: Sequence[str] = RGB) -> DataFrame:
    g = exposure_gains(px, channels)
    out = attach(px, g, [STACK, FRAME])
    return out.withColumns({c: truncate_u8(F.col(c) * F.col(f"gain_{c}")) for c in channels}).drop(*[f"gain_{c}" for c in channels])


def winner_share(win: DataFrame, winner: str = "winner") -> DataFrame:
    """Pixels and share won by each frame; ``owner`` marks the most frequent one (lowest index on ties)."""
    n = win.groupBy(STACK, winner).agg(F.count("*").alias("pixels"))
    w = Window.partitionBy(STACK)
    best = F.max(F.struct("pixels", -F.col(winner))).over(w)
    return n.withColumn("share", F.col("pixels") / F.sum("pixels").over(w)).withColumn("owner", F.struct("pixels", -F.col(winner)) == best)


def masked_mean(df: DataFrame, by: Sequence[str], value: Column | str, mask: Column, out: str = "mean") -> DataFrame:
    """Mean where the mask holds; NULL for keys without a masked row."""
    return df.groupBy(*by).agg(F.avg(F.when(mask, col(value))).alias(out))


def bin_of(v, lo: float, hi: float, bins: int) -> Column:
    """Histogram bin 0..bins−1 with a closed last bin; NULL outside the range."""
    b = F.floor((col(v) - lo) / (hi - lo) * bins).cast("int")
    return F.when((col(v) >= lo) & (col(v) <= hi), F.least(b, F.lit(bins - 1)))


def histogram(df: DataFrame, by: Sequence[str], v: Column | str, lo: float, hi: float, bins: int, weight: Column | str | None = None) -> DataFrame:
    w = weight_of(weight)
    d = df.withColumn("bin", bin_of(v, lo, hi, bins)).filter("bin IS NOT NULL")
    return d.groupBy(*by, "bin").agg(F.sum(w).alias("weight"))


def mutual_information(df: DataFrame, by: Sequence[str], a: str, b: str, bins: int = 64) -> DataFrame:
    """Entropies of both columns and of the pair, their mutual information and its normalised form.

    Bin edges span each image's own range, as for a histogram without a given range.
    """
    by = list(by)
    lim = df.groupBy(*by).agg(*[f(c).alias(f"_{k}{c}") for c in {a, b} for k, f in (("lo", F.min), ("hi", F.max))])
    d = attach(df.select(*by, *{a, b}, *[c for c in (FRAME, Y, X) if c in df.columns and c not in by]), lim, by)

    def cell(c):
        lo, hi = F.col(f"_lo{c}"), F.col(f"_hi{c}")
        flat = lo == hi
        lo, hi = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
        return F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    d = d.withColumns({"_ba": cell(a), "_bb": cell(b)})
    pair = d.groupBy(*by, "_ba", "_bb").agg(F.count("*").alias("_n"))
    n = F.sum("_n").over(Window.partitionBy(*by))
    na, nb = F.sum("_n").over(Window.partitionBy(*by, "_ba")), F.sum("_n").over(Window.partitionBy(*by, "_bb"))
    pair = pair.withColumns({"_p": F.col("_n") / n, "_pa": na / n, "_pb": nb / n})
    out = pair.groupBy(*by).agg(
        (-F.sum(F.col("_p") * F.log2("_pa"))).alias("h_a"), (-F.sum(F.col("_p") * F.log2("_pb"))).alias("h_b"),
        (-F.sum(F.col("_p") * F.log2("_p"))).alias("h_ab"))
    out = out.withColumn("mi", F.col("h_a") + F.col("h_b") - F.col("h_ab"))
    return out.withColumn("nmi", 2 * F.col("mi") / (F.col("h_a") + F.col("h_b") + 1e-10))


def weighted_median(df: DataFrame, by: Sequence[str], v: str, w: str) -> DataFrame:
    """First value at which the running weight reaches half of the total; equal values are added up first."""
    d = df.groupBy(*by, v).agg(F.sum(w).alias("_w"))
    run = Window.partitionBy(*by).orderBy(v)
    d = d.withColumns({"_run": F.sum("_w").over(run), "_all": F.sum("_w").over(Window.partitionBy(*by))})
    return d.filter(F.col("_run") >= 0.5 * F.col("_all")).groupBy(*by).agg(F.min(v).alias("median"))


def normal_translation(df: DataFrame, by: Sequence[str], weight: Column | str | None = None, shift: str = "shift", ridge: float = 0.0) -> DataFrame:
    """Translation (mx, my) whose projections on the unit normals (nx, ny) best explain the shifts."""
    w, nx, ny, s = weight_of(weight), F.col("nx"), F.col("ny"), F.col(shift)
    d = df.groupBy(*by).agg(
        F.sum(w * nx * nx).alias("_a"), F.sum(w * nx * ny).alias("_b"), F.sum(w * ny * ny).alias("_c"),
        F.sum(w * nx * s).alias("_p"), F.sum(w * ny * s).alias("_q"), F.count("*").alias("n"), F.sum(w).alias("weight"))
    mx, my = solve2("_a", "_b", "_c", "_p", "_q", ridge)
    return d.withColumns({"mx": mx, "my": my, "xx": F.col("_a"), "xy": F.col("_b"), "yy": F.col("_c")}).drop("_a", "_b", "_c", "_p", "_q")


def straight_line(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def line_through_origin(df: DataFrame, by: Sequence[str], y: Column | str, x: Column | str, weight: Column | str | None = None) -> DataFrame:
    w, y, x = weight_of(weight), col(y), col(x)
    num, den = F.sum(w * x * y), F.sum(w * x * x)
    return df.groupBy(*by).agg((num / F.when(den > 0, den)).alias("slope"))


def fit_similarity(df: DataFrame, by: Sequence[str], cx: float, cy: float, weight: Column | str | None = None,
                   passes: int = 4, minimum: int = 8) -> DataFrame:
    """Scale and translation dx = s·(x−cx) + tx, dy = s·(y−cy) + ty by reweighted least squares.

    Every observation gives an x row and a y row. After each pass a row whose residual exceeds twice the
    median residual is weighted down in proportion. A pass is one aggregate and a join of three numbers
    per key.
    """
    by = list(by)
    row = lambda u, d, kx, ky: F.struct(u.alias("u"), F.col(d).alias("d"), F.lit(kx).alias("kx"), F.lit(ky).alias("ky"))
    d = df.withColumn("_w0", weight_of(weight).cast("double"))
    d = d.select(*by, "_w0", F.xxhash64("x", "y", "dx", "dy").alias("_id"), F.explode(F.array(
        row(F.col("x") - cx, "dx", 1.0, 0.0), row(F.col("y") - cy, "dy", 0.0, 1.0))).alias("_r")).select(*by, "_w0", "_id", "_r.*")
    base, fit = d, None
    d = d.withColumn("_w", F.col("_w0"))
    for k in range(passes):
        w, u, kx, ky, v = (F.col(c) for c in ("_w", "u", "kx", "ky", "d"))
        g = d.groupBy(*by).agg(
            F.sum(w * u * u).alias("_uu"), F.sum(w * u * kx).alias("_ux"), F.sum(w * u * ky).alias("_uy"), F.sum(w * kx).alias("_x"),
            F.sum(w * ky).alias("_y"), F.sum(w * u * v).alias("_ud"), F.sum(w * kx * v).alias("_xd"), F.sum(w * ky * v).alias("_yd"), F.count("*").alias("n"))
        zero = F.lit(0.0)
        s, tx, ty = solve3([["_uu", "_ux", "_uy"], ["_ux", "_x", zero], ["_uy", zero, "_y"]], ["_ud", "_xd", "_yd"])
        fit = g.filter(F.col("n") >= minimum).select(*by, s.alias("scale"), tx.alias("tx"), ty.alias("ty"), "n")
        if k + 1 < passes:
            fit = cut(fit)  # one row per key
            d = attach_few(base, fit.select(*by, "scale", "tx", "ty"), by)
            d = d.withColumn("_res", F.abs(u * F.col("scale") + kx * F.col("tx") + ky * F.col("ty") - v)).drop("scale", "tx", "ty")
            med = cut(exact_quantiles(d, by, "_res", {"_med": 0.5}, narrow=True))
            limit = F.greatest(2.0 * F.col("_med"), F.lit(1e-6))
            d = attach_few(d, med, by).withColumn("_w", F.col("_w0") * F.least(F.lit(1.0), limit / F.greatest("_res", F.lit(1e-9))))
    return fit


def inverse_depth(df: DataFrame, by: Sequence[str], bin_col: str, flat: Column, coefficient: Column, displacement: Column, weight: Column) -> DataFrame:
    """Inverse depth per bin, Σ w·c·(d − flat) / Σ w·c², centred, unit spread, sign by correlation with the bin."""
    c = coefficient
    g = df.groupBy(*by, bin_col).agg(F.sum(weight * c * (displacement - flat)).alias("_n"), F.sum(weight * c * c).alias("_d"))
    g = g.withColumn("raw", F.col("_n") / F.when(F.col("_d") > 1e-12, F.col("_d")))
    s = g.groupBy(*by).agg(F.avg("raw").alias("_m"), F.stddev_pop("raw").alias("_s"), safe_corr("raw", F.col(bin_col).cast("double")).alias("_r"))
    g = g.join(s, list(by))
    sign = F.when(F.col("_r") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return g.select(*by, bin_col, (sign * (F.col("raw") - F.col("_m")) / F.when(F.col("_s") > 1e-9, F.col("_s"))).alias("inverse_depth"))


def quadrant_signature(df: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Mean horizontal shift left and right of the centre, from mostly horizontal normals; needs both sides."""
    centre = (width - 1) / 2
    d = df.filter(F.abs("nx") > 0.7).withColumn("_h", F.col("shift") * F.col("nx"))
    g = d.groupBy(*by).agg(F.avg(F.when(F.col("x") < centre, F.col("_h"))).alias("left"), F.avg(F.when(F.col("x") > centre, F.col("_h"))).alias("right"))
    return g.filter("left IS NOT NULL AND right IS NOT NULL")


def scalar_gain(df: DataFrame, by: Sequence[str], predicted: str, observed: str, weight: Column | str | None = None, lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """Least-squares gain from predicted to observed, clipped; 1 without evidence."""
    w, p, o = weight_of(weight), F.col(predicted), F.col(observed)
    den = F.sum(w * p * p)
    gain = F.coalesce(F.sum(w * p * o) / F.when(den > 1e-9, den), F.lit(1.0))
    return df.groupBy(*by).agg(F.least(F.lit(hi), F.greatest(F.lit(lo), gain)).alias("gain"))


def disagreement(df: DataFrame, by: Sequence[str], rx: str, ry: str) -> DataFrame:
    """Median and 90th percentile of residual vectors, and the mean vector of those above the median."""
    d = df.withColumn("_m", F.sqrt(F.col(rx) * F.col(rx) + F.col(ry) * F.col(ry)))
    q = exact_quantiles(d, by, "_m", {"median": 0.5, "p90": 0.9})
    far = F.col("_m") > F.col("median")
    return attach(d, q, by).groupBy(*by).agg(
        F.max("median").alias("median"), F.max("p90").alias("p90"), F.count_if(far).alias("stranded"),
        F.avg(F.when(far, F.col(rx))).alias("wants_x"), F.avg(F.when(far, F.col(ry))).alias("wants_y"))


def report(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per key with a struct of statistics and a map of the mean per frame."""
    per = df.groupBy(*by, FRAME).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"), F.max(F.abs(value)).alias("_m"))
    return per.groupBy(*by).agg(
        F.struct(F.sum("_n").alias("observations"), F.count("*").alias("frames"), F.max("_m").alias("largest")).alias("totals"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(FRAME), F.col("_s") / F.col("_n"))))).alias("mean_by_frame"))


def rollup_scores(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Count, mean and extremes by (outer, inner), by outer and over all; one pass at three grains."""
    return df.rollup(outer, inner).agg(
        F.grouping_id().alias("grain"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
