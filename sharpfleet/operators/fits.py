"""Least-squares fits with a handful of unknowns per key.

The rows are reduced to their normal sums by one aggregate; only the small matrix of each key is solved in
Python. Reweighting passes repeat that with weights from the residuals.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharpfleet.functions.quantiles import exact_quantiles
from sharpfleet.operators.grid import FRAME, STACK, X, Y, attach, attach_few
from sharpfleet.runtime import cut, shared


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(a: pd.Series, b: pd.Series, ridge: pd.Series) -> pd.Series:
    out = []
    for m, v, r in zip(a, b, ridge):
        k = len(v)
        full = np.zeros((k, k))
        full[np.triu_indices(k)] = m
        full = full + np.triu(full, 1).T + r * np.eye(k)
        out.append(np.linalg.lstsq(full, np.asarray(v, float), rcond=None)[0].tolist())
    return pd.Series(out)


def robust_fit(rows: DataFrame, by: Sequence[str], design: Sequence[Column], target: str, weight: str,
               passes: int = 3, factor: float = 2.5, floor: float = 1e-6, ridge: float = 0.0, least: int = 0) -> DataFrame:
    """Coefficients (array ``beta``) of target ~ design per key, weights cut at factor × median residual."""
    by, k = list(by), len(design)
    d = rows.select(*by, F.col(target).alias("_y"), F.col(weight).alias("_w0"), *[c.cast("double").alias(f"_d{i}") for i, c in enumerate(design)])
    base, fit = d, None
    d = d.withColumn("_w", F.col("_w0"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for p in range(passes):
        s = d.groupBy(*by).agg(
            F.array(*[F.sum(F.col("_w") * F.col(f"_d{i}") * F.col(f"_d{j}")) for i, j in pairs]).alias("_a"),
            F.array(*[F.sum(F.col("_w") * F.col(f"_d{i}") * F.col("_y")) for i in range(k)]).alias("_b"), F.count("*").alias("n"), F.sum("_w").alias("weight"))
        s = s.filter(F.col("n") >= max(least, 1))
        fit = s.select(*by, _solve("_a", "_b", F.lit(float(ridge))).alias("beta"), "n", "weight")
        if p + 1 < passes:
            fit = cut(fit)  # one row per key
            e = attach_few(base, fit.select(*by, "beta"), by)
            e = e.withColumn("_r", F.abs(sum(F.col(f"_d{i}") * F.element_at("beta", i + 1) for i in range(k)) - F.col("_y"))).drop("beta")
            med = cut(exact_quantiles(e, by, "_r", {"_med": 0.5}, narrow=True))
            limit = F.greatest(F.col("_med") * factor, F.lit(floor))
            d = attach_few(e, med, by).withColumn("_w", F.col("_w0") * F.least(F.lit(1.0), limit / F.greatest("_r", F.lit(1e-9)))).drop("_r", "_med")
    return fit


def motion_rows(obs: DataFrame, h: int, w: int) -> DataFrame:
    """The x row and the y row of every displacement observation in units of the diagonal.

    Design: rotations wx, wy, wz, translations tx, ty, tz times relative depth u, and scale s.
    """
    scale = math.hypot(h, w)
    d = obs.withColumns({"_x": (F.col("x") - (w - 1) / 2) / scale, "_y": (F.col("y") - (h - 1) / 2) / scale})
    x, y, u = F.col("_x"), F.col("_y"), F.col("u")
    zero = F.lit(0.0)
    along = F.array(x * y, -(1 + x * x), y, -u, zero, u * x, x)
    down = F.array(1 + y * y, -x * y, -x, zero, -u, u * y, y)
    row = lambda a, t: F.struct(a.alias("a"), (F.col(t) / scale).alias("t"))
    return d.select(*[c for c in obs.columns], F.explode(F.array(row(along, "dx"), row(down, "dy"))).alias("_r")).select(*obs.columns, "_r.*")


def fit_motion(obs: DataFrame, by: Sequence[str], h: int, w: int, weight: str = "w", ridge: float = 1e-3, passes: int = 3) -> DataFrame:
    """Seven-parameter small-motion model per key; ``u`` is the depth relative to the mean depth of the key."""
    origin = cut(obs.groupBy(*by).agg(F.avg("depth").alias("origin")))
    d = attach_few(obs, origin, list(by)).withColumn("u", F.col("depth") - F.col("origin"))
    r = motion_rows(d.select(*by, "x", "y", "dx", "dy", "u", F.col(weight).alias("_wt")), h, w)
    fit = robust_fit(r, by, [F.element_at("a", i + 1) for i in range(7)], "t", "_wt", passes, 2.0, 1e-6, ridge, 12)
    return fit.join(origin, list(by))


def motion_displacement(px: DataFrame, params: DataFrame, by: Sequence[str], h: int, w: int) -> DataFrame:
    """Displacement (dx, dy) the model gives every row (x, y, depth)."""
    scale = math.hypot(h, w)
    j = attach(px, params.select(*by, "beta", "origin"), list(by))
    x, y, u = (F.col("x") - (w - 1) / 2) / scale, (F.col("y") - (h - 1) / 2) / scale, F.col("depth") - F.col("origin")
    wx, wy, wz, tx, ty, tz, s = (F.element_at("beta", i + 1) for i in range(7))
    return j.withColumns({
        "mdx": scale * (wx * x * y - wy * (1 + x * x) + wz * y + u * (x * tz - tx) + s * x),
        "mdy": scale * (wx * (1 + y * y) - wy * x * y - wz * x + u * (y * tz - ty) + s * y)}).drop("beta", "origin")


def hat_basis(d: Column, knots: Sequence[float]) -> list[Column]:
    """Piecewise-linear basis on the knots, constant outside them."""
    v = F.greatest(F.lit(float(knots[0])), F.least(F.lit(float(knots[-1])), d))
    out = []
    for j, k in enumerate(knots):
        e = F.lit(0.0)
        if j > 0:
            a = knots[j - 1]
            e = F.when((v > a) & (v <= k), (v - a) / (k - a)).otherwise(e)
        if j + 1 < len(knots):
            b = knots[j + 1]
            e = F.when((v >= k) & (v < b), (b - v) / (b - k)).otherwise(e)
        out.append(e)
    return out


def fit_curve(rows: DataFrame, by: Sequence[str], knots: Sequence[float], weight: str = "score") -> DataFrame:
    """Displacement against depth as two piecewise-linear curves (``cx``, ``cy``) from shifts along normals."""
    basis = hat_basis(F.col("depth"), knots)
    design = [b * F.col("nx") for b in basis] + [b * F.col("ny") for b in basis]
    rows = shared(rows.select(*by, "depth", "nx", "ny", "shift", weight))  # measures are an aggregate, passes read them again
    f = robust_fit(rows, by, design, "shift", weight, 3, 2.5, 1e-6, 0.0, 3 * len(knots))
    k = len(knots)
    return f.select(*by, F.slice("beta", 1, k).alias("cx"), F.slice("beta", k + 1, k).alias("cy"), "n")


def evaluate_curve(depth: DataFrame, curve: DataFrame, by: Sequence[str], knots: Sequence[float]) -> DataFrame:
    j = attach(depth, curve.select(*by, "cx", "cy"), list(by))
    basis = hat_basis(F.col("depth"), knots)
    value = lambda c: sum(b * F.element_at(c, i + 1) for i, b in enumerate(basis))
    return j.withColumns({"dx": value("cx"), "dy": value("cy")}).drop("cx", "cy")


def shared_scale(obs: DataFrame, by: Sequence[str], bins: int, cx: float, cy: float, weight: str = "w") -> DataFrame:
    """One scale and one rotation per key with a translation of its own for each depth bin (column ``bin``)."""
    row = lambda a, b, t, axis: F.struct(a.alias("sc"), b.alias("ro"), F.col(t).alias("t"), F.lit(axis).alias("axis"))
    x, y = F.col("x") - cx, F.col("y") - cy
    r = obs.select(*by, "bin", weight, F.explode(F.array(row(x, -y, "dx", 0), row(y, x, "dy", 1))).alias("_r")).select(*by, "bin", weight, "_r.*")
    own = [((F.col("bin") == b) & (F.col("axis") == a)).cast("double") for b in range(bins) for a in (0, 1)]
    f = robust_fit(r, by, [F.col("sc"), F.col("ro"), *own], "t", weight, 3, 2.5, 1e-6, 1e-9)
    return f.select(*by, F.element_at("beta", 1).alias("scale"), F.element_at("beta", 2).alias("rotation"),
                    *[F.element_at("beta", 3 + 2 * b + a).alias(f"{'tx' if a == 0 else 'ty'}{b}") for b in range(bins) for a in (0, 1)], "n")


def breathing(fit: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Spread of the bins' translations and the median of each axis, next to the shared scale."""
    xs, ys = F.array(*[f"tx{b}" for b in range(bins)]), F.array(*[f"ty{b}" for b in range(bins)])
    mid = lambda a: (F.element_at(F.sort_array(a), (bins + 1) // 2) + F.element_at(F.sort_array(a), bins // 2 + 1)) / 2
    return fit.select(*by, "scale", "rotation", (F.array_max(xs) - F.array_min(xs)).alias("spread_x"), (F.array_max(ys) - F.array_min(ys)).alias("spread_y"), mid(xs).alias("median_x"), mid(ys).alias("median_y"))


def piece_affine(rows: DataFrame, by: Sequence[str], dof: int = 6, weight: str = "score") -> DataFrame:
    """Affine displacement of a piece from shifts along normals: 2 (shift), 3 (shift and scale) or 6 unknowns."""
    nx, ny, x, y = (F.col(c) for c in ("nx", "ny", "x", "y"))
    design = {2: [nx, ny], 3: [nx, ny, nx * x + ny * y], 6: [nx * x, nx * y, nx, ny * x, ny * y, ny]}[dof]
    rows = shared(rows.select(*by, "nx", "ny", "x", "y", "shift", weight))
    return robust_fit(rows, by, design, "shift", weight, 3, 2.5, 0.5, 1e-9, 2 * dof)


def prior_walk(fit: DataFrame, prior: DataFrame, sites: DataFrame, by: Sequence[str]) -> DataFrame:
    """How far a fit moved the centroid of its own evidence away from its prior."""
    from sharpfleet.functions.columns import map_point
    c = sites.groupBy(*by).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    j = fit.select(*by, F.col("m").alias("_mf")).join(prior.select(*by, F.col("m").alias("_mp")), list(by)).join(c, list(by), "left")
    (ax, ay), (bx, by_) = map_point("_mf", "_cx", "_cy"), map_point("_mp", "_cx", "_cy")
    return j.select(*by, F.coalesce(F.sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)), F.lit(0.0)).alias("walk"))


def two_means(tiles: DataFrame, by: Sequence[str], rounds: int = 6, least: int = 4, separation: float = 3.0) -> DataFrame:
    """Two clusters of motion vectors (dx, dy) seeded at the ends of the main direction; keys that do not split are absent."""
    from sharpfleet.functions.columns import eigen2
    m = tiles.groupBy(*by).agg(F.covar_pop("dx", "dx").alias("_a"), F.covar_pop("dx", "dy").alias("_b"), F.covar_pop("dy", "dy").alias("_c"))
    lo, hi = eigen2("_a", "_b", "_c")
    flat = F.abs("_b") < 1e-12
    m = m.withColumns({"_ux": F.when(flat, (F.col("_a") >= F.col("_c")).cast("double")).otherwise(hi - F.col("_c")), "_uy": F.when(flat, (F.col("_a") < F.col("_c")).cast("double")).otherwise(F.col("_b"))})
    p = attach(tiles, m.select(*by, "_ux", "_uy"), list(by)).withColumn("_p", F.round(F.col("dx") * F.col("_ux") + F.col("dy") * F.col("_uy"), 9))
    seed = F.struct("dx", "dy")
    c = cut(p.groupBy(*by).agg(F.min_by(seed, F.struct("_p", "dx", "dy")).alias("c0"), F.max_by(seed, F.struct("_p", "dx", "dy")).alias("c1")))
    dist = lambda k: (F.col("dx") - F.col(f"{k}.dx")) * (F.col("dx") - F.col(f"{k}.dx")) + (F.col("dy") - F.col(f"{k}.dy")) * (F.col("dy") - F.col(f"{k}.dy"))
    for _ in range(rounds):
        d = attach(tiles, c.select(*by, "c0", "c1"), list(by)).withColumn("_k", (dist("c1") < dist("c0")).cast("int"))
        avg = lambda k: F.struct(F.avg(F.when(F.col("_k") == k, F.col("dx"))).alias("dx"), F.avg(F.when(F.col("_k") == k, F.col("dy"))).alias("dy"))
        c = cut(d.groupBy(*by).agg(avg(0).alias("c0"), avg(1).alias("c1"), F.count_if(F.col("_k") == 0).alias("n0"), F.count_if(F.col("_k") == 1).alias("n1")))
    gap = F.sqrt((F.col("c0.dx") - F.col("c1.dx")) * (F.col("c0.dx") - F.col("c1.dx")) + (F.col("c0.dy") - F.col("c1.dy")) * (F.col("c0.dy") - F.col("c1.dy")))
    return c.withColumn("separation", gap).filter((F.least("n0", "n1") >= least) & (F.col("separation") >= separation))
