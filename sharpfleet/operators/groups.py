"""Edge profiles, feature motion and the election of motion groups."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharpfleet.functions.columns import col, eigen2, solve2
from sharpfleet.functions.quantiles import exact_quantiles
from sharpfleet.operators import ranking as rk
from sharpfleet.operators import resample as rs
from sharpfleet.operators import stats as sa
from sharpfleet.operators.grid import FRAME, SIDE, STACK, X, Y, attach, attach_few

# Fixed values
MIN_PEAK, MAX_SHIFT, MIN_FRAMES, INLIER, FOCAL_SIGMA = 0.5, 40.0, 3, 2.0, 2.5
MIN_GROUP, SEEDS, NEAR, JOIN = 8, 24, 120.0, 52.0
MIN_FEATURES, MIN_WEIGHT, GATE_TOL, GATE_WEIGHT, GATE_SEEN = 6, 2.5, 1.5, 2.0, 0.10


def profiles(px: DataFrame, features: DataFrame, half: int = 28, span: int = 24, v: str = "v", side: int = SIDE) -> DataFrame:
    """Mean value across the edge of every feature in every frame: (stack, feature, frame, profile array).

    Sample positions are clamped to the image, so edge pixels repeat; a profile has 2·half+1 entries. Missing pixels count as zero
    next to others; a mean leaves out samples without any pixel and is NULL where none has one.
    """
    size = px.groupBy(STACK).agg(F.max("h").alias("_h"), F.max("w").alias("_w"))
    frames = px.select(STACK, FRAME).distinct()
    f = features.select(STACK, "feature_id", "x", "y", "nx", "ny").join(size, STACK).join(frames, STACK)
    f = f.withColumn("o", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("s", F.explode(F.sequence(F.lit(-span), F.lit(span))))
    keep = lambda e, n: F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, e))
    f = f.select(STACK, FRAME, "feature_id", "o", "s",
                 keep(F.col("x") - F.col("s") * F.col("ny") + F.col("o") * F.col("nx"), "_w").alias("sx"),
                 keep(F.col("y") + F.col("s") * F.col("nx") + F.col("o") * F.col("ny"), "_h").alias("sy"))
    r = rs.remap(px, f, [v], side=side, how="inner")
    mean = r.groupBy(STACK, "feature_id", FRAME, "o").agg(F.avg(v).alias("m"))
    return mean.groupBy(STACK, "feature_id", FRAME).agg(
        F.map_from_entries(F.collect_list(F.struct("o", "m"))).alias("_m")).select(
        STACK, "feature_id", FRAME, F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda o: F.try_element_at("_m", o)).alias("profile"))


_PEAK = T.StructType([T.StructField("shift", T.DoubleType()), T.StructField("score", T.DoubleType())])


@F.pandas_udf(_PEAK)
def _best_lag(left: pd.Series, right: pd.Series, size: pd.Series) -> pd.DataFrame:
    """All lags of a batch of profile pairs at once; NaN stands for NULL."""
    n = int(size.iloc[0]) if len(size) else 2

    def table(side):
        out = np.full((len(side), n), np.nan)
        for i, p in enumerate(side):
            if p is not None:
                out[i, :len(p)] = p
        return out

    def slopes(p):  # one-sided at the ends
        return np.concatenate([p[:, 1:2] - p[:, :1], (p[:, 2:] - p[:, :-2]) / 2, p[:, -1:] - p[:, -2:-1]], axis=1)

    def dots(p, q):  # sums of the products that exist
        both = p * q
        return np.where(np.isnan(both).all(axis=1), np.nan, np.nansum(both, axis=1))

    def known(v):
        return pd.Series(v).astype(object).where(~np.isnan(v), None)

    with np.errstate(invalid="ignore"):
        a, b = table(left), table(right)
        ga, gb = slopes(a), slopes(b)
        den = np.sqrt(dots(ga, ga) * dots(gb, gb)) + 1e-12
        corr, met = np.empty((len(a), 2 * n - 1)), np.empty((len(a), 2 * n - 1), bool)
        for i, k in enumerate(range(1 - n, n)):  # sum over j of a[j] · b[j + k]
            head, tail = slice(max(0, -k), n - max(0, k)), slice(max(0, k), n - max(0, -k))
            met[:, i] = ~(np.isnan(a[:, head]) | np.isnan(b[:, tail])).all(axis=1)
            corr[:, i] = np.where(met[:, i], np.round(dots(ga[:, head], gb[:, tail]) / den, 9), np.nan)
        at = np.argmax(np.where(np.isnan(corr), np.where(met, -2.0, -3.0), corr), axis=1)  # of equal ones the first lag
        row = np.arange(len(a))
        peak, before, after = corr[row, at], corr[row, np.maximum(at - 1, 0)], corr[row, np.minimum(at + 1, 2 * n - 2)]
        curve = before - 2 * peak + after
        bent = (at > 0) & (at < 2 * n - 2) & (np.abs(curve) > 1e-9)
        offset = np.where(bent, np.clip(0.5 * (before - after) / np.where(bent, curve, 1.0), -0.5, 0.5), 0.0)
        shift = np.where(met.any(axis=1), at + 1 - n + offset, np.nan)
    return pd.DataFrame({"shift": known(shift), "score": known(peak)})


def match(pairs: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """Shift of profile ``b`` against ``a`` at the correlation peak, with sub-sample parabola, and the peak height.

    Entries that are NULL on either side take no part; a lag under which no two entries meet is none. Expressions over the
    arrays of a pair would be interpreted, some thousand calls for each pair; a batch of pairs is a table of numbers.
    """
    m = pairs.withColumn("_m", _best_lag(F.col(a), F.col(b), F.lit(n)))
    return m.withColumns({"shift": F.col("_m.shift"), "score": F.col("_m.score")}).drop("_m")


def measure(px: DataFrame, features: DataFrame, reference: int, half: int = 28, span: int = 24, v: str = "v", side: int = SIDE) -> DataFrame:
    """Shift of every feature in every other frame against the reference; weak and far matches are absent rows."""
    p = profiles(px, features, half, span, v, side)
    base = p.filter(F.col(FRAME) == reference).select(STACK, "feature_id", F.col("profile").alias("_base"))
    m = match(p.filter(F.col(FRAME) != reference).join(base, [STACK, "feature_id"]), "_base", "profile", 2 * half + 1)
    return confident(m.select(STACK, "feature_id", FRAME, "shift", "score"))


def confident(m: DataFrame, peak: float = MIN_PEAK, limit: float = MAX_SHIFT) -> DataFrame:
    return m.filter((F.col("score") >= peak) & (F.abs("shift") < limit))


def residuals(m: DataFrame, motion: DataFrame, by: Sequence[str] = (STACK,), least: int = MIN_FRAMES) -> DataFrame:
    """RMS distance of each feature's shifts from a motion (mx, my per frame), over at least ``least`` frames."""
    j = attach(m, motion.select(*by, FRAME, "mx", "my"), [*by, FRAME])
    e = F.col("mx") * F.col("nx") + F.col("my") * F.col("ny") - F.col("shift")
    g = j.groupBy(*by, "feature_id", "nx", "ny").agg(F.sqrt(F.avg(e * e)).alias("rms"), F.count("*").alias("frames"))
    return g.filter(F.col("frames") >= least)


def consensus(res: DataFrame, motion: DataFrame, by: Sequence[str] = (STACK,), inlier: float = INLIER) -> DataFrame:
    """Features that agree with a motion and, when the group really moves, can see it along their normal."""
    mag = motion.groupBy(*by).agg(
        F.max(F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))).alias("_mag"),
        F.collect_list(F.struct("mx", "my")).alias("_m"))  # one entry per frame
    at = lambda c: F.round(c, 9)  # what lies exactly on a limit is decided the same in whatever order sums ran
    j = attach(res.filter(at("rms") < inlier), mag, by)
    seen = F.array_max(F.transform("_m", lambda m: F.abs(m["mx"] * F.col("nx") + m["my"] * F.col("ny"))))
    return j.withColumn("seen", seen).filter((at("_mag") < inlier) | (at("seen") >= inlier)).drop("_mag", "_m")


def group_motion(m: DataFrame, focal: DataFrame, frames: DataFrame, by: Sequence[str], support: float = 4.0) -> DataFrame:
    """Focal-weighted translation per frame, propagated through frames the group cannot see."""
    j = attach(m, focal.select(STACK, "feature_id", "focal"), [STACK, "feature_id"])
    w = j.withColumn("_w", F.col("score") * rk.focal_weight(FRAME, "focal"))
    fit = sa.normal_translation(w, [*by, FRAME], "_w").filter("n >= 3 AND mx IS NOT NULL")
    return rk.propagate(fit, by, ["mx", "my"], "weight", support, frames)


def screen(m: DataFrame, predicted: DataFrame, by: Sequence[str] = (STACK,), px_limit: float = 2.0, count: int = 4) -> DataFrame:
    """Stacks with at least ``count`` features whose shift disagrees with the prediction; gates the costly plan."""
    j = attach(m, predicted, [*by, FRAME]).withColumn("_d", F.abs(F.col("shift") - (F.col("mx") * F.col("nx") + F.col("my") * F.col("ny"))))
    bad = j.filter(F.col("_d") > px_limit).select(*by, "feature_id").distinct()
    return bad.groupBy(*by).agg(F.count("*").alias("disagreeing")).filter(F.col("disagreeing") >= count)


def elect(m: DataFrame, members: DataFrame, predicted: DataFrame, areas: DataFrame, by: Sequence[str], limit: float = 5.0, share: float = 0.35) -> DataFrame:
    """Groups whose median disagreement with the prediction reaches the limit in some frame and whose hull is compact."""
    j = attach(m.join(members, [STACK, "feature_id"]), predicted, [STACK, FRAME])
    j = j.withColumn("_d", F.abs(F.col("shift") - (F.col("mx") * F.col("nx") + F.col("my") * F.col("ny"))))
    med = exact_quantiles(j, [*by, FRAME], "_d", {"_m": 0.5}).groupBy(*by).agg(F.max("_m").alias("disagreement"))
    return med.join(areas.select(*by, "share"), list(by)).withColumn("elected", (F.col("disagreement") >= limit) & (F.col("share") <= share))


def claims(support: DataFrame, by: Sequence[str] = (STACK, Y, X), sharpness: float = 6.0, full: float = 0.45) -> DataFrame:
    """Share^6 of each group's support per pixel times the strength of the strongest claim."""
    w = Window.partitionBy(*by)
    s = F.greatest(F.col("support"), F.lit(0.0))
    d = support.withColumn("_peak", F.max(s).over(w))
    d = d.withColumn("_sharp", F.when(F.col("_peak") > 1e-6, F.pow(s / F.greatest("_peak", F.lit(1e-6)), F.lit(sharpness))).otherwise(F.lit(0.0)))
    total = F.sum("_sharp").over(w)
    claim = F.least(F.lit(1.0), F.col("_peak") / full)
    return d.withColumn("claim", F.when(total > 1e-6, F.col("_sharp") / F.greatest(total, F.lit(1e-6))).otherwise(F.lit(0.0)) * claim).drop("_peak", "_sharp")


def unexplained(points: DataFrame, owned: DataFrame, motion: DataFrame, weight: float = 0.9, near: float = 3.0) -> DataFrame:
    """Disagreeing points no owner explains: nobody owns the pixel, or the owner's motion differs from the point's shift."""
    o = owned.filter(F.col("claim") >= weight).select(STACK, F.col(Y).alias("_iy"), F.col(X).alias("_ix"), "group_id")
    m = motion.select(STACK, "group_id", FRAME, "mx", "my")
    p = points.withColumns({"_iy": F.rint("y").cast("int"), "_ix": F.rint("x").cast("int")})
    ok = p.join(o, [STACK, "_iy", "_ix"]).join(m, [STACK, "group_id", FRAME]).filter(
        F.abs(F.col("shift") - (F.col("mx") * F.col("nx") + F.col("my") * F.col("ny"))) < near)
    return p.join(ok.select(STACK, "feature_id", FRAME).distinct(), [STACK, "feature_id", FRAME], "left_anti").drop("_iy", "_ix")


def robust_translation(m: DataFrame, by: Sequence[str], weight: str = "wt", passes: int = 3, least: int = MIN_FEATURES, total: float = MIN_WEIGHT) -> DataFrame:
    """Reweighted translation from normal shifts with observability eigenvalues and raw weighted RMS."""
    from sharpfleet.runtime import cut
    by = list(by)
    d = m.filter(F.col(weight) > 1e-3)
    base = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), F.sqrt(F.sum(F.col(weight) * F.col("shift") * F.col("shift")) / F.sum(weight)).alias("rms"))
    ok = cut(base.filter((F.col("n") >= least) & (F.col("weight") >= total)))
    cur = attach(d, ok.select(*by), by).withColumn("_w", F.col(weight))
    fit = None
    for _ in range(passes):
        fit = cut(sa.normal_translation(cur, by, "_w").select(*by, "mx", "my"))
        r = attach(attach(d, ok.select(*by), by), fit, by)
        r = r.withColumn("_r", F.abs(F.col("mx") * F.col("nx") + F.col("my") * F.col("ny") - F.col("shift")))
        med = cut(exact_quantiles(r, by, "_r", {"_med": 0.5}))
        cutoff = F.greatest(F.col("_med") * 2.5, F.lit(0.5))
        cur = attach(r, med, by).withColumn("_w", F.col(weight) * F.least(F.lit(1.0), cutoff / F.greatest("_r", F.lit(1e-9)))).drop("_r", "_med", "mx", "my")
    w, nx, ny = F.col("_w"), F.col("nx"), F.col("ny")
    mom = cur.groupBy(*by).agg(F.sum(w * nx * nx).alias("_a"), F.sum(w * nx * ny).alias("_b"), F.sum(w * ny * ny).alias("_c")).join(ok, by)
    t = F.greatest("weight", F.lit(1e-9))
    lo, hi = eigen2(F.col("_a") / t, F.col("_b") / t, F.col("_c") / t)
    out = mom.withColumns({"xx": F.col("_a") / t, "xy": F.col("_b") / t, "yy": F.col("_c") / t, "eig_low": lo, "eig_high": hi})
    return out.drop("_a", "_b", "_c").join(fit, by)


def observable_norm(fit: DataFrame, seen: float = GATE_SEEN) -> DataFrame:
    """Length of the translation counted along the directions that some normals point at."""
    # eigenvector of the larger value of [[xx, xy], [xy, yy]]; for a diagonal matrix the longer axis
    ux = F.when(F.abs("xy") > 1e-12, F.col("eig_high") - F.col("yy")).otherwise((F.col("xx") >= F.col("yy")).cast("double"))
    uy = F.when(F.abs("xy") > 1e-12, F.col("xy")).otherwise((F.col("xx") < F.col("yy")).cast("double"))
    length = F.sqrt(ux * ux + uy * uy)
    along, across = (F.col("mx") * ux + F.col("my") * uy) / length, (F.col("my") * ux - F.col("mx") * uy) / length
    kept = F.when(F.col("eig_high") >= seen, along * along).otherwise(F.lit(0.0)) + F.when(F.col("eig_low") >= seen, across * across).otherwise(F.lit(0.0))
    return fit.withColumn("residual", F.sqrt(kept))


def gate(fit: DataFrame, tol: float = GATE_TOL, weight: float = GATE_WEIGHT, seen: float = GATE_SEEN) -> DataFrame:
    """Verified, contradicted or unverifiable, and why."""
    d = observable_norm(fit, seen)
    status = (F.when(F.col("mx").isNull(), "unverifiable").when(F.col("weight") < weight, "unverifiable")
              .when(F.col("residual") <= tol, "verified").otherwise("contradicted"))
    reason = (F.when(F.col("mx").isNull(), "no edge support").when(F.col("weight") < weight, "thin support")
              .when(F.col("eig_low") < seen, "one axis only").otherwise("both axes"))
    return d.withColumns({"status": status, "reason": reason})


def within(features: DataFrame, seeds: DataFrame, radius: float, by: Sequence[str] = (STACK,)) -> DataFrame:
    """Features closer than ``radius`` to a seed (seed_id, sx, sy; few seeds per key), through 3×3 buckets of that size."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    s = seeds.withColumn("_cy", F.explode(F.sequence(cell("sy") - 1, cell("sy") + 1))).withColumn("_cx", F.explode(F.sequence(cell("sx") - 1, cell("sx") + 1)))
    f = features.withColumns({"_cy": cell("y"), "_cx": cell("x")})
    j = f.join(s, [*by, "_cy", "_cx"]).drop("_cy", "_cx")
    return j.filter((F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy")) < radius * radius)


def attach_chain(features: DataFrame, members: DataFrame, radius: float, by: Sequence[str] = (STACK,), rounds: int | None = None) -> DataFrame:
    """Features reached from the members by steps shorter than ``radius``: a semi-join per round, until nothing is added (or for
    as many ``rounds`` as asked for).

    A feature only asks whether any member lies near, so no pair is kept. Members count once per position:
    features sit on pixels, so a bucket of that side holds at most radius² different positions.
    """
    from sharpfleet.runtime import cut
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    rest = cut(features.join(members.select(*by, "feature_id"), [*by, "feature_id"], "left_anti").withColumns({"_cy": cell("y"), "_cx": cell("x")}))
    found, front = members.select(*by, "feature_id", "x", "y"), members.select(*by, "feature_id", "x", "y")
    while rounds is None or rounds > 0:
        rounds = rounds and rounds - 1
        probe = front.select(*by, F.col("x").alias("sx"), F.col("y").alias("sy")).distinct()
        probe = probe.withColumn("_cy", F.explode(F.sequence(cell("sy") - 1, cell("sy") + 1))).withColumn("_cx", F.explode(F.sequence(cell("sx") - 1, cell("sx") + 1)))
        near = (F.col("r.x") - F.col("p.sx")) * (F.col("r.x") - F.col("p.sx")) + (F.col("r.y") - F.col("p.sy")) * (F.col("r.y") - F.col("p.sy")) < radius * radius
        on = [F.col(f"r.{c}") == F.col(f"p.{c}") for c in (*by, "_cy", "_cx")]
        hit = cut(rest.alias("r").join(probe.alias("p"), [*on, near], "left_semi").select(*by, "feature_id", "x", "y"))
        if hit.isEmpty():
            break
        found = found.unionByName(hit)
        front, rest = hit, rest.join(hit.select(*by, "feature_id"), [*by, "feature_id"], "left_anti")
    return found


def grow(m: DataFrame, motion: DataFrame, members: DataFrame, radius: float, near: float = 3.0, peak: float = 0.5, reach: float = 40.0, rounds: int | None = None) -> DataFrame:
    """Coverage of a group: features that move with it, reached from its members in steps shorter than ``radius``.

    A frame speaks for a feature when its match is good enough (score, shift) and the group's motion along the normal
    is at least ``near``, so that the edge could show it; one such frame that agrees is enough, others do not veto.
    """
    j = attach(m, motion.select(STACK, FRAME, "mx", "my"), [STACK, FRAME])
    told = F.col("mx") * F.col("nx") + F.col("my") * F.col("ny")
    agrees = (F.col("score") >= peak) & (F.abs("shift") <= reach) & (F.abs(told) >= near) & (F.abs(F.col("shift") - told) < near)
    fit = j.filter(agrees).select(STACK, "feature_id", "x", "y").distinct()
    return attach_chain(fit, members, radius, rounds=rounds)


def _fits(m: DataFrame, members: DataFrame, by: Sequence[str], least: int = 4) -> DataFrame:
    """Translation of every set of members (``by`` and feature_id) in each frame that ``least`` of them see."""
    on = [c for c in by if c in m.columns] + ["feature_id"]
    fit = sa.normal_translation(m.join(members.select(*by, "feature_id"), on), [*by, FRAME])
    return fit.filter((F.col("n") >= least) & F.col("mx").isNotNull()).select(*by, FRAME, "mx", "my")


def _residuals_of(m: DataFrame, motion: DataFrame, by: Sequence[str]) -> DataFrame:
    """Residual of every feature under each of its stack's motions, which are cut; a stack has few of them."""
    j = attach_few(m, motion, [STACK, FRAME])
    e = F.col("mx") * F.col("nx") + F.col("my") * F.col("ny") - F.col("shift")
    return j.groupBy(*by, "feature_id", "nx", "ny").agg(F.sqrt(F.avg(e * e)).alias("rms"), F.count("*").alias("frames")).filter(F.col("frames") >= MIN_FRAMES)


def consensus_groups(m: DataFrame, rounds: int = 6, seeds: int = SEEDS, near: float = NEAR, least: int = MIN_GROUP, inlier: float = INLIER, reach: float = JOIN) -> DataFrame:
    """Groups of features that one translation per frame explains: stack_id, group_id (in the order found), feature_id, ``informative``.

    ``m``: stack_id, feature_id, frame, x, y, nx, ny, shift. A round fits a motion around every n/``seeds``-th feature of
    what is left (n features, so at most twice ``seeds`` fits), all of all stacks at once. The fit with the most features that
    agree and can see it makes the group; features that agree but can't see the motion join next to one that can. The
    group leaves the pool before the next round. A stack is done when no fit finds ``least`` features.
    """
    from sharpfleet.runtime import cut, shared
    m = shared(m)  # measures are an aggregate, every round reads them several times
    pool = cut(m.select(STACK, "feature_id", "x", "y").distinct())
    found, by = None, [STACK, "seed_id"]
    for k in range(rounds):
        size = pool.groupBy(STACK).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
        p = attach(rk.places(pool, [STACK], "feature_id"), size, [STACK])
        step = F.greatest(F.lit(1), F.floor(F.col("_n") / seeds))
        at = p.filter(F.col("place") % step == 0).select(STACK, F.col("feature_id").alias("seed_id"), F.col("x").alias("sx"), F.col("y").alias("sy"))
        own = m.join(pool.select(STACK, "feature_id"), [STACK, "feature_id"], "left_semi")
        around = within(p.select(STACK, "feature_id", "x", "y"), at, near).select(*by, "feature_id")
        enough = around.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(*by)
        motion = cut(_fits(own, around.join(enough, by), by))
        agree = cut(consensus(_residuals_of(own, motion, by), motion, by, inlier).select(*by, "feature_id"))
        count = agree.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
        best = count.groupBy(STACK).agg((-F.max(F.struct("_n", (-F.col("seed_id")).alias("s")))["s"]).alias("seed_id"))
        core = cut(agree.join(best, by).select(STACK, "feature_id"))
        if core.isEmpty():
            break
        res = _residuals_of(own, cut(_fits(own, core, [STACK])), [STACK]).filter(F.round("rms", 9) < inlier).select(STACK, "feature_id")
        spots = lambda ids: pool.join(ids, [STACK, "feature_id"], "left_semi")
        group = attach_chain(spots(res), spots(core), reach, rounds=1).select(STACK, "feature_id")
        group = group.join(core.withColumn("_core", F.lit(True)), [STACK, "feature_id"], "left")
        group = cut(group.select(STACK, F.lit(k).alias("group_id"), "feature_id", F.col("_core").isNotNull().alias("informative")))
        found = group if found is None else found.unionByName(group)
        pool = cut(pool.join(group.select(STACK, "feature_id"), [STACK, "feature_id"], "left_anti"))
    if found is None:
        found = pool.limit(0).select(STACK, F.lit(0).alias("group_id"), "feature_id", F.lit(False).alias("informative"))
    return found
