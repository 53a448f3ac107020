"""Ranking, greedy selection, histogram splits and runs."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharpfleet.functions.columns import col, first_max
from sharpfleet.functions.taps import gaussian_taps
from sharpfleet.operators.grid import BLK, FRAME, SIDE, STACK, X, Y, attach, idiv
from sharpfleet.runtime import shared


def top_k(df: DataFrame, by: Sequence[str], score: str, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def best_per(df: DataFrame, by: Sequence[str], score: str, tie: str, payload: Sequence[str] = ()) -> DataFrame:
    """Row with the largest score per key (lowest ``tie`` first), by partial aggregation."""
    g = df.groupBy(*by).agg(F.max_by(F.struct(tie, score, *payload), F.struct(F.col(score), -F.col(tie))).alias("_b"))
    return g.select(*by, "_b.*")


def greedy_distinct(cands: DataFrame, conflicts: DataFrame, by: Sequence[str], member: str, score: str, k: int) -> DataFrame:
    """Greedy selection by score: a candidate is dropped if it conflicts with one already kept; at most ``k`` per key.

    ``conflicts`` lists (a, b) pairs. A key holds at most a few dozen candidates per frame, so its
    ranking fits one array.
    """
    c = conflicts.select(*by, F.col("a").alias(member), F.col("b").alias("_o")).union(
        conflicts.select(*by, F.col("b").alias(member), F.col("a").alias("_o")))
    c = c.groupBy(*by, member).agg(F.collect_set("_o").alias("_x"))
    d = cands.join(c, [*by, member], "left").withColumn("_x", F.coalesce("_x", F.slice(F.array(F.col(member)), 1, 0)))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(member).alias("m"), F.col("_x").alias("x"))))
    d = d.groupBy(*by).agg(ranked.alias("_r"))
    none = F.slice(F.transform("_r", lambda e: e["m"]), 1, 0)
    keep = F.aggregate("_r", none, lambda acc, e: F.when(
        (F.size(acc) < k) & ~F.arrays_overlap(acc, e["x"]), F.concat(acc, F.array(e["m"]))).otherwise(acc))
    return d.select(*by, F.posexplode(keep).alias("place", member)).withColumn("place", F.col("place") + 1)


def heat_maxima(heat: DataFrame, v: str, k: int, half: int) -> DataFrame:
    """k strongest pixels per stack, each suppressing the square of ±half around it (ties: lowest y, then x)."""
    heat, out = shared(heat.select(STACK, Y, X, v)), None
    rest = heat
    for i in range(k):
        key = F.struct(F.col(v), -F.col(Y), -F.col(X))
        best = shared(rest.groupBy(STACK).agg(F.max_by(F.struct(Y, X, v), key).alias("_b")).select(
            STACK, F.lit(i).alias("round"), "_b.*"))
        out = best if out is None else out.unionByName(best)
        spot = best.select(STACK, F.col(Y).alias("_by"), F.col(X).alias("_bx"))
        rest = attach(rest, spot, [STACK], "left").filter(
            F.col("_by").isNull() | (F.abs(F.col(Y) - F.col("_by")) > half) | (F.abs(F.col(X) - F.col("_bx")) > half)).drop("_by", "_bx")
    return out


def smooth_histogram(hist: DataFrame, by: Sequence[str], bins: int, sigma: float = 2.0, radius: int = 4) -> DataFrame:
    """Complete histogram (empty bins as 0) and its Gaussian-smoothed counts; (key, bin) rows, bins bounded."""
    grid = hist.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    d = grid.join(hist, [*by, "bin"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    w, terms = Window.partitionBy(*by).orderBy("bin"), []
    for k, t in enumerate(gaussian_taps(sigma, radius)):
        o, m = k - radius, abs(k - radius)
        at = lambda n: F.col("weight") if n == 0 else F.lead("weight", n).over(w) if n > 0 else F.lag("weight", -n).over(w)
        dist, sign = (F.lit(bins - 1) - F.col("bin"), 1) if o > 0 else (F.col("bin"), -1)
        e = None
        for p in range(m):
            v = at(-sign * (m - 2 * p))
            e = F.when(dist == p, v) if e is None else e.when(dist == p, v)
        terms.append(F.lit(t) * (at(o) if e is None else e.otherwise(at(o))))
    return d.withColumn("smooth", sum(terms[1:], terms[0]))


def running_extremes(hist: DataFrame, by: Sequence[str], v: str = "smooth") -> DataFrame:
    """Largest value strictly left and strictly right of every bin, and the running total."""
    w = Window.partitionBy(*by).orderBy("bin")
    return hist.withColumns({
        "left_max": F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "right_max": F.max(v).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "running": F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def valleys(hist: DataFrame, by: Sequence[str], bins: int, keep: int) -> DataFrame:
    """Most prominent inner minima of the smoothed histogram, at most ``keep`` per key."""
    w = Window.partitionBy(*by).orderBy("bin")
    d = running_extremes(smooth_histogram(hist, by, bins), by).withColumns({"_a": F.lag("smooth").over(w), "_c": F.lead("smooth").over(w)})
    d = d.withColumn("prominence", F.round(F.least("left_max", "right_max") - F.col("smooth"), 9))
    d = d.filter((F.col("smooth") <= F.col("_a")) & (F.col("smooth") <= F.col("_c")) & (F.col("prominence") > 0))
    r = Window.partitionBy(*by).orderBy(F.desc("prominence"), F.desc("bin"))
    return d.withColumn("place", F.row_number().over(r)).filter(F.col("place") <= keep).select(*by, "bin", "prominence", "place")


def otsu_split(hist: DataFrame, by: Sequence[str], centre: Column, least: float = 0.12) -> DataFrame:
    """Best two-way split of a weighted histogram and the share of variance it explains; both sides need ``least`` weight.

    ``hist``: key, bin, weight; ``centre``: bin centre as an expression of ``bin``.
    """
    whole = Window.partitionBy(*by)
    run = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    d = hist.withColumns({"_x": centre, "_p": F.try_divide("weight", F.sum("weight").over(whole))})  # nothing to split without weight
    d = d.withColumns({"_mean": F.sum(F.col("_p") * F.col("_x")).over(whole), "_next": F.lead("_x").over(whole.orderBy("bin"))})
    d = d.withColumns({
        "_var": F.sum(F.col("_p") * (F.col("_x") - F.col("_mean")) * (F.col("_x") - F.col("_mean"))).over(whole),
        "_w0": F.sum("_p").over(run), "_m0": F.sum(F.col("_p") * F.col("_x")).over(run)})
    w1 = 1 - F.col("_w0")
    gap = F.col("_m0") / F.col("_w0") - (F.col("_mean") - F.col("_m0")) / w1
    d = d.filter((F.col("_w0") >= least) & (w1 >= least) & (F.col("_var") >= 1e-9) & F.col("_next").isNotNull())
    d = d.withColumn("quality", F.round(F.col("_w0") * w1 * gap * gap / F.col("_var"), 9))
    return d.groupBy(*by).agg(F.max_by((F.col("_x") + F.col("_next")) / 2, F.struct(F.col("quality"), -F.col("bin"))).alias("threshold"), F.max("quality").alias("quality"))


def otsu_ladder(hist: DataFrame, by: Sequence[str], centre: Column, rounds: int = 3, quality: float = 0.45, least: float = 0.12) -> DataFrame:
    """Recursive splits: each open segment is split where the split explains enough variance; (key, segment, bin, weight)."""
    d = hist.withColumn("segment", F.lit(0))
    for _ in range(rounds):
        cut = otsu_split(d, [*by, "segment"], centre, least).filter(F.col("quality") >= quality).select(*by, "segment", "threshold")
        d = d.join(cut, [*by, "segment"], "left")
        d = d.withColumn("segment", F.col("segment") * 2 + F.when(F.col("threshold").isNotNull() & (centre > F.col("threshold")), 1).otherwise(0)).drop("threshold")
    order = F.dense_rank().over(Window.partitionBy(*by).orderBy("segment")) - 1
    return d.withColumn("layer", order).drop("segment")


def column_runs(px: DataFrame, mask: str) -> DataFrame:
    """Height of the run of set pixels that ends at each pixel, going down its column."""
    w = Window.partitionBy(STACK, X).orderBy(Y)
    last_gap = F.max(F.when(~F.col(mask), F.col(Y))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return px.withColumn("run", F.when(F.col(mask), F.col(Y) - F.coalesce(last_gap, F.lit(-1))).otherwise(F.lit(0)))


_RECTANGLE = T.StructType([T.StructField("area", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("x0", "x1", "height")]])


def _not_lower(bars: np.ndarray) -> np.ndarray:
    """For every bar of every row: how many bars right before it are at least as high. Minima of 2^k bars decide 2^k steps at once."""
    low, size = [bars], 1
    while 2 * size <= bars.shape[1]:
        low.append(np.minimum(low[-1][:, : bars.shape[1] - 2 * size + 1], low[-1][:, size : bars.shape[1] - size + 1]))
        size *= 2
    row, count = np.arange(len(bars))[:, None], np.zeros(bars.shape, np.int64)
    place = np.arange(bars.shape[1])[None, :]
    for k in range(len(low) - 1, -1, -1):
        start = place - count - (1 << k)
        count += (1 << k) * ((start >= 0) & (low[k][row, np.maximum(start, 0)] >= bars))
    return count


@F.pandas_udf(_RECTANGLE)
def _widest(rows: pd.Series) -> pd.DataFrame:
    """The largest rectangle under each row of bars: every bar is as wide as the bars on both sides that are not lower; the leftmost of equal ones."""
    bars = np.zeros((len(rows), max([1, *map(len, rows)])), np.int64)
    for i, r in enumerate(rows):
        bars[i, : len(r)] = r
    before, after = _not_lower(bars), _not_lower(bars[:, ::-1])[:, ::-1]
    area = bars * (before + after + 1)
    x = area.argmax(1)
    row = np.arange(len(rows))
    x0, x1 = x - before[row, x], x + after[row, x] + 1
    full = area[row, x] > 0
    return pd.DataFrame({"area": area[row, x], "x0": np.where(full, x0, 0), "x1": np.where(full, x1, 0), "height": bars[row, x]}).astype({"x0": "int32", "x1": "int32", "height": "int32"})


def largest_rectangle(px: DataFrame, mask: str) -> DataFrame:
    """Largest all-set rectangle per stack (y0, x0, y1, x1; ends exclusive), first met in scan order.

    Every image line is one array of run heights; the best rectangle ending on that line comes from
    the bars' widths, then the lines compete.
    """
    rows = column_runs(px, mask).groupBy(STACK, Y).agg(F.sort_array(F.collect_list(F.struct(X, "run"))).alias("_l"))
    rows = rows.select(STACK, Y, _widest(F.transform("_l", lambda e: e["run"])).alias("_r"))
    best = rows.groupBy(STACK).agg(F.max_by(F.struct(Y, "_r"), F.struct(F.col("_r.area"), -F.col(Y))).alias("_b"))
    y1 = F.col(f"_b.{Y}") + 1
    return best.select(STACK, (y1 - F.col("_b._r.height")).alias("y0"), F.col("_b._r.x0").alias("x0"), y1.alias("y1"), F.col("_b._r.x1").alias("x1"), F.col("_b._r.area").alias("area"))


def propagate(motion: DataFrame, by: Sequence[str], values: Sequence[str], support: str, least: float, frames: DataFrame, near: int = 4) -> DataFrame:
    """Trusted frames keep their values; the others take a line through their nearest trusted frames (two at least).

    ``frames``: key and frame of every wanted row; a key holds only its frames, so the pairing is bounded.
    """
    good = motion.filter(F.col(support) >= least).select(*by, F.col(FRAME).alias("_f"), *values)
    pair = frames.select(*by, FRAME).join(good, list(by))
    w = Window.partitionBy(*by, FRAME).orderBy(F.abs(F.col("_f") - F.col(FRAME)), "_f")
    pair = pair.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= near)
    own = {v: F.max(F.when(F.col("_f") == F.col(FRAME), F.col(v))) for v in values}
    line = {v: F.when(F.count("*") >= 2, F.regr_slope(F.col(v), F.col("_f")) * F.first(FRAME) + F.regr_intercept(F.col(v), F.col("_f"))) for v in values}
    g = pair.groupBy(*by, FRAME).agg(
        *[F.coalesce(own[v], line[v]).alias(v) for v in values], F.max(F.col("_f") == F.col(FRAME)).alias("trusted"))
    return g.filter(F.col(values[0]).isNotNull())


def mirror_frames(frames: DataFrame, peaks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs of different frames that lie symmetric about a focal peak (half to even), lower frame first."""
    j = frames.join(peaks, list(by)).withColumn("mirror", F.rint(2 * F.col("peak") - F.col(FRAME)).cast("int"))
    other = frames.select(*by, F.col(FRAME).alias("mirror"))
    return j.join(other, [*by, "mirror"]).filter(F.col(FRAME) < F.col("mirror")).select(*by, FRAME, "mirror")


def focal_weight(frame, focal, sigma: float = 2.5) -> Column:
    u = (col(frame) - col(focal)) / sigma
    return F.exp(-0.5 * u * u)


def travel_order(pieces: DataFrame, by: Sequence[str], travel: str, tolerance: float) -> DataFrame:
    """Occlusion rank by travel, farthest mover first; neighbours in the ranking closer than the tolerance share a group."""
    w = Window.partitionBy(*by).orderBy(F.desc(travel), "piece")
    gap = F.coalesce((F.lag(travel).over(w) - F.col(travel) > tolerance).cast("int"), F.lit(0))
    d = pieces.withColumns({"rank": F.row_number().over(w), "_gap": gap})
    return d.withColumn("group", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def places(df: DataFrame, by: Sequence[str], order: str, out: str = "place") -> DataFrame:
    """Place of every row within its key, from 0, in the order of a column that is unique there.

    Rows are sorted in ranges, so a key with most of the rows spreads over many tasks; the driver sees one count per range.
    """
    from sharpfleet.operators.grid import attach
    from sharpfleet.runtime import cut
    d = cut(df.repartitionByRange(*by, order).sortWithinPartitions(*by, order).withColumn("_id", F.monotonically_increasing_id()))
    part, before, total = F.shiftright("_id", 33), [], 0
    for r in d.groupBy(part.alias("part")).count().orderBy("part").collect():
        before += [F.lit(r["part"]).cast("long"), F.lit(total).cast("long")]
        total += r["count"]
    start = F.element_at(F.create_map(*before), part) if before else F.lit(0).cast("long")
    d = d.withColumn(out, start + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    first = d.groupBy(*by).agg(F.min(out).alias("_first"))
    return attach(d, first, list(by)).withColumn(out, F.col(out) - F.col("_first")).drop("_first")
