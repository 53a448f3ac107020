"""Set operations and overlaps of sparse masks (one row per set pixel)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharpfleet.operators.grid import BLK, FRAME, SIDE, STACK, X, Y, blocked, line

PX = (STACK, Y, X)


def intersection_over_frames(mask: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels set in every frame of their stack; ``frames``: stack_id, n."""
    n = mask.groupBy(*PX).agg(F.countDistinct(FRAME).alias("_c"))
    return n.join(frames, STACK).filter(F.col("_c") == F.col("n")).select(*PX)


def union_of(*masks: DataFrame, on: Sequence[str] = PX) -> DataFrame:
    out = masks[0].select(*on)
    for m in masks[1:]:
        out = out.union(m.select(*on))
    return out.distinct()


def difference(a: DataFrame, b: DataFrame, on: Sequence[str] = PX) -> DataFrame:
    return a.join(b.select(*on), list(on), "left_anti")


def vote(masks: DataFrame, member: str, share: float = 0.75, by: Sequence[str] = (STACK,)) -> DataFrame:
    """Pixels that at least ``share`` of the masks of their group cover."""
    n = masks.groupBy(*by).agg(F.countDistinct(member).alias("_n"))
    c = masks.groupBy(*by, Y, X).agg(F.countDistinct(member).alias("votes"))
    return c.join(n, list(by)).filter(F.col("votes") >= share * F.col("_n")).select(*by, Y, X, "votes")


def agreement(a: DataFrame, b: DataFrame, by: Sequence[str] = (STACK,)) -> DataFrame:
    """Intersection, union, IoU, precision (of a) and recall (of b) per key."""
    on = [*by, Y, X]
    j = a.select(*on, F.lit(1).alias("_a")).join(b.select(*on, F.lit(1).alias("_b")), on, "full_outer")
    g = j.groupBy(*by).agg(F.count("*").alias("union"), F.count("_a").alias("area_a"), F.count("_b").alias("area_b"), F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)).alias("both"))
    safe = lambda n: F.when(F.col(n) > 0, F.col(n))
    return g.withColumns({"iou": F.col("both") / F.col("union"), "precision": F.col("both") / safe("area_a"), "recall": F.col("both") / safe("area_b")})


def contingency(df: DataFrame, label: str, truth: str, by: Sequence[str] = (STACK,)) -> DataFrame:
    """Per true class: its pixels, and the shares owned by labels whose majority is this class or another one."""
    c = df.groupBy(*by, truth, label).agg(F.count("*").alias("_n"))
    best = F.max(F.struct(F.col("_n").alias("n"), (-F.col(truth)).alias("t"))).over(Window.partitionBy(*by, label))
    c = c.withColumn("_own", -best["t"])
    share = lambda cond: F.sum(F.when(F.col(label).isNotNull() & cond, F.col("_n")).otherwise(0)) / F.sum("_n")
    return c.groupBy(*by, truth).agg(
        F.sum("_n").alias("pixels"), share(F.col("_own") == F.col(truth)).alias("claimed_right"), share(F.col("_own") != F.col(truth)).alias("claimed_wrong"))


def subset_violations(inner: DataFrame, outer: DataFrame, on: Sequence[str] = PX) -> DataFrame:
    """Pixels of ``inner`` outside ``outer`` counted per stack; a subset has no rows."""
    return difference(inner, outer, on).groupBy(STACK).agg(F.count("*").alias("outside"))


def overlaps(a: DataFrame, b: DataFrame, by: Sequence[str] = (STACK,), ida: str = "mask_id", idb: str = "mask_id", same: bool = False) -> DataFrame:
    """Pairs of masks that share a pixel: intersection, IoU and containment both ways.

    A pixel carries at most the few dozen masks a segmenter gives per frame, so the pixel equi-join stays
    linear. With ``same`` both sides are one relation and only pairs a < b are kept.
    """
    on = [*by, Y, X]
    left, right = a.select(*on, F.col(ida).alias("mask_a")), b.select(*on, F.col(idb).alias("mask_b"))
    j = left.join(right, on)
    if same:
        j = j.filter("mask_a < mask_b")
    n = j.groupBy(*by, "mask_a", "mask_b").agg(F.count("*").alias("both"))
    sa = left.groupBy(*by, "mask_a").agg(F.count("*").alias("area_a"))
    sb = right.groupBy(*by, "mask_b").agg(F.count("*").alias("area_b"))
    n = n.join(sa, [*by, "mask_a"]).join(sb, [*by, "mask_b"])
    return n.withColumns({
        "iou": F.col("both") / (F.col("area_a") + F.col("area_b") - F.col("both")),
        "a_in_b": F.col("both") / F.col("area_a"), "b_in_a": F.col("both") / F.col("area_b")})


def adjacency(labels: DataFrame, label: str, by: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """Length of the common border of every pair of touching labels."""
    def body(d):
        win = {a: line(a, by) for a in (X, Y)}
        d = d.withColumns({"_e": F.lead(label).over(win[X]), "_s": F.lead(label).over(win[Y])})
        return d.withColumn("_n", F.explode(F.array("_e", "_s"))).drop("_e", "_s")
    d = blocked(labels, 1, body, side).filter(F.col("_n") != F.col(label))
    return d.groupBy(STACK, *by, F.least(label, "_n").alias("piece_a"), F.greatest(label, "_n").alias("piece_b")).agg(F.count("*").alias("border"))
