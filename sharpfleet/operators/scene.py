"""Camera motion and object depths from feature shifts, in turn with the objects that the features belong to."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharpfleet.operators.fits import robust_fit
from sharpfleet.operators.grid import FRAME, STACK, attach, attach_few
from sharpfleet.runtime import cut, shared

# Fixed values
ROUNDS, MIN_ROWS, MIN_MEMBERS = 6, 8, 8


class Scene(NamedTuple):
    """``labels``: object of each feature. ``depths``: inverse depth rho and members of each object. ``motion``: omega, tx, ty, tz of each frame.

    ``audit``: per stack and round, features that changed their object, the largest change of a depth and the RMS residual.
    """

    labels: DataFrame
    depths: DataFrame
    motion: DataFrame
    audit: DataFrame


def _parts(h: int, w: int) -> tuple[Column, Column]:
    """Position from the centre: what a rotation moves along the normal, and what an approach moves."""
    ux, uy = F.col("x") - (w - 1) / 2.0, F.col("y") - (h - 1) / 2.0
    return ux * F.col("ny") - uy * F.col("nx"), ux * F.col("nx") + uy * F.col("ny")


def frame_motion(obs: DataFrame, depths: DataFrame, h: int, w: int, least: int = MIN_ROWS) -> DataFrame:
    """Rotation and translation (stack_id, frame, omega, tx, ty, tz) of every frame with ``least`` rows, given rho per feature."""
    rows = attach(obs, depths.select(STACK, "feature_id", "rho"), [STACK, "feature_id"])
    turn, near = _parts(h, w)
    design = [turn, -F.col("rho") * F.col("nx"), -F.col("rho") * F.col("ny"), F.col("rho") * near]
    fit = robust_fit(rows, [STACK, FRAME], design, "shift", "score", passes=1, least=least)
    return fit.select(STACK, FRAME, *[F.element_at("beta", i + 1).alias(n) for i, n in enumerate(("omega", "tx", "ty", "tz"))])


def feature_sums(obs: DataFrame, motion: DataFrame, h: int, w: int) -> DataFrame:
    """What a feature says of any depth: its residual e, without rotation, and its rate c per unit of rho, as sums over the frames.

    The cost of a depth is ee - 2 rho ce + rho² cc, so no feature meets an object row by row; ``_1`` are the sums without weights.
    """
    turn, near = _parts(h, w)
    j = attach_few(obs, motion, [STACK, FRAME])
    j = j.withColumns({"_e": F.col("shift") - F.col("omega") * turn, "_c": F.col("tz") * near - F.col("tx") * F.col("nx") - F.col("ty") * F.col("ny")})
    e, c, s = F.col("_e"), F.col("_c"), F.col("score")
    return j.groupBy(STACK, "feature_id").agg(
        F.sum(s * e * e).alias("ee"), F.sum(s * c * e).alias("ce"), F.sum(s * c * c).alias("cc"), F.sum(s).alias("seen"),
        F.sum(e * e).alias("ee_1"), F.sum(c * e).alias("ce_1"), F.sum(c * c).alias("cc_1"), F.count("*").alias("n"))


def _cost(rho: Column, end: str = "") -> Column:
    return F.col(f"ee{end}") - 2 * rho * F.col(f"ce{end}") + rho * rho * F.col(f"cc{end}")


def object_depths(sums: DataFrame, labels: DataFrame, depths: DataFrame) -> DataFrame:
    """rho of each object from its features, centred and scaled to a mean distance of one; an object without evidence keeps its own before that."""
    g = labels.join(sums, [STACK, "feature_id"]).groupBy(STACK, "object_id").agg(F.sum("ce").alias("_num"), F.sum("cc").alias("_den"))
    d = depths.select(STACK, "object_id", F.col("rho").alias("_old")).join(g, [STACK, "object_id"], "left")
    d = d.withColumn("_r", F.when(F.col("_den") > 1e-9, F.col("_num") / F.col("_den")).otherwise(F.col("_old")))
    every = Window.partitionBy(STACK)  # the few objects of a stack
    d = d.withColumns({"_m": F.avg("_r").over(every), "_span": F.max("_r").over(every) - F.min("_r").over(every)})
    d = d.withColumn("_far", F.avg(F.abs(F.col("_r") - F.col("_m"))).over(every))
    return d.select(STACK, "object_id", F.when(F.col("_span") > 1e-9, (F.col("_r") - F.col("_m")) / F.col("_far")).otherwise(F.col("_r")).alias("rho"))


def reassign(sums: DataFrame, labels: DataFrame, depths: DataFrame) -> DataFrame:
    """Each feature goes to the object whose depth explains it best (ties: the smallest id); one that no fitted frame shows stays."""
    ladder = depths.groupBy(STACK).agg(F.collect_list(F.struct("object_id", "rho")).alias("_all"))
    j = attach(labels.join(sums, [STACK, "feature_id"], "left"), ladder, [STACK])
    best = F.array_min(F.transform("_all", lambda o: F.struct(F.round(_cost(o["rho"]), 6).alias("cost"), o["object_id"].alias("object_id"))))["object_id"]
    return j.select(STACK, "feature_id", F.when(F.col("seen") > 0, best).otherwise(F.col("object_id")).alias("object_id"), F.col("object_id").alias("was"))


def alternate(obs: DataFrame, labels: DataFrame, depths: DataFrame, h: int, w: int, rounds: int = ROUNDS, tolerance: float = 1e-9,
              least: int = MIN_ROWS, members: int = MIN_MEMBERS) -> Scene:
    """Fit motions, then depths, then move features, for all stacks at once, until no feature moves and no depth changes.

    ``obs``: stack_id, feature_id, frame, x, y, nx, ny, shift, score. ``labels``: stack_id, feature_id, object_id. ``depths``:
    stack_id, object_id, rho. After a round an object with fewer than ``members`` features takes the depth of the largest one.
    ``rounds`` is an upper bound; ``audit`` tells whether a stack had come to rest. Only tables of one row per feature or per
    object are carried from round to round.
    """
    o, audit, motion, k = shared(obs.select(STACK, "feature_id", FRAME, "x", "y", "nx", "ny", "shift", "score")), None, None, 0
    labels, depths = labels.select(STACK, "feature_id", "object_id"), depths.select(STACK, "object_id", F.col("rho").cast("double").alias("rho"))
    if rounds < 1:
        raise ValueError("at least one round")
    while k < rounds:
        motion = cut(frame_motion(o, labels.join(depths.select(STACK, "object_id", "rho"), [STACK, "object_id"]), h, w, least))
        sums = cut(feature_sums(o, motion, h, w))
        fitted = object_depths(sums, labels, depths)
        moved = cut(reassign(sums, labels, fitted))
        held = moved.groupBy(STACK, "object_id").agg(F.count("*").alias("members"))
        d = fitted.join(held, [STACK, "object_id"], "left").withColumn("members", F.coalesce("members", F.lit(0)))
        largest = d.groupBy(STACK).agg(F.min(F.struct((-F.col("members")).alias("few"), "object_id", "rho")).alias("_top"))
        d = d.join(largest, STACK).withColumn("rho", F.when(F.col("members") < members, F.col("_top.rho")).otherwise(F.col("rho"))).drop("_top")
        new = cut(d.join(depths.select(STACK, "object_id", F.col("rho").alias("was")), [STACK, "object_id"]))
        change = new.groupBy(STACK).agg(F.max(F.abs(F.col("rho") - F.col("was"))).alias("change"))
        rms = moved.join(new.select(STACK, "object_id", "rho"), [STACK, "object_id"]).join(sums, [STACK, "feature_id"], "left").groupBy(STACK).agg(
            F.sum((F.col("object_id") != F.col("was")).cast("int")).alias("moved"), F.sqrt(F.greatest(F.sum(_cost(F.col("rho"), "_1")), F.lit(0.0)) / F.sum("n")).alias("rms"))
        step = cut(change.join(rms, STACK).select(STACK, F.lit(k).alias("round"), "moved", "change", "rms"))
        audit = step if audit is None else audit.unionByName(step)
        labels, depths, k = moved.drop("was"), new.drop("was"), k + 1
        if step.filter((F.col("moved") > 0) | (F.col("change") > tolerance)).isEmpty():
            break
    return Scene(labels, depths, motion, audit)
