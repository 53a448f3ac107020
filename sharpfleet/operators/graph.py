"""Connected components and hulls."""

from __future__ import annotations

from typing import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharpfleet.operators.grid import FRAME, STACK, X, Y
from sharpfleet.runtime import cut


def connected(nodes: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Smallest node id of every component: columns of ``by``, node, label.

    ``edges`` has a and b. Every round points a node at its first neighbour in a random order of the round, and on to where
    that one points, and then contracts the graph: only edges between different targets remain. Stars vanish in one round,
    and chains, whatever their ids, shorten by a factor in each, and so does the table of edges. The maps of the rounds are
    put together at the end.
    """
    by = list(by)
    ordered = lambda d, a, b: d.filter(F.col(a) != F.col(b)).select(*by, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    left, maps = cut(ordered(edges, "a", "b")), []
    while not left.isEmpty():
        turn = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), F.col(c)).alias("h"), F.col(c).alias("n"))
        both = left.select(*by, F.col("a").alias("node"), F.col("b").alias("_o")).unionByName(left.select(*by, F.col("b").alias("node"), F.col("a").alias("_o")))
        low = both.groupBy(*by, "node").agg(F.min(turn("_o")).alias("_m")).select(*by, "node", F.least(turn("node"), F.col("_m"))["n"].alias("_low"))
        step = low.join(low.select(*by, F.col("node").alias("_low"), F.col("_low").alias("_to")), [*by, "_low"]).select(*by, "node", "_to")
        maps.append(cut(step))
        to = lambda end: maps[-1].select(*by, F.col("node").alias(end), F.col("_to").alias(f"_{end}"))
        left = cut(ordered(left.join(to("a"), [*by, "a"]).join(to("b"), [*by, "b"]), "_a", "_b"))
    state = nodes.select(*by, "node", F.col("node").alias("_at"))
    for m in maps:
        moved = m.select(*by, F.col("node").alias("_at"), "_to")
        state = state.join(moved, [*by, "_at"], "left").select(*by, "node", F.coalesce("_to", "_at").alias("_at"))
    state = cut(state)
    return state.join(state.groupBy(*by, "_at").agg(F.min("node").alias("label")), [*by, "_at"]).select(*by, "node", "label")


def components(mask: DataFrame, by: Sequence[str] = (STACK, FRAME), diagonal: bool = False) -> DataFrame:
    """Connected components of set pixels: the rows of ``mask`` with ``label`` (id of the first run in scan order).

    Pixels are first joined to horizontal runs, so the graph has one node per run, not per pixel.
    """
    by = list(by)
    w = Window.partitionBy(*by, Y).orderBy(X)
    d = mask.withColumn("_gap", F.coalesce((F.col(X) - F.lag(X).over(w) > 1).cast("int"), F.lit(1)))
    d = d.withColumn("_start", F.last(F.when(F.col("_gap") == 1, F.col(X)), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_run", F.col(Y).cast("long") * (1 << 24) + F.col("_start")).drop("_gap", "_start")
    up = d.select(*by, (F.col(Y) + 1).alias(Y), X, F.col("_run").alias("_up"))
    if diagonal:
        up = up.withColumn(X, F.explode(F.array(F.col(X) - 1, F.col(X), F.col(X) + 1)))
    edges = d.join(up, [*by, Y, X]).select(*by, F.col("_up").alias("a"), F.col("_run").alias("b")).distinct()
    found = connected(d.select(*by, F.col("_run").alias("node")).distinct(), edges, by)
    return d.join(found.withColumnRenamed("node", "_run"), [*by, "_run"]).drop("_run")


def component_table(labelled: DataFrame, by: Sequence[str] = (STACK, FRAME)) -> DataFrame:
    return labelled.groupBy(*by, "label").agg(
        F.count("*").alias("area"), F.min(Y).alias("y0"), F.min(X).alias("x0"), F.max(Y).alias("y1"), F.max(X).alias("x1"))


def fill_holes(px: DataFrame, mask: str, by: Sequence[str] = (STACK, FRAME)) -> DataFrame:
    """Set the unset components that do not touch the image border."""
    empty = components(px.filter(~F.col(mask)).select(*by, Y, X, "h", "w"), by)
    outside = (F.col(Y) == 0) | (F.col(X) == 0) | (F.col(Y) == F.col("h") - 1) | (F.col(X) == F.col("w") - 1)
    open_ = empty.groupBy(*by, "label").agg(F.max(outside).alias("_open"))
    holes = empty.join(open_, [*by, "label"]).filter("NOT _open").select(*by, Y, X, F.lit(True).alias("_hole"))
    return px.join(holes, [*by, Y, X], "left").withColumn("filled", F.col(mask) | F.coalesce("_hole", F.lit(False))).drop("_hole")


def residual_clusters(px: DataFrame, value: str, cutoff: DataFrame, by: Sequence[str], least: int = 25, top: int = 5) -> DataFrame:
    """Components above the cutoff of their key with enough area, largest summed value first."""
    hot = px.join(cutoff, list(by)).filter(F.col(value) > F.col("cutoff")).select(*by, Y, X, value)
    c = components(hot, by, diagonal=True)
    g = c.groupBy(*by, "label").agg(F.count("*").alias("area"), F.sum(value).alias("mass"), F.max(value).alias("peak"), F.avg(value).alias("mean"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("mass", 6)), "label")
    return g.filter(F.col("area") >= least).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def coherent(labelled: DataFrame, by: Sequence[str], biggest: int = 3, share: float = 0.6) -> DataFrame:
    """Whether the few biggest components hold enough of the area."""
    a = labelled.groupBy(*by, "label").agg(F.count("*").alias("_a"))
    w = Window.partitionBy(*by).orderBy(F.desc("_a"), "label")
    a = a.withColumn("_k", F.row_number().over(w))
    g = a.groupBy(*by).agg((F.sum(F.when(F.col("_k") <= biggest, F.col("_a"))) / F.sum("_a")).alias("share"))
    return g.withColumn("coherent", F.col("share") >= share)


_CORNER = T.ArrayType(T.StructType([T.StructField("px", T.DoubleType()), T.StructField("py", T.DoubleType())]))


@F.pandas_udf(_CORNER)
def _corners(columns: pd.Series) -> pd.Series:
    """Corners of the convex hull of sorted columns (x, lowest y, highest y): below from left to right, above from right to left."""
    def turn(points):
        chain = []
        for p in points:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        return chain

    out = []
    for c in columns:
        below, above = turn([(r["px"], r["lo"]) for r in c]), turn([(r["px"], r["hi"]) for r in reversed(c)])
        ring = below + [p for p in above if p not in (below[-1], below[0])]
        out.append([{"px": x, "py": y} for x, y in ring])
    return pd.Series(out)


def hull(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Exact convex hull: its corners in angle order (``ring``) and its area.

    Only the lowest and the highest point of each x can be corners, so a key comes down to its distinct x (image columns)
    before they meet.
    """
    by = list(by)
    d = points.select(*by, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).filter("px IS NOT NULL AND py IS NOT NULL")
    d = d.groupBy(*by, "px").agg(F.min("py").alias("lo"), F.max("py").alias("hi"))
    e = d.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("px", "lo", "hi"))).alias("_c")).withColumn("ring", _corners("_c")).drop("_c")
    turned = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    cross = F.zip_with("ring", turned, lambda a, b: a["px"] * b["py"] - b["px"] * a["py"])
    return e.withColumn("area", F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def in_hull(points: DataFrame, hulls: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Points inside the ring of their key (border included)."""
    j = points.join(hulls.select(*by, "ring"), list(by))
    turned = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    span = lambda c, p: F.col(c).between(F.array_min(F.transform("ring", lambda r: r[p])), F.array_max(F.transform("ring", lambda r: r[p])))
    j = j.filter(span(x, "px") & span(y, "py"))
    side = F.zip_with("ring", turned, lambda a, b: (b["px"] - a["px"]) * (F.col(y) - a["py"]) - (b["py"] - a["py"]) * (F.col(x) - a["px"]))
    return j.filter(F.forall(side, lambda v: v >= -1e-9)).drop("ring")
