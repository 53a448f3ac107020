"""Pieces of an image between jumps of its depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharpfleet.operators import graph as gr
from sharpfleet.operators import resample as rs
from sharpfleet.operators import stencil as st
from sharpfleet.operators.grid import FRAME, SIDE, STACK, X, Y
from sharpfleet.runtime import cut

LEAST = 200  # fixed value: pixels of a piece
PX = [STACK, FRAME, Y, X]


def nearest_label(px: DataFrame, label: str, first: int, side: int = SIDE) -> DataFrame:
    """Pixels without ``label`` take that of the nearest pixel that has one (ties: lowest y, then x), however far it is.

    The search radius doubles for as long as a frame with labels has pixels without; frames without any stay as they are.
    """
    some = px.filter(F.col(label).isNotNull()).select(STACK, FRAME).distinct()
    out, r = px, first
    while True:
        known = out.withColumn("_known", F.col(label).isNotNull())
        out = cut(rs.nearest_fill(known, label, "_known", r, side=side).drop("_known"))
        if out.filter(F.col(label).isNull()).join(some, [STACK, FRAME], "left_semi").isEmpty():
            return out
        out, r = px, 2 * r  # from the given labels: a nearer one may stand beyond the last radius


def cut_pieces(px: DataFrame, depth: str, jump: float, r: int, least: int = LEAST, side: int = SIDE) -> DataFrame:
    """Columns ``ribbon`` (the depth jumps within ``r`` pixels) and ``piece`` (0, 1, ... in scan order) of every pixel.

    The depth goes through a median over the diameter of r; where it then rises by ``jump`` or more within r, it is a ribbon.
    Components of the rest with ``least`` pixels are pieces; all other pixels belong to the nearest piece. A smooth ramp is one
    piece. A frame whose components are all smaller has no piece: NULL.
    """
    d = st.step_height(st.median_filter(px, depth, 2 * r + 1, "_flat", side=side), "_flat", r, "_jump", side=side)
    d = cut(d.withColumn("ribbon", F.round("_jump", 9) >= jump).drop("_flat", "_jump"))
    cores = gr.components(d.filter("NOT ribbon").select(*PX))
    kept = gr.component_table(cores).filter(F.col("area") >= least)
    number = F.row_number().over(Window.partitionBy(STACK, FRAME).orderBy("label")) - 1  # one row per component
    pieces = cores.join(kept.withColumn("piece", number).select(STACK, FRAME, "label", "piece"), [STACK, FRAME, "label"]).select(*PX, "piece")
    return nearest_label(d.join(pieces, PX, "left"), "piece", 2 * r + 1, side)


def piece_table(pieces: DataFrame) -> DataFrame:
    """Area, box and share of ribbon of every piece."""
    return pieces.groupBy(STACK, FRAME, "piece").agg(
        F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"),
        F.avg(F.col("ribbon").cast("double")).alias("ribbon_share"))
