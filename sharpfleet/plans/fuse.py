"""From frames to fused images: validation, exposure, routing and the fusion methods by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharpfleet.operators import evidence as ev
from sharpfleet.operators import fusion as fu
from sharpfleet.operators import stats as sa
from sharpfleet.operators.grid import FRAME, STACK, X, Y, attach

METHODS = {
    "max": lambda px, **kw: fu.fuse_max(px, **kw).drop("winner"),
    "pyramid": fu.fuse_pyramid,
    "decision": fu.fuse_decision,
    "blend": fu.fuse_blend,
    "coherent": fu.fuse_coherent,
    "perband": lambda px, **kw: fu.fuse_routed(px, **kw).drop("coherent"),
}


def accepted(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels of the stacks that can be fused, and the status of every stack."""
    status = ev.stack_status(px.select(STACK, FRAME, "h", "w").distinct())
    good = status.filter("status = 'ok'").select(STACK, F.lit(True).alias("_ok"))
    return attach(px, good, [STACK]).drop("_ok"), status


def run(px: DataFrame, method: str = "perband", exposure: bool = True, **options) -> DataFrame:
    """Fuse all stacks of a pixel relation (stack_id, frame, y, x, h, w, b, g, r) into stack_id, y, x, b, g, r."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    good, _ = accepted(px)
    if exposure:
        good = sa.normalize_exposure(good)
    return METHODS[method](good, **options).select(STACK, Y, X, "b", "g", "r")
