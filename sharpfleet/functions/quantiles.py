"""Exact percentiles of groups of any size."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharpfleet.operators.grid import attach, attach_few
from sharpfleet.runtime import cut

_ACCURACY = 10_000
_MARGIN = 0.001
_SMALL = 8_192


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], narrow: bool = False) -> DataFrame:
    """Linear-interpolated percentiles per key, one column per name, exact.

    The built-in ``percentile`` keeps every distinct value of a key in one buffer. Here a bounded sketch
    first gives an interval around each wanted rank; only values inside it are kept, counted per value
    with map-side aggregation, and ranked behind the exact number of values below the interval. The kept
    part is at most the margin's share of a large key, or a whole key of a few thousand rows.
    ``narrow``: the rows are cheap to make twice (no shuffle before them), so the sketch is cut and joined without moving them.
    """
    by, names = list(by), list(probs)
    v = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    cuts = [c for n in names for c in (max(0.0, probs[n] - _MARGIN), min(1.0, probs[n] + _MARGIN))]
    sketch = v.groupBy(*by).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.approx_percentile("_v", F.array(*[F.lit(c) for c in cuts]), F.lit(_ACCURACY)).alias("_cuts"))
    rank = lambda n: F.lit(float(probs[n])) * (F.col("_n") - 1)
    sketch = sketch.withColumn("_w", F.explode(F.array(*[
        F.struct(
            F.lit(n).alias("name"), rank(n).alias("rank"),
            F.when((F.col("_n") <= _SMALL) | F.lit(cuts[2 * i] == 0.0), F.col("_lo")).otherwise(F.element_at("_cuts", 2 * i + 1)).alias("lo"),
            F.when((F.col("_n") <= _SMALL) | F.lit(cuts[2 * i + 1] == 1.0), F.col("_hi")).otherwise(F.element_at("_cuts", 2 * i + 2)).alias("hi"),
        ) for i, n in enumerate(names)]))).select(*by, F.col("_w.name").alias("_name"), "_w.rank", "_w.lo", "_w.hi")
    key = [*by, "_name", "rank"]
    near = attach_few(v, cut(sketch), by) if by and narrow else attach(v, sketch, by) if by else v.crossJoin(F.broadcast(sketch))  # one sketch row per name without keys
    # values below the interval collapse into one NULL row, which sorts first and carries their count
    inside = near.filter("_v <= hi").select(*key, F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v"))
    inside = inside.groupBy(*key, "_v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_first("_v"))
    inside = inside.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
    lo_rank, hi_rank = F.floor("rank"), F.ceil("rank")
    hit = lambda k: F.max(F.when((F.col("_start") <= k) & (k < F.col("_end")), F.col("_v")))
    value_at = hit(lo_rank) + (hit(hi_rank) - hit(lo_rank)) * F.max(F.col("rank") - lo_rank)
    long = inside.groupBy(*key).agg(value_at.alias("_q"))
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in names])
