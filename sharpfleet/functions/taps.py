"""Filter taps as plain numbers and as tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gaussian_taps(sigma: float, radius: int | None = None) -> list[float]:
    """Normalised samples of a Gaussian; the default radius is the smallest odd window over 8 sigma."""
    if radius is None:
        radius = (int(round(sigma * 8 + 1)) | 1) // 2
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [t / total for t in raw]


def disk_half_widths(r: int) -> dict[int, int]:
    """Half width of the chord of a disk of radius ``r`` for each row offset."""
    return {dy: math.isqrt(r * r - dy * dy) for dy in range(-r, r + 1)}


def disk_taps(spark: SparkSession, radii: list[int]) -> DataFrame:
    """Table (radius, dy, dx, weight) of normalised disks, x² + y² ≤ r²."""
    r = spark.createDataFrame([(k,) for k in radii], "radius int")
    grid = r.select("radius", F.explode(F.sequence(-F.col("radius"), F.col("radius"))).alias("dy"))
    grid = grid.select("radius", "dy", F.explode(F.sequence(-F.col("radius"), F.col("radius"))).alias("dx"))
    inside = grid.filter(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= F.col("radius") * F.col("radius"))
    n = inside.groupBy("radius").agg((1.0 / F.count("*")).alias("weight"))
    return inside.join(F.broadcast(n), "radius")  # one row per radius of the given list
