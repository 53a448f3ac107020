"""Focal-stack views over plain tables: an array column read as image tiles, rows read as observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def array_pixels(df: DataFrame, frame_id: Column, values: str, frames: int, tiles: int = 1, side: int = 8) -> DataFrame:
    """Array rows to pixel rows.

    Each array is one side×side tile, ``tiles``² consecutive arrays are one frame and ``frames``
    consecutive frames are one stack.
    """
    per_frame = tiles * tiles
    per_stack = per_frame * frames
    out = df.select(frame_id.alias("_id"), F.posexplode(values).alias("_i", "_e"))
    within = F.col("_id") % per_stack
    cell = within % per_frame
    size = F.lit(tiles * side)
    return out.select(
        F.floor(F.col("_id") / per_stack).alias("stack_id"),
        F.floor(within / per_frame).cast("int").alias("frame"),
        (F.floor(cell / tiles) * side + F.floor(F.col("_i") / side)).cast("int").alias("y"),
        ((cell % tiles) * side + F.col("_i") % side).cast("int").alias("x"),
        size.alias("h"), size.alias("w"),
        F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(127.5 + 255 * F.col("_e").cast("double") + 0.5).cast("double"))).cast("int").alias("v"),
    )


def pixels(spark: SparkSession, folder: str, tiles: int = 1) -> DataFrame:
    """Gray pixel relation: stacks of five frames of (8·tiles)² pixels."""
    return array_pixels(table(spark, folder, "embeddings"), F.col("vec_id"), "embedding", 5, tiles)


def frames_as_stacks(px: DataFrame, frames: int = 5) -> DataFrame:
    """Every frame as a stack of one frame."""
    return px.withColumn("stack_id", F.col("stack_id") * frames + F.col("frame")).withColumn("frame", F.lit(0))


def frame_pairs(px: DataFrame, frames: int = 5) -> DataFrame:
    """Every frame and the one after it as a stack of two frames; inner frames are in two of them."""
    at = F.explode(F.array(F.lit(0), F.lit(1)))
    out = px.withColumn("_at", at).filter(F.col("frame").between(F.col("_at"), frames - 2 + F.col("_at")))
    return out.withColumn("stack_id", F.col("stack_id") * frames + F.col("frame") - F.col("_at")).withColumn("frame", F.col("_at")).drop("_at")


def colour(px: DataFrame) -> DataFrame:
    """Three channels from the gray value and the position."""
    return px.withColumns({
        "b": F.col("v"), "g": (F.col("v") + 3 * F.col("x")) % 256, "r": (F.col("v") + 5 * F.col("y")) % 256,
    })


def truth(px: DataFrame) -> DataFrame:
    """Stand-in reference image: half-up mean over the frames."""
    return px.groupBy("stack_id", "y", "x", "h", "w").agg(
        F.floor(F.sum("v") / F.count("*") + 0.5).cast("int").alias("t"))


def masks(px: DataFrame) -> DataFrame:
    """Sparse masks 0..3 on every frame: set pixels above 90 + 20·mask_id."""
    m = px.withColumn("mask_id", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return m.filter("v > 90 + 20 * mask_id").select("stack_id", "frame", "mask_id", "y", "x", "h", "w")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Displacement observations, one per line item."""
    li = table(spark, folder, "lineitem")
    d = lambda c: F.col(c).cast("double")
    return li.select(
        (F.col("l_suppkey") % 10).alias("stack_id"), F.col("l_linenumber").cast("int").alias("frame"),
        (F.col("l_partkey") % 640).cast("int").alias("x"), (F.col("l_orderkey") % 480).cast("int").alias("y"),
        (d("l_discount") * 10).alias("depth"), (d("l_tax") * 100 - 4).alias("dx"),
        (d("l_discount") * 100 - 5).alias("dy"), (d("l_quantity") / 50).alias("w"),
    )


def measures(spark: SparkSession, folder: str) -> DataFrame:
    """Feature × frame shifts along the feature normal, one row per (feature, frame)."""
    li = table(spark, folder, "lineitem")
    kind = F.col("l_partkey") % 4
    best = li.groupBy("l_partkey", "l_linenumber").agg(
        F.max(F.col("l_tax").cast("double") * 100 - 4).alias("shift"),
        F.max(F.col("l_quantity").cast("double") / 50).alias("score"))
    return best.select(
        (F.col("l_partkey") % 10).alias("stack_id"), F.col("l_partkey").alias("feature_id"),
        F.col("l_linenumber").cast("int").alias("frame"),
        (F.col("l_partkey") % 640).cast("double").alias("x"), (F.floor(F.col("l_partkey") / 7) % 480).cast("double").alias("y"),
        F.when(kind == 0, 0.6).when(kind == 1, 0.8).when(kind == 2, 1.0).otherwise(0.0).alias("nx"),
        F.when(kind == 0, 0.8).when(kind == 1, 0.6).when(kind == 2, 0.0).otherwise(1.0).alias("ny"),
        "shift", "score",
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("scene"), F.col("o_orderpriority").alias("method"),
        F.col("o_orderstatus").alias("stratum"), F.col("o_totalprice").cast("double").alias("value"))
