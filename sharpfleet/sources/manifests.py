"""Scene manifests and resumable result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENE = "scene string, stratum string, core_pixels long, inner_veil_pixels long, outer_veil_pixels long, core_fraction double"


def read_manifest(spark: SparkSession, path: str, field: str = "scenes") -> DataFrame:
    """Scenes of multi-line JSON manifests, one row each."""
    raw = spark.read.option("multiLine", "true").json(path)
    return raw.select(F.explode(field).alias("_s")).select("_s.*")


def parse_manifests(df: DataFrame, column: str) -> DataFrame:
    """Scenes of manifests held as JSON text in a column."""
    parsed = F.from_json(column, f"struct<scenes: array<struct<{', '.join(':'.join(p.split(' ')) for p in SCENE.split(', '))}>>>")
    return df.select(F.explode(parsed["scenes"]).alias("_s")).select("_s.*")


def pending(manifest: DataFrame, done: DataFrame, key: str = "scene") -> DataFrame:
    """Scenes without a result yet."""
    return manifest.join(done.select(key).distinct(), key, "left_anti")


def write_pixels(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fused images, weights, selections or focus maps, one folder per stack bucket."""
    df.withColumn("bucket", F.pmod(F.xxhash64("stack_id"), F.lit(64))).write.mode(mode).partitionBy("bucket").parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
