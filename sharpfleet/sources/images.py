"""Image files as tables: listing, decoding, validation and inventories."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharpfleet.operators.grid import FRAME, STACK, X, Y

EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def keep_images(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct image paths; everything without a known extension is dropped."""
    return paths.filter(extension(F.col(path)).isin(*EXTENSIONS)).dropDuplicates([path])


def list_images(spark: SparkSession, inputs: str | Sequence[str]) -> DataFrame:
    """Image files under folders, globs or file names: path, length, stack folder. The content is not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs if isinstance(inputs, str) else list(inputs))
    return with_folder(keep_images(raw.select("path", "length", "modificationTime")))


def with_folder(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumns({"folder": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "name": F.element_at(F.split(path, "/"), -1)})


def number_frames(files: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    """Frame numbers by path order inside each folder; the folder's hash names the stack."""
    w = Window.partitionBy(folder).orderBy(path)
    return files.withColumns({STACK: F.xxhash64(folder), FRAME: F.row_number().over(w) - 1})


def read_frames(spark: SparkSession, inputs: str | Sequence[str]) -> DataFrame:
    """Decoded frames: stack_id, frame, origin, h, w, n_channels, data (BGR bytes), readable."""
    img = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(inputs if isinstance(inputs, str) else list(inputs))
    d = img.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"),
                   F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))
    d = number_frames(with_folder(keep_images(d)))
    return d.select(STACK, FRAME, F.col("path").alias("origin"), "folder", "h", "w", "n_channels", "data", (F.col("h") > 0).alias("readable"))


def frame_pixels(frames: DataFrame) -> DataFrame:
    """BGR bytes to pixel rows; a single channel is copied to all three.

    One generated row per image line keeps the generator small, then one per pixel of that line.
    """
    n = F.col("n_channels")
    lines = frames.filter("h > 0").select(STACK, FRAME, "h", "w", "n_channels", "data", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias(Y))
    lines = lines.withColumn("_l", F.hex(F.substring("data", (F.col(Y) * F.col("w") * n + 1), F.col("w") * n))).drop("data")
    px = lines.withColumn(X, F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    byte = lambda k: F.conv(F.substring("_l", (F.col(X) * n + F.when(n >= 3, F.lit(k)).otherwise(F.lit(0))) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return px.select(STACK, FRAME, Y, X, "h", "w", byte(0).alias("b"), byte(1).alias("g"), byte(2).alias("r"))


def registry(frames: DataFrame, dataset: str) -> DataFrame:
    """File count and sample shape (of the first path) of every dataset."""
    return frames.groupBy(dataset).agg(F.count("*").alias("files"), F.min_by(F.struct("h", "w", "n_channels"), "origin").alias("sample_shape"), F.min("origin").alias("first"))


def inventory(files: DataFrame, folder: str = "folder") -> DataFrame:
    return files.groupBy(folder).agg(F.count("*").alias("frames"))


def triples(files: DataFrame, path: str = "path", roles: Sequence[str] = ("A", "B", "F")) -> DataFrame:
    """Complete (A, B, fused) triples by the three-character id at the start of the file name."""
    name = F.element_at(F.split(path, "/"), -1)
    d = files.select(F.substring(name, 1, 3).alias("id"), F.regexp_extract(name, r"_([A-Z])\.", 1).alias("role"), F.col(path).alias("path"))
    d = d.filter(F.col("role").isin(*roles)).groupBy("id").pivot("role", list(roles)).agg(F.min("path"))
    return d.dropna(subset=list(roles))


def complete_stacks(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """All-or-nothing: rows of an outside table (masks, depth) only for stacks where every frame delivered; ``frames`` has stack_id, n."""
    have = rows.groupBy(STACK).agg(F.countDistinct(FRAME).alias("_c"))
    ok = have.join(frames, STACK).filter(F.col("_c") == F.col("n")).select(STACK)
    return rows.join(ok, STACK, "left_semi")
