"""Focal-stack analytics on Spark: every operator works on tables of pixels, tiles, features or masks."""
