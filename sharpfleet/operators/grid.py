"""Pixel relations and how they are spread over the cluster.

A pixel relation has one row per (stack_id, frame, y, x) plus the image size ``h``, ``w``. Work on
neighbourhoods runs inside square blocks with a halo: ``Blocks.open`` copies the border pixels of each
block to its neighbours and shuffles once on (stack_id, blk); every window whose keys start with
(stack_id, blk) then needs no further exchange, and a single huge stack is spread over all its blocks.
``Blocks.close`` keeps only the rows a block owns.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STACK, BLK, FRAME, Y, X = "stack_id", "blk", "frame", "y", "x"
SIDE = 64          # block side in pixels
FEW = 20_000       # rows of a few numbers each that are broadcast once they are counted
TASKS = 3          # tasks of a sort for each shuffle partition of the session
_ROW = 1 << 20     # blk = block row * _ROW + block column


def idiv(c: Column | str, n) -> Column:
    """Floor division to INT."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / n).cast("int")


def spread(df: DataFrame, *on: str) -> DataFrame:
    """Shuffle on ``on`` into TASKS partitions for each one of the session.

    Adaptive execution packs partitions by their compressed size, and sorted rows take tens of times that in memory. A
    number that is asked for is not packed, so the memory of a task is that of its share of the rows.
    """
    return df.repartition(TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)


class Blocks:
    """Block layout: ``side`` pixels owned per block and axis, ``halo`` pixels copied on each side."""

    def __init__(self, halo: int, side: int = SIDE):
        self.halo = halo
        self.side = max(SIDE, 4 * halo) if side == SIDE else max(side, halo)

    def open(self, px: DataFrame) -> DataFrame:
        s, r = F.lit(self.side), self.halo

        def span(c: str, size: str) -> Column:
            first = idiv(F.greatest(F.lit(0), F.col(c) - r), s)
            last = idiv(F.least(F.col(size) - 1, F.col(c) + r), s)
            return F.sequence(first, last)

        out = px.withColumn("_br", F.explode(span(Y, "h"))).withColumn("_bc", F.explode(span(X, "w")))
        out = out.withColumn(BLK, F.col("_br").cast("long") * _ROW + F.col("_bc")).drop("_br", "_bc")
        return spread(out, STACK, BLK)

    def owner(self) -> Column:
        return idiv(Y, self.side).cast("long") * _ROW + idiv(X, self.side)

    def close(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(BLK) == self.owner()).drop(BLK)


def blocked(px: DataFrame, halo: int, body: Callable[[DataFrame], DataFrame], side: int = SIDE) -> DataFrame:
    """Run ``body`` inside blocks with the given halo; a relation that is already blocked is used as it is."""
    if BLK in px.columns:
        return body(px)
    blocks = Blocks(halo, side)
    return blocks.close(body(blocks.open(px)))


def keys(*extra: str) -> list[str]:
    return [STACK, BLK, *extra]


def line(axis: str, by: Sequence[str]) -> Window:
    """Window over one image line inside a block, ordered along ``axis``."""
    other = Y if axis == X else X
    return Window.partitionBy(*keys(*by), other).orderBy(axis)


def size_of(axis: str) -> Column:
    return F.col("w") if axis == X else F.col("h")


def pad(df: DataFrame, axis: str, r: int) -> DataFrame:
    """Reflect one axis by ``r`` pixels without repeating the edge, again and again where r reaches beyond the image."""
    c, last = F.col(axis), size_of(axis) - 1
    once = F.filter(
        F.array_distinct(F.array(c, -c, 2 * last - c)), lambda p: (p >= -r) & (p <= last + r)
    )
    period = F.greatest(2 * last, F.lit(1))
    fold = lambda p: F.least(F.pmod(p, period), 2 * last - F.pmod(p, period))
    often = F.filter(F.sequence(F.lit(-r), (last + r).cast("int")), lambda p: (last == 0) | (fold(p) == c))
    mirrored = F.when(F.lit(r) <= last, once).otherwise(often)
    inner = (c > r) & (c < last - r)
    return df.withColumn(axis, F.explode(F.when(inner, F.array(c)).otherwise(mirrored)))


def unpad(df: DataFrame, axis: str) -> DataFrame:
    return df.filter((F.col(axis) >= 0) & (F.col(axis) < size_of(axis)))


def attach(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 16, large: bool = False) -> DataFrame:
    """Join a few columns per key onto many rows per key.

    A key can own a large share of ``big``, so the join key carries a salt computed from the pixel or
    row identity and ``small`` is repeated once per salt. Spark still broadcasts ``small`` when it
    finds it under its own threshold. ``large``: ``small`` grows with the images, both sides are sorted in more tasks.
    """
    by = [c for c in (BLK, FRAME, Y, X) if c in big.columns and c not in on]
    if not by:
        by = [c for c in big.columns if c not in on][:3]
    if not by:
        return big.join(small, list(on), how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if large:
        left, right = spread(left, *on, "_salt"), spread(right, *on, "_salt")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def attach_few(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``attach`` for a ``small`` that is already cut, so that counting it is cheap.

    The statistics of a cut relation are those of the rows it came from, so Spark would shuffle ``big``. Up to FEW rows
    are broadcast instead; more go through the salted join.
    """
    if small.count() <= FEW:
        return big.join(F.broadcast(small), list(on), how)
    return attach(big, small, on, how)


def add_all(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)
