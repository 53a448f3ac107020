"""Gaussian and Laplacian pyramids with all levels in one relation.

One block pass per level computes the low-pass value and its expansion back to the fine grid with
windows only, so a detail band needs no join; the even pixels of the low-pass column are the next level.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharpfleet.operators import stencil as st
from sharpfleet.runtime import cut, shared
from sharpfleet.operators.grid import FRAME, SIDE, STACK, X, Y, blocked, size_of

TAPS = [0.0625, 0.25, 0.375, 0.25, 0.0625]
CAP = 6


def auto_levels(h="h", w="w", requested: int | None = None) -> Column:
    """Depth of the pyramid: floor(log2(min side)) − 1, at least 1, at most 6 or the requested depth."""
    small = F.greatest(F.lit(1), F.least(F.col(h), F.col(w)))
    hard = F.greatest(F.lit(1), F.floor(F.log2(small) + 1e-9).cast("int") - 1)
    return F.greatest(F.lit(1), F.least(hard, F.lit(CAP if requested is None else requested)))


def planned(levels: int | None = None, depth: int | None = None) -> int:
    """Levels that a plan holds: ``depth`` where given, else the requested depth or the cap that holds without a request."""
    return depth or levels or CAP


def _deepest(level: Column, depth: int) -> Column:
    """``level``, or an error when an image is deeper than the plan; nothing is cut in silence."""
    return F.when(level > depth, F.raise_error(F.lit(f"an image has more than {depth} pyramid levels; raise depth"))).otherwise(level).cast("int")


def halve(df: DataFrame) -> DataFrame:
    """Keep even pixels and renumber them."""
    return df.filter((F.col(Y) % 2 == 0) & (F.col(X) % 2 == 0)).withColumns({
        Y: F.floor(F.col(Y) / 2).cast("int"), X: F.floor(F.col(X) / 2).cast("int"),
        "h": F.floor((F.col("h") + 1) / 2).cast("int"), "w": F.floor((F.col("w") + 1) / 2).cast("int"),
    })


def pyr_down(px: DataFrame, cols: Sequence[str], by=(FRAME,), side: int = SIDE) -> DataFrame:
    """Five-tap blur and every second pixel; size (n+1)/2."""
    return halve(st.separable(px, {c: c for c in cols}, TAPS, by, side))


def pyr_up(px: DataFrame, cols: Sequence[str], th: Column, tw: Column, by=(FRAME,), side: int = SIDE, around: bool = False) -> DataFrame:
    """Expand to th×tw: even pixel (g[i−1]+6g[i]+g[i+1])/8, odd pixel (g[i]+g[i+1])/2; first side reflects, last repeats.

    Missing pixels count as zero. ``around``: those next to a pixel are expanded too.
    """
    def body(df):
        names = {c: [c] for c in cols}
        for axis in (X, Y):
            new = {}
            if axis == X or around:
                df = st.fringe(df, 1, by, axis, **{n: 0.0 for c in cols for n in names[c]})
            df, read, added = st.beside(df, [n for c in cols for n in names[c]], 1, axis, by, 0.0)
            for c in cols:
                for n in names[c]:
                    after = st.neighbour(n, 1, axis, by, "clamp", read=read)
                    before = F.when(F.col(axis) == 0, after).otherwise(read(n, -1))
                    new[f"{n}0"] = (before + 6 * F.col(n) + after) / 8
                    new[f"{n}1"] = (F.col(n) + after) / 2
            df = df.withColumns(new).drop(*added)
            names = {c: [m for n in names[c] for m in (f"{n}0", f"{n}1")] for c in cols}
        return df.drop("_void") if around else st.unfringe(df)
    df = blocked(px.withColumns({"_th": th, "_tw": tw}), 1, body, side)
    child = F.explode(F.array(*[
        F.struct((2 * F.col(Y) + b).alias(Y), (2 * F.col(X) + a).alias(X), *[F.col(f"{c}{a}{b}").alias(c) for c in cols])
        for a in (0, 1) for b in (0, 1)]))
    rest = [c for c in px.columns if c not in (*cols, Y, X, "h", "w")]
    out = df.select(*rest, F.col("_th").alias("h"), F.col("_tw").alias("w"), child.alias("_k"))
    out = out.select(*rest, "h", "w", "_k.*")
    return out.filter((F.col(Y) < F.col("h")) & (F.col(X) < F.col("w")))


def _split(df: DataFrame, cols: Sequence[str], lows: Sequence[str], by, side: int) -> DataFrame:
    """Adds <c>_low for all columns and turns ``cols`` into c − expand(low) below the base level; missing pixels count as zero."""
    def body(d):
        for axis in (X, Y):
            src = (lambda c: c) if axis == X else (lambda c: f"{c}_low")
            d, read, added = st.beside(d, [src(c) for c in (*cols, *lows)], 2, axis, by, 0.0)
            d = d.withColumns({
                f"{c}_low": sum(F.lit(t) * st.neighbour(src(c), k - 2, axis, by, read=read) for k, t in enumerate(TAPS))
                for c in (*cols, *lows)}).drop(*added)
        if not cols:
            return d
        d = st.fringe(d, 2, by, **{f"{c}_low": 0.0 for c in cols})
        for axis in (X, Y):
            even, new = F.col(axis) % 2 == 0, {}
            d, read, added = st.beside(d, [f"{c}_low" if axis == X else f"_{c}_up" for c in cols], 2, axis, by, 0.0)
            for c in cols:
                n = f"{c}_low" if axis == X else f"_{c}_up"
                after = F.when(F.col(axis) + 2 >= size_of(axis), F.col(n)).otherwise(read(n, 2))
                up_even = (F.when(F.col(axis) == 0, after).otherwise(read(n, -2)) + 6 * F.col(n) + after) / 8
                up_odd = (read(n, -1) + F.when(F.col(axis) + 1 >= size_of(axis), read(n, -1)).otherwise(read(n, 1))) / 2
                up = F.when(even, up_even).otherwise(up_odd)
                new[f"_{c}_up" if axis == X else c] = up if axis == X else F.when(F.col("level") < F.col("levels"), F.col(c) - up).otherwise(F.col(c))
            d = d.withColumns(new).drop(*added)
        return st.unfringe(d)
    return blocked(df, 4, body, side)


def pyramid(px: DataFrame, details: Sequence[str], lows: Sequence[str] = (), levels: int | None = None,
            by=(FRAME,), side: int = SIDE, depth: int | None = None) -> DataFrame:
    """All levels in one relation.

    Columns ``level`` (0 finest) and ``levels`` (index of the base); ``details`` hold band-pass values
    below the base and the low-pass image at the base, ``lows`` the low-pass image at every level.
    ``depth`` is the number of levels planned when the largest image is known to be small; a deeper image is an error.
    """
    depth = planned(levels, depth)
    every = [STACK, *by, Y, X, "h", "w", *details, *lows]
    g = px.select(*[F.col(c).cast("double").alias(c) if c in (*details, *lows) else F.col(c) for c in every],
                  F.lit(0).alias("level"), _deepest(auto_levels("h", "w", levels), depth).alias("levels"))
    every += ["level", "levels"]
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    out = None
    for _ in range(depth):
        s = shared(_split(g, details, lows, by, side))
        part = s.select(*every)
        out = part if out is None else out.unionByName(part)
        even = s.filter((F.col(Y) % 2 == 0) & (F.col(X) % 2 == 0) & (F.col("level") < F.col("levels")))
        g = even.select(
            STACK, *by, half(Y).alias(Y), half(X).alias(X), F.floor((F.col("h") + 1) / 2).cast("int").alias("h"),
            F.floor((F.col("w") + 1) / 2).cast("int").alias("w"), *[F.col(f"{c}_low").alias(c) for c in (*details, *lows)],
            (F.col("level") + 1).alias("level"), "levels")
    return out.unionByName(g.select(*every))


def collapse(bands: DataFrame, cols: Sequence[str], by=(), side: int = SIDE, depth: int | None = None) -> DataFrame:
    """Sum of all bands on the finest grid. ``bands`` has level, levels, y, x, h, w and one row per pixel and level, ``depth`` as the pyramid.

    Every level has the pixels of its own band; coarser pixels that are missing count as zero.
    """
    depth = planned(None, depth)
    size = F.struct("h", "w")
    keep = [STACK, *by, "levels", "level", Y, X, "h", "w"]
    bands = cut(bands.withColumn("level", _deepest(F.col("level"), depth)).select(*keep, *cols))  # one image per stack: small next to the frames
    full = bands.filter("level = 0").groupBy(STACK, *by).agg(F.max(size).alias("_full"))

    def size_at(level: Column, axis: str) -> Column:
        scale = F.pow(F.lit(2.0), level)
        return F.ceil(F.col(f"_full.{axis}") / scale).cast("int")
    acc = bands.filter(F.col("level") == depth)
    for k in range(depth - 1, -1, -1):
        up = pyr_up(acc.join(full, [STACK, *by]), cols, size_at(F.lit(k), "h"), size_at(F.lit(k), "w"), by, side, around=True)
        up = up.withColumn("level", F.lit(k)).select(*keep, *cols, F.lit(False).alias("_own"))
        both = up.unionByName(bands.filter(F.col("level") == k).withColumn("_own", F.lit(True)))
        both = both.groupBy(*keep).agg(*[F.sum(c).alias(c) for c in cols], F.bool_or("_own").alias("_own"))
        acc = both.filter("_own").drop("_own")
    return acc.drop("level", "levels")
