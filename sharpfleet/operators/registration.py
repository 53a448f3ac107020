"""Displacements from pixels, sampling fields and what has to be refused."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharpfleet.functions.columns import homogeneous, map_point, parabola
from sharpfleet.functions.quantiles import exact_quantiles
from sharpfleet.operators import ranking as rk
from sharpfleet.operators import resample as rs
from sharpfleet.operators import stats as sa
from sharpfleet.operators import stencil as st
from sharpfleet.operators.grid import BLK, FRAME, SIDE, STACK, X, Y, attach, blocked, idiv, keys
from sharpfleet.runtime import shared


def shift_scores(px: DataFrame, reference: int, reach: int, region: Column, v: str = "v", side: int = SIDE) -> DataFrame:
    """Normalised correlation of every frame with the reference frame for integer shifts up to ``reach``.

    One row per (stack, frame, region, dy, dx). The shifted values are window neighbours inside a block and
    are summed where they are, so the many shifts never travel; only sums per region do.
    """
    span = range(-reach, reach + 1)

    def body(d):
        pixel = Window.partitionBy(*keys(), Y, X)
        for axis in (X, Y):  # a pixel of the reference counts where its own place is missing in the other frame
            d = st.fringe(d, reach, (FRAME,), axis, **{v: None})
        d = d.withColumn("_a", F.max(F.when(F.col(FRAME) == reference, F.col(v))).over(pixel)).withColumn("_region", region)
        d = d.withColumns({f"_x{k + reach}": st.neighbour(v, k, X, (FRAME,), "none") for k in span})
        near = [F.struct(F.lit(j).alias("dy"), F.lit(k).alias("dx"), st.neighbour(f"_x{k + reach}", j, Y, (FRAME,), "none").alias("b")) for j in span for k in span]
        return d.withColumns({f"_n{i}": e for i, e in enumerate(near)}).drop("_void")
    d = blocked(px, reach, body, side).filter((F.col(FRAME) != reference) & F.col("_region").isNotNull())
    n = F.explode(F.array(*[f"_n{i}" for i in range(len(span) ** 2)]))
    d = d.select(STACK, FRAME, F.col("_region").alias("region"), F.col("_a").cast("double").alias("a"), n.alias("_n"))
    d = d.select(STACK, FRAME, "region", "a", "_n.dy", "_n.dx", F.col("_n.b").cast("double").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    g = d.groupBy(STACK, FRAME, "region", "dy", "dx").agg(F.count("*").alias("n"), F.sum(a).alias("_a"), F.sum(b).alias("_b"), F.sum(a * a).alias("_aa"), F.sum(b * b).alias("_bb"), F.sum(a * b).alias("_ab"))
    va, vb = F.col("n") * F.col("_aa") - F.col("_a") * F.col("_a"), F.col("n") * F.col("_bb") - F.col("_b") * F.col("_b")
    den = F.when((va > 0) & (vb > 0), F.sqrt(va * vb))
    return g.select(STACK, FRAME, "region", "dy", "dx", "n", F.round((F.col("n") * F.col("_ab") - F.col("_a") * F.col("_b")) / den, 9).alias("ncc"))


def translation(scores: DataFrame, limit: float, by: Sequence[str] = (STACK, FRAME, "region")) -> DataFrame:
    """Best shift with a parabola on each axis, refused (NULL) where it exceeds the limit or nothing correlates."""
    by = list(by)
    order = F.struct(F.col("ncc"), -F.col("dy"), -F.col("dx"))
    near = scores.select(*by, F.struct("dy", "dx", "ncc").alias("_s"))
    best = scores.filter("ncc IS NOT NULL").groupBy(*by).agg(F.max_by(F.struct("dy", "dx", "ncc"), order).alias("_b"))
    j = near.join(best, by)
    at = lambda oy, ox: F.max(F.when((F.col("_s.dy") == F.col("_b.dy") + oy) & (F.col("_s.dx") == F.col("_b.dx") + ox), F.col("_s.ncc")))
    g = j.groupBy(*by).agg(F.first("_b").alias("_b"), at(0, -1).alias("_l"), at(0, 1).alias("_r"), at(-1, 0).alias("_u"), at(1, 0).alias("_d"))
    own = F.col("_b.ncc")
    sub = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), parabola(a, own, b)).otherwise(F.lit(0.0))
    g = g.select(*by, (F.col("_b.dx") + sub("_l", "_r")).alias("dx"), (F.col("_b.dy") + sub("_u", "_d")).alias("dy"), own.alias("response"))
    ok = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) <= limit
    return g.withColumns({"dx": F.when(ok, F.col("dx")), "dy": F.when(ok, F.col("dy"))})


def tile_field(px: DataFrame, reference: int, reach: int, tile: int, depth: DataFrame, texture: float = 5.0, response: float = 0.1, v: str = "v", side: int = SIDE) -> DataFrame:
    """Tile displacements of textured tiles with a good response, with the tile centre and its median depth."""
    cols = 1 << 16
    region = (idiv(Y, tile) * cols + idiv(X, tile)).cast("int")
    found = translation(shift_scores(px, reference, reach, region, v, side), reach)
    tex = px.filter(F.col(FRAME) == reference).groupBy(STACK, region.alias("region")).agg(F.stddev_pop(v).alias("_t"))
    med = depth.withColumn("region", region).groupBy(STACK, "region").agg(F.percentile("depth", F.lit(0.5)).alias("depth"))
    j = found.join(tex, [STACK, "region"]).join(med, [STACK, "region"]).filter((F.col("_t") >= texture) & (F.col("response") >= response) & F.col("dx").isNotNull())
    centre = lambda c: c * tile + (tile - 1) / 2
    return j.select(STACK, FRAME, centre(F.col("region") % cols).alias("x"), centre(F.floor(F.col("region") / cols)).alias("y"), "depth", "dx", "dy", "response")


def affine_from_tiles(tiles: DataFrame, by: Sequence[str] = (STACK, FRAME), weight: str = "response", least: int = 3) -> DataFrame:
    """Affine map of each frame from its tile displacements; identity with a flag where the tiles do not suffice."""
    from sharpfleet.functions.columns import solve3
    w, x, y = F.col(weight), F.col("x"), F.col("y")
    s = tiles.groupBy(*by).agg(*[F.sum(e).alias(n) for n, e in {
        "_xx": w * x * x, "_xy": w * x * y, "_yy": w * y * y, "_x": w * x, "_y": w * y, "_n": w,
        "_ux": w * x * F.col("dx"), "_uy": w * y * F.col("dx"), "_u": w * F.col("dx"),
        "_vx": w * x * F.col("dy"), "_vy": w * y * F.col("dy"), "_v": w * F.col("dy")}.items()], F.count("*").alias("tiles"))
    m = [["_xx", "_xy", "_x"], ["_xy", "_yy", "_y"], ["_x", "_y", "_n"]]
    a, b = solve3(m, ["_ux", "_uy", "_u"]), solve3(m, ["_vx", "_vy", "_v"])
    rows = [a[0] + 1, a[1], a[2], b[0], b[1] + 1, b[2], F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    ok = (F.col("tiles") >= least) & a[0].isNotNull()
    identity = F.array(*[F.lit(float(k in (0, 4, 8))) for k in range(9)])
    return s.select(*by, F.when(ok, F.array(*rows)).otherwise(identity).alias("m"), (~ok).alias("failed"), "tiles")


def depth_bins(depth: DataFrame, bins: int, resolution: int = 96, d: str = "depth") -> DataFrame:
    """Bin edges per stack at the valleys of the depth histogram, quantiles where there is none; (stack, bin, lo, hi, last)."""
    h = sa.histogram(depth, [STACK], d, 0.0, 1.0, resolution)
    inner = rk.valleys(h, [STACK], resolution, bins - 1).select(STACK, ((F.col("bin") + 0.5) / resolution).alias("edge"))
    probs = {f"_q{i}": i / bins for i in range(bins + 1)}
    q = exact_quantiles(depth, [STACK], d, probs)
    valley = inner.groupBy(STACK).agg(F.sort_array(F.collect_set("edge")).alias("_v"))  # at most bins − 1 edges
    j = q.join(valley, STACK, "left")
    edges = F.when(F.col("_v").isNotNull(), F.concat(F.array(F.lit(0.0)), F.col("_v"), F.array(F.lit(1.0)))).otherwise(F.array(*probs))
    j = j.select(STACK, F.sort_array(F.array_distinct(edges)).alias("_e")).filter(F.size("_e") >= 3)
    j = j.select(STACK, "_e", F.posexplode(F.slice("_e", 1, F.size("_e") - 1)).alias("bin", "lo"))
    return j.select(STACK, "bin", "lo", F.element_at("_e", F.col("bin") + 2).alias("hi"), (F.col("bin") == F.size("_e") - 2).alias("last"))


def assign_bins(depth: DataFrame, edges: DataFrame, d: str = "depth") -> DataFrame:
    """Bin of each pixel; the last bin is closed. Each pixel meets the handful of bins of its stack."""
    j = attach(depth, edges, [STACK])
    v = F.col(d)
    return j.filter((v >= F.col("lo")) & ((v < F.col("hi")) | (F.col("last") & (v <= F.col("hi"))))).drop("lo", "hi", "last")


def limit_stretch(field: DataFrame, tolerance: float = 0.1, sigma: float = 2.0, rounds: int = 6, by: Sequence[str] = (FRAME,), side: int = SIDE) -> DataFrame:
    """Smooth the displacement (dispx, dispy) only where its gradient exceeds the tolerance.

    The excess of a whole image decides when it is left alone; a round without excess changes nothing.
    """
    r = int(round(3 * sigma))

    def body(d):
        for _ in range(rounds):
            steps = []
            for c in ("dispx", "dispy"):
                d = st.central_diff(d, c, by).withColumnsRenamed({"dx": f"_{c}x", "dy": f"_{c}y"})
                steps += [F.abs(f"_{c}x"), F.abs(f"_{c}y")]
            excess = (F.greatest(*steps) - tolerance) / tolerance
            d = d.withColumn("_ex", F.greatest(F.lit(0.0), F.least(F.lit(1.0), excess)))
            d = st.gaussian(d, {"_ex": "_ex", "_sx": "dispx", "_sy": "dispy"}, sigma, by, r)
            d = d.withColumns({c: (1 - F.col("_ex")) * F.col(c) + F.col("_ex") * F.col(s) for c, s in (("dispx", "_sx"), ("dispy", "_sy"))})
            d = d.drop("_ex", "_sx", "_sy", "_dispxx", "_dispxy", "_dispyx", "_dispyy")
        return d
    return blocked(field, rounds * (r + 1), body, side)


def field_stretch(field: DataFrame, by: Sequence[str] = (FRAME,), share: float = 0.999, side: int = SIDE) -> DataFrame:
    """99.9th percentile of the local deviation of a sampling field (sx, sy) from a rigid shift."""
    def body(d):
        for c in ("sx", "sy"):
            d = st.central_diff(d, c, by).withColumnsRenamed({"dx": f"_{c}x", "dy": f"_{c}y"})
        return d
    d = blocked(field, 1, body, side)
    dev = F.greatest(F.abs(F.col("_sxx") - 1), F.abs("_sxy"), F.abs("_syx"), F.abs(F.col("_syy") - 1))
    return exact_quantiles(shared(d.select(STACK, *by, dev.alias("_dev"))), [STACK, *by], "_dev", {"stretch": share})


def occlusion(disp: DataFrame, tolerance: float, top: int = 24, by: Sequence[str] = (FRAME,), side: int = SIDE) -> DataFrame:
    """Pixels a moving surface may have covered: for radii 1, 2, 4 … the displacement range exceeds the radius near a depth step.

    Input columns dispx, dispy and boolean ``edge``.
    """
    radii = [1 << k for k in range(12) if (1 << k) <= top]

    def body(d):
        out = F.lit(False)
        for r in radii:
            d = d.withColumns({f"_x{r}": F.col("dispx"), f"_y{r}": F.col("dispy")})
            d = st.step_height(d, f"_x{r}", r, f"_x{r}", by)
            d = st.step_height(d, f"_y{r}", r, f"_y{r}", by)
            d = st.extreme(d, {f"_e{r}": F.col("edge").cast("int")}, r, "dilate", by)
            out = out | ((F.greatest(f"_x{r}", f"_y{r}") > max(float(r), tolerance)) & (F.col(f"_e{r}") > 0))
        return d.withColumn("occluded", out).drop(*[f"_{c}{r}" for c in "xye" for r in radii])
    return blocked(disp, radii[-1], body, side)


def transition_refusal(disp: DataFrame, dominance: str, r: int = 5, spread: float = 2.0, share: float = 0.9, by: Sequence[str] = (FRAME,), side: int = SIDE) -> DataFrame:
    """Pixels between regions (dominance below ``share``) where the displacement range in the window is large."""
    def body(d):
        d = st.step_height(d, "dispx", r, "_rx", by)
        d = st.step_height(d, "dispy", r, "_ry", by)
        return d.withColumn("refused", (F.col(dominance) < share) & (F.greatest("_rx", "_ry") > spread)).drop("_rx", "_ry")
    return blocked(disp, r, body, side)


def footprint_crop(px: DataFrame, valid: str, cols: Sequence[str]) -> DataFrame:
    """Crop every stack to the largest rectangle that is valid in all frames."""
    every = px.groupBy(STACK, Y, X).agg(F.bool_and(valid).alias("_all"))
    return rs.crop(px, rk.largest_rectangle(every, "_all").filter("area > 0"))


def override(base: DataFrame, proposal: DataFrame, weight: str, ambiguity: str, inside: float = 0.9, ring: float = 0.1, tolerance: float = 2.0) -> DataFrame:
    """Three-way decision per pixel: replaced where owned, refused in the ring where both readings differ, else left alone."""
    on = [STACK, FRAME, Y, X]
    j = base.join(proposal.select(*on, F.col("sx").alias("_px"), F.col("sy").alias("_py"), weight, ambiguity), on, "left")
    own = F.coalesce(F.col(weight), F.lit(0.0))
    state = F.when(own >= inside, "replaced").when((own > ring) & (F.col(ambiguity) > tolerance), "refused").otherwise("kept")
    take = own >= inside
    return j.withColumns({"sx": F.when(take, F.col("_px")).otherwise(F.col("sx")), "sy": F.when(take, F.col("_py")).otherwise(F.col("sy")), "state": state}).drop("_px", "_py")


def motion_series(fits: DataFrame, by: Sequence[str], entries: int, frames: DataFrame, prior: Column, reference: int, weight: str = "weight") -> DataFrame:
    """Matrix entries linear in the frame distance through the prior; without evidence the prior itself."""
    e = fits.select(*by, FRAME, weight, F.posexplode("delta").alias("entry", "d"))
    s = sa.line_through_origin(e, [*by, "entry"], "d", F.col(FRAME) - reference, weight)
    grid = frames.withColumn("entry", F.explode(F.sequence(F.lit(0), F.lit(entries - 1))))
    return grid.join(s, [*by, "entry"], "left").withColumn("value", F.coalesce(F.col("slope") * (F.col(FRAME) - reference), F.lit(0.0)) + prior).drop("slope")


def affine_gap(a: DataFrame, b: DataFrame, support: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distance of two matrices at the centroid of a support, and their difference in scale."""
    c = support.groupBy(*by).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    j = a.select(*by, homogeneous("m").alias("_ma")).join(b.select(*by, homogeneous("m").alias("_mb")), list(by)).join(c, list(by))
    (ax, ay), (bx, by_) = map_point("_ma", "_cx", "_cy"), map_point("_mb", "_cx", "_cy")
    det = lambda m: F.sqrt(F.abs(F.element_at(m, 1) * F.element_at(m, 5) - F.element_at(m, 2) * F.element_at(m, 4)))
    dx, dy = ax - bx, ay - by_
    return j.select(*by, F.sqrt(dx * dx + dy * dy).alias("shift_gap"), F.abs(det("_ma") - det("_mb")).alias("scale_gap"))


def gap_ledger(flags: DataFrame, clauses: Sequence[str], by: Sequence[str] = (STACK, FRAME)) -> DataFrame:
    """Share of pixels each clause withdraws first, per key and over all frames of a stack."""
    first = F.lit(True)
    shares = []
    for c in clauses:
        shares.append(F.avg((first & F.col(c)).cast("double")).alias(c))
        first = first & ~F.col(c)
    return flags.rollup(*by).agg(F.count("*").alias("pixels"), *shares, F.avg(first.cast("double")).alias("kept")).filter(F.col(by[0]).isNotNull())


def monotone_violations(flags: DataFrame, stages: Sequence[str], by: Sequence[str] = (STACK, FRAME)) -> DataFrame:
    """Pixels that a later stage allows although an earlier one refused them; a sound ledger has none."""
    broken = F.lit(False)
    for a, b in zip(stages, stages[1:]):
        broken = broken | (F.col(b) & ~F.col(a))
    return flags.groupBy(*by).agg(F.count_if(broken).alias("violations"))


def bin_memberships(binned: DataFrame, bins: int, guide: str, radius: int, eps: float = 1e-3, side: int = SIDE) -> DataFrame:
    """Edge-aware share of every depth bin at every pixel, and the share left to the global map (bin −1).

    ``binned``: one row per pixel with ``bin`` (NULL where none applies) and the guide value in 0..1; the bins are few.
    """
    from sharpfleet.operators.fusion import guided_filter
    own = binned.withColumnRenamed("bin", "_own").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    raw = F.coalesce((F.col("_own") == F.col("bin")).cast("double"), F.lit(0.0))
    g = guided_filter(own, guide, raw, "_m", radius, eps, ("bin",), side)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_m")))
    w = Window.partitionBy(STACK, Y, X)
    g = g.select(STACK, Y, X, "bin", share.alias("share")).withColumn("share", F.col("share") / F.greatest(F.sum("share").over(w), F.lit(1.0)))
    rest = g.groupBy(STACK, Y, X).agg(F.lit(-1).alias("bin"), F.greatest(F.lit(0.0), 1 - F.sum("share")).alias("share"))
    return g.unionByName(rest)


def blur_rate(px: DataFrame, reference: int, peaks: DataFrame, rmax: int, piece: str = "piece", v: str = "v", side: int = SIDE) -> DataFrame:
    """Disk radius per (piece, frame) that best turns the reference into the frame, and the rate Σ r·d / Σ d² per stack.

    All radii come from one ladder pass; ``peaks``: stack_id, piece, peak.
    """
    def body(d):
        pixel = Window.partitionBy(*keys(), Y, X)
        d = d.withColumn("_ref", F.max(F.when(F.col(FRAME) == reference, F.col(v))).over(pixel).cast("double"))
        return st.disk_ladder(d, {"_l": "_ref"}, list(range(1, rmax + 1)))
    d = blocked(px, rmax, body, side).filter(F.col(FRAME) != reference)
    err = lambda c: F.round(F.avg(F.abs(F.col(c) - F.col(v))), 9)
    g = d.groupBy(STACK, piece, FRAME).agg(err("_ref").alias("_e0"), *[err(f"_l_r{r}").alias(f"_e{r}") for r in range(1, rmax + 1)])
    best = F.array_min(F.array(*[F.struct(F.col(f"_e{r}").alias("mae"), F.lit(r).alias("radius")) for r in range(rmax + 1)]))
    g = g.withColumn("_b", best).select(STACK, piece, FRAME, "_b.radius", "_b.mae")
    return g.join(peaks, [STACK, piece]).withColumn("distance", F.abs(F.col(FRAME) - F.col("peak")))


def rate_of(radii: DataFrame) -> DataFrame:
    return sa.line_through_origin(radii, [STACK], F.col("radius").cast("double"), F.col("distance").cast("double")).withColumnRenamed("slope", "rate")


def edge_offset(px: DataFrame, box: tuple[int, int, int, int], reference: int, v: str = "v") -> DataFrame:
    """Horizontal shift of a box against the reference frame from its column means; ``box`` is y0, y1, x0, x1."""
    from sharpfleet.operators.groups import match
    y0, y1, x0, x1 = box
    d = px.filter((F.col(Y) >= y0) & (F.col(Y) < y1) & (F.col(X) >= x0) & (F.col(X) < x1))
    mean = d.groupBy(STACK, FRAME, X).agg(F.avg(v).alias("m"))
    p = mean.groupBy(STACK, FRAME).agg(F.transform(F.sort_array(F.collect_list(F.struct(X, "m"))), lambda e: e["m"]).alias("profile"))  # x1 − x0 values
    base = p.filter(F.col(FRAME) == reference).select(STACK, F.col("profile").alias("_base"))
    return match(p.filter(F.col(FRAME) != reference).join(base, STACK), "_base", "profile", x1 - x0).select(STACK, FRAME, "shift", "score")
