"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def luminance(b="b", g="g", r="r") -> Column:
    """Rounded 0.114 b + 0.587 g + 0.299 r, in exact integers."""
    return F.floor((col(b) * 114 + col(g) * 587 + col(r) * 299 + 500) / 1000).cast("int")


def truncate_u8(v) -> Column:
    """Clip to 0..255 and cut the fraction; rounding at 6 digits first keeps 99.9999999999 at 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(col(v), 6))).cast("int")


def soft_threshold(v, t) -> Column:
    return F.signum(col(v)) * F.greatest(F.abs(col(v)) - col(t), F.lit(0.0))


def clip(v, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(v)))


def dominance(best, second) -> Column:
    return (col(best) - col(second)) / (col(best) + F.lit(1e-6))


def parabola(before, peak, after) -> Column:
    """Vertex offset of the parabola through three samples, within ±0.5, 0 where it is flat."""
    curve = col(before) - 2 * col(peak) + col(after)
    offset = 0.5 * (col(before) - col(after)) / F.when(F.abs(curve) > 1e-9, curve)
    return F.when(offset.isNotNull(), clip(offset, -0.5, 0.5)).otherwise(F.lit(0.0))  # least and greatest skip NULL


def first_max(value, index) -> Column:
    """Ordering key for ``max_by``: largest value, then lowest index."""
    return F.struct(col(value), -col(index))


def solve2(a11, a12, a22, b1, b2, ridge: float = 0.0) -> tuple[Column, Column]:
    """Symmetric 2×2 system by Cramer's rule; NULL where singular."""
    a11, a12, a22, b1, b2 = (col(c) for c in (a11, a12, a22, b1, b2))
    a11, a22 = a11 + F.lit(ridge), a22 + F.lit(ridge)
    det = a11 * a22 - a12 * a12
    det = F.when(F.abs(det) > 1e-9, det)
    return (a22 * b1 - a12 * b2) / det, (a11 * b2 - a12 * b1) / det


def solve3(m: list, b: list) -> list[Column]:
    """3×3 system by Cramer's rule, ``m`` row by row; NULL where singular."""
    m, b = [[col(c) for c in row] for row in m], [col(c) for c in b]

    def det(a):
        return (a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
                - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
                + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0]))

    whole = det(m)
    whole = F.when(F.abs(whole) > 1e-9, whole)
    return [det([[b[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / whole for k in range(3)]


def eigen2(a, b, c) -> tuple[Column, Column]:
    """Eigenvalues of [[a, b], [b, c]], smaller first."""
    a, b, c = col(a), col(b), col(c)
    mid, gap = (a + c) / 2, F.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)
    return mid - gap, mid + gap


def map_point(m, x, y) -> tuple[Column, Column]:
    """Apply a row-major 3×3 matrix held in an array column to a point; denominators keep 1e-12 away from 0."""
    m, x, y = col(m), col(x), col(y)
    e = lambda i: F.element_at(m, i + 1)
    den = e(6) * x + e(7) * y + e(8)
    den = F.when(F.abs(den) < 1e-12, F.lit(1e-12)).otherwise(den)
    return (e(0) * x + e(1) * y + e(2)) / den, (e(3) * x + e(4) * y + e(5)) / den


def homogeneous(m) -> Column:
    """Six or nine matrix entries to nine."""
    m = col(m)
    return F.when(F.size(m) == 6, F.concat(m, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))).otherwise(m)


def safe_corr(a, b) -> Column:
    """Correlation aggregate that is NULL where one side does not vary."""
    spread = F.stddev_pop(col(a)) * F.stddev_pop(col(b))
    return F.covar_pop(col(a), col(b)) / F.when(spread > 1e-12, spread)
