"""Column builders shared by the operators. All stay inside JVM code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO_FLOOR = 1e-9


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clipped_ratio(a, b, eps: float = RATIO_FLOOR) -> Column:
    """a / max(b, eps) held inside [0, 1]."""
    return F.least(F.greatest(floored_ratio(a, b, eps), F.lit(0.0)), F.lit(1.0))


def floored_ratio(a, b, eps: float = RATIO_FLOOR) -> Column:
    """a / max(b, eps)."""
    return col(a) / F.greatest(col(b).cast("double"), F.lit(float(eps)))


def safe_div(a, b) -> Column:
    """a / b, NULL when b is zero."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def pairs_of(n) -> Column:
    """n choose 2, in double so that large counts cannot overflow."""
    d = col(n).cast("double")
    return d * (d - F.lit(1.0)) / F.lit(2.0)


def xlogx(p) -> Column:
    """p * ln(p) with the limit 0 at p = 0."""
    return F.when(col(p) > 0, col(p) * F.log(col(p))).otherwise(F.lit(0.0))


def sq_distance(ax, ay, bx, by) -> Column:
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return dx * dx + dy * dy


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt(sq_distance(ax, ay, bx, by))


def array_sq_distance(a, b) -> Column:
    """Squared Euclidean distance of two equal-length double arrays."""
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v
    )


def polar_angle(x="x", y="y") -> Column:
    return F.atan2(col(y), col(x))


def angle_segment(x="x", y="y", n: int = 4) -> Column:
    """Segment 1..n of (-pi, pi] cut into n right-closed bins; exactly -pi falls outside (NULL)."""
    step = 2 * math.pi / n
    a = polar_angle(x, y)
    out = None
    for i in range(1, n + 1):
        upper = math.pi if i == n else -math.pi + step * i
        cond = (a > F.lit(-math.pi + step * (i - 1))) & (a <= F.lit(upper))
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def in_ellipse(x, y, cx: float, cy: float, a: float, b: float, angle: float = 0.0) -> Column:
    """Is the point inside an ellipse with half-axes a, b rotated by ``angle``?"""
    cos, sin = math.cos(angle), math.sin(angle)
    dx, dy = col(x) - F.lit(float(cx)), col(y) - F.lit(float(cy))
    u = dx * F.lit(cos) + dy * F.lit(sin)
    v = dy * F.lit(cos) - dx * F.lit(sin)
    return (u * u / F.lit(a * a) + v * v / F.lit(b * b)) <= F.lit(1.0)


def hash_unit(*cols, seed: int = 0) -> Column:
    """Uniform value in [0, 1) from a hash, the same on every run and partitioning."""
    h = F.xxhash64(*[col(c) for c in cols], F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(2**53))


def equal_width_bin(value, lo, hi, bins: int) -> Column:
    """0-based bin of an equal-width histogram; the top edge belongs to the last bin."""
    v, lo, hi = col(value), col(lo), col(hi)
    raw = F.floor((v - lo) * F.lit(float(bins)) / F.nullif(hi - lo, F.lit(0.0)))
    return F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def vector_columns(values: str, p: int, prefix: str = "pc") -> list[Column]:
    """The first p entries of an array column as separate columns."""
    return [F.col(values)[i].alias(f"{prefix}{i + 1}") for i in range(p)]
