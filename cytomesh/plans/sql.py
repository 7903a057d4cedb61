"""Small helpers shared by the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded double; adding 0.0 turns -0.0 into 0.0."""
    e = F.col(c) if isinstance(c, str) else c
    out = F.round(e.cast("double"), digits) + F.lit(0.0)
    return out.alias(name or (c if isinstance(c, str) else "value"))


def rounded(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


def rs(expr: str, digits: int = 6) -> str:
    """SQL twin of ``r``."""
    return f"round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE"


# outline used by the spatial queries: a frame with a hole, plus a triangle, in the range of ``points``
RINGS = {
    (1, 0): [(50.0, 200.0), (450.0, 150.0), (470.0, 1200.0), (300.0, 1500.0), (60.0, 1300.0)],
    (1, 1): [(200.0, 500.0), (300.0, 500.0), (300.0, 900.0), (200.0, 900.0)],
    (2, 0): [(100.0, 1700.0), (400.0, 1800.0), (250.0, 2300.0), (100.0, 1700.0)],
}
# the same shape scaled into the range of the cells' coordinates
CELL_RINGS = {
    (1, 0): [(-0.2, -0.22), (0.21, -0.2), (0.25, 0.1), (0.05, 0.24), (-0.22, 0.18)],
    (1, 1): [(-0.05, -0.05), (0.06, -0.05), (0.06, 0.05), (-0.05, 0.05)],
}


def ring_rows(rings) -> list[tuple]:
    return [(p, g, i, x, y) for (p, g), pts in rings.items() for i, (x, y) in enumerate(pts)]


def vertices(spark: SparkSession, rings=RINGS) -> DataFrame:
    return spark.createDataFrame(ring_rows(rings), "polygon_id int, ring_id int, seq int, x double, y double")


def vertices_sql(rings=RINGS) -> str:
    vals = ", ".join(f"({p}, {g}, {i}, {x}::DOUBLE, {y}::DOUBLE)" for p, g, i, x, y in ring_rows(rings))
    return (
        f"verts AS (SELECT * FROM (VALUES {vals}) t(polygon_id, ring_id, seq, x, y)), "
        "segs AS (SELECT * FROM (SELECT polygon_id, ring_id, seq, x AS x1, y AS y1, "
        "coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 "
        "FROM verts WINDOW w AS (PARTITION BY polygon_id, ring_id ORDER BY seq)) WHERE x1 <> x2 OR y1 <> y2)"
    )


SEG_DIST_SQL = (
    "sqrt((p.x - (s.x1 + t * (s.x2 - s.x1))) * (p.x - (s.x1 + t * (s.x2 - s.x1))) + "
    "(p.y - (s.y1 + t * (s.y2 - s.y1))) * (p.y - (s.y1 + t * (s.y2 - s.y1))))"
)
SEG_T_SQL = (
    "least(greatest(coalesce(((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1)) / "
    "nullif((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1), 0), 0), 0), 1)"
)
CROSSES_RAY_SQL = (
    "((s.y1 > p.y) <> (s.y2 > p.y) AND p.x < s.x1 + (p.y - s.y1) / nullif(s.y2 - s.y1, 0) * (s.x2 - s.x1))"
)
ON_SEGMENT_SQL = (
    "((s.x2 - s.x1) * (p.y - s.y1) - (s.y2 - s.y1) * (p.x - s.x1) = 0 AND p.x BETWEEN least(s.x1, s.x2) AND "
    "greatest(s.x1, s.x2) AND p.y BETWEEN least(s.y1, s.y2) AND greatest(s.y1, s.y2))"
)
