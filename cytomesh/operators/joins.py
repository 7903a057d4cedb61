"""Key joins, label attachments and point / outline predicates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomesh.functions import columns as C
from cytomesh.operators.core import cut_lineage, keyed_join, with_scalars
from cytomesh.operators.segment_tree import outline_distance

PLACE_PAIRS = 1 << 20  # rows that one task of a join on places should make
MOST_TASKS = 20_000

# --------------------------------------------------------------------------- key joins


def attach(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(other, on, "inner")


def attach_left(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(other, on, "left")


def outer_on_xy(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["x", "y"], "full")


def join_all(tables: Mapping[str, DataFrame], keys: Sequence[str], label: str = "label") -> DataFrame:
    """Many result tables on common keys, one column per table: one union and one shuffle instead of n joins."""
    tagged = [t.select(*keys, F.lit(n).alias("_src"), F.col(label).alias("_v")) for n, t in tables.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    return stacked.groupBy(*keys).pivot("_src", list(tables)).agg(F.first("_v"))


def join_all_by_join(tables: Mapping[str, DataFrame], keys: Sequence[str], label: str = "label") -> DataFrame:
    """The same as a chain of full joins, for tables whose keys repeat."""
    named = [t.select(*keys, F.col(label).alias(n)) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, list(keys), "full"), named)


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids, on, "left_semi")


def drop_duplicated_ids(df: DataFrame, on: str) -> DataFrame:
    """Drop every row whose id occurs more than once. Counts are combined before the shuffle."""
    repeated = df.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(on)
    return df.join(repeated, on, "left_anti")


def align_ids(counts: DataFrame, cells: DataFrame, on: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """Restrict the matrix and the metadata to the ids they share."""
    shared = counts.select(on).intersect(cells.select(on))
    return keyed_join(counts, shared, [on]), cells.join(shared, on, "left_semi")


def common_ids(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), frames)


def minus_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_anti")


def n_clusters(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of distinct labels, NULL not counted. Distinct first, then count: no group's labels sit in one buffer."""
    labels = df.where(F.col(column).isNotNull()).select(*by, column).distinct()
    n = F.count(F.lit(1)).alias("n_clusters")
    return labels.groupBy(*by).agg(n) if by else labels.agg(n)


def join_rounded_xy(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """Join on coordinates rounded half-even to integers.

    Many rows may share a place, so the result can be far larger than both sides. It is counted from the rows of every
    place first; a large one is made by tasks that have about PLACE_PAIRS rows of it each: the rows of ``a`` at a heavy place
    are dealt over shares, and each share meets all of ``b`` there.
    """

    def rounded(df: DataFrame) -> DataFrame:
        return df.withColumns({"x": F.bround("x").cast("int"), "y": F.bround("y").cast("int")})

    a, b = rounded(a), rounded(b)
    if how not in ("inner", "left"):
        return a.join(b, ["x", "y"], how)
    at = a.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_na"))
    met = cut_lineage(at.join(b.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_nb")), ["x", "y"]).withColumn("_pairs", F.col("_na") * F.col("_nb")))
    pairs = met.agg(F.coalesce(F.sum("_pairs"), F.lit(0))).first()[0]
    if pairs <= PLACE_PAIRS:
        return a.join(b, ["x", "y"], how)
    shares = met.where(F.col("_pairs") > PLACE_PAIRS).select("x", "y", F.ceil(F.col("_pairs") / PLACE_PAIRS).cast("int").alias("_shares"))
    parts = min(MOST_TASKS, 4 * math.ceil(pairs / PLACE_PAIRS))
    own = F.coalesce("_shares", F.lit(1))
    left = a.join(shares, ["x", "y"], "left").withColumn("_share", F.pmod(F.xxhash64(*a.columns), own).cast("int")).drop("_shares")
    right = b.join(shares, ["x", "y"], "left").withColumn("_share", F.explode(F.sequence(F.lit(0), own - 1))).drop("_shares")
    on = ["x", "y", "_share"]
    return left.repartition(parts, *on).join(right, on, how).drop("_share")


def join_result(truth: DataFrame, result: DataFrame) -> DataFrame:
    """By barcode when both sides have one, else by position; decided from the schemas."""
    if "barcode" in truth.columns and "barcode" in result.columns:
        extra = [c for c in result.columns if c == "barcode" or c not in truth.columns]
        return truth.join(result.select(*extra), "barcode")
    return truth.join(result, ["x", "y"])


def with_endpoints(edges: DataFrame, verts: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Attach a vertex attribute to both ends of every edge; hub vertices are spread by a salt."""
    out = edges
    for end in ("src", "dst"):
        side = verts.select(F.col(key).alias(end), F.col(column).alias(f"{end}_{column}"))
        out = keyed_join(out, side, [end])
    return out


def compose_partition(groups: DataFrame, teams: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """obs -> group and group -> team give obs -> team; the group table is small, hot groups are salted."""
    return keyed_join(groups, teams, [*by, "grp"])


def apply_alignment(cells: DataFrame, hard: DataFrame) -> DataFrame:
    """Give every cell the reference cluster of its (shard, cluster)."""
    small = hard.select("shard_id", "cluster", "ref_cluster")
    return keyed_join(cells, small, ["shard_id", "cluster"], "left")


def parameter_grid(runs: DataFrame, *params: DataFrame) -> DataFrame:
    """Runs x settings; every side is a short list of settings."""
    return reduce(lambda a, b: a.crossJoin(b), params, runs)


# --------------------------------------------------------------------------- outlines


def _crosses_ray(s: Column, x: Column, y: Column) -> Column:
    """Does the rightward ray from (x, y) cross the segment? Half-open in y, so vertices count once."""
    spans = (s["y1"] > y) != (s["y2"] > y)
    at = s["x1"] + (y - s["y1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0)) * (s["x2"] - s["x1"])
    return spans & (x < at)


def _on_segment(s: Column, x: Column, y: Column) -> Column:
    cross = (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])
    within = (
        (x >= F.least(s["x1"], s["x2"]))
        & (x <= F.greatest(s["x1"], s["x2"]))
        & (y >= F.least(s["y1"], s["y2"]))
        & (y <= F.greatest(s["y1"], s["y2"]))
    )
    return (cross == 0) & within


def points_in_polygons(points: DataFrame, segments: DataFrame, key: str = "id", out: str = "inside", slabs: int = 4096) -> DataFrame:
    """Flag points inside any polygon: even-odd over all rings, points on the outline count as inside.

    The outline is cut into horizontal slabs and joined on the slab, so a point meets only the segments at its own
    height, whatever the size of the outline. Rows are told apart by a key of their own, so ids may repeat. A point
    without coordinates gets NULL.
    """
    ext = segments.agg(F.min(F.least("y1", "y2")).alias("_lo"), F.max(F.greatest("y1", "y2")).alias("_hi"))

    def slab(c: Column) -> Column:
        return F.coalesce(F.floor((c - F.col("_lo")) * slabs / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(0))

    salts = 8
    own = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_p"), F.monotonically_increasing_id().alias("_row"))
    rows = with_scalars(own, ext).select(
        "_p", "_row", slab(F.col("_p.y").cast("double")).alias("_slab"), F.pmod(F.col("_row"), F.lit(salts)).cast("int").alias("_salt")
    )
    segs = with_scalars(segments, ext).select(
        "polygon_id",
        F.struct("x1", "y1", "x2", "y2").alias("s"),
        F.explode(F.sequence(slab(F.least("y1", "y2")), slab(F.greatest("y1", "y2")))).alias("_slab"),
    ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    x, y = F.col("_p.x"), F.col("_p.y")
    per = rows.join(segs, ["_slab", "_salt"], "left").groupBy("_row", "polygon_id").agg(
        F.first("_p").alias("_p"), F.count_if(_crosses_ray(F.col("s"), x, y)).alias("_odd"), F.count_if(_on_segment(F.col("s"), x, y)).alias("_touch")
    )
    flagged = per.groupBy("_row").agg(F.first("_p").alias("_p"), F.max((F.col("_odd") % 2 == 1) | (F.col("_touch") > 0)).alias("_in"))
    known = F.col("_p.x").isNotNull() & F.col("_p.y").isNotNull()
    return flagged.select("_p.*", F.when(known, F.col("_in")).alias(out))


def min_boundary_distance(points: DataFrame, segments: DataFrame, out: str = "boundary_distance") -> DataFrame:
    """Distance to the nearest piece of the outline, whatever its size; NULL without coordinates."""
    return outline_distance(points, segments, out)


def min_dist_to_outline(points: DataFrame, outline: DataFrame, out: str = "outline_distance") -> DataFrame:
    """Distance to the nearest vertex of a sampled outline (x, y)."""
    degenerate = outline.select(
        F.lit(0).alias("polygon_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    return min_boundary_distance(points, degenerate, out)


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(ax, ay, bx, by, s: Column) -> Column:
    """Do segment a-b and s cross at an inner point of both?"""
    d1 = _turn(s["x1"], s["y1"], s["x2"], s["y2"], ax, ay)
    d2 = _turn(s["x1"], s["y1"], s["x2"], s["y2"], bx, by)
    d3 = _turn(ax, ay, bx, by, s["x1"], s["y1"])
    d4 = _turn(ax, ay, bx, by, s["x2"], s["y2"])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def passed(df: DataFrame, size: DataFrame | Column, keep: Sequence[Column], x1: Column, y1: Column, x2: Column, y2: Column) -> DataFrame:
    """One row per cell of the given size (a number, or a one-row frame with _size) on the way: column by column, and in a column the rows between entry and exit."""
    cols = F.explode(F.sequence(F.floor(F.least(x1, x2) / F.col("_size")), F.floor(F.greatest(x1, x2) / F.col("_size"))))
    sized = with_scalars(df, size) if isinstance(size, DataFrame) else df.withColumn("_size", size)
    w = sized.select(*keep, x1.alias("_x1"), y1.alias("_y1"), x2.alias("_x2"), y2.alias("_y2"), "_size", cols.alias("cx"))

    def at(x: Column) -> Column:
        t = F.coalesce((x - F.col("_x1")) / F.nullif(F.col("_x2") - F.col("_x1"), F.lit(0.0)), F.lit(0.0))
        return F.col("_y1") + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (F.col("_y2") - F.col("_y1"))

    steep = F.col("_x1") == F.col("_x2")
    u = F.when(steep, F.col("_y1")).otherwise(at(F.col("cx") * F.col("_size")))
    v = F.when(steep, F.col("_y2")).otherwise(at((F.col("cx") + 1) * F.col("_size")))
    room = F.col("_size") * 1e-6  # neighbours share what rounding puts on their border
    rows = F.explode(F.sequence(F.floor((F.least(u, v) - room) / F.col("_size")), F.floor((F.greatest(u, v) + room) / F.col("_size"))))
    return w.withColumn("cy", rows).drop("_x1", "_y1", "_x2", "_y2", "_size")


def drop_crossing_edges(edges: DataFrame, verts: DataFrame, segments: DataFrame) -> DataFrame:
    """Drop edges that cross the outline; edges and segments meet in the grid cells that they pass through."""
    ends = edges.select("src", "dst").distinct()
    for end, s in (("src", "a"), ("dst", "b")):
        side = verts.select(F.col("id").alias(end), F.col("x").alias(f"_{s}x"), F.col("y").alias(f"_{s}y"))
        ends = keyed_join(ends, side, [end])
    a = [F.col(c) for c in ("_ax", "_ay", "_bx", "_by")]
    extent = F.max(F.greatest(*a)) - F.min(F.least(*a))
    mean = F.avg(F.greatest(F.abs(a[0] - a[2]), F.abs(a[1] - a[3]))) * 2.0
    size = ends.agg(F.greatest(mean, extent / 100_000.0, F.lit(1e-300)).alias("_size"))

    boxed = passed(ends, size, [F.col(c) for c in ("src", "dst", "_ax", "_ay", "_bx", "_by")], *a)
    segs = passed(segments, size, [F.struct("x1", "y1", "x2", "y2").alias("s")], *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    crossing = keyed_join(boxed, segs, ["cx", "cy"]).where(segments_cross(*a, F.col("s"))).select("src", "dst").distinct()
    return edges.join(crossing, ["src", "dst"], "left_anti")
