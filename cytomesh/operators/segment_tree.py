"""Distances from points to an outline of any size, by a tree of segment boxes.

Segments are put in the order of a space-filling curve and cut into leaves of equal size; the boxes of the leaves, and of
runs of leaves, are a directory of fixed size. A point is sent to the leaf whose box is nearest; the distance found
there rules out every leaf whose box is not nearer. The few that remain are visited in a second step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomesh.functions import columns as C
from cytomesh.operators.core import cumulative_counts, cut_lineage, drop_table, keyed_join, with_scalars

#: Segments of a leaf; leaves at most (larger outlines have larger leaves); leaves under one box of the upper level.
LEAF, LEAVES, FAN = 128, 1 << 14, 128
#: Bits of a coordinate on the curve.
BITS = 20


def segment_distance(s: Column, x: Column, y: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    len2 = dx * dx + dy * dy
    t = ((x - s["x1"]) * dx + (y - s["y1"]) * dy) / F.nullif(len2, F.lit(0.0))
    t = F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return C.distance(x, y, s["x1"] + t * dx, s["y1"] + t * dy)


def _spread(c: Column) -> Column:
    """The bits of a number of BITS bits, with a free bit after each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _leaves(segments: DataFrame) -> DataFrame:
    """A written table (leaf, segs, x1, y1, x2, y2): leaves in the order of the curve, with their boxes."""
    ends = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    segs = cut_lineage(segments.select(*ends).dropna().distinct())
    ext = segs.agg(
        F.min(F.least("x1", "x2")).alias("_x"), F.min(F.least("y1", "y2")).alias("_y"),
        F.greatest(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("_w"),
    )
    cell = lambda a, b, lo: F.least(F.floor(((F.col(a) + F.col(b)) / 2 - F.col(lo)) * 2**BITS / F.greatest("_w", F.lit(1e-300))), F.lit(2**BITS - 1)).cast("bigint")
    curve = F.shiftleft(_spread(cell("x1", "x2", "_x")).bitwiseOR(F.shiftleft(_spread(cell("y1", "y2", "_y")), 1)), 63 - 2 * BITS)
    # equal places on the curve are told apart by a hash, so no leaf grows with them
    mixed = F.pmod(F.xxhash64("x1", "y1", "x2", "y2"), F.lit(1 << (63 - 2 * BITS)))
    placed = cut_lineage(with_scalars(segs, ext).select("x1", "y1", "x2", "y2", curve.bitwiseOR(mixed).alias("at")))
    n = placed.count()
    leaves = min(max(-(-n // LEAF), 1), LEAVES)
    ranks = cumulative_counts(placed, "at").select(F.col("value").alias("at"), F.floor(F.col("before") * leaves / n).cast("int").alias("leaf"))
    box = [F.min(F.least("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y1"), F.max(F.greatest("x1", "x2")).alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2")]
    out = cut_lineage(keyed_join(placed, ranks, ["at"]).groupBy("leaf").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("segs"), *box))
    drop_table(segs)
    drop_table(placed)
    return out


class Directory:
    """Boxes of the leaves, and of runs of FAN leaves."""

    def __init__(self, leaves: DataFrame):
        rows = sorted(leaves.select("leaf", "x1", "y1", "x2", "y2").collect())  # LEAVES rows at most
        self.leaf = np.array([r["leaf"] for r in rows], np.int32)
        self.box = np.array([tuple(r)[1:] for r in rows], float).reshape(-1, 4)
        self.fan = FAN
        starts = np.arange(0, len(rows), FAN)
        low, high = (f.reduceat(self.box, starts, axis=0) if len(rows) else self.box for f in (np.minimum, np.maximum))
        self.upper = np.concatenate([low[:, :2], high[:, 2:]], axis=1)

    @staticmethod
    def _bounds(x: np.ndarray, y: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances from points to the nearest and to the farthest place of boxes."""
        dx = np.maximum(np.maximum(box[:, 0] - x[:, None], x[:, None] - box[:, 2]), 0.0)
        dy = np.maximum(np.maximum(box[:, 1] - y[:, None], y[:, None] - box[:, 3]), 0.0)
        fx = np.maximum(x[:, None] - box[:, 0], box[:, 2] - x[:, None])
        fy = np.maximum(y[:, None] - box[:, 1], box[:, 3] - y[:, None])
        return dx * dx + dy * dy, fx * fx + fy * fy

    def nearest(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Position of the leaf with the nearest box, and of equal ones that with the nearest far corner."""
        low, high = self._bounds(x, y, self.upper)
        reach = high.min(1)
        best = np.full((len(x), 2), np.inf)
        found = np.zeros(len(x), np.int64)
        for u in np.argsort(low.min(0), kind="stable"):
            at = np.flatnonzero(low[:, u] <= np.minimum(reach, best[:, 0]))
            if len(at):
                lo, hi = self._bounds(x[at], y[at], self.box[u * self.fan : (u + 1) * self.fan])
                first = np.lexsort((hi, lo), axis=1)[:, 0]
                lo, hi = lo[np.arange(len(at)), first], hi[np.arange(len(at)), first]
                better = (lo < best[at, 0]) | ((lo == best[at, 0]) & (hi < best[at, 1]))
                at, first = at[better], first[better]
                best[at, 0], best[at, 1], found[at] = lo[better], hi[better], u * self.fan + first
        return found

    def within(self, x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(points, positions of leaves) whose boxes are nearer than ``reach``."""
        low, _ = self._bounds(x, y, self.upper)
        for u in range(len(self.upper)):
            at = np.flatnonzero(low[:, u] < reach * reach)
            if len(at):
                lo, _ = self._bounds(x[at], y[at], self.box[u * self.fan : (u + 1) * self.fan])
                i, j = np.nonzero(lo < (reach[at] ** 2)[:, None])
                yield at[i], u * self.fan + j


AT_ONCE = 1024


def outline_distance(points: DataFrame, segments: DataFrame, out: str) -> DataFrame:
    """The points with ``out``, the distance to the nearest segment; NULL without coordinates or without an outline."""
    leaves = _leaves(segments)
    directory = Directory(leaves)
    if not len(directory.leaf):
        return points.withColumn(out, F.lit(None).cast("double"))
    handed = points.sparkSession.sparkContext.broadcast(directory)  # of fixed size at most

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y"))
            known = np.isfinite(x) & np.isfinite(y)
            found = np.full(len(x), -1, np.int64)
            at = np.flatnonzero(known)
            for a in range(0, len(at), AT_ONCE):
                part = at[a : a + AT_ONCE]
                found[part] = handed.value.leaf[handed.value.nearest(x[part], y[part])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32(), mask=~known)], [*batch.schema.names, "_leaf"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, d = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y", "_d"))
            seen = batch.column("_leaf").to_numpy(zero_copy_only=False)
            for a in range(0, len(x), AT_ONCE):
                part = slice(a, a + AT_ONCE)
                for i, j in handed.value.within(x[part], y[part], d[part]):
                    i, leaf = i + a, handed.value.leaf[j]
                    new = leaf != seen[i]
                    at = pa.array(i[new])
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("_row", "_x", "_y")] + [pa.array(leaf[new], pa.int32())], ["_row", "_x", "_y", "_leaf"])

    own = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_p"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    own = own.withColumn("_row", F.monotonically_increasing_id())
    target = own.withColumn("_leaf", F.lit(None).cast("int")).schema
    boxes = leaves.select(F.col("leaf").alias("_leaf"), "segs")
    nearest = F.array_min(F.transform("segs", lambda s: segment_distance(s, F.col("_x"), F.col("_y"))))
    one = cut_lineage(own.mapInArrow(first, target).join(boxes, "_leaf", "left").select("_p", "_x", "_y", "_row", "_leaf", nearest.alias("_d")))
    more = one.where("_d > 0").select("_row", "_x", "_y", "_leaf", "_d").mapInArrow(second, "_row bigint, _x double, _y double, _leaf int")
    near = more.join(boxes, "_leaf").select("_row", nearest.alias("_e")).groupBy("_row").agg(F.min("_e").alias("_e"))
    keep = [F.col(f"_p.`{c}`").alias(c) for c in points.columns if c != out]
    return one.join(near, "_row", "left").select(*keep, F.least("_d", "_e").alias(out))


__all__ = ["Directory", "outline_distance", "segment_distance"]
