"""Connected components by alternating star contractions, with minima taken before every shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomesh.llm.common import delete, written


def _nearest(edges: DataFrame) -> DataFrame:
    """v, m: the smallest of a vertex and its neighbours."""
    return edges.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """v, root (the smallest vertex of its component) for every vertex of (v, u) that has an edge to another.

    A round links every vertex's larger neighbours to its smallest one, then its smaller neighbours; the depth halves at
    least. Only the edges of the current round are kept on disk.
    """
    both = edges.where("v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct()
    now = written(both)  # v > u
    while True:
        sym = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # large star: larger neighbours go to the smallest
        large = sym.join(_nearest(sym), "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = written(large.where("v <> u").distinct())
        # small star: a vertex and its smaller neighbours go to the smallest of them
        joined = large.join(large.groupBy("v").agg(F.min("u").alias("m")), "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(joined.select("v", F.col("m").alias("u")))
        nxt = written(small.where("v <> u").distinct())
        delete(large)
        # done when every vertex has one edge and no vertex is both a root and below one
        rows, vertices = nxt.agg(F.count(F.lit(1)), F.count_distinct("v")).first()
        settled = rows == vertices and nxt.join(nxt.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        delete(now)
        now = nxt
        if settled:
            return now.select("v", F.col("u").alias("root"))
