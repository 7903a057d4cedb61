"""Sums over both sides of every edge of a forest, by rake and compress.

A round rakes all leaves (their sums are one side of their edge and move on to the neighbour) and compresses chains (an
independent set of vertices with two edges is bridged; the bridge keeps the name of one edge, and the other one follows
from it later). Either removes a constant share of the vertices, whatever the shape: hubs only receive sums, long chains
halve. Rounds end once the rest fits one task, or nothing is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomesh.operators.core import cut_lineage, drop_table, union_all

#: Edges that one task may finish.
LOCAL_EDGES = 1 << 20


def array_sum(column: str, p: int) -> Column:
    """Entry-wise sum of arrays of length p."""
    return F.array(*[F.sum(F.col(column)[i]) for i in range(p)])


def _plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _src_side(at_src: Column, n: str, s: str, tn: str, ts: str) -> list[Column]:
    """The sums of the src side from those of the side that is known."""
    return [F.when(at_src, F.col(n)).otherwise(F.col(tn) - F.col(n)).alias("n1"), F.when(at_src, F.col(s)).otherwise(_minus(ts, s)).alias("s1")]


def strip_leaves(ends: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per edge (rows of ``ends``): whether the first end was below, and the sums of the part that was.

    Leaves go one after another; a vertex knows its last edge as the exclusive or of the edges it still has.
    """
    m = len(ends)
    degree = np.bincount(ends.ravel(), minlength=len(n))
    link = np.zeros(len(n), np.int64)
    np.bitwise_xor.at(link, ends[:, 0], np.arange(m))
    np.bitwise_xor.at(link, ends[:, 1], np.arange(m))
    first, below_n, below_s = np.zeros(m, bool), np.zeros(m, n.dtype), np.zeros((m, s.shape[1]))
    n, s = n.copy(), s.copy()
    todo = np.flatnonzero(degree == 1).tolist()
    while todo:
        v = todo.pop()
        if degree[v] != 1:
            continue  # the other end of a lone edge went first
        e = link[v]
        first[e] = ends[e, 0] == v
        u = ends[e, 1] if first[e] else ends[e, 0]
        below_n[e], below_s[e] = n[v], s[v]
        n[u] += n[v]
        s[u] += s[v]
        degree[v], degree[u] = 0, degree[u] - 1
        link[u] ^= e
        if degree[u] == 1:
            todo.append(int(u))
    return first, below_n, below_s


def _finish(edges: DataFrame, verts: DataFrame, p: int) -> DataFrame:
    """name, n1, s1 for a forest of at most LOCAL_EDGES edges, in one task."""
    none = {c: F.lit(None).cast(t) for c, t in edges.dtypes + verts.dtypes}
    both = edges.select("name", "a", "b", "tn", "ts", none["id"].alias("id"), none["n"].alias("n"), none["s"].alias("s")).unionByName(
        verts.select(*[none[c].alias(c) for c in ("name", "a", "b", "tn", "ts")], "id", "n", "s")
    )

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        is_vertex = pa.compute.is_valid(t["id"])
        e, v = t.filter(pa.compute.invert(is_vertex)).combine_chunks(), t.filter(is_vertex).combine_chunks()
        if not e.num_rows:
            return
        ids = v["id"].combine_chunks()
        ends = np.stack([pa.compute.index_in(e[c], value_set=ids).to_numpy() for c in ("a", "b")], axis=1).astype(np.int64)
        first, n, s = strip_leaves(ends, v["n"].to_numpy(), matrix(v["s"].combine_chunks()))
        tn, ts = e["tn"].to_numpy(), matrix(e["ts"].combine_chunks())
        n1, s1 = np.where(first, n, tn - n), np.where(first[:, None], s, ts - s)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(s1) + 1, dtype=np.int32) * p), pa.array(s1.ravel()))
        yield pa.RecordBatch.from_arrays([e["name"].combine_chunks(), pa.array(n1), sums], ["name", "n1", "s1"])

    schema = edges.select("name", F.col("tn").alias("n1"), F.col("ts").alias("s1")).schema
    return both.coalesce(1).mapInArrow(solve, schema)


def _round(edges: DataFrame, verts: DataFrame, p: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round: the remaining edges and vertices, results of raked edges, bridged edges, and the table they come from."""
    at = lambda end, other: F.struct("name", F.col(other).alias("other"), F.lit(end == "a").alias("at_src"), "tn", "ts")
    ends = edges.select(F.col("a").alias("id"), at("a", "b").alias("e")).unionByName(edges.select(F.col("b").alias("id"), at("b", "a").alias("e")))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("d"), F.min("e").alias("e1"), F.max("e").alias("e2"))
    degree = cut_lineage(degree.withColumn("h", F.xxhash64("id", "d")))
    few = degree.where("d <= 2")
    near = degree.select(F.col("id").alias("_o"), F.col("d").alias("_d"), F.struct("h", "id").alias("_h"))
    for k in ("1", "2"):
        few = few.join(near.select(F.col("_o").alias(f"o{k}"), F.col("_d").alias(f"d{k}"), F.col("_h").alias(f"h{k}")), F.col(f"e{k}.other") == F.col(f"o{k}")).drop(f"o{k}")
    own = F.struct("h", "id")
    rake = (F.col("d") == 1) & ((F.col("d1") > 1) | (F.col("id") < F.col("e1.other")))
    alone = lambda k: (F.col(f"d{k}") >= 2) & ((F.col(f"d{k}") > 2) | (own < F.col(f"h{k}")))
    chosen = few.where(rake | ((F.col("d") == 2) & alone("1") & alone("2"))).select("id", "d", "e1", "e2")
    picked = cut_lineage(chosen.join(verts, "id"))
    drop_table(degree)
    raked, bridged = picked.where("d = 1"), picked.where("d = 2")
    done = raked.select("e1.*", "n", "s").select("name", *_src_side(F.col("at_src"), "n", "s", "tn", "ts"))
    # the bridge keeps the name of the first edge, whose end at the vertex becomes the far end of the second
    moved = bridged.select(F.col("e1.name").alias("name"), F.col("e1.at_src").alias("_src"), F.col("e2.other").alias("_to"))
    gone = raked.select(F.col("e1.name").alias("name")).unionByName(bridged.select(F.col("e2.name").alias("name")))
    left = edges.join(gone, "name", "left_anti").join(moved, "name", "left").select(
        "name", F.when(F.col("_src"), F.col("_to")).otherwise(F.col("a")).alias("a"), F.when(~F.col("_src"), F.col("_to")).otherwise(F.col("b")).alias("b"), "tn", "ts"
    )
    # a vertex that goes hands its sums on across the edge that goes with it: no other edge parts the two
    handed = raked.select(F.col("e1.other").alias("id"), "n", "s").unionByName(bridged.select(F.col("e2.other").alias("id"), "n", "s"))
    got = handed.groupBy("id").agg(F.sum("n").alias("_n"), array_sum("s", p).alias("_s"))
    grown = verts.join(picked.select("id"), "id", "left_anti").join(got, "id", "left").select(
        "id", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.when(F.col("_s").isNull(), F.col("s")).otherwise(_plus("s", "_s")).alias("s")
    )
    return left, grown, done, bridged, picked


def side_sums(edges: DataFrame, verts: DataFrame, p: int) -> DataFrame:
    """name, n1, s1: count and sums on the ``a`` side of every edge.

    ``edges``: name (unique, of any ordered type), a, b, tn, ts (count and sums of the whole tree); they form a forest.
    ``verts``: id, n, s. Work and written data are proportional to the forest.
    """
    e, v = cut_lineage(edges), cut_lineage(verts)
    results: list[DataFrame] = []
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while True:
        left = e.count()
        if left <= LOCAL_EDGES:
            if left:
                results.append(cut_lineage(_finish(e, v, p)))
            break
        le, lv, done, bridged, picked = _round(e, v, p)
        results.append(done)
        rounds.append((bridged, picked))
        before = (e, v)
        e, v = cut_lineage(le), cut_lineage(lv)
        for t in before:
            drop_table(t)
    if not results:
        return edges.limit(0).select("name", F.col("tn").alias("n1"), F.col("ts").alias("s1"))
    own = results[len(rounds) :]  # what the last step solved; results[i] are the raked edges of round i
    known = union_all(own) if own else results[-1].limit(0)
    tables: list[DataFrame] = list(own)
    for i in range(len(rounds) - 1, -1, -1):
        # edges that were bridged in this round follow from the edge that kept its name
        bridged, picked = rounds[i]
        known = known.unionByName(results[i])
        kept = bridged.select("e1.name", F.col("e1.at_src").alias("_src1"), "e2", "n", "s").join(known, "name")
        # the side of the kept edge away from the vertex
        away_n = F.when(~F.col("_src1"), F.col("n1")).otherwise(F.col("e2.tn") - F.col("n1"))
        away_s = F.when(~F.col("_src1"), F.col("s1")).otherwise(_minus("e2.ts", "s1"))
        with_own = kept.select("e2.*", (away_n + F.col("n")).alias("n"), _plus(away_s, F.col("s")).alias("s"))
        known = cut_lineage(known.unionByName(with_own.select("name", *_src_side(F.col("at_src"), "n", "s", "tn", "ts"))))
        for t in (*tables, picked):
            drop_table(t)
        tables = [known]
    drop_table(e)
    drop_table(v)
    return known


__all__ = ["LOCAL_EDGES", "array_sum", "side_sums", "strip_leaves"]
