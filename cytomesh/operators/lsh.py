"""Approximate neighbours in feature space: random projections, several probes, exact distances.

A table cuts a few random projections at their quantiles, so its buckets have about equal sizes; a row is stored in its
bucket and also asks in the buckets next to the borders it is closest to. Larger buckets (repeated rows) are dealt into
parts of bounded size. The best neighbours of all tables are then improved by looking at neighbours of neighbours, whose
true distances decide. Work is rows x (tables x probes x bucket + k^2), not rows squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomesh.functions import columns as C
from cytomesh.functions.kernels import pairwise_distance, smallest_k
from cytomesh.operators.core import cut_lineage, drop_table, keyed_join, top_k_per_group

TABLES, PROBES, ROUNDS = 6, 2, 2
#: Rows of a bucket that are compared with each other.
BUCKET = 512
CUTS_SAMPLE = 200  # accuracy of the quantiles that cut a projection


class Projections:
    """Random directions of all tables and the cuts along each."""

    def __init__(self, p: int, tables: int, directions: int, cells: int, seed: int):
        rng = np.random.default_rng(seed)
        self.shape = (tables, directions)
        self.axes = np.concatenate([np.linalg.qr(rng.standard_normal((p, min(directions, p))))[0] for _ in range(tables)], axis=1)
        self.shape = (tables, self.axes.shape[1] // tables)
        self.cells = cells
        self.cuts = np.zeros((self.axes.shape[1], cells - 1))

    def places(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes

    def buckets(self, x: np.ndarray, probes: int) -> Iterator[tuple[int, np.ndarray, bool]]:
        """Per table the buckets of the rows, then those on the other side of their nearest borders."""
        at = self.places(x)
        tables, directions = self.shape
        for t in range(tables):
            own = np.arange(t * directions, (t + 1) * directions)
            cell = np.stack([np.searchsorted(self.cuts[j], at[:, j], "right") for j in own], axis=1)
            weight = self.cells ** np.arange(directions)
            yield t, cell @ weight, True
            gaps = np.full((len(x), directions, 2), np.inf)
            for d, j in enumerate(own):
                below, above = cell[:, d] > 0, cell[:, d] < self.cells - 1
                gaps[below, d, 0] = at[below, j] - self.cuts[j][cell[below, d] - 1]
                gaps[above, d, 1] = self.cuts[j][cell[above, d]] - at[above, j]
            flat = gaps.reshape(len(x), -1)
            for which in np.argsort(flat, axis=1, kind="stable")[:, :probes].T:
                step = np.where(which % 2 == 0, -1, 1) * weight[which // 2]
                there = np.isfinite(flat[np.arange(len(x)), which])
                yield t, np.where(there, cell @ weight + step, -1), False


def feature_knn_lsh(
    df: DataFrame, key: str, p: int, k: int, vector: str = "pcs", tables: int = TABLES, probes: int = PROBES, rounds: int = ROUNDS, bucket: int = BUCKET, seed: int = 1
) -> DataFrame:
    """src, dst, d, rk: about the k nearest neighbours by embedding, by distance, then dst. ``d`` is exact; a neighbour may
    be missed. Rows with missing values take no part; ``key`` is unique."""
    v = F.slice(F.col(vector), 1, p).cast("array<double>")
    rows = df.select(F.col(key).alias("id"), v.alias("v"))
    rows = cut_lineage(rows.where((F.size("v") == p) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))))
    n = rows.count()
    kind = dict(rows.dtypes)["id"]
    directions = max(1, min(p, int(np.ceil(np.log2(max(n / bucket, 1)) / 2)) or 1))
    cells = max(1, int(np.ceil(max(n / bucket, 1) ** (1 / directions))))
    made = Projections(p, tables, directions, cells, seed)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = made.places(batch.column("v").flatten().to_numpy().reshape(-1, p))
            for j in range(at.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j, np.int32)), pa.array(at[:, j])], ["j", "at"])

    if cells > 1:
        probs = [i / cells for i in range(1, cells)]
        found = rows.select("v").mapInArrow(project, "j int, at double").groupBy("j").agg(F.percentile_approx("at", probs, F.lit(CUTS_SAMPLE * cells)).alias("cuts"))
        for r in found.collect():  # a row per direction
            made.cuts[r["j"]] = r["cuts"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, p)
            for t, where, stored in made.buckets(x, probes):
                at = np.flatnonzero(where >= 0)
                cols = [np.full(len(at), t, np.int32), where[at].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], pa.array(np.full(len(at), stored)), batch.column("id").take(pa.array(at)), batch.column("v").take(pa.array(at))], ["t", "b", "stored", "id", "v"])

    dealt = cut_lineage(rows.mapInArrow(deal, f"t int, b bigint, stored boolean, id {kind}, v array<double>"))
    sizes = dealt.groupBy("t", "b").agg(F.ceil(F.count_if("stored") / (2.0 * bucket)).cast("int").alias("_s"), F.ceil(F.count(F.lit(1)) / (8.0 * bucket)).cast("int").alias("_a"))
    parts = F.greatest(F.lit(1), "_s", "_a")  # a large bucket is dealt by hash
    chunked = keyed_join(dealt, sizes, ["t", "b"]).select("t", "b", F.pmod(F.xxhash64("id", "t"), parts).alias("c"), "stored", "id", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stored, asking in zip(batch.column("stored"), batch.column("asking"), strict=True):
                own = stored.values
                if not len(own):
                    continue
                d_id, q = own.field("id"), pa.concat_arrays([own, asking.values])
                q_id = q.field("id")
                data = own.field("v").flatten().to_numpy().reshape(-1, p)
                queries = q.field("v").flatten().to_numpy().reshape(-1, p)
                names = pa.concat_arrays([d_id, q_id]).dictionary_encode().indices.to_numpy()
                di, qi = names[: len(d_id)], names[len(d_id) :]
                dist = pairwise_distance(queries, data)
                dist[qi[:, None] == di[None, :]] = np.inf
                order = pa.compute.sort_indices(d_id).to_numpy()  # ties to the smaller id
                best = order[smallest_k(dist[:, order], np.arange(len(order)), k)]
                d = np.take_along_axis(dist, best, 1).ravel()
                ok = np.flatnonzero(np.isfinite(d))
                src = np.repeat(np.arange(len(queries)), best.shape[1])[ok]
                yield pa.RecordBatch.from_arrays([q_id.take(pa.array(src)), d_id.take(pa.array(best.ravel()[ok])), pa.array(d[ok])], ["src", "dst", "d"])

    member = F.struct("id", "v")
    grouped = chunked.groupBy("t", "b", "c").agg(
        F.collect_list(F.when(F.col("stored"), member)).alias("stored"), F.collect_list(F.when(~F.col("stored"), member)).alias("asking")
    )
    edge = f"src {kind}, dst {kind}, d double"
    best = _best(grouped.select("stored", "asking").mapInArrow(compare, edge), k)
    drop_table(dealt)
    for _ in range(rounds):
        before, best = best, _best(best.unionByName(_further(best, rows)), k)
        drop_table(before)
    out = top_k_per_group(best, ["src"], [F.asc("d"), F.asc("dst")], k)
    return out.select("src", "dst", "d", "rk")


def _best(edges: DataFrame, k: int) -> DataFrame:
    return cut_lineage(top_k_per_group(edges.distinct(), ["src"], [F.asc("d"), F.asc("dst")], k).select("src", "dst", "d"))


def _further(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Distances to neighbours of neighbours, and to rows that have one as a neighbour."""
    back = top_k_per_group(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d"), ["src"], [F.asc("d"), F.asc("dst")], 8)
    near = edges.select("src", "dst").unionByName(back.select("src", "dst")).distinct()
    two = near.select(F.col("src").alias("_a"), F.col("dst").alias("_m")).join(near.select(F.col("src").alias("_m"), F.col("dst").alias("_b")), "_m")
    pairs = two.where("_a <> _b").select("_a", "_b").distinct().join(edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b")), ["_a", "_b"], "left_anti")
    for end, name in (("_a", "_va"), ("_b", "_vb")):
        pairs = keyed_join(pairs, rows.select(F.col("id").alias(end), F.col("v").alias(name)), [end])
    return pairs.select(F.col("_a").alias("src"), F.col("_b").alias("dst"), F.sqrt(C.array_sq_distance("_va", "_vb")).alias("d"))


__all__ = ["feature_knn_lsh"]
