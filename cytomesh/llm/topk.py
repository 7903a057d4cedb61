"""Exact search for the largest inner products with a pivot-distance index.

A vector x gets one more component, sqrt(M - |x|^2) with M the largest squared length, and a query gets 0 there. Then
|q - x|^2 = |q|^2 + M - 2 q.x, so the largest inner products are the nearest vectors.

* Index: every vector is keyed by its nearest pivot and its distance to it. The distances of a pivot are cut into
  annuli at quantiles, and an annulus into blocks of at most about ``BLOCK`` rows by a hash, so equal vectors, however many,
  fill many blocks. Pivots come from a bounded sample (``SAMPLE`` rows, by the hash of the id) and are farthest-first;
  they decide speed only. All vectors are indexed.
* Search: a query first visits the annulus around its own distance from the nearest pivots. The score it can be sure
  of then bounds the distance of every better vector, and by the triangle inequality only annuli that come within that
  distance of it, seen from their pivot, are visited next. Everything else is provably worse. Blocks are scored by one
  matrix product, exactly.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, neither as queries
nor as candidates. Vectors of another length count as padded with zeros. A query is not its own candidate; rows that
repeat an id are the query's own and no candidates of it, and repeated query rows are answered once. Equal scores go
to the smaller id; a candidate id that is repeated appears as often as it is stored. Fewer than k candidates are all
returned. Components are whole numbers; products that a float64 cannot hold exactly are computed in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytomesh.llm.common import hash_sample, table, written

#: Fixed by the task.
K = 5
EVERY = 50
SCALE = 256

PIVOTS = 48
SAMPLE = 4096
ANNULI = 24
BLOCK = 4096
#: Visits of queries to blocks that leave a task together, each with a copy of its vector.
VISITS = 8192
#: Pivots whose annulus a query visits first.
FIRST_PIVOTS = 2
#: Relative room for rounding in distances, which only decide what is visited.
ROUNDING = 1e-9

ROWS = "vec_id bigint, v array<bigint>"


def whole_vectors(df: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``: floor(scale * x) of every component; rows that take no part are left out."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & finite
    return df.where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as int64, padded with zeros."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lens) and (lens == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lens), width), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.concatenate([np.arange(n) for n in lens]) if len(lens) else []] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top >= 2.0**63:
        raise OverflowError("inner products leave 64 bits")
    return q @ x.T


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first rows of the sample."""
    chosen = [0] if len(sample) else []
    far = ((sample - sample[:1]) ** 2).sum(axis=1) if len(sample) else np.zeros(0)
    while len(chosen) < n and len(far) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


class Geometry:
    """What tasks need to place vectors: the lifted pivots."""

    def __init__(self, width: int, longest: float, sample: np.ndarray, pivots: int):
        self.width, self.longest = width, longest
        self.pivots = choose_pivots(self.lifted(sample), pivots)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.longest - (x * x).sum(axis=1)))[:, None]], axis=1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """Rows by pivots."""
        squares = (lifted**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0.0))

    def slack(self) -> float:
        """Bound of the rounding error of a distance: of the square root of a cancelled difference."""
        return float(np.sqrt(4 * max(self.longest, 1.0) * 1e-12 * self.width))


class Index:
    """Written index rows with the small tables that lead to them: pivots, and borders of their annuli."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, annuli: int = ANNULI):
        lengths = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        top = vectors.agg(F.max(lengths).alias("m"), F.max(F.size("v")).alias("w"), F.count(F.lit(1)).alias("n")).first()
        self.empty = top["w"] is None
        if self.empty:
            return
        sample = hash_sample(vectors, top["n"], SAMPLE, "vec_id", "v").toArrow().column("v").combine_chunks()
        self.geometry = Geometry(top["w"], top["m"] * (1 + ROUNDING), _matrix(sample, top["w"]), pivots)
        self.rows, self.annuli = self._build(vectors, annuli)

    def _build(self, vectors: DataFrame, annuli: int) -> tuple[DataFrame, list[list[tuple]]]:
        geometry = self.geometry

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = geometry.distances(geometry.lifted(_matrix(batch.column("v"), geometry.width)))
                    nearest = d.argmin(axis=1)
                    arrays = [*batch.columns, pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(d)), nearest])]
                    yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "v", "pivot", "dist"])

        keyed_rows = written(vectors.mapInArrow(keyed, ROWS + ", pivot int, dist double"))
        cuts = F.percentile_approx("dist", [i / annuli for i in range(1, annuli)], F.lit(1000)).alias("cuts")
        borders = keyed_rows.groupBy("pivot").agg(cuts)  # one row a pivot
        ring = F.size(F.filter("cuts", lambda c: c < F.col("dist"))).alias("ring")
        rows = keyed_rows.join(F.broadcast(borders), "pivot").select("pivot", ring, "vec_id", "v", "dist")
        # at most pivots * annuli rows
        found = rows.groupBy("pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
        by_pivot: list[list[tuple]] = [[] for _ in range(len(geometry.pivots))]
        for r in sorted(found, key=lambda r: (r["pivot"], r["ring"])):
            by_pivot[r["pivot"]].append((r["ring"], r["lo"], r["hi"], -(-r["n"] // BLOCK)))
        return rows, by_pivot


def _block(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id"), chunks).cast("int")


def search(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, vec_id, score of the k best candidates of every query, with ``rank`` from 1."""
    spark = queries.sparkSession
    if index.empty:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    geometry, annuli = index.geometry, index.annuli
    width, slack = geometry.width, geometry.slack()
    sizes = spark.createDataFrame([(p, a[0], a[3]) for p, x in enumerate(annuli) for a in x], "pivot int, ring int, blocks int")
    stored = written(index.rows.join(F.broadcast(sizes), ["pivot", "ring"]).withColumn("block", _block(F.col("blocks"))).select("pivot", "ring", "block", "vec_id", "v"))
    lifted_query = lambda q: np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)

    def routed(first: bool):
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column("v"), width)
                d = geometry.distances(lifted_query(q))
                squares = (q.astype(np.float64) ** 2).sum(axis=1)
                # best possible squared distance of a vector that could still enter the result
                worst = batch.column("sure").to_numpy(zero_copy_only=False) if not first else None
                rows: list[tuple[int, int, int, int]] = []

                def visits() -> pa.RecordBatch:
                    at = pa.array([r[0] for r in rows], pa.int64())
                    cols = [pa.array([r[c] for r in rows], pa.int32()) for c in (1, 2, 3)]
                    return pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("v").take(at), *cols], ["vec_id", "v", "pivot", "ring", "block"])

                for i in range(len(q)):
                    for rank, p in enumerate(np.argsort(d[i], kind="stable")):
                        rings = annuli[p]
                        if first:
                            if rank >= FIRST_PIVOTS or not rings:
                                break
                            near = min(rings, key=lambda a: max(a[1] - d[i, p], d[i, p] - a[2], 0.0))
                            take = [near]
                        else:
                            reach = np.inf if np.isnan(worst[i]) else np.sqrt(max(0.0, squares[i] + geometry.longest - 2 * worst[i])) * (1 + ROUNDING) + slack
                            take = [a for a in rings if d[i, p] - a[2] <= reach and a[1] - d[i, p] <= reach]
                        for a in take:
                            for b in range(a[3]):
                                rows.append((i, int(p), a[0], b))
                                if len(rows) >= VISITS:
                                    yield visits()
                                    rows.clear()
                if rows:
                    yield visits()

        return route

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stored rows of a block come first, then the queries that visit it, a batch at a time."""
        key, ids, parts, x = None, [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("pivot", "ring", "block", "kind")), strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                part = batch.slice(at, end - at)
                if keys[at][:3] != key:
                    key, ids, parts, x = keys[at][:3], [], [], None
                m, own = _matrix(part.column("v"), width), part.column("vec_id").to_numpy()
                if keys[at][3] == 0:
                    ids.append(own)
                    parts.append(m)
                elif parts:
                    if x is None:
                        x, held = np.concatenate(parts), np.concatenate(ids)
                        order = np.argsort(held, kind="stable")  # equal scores: smaller ids first
                        x, held = x[order], held[order]
                    for a in range(0, len(m), 256):
                        s = products(m[a : a + 256], x)
                        out: list[tuple[int, int, int]] = []
                        for qid, row in zip(own[a : a + 256].tolist(), s, strict=True):
                            other = np.flatnonzero(held != qid)
                            top = other
                            if len(other) > k:
                                cut = np.partition(row[other], len(other) - k)[len(other) - k]
                                top = np.concatenate([other[row[other] > cut], other[row[other] == cut][:k]])
                            out += [(qid, int(held[t]), int(row[t])) for t in top]
                        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])
                at = end

    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def visit(visits: DataFrame) -> DataFrame:
        rows = stored.withColumn("kind", F.lit(0)).unionByName(visits.select("pivot", "ring", "block", "vec_id", "v").withColumn("kind", F.lit(1)))
        dealt = rows.repartition("pivot", "ring", "block").sortWithinPartitions("pivot", "ring", "block", "kind")
        got = dealt.mapInArrow(scored, "query_id bigint, vec_id bigint, score bigint")
        return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    own = written(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")))
    routes = "vec_id bigint, v array<bigint>, pivot int, ring int, block int"
    found = written(visit(own.mapInArrow(routed(True), routes)))
    # the score that the k-th of the candidates seen so far has for sure
    sure = found.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("sure"))
    return visit(own.join(sure, "query_id", "left").mapInArrow(routed(False), routes)).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM w q JOIN w c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return search(Index(vectors), vectors.where(F.col("vec_id") % EVERY == 0))
