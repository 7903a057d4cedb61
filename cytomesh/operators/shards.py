"""Sharding, per-shard summaries and alignment of shard clusters to a reference shard.

Everything is keyed by (shard_id, cluster); nothing depends on row positions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytomesh.functions import columns as C
from cytomesh.functions.kernels import transport_cost, w2_cov_term
from cytomesh.operators import starts
from cytomesh.operators.blocks import block_pairs
from cytomesh.operators.core import cut_lineage, drop_table, hashed_row_index, top_k_per_group, with_scalars
from cytomesh.operators.metrics import ari
from cytomesh.operators.prep import centroids, cov_matrix, proportions

# --------------------------------------------------------------------------- sharding


def assign_shards(df: DataFrame, n_shards: int, key: str = "cell_id", seed: int = 1) -> DataFrame:
    """Random disjoint shards 0..n-1 whose sizes differ by at most one; reproducible for any partitioning."""
    indexed = hashed_row_index(df, key, seed)
    return indexed.withColumn("shard_id", (F.col("row_index") % n_shards).cast("int")).drop("row_index")


def sample_n(df: DataFrame, n: int, key: str = "cell_id", seed: int = 1) -> DataFrame:
    """Exactly n rows (or all) from a hashed order; no task gathers the sample."""
    return hashed_row_index(df, key, seed).where(F.col("row_index") < n).drop("row_index")


def map_shards(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType, key: str = "shard_id") -> DataFrame:
    """Apply a function to every shard. A shard is one group by contract: make shards small with ``assign_shards``."""
    return df.groupBy(key).applyInPandas(fn, schema)


# --------------------------------------------------------------------------- summaries


def shard_summary(cells: DataFrame, p: int) -> tuple[DataFrame, DataFrame]:
    """(shard_id, cluster, n_obs, total_n, prop, mean) and one covariance per shard (shard_id, i, j, v)."""
    sizes = proportions(cells, "cluster", ["shard_id"])
    means = centroids(cells, ["shard_id", "cluster"], p).drop("n_obs")
    return sizes.join(means, ["shard_id", "cluster"]), cov_matrix(cells, p, ["shard_id"])


def shard_scores(cells: DataFrame, truth: str, label: str) -> tuple[DataFrame, DataFrame]:
    """ARI per shard, and its mean / median / min / max over shards."""
    per = ari(cells, truth, label, ["shard_id"])
    over = per.agg(
        F.count(F.lit(1)).alias("n_shards"),
        F.avg("ari").alias("mean_ari"),
        F.percentile("ari", 0.5).alias("median_ari"),
        F.min("ari").alias("min_ari"),
        F.max("ari").alias("max_ari"),
    )
    return per, over


# --------------------------------------------------------------------------- alignment


def flat_cov(cov: DataFrame, p: int) -> DataFrame:
    """shard_id, cov: each p x p matrix as a row-major array."""
    entry = F.sort_array(F.collect_list(F.struct("i", "j", "v")))
    return cov.groupBy("shard_id").agg(F.transform(entry, lambda e: e["v"]).alias("cov"))


def cov_terms(cov: DataFrame, ref_shard: int, p: int) -> DataFrame:
    """shard_id, cov_term against the reference shard. All clusters of a shard share one covariance, so this is
    one small eigenproblem per shard."""
    flat = flat_cov(cov, p)
    ref = flat.where(F.col("shard_id") == ref_shard).select(F.col("cov").alias("ref_cov"))

    def kernel(batches):
        for pdf in batches:
            if len(pdf):
                a = np.stack(pdf["cov"].to_list()).reshape(-1, p, p)
                b = np.stack(pdf["ref_cov"].to_list()).reshape(-1, p, p)
                yield pd.DataFrame({"shard_id": pdf["shard_id"], "cov_term": w2_cov_term(a, b)})

    t = dict(cov.dtypes)["shard_id"]
    return with_scalars(flat, ref).mapInPandas(kernel, f"shard_id {t}, cov_term double")


def gaussian_w2(pairs: DataFrame, p: int) -> DataFrame:
    """Adds ``w2`` to rows holding mean1, cov1, mean2, cov2 (row-major arrays)."""
    def kernel(batches):
        for pdf in batches:
            if len(pdf):
                a = np.stack(pdf["cov1"].to_list()).reshape(-1, p, p)
                b = np.stack(pdf["cov2"].to_list()).reshape(-1, p, p)
                yield pdf.assign(cov_term=w2_cov_term(a, b))

    schema = T.StructType([*pairs.schema.fields, T.StructField("cov_term", T.DoubleType())])
    out = pairs.mapInPandas(kernel, schema)
    return out.withColumn("w2", F.sqrt(C.array_sq_distance("mean1", "mean2") + F.col("cov_term"))).drop("cov_term")


def cost_matrix(summary: DataFrame, cov: DataFrame, ref_shard: int, p: int) -> DataFrame:
    """shard_id, cluster, n_obs, ref_cluster, cost: 2-Wasserstein distances of local to reference clusters.

    The reference clusters of one shard travel as an array next to the local rows.
    """
    ref = summary.where(F.col("shard_id") == ref_shard).agg(
        F.collect_list(F.struct(F.col("cluster").alias("ref_cluster"), F.col("mean").alias("ref_mean"))).alias("refs")
    )
    local = summary.select("shard_id", "cluster", "n_obs", "mean").join(cov_terms(cov, ref_shard, p), "shard_id")
    long = with_scalars(local, ref).select("*", F.explode("refs").alias("r"))
    cost = F.sqrt(F.greatest(C.array_sq_distance("mean", "r.ref_mean") + F.col("cov_term"), F.lit(0.0)))
    return long.select("shard_id", "cluster", "n_obs", "r.ref_cluster", cost.alias("cost"))


def soft_assign(cost: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Softmax of the negative cost per local cluster; windows run over at most K reference clusters."""
    w = W.partitionBy("shard_id", "cluster")
    e = F.exp(-(F.col("cost") - F.min("cost").over(w)) / F.lit(float(temperature)))
    return cost.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def hard_assign(soft: DataFrame) -> DataFrame:
    """Most probable reference cluster; the smaller cluster id wins a tie."""
    return top_k_per_group(soft, ["shard_id", "cluster"], [F.desc("p"), F.asc("ref_cluster")], 1).drop("rk")


def confidence(soft: DataFrame) -> DataFrame:
    best = soft.groupBy("shard_id", "cluster").agg(F.max("p").alias("p"))
    return best.agg(F.avg("p").alias("confidence"))


def global_params(hard: DataFrame, summary: DataFrame, ref_shard: int, p: int) -> DataFrame:
    """ref_cluster, n_obs, weight, mean: pooled means and weights; a reference cluster that nothing maps to keeps
    its own mean with weight 0. The covariance stays that of the reference shard."""
    members = hard.select("shard_id", "cluster", "ref_cluster").join(
        summary.select("shard_id", "cluster", "n_obs", "mean"), ["shard_id", "cluster"]
    )
    sums = members.groupBy("ref_cluster").agg(
        F.sum("n_obs").alias("w"), *[F.sum(F.col("mean")[i] * F.col("n_obs")).alias(f"s{i}") for i in range(p)]
    )
    pooled = sums.select("ref_cluster", "w", F.array(*[F.col(f"s{i}") / F.col("w") for i in range(p)]).alias("pooled"))
    ref = summary.where(F.col("shard_id") == ref_shard).select(F.col("cluster").alias("ref_cluster"), "mean")
    j = ref.join(pooled, "ref_cluster", "left")
    n = F.coalesce("w", F.lit(0))
    total = F.sum(n).over(W.partitionBy(F.lit(0)))
    return j.select(
        "ref_cluster", n.cast("bigint").alias("n_obs"), (n / total).alias("weight"), F.coalesce("pooled", "mean").alias("mean")
    )


def shard_distances(summary: DataFrame, p: int) -> DataFrame:
    """shard_id, avg_cost: mean exact transport cost to all shards (the zero to itself included).

    A shard is one row with its few weighted centroids; pairs are handled in bounded blocks of shards.
    """
    rows = summary.groupBy("shard_id").agg(
        F.sort_array(F.collect_list(F.struct("cluster", F.col("n_obs").cast("double").alias("w"), "mean"))).alias("c")
    )
    flat = rows.select(
        "shard_id", F.transform("c", lambda c: c["w"]).alias("w"), F.flatten(F.transform("c", lambda c: c["mean"])).alias("m")
    )

    def kernel(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, wi, mi in zip(q["shard_id"], q["w"], q["m"]):
            a = np.asarray(mi, float).reshape(-1, p)
            for j, wj, mj in zip(d["shard_id"], d["w"], d["m"]):
                if i < j:
                    b = np.asarray(mj, float).reshape(-1, p)
                    ground = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
                    out.append((i, j, transport_cost(np.asarray(wi, float), np.asarray(wj, float), ground)))
        return pd.DataFrame(out, columns=["a", "b", "cost"])

    t = dict(summary.dtypes)["shard_id"]
    pairs = block_pairs(flat, "shard_id", kernel, f"a {t}, b {t}, cost double", block_rows=16)
    sides = pairs.select(F.explode(F.array("a", "b")).alias("shard_id"), "cost")
    n = flat.agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = sides.groupBy("shard_id").agg(F.sum("cost").alias("cost"))
    everyone = with_scalars(flat.select("shard_id"), n).join(total, "shard_id", "left")
    return everyone.select("shard_id", (F.coalesce("cost", F.lit(0.0)) / F.col("n")).alias("avg_cost"))


#: Shards whose exact costs are found in one pass.
CANDIDATES = 8


def select_reference_shard(summary: DataFrame, p: int) -> DataFrame:
    """One row: the shard with the smallest mean cost (smallest id on a tie).

    Moving one set of weighted centroids onto another costs at least the squared distance of their means, and the mean of
    these bounds over all shards has a closed form. Shards are therefore looked at in the order of their bounds, a few a
    pass, and the search ends at a bound above the best exact cost: other pairs of shards need no transport.
    """
    w = F.col("n_obs").cast("double")
    rows = summary.groupBy("shard_id").agg(
        F.sort_array(F.collect_list(F.struct("cluster", w.alias("w"), "mean"))).alias("c"), F.array(*[F.sum(F.col("mean")[i] * w) / F.sum(w) for i in range(p)]).alias("centre")
    )
    flat = cut_lineage(rows.select("shard_id", "centre", F.transform("c", lambda c: c["w"]).alias("w"), F.flatten(F.transform("c", lambda c: c["mean"])).alias("m")))
    zero = [F.sum(F.col("centre")[i]) for i in range(p)]
    square = F.aggregate("centre", F.lit(0.0), lambda a, x: a + x * x)
    whole = flat.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.array(*zero).alias("_s"), F.sum(square).alias("_q"))
    cross = F.aggregate(F.zip_with("centre", "_s", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    bound = (square + (F.col("_q") - cross * 2.0) / F.col("_n")) * (1 - 1e-9) - (square + F.col("_q") / F.col("_n")) * 1e-12
    bounded = cut_lineage(with_scalars(flat, whole).withColumn("bound", bound))
    best: tuple[float, object] | None = None
    last = None
    while True:
        left = bounded if last is None else bounded.where((F.col("bound") > last[0]) | ((F.col("bound") == last[0]) & (F.col("shard_id") > F.lit(last[1]))))
        few = left.orderBy("bound", "shard_id").limit(CANDIDATES).collect()
        if best is not None:
            few = [r for r in few if r["bound"] <= best[0]]
        if not few:
            break
        last = (few[-1]["bound"], few[-1]["shard_id"])
        sets = [(np.asarray(r["w"]), np.asarray(r["m"]).reshape(-1, p)) for r in few]

        def kernel(batches, sets=sets):
            total, n = np.zeros(len(sets)), 0
            for pdf in batches:
                for wi, mi in zip(pdf["w"], pdf["m"]):
                    b = np.asarray(mi, float).reshape(-1, p)
                    for k, (wk, a) in enumerate(sets):
                        ground = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
                        total[k] += transport_cost(wk, np.asarray(wi, float), ground)
                    n += 1
            yield pd.DataFrame({"k": np.arange(len(sets)), "cost": total, "n": n})

        found = flat.select("w", "m").mapInPandas(kernel, "k int, cost double, n long").groupBy("k").agg((F.sum("cost") / F.sum("n")).alias("c")).collect()
        for r in found:
            one = (round(r["c"], 12), few[r["k"]]["shard_id"])
            best = one if best is None or one < best else best
    kind = dict(summary.dtypes)["shard_id"]
    drop_table(flat)
    drop_table(bounded)
    return summary.sparkSession.createDataFrame([] if best is None else [(best[1], best[0])], f"shard_id {kind}, avg_cost double")


def align(cells: DataFrame, ref_shard: int, p: int) -> dict[str, DataFrame]:
    """Summaries -> costs -> soft and hard assignment -> pooled parameters.

    The cost table has S x K x K rows; it is cut from the cell-level plan once and shared by all results.
    """
    return align_summaries(*shard_summary(cells, p), ref_shard, p)


def align_summaries(summary: DataFrame, cov: DataFrame, ref_shard: int, p: int) -> dict[str, DataFrame]:
    """The same from summaries that were computed before, as ``readers.read_shard_summaries`` brings them."""
    summary = cut_lineage(summary)
    soft = cut_lineage(soft_assign(cost_matrix(summary, cov, ref_shard, p)))
    hard = hard_assign(soft)
    return {"summary": summary, "soft": soft, "hard": hard, "params": global_params(hard, summary, ref_shard, p)}


def final_assignments(cells: DataFrame, hard: DataFrame) -> DataFrame:
    """Every cell with its metacluster; annotated or not."""
    from cytomesh.operators.joins import apply_alignment

    return apply_alignment(cells, hard).withColumnRenamed("ref_cluster", "metacluster")


# --------------------------------------------------------------------------- clustering every shard at once


def kmeans_by_shard(cells: DataFrame, k: int, p: int, iters: int = 1000, seeds: Sequence[int] = tuple(range(1, 21)), vector: str = "pcs") -> DataFrame:
    """Lloyd's algorithm for all shards and starts in the same passes: shard_id, cell_id, cluster (0-based) from the start
    of least cost of every shard. A huge shard is just more blocks; cells with missing values are left out."""
    packed = starts.blocks(cells, "cell_id", p, vector, by="shard_id")
    state = starts.lloyd(packed, [starts.Run(i, k, p, s) for i, s in enumerate(seeds)], p, iters)
    best = top_k_per_group(state, ["grp"], [F.asc("total"), F.asc("run")], 1)
    return starts.labels(packed, best, p).select(F.col("grp").alias("shard_id"), F.col("key").alias("cell_id"), F.col("c").alias("cluster"))


__all__: Sequence[str] = [
    "assign_shards", "sample_n", "map_shards", "shard_summary", "shard_scores", "cost_matrix", "soft_assign",
    "hard_assign", "confidence", "global_params", "select_reference_shard", "align", "align_summaries", "final_assignments",
    "kmeans_by_shard", "gaussian_w2", "shard_distances",
]
