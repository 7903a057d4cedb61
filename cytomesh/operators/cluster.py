"""Variable genes, components, clustering and partition scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomesh.operators import starts
from cytomesh.operators.core import cut_lineage, null_safe_join, quantiles_long, top_k_per_group, with_scalars
from cytomesh.operators.forest import array_sum, side_sums
from cytomesh.operators.graph import connected_components
from cytomesh.operators.metrics import ari
from cytomesh.operators.principal import pca, pca_counts

ANCHORS = 33

#: Starts and rounds that the compared methods use.
KMEANS_SEEDS, KMEANS_ROUNDS = tuple(range(1, 21)), 1000
MIXTURE_SEEDS = tuple(range(1, 11))


# --------------------------------------------------------------------------- features


def select_hvg(moments: DataFrame, n: int = 2000, span: float = 0.3, min_mean: float = 0.01) -> DataFrame:
    """gene_id, mean, variance, residual, highly_variable: genes above the mean-variance trend.

    The trend of log10(var + 1) on log10(mean + 1) is a tricube-weighted local quadratic at anchors placed at
    equal shares of genes; each window covers ``span`` of the genes. Between anchors it is interpolated.
    """
    g = moments.where(F.col("mean") > min_mean).select(
        "gene_id", "mean", "variance", F.log10(F.col("mean") + 1).alias("x"), F.log10(F.col("variance") + 1).alias("y")
    )
    names, probs = [], []
    for i in range(ANCHORS):
        q = i / (ANCHORS - 1)
        lo = min(max(q - span / 2, 0.0), 1 - span)
        names += [f"c{i}", f"l{i}", f"h{i}"]
        probs += [q, lo, lo + span]
    pos = {names[row["i"]]: row["q"] for row in quantiles_long(g, "x", probs).collect()}  # three rows per anchor
    if not pos:
        return g.select("gene_id", "mean", "variance", F.lit(0.0).alias("residual"), F.lit(False).alias("highly_variable"))
    anchors = []
    for i in range(ANCHORS):
        c = pos[f"c{i}"]
        anchors.append((i, c, max(c - pos[f"l{i}"], pos[f"h{i}"] - c, 1e-9) * (1 + 1e-9)))
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(b).alias("b")) for i, c, b in anchors])
    inside = F.filter(arr, lambda a: F.abs(F.col("x") - a["c"]) < a["b"])
    u = (F.col("x") - F.col("a.c")) / F.col("a.b")
    t = F.lit(1.0) - F.pow(F.abs(u), 3)
    w = t * t * t
    sums = g.withColumn("a", F.explode(inside)).groupBy("a.i").agg(
        *[F.sum(w * F.pow(u, d)).alias(f"s{d}") for d in range(5)], *[F.sum(w * F.pow(u, d) * F.col("y")).alias(f"t{d}") for d in range(3)]
    )
    fit = {}
    for r in sums.collect():  # one row per anchor
        m = np.array([[r[f"s{a + b}"] for b in range(3)] for a in range(3)])
        fit[r["i"]] = float(np.linalg.lstsq(m, np.array([r["t0"], r["t1"], r["t2"]]), rcond=None)[0][0])
    xs, ys = [], []
    for i, c, _ in anchors:
        if i in fit and (not xs or c > xs[-1]):
            xs.append(c)
            ys.append(fit[i])
    knots = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in zip(xs, ys)])
    left = F.element_at(F.filter(knots, lambda k: k["x"] <= F.col("x")), -1)
    right = F.filter(knots, lambda k: k["x"] > F.col("x"))
    r0 = F.when(F.size(right) > 0, right[0])
    slope = (r0["y"] - left["y"]) / (r0["x"] - left["x"])
    trend = F.when(r0.isNull(), F.lit(ys[-1])).otherwise(left["y"] + slope * (F.col("x") - left["x"]))
    res = g.select("gene_id", "mean", "variance", (F.col("y") - trend).alias("residual"))
    top = res.orderBy(F.desc("residual"), F.asc("gene_id")).limit(n).select("gene_id", F.lit(True).alias("_hv"))
    return res.join(top, "gene_id", "left").withColumn("highly_variable", F.coalesce("_hv", F.lit(False))).drop("_hv")


# --------------------------------------------------------------------------- clustering


def _best(state: DataFrame, by: Sequence[str], largest: bool = False) -> DataFrame:
    """The run with the best total of every group; equal ones by their number."""
    order = F.desc("total") if largest else F.asc("total")
    return top_k_per_group(state, by, [order, F.asc("run")], 1)


def kmeans(df: DataFrame, k: int, p: int, seeds: Sequence[int] = KMEANS_SEEDS, iters: int = KMEANS_ROUNDS, vector: str = "pcs", key: str = "cell_id") -> DataFrame:
    """key, cluster (1-based) from the start with the lowest within-cluster cost; all starts share their passes over the
    data. Rows with missing values have no cluster and are left out."""
    packed = starts.blocks(df, key, p, vector)
    state = starts.lloyd(packed, [starts.Run(i, k, p, s) for i, s in enumerate(seeds)], p, iters)
    return starts.labels(packed, _best(state, ["grp"]), p).select(F.col("key").alias(key), (F.col("c") + 1).alias("cluster"))


def gmm(df: DataFrame, k: int, p: int, seeds: Sequence[int] = MIXTURE_SEEDS, vector: str = "pcs", key: str = "cell_id", iters: int = 100) -> DataFrame:
    """key, cluster (1-based) from the Gaussian mixture with the highest likelihood; see ``kmeans``."""
    packed = starts.blocks(df, key, p, vector)
    state = starts.mixtures(packed, [starts.Run(i, k, p, s) for i, s in enumerate(seeds)], p, iters)
    found = starts.labels(packed, _best(state, ["grp"], largest=True), p, mixture=True)
    return found.select(F.col("key").alias(key), (F.col("c") + 1).alias("cluster"))


def sweep(df: DataFrame, ks: Sequence[int], ps: Sequence[int], truth: str, seeds: Sequence[int] = KMEANS_SEEDS, vector: str = "pcs", key: str = "cell_id") -> DataFrame:
    """k, p, ari: k-means for every setting, all settings and starts in the same passes."""
    settings = [(k, p, s) for p in ps for k in ks for s in seeds]
    runs = [starts.Run(i, k, p, s) for i, (k, p, s) in enumerate(settings)]
    packed = starts.blocks(df, key, max(ps), vector)
    best = cut_lineage(_best(starts.lloyd(packed, runs, max(ps), KMEANS_ROUNDS), ["grp", "k", "p"]).drop("rk"))
    found = starts.labels(packed, best, max(ps)).join(F.broadcast(best.select("run", "k", "p")), "run")  # one row a setting
    labelled = found.select(F.col("key").alias(key), "k", "p", (F.col("c") + 1).alias("cluster")).join(df.select(key, truth), key)
    return ari(labelled, truth, "cluster", ["k", "p"])


def select_k(df: DataFrame, ks: Sequence[int], p: int, seeds: Sequence[int] = MIXTURE_SEEDS, vector: str = "pcs", key: str = "cell_id", iters: int = 100) -> DataFrame:
    """k, log_likelihood, bic, best: Gaussian mixtures, each from its likeliest start, by -2 log L + parameters * ln n."""
    packed = starts.blocks(df, key, p, vector)
    runs = [starts.Run(i, k, p, s) for i, (k, s) in enumerate((k, s) for k in ks for s in seeds)]
    n = packed.agg(F.sum(F.size("keys")).cast("double").alias("n"))
    top = starts.mixtures(packed, runs, p, iters).groupBy("k").agg(F.max("total").alias("log_likelihood"))
    params = (F.col("k") - 1) + F.col("k") * p + F.col("k") * (p * (p + 1) // 2)
    scored = with_scalars(top, n).select("k", "log_likelihood", (F.col("log_likelihood") * -2 + params * F.log("n")).alias("bic"))
    low = scored.agg(F.min("bic").alias("_low"))
    return with_scalars(scored, low).select("k", "log_likelihood", "bic", (F.col("bic") == F.col("_low")).alias("best"))


# --------------------------------------------------------------------------- partition scores


def _sums(df: DataFrame, p: int, by: Sequence[str], vector: str = "pcs") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(vector)[i]) for i in range(p)]).alias("s")
    )


def _cross_products(df: DataFrame, p: int, by: Sequence[str] = (), vector: str = "pcs") -> DataFrame:
    aggs = [F.sum(F.col(vector)[i] * F.col(vector)[j]) for i in range(p) for j in range(p)]
    one = F.array(*aggs).alias("yy")
    return df.groupBy(*by).agg(one) if by else df.agg(one)


def _logliks(k: np.ndarray, n: np.ndarray, log_omega: np.ndarray, inner: np.ndarray, p: int, sigmasq_mu: float, nu: float) -> np.ndarray:
    """Marginal log-likelihoods: numbers of clusters and rows, sums of log omega, and the p x p matrices that remain."""
    return -(p / 2) * log_omega - (nu + n) / 2 * np.linalg.slogdet(inner)[1] - (p * k / 2) * np.log(sigmasq_mu)


def _cluster_terms(per: DataFrame, p: int, by: Sequence[str], sigmasq_mu: float) -> DataFrame:
    """by, k, n, lo, m: plain sums over clusters (n, s) of what the score needs."""
    omega = F.col("n") + 1.0 / sigmasq_mu
    outer = F.array(*[F.sum(F.col("s")[i] * F.col("s")[j] / omega) for i in range(p) for j in range(p)])
    aggs = [F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.log(omega)).alias("lo"), outer.alias("m")]
    return per.groupBy(*by).agg(*aggs) if by else per.agg(*aggs)


def _stacked(column: pd.Series, *shape: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, *shape)


def marginal_loglik(
    df: DataFrame, p: int, by: Sequence[str] = (), cluster: str = "cluster", sigmasq_mu: float = 0.0625, scale: float = 1.0, nu: float | None = None
) -> DataFrame:
    """by, k, loglik of a partition. The indicator matrix is never formed: cluster sizes, cluster sums and the
    cross products suffice, so this is one aggregation, sums over its clusters, and p x p algebra."""
    nu = p if nu is None else nu
    by = list(by)
    terms = _cluster_terms(_sums(df, p, [*by, cluster]), p, by, sigmasq_mu)
    yy = _cross_products(df, p, by)
    j = null_safe_join(terms, yy, by) if by else with_scalars(terms, yy)

    def kernel(batches):
        for pdf in batches:
            inner = _stacked(pdf["yy"], p, p) - _stacked(pdf["m"], p, p) + scale * np.eye(p)
            yield pdf[by].assign(k=pdf["k"].astype(int), loglik=_logliks(pdf["k"].to_numpy(), pdf["n"].to_numpy(), pdf["lo"].to_numpy(), inner, p, sigmasq_mu, nu))

    types = dict(df.dtypes)
    return j.mapInPandas(kernel, "".join(f"`{c}` {types[c]}, " for c in by) + "k int, loglik double")


def score_cuts(tree: DataFrame, features: DataFrame, p: int, cut_eids: DataFrame | None = None, sigmasq_mu: float = 0.0625, scale: float = 1.0) -> DataFrame:
    """eid, src, dst, n_side (vertices on the src side), loglik for every edge, or the given ones: the score after splitting
    its tree (one cluster per tree) there.

    One rake-and-compress pass over the forest gives the sums of both sides of all edges; the other trees enter by their
    summed terms alone.
    """
    points = features.select("id", F.lit(1).cast("bigint").alias("n"), F.slice("pcs", 1, p).alias("s"))
    trees = cut_lineage(connected_components(tree, points).join(points, "id"))
    whole = trees.groupBy("component").agg(F.sum("n").alias("tn"), array_sum("s", p).alias("ts"))
    known = trees.select("id", "component").join(whole, "component").select(F.col("id").alias("src"), "tn", "ts")
    edges = tree.where(F.col("src") != F.col("dst")).select("eid", "src", "dst").join(known, "src")
    named = edges.select(F.struct("eid", "src", "dst").alias("name"), F.col("src").alias("a"), F.col("dst").alias("b"), "tn", "ts")
    sides = side_sums(named, trees.select("id", "n", "s"), p).join(named.select("name", "tn", "ts"), "name")
    if cut_eids is not None:
        sides = sides.join(cut_eids.select(F.col("eid").alias("_e")), F.col("name.eid") == F.col("_e"), "left_semi")
    terms = _cluster_terms(whole.select(F.col("tn").alias("n"), F.col("ts").alias("s")), p, [], sigmasq_mu)
    j = with_scalars(with_scalars(sides, terms), _cross_products(features, p)).select("name.*", "n1", "s1", "tn", "ts", "k", "n", "lo", "m", "yy")

    def kernel(batches):
        c = 1.0 / sigmasq_mu

        def outer(n: np.ndarray, s: np.ndarray) -> np.ndarray:
            return s[:, :, None] * s[:, None, :] / (n + c)[:, None, None]

        for pdf in batches:
            if not len(pdf):
                continue
            n1, n, s1, s = pdf["n1"].to_numpy(float), pdf["tn"].to_numpy(float), _stacked(pdf["s1"], p), _stacked(pdf["ts"], p)
            lo = pdf["lo"].to_numpy() - np.log(n + c) + np.log(n1 + c) + np.log(n - n1 + c)
            m = _stacked(pdf["m"], p, p) - outer(n, s) + outer(n1, s1) + outer(n - n1, s - s1)
            inner = _stacked(pdf["yy"], p, p) - m + scale * np.eye(p)
            yield pdf[["eid", "src", "dst"]].assign(n_side=pdf["n1"], loglik=_logliks(pdf["k"].to_numpy() + 1, pdf["n"].to_numpy(), lo, inner, p, sigmasq_mu, p))

    types = dict(tree.dtypes)
    return j.mapInPandas(kernel, f"eid {types['eid']}, src {types['src']}, dst {types['dst']}, n_side long, loglik double")


__all__ = [
    "select_hvg", "pca", "pca_counts", "kmeans", "gmm", "sweep", "select_k", "marginal_loglik", "score_cuts",
]
