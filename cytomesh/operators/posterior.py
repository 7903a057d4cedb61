"""Summaries of sampled partitions: samples(iter, obs_id, label)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomesh.functions import columns as C
from cytomesh.operators.core import cut_lineage, keyed_join, top_k_per_group, with_scalars
from cytomesh.operators.metrics import ari
from cytomesh.operators.prep import best_run, run_summary

ITER_BLOCK = 32  # iterations per side of one contingency block
COLUMNS = 2000  # indicator columns multiplied at a time


def thin(samples: DataFrame, burn: int, every: int) -> DataFrame:
    """Drop the burn-in, keep every n-th iteration, renumber from 1."""
    kept = samples.where((F.col("iter") > burn) & ((F.col("iter") - burn) % every == 0))
    return kept.withColumn("iter", F.floor((F.col("iter") - burn) / every).cast("int"))


def posterior_mode(samples: DataFrame, burn: int = 0) -> DataFrame:
    """Most frequent label per observation after the burn-in; the smallest label wins a tie."""
    n = samples.where(F.col("iter") > burn).groupBy("obs_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_group(n, ["obs_id"], [F.desc("n"), F.asc("label")], 1).select("obs_id", "label", "n")


def cluster_counts(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, iter, k."""
    return samples.select(*by, "iter", "label").distinct().groupBy(*by, "iter").agg(F.count("label").alias("k"))


def modal_k(iters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent number of clusters (smallest wins a tie) and how often it occurs."""
    n = iters.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("freq"))
    best = F.max_by(F.struct("k", "freq"), F.struct("freq", -F.col("k"))).alias("m")
    g = n.groupBy(*by).agg(best) if by else n.agg(best)
    return g.select(*by, F.col("m.k").alias("k"), F.col("m.freq").alias("freq"))


def label_arrays(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per observation with its labels in iteration order; as long as the chain, not as the data."""
    return samples.groupBy(*by, "obs_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("iter", "label"))), lambda s: s["label"]).alias("labels")
    )


def coassignment(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, together: how often two observations share a cluster, for the given pairs only."""
    a = label_arrays(samples)
    out = pairs.select("src", "dst")
    for end in ("src", "dst"):
        side = a.select(F.col("obs_id").alias(end), F.col("labels").alias(f"_{end}"))
        out = keyed_join(out, side, [end])
    same = F.size(F.filter(F.zip_with("_src", "_dst", lambda u, v: u == v), lambda b: b))
    return out.select("src", "dst", (same / F.size("_src")).alias("together"))


def partition_overlap(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, s, t (s <= t), overlap = sum of squared contingency counts of iterations s and t. NULL labels are left out.

    This is the inner product of the two co-clustering matrices, which are never formed. Iterations go in blocks; a task
    turns the observations of a batch into indicator columns, of the labels that the batch has, and multiplies them, a
    bounded number of columns at a time. Batches and tasks meet in a sum per (s, label, t, label).
    """
    by = list(by)
    known = samples.where(F.col("label").isNotNull()).select(*by, "obs_id", "iter", "label")
    rows = known.groupBy(*by, "obs_id").agg(F.sort_array(F.collect_list(F.struct("iter", "label"))).alias("lc"))
    blocks = F.transform("lc", lambda s: F.floor(s["iter"] / F.lit(ITER_BLOCK)))
    pairs = (
        rows.select("*", F.explode(F.array_distinct(blocks)).alias("_bs"), F.array_distinct(blocks).alias("_bb"))
        .select(*by, "obs_id", "lc", "_bs", F.explode(F.filter("_bb", lambda b: b >= F.col("_bs"))).alias("_bt"))
    )

    def part(b: str):
        return F.filter("lc", lambda s: F.floor(s["iter"] / F.lit(ITER_BLOCK)) == F.col(b))

    narrowed = pairs.select(
        *by, "_bs", "_bt",
        *[F.transform(part(b), lambda s: s[f]).alias(f"{o}{f}") for b, o in (("_bs", "s"), ("_bt", "t")) for f in ("iter", "label")],
    )

    def columns_of(iters, labels):
        """Distinct (iteration, label) pairs and, per observation and entry, the pair's number."""
        flat = pd.MultiIndex.from_arrays([np.concatenate(iters), np.concatenate(labels)])
        codes, levels = pd.factorize(flat)
        return levels, np.repeat(np.arange(len(iters)), [len(v) for v in iters]), codes

    def kernel(batches):
        for pdf in batches:
            for key, g in pdf.groupby([*by, "_bs", "_bt"], sort=False, dropna=False):
                ls, rs, cs = columns_of(g["siter"].tolist(), g["slabel"].tolist())
                lt, rt, ct = columns_of(g["titer"].tolist(), g["tlabel"].tolist())
                for a in range(0, len(ls), COLUMNS):
                    zs = np.zeros((len(g), min(COLUMNS, len(ls) - a)), dtype=np.float32)
                    own = (cs >= a) & (cs < a + COLUMNS)
                    zs[rs[own], cs[own] - a] = 1
                    for b in range(0, len(lt), COLUMNS):
                        zt = np.zeros((len(g), min(COLUMNS, len(lt) - b)), dtype=np.float32)
                        own = (ct >= b) & (ct < b + COLUMNS)
                        zt[rt[own], ct[own] - b] = 1
                        prod = zs.T @ zt
                        i, j = np.nonzero(prod)
                        frame = pd.DataFrame(
                            {
                                "s": ls.get_level_values(0)[a + i], "a": ls.get_level_values(1)[a + i],
                                "t": lt.get_level_values(0)[b + j], "b": lt.get_level_values(1)[b + j], "n": prod[i, j].astype(np.int64),
                            }
                        )
                        frame = frame[frame["s"] <= frame["t"]]
                        for c, v in zip(by, key):
                            frame[c] = v
                        yield frame[[*by, "s", "a", "t", "b", "n"]]

    types = dict(samples.dtypes)
    head = "".join(f"`{c}` {types[c]}, " for c in by)
    counts = narrowed.mapInPandas(kernel, f"{head}s int, a {types['label']}, t int, b {types['label']}, n long")
    cells = counts.groupBy(*by, "s", "a", "t", "b").agg(F.sum("n").cast("double").alias("n"))
    return cells.groupBy(*by, "s", "t").agg(F.sum(F.col("n") * F.col("n")).alias("overlap"))


def representative_iteration(samples: DataFrame, by: Sequence[str] = (), modal_only: bool = True) -> DataFrame:
    """by, iter, score: the iteration whose co-clustering matrix is nearest to the mean one.

    Minimises <W_t, W_t> - 2 mean_s <W_s, W_t> over the iterations with the most frequent number of
    clusters. Partitions that are equal but for the names of their clusters are collapsed first and enter as weights. The earliest iteration wins a tie.
    """
    by = list(by)
    use = samples
    if modal_only:
        k = cluster_counts(samples, by)
        m = modal_k(k, by).select(*by, "k")
        keep = (k.join(m, [*by, "k"]) if by else k.join(F.broadcast(m), "k")).select(*by, "iter")
        use = samples.join(F.broadcast(keep), [*by, "iter"], "left_semi")
    # a partition is the set of its blocks, whatever they are called; a block is known by its members' hashes
    h = F.xxhash64("obs_id")
    blocks = use.where(F.col("label").isNotNull()).groupBy(*by, "iter", "label").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(h.cast("decimal(38,0)")).alias("_sum"), F.bit_xor(F.xxhash64("obs_id", F.lit(7))).alias("_xor")
    )
    sig = blocks.groupBy(*by, "iter").agg(
        F.sum(F.xxhash64("_n", "_sum", "_xor").cast("decimal(38,0)")).alias("sig"), F.bit_xor(F.xxhash64("_xor", "_sum", "_n")).alias("sig2")
    )
    reps = cut_lineage(
        sig.groupBy(*by, "sig", "sig2").agg(F.min("iter").alias("iter"), F.count(F.lit(1)).cast("double").alias("weight"))
    ).select(*by, "iter", "weight")
    rep_samples = use.join(F.broadcast(reps.select(*by, "iter")), [*by, "iter"], "left_semi")
    o = cut_lineage(partition_overlap(rep_samples, by))
    both = o.unionByName(
        o.where(F.col("s") != F.col("t")).select(*by, F.col("t").alias("s"), F.col("s").alias("t"), "overlap")
    )
    w = reps.select(*by, F.col("iter").alias("s"), "weight")
    mean = both.join(w, [*by, "s"]).groupBy(*by, "t").agg(
        (F.sum(F.col("overlap") * F.col("weight")) / F.sum("weight")).alias("mean_overlap")
    )
    own = o.where(F.col("s") == F.col("t")).select(*by, "t", F.col("overlap").alias("own"))
    score = own.join(mean, [*by, "t"]).select(
        *by, F.col("t").alias("iter"), (F.col("own") - F.col("mean_overlap") * 2.0).alias("score")
    )
    best = F.min_by(F.struct("iter", "score"), F.struct(F.round("score", 6), "iter")).alias("m")
    g = score.groupBy(*by).agg(best) if by else score.agg(best)
    return g.select(*by, F.col("m.iter").alias("iter"), F.col("m.score").alias("score"))


def partition_at(samples: DataFrame, chosen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The labels of the chosen iteration(s)."""
    return samples.join(F.broadcast(chosen.select(*by, "iter")), [*by, "iter"], "left_semi")


def params_at(params: DataFrame, chosen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Parameter rows (means, covariances) of the chosen iteration(s)."""
    return params.join(F.broadcast(chosen.select(*by, "iter")), [*by, "iter"])


# --------------------------------------------------------------------------- predictive checks


def _normals(p: int, seed: int) -> list:
    """p standard normals per (iter, obs_id) from hashes, the same for any partitioning."""
    out = []
    for d in range(p):
        u = F.greatest(C.hash_unit("iter", "obs_id", F.lit(2 * d), seed=seed), F.lit(2.0**-53))
        v = C.hash_unit("iter", "obs_id", F.lit(2 * d + 1), seed=seed)
        out.append(F.sqrt(F.log(u) * -2.0) * F.cos(v * (2 * np.pi)))
    return out


def cholesky(covs: DataFrame, p: int) -> DataFrame:
    """iter, chol: lower triangular factors (row-major) of iter, cov (row-major array)."""

    def kernel(batches):
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["cov"].to_list()).reshape(-1, p, p)
                yield pd.DataFrame({"iter": pdf["iter"], "chol": list(np.linalg.cholesky(m).reshape(len(m), -1))})

    return covs.select("iter", "cov").mapInPandas(kernel, "iter int, chol array<double>")


def replicate_data(samples: DataFrame, teams: DataFrame, covs: DataFrame, p: int, seed: int = 1) -> DataFrame:
    """iter, obs_id, y: one replicated data set per iteration. ``samples`` carry (iter, obs_id, grp), ``teams``
    (iter, grp, mu)."""
    j = keyed_join(samples.select("iter", "obs_id", "grp"), teams.select("iter", "grp", "mu"), ["iter", "grp"])
    j = keyed_join(j, cholesky(covs, p), ["iter"])
    z = _normals(p, seed)
    y = []
    for d in range(p):
        noise = sum((F.col("chol")[d * p + e] * z[e] for e in range(1, d + 1)), F.col("chol")[d * p] * z[0])
        y.append(F.col("mu")[d] + noise)
    return j.select("iter", "obs_id", F.array(*y).alias("y"))


def ppc_means(samples: DataFrame, teams: DataFrame, covs: DataFrame, observed: DataFrame, p: int, seed: int = 1) -> DataFrame:
    """dim, obs_mean, n_iter, ppp, flag: how extreme the observed component means are among replicated ones.

    The mean of mu + L z is mean(mu) + L mean(z), so replicates are averaged before the factor is applied.
    """
    j = keyed_join(samples.select("iter", "obs_id", "grp"), teams.select("iter", "grp", "mu"), ["iter", "grp"])
    z = _normals(p, seed)
    avg = j.groupBy("iter").agg(
        *[F.avg(F.col("mu")[d]).alias(f"m{d}") for d in range(p)], *[F.avg(z[d]).alias(f"z{d}") for d in range(p)]
    )
    rep = avg.join(cholesky(covs, p), "iter")
    means = []
    for d in range(p):
        noise = sum((F.col("chol")[d * p + e] * F.col(f"z{e}") for e in range(1, d + 1)), F.col("chol")[d * p] * F.col("z0"))
        means.append((F.col(f"m{d}") + noise).alias(f"r{d}"))
    obs = observed.agg(*[F.avg(F.col("pcs")[d]).alias(f"o{d}") for d in range(p)])
    tail = with_scalars(rep.select("iter", *means), obs)
    agg = tail.agg(
        F.count(F.lit(1)).alias("n_iter"),
        *[F.avg((F.col(f"r{d}") >= F.col(f"o{d}")).cast("double")).alias(f"p{d}") for d in range(p)],
        *[F.max(f"o{d}").alias(f"o{d}") for d in range(p)],
    )
    entries = F.array(*[F.struct(F.lit(d + 1).alias("dim"), F.col(f"o{d}").alias("obs_mean"), F.col(f"p{d}").alias("p")) for d in range(p)])
    long = agg.select("n_iter", F.explode(entries).alias("e"))
    ppp = F.least(F.col("e.p"), 1.0 - F.col("e.p"))
    return long.select("e.dim", "e.obs_mean", "n_iter", ppp.alias("ppp"), (ppp < 0.025).alias("flag"))


# --------------------------------------------------------------------------- sweeps and replicated runs


def sensitivity_summary(samples: DataFrame, truth: DataFrame, setting: str = "setting") -> DataFrame:
    """Per setting: modal cluster count and its share, the representative iteration and its ARI."""
    k = cluster_counts(samples, [setting])
    total = k.groupBy(setting).agg(F.count(F.lit(1)).alias("n_iter"))
    chosen = cut_lineage(representative_iteration(samples, [setting]))
    scored = ari(partition_at(samples, chosen, [setting]).join(truth, "obs_id"), "truth", "label", [setting])
    return (
        modal_k(k, [setting])
        .join(total, setting)
        .join(chosen.select(setting, F.col("iter").alias("rep_iter")), setting)
        .join(scored, setting)
        .select(setting, "k", (F.col("freq") / F.col("n_iter")).alias("k_share"), "rep_iter", "ari")
    )


def replicate_summary(scores: DataFrame, counts: DataFrame) -> DataFrame:
    """Per method: spread of the scores over seeds, best run, and the most frequent cluster count."""
    n = counts.groupBy("method", "k").agg(F.count(F.lit(1)).alias("freq"))
    usual = n.groupBy("method").agg(F.max_by("k", F.struct("freq", -F.col("k"))).alias("modal_k"))
    return run_summary(scores, ["method"]).join(best_run(scores), "method").join(usual, "method")
