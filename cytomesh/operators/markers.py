"""Marker genes per cluster and rank tests on triplets whose zeros are absent."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytomesh.functions.kernels import chi2_upper, normal_two_sided
from cytomesh.operators.core import average_ranks, cut_lineage, keyed_join, top_k_per_group, with_scalars


@F.pandas_udf(T.DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_upper(a, b) for a, b in zip(x, df)])


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """cluster, n_c, n: cluster sizes and the number of labelled cells."""
    s = labels.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_c"))
    return s.withColumn("n", F.sum("n_c").over(W.partitionBy(F.lit(0))))


def _labelled(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Values of labelled cells; a cell with very many genes is spread by a salt."""
    lab = labels.where(F.col("cluster").isNotNull()).select("cell_id", "cluster")
    return keyed_join(values.where(F.col("value") > 0), lab, ["cell_id"])


def _full_grid(per: DataFrame, sizes: DataFrame, fill: Sequence[str]) -> DataFrame:
    """Every gene with every cluster, absent combinations filled with 0; clusters are a short list."""
    clusters = sizes.agg(F.collect_list(F.struct("cluster", "n_c", "n")).alias("_cs"))
    genes = per.select("gene_id").distinct()
    grid = with_scalars(genes, clusters).select("gene_id", F.explode("_cs").alias("c")).select("gene_id", "c.cluster", "c.n_c", "c.n")
    return grid.join(per, ["gene_id", "cluster"], "left").fillna(0, subset=list(fill))


def rank_sum_statistics(values: DataFrame, labels: DataFrame) -> DataFrame:
    """gene_id, cluster, u, z: one-against-rest rank-sum statistics, tie-corrected and continuity-corrected.

    Only non-zeros are ranked; the zeros of a gene form one tie block below them, added in closed form.
    """
    data = _labelled(values, labels)
    per_value = cut_lineage(data.groupBy("gene_id", "cluster", "value").agg(F.count(F.lit(1)).alias("m")))
    ranks = cut_lineage(average_ranks(per_value, "value", ["gene_id"], "m"))
    t = F.col("ties").cast("double")
    sums = per_value.join(ranks, ["gene_id", "value"]).groupBy("gene_id", "cluster").agg(
        F.sum(F.col("m") * F.col("avg_rank")).alias("r"), F.sum("m").alias("nnz_c")
    )
    gene = ranks.groupBy("gene_id").agg(F.sum(t * t * t - t).alias("tie"), F.max("total").alias("nnz"))
    g = _full_grid(sums, cluster_sizes(labels), ["r", "nnz_c"]).join(gene, "gene_id")
    n, nc = F.col("n").cast("double"), F.col("n_c").cast("double")
    n0 = n - F.col("nnz")
    rest = n - nc
    rank_sum = F.col("r") + F.col("nnz_c") * n0 + (nc - F.col("nnz_c")) * (n0 + 1.0) / 2.0
    u = rank_sum - nc * (nc + 1.0) / 2.0
    tie = F.col("tie") + n0 * n0 * n0 - n0
    var = nc * rest / 12.0 * ((n + 1.0) - tie / F.nullif(n * (n - 1.0), F.lit(0.0)))
    dev = u - nc * rest / 2.0
    z = (dev - F.signum(dev) * 0.5) / F.nullif(F.sqrt(var), F.lit(0.0))
    return g.select("gene_id", "cluster", u.alias("u"), z.alias("z"))


def rank_sum_markers(values: DataFrame, labels: DataFrame) -> DataFrame:
    """gene_id, cluster, u, z, p_val (two-sided)."""
    return rank_sum_statistics(values, labels).withColumn("p_val", F.least(_two_sided("z"), F.lit(1.0)))


def fold_change(values: DataFrame, labels: DataFrame) -> DataFrame:
    """gene_id, cluster, avg_log2fc, pct_1, pct_2 on log-normalised values, zeros included."""
    sizes = cluster_sizes(labels)
    per = _labelled(values, labels).groupBy("gene_id", "cluster").agg(
        F.sum(F.expm1("value")).alias("s"), F.count(F.lit(1)).alias("k")
    )
    total = per.groupBy("gene_id").agg(F.sum("s").alias("ts"), F.sum("k").alias("tk"))
    g = _full_grid(per, sizes, ["s", "k"]).join(total, "gene_id")
    rest = F.nullif(F.col("n") - F.col("n_c"), F.lit(0))

    def level(s: Column, n: Column) -> Column:
        return F.log2(F.greatest(s, F.lit(0.0)) / n + 1.0)

    return g.select(
        "gene_id", "cluster",
        (level(F.col("s"), F.col("n_c")) - level(F.col("ts") - F.col("s"), rest)).alias("avg_log2fc"),
        (F.col("k") / F.col("n_c")).alias("pct_1"),
        ((F.col("tk") - F.col("k")) / rest).alias("pct_2"),
    )


def adjust_p(df: DataFrame, n_tests: int | DataFrame) -> DataFrame:
    """Bonferroni over all genes: ``n_tests`` is a number or a one-row frame with column n_tests."""
    j = with_scalars(df, n_tests) if isinstance(n_tests, DataFrame) else df.withColumn("n_tests", F.lit(n_tests))
    return j.withColumn("p_val_adj", F.least(F.col("p_val") * F.col("n_tests"), F.lit(1.0))).drop("n_tests")


def find_markers(
    values: DataFrame, labels: DataFrame, n_genes: int | DataFrame, min_pct: float = 0.1, min_log2fc: float = 0.5, only_positive: bool = True
) -> DataFrame:
    """gene_id, cluster, p_val, avg_log2fc, pct_1, pct_2, p_val_adj for genes that pass the gates."""
    fc = fold_change(values, labels)
    size = F.col("avg_log2fc") if only_positive else F.abs("avg_log2fc")
    gated = cut_lineage(fc.where((F.greatest("pct_1", "pct_2") >= min_pct) & (size >= min_log2fc)))
    # only genes that pass for some cluster are ranked
    few = values.join(gated.select("gene_id").distinct(), "gene_id", "left_semi")
    tests = rank_sum_markers(few, labels).select("gene_id", "cluster", "p_val")
    return adjust_p(gated.join(tests, ["gene_id", "cluster"]), n_genes)


def top_markers(markers: DataFrame, n: int = 5, alpha: float = 0.05) -> DataFrame:
    """Significant markers with the n largest fold changes per cluster, ties kept."""
    sig = markers.where(F.col("p_val_adj") < alpha)
    return top_k_per_group(sig, ["cluster"], [F.desc("avg_log2fc")], n, rank="rank")


def marker_quality(markers: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per method and cluster: significant markers, mean / median / max fold change, mean -log10 p, specificity.

    A cluster's markers are at most the genes, so its median buffer is small.
    """
    p = F.greatest("p_val_adj", F.lit(1e-300))
    return markers.where(F.col("p_val_adj") < alpha).groupBy("method", "cluster").agg(
        F.count(F.lit(1)).alias("n_markers"),
        F.avg("avg_log2fc").alias("log2fc_mean"),
        F.percentile("avg_log2fc", 0.5).alias("log2fc_median"),
        F.max("avg_log2fc").alias("log2fc_max"),
        F.avg(-F.log10(p)).alias("neg_log10_p_mean"),
        F.avg(F.col("pct_1") - F.col("pct_2")).alias("specificity_mean"),
    )


def method_summary(quality: DataFrame) -> DataFrame:
    return quality.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.avg("n_markers").alias("markers_per_cluster"),
        F.avg("log2fc_mean").alias("log2fc"),
        F.avg("neg_log10_p_mean").alias("neg_log10_p"),
        F.avg("specificity_mean").alias("specificity"),
    )


def dot_table(values: DataFrame, labels: DataFrame, genes: Sequence) -> DataFrame:
    """cluster, gene_id, avg_expression, pct_expressed for chosen genes, zeros included."""
    per = _labelled(values.where(F.col("gene_id").isin(list(genes))), labels).groupBy("gene_id", "cluster").agg(
        F.sum(F.expm1("value")).alias("s"), F.count(F.lit(1)).alias("k")
    )
    g = _full_grid(per, cluster_sizes(labels), ["s", "k"])
    return g.select("cluster", "gene_id", (F.col("s") / F.col("n_c")).alias("avg_expression"), (F.col("k") * 100.0 / F.col("n_c")).alias("pct_expressed"))


def _group_ranks(df: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Rank sums per group and one row with N and the tie sum."""
    use = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranks = average_ranks(use, value)
    t = F.col("ties").cast("double")
    tie = ranks.agg(F.sum(t * t * t - t).alias("tie"), F.max("total").cast("double").alias("n"))
    per = use.groupBy(group, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("m"))
    sums = per.join(ranks, "value").groupBy(group).agg(
        F.sum(F.col("m") * F.col("avg_rank")).alias("r"), F.sum("m").cast("double").alias("n_g")
    )
    return sums, tie


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """statistic, df, p_val of the Kruskal-Wallis test with tie correction."""
    sums, tie = _group_ranks(df, value, group)
    one = with_scalars(sums.agg(F.sum(F.col("r") * F.col("r") / F.col("n_g")).alias("q"), F.count(F.lit(1)).alias("k")), tie)
    n = F.col("n")
    raw = F.lit(12.0) / (n * (n + 1.0)) * F.col("q") - (n + 1.0) * 3.0
    h = raw / F.nullif(F.lit(1.0) - F.col("tie") / (n * n * n - n), F.lit(0.0))
    out = one.select(h.alias("statistic"), (F.col("k") - 1).cast("int").alias("df"))
    return out.withColumn("p_val", _chi2_tail("statistic", "df"))


def dunn_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """group_a, group_b, z, p_val, p_adj (Bonferroni over the pairs)."""
    sums, tie = _group_ranks(df, value, group)
    a = sums.select(F.col(group).alias("group_a"), (F.col("r") / F.col("n_g")).alias("ma"), F.col("n_g").alias("na"))
    b = sums.select(F.col(group).alias("group_b"), (F.col("r") / F.col("n_g")).alias("mb"), F.col("n_g").alias("nb"))
    pairs = with_scalars(a.join(b, F.col("group_a") < F.col("group_b")), tie)
    n = F.col("n")
    var = (n * (n + 1.0) / 12.0 - F.col("tie") / ((n - 1.0) * 12.0)) * (F.lit(1.0) / F.col("na") + F.lit(1.0) / F.col("nb"))
    z = (F.col("ma") - F.col("mb")) / F.nullif(F.sqrt(var), F.lit(0.0))
    out = pairs.select("group_a", "group_b", z.alias("z")).withColumn("p_val", _two_sided("z"))
    m = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    return out.withColumn("p_adj", F.least(F.col("p_val") * m, F.lit(1.0)))
