"""Normalisation, quality gates and per-cell / per-gene summaries over count triplets and cell tables.

Counts are long triplets ``(cell_id, gene_id, cnt)`` without zeros. Every mean over cells therefore takes
the number of cells from outside the triplets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytomesh.functions import columns as C
from cytomesh.operators.core import (
    average_ranks,
    cumulative_counts,
    cut_lineage,
    keyed_join,
    null_safe_join,
    quantiles,
    top_k_per_group,
    with_scalars,
)

MAD_SCALE = 1.4826

# --------------------------------------------------------------------------- rows and columns


def keep_rows(df: DataFrame, cond: Column) -> DataFrame:
    return df.where(cond)


def recode(df: DataFrame, column: str, mapping: Mapping[str, Sequence[str]], out: str) -> DataFrame:
    """Group free-text categories; values that no rule names become NULL."""
    expr = F.lit(None).cast("string")
    for target, values in mapping.items():
        expr = F.when(F.col(column).isin(*values), F.lit(target)).otherwise(expr)
    return df.withColumn(out, expr)


def parse_run_name(df: DataFrame, column: str = "run") -> DataFrame:
    """Cluster and component numbers from names such as ``q5_pc3``; shard numbers from ``Shard_012``."""

    def number(pattern: str) -> Column:
        text = F.regexp_extract(column, pattern, 1)
        return F.when(text != "", text).cast("int")

    return df.select(
        column,
        number(r"q(\d+)_").alias("k"),
        number(r"pc(\d+)").alias("n_pcs"),
        number(r"Shard_(\d+)").alias("shard_id"),
    )


def label_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Dense 1-based codes in sorted label order; NULL stays NULL. Labels are few, rows are many."""
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    coded = levels.withColumn(out, F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy(column)))
    return keyed_join(df, coded, [column], "left")


def adapt_result(df: DataFrame, label: str, offset: int = 0, swap_xy: bool = False) -> DataFrame:
    """Bring another tool's result to our convention: shift labels, exchange axes."""
    out = df.withColumn(label, F.col(label) + F.lit(offset))
    if swap_xy:
        out = out.withColumns({"x": F.col("y"), "y": F.col("x")})
    return out


def make_unique(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """Add ``-1, -2, ...`` to the second, third, ... use of a name. ``order`` is unique inside a name.

    The position comes from distributed counts, so one very frequent name does not end in one task. NULL is a name that
    stays NULL; rows without an order keep their plain name.
    """
    pos = cumulative_counts(df, order, [name]).select(name, F.col("value").alias(order), F.col("before").alias("_before"))
    label = F.when(F.col("_before") > 0, F.concat(F.col(name), F.lit("-"), F.col("_before"))).otherwise(F.col(name))
    return null_safe_join(df, pos, [name, order], "left").withColumn(out, label).select(*[c for c in df.columns if c != out], out)


def unique_features(df: DataFrame, name: str, order: str) -> DataFrame:
    """First row of every name."""
    return top_k_per_group(df, [name], [F.col(order)], 1).drop("rk")


def gene_columns(counts: DataFrame, cells: DataFrame, genes: Sequence[str], prefix: str = "g_") -> DataFrame:
    """Chosen genes as columns next to every cell; a missing count is 0."""
    wide = (
        counts.where(F.col("gene_id").isin(*genes))
        .groupBy("cell_id")
        .agg(*[F.sum(F.when(F.col("gene_id") == g, F.col("cnt"))).alias(f"{prefix}{i}") for i, g in enumerate(genes)])
    )
    filled = [F.coalesce(f"{prefix}{i}", F.lit(0)).cast("bigint").alias(f"{prefix}{i}") for i in range(len(genes))]
    return cells.join(wide, "cell_id", "left").select(*cells.columns, *filled)


def pc_table(embeddings: DataFrame, cells: DataFrame, p: int) -> DataFrame:
    """Coordinates and labels next to the first p components as columns."""
    return embeddings.join(cells, "cell_id", "left").select(
        "cell_id", *C.vector_columns("pcs", p), *[c for c in cells.columns if c != "cell_id"]
    )


def unpivot_vector(df: DataFrame, ids: Sequence[str], column: str) -> DataFrame:
    """One row per vector entry: ids, dim (0-based), value."""
    return df.select(*ids, F.posexplode(column).alias("dim", "value"))


# --------------------------------------------------------------------------- normalisation


def cell_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell_id").agg(
        F.sum("cnt").alias("total_counts"), F.count(F.lit(1)).alias("n_genes")
    )


def log1p_counts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("value", F.log1p("cnt"))


def log_normalize(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """``log1p(cnt / cell total * scale)`` on the non-zeros; the totals join is salted against huge cells."""
    joined = keyed_join(counts, cell_totals(counts).select("cell_id", "total_counts"), ["cell_id"])
    return joined.select(
        "cell_id", "gene_id", F.log1p(F.col("cnt") / F.col("total_counts") * F.lit(scale)).alias("value")
    )


def size_factor_normalize(counts: DataFrame, target: str = "mean") -> DataFrame:
    """Mean target: ``log2(cnt / (total / mean total) + 1)``; median target: counts scaled to the median total."""
    totals = cell_totals(counts).select("cell_id", "total_counts")
    if target == "mean":
        ref = totals.agg(F.avg("total_counts").alias("ref"))
    else:
        ref = quantiles(totals, "total_counts", {"ref": 0.5})
    factor = with_scalars(totals, ref).select("cell_id", (F.col("total_counts") / F.col("ref")).alias("sf"))
    joined = keyed_join(counts, factor, ["cell_id"])
    scaled = F.col("cnt") / F.col("sf")
    value = F.log2(scaled + 1.0) if target == "mean" else scaled
    return joined.select("cell_id", "gene_id", value.alias("value"))


def pct_feature(counts: DataFrame, pattern: str) -> DataFrame:
    """Share (in percent) of a cell's counts in genes whose name matches."""
    hit = F.sum(F.when(F.col("gene_id").rlike(pattern), F.col("cnt")).otherwise(0))
    return counts.groupBy("cell_id").agg((hit * 100.0 / F.sum("cnt")).alias("pct"))


def winsorize(df: DataFrame, column: str, lo: float = 0.01, hi: float = 0.99, out: str = "clipped") -> DataFrame:
    q = quantiles(df, column, {"_lo": lo, "_hi": hi})
    return with_scalars(df, q).withColumn(
        out, F.least(F.greatest(F.col(column), F.col("_lo")), F.col("_hi"))
    ).drop("_lo", "_hi")


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    aggs = [f for c in cols for f in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"))]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Centre and scale with the n-1 deviation, over all rows or inside each group."""
    return scale_like(df, moments(df, cols, by), cols, by)


def scale_like(df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Apply another table's means and deviations."""
    joined = keyed_join(df, stats, by) if by else with_scalars(df, stats)
    scaled = {c: C.safe_div(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_sd")) for c in cols}
    return joined.withColumns(scaled).select(*df.columns)


def standardize(df: DataFrame, column: str) -> DataFrame:
    """Centre, then divide by twice the largest absolute deviation; keeps ``mean`` and ``scale``."""
    ext = df.agg(F.avg(column).alias("std_mean"), F.min(column).alias("_mn"), F.max(column).alias("_mx"))
    par = ext.select(
        "std_mean",
        (F.greatest(F.col("_mx") - F.col("std_mean"), F.col("std_mean") - F.col("_mn")) * 2.0).alias("std_scale"),
    )
    return with_scalars(df, par).withColumn(
        "standardized", C.safe_div(F.col(column) - F.col("std_mean"), F.col("std_scale"))
    )


def unstandardize(df: DataFrame, column: str, out: str, keep_mean: bool = True, squared: bool = False) -> DataFrame:
    scale = F.col("std_scale") * F.col("std_scale") if squared else F.col("std_scale")
    value = F.col(column) * scale
    return df.withColumn(out, value + F.col("std_mean") if keep_mean else value)


# --------------------------------------------------------------------------- quality gates


def qc_gates(df: DataFrame, gates: Mapping[str, Column], out: str = "keep") -> DataFrame:
    """One boolean per gate plus their conjunction; NULL counts as failing."""
    flags = {name: F.coalesce(cond, F.lit(False)) for name, cond in gates.items()}
    flagged = df.withColumns(flags)
    keep = F.lit(True)
    for name in gates:
        keep = keep & F.col(name)
    return flagged.withColumn(out, keep)


def gate_summary(flagged: DataFrame, gates: Sequence[str]) -> DataFrame:
    """gate, n_pass, pct_pass in one pass over the rows."""
    one = flagged.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(g).alias(g) for g in gates])
    long = one.unpivot(["n"], list(gates), "gate", "n_pass")
    return long.select("gate", "n_pass", (F.col("n_pass") * 100.0 / F.col("n")).alias("pct_pass"))


def mad_upper_bound(df: DataFrame, column: str, k: float = 2.5, cap: float = 1000.0) -> DataFrame:
    """One row: median and scaled MAD of ``log10(v + 1)``, and ``min(10^(median + k MAD) - 1, cap)``."""
    logged = df.where(F.col(column).isNotNull()).select(F.log10(F.col(column) + 1.0).alias("lg"))
    med = quantiles(logged, "lg", {"med": 0.5})
    dev = with_scalars(logged, med).select(F.abs(F.col("lg") - F.col("med")).alias("dev"))
    mad = quantiles(dev, "dev", {"raw_mad": 0.5})
    row = with_scalars(med, mad).withColumn("mad", F.col("raw_mad") * MAD_SCALE)
    bound = F.pow(F.lit(10.0), F.col("med") + F.col("mad") * k) - 1.0
    return row.select("med", "mad", F.least(bound, F.lit(cap)).alias("upper"))


def kneedle_cutoff(df: DataFrame, column: str) -> DataFrame:
    """One row ``cutoff``: the value farthest from the chord of the descending rank curve.

    Inside a block of tied values the height is constant, so the extreme is at the block's first or last
    rank; only those two are looked at. The earliest rank wins among equals.
    """
    c = cumulative_counts(df, column)
    ends = c.agg(
        F.max("total").alias("n"), F.max("value").cast("double").alias("top"), F.min("value").cast("double").alias("low")
    )
    j = with_scalars(c, ends)
    first = F.col("n") - F.col("before") - F.col("cnt")
    last = F.col("n") - F.col("before") - 1
    long = j.select("value", "n", "top", "low", F.explode(F.array(first, last)).alias("pos"))
    xn = C.safe_div(F.col("pos").cast("double"), F.col("n") - 1.0)
    yn = C.safe_div(F.col("value").cast("double") - F.col("low"), F.col("top") - F.col("low"))
    d = F.abs(F.lit(1.0) - xn - yn) / F.sqrt(F.lit(2.0))
    return long.select("value", "pos", d.alias("d")).agg(
        F.max_by("value", F.struct(F.round("d", 12), -F.col("pos"))).alias("cutoff")
    )


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def doublet_flag(cells: DataFrame, counts_col: str, area_col: str, p: float = 0.97) -> DataFrame:
    """Score = positive part of the standardised residual of log counts on log area, plus that of the z-scored area."""
    base = cells.withColumns({"_la": F.log10(F.col(area_col) + 1.0), "_lt": F.log10(F.col(counts_col) + 1.0)})
    res = with_scalars(base, ols(base, "_lt", "_la")).withColumns(
        {"_res": F.col("_lt") - (F.col("intercept") + F.col("slope") * F.col("_la")), "_area": F.col(area_col).cast("double")}
    )
    z = zscore(res, ["_res", "_area"])
    zero = F.lit(0.0)
    scored = z.withColumn(
        "doublet_score",
        F.greatest(zero, F.coalesce("_res", zero)) + F.greatest(zero, F.coalesce("_area", zero)),
    ).select(*cells.columns, "doublet_score")
    scored = cut_lineage(scored)  # it hangs on aggregates of its own rows, and is read three times
    thr = quantiles(scored, "doublet_score", {"threshold": p})
    return with_scalars(scored, thr).withColumn("likely_doublet", F.col("doublet_score") > F.col("threshold"))


# --------------------------------------------------------------------------- summaries


def filter_genes(counts: DataFrame, min_cells: int = 3) -> DataFrame:
    kept = counts.where(F.col("cnt") > 0).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells)
    return keyed_join(counts, kept.select("gene_id"), ["gene_id"])


def gene_moments(counts: DataFrame, n_cells: DataFrame, value: str = "cnt") -> DataFrame:
    """Mean, variance and squared CV per gene over all cells, zeros included. ``n_cells``: one row (n)."""
    x = F.col(value).cast("double")
    s = counts.groupBy("gene_id").agg(F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
    n = F.col("n").cast("double")
    mean = F.col("s1") / n
    var = (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1.0)
    j = with_scalars(s, n_cells)
    floor = F.greatest(F.col("mean"), F.lit(1e-12))
    return j.select("gene_id", mean.alias("mean"), var.alias("variance")).withColumn(
        "cv2", F.col("variance") / (floor * floor)
    )


def detection_rate(counts: DataFrame, n_cells: DataFrame) -> DataFrame:
    hit = counts.where(F.col("cnt") > 0).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_detected"))
    return with_scalars(hit, n_cells).select(
        "gene_id", "n_detected", (F.col("n_detected") * 100.0 / F.col("n")).alias("pct_detected")
    )


def sparsity(counts: DataFrame, n_cells: DataFrame, n_genes: DataFrame) -> DataFrame:
    """Percent of the matrix that is zero; inputs are one-row frames (n) and (g)."""
    nnz = counts.where(F.col("cnt") != 0).agg(F.count(F.lit(1)).alias("nnz"))
    all_ = with_scalars(with_scalars(nnz, n_cells), n_genes)
    cells = F.col("n").cast("double") * F.col("g").cast("double")
    return all_.select("nnz", ((F.lit(1.0) - F.col("nnz") / cells) * 100.0).alias("sparsity_pct"))


def dataset_summary(cells: DataFrame, kept: Column, medians: Sequence[str], means: Sequence[str], ranges: Sequence[str]) -> DataFrame:
    """One row with counts, medians, means, totals and ranges of the named columns."""
    one = cells.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(kept).alias("n_kept"),
        F.count_if(~kept).alias("n_filtered"),
        *[f for c in means for f in (F.avg(c).alias(f"mean_{c}"), F.sum(c).alias(f"sum_{c}"))],
        *[f for c in ranges for f in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))],
    )
    for c in medians:
        one = with_scalars(one, quantiles(cells, c, {f"median_{c}": 0.5}))
    return one


def proportions(df: DataFrame, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """by, cluster, n_obs, total_n, prop. The totals window runs over group counts, never over rows."""
    g = df.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n_obs"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return g.withColumn("total_n", F.sum("n_obs").over(w)).withColumn("prop", F.col("n_obs") / F.col("total_n"))


def qc_by_cluster(cells: DataFrame, cluster: str) -> DataFrame:
    """Size, share and rounded (half-even) means of counts, genes and a percentage column, per cluster."""
    g = cells.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.avg("total_counts").alias("_u"),
        F.avg("n_genes").alias("_g"),
        F.avg("pct").alias("_p"),
    )
    total = F.sum("n_cells").over(W.partitionBy(F.lit(0)))
    return g.select(
        cluster,
        "n_cells",
        F.bround(F.col("n_cells") * 100.0 / total, 1).alias("pct_total"),
        F.bround("_u", 0).alias("mean_counts"),
        F.bround("_g", 0).alias("mean_genes"),
        F.bround("_p", 1).alias("mean_pct"),
    )


def centroids(df: DataFrame, group: Sequence[str], p: int, vector: str = "pcs") -> DataFrame:
    """Mean vector per group as one array, from p map-side averages."""
    g = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_obs"), *[F.avg(F.col(vector)[i]).alias(f"_m{i}") for i in range(p)])
    return g.select(*group, "n_obs", F.array(*[f"_m{i}" for i in range(p)]).alias("mean"))


def weighted_centroids(df: DataFrame, group: Sequence[str], p: int, vector: str = "mean", weight: str = "n_obs") -> DataFrame:
    g = df.groupBy(*group).agg(
        F.sum(weight).alias("w"), *[F.sum(F.col(vector)[i] * F.col(weight)).alias(f"_s{i}") for i in range(p)]
    )
    return g.select(*group, "w", F.array(*[F.col(f"_s{i}") / F.col("w") for i in range(p)]).alias("mean"))


def cov_matrix(df: DataFrame, p: int, by: Sequence[str] = (), vector: str = "pcs") -> DataFrame:
    """by, i, j (0-based, full symmetric matrix), v: sample covariances from one aggregation."""
    pairs = list(combinations_with_replacement(range(p), 2))
    aggs = [F.covar_samp(F.col(vector)[i], F.col(vector)[j]).alias(f"c_{i}_{j}") for i, j in pairs]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    entries = [
        F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c_{i}_{j}").alias("v"))
        for i, j in pairs
        for a, b in ({(i, j), (j, i)})
    ]
    return g.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.i", "e.j", "e.v")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("corr"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (0-based), bin_lo, n for an equal-width histogram between the extremes; empty bins are absent."""
    ext = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    j = with_scalars(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), ext)
    binned = j.select(C.equal_width_bin("v", "lo", "hi", bins).alias("bin"), "lo", "hi")
    lo = F.min("lo") + F.col("bin") * (F.min("hi") - F.min("lo")) / F.lit(float(bins))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), lo.alias("bin_lo"))


def grid_counts(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Cells of a bins x bins square grid with their number of points."""
    ext = df.agg(
        *[f for c in (x, y) for f in (F.min(c).alias(f"_{c}lo"), F.max(c).alias(f"_{c}hi"))]
    )
    j = with_scalars(df.select(x, y), ext)
    return (
        j.select(
            C.equal_width_bin(x, f"_{x}lo", f"_{x}hi", bins).alias("bx"),
            C.equal_width_bin(y, f"_{y}lo", f"_{y}hi", bins).alias("by"),
        )
        .groupBy("bx", "by")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def run_summary(scores: DataFrame, by: Sequence[str], score: str = "score", ddof: int = 1) -> DataFrame:
    """Runs that succeeded, mean, deviation, standard error and quartiles per method.

    ``scores`` holds one row per run, so the percentile buffers stay as small as the number of runs.
    """
    sd = F.stddev_samp(score) if ddof == 1 else F.stddev_pop(score)
    n = F.count(score)
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"),
        n.alias("n_success"),
        F.avg(score).alias("mean"),
        sd.alias("sd"),
        (sd / F.sqrt(F.nullif(n.cast("double"), F.lit(0.0)))).alias("se"),
        F.min(score).alias("min"),
        F.percentile(score, 0.25).alias("q1"),
        F.percentile(score, 0.5).alias("median"),
        F.percentile(score, 0.75).alias("q3"),
        F.max(score).alias("max"),
    )


def score_matrix(scores: DataFrame, rows: str, cols: str, levels: Sequence[str], value: str = "score") -> DataFrame:
    """Rows x methods with NULL where a method has no score; the levels are given, so no extra pass."""
    return scores.groupBy(rows).pivot(cols, list(levels)).agg(F.max(value))


def means_by_cluster_var(df: DataFrame, cluster: str, variables: Sequence[str]) -> DataFrame:
    return (
        df.unpivot([cluster], list(variables), "variable", "value")
        .groupBy(cluster, "variable")
        .agg(F.avg("value").alias("mean_value"))
    )


# --------------------------------------------------------------------------- order


def local_index(clusters: DataFrame, order: Sequence[str]) -> DataFrame:
    """0-based index of the (small) shard-cluster table."""
    return clusters.withColumn("idx_global", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) - 1)


def top_n(df: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    """Top n per group, ties kept."""
    return top_k_per_group(df, by, [F.desc(order)], n, rank="rank")


def top_k(df: DataFrame, order: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(order), F.asc(tie)).limit(k)


def best_run(scores: DataFrame, by: str = "method", run: str = "run", score: str = "score") -> DataFrame:
    """Run with the highest score; the smaller run name wins a tie."""
    s = scores.where(F.col(score).isNotNull())
    best = s.groupBy(by).agg(F.max(score).alias("best_score"))
    return (
        s.join(best, by)
        .where(F.col(score) == F.col("best_score"))
        .groupBy(by, "best_score")
        .agg(F.min(run).alias("best_run"))
    )


def top_loadings(loadings: DataFrame, gene: str, components: Sequence[str], n: int = 5) -> DataFrame:
    """Genes with the largest absolute loading on each component."""
    long = loadings.unpivot([gene], list(components), "component", "loading").withColumn("abs_loading", F.abs("loading"))
    return top_k_per_group(long, ["component"], [F.desc("abs_loading")], n, rank="rank").drop("abs_loading")


def avg_ranks(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return average_ranks(df, value, by)
