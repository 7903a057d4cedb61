"""Features, clustering, partition scores and marker tests over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytomesh.operators import cluster as K
from cytomesh.operators import markers as T
from cytomesh.operators import prep as P
from cytomesh.operators.core import cut_lineage
from cytomesh.plans import roles as R
from cytomesh.plans.registry import query
from cytomesh.plans.spatial import _heap_tree
from cytomesh.plans.sql import r, rounded, rs


def _cells(spark, sf_dir, p=10):
    return R.cells(spark, sf_dir, p)


def _n_cells(spark, sf_dir):
    return R.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))


@query("F1_select_hvg")
def f1(spark, sf_dir):
    mom = P.gene_moments(R.sparse_counts(spark, sf_dir), _n_cells(spark, sf_dir))
    return K.select_hvg(mom, 500)


@query("F4_pca")
def f4(spark, sf_dir):
    return K.pca(_cells(spark, sf_dir, 64).withColumnRenamed("pcs", "features"), 15)


@query("F4_pca_from_counts")
def f4b(spark, sf_dir):
    """Counts -> log-normalised -> variable genes -> components."""
    counts = R.sparse_counts(spark, sf_dir)
    mom = P.gene_moments(counts, _n_cells(spark, sf_dir))
    genes = K.select_hvg(mom, 2000).where("highly_variable").select("gene_id")
    cells = R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"))
    return K.pca_counts(P.log_normalize(counts), cells, genes, 15)


@query("F6_kmeans")
def f6(spark, sf_dir):
    return K.kmeans(_cells(spark, sf_dir), 6, 10)


@query("F7_gmm")
def f7(spark, sf_dir):
    return K.gmm(_cells(spark, sf_dir), 4, 5)


@query("F8_sweep")
def f8(spark, sf_dir):
    return K.sweep(_cells(spark, sf_dir), [4, 8], [3, 10], "annotation")


@query("F11_select_k")
def f11(spark, sf_dir):
    return K.select_k(_cells(spark, sf_dir), [2, 4, 6], 3)


_SIG = 0.0625

@query(
    "F9_marginal_loglik",
    f"WITH {R.cells_sql(2)}, g AS (SELECT annotation, count(*)::DOUBLE AS n, sum(pcs[1]) AS a, sum(pcs[2]) AS b FROM cells GROUP BY 1), "
    "y AS (SELECT sum(pcs[1] * pcs[1]) AS aa, sum(pcs[1] * pcs[2]) AS ab, sum(pcs[2] * pcs[2]) AS bb, count(*) AS n FROM cells), "
    "q AS (SELECT count(*) AS k, sum(ln(n + 16)) AS ldo, sum(a * a / (n + 16)) AS saa, sum(a * b / (n + 16)) AS sab, sum(b * b / (n + 16)) AS sbb FROM g) "
    f"SELECT k::INTEGER AS k, {rs('-(2 / 2.0) * ldo - (2 + y.n) / 2.0 * ln((aa - saa + 1) * (bb - sbb + 1) - (ab - sab) * (ab - sab)) - k * ln(0.0625::DOUBLE)')} AS loglik FROM q CROSS JOIN y",
)
def f9(spark, sf_dir):
    return rounded(K.marginal_loglik(_cells(spark, sf_dir, 2), 2, cluster="annotation"), ["loglik"])


def _heap_cuts_sql(p: int, inner: str) -> str:
    """All edges id -> id // 2 as cuts; ``inner`` is the determinant that is left."""
    sums = ", ".join(f"sum(pcs[{i + 1}]) AS s{i}" for i in range(p))
    cross = ", ".join(f"sum(pcs[{i + 1}] * pcs[{j + 1}]) AS y{i}{j}" for i in range(p) for j in range(i, p))
    whole = ", ".join(f"t.s{i} AS t{i}" for i in range(p))
    left = ", ".join(
        f"y{i}{j} - s{i} * s{j} / (n1 + 16) - (t{i} - s{i}) * (t{j} - s{j}) / (n - n1 + 16) + {int(i == j)} AS c{i}{j}" for i in range(p) for j in range(i, p)
    )
    return (
        f"WITH RECURSIVE {R.cells_sql(p)}, up(id, anc) AS (SELECT cell_id, cell_id FROM cells UNION ALL SELECT id, anc // 2 FROM up WHERE anc > 0), "
        f"sub AS (SELECT anc AS eid, count(*)::DOUBLE AS n1, {sums} FROM up JOIN cells ON cell_id = id WHERE anc > 0 GROUP BY 1), "
        f"t AS (SELECT count(*)::DOUBLE AS n, {sums}, {cross} FROM cells), "
        f"sides AS (SELECT sub.*, t.n, {whole}, {', '.join(f'y{i}{j}' for i in range(p) for j in range(i, p))} FROM sub CROSS JOIN t), "
        f"rest AS (SELECT eid, n1, n, {left} FROM sides) "
        f"SELECT eid, eid AS src, eid // 2 AS dst, n1::BIGINT AS n_side, "
        f"{rs(f'-0.5 * {p} * (ln(n1 + 16) + ln(n - n1 + 16)) - ({p} + n) / 2 * ln({inner}) - {p} * ln(0.0625::DOUBLE)')} AS loglik FROM rest"
    )


@query("F10_score_cuts", _heap_cuts_sql(3, "c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02)"))
def f10(spark, sf_dir):
    """Every edge of a tree over all cells as candidate cut, three components."""
    c = _cells(spark, sf_dir, 3).select(F.col("cell_id").alias("id"), "pcs")
    return rounded(K.score_cuts(_heap_tree(c), c, 3), ["loglik"])


# --------------------------------------------------------------------------- markers


def _values(spark, sf_dir):
    """Triplets as they are; the rank tests depend on the order only."""
    return R.sparse_counts(spark, sf_dir).select("cell_id", "gene_id", F.col("cnt").cast("double").alias("value"))


_FULL = (
    f"{R.SPARSE_SQL}, {R.CELL_LABELS_SQL}, genes AS (SELECT DISTINCT gene_id FROM counts), "
    "grid AS (SELECT cell_id, cluster, gene_id, coalesce(cnt, 0)::DOUBLE AS v FROM cell_labels CROSS JOIN genes LEFT JOIN counts USING (cell_id, gene_id))"
)
_RANK = (
    "rk AS (SELECT gene_id, cluster, v, rank() OVER (PARTITION BY gene_id ORDER BY v) + (count(*) OVER (PARTITION BY gene_id, v) - 1) / 2.0::DOUBLE AS r FROM grid), "
    "tie AS (SELECT gene_id, sum(t * t * t - t) AS tie FROM (SELECT gene_id, v, count(*)::DOUBLE AS t FROM grid GROUP BY 1, 2) GROUP BY 1), "
    "ct AS (SELECT cluster, count(*)::DOUBLE AS nc, (SELECT count(*) FROM cell_labels)::DOUBLE AS n FROM cell_labels GROUP BY 1), "
    "u AS (SELECT gene_id, cluster, sum(r) - nc * (nc + 1) / 2 AS u, nc, n FROM rk JOIN ct USING (cluster) GROUP BY gene_id, cluster, nc, n), "
    "z AS (SELECT gene_id, cluster, u, u - nc * (n - nc) / 2 AS dev, nc * (n - nc) / 12 * ((n + 1) - tie / (n * (n - 1))) AS var FROM u JOIN tie USING (gene_id))"
)


@query("T1_rank_sum_statistics", f"WITH {_FULL}, {_RANK} SELECT gene_id, cluster, {rs('u')} AS u, {rs('(dev - sign(dev) * 0.5) / sqrt(var)')} AS z FROM z")
def t1(spark, sf_dir):
    return rounded(T.rank_sum_statistics(_values(spark, sf_dir), R.cell_labels(spark, sf_dir)), ["u", "z"])


@query("T1_rank_sum_markers")
def t1b(spark, sf_dir):
    return T.rank_sum_markers(_values(spark, sf_dir), R.cell_labels(spark, sf_dir))


_LOGN = "tot AS (SELECT cell_id, sum(cnt) AS total FROM counts GROUP BY 1), nv AS (SELECT g.cell_id, g.cluster, g.gene_id, g.v / total * 10000 AS e FROM grid g JOIN tot USING (cell_id))"


@query(
    "T2_fold_change",
    f"WITH {_FULL}, {_LOGN}, cl AS (SELECT DISTINCT cluster FROM cell_labels), "
    "p AS (SELECT gene_id, cl.cluster, avg(e) FILTER (WHERE nv.cluster = cl.cluster) AS m1, avg(e) FILTER (WHERE nv.cluster <> cl.cluster) AS m2, "
    "avg(CASE WHEN e > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE nv.cluster = cl.cluster) AS pct_1, avg(CASE WHEN e > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE nv.cluster <> cl.cluster) AS pct_2 FROM nv CROSS JOIN cl GROUP BY 1, 2) "
    f"SELECT gene_id, cluster, {rs('log2(m1 + 1) - log2(m2 + 1)')} AS avg_log2fc, {rs('pct_1')} AS pct_1, {rs('pct_2')} AS pct_2 FROM p",
)
def t2(spark, sf_dir):
    out = T.fold_change(P.log_normalize(R.sparse_counts(spark, sf_dir)), R.cell_labels(spark, sf_dir))
    return rounded(out, ["avg_log2fc", "pct_1", "pct_2"])


def _marker_table(spark, sf_dir):
    return R.table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), F.col("p_size") % 3).alias("method"),
        F.col("p_type").alias("cluster"),
        F.col("p_partkey").alias("gene_id"),
        (F.col("p_retailprice") / 1000.0).alias("avg_log2fc"),
        (F.col("p_size") / 500000.0).alias("p_val"),
        (F.col("p_size") / 50.0).alias("pct_1"),
        ((F.col("p_partkey") % 50) / 50.0).alias("pct_2"),
    )


_MARKERS = (
    "mk0 AS (SELECT 'm' || (p_size % 3) AS method, p_type AS cluster, p_partkey AS gene_id, p_retailprice / 1000.0::DOUBLE AS avg_log2fc, p_size / 500000.0::DOUBLE AS p_val, "
    "p_size / 50.0::DOUBLE AS pct_1, (p_partkey % 50) / 50.0::DOUBLE AS pct_2 FROM part), "
    "mk AS (SELECT *, least(p_val * (SELECT count(*) FROM part), 1.0::DOUBLE) AS p_val_adj FROM mk0)"
)


def _adjusted(spark, sf_dir):
    n = R.table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n_tests"))
    return T.adjust_p(_marker_table(spark, sf_dir), n)


@query("T3_adjust_p", f"WITH {_MARKERS} SELECT gene_id, {rs('p_val_adj', 9)} AS p_val_adj FROM mk")
def t3(spark, sf_dir):
    return _adjusted(spark, sf_dir).select("gene_id", r("p_val_adj", 9))


@query(
    "T4_top_markers",
    f"WITH {_MARKERS} SELECT cluster, gene_id, avg_log2fc, rk::INTEGER AS rk FROM (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY avg_log2fc DESC) AS rk FROM mk WHERE p_val_adj < 0.05::DOUBLE) WHERE rk <= 5",
)
def t4(spark, sf_dir):
    return T.top_markers(_adjusted(spark, sf_dir)).select("cluster", "gene_id", "avg_log2fc", "rk")


_QUALITY = (
    "q AS (SELECT method, cluster, count(*) AS n_markers, avg(avg_log2fc) AS log2fc_mean, median(avg_log2fc) AS log2fc_median, max(avg_log2fc) AS log2fc_max, "
    "avg(-log10(p_val_adj)) AS neg_log10_p_mean, avg(pct_1 - pct_2) AS specificity_mean FROM mk WHERE p_val_adj < 0.05::DOUBLE GROUP BY 1, 2)"
)


@query(
    "A23_marker_quality",
    f"WITH {_MARKERS}, {_QUALITY} SELECT method, cluster, n_markers, " + ", ".join(f"{rs(c)} AS {c}" for c in ("log2fc_mean", "log2fc_median", "log2fc_max", "neg_log10_p_mean", "specificity_mean")) + " FROM q",
)
def a23(spark, sf_dir):
    return rounded(T.marker_quality(_adjusted(spark, sf_dir)), ["log2fc_mean", "log2fc_median", "log2fc_max", "neg_log10_p_mean", "specificity_mean"])


@query(
    "A23_method_summary",
    f"WITH {_MARKERS}, {_QUALITY} SELECT method, count(*) AS n_clusters, {rs('avg(n_markers)')} AS markers_per_cluster, {rs('avg(log2fc_mean)')} AS log2fc, "
    f"{rs('avg(neg_log10_p_mean)')} AS neg_log10_p, {rs('avg(specificity_mean)')} AS specificity FROM q GROUP BY 1",
)
def a23b(spark, sf_dir):
    s = T.method_summary(T.marker_quality(_adjusted(spark, sf_dir)))
    return rounded(s, ["markers_per_cluster", "log2fc", "neg_log10_p", "specificity"])


@query(
    "T5_kruskal",
    "WITH rk AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem), "
    "t AS (SELECT sum(t * t * t - t) AS tie, sum(t) AS n FROM (SELECT count(*)::DOUBLE AS t FROM lineitem GROUP BY l_quantity)), "
    "h AS (SELECT count(*) AS k, sum(q) AS q FROM (SELECT g, sum(r) * sum(r) / count(*) AS q FROM rk GROUP BY 1)), "
    "s AS (SELECT k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h FROM h CROSS JOIN t) "
    f"SELECT {rs('h', 5)} AS statistic, (k - 1)::INTEGER AS df, {rs('exp(-h / 2)', 5)} AS p_val FROM s",
)
def t5(spark, sf_dir):
    """Three groups, so the tail of the chi-square has a closed form on the SQL side."""
    k = T.kruskal(R.table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")
    return rounded(k, ["statistic", "p_val"], 5)


@query(
    "T6_dunn_statistics",
    "WITH rk AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem), "
    "t AS (SELECT sum(t * t * t - t) AS tie, sum(t) AS n FROM (SELECT count(*)::DOUBLE AS t FROM lineitem GROUP BY l_quantity)), "
    "m AS (SELECT g, avg(r) AS m, count(*) AS c FROM rk GROUP BY 1) "
    f"SELECT a.g AS group_a, b.g AS group_b, {rs('(a.m - b.m) / sqrt((n * (n + 1) / 12 - tie / (12 * (n - 1))) * (1.0 / a.c + 1.0 / b.c))', 5)} AS z FROM m a JOIN m b ON a.g < b.g CROSS JOIN t",
)
def t6(spark, sf_dir):
    d = T.dunn_test(R.table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")
    return d.select("group_a", "group_b", r("z", 5))


@query("T6_dunn_test")
def t6b(spark, sf_dir):
    return T.dunn_test(R.table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")


_DOT_GENES = [1, 5, 17, 42, 77]


@query(
    "T7_dot_table",
    f"WITH {_FULL}, {_LOGN} SELECT cluster, gene_id, {rs('avg(e)')} AS avg_expression, {rs('avg(CASE WHEN e > 0 THEN 100.0::DOUBLE ELSE 0 END)')} AS pct_expressed FROM nv WHERE gene_id IN (1, 5, 17, 42, 77) GROUP BY 1, 2",
)
def t7(spark, sf_dir):
    d = T.dot_table(P.log_normalize(R.sparse_counts(spark, sf_dir)), R.cell_labels(spark, sf_dir), _DOT_GENES)
    return rounded(d, ["avg_expression", "pct_expressed"])


@query("E3_markers")
def e3(spark, sf_dir):
    """Log-normalised counts and clusters -> gated, adjusted markers -> top genes per cluster."""
    counts = R.sparse_counts(spark, sf_dir)
    n = R.table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n_tests"))
    found = T.find_markers(P.log_normalize(counts), R.cell_labels(spark, sf_dir), n)
    return T.top_k_per_group(found, ["cluster"], [F.asc("p_val"), F.desc("avg_log2fc"), F.asc("gene_id")], 5)


@query("E2_counts_to_clusters")
def e2(spark, sf_dir):
    """Counts -> cells and genes kept -> log-normalised -> variable genes -> components -> clusters -> scores by setting."""
    counts = R.sparse_counts(spark, sf_dir)
    totals = P.cell_totals(counts)
    cells = totals.where("n_genes >= 5 AND total_counts >= 50").select("cell_id")
    kept = counts.join(cells, "cell_id", "left_semi")
    seen = kept.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_cells"))
    kept = cut_lineage(kept.join(seen.where("n_cells >= 3").select("gene_id"), "gene_id", "left_semi"))
    genes = K.select_hvg(P.gene_moments(kept, cells.agg(F.count(F.lit(1)).alias("n"))), 2000).where("highly_variable").select("gene_id")
    pcs = cut_lineage(K.pca_counts(P.log_normalize(kept), cells, genes, 15))
    # few cells have fewer components: all rows are 0 on those that would follow
    pcs = pcs.withColumn("pcs", F.slice(F.concat("pcs", F.array_repeat(F.lit(0.0), 15)), 1, 15))
    named = pcs.join(R.cell_labels(spark, sf_dir).withColumnRenamed("cluster", "annotation"), "cell_id")
    return K.sweep(named, [3, 5], [5, 10], "annotation")
