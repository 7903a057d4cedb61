"""Aggregations, summaries and ordered reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytomesh.operators import metrics as M
from cytomesh.operators import prep as P
from cytomesh.operators.core import average_ranks, quantiles
from cytomesh.plans import roles as R
from cytomesh.plans.registry import query
from cytomesh.plans.sql import r, rounded, rs, vertices, vertices_sql
from cytomesh.sources import readers


def count_row(df, column, name):
    """Number of distinct ids as a one-row frame."""
    return df.select(column).distinct().agg(F.count(F.lit(1)).alias(name))


@query("A1_cell_totals", f"WITH {R.SPARSE_SQL} SELECT cell_id, sum(cnt)::BIGINT AS total_counts, count(*) AS n_genes FROM counts GROUP BY 1")
def a1(spark, sf_dir):
    return P.cell_totals(R.sparse_counts(spark, sf_dir))


@query(
    "A2_filter_genes",
    f"WITH {R.SPARSE_SQL} SELECT * FROM counts WHERE gene_id IN (SELECT gene_id FROM counts WHERE cnt > 0 GROUP BY 1 HAVING count(*) >= 28)",
)
def a2(spark, sf_dir):
    return P.filter_genes(R.sparse_counts(spark, sf_dir), 28)


_MOM_SQL = (
    f"WITH {R.SPARSE_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM supplier), "
    "s AS (SELECT gene_id, sum(cnt)::DOUBLE AS s1, sum(cnt::DOUBLE * cnt) AS s2 FROM counts GROUP BY 1), "
    "m AS (SELECT gene_id, s1 / n AS mean, (s2 - s1 * s1 / n) / (n - 1) AS variance FROM s CROSS JOIN n) "
)


@query("A3_gene_moments", _MOM_SQL + f"SELECT gene_id, {rs('mean')} AS mean, {rs('variance')} AS variance, {rs('variance / (greatest(mean, 1e-12::DOUBLE) * greatest(mean, 1e-12::DOUBLE))')} AS cv2 FROM m")
def a3(spark, sf_dir):
    n = R.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.gene_moments(R.sparse_counts(spark, sf_dir), n), ["mean", "variance", "cv2"])


@query(
    "A4_detection_rate",
    f"WITH {R.SPARSE_SQL} SELECT gene_id, count(*) AS n_detected, {rs('count(*) * 100.0 / (SELECT count(*) FROM supplier)')} AS pct_detected FROM counts WHERE cnt > 0 GROUP BY 1",
)
def a4(spark, sf_dir):
    n = R.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.detection_rate(R.sparse_counts(spark, sf_dir), n), ["pct_detected"])


@query(
    "A5_sparsity",
    f"WITH {R.SPARSE_SQL} SELECT count(*) AS nnz, {rs('(1 - count(*) / ((SELECT count(*) FROM supplier)::DOUBLE * (SELECT count(*) FROM part))) * 100')} AS sparsity_pct FROM counts WHERE cnt <> 0",
)
def a5(spark, sf_dir):
    n = R.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    g = R.table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("g"))
    return rounded(P.sparsity(R.sparse_counts(spark, sf_dir), n, g), ["sparsity_pct"])


@query(
    "A6_dataset_summary",
    f"WITH {R.QC_SQL} SELECT count(*) AS n_cells, count(*) FILTER (WHERE n_genes >= 3) AS n_kept, count(*) FILTER (WHERE n_genes < 3) AS n_filtered, "
    f"{rs('avg(total_counts)')} AS mean_total_counts, {rs('sum(total_counts)', 2)} AS sum_total_counts, {rs('min(cell_area)')} AS min_cell_area, {rs('max(cell_area)')} AS max_cell_area, "
    f"{rs('median(total_counts)')} AS median_total_counts, {rs('median(cell_area)')} AS median_cell_area FROM qc",
)
def a6(spark, sf_dir):
    q = R.qc_cells(spark, sf_dir)
    s = P.dataset_summary(q, F.col("n_genes") >= 3, ["total_counts", "cell_area"], ["total_counts"], ["cell_area"])
    s = s.withColumn("sum_total_counts", r("sum_total_counts", 2))
    return rounded(s, ["mean_total_counts", "min_cell_area", "max_cell_area", "median_total_counts", "median_cell_area"])


@query(
    "A7_proportions",
    f"SELECT c_nationkey, c_mktsegment, count(*) AS n_obs, (sum(count(*)) OVER (PARTITION BY c_nationkey))::BIGINT AS total_n, "
    f"{rs('count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey)')} AS prop FROM customer GROUP BY 1, 2",
)
def a7(spark, sf_dir):
    return rounded(P.proportions(R.table(spark, sf_dir, "customer"), "c_mktsegment", ["c_nationkey"]), ["prop"])


@query(
    "A8_qc_by_cluster",
    f"WITH {R.COUNTS_SQL}, {R.CELL_LABELS_SQL}, t AS (SELECT cell_id, sum(cnt) AS u, count(*) AS g, sum(CASE WHEN gene_id LIKE 'Brand#1%' THEN cnt ELSE 0 END) * 100.0::DOUBLE / sum(cnt) AS p FROM counts GROUP BY 1), "
    "a AS (SELECT cluster, count(*) AS n, avg(u) AS u, avg(g) AS g, avg(p) AS p FROM t JOIN cell_labels USING (cell_id) GROUP BY 1) "
    "SELECT cluster, n AS n_cells, round_even(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS pct_total, round_even(u, 0) AS mean_counts, round_even(g, 0) AS mean_genes, round_even(p, 1) AS mean_pct FROM a",
)
def a8(spark, sf_dir):
    counts = R.counts(spark, sf_dir)
    cells = (
        P.cell_totals(counts)
        .join(P.pct_feature(counts, "^Brand#1"), "cell_id")
        .join(R.cell_labels(spark, sf_dir), "cell_id")
    )
    return P.qc_by_cluster(cells, "cluster")


_PCS10 = ", ".join(f"round(avg(pcs[{i + 1}]), 6) + 0.0::DOUBLE AS m{i}" for i in range(10))


@query("A9_centroids", f"WITH {R.cells_sql()} SELECT annotation, count(*) AS n_obs, {_PCS10} FROM cells GROUP BY 1")
def a9(spark, sf_dir):
    c = P.centroids(R.cells(spark, sf_dir), ["annotation"], 10)
    return c.select("annotation", "n_obs", *[r(F.col("mean")[i], name=f"m{i}") for i in range(10)])


@query(
    "A10_cov_matrix",
    f"WITH {R.cells_sql(3)}, d AS (SELECT unnest([0, 1, 2])::INTEGER AS i) SELECT annotation, a.i AS i, b.i AS j, {rs('covar_samp(pcs[a.i + 1], pcs[b.i + 1])', 8)} AS v "
    "FROM cells CROSS JOIN d a CROSS JOIN d b GROUP BY 1, 2, 3",
)
def a10(spark, sf_dir):
    return rounded(P.cov_matrix(R.cells(spark, sf_dir, 3), 3, ["annotation"]), ["v"], 8)


@query("A11_correlation", f"WITH {R.QC_SQL} SELECT {rs('corr(transcript_counts, cell_area)')} AS corr FROM qc")
def a11(spark, sf_dir):
    return rounded(P.correlation(R.qc_cells(spark, sf_dir), "transcript_counts", "cell_area"), ["corr"])


@query(
    "A12_quantiles",
    f"SELECT o_orderpriority, {rs('quantile_cont(o_totalprice, 0.25)')} AS q25, {rs('quantile_cont(o_totalprice, 0.5)')} AS q50, {rs('quantile_cont(o_totalprice, 0.97)')} AS q97 FROM orders GROUP BY 1",
)
def a12(spark, sf_dir):
    q = quantiles(R.table(spark, sf_dir, "orders"), "o_totalprice", {"q25": 0.25, "q50": 0.5, "q97": 0.97}, ["o_orderpriority"])
    return rounded(q, ["q25", "q50", "q97"])


@query(
    "A13_mad_upper_bound",
    f"WITH {R.QC_SQL}, l AS (SELECT log10(cell_area + 1) AS lg FROM qc), m AS (SELECT median(lg) AS med FROM l), "
    "d AS (SELECT med, median(abs(lg - med)) * 1.4826::DOUBLE AS mad FROM l CROSS JOIN m GROUP BY med) "
    f"SELECT {rs('med')} AS med, {rs('mad')} AS mad, {rs('least(pow(10, med + 2.5 * mad) - 1, 1000)')} AS upper FROM d",
)
def a13(spark, sf_dir):
    return rounded(P.mad_upper_bound(R.qc_cells(spark, sf_dir), "cell_area"), ["med", "mad", "upper"])


@query(
    "A15_weighted_centroids",
    f"WITH {R.cells_sql(3)}, s AS (SELECT cell_id % 4 AS shard, annotation, count(*) AS w, avg(pcs[1]) AS a, avg(pcs[2]) AS b, avg(pcs[3]) AS c FROM cells GROUP BY 1, 2) "
    f"SELECT annotation, sum(w)::BIGINT AS w, {rs('sum(w * a) / sum(w)')} AS m0, {rs('sum(w * b) / sum(w)')} AS m1, {rs('sum(w * c) / sum(w)')} AS m2 FROM s GROUP BY 1",
)
def a15(spark, sf_dir):
    c = R.cells(spark, sf_dir, 3).withColumn("shard", F.col("cell_id") % 4)
    s = P.centroids(c, ["shard", "annotation"], 3)
    w = P.weighted_centroids(s, ["annotation"], 3)
    return w.select("annotation", "w", *[r(F.col("mean")[i], name=f"m{i}") for i in range(3)])


@query("A16_frequency", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a16(spark, sf_dir):
    return P.frequency(R.table(spark, sf_dir, "events"), "event_type")


@query("A17_contingency", "SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2")
def a17(spark, sf_dir):
    return M.contingency(R.table(spark, sf_dir, "documents"), "source", "lang")


@query(
    "A18_histogram",
    "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT least(floor((o_totalprice - lo) * 40.0::DOUBLE / (hi - lo)), 39)::INTEGER AS bin, lo, hi FROM orders CROSS JOIN e) "
    f"SELECT bin, count(*) AS n, {rs('min(lo) + bin * (min(hi) - min(lo)) / 40.0::DOUBLE')} AS bin_lo FROM b GROUP BY 1",
)
def a18(spark, sf_dir):
    return rounded(P.histogram(R.table(spark, sf_dir, "orders"), "o_totalprice", 40), ["bin_lo"])


@query(
    "A19_grid_counts",
    f"WITH {R.POINTS_SQL}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points) "
    "SELECT least(floor((x - x0) * 20.0::DOUBLE / (x1 - x0)), 19)::INTEGER AS bx, least(floor((y - y0) * 20.0::DOUBLE / (y1 - y0)), 19)::INTEGER AS by, count(*) AS n FROM points CROSS JOIN e GROUP BY 1, 2",
)
def a19(spark, sf_dir):
    return P.grid_counts(R.points(spark, sf_dir), "x", "y", 20)


def _scores(spark, sf_dir):
    """One score per (method, run); failed runs are NULL."""
    c = R.table(spark, sf_dir, "customer")
    avg = F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count("c_acctbal")  # exact in any order
    return c.groupBy(F.col("c_mktsegment").alias("method"), F.col("c_nationkey").alias("run")).agg(
        F.when(F.count(F.lit(1)) % 7 != 0, avg / 9973.0).alias("score")
    )


_SCORES_SQL = (
    "scores AS (SELECT c_mktsegment AS method, c_nationkey AS run, CASE WHEN count(*) % 7 <> 0 THEN "
    + "sum(c_acctbal::DECIMAL(18, 2))::DOUBLE / count(c_acctbal) / 9973.0::DOUBLE"
    + " END AS score FROM customer GROUP BY 1, 2)"
)


def _run_summary_sql(sd):
    return (
        f"WITH {_SCORES_SQL} SELECT method, count(*) AS n_runs, count(score) AS n_success, {rs('avg(score)')} AS mean, {rs(f'{sd}(score)')} AS sd, "
        f"{rs(f'{sd}(score) / sqrt(nullif(count(score), 0))')} AS se, min(score) AS min, {rs('quantile_cont(score, 0.25)')} AS q1, {rs('median(score)')} AS median, "
        f"{rs('quantile_cont(score, 0.75)')} AS q3, max(score) AS max FROM scores GROUP BY 1"
    )


@query("A20_run_summary", _run_summary_sql("stddev_samp"))
def a20(spark, sf_dir):
    return rounded(P.run_summary(_scores(spark, sf_dir), ["method"]), ["mean", "sd", "se", "q1", "median", "q3"])


@query("A20_run_summary_population", _run_summary_sql("stddev_pop"))
def a20b(spark, sf_dir):
    return rounded(P.run_summary(_scores(spark, sf_dir), ["method"], ddof=0), ["mean", "sd", "se", "q1", "median", "q3"])


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "A21_score_matrix",
    f"WITH {_SCORES_SQL} SELECT run, " + ", ".join(f"max(CASE WHEN method = '{s}' THEN score END) AS \"{s}\"" for s in _SEGMENTS) + " FROM scores GROUP BY 1",
)
def a21(spark, sf_dir):
    return P.score_matrix(_scores(spark, sf_dir), "run", "method", _SEGMENTS)


@query(
    "A22_means_by_cluster_var",
    f"WITH {R.QC_SQL}, l AS (SELECT n_genes AS cluster, v, CASE v WHEN 'cell_area' THEN cell_area WHEN 'transcript_counts' THEN transcript_counts ELSE nucleus_area END AS value "
    "FROM qc CROSS JOIN (VALUES ('cell_area'), ('transcript_counts'), ('nucleus_area')) t(v)) "
    f"SELECT cluster, v AS variable, {rs('avg(value)')} AS mean_value FROM l GROUP BY 1, 2",
)
def a22(spark, sf_dir):
    q = R.qc_cells(spark, sf_dir).withColumnRenamed("n_genes", "cluster")
    return rounded(P.means_by_cluster_var(q, "cluster", ["cell_area", "transcript_counts", "nucleus_area"]), ["mean_value"])


# --------------------------------------------------------------------------- order


@query(
    "W1_local_index",
    f"WITH {R.cells_sql()}, s AS (SELECT cell_id % 4 AS shard_id, annotation AS cluster, count(*) AS n FROM cells GROUP BY 1, 2) "
    "SELECT shard_id, cluster, n, (row_number() OVER (ORDER BY shard_id, cluster) - 1)::INTEGER AS idx_global FROM s",
)
def w1(spark, sf_dir):
    s = R.cells(spark, sf_dir).groupBy((F.col("cell_id") % 4).alias("shard_id"), F.col("annotation").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return P.local_index(s, ["shard_id", "cluster"])


@query(
    "W2_top_n_with_ties",
    "SELECT p_type, p_partkey, p_size, rk::INTEGER AS rk FROM (SELECT p_type, p_partkey, p_size, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS rk FROM part) WHERE rk <= 5",
)
def w2(spark, sf_dir):
    return P.top_n(R.table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_size"), ["p_type"], "p_size", 5)


@query(
    "W3_top_k",
    f"WITH {R.SPARSE_SQL} SELECT gene_id, count(*) AS n FROM counts GROUP BY 1 ORDER BY n DESC, gene_id LIMIT 20",
)
def w3(spark, sf_dir):
    n = R.sparse_counts(spark, sf_dir).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))
    return P.top_k(n, "n", "gene_id", 20)


@query(
    "W4_kneedle_cutoff",
    f"WITH {R.QC_SQL}, s AS (SELECT total_counts AS v, row_number() OVER (ORDER BY total_counts DESC) AS rn, count(*) OVER () AS n, max(total_counts) OVER () AS hi, min(total_counts) OVER () AS lo FROM qc), "
    "d AS (SELECT v, rn, round(abs(1 - (rn - 1) / (n - 1)::DOUBLE - (v - lo) / (hi - lo)) / sqrt(2), 12) AS d FROM s) "
    "SELECT v AS cutoff FROM d ORDER BY d DESC, rn LIMIT 1",
)
def w4(spark, sf_dir):
    return P.kneedle_cutoff(R.qc_cells(spark, sf_dir), "total_counts")


@query(
    "W5_zscore",
    f"WITH {R.POINTS_SQL} SELECT id, label, {rs('(x - avg(x) OVER w) / stddev_samp(x) OVER w')} AS x, {rs('(y - avg(y) OVER w) / stddev_samp(y) OVER w')} AS y FROM points WINDOW w AS ()",
)
def w5(spark, sf_dir):
    return rounded(P.zscore(R.points(spark, sf_dir), ["x", "y"]), ["x", "y"])


@query(
    "W6_scale_like",
    f"WITH {R.POINTS_SQL}, {vertices_sql()}, m AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_samp(y) AS sy FROM points) "
    f"SELECT polygon_id, ring_id, seq, {rs('(x - mx) / sx')} AS x, {rs('(y - my) / sy')} AS y FROM verts CROSS JOIN m",
)
def w6(spark, sf_dir):
    stats = P.moments(R.points(spark, sf_dir), ["x", "y"])
    return rounded(P.scale_like(vertices(spark), stats, ["x", "y"]), ["x", "y"])


@query(
    "W7_standardize",
    "WITH m AS (SELECT avg(o_totalprice) AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), p AS (SELECT m, greatest(hi - m, m - lo) * 2 AS s FROM m) "
    f"SELECT o_orderkey, {rs('(o_totalprice - m) / s')} AS standardized, {rs('o_totalprice', 4)} AS restored FROM orders CROSS JOIN p",
)
def w7(spark, sf_dir):
    s = P.standardize(R.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    back = P.unstandardize(s, "standardized", "restored")
    return back.select("o_orderkey", r("standardized"), r("restored", 4))


@query(
    "W8_best_run",
    f"WITH {_SCORES_SQL} SELECT method, score AS best_score, run AS best_run FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, run) AS rn FROM scores WHERE score IS NOT NULL) WHERE rn = 1",
)
def w8(spark, sf_dir):
    return P.best_run(_scores(spark, sf_dir))


@query(
    "W9_average_ranks",
    "WITH v AS (SELECT l_shipdate::DATE AS d, l_quantity, l_returnflag FROM lineitem), r AS (SELECT l_returnflag, l_quantity AS value, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rk, "
    "count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS ties, count(*) OVER (PARTITION BY l_returnflag) AS total FROM lineitem) "
    "SELECT DISTINCT l_returnflag, value, ties, rk + (ties - 1) / 2.0::DOUBLE AS avg_rank, total FROM r",
)
def w9(spark, sf_dir):
    return average_ranks(R.table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


_LOADINGS = ["pc1", "pc2", "pc3"]


@query(
    "W10_top_loadings",
    "WITH l AS (SELECT vec_id AS gene, embedding[1]::DOUBLE AS pc1, embedding[2]::DOUBLE AS pc2, embedding[3]::DOUBLE AS pc3 FROM embeddings), "
    "u AS (UNPIVOT l ON pc1, pc2, pc3 INTO NAME component VALUE loading) "
    "SELECT gene, component, loading, rk::INTEGER AS rk FROM (SELECT *, rank() OVER (PARTITION BY component ORDER BY abs(loading) DESC) AS rk FROM u) WHERE rk <= 5",
)
def w10(spark, sf_dir):
    loadings = R.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("gene"), *[F.col("embedding")[i].cast("double").alias(f"pc{i + 1}") for i in range(3)]
    )
    return P.top_loadings(loadings, "gene", _LOADINGS)


# --------------------------------------------------------------------------- fits


@query("F3_ols", f"WITH {R.QC_SQL} SELECT {rs('regr_slope(transcript_counts, cell_area)')} AS slope, {rs('regr_intercept(transcript_counts, cell_area)')} AS intercept FROM qc")
def f3(spark, sf_dir):
    return rounded(P.ols(R.qc_cells(spark, sf_dir), "transcript_counts", "cell_area"), ["slope", "intercept"])


@query(
    "F2_doublet_flag",
    f"WITH {R.QC_SQL}, l AS (SELECT cell_id, cell_area, log10(cell_area + 1) AS la, log10(transcript_counts + 1) AS lt FROM qc), "
    "f AS (SELECT regr_slope(lt, la) AS b, regr_intercept(lt, la) AS a FROM l), e AS (SELECT cell_id, cell_area, lt - (a + b * la) AS res FROM l CROSS JOIN f), "
    "z AS (SELECT cell_id, greatest(0, (res - avg(res) OVER ()) / stddev_samp(res) OVER ()) + greatest(0, (cell_area - avg(cell_area) OVER ()) / stddev_samp(cell_area) OVER ()) AS score FROM e), "
    "t AS (SELECT quantile_cont(score, 0.97) AS thr FROM z) "
    f"SELECT cell_id, {rs('score')} AS doublet_score, score > thr AS likely_doublet FROM z CROSS JOIN t",
)
def f2(spark, sf_dir):
    q = R.qc_cells(spark, sf_dir).select("cell_id", "transcript_counts", "cell_area")
    out = P.doublet_flag(q, "transcript_counts", "cell_area")
    return out.select("cell_id", r("doublet_score"), "likely_doublet")


@query(
    "E2_cell_filter",
    None,
)
def e2(spark, sf_dir):
    """Position, rank-curve cutoff, gates and doublets combined as in the cell filtering workflows.

    ``keep_upper``: counts up to the cutoff of the cells inside; ``keep_upper_rel``: or a shape that makes up for more.
    ``keep_counts`` is the filter of the workflow that goes by position and counts alone, ``keep_final`` that of the one
    with gates, which ask for a shape that lets every count pass: there the relaxed flag is kept for the record, as here.
    """
    from cytomesh.operators.core import cut_lineage, with_scalars
    from cytomesh.operators.joins import points_in_polygons
    from cytomesh.plans.tables import _QC, qc_gate_columns

    q = R.qc_cells(spark, sf_dir)
    pts = R.points(spark, sf_dir).select(F.col("id").alias("cell_id"), "x", "y")
    placed = cut_lineage(points_in_polygons(q.join(pts, "cell_id"), readers.read_boundary(vertices(spark)), key="cell_id"))
    knee = P.kneedle_cutoff(placed.where("inside"), "total_counts")
    dbl = P.doublet_flag(placed, "transcript_counts", "cell_area")
    gated = P.qc_gates(with_scalars(dbl, knee), qc_gate_columns(), "pass_gates")
    upper = F.col("total_counts") <= F.col("cutoff")
    relaxed = F.col("keep_upper") | ((F.col("cell_area") <= _QC["area_high"]) & ~F.col("likely_doublet") & F.col("keep_nucleus"))
    flags = gated.withColumn("keep_upper", upper).withColumn("keep_upper_rel", relaxed).withColumns({
        "keep_counts": F.col("inside") & F.col("keep_upper"),
        "keep_final": F.col("inside") & F.col("keep_upper_rel") & F.col("pass_gates") & ~F.col("likely_doublet"),
    })
    kept = ["inside", "keep_upper", "keep_upper_rel", "likely_doublet", "pass_gates", "keep_counts", "keep_final"]
    return flags.groupBy(*kept).agg(F.count(F.lit(1)).alias("n_cells"))
