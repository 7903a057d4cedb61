"""Sources, scalar projections, key joins, set operations and outline predicates over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytomesh.functions import columns as C
from cytomesh.operators import joins as J
from cytomesh.operators import prep as P
from cytomesh.plans import roles as R
from cytomesh.plans.registry import query
from cytomesh.plans.sql import (
    CROSSES_RAY_SQL,
    ON_SEGMENT_SQL,
    SEG_DIST_SQL,
    SEG_T_SQL,
    r,
    rounded,
    rs,
    vertices,
    vertices_sql,
)
from cytomesh.sources import readers, writers


def scratch(spark) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    from uuid import uuid4

    from cytomesh.operators.core import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/out-{uuid4().hex}"


# --------------------------------------------------------------------------- sources and sinks

_CELL_TEXT = (
    "SELECT o_orderkey::VARCHAR AS id, (o_custkey % 1000)::INTEGER AS n_genes_by_counts, "
    "round(o_totalprice)::INTEGER AS total_counts, o_totalprice AS area, o_orderpriority AS region, "
    "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS annotation, "
    "CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS filtered FROM orders"
)


@query("S1_read_cells", _CELL_TEXT)
def s1(spark, sf_dir):
    """Write the cell table as tab-separated gzip text, read it back with the declared schema."""
    o = R.table(spark, sf_dir, "orders")
    cells = o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        (F.col("o_custkey") % 1000).cast("int").alias("n_genes_by_counts"),
        F.round("o_totalprice").cast("int").alias("total_counts"),
        F.col("o_totalprice").alias("area"),
        F.col("o_orderpriority").alias("region"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderstatus")).alias("annotation"),
        F.when(F.col("o_custkey") % 2 == 0, "yes").otherwise("no").alias("filtered"),
    )
    path = scratch(spark) + "/cells.tsv.gz"
    cells.write.option("header", True).option("sep", "\t").option("nullValue", "NA").option("compression", "gzip").csv(path)
    return readers.read_cells(spark, path)


@query("S2_read_triplets", f"WITH {R.COUNTS_SQL} SELECT * FROM counts")
def s2(spark, sf_dir):
    """Write counts as cells x genes coordinate text and read them back: the axes are turned on reading."""
    counts = R.counts(spark, sf_dir)
    cells, genes = readers.numbered(counts, "cell_id", "cell_idx"), readers.numbered(counts, "gene_id", "gene_idx")
    path = scratch(spark) + "/counts.mtx"
    writers.write_triplets(counts, genes, cells, path, by_cell=True)
    return readers.read_triplets(spark, path, genes, cells)


@query(
    "S2_read_real_triplets",
    f"SELECT l_suppkey AS cell_id, l_partkey AS gene_id, {rs('sum(l_discount) / 8', 9)} AS cnt FROM lineitem GROUP BY 1, 2",
)
def s2b(spark, sf_dir):
    """Real entries are kept as they are."""
    li = R.table(spark, sf_dir, "lineitem")
    counts = li.groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg((F.sum("l_discount") / 8).alias("cnt"))
    cells, genes = readers.numbered(counts, "cell_id", "cell_idx"), readers.numbered(counts, "gene_id", "gene_idx")
    path = scratch(spark) + "/real.mtx"
    writers.write_triplets(counts, genes, cells, path, field="real")
    return rounded(readers.read_triplets(spark, path, genes, cells), ["cnt"], 9)


@query(
    "S3_read_shards",
    "SELECT shard_id, cluster, count, " + rs("count * 1.0::DOUBLE / total_n", 9) + " AS proportion, total_n::BIGINT AS total_n FROM (SELECT *, sum(count) OVER (PARTITION BY shard_id) AS total_n FROM "
    "(SELECT (c_custkey % 7)::INTEGER AS shard_id, c_nationkey AS cluster, count(*) AS count FROM customer WHERE c_custkey % 7 IN (0, 1, 2, 5) GROUP BY 1, 2))",
)
def s3(spark, sf_dir):
    """Per-shard summary files; shards without a companion are skipped."""
    own = R.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).cast("int").alias("shard_id"), F.col("c_nationkey").alias("cluster"))
    counts = own.groupBy("shard_id", "cluster").agg(F.count(F.lit(1)).alias("count"))
    df = counts.join(own.groupBy("shard_id").agg(F.count(F.lit(1)).alias("total_n")), "shard_id").select(
        "shard_id", "cluster", "count", (F.col("count") / F.col("total_n")).alias("proportion"), "total_n"
    )
    path = scratch(spark)
    for s in range(7):
        name = f"Shard_{s:03d}_proportions.csv"
        df.where(F.col("shard_id") == s).drop("shard_id").write.option("header", True).csv(f"{path}/{name}")
    companions = spark.createDataFrame([(0,), (1,), (2,), (5,)], "shard_id int")
    return rounded(readers.read_shards(spark, f"{path}/*", r"Shard_(\d+)_proportions", readers.PROPORTIONS_SCHEMA, companions), ["proportion"], 9)


@query("S4_read_boundary", "WITH p AS (SELECT nation.n_nationkey AS polygon_id, (c_custkey % 3)::INTEGER AS ring_id, c_custkey AS seq, c_acctbal AS x, c_custkey::DOUBLE AS y FROM customer JOIN nation ON c_nationkey = n_nationkey) "
    "SELECT * FROM (SELECT polygon_id, ring_id, seq, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, "
    "coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM p WINDOW w AS (PARTITION BY polygon_id, ring_id ORDER BY seq)) WHERE x1 <> x2 OR y1 <> y2")
def s4(spark, sf_dir):
    v = R.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("polygon_id"),
        (F.col("c_custkey") % 3).cast("int").alias("ring_id"),
        F.col("c_custkey").alias("seq"),
        F.col("c_acctbal").alias("x"),
        F.col("c_custkey").cast("double").alias("y"),
    )
    return readers.read_boundary(v)


@query(
    "S5_stack_sources",
    "SELECT 'customer' AS source_id, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer "
    "UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier",
)
def s5(spark, sf_dir):
    c = R.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    s = R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return readers.stack_sources({"customer": c, "supplier": s})


@query(
    "S6_write_shards",
    f"WITH {R.cells_sql()} SELECT cell_id, x, y, annotation, (cell_id % 4)::INTEGER AS shard_id FROM cells",
)
def s6(spark, sf_dir):
    df = R.cells(spark, sf_dir).select("cell_id", "x", "y", "annotation", (F.col("cell_id") % 4).cast("int").alias("shard_id"))
    path = scratch(spark)
    writers.write_shards(df, path)
    return spark.read.parquet(path)


@query(
    "S7_write_summary",
    "SELECT o_orderpriority AS region, count(*)::INTEGER AS n, " + rs("avg(o_totalprice)", 4) + " AS mean_price FROM orders GROUP BY 1",
)
def s7(spark, sf_dir):
    df = R.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("region")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("o_totalprice"), 4, "mean_price")
    )
    path = scratch(spark)
    writers.write_summary(df, path)
    return spark.read.schema("region string, n int, mean_price double").option("header", True).csv(path)


@query(
    "S8_export_labels",
    f"WITH {R.SAMPLES_SQL} SELECT obs_id, " + ", ".join(f"max(CASE WHEN iter = {i} THEN label END) AS run_{i}" for i in range(1, 32)) + " FROM samples GROUP BY 1",
)
def s8(spark, sf_dir):
    long = R.samples(spark, sf_dir).withColumn("run", F.concat(F.lit("run_"), F.col("iter").cast("string")))
    return writers.export_labels(long, ["obs_id"], [f"run_{i}" for i in range(1, 32)])


# --------------------------------------------------------------------------- projections and filters


@query("P1_keep_rows", f"WITH {R.cells_sql()} SELECT cell_id, x, y, annotation FROM cells WHERE annotation IS NOT NULL AND annotation < 7 AND x > 0")
def p1(spark, sf_dir):
    c = R.cells(spark, sf_dir)
    cond = F.col("annotation").isNotNull() & (F.col("annotation") < 7) & (F.col("x") > 0)
    return P.keep_rows(c, cond).select("cell_id", "x", "y", "annotation")


@query(
    "P2_log_normalize",
    f"WITH {R.SPARSE_SQL}, t AS (SELECT cell_id, sum(cnt) AS total FROM counts GROUP BY 1) "
    f"SELECT cell_id, gene_id, {rs('ln(1 + cnt / total * 10000)')} AS value FROM counts JOIN t USING (cell_id)",
)
def p2(spark, sf_dir):
    return rounded(P.log_normalize(R.sparse_counts(spark, sf_dir)), ["value"])


@query("P3_log1p_counts", f"WITH {R.SPARSE_SQL} SELECT cell_id, gene_id, cnt, {rs('ln(1 + cnt)')} AS value FROM counts")
def p3(spark, sf_dir):
    return rounded(P.log1p_counts(R.sparse_counts(spark, sf_dir)), ["value"])


@query(
    "P4_clipped_ratio",
    f"WITH {R.QC_SQL} SELECT cell_id, {rs('least(greatest(control_counts / greatest(total_counts, 1e-9::DOUBLE), 0), 1)')} AS control_ratio, "
    f"{rs('least(greatest(cell_area / greatest(total_counts, 1e-9::DOUBLE), 0), 1)')} AS area_ratio, "
    f"{rs('nucleus_area / greatest(cell_area, 1e-9::DOUBLE)')} AS nucleus_ratio FROM qc",
)
def p4(spark, sf_dir):
    q = R.qc_cells(spark, sf_dir)
    return q.select(
        "cell_id",
        r(C.clipped_ratio("control_counts", "total_counts"), name="control_ratio"),
        r(C.clipped_ratio("cell_area", "total_counts"), name="area_ratio"),
        r(C.floored_ratio("nucleus_area", "cell_area"), name="nucleus_ratio"),
    )


#: Bounds that suit these tables; callers of the operator bring their own.
_QC = {"transcripts": 30, "area_low": 25, "area_high": 1500, "control": 0.4, "unassigned": 0.45, "nucleus_low": 0.05, "nucleus_high": 0.6, "assigned": 0.9}


def qc_gate_columns():
    return {
        "keep_transcripts": F.col("transcript_counts") >= _QC["transcripts"],
        "keep_area": F.col("cell_area").between(_QC["area_low"], _QC["area_high"]),
        "keep_control": C.clipped_ratio("control_counts", "total_counts") <= _QC["control"],
        "keep_unassigned": C.clipped_ratio("unassigned_counts", "total_counts") <= _QC["unassigned"],
        "keep_nucleus": C.floored_ratio("nucleus_area", "cell_area").between(_QC["nucleus_low"], _QC["nucleus_high"]),
        "keep_assignment": C.clipped_ratio("transcript_counts", "total_counts") >= _QC["assigned"],
    }


_QC_FLAGS_SQL = (
    "WITH {qc}, f AS (SELECT cell_id, transcript_counts >= {transcripts} AS keep_transcripts, "
    "cell_area BETWEEN {area_low} AND {area_high} AS keep_area, "
    "least(greatest(control_counts / greatest(total_counts, 1e-9::DOUBLE), 0), 1) <= {control}::DOUBLE AS keep_control, "
    "least(greatest(unassigned_counts / greatest(total_counts, 1e-9::DOUBLE), 0), 1) <= {unassigned}::DOUBLE AS keep_unassigned, "
    "nucleus_area / greatest(cell_area, 1e-9::DOUBLE) BETWEEN {nucleus_low}::DOUBLE AND {nucleus_high}::DOUBLE AS keep_nucleus, "
    "least(greatest(transcript_counts / greatest(total_counts, 1e-9::DOUBLE), 0), 1) >= {assigned}::DOUBLE AS keep_assignment FROM qc), "
    "g AS (SELECT *, keep_transcripts AND keep_area AND keep_control AND keep_unassigned AND keep_nucleus AND keep_assignment AS keep FROM f) "
).format(qc=R.QC_SQL, **_QC)
_GATES = ["keep_transcripts", "keep_area", "keep_control", "keep_unassigned", "keep_nucleus", "keep_assignment"]


@query("P5_qc_gates", _QC_FLAGS_SQL + "SELECT * FROM g")
def p5(spark, sf_dir):
    gates = qc_gate_columns()
    return P.qc_gates(R.qc_cells(spark, sf_dir), gates).select("cell_id", *gates, "keep")


@query(
    "P5_gate_summary",
    _QC_FLAGS_SQL
    + " UNION ALL ".join(
        f"SELECT '{g}' AS gate, count(*) FILTER (WHERE {g}) AS n_pass, {rs(f'count(*) FILTER (WHERE {g}) * 100.0 / count(*)')} AS pct_pass FROM g"
        for g in [*_GATES, "keep"]
    ),
)
def p5b(spark, sf_dir):
    gates = qc_gate_columns()
    flagged = P.qc_gates(R.qc_cells(spark, sf_dir), gates)
    return rounded(P.gate_summary(flagged, [*gates, "keep"]), ["pct_pass"])


@query(
    "P6_recode",
    "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' "
    "WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' END AS segment_group FROM customer",
)
def p6(spark, sf_dir):
    c = R.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return P.recode(c, "c_mktsegment", {"heavy": ["BUILDING", "MACHINERY"], "home": ["HOUSEHOLD", "FURNITURE"]}, "segment_group")


@query(
    "P8_parse_run_name",
    "WITH runs AS (SELECT 'q' || (p_size % 9) || '_pc' || (p_partkey % 15) || CASE WHEN p_size > 25 THEN '_Shard_' || lpad((p_partkey % 100)::VARCHAR, 3, '0') ELSE '' END AS run FROM part) "
    "SELECT run, regexp_extract(run, 'q(\\d+)_', 1)::INTEGER AS k, regexp_extract(run, 'pc(\\d+)', 1)::INTEGER AS n_pcs, "
    "nullif(regexp_extract(run, 'Shard_(\\d+)', 1), '')::INTEGER AS shard_id FROM runs",
)
def p8(spark, sf_dir):
    tail = F.when(
        F.col("p_size") > 25, F.concat(F.lit("_Shard_"), F.lpad((F.col("p_partkey") % 100).cast("string"), 3, "0"))
    ).otherwise("")
    runs = R.table(spark, sf_dir, "part").select(
        F.concat(F.lit("q"), F.col("p_size") % 9, F.lit("_pc"), F.col("p_partkey") % 15, tail).alias("run")
    )
    return P.parse_run_name(runs)


@query(
    "P9_label_codes",
    "WITH l AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '3%' THEN NULL ELSE o_orderpriority END AS lab FROM orders), "
    "c AS (SELECT lab, dense_rank() OVER (ORDER BY lab)::INTEGER AS code FROM (SELECT DISTINCT lab FROM l WHERE lab IS NOT NULL)) "
    "SELECT l.lab, o_orderkey, code FROM l LEFT JOIN c ON l.lab = c.lab",
)
def p9(spark, sf_dir):
    lab = F.when(~F.col("o_orderpriority").like("3%"), F.col("o_orderpriority"))
    return P.label_codes(R.table(spark, sf_dir, "orders").select("o_orderkey", lab.alias("lab")), "lab")


@query("P10_adapt_result", f"WITH {R.cells_sql()} SELECT cell_id, y AS x, x AS y, annotation + 1 AS annotation FROM cells")
def p10(spark, sf_dir):
    return P.adapt_result(R.cells(spark, sf_dir).select("cell_id", "x", "y", "annotation"), "annotation", 1, True)


@query(
    "P11_pct_feature",
    f"WITH {R.COUNTS_SQL} SELECT cell_id, {rs('sum(CASE WHEN regexp_matches(gene_id, ' + chr(39) + '^Brand#1' + chr(39) + ') THEN cnt ELSE 0 END) * 100.0 / sum(cnt)')} AS pct FROM counts GROUP BY 1",
)
def p11(spark, sf_dir):
    return rounded(P.pct_feature(R.counts(spark, sf_dir), "^Brand#1"), ["pct"])


@query(
    "P12_winsorize",
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) "
    f"SELECT o_orderkey, o_totalprice, {rs('least(greatest(o_totalprice, lo), hi)')} AS clipped FROM orders CROSS JOIN q",
)
def p12(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(P.winsorize(o, "o_totalprice"), ["clipped"])


@query(
    "P13_angle_segment",
    f"WITH {R.cells_sql()}, a AS (SELECT cell_id, atan2(y, x) AS a FROM cells) SELECT cell_id, {rs('a')} AS angle, "
    "(CASE WHEN a > -pi() AND a <= -pi() / 2 THEN 1 WHEN a > -pi() / 2 AND a <= 0 THEN 2 WHEN a > 0 AND a <= pi() / 2 THEN 3 "
    "WHEN a > pi() / 2 AND a <= pi() THEN 4 END)::INTEGER AS segment FROM a",
)
def p13(spark, sf_dir):
    return R.cells(spark, sf_dir).select("cell_id", r(C.polar_angle(), name="angle"), C.angle_segment(n=4).alias("segment"))


@query(
    "P14_in_ellipse",
    f"WITH {R.POINTS_SQL}, e AS (SELECT id, (x - 250) * cos(0.3::DOUBLE) + (y - 1200) * sin(0.3::DOUBLE) AS u, "
    "(y - 1200) * cos(0.3::DOUBLE) - (x - 250) * sin(0.3::DOUBLE) AS v FROM points) "
    "SELECT id, (u * u / (400.0::DOUBLE * 400) + v * v / (300.0::DOUBLE * 300)) <= 1 AS inside FROM e",
)
def p14(spark, sf_dir):
    return R.points(spark, sf_dir).select("id", C.in_ellipse("x", "y", 250, 1200, 400, 300, 0.3).alias("inside"))


@query(
    "P14_min_dist_to_outline",
    f"WITH {R.POINTS_SQL}, {vertices_sql()} SELECT id, {rs('min(sqrt((p.x - v.x) * (p.x - v.x) + (p.y - v.y) * (p.y - v.y)))')} AS outline_distance "
    "FROM points p CROSS JOIN verts v GROUP BY 1",
)
def p14b(spark, sf_dir):
    out = J.min_dist_to_outline(R.points(spark, sf_dir).select("id", "x", "y"), vertices(spark).select("x", "y"))
    return out.select("id", r("outline_distance"))


@query(
    "P15_size_factor_log2",
    f"WITH {R.SPARSE_SQL}, t AS (SELECT cell_id, sum(cnt)::DOUBLE AS total FROM counts GROUP BY 1), m AS (SELECT avg(total) AS ref FROM t) "
    f"SELECT cell_id, gene_id, {rs('log2(cnt / (total / ref) + 1)')} AS value FROM counts JOIN t USING (cell_id) CROSS JOIN m",
)
def p15(spark, sf_dir):
    return rounded(P.size_factor_normalize(R.sparse_counts(spark, sf_dir)), ["value"])


@query(
    "P15_median_total",
    f"WITH {R.SPARSE_SQL}, t AS (SELECT cell_id, sum(cnt)::DOUBLE AS total FROM counts GROUP BY 1), m AS (SELECT median(total) AS ref FROM t) "
    f"SELECT cell_id, gene_id, {rs('cnt / (total / ref)')} AS value FROM counts JOIN t USING (cell_id) CROSS JOIN m",
)
def p15b(spark, sf_dir):
    return rounded(P.size_factor_normalize(R.sparse_counts(spark, sf_dir), "median"), ["value"])


_GENES = ["Brand#1", "Brand#7", "Brand#13"]


@query(
    "P16_gene_columns",
    f"WITH {R.COUNTS_SQL} SELECT s_suppkey AS cell_id, s_acctbal AS x, "
    + ", ".join(f"coalesce(sum(CASE WHEN gene_id = '{g}' THEN cnt END), 0)::BIGINT AS g_{i}" for i, g in enumerate(_GENES))
    + " FROM supplier LEFT JOIN counts ON cell_id = s_suppkey GROUP BY 1, 2",
)
def p16(spark, sf_dir):
    cells = R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("x"))
    return P.gene_columns(R.counts(spark, sf_dir), cells, _GENES)


@query(
    "P17_make_unique",
    "SELECT p_partkey, p_name, CASE WHEN rn > 1 THEN p_name || '-' || (rn - 1) ELSE p_name END AS unique_name FROM "
    "(SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)",
)
def p17(spark, sf_dir):
    return P.make_unique(R.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


# --------------------------------------------------------------------------- joins


@query("J1_attach", "SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j1(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("id"))
    c = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return J.attach(o, c, "id").select("o_orderkey", "o_totalprice", "c_mktsegment")


@query("J2_attach_left", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j2(spark, sf_dir):
    d = R.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return J.attach_left(d, R.table(spark, sf_dir, "labels"), "doc_id")


@query(
    "J3_outer_on_xy",
    "WITH a AS (SELECT p_size::DOUBLE AS x, (p_partkey % 97)::DOUBLE AS y, p_partkey AS a_id FROM part), "
    "b AS (SELECT c_nationkey::DOUBLE AS x, (c_custkey % 97)::DOUBLE AS y, c_custkey AS b_id FROM customer) "
    "SELECT x, y, a_id, b_id FROM a FULL JOIN b USING (x, y)",
)
def j3(spark, sf_dir):
    a = R.table(spark, sf_dir, "part").select(
        F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), F.col("p_partkey").alias("a_id")
    )
    b = R.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("double").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"), F.col("c_custkey").alias("b_id")
    )
    return J.outer_on_xy(a, b)


_J4_SQL = (
    "WITH e AS (SELECT o_custkey AS r, o_orderpriority AS p, max(o_orderstatus) AS label FROM orders GROUP BY 1, 2), "
    "a AS (SELECT r, label FROM e WHERE p = '1-URGENT'), b AS (SELECT r, label FROM e WHERE p = '2-HIGH'), "
    "c AS (SELECT r, label FROM e WHERE p = '3-MEDIUM'), d AS (SELECT r, label FROM e WHERE p = '4-NOT SPECIFIED'), f AS (SELECT r, label FROM e WHERE p = '5-LOW') "
    "SELECT r, a.label AS urgent, b.label AS high, c.label AS medium, d.label AS unspecified, f.label AS low "
    "FROM a FULL JOIN b USING (r) FULL JOIN c USING (r) FULL JOIN d USING (r) FULL JOIN f USING (r)"
)


def _j4_tables(spark, sf_dir):
    e = (
        R.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("r"), F.col("o_orderpriority").alias("p"))
        .agg(F.max("o_orderstatus").alias("label"))
    )
    names = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}
    return {n: e.where(F.col("p") == v).select("r", "label") for n, v in names.items()}


@query("J4_join_all", _J4_SQL)
def j4(spark, sf_dir):
    return J.join_all(_j4_tables(spark, sf_dir), ["r"])


@query("J4_join_all_by_join", _J4_SQL)
def j4b(spark, sf_dir):
    return J.join_all_by_join(_j4_tables(spark, sf_dir), ["r"])


@query(
    "J5_keep_ids",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)",
)
def j5(spark, sf_dir):
    ids = R.table(spark, sf_dir, "part").where(F.col("p_size") < 10).select(F.col("p_partkey").alias("l_partkey"))
    li = R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return J.keep_ids(li, ids, "l_partkey").drop("l_partkey")


@query(
    "J6_drop_duplicated_ids",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)",
)
def j6(spark, sf_dir):
    return J.drop_duplicated_ids(R.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query(
    "J7_align_ids",
    f"WITH {R.SPARSE_SQL}, m AS (SELECT s_suppkey AS cell_id, s_nationkey FROM supplier WHERE s_acctbal > 0), "
    "k AS (SELECT cell_id FROM counts INTERSECT SELECT cell_id FROM m) "
    "SELECT cell_id, s_nationkey, gene_id, cnt FROM counts JOIN k USING (cell_id) JOIN m USING (cell_id)",
)
def j7(spark, sf_dir):
    m = R.table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("cell_id"), "s_nationkey")
    counts, cells = J.align_ids(R.sparse_counts(spark, sf_dir), m)
    return counts.join(cells, "cell_id").select("cell_id", "s_nationkey", "gene_id", "cnt")


@query(
    "J8_join_rounded_xy",
    "WITH a AS (SELECT p_partkey AS a_id, round_even(p_size + 0.5::DOUBLE, 0)::INTEGER AS x, round_even(p_retailprice / 100, 0)::INTEGER AS y FROM part), "
    "b AS (SELECT s_suppkey AS b_id, round_even(s_nationkey * 2.0::DOUBLE, 0)::INTEGER AS x, round_even(s_acctbal / 500, 0)::INTEGER AS y FROM supplier) "
    "SELECT x, y, a_id, b_id FROM a LEFT JOIN b USING (x, y)",
)
def j8(spark, sf_dir):
    a = R.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("a_id"), (F.col("p_size") + F.lit(0.5)).alias("x"), (F.col("p_retailprice") / 100).alias("y")
    )
    b = R.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("b_id"), (F.col("s_nationkey") * F.lit(2.0)).alias("x"), (F.col("s_acctbal") / 500).alias("y")
    )
    return J.join_rounded_xy(a, b)


@query(
    "J10_points_in_polygons",
    f"WITH {R.POINTS_SQL}, {vertices_sql()}, h AS (SELECT p.id, s.polygon_id, count(*) FILTER (WHERE {CROSSES_RAY_SQL}) % 2 = 1 "
    f"OR count(*) FILTER (WHERE {ON_SEGMENT_SQL}) > 0 AS hit FROM points p CROSS JOIN segs s GROUP BY 1, 2) "
    "SELECT id, bool_or(hit) AS inside FROM h GROUP BY 1",
)
def j10(spark, sf_dir):
    segs = readers.read_boundary(vertices(spark))
    return J.points_in_polygons(R.points(spark, sf_dir).select("id", "x", "y"), segs).select("id", "inside")


@query(
    "J11_min_boundary_distance",
    f"WITH {R.POINTS_SQL}, {vertices_sql()}, d AS (SELECT id, min({SEG_DIST_SQL}) AS d FROM (SELECT p.id, p.x, p.y, s.x1, s.y1, s.x2, s.y2, "
    f"{SEG_T_SQL} AS t FROM points p CROSS JOIN segs s) p, (SELECT 1) z WHERE true GROUP BY 1) SELECT id, {rs('d')} AS boundary_distance, d > 15 AS keep FROM d".replace(
        "s.x1 + t", "p.x1 + t").replace("s.y1 + t", "p.y1 + t").replace("t * (s.x2 - s.x1)", "t * (p.x2 - p.x1)").replace("t * (s.y2 - s.y1)", "t * (p.y2 - p.y1)"),
)
def j11(spark, sf_dir):
    segs = readers.read_boundary(vertices(spark))
    d = J.min_boundary_distance(R.points(spark, sf_dir).select("id", "x", "y"), segs)
    return d.select("id", r("boundary_distance"), (F.col("boundary_distance") > 15).alias("keep"))


@query(
    "J12_join_result",
    "WITH a AS (SELECT c_custkey AS barcode, c_mktsegment AS truth FROM customer), b AS (SELECT o_custkey AS barcode, max(o_orderpriority) AS label FROM orders GROUP BY 1) "
    "SELECT barcode, truth, label FROM a JOIN b USING (barcode)",
)
def j12(spark, sf_dir):
    a = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("barcode"), F.col("c_mktsegment").alias("truth"))
    b = R.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("barcode")).agg(F.max("o_orderpriority").alias("label"))
    return J.join_result(a, b)


@query(
    "J13_with_endpoints",
    "WITH e AS (SELECT l_suppkey AS src, (l_partkey % 100)::BIGINT AS dst, count(*) AS w FROM lineitem GROUP BY 1, 2) "
    "SELECT src, dst, w, a.s_nationkey AS src_cluster, b.s_nationkey AS dst_cluster FROM e JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst",
)
def j13(spark, sf_dir):
    e = (
        R.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    v = R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("cluster"))
    return J.with_endpoints(e, v, "cluster")


@query(
    "J14_compose_partition",
    "SELECT c_custkey AS obs_id, n_regionkey AS team FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def j14(spark, sf_dir):
    groups = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("obs_id"), F.col("c_nationkey").alias("grp"))
    teams = R.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("grp"), F.col("n_regionkey").alias("team"))
    return J.compose_partition(groups, teams).select("obs_id", "team")


@query(
    "J15_apply_alignment",
    f"WITH {R.cells_sql()} SELECT cell_id, cell_id % 4 AS shard_id, annotation AS cluster, "
    "CASE WHEN annotation < 8 THEN (annotation + cell_id % 4) % 5 END AS ref_cluster FROM cells",
)
def j15(spark, sf_dir):
    c = R.cells(spark, sf_dir).select("cell_id", (F.col("cell_id") % 4).alias("shard_id"), F.col("annotation").alias("cluster"))
    hard = c.where(F.col("cluster") < 8).select("shard_id", "cluster", ((F.col("cluster") + F.col("shard_id")) % 5).alias("ref_cluster")).distinct()
    return J.apply_alignment(c, hard).select("cell_id", "shard_id", "cluster", "ref_cluster")


# --------------------------------------------------------------------------- set operations


@query("O1_union", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def o1(spark, sf_dir):
    a = R.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.unionByName(R.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query(
    "O2_common_ids",
    "SELECT l_partkey AS id FROM lineitem INTERSECT SELECT o_orderkey FROM orders INTERSECT SELECT c_custkey FROM customer",
)
def o2(spark, sf_dir):
    return J.common_ids(
        R.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")),
        R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")),
        R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")),
    )


@query("O3_minus_ids", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def o3(spark, sf_dir):
    return J.minus_ids(
        R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")),
        R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct(),
    )


@query("O4_n_clusters", f"WITH {R.SAMPLES_SQL} SELECT iter, count(DISTINCT label) AS n_clusters FROM samples GROUP BY 1")
def o4(spark, sf_dir):
    return J.n_clusters(R.samples(spark, sf_dir), "label", ["iter"])


@query("O5_unique_features", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def o5(spark, sf_dir):
    return P.unique_features(R.table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")


@query(
    "H3_parameter_grid",
    "WITH m AS (SELECT DISTINCT c_mktsegment AS method FROM customer) SELECT method, k, p FROM m CROSS JOIN (VALUES (3), (5), (7)) a(k) CROSS JOIN (VALUES (3), (10)) b(p)",
)
def h3(spark, sf_dir):
    methods = R.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("method")).distinct()
    ks = spark.createDataFrame([(3,), (5,), (7,)], "k int")
    ps = spark.createDataFrame([(3,), (10,)], "p int")
    return J.parameter_grid(methods, ks, ps)


@query(
    "U4_explode_features",
    f"WITH {R.cells_sql(3)} SELECT cell_id, dim::INTEGER AS dim, pcs[dim + 1] AS value FROM cells CROSS JOIN (VALUES (0), (1), (2)) d(dim)",
)
def u4(spark, sf_dir):
    return P.unpivot_vector(R.cells(spark, sf_dir, 3), ["cell_id"], "pcs")


@query("F5_pc_table", f"WITH {R.cells_sql()} SELECT cell_id, pcs[1] AS pc1, pcs[2] AS pc2, pcs[3] AS pc3, x, y, annotation FROM cells")
def f5(spark, sf_dir):
    c = R.cells(spark, sf_dir)
    return P.pc_table(c.select("cell_id", "pcs"), c.select("cell_id", "x", "y", "annotation"), 3)
