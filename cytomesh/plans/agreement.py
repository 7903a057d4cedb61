"""Label agreement, cluster quality, sampled partitions, shards and alignment over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytomesh.operators import lsh as L
from cytomesh.operators import metrics as M
from cytomesh.operators import posterior as B
from cytomesh.operators import prep as P
from cytomesh.operators import shards as S
from cytomesh.plans import roles as R
from cytomesh.plans.registry import query
from cytomesh.plans.sql import r, rounded, rs
from cytomesh.plans.tables import scratch
from cytomesh.sources import readers, writers

# --------------------------------------------------------------------------- agreement


def ari_sql(source: str, a: str, b: str, by: str = "") -> str:
    """CTEs ending in ``ari(by..., ari)`` from a relation with label columns a and b."""
    sel, g = (f"{by}, ", by) if by else ("", "")
    on = f"USING ({by})" if by else "ON true"
    keys = f"GROUP BY {g}" if by else ""
    return (
        f"nab AS (SELECT {sel}{a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL), "
        f"sab AS (SELECT {sel}sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM nab {keys}), "
        f"sa AS (SELECT {sel}sum(n * (n - 1) / 2) AS sa FROM (SELECT {sel}a, sum(n) AS n FROM nab GROUP BY ALL) {keys}), "
        f"sb AS (SELECT {sel}sum(n * (n - 1) / 2) AS sb FROM (SELECT {sel}b, sum(n) AS n FROM nab GROUP BY ALL) {keys}), "
        f"j AS (SELECT {sel}s, sa, sb, sa * sb / nullif(n * (n - 1) / 2, 0) AS e FROM sab JOIN sa {on} JOIN sb {on}), "
        f"ari AS (SELECT {sel}coalesce((s - e) / nullif((sa + sb) / 2 - e, 0), 1.0::DOUBLE) AS ari FROM j)"
    )


def nmi_sql(source: str, a: str, b: str, base: str) -> str:
    return (
        f"WITH nab AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL), "
        "t AS (SELECT sum(n) AS t FROM nab), na AS (SELECT a, sum(n) AS na FROM nab GROUP BY 1), nb AS (SELECT b, sum(n) AS nb FROM nab GROUP BY 1), "
        "ha AS (SELECT -sum(na / t * ln(na / t)) AS ha FROM na CROSS JOIN t), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS hb FROM nb CROSS JOIN t), "
        "mi AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM nab JOIN na USING (a) JOIN nb USING (b) CROSS JOIN t) "
        f"SELECT {rs('mi / ' + base)} AS nmi FROM mi CROSS JOIN ha CROSS JOIN hb"
    )


@query("M1_ari", f"WITH {ari_sql('documents', 'source', 'lang')} SELECT {rs('ari')} AS ari FROM ari")
def m1(spark, sf_dir):
    return rounded(M.ari(R.table(spark, sf_dir, "documents"), "source", "lang"), ["ari"])


@query("M1_ari_grouped", f"WITH {ari_sql('customer', 'c_mktsegment', 'cl', 'c_nationkey').replace('FROM customer', 'FROM (SELECT *, c_custkey % 4 AS cl FROM customer)')} SELECT c_nationkey, {rs('ari')} AS ari FROM ari")
def m1b(spark, sf_dir):
    c = R.table(spark, sf_dir, "customer").withColumn("cl", F.col("c_custkey") % 4)
    return rounded(M.ari(c, "c_mktsegment", "cl", ["c_nationkey"]), ["ari"])


@query("M2_nmi_max", nmi_sql("documents", "source", "lang", "greatest(ha, hb)"))
def m2(spark, sf_dir):
    return rounded(M.nmi(R.table(spark, sf_dir, "documents"), "source", "lang"), ["nmi"])


@query("M2_nmi_sqrt", nmi_sql("(SELECT l.quality, d.lang FROM labels l JOIN documents d USING (doc_id))", "quality", "lang", "sqrt(ha * hb)"))
def m2b(spark, sf_dir):
    j = R.table(spark, sf_dir, "labels").join(R.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(M.nmi(j, "quality", "lang", variant="sqrt"), ["nmi"])


_WIDE_SQL = (
    "wide AS (SELECT vec_id AS cell_id, label AS truth, (label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END)::VARCHAR AS seed_1, "
    "(label // 2)::VARCHAR AS seed_2, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE (vec_id % 3)::VARCHAR END AS seed_3 FROM embeddings), "
    "long AS (UNPIVOT wide ON seed_1, seed_2, seed_3 INTO NAME run VALUE label)"
)


def _wide(spark, sf_dir):
    c = R.cells(spark, sf_dir)
    return c.select(
        "cell_id", "pcs",
        F.col("annotation").alias("truth"),
        (F.col("annotation") + F.when(F.col("cell_id") % 5 == 0, 1).otherwise(0)).cast("string").alias("seed_1"),
        F.floor(F.col("annotation") / 2).cast("string").alias("seed_2"),
        F.when(F.col("cell_id") % 11 != 0, (F.col("cell_id") % 3).cast("string")).alias("seed_3"),
    )


_SEEDS = ["seed_1", "seed_2", "seed_3"]


@query("M3_ari_all", f"WITH {_WIDE_SQL}, {ari_sql('long', 'truth', 'label', 'run')} SELECT run, {rs('ari')} AS ari FROM ari")
def m3(spark, sf_dir):
    return rounded(M.ari_all(_wide(spark, sf_dir), "truth", _SEEDS), ["ari"])


_TRUTH_SQL = "truth AS (SELECT DISTINCT user_id AS obs_id, (user_id % 4)::VARCHAR AS truth FROM events)"


def _truth(spark, sf_dir):
    return R.table(spark, sf_dir, "events").select(F.col("user_id").alias("obs_id")).distinct().withColumn(
        "truth", (F.col("obs_id") % 4).cast("string")
    )


def _teams(samples):
    return samples.select("iter", F.col("label").alias("grp")).distinct().withColumn(
        "team", (F.length("grp") + F.col("iter")) % 3
    )


@query(
    "M4_ari_trace",
    f"WITH {R.SAMPLES_SQL}, {_TRUTH_SQL}, lv AS (SELECT iter, 'spatial' AS level, truth, label AS g FROM samples JOIN truth USING (obs_id) "
    "UNION ALL SELECT iter, 'refined', truth, ((length(label) + iter) % 3)::VARCHAR FROM samples JOIN truth USING (obs_id)), "
    + ari_sql("lv", "truth", "g", "iter, level")
    + f" SELECT iter, level, {rs('ari')} AS ari FROM ari",
)
def m4(spark, sf_dir):
    s = R.samples(spark, sf_dir)
    out = M.ari_trace(s.withColumnRenamed("label", "grp"), _teams(s), _truth(spark, sf_dir))
    return rounded(out, ["ari"])


# --------------------------------------------------------------------------- cluster quality

_P = 5
_D2 = " + ".join(f"(a.pcs[{i}] - b.pcs[{i}]) * (a.pcs[{i}] - b.pcs[{i}])" for i in range(1, _P + 1))
_QUALITY = (
    _WIDE_SQL.replace("FROM embeddings)", f"embedding[1:{_P}]::DOUBLE[] AS pcs FROM embeddings)").replace("AS seed_3 embedding", "AS seed_3, embedding")
    + ", cent AS (SELECT run, label, count(*)::DOUBLE AS n, ["
    + ", ".join(f"avg(pcs[{i}])" for i in range(1, _P + 1))
    + "] AS pcs FROM long GROUP BY 1, 2), "
    f"wss AS (SELECT a.run, a.label, sum({_D2}) AS w FROM long a JOIN cent b ON a.run = b.run AND a.label = b.label GROUP BY 1, 2), "
    "st AS (SELECT run, label, n, pcs, w FROM cent JOIN wss USING (run, label)), "
    f"cp AS (SELECT a.run, a.label AS la, b.label AS lb, {_D2} AS d2, sqrt(a.w / a.n) AS sa, sqrt(b.w / b.n) AS sb FROM st a JOIN st b ON a.run = b.run AND a.label <> b.label), "
    "m5 AS (SELECT run, sum(w) / sum(n) AS avg_within FROM st GROUP BY 1), "
    "m6 AS (SELECT run, avg(d2) AS avg_between FROM cp WHERE la < lb GROUP BY 1), "
    "m8 AS (SELECT run, avg(r) AS davies_bouldin FROM (SELECT run, la, max((sa + sb) / sqrt(d2)) AS r FROM cp GROUP BY 1, 2) GROUP BY 1), "
    "gc AS (SELECT run, count(*)::DOUBLE AS n, [" + ", ".join(f"avg(pcs[{i}])" for i in range(1, _P + 1)) + "] AS pcs FROM long GROUP BY 1), "
    f"tss AS (SELECT a.run, sum({_D2}) AS t FROM long a JOIN gc b ON a.run = b.run GROUP BY 1), "
    "m9 AS (SELECT run, ((max(t) - sum(w)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS calinski_harabasz FROM st JOIN tss USING (run) GROUP BY run), "
    f"pd AS (SELECT a.run, a.cell_id AS i, a.label AS own, b.label AS other, sqrt({_D2}) AS d FROM long a JOIN long b ON a.run = b.run AND a.cell_id <> b.cell_id), "
    "sw0 AS (SELECT run, i, own, avg(d) FILTER (WHERE own = other) AS a FROM pd GROUP BY 1, 2, 3), "
    "sw1 AS (SELECT run, i, min(b) AS b FROM (SELECT run, i, other, avg(d) AS b FROM pd WHERE own <> other GROUP BY 1, 2, 3) GROUP BY 1, 2), "
    "sw AS (SELECT run, i, own, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS width FROM sw0 JOIN sw1 USING (run, i)), "
    "m7 AS (SELECT run, avg(width) AS silhouette FROM sw GROUP BY 1), "
    "m10 AS (SELECT run, min(d) FILTER (WHERE own <> other) / max(d) FILTER (WHERE own = other) AS dunn FROM pd GROUP BY 1) "
)


def _long(spark, sf_dir):
    w = _wide(spark, sf_dir)
    return w.select("cell_id", "pcs", *_SEEDS).unpivot(["cell_id", "pcs"], _SEEDS, "method", "cluster")


def _register_quality(name, cte, fn, column):
    @query(name, f"WITH {_QUALITY} SELECT run AS method, {rs(column)} AS {column} FROM {cte}")
    def _q(spark, sf_dir, fn=fn, column=column):
        return rounded(fn(spark, sf_dir), [column])


_register_quality("M5_avg_within", "m5", lambda s, d: M.avg_within(_long(s, d), _P, ["method"]), "avg_within")
_register_quality("M6_avg_between", "m6", lambda s, d: M.avg_between(_long(s, d), _P, ["method"]), "avg_between")
_register_quality("M7_silhouette", "m7", lambda s, d: M.silhouette(_wide(s, d), "cell_id", _P, _SEEDS), "silhouette")
_register_quality("M8_davies_bouldin", "m8", lambda s, d: M.davies_bouldin(_long(s, d), _P, ["method"]), "davies_bouldin")
_register_quality("M9_calinski_harabasz", "m9", lambda s, d: M.calinski_harabasz(_long(s, d), _P, ["method"]), "calinski_harabasz")
_register_quality("M10_dunn", "m10", lambda s, d: M.dunn(_wide(s, d), "cell_id", _P, _SEEDS), "dunn")

_INDICES = ["avg_within", "avg_between", "silhouette", "davies_bouldin", "calinski_harabasz", "dunn"]


@query(
    "M11_evaluate",
    f"WITH {_QUALITY} SELECT run AS method, " + ", ".join(f"{rs(c)} AS {c}" for c in _INDICES)
    + " FROM m5 JOIN m6 USING (run) JOIN m7 USING (run) JOIN m8 USING (run) JOIN m9 USING (run) JOIN m10 USING (run)",
)
def m11(spark, sf_dir):
    return rounded(M.evaluate(_wide(spark, sf_dir), "cell_id", _P, _SEEDS), _INDICES)


@query("M7_silhouette_centroid")
def m7c(spark, sf_dir):
    return M.silhouette_centroid(R.cells(spark, sf_dir).withColumnRenamed("annotation", "cluster"))


@query("U2_map_runs", f"WITH {_WIDE_SQL} SELECT run, count(*) AS n, count(DISTINCT label) AS n_labels FROM long GROUP BY 1")
def u2(spark, sf_dir):
    long = _wide(spark, sf_dir).select(*_SEEDS).unpivot([], _SEEDS, "run", "label").where(F.col("label").isNotNull())
    per = long.groupBy("run", "label").agg(F.count(F.lit(1)).alias("m"))
    return per.groupBy("run").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_labels"))


@query(
    "U3_custom_aggregates",
    "WITH e AS (SELECT event_type, user_id % 10 AS g, count(*) AS n FROM events GROUP BY 1, 2), "
    "m AS (SELECT g, event_type AS mode_label FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, event_type) AS rn FROM e) WHERE rn = 1), "
    "v AS (SELECT user_id % 10 AS g, median(value) AS med FROM events GROUP BY 1), "
    f"d AS (SELECT g, {rs('median(abs(value - med)) * 1.4826::DOUBLE')} AS mad FROM events JOIN v ON user_id % 10 = g GROUP BY 1) SELECT g, mode_label, mad FROM m JOIN d USING (g)",
)
def u3(spark, sf_dir):
    """Mode and median absolute deviation per group, composed from built-in expressions."""
    from cytomesh.operators.core import quantiles, keyed_join, top_k_per_group

    e = R.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("g"), "event_type", "value")
    n = e.groupBy("g", "event_type").agg(F.count(F.lit(1)).alias("n"))
    mode = top_k_per_group(n, ["g"], [F.desc("n"), F.asc("event_type")], 1).select("g", F.col("event_type").alias("mode_label"))
    med = quantiles(e, "value", {"med": 0.5}, ["g"])
    dev = keyed_join(e, med, ["g"]).select("g", F.abs(F.col("value") - F.col("med")).alias("dev"))
    mad = quantiles(dev, "dev", {"mad": 0.5}, ["g"]).select("g", r(F.col("mad") * P.MAD_SCALE, name="mad"))
    return mode.join(mad, "g")


# --------------------------------------------------------------------------- sampled partitions


@query(
    "A14_posterior_mode",
    f"WITH {R.SAMPLES_SQL}, n AS (SELECT obs_id, label, count(*) AS n FROM samples WHERE iter > 5 GROUP BY 1, 2) "
    "SELECT obs_id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY n DESC, label) AS rn FROM n) WHERE rn = 1",
)
def a14(spark, sf_dir):
    return B.posterior_mode(R.samples(spark, sf_dir), 5)


_K_SQL = "kk AS (SELECT iter, count(DISTINCT label) AS k FROM samples GROUP BY 1), mk AS (SELECT k, count(*) AS freq FROM kk GROUP BY 1 ORDER BY freq DESC, k LIMIT 1)"


@query("B1_modal_k", f"WITH {R.SAMPLES_SQL}, {_K_SQL} SELECT k, freq FROM mk")
def b1(spark, sf_dir):
    return B.modal_k(B.cluster_counts(R.samples(spark, sf_dir)))


@query(
    "B2_coassignment",
    f"WITH {R.SAMPLES_SQL}, o AS (SELECT DISTINCT obs_id FROM samples), p AS (SELECT a.obs_id AS src, b.obs_id AS dst FROM o a JOIN o b ON b.obs_id IN (a.obs_id + 1, a.obs_id + 7)) "
    f"SELECT src, dst, {rs('avg(CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0 END)')} AS together FROM p JOIN samples a ON a.obs_id = src JOIN samples b ON b.obs_id = dst AND b.iter = a.iter GROUP BY 1, 2",
)
def b2(spark, sf_dir):
    s = R.samples(spark, sf_dir)
    o = s.select("obs_id").distinct()
    pairs = o.select(F.col("obs_id").alias("src"), F.explode(F.array(F.col("obs_id") + 1, F.col("obs_id") + 7)).alias("dst"))
    pairs = pairs.join(o.withColumnRenamed("obs_id", "dst"), "dst", "left_semi")
    return rounded(B.coassignment(s, pairs), ["together"])


_REP_SQL = (
    "ms AS (SELECT s.* FROM samples s JOIN kk USING (iter) JOIN mk USING (k)), "
    "ct AS (SELECT a.iter AS s, b.iter AS t, a.label AS la, b.label AS lb, count(*)::DOUBLE AS n FROM ms a JOIN ms b USING (obs_id) GROUP BY ALL), "
    "ov AS (SELECT s, t, sum(n * n) AS w FROM ct GROUP BY 1, 2), "
    "sc AS (SELECT t AS iter, max(CASE WHEN s = t THEN w END) - 2 * avg(w) AS score FROM ov GROUP BY 1), "
    "rep AS (SELECT iter, score FROM sc ORDER BY round(score, 6), iter LIMIT 1)"
)


@query("B3_representative_iteration", f"WITH {R.SAMPLES_SQL}, {_K_SQL}, {_REP_SQL} SELECT iter, {rs('score', 4)} AS score FROM rep")
def b3(spark, sf_dir):
    return rounded(B.representative_iteration(R.samples(spark, sf_dir)), ["score"], 4)


@query(
    "B3_partition_overlap",
    f"WITH {R.SAMPLES_SQL}, c AS (SELECT a.iter AS s, b.iter AS t, a.label, b.label, count(*)::DOUBLE AS n FROM samples a JOIN samples b ON a.obs_id = b.obs_id AND a.iter <= b.iter GROUP BY ALL) SELECT s, t, sum(n * n) AS overlap FROM c GROUP BY 1, 2",
)
def b3b(spark, sf_dir):
    return B.partition_overlap(R.samples(spark, sf_dir))


@query("B4_thin", f"WITH {R.SAMPLES_SQL} SELECT ((iter - 4) // 3)::INTEGER AS iter, obs_id, label FROM samples WHERE iter > 4 AND (iter - 4) % 3 = 0")
def b4(spark, sf_dir):
    return B.thin(R.samples(spark, sf_dir), 4, 3)


@query(
    "B5_params_at",
    f"WITH {R.SAMPLES_SQL}, {_K_SQL}, {_REP_SQL}, par AS (SELECT iter, label AS grp, count(*) AS n FROM samples GROUP BY 1, 2) SELECT iter, grp, n FROM par JOIN (SELECT iter FROM rep) USING (iter)",
)
def b5(spark, sf_dir):
    s = R.samples(spark, sf_dir)
    params = s.groupBy("iter", F.col("label").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return B.params_at(params, B.representative_iteration(s))


def _ppc_inputs(spark, sf_dir, p=3):
    """Chain over the cells: iteration t labels a cell by annotation, shifted for some cells."""
    c = R.cells(spark, sf_dir, p)
    iters = F.explode(F.sequence(F.lit(1), F.lit(40))).alias("iter")
    s = c.select("cell_id", "pcs", "annotation", iters).select(
        F.col("iter").cast("int").alias("iter"), F.col("cell_id").alias("obs_id"), "pcs",
        F.when(F.pmod(F.xxhash64("cell_id", "iter"), F.lit(10)) == 0, (F.col("annotation") + 1) % 10).otherwise(F.col("annotation")).alias("grp"),
    )
    teams = P.centroids(s, ["iter", "grp"], p).select("iter", "grp", F.col("mean").alias("mu"))
    cov = P.cov_matrix(s, p, ["iter"])
    flat = S.flat_cov(cov.withColumnRenamed("iter", "shard_id"), p).withColumnRenamed("shard_id", "iter")
    return s, teams, flat, c


@query("B6_ppc_means")
def b6(spark, sf_dir):
    s, teams, covs, c = _ppc_inputs(spark, sf_dir)
    return B.ppc_means(s, teams, covs, c, 3)


@query("B6_replicate_data")
def b6b(spark, sf_dir):
    s, teams, covs, _ = _ppc_inputs(spark, sf_dir)
    return B.replicate_data(s, teams, covs, 3)


def _settings(spark, sf_dir):
    """The chain under three settings: as it is, rare labels merged, and a two-way split."""
    s = R.samples(spark, sf_dir)
    return (
        s.withColumn("setting", F.lit("full"))
        .unionByName(s.withColumns({"setting": F.lit("merged"), "label": F.when(F.col("label") == "error", "none").otherwise(F.col("label"))}))
        .unionByName(s.withColumns({"setting": F.lit("split"), "label": F.when(F.col("label") == "none", "none").otherwise("any")}))
    )


def _setting_sql():
    k = (
        "st AS (SELECT 'full' AS setting, * FROM samples UNION ALL SELECT 'merged', iter, obs_id, CASE WHEN label = 'error' THEN 'none' ELSE label END FROM samples "
        "UNION ALL SELECT 'split', iter, obs_id, CASE WHEN label = 'none' THEN 'none' ELSE 'any' END FROM samples), "
        "kk AS (SELECT setting, iter, count(DISTINCT label) AS k FROM st GROUP BY 1, 2), kf AS (SELECT setting, k, count(*) AS freq FROM kk GROUP BY 1, 2), "
        "mk AS (SELECT * FROM kf QUALIFY row_number() OVER (PARTITION BY setting ORDER BY freq DESC, k) = 1), "
        "tot AS (SELECT setting, count(*) AS n FROM kk GROUP BY 1), "
        "ms AS (SELECT st.* FROM st JOIN kk USING (setting, iter) JOIN mk USING (setting, k)), "
        "ct AS (SELECT a.setting, a.iter AS s, b.iter AS t, a.label AS la, b.label AS lb, count(*)::DOUBLE AS n FROM ms a JOIN ms b ON a.setting = b.setting AND a.obs_id = b.obs_id GROUP BY ALL), "
        "ov AS (SELECT setting, s, t, sum(n * n) AS w FROM ct GROUP BY 1, 2, 3), "
        "sc AS (SELECT setting, t AS iter, max(CASE WHEN s = t THEN w END) - 2 * avg(w) AS score FROM ov GROUP BY 1, 2), "
        "rep AS (SELECT setting, iter FROM sc QUALIFY row_number() OVER (PARTITION BY setting ORDER BY round(score, 6), iter) = 1), "
        "lab AS (SELECT setting, truth, label FROM st JOIN rep USING (setting, iter) JOIN truth USING (obs_id)), "
    )
    return (
        f"WITH {R.SAMPLES_SQL}, {_TRUTH_SQL}, {k}{ari_sql('lab', 'truth', 'label', 'setting')} "
        f"SELECT setting, k, {rs('freq / tot.n')} AS k_share, iter AS rep_iter, {rs('ari')} AS ari FROM mk JOIN tot USING (setting) JOIN rep USING (setting) JOIN ari USING (setting)"
    )


@query("B7_sensitivity_summary", _setting_sql())
def b7(spark, sf_dir):
    out = B.sensitivity_summary(_settings(spark, sf_dir), _truth(spark, sf_dir))
    return rounded(out, ["k_share", "ari"])


_REPL_SQL = (
    "runs AS (SELECT 'm' || (iter % 3) AS method, 's' || lpad(iter::VARCHAR, 2, '0') AS run, label, truth FROM samples JOIN truth USING (obs_id)), "
)


@query(
    "B8_replicate_summary",
    f"WITH {R.SAMPLES_SQL}, {_TRUTH_SQL}, {_REPL_SQL}{ari_sql('runs', 'truth', 'label', 'method, run')}, "
    f"sc AS (SELECT method, run, {rs('ari', 9)} AS score FROM ari), "
    "kk AS (SELECT method, run, count(DISTINCT label) AS k FROM runs GROUP BY 1, 2), kf AS (SELECT method, k, count(*) AS f FROM kk GROUP BY 1, 2), "
    "mk AS (SELECT method, k AS modal_k FROM kf QUALIFY row_number() OVER (PARTITION BY method ORDER BY f DESC, k) = 1), "
    "br AS (SELECT method, score AS best_score, run AS best_run FROM sc QUALIFY row_number() OVER (PARTITION BY method ORDER BY score DESC, run) = 1) "
    f"SELECT method, count(*) AS n_runs, count(score) AS n_success, {rs('avg(score)')} AS mean, {rs('stddev_samp(score)')} AS sd, {rs('stddev_samp(score) / sqrt(count(score))')} AS se, "
    f"min(score) AS min, {rs('quantile_cont(score, 0.25)')} AS q1, {rs('median(score)')} AS median, {rs('quantile_cont(score, 0.75)')} AS q3, max(score) AS max, "
    "max(best_score) AS best_score, max(best_run) AS best_run, max(modal_k) AS modal_k FROM sc JOIN mk USING (method) JOIN br USING (method) GROUP BY 1",
)
def b8(spark, sf_dir):
    runs = R.samples(spark, sf_dir).join(_truth(spark, sf_dir), "obs_id").select(
        F.concat(F.lit("m"), F.col("iter") % 3).alias("method"),
        F.concat(F.lit("s"), F.lpad(F.col("iter").cast("string"), 2, "0")).alias("run"),
        "label", "truth",
    )
    scores = M.ari(runs, "truth", "label", ["method", "run"]).select("method", "run", r("ari", 9, name="score"))
    counts = runs.select("method", "run", "label").distinct().groupBy("method", "run").agg(F.count(F.lit(1)).alias("k"))
    return rounded(B.replicate_summary(scores, counts), ["mean", "sd", "se", "q1", "median", "q3"])


# --------------------------------------------------------------------------- shards and alignment

_SP, _REF, _NS = 3, 1, 4


def _sharded(spark, sf_dir):
    c = R.cells(spark, sf_dir, _SP)
    return c.select("cell_id", "x", "y", "pcs", "annotation", (F.col("cell_id") % _NS).alias("shard_id"), F.col("annotation").alias("cluster"))


_SH_SQL = f"{R.cells_sql(_SP)}, sh AS (SELECT cell_id, x, y, pcs, annotation, cell_id % {_NS} AS shard_id, annotation AS cluster FROM cells)"
_SUM_SQL = (
    _SH_SQL + ", summ AS (SELECT shard_id, cluster, count(*) AS n_obs, (sum(count(*)) OVER (PARTITION BY shard_id))::BIGINT AS total_n, "
    "avg(pcs[1]) AS m0, avg(pcs[2]) AS m1, avg(pcs[3]) AS m2 FROM sh GROUP BY 1, 2)"
)


@query("H1_assign_shards")
def h1(spark, sf_dir):
    return S.assign_shards(R.points(spark, sf_dir), 7, key="id").select("id", "shard_id")


@query("H2_sample_n")
def h2(spark, sf_dir):
    return S.sample_n(R.points(spark, sf_dir), 2000, key="id")


@query(
    "H4_zscore_by_shard",
    f"WITH {_SH_SQL} SELECT cell_id, shard_id, {rs('(x - avg(x) OVER w) / stddev_samp(x) OVER w')} AS x, {rs('(y - avg(y) OVER w) / stddev_samp(y) OVER w')} AS y FROM sh WINDOW w AS (PARTITION BY shard_id)",
)
def h4(spark, sf_dir):
    sh = _sharded(spark, sf_dir).select("cell_id", "shard_id", "x", "y")
    return rounded(P.zscore(sh, ["x", "y"], ["shard_id"]), ["x", "y"])


@query(
    "H5_shard_summary",
    f"WITH {_SUM_SQL} SELECT shard_id, cluster, n_obs, total_n, {rs('n_obs / total_n')} AS prop, {rs('m0')} AS m0, {rs('m1')} AS m1, {rs('m2')} AS m2 FROM summ",
)
def h5(spark, sf_dir):
    summary, _ = S.shard_summary(_sharded(spark, sf_dir), _SP)
    return summary.select("shard_id", "cluster", "n_obs", "total_n", r("prop"), *[r(F.col("mean")[i], name=f"m{i}") for i in range(_SP)])


@query(
    "H5_shard_cov",
    f"WITH {_SH_SQL}, d AS (SELECT unnest([0, 1, 2])::INTEGER AS i) SELECT shard_id, a.i AS i, b.i AS j, {rs('covar_samp(pcs[a.i + 1], pcs[b.i + 1])', 8)} AS v FROM sh CROSS JOIN d a CROSS JOIN d b GROUP BY 1, 2, 3",
)
def h5b(spark, sf_dir):
    _, cov = S.shard_summary(_sharded(spark, sf_dir), _SP)
    return rounded(cov, ["v"], 8)


_H6_SQL = f"WITH {_SH_SQL.replace('annotation AS cluster', '(annotation + cell_id % 3) % 7 AS cluster')}, {ari_sql('sh', 'annotation', 'cluster', 'shard_id')}"


def _h6_cells(spark, sf_dir):
    return _sharded(spark, sf_dir).withColumn("cluster", (F.col("annotation") + F.col("cell_id") % 3) % 7)


@query("H6_shard_scores", _H6_SQL + f" SELECT shard_id, {rs('ari')} AS ari FROM ari")
def h6(spark, sf_dir):
    return rounded(S.shard_scores(_h6_cells(spark, sf_dir), "annotation", "cluster")[0], ["ari"])


@query(
    "H6_shard_score_summary",
    _H6_SQL + f" SELECT count(*) AS n_shards, {rs('avg(ari)')} AS mean_ari, {rs('median(ari)')} AS median_ari, {rs('min(ari)')} AS min_ari, {rs('max(ari)')} AS max_ari FROM ari",
)
def h6b(spark, sf_dir):
    return rounded(S.shard_scores(_h6_cells(spark, sf_dir), "annotation", "cluster")[1], ["mean_ari", "median_ari", "min_ari", "max_ari"])


# With one component the covariance term is (s1 - s2)^2, which plain SQL can state; the 3-component form is
# covered by fixtures with known answers.
_SH1_SQL = (
    f"{R.cells_sql(1)}, sh AS (SELECT cell_id, x, y, pcs[1] AS v, annotation, cell_id % {_NS} AS shard_id, annotation AS cluster FROM cells), "
    "summ AS (SELECT shard_id, cluster, count(*) AS n_obs, avg(v) AS m FROM sh GROUP BY 1, 2), sc AS (SELECT shard_id, stddev_samp(v) AS s FROM sh GROUP BY 1), "
    f"rf AS (SELECT cluster AS ref_cluster, m AS rm, s AS rs FROM summ JOIN sc USING (shard_id) WHERE shard_id = {_REF}), "
    "cost AS (SELECT shard_id, cluster, n_obs, m, ref_cluster, sqrt((m - rm) * (m - rm) + (s - rs) * (s - rs)) AS cost FROM summ JOIN sc USING (shard_id) CROSS JOIN rf), "
    "e AS (SELECT *, exp(-(cost - min(cost) OVER (PARTITION BY shard_id, cluster)) / 1.0) AS e FROM cost), "
    "soft AS (SELECT shard_id, cluster, n_obs, m, ref_cluster, cost, e / sum(e) OVER (PARTITION BY shard_id, cluster) AS p FROM e), "
    "hard AS (SELECT * FROM soft QUALIFY row_number() OVER (PARTITION BY shard_id, cluster ORDER BY p DESC, ref_cluster) = 1)"
)


def _sharded1(spark, sf_dir):
    return _sharded(spark, sf_dir).withColumn("pcs", F.slice("pcs", 1, 1))


@query("L2_cost_matrix", f"WITH {_SH1_SQL} SELECT shard_id, cluster, n_obs, ref_cluster, {rs('cost')} AS cost FROM cost")
def l2(spark, sf_dir):
    summary, cov = S.shard_summary(_sharded1(spark, sf_dir), 1)
    return rounded(S.cost_matrix(summary, cov, _REF, 1), ["cost"])


@query("L1_gaussian_w2")
def l1(spark, sf_dir):
    """All clusters of all shards against their own shard 1 twin, three components."""
    summary, cov = S.shard_summary(_sharded(spark, sf_dir), _SP)
    full = summary.join(S.flat_cov(cov, _SP), "shard_id")
    ref = full.where(F.col("shard_id") == _REF).select("cluster", F.col("mean").alias("mean2"), F.col("cov").alias("cov2"))
    pairs = full.select("shard_id", "cluster", F.col("mean").alias("mean1"), F.col("cov").alias("cov1")).join(ref, "cluster")
    return S.gaussian_w2(pairs, _SP).select("shard_id", "cluster", "w2")


@query("L3_soft_assign", f"WITH {_SH1_SQL} SELECT shard_id, cluster, ref_cluster, {rs('p')} AS p FROM soft")
def l3(spark, sf_dir):
    summary, cov = S.shard_summary(_sharded1(spark, sf_dir), 1)
    return rounded(S.soft_assign(S.cost_matrix(summary, cov, _REF, 1)), ["p"]).select("shard_id", "cluster", "ref_cluster", "p")


@query("L4_hard_assign", f"WITH {_SH1_SQL} SELECT shard_id, cluster, ref_cluster FROM hard")
def l4(spark, sf_dir):
    return S.align(_sharded1(spark, sf_dir), _REF, 1)["hard"].select("shard_id", "cluster", "ref_cluster")


@query("L5_confidence", f"WITH {_SH1_SQL} SELECT {rs('avg(p)')} AS confidence FROM hard")
def l5(spark, sf_dir):
    return rounded(S.confidence(S.align(_sharded1(spark, sf_dir), _REF, 1)["soft"]), ["confidence"])


@query(
    "L6_global_params",
    f"WITH {_SH1_SQL}, g AS (SELECT ref_cluster, sum(n_obs) AS w, sum(n_obs * m) / sum(n_obs) AS m FROM hard GROUP BY 1) "
    f"SELECT ref_cluster, coalesce(w, 0)::BIGINT AS n_obs, {rs('coalesce(w, 0) / sum(coalesce(w, 0)) OVER ()')} AS weight, {rs('coalesce(m, rm)')} AS m0 FROM rf LEFT JOIN g USING (ref_cluster)",
)
def l6(spark, sf_dir):
    g = S.align(_sharded1(spark, sf_dir), _REF, 1)["params"]
    return g.select("ref_cluster", "n_obs", r("weight"), r(F.col("mean")[0], name="m0"))


@query("L7_select_reference_shard")
def l7(spark, sf_dir):
    c = _sharded(spark, sf_dir).withColumn("shard_id", F.col("cell_id") % 9)
    return S.select_reference_shard(S.shard_summary(c, _SP)[0], _SP)


@query("L8_final_assignments", f"WITH {_SH1_SQL} SELECT cell_id, sh.shard_id, x, y, sh.cluster, annotation, ref_cluster AS metacluster FROM sh LEFT JOIN hard h ON h.shard_id = sh.shard_id AND h.cluster = sh.cluster")
def l8(spark, sf_dir):
    """Shards -> summaries -> alignment -> metacluster of every cell."""
    sh = _sharded1(spark, sf_dir)
    out = S.final_assignments(sh, S.align(sh, _REF, 1)["hard"])
    return out.select("cell_id", "shard_id", "x", "y", "cluster", "annotation", "metacluster")


@query(
    "E4_files_to_metaclusters",
    f"WITH {_SH1_SQL} SELECT cell_id, sh.shard_id, x, y, sh.cluster, annotation, ref_cluster AS metacluster FROM sh LEFT JOIN hard h ON h.shard_id = sh.shard_id AND h.cluster = sh.cluster AND h.shard_id <> 2",
)
def e4(spark, sf_dir):
    """Shards -> summary files -> read back, without the shard that has no covariance -> alignment -> metacluster of every cell."""
    sh, path = _sharded1(spark, sf_dir), scratch(spark)
    summary, cov = S.shard_summary(sh, 1)
    writers.write_shard_summaries(summary, cov.where("shard_id <> 2"), path, 1)
    known, spread = readers.read_shard_summaries(spark, path, 1)
    out = S.final_assignments(sh, S.align_summaries(known, spread, _REF, 1)["hard"])
    return out.select("cell_id", "shard_id", "x", "y", "cluster", "annotation", "metacluster")


@query(
    "L8_final_agreement",
    f"WITH {_SH1_SQL}, fin AS (SELECT annotation, ref_cluster FROM sh LEFT JOIN hard h ON h.shard_id = sh.shard_id AND h.cluster = sh.cluster), {ari_sql('fin', 'annotation', 'ref_cluster')} SELECT {rs('ari')} AS ari FROM ari",
)
def l8b(spark, sf_dir):
    sh = _sharded1(spark, sf_dir)
    return rounded(M.ari(S.final_assignments(sh, S.align(sh, _REF, 1)["hard"]), "annotation", "metacluster"), ["ari"])


@query(
    "L7_reference_shard_of_one_component",
    "WITH sized AS (SELECT (vec_id % 40)::BIGINT AS shard_id, label, count(*)::DOUBLE AS n, avg(embedding[1]::DOUBLE) AS m FROM embeddings GROUP BY 1, 2), "
    "cum AS (SELECT shard_id, m, sum(n) OVER w / sum(n) OVER (PARTITION BY shard_id) AS hi, (sum(n) OVER w - n) / sum(n) OVER (PARTITION BY shard_id) AS lo FROM sized WINDOW w AS (PARTITION BY shard_id ORDER BY m, label)), "
    "pairs AS (SELECT a.shard_id, b.shard_id AS other, sum(greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) * (a.m - b.m) * (a.m - b.m)) AS cost FROM cum a CROSS JOIN cum b GROUP BY 1, 2), "
    f"mean AS (SELECT shard_id, avg(cost) AS c FROM pairs GROUP BY 1) SELECT shard_id, {rs('c', 9)} AS avg_cost FROM mean ORDER BY round(c, 12), shard_id LIMIT 1",
)
def l7b(spark, sf_dir):
    """In one dimension transport has a closed form: equal shares of sorted clusters meet."""
    c = R.cells(spark, sf_dir, 1)
    summary, _ = S.shard_summary(c.select("pcs", (F.col("cell_id") % 40).alias("shard_id"), F.col("annotation").alias("cluster")), 1)
    return rounded(S.select_reference_shard(summary, 1), ["avg_cost"], 9)


@query("L9_kmeans_by_shard")
def l9(spark, sf_dir):
    return S.kmeans_by_shard(_sharded(spark, sf_dir), 5, _SP)


@query("E1_sharded_metaclusters")
def e1(spark, sf_dir):
    """Random shards, k-means in each, reference shard by transport cost, alignment, agreement with the annotation."""
    from cytomesh.operators.core import cut_lineage

    c = S.assign_shards(R.cells(spark, sf_dir, _SP), 6)
    local = S.kmeans_by_shard(c, 6, _SP)
    cells = cut_lineage(c.join(local, ["shard_id", "cell_id"]))
    ref = S.select_reference_shard(S.shard_summary(cells, _SP)[0], _SP).first()["shard_id"]
    out = S.final_assignments(cells, S.align(cells, ref, _SP)["hard"])
    return M.ari(out, "annotation", "metacluster", ["shard_id"])


@query(
    "U1_map_shards",
    f"WITH {_SH_SQL} SELECT shard_id, count(*) AS n, {rs('max(x) - min(x)')} AS x_range FROM sh GROUP BY 1",
)
def u1(spark, sf_dir):
    import pandas as pd

    def describe(pdf):
        return pd.DataFrame({"shard_id": [pdf["shard_id"].iloc[0]], "n": [len(pdf)], "x_range": [pdf["x"].max() - pdf["x"].min()]})

    sh = _sharded(spark, sf_dir).select("shard_id", "x")
    return rounded(S.map_shards(sh, describe, "shard_id long, n long, x_range double"), ["x_range"])


@query(
    "G25_feature_knn",
    f"WITH {R.cells_sql()}, d AS (SELECT a.cell_id AS src, b.cell_id AS dst, sqrt("
    + " + ".join(f"(a.pcs[{i}] - b.pcs[{i}]) * (a.pcs[{i}] - b.pcs[{i}])" for i in range(1, 11))
    + ") AS d FROM cells a JOIN cells b ON a.cell_id <> b.cell_id) "
    f"SELECT src, dst, {rs('d')} AS d, rk::INTEGER AS rk FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rk FROM d) WHERE rk <= 5",
)
def g25(spark, sf_dir):
    return rounded(M.feature_knn(R.cells(spark, sf_dir), "cell_id", 10, 5), ["d"])


@query("G25_feature_knn_lsh")
def g25b(spark, sf_dir):
    """Neighbours from random projections; tests measure the share of the exact ones that they find."""
    return L.feature_knn_lsh(R.cells(spark, sf_dir), "cell_id", 10, 5)
