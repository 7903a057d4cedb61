"""Components, many starts at once, feature neighbours, posterior checks and variable genes against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytomesh.operators import cluster, lsh, metrics, principal, shards, starts


def svd_scores(x, k):
    keep = x.std(0, ddof=1) > 0
    z = (x[:, keep] - x[:, keep].mean(0)) / x[:, keep].std(0, ddof=1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    v = vt[:k].T
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return z @ v, s[:k] ** 2 / (len(x) - 1)


def test_dense_components(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5]) + 1e6
    x[:, 1] += x[:, 0]
    x = np.concatenate([x, np.full((200, 1), 3.0)], axis=1)  # a column without variance
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None), (901, [None] * 7)], "cell_id int, features array<double>").repartition(3)
    got = {r.cell_id: r.pcs for r in cluster.pca(df, 4).collect()}
    want, _ = svd_scores(x, 4)
    assert got[900] is None and got[901] is None
    assert np.allclose(np.array([got[i] for i in range(200)]), want, atol=1e-5)
    assert len(cluster.pca(df, 40).where("cell_id = 3").first()["pcs"]) == 6


@pytest.mark.parametrize("cells, genes", [(300, 90), (30, 120)])
def test_sparse_components(spark, cells, genes):
    rng = np.random.default_rng(cells)
    x = rng.poisson(0.4, (cells, genes)).astype(float) * rng.uniform(0.5, 2, genes)
    x[:, :20] += np.outer(rng.exponential(2, cells), rng.uniform(1, 2, 20)) * (rng.random((cells, 20)) < 0.8)
    x[:, 5] = 0  # a gene without counts
    x[0] = 0  # a cell without counts
    values = [(int(i), f"g{j:03d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    df = spark.createDataFrame([*values, (99_999, "g001", 5.0), (1, "other", 7.0)], "cell_id long, gene_id string, value double").repartition(3)
    chosen = spark.createDataFrame([(f"g{j:03d}",) for j in range(genes)], "gene_id string")
    rows = principal.SparseRows(df, spark.range(cells).withColumnRenamed("id", "cell_id"), chosen)
    k = 8
    variances, load = rows.components(k)
    want, values = svd_scores(x, k)
    assert np.allclose(variances, values, rtol=1e-9) and np.allclose(load.T @ load, np.eye(k), atol=1e-9)
    got = {r.cell_id: r.pcs for r in rows.scores(load).collect()}
    assert len(got) == cells and np.allclose(np.array([got[i] for i in range(cells)]), want, atol=1e-4)


def test_components_of_many_genes(spark):
    """The production sizes: 2,000 genes, 15 components."""
    rng = np.random.default_rng(8)
    x = rng.poisson(np.outer(rng.gamma(2, 1, 400), rng.gamma(0.5, 1, 2000))).astype(float)
    i, j = np.nonzero(x)
    df = spark.createDataFrame(pd.DataFrame({"cell_id": i, "gene_id": j, "value": np.log1p(x[i, j])}))
    cells, genes = spark.range(400).withColumnRenamed("id", "cell_id"), spark.range(2000).withColumnRenamed("id", "gene_id")
    got = cluster.pca_counts(df, cells, genes, 15).toPandas().sort_values("cell_id")
    scores = np.stack(got["pcs"])
    want, values = svd_scores(np.log1p(x), 15)
    assert np.allclose(scores.var(0, ddof=1), values, rtol=1e-6)
    cov = np.cov(scores.T)
    assert np.abs(cov - np.diag(np.diag(cov))).max() < 1e-5 * values[0]


# --------------------------------------------------------------------------- many starts


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(6)
    centres = rng.uniform(-30, 30, (6, 3))
    v = np.concatenate([c + rng.standard_normal((n, 3)) * [1, 2, 0.5] for c, n in zip(centres, (400, 60, 30, 90, 20, 50))])
    df = pd.DataFrame({"cell_id": np.arange(len(v)), "pcs": v.tolist(), "truth": np.repeat(np.arange(6), (400, 60, 30, 90, 20, 50))})
    return v, spark.createDataFrame(df).repartition(3).cache()


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_every_start_ends_at_a_fixed_point(clouds, monkeypatch, local):
    monkeypatch.setattr(starts, "BLOCK_ROWS", 64)
    monkeypatch.setattr(starts, "LOCAL_NUMBERS", local)
    x, df = clouds
    packed = starts.blocks(df, "cell_id", 3)
    assert packed.agg(F.max(F.size("keys"))).first()[0] < 130
    runs = [starts.Run(i, k, p, i) for i, (k, p) in enumerate([(6, 3), (6, 3), (3, 2), (1, 3), (2, 1)])]
    for r in starts.lloyd(packed, runs, 3, 500).collect():
        c = np.array(r.params).reshape(-1, r.p)
        d = ((x[:, None, : r.p] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        assert len(c) == r.k and r.total == pytest.approx(d.min(1).sum()) and not r.active
        assert np.allclose([x[own == j, : r.p].mean(0) for j in range(r.k)], c)


def test_the_best_of_many_starts(clouds):
    x, df = clouds
    found = cluster.kmeans(df, 6, 3, seeds=range(1, 9)).join(df, "cell_id").select("truth", "cluster").distinct()
    assert found.count() == 6 and {r.cluster for r in found.collect()} == set(range(1, 7))
    agree = {(r.k, r.p): r.ari for r in cluster.sweep(df, [2, 6], [1, 3], "truth", seeds=range(1, 6)).collect()}
    assert set(agree) == {(2, 1), (2, 3), (6, 1), (6, 3)} and agree[6, 3] == pytest.approx(1.0) and agree[2, 3] < 0.9


def test_mixtures_climb_to_a_maximum(clouds):
    x, df = clouds
    packed = starts.blocks(df, "cell_id", 3)
    state = starts.mixtures(packed, [starts.Run(0, 6, 3, 1), starts.Run(1, 2, 2, 5)], 3, 200).collect()
    for r in state:
        logs = starts._log_density(x[:, : r.p], r.params, r.p)
        assert r.total == pytest.approx(np.logaddexp.reduce(logs, axis=1).sum())
        # one more step hardly helps
        share = np.exp(logs - np.logaddexp.reduce(logs, axis=1)[:, None])
        again = []
        for j in range(share.shape[1]):
            m = share[:, j] @ x[:, : r.p] / share[:, j].sum()
            c = ((x[:, : r.p] - m) * share[:, [j]]).T @ (x[:, : r.p] - m) / share[:, j].sum() + starts.FLOOR * np.eye(r.p)
            again.append(np.concatenate([[share[:, j].mean()], m, c.ravel()]))
        more = np.logaddexp.reduce(starts._log_density(x[:, : r.p], np.concatenate(again), r.p), axis=1).sum()
        assert 0 <= more - r.total + 1e-6 <= 2 * starts.FLAT * len(x)
    best = {r.k: r.best for r in cluster.select_k(df, [2, 6, 9], 3, seeds=(1, 2, 3)).collect()}
    assert best == {2: False, 6: True, 9: False}


def test_fewer_rows_than_clusters(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0]), (3, [5.0, 5.0]), (4, None), (5, [None, 1.0])], "cell_id int, pcs array<double>")
    got = {r.cell_id: r.cluster for r in cluster.kmeans(df, 4, 2, seeds=(1, 2)).collect()}
    assert set(got) == {1, 2, 3} and got[2] == got[3] != got[1]


def test_shards_keep_their_best_start(clouds):
    x, df = clouds
    own = df.withColumn("shard_id", F.when(F.col("cell_id") % 3 == 0, None).otherwise(F.col("cell_id") % 3))  # a hot and a NULL shard are shards
    got = shards.kmeans_by_shard(own, 6, 3, seeds=range(1, 7)).collect()
    assert len(got) == len(x) and {r.shard_id for r in got} == {None, 1, 2}
    label = {r.cell_id: r.cluster for r in got}
    for rest in range(3):
        ids = [i for i in label if i % 3 == rest]
        pairs = {(int(np.searchsorted(np.cumsum((400, 60, 30, 90, 20, 50)), i, "right")), label[i]) for i in ids}
        assert len(pairs) == 6


# --------------------------------------------------------------------------- neighbours in feature space


@pytest.mark.parametrize("kind", ["clouds", "even"])
def test_recall_of_hashed_neighbours(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    n, k = 4000, 8
    x = rng.standard_normal((n, 10))
    if kind == "clouds":
        x = x * 0.3 + rng.standard_normal((40, 10))[rng.integers(0, 40, n)]
        x[:1300] = x[0]  # a third of the rows are equal
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "pcs": x.tolist()})).repartition(4)
    seen = []
    real = lsh.pairwise_distance
    monkeypatch.setattr(lsh, "pairwise_distance", lambda a, b: (seen.append(len(a) * len(b)), real(a, b))[1])
    got = lsh.feature_knn_lsh(df, "id", 10, k, bucket=128).toPandas()
    exact = np.sqrt(np.maximum(((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T), 0))
    np.fill_diagonal(exact, np.inf)
    limit = np.sort(exact, axis=1)[:, k - 1]
    assert np.allclose(got["d"], [exact[a, b] for a, b in zip(got["src"], got["dst"])], atol=1e-6) and (got["src"] != got["dst"]).all()
    assert (got.groupby("src").size() == k).mean() > 0.999 and not got.duplicated(["src", "dst"]).any()
    good = (got["d"].to_numpy() <= limit[got["src"]] + 1e-6).sum() / (n * k)
    assert good >= 0.9, good


def test_few_rows_have_exact_neighbours(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "pcs": rng.standard_normal((90, 5)).round(1).tolist()}))
    key = lambda d: sorted((r.src, r.dst, round(r.d, 9), r.rk) for r in d.collect())
    assert key(lsh.feature_knn_lsh(df, "id", 5, 4)) == key(metrics.feature_knn(df, "id", 5, 4))


# --------------------------------------------------------------------------- variable genes


def plain_hvg(mean, var, n, span=0.3, anchors=33):
    x, y = np.log10(mean + 1), np.log10(var + 1)
    q = [i / (anchors - 1) for i in range(anchors)]
    lo = [min(max(a - span / 2, 0.0), 1 - span) for a in q]
    at, fit = [], []
    for a, b in zip(q, lo):
        c, left, right = np.quantile(x, [a, b, b + span])
        w = max(c - left, right - c, 1e-9) * (1 + 1e-9)
        u = (x - c) / w
        t = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0)
        design = np.stack([np.ones_like(u), u, u * u], axis=1)
        f = np.linalg.lstsq(design.T @ (design * t[:, None]), design.T @ (t * y), rcond=None)[0][0]
        if not at or c > at[-1]:
            at.append(c)
            fit.append(f)
    residual = y - np.interp(x, at, fit)
    order = sorted(range(len(x)), key=lambda i: (-residual[i], i))
    return residual, set(order[:n])


def test_variable_genes(spark):
    rng = np.random.default_rng(9)
    mean = rng.gamma(1.0, 2.0, 400) + 0.02
    var = mean * rng.uniform(0.8, 1.3, 400) + 0.1 * mean**2
    var[:25] *= 6
    df = spark.createDataFrame(pd.DataFrame({"gene_id": np.arange(400), "mean": mean, "variance": var})).unionByName(
        spark.createDataFrame([(1000, 0.001, 5.0)], "gene_id long, mean double, variance double")
    )
    got = cluster.select_hvg(df, 30).toPandas().set_index("gene_id")
    residual, top = plain_hvg(mean, var, 30)
    assert 1000 not in got.index and np.allclose(got["residual"].sort_index(), residual, atol=1e-6)
    assert set(got.index[got["highly_variable"]]) == top and len(top & set(range(25))) > 20
