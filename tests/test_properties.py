"""Operators whose results depend on seeds or starts: what must hold for any of them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytomesh.operators import cluster, graph, neighbors, shards


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(6)
    centres = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0], [0, 0, 20.0]])
    v = np.concatenate([c + rng.standard_normal((60, 3)) for c in centres])
    df = pd.DataFrame({"cell_id": np.arange(len(v)), "pcs": v.tolist(), "truth": np.repeat(np.arange(4), 60)})
    return spark.createDataFrame(df).repartition(2).cache()


def same_partition(rows):
    pairs = {(r.truth, r.cluster) for r in rows}
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_kmeans_and_mixture_find_separate_groups(blobs):
    for found in (cluster.kmeans(blobs, 4, 3, seeds=(1, 2, 3)), cluster.gmm(blobs, 4, 3, seeds=(1, 2, 3))):
        assert same_partition(found.join(blobs, "cell_id").collect())


def test_number_of_clusters_by_bic(blobs):
    rows = {r.k: r for r in cluster.select_k(blobs, [2, 4], 3, seeds=(1, 2, 3)).collect()}
    assert rows[4].best and not rows[2].best and rows[4].log_likelihood > rows[2].log_likelihood


def test_kmeans_by_shard_ends_at_a_fixed_point(blobs):
    own = blobs.withColumn("shard_id", F.col("cell_id") % 2)
    got = shards.kmeans_by_shard(own, 4, 3).join(own, ["shard_id", "cell_id"]).toPandas()
    for _, g in got.groupby("shard_id"):
        x = np.stack(g["pcs"])
        centres = {c: x[(g["cluster"] == c).to_numpy()].mean(0) for c in g["cluster"].unique()}
        near = [min(centres, key=lambda c: ((p - centres[c]) ** 2).sum()) for p in x]
        assert near == g["cluster"].tolist()


def test_components_are_orthogonal_and_keep_the_variance(blobs):
    out = cluster.pca(blobs.withColumnRenamed("pcs", "features"), 3).toPandas()
    vectors = [c for c in out.columns if isinstance(out[c].iloc[0], (list, np.ndarray))]
    x = np.stack(out[vectors[0]]) if vectors else out[[c for c in out.columns if c.upper().startswith("PC")]].to_numpy()
    cov = np.cov(x.T)
    assert np.abs(cov - np.diag(np.diag(cov))).max() < 1e-6 and (np.diff(np.diag(cov)) <= 1e-9).all()


def test_shards_and_samples(spark):
    cells = spark.range(1000).withColumnRenamed("id", "cell_id")
    sizes = [r["count"] for r in shards.assign_shards(cells, 7).groupBy("shard_id").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1 and sum(sizes) == 1000
    one, two = (shards.sample_n(cells, 100, key="cell_id", seed=3).collect() for _ in range(2))
    assert len({r.cell_id for r in one}) == 100 and sorted(one) == sorted(two)


def test_random_tree_spans_and_prefers_labels(spark):
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame(pd.DataFrame({"id": np.arange(80), "x": rng.uniform(0, 1, 80), "y": rng.uniform(0, 1, 80), "label": np.arange(80) % 2}))
    edges = neighbors.with_eid(neighbors.radius_graph(pts, 0.35).withColumnRenamed("d", "w"))
    tree = graph.random_mst(edges, pts, seed=5)
    parts = graph.connected_components(edges, pts).select("component").distinct().count()
    assert tree.count() == 80 - parts
    assert graph.connected_components(tree, pts).select("component").distinct().count() == parts
    same = graph.spatial_components(edges, pts).select("component").distinct().count()
    between = neighbors.edge_status(tree.select("src", "dst"), pts).where("status = 'b'").count()
    assert between == same - parts
