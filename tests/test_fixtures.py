"""Micro fixtures with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytomesh.functions.kernels import chi2_upper, transport_cost, w2_cov_term
from cytomesh.operators import core, graph, joins, metrics, neighbors, posterior, prep, segment_tree, shards
from cytomesh.sources import readers


def labels(spark, a, b):
    return spark.createDataFrame(list(zip(a, b)), "a int, b int")


@pytest.mark.parametrize("a,b,ari,nmi", [([1, 1, 2, 2], [2, 2, 1, 1], 1.0, 1.0), ([1, 1, 2, 2], [1, 2, 1, 2], -0.5, 0.0)])
def test_agreement(spark, a, b, ari, nmi):
    df = labels(spark, a, b)
    assert metrics.ari(df, "a", "b").first()[0] == pytest.approx(ari)
    assert metrics.nmi(df, "a", "b").first()[0] == pytest.approx(nmi)


def test_agreement_ignores_null_pairs_and_single_clusters(spark):
    df = labels(spark, [1, 1, 2, 2, None], [2, 2, 1, 1, 1])
    assert metrics.ari(df, "a", "b").first()[0] == pytest.approx(1.0)
    one = labels(spark, [1, 1], [1, 1])
    assert metrics.ari(one, "a", "b").first()[0] == 1.0
    assert metrics.nmi(one, "a", "b").first()[0] is None


def test_wasserstein(spark):
    eye = [1.0, 0.0, 0.0, 1.0]
    rows = [([0.0, 0.0], eye, [3.0, 4.0], eye), ([0.0, 0.0], eye, [0.0, 0.0], [4.0, 0.0, 0.0, 4.0])]
    df = spark.createDataFrame(rows, "mean1 array<double>, cov1 array<double>, mean2 array<double>, cov2 array<double>")
    got = sorted(r["w2"] for r in shards.gaussian_w2(df, 2).collect())
    assert got == pytest.approx([math.sqrt(2), 5.0])


def test_wasserstein_full_matrices():
    rng = np.random.default_rng(3)
    a, b = (m @ m.T + np.eye(3) for m in rng.normal(size=(2, 3, 3)))
    vals = np.linalg.eigvals(a @ b)  # tr sqrt(b^1/2 a b^1/2) = sum of roots of the eigenvalues of ab
    want = np.trace(a) + np.trace(b) - 2 * np.sqrt(vals.real).sum()
    assert w2_cov_term(a[None], b[None])[0] == pytest.approx(want)


def test_transport_against_sorted_matching():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, y = np.sort(rng.random(6)), np.sort(rng.random(6))
        cost = (x[:, None] - y[None, :]) ** 2
        w = np.ones(6)
        assert transport_cost(w, w, cost) == pytest.approx(((x - y) ** 2).mean())
    a = np.array([0.7, 0.3])
    assert transport_cost(a, np.array([0.3, 0.7]), np.array([[0.0, 1.0], [1.0, 0.0]])) == pytest.approx(0.4)


def test_chi2_tail():
    assert chi2_upper(3.0, 2) == pytest.approx(math.exp(-1.5))
    assert chi2_upper(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_upper(30.0, 4) == pytest.approx(math.exp(-15) * 16)


def square(spark):
    pts = [(1, 0, i, x, y) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])]
    pts += [(1, 1, i, x, y) for i, (x, y) in enumerate([(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)])]
    rows = [(p, g, s, float(x), float(y)) for p, g, s, x, y in pts]
    return readers.read_boundary(spark.createDataFrame(rows, "polygon_id int, ring_id int, seq int, x double, y double"))


@pytest.mark.parametrize("slabs", [1, 4096])
def test_square_with_hole(spark, slabs):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.2, 0.2), (3, 1.0, 0.5), (4, 2.0, 2.0)], "id int, x double, y double")
    got = {r["id"]: r["inside"] for r in joins.points_in_polygons(pts, square(spark), slabs=slabs).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_large_outline_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame(pd.DataFrame({"id": range(200), "x": rng.uniform(-0.5, 1.5, 200), "y": rng.uniform(-0.5, 1.5, 200)}))
    segs = square(spark)
    edges = neighbors.with_eid(neighbors.undirected(neighbors.knn(pts, 4)))

    def results():
        d = joins.min_boundary_distance(pts, segs).orderBy("id").toPandas()["boundary_distance"].to_numpy()
        e = {(r["src"], r["dst"]) for r in joins.drop_crossing_edges(edges, pts, segs).collect()}
        return d, e

    d1, e1 = results()
    for name, value in (("LEAF", 2), ("FAN", 2)):
        monkeypatch.setattr(segment_tree, name, value)
    d2, e2 = results()
    assert np.allclose(d1, d2) and e1 == e2


def test_kneedle_and_quantile(spark):
    df = spark.createDataFrame([(v,) for v in (10, 4, 3, 2, 1)], "v int")
    assert prep.kneedle_cutoff(df, "v").first()[0] == 4
    q = core.quantiles(spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int"), "v", {"q": 0.25}).first()[0]
    assert q == 1.75


def test_range_split_counts_match_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "b", "c"], 4000, p=[0.8, 0.1, 0.1]), "v": rng.normal(size=4000).round(2)})
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(core, "RANGE_VALUES", 50)
    got = core.average_ranks(df, "v", ["g"]).toPandas()
    want = pdf.assign(r=pdf.groupby("g")["v"].rank()).drop_duplicates(["g", "v"]).set_index(["g", "v"])["r"]
    assert len(got) == len(want)
    assert all(want[(r.g, r.value)] == r.avg_rank for r in got.itertuples())
    q = core.quantiles(df, "v", {"m": 0.5}).first()[0]
    assert q == pytest.approx(pdf["v"].median())


def test_minimum_tree_of_a_cycle(spark):
    e = spark.createDataFrame([(1, 1, 2, 1.0), (2, 2, 3, 2.0), (3, 3, 4, 3.0), (4, 1, 4, 4.0)], "eid long, src long, dst long, w double")
    got = graph.mst(e).toPandas()
    assert len(got) == 3 and got["w"].sum() == 6


def test_merge_small_path(spark):
    e = spark.createDataFrame([(1, 1, 2, 1.0), (2, 2, 3, 1.0)], "eid long, src long, dst long, w double")
    lab = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "id long, label long")
    got = {r["id"]: r["label"] for r in graph.merge_small_components(e, lab, 2).collect()}
    assert got == {1: 10, 2: 10, 3: 10}


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = spark.range(1, 400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    hub = spark.range(1001, 1500).select(F.lit(1000).cast("long").alias("src"), F.col("id").alias("dst"))
    verts = spark.range(1, 401).unionByName(spark.range(1000, 1500)).unionByName(spark.range(5000, 5003))
    got = graph.connected_components(chain.unionByName(hub), verts).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in got} == {1: 400, 1000: 500, 5000: 1, 5001: 1, 5002: 1}


def test_posterior(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "a"), (2, 2, "b"), (2, 3, "b"), (3, 1, "x"), (3, 2, "x"), (3, 3, "y")]
    s = spark.createDataFrame(rows, "iter int, obs_id long, label string")
    o = {(r["s"], r["t"]): r["overlap"] for r in posterior.partition_overlap(s).collect()}
    assert o[(1, 1)] == 5 and o[(1, 3)] == 5 and o[(1, 2)] == 3
    assert posterior.representative_iteration(s).first()["iter"] == 1


def test_shards_are_balanced_and_stable(spark):
    df = spark.range(1003).withColumnRenamed("id", "cell_id")
    a = shards.assign_shards(df, 7)
    sizes = [r["count"] for r in a.groupBy("shard_id").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1 and sum(sizes) == 1003
    b = shards.assign_shards(df.repartition(13), 7)
    assert a.join(b, ["cell_id", "shard_id"]).count() == 1003
