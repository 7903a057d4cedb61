"""Spatial search and graph operators against brute force, with dense spots and repeated locations."""

import numpy as np
import pandas as pd
import pytest

from cytomesh.operators import graph, neighbors
from cytomesh.operators.spatial_index import knn_join, nearest_foreign


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    n = 900
    x = np.concatenate([rng.uniform(0, 100, n // 3), 50 + rng.normal(0, 0.01, n // 3), np.full(n // 3, 7.0)])
    y = np.concatenate([rng.uniform(0, 100, n // 3), 50 + rng.normal(0, 0.01, n // 3), np.full(n // 3, 7.0)])
    return pd.DataFrame({"id": rng.permutation(n), "x": x, "y": y, "label": (x // 20).astype(int)})


def brute(q, c, k, same):
    c = c.sort_values("id")
    out = {}
    for r in q.itertuples():
        d = np.sqrt((r.x - c.x.to_numpy()) ** 2 + (r.y - c.y.to_numpy()) ** 2)
        if same:
            d[c.id.to_numpy() == r.id] = np.inf
        s = np.argsort(d, kind="stable")[:k]
        out[r.id] = [(int(c.id.iloc[j]), float(d[j])) for j in s]
    return out


def as_dict(df):
    return {s: list(zip(g.dst.tolist(), g.d.tolist())) for s, g in df.sort_values(["src", "rk"]).groupby("src")}


@pytest.mark.parametrize("leaf", [64, 512])
def test_knn_matches_brute_force(spark, cloud, leaf):
    df = spark.createDataFrame(cloud)
    assert as_dict(knn_join(None, df, 4, leaf_rows=leaf).toPandas()) == brute(cloud, cloud, 4, True)


def test_far_queries(spark, cloud):
    rng = np.random.default_rng(1)
    q = pd.DataFrame({"id": np.arange(80), "x": rng.uniform(-300, 300, 80), "y": rng.uniform(-300, 300, 80)})
    got = knn_join(spark.createDataFrame(q), spark.createDataFrame(cloud), 2, leaf_rows=64).toPandas()
    assert as_dict(got) == brute(q, cloud, 2, False)


def test_nearest_foreign(spark, cloud):
    got = nearest_foreign(spark.createDataFrame(cloud), leaf_rows=64).toPandas().set_index("label")
    for lab, own in cloud.groupby("label"):
        other = cloud[cloud.label != lab]
        best = min(np.sqrt((other.x - r.x) ** 2 + (other.y - r.y) ** 2).min() for r in own.itertuples())
        assert got.loc[lab, "d"] == pytest.approx(best, abs=1e-12)


def test_radius_graph_with_heavy_cells(spark, cloud):
    some = cloud[cloud.x != 7.0]
    got = neighbors.radius_graph(spark.createDataFrame(some), 0.02, cell_rows=50).toPandas()
    d = np.sqrt((some.x.to_numpy()[:, None] - some.x.to_numpy()) ** 2 + (some.y.to_numpy()[:, None] - some.y.to_numpy()) ** 2)
    assert len(got) == np.triu(d <= 0.02, 1).sum()
    assert not got.duplicated(["src", "dst"]).any()


def test_bridging_equals_greedy_growth(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": np.arange(60), "x": rng.random(60), "y": rng.random(60)})
    df = spark.createDataFrame(pdf)
    edges = neighbors.radius_graph(df, 0.08)
    lab = graph.connected_components(edges, df).toPandas().set_index("id").component.loc[pdf.id].to_numpy()
    out = graph.bridge_components(edges, df).toPandas()
    got = set(map(tuple, out[out.merged_edge][["src", "dst"]].to_numpy()))
    xy = pdf[["x", "y"]].to_numpy()
    dist = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    want, cur = set(), lab.copy()
    while len(set(cur)) > 1:
        v, c = np.unique(cur, return_counts=True)
        giant = v[c.argmax()]
        a, o = np.flatnonzero(cur == giant), np.flatnonzero(cur != giant)
        i, j = np.unravel_index(dist[np.ix_(a, o)].argmin(), (len(a), len(o)))
        want.add((min(a[i], o[j]), max(a[i], o[j])))
        cur[cur == cur[o[j]]] = giant
    assert got == want


def test_outlier_does_not_gather_the_rest(spark):
    from pyspark.sql import functions as F

    from cytomesh.operators.spatial_index import assign_leaves

    rng = np.random.default_rng(7)
    pts = pd.DataFrame({"id": np.arange(5001), "x": np.append(rng.uniform(0, 1, 5000), 1e10), "y": np.append(rng.uniform(0, 1, 5000), -1e10)})
    rows, *_ = assign_leaves(spark.createDataFrame(pts).withColumn("realm", F.lit("")), 100)
    assert rows.groupBy("realm", "lv", "cx", "cy").count().agg(F.max("count")).first()[0] < 200
    got = knn_join(None, spark.createDataFrame(pts), 2, leaf_rows=100).toPandas()
    some = pts.iloc[[0, 1, 2, 4999, 5000]]
    want = brute(some, pts, 3, False)
    found = as_dict(got)
    for i in some.id:
        assert [d for _, d in found[i]] == pytest.approx([d for j, d in want[i] if j != i][:2])


def test_suggested_radius_follows_the_density(spark):
    rng = np.random.default_rng(3)
    for n in (500, 4000):
        pts = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": rng.uniform(0, 1, n), "y": rng.uniform(0, 1, n)}))
        row = neighbors.suggest_radius(pts, n=200).first()
        deg = neighbors.degree_stats(neighbors.radius_graph(pts, row["radius"]), pts).first()
        assert deg["median"] in (3.5, 4.0, 4.5, 5.0)
