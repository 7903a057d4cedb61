"""Radius graphs of points with many copies: as few rows as the work needs, and the results of the plain graph."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import cytomesh.plans.catalog  # noqa: F401
from cytomesh.operators import graph, joins, neighbors
from cytomesh.plans.registry import QUERIES


@pytest.fixture(scope="module")
def copies():
    """Sparse points, a dense spot, copies of places, and points without a place or label."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0, 60, 400), 20 + rng.normal(0, 0.4, 300), np.repeat(rng.uniform(0, 60, 20), 15), [np.nan, np.nan, 5.0]])
    y = np.concatenate([rng.uniform(0, 60, 400), 20 + rng.normal(0, 0.4, 300), np.repeat(rng.uniform(0, 60, 20), 15), [np.nan, 1.0, 5.0]])
    label = [*rng.choice(["a", "b", "c"], len(x) - 1), None]
    return pd.DataFrame({"id": rng.permutation(len(x)), "x": x, "y": y, "label": label})


def pairs(c, r):
    d = np.sqrt((c.x.to_numpy()[:, None] - c.x.to_numpy()) ** 2 + (c.y.to_numpy()[:, None] - c.y.to_numpy()) ** 2)
    i, j = np.nonzero(d <= r)
    keep = c.id.to_numpy()[i] < c.id.to_numpy()[j]
    return pd.DataFrame({"src": c.id.to_numpy()[i[keep]], "dst": c.id.to_numpy()[j[keep]], "d": d[i[keep], j[keep]]})


def shuffled(spark, df):
    """Exchanges of the plan of the rows themselves."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("r", [0.3, 1.5, 4.0])
@pytest.mark.parametrize("label", [None, "label"])
def test_components_without_edges(spark, copies, r, label):
    df = spark.createDataFrame(copies)
    edges = spark.createDataFrame(pairs(copies, r))
    want = graph.connected_components(edges, df) if label is None else graph.spatial_components(edges, df)
    got = graph.radius_components(df, r, label)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_squares_that_only_inner_places_link(spark):
    """The nearest places of two squares are none of the outermost ones."""
    at = [(0.0, 0.0), (0.0, 6.9), (3.2, 0.1), (3.2, 6.8), (3.4, 3.4), (8.35, 3.45), (8.6, 0.2), (8.6, 6.6), (10.4, 0.0), (10.4, 6.9)]
    rng = np.random.default_rng(0)
    for turn in range(6):
        phi = rng.uniform(0, 2 * np.pi)
        c = pd.DataFrame([(i, x * np.cos(phi) - y * np.sin(phi), x * np.sin(phi) + y * np.cos(phi)) for i, (x, y) in enumerate(at)], columns=["id", "x", "y"])
        df = spark.createDataFrame(c)
        for r in (4.951, 5.0, 9.9):
            want = graph.connected_components(spark.createDataFrame(pairs(c, r)), df).toPandas().set_index("id").component.to_dict()
            assert graph.radius_components(df, r).toPandas().set_index("id").component.to_dict() == want


def test_carried_labels_need_no_shuffle_of_edges(spark, copies):
    df = spark.createDataFrame(copies.dropna())
    plain, carried = neighbors.radius_graph(df, 1.5), neighbors.radius_graph(df, 1.5, carry=["label"])
    assert sorted(carried.columns) == ["d", "dst", "dst_label", "src", "src_label"]
    for step in (neighbors.edge_status, lambda e, v: neighbors.penalize(e.withColumnRenamed("d", "w"), v, 2.0)):
        want, got = step(plain, df), step(carried, df)
        assert shuffled(spark, got) <= shuffled(spark, plain)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_locations_keep_the_longest_edge(spark, copies):
    df = spark.createDataFrame(copies.dropna())
    longest = F.max("d")
    assert neighbors.radius_graph(neighbors.locations(df), 1.5).agg(longest).first() == neighbors.radius_graph(df, 1.5).agg(longest).first()


def test_forest_of_copies(spark, copies):
    df = spark.createDataFrame(copies)
    plain = graph.mst(neighbors.with_eid(spark.createDataFrame(pairs(copies, 1.5)).withColumnRenamed("d", "w"))).toPandas()
    got = graph.radius_forest(df, 1.5).toPandas()
    assert len(got) == len(plain) and got.w.sum() == pytest.approx(plain.w.sum())
    parts = graph.connected_components(spark.createDataFrame(got[["src", "dst"]]), df)
    assert parts.exceptAll(graph.radius_components(df, 1.5)).isEmpty()


def test_degrees_and_lengths_of_copies(spark, copies):
    df, edges = spark.createDataFrame(copies), spark.createDataFrame(pairs(copies, 1.5))
    assert neighbors.radius_degrees(df, 1.5).exceptAll(neighbors.degrees(edges, df)).isEmpty()
    rows = neighbors.radius_distances(df, 1.5)
    assert rows.agg(F.sum("n")).first()[0] == edges.count() > rows.count()
    p = 2 * edges.where("d = 0").count() / len(copies) + 0.5
    want, got = neighbors.search_length(edges, len(copies), p), neighbors.search_length(rows, len(copies), p, count="n")
    assert got == pytest.approx(want)


def test_radius_graph_of_copies(spark, copies, tmp_path):
    """All edges, in cells with slices too; pairs of copies add few bytes, as rows of equal d and id follow one another."""
    df = spark.createDataFrame(copies)
    want = pairs(copies, 1.5)
    for cell_rows in (4096, 7):
        got = neighbors.radius_graph(df, 1.5, cell_rows, carry=["label"], value=F.floor).toPandas().sort_values(["src", "dst"])
        assert np.array_equal(got[["src", "dst"]], want.sort_values(["src", "dst"])[["src", "dst"]])
        assert np.array_equal(got.d, np.floor(want.sort_values(["src", "dst"]).d))
        label = copies.set_index("id").label
        assert np.array_equal(got.src_label, label.loc[got.src]) and np.array_equal(got.dst_label, label.loc[got.dst])
    per_row = []
    for n in (1, 30):
        many = spark.range(100 * n).selectExpr("id", "cast(id % 100 % 10 AS double) AS x", "cast(floor(id % 100 / 10) AS double) AS y")
        neighbors.radius_graph(many, 1.5).coalesce(1).write.parquet(f"{tmp_path}/{n}")
        size = sum(f.stat().st_size for f in (tmp_path / str(n)).glob("*.parquet"))
        per_row.append(size / spark.read.parquet(f"{tmp_path}/{n}").count())
    assert per_row[1] < 1


def test_radius_graph_inside_an_outline(spark, copies):
    df = spark.createDataFrame(copies)
    edges = spark.createDataFrame(pairs(copies, 1.5)).select("src", "dst")
    t = np.linspace(0, 2 * np.pi, 41)
    x, y = 28 + 17.3 * np.cos(t) * (1 + 0.3 * np.sin(5 * t)), 31 + 19.1 * np.sin(t)
    rows = [(0, *map(float, r)) for r in zip(x[:-1], y[:-1], x[1:], y[1:])] + [(1, -3.0, 41.0, 70.0, 2.0)]
    segs = spark.createDataFrame(rows, "polygon_id int, x1 double, y1 double, x2 double, y2 double")
    want = joins.drop_crossing_edges(edges, df, segs).select("src", "dst")
    for most in (4096, 0):
        got = neighbors.radius_graph_inside(df, segs, 1.5, most).select("src", "dst")
        assert 0 < got.count() < edges.count()
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_search_length_query_where_every_point_has_a_copy(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.unionByName(orders.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000)).write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in QUERIES["G22_search_length"](spark, str(tmp_path)).collect()] == [(None, None)]


def test_suggested_radius_asks_once_per_place(spark, monkeypatch):
    """Places with more copies than neighbours wanted need no search; the others ask once, whatever their copies."""
    from cytomesh.operators import spatial_index

    rng = np.random.default_rng(9)
    x, times = rng.random((400, 2)) * 10, np.repeat([1, 2, 7], [150, 150, 100])
    at = np.repeat(x, times, axis=0)
    at[-1] = np.nan
    pts = spark.createDataFrame([(i, None if a != a else float(a), None if b != b else float(b)) for i, (a, b) in enumerate(at)], "id bigint, x double, y double")
    asked, real = [], spatial_index.search
    monkeypatch.setattr(spatial_index, "search", lambda rows, *a, **k: (asked.append(rows.where("is_q").count()), real(rows, *a, **k))[1])
    kth = spatial_index.kth_distances(pts, 4).groupBy("d").sum("n").collect()
    assert asked == [300]
    asked.clear()
    radius = neighbors.suggest_radius(pts, n=20).first()["radius"]
    d = np.sort(np.sqrt(((at[:-1, None] - at[None, :-1]) ** 2).sum(-1)), axis=1)[:, 4]
    assert np.allclose(np.sort(np.repeat([r[0] for r in kth], [r[1] for r in kth])), np.sort(d), rtol=0, atol=1e-12)
    assert radius == pytest.approx(np.sort(d)[(len(d) + 1) // 2 - 1], abs=1e-12)
    assert sum(asked) <= 300 + 20
