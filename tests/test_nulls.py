"""Groups and rows with NULL keys, repeated ids and missing coordinates."""

import pytest

from cytomesh.operators import core, joins, posterior, prep
from cytomesh.operators.graph import geodesic, mst


@pytest.mark.parametrize("limit", [100_000, 7])
def test_quantiles_keep_the_null_group(spark, monkeypatch, limit):
    monkeypatch.setattr(core, "RANGE_VALUES", limit)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in range(50)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.lo, r.mid) for r in core.quantiles(df, "v", {"lo": 0.1, "mid": 0.5}, ["k"]).collect()}
    assert got == {k: (pytest.approx(4.9), 24.5) for k in ("a", "b", None)}
    assert core.quantiles(df, "v", {"mid": 0.5}).first()["mid"] == 24.5


def test_polygons_with_repeated_ids_and_missing_coordinates(spark):
    box = [(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 4.0, 4.0), (4.0, 4.0, 0.0, 4.0), (0.0, 4.0, 0.0, 0.0)]
    seg = spark.createDataFrame([(1, *s) for s in box], "polygon_id int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (1, 9.0, 1.0), (2, None, 1.0), (3, 4.0, 2.0), (4, 1.0, 99.0)], "id int, x double, y double")
    got = {(r.id, r.x): r.inside for r in joins.points_in_polygons(pts, seg).collect()}
    assert got == {(1, 1.0): True, (1, 9.0): False, (2, None): None, (3, 4.0): True, (4, 1.0): False}


def test_crossing_edges_with_equal_eids_long_and_short(spark):
    verts = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1000.0), (4, 1000.0, 1001.0), (5, 0.0, 0.0)], "id int, x double, y double")
    edges = spark.createDataFrame([(7, 1, 2), (7, 1, 3), (7, 3, 4), (7, 1, 5)], "eid int, src int, dst int")
    wall = spark.createDataFrame([(0.5, -1.0, 0.5, 1.0), (500.0, 0.0, 500.5, 2000.0)], "x1 double, y1 double, x2 double, y2 double")
    assert {(r.src, r.dst) for r in joins.drop_crossing_edges(edges, verts, wall).collect()} == {(1, 3), (1, 5)}


def test_spanning_tree_with_equal_eids(spark):
    edges = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 2.0), (1, 1, 3, 5.0)], "eid int, src int, dst int, w double")
    assert {(r.src, r.dst) for r in mst(edges).collect()} == {(1, 2), (2, 3)}


def test_geodesic_reaches_the_end_of_a_chain(spark):
    n = 12
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "src int, dst int, w double")
    verts = spark.createDataFrame([(i,) for i in range(n + 2)], "id int")
    got = {r.id: r.d for r in geodesic(edges, verts.where("id = 0"), verts).collect()}
    assert got == {**{i: float(i) for i in range(n + 1)}, n + 1: 2.0 * n}


def test_representative_iteration_leaves_null_labels_out(spark):
    rows = [(i, o, None if o == 5 else ("a" if (o + (i == 3)) % 2 else "b")) for i in (1, 2, 3) for o in range(6)]
    df = spark.createDataFrame(rows, "iter int, obs_id int, label string")
    assert posterior.representative_iteration(df).first()["iter"] in (1, 2, 3)
    o = {(r.s, r.t): r.overlap for r in posterior.partition_overlap(df).collect()}
    assert o[1, 2] == 2.0**2 + 3.0**2


def test_groups_and_names_without_key_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), (None, 3, 5.0), (None, 4, 9.0), ("b", None, 2.0)], "name string, n int, v double")
    z = {(r.name, r.n): r.v for r in prep.zscore(df, ["v"], ["name"]).collect()}
    half = 0.5**0.5
    assert len(z) == 5 and z[None, 3] == pytest.approx(-half) and z[None, 4] == pytest.approx(half) and z["a", 2] == pytest.approx(half)
    stats = prep.moments(df, ["v"], ["name"])
    assert prep.scale_like(df, stats, ["v"], ["name"]).count() == 5
    names = {(r.n, r.v): r.unique_name for r in prep.make_unique(df.unionByName(df.where("n = 1").withColumn("n", df.n + 4)), "name", "n").collect()}
    assert names == {(1, 1.0): "a", (2, 3.0): "a-1", (5, 1.0): "a-2", (3, 5.0): None, (4, 9.0): None, (None, 2.0): "b"}


@pytest.mark.parametrize("limit", [100_000, 7])
def test_keys_with_the_names_of_inner_columns(spark, monkeypatch, limit):
    monkeypatch.setattr(core, "RANGE_VALUES", limit)
    rows = [(k, k, k, k, float(v)) for k in (1, 2) for v in range(40)]
    df = spark.createDataFrame(rows, "n int, rb int, value int, total int, v double")
    got = {tuple(r)[:4]: r.mid for r in core.quantiles(df, "v", {"mid": 0.5}, ["n", "rb", "value", "total"]).collect()}
    assert got == {(1, 1, 1, 1): 19.5, (2, 2, 2, 2): 19.5}
    assert core.cumulative_counts(df, "v", ["n", "rb"]).where("before + cnt = total").count() == 2
    with pytest.raises(ValueError):
        core.cumulative_counts(df, "v", ["value"])
