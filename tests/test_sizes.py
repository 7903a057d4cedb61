"""What grows with the number of groups, or with the rows at one place, is left out or dealt over tasks."""

import numpy as np
import pandas as pd

from cytomesh.operators import core, joins, markers, prep
from cytomesh.operators.spatial_index import _reached_leaves, knn_join


def test_small_groups_need_no_sketch(spark, monkeypatch):
    df = spark.createDataFrame([(g, float(v), 2) for g in (1, 2, None) for v in (3, 1, 1, 2)], "g int, v double, m int")
    sketched, plain = [], core.F.percentile_approx
    monkeypatch.setattr(core.F, "percentile_approx", lambda *a: (sketched.append(1), plain(*a))[1])
    want = {(g, 1.0, 2, 0, 4) for g in (1, 2, None)} | {(g, 2.0, 1, 2, 4) for g in (1, 2, None)} | {(g, 3.0, 1, 3, 4) for g in (1, 2, None)}
    assert set(map(tuple, core.cumulative_counts(df, "v", ["g"]).collect())) == want
    assert not sketched
    weighted = {(g, v, 2 * c, 2 * b, 2 * t) for g, v, c, b, t in want}
    assert set(map(tuple, core.cumulative_counts(df, "v", ["g"], "m").collect())) == weighted
    monkeypatch.setattr(core, "RANGE_VALUES", 2)
    assert set(map(tuple, core.cumulative_counts(df, "v", ["g"], "m").collect())) == weighted
    assert sketched


def test_rank_sums_read_the_values_once(spark):
    values = spark.range(120).selectExpr("id DIV 4 AS cell_id", "id % 4 AS gene_id", "1.0D + (id * id + id DIV 7) % 5 AS value")
    labels = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(30), "cluster": np.arange(30) % 3}))
    rows = values.toPandas()
    got = {(r.gene_id, r.cluster): r.u for r in markers.rank_sum_statistics(values, labels).collect()}
    for (g, c), u in got.items():
        own = rows[rows.gene_id == g]
        a, b = own[own.cell_id % 3 == c].value.to_numpy(), own[own.cell_id % 3 != c].value.to_numpy()
        assert u == (a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()
    plan = markers.rank_sum_statistics(values, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan  # only the written counts


def test_doublets_read_the_cells_once(spark):
    cells = spark.range(50).selectExpr("id AS cell_id", "id % 7 + 1.0D AS n", "id % 11 + 1.0D AS area")
    plan = prep.doublet_flag(cells, "n", "area")._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan  # only the written table


def test_rows_of_a_place_are_dealt_over_tasks(spark, monkeypatch):
    a = spark.range(400).selectExpr("id AS a_id", "CASE WHEN id < 300 THEN 2.4D WHEN id < 350 THEN id * 1.0D END AS x", "1.5D AS y")
    b = spark.range(40).selectExpr("id AS b_id", "IF(id < 30, 2.0D, id + 300.0D) AS x", "2.0D AS y")
    place = lambda r: (r.x, r.y, r.a_id, r.b_id)
    for how in ("left", "inner"):
        monkeypatch.setattr(joins, "PLACE_PAIRS", 1 << 20)
        want = sorted(map(place, joins.join_rounded_xy(a, b, how).collect()), key=str)
        monkeypatch.setattr(joins, "PLACE_PAIRS", 500)
        got = joins.join_rounded_xy(a, b, how)
        assert sorted(map(place, got.collect()), key=str) == want and got.columns == ["x", "y", "a_id", "b_id"]
        rows = got.rdd.mapPartitions(lambda rs: [sum(1 for _ in rs)]).collect()
        assert sum(rows) == len(want) > 9000 and max(rows) < 3000


def test_neighbours_where_every_location_has_copies(spark):
    """A leaf may be one location, and all neighbours of its points copies."""
    points = spark.range(6 * 400).selectExpr("id", "hash(id % 400) % 1000 / 7.0D AS x", "hash(id % 400, 1) % 1000 / 7.0D AS y")
    got = knn_join(None, points, 5).toPandas()
    assert len(got) == 5 * 6 * 400 and (got.d == 0).all() and ((got.src - got.dst) % 400 == 0).all() and (got.src != got.dst).all()
    far = points.unionByName(points.limit(0)).where("id < 2399")  # one location has five, whose fifth neighbour is elsewhere
    assert (knn_join(None, far, 5).toPandas().groupby("src").size() == 5).all()


def test_a_leaf_without_extent_reaches_its_neighbours(spark):
    local = spark.sql("SELECT 0 AS realm, 3 AS lv, 1L AS cx, 1L AS cy, 1.5D AS x, 1.5D AS y, 0.0D AS radius")
    stats = spark.sql("SELECT 0 AS realm, 2 AS lv, 0L AS cx, 0L AS cy, 6L AS nc, 1.0D AS bx0, 1.5D AS bx1, 1.5D AS by0, 1.5D AS by1")
    assert _reached_leaves(local, stats, 8.0, 0.0, 0.0).count() == 1
