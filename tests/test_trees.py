"""Components, spanning forests, sums over both sides of edges, distances to outlines: whole and in rounds, against plain versions."""

import random

import numpy as np
import pytest

from cytomesh.functions.kernels import least_members, lightest_forest
from cytomesh.operators import cluster, forest, graph, joins, segment_tree
from cytomesh.operators.core import ensure_checkpoint_dir


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def random_edges(rng, n, m):
    edges = [(i, rng.randrange(n), rng.randrange(n), float(rng.randrange(6))) for i in range(m)]
    edges += [(m + i, i, i + 1, 3.0) for i in range(n // 2)]  # a long chain
    return edges + [(9999, 7, j, 2.5) for j in range(0, n, 3)] + edges[:5]  # a hub, equal eids, repeated rows


def plain_components(edges, verts):
    g = Groups()
    for a, b in edges:
        if a is not None and b is not None:
            g.join(a, b)
    return {v: g.find(v) for v in verts}


def plain_forest(edges):
    g, out = Groups(), set()
    for i, a, b, w in sorted(set(edges), key=lambda e: (e[3], e[0], e[1], e[2])):
        if g.join(a, b):
            out.add((i, a, b, w))
    return out


def test_kernels():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(1, 40), rng.integers(0, 60)
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        g = Groups()
        taken = [bool(g.join(int(x), int(y))) for x, y in zip(a, b)]
        assert least_members(a, b, n).tolist() == [g.find(i) for i in range(n)]
        assert lightest_forest(a, b, n).tolist() == taken


@pytest.mark.parametrize("limit", [1 << 20, 40, 0])
def test_components_and_forest(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "LOCAL_EDGES", max(limit, 1))
    rng = random.Random(limit)
    edges = random_edges(rng, 300, 120)
    if limit == 0:
        edges = edges[:40]
    df = spark.createDataFrame([*edges, (1, None, 3, 1.0), (2, 4, None, 1.0)], "eid long, src long, dst long, w double").repartition(5)
    verts = spark.range(320)
    got = {r.id: r.component for r in graph.connected_components(df, verts).collect()}
    assert got == plain_components([(a, b) for _, a, b, _ in edges], range(320))
    tree = graph.mst(df.withColumn("note", df.eid + 1))
    assert tree.columns == ["eid", "src", "dst", "w", "note"]
    rows = [tuple(r)[:4] for r in tree.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_forest(edges)


def test_components_of_names(spark):
    df = spark.createDataFrame([("é", "b"), ("b", "z"), ("q", "q"), ("x", "y")], "src string, dst string")
    got = {r.id: r.component for r in graph.connected_components(df, spark.createDataFrame([(c,) for c in "ébzqxyw"], "id string")).collect()}
    assert got == {"é": "b", "b": "b", "z": "b", "q": "q", "x": "x", "y": "x", "w": "w"}
    empty = df.where("false")
    assert graph.connected_components(empty, spark.range(3)).count() == 3


def test_rounds_leave_only_what_the_result_reads(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 30)
    ensure_checkpoint_dir(spark)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = lambda: len([s for s in fs.listStatus(root) if s.getPath().getName().startswith("table-")])
    df = spark.createDataFrame(random_edges(random.Random(1), 200, 100), "eid long, src long, dst long, w double")
    before = tables()
    graph.connected_components(df, spark.range(200)).count()
    assert tables() == before + 1
    graph.mst(df).count()
    assert tables() == before + 2


def tree_edges(rng, n, shape):
    order = list(range(n))
    rng.shuffle(order)
    up = {"path": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rng.randrange(i), "broom": lambda i: i - 1 if i <= n // 2 else n // 2}[shape]
    out = []
    for i in range(1, n):
        a, b = order[i], order[up(i)]
        out.append((a, b) if rng.random() < 0.5 else (b, a))
    return out


def plain_sides(edges, n, s):
    out = {}
    for a, b in edges:
        near = {}
        for x, y in edges:
            if (x, y) != (a, b):
                near.setdefault(x, []).append(y)
                near.setdefault(y, []).append(x)
        seen, todo = {a}, [a]
        while todo:
            for y in near.get(todo.pop(), []):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[a, b] = (sum(n[v] for v in seen), sum(s[v] for v in seen))
    return out


@pytest.mark.parametrize("shape", ["path", "star", "random", "broom"])
def test_leaf_stripping(shape):
    rng = random.Random(5)
    edges = tree_edges(rng, 25, shape)
    n = np.arange(1, 26)
    s = np.arange(25.0)[:, None] * [1.0, 2.0]
    first, bn, bs = forest.strip_leaves(np.array(edges), n, s)
    for (a, b), f, cn, cs in zip(edges, first, bn, bs):
        wn, ws = plain_sides(edges, n, s[:, 0])[a, b]
        assert (cn, cs[0]) == ((wn, ws) if f else (n.sum() - wn, s[:, 0].sum() - ws)) and cs[1] == 2 * cs[0]


@pytest.mark.parametrize("limit", [1 << 20, 3, 0])
def test_sides_of_all_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(forest, "LOCAL_EDGES", limit)
    rng = random.Random(11)
    edges, at, rows = [], 0, []
    for shape, size in (("path", 23), ("star", 12), ("random", 20), ("broom", 14), ("path", 1), ("path", 2)):
        part = [(a + at, b + at) for a, b in tree_edges(rng, size, shape)]
        count = {v: v % 3 + 1 for v in range(at, at + size)}
        value = {v: float(v * v % 17) for v in range(at, at + size)}
        want = plain_sides(part, count, value)
        total = (sum(count.values()), sum(value.values()))
        edges += [(f"e{a}-{b}", a, b, total[0], [total[1], -total[1]], *want[a, b]) for a, b in part]
        rows += [(v, count[v], [value[v], -value[v]]) for v in count]
        at += size
    e = spark.createDataFrame([x[:5] for x in edges], "name string, a long, b long, tn long, ts array<double>").repartition(3)
    v = spark.createDataFrame(rows, "id long, n long, s array<double>").repartition(3)
    got = {r.name: (r.n1, r.s1) for r in forest.side_sums(e, v, 2).collect()}
    assert got == {x[0]: (x[5], [pytest.approx(x[6]), pytest.approx(-x[6])]) for x in edges}


def plain_loglik(parts, data, p, var=0.0625):
    yy = data.T @ data
    inner, lo = yy + np.eye(p), 0.0
    for ids in parts:
        s, om = data[ids].sum(0), len(ids) + 1 / var
        inner = inner - np.outer(s, s) / om
        lo += np.log(om)
    return -p / 2 * lo - (p + len(data)) / 2 * np.linalg.slogdet(inner)[1] - p * len(parts) / 2 * np.log(var)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_scores_of_all_cuts(spark, monkeypatch, limit):
    monkeypatch.setattr(forest, "LOCAL_EDGES", limit)
    rng = random.Random(2)
    data = np.random.default_rng(2).standard_normal((30, 4))
    edges = tree_edges(rng, 18, "random") + [(a + 18, b + 18) for a, b in tree_edges(rng, 11, "path")]  # vertex 29 is alone
    tree = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "eid long, src long, dst long")
    points = spark.createDataFrame([(i, data[i].tolist()) for i in range(30)], "id long, pcs array<double>")
    got = {r.eid: (r.n_side, r.loglik) for r in cluster.score_cuts(tree, points, 3).collect()}
    assert len(got) == len(edges)
    for i, (a, b) in enumerate(edges):
        parts = plain_components(edges[:i] + edges[i + 1 :], range(30))
        groups = [[v for v in range(30) if parts[v] == c] for c in set(parts.values())]
        assert got[i][0] == sum(parts[v] == parts[a] for v in range(30))
        assert got[i][1] == pytest.approx(plain_loglik(groups, data[:, :3], 3), abs=1e-8)
    few = cluster.score_cuts(tree, points, 3, tree.where("eid in (2, 5)").select("eid"))
    assert {r.eid for r in few.collect()} == {2, 5}
    labelled = points.withColumn("cluster", (points.id % 3).cast("int"))
    found = cluster.marginal_loglik(labelled, 3).first()
    assert found.k == 3 and found.loglik == pytest.approx(plain_loglik([list(range(i, 30, 3)) for i in range(3)], data[:, :3], 3))


# --------------------------------------------------------------------------- outlines


def plain_distance(x, y, segs):
    best = np.inf
    for x1, y1, x2, y2 in segs:
        dx, dy = x2 - x1, y2 - y1
        t = 0.0 if dx == dy == 0 else min(max(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0.0), 1.0)
        best = min(best, float(np.hypot(x - x1 - t * dx, y - y1 - t * dy)))
    return best


@pytest.mark.parametrize("leaf, leaves, fan", [(128, 1 << 14, 128), (2, 1 << 14, 3), (4, 5, 2)])
def test_distance_to_outlines(spark, monkeypatch, leaf, leaves, fan):
    for name, value in (("LEAF", leaf), ("LEAVES", leaves), ("FAN", fan)):
        monkeypatch.setattr(segment_tree, name, value)
    rng = random.Random(4)
    at = np.linspace(0, 2 * np.pi, 60)
    ring = [(float(5 * np.cos(a)), float(3 * np.sin(a))) for a in at]
    segs = [(*p, *q) for p, q in zip(ring, ring[1:])] + [(2.0, 2.0, 2.0, 2.0)] * 4 + [(-9.0, 0.0, 9.0, 0.5), (100.0, 100.0, 101.0, 100.0)]
    segs += [(1.0 + rng.random() * 1e-9, 1.0, 1.0, 1.0) for _ in range(30)]  # one place on the curve
    pts = [(i, rng.uniform(-8, 8), rng.uniform(-8, 8)) for i in range(120)] + [(1, None, 2.0), (2, 3.0, None), (3, 1e6, -1e6), (4, 2.0, 2.0), (4, 0.0, 0.0)]
    df = spark.createDataFrame([(*p, "x") for p in pts], "id int, x double, y double, _leaf string").repartition(3)
    outline = spark.createDataFrame([(1, *s) for s in segs] + [(1, None, 1.0, 1.0, 1.0)], "polygon_id int, x1 double, y1 double, x2 double, y2 double")
    got = joins.min_boundary_distance(df, outline, "far")
    assert got.columns == [*df.columns, "far"]
    rows = got.collect()
    assert sorted((r.id, str(r.x)) for r in rows) == sorted((p[0], str(p[1])) for p in pts)
    for r in rows:
        assert (r.far is None) if r.x is None or r.y is None else r.far == pytest.approx(plain_distance(r.x, r.y, segs), rel=1e-12, abs=1e-15)
    assert {r.far for r in joins.min_boundary_distance(df, outline.where("false"), "far").collect()} == {None}


def test_far_leaves_are_not_visited(spark):
    at = np.linspace(0, 2 * np.pi, 20_001)
    ring = np.stack([np.cos(at), np.sin(at)], axis=1)
    outline = spark.createDataFrame(np.concatenate([ring[:-1], ring[1:]], axis=1).tolist(), "x1 double, y1 double, x2 double, y2 double")
    directory = segment_tree.Directory(segment_tree._leaves(outline))
    x, y = np.array([0.9, 1.5, 0.2]), np.array([0.1, 1.5, -0.7])
    reach = np.abs(np.hypot(x, y) - 1) + 1e-9
    visits = sum(len(i) for i, _ in directory.within(x, y, reach))
    assert len(directory.leaf) > 150 and visits < 40
