"""Spatial joins, neighbour graphs and graph algorithms over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytomesh.operators import graph as G
from cytomesh.operators import neighbors as N
from cytomesh.operators.core import cut_lineage
from cytomesh.plans import roles as R
from cytomesh.plans.registry import query
from cytomesh.plans.sql import CELL_RINGS, r, rounded, rs, vertices, vertices_sql
from cytomesh.sources import readers

_R = 5.0  # radius for the graph on ``points``


def _cells(spark, sf_dir):
    return R.cells(spark, sf_dir).select(F.col("cell_id").alias("id"), "x", "y", "pcs", F.col("annotation").alias("label"))


def _places(spark, sf_dir):
    """Customer positions in the range of the cells: locations that are not cells."""
    return R.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.col("c_acctbal") / 40000.0).alias("x"),
        ((F.col("c_custkey") % 1000) / 3000.0 - 0.15).alias("y"),
    )


_CELLS = f"{R.cells_sql()}, c AS (SELECT cell_id AS id, x, y, pcs, annotation AS label FROM cells)"
_PLACES = "places AS (SELECT c_custkey AS id, c_acctbal / 40000.0::DOUBLE AS x, (c_custkey % 1000) / 3000.0::DOUBLE - 0.15::DOUBLE AS y FROM customer)"
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def _knn_sql(k: int, name: str = "knn") -> str:
    return (
        f"{name} AS (SELECT src, dst, d, rk FROM (SELECT a.id AS src, b.id AS dst, {_DIST} AS d, "
        f"row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id)::INTEGER AS rk FROM c a JOIN c b ON a.id <> b.id) WHERE rk <= {k})"
    )


_UND = "und AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(d) AS d, count(*) AS n FROM knn GROUP BY 1, 2)"
_RAD = (
    f"{R.POINTS_SQL}, rad AS (SELECT a.id AS src, b.id AS dst, {_DIST} AS d FROM points a JOIN points b "
    f"ON a.id < b.id AND b.y BETWEEN a.y - {_R} AND a.y + {_R} AND b.x BETWEEN a.x - {_R} AND a.x + {_R} WHERE {_DIST} <= {_R})"
)


def _closure_sql(edges: str, verts: str, name: str = "cc") -> str:
    """Smallest reachable id per vertex; only smaller ids need to travel."""
    return (
        f"arcs AS (SELECT src AS a, dst AS b FROM {edges} UNION ALL SELECT dst, src FROM {edges}), "
        f"walk(id, rep) AS (SELECT id, id FROM {verts} UNION SELECT arcs.b, walk.rep FROM walk JOIN arcs ON arcs.a = walk.id WHERE walk.rep < arcs.b), "
        f"{name} AS (SELECT id, min(rep) AS component FROM walk GROUP BY 1)"
    )


@query("J9_nearest_join", f"WITH {_CELLS}, {_PLACES} SELECT src, dst, {rs('d')} AS d FROM (SELECT a.id AS src, b.id AS dst, {_DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS rn FROM places a CROSS JOIN c b) WHERE rn = 1")
def j9(spark, sf_dir):
    return rounded(N.nearest_join(_places(spark, sf_dir), _cells(spark, sf_dir)), ["d"])


@query("G1_knn", f"WITH {_CELLS}, {_knn_sql(6)} SELECT src, dst, {rs('d')} AS d, rk FROM knn")
def g1(spark, sf_dir):
    return rounded(N.knn(_cells(spark, sf_dir), 6), ["d"])


@query(
    "G1_knn_points",
    f"WITH {R.POINTS_SQL}, m AS (SELECT a.id AS src, min({{'d': {_DIST}, 'id': b.id}}, 5) AS near FROM points a JOIN points b ON a.id <> b.id GROUP BY 1), "
    f"u AS (SELECT src, unnest(near) AS e, generate_subscripts(near, 1)::INTEGER AS rk FROM m) SELECT src, e.id AS dst, {rs('e.d')} AS d, rk FROM u",
)
def g1b(spark, sf_dir):
    """The adaptive-grid search on all points."""
    return rounded(N.knn(R.points(spark, sf_dir), 5), ["d"])


@query("G2_mutual_knn", f"WITH {_CELLS}, {_knn_sql(6)}, {_UND} SELECT src, dst, {rs('d')} AS d FROM und WHERE n >= 2")
def g2(spark, sf_dir):
    return rounded(N.mutual_knn(_cells(spark, sf_dir), 6), ["d"])


@query("G3_radius_graph", f"WITH {_RAD} SELECT src, dst, {rs('d')} AS d FROM rad")
def g3(spark, sf_dir):
    return N.radius_graph(R.points(spark, sf_dir), _R, value=r)


@query(
    "G4_auto_radius_graph",
    f"WITH {_CELLS}, {_knn_sql(1)}, r AS (SELECT median(d) * 2.0 AS r FROM knn), "
    f"e AS (SELECT a.id AS src, b.id AS dst, {_DIST} AS d FROM c a JOIN c b ON a.id <> b.id CROSS JOIN r WHERE {_DIST} <= r), "
    "k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 5), "
    f"u AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(d) AS d FROM k GROUP BY 1, 2 HAVING count(*) >= 2) SELECT src, dst, {rs('d')} AS d FROM u",
)
def g4(spark, sf_dir):
    return rounded(N.auto_radius_graph(_cells(spark, sf_dir), max_k=6), ["d"])


@query("G5_suggest_radius")
def g5(spark, sf_dir):
    return N.suggest_radius(R.points(spark, sf_dir))


@query(
    "G5_radius_of_all_points",
    f"WITH {_CELLS}, {_knn_sql(4)} SELECT {rs('quantile_disc(d, 0.5)')} AS radius FROM knn WHERE rk = 4",
)
def g5b(spark, sf_dir):
    """The radius alone: it comes from all points, whatever the sample."""
    return rounded(N.suggest_radius(_cells(spark, sf_dir), n=50).select("radius"), ["radius"])


@query(
    "G6_degree_stats",
    f"WITH {_RAD}, e AS (SELECT src AS id FROM rad UNION ALL SELECT dst FROM rad), g AS (SELECT points.id, count(e.id) AS degree FROM points LEFT JOIN e ON e.id = points.id GROUP BY 1) "
    f"SELECT count(*) AS n, min(degree) AS min, {rs('avg(degree)')} AS mean, max(degree) AS max, count(*) FILTER (WHERE degree = 0) AS n_isolated, "
    "quantile_cont(degree, 0.25)::DOUBLE AS q1, median(degree)::DOUBLE AS median, quantile_cont(degree, 0.75)::DOUBLE AS q3 FROM g",
)
def g6(spark, sf_dir):
    return rounded(N.degree_summary(N.radius_degrees(R.points(spark, sf_dir), _R)), ["mean"])


@query(
    "G7_trim_edges",
    f"WITH {R.POINTS_SQL}, e AS (SELECT a.id AS src, b.id AS dst, {_DIST} AS w FROM points a JOIN points b ON b.id = a.id // 2 WHERE a.id > 0) SELECT src, dst, {rs('w')} AS w FROM e WHERE w <= 900",
)
def g7(spark, sf_dir):
    p = R.points(spark, sf_dir)
    tree = p.where("id > 0").select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"))
    return rounded(N.trim_edges(tree, p, 900.0), ["w"])


def _turn(a, b, c):
    return f"sign(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


_A, _B, _S1, _S2 = ("a.x", "a.y"), ("b.x", "b.y"), ("s.x1", "s.y1"), ("s.x2", "s.y2")
_CROSS = f"{_turn(_S1, _S2, _A)} * {_turn(_S1, _S2, _B)} < 0 AND {_turn(_A, _B, _S1)} * {_turn(_A, _B, _S2)} < 0"


@query(
    "G8_domain_graph",
    f"WITH {_CELLS}, {_knn_sql(6)}, {_UND}, {vertices_sql(CELL_RINGS)}, "
    f"x AS (SELECT DISTINCT u.src, u.dst FROM und u JOIN c a ON a.id = u.src JOIN c b ON b.id = u.dst CROSS JOIN segs s WHERE {_CROSS}) "
    f"SELECT src, dst, {rs('d')} AS d FROM und WHERE (src, dst) NOT IN (SELECT (src, dst) FROM x)",
)
def g8(spark, sf_dir):
    g = N.domain_graph(_cells(spark, sf_dir), readers.read_boundary(vertices(spark, CELL_RINGS)), 6)
    return g.select("src", "dst", r("d"))


@query(
    "J16_drop_crossing_edges",
    f"WITH {_RAD}, {vertices_sql()}, x AS (SELECT DISTINCT u.src, u.dst FROM rad u JOIN points a ON a.id = u.src JOIN points b ON b.id = u.dst CROSS JOIN segs s WHERE {_CROSS}) "
    "SELECT src, dst FROM rad ANTI JOIN x USING (src, dst)",
)
def j16(spark, sf_dir):
    return N.radius_graph_inside(R.points(spark, sf_dir), readers.read_boundary(vertices(spark)), _R).select("src", "dst")


@query(
    "G9_penalize",
    f"WITH {_RAD}, m AS (SELECT max(d) + 1 AS pen FROM rad) SELECT src, dst, {rs('d + CASE WHEN a.label <> b.label THEN pen ELSE 0 END')} AS pen_w FROM rad JOIN points a ON a.id = src JOIN points b ON b.id = dst CROSS JOIN m",
)
def g9(spark, sf_dir):
    p = R.points(spark, sf_dir)
    e = N.radius_graph(p, _R, carry=["label"]).withColumnRenamed("d", "w")
    return N.penalize(e, p, longest=N.longest_edge(p, _R)).select("src", "dst", r("pen_w"))


@query(
    "G10_edge_status",
    f"WITH {_RAD} SELECT src, dst, CASE WHEN a.label = b.label THEN 'w' ELSE 'b' END AS status FROM rad JOIN points a ON a.id = src JOIN points b ON b.id = dst",
)
def g10(spark, sf_dir):
    p = R.points(spark, sf_dir)
    return N.edge_status(N.radius_graph(p, _R, carry=["label"]), p).select("src", "dst", "status")


@query("G11_connected_components", f"WITH RECURSIVE {_RAD}, {_closure_sql('rad', 'points')} SELECT id, component FROM cc")
def g11(spark, sf_dir):
    return G.radius_components(R.points(spark, sf_dir), _R)


_SAME_EDGES = "same AS (SELECT src, dst FROM rad JOIN points a ON a.id = src JOIN points b ON b.id = dst WHERE a.label = b.label)"


@query("G12_spatial_components", f"WITH RECURSIVE {_RAD}, {_SAME_EDGES}, {_closure_sql('same', 'points')} SELECT id, component FROM cc")
def g12(spark, sf_dir):
    return G.radius_components(R.points(spark, sf_dir), _R, "label")


def _cell_graph(spark, sf_dir, k: int = 6):
    c = _cells(spark, sf_dir)
    return c, cut_lineage(N.with_eid(N.undirected(N.knn(c, k)).withColumnRenamed("d", "w")))


# Kruskal, one edge per recursion step: the state is the component of every vertex (ids are 0..n-1).
_KRUSKAL = (
    "eo AS (SELECT row_number() OVER (ORDER BY d, src, dst) AS rn, src, dst, d FROM und), "
    "kr(rn, comp, used) AS (SELECT 0::BIGINT, (SELECT list(id ORDER BY id) FROM c), false UNION ALL "
    "SELECT eo.rn, CASE WHEN comp[src + 1] = comp[dst + 1] THEN comp ELSE list_transform(comp, lambda v: CASE WHEN v = comp[dst + 1] THEN comp[src + 1] ELSE v END) END, "
    "comp[src + 1] <> comp[dst + 1] FROM kr JOIN eo ON eo.rn = kr.rn + 1), "
    "tree AS (SELECT src, dst, d FROM eo JOIN kr USING (rn) WHERE used)"
)


@query("G13_mst", f"WITH RECURSIVE {_CELLS}, {_knn_sql(6)}, {_UND}, {_KRUSKAL} SELECT src, dst, {rs('d')} AS w FROM tree")
def g13(spark, sf_dir):
    _, e = _cell_graph(spark, sf_dir)
    return G.mst(e).select("src", "dst", r("w"))


@query(
    "G13_mst_points",
    f"WITH RECURSIVE {_RAD}, {_closure_sql('rad', 'points')} SELECT count(*) - count(DISTINCT component) AS n_edges FROM cc",
)
def g13b(spark, sf_dir):
    """Spanning forest of all points: vertices minus components edges."""
    return G.radius_forest(R.points(spark, sf_dir), _R).agg(F.count(F.lit(1)).alias("n_edges"))


@query("G14_bridge_components")
def g14(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return G.bridge_components(N.mutual_knn(c, 3), c)


@query("G15_merge_small_components")
def g15(spark, sf_dir):
    c, e = _cell_graph(spark, sf_dir)
    pieces = G.spatial_components(e, c).select("id", F.col("component").alias("label"))
    return G.merge_small_components(G.mst(e), pieces, 5)


_SMALL_TARGETS = (
    f"{_RAD}, {_SAME_EDGES}, {_closure_sql('same', 'points')}, "
    "cp AS (SELECT component, label, count(*) AS n, avg(x) AS x, avg(y) AS y FROM cc JOIN points USING (id) GROUP BY 1, 2), "
    f"big AS (SELECT a.component, b.component AS target, row_number() OVER (PARTITION BY a.component ORDER BY round({_DIST}, 9), b.component) AS rn FROM cp a JOIN cp b ON a.label = b.label AND a.component <> b.component AND (b.n >= 3 OR a.label NOT IN (SELECT label FROM cp WHERE n >= 3)) WHERE a.n < 3)"
)


def _pieces(spark, sf_dir):
    p = R.points(spark, sf_dir)
    return p, G.radius_components(p, _R, "label").join(p, "id")


@query("G16_same_label_targets", f"WITH RECURSIVE {_SMALL_TARGETS} SELECT component, target FROM big WHERE rn = 1")
def g16(spark, sf_dir):
    _, m = _pieces(spark, sf_dir)
    comps = m.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return G.same_label_targets(cut_lineage(comps), 3)


@query(
    "G16_merge_small_same_label",
    f"WITH RECURSIVE {_SMALL_TARGETS}, tg AS (SELECT component AS src, target AS dst FROM big WHERE rn = 1), "
    "steps AS (SELECT src AS a, dst AS b FROM tg UNION ALL SELECT dst, src FROM tg), "
    "joined(id, rep) AS (SELECT component, component FROM cp UNION SELECT steps.b, joined.rep FROM joined JOIN steps ON steps.a = joined.id WHERE joined.rep < steps.b), "
    "top AS (SELECT id, min(rep) AS component FROM joined GROUP BY 1) SELECT cc.id, top.component FROM cc JOIN top ON top.id = cc.component",
)
def g16b(spark, sf_dir):
    """Pieces of a label with fewer than three points move to the nearest large one of their label."""
    p, m = _pieces(spark, sf_dir)
    return G.merge_small_same_label(cut_lineage(m.select("id", "component", "label")), p, 3)


def _heap_tree(df):
    """The tree id -> id // 2 over dense ids; the edge is named by its lower end."""
    return df.where("id > 0").select(F.col("id").alias("eid"), F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"))


@query(
    "G17_cut_tree",
    f"WITH RECURSIVE {R.POINTS_SQL}, e AS (SELECT id AS src, id // 2 AS dst FROM points WHERE id > 0 AND id % 7 <> 0), "
    "up(id, top) AS (SELECT id, id FROM points UNION ALL SELECT up.id, e.dst FROM up JOIN e ON e.src = up.top) SELECT id, min(top) AS component FROM up GROUP BY 1",
)
def g17(spark, sf_dir):
    p = R.points(spark, sf_dir)
    cuts = p.where("id % 7 = 0").select(F.col("id").alias("eid"))
    return G.cut_tree(_heap_tree(p), cuts, p)


@query("G18_random_mst")
def g18(spark, sf_dir):
    c, e = _cell_graph(spark, sf_dir)
    return G.random_mst(e, c, seed=7).select("eid", "src", "dst", "w")


_GEO = (
    "marks AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY label ORDER BY x, id) AS rn FROM c) WHERE rn = 1), "
    "arcs AS (SELECT src AS a, dst AS b, d AS w FROM und UNION ALL SELECT dst, src, d FROM und UNION ALL SELECT id, id, 0 FROM c), "
    "bf(it, source, id, d) AS (SELECT 0, id, id, 0.0::DOUBLE FROM marks UNION ALL "
    "SELECT bf.it + 1, bf.source, arcs.b, min(bf.d + arcs.w) FROM bf JOIN arcs ON arcs.a = bf.id WHERE bf.it < 150 GROUP BY 1, 2, 3), "
    "fin AS (SELECT source, id, d FROM bf WHERE it = 150), "
    "geo AS (SELECT s.source, c.id, coalesce(f.d, (SELECT max(d) * 2 FROM fin)) AS d FROM c CROSS JOIN (SELECT DISTINCT source FROM fin) s LEFT JOIN fin f ON f.source = s.source AND f.id = c.id)"
)


def _landmarks(c):
    """One landmark a label: its leftmost cell."""
    return c.groupBy("label").agg(F.min_by("id", F.struct("x", "id")).alias("id")).select("id")


@query("G19_geodesic", f"WITH RECURSIVE {_CELLS}, {_knn_sql(6)}, {_UND}, {_GEO} SELECT source, id, {rs('d')} AS d FROM geo")
def g19(spark, sf_dir):
    c, e = _cell_graph(spark, sf_dir)
    return rounded(G.geodesic(e, _landmarks(c), c), ["d"])


_FD = " + ".join(f"(a.pcs[{i}] - b.pcs[{i}]) * (a.pcs[{i}] - b.pcs[{i}])" for i in range(1, 11))


@query(
    "G20_geodesic_assign",
    f"WITH RECURSIVE {_CELLS}, {_knn_sql(6)}, {_UND}, {_GEO}, bl AS (SELECT geo.id, source, d * 0.5 + sqrt({_FD}) * 0.5 AS blended FROM geo JOIN c a ON a.id = geo.id JOIN c b ON b.id = source) "
    f"SELECT id, source, {rs('blended')} AS blended FROM bl QUALIFY row_number() OVER (PARTITION BY id ORDER BY blended, source) = 1",
)
def g20(spark, sf_dir):
    c, e = _cell_graph(spark, sf_dir)
    return rounded(G.geodesic_assign(G.geodesic(e, _landmarks(c), c), c), ["blended"])


@query(
    "G21_refine_labels",
    f"WITH {_CELLS.replace('annotation AS label', 'annotation % 3 AS label')}, {_knn_sql(6)}, v AS (SELECT src AS id, label FROM knn JOIN c ON c.id = dst UNION ALL SELECT id, label FROM c), "
    "n AS (SELECT id, label, count(*) AS n FROM v GROUP BY 1, 2), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1) "
    "SELECT c.id, c.label, CASE WHEN n.n < 3 AND b.n > 3 THEN b.label ELSE c.label END AS refined FROM c JOIN n ON n.id = c.id AND n.label = c.label JOIN b ON b.id = c.id",
)
def g21(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("label", F.col("label") % 3)
    return N.refine_labels(c, N.knn(c, 6), 6)


@query("G22_kernel_weights", f"WITH {_RAD} SELECT src, dst, {rs('exp(-(d * d) / (2 * 9.0::DOUBLE))')} AS weight FROM rad")
def g22(spark, sf_dir):
    return N.radius_graph(R.points(spark, sf_dir), _R, value=lambda d: r(N.kernel_weight(d, 3.0))).withColumnRenamed("d", "weight")


@query("G22_search_length")
def g22b(spark, sf_dir):
    """NULL where no length meets the target, as where every point has copies."""
    p = R.points(spark, sf_dir)
    try:
        if N.repeated_ids(N.locations(p)).isEmpty():
            length, share = N.search_length(
                N.radius_distances(p, 12.0), p.count(), 0.5, count="n", shorter=lambda d: N.radius_distances(p, d), extent=lambda d: N.radius_extent(p, d), r=12.0
            )
        else:
            length, share = N.search_length(N.radius_distances(p, 12.0), p.count(), 0.5, count="n")
    except N.NoLength:
        length = share = None
    return spark.createDataFrame([(length, share)], "length double, contribution double")


@query(
    "G23_smooth_features",
    f"WITH {_CELLS}, {_knn_sql(6)} SELECT src AS id, " + ", ".join(f"{rs(f'avg(b.pcs[{i}])')} AS s{i}" for i in (1, 2, 3)) + " FROM knn JOIN c b ON b.id = dst GROUP BY 1",
)
def g23(spark, sf_dir):
    c = _cells(spark, sf_dir)
    s = N.smooth_features(c, N.knn(c, 6), 3)
    return s.select("id", *[r(F.col("smoothed")[i], name=f"s{i + 1}") for i in range(3)])


@query(
    "G24_knn_predict",
    f"WITH {_CELLS}, {_PLACES}, k AS (SELECT a.id, b.pcs[1] AS v, {_DIST} AS d FROM places a CROSS JOIN c b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) <= 5), "
    "w AS (SELECT id, v, 1.0 / CASE WHEN d = 0 THEN 1e-9::DOUBLE ELSE d END AS w FROM k) "
    f"SELECT id, {rs('sum(v * w) / sum(w)')} AS predicted FROM w GROUP BY 1",
)
def g24(spark, sf_dir):
    train = _cells(spark, sf_dir).select("id", "x", "y", F.col("pcs")[0].alias("value"))
    return rounded(N.knn_predict(train, _places(spark, sf_dir), 5, "distance"), ["predicted"])


_SPOTS = "spots AS (SELECT p_partkey AS id, p_partkey // 50 AS row, (p_partkey % 50) * 2 + (p_partkey // 50) % 2 AS col FROM part)"


def _spots(spark, sf_dir):
    row = F.floor(F.col("p_partkey") / 50)
    return R.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), row.alias("row"), ((F.col("p_partkey") % 50) * 2 + row % 2).alias("col")
    )


@query(
    "G26_lattice_hex",
    f"WITH {_SPOTS} SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM spots a JOIN spots b ON (b.row = a.row AND b.col = a.col + 2) OR (b.row = a.row + 1 AND b.col IN (a.col + 1, a.col - 1))",
)
def g26(spark, sf_dir):
    return N.lattice_edges(_spots(spark, sf_dir), "hex")


@query(
    "G26_lattice_square",
    "WITH spots AS (SELECT p_partkey AS id, p_partkey // 50 AS row, p_partkey % 50 AS col FROM part) "
    "SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM spots a JOIN spots b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)",
)
def g26b(spark, sf_dir):
    spots = R.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col")
    )
    return N.lattice_edges(spots, "square")
