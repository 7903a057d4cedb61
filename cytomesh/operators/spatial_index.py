"""Exact nearest-neighbour search on an adaptive grid.

The plane is cut into quadtree leaves of bounded size, so a dense spot becomes many leaves instead of one
heavy task. A search runs in two rounds: inside the own leaf, which yields a radius, and then only in the
leaves that the radius reaches. Points at one location are collapsed to the few ids that can ever be
among the k nearest, so even a location that holds a third of all points costs one candidate list.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytomesh.functions.kernels import smallest_k
from cytomesh.operators.core import cut_lineage, keyed_join, top_k_per_group, union_all

DEPTH = 50  # levels of the finest grid
LEAF_ROWS = 512  # a leaf is split while it holds more
LEAVES_PER_TASK = 32  # query leaves that one group of the second round may receive
SLACK = 1 + 1e-9  # radii are widened by this before comparing
KEY = ["realm", "lv", "cx", "cy"]


def _parent(c: str, steps) -> Column:
    return F.expr(f"shiftright({c}, cast({steps} as int))")


def _tasks(df: DataFrame) -> int:
    """Partitions for the numeric kernels; adaptive coalescing looks at bytes and would put them in one task."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def assign_leaves(rows: DataFrame, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, float, float, float]:
    """Adds the leaf key (lv, cx, cy) to rows with (realm, x, y); returns the rows and the grid's side and corner."""
    ext = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    ).first()
    if ext["n"] == 0:
        return rows.withColumns({"lv": F.lit(0), "cx": F.lit(0).cast("bigint"), "cy": F.lit(0).cast("bigint")}), 1.0, 0.0, 0.0
    span = max(ext["x1"] - ext["x0"], ext["y1"] - ext["y0"]) * (1 + 1e-12) or 1.0
    top = 2**DEPTH - 1

    def fine(c: str, lo: float) -> Column:
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(span) * F.lit(float(2**DEPTH))), F.lit(top)).cast("bigint")

    rest = rows.withColumns({"_ix": fine("x", ext["x0"]), "_iy": fine("y", ext["y0"])})
    short = max(min(ext["x1"] - ext["x0"], ext["y1"] - ext["y0"]), span / 256)
    level = min(DEPTH, max(0, math.ceil(math.log(max(ext["n"] / (leaf_rows / 2) * span / short, 1), 4))))
    parts = []
    while True:
        up = DEPTH - level
        keyed = rest.withColumns(
            {"lv": F.lit(level), "cx": F.shiftright("_ix", up), "cy": F.shiftright("_iy", up)}
        )
        if level == DEPTH:
            parts.append(keyed)
            break
        width = F.greatest(F.max("_ix") - F.min("_ix"), F.max("_iy") - F.min("_iy"))
        size = keyed.groupBy("realm", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), width.alias("width"))
        heavy = size.where(F.col("n") > leaf_rows).select("realm", "cx", "cy", "width", F.lit(True).alias("_heavy"))
        widest = heavy.agg(F.max("width")).first()[0]
        if widest is None:
            parts.append(keyed)
            break
        heavy = heavy.drop("width")
        flagged = cut_lineage(keyed_join(keyed, heavy, ["realm", "cx", "cy"], "left"))
        parts.append(flagged.where(F.col("_heavy").isNull()).drop("_heavy"))
        rest = flagged.where("_heavy").drop("_heavy", "lv", "cx", "cy")
        # far outliers leave everything else in one small spot: go on at the level that begins to part it
        level = min(DEPTH, max(level + 2, DEPTH - int(widest).bit_length() + 1))
    return union_all(parts).drop("_ix", "_iy"), span, ext["x0"], ext["y0"]


def _leaf_stats(tree: DataFrame, need: int, foreign: bool, span: float) -> DataFrame:
    """Per leaf: box of its candidates and a radius within which every query of the leaf surely finds enough."""
    cx = F.when(F.col("is_c"), F.col("x"))
    cy = F.when(F.col("is_c"), F.col("y"))
    lab = F.when(F.col("is_c"), F.col("lab"))
    leaf = tree.groupBy(*KEY).agg(
        F.count_if("is_c").alias("nc"),
        F.min(cx).alias("bx0"), F.max(cx).alias("bx1"), F.min(cy).alias("by0"), F.max(cy).alias("by1"),
        F.min(lab).alias("lo"), F.max(lab).alias("hi"),
        F.max(F.col("is_q")).alias("has_q"),
    )

    def enough(df_lo="lo", df_hi="hi", df_n="nc") -> Column:
        return (F.col(df_lo) != F.col(df_hi)) if foreign else (F.col(df_n) >= need)

    leaf = leaf.withColumn("ok", F.coalesce(enough(), F.lit(False)))
    lacking = leaf.where(~F.col("ok") & F.col("has_q"))
    levels = F.sequence(F.lit(0), F.col("lv"))
    anc = leaf.select("realm", "nc", "lo", "hi", "lv", "cx", "cy", F.explode(levels).alias("al")).select(
        "realm", "al", _parent("cx", "lv - al").alias("ax"), _parent("cy", "lv - al").alias("ay"), "nc", "lo", "hi"
    )
    anc = (
        anc.groupBy("realm", "al", "ax", "ay")
        .agg(F.sum("nc").alias("nc"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .where(enough())
        .select("realm", "al", "ax", "ay")
    )
    climb = lacking.select(*KEY, F.explode(levels).alias("al")).select(
        *KEY, "al", _parent("cx", "lv - al").alias("ax"), _parent("cy", "lv - al").alias("ay")
    )
    found = keyed_join(climb, anc, ["realm", "al", "ax", "ay"]).groupBy(*KEY).agg(F.max("al").alias("al"))
    level = F.when(F.col("ok"), F.col("lv")).otherwise(F.col("al"))
    bound = F.lit(span * math.sqrt(2) * SLACK) / F.pow(F.lit(2.0), level)
    return leaf.join(found, KEY, "left").select(
        *KEY, "nc", "bx0", "bx1", "by0", "by1", F.coalesce(bound, F.lit(float("inf"))).alias("bound")
    )


def _reached_leaves(local: DataFrame, stats: DataFrame, span: float, x0: float, y0: float) -> DataFrame:
    """(query leaf, other leaf) pairs whose boxes are within the query leaf's largest radius.

    A box is covered by at most four grid cells of matching size; leaves below those cells carry the cell
    among their ancestors, leaves above them are ancestors of the cell. Both become equality joins.
    """
    q = local.groupBy(*KEY).agg(
        F.max("radius").alias("rad"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    r = F.col("rad") * SLACK
    q = q.select(
        "realm", *[F.col(c).alias(f"q{c}") for c in ("lv", "cx", "cy")],
        (F.col("x0") - r).alias("qx0"), (F.col("x1") + r).alias("qx1"), (F.col("y0") - r).alias("qy0"), (F.col("y1") + r).alias("qy1"),
    )
    extent = F.greatest(F.col("qx1") - F.col("qx0"), F.col("qy1") - F.col("qy0"))
    # a leaf of one location whose neighbours are all copies has no extent
    fine = F.least(F.log2(F.lit(span) / F.nullif(extent, F.lit(0.0))), F.lit(float(DEPTH)))
    lvl = F.when(extent >= span, 0).when(extent <= 0, DEPTH).otherwise(F.floor(fine)).cast("int")
    q = q.withColumn("cl", lvl)
    cells = F.pow(F.lit(2.0), F.col("cl"))

    def cell(c: Column, lo: float) -> Column:
        pos = F.floor(F.least(F.greatest((c - F.lit(lo)) / F.lit(span), F.lit(0.0)), F.lit(1.0)) * cells)
        return F.least(pos, cells - 1).cast("bigint")

    q = q.withColumn("kx", F.explode(F.sequence(cell(F.col("qx0"), x0), cell(F.col("qx1"), x0)))).withColumn(
        "ky", F.explode(F.sequence(cell(F.col("qy0"), y0), cell(F.col("qy1"), y0)))
    )
    t = stats.where(F.col("nc") > 0).select(
        "realm", *[F.col(c).alias(f"t{c}") for c in ("lv", "cx", "cy")], "bx0", "bx1", "by0", "by1"
    )
    below_t = t.withColumn("cl", F.explode(F.sequence(F.lit(0), F.col("tlv")))).withColumns(
        {"kx": _parent("tcx", "tlv - cl"), "ky": _parent("tcy", "tlv - cl")}
    )
    below = q.join(below_t, ["realm", "cl", "kx", "ky"])
    above_q = q.where(F.col("cl") > 0).withColumn("al", F.explode(F.sequence(F.lit(0), F.col("cl") - 1)))
    above_q = above_q.withColumns({"kx": _parent("kx", "cl - al"), "ky": _parent("ky", "cl - al")}).drop("cl")
    above_t = t.withColumns({"al": F.col("tlv"), "kx": F.col("tcx"), "ky": F.col("tcy")})
    above = above_q.join(above_t, ["realm", "al", "kx", "ky"])
    cols = ["realm", "qlv", "qcx", "qcy", "tlv", "tcx", "tcy", "bx0", "bx1", "by0", "by1", "qx0", "qx1", "qy0", "qy1"]
    near = union_all([below.select(*cols), above.select(*cols)]).where(
        (F.col("bx0") <= F.col("qx1")) & (F.col("bx1") >= F.col("qx0")) & (F.col("by0") <= F.col("qy1")) & (F.col("by1") >= F.col("qy0"))
        & ~((F.col("qlv") == F.col("tlv")) & (F.col("qcx") == F.col("tcx")) & (F.col("qcy") == F.col("tcy")))
    )
    return near.select(*cols[:11]).distinct()


def _nearest(qx, qy, qlab, radius, cx, cy, cid, clab, need: int, foreign: bool):
    """Flat result: query position, neighbour id, distance (NaN when there is none), the query's new radius.

    Candidates farther than the radius are left out. A query that finds none keeps one row without neighbour.
    """
    parts = []
    step = max(1, 4_000_000 // max(len(cid), 1))
    for a in range(0, len(qx), step):
        rows = np.arange(a, min(a + step, len(qx)))
        rad = radius[rows].astype(float)
        if len(cid) == 0:
            parts.append((rows, np.zeros(len(rows), dtype=cid.dtype), np.full(len(rows), np.nan), rad))
            continue
        dx, dy = qx[rows, None] - cx[None, :], qy[rows, None] - cy[None, :]
        d = np.sqrt(dx * dx + dy * dy)
        if foreign:
            d[qlab[rows, None] == clab[None, :]] = np.inf
        pick = smallest_k(d, cid, need)
        dist = np.take_along_axis(d, pick, 1)
        ok = np.isfinite(dist) & (dist <= rad[:, None] * SLACK)
        if dist.shape[1] >= need:
            rad = np.minimum(rad, np.where(ok[:, need - 1], dist[:, need - 1], np.inf))
        none = ~ok.any(1)
        ok[none, 0] = True
        r, c = np.nonzero(ok)
        parts.append((rows[r], cid[pick[r, c]], np.where(none[r], np.nan, dist[r, c]), rad[r]))
    return [np.concatenate(v) for v in zip(*parts)]


def _search_groups(df: DataFrame, spread: Sequence[str], keys: Sequence[str], out: Sequence[str], id_type: str, need: int, foreign: bool) -> DataFrame:
    """Run the kernel on every group of ``keys``; a group holds candidate rows (is_c) and query rows (is_q, radius).

    Rows are partitioned by ``spread`` and sorted by group, so one Python call walks through many small groups
    of an Arrow batch instead of paying the start of a call per group. A group may continue in the next batch.
    """
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = {c: pdf[c].to_numpy() for c in ("x", "y", "lab", "qlab", "radius")}
        ids, is_c, is_q = pdf["id"].to_numpy(), pdf["is_c"].to_numpy(bool), pdf["is_q"].to_numpy(bool)
        change = np.zeros(len(pdf), dtype=bool)
        for k in names:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [len(pdf)]])
        found = []
        for a, b in zip(starts[:-1], starts[1:]):
            q, c = a + np.flatnonzero(is_q[a:b]), a + np.flatnonzero(is_c[a:b])
            if len(q):
                cid = ids[c].astype(np.int64) if id_type in ("bigint", "int") else ids[c]
                res = _nearest(
                    cols["x"][q], cols["y"][q], cols["qlab"][q], cols["radius"][q],
                    cols["x"][c], cols["y"][c], cid, cols["lab"][c], need, foreign,
                )
                res[0] = q[res[0]]
                found.append(res)
        if not found:
            return pd.DataFrame(columns=[*out, "nid", "nd", "radius"])
        pos, nid, nd, rad = (np.concatenate(v) for v in zip(*found))
        res = pdf.iloc[pos][list(out)].reset_index(drop=True)
        res["nid"], res["nd"], res["radius"] = nid, nd, rad
        return res

    def kernel(batches):
        rest = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = np.ones(len(pdf), dtype=bool)
            for k in names:
                v = pdf[k].to_numpy()
                last &= v == v[-1]
            cut = len(pdf) - int(last.sum())
            if cut:
                yield run(pdf.iloc[:cut])
            rest = pdf.iloc[cut:]
        if rest is not None and len(rest):
            yield run(rest)

    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in out) + f", nid {id_type}, nd double, radius double"
    placed = df.repartition(_tasks(df), *spread).sortWithinPartitions(*names)
    return placed.mapInPandas(kernel, schema)


def search(rows: DataFrame, need: int, foreign: bool = False, id_type: str = "bigint", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The core search. ``rows``: realm, x, y, is_c, id, lab (candidates), is_q, qlab (queries).

    Returns realm, x, y, qlab, near = array of (d, id), at most ``need`` entries in (distance, id) order.
    """
    tree, span, x0, y0 = assign_leaves(rows, leaf_rows)
    tree = cut_lineage(tree)
    stats = cut_lineage(_leaf_stats(tree, need, foreign, span))
    with_bound = tree.join(stats.select(*KEY, F.col("bound").alias("radius")), KEY)
    local = cut_lineage(
        _search_groups(with_bound, KEY[1:], KEY, ["realm", "x", "y", "qlab", *KEY[1:]], id_type, need, foreign)
    )

    pairs = _reached_leaves(local, stats, span, x0, y0)
    target = ["realm", "tlv", "tcx", "tcy"]
    lot = F.floor((F.row_number().over(W.partitionBy(*target).orderBy("qlv", "qcx", "qcy")) - 1) / LEAVES_PER_TASK)
    pairs = cut_lineage(pairs.withColumn("lot", lot.cast("int")))
    gap_x = F.greatest(F.col("bx0") - F.col("x"), F.col("x") - F.col("bx1"), F.lit(0.0))
    gap_y = F.greatest(F.col("by0") - F.col("y"), F.col("y") - F.col("by1"), F.lit(0.0))
    group = [*target, "lot"]
    queries = local.groupBy("realm", "x", "y", "qlab", *[F.col(c).alias(f"q{c}") for c in KEY[1:]]).agg(F.min("radius").alias("radius"))
    asking = queries.join(pairs, ["realm", "qlv", "qcx", "qcy"]).where(
        F.sqrt(gap_x * gap_x + gap_y * gap_y) <= F.col("radius") * SLACK
    )
    offered = tree.where("is_c").select(
        "realm", "x", "y", "id", "lab", *[F.col(c).alias(f"t{c}") for c in KEY[1:]]
    ).join(pairs.select(*group).distinct(), target)
    no_id, no_lab = F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("bigint")
    second = asking.select(
        *group, "x", "y", no_id, no_lab.alias("lab"), "qlab", "radius", F.lit(False).alias("is_c"), F.lit(True).alias("is_q")
    ).unionByName(
        offered.select(
            *group, "x", "y", "id", "lab", no_lab.alias("qlab"), F.lit(None).cast("double").alias("radius"),
            F.lit(True).alias("is_c"), F.lit(False).alias("is_q"),
        )
    )
    remote = _search_groups(second, group[1:], group, ["realm", "x", "y", "qlab"], id_type, need, foreign)
    cols = ["realm", "x", "y", "qlab", "nid", "nd"]
    both = local.select(*cols).unionByName(remote.select(*cols)).where(F.col("nd").isNotNull() & ~F.isnan("nd"))
    # each leaf that was reached brings at most `need` entries
    merged = both.groupBy("realm", "x", "y", "qlab").agg(
        F.sort_array(F.collect_list(F.struct(F.col("nd").alias("d"), F.col("nid").alias("id")))).alias("z")
    )
    return merged.select("realm", "x", "y", "qlab", F.slice("z", 1, need).alias("near"))


def _locations(points: DataFrame, keep: int) -> DataFrame:
    """At each location the rows with the ``keep`` smallest ids; ``rk`` 1 is the first."""
    return top_k_per_group(points, ["realm", "x", "y"], [F.asc("id")], keep)


def knn_join(
    queries: DataFrame | None,
    candidates: DataFrame,
    k: int,
    realm: str | None = None,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """src, dst, d, rk: the k nearest candidates of every query, smaller id first among equal distances.

    Without ``queries`` the candidates query each other and a point is never its own neighbour. With ``realm``
    (a column of both sides) only candidates of the same realm count.
    """
    self_join = queries is None
    need = k + 1 if self_join else k
    tag = F.col(realm).cast("string") if realm else F.lit("")
    pos = [F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    cand = candidates.select(tag.alias("realm"), "id", *pos)
    asks = cand if self_join else queries.select(tag.alias("realm"), "id", *pos)
    id_type = dict(cand.dtypes)["id"]
    places = _locations(cand, need)
    rows = places.select("realm", "x", "y", "id", F.lit(True).alias("is_c"), (F.lit(self_join) & (F.col("rk") == 1)).alias("is_q"))
    if not self_join:
        spots = asks.select("realm", "x", "y").distinct()
        rows = rows.unionByName(
            spots.select("realm", "x", "y", F.lit(None).cast(id_type).alias("id"), F.lit(False).alias("is_c"), F.lit(True).alias("is_q"))
        )
    rows = rows.withColumns({"lab": F.lit(0).cast("bigint"), "qlab": F.lit(0).cast("bigint")})
    near = search(rows, need, id_type=id_type, leaf_rows=leaf_rows).drop("qlab")
    out = keyed_join(asks.withColumnRenamed("id", "src"), near, ["realm", "x", "y"])
    picked = F.filter("near", lambda e: e["id"] != F.col("src")) if self_join else F.col("near")
    return out.select("src", F.posexplode(F.slice(picked, 1, k)).alias("pos", "e")).select(
        "src", F.col("e.id").alias("dst"), F.col("e.d").alias("d"), (F.col("pos") + 1).alias("rk")
    )


def kth_distances(points: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """d, n: the distance from a point to the k-th of all others, and how many points have it. Rows may repeat a distance.

    All points of a place have the same one, so a place asks once; one with more than k points need not ask.
    """
    pos = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    placed = points.select(F.lit("").alias("realm"), "id", *pos).where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    here = F.count(F.lit(1)).over(W.partitionBy("realm", "x", "y"))
    places = cut_lineage(_locations(placed, k + 1).withColumn("qlab", here))
    asks = (F.col("rk") == 1) & (F.col("qlab") <= k)
    asking = places.where(asks).agg(F.count(F.lit(1)), F.coalesce(F.sum("qlab"), F.lit(0))).first()
    crowded = placed.agg((F.count(F.lit(1)) - asking[1]).alias("n")).where("n > 0").select(F.lit(0.0).alias("d"), "n")
    if not asking[0]:
        return crowded
    rows = places.select("realm", "x", "y", "id", F.lit(True).alias("is_c"), asks.alias("is_q"), F.lit(0).cast("bigint").alias("lab"), "qlab")
    near = search(rows, k + 1, id_type=dict(placed.dtypes)["id"], leaf_rows=leaf_rows).where(F.size("near") > k)
    return crowded.unionByName(near.select(F.col("near")[k]["d"].alias("d"), F.col("qlab").alias("n")))


def nearest_foreign(
    points: DataFrame, asking: DataFrame | None = None, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """label, src, dst, d: for every label group the closest pair to a point of another group.

    ``points``: id, x, y, label (integers). ``asking(label)`` limits the groups that look for a partner.
    """
    p = points.select(F.lit("").alias("realm"), "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("label").cast("bigint").alias("qlab"))
    unit = p.groupBy("realm", "x", "y", "qlab").agg(F.min("id").alias("id"))
    ask = unit if asking is None else keyed_join(unit, asking.select(F.col("label").cast("bigint").alias("qlab")).distinct(), ["qlab"])
    id_type = dict(unit.dtypes)["id"]
    best = F.min(F.struct("d", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src", "dst")).alias("m")
    # two different labels per location are enough to serve any asking label
    two = top_k_per_group(unit, ["realm", "x", "y"], [F.asc("id")], 2)
    places = two.select(
        "realm", "x", "y", "id", F.col("qlab").alias("lab"), F.lit(True).alias("is_c"), F.lit(False).alias("is_q"), F.lit(None).cast("bigint").alias("qlab"),
    )
    ask_rows = ask.select(
        "realm", "x", "y", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("bigint").alias("lab"),
        F.lit(False).alias("is_c"), F.lit(True).alias("is_q"), "qlab",
    )
    near = search(places.unionByName(ask_rows), 1, foreign=True, id_type=id_type, leaf_rows=leaf_rows).where(F.size("near") > 0)
    own = near.join(unit, ["realm", "x", "y", "qlab"]).select(
        F.col("qlab").alias("label"), F.col("id").alias("src"), F.col("near")[0]["id"].alias("dst"), F.col("near")[0]["d"].alias("d")
    )
    return own.groupBy("label").agg(best).select("label", "m.src", "m.dst", "m.d")


__all__: Sequence[str] = ["assign_leaves", "search", "knn_join", "kth_distances", "nearest_foreign"]
