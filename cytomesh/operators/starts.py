"""Lloyd's algorithm and expectation-maximisation over many starts at once, for one table or for every group of it.

Rows are packed once into blocks of bounded size. A round reads every block once for all runs (a run is one start with its
number of clusters and components): a task adds up what each run needs of its blocks, sums meet by (group, run, cluster),
and the few numbers of every run are updated. Runs that have settled take no more work. No group gathers anywhere, so a
hot one is only more blocks.

Seeding is oversampled: each pass draws a fixed number of rows per run with chances proportional to their squared distance
from those drawn before (the smallest of exponential variates from the hash of key and seed), weighs them by the rows
that are nearest to them, and reduces them to k by weighted k-means++.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytomesh.operators.core import cut_lineage, drop_table, null_safe_join, top_k_per_group
from cytomesh.operators.forest import array_sum

BLOCK_ROWS = 8192
#: Numbers of a group that one task may hold, and numbers times starts that one task takes through all rounds.
LOCAL_NUMBERS = 1 << 20
LOCAL_WORK = 1 << 21
#: Numbers of the centres of all runs that are handed out together.
STATE_NUMBERS = 1 << 20
#: Seeding passes, and rows drawn in each as a multiple of the number of clusters.
SEED_PASSES, OVERSAMPLE = 3, 2
#: A centre that moves by less than this share of its length has settled.
STILL = 1e-9
#: A mixture has settled when the mean log-likelihood grows by less than this.
FLAT = 1e-6
#: Added to the variances of a mixture's components.
FLOOR = 1e-6


@dataclass(frozen=True)
class Run:
    run: int
    k: int
    p: int
    seed: int


# --------------------------------------------------------------------------- blocks of rows


def blocks(df: DataFrame, key: str, width: int, vector: str = "pcs", by: str | None = None) -> DataFrame:
    """A written table (grp, keys, h, x): up to about BLOCK_ROWS rows of one group, x row by row. Rows with missing
    values take no part."""
    v = F.slice(F.col(vector), 1, width).cast("array<double>")
    rows = df.select((F.col(by) if by else F.lit(0)).alias("grp"), F.col(key).alias("key"), v.alias("v"))
    rows = rows.where((F.size("v") == width) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    sizes = rows.groupBy("grp").agg((F.count(F.lit(1)) / F.lit(BLOCK_ROWS // 2)).cast("int").alias("_n"))
    spread = null_safe_join(rows, sizes, ["grp"])
    spread = spread.withColumn("_b", F.pmod(F.xxhash64("key"), F.col("_n") + 1))
    packed = spread.groupBy("grp", "_b").agg(F.sort_array(F.collect_list(F.struct("key", "v"))).alias("r"))
    return cut_lineage(
        packed.select("grp", F.transform("r", lambda r: r["key"]).alias("keys"), F.transform("r", lambda r: F.xxhash64(r["key"])).alias("h"), F.flatten(F.transform("r", lambda r: r["v"])).alias("x"))
    )


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes and a seed."""
    z = h.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0.0)


State = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _over_blocks(packed: DataFrame, state: DataFrame, width: int, work, schema: str) -> DataFrame:
    """``work(x, h, keys, run)`` yields tuples for every block and run of its group; see ``schema`` after grp and run."""
    runs = state.groupBy("grp").agg(F.collect_list(F.struct("run", "k", "p", "seed", "params")).alias("runs"))
    names = ["grp", "run", *[c.split()[0] for c in schema.split(", ")]]
    both = null_safe_join(packed, runs, ["grp"])
    out = f"grp {dict(packed.dtypes)['grp']}, run int, {schema}"

    target = packed.sparkSession.createDataFrame([], out).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(target)
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column("x")[i].values.to_numpy().reshape(-1, width)
                h = batch.column("h")[i].values.to_numpy()
                grp, keys = batch.column("grp")[i].as_py(), batch.column("keys")[i].values
                rows = [(grp, r["run"], *t) for r in batch.column("runs")[i].as_py() for t in work(x, h, keys, r)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), types.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return both.mapInArrow(kernel, target)


# --------------------------------------------------------------------------- seeding


def _start(packed: DataFrame, runs: Sequence[Run]) -> DataFrame:
    spec = F.array(*[F.struct(*[F.lit(getattr(r, c)).alias(c) for c in ("run", "k", "p", "seed")]) for r in runs])
    groups = packed.select("grp").distinct().select("grp", F.explode(spec).alias("r"))
    return groups.select("grp", "r.*", F.array().cast("array<double>").alias("params"))


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ and a few rounds over the drawn rows."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    near = _distances(points, points[chosen])[:, 0]
    while len(chosen) < k:
        chance = weights * near
        if chance.sum() <= 0:
            break  # fewer different rows than clusters
        chosen.append(int(rng.choice(len(points), p=chance / chance.sum())))
        near = np.minimum(near, _distances(points, points[chosen[-1:]])[:, 0])
    centres = points[chosen]
    for _ in range(10):
        own = _distances(points, centres).argmin(1)
        hot = (own[:, None] == np.arange(len(centres))) * weights[:, None]
        full = hot.sum(0) > 0
        centres[full] = (hot.T @ points)[full] / hot.sum(0)[full, None]
    return centres


def seeded(packed: DataFrame, runs: Sequence[Run], width: int) -> DataFrame:
    """A written table (grp, run, k, p, seed, params): k centres of every group and run, or as many as it has rows."""

    def draw(x: np.ndarray, h: np.ndarray, keys, r: dict):
        p, drawn = r["p"], np.array(r["params"]).reshape(-1, r["p"])
        near = _distances(x[:, :p], drawn).min(1) if len(drawn) else np.ones(len(x))
        with np.errstate(divide="ignore"):
            late = -np.log(_uniform(h, r["seed"] * 1009 + len(drawn))) / near
        n = OVERSAMPLE * r["k"] if len(drawn) else 1
        for i in np.argsort(late, kind="stable")[:n]:
            if np.isfinite(late[i]):
                yield float(late[i]), int(h[i]), n, x[i, :p].tolist()

    state = cut_lineage(_start(packed, runs))
    for _ in range(SEED_PASSES + 1):
        drawn = _over_blocks(packed, state, width, draw, "late double, h bigint, n int, v array<double>")
        few = top_k_per_group(drawn, ["grp", "run"], [F.col("late"), F.col("h")], OVERSAMPLE * max(r.k for r in runs)).where("rk <= n")
        more = few.groupBy("grp", "run").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rk", "v"))), lambda t: t["v"])).alias("more"))
        before = state
        new = F.concat("params", F.coalesce("more", F.array().cast("array<double>")))
        state = cut_lineage(null_safe_join(state, more, ["grp", "run"], "left").select("grp", "run", "k", "p", "seed", new.alias("params")))
        drop_table(before)

    def weigh(x: np.ndarray, h: np.ndarray, keys, r: dict):
        own = _distances(x[:, : r["p"]], np.array(r["params"]).reshape(-1, r["p"])).argmin(1)
        for c, n in zip(*np.unique(own, return_counts=True), strict=True):
            yield int(c), int(n)

    weights = _over_blocks(packed, state, width, weigh, "c int, n bigint").groupBy("grp", "run", "c").agg(F.sum("n").alias("n"))
    heavy = weights.groupBy("grp", "run").agg(F.collect_list(F.struct("c", "n")).alias("w"))

    def reduce(r: dict) -> list[float]:
        points = np.array(r["params"]).reshape(-1, r["p"])
        w = np.zeros(len(points))
        for c in r["w"]:
            w[c["c"]] = c["n"]
        return _plus_plus(points, w, r["k"], r["seed"]).ravel().tolist()

    out = cut_lineage(_updated(null_safe_join(state, heavy, ["grp", "run"]), lambda r: {"params": reduce(r)}, ["grp", "run", "k", "p", "seed", "params"]))
    drop_table(state)
    return out


def _updated(df: DataFrame, change, columns: Sequence[str]) -> DataFrame:
    """Small rows with some values replaced; ``change(row)`` returns them by name."""
    schema = df.select(*columns).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r | change(r) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in rows], to_arrow(schema))

    from pyspark.sql.pandas.types import to_arrow_schema as to_arrow

    return df.mapInArrow(kernel, schema)


# --------------------------------------------------------------------------- rounds

SUMS = "c int, n double, total double, s array<double>"


def _settle(packed: DataFrame, state: DataFrame, width: int, work, update, iters: int, columns: Sequence[str]) -> DataFrame:
    """All rounds of groups that one task can hold; the runs of a group are dealt over tasks by the work they make."""
    whole = packed.groupBy("grp").agg(F.collect_list(F.struct("x", "h")).alias("parts"))  # bounded by LOCAL_NUMBERS
    dealt = null_safe_join(state, packed.groupBy("grp").agg(F.sum(F.size("x")).alias("_size")), ["grp"])
    slots = F.ceil(F.count(F.lit(1)).over(W.partitionBy("grp")) * F.col("_size") / LOCAL_WORK)
    dealt = dealt.withColumn("_slot", F.pmod(F.col("run"), F.greatest(slots, F.lit(1))))
    runs = cut_lineage(dealt.groupBy("grp", "_slot").agg(F.collect_list(F.struct(*[c for c in columns if c != "grp"])).alias("runs")))
    tasks = max(1, min(runs.count(), 512))
    schema = state.select(*columns).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column("parts")[i].values
                blocks = [(parts.field("x")[j].values.to_numpy().reshape(-1, width), parts.field("h")[j].values.to_numpy()) for j in range(len(parts))]
                grp, done = batch.column("grp")[i].as_py(), []
                for r in batch.column("runs")[i].as_py():
                    r = {"grp": grp} | r
                    for _ in range(iters):
                        sums: dict[int, list] = {}
                        for x, h in blocks:
                            for c, n, t, v in work(x, h, None, r):
                                old = sums.get(c, (0.0, 0.0, 0.0))
                                sums[c] = (old[0] + n, old[1] + t, old[2] + np.array(v))
                        r = r | update(r | {"sums": [{"c": c, "n": n, "t": t, "s": v} for c, (n, t, v) in sorted(sums.items())]})
                        if not r["active"]:
                            break
                    done.append({c: r[c] for c in columns})
                yield pa.RecordBatch.from_pylist(done, to_arrow_schema(schema))

    out = cut_lineage(null_safe_join(runs, whole, ["grp"]).repartition(tasks, "grp", "_slot").mapInArrow(kernel, schema))
    drop_table(runs)
    return out


def _far_rounds(packed: DataFrame, state: DataFrame, width: int, length: int, work, update, iters: int, columns: Sequence[str]) -> DataFrame:
    """All rounds of the other groups: a round is one job. It is handed the centres, which are small, every task adds up
    what the runs need of its blocks, and the sums that come back move the centres."""
    spark, schema = packed.sparkSession, state.select(*columns).schema
    out = f"grp {dict(packed.dtypes)['grp']}, run int, {SUMS}"
    target = spark.createDataFrame([], out).schema
    size = state.groupBy("grp").agg(F.sum(F.size("params")).alias("n")).collect()  # one row a group of more than LOCAL_NUMBERS
    parts, room = [[]], 0
    for g in size:
        if room + g["n"] > STATE_NUMBERS and parts[-1]:
            parts.append([])
            room = 0
        parts[-1].append(g["grp"])
        room += g["n"]

    def summed(handed):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            types, sums = to_arrow_schema(target), {}
            for batch in batches:
                for i in range(batch.num_rows):
                    grp = batch.column("grp")[i].as_py()
                    runs = handed.value.get(grp, [])
                    if not runs:
                        continue
                    x = batch.column("x")[i].values.to_numpy().reshape(-1, width)
                    h = batch.column("h")[i].values.to_numpy()
                    for r in runs:
                        for c, n, t, v in work(x, h, None, r):
                            old = sums.get((grp, r["run"], c), (0.0, 0.0, 0.0))
                            sums[grp, r["run"], c] = (old[0] + n, old[1] + t, old[2] + np.array(v))
            rows = [(*k, n, t, v.tolist()) for k, (n, t, v) in sums.items()]
            if rows:
                names = types.names
                yield pa.RecordBatch.from_arrays([pa.array(list(c), types.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

        return kernel

    done = []
    for groups in parts:
        known = [g for g in groups if g is not None]
        mine = F.lit(False) if not known else F.coalesce(F.col("grp").isin(known), F.lit(False))
        mine = mine | F.col("grp").isNull() if len(known) < len(groups) else mine
        rows = [r.asDict() for r in state.where(mine).collect()]
        own = packed.where(mine).select("grp", "h", "x")
        for _ in range(iters):
            active: dict = {}
            for r in rows:
                if r["active"]:
                    active.setdefault(r["grp"], []).append(r)
            if not active:
                break
            handed = spark.sparkContext.broadcast(active)
            got = own.mapInArrow(summed(handed), target).groupBy("grp", "run", "c").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), array_sum("s", length).alias("s"))
            sums: dict = {}
            for r in got.collect():  # one row a cluster of every run that moves
                sums.setdefault((r["grp"], r["run"]), []).append({"c": r["c"], "n": r["n"], "t": r["t"], "s": r["s"]})
            handed.unpersist()
            rows = [r | update(r | {"sums": sorted(sums[r["grp"], r["run"]], key=lambda c: c["c"])}) if r["active"] else r for r in rows]
        done += [tuple(r[c] for c in columns) for r in rows]
    return cut_lineage(spark.createDataFrame(done, schema))


def _rounds(packed: DataFrame, state: DataFrame, width: int, length: int, work, update, iters: int, what: str) -> DataFrame:
    """Repeat: sums of all blocks by (grp, run, c), then ``update`` of every run that still moves. Adds total, active.

    Groups that one task can hold go through all rounds there; the others take one job a round."""
    columns = ["grp", "run", "k", "p", "seed", "params", "total", "active"]
    state = state.select(*columns[:6], F.lit(None).cast("double").alias("total"), F.lit(True).alias("active"))
    few = cut_lineage(packed.groupBy("grp").agg((F.sum(F.size("x")) <= LOCAL_NUMBERS).alias("_few")))
    state = null_safe_join(state, few, ["grp"])
    own = null_safe_join(packed, few.where("_few").select("grp", F.lit(True).alias("_own")), ["grp"]).drop("_own")
    settled = _settle(own, state.where("_few").drop("_few"), width, work, update, iters, columns)
    far = _far_rounds(packed, state.where("NOT _few").select(*columns), width, length, work, update, iters, columns)
    drop_table(few)
    out = cut_lineage(far.unionByName(settled))
    drop_table(far)
    drop_table(settled)
    if not out.where("active").isEmpty():
        warnings.warn(f"{what}: some runs still moved after {iters} rounds", stacklevel=3)
    return out


def lloyd(packed: DataFrame, runs: Sequence[Run], width: int, iters: int) -> DataFrame:
    """A written table (grp, run, k, p, seed, params, total, active): settled centres and their cost."""

    def work(x: np.ndarray, h: np.ndarray, keys, r: dict):
        centres = np.array(r["params"]).reshape(-1, r["p"])
        d = _distances(x[:, : r["p"]], centres)
        own = d.argmin(1)
        cost = d[np.arange(len(x)), own]
        for c in np.unique(own):
            mine = own == c
            s = np.zeros(width)
            s[: r["p"]] = x[mine, : r["p"]].sum(0)
            yield int(c), float(mine.sum()), float(cost[mine].sum()), s.tolist()

    def update(r: dict) -> dict:
        old = np.array(r["params"]).reshape(-1, r["p"])
        new = old.copy()
        for c in r["sums"]:
            new[c["c"]] = np.array(c["s"][: r["p"]]) / c["n"]
        still = ((new - old) ** 2).sum(1) <= STILL**2 * (1 + (old**2).sum(1))
        return {"params": new.ravel().tolist(), "total": float(sum(c["t"] for c in r["sums"])), "active": not still.all()}

    start = seeded(packed, runs, width)
    out = _rounds(packed, start, width, width, work, update, iters, "k-means")
    drop_table(start)
    return out


def _unpack(params: Sequence[float], p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, means and covariances of a mixture."""
    a = np.array(params).reshape(-1, 1 + p + p * p)
    return a[:, 0], a[:, 1 : 1 + p], a[:, 1 + p :].reshape(-1, p, p)


def _log_density(x: np.ndarray, params: Sequence[float], p: int) -> np.ndarray:
    share, mean, cov = _unpack(params, p)
    out = np.empty((len(x), len(share)))
    for c in range(len(share)):
        root = np.linalg.cholesky(cov[c])
        z = np.linalg.solve(root, (x - mean[c]).T)
        out[:, c] = np.log(share[c]) - 0.5 * (p * np.log(2 * np.pi) + (z * z).sum(0)) - np.log(np.diag(root)).sum()
    return out


def mixtures(packed: DataFrame, runs: Sequence[Run], width: int, iters: int) -> DataFrame:
    """As ``lloyd``: settled Gaussian mixtures with full covariances, started from settled centres; total is the
    log-likelihood."""
    length = 1 + width + width * width

    def moments(x: np.ndarray, share: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Weighted sums around ``centre``."""
        y = x - centre
        out = np.zeros(length)
        p = x.shape[1]
        out[0], out[1 : 1 + p], out[1 + p : 1 + p + p * p] = share.sum(), share @ y, ((y * share[:, None]).T @ y).ravel()
        return out

    def hard(x: np.ndarray, h: np.ndarray, keys, r: dict):
        x, centres = x[:, : r["p"]], np.array(r["params"]).reshape(-1, r["p"])
        own = _distances(x, centres).argmin(1)
        for c in np.unique(own):
            yield int(c), float((own == c).sum()), 0.0, moments(x, (own == c).astype(float), centres[c]).tolist()

    def soft(x: np.ndarray, h: np.ndarray, keys, r: dict):
        x = x[:, : r["p"]]
        logs = _log_density(x, r["params"], r["p"])
        top = logs.max(1)
        total = top + np.log(np.exp(logs - top[:, None]).sum(1))
        share, centres = np.exp(logs - total[:, None]), _unpack(r["params"], r["p"])[1]
        for c in range(logs.shape[1]):
            yield c, float(share[:, c].sum()), float(total.sum()) if c == 0 else 0.0, moments(x, share[:, c], centres[c]).tolist()

    def refit(r: dict, centres: np.ndarray) -> list[float]:
        p, n_all = r["p"], sum(c["n"] for c in r["sums"])
        out = []
        for c in r["sums"]:
            a, n = np.array(c["s"]), max(c["n"], 1e-300)
            shift = a[1 : 1 + p] / n
            cov = a[1 + p : 1 + p + p * p].reshape(p, p) / n - np.outer(shift, shift)
            out.append(np.concatenate([[max(c["n"] / n_all, 1e-300)], centres[c["c"]] + shift, (cov + FLOOR * np.eye(p)).ravel()]))
        return np.concatenate(out).tolist()

    def first(r: dict) -> dict:
        return {"params": refit(r, np.array(r["params"]).reshape(-1, r["p"])), "active": False}

    def update(r: dict) -> dict:
        n, total = sum(c["n"] for c in r["sums"]), float(sum(c["t"] for c in r["sums"]))
        flat = r["total"] is not None and total - r["total"] <= FLAT * n
        # a settled mixture keeps the parameters that ``total`` belongs to
        params = r["params"] if flat else refit(r, _unpack(r["params"], r["p"])[1])
        return {"params": params, "total": total, "active": not flat}

    centres = lloyd(packed, runs, width, iters)
    start = _rounds(packed, centres, width, length, hard, first, 1, "mixture start")
    out = _rounds(packed, start, width, length, soft, update, iters, "mixture")
    drop_table(centres)
    drop_table(start)
    return out


def labels(packed: DataFrame, state: DataFrame, width: int, mixture: bool = False) -> DataFrame:
    """grp, run, key, c: the cluster (from 0) of every row for every run in ``state``."""

    def work(x: np.ndarray, h: np.ndarray, keys, r: dict):
        if mixture:
            own = _log_density(x[:, : r["p"]], r["params"], r["p"]).argmax(1)
        else:
            own = _distances(x[:, : r["p"]], np.array(r["params"]).reshape(-1, r["p"])).argmin(1)
        yield from zip(keys.to_pylist(), own.tolist(), strict=True)

    kind = dict(packed.dtypes)["keys"].removeprefix("array<").removesuffix(">")
    return _over_blocks(packed, state, width, work, f"key {kind}, c int")


__all__ = ["Run", "blocks", "labels", "lloyd", "mixtures", "seeded"]
