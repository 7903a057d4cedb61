"""Building blocks that keep the operators safe on skewed, very large inputs."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE_VALUES = 100_000  # distinct values one running sum should see
MAX_RANGES = 512  # value ranges of a group at most; a power of two


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local session may fall back to its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="cytomesh-ckpt-")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared checkpoint folder, so lost executors cost no recomputation.

    A written table also carries its true size, so what follows can broadcast it when it is small, and none
    of the planner facts collected about the original plan, which grow from round to round.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame | None) -> None:
    """Delete a table made by ``cut_lineage`` once nothing reads it any more."""
    if df is None:
        return
    spark = df.sparkSession
    root = spark.sparkContext.getCheckpointDir()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root and f"/{root.rsplit('/', 1)[1]}/table-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where a NULL key is a group like any other. ``right`` has one row per key."""
    other = right.withColumnsRenamed({c: f"_k_{c}" for c in on})
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"_k_{c}"]) for c in on])
    return left.join(other, cond, how).drop(*[f"_k_{c}" for c in on])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a large, possibly skewed ``left`` to a ``right`` that is unique per key. A NULL key is a key like any other.

    Adaptive execution splits the partition of a hot key among tasks and broadcasts a small right side.
    """
    return null_safe_join(left, right, list(on), how)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row."""
    return df.join(F.broadcast(one_row))


def _position(cuts: Column, value: Column) -> Column:
    """How many of MAX_RANGES - 1 ascending cuts are below the value, by binary search."""
    steps = F.array(*[F.lit(MAX_RANGES >> k) for k in range(1, MAX_RANGES.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def _cumulative(df: DataFrame, value: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """by, _value, _cnt, _before, _total: see ``cumulative_counts``."""
    by = list(by)
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    vc = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(rows.alias("_cnt"))
    if by:
        # a sketch of every one of very many small groups would cost more than all else: where one range will do, none is made
        vc = cut_lineage(vc)
        if vc.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > RANGE_VALUES).isEmpty():
            run, whole = F.sum("_cnt").over(W.partitionBy(*by).orderBy("_value")), F.sum("_cnt").over(W.partitionBy(*by))
            return vc.select(*by, "_value", "_cnt", (run - F.col("_cnt")).alias("_before"), whole.alias("_total"))
    # sizes and cuts of all groups come from one aggregate over the shuffle that the counts use too
    sketch = F.percentile_approx("_value", [i / MAX_RANGES for i in range(1, MAX_RANGES)], F.lit(10 * MAX_RANGES))
    aggs = [F.least(F.lit(MAX_RANGES), F.ceil(F.count(F.lit(1)) / RANGE_VALUES)).cast("int").alias("_need"), sketch.alias("_cuts")]
    groups = vc.groupBy(*by).agg(*aggs) if by else vc.agg(*aggs)
    groups = groups.withColumn("_cuts", F.when(F.col("_need") > 1, F.col("_cuts")))
    vc = null_safe_join(vc, groups, by) if by else with_scalars(vc, groups)
    at = F.floor(_position(F.col("_cuts"), F.col("_value")) * F.col("_need") / MAX_RANGES).cast("int")
    vc = vc.select(*by, "_value", "_cnt", F.when(F.col("_need") > 1, at).otherwise(0).alias("_rb"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ranges = vc.groupBy(*by, "_rb").agg(F.sum("_cnt").alias("_in"))
    ranges = ranges.select(*by, "_rb", (F.sum("_in").over(w.orderBy("_rb")) - F.col("_in")).alias("_earlier"), F.sum("_in").over(w).alias("_total"))
    joined = null_safe_join(vc, ranges, [*by, "_rb"])
    run = F.sum("_cnt").over(W.partitionBy(*by, "_rb").orderBy("_value"))
    return joined.select(*by, "_value", "_cnt", (F.col("_earlier") + run - F.col("_cnt")).alias("_before"), "_total")


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``by, value, cnt, before, total``: rows per distinct value and how many come earlier. NULL keys are a group.
    ``weight``: a column that says for how many rows a row stands.

    Values are first collapsed to (value, count). If any group needs it, every group is then cut into value ranges taken from a mergeable
    quantile sketch, about one per RANGE_VALUES distinct values, so that a running sum sees one range of one group
    whatever the group's size. The sketch decides balance only; the counts are exact.
    """
    clash = {"value", "cnt", "before", "total"} & set(by)
    if clash:
        raise ValueError(f"rename the key columns {sorted(clash)}: the result uses these names")
    c = _cumulative(df, value, by, weight)
    return c.select(*by, F.col("_value").alias("value"), F.col("_cnt").alias("cnt"), F.col("_before").alias("before"), F.col("_total").alias("total"))


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics, one column per entry of ``probs``.

    Works from distributed cumulative counts: no task holds a group's values.
    """
    by = list(by)
    c = _cumulative(df, value, by)
    aggs, outs = [], []
    for name, p in probs.items():
        h = (F.col("_total") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)

        def at(pos: Column) -> Column:
            return F.max(F.when((F.col("_before") <= pos) & (pos < F.col("_before") + F.col("_cnt")), F.col("_value")))

        aggs += [at(lo).alias(f"_{name}_lo"), at(hi).alias(f"_{name}_hi"), F.max(h - lo).alias(f"_{name}_f")]
        a, b = F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double")
        outs.append((a + (b - a) * F.col(f"_{name}_f")).alias(name))
    grouped = c.groupBy(*by).agg(*aggs) if by else c.agg(*aggs)
    return grouped.select(*by, *outs)


def quantiles_long(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """i, q: the same quantiles for a long list of probabilities, one row each."""
    c = cumulative_counts(df, value)
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    h = F.transform(arr, lambda a: F.struct(a["i"].alias("i"), ((F.col("total") - 1) * a["p"]).alias("h")))
    upto = F.col("before") + F.col("cnt")

    def holds(pos: Column) -> Column:
        return (F.col("before") <= pos) & (pos < upto)

    hit = c.select("value", "before", "cnt", F.explode(F.filter(h, lambda a: holds(F.floor(a["h"])) | holds(F.ceil(a["h"])))).alias("e"))
    lo, hi = F.floor("e.h"), F.ceil("e.h")
    g = hit.groupBy(F.col("e.i").alias("i")).agg(
        F.max(F.when(holds(lo), F.col("value"))).alias("a"), F.max(F.when(holds(hi), F.col("value"))).alias("b"), F.max(F.col("e.h") - lo).alias("f")
    )
    return g.select("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("q"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``by, value, ties, avg_rank, total``: mid-rank of each distinct value inside its group."""
    c = cumulative_counts(df, value, by, weight)
    rank = F.col("before").cast("double") + (F.col("cnt").cast("double") + F.lit(1.0)) / F.lit(2.0)
    return c.select(*by, "value", F.col("cnt").alias("ties"), rank.alias("avg_rank"), "total")


def hashed_row_index(df: DataFrame, key: str, seed: int, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """0-based dense index ``row_index`` in a random but reproducible order, without a global sort.

    Rows fall into hash buckets; a bucket is numbered on its own and shifted by the rows before it.
    """
    n = df.count()
    buckets = max(16, -(-n // rows_per_bucket))
    h = F.xxhash64(F.col(key), F.lit(seed))
    keyed = df.withColumn("_h", h).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        "_b", (F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).alias("_start")
    )
    numbered = keyed.withColumn("_rn", F.row_number().over(W.partitionBy("_b").orderBy("_h", key)))
    return (
        numbered.join(starts, "_b")
        .withColumn("row_index", F.col("_start") + F.col("_rn") - 1)
        .drop("_h", "_b", "_rn", "_start")
    )


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "row_number") -> DataFrame:
    """Rows ranked at most k in their group. The rank filter is applied before the shuffle too."""
    fn = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[rank]
    return df.withColumn("rk", fn().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rk") <= k)
