"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytomesh.operators.core import ensure_checkpoint_dir

#: Fixed by the task: what counts as white space between words.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join may be broadcast after a count showed at most so many (narrow) rows.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, what: str = "llm") -> str:
    """A new folder name below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid4().hex}"


def written(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cut the lineage with a table in the shared folder; lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if "/llm-" in folder:
            path.getFileSystem(conf).delete(path, True)


def words(text: Column) -> Column:
    """The maximal runs of characters other than white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def hash_sample(df: DataFrame, rows: int, n: int, *key: str) -> DataFrame:
    """The n rows with the smallest hashes of ``key``, of ``rows`` in all (the rows of ``df``).

    Rows are filtered by a hash threshold first, so tasks hand on about 4 n rows together, not n each. Should fewer than
    n pass, as equal rows share a hash, the threshold is widened.
    """
    h, share = F.xxhash64(*key), 4.0 * n / max(rows, 1)
    while share < 1:
        near = df.where(h < F.lit(int((2.0 * share - 1.0) * 2**63)))
        found = written(near.orderBy(h, *key).limit(n))
        if found.count() >= min(n, rows):
            return found.orderBy(h, *key)
        share *= 4
    return df.orderBy(h, *key).limit(n)


def crc32_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string"))


def is_small(df: DataFrame) -> bool:
    """Whether a count allows this table to be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join_small(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", small: bool | None = None) -> DataFrame:
    """Null-safe join with a table unique per key; broadcast only after its rows were counted (``small``: before).

    Larger tables go through a shuffle join, whose hot partitions adaptive execution splits.
    """
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    if is_small(right) if small is None else small:
        right = F.broadcast(right)
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(right[f"_r_{k}"])
        cond = one if cond is None else cond & one
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def number_rows(df: DataFrame, by: Sequence[str], order: Column, ties: Sequence[str], out: str, n_rows: int) -> DataFrame:
    """Gapless numbers from 0 inside each group ``by``, in the sequence of (order, ties).

    ``order`` is a well-mixed whole number in 0 .. 2**31 - 1. Its leading bits cut every group, hot ones too,
    into buckets that are numbered on their own and shifted by the rows before them.
    """
    bits = max(4, min(24, (max(n_rows, 1) // 50_000).bit_length() + 2))
    keyed = df.withColumn("_o", order).withColumn("_b", F.shiftright("_o", 31 - bits))
    own = keyed.withColumn("_rn", F.row_number().over(W.partitionBy(*by, "_b").orderBy("_o", *ties)))
    counts = keyed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ends = F.sum("_n").over(W.partitionBy(*by).orderBy("_b"))
    starts = counts.select(*by, "_b", (ends - F.col("_n")).alias("_start"))
    return join_small(own, starts, [*by, "_b"], "inner").withColumn(out, F.col("_start") + F.col("_rn") - 1).drop("_o", "_b", "_rn", "_start")
