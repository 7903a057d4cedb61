"""How the driver tables stand in for cells, points, counts, labelings and samples.

Every role has a DataFrame form and a SQL form built from the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.operators.core import with_scalars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark, sf_dir, p: int = 10) -> DataFrame:
    """cell_id, x, y, pcs (first p), annotation."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"),
        F.col("embedding")[63].cast("double").alias("x"),
        F.col("embedding")[62].cast("double").alias("y"),
        F.slice("embedding", 1, p).cast("array<double>").alias("pcs"),
        F.col("label").alias("annotation"),
    )


def cells_sql(p: int = 10) -> str:
    return (
        "cells AS (SELECT vec_id AS cell_id, embedding[64]::DOUBLE AS x, embedding[63]::DOUBLE AS y, "
        f"embedding[1:{p}]::DOUBLE[] AS pcs, label AS annotation FROM embeddings)"
    )


def points(spark, sf_dir) -> DataFrame:
    """id, x, y, label: many planar points."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") / 1000.0).alias("x"),
        F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("y"),
        F.col("o_orderstatus").alias("label"),
    )


POINTS_SQL = (
    "points AS (SELECT o_orderkey AS id, o_totalprice / 1000.0::DOUBLE AS x, "
    "date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS y, o_orderstatus AS label FROM orders)"
)


def counts(spark, sf_dir) -> DataFrame:
    """cell_id, gene_id, cnt with few genes."""
    li, pa = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return (
        li.select("l_suppkey", "l_partkey", "l_quantity")
        .join(pa.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("cell_id"), F.col("p_brand").alias("gene_id"))
        .agg(F.sum("l_quantity").cast("bigint").alias("cnt"))
    )


COUNTS_SQL = (
    "counts AS (SELECT l_suppkey AS cell_id, p_brand AS gene_id, sum(l_quantity)::BIGINT AS cnt "
    "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
)


def sparse_counts(spark, sf_dir) -> DataFrame:
    """cell_id, gene_id, cnt with many genes and few non-zeros."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"))
        .agg(F.sum("l_quantity").cast("bigint").alias("cnt"))
    )


SPARSE_SQL = (
    "counts AS (SELECT l_suppkey AS cell_id, l_partkey AS gene_id, sum(l_quantity)::BIGINT AS cnt "
    "FROM lineitem GROUP BY 1, 2)"
)


def cell_labels(spark, sf_dir) -> DataFrame:
    """cell_id, cluster for the cells of the count matrices."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") % 5).alias("cluster")
    )


CELL_LABELS_SQL = "cell_labels AS (SELECT s_suppkey AS cell_id, s_nationkey % 5 AS cluster FROM supplier)"


def samples(spark, sf_dir) -> DataFrame:
    """iter, obs_id, label: last event type per user and day, ``none`` where a day has no event."""
    ev = table(spark, sf_dir, "events").select(
        F.dayofmonth("ts").alias("iter"), F.col("user_id").alias("obs_id"), "ts", "event_id", "event_type"
    )
    seen = ev.groupBy("iter", "obs_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("label"))
    days = ev.agg(F.collect_set("iter").alias("iters"))  # at most 31 days of a month
    grid = with_scalars(ev.select("obs_id").distinct(), days).select("obs_id", F.explode("iters").alias("iter"))
    return grid.join(seen, ["iter", "obs_id"], "left").select(
        "iter", "obs_id", F.coalesce("label", F.lit("none")).alias("label")
    )


SAMPLES_SQL = (
    "seen AS (SELECT day(ts)::INTEGER AS iter, user_id AS obs_id, "
    "arg_max(event_type, {'t': ts, 'e': event_id}) AS label FROM events GROUP BY 1, 2), "
    "samples AS (SELECT i.iter, o.obs_id, coalesce(s.label, 'none') AS label "
    "FROM (SELECT DISTINCT day(ts)::INTEGER AS iter FROM events) i "
    "CROSS JOIN (SELECT DISTINCT user_id AS obs_id FROM events) o "
    "LEFT JOIN seen s ON s.iter = i.iter AND s.obs_id = o.obs_id)"
)


def qc_cells(spark, sf_dir) -> DataFrame:
    """A cell table with the measures that quality gates need, from lineitem orders."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("cell_id"))
        .agg(
            F.sum("l_quantity").alias("transcript_counts"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("control_counts"),
            F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)).alias("unassigned_counts"),
            (F.sum("l_extendedprice") / 1000.0).alias("cell_area"),
            (F.min("l_extendedprice") / 1000.0).alias("nucleus_area"),
            F.count(F.lit(1)).alias("n_genes"),
        )
        .withColumn("total_counts", F.col("transcript_counts") + F.col("n_genes"))
    )


QC_SQL = (
    "qc0 AS (SELECT l_orderkey AS cell_id, sum(l_quantity) AS transcript_counts, "
    "sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0::DOUBLE END) AS control_counts, "
    "sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0.0::DOUBLE END) AS unassigned_counts, "
    "sum(l_extendedprice) / 1000.0::DOUBLE AS cell_area, min(l_extendedprice) / 1000.0::DOUBLE AS nucleus_area, "
    "count(*) AS n_genes FROM lineitem GROUP BY 1), "
    "qc AS (SELECT *, transcript_counts + n_genes AS total_counts FROM qc0)"
)
