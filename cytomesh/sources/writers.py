"""Writers: partitioned shard outputs, coordinate text, summaries, wide label exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomesh.operators.core import keyed_join


def write_shards(df: DataFrame, path: str, fmt: str = "parquet", files_per_shard: int = 8) -> None:
    """One folder per shard. A hash salt splits a large shard over several writers."""
    others = [c for c in df.columns if c != "shard_id"]
    salt = F.pmod(F.xxhash64(*others), F.lit(files_per_shard))
    out = df.repartition(F.col("shard_id"), salt).write.mode("overwrite").partitionBy("shard_id")
    (out.option("header", True).csv(path) if fmt == "csv" else out.parquet(path))


def write_summary(df: DataFrame, path: str, files: int = 1) -> None:
    """A table as CSV below ``path``, in at most so many files. A summary is one; ask for more where rows are many."""
    df.coalesce(files).write.mode("overwrite").option("header", True).csv(path)


def write_shard_summaries(summary: DataFrame, cov: DataFrame, path: str, p: int) -> None:
    """Per-shard CSV files below ``path``: proportions (cluster, count, proportion, total_n), means (cluster, pc1 .. pcp)
    and covariance (row, pc1 .. pcp), each in one folder a shard. See ``shards.shard_summary``."""
    pcs = [F.col("mean")[i].alias(f"pc{i + 1}") for i in range(p)]
    rows = cov.groupBy("shard_id", F.col("i").alias("row")).agg(*[F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"pc{j + 1}") for j in range(p)])
    tables = {
        "proportions": summary.select("shard_id", "cluster", F.col("n_obs").alias("count"), F.col("prop").alias("proportion"), "total_n"),
        "means": summary.select("shard_id", "cluster", *pcs),
        "covariance": rows,
    }
    for kind, df in tables.items():
        df.repartition("shard_id").write.mode("overwrite").partitionBy("shard_id").option("header", True).csv(f"{path}/{kind}")


def write_triplets(counts: DataFrame, genes: DataFrame, cells: DataFrame, path: str, field: str = "integer", by_cell: bool = False) -> None:
    """(cell_id, gene_id, cnt) as Matrix-Market coordinate text below ``path``, genes x cells or, ``by_cell``, turned.

    The positions come from ``genes(gene_idx, gene_id)`` and ``cells(cell_idx, cell_id)``. The banner and the size line are
    a part of their own, so entries are written in parallel.
    """
    n_genes, n_cells, n = genes.count(), cells.count(), counts.count()
    size = (n_cells, n_genes, n) if by_cell else (n_genes, n_cells, n)
    head = [f"%%MatrixMarket matrix coordinate {field} general", "%d %d %d" % size]
    order = ["cell_idx", "gene_idx"] if by_cell else ["gene_idx", "cell_idx"]
    placed = keyed_join(keyed_join(counts, genes, ["gene_id"]), cells, ["cell_id"])
    values = [] if field == "pattern" else ["cnt"]
    body = placed.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in order + values]).alias("value"))
    counts.sparkSession.createDataFrame([(line,) for line in head], "value string").coalesce(1).write.mode("overwrite").text(path)
    body.write.mode("append").text(path)


def export_labels(long: DataFrame, ids: Sequence[str], runs: Sequence[str], run: str = "run", label: str = "label") -> DataFrame:
    """Wide table: ids and one label column per run."""
    return long.groupBy(*ids).pivot(run, list(runs)).agg(F.first(label))
