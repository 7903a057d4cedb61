"""Exact all-against-all kernels on block pairs.

Rows fall into hash blocks of bounded size; each pair of blocks is one task-sized group, and a kernel
returns only its summary. The work is quadratic by nature, but no task sees more than two blocks and no
pair of rows is ever written out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384  # rows of a block; kernels go over its pairs in tiles
WIDE_ROWS = 262_144  # rows of the second block where a kernel returns something for every row of the first
#: Blocks into which a small table is cut, so that there is work for all tasks, and rows below which none is cut.
SPREAD, WIDE_SPREAD, LEAST_ROWS = 16, 64, 512
MOST_TASKS = 4096


def _dealt(df: DataFrame, key: str, blocks: int, seed: int = 42) -> DataFrame:
    return df.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(blocks)).cast("int"))


def block_pairs(
    df: DataFrame,
    key: str,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    half: bool = False,
    wide_rows: int | None = None,
    queries: DataFrame | None = None,
) -> DataFrame:
    """Apply ``kernel(rows of block q, rows of block d)`` to every pair of blocks (q <= d when ``half``).

    With ``wide_rows`` the blocks d have so many rows, and what the kernel returns for a row of block q comes once for
    each of them. ``queries``: rows for the blocks q, if they are others than ``df``.
    """
    n = df.count()
    asking = df if queries is None else queries
    m = n if queries is None else queries.count()
    small = min(SPREAD if wide_rows is None else WIDE_SPREAD, -(-m // LEAST_ROWS))
    blocks = max(1, -(-m // block_rows), small)
    others = blocks if wide_rows is None else max(1, -(-n // wide_rows))
    rows, asking = _dealt(df, key, others), _dealt(asking, key, blocks)
    later = F.sequence(F.col("_b") if half else F.lit(0), F.lit(others - 1))
    earlier = F.sequence(F.lit(0), F.col("_b") if half else F.lit(blocks - 1))
    left = asking.select("*", F.col("_b").alias("_q"), F.explode(later).alias("_d"))
    fresh = [F.col(c).alias(c) for c in rows.columns]  # new attributes, so the two sides stay distinct
    right = rows.select(*fresh).select("*", F.explode(earlier).alias("_q"), F.col("_b").alias("_d"))
    # adaptive coalescing looks at bytes, not at pairs, and leaves a given number alone
    tasks = min(MOST_TASKS, blocks * (blocks + 1) // 2 if half else blocks * others)
    left, right = (side.repartition(tasks, "_q", "_d") for side in (left, right))

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(d) == 0:
            return kernel(q.head(0), d.head(0))
        return kernel(q, d)

    return left.groupBy("_q", "_d").cogroup(right.groupBy("_q", "_d")).applyInPandas(run, schema)


def feature_columns(p: int, vector: str = "pcs") -> list:
    return [F.col(vector)[i].alias(f"f{i}") for i in range(p)]


def feature_names(p: int) -> list[str]:
    return [f"f{i}" for i in range(p)]


__all__: Sequence[str] = ["block_pairs", "feature_columns", "feature_names", "BLOCK_ROWS", "WIDE_ROWS"]
