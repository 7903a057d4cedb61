"""Principal components from dense rows or from sparse triplets, without a dense matrix of all cells.

Dense rows of a few hundred columns: the cross products meet by entry, and the driver solves the p x p problem. Sparse
counts of thousands of genes: a randomised block Krylov method. A pass multiplies the centred and scaled matrix and its
transpose with a narrow block (centring enters as a correction, so zeros stay zeros), the driver orthogonalises p x l
numbers, and passes go on until the wanted components are accurate.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomesh.operators.core import cut_lineage, drop_table
from cytomesh.operators.forest import array_sum

#: Columns up to which all cross products are formed.
DENSE_COLUMNS = 512
#: Further columns of a block, accuracy of a component relative to the largest, passes at most.
MORE_COLUMNS, ACCURACY, PASSES = 8, 1e-7, 60
#: Entries that are multiplied together.
ENTRIES_AT_ONCE = 1 << 16


def _turned(vectors: np.ndarray) -> np.ndarray:
    """Every column with its largest entry positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], vectors[:, order]


def _list_rows(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def pca(df: DataFrame, k: int = 15, features: str = "features", key: str = "cell_id") -> DataFrame:
    """key, pcs: scores on the first k components of the centred and scaled features. Each component is turned so that its
    largest loading is positive. Columns without variance take no part; rows with missing values get NULL."""
    v = df.select(key, F.col(features).cast("array<double>").alias("v"))
    whole = v.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select("v")
    p = whole.agg(F.max(F.size("v"))).first()[0] or 0
    if p > DENSE_COLUMNS:
        raise ValueError(f"{p} columns: use pca_counts beyond {DENSE_COLUMNS}")
    if not p:
        return v.select(key, F.lit(None).cast("array<double>").alias("pcs"))
    upper = np.triu_indices(p)

    def sums(shift: np.ndarray, second: bool):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros((p, p) if second else p)
            for batch in batches:
                x = _list_rows(batch, "v", p) - shift
                n += len(x)
                total += x.T @ x if second else x.sum(0)
            flat = total[upper] if second else total
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.concatenate([flat, [n]]).astype(float))], ["i", "t"])

        got = whole.mapInArrow(kernel, "i bigint, t double").groupBy("i").agg(F.sum("t").alias("t")).toArrow()  # of fixed size
        out = np.zeros(got.num_rows)
        out[got["i"].to_numpy()] = got["t"].to_numpy()
        return out[:-1], out[-1]

    first, n = sums(np.zeros(p), False)
    mean = first / n
    half, _ = sums(mean, True)
    cov = np.zeros((p, p))
    cov[upper] = half / max(n - 1, 1)
    cov = cov + cov.T - np.diag(np.diag(cov))
    sd = np.sqrt(np.diag(cov))
    used = sd > 1e-12 * max(sd.max(), 1e-300)
    scale = np.where(used, 1.0 / np.where(used, sd, 1.0), 0.0)
    k = min(k, int(used.sum()))
    _, vectors = _leading(cov * scale[:, None] * scale[None], k)
    load = _turned(vectors) * scale[:, None]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("v").to_pylist()
            good = [r is not None and all(x is not None and x == x for x in r) for r in rows]
            x = np.array([r for r, g in zip(rows, good, strict=True) if g], float).reshape(-1, p)
            found = iter(((x - mean) @ load).tolist())
            pcs = [next(found) if g else None for g in good]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pcs, pa.list_(pa.float64()))], [key, "pcs"])

    return v.mapInArrow(score, v.select(key, F.col("v").alias("pcs")).schema)


# --------------------------------------------------------------------------- sparse


def _products(x: np.ndarray, gene: np.ndarray, row: np.ndarray, block: np.ndarray) -> np.ndarray:
    """X @ block for entries sorted by row."""
    out = np.zeros((int(row[-1]) + 1 if len(row) else 0, block.shape[1]))
    for a in range(0, len(x), ENTRIES_AT_ONCE):
        s = slice(a, a + ENTRIES_AT_ONCE)
        first = np.flatnonzero(np.diff(row[s], prepend=-1))
        out[row[s][first]] += np.add.reduceat(x[s, None] * block[gene[s]], first, axis=0)
    return out


class SparseRows:
    """Cells as (cell_id, g, x): positions of chosen genes and values divided by the gene's deviation."""

    def __init__(self, values: DataFrame, cells: DataFrame, genes: DataFrame):
        """``values``: cell_id, gene_id, value without zeros; ``genes``: gene_id, a list that fits the driver."""
        self.cells = cells.select("cell_id").distinct()
        self.n = self.cells.count()
        chosen = values.join(F.broadcast(genes.select("gene_id").distinct()), "gene_id", "left_semi").join(self.cells, "cell_id", "left_semi")
        chosen = cut_lineage(chosen.groupBy("cell_id", "gene_id").agg(F.sum("value").cast("double").alias("value")))
        # around the mean of the non-zeros first, so large values do not cancel
        stats = chosen.groupBy("gene_id").agg(F.count(F.lit(1)).alias("m"), F.avg("value").alias("a"), (F.var_pop("value") * F.count(F.lit(1))).alias("w")).collect()
        found = []
        for r in sorted(stats, key=lambda r: r["gene_id"]):
            mean = r["a"] * r["m"] / self.n
            square = r["w"] + r["m"] * (self.n - r["m"]) / self.n * r["a"] ** 2
            if square > 1e-24 * max(1.0, r["a"] ** 2) and self.n > 1:
                sd = float(np.sqrt(square / (self.n - 1)))
                found.append((r["gene_id"], len(found), sd, mean / sd))
        self.genes = [f[0] for f in found]
        self.centre = np.array([f[3] for f in found])
        spark = values.sparkSession
        kind = dict(values.dtypes)["gene_id"]
        places = spark.createDataFrame([f[:3] for f in found], f"gene_id {kind}, g int, sd double")
        scaled = chosen.join(F.broadcast(places), "gene_id").select("cell_id", F.struct("g", (F.col("value") / F.col("sd")).alias("x")).alias("e"))
        lists = scaled.groupBy("cell_id").agg(F.sort_array(F.collect_list("e")).alias("e"))  # one entry a gene at most
        take = lambda f: F.coalesce(F.transform("e", lambda e: e[f]), F.array().cast("array<int>" if f == "g" else "array<double>")).alias(f)
        self.rows = cut_lineage(self.cells.join(lists, "cell_id", "left").select("cell_id", take("g"), take("x")))
        drop_table(chosen)

    @staticmethod
    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = batch.column("g")
        row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(g).to_numpy())
        return batch.column("x").flatten().to_numpy(), g.flatten().to_numpy(), row

    def covariance_times(self, block: np.ndarray) -> np.ndarray:
        """C @ block for the correlation matrix C of the genes, in one pass."""
        p, width = block.shape
        centre = self.centre
        spread = self.rows.sparkSession.sparkContext.broadcast(block)  # genes x a few columns

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = spread.value
            shift, total, sums = centre @ block, np.zeros((p, width)), np.zeros(width)
            for batch in batches:
                x, g, row = SparseRows.entries(batch)
                y = np.zeros((batch.num_rows, width))
                got = _products(x, g, row, block)
                y[: len(got)] = got
                y -= shift
                sums += y.sum(0)
                order = np.argsort(g, kind="stable")
                for a in range(0, len(order), ENTRIES_AT_ONCE):
                    o = order[a : a + ENTRIES_AT_ONCE]
                    first = np.flatnonzero(np.diff(g[o], prepend=-1))
                    total[g[o][first]] += np.add.reduceat(x[o, None] * y[row[o]], first, axis=0)
            total -= np.outer(centre, sums)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(p + 1, dtype=np.int32) * width), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p, dtype=np.int32)), lists], ["g", "z"])

        part = self.rows.mapInArrow(kernel, "g int, z array<double>").groupBy("g").agg(array_sum("z", width).alias("z")).toArrow()
        out = np.zeros((p, width))
        out[part["g"].to_numpy()] = part["z"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        spread.unpersist()
        return out / (self.n - 1)

    def components(self, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Variances and loadings (genes x k) of the first k components."""
        p = len(self.genes)
        k = min(k, p, max(self.n - 1, 0))
        if not k:
            return np.zeros(0), np.zeros((p, 0))
        block = np.linalg.qr(np.random.default_rng(seed).standard_normal((p, min(p, k + MORE_COLUMNS))))[0]
        basis, image = block, None
        for _ in range(PASSES):
            got = self.covariance_times(block)
            image = got if image is None else np.concatenate([image, got], axis=1)
            values, turn = _leading(basis.T @ image, k)
            vectors = basis @ turn
            if (np.linalg.norm(image @ turn - vectors * values, axis=0) <= ACCURACY * max(values[0], 1e-300)).all():
                return values, _turned(vectors)
            block = got
            for _ in range(2):  # twice is enough
                block = block - basis @ (basis.T @ block)
                block, r = np.linalg.qr(block)
                block = block[:, np.abs(np.diag(r)) > 1e-10 * max(values[0], 1e-300)]
            if not block.shape[1] or basis.shape[1] + block.shape[1] > p:
                block = np.linalg.qr(np.eye(p) - basis @ basis.T)[0][:, : max(p - basis.shape[1], 0)] if basis.shape[1] < p else block[:, :0]
                block = block[:, : k + MORE_COLUMNS]
                if not block.shape[1]:
                    return values, _turned(vectors)
            basis = np.concatenate([basis, block], axis=1)
        warnings.warn(f"components are less accurate than {ACCURACY} after {PASSES} passes", stacklevel=2)
        return values, _turned(vectors)

    def scores(self, loadings: np.ndarray) -> DataFrame:
        shift = self.centre @ loadings
        spread = self.rows.sparkSession.sparkContext.broadcast(loadings)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = np.zeros((batch.num_rows, len(shift)))
                got = _products(*SparseRows.entries(batch), spread.value)
                y[: len(got)] = got
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((y - shift).tolist(), pa.list_(pa.float64()))], ["cell_id", "pcs"])

        return self.rows.mapInArrow(kernel, self.rows.select("cell_id", F.col("x").alias("pcs")).schema)


def pca_counts(values: DataFrame, cells: DataFrame, genes: DataFrame, k: int = 15) -> DataFrame:
    """cell_id, pcs: as ``pca``, for the chosen genes of sparse values (a missing value is 0). Cells without any value
    are rows of zeros; genes without variance take no part."""
    rows = SparseRows(values, cells, genes)
    return rows.scores(rows.components(k)[1])


__all__ = ["SparseRows", "pca", "pca_counts"]
