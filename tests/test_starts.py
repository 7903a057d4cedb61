"""Rounds of many starts: the same result whoever takes them, and no written table a round."""

import numpy as np
import pytest

from cytomesh.operators import cluster, starts


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 3)) + rng.integers(0, 3, (600, 1))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cell_id long, pcs array<double>")


def found(df):
    return {r["cell_id"]: r["cluster"] for r in df.collect()}


@pytest.mark.parametrize("limits", [(0, 1), (1 << 20, 1)])
def test_far_and_near_rounds_agree(spark, rows, monkeypatch, limits):
    plain = found(cluster.kmeans(rows, 4, 3, (1, 2, 3))), found(cluster.gmm(rows, 2, 3, (1, 2), iters=5))
    monkeypatch.setattr(starts, "LOCAL_NUMBERS", limits[0])
    monkeypatch.setattr(starts, "LOCAL_WORK", limits[1])
    monkeypatch.setattr(starts, "STATE_NUMBERS", 1)
    assert (found(cluster.kmeans(rows, 4, 3, (1, 2, 3))), found(cluster.gmm(rows, 2, 3, (1, 2), iters=5))) == plain


def test_far_rounds_write_no_table_each(spark, rows, monkeypatch):
    monkeypatch.setattr(starts, "LOCAL_NUMBERS", 0)
    packed, written, plain = starts.blocks(rows, "cell_id", 3, "pcs"), [], starts.cut_lineage
    monkeypatch.setattr(starts, "cut_lineage", lambda df: written.append(1) or plain(df))
    n = []
    for iters in (1, 12):
        starts.lloyd(packed, [starts.Run(0, 8, 3, 1)], 3, iters)
        n.append(len(written))
        written.clear()
    assert n[0] == n[1]
