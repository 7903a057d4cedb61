"""Predictive checks and representative partitions against plain versions."""

import numpy as np
import pytest

from cytomesh.operators import posterior


def chain(spark, iters=30, n=25, p=2):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((n, p)) + [0.0, 3.0]
    samples = [(t, o, int((o + t) % 3)) for t in range(iters) for o in range(n)]
    teams = [(t, g, (rng.standard_normal(p) * 0.4 + [0.0, 2.0]).tolist()) for t in range(iters) for g in range(3)]
    covs = []
    for t in range(iters):
        a = rng.standard_normal((p, p))
        covs.append((t, (a @ a.T + np.eye(p)).ravel().tolist()))
    return (
        spark.createDataFrame(samples, "iter int, obs_id int, grp int"),
        spark.createDataFrame(teams, "iter int, grp int, mu array<double>"),
        spark.createDataFrame(covs, "iter int, cov array<double>"),
        spark.createDataFrame([(o, data[o].tolist()) for o in range(n)], "cell_id int, pcs array<double>"),
        data,
    )


def test_predictive_means_are_those_of_the_replicates(spark):
    samples, teams, covs, cells, data = chain(spark)
    y = posterior.replicate_data(samples, teams, covs, 2, seed=9).toPandas()
    assert len(y) == 30 * 25
    means = np.array([np.stack(g["y"]).mean(0) for _, g in y.groupby("iter")])
    seen = data.mean(0)
    share = (means >= seen).mean(0)
    got = {r.dim: r for r in posterior.ppc_means(samples, teams, covs, cells, 2, seed=9).collect()}
    for d in (1, 2):
        assert got[d].obs_mean == pytest.approx(seen[d - 1]) and got[d].n_iter == 30
        assert got[d].ppp == pytest.approx(min(share[d - 1], 1 - share[d - 1])) and got[d].flag == (got[d].ppp < 0.025)
    assert any(got[d].ppp > 0 for d in got) and got[2].ppp < 0.5


def test_replicates_have_the_given_spread(spark):
    rows = [(0, o, 1) for o in range(4000)]
    samples = spark.createDataFrame(rows, "iter int, obs_id int, grp int")
    teams = spark.createDataFrame([(0, 1, [5.0, -2.0])], "iter int, grp int, mu array<double>")
    covs = spark.createDataFrame([(0, [2.0, 0.8, 0.8, 1.0])], "iter int, cov array<double>")
    y = np.stack(posterior.replicate_data(samples, teams, covs, 2, seed=3).toPandas()["y"])
    assert np.allclose(y.mean(0), [5, -2], atol=0.1) and np.allclose(np.cov(y.T), [[2, 0.8], [0.8, 1]], atol=0.12)


def plain_representative(rows):
    iters = sorted({t for t, _, _ in rows})
    obs = sorted({o for _, o, _ in rows})
    w = {}
    for t in iters:
        lab = {o: g for i, o, g in rows if i == t}
        w[t] = np.array([[float(lab[a] == lab[b]) for b in obs] for a in obs])
    mean = sum(w.values()) / len(iters)
    return min(iters, key=lambda t: (round(float(((w[t] - mean) ** 2).sum()), 6), t))


def test_partitions_equal_up_to_names_are_one(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 3, 20) for _ in range(4)]
    rows = []
    for t in range(24):
        names = rng.permutation(["x", "y", "z", "u", "v"])[:3]
        rows += [(t, o, str(names[g])) for o, g in enumerate(base[t % 4 if t < 18 else 2])]
    seen = []
    real = posterior.partition_overlap
    monkeypatch.setattr(posterior, "partition_overlap", lambda df, by=(): (seen.append(df.select("iter").distinct().count()), real(df, by))[1])
    df = spark.createDataFrame(rows, "iter int, obs_id int, label string")
    assert posterior.representative_iteration(df, modal_only=False).first()["iter"] == plain_representative(rows)
    assert seen == [4]


@pytest.mark.parametrize("few", [8, 2])
def test_reference_shard_is_that_of_all_pairs(spark, monkeypatch, few):
    from cytomesh.operators import shards

    monkeypatch.setattr(shards, "CANDIDATES", few)
    rng = np.random.default_rng(few)
    rows = [(s, c, int(rng.integers(1, 30)), (rng.standard_normal(2) + [s % 5, c]).tolist()) for s in range(25) for c in range(int(rng.integers(1, 5)))]
    rows += [(30, c, n, m) for s, c, n, m in rows if s == 7]  # two equal shards
    summary = spark.createDataFrame(rows, "shard_id int, cluster int, n_obs long, mean array<double>")
    costs = {r.shard_id: r.avg_cost for r in shards.shard_distances(summary, 2).collect()}
    got = shards.select_reference_shard(summary, 2).first()
    assert got.shard_id == min(costs, key=lambda s: (round(costs[s], 9), s)) and got.avg_cost == pytest.approx(costs[got.shard_id])
    assert shards.select_reference_shard(summary.where("false"), 2).count() == 0


def test_transport_ends_and_is_exact():
    import itertools

    from cytomesh.functions.kernels import transport_cost

    rng = np.random.default_rng(0)
    for t in range(1500):
        n, m = rng.integers(1, 9, 2)
        w, v = rng.integers(1, 30, n).astype(float), rng.integers(1, 30, m).astype(float)
        a, b = np.sort(rng.integers(0, 6, n) * 1.0), np.sort(rng.standard_normal(m))
        x, y = np.cumsum(w / w.sum()), np.cumsum(v / v.sum())
        cuts = np.unique(np.concatenate([[0], x, y]))
        mid = (cuts[1:] + cuts[:-1]) / 2
        want = (np.diff(cuts) * (a[np.minimum(np.searchsorted(x, mid), n - 1)] - b[np.minimum(np.searchsorted(y, mid), m - 1)]) ** 2).sum()
        assert transport_cost(w, v, (a[:, None] - b[None]) ** 2) == pytest.approx(want, abs=1e-9)
        assert transport_cost(w, w, (a[:, None] - a[None]) ** 2) == pytest.approx(0, abs=1e-9)  # ties and equal sets
    for _ in range(100):
        c = rng.random((5, 5))
        want = min(sum(c[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5))) / 5
        assert transport_cost(np.ones(5), np.ones(5), c) == pytest.approx(want)
