"""Two-covariance model and variational speakers against plain loops."""

import math

import numpy as np
import pytest

from veloquent.operators import variational as V


def planted(seed, speakers=6, each=15, d=5, noise=0.15):
    rng = np.random.default_rng(seed)
    own = rng.standard_normal((speakers, d))
    return np.repeat(own, each, 0) + noise * rng.standard_normal((speakers * each, d)), np.repeat(np.arange(speakers), each)


def plain_memberships(f, spread, labels, fa, fb, rounds):
    """The same steps, number by number."""
    n, d, k = len(f), len(spread), int(max(labels)) + 1
    held = [[math.exp(7.0 * (labels[i] == c)) for c in range(k)] for i in range(n)]
    held = [[v / sum(row) for v in row] for row in held]
    weight, bounds = [1 / k] * k, []
    for _ in range(rounds):
        var, at = [[0.0] * d for _ in range(k)], [[0.0] * d for _ in range(k)]
        for c in range(k):
            for j in range(d):
                var[c][j] = 1 / (1 + fa / fb * sum(held[i][c] for i in range(n)) * spread[j])
                at[c][j] = fa / fb * var[c][j] * sum(held[i][c] * f[i][j] * math.sqrt(spread[j]) for i in range(n))
        bound = 0.0
        for i in range(n):
            joint = []
            for c in range(k):
                # the expected log density of f about sqrt(spread) * place, whose variance is var
                fit = sum(-0.5 * math.log(2 * math.pi) - 0.5 * ((f[i][j] - math.sqrt(spread[j]) * at[c][j]) ** 2 + spread[j] * var[c][j]) for j in range(d))
                joint.append(math.exp(fa * fit) * weight[c])
            bound += math.log(sum(joint))
            held[i] = [v / sum(joint) for v in joint]
        weight = [sum(held[i][c] for i in range(n)) / n for c in range(k)]
        bounds.append(bound + fb / 2 * sum(math.log(v) - v - a * a + 1 for vs, xs in zip(var, at) for v, a in zip(vs, xs)))
        if len(bounds) > 1 and bounds[-1] - bounds[-2] < 1e-4:
            break
    return held, weight, bounds


@pytest.mark.parametrize("seed,fa,fb", [(1, 0.07, 0.8), (2, 0.4, 1.0), (3, 1.0, 11.0)])
def test_memberships_equal_plain_loops(seed, fa, fb):
    x, truth = planted(seed, 4, 8, 3)
    spread = np.array([6.0, 2.0, 0.3])
    rough = np.where(np.arange(len(x)) % 5 == 0, (truth + 1) % 4, truth)  # every fifth row starts wrong
    held, weight, bounds = V.memberships(x, spread, rough, fa, fb)
    want = plain_memberships(x.tolist(), spread.tolist(), rough.tolist(), fa, fb, 20)
    assert np.allclose(held, want[0]) and np.allclose(weight, want[1]) and np.allclose(bounds, want[2])


@pytest.mark.parametrize("seed", range(8))
def test_bound_never_falls(seed):
    rng = np.random.default_rng(seed)
    x, _ = planted(seed, 5, 12, 4, 0.6)
    _, weight, bounds = V.memberships(x, np.sort(rng.uniform(0, 8, 4))[::-1], rng.integers(0, 9, len(x)), 0.3, 0.8, gain=-1)
    assert len(bounds) == 20 and all(b >= a - 1e-9 for a, b in zip(bounds, bounds[1:])) and abs(weight.sum() - 1) < 1e-9


def test_projection_equals_plain_covariances(spark):
    x, truth = planted(4, 7, 20, 6, 0.3)
    rows = [(int(k), v.tolist()) for k, v in zip(truth, x)]
    odd = [(None, [1.0] * 6), (1, None), (2, [1.0] * 5 + [float("nan")]), (2, [None] + [1.0] * 5)]
    got = V.fit_projection(spark.createDataFrame(rows + odd, "label bigint, vec array<double>").repartition(5))
    unit = np.array([v / np.linalg.norm(v) for v in x])
    z = np.array([(u - unit.mean(0)) / np.linalg.norm(u - unit.mean(0)) * math.sqrt(6) for u in unit])
    means = {k: z[truth == k].mean(0) for k in range(7)}
    within = sum(np.outer(v - means[k], v - means[k]) for k, v in zip(truth, z)) / (140 - 7)
    spread = sum(20 * np.outer(m - z.mean(0), m - z.mean(0)) for m in means.values())
    between = (spread - 6 * within) / (140 - 7 * 400 / 140)
    assert np.allclose(got.mean, unit.mean(0)) and np.allclose(got.centre, z.mean(0))
    assert np.allclose(got.rows @ within @ got.rows.T, np.eye(len(got.rows)), atol=1e-5)
    assert np.allclose(got.rows @ between @ got.rows.T, np.diag(got.spread), atol=1e-4 * got.spread[0])
    assert (np.diff(got.spread) <= 0).all() and (got.spread > 0).all() and len(got.rows) >= 5


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0]), (1, [2.0, 1.0])], [(1, [1.0, 2.0]), (2, [2.0, 1.0])]])
def test_too_little_to_fit(spark, rows):
    with pytest.raises(ValueError):
        V.fit_projection(spark.createDataFrame(rows, "label bigint, vec array<double>"))


def test_clusters_of_files(spark):
    x, truth = planted(5, 4, 12, 16, 0.05)
    order = np.random.default_rng(0).permutation(len(x))
    rows = [(f, int(p), int(truth[i]), x[i].tolist(), "x") for f in (1, 2) for p, i in enumerate(order)]
    rows += [(1, 900, 0, None, "x"), (2, 901, 0, [float("inf")] * 16, None), (3, 0, None, [1.0] * 16, "y")]
    table = spark.createDataFrame(rows, "file_id bigint, pos bigint, label bigint, vec array<double>, cluster string")
    fitted = V.fit_projection(table)
    got = {(r.file_id, r.pos): r.cluster for r in V.clusters(table, fitted).collect()}
    names = list(dict.fromkeys(truth[order].tolist()))
    want = {(f, p): names.index(truth[i]) for f in (1, 2) for p, i in enumerate(order)} | {(3, 0): 0}
    assert got == want
    assert len({r.cluster for r in V.clusters(table, fitted, most=2).collect() if r.file_id == 1}) == 2
    assert V.clusters(table.limit(0), fitted).count() == 0


def test_wrong_splits_of_the_linkage_join(spark):
    """Two rough clusters of one speaker become one: the second's share vanishes."""
    x, truth = planted(6, 3, 30, 8, 0.2)
    rows = [(int(k), v.tolist()) for k, v in zip(truth, x)]
    fitted = V.fit_projection(spark.createDataFrame(rows, "label bigint, vec array<double>"))
    rough = truth + 3 * (np.arange(len(x)) % 2)
    _, weight, _ = V.memberships(fitted(x), fitted.spread, rough, rounds=500, gain=-1)
    assert (weight > V.SHARE).sum() < 6
