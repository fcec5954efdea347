"""Validation of information scores against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlume.operators import selection, validation


def data(n=160, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = x[:, 0] + 0.3 * rng.normal(size=n)
    z = x[:, 0] + 0.1 * x[:, 1] + 0.05 * rng.normal(size=n)
    x[3, 1] = np.nan
    return x, y, z


@pytest.fixture
def table(frame):
    def made(n=160, seed=3):
        x, y, z = data(n, seed)
        rows = [(g, i, *(None if np.isnan(v) else float(v) for v in r), float(p), float(q)) for g in ("a", "b") for i, (r, p, q) in enumerate(zip(x, y, z, strict=True))]
        return frame(rows + [("few", i, 1.0, 2.0, 3.0, 4.0, 5.0) for i in range(5)], "g string, i int, x0 double, x1 double, x2 double, y double, z double").repartition(3)

    return made


FEATURES = ["x0", "x1", "x2"]


def test_paired_targets_equal_numpy(table):
    got = {(r["g"], r["feature"]): r for r in validation.paired_targets(table(), "i", FEATURES, "y", "z", replicates=23, by=["g"], block=7).collect()}
    assert len(got) == 9
    x, y, z = data()
    for j, f in enumerate(FEATURES):
        ok = ~np.isnan(x[:, j])
        a, p, q = x[ok, j], y[ok], z[ok]
        seen = [selection.ksg(a, t, 3, np.random.default_rng(42)) for t in (p, q)]
        gaps = []
        for r in range(23):
            at = np.random.default_rng([42, r]).integers(0, len(a), len(a))
            one, two = (selection.ksg(a[at], t[at], 3, np.random.default_rng([42, r, 1])) for t in (p, q))
            gaps.append(two - one)
        row = got["a", f]
        want = [*seen, seen[1] - seen[0], *np.percentile(gaps, [2.5, 97.5]), np.mean(np.array(gaps) <= 0)]
        np.testing.assert_allclose([row[c] for c in ("first_mi", "second_mi", "difference", "low", "high", "p_value")], want, atol=1e-12)
        assert row["n"] == ok.sum() and tuple(got["b", f])[2:] == tuple(row)[2:]
        assert got["few", f]["difference"] is None and got["few", f]["p_value"] is None and got["few", f]["n"] == 5
    assert got["a", "x0"]["p_value"] < 0.05  # z is the cleaner target


def test_two_target_report(table):
    out = {(r["g"], r["feature"]): r for r in validation.two_target_report(table(), "i", FEATURES, "y", "z", replicates=40, by=["g"]).collect()}
    x, y, _ = data()
    r = out["a", "x0"]
    perm = []
    for k in range(40):
        rng = np.random.default_rng([2042, k])
        at = rng.permutation(160)
        perm.append(selection.ksg(x[:, 0], y[at], 3, np.random.default_rng([2042, k, 1])))
    seen = selection.ksg(x[:, 0], y, 3, np.random.default_rng(2042))
    assert r["first_p_value"] == np.mean(np.array(perm) >= seen) == 0 and r["first_low"] <= r["first_mi"] <= r["first_high"]
    assert r["q_value"] >= r["p_value"] and out["a", "x2"]["second_p_value"] > 0.02 and out["few", "x0"]["q_value"] is None
    with pytest.raises(ValueError, match="unknown kind"):
        validation.drawn_scores(table(), "i", FEATURES, ["y"], "jackknife")


def test_k_sensitivity_equals_numpy(table):
    got = {(r["g"], r["feature"]): r for r in validation.k_sensitivity(table(), "i", FEATURES, "y", by=["g"]).collect()}
    x, y, _ = data()
    s = np.array([[selection.ksg(x[ok, j], y[ok], k, np.random.default_rng(42)) for j in range(3) for ok in [~np.isnan(x[:, j])]] for k in (1, 3, 5, 7)])
    ranks = np.array([[1 + sum(v > w for v in row) for w in row] for row in s + np.arange(3, 0, -1) * 1e-15])
    rho = np.mean([1 - 6 * ((a - b) ** 2).sum() / 24 for a, b in zip(ranks[:-1], ranks[1:], strict=True)])
    for j, f in enumerate(FEATURES):
        r = got["a", f]
        np.testing.assert_allclose(r["scores"], s[:, j], atol=1e-12)
        assert r["ranks"] == ranks[:, j].tolist() and abs(r["rank_correlation"] - rho) < 1e-12
        np.testing.assert_allclose([r["mean"], r["spread"]], [s[:, j].mean(), s[:, j].std(ddof=1)])
        assert got["few", f]["scores"] is None
    one = validation.k_sensitivity(table(), "i", ["x0"], "y", neighbors=(3,), by=["g"]).filter("g = 'a'").first()
    assert one["rank_correlation"] == 1.0 and one["spread"] == 0.0 and one["ranks"] == [1]
    with pytest.raises(ValueError, match="at least 1"):
        validation.k_sensitivity(table(), "i", FEATURES, "y", neighbors=(0, 3))


@pytest.mark.parametrize("temporal", [True, False])
def test_split_validation_equals_numpy(table, temporal):
    got = {(r["g"], r["feature"]): r for r in validation.split_validation(table(), "i", FEATURES, "y", temporal=temporal, top=2, by=["g"]).collect()}
    x, y, _ = data()
    at = np.arange(160) if temporal else np.random.default_rng(42).permutation(160)
    scores = []
    for part in (at[:128], at[128:]):
        own = [part[~np.isnan(x[part, j])] for j in range(3)]
        scores.append([selection.ksg(x[o, j], y[o], 3, np.random.default_rng(42)) for j, o in enumerate(own)])
    order = [sorted(range(3), key=lambda j: -s[j]) for s in scores]
    rank = [[o.index(j) + 1 for j in range(3)] for o in order]
    rho = 1 - 6 * sum((a - b) ** 2 for a, b in zip(*rank, strict=True)) / 24
    for j, f in enumerate(FEATURES):
        r = got["a", f]
        assert (r["n_train"], r["n_test"], r["train_rank"], r["test_rank"]) == (128, 32, rank[0][j], rank[1][j]) and abs(r["spearman"] - rho) < 1e-12
        np.testing.assert_allclose([r["train_mi"], r["test_mi"]], [scores[0][j], scores[1][j]], atol=1e-12)
        assert r["stable"] == (rho > 0.8) and r["top_overlap"] == len(set(order[0][:2]) & set(order[1][:2])) / 2
        assert got["few", f]["train_mi"] is None and got["few", f]["n_test"] == 1
    with pytest.raises(ValueError, match="between 0 and 1"):
        validation.split_validation(table(), "i", FEATURES, "y", test_share=1.0)


def test_effect_sizes_equal_numpy_and_do_not_depend_on_partitions(spark, frame):
    rng = np.random.default_rng(5)
    x, g = rng.normal(size=(400, 2)) + 1e3, rng.choice(["a", "b", "c"], 400)
    x[g == "a", 0] += 0.6
    x[7, 1] = np.nan
    df = frame([(i, str(k), float(v[0]), None if np.isnan(v[1]) else float(v[1]), 1.0) for i, (k, v) in enumerate(zip(g, x, strict=True))], "i bigint, g string, u double, v double, same double")
    run = lambda d: {r["feature"]: r for r in validation.effect_sizes(d, F.col("i"), "g", ["u", "v", "same"], "a", "b", replicates=200).collect()}
    got, again = run(df.repartition(1)), run(df.repartition(5))
    w = validation.draw_weights(np.arange(400), 200, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.3

    def d(values, weights):
        parts = []
        for k in ("a", "b"):
            own = (g == k) & ~np.isnan(values)
            m = np.average(values[own], weights=weights[own])
            parts.append((weights[own].sum(), m, (weights[own] * (values[own] - m) ** 2).sum()))
        (n, m, s), (n2, m2, s2) = parts
        return (m - m2) / np.sqrt((s + s2) / (n + n2 - 2))

    for j, f in enumerate(("u", "v")):
        want = [d(x[:, j], np.ones(400)), *np.percentile([d(x[:, j], v) for v in w], [2.5, 97.5])]
        for r in (got[f], again[f]):
            np.testing.assert_allclose([r["cohens_d"], r["low"], r["high"]], want, atol=1e-7)
        assert got[f]["n_first"] == ((g == "a") & ~np.isnan(x[:, j])).sum()
    assert got["u"]["low"] < got["u"]["cohens_d"] < got["u"]["high"] and got["u"]["interpretation"] == "medium"
    assert got["same"]["cohens_d"] is None and got["same"]["low"] is None
    assert run(df.limit(0))["u"]["cohens_d"] is None


def test_model_comparison(frame):
    df = frame([(1.0, 2.0, 1.0, 1.5), (-1.0, -1.0, 1.0, -1.0), (2.0, -1.0, 2.0, 2.0), (None, 1.0, 1.0, 1.0)], "y double, p double, z double, q double")
    r = validation.model_comparison(df, ("y", "p"), ("z", "q")).first()
    assert r["n"] == 3 and abs(r["first_mae"] - 4 / 3) < 1e-12 and abs(r["second_mae"] - 2.5 / 3) < 1e-12
    assert abs(r["mae_improvement"] - (4 / 3 - 2.5 / 3) / (4 / 3)) < 1e-12 and abs(r["first_directional"] - 2 / 3) < 1e-12
    earned = np.array([1.0, 1.0, -2.0])
    assert abs(r["first_sharpe"] - earned.mean() / earned.std()) < 1e-12
    assert validation.model_comparison(df.filter("y = 1"), ("y", "y"), ("z", "z")).first()["mae_improvement"] == 0.0
