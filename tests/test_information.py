"""Information across tasks against the form that holds a series whole."""

import numpy as np
import pytest

from barlume.operators import information, selection


def table(frame, x, y):
    return frame([(i, None if np.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i bigint, x double, y double").repartition(5)


@pytest.mark.parametrize("cell_rows", [40, 10_000])
@pytest.mark.parametrize("k", [1, 3])
def test_large_information_equals_ksg(frame, cell_rows, k):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(size=600), rng.exponential(size=400) ** 3])
    y = np.sin(x) + 0.2 * rng.normal(size=1000)
    x[5] = np.nan
    got = information.large_information(table(frame, x, y), "i", ["x"], "y", k, cell_rows=cell_rows).first()
    ok = ~np.isnan(x)
    assert got["n"] == 999 and abs(got["mi"] - selection.ksg(x[ok], y[ok], k, np.random.default_rng(0))) < 1e-6


def test_distances_and_counts_equal_brute_force(spark, frame):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=700), rng.normal(size=700) ** 3
    points = table(frame, x, y).withColumnRenamed("i", "row")
    r = {p["row"]: p["r"] for p in information.neighbour_distances(points, 4, cell_rows=20).collect()}
    d = np.maximum(np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None]))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, 3]
    np.testing.assert_allclose([r[i] for i in range(700)], want, rtol=0, atol=0)
    n = {(p["row"], p["axis"]): p["n"] for p in information.counts_within(information.neighbour_distances(points, 4, cell_rows=20)).collect()}
    for a, v in enumerate((x, y)):
        assert [n[i, a] for i in range(700)] == (np.abs(v[:, None] - v[None]) < want[:, None] * (1 - 1e-12)).sum(axis=1).tolist()
    assert len(set(information.Cells(x, y, 6).of(x, y).tolist())) == 36


def test_little_and_equal_values(frame):
    few = information.large_information(table(frame, np.arange(3.0), np.arange(3.0)), "i", ["x"], "y")
    assert few.first()["mi"] is None and few.first()["n"] == 3
    same = information.large_information(table(frame, np.repeat([1.0, 2.0], 60), np.random.default_rng(0).normal(size=120)), "i", ["x"], "y", cell_rows=10).first()
    assert 0 <= same["mi"] < 0.3
    assert information.large_information(table(frame, np.zeros(0), np.zeros(0)), "i", ["x"], "y").first()["mi"] is None
