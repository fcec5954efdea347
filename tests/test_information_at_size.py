"""Information across tasks where it used to go wrong or take too long: names that rows share, copies, and the pairs that meet."""

import numpy as np
import pytest

from barlume.operators import information, selection


def clouds(rng, n, copies=40):
    """Copies of places with few values of x, parted by a little noise."""
    x, y = (np.repeat(v, copies)[:n] for v in (rng.integers(0, 4, n // copies + 1).astype(float), rng.normal(size=n // copies + 1)))
    return x + 1e-10 * rng.normal(size=n), y + 1e-10 * rng.normal(size=n)


def brute(x, y, qx, qy, k, itself=False):
    d = np.maximum(np.abs(qx[:, None] - x), np.abs(qy[:, None] - y))
    if itself:
        np.fill_diagonal(d, np.inf)
    return np.pad(np.sort(d, axis=1)[:, :k], ((0, 0), (0, max(0, k - len(x)))), constant_values=np.inf)


def test_rows_that_share_a_name_count_one_by_one(frame):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = x + 0.3 * rng.normal(size=400)
    rows = frame([(i // 4, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i bigint, x double, y double")
    got = information.large_information(rows, "i", ["x"], "y", cell_rows=50).first()
    assert got["n"] == 400 and got["mi"] == pytest.approx(selection.ksg(x, y, 3, np.random.default_rng(0)), abs=1e-6)


def test_cells_and_ranges_cut_through_copies(frame):
    x, y = clouds(np.random.default_rng(1), 1200)
    points = frame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row bigint, x double, y double")
    found = information.neighbour_distances(points, 3, cell_rows=30)
    r = {p["row"]: p["r"] for p in found.collect()}
    want = brute(x, y, x, y, 3, True)[:, 2]
    assert [r[i] for i in range(1200)] == want.tolist()
    near = want * information.SHRINK
    for range_rows in (50, 5000):
        n = {(p["row"], p["axis"]): p["n"] for p in information.counts_within(found, range_rows=range_rows).collect()}
        for a, v in enumerate((x, y)):
            assert [n[i, a] for i in range(1200)] == ((v[None] >= (v - near)[:, None]) & (v[None] <= (v + near)[:, None])).sum(axis=1).tolist()


@pytest.mark.parametrize("n", [1, 2, 33, 700])
@pytest.mark.parametrize("k", [1, 3, 40])
def test_tree_equals_brute_force(n, k):
    rng = np.random.default_rng(n + k)
    for x, y in (rng.normal(size=(2, n)), clouds(rng, n), np.round(rng.normal(size=(2, n)))):
        tree = information.Tree(x, y, max(information.LEAF, k + 1))
        at, d = tree.own(k)
        assert sorted(at.tolist()) == list(range(n)) and np.array_equal(d, brute(x, y, x, y, k, True)[at])
        qx, qy = 2 * rng.normal(size=(2, 60))
        want, r = brute(x, y, qx, qy, k), np.full(60, 0.3)
        assert np.array_equal(tree.others(qx, qy, np.full(60, np.inf), k), want)
        assert np.array_equal(np.minimum(tree.others(qx, qy, r, k), 0.3), np.minimum(want, 0.3))


def test_a_point_meets_few_others(monkeypatch):
    """What a point costs does not grow with its cell: all pairs of a cell met before."""
    rng, met, real = np.random.default_rng(2), [], information.Tree.distances
    monkeypatch.setattr(information.Tree, "distances", lambda self, *a: met.append(real(self, *a)) or met[-1])
    for x, y in (rng.normal(size=(2, 20_000)), clouds(rng, 20_000)):
        met.clear()
        information.Tree(x, y).own(3)
        assert sum(d.size for d in met) < 20_000 * 500
