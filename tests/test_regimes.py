"""Bootstraps of regimes, kernel machines and silhouettes against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlume.functions import arrays
from barlume.operators import bootstraps, kernel, regime
from barlume.plans import staging


@pytest.fixture
def vectors(frame):
    return lambda x, *more: frame([(i, [float(v) for v in r], *(m[i] for m in more)) for i, r in enumerate(x)], "id bigint, v array<double>" + "".join(f", y{j} int" for j in range(len(more))))


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def balanced(scores, rounds):
    a = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
    for _ in range(rounds):
        a = a / a.sum(axis=1, keepdims=True) / len(a)
        a = a / a.sum(axis=0, keepdims=True) / a.shape[1]
    return a / a.sum(axis=1, keepdims=True)


def one_by_one(d):
    n, k = d.shape
    free, out = [n // k + (j < n % k) for j in range(k)], np.full(n, -1)
    for i in np.lexsort((np.arange(n), d.min(axis=1))):
        out[i] = next(j for j in np.argsort(d[i], kind="stable") if free[j])
        free[out[i]] -= 1
    return out


@pytest.mark.parametrize(("n", "k", "block"), [(403, 4, 7), (60, 7, 1000), (3, 5, 2), (50, 1, 9)])
def test_balanced_labels_equal_the_sequential_pass(vectors, n, k, block):
    d = np.round(np.random.default_rng(n).random((n, k)) * np.linspace(0.2, 1, k), 2)  # ties, and one regime that all prefer
    got = [r[0] for r in bootstraps.balanced_labels(vectors(d), "id", "v", block).orderBy("id").select("cluster_id").collect()]
    assert got == one_by_one(d).tolist()


def test_sinkhorn_and_prototypes_equal_numpy(vectors):
    rng = np.random.default_rng(1)
    x, p = unit(np.vstack([rng.normal(size=(150, 5)) + 2 * np.eye(5)[rng.integers(0, 3, 150)], np.zeros((1, 5))])), unit(rng.normal(size=(3, 5)))
    df = vectors(x)
    a = bootstraps.with_assignments(df, "v", p, bootstraps.sinkhorn_columns(df, "v", p, 0.1, 3)).orderBy("id").select("__a").collect()
    np.testing.assert_allclose([r[0] for r in a], balanced(x @ p.T / 0.1, 3), atol=1e-12)
    want = p
    for _ in range(4):
        want = unit(balanced(x @ want.T / 0.1, 3).T @ x)
    np.testing.assert_allclose(bootstraps.fit_prototypes(df, "v", 3, epochs=4, initial=p), want, atol=1e-9)
    got = bootstraps.prototype_regimes(df, "id", "v", 3, epochs=4, initial=p).orderBy("id").collect()
    d = 1 - x @ want.T
    labels = one_by_one(np.round(d, 12))
    assert np.mean([r["cluster_id"] == k for r, k in zip(got, labels, strict=True)]) > 0.97  # distances that are equal but for rounding may swap
    assert sorted(np.bincount([r["cluster_id"] for r in got])) == [50, 50, 51]
    assert abs(np.mean([r["distance"] for r in got]) - d[np.arange(len(d)), labels].mean()) < 1e-3


def test_prototypes_refuse(vectors):
    df = vectors(np.eye(3))
    for bad in ({"k": 1}, {"k": 4}, {"epochs": 0}, {"rounds": 0}, {"temperature": 0.0}):
        with pytest.raises(ValueError, match="there"):
            bootstraps.prototype_regimes(df, "id", "v", **{"k": 2, **bad})


def contexts(x, bars):
    padded = np.vstack([np.repeat(x[:1], bars - 1, axis=0), x])
    return np.array([padded[i : i + bars].ravel() for i in range(len(x))])


def test_temporal_encoder_equals_numpy(spark, frame):
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(size=(40, 2)).cumsum(axis=0), "b": rng.normal(size=(25, 2)) + 5, "c": rng.normal(size=(1, 2))}
    rows = [(s, t, float(v[0]), float(v[1])) for s, x in series.items() for t, v in enumerate(x)]
    df = frame(rows, "s string, t int, p double, q double")
    e = bootstraps.TemporalEncoder("s", "t", ["p", "q"], bars=3, size=4, negatives=5).fit(df)
    c = {s: contexts(x, 3) for s, x in series.items()}
    every = np.vstack(list(c.values()))
    z = {s: (x - every.mean(axis=0)) / every.std(axis=0) for s, x in c.items()}
    # the draws are Spark's hash of (seed, place, number)
    hashes = {r["t"]: r["h"] for r in spark.range(40).select(F.row_number().over(bootstraps.Window.orderBy("id")).alias("n")).select((F.col("n") - 1).alias("t")).select("t", F.array(*[F.xxhash64(F.lit(7), F.col("t"), F.lit(j)) for j in range(5)]).alias("h")).collect()}
    pairs = {s: [(t, h % len(x)) for t in range(len(x) - 1) for h in hashes[t]] for s, x in z.items()}
    near = np.vstack([x[1:] - x[:-1] for x in z.values()]).mean(axis=0)
    far = np.mean([z[s][j] - z[s][i] for s, own in pairs.items() for i, j in own], axis=0)
    np.testing.assert_allclose(e.directions["contrast"], near - far, atol=1e-12)
    axes = np.linalg.svd(np.vstack(list(z.values())), full_matrices=False)[2]
    want = unit(np.vstack([near - far, axes[:3]]))
    np.testing.assert_allclose(np.abs((e.projection * want).sum(axis=1)), 1, atol=1e-9)
    emb = {s: unit(x @ e.projection.T) for s, x in z.items()}
    got = {(r["s"], r["t"]): r["__e"] for r in e.encode(df).collect()}
    assert len(got) == len(rows)
    for s, x in emb.items():
        np.testing.assert_allclose([got[s, t] for t in range(len(x))], x, atol=1e-9)
    positive = np.mean(np.concatenate([(x[1:] * x[:-1]).sum(axis=1) for x in emb.values()]))
    negative = np.mean([emb[s][i] @ emb[s][j] for s, own in pairs.items() for i, j in own])
    assert abs(e.positive - positive) < 1e-9 and abs(e.negative - negative) < 1e-9 and abs(e.loss - max(0, 1 - positive + negative)) < 1e-9
    assert bootstraps.embedding_regimes(df, e, 2).groupBy("cluster_id").count().count() == 2


def test_temporal_encoder_refuses(frame):
    for bad in ({"bars": 0}, {"size": 0}, {"negatives": 0}):
        with pytest.raises(ValueError, match="at least 1"):
            bootstraps.TemporalEncoder("s", "t", ["p"], **bad)
    with pytest.raises(RuntimeError):
        bootstraps.TemporalEncoder("s", "t", ["p"]).encode(frame([("a", 0, 1.0)], "s string, t int, p double"))
    with pytest.raises(ValueError, match="two rows"):
        bootstraps.TemporalEncoder("s", "t", ["p"]).fit(frame([("a", 0, 1.0)], "s string, t int, p double"))


def test_embedding_regimes_take_any_encoder(vectors):
    x = np.repeat(np.eye(3), 20, axis=0) + np.random.default_rng(0).normal(size=(60, 3)) * 0.05
    df = vectors(x)

    class Doubling:
        fitted = 0

        def fit(self, df):
            self.fitted += 1

        def encode(self, df):
            return df.withColumn("__e", F.concat("v", "v"))

    e = Doubling()
    out = [r["cluster_id"] for r in bootstraps.embedding_regimes(df, e, 3, fit_encoder=True).orderBy("id").collect()]
    assert e.fitted == 1 and [len({*out[i : i + 20]}) for i in (0, 20, 40)] == [1, 1, 1] and len(set(out)) == 3
    bootstraps.embedding_regimes(df, e, 3)
    assert e.fitted == 1
    e.encode = lambda df: df.limit(5).withColumn("__e", F.col("v"))
    with pytest.raises(ValueError, match="each row"):
        bootstraps.embedding_regimes(df, e, 3)
    with pytest.raises(ValueError, match="two regimes"):
        bootstraps.embedding_regimes(df, e, 1)
    p = bootstraps.PrincipalEncoder("v", 2).fit(df)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    axes = np.linalg.svd(z, full_matrices=False)[2][:2]
    got = np.array([r["__e"] for r in p.encode(df).orderBy("id").collect()])
    np.testing.assert_allclose(np.abs(got), np.abs(z @ axes.T), atol=1e-9)
    later = vectors(x[:2])  # the moments of the rows that were fitted serve others
    np.testing.assert_allclose([r["__e"] for r in p.encode(later).orderBy("id").collect()], got[:2], atol=1e-12)


def rings(n=400, seed=0):
    rng = np.random.default_rng(seed)
    r, a = np.concatenate([rng.normal(1, 0.2, n // 2), rng.normal(2, 0.25, n // 2)]), rng.random(n) * 2 * np.pi
    return np.stack([r * np.cos(a), r * np.sin(a)], axis=1), (np.arange(n) >= n // 2).astype(int)


def exact_machine(x, y, c=1.0):
    """The same machine with the RBF kernel itself."""
    m, s = x.mean(axis=0), x.std(axis=0)
    k = lambda a, b: np.exp(-((((a - m) / s)[:, None] - ((b - m) / s)[None]) ** 2).sum(axis=2) / 2)
    n = len(x)
    system = np.block([[np.zeros((1, 1)), np.ones((1, n))], [np.ones((n, 1)), k(x, x) + np.eye(n) / c]])
    solved = np.linalg.solve(system, np.append(0, 2.0 * y - 1))
    return lambda q: k(q, x) @ solved[1:] + solved[0]


def test_kernel_machine_tells_rings_apart_as_the_exact_one_does(vectors):
    x, y = rings()
    q, truth = rings(300, 5)
    m = kernel.KernelClassifier(3, frequencies=256).fit(vectors(x, y.tolist()), "v", "y0", "id")
    got = m.predict(vectors(q), "v").orderBy("id").collect()
    p, own = np.array([r["probabilities"] for r in got]), np.array([r["prediction"] for r in got])
    exact = exact_machine(x, y)(q)
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-12 and (p[:, 2] == 0).all()
    assert np.mean(own == truth) > np.mean((exact > 0) == truth) - 0.02 > 0.9 and np.mean(own == (exact > 0)) > 0.96
    sure = p.max(axis=1) > 0.9
    assert sure.mean() > 0.5 and np.mean(own[sure] == truth[sure]) > 0.95
    linear = kernel.KernelClassifier(3, kernel="linear").fit(vectors(x, y.tolist()), "v", "y0", "id")
    assert np.mean([r["prediction"] == t for r, t in zip(linear.predict(vectors(q), "v").orderBy("id").collect(), truth, strict=True)]) < 0.7
    again = kernel.KernelClassifier.from_json(m.to_json())
    assert (again.margins(q) == m.margins(q)).all() and (again.sigmoids == m.sigmoids).all()
    both = kernel.vote(vectors(q), "v", [m, linear], [3.0, 1.0]).orderBy("id").collect()
    lp = np.array([r["probabilities"] for r in linear.predict(vectors(q), "v").orderBy("id").collect()])
    np.testing.assert_allclose([r["probabilities"] for r in both], 0.75 * p + 0.25 * lp, atol=1e-12)
    assert [r["prediction"] for r in both] == (0.75 * p + 0.25 * lp).argmax(axis=1).tolist()


def test_kernel_machine_on_odd_rows(frame, vectors):
    x, y = rings(60)
    df = vectors(x, y.tolist())
    m = kernel.KernelClassifier(2, class_weight="balanced", frequencies=32).fit(df, "v", "y0", "id")
    odd = m.predict(frame([(0, None), (1, [1.0]), (2, [None, 1.0]), (3, [1.0, 0.0])], "id int, v array<double>"), "v").orderBy("id").collect()
    assert [r["prediction"] is None and r["probabilities"] is None for r in odd] == [True, True, True, False]
    for bad in ({"n_regimes": 1}, {"folds": 1}, {"kernel": "cubic"}, {"class_weight": "odd"}):
        with pytest.raises(ValueError, match=r"there must|unknown"):
            kernel.KernelClassifier(**bad)
    with pytest.raises(ValueError, match="classes"):
        kernel.KernelClassifier(2).fit(df.filter("y0 = 1"), "v", "y0", "id")
    with pytest.raises(ValueError, match="classes"):
        kernel.KernelClassifier(2).fit(df.withColumn("y0", F.col("y0") + 5), "v", "y0", "id")
    with pytest.raises(ValueError, match="state"):
        kernel.KernelClassifier.from_json("[]")
    with pytest.raises(RuntimeError):
        kernel.KernelClassifier(2).predict(df, "v")
    with pytest.raises(ValueError, match="agree"):
        kernel.vote(df, "v", [])


def brute_silhouettes(x, y):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    out = []
    for i in range(len(x)):
        own = y == y[i]
        a, b = d[i, own].sum() / max(1, own.sum() - 1), min(d[i, y == k].mean() for k in set(y.tolist()) - {int(y[i])})
        out.append(0.0 if own.sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("block_bytes", [1 << 24, 600])
def test_silhouettes_equal_brute_force(vectors, block_bytes):
    rng = np.random.default_rng(4)
    y = np.array([0] * 30 + [1] * 20 + [2] * 9 + [3])
    x = rng.normal(size=(60, 4)) + y[:, None]
    x[5] = x[6]
    df, want = vectors(x, y.tolist()), brute_silhouettes(x, y)
    got = dict(regime.silhouettes(df, "id", "v", "y0", block_bytes=block_bytes).collect())
    np.testing.assert_allclose([got[i] for i in range(60)], want, atol=1e-7)
    some = dict(regime.silhouettes(df, "id", "v", "y0", F.col("id") % 7 == 0, block_bytes=block_bytes).collect())
    assert set(some) == set(range(0, 60, 7)) and all(abs(v - got[i]) < 1e-9 for i, v in some.items())
    q = regime.cluster_quality(df, "id", "v", "y0", F.lit(True)).first()
    assert abs(q["silhouette"] - want.mean()) < 1e-7 and q["n_singletons"] == 1 and abs(q["min_cluster_fraction"] - 1 / 60) < 1e-12


def test_quality_of_little(vectors, frame):
    one = regime.cluster_quality(vectors(np.eye(3), [1, 1, 1]), "id", "v", "y0", F.lit(True)).first().asDict()
    assert one == {"davies_bouldin": None, "calinski_harabasz": None, "min_cluster_fraction": 1.0, "n_singletons": 0, "simplified_silhouette": None, "silhouette": None}
    assert regime.silhouettes(vectors(np.eye(3), [1, 1, 1]), "id", "v", "y0").filter("silhouette IS NOT NULL").count() == 0
    none = frame([], "id bigint, v array<double>, y int")
    assert regime.cluster_quality(none, "id", "v", "y").first()["min_cluster_fraction"] is None
    assert regime.silhouettes(none, "id", "v", "y").count() == regime.nearest_centroid(none, "id", "v", "y").count() == 0


def test_moments_axes_and_order(spark, vectors):
    x = np.random.default_rng(6).normal(size=(101, 3)) * [1, 5, 0] + [1e6, 0, 7]
    n, mean, spread = arrays.moments(vectors(x), "v")
    assert n == 101 and np.allclose(mean, x.mean(axis=0)) and np.allclose(spread[:2], x.std(axis=0)[:2], atol=1e-9) and spread[2] == 1
    axes = np.linalg.svd(x, full_matrices=False)[2]
    np.testing.assert_allclose(np.abs((arrays.principal_axes(vectors(x), "v") * axes).sum(axis=1))[:2], 1, atol=1e-9)
    rows = staging.in_order(spark.range(1000).withColumn("x", F.col("id") * 7919 % 1000), F.col("x")).collect()
    assert all(r["__rank"] == r["x"] for r in rows)
    for bad in ([[1.0], [1.0, 2.0]], [[None]], [[float("nan")]], []):
        with pytest.raises(ValueError, match="complete"):
            arrays.dimension(spark.createDataFrame([(b,) for b in bad], "v array<double>"), "v")
