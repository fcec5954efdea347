"""Selection over many features, holes and families, against pandas and plain Python."""

import numpy as np
import pandas as pd
import pytest

from barlume.operators import selection


def holes(n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    x[:, 1] = np.round(x[:, 0] + rng.normal(size=n), 1)
    x[: n // 3, 2] = np.nan  # a and d are complete, c and e lack the same rows, b others
    x[: n // 3, 4] = np.nan
    x[n // 4 :: 3, 1] = np.nan
    return pd.DataFrame(x, columns=list("abcde"))


def as_table(frame, pdf):
    return frame([tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()], ", ".join(f"{c} double" for c in pdf.columns)).repartition(3)


def pairs_of(df):
    return {(r["f1"], r["f2"]): r["corr"] for r in df.collect()}


@pytest.mark.parametrize(("most", "room"), [(20_000, 2_000_000), (0, 0), (70, 100), (130, 2_000_000)])
def test_pairwise_spearman_ranks_each_pair_anew(frame, monkeypatch, most, room):
    """Domains looked up in tasks: all, none, one, some."""
    real = selection.small_domains
    monkeypatch.setattr(selection, "small_domains", lambda ranks: real(ranks, most, room))
    pdf = holes()
    names = list(pdf.columns)
    want = {}
    for i, a in enumerate(names):
        for b in names[i:]:
            both = pdf[[a, b]].dropna() if a != b else pdf[[a]].dropna()
            r = both.rank()
            want[a, b] = r[a].corr(r[b])
    got = pairs_of(selection.spearman_pairs(as_table(frame, pdf), names, listwise=False))
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    once = pdf.rank()
    assert abs(once["b"].corr(once["c"]) - want["b", "c"]) > 1e-6  # ranks of the whole feature give another value
    few = pairs_of(selection.spearman_pairs(as_table(frame, pdf), names, listwise=False, min_periods=150))
    assert {k for k, v in few.items() if v is None} == {k for k in want if (pdf[k[0]].notna() & pdf[k[1]].notna()).sum() < 150} != set()


@pytest.mark.parametrize("most", [0, 60, 299, 20_000])
def test_listwise_spearman_with_domains_of_any_size(frame, monkeypatch, most):
    real = selection.small_domains
    monkeypatch.setattr(selection, "small_domains", lambda ranks: real(ranks, most))
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.integers(0, 5, 300) * 1.0, "c": rng.integers(0, 50, 300) * 1.0, "d": rng.integers(0, 2, 300) - 0.0})
    pdf.loc[3, "c"] = np.nan
    want = pdf.dropna().corr("spearman")
    got = pairs_of(selection.spearman_pairs(as_table(frame, pdf), list("abcd")))
    assert got == {(a, b): pytest.approx(want.loc[a, b], abs=1e-12) for i, a in enumerate("abcd") for b in "abcd"[i:]}


def test_spearman_of_odd_columns(frame):
    df = frame([(1.0, None, 3.0, float("nan")), (2.0, None, 3.0, float("inf")), (None, 5.0, 3.0, 1.0), (None, 6.0, 3.0, 2.0)], "a double, b double, c double, d double")
    got = pairs_of(selection.spearman_pairs(df, list("abcd"), listwise=False))
    assert len(got) == 10 and got["a", "b"] is None and got["a", "c"] is None and got["a", "d"] is None and got["a", "a"] == got["b", "b"] == got["d", "d"] == got["b", "d"] == 1.0
    assert all(v is None for v in pairs_of(selection.spearman_pairs(df.limit(0), list("ab"))).values())


def test_value_ranks_equal_pandas(frame):
    rng = np.random.default_rng(0)
    rows = [(f, float(v)) for f in "xy" for v in rng.integers(0, 40, 500)] + [("x", 7.0)] * 400
    long = frame(rows, "f string, value double").repartition(7)
    pdf = pd.DataFrame(rows, columns=["f", "value"])
    pdf["rank"] = pdf.groupby("f")["value"].rank()
    assert {(r["f"], r["value"]): r["rank"] for r in selection.value_ranks(long, ["f"]).collect()} == {(f, v): r for f, v, r in pdf.itertuples(index=False)}


def test_correlations_in_blocks(frame):
    pdf = holes()
    names = list(pdf.columns)
    df = as_table(frame, pdf)
    for listwise in (True, False):
        assert pairs_of(selection.correlation_pairs(df, names, listwise, block=2)) == {k: pytest.approx(v, abs=1e-12) for k, v in pairs_of(selection.correlation_pairs(df, names, listwise)).items()}


def brute_mrmr(c, target, names, k, denominator, same_domain):
    chosen, left = [], sorted(names)
    while left and len(chosen) < k:
        def score(f):
            past = [c[f, s] for s, *_ in chosen if not same_domain or s.split("_")[0] == f.split("_")[0]]
            return c[f, target] - ((max(past) if denominator == "max" else sum(past) / len(past)) if past else 0.0)

        best = max(left, key=score)  # the first of equal ones
        chosen.append((best, score(best)))
        left.remove(best)
    return chosen


@pytest.mark.parametrize(("denominator", "same_domain"), [("mean", False), ("max", False), ("mean", True)])
def test_mrmr_by_steps_equals_the_whole_matrix(frame, denominator, same_domain):
    rng = np.random.default_rng(7)
    n, width = 250, 60
    base = rng.normal(size=(n, 8))
    x = base[:, rng.integers(0, 8, width)] + rng.normal(size=(n, width))
    x[:, 5], x[10:40, 6] = 3.0, np.nan
    names = [f"{'pqr'[i % 3]}_{i:02d}" for i in range(width)]
    pdf = pd.DataFrame(x, columns=names).assign(y=base[:, 0] + 0.5 * base[:, 1])
    c = pdf.corr().abs().fillna(0.0)
    want = brute_mrmr({(a, b): c.loc[a, b] for a in c for b in c}, "y", names, 9, denominator, same_domain)
    got = selection.mrmr(as_table(frame, pdf), "y", names, 9, denominator, same_domain)
    assert [f for f, _ in got] == [f for f, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)


def test_mrmr_takes_a_thousand_features_and_filters_them(spark, frame):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 1000))
    df = spark.createDataFrame([(i, *map(float, r), float(r[17] + 0.1 * r[400])) for i, r in enumerate(x)], "i int, " + ", ".join(f"f{j:04d} double" for j in range(1000)) + ", y double")
    names = [f"f{j:04d}" for j in range(1000)]
    got = selection.mrmr_scores(df, "y", names, 3)
    assert got[0][0] == "f0017" and got[0][1] > 0.9 and got[0][2] == 0.0 and len(got) == 3
    only = selection.mrmr(df, "y", names, 3, max_features=2, information={"f0003": 2.0, "f0400": 1.0, "f0017": 0.5})
    assert [f for f, _ in only] and {f for f, _ in only} == {"f0003", "f0400"}
    few = selection.mrmr(df, "y", names[:20], 2, max_features=3, row_id="i")
    assert few[0][0] == "f0017" and len(few) == 2
    with pytest.raises(ValueError, match="max_features"):
        selection.mrmr(df, "y", names, 3, max_features=2)
    classes = selection.mrmr_classes(df.selectExpr("f0017", "f0018", "CAST(y > 0 AS INT) AS y"), "y", ["f0017", "f0018"], 1)
    assert classes[0][0] == "f0017"


def brute_clusters(d, cut, linkage):
    groups = [[i] for i in range(len(d))]
    far = {"average": np.mean, "single": np.min, "complete": np.max}[linkage]
    while len(groups) > 1:
        h, i, j = min((far(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if h > cut:
            break
        groups[i] += groups.pop(j)
    return {x: min(g) for g in groups for x in g}


@pytest.mark.parametrize("linkage", ["average", "single", "complete"])
def test_feature_clusters_equal_step_by_step_mergers(frame, linkage):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(80, 6))
    pdf = pd.DataFrame(base[:, rng.integers(0, 6, 25)] + 0.7 * rng.normal(size=(80, 25)), columns=[f"f{i:02d}" for i in range(25)])
    got = selection.cluster_features(selection.correlation_pairs(as_table(frame, pdf), list(pdf.columns)), 0.5, linkage)
    want = brute_clusters(1 - pdf.corr().abs().to_numpy(), 0.5, linkage)
    assert sorted(got.values()) == sorted(got[f"f{i:02d}"] for i in range(25))
    for i in range(25):
        for j in range(25):
            assert (got[f"f{i:02d}"] == got[f"f{j:02d}"]) == (want[i] == want[j])
    with pytest.raises(ValueError, match="linkage"):
        selection.cluster_features(selection.correlation_pairs(as_table(frame, pdf), ["f00"]), 0.5, "ward")


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_false_discovery_by_families_and_blocks(frame, block):
    rng = np.random.default_rng(4)
    rows = [(g, i, None if i % 9 == 0 else float(round(rng.random() ** 3, 2))) for g in ("a", "b", None) for i in range(90)] + [("c", 0, None)]
    got = {(r["g"], r["i"]): (r["q_value"], r["significant"]) for r in selection.benjamini_hochberg(frame(rows, "g string, i int, p double").repartition(5), "p", by=["g"], block=block).collect()}
    assert len(got) == len(rows) and got["c", 0] == (None, None)
    for g in ("a", "b", None):
        p = sorted((p, i) for k, i, p in rows if k == g and p is not None)
        q, least = {}, 1.0
        for r in range(len(p), 0, -1):
            least = min(least, p[r - 1][0] * len(p) / r)
            q[p[r - 1][1]] = least
        for i in range(90):
            assert got[g, i] == ((None, None) if i not in q else (pytest.approx(q[i], abs=1e-12), q[i] < 0.05))
