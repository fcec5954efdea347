"""Whether scores of mutual information hold: two targets over the same draws, neighbours, splits, effect sizes, models.

What the neighbours of a series tell is computed where the series lies whole, in a task for each feature, group and block of
draws. Effect sizes take any number of rows: their draws are weights of rows, so that sums over all rows are enough.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.operators.selection import benjamini_hochberg, grouped_scores, key_schema, ksg, ksg_many
from barlume.plans.staging import staged, summed

LEAST = 100  # rows below which two targets are not compared
LEAST_SPLIT = 10  # rows below which a part of a split is not scored


def with_targets(df: DataFrame, row_id: str, features: list[str], targets: list[str], by: list[str]) -> DataFrame:
    """(by, row, feature, value, y0, y1, ...) of the rows that have the feature and all targets."""
    wide = df.select(*by, F.col(row_id).alias("row"), *[F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets)], *[F.col(f).cast("double").alias(f) for f in features])
    ys = [f"y{i}" for i in range(len(targets))]
    long = wide.unpivot([*by, "row", *ys], features, "feature", "value")
    return long.dropna(subset=["value", *ys])  # NaN too


def drawn_scores(df: DataFrame, row_id: str, features: list[str], targets: list[str], kind: str, replicates: int = 10_000, neighbors: int = 3, seed: int = 42, by: list[str] | None = None, least: int = LEAST, block: int = 1000) -> DataFrame:
    """(by, feature, n, observed, value): for each draw an array of the scores of a feature with every target, over the same rows.

    kind is bootstrap (rows with repetition) or permutation (targets against a shuffled feature order). A draw depends on the
    seed and its number alone. With fewer than least rows there is one row, with null scores.
    """
    if kind not in ("bootstrap", "permutation"):
        raise ValueError(f"unknown kind {kind}")
    by, blocks, m = by or [], -(-replicates // block), len(targets)
    long = with_targets(df, row_id, features, targets, by).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    long = long.repartition(min(400, blocks * len(features)), *by, "feature", "block")  # small in bytes, so it would be one task
    columns = [*by, "feature", "n", "observed", "value"]

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *group, number = key
        pdf = pdf.sort_values("row")
        x, ys, n = pdf["value"].to_numpy(), [pdf[f"y{i}"].to_numpy() for i in range(m)], len(pdf)
        if n < max(least, neighbors + 1):
            return pd.DataFrame([[*group, n, None, None]] if number == 0 else [], columns=columns)
        observed = [ksg(x, y, neighbors, np.random.default_rng(seed)) for y in ys]

        def series(r: int) -> list[tuple]:
            rng = np.random.default_rng([seed, r])
            at = rng.permutation(n) if kind == "permutation" else rng.integers(0, n, n)
            own = x if kind == "permutation" else x[at]
            return [(own, y[at], np.random.default_rng([seed, r, 1])) for y in ys]

        out, own, some = [], range(number * block, min(replicates, number * block + block)), max(1, 40_000 // (n * m))
        for i in range(0, len(own), some):
            flat = ksg_many([s for r in own[i : i + some] for s in series(r)], neighbors)
            out += [flat[j : j + m] for j in range(0, len(flat), m)]
        return pd.DataFrame([[*group, n, observed, v] for v in out], columns=columns)

    return grouped_scores(long, [*by, "feature", "block"], score, key_schema(df, by) + "feature string, n bigint, observed array<double>, value array<double>")


def paired_differences(draws: DataFrame, by: list[str] | None = None, confidence: float = 0.95) -> DataFrame:
    """(by, feature, first_mi, second_mi, difference, low, high, p_value, n) from bootstrap draws of two targets.

    difference is by how much the second target's score is higher; low and high are percentiles of its draws, p_value the
    share of draws in which it is not.
    """
    d, tail = F.get("value", F.lit(1)) - F.get("value", F.lit(0)), (1 - confidence) / 2
    first, second = F.get(F.first("observed"), F.lit(0)), F.get(F.first("observed"), F.lit(1))
    return draws.groupBy(*(by or []), "feature").agg(
        first.alias("first_mi"), second.alias("second_mi"), (second - first).alias("difference"), F.percentile(d, tail).alias("low"), F.percentile(d, 1 - tail).alias("high"),
        F.avg(F.when(d.isNotNull(), (d <= 0).cast("double"))).alias("p_value"), F.first("n").alias("n"),
    )


def paired_targets(df: DataFrame, row_id: str, features: list[str], first: str, second: str, replicates: int = 10_000, neighbors: int = 3, seed: int = 42, confidence: float = 0.95, by: list[str] | None = None, **options) -> DataFrame:
    """Whether features tell more of the second target than of the first, see paired_differences()."""
    return paired_differences(drawn_scores(df, row_id, features, [first, second], "bootstrap", replicates, neighbors, seed, by, **options), by, confidence)


def two_target_report(df: DataFrame, row_id: str, features: list[str], first: str, second: str, replicates: int = 10_000, neighbors: int = 3, seed: int = 42, confidence: float = 0.95, alpha: float = 0.05, by: list[str] | None = None, **options) -> DataFrame:
    """(by, feature, n, first_*, second_*, difference, low, high, p_value, q_value, significant) of every feature.

    For both targets the score (mi), its bootstrap interval (low, high) and the permutation test (p_value); then the paired
    difference and its false discovery rate within each group by. One bootstrap gives both intervals and the difference.
    """
    by = by or []
    names, z = [*by, "feature"], NormalDist().inv_cdf(0.5 + confidence / 2)
    # draws are dear and read more than once, so they are written
    boot = staged(drawn_scores(df, row_id, features, [first, second], "bootstrap", replicates, neighbors, seed, by, **options))
    test = staged(drawn_scores(df, row_id, features, [first, second], "permutation", replicates, neighbors, seed + 2000, by, **options))
    ends = []
    for i, t in enumerate(("first", "second")):
        seen, spread = F.get(F.first("observed"), F.lit(i)), F.stddev_samp(F.get("value", F.lit(i)))
        ends += [F.when(seen.isNotNull(), F.greatest(F.lit(0.0), seen - z * spread)).alias(f"{t}_low"), (seen + z * spread).alias(f"{t}_high")]
    share = lambda i: F.avg(F.when(F.col("value").isNotNull(), (F.get("value", F.lit(i)) >= F.get("observed", F.lit(i))).cast("double")))
    tests = test.groupBy(*names).agg(share(0).alias("first_p_value"), share(1).alias("second_p_value"))
    out = paired_differences(boot, by, confidence).join(boot.groupBy(*names).agg(*ends), names).join(tests, names)
    return benjamini_hochberg(out, "p_value", alpha, by)


def ranks_in_order(values: list[float]) -> np.ndarray:
    """1 for the largest; equal ones by place."""
    return np.argsort(np.argsort(-np.asarray(values), kind="stable"), kind="stable") + 1


def rank_correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    """Of two orders of the same things; none of a single one."""
    n = len(a)
    return None if n < 2 else float(1 - 6 * ((a - b) ** 2).sum() / (n * (n * n - 1)))


def per_group(df: DataFrame, by: list[str], row_id: str, features: list[str], target: str, score, schema: str, extra: list[Column] | None = None) -> DataFrame:  # noqa: ANN001
    """Applies score(key, pandas frame) to every group by, with the features, y and what is extra, in order of rows."""
    rows = df.select(*by, F.col(row_id).alias("row"), F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features], *(extra or []))
    if not by:
        rows = rows.withColumn("__all", F.lit(0))
    return rows.groupBy(*(by or ["__all"])).applyInPandas(lambda key, pdf: score(key if by else (), pdf.sort_values("row")), schema)


def k_sensitivity(df: DataFrame, row_id: str, features: list[str], target: str, neighbors: tuple[int, ...] = (1, 3, 5, 7), seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """(by, feature, scores, ranks, mean, spread, variation, rank_correlation): one score for each number of neighbours.

    ranks are those among the features (1 is the best, ties by the features' order), rank_correlation the mean over
    neighbouring numbers of how their ranks of all features agree, 1 for a single feature or number; the variation is 0
    where the mean is. Scores are null, and all that follows, without more rows than neighbours. ValueError for numbers below 1.
    """
    if not neighbors or min(neighbors) < 1:
        raise ValueError("numbers of neighbours must be at least 1")
    by = by or []
    columns = [*by, "feature", "scores", "ranks", "mean", "spread", "variation", "rank_correlation"]

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        scores = np.full((len(neighbors), len(features)), np.nan)
        for j, f in enumerate(features):
            own = pdf[[f, "y"]].dropna()
            for i, k in enumerate(neighbors):
                if len(own) > k:
                    scores[i, j] = ksg(own[f].to_numpy(), own["y"].to_numpy(), k, np.random.default_rng(seed))
        ranks = np.array([ranks_in_order(np.nan_to_num(s, nan=-1.0)) for s in scores])
        near = [r for a, b in zip(ranks[:-1], ranks[1:], strict=True) if (r := rank_correlation(a, b)) is not None]
        rho, out = float(np.mean(near)) if near else 1.0, []
        for j, f in enumerate(features):
            s = scores[:, j]
            if np.isnan(s).any():
                out.append([*key, f, None, None, None, None, None, None])
                continue
            mean, spread = float(s.mean()), float(s.std(ddof=1)) if len(s) > 1 else 0.0
            out.append([*key, f, s.tolist(), ranks[:, j].tolist(), mean, spread, spread / mean if mean > 0 else 0.0, rho])
        return pd.DataFrame(out, columns=columns)

    return per_group(df, by, row_id, features, target, score, key_schema(df, by) + "feature string, scores array<double>, ranks array<int>, mean double, spread double, variation double, rank_correlation double")


def split_validation(df: DataFrame, row_id: str, features: list[str], target: str, test_share: float = 0.2, temporal: bool = True, neighbors: int = 3, seed: int = 42, top: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, feature, train_mi, test_mi, train_rank, test_rank, n_train, n_test, spearman, stable, top_overlap) over a split of each group's rows.

    The last floor(n * test_share) rows are the test, or as many of a shuffled order. Scores are 0 without more rows than
    neighbours; ranks as in k_sensitivity(); spearman is their correlation (1 for one feature), stable above 0.8; top_overlap
    is the share of the ``top`` best features that both parts have. All but names and counts are null where a part has fewer
    than LEAST_SPLIT rows. ValueError for a share that is not between 0 and 1.
    """
    if not 0 < test_share < 1:
        raise ValueError("the test's share is between 0 and 1")
    by = by or []
    columns = [*by, "feature", "train_mi", "test_mi", "train_rank", "test_rank", "n_train", "n_test", "spearman", "stable", "top_overlap"]

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n_test = int(len(pdf) * test_share)
        n_train = len(pdf) - n_test
        if min(n_train, n_test) < LEAST_SPLIT:
            return pd.DataFrame([[*key, f, None, None, None, None, n_train, n_test, None, None, None] for f in features], columns=columns)
        at = np.arange(len(pdf)) if temporal else np.random.default_rng(seed).permutation(len(pdf))
        scores = []
        for part in (at[:n_train], at[n_train:]):
            own = [pdf[[f, "y"]].iloc[part].dropna() for f in features]
            scores.append([ksg(o[f].to_numpy(), o["y"].to_numpy(), neighbors, np.random.default_rng(seed)) if len(o) > neighbors else 0.0 for f, o in zip(features, own, strict=True)])
        ranks = [ranks_in_order(s) for s in scores]
        rho = 1.0 if len(features) < 2 else rank_correlation(*ranks)
        both = float(((ranks[0] <= top) & (ranks[1] <= top)).sum() / top)
        return pd.DataFrame([[*key, f, scores[0][j], scores[1][j], ranks[0][j], ranks[1][j], n_train, n_test, rho, rho > 0.8, both] for j, f in enumerate(features)], columns=columns)

    return per_group(df, by, row_id, features, target, score, key_schema(df, by) + "feature string, train_mi double, test_mi double, train_rank int, test_rank int, n_train bigint, n_test bigint, spearman double, stable boolean, top_overlap double")


# ---- effect sizes

#: The chance that a row is drawn at most 0, 1, 2, ... times in a bootstrap of very many rows.
TIMES = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, i + 1, dtype=float)) for i in range(12)])


def draw_weights(rows: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each row (a 64-bit number) is drawn in each replicate: Poisson numbers that depend on seed, row and replicate alone."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64)[None, :] + (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[:, None]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(TIMES, (x >> np.uint64(11)).astype(float) / 2**53, side="right").astype(float)


def effect_sizes(df: DataFrame, row_hash: Column, group: str, values: list[str], first: object, second: object, replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(feature, cohens_d, low, high, n_first, n_second, pooled_std, mean_diff, interpretation) with percentile bootstrap intervals.

    One pass over the rows, whatever their number: in each replicate every row counts as often as a Poisson draw says, which
    depends on the seed, the replicate and row_hash (a 64-bit number of the row) alone, so the result does not depend on how
    rows are dealt. A replicate without spread takes the whole rows' value. Missing values do not count; null with fewer
    than two rows a group or without spread.
    """
    wide = df.filter(F.col(group).isin(first, second)).select(row_hash.alias("__h"), (F.col(group) == first).alias("__one"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    about = wide.agg(*[F.coalesce(F.avg(F.when(~F.isnan(f"v{i}"), F.col(f"v{i}"))), F.lit(0.0)).alias(f"v{i}") for i in range(len(values))]).first()
    middle, size = np.array(list(about)), len(values)

    def sums(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((replicates + 1, 2, 3, size))
        h, one = b.column("__h").to_numpy(), b.column("__one").to_numpy(zero_copy_only=False).astype(bool)
        x = np.stack([b.column(f"v{i}").to_numpy(zero_copy_only=False) for i in range(size)], axis=1) - middle
        there = np.isfinite(x)
        x = np.where(there, x, 0.0)
        for start in range(0, len(h), 1000):
            part = slice(start, start + 1000)
            w = np.vstack([np.ones(len(h[part])), draw_weights(h[part], replicates, seed)])
            for g, chosen in enumerate((one[part], ~one[part])):
                own = w[:, chosen]
                for m, y in enumerate((there[part].astype(float), x[part], x[part] ** 2)):
                    out[:, g, m] += own @ y[chosen]
        return out

    s = summed(wide, sums, (replicates + 1, 2, 3, size))
    n, mean = s[:, :, 0], np.divide(s[:, :, 1], s[:, :, 0], out=np.zeros_like(s[:, :, 1]), where=s[:, :, 0] > 0)
    within = np.maximum(s[:, :, 2] - n * mean**2, 0)
    free = n.sum(axis=1) - 2
    pooled = np.sqrt(np.divide(within.sum(axis=1), free, out=np.zeros_like(free), where=free > 0))
    apart = mean[:, 0] - mean[:, 1]
    d = np.divide(apart, pooled, out=np.full_like(apart, np.nan), where=(pooled > 1e-12 * (1 + np.abs(middle))) & (n.min(axis=1) > 1))
    rows = []
    for i, v in enumerate(values):
        if np.isnan(d[0, i]):
            rows.append((v, None, None, None, int(n[0, 0, i]), int(n[0, 1, i]), None, None, None))
            continue
        drawn = np.where(np.isnan(d[1:, i]), d[0, i], d[1:, i])
        low, high = np.percentile(drawn, [50 * (1 - confidence), 50 * (1 + confidence)])
        size_of = abs(d[0, i])
        word = "negligible" if size_of < 0.2 else "small" if size_of < 0.5 else "medium" if size_of < 0.8 else "large"
        rows.append((v, float(d[0, i]), float(low), float(high), int(n[0, 0, i]), int(n[0, 1, i]), float(pooled[0, i]), float(apart[0, i]), word))
    return df.sparkSession.createDataFrame(rows, "feature string, cohens_d double, low double, high double, n_first bigint, n_second bigint, pooled_std double, mean_diff double, interpretation string")


# ---- models


def model_comparison(df: DataFrame, first: tuple[str, str], second: tuple[str, str], by: list[str] | None = None) -> DataFrame:
    """(by, n, first_*, second_*, *_improvement): errors of two models, given as (truth, prediction), from one aggregation.

    mae, rmse, directional (the share of signs that agree), sharpe (mean over spread of the truth, with the prediction's
    sign). Improvements of the errors are shares of the first model's, 0 where it has none; the others are differences.
    Rows without all four values do not count.
    """
    both = df.dropna(subset=[*first, *second])
    out = [F.count("*").alias("n")]
    for name, (y, p) in (("first", first), ("second", second)):
        gap, earned = F.col(p) - F.col(y), F.signum(p) * F.col(y)
        out += [F.avg(F.abs(gap)).alias(f"{name}_mae"), F.sqrt(F.avg(gap * gap)).alias(f"{name}_rmse"), F.avg((F.signum(p) == F.signum(y)).cast("double")).alias(f"{name}_directional"), F.try_divide(F.avg(earned), F.stddev_pop(earned)).alias(f"{name}_sharpe")]
    m = both.groupBy(*(by or [])).agg(*out)
    less = lambda c: F.when(F.col(f"first_{c}") == 0, 0.0).otherwise((F.col(f"first_{c}") - F.col(f"second_{c}")) / F.col(f"first_{c}"))
    more = lambda c: F.col(f"second_{c}") - F.col(f"first_{c}")
    return m.withColumns({"mae_improvement": less("mae"), "rmse_improvement": less("rmse"), "directional_improvement": more("directional"), "sharpe_improvement": more("sharpe")})
