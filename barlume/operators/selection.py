"""Feature selection: correlations, mRMR, mutual information and its significance, false discovery, effect sizes."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.plans.staging import in_order, matrix, staged, summed

EPSILON = 1e-10


def pairs(features: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(features) for b in features[i:]]


def correlation_pairs(df: DataFrame, features: list[str], listwise: bool = True, block: int = 1000) -> DataFrame:
    """(f1, f2, corr) of the upper triangle and diagonal. Null where a feature does not vary.

    Each task adds up the products of its rows, as matrices, around one value a feature, and gives a row for each pair; Spark
    sums these. Without listwise every pair takes the rows that have both of it. Of more than block features, two blocks at a
    time are taken, so a task's six matrices have at most (2 * block) ** 2 numbers each.
    """
    if listwise:
        df = df.dropna(subset=features)
    if len(features) > block:
        parts, out = [features[i : i + block] for i in range(0, len(features), block)], None
        for i, a in enumerate(parts):
            for b in parts[i:]:
                own = correlation_pairs(df, a if a is b else a + b, False, 2 * block)
                own = own if a is b else own.filter(F.col("f1").isin(a) & F.col("f2").isin(b))
                out = own if out is None else out.unionByName(own)
        return out
    wide = df.select(*[F.col(f).cast("double").alias(f"{i}") for i, f in enumerate(features)])
    near = wide.agg(*[F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(0.0)).alias(c) for c in wide.columns]).first()
    around, (first, second) = np.array(list(near)), np.triu_indices(len(features))
    schema = "i int, j int, n double, x double, y double, xx double, yy double, xy double"

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(features), len(features)))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) - around
            there = np.isfinite(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            sums, squares = x.T @ there, (x * x).T @ there
            total += np.stack([there.T @ there, sums, sums.T, squares, squares.T, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), *[pa.array(t[first, second]) for t in total]], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    m = wide.mapInArrow(moments, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    both, own = F.expr("xy - x * y / n"), F.expr("(xx - x * x / n) * (yy - y * y / n)")
    spread = F.expr("n > 1 AND xx - x * x / n > 1e-12 * xx AND yy - y * y / n > 1e-12 * yy")
    name = F.array(*[F.lit(f) for f in features])
    return m.select(name[F.col("i")].alias("f1"), name[F.col("j")].alias("f2"), F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), both / F.sqrt(own)))).alias("corr"))


def long_form(df: DataFrame, row_id: str, features: list[str]) -> DataFrame:
    """(row, feature, value) without missing values."""
    return df.select(F.col(row_id).alias("row"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["row"], features, "feature", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def average_rank(value: Column, *by: str) -> Column:
    """1 for the smallest; equal values share the mean of their ranks."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def distributed_ranks(long: DataFrame, parts: int = 64) -> DataFrame:
    """(feature, value, rank): the average rank of each distinct value of a feature.

    Values are counted first. A feature is cut at about equal shares into parts; a value's rank is the count of the parts
    before, a small table, and a running sum within its part, so that no task sorts a whole feature.
    """
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    edges = long.groupBy("feature").agg(F.percentile_approx("value", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts)).alias("edges"))
    cut = counts.join(F.broadcast(edges), "feature").withColumn("part", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = cut.groupBy("feature", "part").agg(F.sum("n").alias("m")).withColumn("shift", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    running = F.sum("n").over(Window.partitionBy("feature", "part").orderBy("value"))
    ranked = cut.withColumn("upto", running).join(F.broadcast(shift), ["feature", "part"])  # rows for parts of features
    return ranked.select("feature", "value", (F.col("shift") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def value_ranks(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, rank): the average rank of each distinct value under its keys.

    Values are counted first, then dealt by ranges and sorted; each task adds up its counts, and one total a task and one a
    key go round.
    """
    counts = long.groupBy(*keys, "value").agg(F.count("*").alias("n")).repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            upto = total + np.cumsum(b.column("n").to_numpy())
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto), pa.array(np.full(b.num_rows, part, np.int32))], [*b.schema.names, "upto", "part"])

    fields = ", ".join(f"{c} {t}" for c, t in counts.dtypes)
    placed = staged(counts.mapInArrow(add, f"{fields}, upto bigint, part int"))
    earlier = lambda c: F.coalesce(F.sum("m").over(Window.orderBy(*c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # noqa: E731  a row a task or key
    parts = placed.groupBy("part").agg(F.sum("n").alias("m")).select("part", earlier(["part"]).alias("before"))
    starts = placed.groupBy(*keys).agg(F.sum("n").alias("m")).select(*keys, earlier(keys).alias("start"))
    placed = placed.join(F.broadcast(parts), "part").join(F.broadcast(starts), keys)
    return placed.select(*keys, "value", (F.col("before") + F.col("upto") - F.col("start") - (F.col("n") - 1) / 2).alias("rank"))


def presence(df: DataFrame, width: int) -> list[tuple[float, ...]]:
    """For each place of the array column v a signature of the rows that have it: places with the same rows have the same one."""
    weights = np.random.default_rng(1).integers(0, 2**64, width, dtype=np.uint64)

    def signs(b: pa.RecordBatch) -> np.ndarray:
        there = np.isfinite(matrix(b.column(0)))
        with np.errstate(over="ignore"):
            h = (there * weights).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        pieces = np.stack([np.ones(len(h)), *[((h >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(float) for i in range(4)]])
        return (pieces @ there).T

    return [tuple(x) for x in summed(df, signs, (width, 5))]


def small_domains(ranks: DataFrame, most: int = 20_000, room: int = 2_000_000) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(values, ranks), rising, of each (s, i) with up to most different values, up to room of them in all: what tasks look up by themselves."""
    small = []
    for r in ranks.groupBy("s", "i").count().orderBy("count", "s", "i").filter(F.col("count") <= most).collect():  # a row a set and feature
        room -= r["count"]
        if room < 0:
            break
        small.append((r["s"], r["i"]))
    if not small:
        return {}
    t = ranks.join(F.broadcast(ranks.sparkSession.createDataFrame(small, "s int, i int")), ["s", "i"]).select("s", "i", "value", "rank").toArrow()
    s, i, value, rank = (t[c].to_numpy() for c in ("s", "i", "value", "rank"))
    order = np.lexsort((value, i, s))
    s, i, value, rank = s[order], i[order], value[order], rank[order]
    cuts = [0, *(np.flatnonzero((np.diff(s) != 0) | (np.diff(i) != 0)) + 1), len(s)]
    return {(int(s[a]), int(i[a])): (value[a:b], rank[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


def spearman_pairs(df: DataFrame, features: list[str], listwise: bool = True, min_periods: int = 2) -> DataFrame:
    """(f1, f2, corr): Pearson of average ranks, over the rows without a missing feature, or with listwise off over each pair's own common rows, ranked anew among them.

    Features that are missing in the same rows are ranked together; where rows differ, two such groups at a time are ranked
    among the rows that have both. However many features there are, values are dealt twice: by value to meet their ranks, and
    by row; those of features with few different values stay where they are. A task then adds up products of ranks, features squared. Null with fewer than min_periods (2 at least) common
    rows, or where a feature does not vary there. Infinite values count as missing.
    """
    number = lambda f: F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double"))  # noqa: E731  not for NaN either
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.array(*[number(f) for f in features]).alias("v"))
    rows = staged(rows.filter(~F.exists("v", lambda x: x.isNull())) if listwise else rows)
    classes: dict[tuple, list[int]] = {}
    for i, sign in enumerate([(1.0,)] * len(features) if listwise else presence(rows.select("v"), len(features))):
        classes.setdefault(sign, []).append(i)
    groups = list(classes.values())
    sets = [(a, b) for i, a in enumerate(groups) for b in groups[i:]]
    parts = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(a[0]).alias("a"), F.lit(b[0]).alias("b"), F.array(*[F.lit(i) for i in sorted({*a, *b})]).alias("of")) for s, (a, b) in enumerate(sets)])
    here = F.filter(parts, lambda p: F.get("v", p["a"]).isNotNull() & F.get("v", p["b"]).isNotNull())
    long = rows.select("row", "v", F.explode(here).alias("p")).select("row", F.col("p.s").alias("s"), F.inline(F.transform("p.of", lambda i: F.struct(i.alias("i"), F.get("v", i).alias("value")))))
    ranks = staged(value_ranks(long, ["s", "i"]))
    count = {r["s"]: r["n"] for r in rows.select(F.explode(here).alias("p")).groupBy("p.s").agg(F.count("*").alias("n")).collect()}
    known = small_domains(ranks)
    members = [sorted({*a, *b}) for a, b in sets]
    few, many = ([[i for i in of if ((s, i) in known) == there] for s, of in enumerate(members)] for there in (True, False))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"))
            for s, (first, second) in enumerate(sets):
                at = np.flatnonzero(np.isfinite(v[:, first[0]]) & np.isfinite(v[:, second[0]]))
                x, n = v[at], len(at)
                found = [known[s, i][1][np.searchsorted(known[s, i][0], x[:, i])] for i in few[s]]
                lists = lambda flat, width: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat)  # noqa: B023, E731
                small = lists(pa.array(np.stack(found, axis=1).ravel() if found else np.zeros(0)), len(few[s]))
                left = pa.StructArray.from_arrays([pa.array(np.tile(many[s], n).astype(np.int32)), pa.array(x[:, many[s]].ravel())], ["i", "value"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s, np.int32)), b.column("row").take(pa.array(at)), small, lists(left, len(many[s]))], ["s", "row", "small", "large"])

    parts = rows.select("row", "v").mapInArrow(look_up, "s int, row bigint, small array<double>, large array<struct<i:int,value:double>>")
    together = parts.filter(F.size("large") == 0).select("s", "small", F.array().cast("array<double>").alias("large"))
    if any(many):  # only values of large domains are dealt, and one of a row takes what is known of it along
        dealt = parts.filter(F.size("large") > 0).select("s", "row", "small", F.posexplode("large").alias("j", "l")).select("s", "row", F.when(F.col("j") == 0, F.col("small")).alias("small"), "l.i", "l.value")
        met = dealt.join(ranks, ["s", "i", "value"])
        if max(map(len, many)) == 1:
            met = met.select("s", "small", F.array("rank").alias("large"))
        else:
            met = met.groupBy("s", "row").agg(F.first("small", ignorenulls=True).alias("small"), F.sort_array(F.collect_list(F.struct("i", "rank"))).alias("r")).select("s", "small", F.transform("r", lambda x: x["rank"]).alias("large"))
        together = together.unionByName(met) if not all(many) else met

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            which = b.column("s").to_numpy()
            for s in np.unique(which).tolist():
                own = pa.array(which == s)
                x = np.concatenate([matrix(b.column(c).filter(own)) for c, of in (("small", few[s]), ("large", many[s])) if of], axis=1) - (count[s] + 1) / 2
                total[s] = total.get(s, 0) + x.T @ x
        for s, t in total.items():
            of = np.array([*few[s], *many[s]])
            i, j = np.nonzero(of[:, None] <= of[None])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), s, np.int32)), pa.array(of[i].astype(np.int32)), pa.array(of[j].astype(np.int32)), pa.array(t[i, j])], ["s", "i", "j", "xy"])

    m = together.mapInArrow(products, "s int, i int, j int, xy double").groupBy("s", "i", "j").agg(F.sum("xy").alias("xy"))
    m = staged(m)  # features squared
    own = m.filter("i = j").select("s", "i", F.col("xy").alias("xx"))
    m = m.join(F.broadcast(own), ["s", "i"]).join(F.broadcast(own.select("s", F.col("i").alias("j"), F.col("xx").alias("yy"))), ["s", "j"])
    name = F.array(*[F.lit(f) for f in features])
    of_pair = {tuple(sorted((i, j))): s for s, (a, b) in enumerate(sets) for i in a for j in b}
    if len(sets) > 1:  # a set also ranks pairs within its groups, which are another set's
        m = m.join(F.broadcast(df.sparkSession.createDataFrame([(s, i, j) for (i, j), s in of_pair.items()], "s int, i int, j int")), ["s", "i", "j"])
    enough = F.create_map(*[F.lit(x) for s in range(len(sets)) for x in (s, count.get(s, 0) >= max(2, min_periods))])[F.col("s")]
    found = m.select(name[F.col("i")].alias("f1"), name[F.col("j")].alias("f2"), F.when(enough & (F.col("xx") > 0) & (F.col("yy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))))).alias("corr"))
    lost = [p for p, s in of_pair.items() if not count.get(s)]
    if lost:  # pairs without a common row
        found = found.unionByName(df.sparkSession.createDataFrame([(features[i], features[j], None) for i, j in lost], "f1 string, f2 string, corr double"))
    return found


def highly_correlated_pairs(correlations: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The pairs of different features with |corr| of threshold or more, strongest first."""
    return correlations.filter((F.col("f1") != F.col("f2")) & (F.abs("corr") >= threshold)).orderBy(F.desc(F.abs("corr")), "f1", "f2")


def cluster_features(correlations: DataFrame, cut: float = 0.5, linkage: str = "average") -> dict[str, int]:
    """Cluster numbers by average, single or complete linkage on 1 - |corr|, cut at a distance.

    The matrix of features is held by the driver, 8 bytes a pair. Mergers follow a chain of nearest neighbours, so each looks
    at one row of the matrix and not at all of it.
    """
    if linkage not in ("average", "single", "complete"):
        raise ValueError(f"unknown linkage {linkage}")
    rows = correlations.select("f1", "f2", F.coalesce(F.abs("corr"), F.lit(0.0)).alias("c")).toArrow()
    first, second, c = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("f1", "f2", "c"))
    names, at = np.unique(first, return_inverse=True)
    d = np.ones((len(names), len(names)))
    to = np.searchsorted(names, second)
    d[at, to] = d[to, at] = 1 - c
    np.fill_diagonal(d, np.inf)
    size, parent, alive, chain = np.ones(len(names)), np.arange(len(names)), np.ones(len(names), bool), []
    mergers: list[tuple[float, int, int]] = []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        x = chain[-1]
        y = int(np.argmin(np.where(alive, d[x], np.inf)))
        if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
            y = chain[-2]
        if len(chain) > 1 and y == chain[-2]:
            chain = chain[:-2]
            mergers.append((float(d[x, y]), x, y))
            if linkage == "average":
                joined = (size[x] * d[x] + size[y] * d[y]) / (size[x] + size[y])
            else:
                joined = (np.minimum if linkage == "single" else np.maximum)(d[x], d[y])
            d[y], d[:, y] = joined, joined
            d[y, y], size[y], alive[x] = np.inf, size[x] + size[y], False
        else:
            chain.append(y)

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for height, x, y in mergers:
        if height <= cut:
            parent[root(x)] = root(y)
    groups: dict[int, list[int]] = {}
    for i in range(len(names)):
        groups.setdefault(root(i), []).append(i)
    return {str(names[i]): k for k, g in enumerate(sorted(groups.values())) for i in g}


def correlations_with(rows: DataFrame, width: int, other: int, around: np.ndarray) -> np.ndarray:
    """|corr| of every place of the array column v with one of them, over the rows that have both; 0 where one does not vary."""

    def sums(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(0)) - around
        there = np.isfinite(x) & np.isfinite(x[:, [other]])
        x, y = np.where(there, x, 0.0), np.where(there, x[:, [other]], 0.0)
        return np.stack([there.sum(axis=0), x.sum(axis=0), y.sum(axis=0), (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)])

    n, x, y, xx, yy, xy = summed(rows, sums, (6, width))
    n = np.maximum(n, 1)
    vx, vy = xx - x * x / n, yy - y * y / n
    spread = (n > 1) & (vx > 1e-12 * xx) & (vy > 1e-12 * yy)
    return np.where(spread, np.abs(np.divide(xy - x * y / n, np.sqrt(np.abs(vx * vy)), out=np.zeros(width), where=spread)), 0.0)


def domain(f: str) -> str:
    return f.split("_")[0]


def mrmr_scores(df: DataFrame, target: str, features: list[str], k: int = 10, denominator: str = "mean", same_domain: bool = False, max_features: int = 2000, information: dict[str, float] | None = None, row_id: str | None = None) -> list[tuple[str, float, float, float]]:
    """(feature, relevance, redundancy, score) in order of selection, ties to the first name.

    relevance is |corr| with the target, redundancy the mean or greatest |corr| with those selected (with same_domain of the
    same name prefix only), the score their difference. Each step is one pass that correlates all features with the one
    selected last, so nothing grows with the square of the features. Of more than max_features (0: no bound) those that tell
    most of the target go on: by information, or by mutual_information() over row_id where that is not given.
    """
    if max_features and len(features) > max_features:
        if information is None:
            if row_id is None:
                raise ValueError("more features than max_features need information scores or a row_id to compute them")
            information = {r["feature"]: r["mi"] or 0.0 for r in mutual_information(df, row_id, features, target).collect()}
        features = sorted(sorted(features), key=lambda f: -(information.get(f) or 0.0))[:max_features]
    left = sorted(features)
    names = [*left, target]
    number = lambda f: F.coalesce(F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")), F.lit(float("nan")))
    rows = df.select(F.array(*[number(f) for f in names]).alias("v"))
    s = summed(rows, lambda b: np.stack([(t := np.isfinite(x := matrix(b.column(0)))).sum(axis=0), np.where(t, x, 0.0).sum(axis=0)]), (2, len(names)))
    around = s[1] / np.maximum(s[0], 1)
    relevance = correlations_with(rows, len(names), len(left), around)
    total, most, met = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    taken, chosen = np.zeros(len(names), bool), []
    taken[-1] = True
    for _ in range(min(k, len(left))):
        redundancy = most if denominator == "max" else np.divide(total, met, out=np.zeros(len(names)), where=met > 0)
        score = np.where(taken, -np.inf, relevance - redundancy)
        best = int(np.argmax(score))
        chosen.append((names[best], float(relevance[best]), float(redundancy[best]), float(score[best])))
        taken[best] = True
        if len(chosen) < min(k, len(left)):
            c = correlations_with(rows, len(names), best, around)
            counts = np.array([not same_domain or domain(f) == domain(names[best]) for f in names])
            total, most, met = total + c * counts, np.maximum(most, c * counts), met + counts
    return chosen


def mrmr(df: DataFrame, target: str, features: list[str], k: int = 10, denominator: str = "mean", same_domain: bool = False, **options) -> list[tuple[str, float]]:
    """(feature, score) in order of selection, see mrmr_scores()."""
    return [(f, score) for f, _, _, score in mrmr_scores(df, target, features, k, denominator, same_domain, **options)]


def mrmr_classes(df: DataFrame, target: str, features: list[str], k: int = 10, **options) -> list[tuple[str, float]]:
    """mrmr() for a target of classes, by their numbers."""
    return mrmr(df.withColumn(target, F.col(target).cast("double")), target, features, k, **options)


# ---- mutual information by nearest neighbours


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    small = x < 6
    while small.any():
        out[small] -= 1 / x[small]
        x = np.where(small, x + 1, x)
        small = x < 6
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def closer(nearest: np.ndarray, at: tuple, d: np.ndarray) -> None:
    """Takes the distances d into the sorted smallest distances nearest[0], nearest[1], ... at some places."""
    for row in nearest:
        own = row[at]
        row[at], d = np.minimum(own, d), np.maximum(own, d)


def radii(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The distance, by the larger of the two differences, of each point to its k-th neighbour: for many series, rows of x in rising order.

    Points meet in order of their ranks in x until the difference in x alone is no less than the k-th distance.
    """
    m, n = x.shape
    near, d, few = np.full((k, m, n), np.inf), 1, False
    while d < n and not few:
        gap, left, right = x[:, d:] - x[:, :-d], np.s_[:, : n - d], np.s_[:, d:]
        if d % 8 == 0:
            few = np.count_nonzero((gap < near[-1][left]) | (gap < near[-1][right])) < 0.2 * gap.size
        if not few:
            both = np.maximum(gap, np.abs(y[:, d:] - y[:, :-d]))
            closer(near, left, both)
            closer(near, right, both)
            d += 1
    near, x, y = near.reshape(k, -1), x.ravel(), y.ravel()
    for sign in (1, -1):
        own, step = np.arange(m * n), d
        while len(own) and step < n:
            own = own[(own % n + step < n) if sign > 0 else (own % n >= step)]
            gap = np.abs(x[own + sign * step] - x[own])
            own, gap = own[gap < near[-1][own]], gap[gap < near[-1][own]]
            closer(near, (own,), np.maximum(gap, np.abs(y[own + sign * step] - y[own])))
            step += 1
    return near[-1].reshape(m, n)


def scaled(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The series at a spread of 1, with a little noise to part equal values."""
    v = v / s if (s := v.std()) > 0 else v
    return v + 1e-10 * max(1, np.abs(v).mean()) * rng.standard_normal(len(v))


def within(v: np.ndarray, s: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many of the sorted s differ from v by r at most; the search is set right where v + r or v - r was rounded."""
    end = np.append(s, np.inf)
    hi = np.searchsorted(s, v + r, "right")
    hi += (end[hi] - v <= r).astype(int) - (s[hi - 1] - v > r)
    end = np.insert(s, 0, -np.inf)
    lo = np.searchsorted(s, v - r, "left")
    lo += (v - s[np.minimum(lo, len(s) - 1)] > r).astype(int) - (v - end[lo] <= r)
    return hi - lo


def ksg_many(series: list[tuple[np.ndarray, np.ndarray, np.random.Generator]], k: int) -> list[float]:
    """ksg() of many pairs of series of one length."""
    n = len(series[0][0])
    if n <= k:
        return [float("nan")] * len(series)
    own = [(scaled(x, rng), scaled(y, rng)) for x, y, rng in series]
    order = [np.argsort(x) for x, _ in own]
    x, y = np.array([v[0][o] for v, o in zip(own, order, strict=True)]), np.array([v[1][o] for v, o in zip(own, order, strict=True)])
    radius, psi, out = np.nextafter(radii(x, y, k), 0), digamma(np.arange(1, n + 1)), []
    for a, b, r in zip(x, y, radius, strict=True):
        counts = [within(a, a, r), within(b, np.sort(b), r)]
        out.append(max(0.0, float(psi[n - 1] + psi[k - 1] - psi[counts[0] - 1].mean() - psi[counts[1] - 1].mean())))
    return out


def ksg(x: np.ndarray, y: np.ndarray, k: int, rng: np.random.Generator) -> float:
    """The mutual information of two series, never below 0."""
    return ksg_many([(x, y, rng)], k)[0]


def grouped_scores(long: DataFrame, keys: list[str], score, schema: str) -> DataFrame:  # noqa: ANN001
    """Applies score(keys, pandas frame with value and y) to each group; Spark runs the groups side by side."""
    return long.groupBy(*keys).applyInPandas(lambda key, pdf: score(key, pdf), schema)


def with_target(df: DataFrame, row_id: str, features: list[str], target: str, by: list[str]) -> DataFrame:
    """(by, row, y, feature, value) without missing values."""
    y = df.select(*by, F.col(row_id).alias("row"), F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    long = y.unpivot([*by, "row", "y"], features, "feature", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("y").isNotNull() & ~F.isnan("y"))


def key_schema(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {dict(df.dtypes)[c]}, " for c in by)


def mutual_information(df: DataFrame, row_id: str, features: list[str], target: str, neighbors: int = 3, seed: int = 42, least: int = 100, by: list[str] | None = None) -> DataFrame:
    """(by, feature, mi): one task for each feature of each group by; null with fewer than least rows. Meant for groups that fit a task."""
    by = by or []

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        v = None if len(pdf) < least else ksg(pdf["value"].to_numpy(), pdf["y"].to_numpy(), neighbors, np.random.default_rng(seed))
        return pd.DataFrame([[*key, v]], columns=[*by, "feature", "mi"])

    return grouped_scores(with_target(df, row_id, features, target, by), [*by, "feature"], score, key_schema(df, by) + "feature string, mi double")


def resampled_information(df: DataFrame, row_id: str, features: list[str], target: str, kind: str, replicates: int = 10_000, neighbors: int = 3, seed: int = 42, confidence: float = 0.95, by: list[str] | None = None, block: int = 250) -> DataFrame:
    """(by, feature, observed, center, spread, low, high, p_value): bootstrap or permutation of the rows of each group by.

    One task has a feature of a group and a block of replicates. All but the names are null for groups without more rows than neighbors.
    """
    if kind not in ("bootstrap", "permutation"):
        raise ValueError(f"unknown kind {kind}")
    by, blocks = by or [], -(-replicates // block)
    long = with_target(df, row_id, features, target, by).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    long = long.repartition(min(400, blocks * len(features)), *by, "feature", "block")  # small in bytes, so it would be one task

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *group, number = key
        pdf = pdf.sort_values("row")
        x, y = pdf["value"].to_numpy(), pdf["y"].to_numpy()
        if len(x) <= neighbors:
            return pd.DataFrame([[*group, None, None]], columns=[*by, "feature", "observed", "value"])
        observed = ksg(x, y, neighbors, np.random.default_rng(seed))

        def drawn(r: int) -> tuple[np.ndarray, np.ndarray, np.random.Generator]:
            rng = np.random.default_rng([seed, r])
            if kind == "permutation":
                return x, rng.permutation(y), rng
            at = rng.integers(0, len(x), len(x))
            return x[at], y[at], rng

        values, own = [], range(number * block, min(replicates, number * block + block))
        some = max(1, 20_000 // len(x))  # as many at once as the processor's cache holds
        for i in range(0, len(own), some):
            values += ksg_many([drawn(r) for r in own[i : i + some]], neighbors)
        return pd.DataFrame([[*group, observed, v] for v in values], columns=[*by, "feature", "observed", "value"])

    draws = grouped_scores(long, [*by, "feature", "block"], score, key_schema(df, by) + "feature string, observed double, value double")
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    out = draws.groupBy(*by, "feature").agg(F.first("observed").alias("observed"), F.avg("value").alias("center"), F.stddev_samp("value").alias("spread"), F.avg((F.col("value") >= F.col("observed")).cast("double")).alias("p_value"))
    low = F.when(F.col("observed").isNotNull(), F.greatest(F.lit(0.0), F.col("observed") - z * F.col("spread")))
    return out.withColumns({"low": low, "high": F.col("observed") + z * F.col("spread")})


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05, by: list[str] | None = None, block: int = 1 << 16) -> DataFrame:
    """Adds q_value and significant; missing p-values have neither and do not count.

    Rows are dealt by ranges of falling p-values (within by) and numbered; the least of what follows a row comes from its
    block of rows and one number for each block before, so no task holds a family of any size.
    """
    by = by or []
    known = F.col(p).isNotNull() & ~F.isnan(p)
    x = in_order(df.filter(known), *[F.col(c) for c in by], F.desc(p), name="__i")
    family = x.groupBy(*by).agg(F.min("__i").alias("__first"), F.count("*").alias("__n")) if by else x.agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    same = lambda t: [F.col(c).eqNullSafe(F.col(f"{t}{c}")) for c in by]
    named = lambda d, t: d.withColumnsRenamed({c: f"{t}{c}" for c in by})
    x = x.join(F.broadcast(named(family, "__f_")), same("__f_") or F.lit(True)).drop(*[f"__f_{c}" for c in by])  # a row a family
    place = F.col("__n") - (F.col("__i") - F.col("__first"))
    x = x.withColumn("__raw", F.col(p) * F.col("__n") / place).withColumn("__b", F.floor(F.col("__i") / block))
    least = x.groupBy(*by, "__b").agg(F.min("__raw").alias("__m"))
    before = F.min("__m").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    least = named(least.select(*by, "__b", before.alias("__before")).withColumnRenamed("__b", "__c"), "__c_")
    x = x.join(F.broadcast(least), [F.col("__b") == F.col("__c"), *same("__c_")]).drop("__c", *[f"__c_{c}" for c in by])
    own = F.min("__raw").over(Window.partitionBy(*by, "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("q_value", F.least(own, F.coalesce("__before", own), F.lit(1.0))).drop("__first", "__n", "__raw", "__b", "__i", "__before")
    x = x.withColumn("significant", F.col("q_value") < alpha)
    missing = df.filter(~known).withColumns({"q_value": F.lit(None).cast("double"), "significant": F.lit(None).cast("boolean")})
    return x.unionByName(missing)


def cohens_d(df: DataFrame, group: str, value: str, first: object, second: object) -> DataFrame:
    """(cohens_d, pooled_std, mean_diff, interpretation): from one aggregation; null with fewer than two rows a group or without spread."""
    one, two = F.when(F.col(group) == first, F.col(value)), F.when(F.col(group) == second, F.col(value))
    m = df.agg(F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"))
    pooled = F.when((F.col("n1") > 1) & (F.col("n2") > 1), F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)))
    m = m.select(pooled.alias("pooled_std"), (F.col("m1") - F.col("m2")).alias("mean_diff"))
    d = F.abs("cohens_d")
    m = m.withColumn("cohens_d", F.try_divide("mean_diff", "pooled_std"))
    return m.withColumn("interpretation", F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").when(d.isNotNull(), "large"))


def cohens_d_batch(df: DataFrame, group: str, values: list[str], first: object, second: object, confidence: float = 0.95) -> DataFrame:
    """(feature, cohens_d, low, high, mean_diff, interpretation) of many columns from one aggregation, with the normal interval of the effect."""
    named = [F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("v")) for v in values]
    long = df.filter(F.col(group).isin(first, second)).select((F.col(group) == first).alias("__one"), F.inline(F.array(*named)))
    one, two = F.when(F.col("__one"), F.col("v")), F.when(~F.col("__one"), F.col("v"))
    m = long.groupBy("feature").agg(*[f(x).alias(f"{k}{i}") for i, x in ((1, one), (2, two)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.when((F.col("n1") > 1) & (F.col("n2") > 1), F.sqrt(F.expr("((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)")))
    m = m.withColumn("mean_diff", F.col("m1") - F.col("m2")).withColumn("cohens_d", F.try_divide("mean_diff", pooled))
    half = NormalDist().inv_cdf(0.5 + confidence / 2) * F.sqrt(F.expr("(n1 + n2) / (n1 * n2) + cohens_d * cohens_d / (2 * (n1 + n2))"))
    d = F.abs("cohens_d")
    word = F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").when(d.isNotNull(), "large")
    return m.select("feature", "cohens_d", (F.col("cohens_d") - half).alias("low"), (F.col("cohens_d") + half).alias("high"), "mean_diff", word.alias("interpretation"))


def information_matrix(df: DataFrame, row_id: str, features: list[str], neighbors: int = 3, seed: int = 42, least: int = 100, by: list[str] | None = None) -> DataFrame:
    """(by, f1, f2, mi) for each pair of different features, f1 before f2 in the list: one task a pair and group."""
    by = by or []
    cols = [F.col(f).cast("double") for f in features]
    two = [F.struct(F.lit(features[i]).alias("f1"), F.lit(features[j]).alias("f2"), cols[i].alias("value"), cols[j].alias("y")) for i in range(len(features)) for j in range(i + 1, len(features))]
    long = df.select(*by, F.col(row_id).alias("row"), F.inline(F.array(*two))).filter("value IS NOT NULL AND y IS NOT NULL AND NOT isnan(value) AND NOT isnan(y)")

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        v = None if len(pdf) < least else ksg(pdf["value"].to_numpy(), pdf["y"].to_numpy(), neighbors, np.random.default_rng(seed))
        return pd.DataFrame([[*key, v]], columns=[*by, "f1", "f2", "mi"])

    return grouped_scores(long, [*by, "f1", "f2"], score, key_schema(df, by) + "f1 string, f2 string, mi double")


def paired_difference(df: DataFrame, row_id: str, pairs_: list[tuple[str, str]], target: str, replicates: int = 10_000, neighbors: int = 3, seed: int = 42, confidence: float = 0.95, by: list[str] | None = None, block: int = 250) -> DataFrame:
    """(by, first, second, difference, spread, low, high, p_value): how much more the first feature tells of the target than the second.

    Both are scored over the same bootstrap rows. low and high are percentiles of the differences, p_value is twice the
    smaller share of them on one side of 0. All but the names are null without more rows than neighbors.
    """
    by, blocks = by or [], -(-replicates // block)
    cols = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for a, b in pairs_]
    long = df.select(*by, F.col(row_id).alias("row"), F.col(target).cast("double").alias("y"), F.inline(F.array(*cols))).dropna(subset=["y", "a", "b"])
    long = long.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(min(400, blocks * len(pairs_)), *by, "first", "second", "block")

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *group, number = key
        pdf = pdf.sort_values("row")
        a, b, y = (pdf[c].to_numpy() for c in ("a", "b", "y"))
        if len(y) <= neighbors:
            return pd.DataFrame([[*group, None, None]], columns=[*by, "first", "second", "observed", "value"])

        def gaps(draws: list[tuple[np.ndarray, int]]) -> list[float]:
            both = [ksg_many([(v[at], y[at], np.random.default_rng([seed, r])) for at, r in draws], neighbors) for v in (a, b)]
            return [one - two for one, two in zip(*both, strict=True)]

        observed, values = gaps([(np.arange(len(y)), replicates)])[0], []
        own = [(np.random.default_rng([seed, r]).integers(0, len(y), len(y)), r) for r in range(number * block, min(replicates, number * block + block))]
        some = max(1, 20_000 // len(y))
        for i in range(0, len(own), some):
            values += gaps(own[i : i + some])
        return pd.DataFrame([[*group, observed, v] for v in values], columns=[*by, "first", "second", "observed", "value"])

    draws = grouped_scores(long, [*by, "first", "second", "block"], score, key_schema(df, by) + "first string, second string, observed double, value double")
    share = lambda c: F.avg(F.when(F.col("value").isNotNull(), c.cast("double")))
    tail = (1 - confidence) / 2
    return draws.groupBy(*by, "first", "second").agg(
        F.first("observed").alias("difference"), F.stddev_samp("value").alias("spread"), F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"),
        F.least(F.lit(1.0), 2 * F.least(share(F.col("value") <= 0), share(F.col("value") >= 0))).alias("p_value"),
    )


def significance_report(df: DataFrame, row_id: str, features: list[str], target: str, alpha: float = 0.05, replicates: int = 10_000, by: list[str] | None = None, **options) -> DataFrame:
    """(by, feature, mi, low, high, p_value, q_value, significant): bootstrap intervals, permutation tests and their false discovery rate within each group by."""
    by = by or []
    names = [*by, "feature"]
    boot = resampled_information(df, row_id, features, target, "bootstrap", replicates, by=by, **options).select(*names, F.col("observed").alias("mi"), "low", "high")
    test = resampled_information(df, row_id, features, target, "permutation", replicates, by=by, **options).select(*names, "p_value")
    return benjamini_hochberg(boot.join(test, names), "p_value", alpha, by)


def validate_out_of_sample(df: DataFrame, row: str, features: list[str], target: str, train: float = 0.7, by: list[str] | None = None, **options) -> DataFrame:
    """(by, feature, mi_in, mi_out, degradation, rank_in, rank_out): scores over the first part of each group's rows and over the rest.

    row numbers a group's rows in time; degradation is the share of the score that is lost, null where there was none.
    """
    by = by or []
    last = df.groupBy(*by).agg(((F.max(row) + 1) * train).alias("__cut")) if by else df.agg(((F.max(row) + 1) * train).alias("__cut"))
    parts = (df.join(F.broadcast(last), by) if by else df.crossJoin(F.broadcast(last))).withColumn("__in", F.col(row) < F.col("__cut"))
    found = mutual_information(parts, row, features, target, by=[*by, "__in"], **options)
    both = found.groupBy(*by, "feature").agg(F.max(F.when(F.col("__in"), F.col("mi"))).alias("mi_in"), F.max(F.when(~F.col("__in"), F.col("mi"))).alias("mi_out"))
    place = lambda c: F.rank().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc_nulls_last(c)))  # noqa: E731  a row a feature
    return both.withColumns({"degradation": F.try_divide(F.col("mi_in") - F.col("mi_out"), F.col("mi_in")), "rank_in": place("mi_in"), "rank_out": place("mi_out")})


def sensitivity(df: DataFrame, row_id: str, features: list[str], target: str, neighbors: tuple[int, ...] = (3, 5, 7, 10), by: list[str] | None = None, **options) -> DataFrame:
    """(by, feature, mean, spread, variation, low, high, robust): how a score depends on the number of neighbours; robust below a variation of 0.2."""
    by = by or []
    found = None
    for k in neighbors:
        own = mutual_information(df, row_id, features, target, k, by=by, **options).withColumn("k", F.lit(k))
        found = own if found is None else found.unionByName(own)
    m = found.groupBy(*by, "feature").agg(F.avg("mi").alias("mean"), F.stddev_samp("mi").alias("spread"), F.min("mi").alias("low"), F.max("mi").alias("high"))
    return m.withColumn("variation", F.try_divide("spread", "mean")).withColumn("robust", F.col("variation") < 0.2)


def rank_stability(scores: DataFrame, window: str, feature: str, score: str, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """(by, window, spearman, regime_change): the rank correlation of the scores with those of the window before, in each group by; 1 where it is not defined."""
    by = by or []
    order = Window.partitionBy(*by, feature).orderBy(window)
    ranked = scores.withColumn("__r", average_rank(F.col(score), *by, window))
    ranked = ranked.withColumn("__b", F.when(F.lag(window).over(order) == F.col(window) - 1, F.lag("__r").over(order))).filter("__b IS NOT NULL")
    rho = F.try_divide(F.covar_pop("__r", "__b"), F.stddev_pop("__r") * F.stddev_pop("__b"))  # corr() fails on ranks that are all equal
    out = ranked.groupBy(*by, window).agg(F.coalesce(rho, F.lit(1.0)).alias("spearman"))
    return out.withColumn("regime_change", F.col("spearman") < threshold)


def rolling_information(df: DataFrame, row: str, features: list[str], target: str, window_size: int, step: int, neighbors: int = 3, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """(by, window, feature, mi) over row windows of a size and step; the column row numbers the rows of each group by from 0."""
    by = by or []
    most = F.max(row).over(Window.partitionBy(*by)) if by else F.lit(df.agg(F.max(row)).first()[0] or 0)
    n = df.withColumns({"__n": F.col(row), "__last": F.floor((most + 1 - window_size) / step)})
    first = F.greatest(F.lit(0), F.ceil((F.col("__n") - window_size + 1) / step)).cast("int")
    lastw = F.least(F.col("__last"), F.floor(F.col("__n") / step)).cast("int")
    n = n.withColumn("window", F.explode(F.when(first <= lastw, F.sequence(first, lastw)).otherwise(F.array().cast("array<int>"))))
    parts = n.select(*by, "window", F.col("__n").alias("row"), F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot([*by, "window", "row", "y"], features, "feature", "value")

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value", "y"]).sort_values("row")
        return pd.DataFrame([[*key, ksg(pdf["value"].to_numpy(), pdf["y"].to_numpy(), neighbors, np.random.default_rng(seed))]], columns=[*by, "window", "feature", "mi"])

    return grouped_scores(parts, [*by, "window", "feature"], score, key_schema(df, by) + "window int, feature string, mi double")
