"""Regimes: clusters of feature vectors, classifiers trained on them, and measures of both."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.functions.arrays import dimension, doubles, literal, moments, standardised
from barlume.plans.staging import matrix, staged, summed

MIN_SHARE = 0.01  # of rows in the smallest cluster, below which a classifier is refused in strict mode


def vectors(df: DataFrame, features: list[str] | str) -> DataFrame:
    """Adds __v: the numeric columns, or one array column, as an ml vector."""
    if isinstance(features, str):
        return df.withColumn("__v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    return VectorAssembler(inputCols=features, outputCol="__v", handleInvalid="skip").transform(df)


def scaled(df: DataFrame) -> DataFrame:
    return StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True).fit(df).transform(df)


def kmeans_regimes(df: DataFrame, features: list[str] | str, k: int = 3, seed: int = 7, spherical: bool = False) -> DataFrame:
    """Adds cluster_id: k-means on standardised vectors, or on those of unit length if spherical."""
    x = vectors(df, features)
    x = Normalizer(inputCol="__v", outputCol="__s").transform(x) if spherical else scaled(x)
    model = KMeans(k=k, seed=seed, featuresCol="__s", predictionCol="cluster_id", distanceMeasure="cosine" if spherical else "euclidean")
    return model.fit(x).transform(x).drop("__v", "__s")


def gmm_regimes(df: DataFrame, features: list[str] | str, k: int = 3, seed: int = 7) -> DataFrame:
    """Adds cluster_id and probabilities (array) of a Gaussian mixture on standardised vectors."""
    from pyspark.ml.functions import vector_to_array

    x = scaled(vectors(df, features))
    out = GaussianMixture(k=k, seed=seed, featuresCol="__s", predictionCol="cluster_id", probabilityCol="__p").fit(x).transform(x)
    return out.withColumn("probabilities", vector_to_array("__p")).drop("__v", "__s", "__p")


def svm_regimes(train: DataFrame, test: DataFrame, features: list[str] | str, label: str, seed: int = 7, strict: bool = True) -> DataFrame:
    """test with prediction: one-against-rest linear support vectors on standardised vectors. ValueError in strict mode if a class is rarer than MIN_SHARE."""
    shares = terminal_coverage(train, label, [r[0] for r in train.select(label).distinct().collect()])
    if strict and shares.filter(F.col("coverage") < MIN_SHARE).limit(1).count():
        raise ValueError("a regime has too few rows")
    x = vectors(train, features)
    scaler = StandardScaler(inputCol="__v", outputCol="__s", withMean=True).fit(x)
    model = OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01, featuresCol="__s"), labelCol="__y", featuresCol="__s").fit(scaler.transform(x).withColumn("__y", F.col(label).cast("double")))
    return model.transform(scaler.transform(vectors(test, features))).withColumn("prediction", F.col("prediction").cast("int")).drop("__v", "__s", "rawPrediction")


def invalid_assignments(df: DataFrame, cluster: str, probabilities: list[str], tolerance: float = 1e-6) -> DataFrame:
    """The rows of df that assign no valid regime, with a column reason: the first of those below that fits.

    cluster is the number of one of the probability columns, of which there are two at least (else ValueError); each
    probability is a finite number from 0 to 1, and they add up to 1.
    """
    if len(probabilities) < 2:
        raise ValueError("there must be two regimes at least")
    p = F.array(*[F.col(c).cast("double") for c in probabilities])
    k = F.col(cluster)
    outside = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    reason = F.when(k.isNull() | (k < 0) | (k >= len(probabilities)), "cluster").when(outside, "probability").when(F.abs(total - 1) > tolerance, "sum")
    return df.withColumn("reason", reason).filter("reason IS NOT NULL")


def complete(df: DataFrame, vector: str) -> DataFrame:
    """The rows that have a vector, with it in doubles as __x."""
    return df.filter(F.col(vector).isNotNull()).withColumn("__x", doubles(vector))


def class_sums(df: DataFrame, vector: str, label: str, classes: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sum of the vectors) of each class, in one pass."""
    d = dimension(df, vector)
    number = F.create_map(*[F.lit(x) for pair in zip(classes, range(len(classes)), strict=True) for x in pair])
    rows = df.filter(F.col(label).isNotNull()).select(vector, F.try_element_at(number, F.col(label)).alias("__k"))

    def sums(b: pa.RecordBatch) -> np.ndarray:
        x, k = matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
        chosen = (k[None, :] == np.arange(len(classes))[:, None]).astype(float)
        return np.concatenate([chosen.sum(axis=1, keepdims=True), chosen @ x], axis=1)

    s = summed(rows, sums, (len(classes), d + 1))
    return s[:, 0], s[:, 1:]


def labels_of(df: DataFrame, label: str) -> list:
    return sorted(r[0] for r in df.select(label).distinct().collect() if r[0] is not None)


def distances(v: str, centres: np.ndarray) -> Column:
    """The distances of a vector to some centres, as an array."""
    return F.array(*[F.sqrt(F.aggregate(F.zip_with(v, literal(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) for c in centres])


def nearest_centroid(df: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """(row, prediction, confidence): the class whose mean of standardised vectors is nearest, by softmax of minus the distance.

    Moments and centroids are sums over all rows, classes times dimensions at most; each row is then judged by itself. Rows
    without a vector have no row in the result, those without a label are judged only; equally near classes go by number.
    """
    df = complete(df, vector)
    classes = labels_of(df, label)
    if not classes:
        return df.select(F.col(row_id).alias("row"), F.col(label).alias("prediction"), F.lit(None).cast("double").alias("confidence")).limit(0)
    _, mean, spread = moments(df, "__x")
    z = df.select(F.col(row_id).alias("row"), label, standardised("__x", mean, spread).alias("__z"))
    n, sums = class_sums(z, "__z", label, classes)
    d = z.withColumn("__d", distances("__z", sums / n[:, None]))
    least = F.array_min("__d")
    names = F.array(*[F.lit(c) for c in classes])
    total = F.aggregate("__d", F.lit(0.0), lambda s, x: s + F.exp(-x))
    return d.select("row", F.get(names, F.array_position("__d", least).cast("int") - 1).alias("prediction"), (F.exp(-least) / total).alias("confidence"))


def weighted_vote(votes: DataFrame, row: str, model: str, label: str, probability: str, weights: dict[str, float]) -> DataFrame:
    """(row, prediction, confidence): the class with the greatest weighted mean probability, the first of equal ones."""
    w = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    t = votes.groupBy(row, label).agg((F.sum(F.col(probability) * F.try_element_at(w, F.col(model))) / sum(weights.values())).alias("p"))
    best = t.groupBy(row).agg(F.max(F.struct("p", (-F.col(label)).alias("k"))).alias("b"))
    return best.select(row, (-F.col("b.k")).alias("prediction"), F.col("b.p").alias("confidence"))


def cluster_quality(df: DataFrame, row_id: str, vector: str, label: str, silhouette_of: Column | None = None) -> DataFrame:
    """(davies_bouldin, calinski_harabasz, min_cluster_fraction, n_singletons, simplified_silhouette[, silhouette]).

    The simplified silhouette goes by distances to the cluster means. silhouette, by distances to all rows, is the mean over
    the rows for which silhouette_of holds (F.lit(True): all), see silhouettes(). All but the last two counts are null with
    less than two clusters or as many as rows.
    """
    df = complete(df, vector).filter(F.col(label).isNotNull())
    names = ["davies_bouldin", "calinski_harabasz", "min_cluster_fraction", "n_singletons", "simplified_silhouette"]
    classes = labels_of(df, label)
    row: list = [None, None, None, 0, None]
    if classes:
        n, sums = class_sums(df, "__x", label, classes)
        centres, whole = sums / n[:, None], sums.sum(axis=0) / n.sum()
        row[2:4] = [float(n.min() / n.sum()), int((n == 1).sum())]
        if 2 <= len(classes) < n.sum():
            own = F.create_map(*[F.lit(x) for pair in zip(classes, range(len(classes)), strict=True) for x in pair])[F.col(label)]
            d = df.select(own.alias("k"), distances("__x", centres).alias("d")).withColumn("a", F.get("d", F.col("k")))
            b = F.array_min(F.transform("d", lambda x, i: F.when(i != F.col("k"), x)))
            d = d.withColumn("s", F.coalesce(F.try_divide(b - F.col("a"), F.greatest("a", b)), F.lit(0.0)))
            spread, within, sil = np.zeros(len(classes)), 0.0, 0.0
            for r in d.groupBy("k").agg(F.avg("a").alias("a"), F.sum(F.col("a") ** 2).alias("w"), F.sum("s").alias("s")).collect():
                spread[r["k"]], within, sil = r["a"], within + r["w"], sil + r["s"]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(apart > 0, (spread[:, None] + spread[None]) / apart, 0.0)
            between = float((n * ((centres - whole) ** 2).sum(axis=1)).sum())
            row[0], row[4] = float(ratio.max(axis=1).mean()), sil / float(n.sum())
            row[1] = between / (len(classes) - 1) / (within / (n.sum() - len(classes))) if within > 0 else None
    out = df.sparkSession.range(1).select(*[F.lit(x).cast("bigint" if c == "n_singletons" else "double").alias(c) for c, x in zip(names, map(lambda v: v if v is None else v.item() if hasattr(v, "item") else v, row), strict=True)])
    if silhouette_of is None:
        return out
    found = silhouettes(df, row_id, vector, label, silhouette_of).agg(F.avg("silhouette").alias("silhouette")).first()[0]
    return out.withColumn("silhouette", F.lit(found).cast("double"))


def silhouettes(df: DataFrame, row_id: str, vector: str, label: str, asked: Column | None = None, block_bytes: int = 1 << 24) -> DataFrame:
    """(row_id, silhouette) of the rows for which asked holds (all by default), by their distances to all rows.

    Rows that ask come in blocks of bounded size, which are broadcast; a task adds up its rows' distances to them by cluster,
    and these sums are all that moves. 0 for a row alone in its cluster, null with a single cluster. For the measure of a
    sample alone, give a df of that sample. row_id tells a row from others; rows without vector or label take no part.
    """
    df = complete(df, vector).filter(F.col(label).isNotNull()).select(F.col(row_id).alias("__id"), "__x", F.col(label).alias("__k"), (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))).alias("__asks"))
    df = staged(df)
    spark = df.sparkSession
    kind = dict(df.dtypes)["__id"]
    nothing = spark.range(0).select(F.lit(None).cast(kind).alias(row_id), F.lit(None).cast("double").alias("silhouette"))
    classes = labels_of(df, "__k")
    total = df.filter("__asks").count()
    if not total:
        return nothing
    d = dimension(df, "__x")
    n, sums = class_sums(df, "__x", "__k", classes)
    middle = sums.sum(axis=0) / n.sum()
    number = F.create_map(*[F.lit(x) for pair in zip(classes, range(len(classes)), strict=True) for x in pair])[F.col("__k")]
    rows = df.select("__id", number.alias("k"), "__x")
    blocks = max(1, -(-8 * d * total // block_bytes))
    held = df.filter("__asks").select("__id", number.alias("k"), "__x", F.pmod(F.xxhash64("__id"), F.lit(blocks)).alias("block"))
    out = nothing
    for block in range(blocks):
        own = held.filter(F.col("block") == block).collect()  # at most about block_bytes
        if not own:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["__id"] for r in own]), np.array([r["__x"] for r in own]) - middle))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, x = sent.value
            square, total = (x * x).sum(axis=1)[:, None], np.zeros((len(x), len(classes)))
            for b in batches:
                y, k, other = matrix(b.column("__x")) - middle, b.column("k").to_numpy(zero_copy_only=False), b.column("__id").to_numpy(zero_copy_only=False)
                for start in range(0, len(y), 1024):
                    part = slice(start, start + 1024)
                    far = np.sqrt(np.maximum(square + (y[part] * y[part]).sum(axis=1)[None] - 2 * x @ y[part].T, 0))
                    far[ids[:, None] == other[part][None]] = 0
                    total += far @ (k[part][:, None] == np.arange(len(classes))[None]).astype(float)
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["slot", "k", "s"])

        far = rows.mapInArrow(run, "slot int, k int, s double").groupBy("slot", "k").agg(F.sum("s").alias("s"))
        far = far.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("far"))
        asks = spark.createDataFrame([(i, r["__id"], r["k"]) for i, r in enumerate(own)], f"slot int, id {kind}, own int")
        size, sums_to = literal(n), F.coalesce(F.col("far"), F.create_map().cast("map<int,double>"))
        mean = lambda j: F.coalesce(F.try_element_at(sums_to, j), F.lit(0.0))
        others = F.filter(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda j: j != F.col("own"))
        found = asks.join(far, "slot", "left").withColumn("b", F.array_min(F.transform(others, lambda j: mean(j) / F.get(size, j)))).withColumn("a", F.when(F.get(size, F.col("own")) > 1, F.try_divide(mean(F.col("own")), F.get(size, F.col("own")) - 1)))
        value = F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
        out = out.unionByName(staged(found.select(F.col("id").alias(row_id), value.alias("silhouette"))))
    return out


def adjusted_rand(df: DataFrame, a: str, b: str) -> Column | DataFrame:
    """(ari): the adjusted Rand index of two labellings, from their contingency counts; 1 where both are trivial."""
    two = lambda n: F.col(n) * (F.col(n) - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    side = lambda c, out: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias(out))
    x = cells.agg(F.sum(two("n")).alias("ij"), F.sum("n").alias("n")).crossJoin(side(a, "i")).crossJoin(side(b, "j"))  # single rows
    expected = F.try_divide(F.col("i") * F.col("j"), two("n"))
    return x.select(F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected), F.lit(1.0)).alias("ari"))


def cross_seed_stability(df: DataFrame, labels: list[str]) -> float:
    """The mean adjusted Rand index of all pairs of labellings; NaN below two."""
    found = [adjusted_rand(df, a, b).first()["ari"] for a, b in combinations(labels, 2)]
    return sum(found) / len(found) if found else float("nan")


def terminal_coverage(df: DataFrame, label: str, expected: list) -> DataFrame:
    """(label, coverage): each expected label's share of the rows, 0 where there are none."""
    shares = df.groupBy(label).agg(F.count("*").alias("n")).withColumn("coverage", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row a label
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in expected])).alias(label))
    return names.join(shares, label, "left").select(label, F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
