"""Bootstraps of regimes: encoders of array columns, prototypes with balanced assignments, and labels under quotas.

Rows are never gathered. What goes round between passes are sums: moments, Gram matrices, column sums, prototypes, whose
size depends on dimensions and regimes alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.functions.arrays import at_length_one, dimension, dot, doubles, literal, moments, principal_axes, standardised, unit
from barlume.operators.regime import kmeans_regimes
from barlume.plans.staging import in_order, matrix, staged, summed


class Encoder(Protocol):
    """What embedding_regimes takes. fit(), where there is one, keeps its state in the encoder; encode() needs no more than that."""

    def encode(self, df: DataFrame) -> DataFrame:
        """df with an array column __e, one for each row."""


@dataclass
class PrincipalEncoder:
    """The leading coordinates of standardised vectors along their principal axes. Moments and axes of fit() serve later rows too."""

    vector: str
    size: int = 8
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    axes: np.ndarray | None = None

    def fit(self, df: DataFrame) -> PrincipalEncoder:
        x = df.select(doubles(self.vector).alias("__x"))
        _, self.mean, self.spread = moments(x, "__x")
        self.axes = principal_axes(x.select(standardised("__x", self.mean, self.spread).alias("__z")), "__z")[: self.size]
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        if self.axes is None:
            raise RuntimeError("the encoder was not fitted")
        df = df.withColumn("__z", standardised("__x", self.mean, self.spread)) if "__x" in df.columns else df.withColumn("__x", doubles(self.vector)).withColumn("__z", standardised("__x", self.mean, self.spread))
        return df.withColumn("__e", F.array(*[dot("__z", literal(a)) for a in self.axes])).drop("__x", "__z")


def embedding_regimes(df: DataFrame, encoder: Encoder, k: int = 3, seed: int = 7, fit_encoder: bool = False, inner=None) -> DataFrame:  # noqa: ANN001
    """Adds cluster_id: regimes of the encoder's embeddings, by spherical k-means or inner(df, vector, k, seed).

    ValueError below two regimes, for embeddings of different lengths, and where the encoder loses or adds rows.
    """
    if k < 2:
        raise ValueError("there must be two regimes at least")
    if fit_encoder and callable(getattr(encoder, "fit", None)):
        encoder.fit(df)
    encoded = encoder.encode(df)
    dimension(encoded, "__e")
    if encoded.count() != df.count():
        raise ValueError("an encoder gives one embedding for each row")
    return (inner or (lambda x, v, k, seed: kmeans_regimes(x, v, k, seed, spherical=True)))(encoded, "__e", k, seed).drop("__e")


# ---- a temporal encoder


def temporal_contexts(df: DataFrame, by: str, order: str, features: list[str], bars: int) -> DataFrame:
    """df with __c, the features of the last bars rows of a group, oldest first; before the first row its values repeat."""
    w = Window.partitionBy(by).orderBy(order)
    value = lambda f: F.col(f).cast("double")
    past = [F.coalesce(F.lag(value(f), i).over(w), F.first(value(f)).over(w)) if i else value(f) for i in range(bars - 1, -1, -1) for f in features]
    return df.withColumn("__c", F.array(*past))


@dataclass
class TemporalEncoder:
    """Contexts of rows, projected on the direction that parts neighbours from random pairs and on principal axes, at length 1.

    Groups (``by``) are series of their own: neighbours and random partners are rows of one group. A row's partners are drawn
    by a hash of the seed, its place and the draw's number, so they do not depend on how rows are dealt over tasks. Rows are
    standardised by the moments of the rows that encode() is given. fit() leaves loss, positive and negative similarity.
    """

    by: str
    order: str
    features: list[str]
    bars: int = 8
    size: int = 8
    negatives: int = 8
    seed: int = 7
    projection: np.ndarray | None = None
    positive: float = float("nan")
    negative: float = float("nan")
    loss: float | None = None
    directions: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if min(self.bars, self.size, self.negatives) < 1:
            raise ValueError("bars, size and negatives must be at least 1")

    def contexts(self, df: DataFrame) -> tuple[DataFrame, int]:
        """df with the standardised context __z, and the number of rows."""
        c = temporal_contexts(df, self.by, self.order, self.features, self.bars)
        n, mean, spread = moments(c, "__c")
        return c.withColumn("__z", standardised("__c", mean, spread)).drop("__c"), n

    def partners(self, z: DataFrame) -> DataFrame:
        """(by, __at, __to): the places in its group that each row but the last is compared with."""
        rows = z.select(self.by, "__at", "__n").filter(F.col("__at") < F.col("__n") - 1)
        drawn = [F.pmod(F.xxhash64(F.lit(self.seed), F.col("__at"), F.lit(j)), F.col("__n")) for j in range(self.negatives)]
        return rows.select(self.by, "__at", F.explode(F.array(*drawn)).alias("__to"))

    def fit(self, df: DataFrame) -> TemporalEncoder:
        z, n = self.contexts(df)
        if n < 2:
            raise ValueError("there must be two rows at least")
        group = Window.partitionBy(self.by)
        z = staged(z.select(self.by, "__z", F.col(self.order).alias("__o")).withColumns({"__at": F.row_number().over(group.orderBy("__o")) - 1, "__n": F.count("*").over(group)}))
        d = len(self.features) * self.bars
        drawn = self.partners(z)

        # means of neighbours' differences and of random ones, from how often a row is either side of one
        times = drawn.groupBy(self.by, F.col("__to").alias("__at")).agg(F.count("*").alias("__times"))
        weights = z.join(times, [self.by, "__at"], "left").select(
            "__z", (F.col("__at") > 0).cast("double").alias("after"), (F.col("__at") < F.col("__n") - 1).cast("double").alias("before"), F.coalesce("__times", F.lit(0)).cast("double").alias("drawn"),
        )

        def sums(b: pa.RecordBatch) -> np.ndarray:
            w = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("after", "before", "drawn")])
            return np.concatenate([w @ matrix(b.column(0)), w.sum(axis=1, keepdims=True)], axis=1)

        s = summed(weights, sums, (3, d + 1))
        if not s[0, -1]:
            raise ValueError("no group has two rows")
        positive = (s[0, :d] - s[1, :d]) / s[0, -1]
        negative = s[2, :d] / s[2, -1] - s[1, :d] / s[1, -1]
        contrast = positive - negative
        if np.allclose(contrast, 0.0):
            contrast = np.sqrt(np.diag(summed(z.select("__z"), lambda b: (x := matrix(b.column(0))).T @ x, (d, d))) / n)
        self.directions = {"contrast": contrast, "axes": principal_axes(z, "__z")}
        parts = [contrast, *self.directions["axes"][: max(0, self.size - 1)]][: self.size]
        while len(parts) < self.size:
            parts.append(np.eye(d)[(len(parts) - 1) % d])
        length = np.linalg.norm(parts, axis=1, keepdims=True)
        self.projection = np.divide(parts, length, out=np.zeros((self.size, d)), where=length > 0)

        e = staged(self.projected(z).select(self.by, "__at", "__e"))
        near = e.join(e.select(self.by, (F.col("__at") - 1).alias("__at"), F.col("__e").alias("__f")), [self.by, "__at"])
        far = drawn.join(e, [self.by, "__at"]).join(e.select(self.by, F.col("__at").alias("__to"), F.col("__e").alias("__f")), [self.by, "__to"])
        self.positive, self.negative = (x.agg(F.avg(dot("__e", "__f"))).first()[0] for x in (near, far))
        self.loss = max(0.0, 1.0 - self.positive + self.negative)
        return self

    def projected(self, z: DataFrame) -> DataFrame:
        return z.withColumn("__e", F.array(*[dot("__z", literal(p)) for p in self.projection])).withColumn("__e", unit("__e"))

    def encode(self, df: DataFrame) -> DataFrame:
        if self.projection is None:
            raise RuntimeError("the encoder was not fitted")
        return self.projected(self.contexts(df)[0]).drop("__z")


# ---- prototypes


def affinities(x: np.ndarray, prototypes: np.ndarray, temperature: float) -> np.ndarray:
    """exp of a row's inner products with the prototypes over the temperature, the largest at 1."""
    logits = x @ prototypes.T / temperature
    return np.exp(logits - logits.max(axis=1, keepdims=True)) + 1e-12


def sinkhorn_columns(df: DataFrame, vector: str, prototypes: np.ndarray, temperature: float, rounds: int) -> np.ndarray:
    """The factors of the prototypes after some rounds of balancing: rows to equal sums, then prototypes to equal sums.

    A row's factor follows from the prototypes' factors, so these are all that a round leaves; each is one sum over the rows.
    """
    k, factors = len(prototypes), np.ones(len(prototypes))
    for _ in range(rounds):
        held = factors

        def columns(b: pa.RecordBatch, held: np.ndarray = held) -> np.ndarray:
            s = affinities(matrix(b.column(0)), prototypes, temperature) * held
            return np.append((s / s.sum(axis=1, keepdims=True)).sum(axis=0), b.num_rows)

        total = summed(df.select(vector), columns, (k + 1,))
        factors = factors * (total[-1] / k) / total[:-1]
    return factors


def with_assignments(df: DataFrame, vector: str, prototypes: np.ndarray, factors: np.ndarray, temperature: float = 0.1) -> DataFrame:
    """Adds __a, each row's shares of the prototypes, which add up to 1."""
    logits = F.array(*[dot(vector, literal(p)) / temperature for p in prototypes])
    df = df.withColumn("__l", logits)
    df = df.withColumn("__s", F.zip_with(F.transform("__l", lambda x: F.exp(x - F.array_max("__l")) + 1e-12), literal(factors), lambda s, c: s * c))
    total = F.aggregate("__s", F.lit(0.0), lambda t, x: t + x)
    return df.withColumn("__a", F.transform("__s", lambda x: x / total)).drop("__l", "__s")


def fit_prototypes(df: DataFrame, vector: str, k: int, *, epochs: int = 5, temperature: float = 0.1, rounds: int = 3, seed: int = 7, initial: np.ndarray | None = None) -> np.ndarray:
    """k prototypes of unit vectors: each epoch balances the assignments and takes the assigned rows' sum as the new prototype."""
    d = dimension(df, vector)
    if initial is None:
        x = df.select(array_to_vector(vector).alias("features"))
        initial = np.array(KMeans(k=k, seed=seed).fit(x).clusterCenters())
    prototypes = at_length_one(np.resize(np.asarray(initial, float), (k, d)))
    for _ in range(epochs):
        factors, held = sinkhorn_columns(df, vector, prototypes, temperature, rounds), prototypes

        def sums(b: pa.RecordBatch, factors: np.ndarray = factors, held: np.ndarray = held) -> np.ndarray:
            x = matrix(b.column(0))
            s = affinities(x, held, temperature) * factors
            return (s / s.sum(axis=1, keepdims=True)).T @ x

        prototypes = at_length_one(summed(df.select(vector), sums, (k, d)))
    return prototypes


def prototype_regimes(df: DataFrame, row_id: str, vector: str, k: int = 3, *, epochs: int = 5, temperature: float = 0.1, rounds: int = 3, seed: int = 7, initial: np.ndarray | None = None) -> DataFrame:
    """(row_id, cluster_id, distance): prototypes of the vectors at length 1, then labels of nearly equal number.

    distance is 1 less the inner product with the label's prototype; its mean is the assignment loss. row_id names rows and
    breaks ties. ValueError below two regimes, for more regimes than rows, and for parameters below 1.
    """
    if k < 2 or epochs < 1 or rounds < 1 or temperature <= 0:
        raise ValueError("there must be two regimes, one epoch and one round at least, and a temperature above 0")
    e = df.select(row_id, doubles(vector).alias("__x")).withColumn("__e", unit("__x")).drop("__x")
    e = staged(e)
    if e.count() < k:
        raise ValueError("there are more regimes than rows")
    prototypes = fit_prototypes(e, "__e", k, epochs=epochs, temperature=temperature, rounds=rounds, seed=seed, initial=initial)
    d = e.select(row_id, F.array(*[1 - dot("__e", literal(p)) for p in prototypes]).alias("__d"))
    out = balanced_labels(d, row_id, "__d")
    return out.select(row_id, "cluster_id", F.get("__d", F.col("cluster_id")).alias("distance"))


def first_open(order: str, full: list[int]) -> Column:
    """The first regime of a row's order that is not full."""
    closed = F.array(*[F.lit(j) for j in full]).cast("array<int>")
    return F.get(F.filter(order, lambda j: ~F.array_contains(closed, j)), F.lit(0))


def balanced_labels(df: DataFrame, row_id: str, distances: str, block: int = 1 << 16) -> DataFrame:
    """df with cluster_id: rows, by their smallest distance and then by row_id, take the nearest regime that is not full.

    n rows fill k regimes with n div k rows each, the first n mod k of them with one more. The result is that of one pass
    over all rows in order, found without one: until the first regime is full every row has its first choice, from there to
    the second one its first choice but for that regime, and so on. So there are as many rounds as regimes; a round counts
    choices by blocks of rows, a small table, and looks into the blocks in which a regime may become full.
    """
    k = dimension(df, distances)
    rows = in_order(df.withColumn("__least", F.array_min(distances)), F.col("__least"), F.col(row_id)).drop("__least")
    # nearest first, of equal ones the smaller number
    order = F.transform(F.array_sort(F.transform(distances, lambda x, i: F.struct(x.alias("d"), i.alias("i")))), lambda s: s["i"])
    rows = staged(rows.withColumn("__order", order).withColumn("__block", F.floor(F.col("__rank") / block)))
    n = rows.count()
    left = {j: n // k + (j < n % k) for j in range(k)}
    full: list[int] = [j for j in left if not left[j]]  # with fewer rows than regimes
    spans: list[tuple[int, list[int]]] = []  # up to which rank which regimes were full
    start = 0
    while start < n:
        now = rows.filter(F.col("__rank") >= start).select("__rank", "__block", first_open("__order", full).alias("__j"))
        upto = F.sum("c").over(Window.partitionBy("__j").orderBy("__block"))
        quota = F.create_map(*[F.lit(x) for pair in left.items() for x in pair])[F.col("__j")]
        hit = now.groupBy("__block", "__j").agg(F.count("*").alias("c")).withColumn("upto", upto)
        hit = hit.filter((F.col("upto") >= quota) & (F.col("upto") - F.col("c") < quota)).withColumn("place", quota - F.col("upto") + F.col("c"))
        inner = now.join(F.broadcast(hit.select("__block", "__j", "place")), ["__block", "__j"])  # a row a regime at most
        inner = inner.withColumn("at", F.row_number().over(Window.partitionBy("__block", "__j").orderBy("__rank"))).filter("at = place")
        ends = {r["__j"]: r["__rank"] for r in inner.select("__j", "__rank").collect()}
        end = min(ends.values(), default=n - 1) + 1
        spans.append((end, list(full)))
        for r in now.filter(F.col("__rank") < end).groupBy("__j").count().collect():
            left[r["__j"]] -= r["count"]
        full = [j for j in left if not left[j]]
        start = end
    label = F.lit(None).cast("int")
    for end, closed in reversed(spans):
        label = F.when(F.col("__rank") < end, first_open("__order", closed)).otherwise(label)
    return rows.withColumn("cluster_id", label).drop("__rank", "__order", "__block")
