"""A kernel classifier with probabilities, whose training is one pass over the rows.

The RBF kernel becomes an inner product of random Fourier features, and one machine a class against the rest is fitted by
least squares on targets of 1 and -1 (a least-squares support vector machine). Its solution needs the features' products
alone, summed by folds of rows: all the machines, on all rows and on all but each fold, come from these sums. Probabilities
are sigmoids of the margins, fitted to the margins of rows that the machine was not trained on.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.functions.arrays import dimension, doubles, moments
from barlume.plans.staging import matrix, staged, summed

KERNELS = ("rbf", "linear")


@dataclass
class KernelClassifier:
    """Classes 0 to n_regimes - 1 of array columns. fit() first; predict() adds prediction and probabilities.

    gamma is "scale" (1 over dimensions times variance, of standardised vectors) or a number. class_weight "balanced" weighs
    rows by the inverse of their class's share. frequencies bounds the kernel's approximation, its error falls with their root.
    """

    n_regimes: int = 3
    kernel: str = "rbf"
    c: float = 1.0
    gamma: str | float = "scale"
    class_weight: str | None = None
    frequencies: int = 128
    folds: int = 3
    seed: int = 7
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    waves: np.ndarray | None = None
    weights: np.ndarray | None = None
    sigmoids: np.ndarray | None = None
    classes: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.n_regimes < 2 or self.folds < 2 or self.frequencies < 1:
            raise ValueError("there must be two regimes, two folds and one frequency at least")
        if self.kernel not in KERNELS or self.class_weight not in (None, "balanced"):
            raise ValueError("unknown kernel or class weight")

    def features(self, x: np.ndarray) -> np.ndarray:
        """The features of vectors as given, with a constant last."""
        z = (x - self.mean) / self.spread
        if self.kernel == "rbf":
            t = z @ self.waves
            z = np.concatenate([np.cos(t), np.sin(t)], axis=1) / np.sqrt(self.waves.shape[1])
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def fit(self, df: DataFrame, vector: str, label: str, row_id: str) -> KernelClassifier:
        """Learns from the rows with a label. Rows are dealt over folds by a hash of row_id. ValueError for labels that are no class, or fewer than two."""
        rows = staged(df.filter(F.col(label).isNotNull()).select(doubles(vector).alias("x"), F.col(label).cast("int").alias("y"), F.pmod(F.xxhash64(F.lit(self.seed), F.col(row_id)), F.lit(self.folds)).cast("int").alias("fold")))
        d = dimension(rows, "x")
        counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        if len(counts) < 2 or not set(counts) <= set(range(self.n_regimes)):
            raise ValueError("labels must be classes, two different ones at least")
        self.classes = sorted(counts)
        _, self.mean, self.spread = moments(rows, "x")
        if self.kernel == "rbf":
            varies = summed(rows.select("x"), lambda b: (((matrix(b.column(0)) - self.mean) / self.spread) ** 2).sum(axis=0), (d,)).sum() / sum(counts.values())
            gamma = 1 / max(varies, 1e-12) if self.gamma == "scale" else float(self.gamma)
            self.waves = np.random.default_rng(self.seed).normal(0, np.sqrt(2 * gamma), (d, self.frequencies))
        n, size = sum(counts.values()), (2 * self.frequencies if self.kernel == "rbf" else d) + 1
        weight = np.ones(self.n_regimes)
        if self.class_weight == "balanced":
            weight[self.classes] = [n / (len(counts) * counts[k]) for k in self.classes]

        def products(b: pa.RecordBatch) -> np.ndarray:
            z, y, fold = self.features(matrix(b.column("x"))), b.column("y").to_numpy(), b.column("fold").to_numpy()
            target = np.where(y[:, None] == np.array(self.classes)[None], 1.0, -1.0)
            out = np.zeros((self.folds, size, size + len(self.classes)))
            for f in np.unique(fold):
                own = fold == f
                out[f] = (z[own] * weight[y[own]][:, None]).T @ np.concatenate([z[own], target[own]], axis=1)
            return out

        parts = summed(rows, products, (self.folds, size, size + len(self.classes)))
        ridge = np.eye(size) / self.c
        ridge[-1, -1] = 1e-9
        solve = lambda s: np.linalg.solve(s[:, :size] + ridge, s[:, size:])
        whole = parts.sum(axis=0)
        self.weights, others = solve(whole), [solve(whole - p) for p in parts]
        self.sigmoids = self.calibrated(rows, others, np.array([counts[k] for k in self.classes]), n)
        return self

    def calibrated(self, rows: DataFrame, others: list[np.ndarray], counts: np.ndarray, n: int, steps: int = 12) -> np.ndarray:
        """(slope, offset) of each class's sigmoid, by Newton steps over margins of rows that their machine has not seen. Targets keep off 0 and 1 by the classes' sizes."""
        high, low = (counts + 1) / (counts + 2), 1 / (n - counts + 2)
        ab = np.stack([np.zeros(len(counts)), np.log((counts + 1) / (n - counts + 1))], axis=1)
        for _ in range(steps):

            def step(b: pa.RecordBatch, ab: np.ndarray = ab) -> np.ndarray:
                z, y, fold = self.features(matrix(b.column("x"))), b.column("y").to_numpy(), b.column("fold").to_numpy()
                m = np.zeros((len(z), len(counts)))
                for f in np.unique(fold):
                    m[fold == f] = z[fold == f] @ others[f]
                t = np.where(y[:, None] == np.array(self.classes)[None], high, low)
                p = 1 / (1 + np.exp(-np.clip(m * ab[:, 0] + ab[:, 1], -30, 30)))
                e, h = p - t, p * (1 - p)
                return np.stack([(e * m).sum(axis=0), e.sum(axis=0), (h * m * m).sum(axis=0), (h * m).sum(axis=0), h.sum(axis=0)], axis=1)

            g = summed(rows, step, (len(counts), 5))
            move = np.array([np.linalg.solve([[x[2] + 1e-9, x[3]], [x[3], x[4] + 1e-9]], x[:2]) for x in g])
            ab = ab - np.clip(move, -3, 3)
            if np.abs(move).max() < 1e-8:
                break
        return ab

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Of each class that was learned from."""
        return self.features(x) @ self.weights

    def predict(self, df: DataFrame, vector: str) -> DataFrame:
        """df with prediction (the class of the largest margin) and probabilities (one a regime, adding up to 1; 0 for classes not learned from). Null for rows without a complete vector."""
        if self.weights is None:
            raise RuntimeError("the classifier was not fitted")

        @F.pandas_udf("prediction int, probabilities array<double>")
        def judged(v: pd.Series) -> pd.DataFrame:
            d = len(self.mean)
            fits = v.map(lambda x: x is not None and len(x) == d and bool(np.isfinite(np.asarray(x, float)).all()))
            out = pd.DataFrame({"prediction": pd.array([None] * len(v), "Int32"), "probabilities": None}, index=v.index)
            if fits.any():
                m = self.margins(np.stack(v[fits].to_numpy()))
                p = np.zeros((len(m), self.n_regimes))
                p[:, self.classes] = 1 / (1 + np.exp(-np.clip(m * self.sigmoids[:, 0] + self.sigmoids[:, 1], -30, 30)))
                out.loc[fits, "prediction"] = np.array(self.classes)[m.argmax(axis=1)]
                out.loc[fits, "probabilities"] = pd.Series(list(p / p.sum(axis=1, keepdims=True)), index=v.index[fits])
            return out

        return df.withColumn("__p", judged(doubles(vector))).withColumns({"prediction": F.col("__p.prediction"), "probabilities": F.col("__p.probabilities")}).drop("__p")

    def to_json(self) -> str:
        """The fitted state as text, for from_json()."""
        if self.weights is None:
            raise RuntimeError("the classifier was not fitted")
        return json.dumps({"format": "barlume.kernel.1"} | {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()})

    @classmethod
    def from_json(cls, text: str) -> KernelClassifier:
        """ValueError for what to_json() did not write."""
        state = json.loads(text)
        if not isinstance(state, dict) or state.pop("format", None) != "barlume.kernel.1":
            raise ValueError("this is no state of a kernel classifier")
        arrays = ("mean", "spread", "waves", "weights", "sigmoids")
        return cls(**{k: np.array(v) if k in arrays and v is not None else v for k, v in state.items()})


def vote(df: DataFrame, vector: str, models: list[KernelClassifier], weights: list[float] | None = None) -> DataFrame:
    """df with prediction and probabilities: the weighted mean of the models' probabilities, and the first of its largest."""
    w = weights or [1.0] * len(models)
    if not models or len(w) != len(models) or min(w) < 0 or sum(w) <= 0 or len({m.n_regimes for m in models}) > 1:
        raise ValueError("models must agree in their regimes and have weights that add up to more than 0")
    for i, m in enumerate(models):
        df = m.predict(df, vector).withColumnRenamed("probabilities", f"__p{i}").drop("prediction")
    mean = F.array(*[sum(F.get(f"__p{i}", F.lit(j)) * (x / sum(w)) for i, x in enumerate(w)) for j in range(models[0].n_regimes)])
    df = df.withColumn("probabilities", F.when(F.col("__p0").isNotNull(), mean)).drop(*[f"__p{i}" for i in range(len(models))])
    return df.withColumn("prediction", F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1)
