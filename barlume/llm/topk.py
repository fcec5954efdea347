"""Exact top-k search by inner product: a ball tree per shard, descended by branch and bound.

Vectors are dealt over shards by space: a tree of medians, fitted on a bounded sample, sends every row to a leaf, and a leaf
with too many rows is dealt over several shards. Queries come in blocks made in the same way. Every shard and block has a
ball, and two balls bound the inner products between them: a block meets a shard only if that bound reaches the least k-th
score of its queries so far, so rows are copied for pairs that may matter alone. Rounds take the pairs in order of their
bounds, the best one of each block first, then ever more; what a round finds is to be beaten in the next.

Each (shard, block) task builds the tree of its shard once and lets its queries down together: a query enters a ball only if
the ball's upper bound reaches the query's k-th score so far, and the child with the higher bound first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.llm.common import at_the_end, shared_folder, written

LEAF = 64
LEAST = -(2**62)  # below any score
FEW_PAIRS = 1_000_000  # pairs of blocks and shards up to this number are sent to all tasks, 8 bytes each


def scaled(c: Column, scale: float) -> Column:
    """floor(scale * x) of every component, or null if a component is null or not finite."""
    d = F.transform(c, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(d, lambda x: F.floor(x * F.lit(scale))))


@dataclass(frozen=True)
class Ball:
    """A node: all its rows lie within radius of centre. Leaves have rows, others two children."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray | None
    children: tuple[Ball, ...] = ()


def tree(x: np.ndarray, rows: np.ndarray | None = None) -> Ball:
    """The ball tree of the rows of x, split at the median of the widest axis."""
    rows = np.arange(len(x)) if rows is None else rows
    part = x[rows]
    centre = part.mean(axis=0)
    radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
    if len(rows) <= LEAF:
        return Ball(centre, radius, rows)
    order = np.argsort(part[:, int(np.argmax(part.max(axis=0) - part.min(axis=0)))], kind="stable")
    return Ball(centre, radius, None, (tree(x, rows[order[: len(rows) // 2]]), tree(x, rows[order[len(rows) // 2 :]])))


def best(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best here, best first, LEAST where there are fewer that reach its floor."""
    wide = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) >= 2**52
    xs, qs = (x, q) if wide else (x.astype(np.float64), q.astype(np.float64))  # below 2**52 doubles add whole numbers without error
    qf = q.astype(np.float64)
    length = np.linalg.norm(qf, axis=1)
    scores, found = np.full((len(q), k), LEAST), np.full((len(q), k), np.iinfo(np.int64).max)

    def bound(ball: Ball, a: np.ndarray) -> np.ndarray:
        top = qf[a] @ ball.centre + length[a] * ball.radius
        return top + np.abs(top) * 1e-9 + 1e-6

    def descend(ball: Ball, a: np.ndarray) -> None:
        a = a[bound(ball, a) >= np.maximum(floor[a], scores[a, -1])]
        if not len(a):
            return
        if ball.rows is None:
            left, right = ball.children
            first = bound(left, a) >= bound(right, a)
            descend(left, a[first])
            descend(right, a)
            descend(left, a[~first])
            return
        s = (qs[a] @ xs[ball.rows].T).astype(np.int64)
        i = np.broadcast_to(ids[ball.rows], s.shape)
        s = np.where((i != q_ids[a, None]) & (s >= floor[a, None]), s, LEAST)
        s, i = np.concatenate([scores[a], s], axis=1), np.concatenate([found[a], i], axis=1)
        order = np.lexsort((i, -s), axis=-1)[:, :k]
        scores[a], found[a] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)

    descend(tree(x.astype(np.float64)), np.arange(len(q)))
    return scores, found


@dataclass(frozen=True)
class Medians:
    """A tree of splits: node i sends x to left[i] if x[axis[i]] < cut[i], else to right[i]; a negative child -1 - j is leaf j."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, leaves: int) -> Medians:
        """Parts the rows of x into up to so many leaves: each time along the widest axis, at its widest gap between 3 and 7 tenths of the rows, so clusters stay whole."""
        nodes: list[list] = []
        made = 0

        def grow(part: np.ndarray, share: int) -> int:
            nonlocal made
            wide = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(0)
            if share < 2 or len(part) < 2 or not wide.size or wide.max() == 0:
                made += 1
                return -made
            at = len(nodes)
            nodes.append([])
            axis = int(wide.argmax())
            y = np.sort(part[:, axis])
            gaps = np.diff(y)
            first = int(0.3 * len(gaps))
            inner = gaps[first : max(first + 1, int(0.7 * len(gaps)))]
            i = first + int(inner.argmax()) if inner.max() > 0 else int(gaps.argmax())
            cut = float(y[i + 1])
            low = part[:, axis] < cut
            half = min(share - 1, max(1, round(share * low.mean())))
            nodes[at] = [axis, cut, grow(part[low], half), grow(part[~low], share - half)]
            return at

        if grow(x, leaves) < 0:
            return cls(*(np.zeros(0, int) for _ in range(4)))
        return cls(*(np.array(c) for c in zip(*nodes, strict=True)))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int) if len(self.axis) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            at[inner] = np.where(x[inner, self.axis[n]] < self.cut[n], self.left[n], self.right[n])
        return -1 - at


def dealt_by_space(rows: DataFrame, per: int, sample: int, name: str, path: str) -> tuple[DataFrame, pd.DataFrame]:
    """rows (dim, id, of, v) with a number of their part, written; and (name, dim, centre, radius) of the parts.

    Parts have about per rows. The tree is fitted on up to sample rows, every row is dealt; a leaf with far more rows than
    that is dealt over several parts by chance, so equal rows part too.
    """
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row for each length of vectors
    some = rows.select("dim", "v").orderBy(F.xxhash64("id", "of")).limit(sample).collect() if max(counts.values(), default=0) > per else []
    trees = {d: Medians.of(np.array([r["v"] for r in some if r["dim"] == d], float).reshape(-1, d), max(1, round(n / per))) for d, n in counts.items()}

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, out = b.column("dim").to_numpy(), np.zeros(b.num_rows, np.int32)
            v, ends = b.column("v").flatten().to_numpy(), np.cumsum(b.column("v").value_lengths().to_numpy())
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                if d:
                    out[at] = trees[d].leaf(v[(ends[at] - d)[:, None] + np.arange(d)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "leaf"])

    placed = written(rows.mapInArrow(leaves, "dim int, id bigint, of bigint, v array<bigint>, leaf int"), f"{path}/{name}-leaves")
    crowds = [(d, leaf, first, -(-n // per)) for first, (d, leaf, n) in enumerate(sorted((r["dim"], r["leaf"], r["count"]) for r in placed.groupBy("dim", "leaf").count().collect()))]
    start, at = [], 0
    for d, leaf, _, parts in crowds:
        start.append((d, leaf, at, parts))
        at += parts
    numbers = rows.sparkSession.createDataFrame(start, "dim int, leaf int, first int, parts int")  # a row a leaf
    placed = placed.join(F.broadcast(numbers), ["dim", "leaf"]).withColumn(name, F.col("first") + F.floor(F.rand(7) * F.col("parts")).cast("int"))
    placed = written(placed.select("dim", name, "id", "of", "v"), f"{path}/{name}s")

    def ball(b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(b["v"].to_numpy()).astype(float).reshape(len(b), -1)
        centre = x.mean(axis=0)
        return pd.DataFrame({name: [b[name].iloc[0]], "dim": [b["dim"].iloc[0]], "centre": [centre], "radius": [float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))]})

    return placed, placed.groupBy(name).applyInPandas(ball, f"{name} int, dim int, centre array<double>, radius double").toPandas()


def pair_bounds(blocks: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
    """(block, shard, bound, place): what no inner product between a block and a shard exceeds, the pairs of a block by falling bound."""
    out = []
    for d in sorted(set(blocks["dim"]) & set(shards["dim"])):
        b, s = blocks[blocks["dim"] == d], shards[shards["dim"] == d]
        cb, cs = (np.stack(x["centre"].to_numpy()).reshape(len(x), -1) for x in (b, s))
        rb, rs = b["radius"].to_numpy()[:, None], s["radius"].to_numpy()[None]
        top = cb @ cs.T + np.linalg.norm(cb, axis=1)[:, None] * rs + np.linalg.norm(cs, axis=1)[None] * rb + rb * rs
        top += np.abs(top) * 1e-9 + 1e-6
        place = np.argsort(np.argsort(-top, axis=1, kind="stable"), axis=1, kind="stable")
        out.append(pd.DataFrame({"block": np.repeat(b["block"].to_numpy(), len(s)), "shard": np.tile(s["shard"].to_numpy(), len(b)), "bound": top.ravel(), "place": place.ravel()}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"block": [], "shard": [], "bound": [], "place": []})


def exact_top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, shard_rows: int = 8192, block_rows: int = 4096, sample_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by the inner product of floor(scale * x), ties to the smaller id.

    Queries are the rows for which is_query holds; candidates are all rows with another id, each row of a repeated id for
    itself. A query id with several different vectors is answered for each of them, with ranks from 1. Null vectors and
    those with null or non-finite components take no part, nor do null ids; an empty vector scores 0 with others like it.
    Vectors of different lengths do not meet. With fewer than k candidates all are returned; an empty table gives an empty
    one. Scores beyond 62 bits are not defined. Other columns are ignored.

    sample_rows bounds the rows on which the trees that deal rows over shards are fitted; they decide the work alone.
    """
    spark = vectors.sparkSession
    path = f"{shared_folder(spark)}/top-k-{uuid.uuid4().hex}"
    at_the_end(spark, path)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("v").isNotNull() & F.col("id").isNotNull()).select(F.size("v").alias("dim"), "id", F.xxhash64("v").alias("of"), "v", "asks")
    held, shards = dealt_by_space(rows.drop("asks"), shard_rows, sample_rows, "shard", path)
    asked, blocks = dealt_by_space(rows.filter("asks").drop("asks").distinct(), block_rows, sample_rows, "block", path)
    pairs = pair_bounds(blocks, shards)

    def walk(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if own.empty or ask.empty:
            return pd.DataFrame({"query_id": [], "query_of": [], "vec_id": [], "score": []}).astype("int64")
        x, q = np.stack(own["v"].to_numpy()).reshape(len(own), -1), np.stack(ask["q_v"].to_numpy()).reshape(len(ask), -1)
        scores, found = best(own["id"].to_numpy(), x, ask["q_id"].to_numpy(), q, ask["q_floor"].to_numpy(), k)
        there = scores > LEAST
        return pd.DataFrame({"query_id": np.repeat(ask["q_id"].to_numpy(), there.sum(axis=1)), "query_of": np.repeat(ask["q_of"].to_numpy(), there.sum(axis=1)), "vec_id": found[there], "score": scores[there]})

    def search(met: pd.DataFrame, ask: DataFrame) -> DataFrame:
        """What the shards have for the blocks that they meet, given the scores to beat."""
        number = spark.createDataFrame(list(zip(met["block"].tolist(), met["shard"].tolist(), strict=True)), "block int, shard int")
        number = F.broadcast(number) if len(met) <= FEW_PAIRS else number
        ask = ask.join(number, "block").select(*[F.col(c).alias(f"q_{c}") for c in ("shard", "block", "id", "of", "v", "floor")])
        own = held.join(number, "shard").select("shard", "block", "id", "v")
        return own.groupBy("shard", "block").cogroup(ask.groupBy("q_shard", "q_block")).applyInPandas(walk, "query_id bigint, query_of bigint, vec_id bigint, score bigint")

    order = Window.partitionBy("query_id", "query_of").orderBy(F.desc("score"), "vec_id")
    empty = spark.createDataFrame([], "query_id bigint, query_of bigint, vec_id bigint, score bigint, rank int")
    first, size, top = 0, 1, written(empty, f"{path}/0")
    least = dict.fromkeys(pairs["block"].tolist(), float(LEAST))
    while first <= pairs["place"].max() if len(pairs) else False:
        met = pairs[(pairs["place"] >= first) & (pairs["place"] < first + size)]
        met = met[met["bound"] >= met["block"].map(least)]
        first, size = first + size, 8 * size
        if not len(met):
            continue
        floors = top.groupBy(F.col("query_id").alias("id"), F.col("query_of").alias("of")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
        ask = asked.join(floors, ["id", "of"], "left").withColumn("floor", F.coalesce("floor", F.lit(float(LEAST))))
        found = search(met, ask).unionByName(top.drop("rank"))
        top = written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), f"{path}/{first}")
        ends = top.groupBy(F.col("query_id").alias("id"), F.col("query_of").alias("of")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
        ends = asked.select("block", "id", "of").join(ends, ["id", "of"], "left").groupBy("block").agg(F.min(F.coalesce("floor", F.lit(float(LEAST)))).alias("least"))
        least = {r["block"]: r["least"] for r in ends.collect()}  # a row a block
    return top.select("query_id", "rank", "vec_id", "score")
