"""Hard-negative mining by blocked dense products.

Anchors come in blocks of bounded size, which are broadcast; every task multiplies its candidates with the block in double
precision, which adds whole numbers without error below 2 ** 53, and keeps a few best rows an anchor. A first pass finds the
positives, of which the tasks' best are merged, and a second one the best rows of other labels within the window that each
positive opens. Only bounded blocks of anchors and their positives pass through the driver, and candidates are never moved.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.llm.common import Scratch, at_the_end, shared_folder, written
from barlume.llm.topk import LEAST, scaled

NONE = np.iinfo(np.int64).max  # the id of no row
EXACT = 2**53


@dataclass(frozen=True)
class Slots:
    """Per slot: its vector's row in x, its anchor's id and label, and the scores that qualify, both ends included."""

    x: np.ndarray
    row: np.ndarray
    anchor: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Best:
    """The k best (score, id) of every slot so far: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.scores, self.ids = k, np.full((slots, k), LEAST), np.full((slots, k), NONE)

    def offer(self, slot: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merges rows (slot, score, id) in."""
        if not len(slot):
            return
        touched, at = np.unique(slot, return_inverse=True)
        at = np.concatenate([at, np.repeat(np.arange(len(touched)), self.k)])
        s, i = np.concatenate([scores, self.scores[touched].ravel()]), np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((i, -s, at))
        at, s, i = at[order], s[order], i[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k
        self.scores[touched[at[kept]], place[kept]], self.ids[touched[at[kept]], place[kept]] = s[kept], i[kept]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as 64-bit integers, by doubles where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < EXACT else a @ b.T


def collect_best(slots: Slots, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool, best: Best, tile: int = 1 << 21) -> None:
    """Offers every row to all slots of its own label (same) or of the other ones."""
    width = max(1, tile // max(1, len(slots.x)))
    for label in np.unique(labels):
        chosen = np.flatnonzero((slots.label == label) == same)
        vectors, of = np.unique(slots.row[chosen], return_inverse=True)
        rows = np.flatnonzero(labels == label)
        for start in range(0, len(rows) if len(chosen) else 0, width):
            part = rows[start : start + width]
            score = products(slots.x[vectors], x[part])
            for first in range(0, len(chosen), 4096):  # slots share vectors, so their scores are not held all at once
                slot = chosen[first : first + 4096]
                s = score[of[first : first + 4096]]
                # equal scores may still win by their id
                at, j = np.nonzero((s >= np.maximum(slots.low[slot], best.scores[slot, -1])[:, None]) & (s <= slots.high[slot][:, None]) & (ids[part][None, :] != slots.anchor[slot][:, None]))
                best.offer(slot[at], s[at, j], ids[part][j])


FOUND = "slot int, id bigint, score bigint"


def pass_over(rows: DataFrame, slots: dict[int, tuple[np.ndarray, Slots]], same: bool, k: int) -> DataFrame:
    """(slot, id, score): every task's k best rows of each slot. slots: by length of vectors, with the slots' numbers."""
    sent = rows.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(len(own.row), k) for d, (_, own) in sent.value.items()}
        for b in batches:
            ids, labels = b.column("id").to_numpy(), b.column("label").to_numpy()
            v, ends = b.column("v").flatten().to_numpy(), np.cumsum(lengths := b.column("v").value_lengths().to_numpy())
            for d in np.unique(lengths):
                if d in best:
                    at = np.flatnonzero(lengths == d)
                    x = v[(ends[at] - d)[:, None] + np.arange(d)] if len(v) else np.zeros((len(at), 0), np.int64)
                    collect_best(sent.value[d][1], ids[at], labels[at], x, same, best[d])
        for d, own in best.items():
            slot, place = np.nonzero(own.ids < NONE)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[d][0][slot].astype(np.int32)), pa.array(own.ids[slot, place]), pa.array(own.scores[slot, place])], ["slot", "id", "score"])

    return rows.select("id", "label", "v").mapInArrow(run, FOUND)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each slot over all tasks, with their rank from 1."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def grouped(rows: list, x: list[np.ndarray], row: list[int], low: list[int], high: list[int]) -> dict[int, tuple[np.ndarray, Slots]]:
    """Slots by length of vectors. Slot number s asks for the anchor rows[row[s]], whose vector is x[row[s]]."""
    out, lengths = {}, np.array([len(x[r]) for r in row])
    for d in np.unique(lengths).tolist():
        number = np.flatnonzero(lengths == d)
        used, at = np.unique(np.array(row)[number], return_inverse=True)
        out[d] = number, Slots(np.stack([x[u] for u in used]).reshape(len(used), d), at, np.array([rows[row[s]]["id"] for s in number]), np.array([rows[row[s]]["label"] for s in number]), np.array(low)[number], np.array(high)[number])
    return out


def mine(
    vectors: DataFrame, is_anchor: Column, *, label: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100, scale: float = 256.0, block_bytes: int = 1 << 24,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, rows where is_anchor holds.

    Scores are inner products of floor(scale * x). An anchor's positives are its best other rows of the same label; for each,
    the best rows of other labels with least_percent * positive_score <= 100 * negative_score <= most_percent *
    positive_score are its hard negatives. Higher scores come first, ties by smaller id; fewer rows than asked for are all
    returned, so an anchor without positives, and a positive without negatives, has no row. label, given, stands for the
    label column.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of different lengths do
    not meet. Other rows are those with another id; each row of a repeated id counts for itself, and an anchor id with
    several different rows is answered for each of them, alike rows once. Scores beyond 62 bits are not defined. An empty
    table gives an empty one; other columns are ignored.

    block_bytes bounds the vectors of a block of anchors, 8 bytes a component; there are two passes over the rows for each
    block.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), (F.col(label_col) if label is None else label).cast("bigint").alias("label"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    asked = rows.filter("asks").select("id", "label", "v").distinct()
    total = asked.agg(F.coalesce(F.sum(F.size("v") + 8), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(8 * total / block_bytes))
    path = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    with Scratch(spark) as scratch:
        anchors = scratch.stage(asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")), "anchors")
        for block in range(blocks):
            held = anchors.filter(F.col("block") == block).collect()  # at most about block_bytes
            x = [np.array(r["v"], np.int64) for r in held]
            every = list(range(len(held)))
            found = merged(pass_over(rows, grouped(held, x, every, [LEAST + 1] * len(held), [NONE] * len(held)), True, positives), positives).collect() if held else []
            low, high = [-((-least_percent * r["score"]) // 100) for r in found], [most_percent * r["score"] // 100 for r in found]
            if not found:
                written(spark.range(0).selectExpr(*(f"CAST(NULL AS {f.split()[1]}) AS {f.split()[0]}" for f in schema.split(", "))), f"{path}/block={block}")
                continue
            opened = scratch.stage(spark.createDataFrame([(s, held[r["slot"]]["id"], r["id"], r["score"]) for s, r in enumerate(found)], "slot int, anchor_id bigint, positive_id bigint, positive_score bigint"), "positives")
            mined = merged(pass_over(rows, grouped(held, x, [r["slot"] for r in found], low, high), False, negatives), negatives)
            out = mined.join(F.broadcast(opened), "slot").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            written(out, f"{path}/block={block}")
    at_the_end(spark, path)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
