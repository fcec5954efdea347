"""The prefix trie of conversations, built as a Patricia trie and expanded.

Conversations become sequences of digests, one for each of their prefixes, so that a trie node is a digest and equal
conversations are one sequence. Sequences are sorted over all tasks; what each shares with its neighbours tells the branch
points, and with the ends these are the points of the compressed trie. Every aggregate of a point is a sum over the
sequences below it, so one grouping by digest gives them all, pre-aggregated, however many sequences share a point: the
first sequence below a point in sorted order brings its edge, and what a sequence adds to the trie is what lies beyond the
prefix that it shares with the one before. At last each edge is cut into its single nodes, which differ from the point at
their end only by a suffix sum over the edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.llm.common import Scratch, ranked, stage

GROUP = 4096  # neighbours are looked at in groups of so many sequences
NO_ENDS = hashlib.sha256(b"").hexdigest()
CHAINED = "conv bigint, path array<bigint>, cum array<bigint>"


def gathered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turns): each conversation's turns in order, as (t, u, n): 128 bits of a hash of role and text, and the text's code points."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    # of two fields a null turn number comes first in any sort
    one = F.struct(F.col(turn_col).isNotNull().alias("has"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("t"), F.xxhash64(F.lit(1), role, text).alias("u"), F.char_length(text).alias("n"))
    each = turns.filter(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).cast("bigint").alias("conv")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return each.withColumn("turns", F.transform("turns", lambda x: F.struct(x["t"], x["u"], x["n"])))


def regrafted(each: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """(conv, turns): each conversation with its first ``shared`` turns, up to most, replaced by those that the conversation base has."""
    heads = each.filter(F.size("turns") > 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most).alias("head"))
    wanted = each.withColumns({"base": base, "shared": shared})
    heads = heads.join(wanted.select("base").distinct(), "base", "left_semi")
    joined = wanted.join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("shared")), F.slice("turns", 1, 0))
    return joined.select("conv", F.concat(head, F.slice("turns", F.col("shared") + 1, F.greatest(F.size("turns") - F.col("shared"), F.lit(0)))).alias("turns"))


def chained(each: DataFrame) -> DataFrame:
    """(conv, path, cum): for every depth from 0 two numbers of path, the 128-bit digest of the prefix, and the code points up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns, paths, sums = b.column("turns").to_pylist(), [], []
            for own in turns:
                digest, total, path, cum = 0, 0, [0, 0], [0]
                for x in own:
                    digest = xxhash.xxh3_128_intdigest(b"".join((digest.to_bytes(16), x["t"].to_bytes(8, signed=True), x["u"].to_bytes(8, signed=True))))
                    total += x["n"]
                    path += (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63
                    cum.append(total)
                paths.append(path)
                sums.append(cum)
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(paths, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.int64()))], ["conv", "path", "cum"])

    return each.select("conv", "turns").mapInArrow(run, CHAINED)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(hi, lo, sha): the digest of each end point's conversations, in ascending order. A point's conversations stream through one task, as the digest asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, digest = None, None
        for b in batches:
            done = []
            for hi, lo, conv in zip(*(b.column(c).to_pylist() for c in ("hi", "lo", "conv")), strict=True):
                if (hi, lo) != point:
                    if point is not None:
                        done.append((*point, digest.hexdigest()))
                    point, digest = (hi, lo), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield sealed(done)
        if point is not None:
            yield sealed([(*point, digest.hexdigest())])

    def sealed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["hi", "lo", "sha"])

    return ends.select("hi", "lo", "conv").repartition("hi", "lo").sortWithinPartitions("hi", "lo", "conv").mapInArrow(run, "hi bigint, lo bigint, sha string")


def at(path: str, depth: Column) -> list[Column]:
    """The two numbers of the prefix of the given depth."""
    return [F.get(path, 2 * depth).alias("hi"), F.get(path, 2 * depth + 1).alias("lo")]


def with_neighbours(sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds lcp and after, the depths to which a sequence agrees with the ones before and after it in sorted order (-1 for none)."""
    placed = ranked(sequences, [F.col("path")], scratch).withColumn("group", F.floor(F.col("rank") / GROUP))
    # both ends of a group also meet their neighbours in the next one
    out = F.array_compact(F.array(F.col("group"), F.when(F.col("rank") % GROUP == 0, F.col("group") - 1), F.when(F.col("rank") % GROUP == GROUP - 1, F.col("group") + 1)))
    met = placed.withColumns({"own": F.col("group"), "group": F.explode(out)})
    order = Window.partitionBy("group").orderBy("rank")
    met = met.withColumn("before", F.lag("path").over(order))
    # the first number that differs, counted from 1; a path of two numbers for each depth from 0 pads with nothing
    met = met.withColumn("differ", F.array_position(F.zip_with("path", "before", lambda x, y: F.coalesce(x == y, F.lit(False))), False))
    met = met.withColumn("lcp", F.when(F.col("before").isNull(), -1).otherwise(F.expr("CAST((differ - 1) DIV 2 AS INT) - 1"))).drop("before", "differ")
    met = met.withColumn("after", F.coalesce(F.lead("lcp").over(order), F.lit(-1)))
    return met.filter(F.col("own") == F.col("group")).drop("own", "group", "rank")


def prefix_trie(
    turns: DataFrame, *, base: Column | None = None, shared: Column | None = None, most_shared: int = 5, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row for each node of the trie of conversations: every distinct sequence of their first d turns (role, text), from the root with d = 0.

    conv_id, the smallest member, names a node together with depth; parent_conv_id (null for the root), n_convs, n_children,
    n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its subtree, itself included: code points
    of the node's last text for each member but one), ends_sha256 (of the ids of members that end here, ascending, joined by
    commas). base and shared, expressions over a column conv, rebuild conversations first: the first ``shared`` turns (0 to
    most_shared) are those of conversation base, as far as it has them, then come the conversation's own after its first
    ``shared``; one without any turn ends at the root.

    Turns are ordered by number, null first; those of one number by role, then by a hash of the text, so repeated rows are
    turns each. A null role or text is empty. Turns without a conversation are no conversation's. Texts of any length count
    whole; an empty table has no node. Other columns are ignored. A conversation's turns, 50 bytes each and not the texts,
    must fit in a task.
    """
    with Scratch(turns.sparkSession) as scratch:
        each = scratch.stage(gathered(turns, conv_col, turn_col, role_col, text_col), "conversations")
        if base is not None:
            each = regrafted(each, base, shared, most_shared)
        every = scratch.stage(chained(each).withColumns({"hi": F.get("path", F.size("path") - 2), "lo": F.get("path", F.size("path") - 1)}), "paths")

        # equal conversations are one sequence
        copies = every.groupBy("hi", "lo").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
        sequences = scratch.stage(every.select("conv", "path", "cum").join(copies.select("conv", "copies"), "conv"), "sequences")
        s = scratch.stage(with_neighbours(sequences, scratch), "sorted").withColumn("end", F.size("cum") - 1)

        branch = s.filter("lcp >= 0").select(*at("path", F.col("lcp")))
        points = branch.unionByName(s.select(*at("path", F.col("end")))).unionByName(s.limit(1).selectExpr("CAST(0 AS BIGINT) AS hi", "CAST(0 AS BIGINT) AS lo")).distinct()
        # beyond what it shares with its neighbours a sequence has no point but its end
        depths = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest("lcp", "after", F.lit(0))), F.array("end")))
        tried = s.withColumn("depth", F.explode(depths)).select("conv", "depth", *at("path", F.col("depth")))
        passed = tried.join(points, ["hi", "lo"], "left_semi").groupBy("conv").agg(F.sort_array(F.collect_list("depth")).alias("depths"))
        s = scratch.stage(s.join(passed, "conv"), "passed")

        total = F.get("cum", F.col("end"))
        step = s.withColumn("depth", F.explode("depths"))
        added = F.col("copies") * (total - F.get("cum", F.col("depth"))) - (total - F.get("cum", F.greatest("lcp", "depth")))
        step = step.select(*at("path", F.col("depth")), "conv", "copies", (F.col("after") < F.col("end")).cast("bigint").alias("leaf"), ((F.col("end") > F.col("depth")) & (F.col("lcp") <= F.col("depth"))).cast("bigint").alias("child"), added.alias("added"))
        sums = scratch.stage(step.groupBy("hi", "lo").agg(F.min("conv").alias("conv_id"), F.sum("copies").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children"), F.sum("added").alias("below")), "sums")

        new = F.filter("depths", lambda d: d > F.col("lcp"))
        edges = s.withColumn("new", new).select("path", "cum", "lcp", F.posexplode("new").alias("i", "depth"), "new")
        edges = edges.withColumn("above", F.when(F.col("i") == 0, F.col("lcp")).otherwise(F.get("new", F.col("i") - 1)))
        edges = edges.select(*at("path", F.col("depth")), *[c.alias(f"p_{n}") for c, n in zip(at("path", F.col("above")), ("hi", "lo"), strict=True)], "depth", "above", F.slice("cum", F.greatest("above", F.lit(0)) + 1, F.col("depth") - F.greatest("above", F.lit(0)) + 1).alias("cum"))
        parents = sums.select(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("conv_id").alias("above_conv"))
        edges = edges.join(sums, ["hi", "lo"]).join(parents, ["p_hi", "p_lo"], "left").join(ends_digests(every), ["hi", "lo"], "left")

        last, first = F.col("d") == F.col("depth"), F.col("d") == F.col("above") + 1
        nodes = edges.withColumn("d", F.explode(F.sequence(F.col("above") + 1, F.col("depth"))))
        before = F.get("cum", F.greatest(F.col("d") - F.greatest("above", F.lit(0)) - 1, F.lit(0)))
        nodes = nodes.select(
            "conv_id", F.col("d").cast("bigint").alias("depth"), F.when(first, F.col("above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
            (F.col("below") + (F.col("n_convs") - 1) * (F.element_at("cum", -1) - before)).alias("saved_tokens"), F.when(last, F.coalesce("sha", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
        )
        return stage(nodes, "trie")
