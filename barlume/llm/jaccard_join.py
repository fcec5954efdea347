"""N-gram Jaccard join by parity sketches.

A document's distinct shingles are dealt by hash over the parts of its size band. The parity sketch of a part is the XOR
of its shingles' hashes: two documents whose sets differ in at most d shingles differ in at most d parts, so by the
pigeonhole principle they agree in one of the first d + 1 parts that are not empty. These sketches are joined by
equality, per size band. A second sketch, one bit flipped for each shingle, has a Hamming distance that never exceeds the
number of differing shingles and turns candidates away before their shingles are compared.

A pair that qualifies always meets: parts are so few that many more than d + 1 hold a shingle. Each document offers some
spare sketches beyond these, so that a qualifying pair agrees in more than one, and then takes back as many of its most
frequent sketches: in one order of all sketches, the rarest that a pair shares stays with both. So a passage that many
documents share makes no large bucket.

Documents with equal sets are one node from the start, told apart by 128 bits of a hash. Within a bucket of equal sketches
every node is compared with the smallest one first. Only where the bucket then still holds several components are members
outside the largest one compared with those of other ones, in rounds, until no pair that the bit sketches allow is left
unverified. So a group of thousands of near copies is a star, not all its pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.llm.common import Scratch, stage
from barlume.llm.components import components

SMALL = 64  # sets below this size form one band in which every shingle is a part
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * M2
        x = (x ^ (x >> np.uint64(29))) * M1
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Sorted distinct hashes of the shingles of texts, with a bounded memory of words' hashes."""

    def __init__(self, words: int, remember: int = 300_000):
        self.words, self.remember, self.known = words, remember, {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.remember:
            self.known.clear()
        known, hashes = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            hashes.append(h)
        w = np.array(hashes, np.uint64)
        k = min(self.words, len(w))
        with np.errstate(over="ignore"):
            s = w[: len(w) - k + 1].copy()
            for i in range(1, k):
                s = mixed(s) + w[i : len(w) - k + 1 + i]
            return np.unique(mixed(s + np.uint64(k)))


def band_of(n: int) -> int:
    """Bands double in size; band 0 holds the small sets."""
    return 0 if n < SMALL else n.bit_length() - 1


def allowed(n: int, percent: int) -> int:
    """By how many shingles a partner of a set of n may differ at most."""
    return (100 - percent) * n // percent


def spare(n: int, percent: int) -> int:
    """How many sketches a set of n offers beyond those that the pigeonhole principle needs."""
    return allowed(n, percent) // 8 + 2


def part_keys(s: np.ndarray, band: int, most: int) -> np.ndarray:
    """The parity sketches of the first parts that hold a shingle, up to most, as join keys of a band."""
    order = mixed(s ^ np.uint64(band + 1))
    if band == 0:
        return np.sort(order)[:most]
    top = np.uint64(2 << band)
    part = (order >> np.uint64(32)) % (top // np.uint64(4))
    at = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[at], prepend=top))
    first, ends = starts[:most], np.append(starts[1:], len(at))[:most]
    xors = np.bitwise_xor.reduceat(s[at][: ends[-1]], first)
    with np.errstate(over="ignore"):
        return mixed(mixed(xors) + part[at][first] * M1 + np.uint64(band))


def bit_sketch(s: np.ndarray, band: int) -> np.ndarray:
    """One bit flipped for each shingle. That of a band, its halves combined by XOR, is that of the band before it."""
    width = 2 * SMALL if band == 0 else 4 << band
    bits = np.bincount((mixed(s ^ M2) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


SKETCHED = "doc_id {id}, t bigint, u bigint, n bigint, node bigint, check bigint, spare int, keys0 array<bigint>, keys1 array<bigint>, bits array<bigint>"


def sketch(docs: DataFrame, words: int, percent: int, remember: int = 200_000) -> DataFrame:
    """One row for each of docs (doc_id, t, u, text): set size, node, and keys for its own band (0) and the next (1) if a partner may be there.

    node and check are 127 bits of a hash of the set; nodes are multiples of 2. A task gives keys and bits for a set once (as
    far back as it remembers), whatever the number of copies.
    """
    names, kinds, schema = [], [], SKETCHED.format(id=dict(docs.dtypes)["doc_id"])
    for f in schema.split(", "):
        name, kind = f.split(" ")
        names.append(name)
        kinds.append({"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(words), set()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                rows, part = [], b.slice(i, 500)
                for key, t, u, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    s = shingles.of(text)
                    n = len(s)
                    if n == 0:
                        rows.append((key, t, u, 0, None, None, None, None, None, None))
                        continue
                    digest = xxhash.xxh3_128_intdigest(s.tobytes())
                    name = ((digest & (2**64 - 2)) - 2**63, (digest >> 64) - 2**63)
                    extra = spare(-(-percent * n // 100), percent)
                    if digest in seen:
                        rows.append((key, t, u, n, *name, extra, None, None, None))
                        continue
                    if len(seen) >= remember:
                        seen.clear()
                    seen.add(digest)
                    if allowed(n, percent) == 0:  # it links with equal sets only, and these are one node
                        rows.append((key, t, u, n, *name, extra, None, None, None))
                        continue
                    most, band = allowed(n, percent) + 1 + spare(n, percent), band_of(n)
                    own = part_keys(s, band, most).view(np.int64)
                    up = part_keys(s, max(band + 1, band_of(SMALL)), most).view(np.int64) if band_of(100 * n // percent) > band else None
                    rows.append((key, t, u, n, *name, extra, own, up, bit_sketch(s, band)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, schema)


def one_node_a_set(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with another node for sets whose 63 bits meet those of another set, as their other 64 bits show."""
    met = rows.filter("n > 0").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi")
    met = scratch.stage(met.select("node", "lo"), "met-nodes")
    if met.limit(1).count() == 0:
        return rows
    other = F.shiftleft(F.shiftright(F.xxhash64("node", "check"), 1), 1)
    return rows.join(met, "node", "left").withColumn("node", F.when(F.col("lo") != F.col("check"), other).otherwise(F.col("node"))).drop("lo")


def possible(n: Column, m: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and bit sketches (of the same or neighbouring bands) leave a chance that two sets are similar enough."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) / 2), F.slice(x, F.size(x) / 2 + 1, F.size(x) / 2), lambda p, q: p.bitwiseXOR(q))
    x = F.when(F.size(a) > F.size(b), half(a)).otherwise(a)
    y = F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    distance = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * distance <= (100 - percent) * (n + m))


def node_texts(texts: DataFrame, rows: DataFrame, nodes: DataFrame, scratch: Scratch, small: int) -> DataFrame:
    """(node, text) for nodes: a text with each node's set. Texts are found by 128 bits of a hash, and only these are shuffled while nodes are up to small."""
    holders = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("t", "u")).alias("h")).select("node", "h.t", "h.u")
    holders = scratch.stage(holders, "holders")
    held = texts.select("t", "u", "text").join(F.broadcast(holders) if holders.count() <= small else holders, ["t", "u"])
    return held.groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Rows come in order of b, whose set is made once."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, held = Shingles(words), None, None
        for x in batches:
            keep = []
            for b, ta, tb in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                if held is None or b != last:
                    last, held = b, shingles.of(tb)
                own = shingles.of(ta)
                every = np.sort(np.concatenate([own, held]), kind="stable")
                both = int((every[1:] == every[:-1]).sum())
                keep.append(100 * both >= percent * (len(every) - both))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint")


def partners(own: pd.DataFrame, percent: int, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The pairs (a, b) of one block pair of a bucket: for each node outside the largest component its most smallest allowed partners in others, and whether there are more."""
    own = own.drop_duplicates("node")
    if len(own) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    node, n, comp, side = (own[c].to_numpy() for c in ("node", "n", "component", "at"))
    within = own["x"].iloc[0] == own["y"].iloc[0]
    width = own["bits"].map(len).min()  # the sketches of the band after are twice as long
    bits = np.stack([b if len(b) == width else b[:width] ^ b[width:] for b in own["bits"]]).view(np.uint64)
    left, right, more = [], [], False
    kinds, counts = np.unique(comp, return_counts=True)
    for i in np.flatnonzero(comp != kinds[counts.argmax()]):
        j = np.flatnonzero((comp != comp[i]) & (within | (side != side[i])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        if len(j):
            h = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            j = j[(100 + percent) * h <= (100 - percent) * (n[j] + n[i])]
            more |= len(j) > most
            left.append(np.minimum(node[j[:most]], node[i]))
            right.append(np.maximum(node[j[:most]], node[i]))
    return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64), more


def across(members: DataFrame, percent: int, most: int, block: int = 2048) -> DataFrame:
    """(key, a, b, more): the pairs to verify next, see partners(). more tells that the bucket has others, for a later round.

    members: key, node, n, bits, component, size of the bucket. A large bucket is cut into blocks that meet two by two, each
    meeting being dealt on its own, so that no task gets a whole bucket. Small buckets share a call.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for last, batch in ends(batches):
            own = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            k = own[["key", "x", "y"]].to_numpy()
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1)] if len(k) else [0]
            if last:
                cuts.append(len(own))
            found = [(k[s, 0], *partners(own.iloc[s:e], percent, most)) for s, e in zip(cuts[:-1], cuts[1:], strict=True) if e - s > 1]
            rest = None if last else own.iloc[cuts[-1] :]
            sizes = [0, *(len(f[1]) for f in found)]
            yield pd.DataFrame({
                "key": np.repeat(np.array([0, *(f[0] for f in found)], np.int64), sizes),
                "a": np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)]), "b": np.concatenate([np.zeros(0, np.int64), *(f[2] for f in found)]),
                "more": np.repeat([False, *(f[3] for f in found)], sizes),
            })

    parts = F.ceil(F.col("size") / block).cast("int")
    dealt = members.withColumn("at", F.pmod(F.xxhash64("node"), parts).cast("int"))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = met.select("key", F.least("at", "o").alias("x"), F.greatest("at", "o").alias("y"), "node", "n", "component", "at", "bits")
    met = met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node")
    return met.mapInPandas(compare, "key bigint, a bigint, b bigint, more boolean")


def ends(items: Iterator) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Each item with whether it is the last."""
    held = None
    for item in items:
        if held is not None:
            yield False, held
        held = item
    if held is not None:
        yield True, held


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85, small: int = 1_000_000) -> DataFrame:
    """(id, n_shingles, component_id) for every row: set size, and the smallest id reachable over links.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a set holds the distinct runs of ``words``
    words, or the whole sequence if it is shorter. Two documents link if the sets' Jaccard similarity is at least
    percent / 100. Null texts and texts without words have an empty set and link with nothing: their component is their own
    id. Texts of any length are taken whole. Repeated rows of a document are returned each, rows of one id with different
    texts are judged by their own texts, a null id is none to name a component by (null if all ids there are); an empty
    table gives an empty one; other columns are ignored. Ids are whole numbers or strings.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _near_duplicates(docs, scratch, id_col, text_col, words, percent, small)


def offered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, size): the buckets of at least two nodes after each node has taken back its most frequent keys, see above."""
    # the last bit of a node tells the band in which it offers a key
    keyed = rows.select(F.explode("keys0").alias("key"), F.col("node").alias("offer"), "spare").unionByName(rows.select(F.explode("keys1").alias("key"), (F.col("node") + 1).alias("offer"), "spare"))
    bucket = Window.partitionBy("key")
    several = lambda df, c: df.withColumns({"lo": F.min(c).over(bucket), "hi": F.max(c).over(bucket)}).filter("shiftright(lo, 1) <> shiftright(hi, 1)").drop("lo", "hi")
    met = several(keyed, "offer").distinct().withColumn("size", F.count("*").over(bucket))
    met = scratch.stage(met, "buckets")
    popular = Window.partitionBy("offer").orderBy(F.desc("size"), "key")
    left = met.withColumn("place", F.row_number().over(popular)).filter("place > spare").select("key", "offer")
    left = several(left, "offer").select("key", F.shiftleft(F.shiftright("offer", 1), 1).alias("node"))
    return left.withColumn("size", F.count("*").over(bucket))


def _near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, words: int, percent: int, small: int) -> DataFrame:
    text = F.col(text_col)
    name = F.col(id_col) if dict(docs.dtypes)[id_col] == "string" else F.col(id_col).cast("bigint")
    texts = docs.select(name.alias("doc_id"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u"), text.alias("text"))
    rows = one_node_a_set(scratch.stage(sketch(texts, words, percent), "sketches"), scratch)
    bits = rows.filter("bits IS NOT NULL").select("node", "n", "bits").dropDuplicates(["node"])
    members = scratch.stage(offered(rows, scratch), "members")

    def judged(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """pairs, written, and the links among them."""
        pairs = scratch.stage(pairs, "pairs")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return pairs, scratch.stage(verified(pairs, node_texts(texts, rows, nodes, scratch, small), words, percent), "links")

    def unfinished(found: DataFrame) -> DataFrame:
        """The buckets that still hold several components, with their members' components."""
        found = found.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        found = found.withColumns({"lo": F.min("component").over(bucket), "hi": F.max("component").over(bucket)}).filter("lo <> hi")
        return found.select("key", "node", "component").withColumn("size", F.count("*").over(bucket))

    bucket = Window.partitionBy("key")
    star = members.withColumn("b", F.min("node").over(bucket)).select(F.col("node").alias("a"), "b").filter("a <> b").distinct()
    star = star.join(bits.toDF("a", "n", "x"), "a").join(bits.toDF("b", "m", "y"), "b")
    tested, links = judged(star.filter(possible(F.col("n"), F.col("m"), F.col("x"), F.col("y"), percent)).select("a", "b"))
    labels = scratch.stage(components(links, scratch), "components")

    # buckets of two have been looked through, and of those with the same members one is enough
    rest = members.filter("size > 2").withColumn("sign", F.sum(F.xxhash64("node").cast("decimal(38,0)")).over(bucket))
    one = rest.groupBy("size", "sign").agg(F.min("key").alias("key"))
    rest = scratch.stage(rest.join(one.select("key"), "key", "left_semi").select("key", "node"), "rest")

    most = 4
    while True:
        found = scratch.stage(across(unfinished(rest).join(bits, "node"), percent, most), "found")
        if found.limit(1).count() == 0:
            break
        again, fresh = judged(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        tested, links = tested.unionByName(again), links.unionByName(fresh)
        labels = scratch.stage(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh), scratch), "components")
        open_keys = found.filter("more").select("key").distinct()  # the other buckets have been looked through
        if open_keys.limit(1).count() == 0:
            break
        rest, most = rest.join(open_keys, "key", "left_semi"), 8 * most

    # tables that are joined on a key which many rows may share are written first: Spark can then split such a key
    nodes = scratch.stage(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left"), "nodes")
    least = scratch.stage(nodes.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = nodes.filter("component IS NOT NULL").join(least, "component").select("node", "component_id").unionByName(nodes.filter("component IS NULL").select("node", F.col("least").alias("component_id")))
    named = scratch.stage(named, "named")
    out = rows.filter("n > 0").join(named, "node").select("doc_id", "n", "component_id").unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return stage(out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"), "near-duplicates")
