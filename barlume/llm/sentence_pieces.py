"""SentencePiece encoding and decoding with a public vocabulary, by a relational lattice.

The words of the corpus are counted. The most frequent ones, a bounded number, are encoded relationally: their substrings
of bounded length are exploded, joined by equality to the piece table and grouped by word to lattices, and a higher-order
aggregate folds each lattice to the best segmentation. This word table is then broadcast (its size is a parameter) and
documents are encoded where they lie, so that no text is shuffled: a task numbers the words and gathers their ids. Words
outside the table go through the same lattice, laid out in arrays, once in the task that meets them.

The fold depends on the kind of the vocabulary file. For unigram vocabularies it is Viterbi, the greatest sum of scores.
Vocabularies of byte-pair encoding have ranks for scores, whose sums mean nothing; there it merges the best-ranked pair of
neighbours until none is left, which gives the ids of the library. Characters without a piece become pieces of their bytes.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.llm.byte_bpe import Numbered, by_bytes
from barlume.llm.common import Scratch
from barlume.llm.language_id import Lattice, grids

MARK = "▁"
UNITS = rf"{MARK}*[^{MARK}\n]+|\n|{MARK}+"
WIDE = 48  # longer words are merged one by one
UNKNOWN_PENALTY = 10.0  # a fixed value of the format


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of text with ids and scores, and the ids of the 256 bytes. kind: bpe or unigram."""

    kind: str
    pieces: list[str]
    ids: list[int]
    scores: list[float]
    bytes_: list[int]
    longest: int = field(default=0)
    pattern: str = UNITS

    @staticmethod
    def load(path: str, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(s.get_piece_size()) if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i))]
        pieces = [s.id_to_piece(i) for i in ids]
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in pieces):
            raise ValueError("pieces that span words are not supported")
        return Vocabulary(kind, pieces, ids, [s.get_score(i) for i in ids], [s.piece_to_id(f"<0x{b:02X}>") for b in range(256)], max(map(len, pieces)), unit_pattern(pieces))


def unit_pattern(pieces: list[str]) -> str:
    """How a text, with marks for spaces, falls into units that no piece crosses.

    These are words with the marks before them, line ends and runs of marks. Where the vocabulary has no piece with a letter
    beside a digit or another character, nor with a digit beside anything, runs of letters, single digits and runs of others
    are units of their own, so that there are far fewer different ones.
    """
    pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    letter = lambda c: re.fullmatch(r"[^\W\d_]", c) is not None
    mixed = [p for p in pairs if MARK not in p and letter(p[0]) != letter(p[1])]
    odd = {c for p in mixed for c in p if letter(c)}  # these count as others
    if any(re.search("[0-9]", p) for p in pairs) or any(letter(c) and c not in odd for p in pairs if odd & set(p) for c in p):
        return UNITS
    extra = re.escape("".join(sorted(odd)))
    return rf"{MARK}*(?:[^\W\d_{extra}]+|(?:(?![0-9\n{MARK}])[\W\d_{extra}])+)|[0-9\n]|{MARK}+"


def units(text: str | None, pattern: str = UNITS) -> list[str]:
    """The independent stretches of a text."""
    return re.findall(pattern, MARK + text.replace(" ", MARK)) if text else []


# ---- the relational lattice, for the word table


def piece_table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    return spark.createDataFrame(list(zip(v.pieces, v.ids, v.scores, strict=True)), "piece string, id int, score double")


def lattices(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """words (word) with edges: an array of (s, e, id, score) over the pieces that are substrings of the word."""
    spots = words.select("word", F.char_length("word").alias("n")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    subs = spots.withColumn("l", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("s")))))
    subs = subs.select("word", "s", (F.col("s") + F.col("l")).alias("e"), F.substr("word", F.col("s") + 1, F.col("l")).alias("piece"))
    found = subs.join(F.broadcast(pieces), "piece")  # a fixed vocabulary
    edges = found.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("s", "e", "id", "score"))).alias("edges"))
    none = F.array().cast("array<struct<s:int,e:int,id:int,score:double>>")
    return words.join(edges, "word", "left").withColumn("edges", F.coalesce("edges", none))


def fold_merges(word: Column, edges: Column) -> Column:
    """The bounds of the segments after all merges: the best score first, then the leftmost."""
    n = F.char_length(word)

    def merge(b: Column, _: Column) -> Column:
        def joins(x: Column) -> Column:
            at = F.array_position(b, x["s"])
            return (at > 0) & (F.array_position(b, x["e"]) == at + 2)

        best = F.array_min(F.transform(F.filter(edges, joins), lambda x: F.struct((-x["score"]).alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
        return F.coalesce(F.get(F.transform(F.array(best), lambda m: F.when(m.isNotNull(), F.filter(b, lambda y: (y <= m["s"]) | (y >= m["e"])))), F.lit(0)), b)

    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), merge)


def fold_viterbi(word: Column, edges: Column, unknown: float) -> Column:
    """The bounds of the segments of the path with the greatest sum of scores; of equal ones, the longer last segment."""
    n = F.char_length(word)
    start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(0)).alias("back"))

    def step(state: Column, end: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda x: x["e"] == end), lambda x: F.struct((F.get(state["best"], x["s"]) + x["score"]).alias("v"), (-x["s"]).alias("s")))
        lone = F.exists(edges, lambda x: (x["e"] == end) & (x["s"] == end - 1))
        ways = F.when(lone, ways).otherwise(F.array_append(ways, F.struct((F.get(state["best"], end - 1) + F.lit(unknown)).alias("v"), (1 - end).alias("s"))))
        return F.get(F.transform(F.array(F.array_max(ways)), lambda w: F.struct(F.array_append(state["best"], w["v"]).alias("best"), F.array_append(state["back"], -w["s"]).alias("back"))), F.lit(0))

    def walk(back: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda b, _: F.when(F.get(b, F.lit(0)) > 0, F.array_prepend(b, F.get(back, F.get(b, F.lit(0))))).otherwise(b))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: walk(s["back"]))


def segment_ids(word: Column, edges: Column, bounds: Column, bytes_: list[int]) -> Column:
    """The ids of the segments; a character without a piece gives the ids of its bytes."""
    byte_ids = F.array(*[F.lit(b) for b in bytes_])

    def ids(i: Column) -> Column:
        s, e = F.get(bounds, i - 1), F.get(bounds, i)
        hit = F.get(F.filter(edges, lambda x: (x["s"] == s) & (x["e"] == e)), F.lit(0))
        code = F.hex(F.encode(F.substr(word, s + 1, e - s), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(1), F.char_length(code) - 1, F.lit(2)), lambda j: F.get(byte_ids, F.conv(F.substr(code, j, F.lit(2)), 16, 10).cast("int")))
        return F.when(hit.isNotNull(), F.array(hit["id"])).otherwise(raw)

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), ids))


def encode_words(words: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, ids) for distinct non-empty words."""
    spark = words.sparkSession
    words = words.repartition(2 * spark.sparkContext.defaultParallelism, "word")  # few bytes, but much work
    laid = lattices(words, piece_table(spark, v), v.longest)
    word, edges = F.col("word"), F.col("edges")
    unknown = min(v.scores) - UNKNOWN_PENALTY
    bounds = fold_merges(word, edges) if v.kind == "bpe" else fold_viterbi(word, edges, unknown)
    return laid.withColumn("bounds", bounds).select("word", segment_ids(word, edges, F.col("bounds"), v.bytes_).alias("ids"))


# ---- the same lattice in arrays, for words outside the table


class ArrayLattice:
    """Encodes many words at once in a task."""

    def __init__(self, v: Vocabulary):
        self.v, self.lattice = v, Lattice(v.pieces)
        self.scores, self.ids = np.append(np.array(v.scores), min(v.scores) - UNKNOWN_PENALTY), np.append(np.array(v.ids), -1)
        self.at = {p: i for i, p in enumerate(v.pieces)}
        self.pairs = {p[i : i + 2] for p in v.pieces for i in range(len(p) - 1)}

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' ids one after the other in some order, with each word's place there and number of ids."""
        starts, sizes, parts, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], 0

        def add(rows: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
            nonlocal total
            starts[rows], sizes[rows] = total + np.cumsum(counts) - counts, counts
            parts.append(ids.astype(np.int32))
            total += len(ids)

        def alone(row: int, ids: list[int]) -> None:
            add(np.array([row]), np.array([len(ids)]), np.array(ids))

        short = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) <= WIDE)
        for at, grid, lengths in grids([words[i] for i in short], 8192, squares=True):
            rows = short[at]
            score, piece = self.table(grid, lengths)
            bounds, count = self.merge(score, lengths) if self.v.kind == "bpe" else self.viterbi(grid, lengths)
            used = np.arange(bounds.shape[1] - 1)[None, :] < count[:, None]
            ids = piece[np.arange(len(rows))[:, None], bounds[:, :-1], bounds[:, 1:]]
            odd = ((ids < 0) & used).any(axis=1)
            add(rows[~odd], count[~odd], ids[used & ~odd[:, None]])
            for i in np.flatnonzero(odd):
                alone(rows[i], self.spell(words[rows[i]], bounds[i, : count[i] + 1].tolist()))
        for i in np.setdiff1d(np.arange(len(words)), short):
            alone(i, self.encode_wide(words[i]))
        return np.concatenate(parts), starts, sizes

    def spell(self, w: str, bounds: list[int]) -> list[int]:
        ids: list[int] = []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            k = self.at.get(w[s:e])
            if k is None:
                ids += [self.v.bytes_[b] for b in w[s:e].encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.v.ids[k])
        return ids

    def table(self, grid: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """score[word, start, end] and id, -inf and -1 where there is no piece."""
        n, width = grid.shape
        score, piece = np.full((n, width + 1, width + 1), -np.inf, np.float32), np.full((n, width + 1, width + 1), -1, np.int32)
        for end, length, rows, pieces in self.lattice.edges(grid, sizes):
            ok = pieces < len(self.v.pieces)
            score[rows[ok], end - length, end], piece[rows[ok], end - length, end] = self.scores[pieces[ok]], self.ids[pieces[ok]]
        return score, piece

    def merge(self, score: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bounds of the segments after all merges, and their number."""
        width = score.shape[1] - 1
        b = np.minimum(np.arange(width + 1)[None, :], sizes[:, None])
        count = sizes.copy()
        live = np.flatnonzero(count > 1)
        while len(live):
            top = int(count[live].max())
            own = b[live, : top + 1]
            s = score[live[:, None], own[:, :-2], own[:, 2:]]
            s[np.arange(top - 1)[None, :] >= (count[live] - 1)[:, None]] = -np.inf
            k = s.argmax(axis=1)
            go = s[np.arange(len(live)), k] > -np.inf
            live, k = live[go], k[go]
            if not len(live):
                break
            move = np.arange(width)[None, :] > k[:, None]  # drop bound k + 1
            old = b[live]
            b[live, :-1] = np.where(move, old[:, 1:], old[:, :-1])
            count[live] -= 1
            live = live[count[live] > 1]
        return b, count

    def viterbi(self, grid: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bounds of the segments of the best path, and their number."""
        n, width = grid.shape
        best, back = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int64)
        best[:, 0] = 0
        for end, length, rows, pieces in sorted(self.lattice.edges(grid, sizes), key=lambda x: (x[0], -x[1])):
            value = best[rows, end - length] + self.scores[pieces]
            better = value > best[rows, end]
            best[rows[better], end], back[rows[better], end] = value[better], end - length
        bounds, count = np.repeat(sizes[:, None], width + 1, axis=1), np.zeros(n, np.int64)
        for i in range(n):
            path = [int(sizes[i])]
            while path[-1] > 0:
                path.append(int(back[i, path[-1]]))
            count[i] = len(path) - 1
            bounds[i, : len(path)] = path[::-1]
        return bounds, count

    def encode_wide(self, w: str) -> list[int]:
        """A long word: cut where no piece has the two characters side by side, then merged by a queue or walked by Viterbi."""
        cuts = [0, *(i for i in range(1, len(w)) if w[i - 1 : i + 1] not in self.pairs), len(w)]
        ids: list[int] = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = w[s:e]
            ids += self.spell(part, self.queue(part) if self.v.kind == "bpe" else self.long_viterbi(part))
        return ids

    def queue(self, w: str) -> list[int]:
        n = len(w)
        right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive, heap = [True] * n, []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n:
                k = self.at.get(w[a : end[b]]) if end[b] - a <= self.v.longest else None
                if k is not None:
                    heapq.heappush(heap, (-self.v.scores[k], a, b, end[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if not (alive[a] and b < n and alive[b] and right[a] == b and end[b] == e and end[a] == b):
                continue
            end[a], alive[b], right[a] = e, False, right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [*(i for i in range(n) if alive[i]), n]

    def long_viterbi(self, w: str) -> list[int]:
        best, back = [0.0], [0]
        for e in range(1, len(w) + 1):
            ways = [(best[s] + self.v.scores[k], -s) for s in range(max(0, e - self.v.longest), e) if (k := self.at.get(w[s:e])) is not None]
            if not ways or all(-s != e - 1 for _, s in ways):
                ways.append((best[e - 1] + float(self.scores[-1]), 1 - e))
            value, s = max(ways)
            best.append(value)
            back.append(-s)
        b = [len(w)]
        while b[-1] > 0:
            b.append(back[b[-1]])
        return b[::-1]


# ---- documents


def frequent_words(docs: DataFrame, text_col: str, size: int, pattern: str = UNITS) -> DataFrame:
    """(word): the size most frequent words. A task names the words that it meets twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            kept = [w for w, n in seen.items() if n > 1 and len(w) <= WIDE]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([seen[w] for w in kept], pa.int64())], ["word", "n"])

        for b in batches:
            for i in range(b.num_rows):
                seen.update(units(b.column(0)[i].as_py(), pattern))
                if len(seen) > 250_000:
                    yield rows()
                    seen.clear()
        yield rows()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(size).select("word")


class WordIds:
    """The ids of words by number: those of the word table first, then those that a task has met, a bounded number of them."""

    def __init__(self, v: Vocabulary, words: list[str], sizes: np.ndarray, ids: np.ndarray, remember: int = 100_000):
        self.lattice, self.remember, self.table, self.pattern = ArrayLattice(v), remember, len(words), v.pattern
        self.index = Numbered(zip(words, range(len(words)), strict=True))
        self.sizes, self.starts, self.ids = sizes, np.cumsum(sizes) - sizes, ids

    def forget(self) -> None:
        """Drops all but the table."""
        self.index = Numbered(itertools.islice(self.index.items(), self.table))
        self.sizes, self.starts = self.sizes[: self.table], self.starts[: self.table]
        self.ids = self.ids[: int(self.sizes.sum())]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and the number of ids of each."""
        if len(self.index) > self.table + self.remember:
            self.forget()
        known, counts = len(self.index), []

        def words() -> Iterator[list[str]]:
            for t in texts:  # only one text's words are there at a time
                found = units(t, self.pattern)
                counts.append(len(found))
                yield found

        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(words())), np.int64)
        if len(self.index) > known:
            ids, starts, sizes = self.lattice.encode(list(itertools.islice(self.index, known, None)))
            self.starts, self.sizes = np.concatenate([self.starts, len(self.ids) + starts]), np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


def encode_documents(docs: DataFrame, model_path: str, *, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, table_words: int = 150_000, batch_bytes: int = 1 << 20) -> DataFrame:
    """docs with n_tokens and ids (array of int) added: the ids of each whole text.

    Null and empty texts have no ids, texts of any length are encoded whole, repeated rows are encoded each, an empty table
    gives an empty one. All columns of docs are kept, or those named in keep, so that texts need not come back from the
    tasks; columns of docs named n_tokens or ids are overwritten.
    """
    docs = docs.drop("n_tokens", "ids")
    keep = docs.columns if keep is None else keep
    docs = docs.select(*keep, *[text_col] * (text_col not in keep))
    v = Vocabulary.load(model_path, kind)
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.stage(frequent_words(docs, text_col, table_words, v.pattern), "words")
        known = encode_words(words, v).toArrow()  # at most table_words rows
    ids = known["ids"].combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast((v, known["word"].to_pylist(), np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy().astype(np.int32)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(*shared.value)
        for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            done = 0
            for run in by_bytes([t or "" for t in b.column(b.schema.names.index(text_col)).to_pylist()], batch_bytes):
                flat, sizes = encoder.encode(run)
                part = b.slice(done, len(run)).select(keep)
                done += len(run)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64()), lists], [*part.schema.names, "n_tokens", "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.mapInArrow(encode, f"{fields}, n_tokens bigint, ids array<int>")


def decode(ids: Column, model_path: str) -> Column:
    """The text of an array of ids: pieces joined, marks to spaces, the first space dropped. Null for null."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=model_path)

    def code(i: int) -> str:
        p = s.id_to_piece(i)
        return p[3:5] if s.is_byte(i) else "" if s.is_control(i) else p.replace(MARK, " ").encode().hex()

    table = F.split(F.lit(",".join(code(i) for i in range(s.get_piece_size()))), ",")
    text = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")).cast("string")
    return F.when(text.startswith(" "), F.substr(text, F.lit(2))).otherwise(text)
