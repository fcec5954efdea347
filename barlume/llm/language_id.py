"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The piece
probabilities are learned by expectation-maximisation from the word counts of all labelled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlume.llm.common import Scratch

UNKNOWN = "und"
MARK = "▁"
WORD = re.compile(r"[^\W\d_]+")
LEAST = 1e-60  # sums below it are scaled up; eight more characters, of 1e-9 at least each, cannot reach the end of a double's range
FLOOR = 1e-6


def words_of(text: str | None) -> list[str]:
    """The lower-case runs of letters, each after the vocabulary's mark of a word's beginning. Numerals such as ½ and Ⅷ are no letters."""
    found = WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return [MARK + w for w in found]
    return [MARK + w for f in found for w in ([f] if f.isalpha() else "".join(c if c.isalpha() else " " for c in f).split())]


class Lattice:
    """Finds the edges of many words at once: substrings that are pieces, looked up by hash."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append((int(self.hashes(np.array([ord(c) for c in p], np.uint64))[-1]), i))
        self.tables = {n: (np.array([h for h, _ in sorted(t)], np.uint64), np.array([i for _, i in sorted(t)], np.int64)) for n, t in by_length.items()}

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        out, h = np.empty(len(codes), np.uint64), np.uint64(0)
        with np.errstate(over="ignore"):
            for i, c in enumerate(codes):
                h = h * self.BASE + c + np.uint64(1)
                out[i] = h
        return out

    def edges(self, grid: np.ndarray, sizes: np.ndarray, back: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, words, pieces) by rising end, or falling if back; the piece number self.size stands for an unknown character."""
        width = grid.shape[1]
        codes = grid.astype(np.uint64) + np.uint64(1)
        rolling = {1: codes}
        with np.errstate(over="ignore"):
            for n in range(2, min(width, max(self.tables)) + 1):
                rolling[n] = rolling[n - 1][:, :-1] * self.BASE + codes[:, n - 1 :]
        for end in range(width, 0, -1) if back else range(1, width + 1):
            live = np.flatnonzero(sizes >= end)
            for n in range(1, min(end, max(self.tables)) + 1):
                if n not in self.tables:
                    continue
                keys, ids = self.tables[n]
                h = rolling[n][live, end - n]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                if n == 1:
                    yield end, 1, live, np.where(hit, ids[at], self.size)
                elif hit.any():
                    yield end, n, live[hit], ids[at[hit]]


def grids(words: list[str], most: int = 20_000, cells: int = 250_000, squares: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, code points, sizes) of words of like length, a bounded number at a time.

    cells bounds the words times their length, or its square if squares; edges() alone takes some hundred bytes a code point.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        at = order[i : i + most]
        at = at[: max(1, np.searchsorted(np.arange(1, len(at) + 1) * sizes[at] ** (2 if squares else 1), cells, "right"))]
        i += len(at)
        width = int(sizes[at[-1]])
        flat = "".join(words[j].ljust(width, "\0") for j in at)
        yield at, np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), width), sizes[at]


def forward_scaled(edges: Iterable, n: int, width: int, p: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray | None]:
    """alpha[word, place, language], the summed probability of all segmentations up to a place times exp(shift), and shift.

    Where a sum gets small, it and those that a piece of up to reach characters can still start from are scaled up.
    shift is None where that never happened.
    """
    alpha, shift, level, last = np.zeros((n, width + 1, p.shape[1])), None, np.zeros((n, p.shape[1])), 0
    alpha[:, 0] = 1
    for end, length, rows, pieces in edges:
        if end != last:
            small = (alpha[:, last] > 0) & (alpha[:, last] < LEAST) if last % 8 == 0 else None
            if small is not None and small.any():
                shift = np.zeros_like(alpha) if shift is None else shift
                up = 1 / np.where(small, alpha[:, last], 1)
                near = np.s_[:, max(0, last + 1 - reach) : last + 1]
                alpha[near] *= up[:, None]
                shift[near] += np.log(up)[:, None]
                level += np.log(up)
            last = end
            if shift is not None:
                shift[:, end] = level
        alpha[rows, end] += alpha[rows, end - length] * p[pieces]
    return alpha, shift


def forward(edges: Iterable, n: int, width: int, p: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: the summed probability of all segmentations up to a place."""
    alpha, shift = forward_scaled(edges, n, width, p, width)
    return alpha if shift is None else alpha * np.exp(-shift)


def expected_counts(lattice: Lattice, words: list[str], weights: np.ndarray, p: np.ndarray | None) -> np.ndarray:
    """How often each piece occurs in the words: over all segmentations by p, or as any substring where p is None.

    passing is how often a segmentation passes a place; it is dealt over the edges that end there by their shares of alpha,
    which are ratios of near places and so never too small.
    """
    total = np.zeros(lattice.size + 1)
    for at, grid, sizes in grids(words):
        n, width, w = len(at), grid.shape[1], weights[at]
        edges = lattice.edges(grid, sizes)
        if p is None:
            for _, _, rows, pieces in edges:
                total += np.bincount(pieces, w[rows], len(total))
            continue
        kept = list(edges) if width <= 256 else None  # those of long words are found twice instead
        alpha, shift = forward_scaled(lattice.edges(grid, sizes) if kept is None else kept, n, width, p[:, None], max(lattice.tables))
        alpha = alpha[:, :, 0]
        passing = np.zeros((n, width + 1))
        passing[np.arange(n), sizes] = w
        for end, length, rows, pieces in lattice.edges(grid, sizes, back=True) if kept is None else reversed(kept):
            flow = passing[rows, end] * (alpha[rows, end - length] / alpha[rows, end]) * p[pieces]
            if shift is not None:
                flow *= np.exp(shift[rows, end, 0] - shift[rows, end - length, 0])
            total += np.bincount(pieces, flow, len(total))
            passing[rows, end - length] += flow
    return total


@dataclass(frozen=True)
class LanguageModel:
    """Piece probabilities by language: p[piece, language], the last row for unknown characters; log priors."""

    languages: list[str]
    pieces: list[str]
    p: np.ndarray
    prior: np.ndarray


def vocabulary(model_path: str) -> list[str]:
    """The pieces of a sentencepiece file that stand for text."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [s.id_to_piece(i) for i in range(s.get_piece_size()) if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i))]


def normalised(counts: np.ndarray, smoothing: float) -> np.ndarray:
    p = (counts + smoothing) / (counts + smoothing).sum()
    return np.maximum(p, FLOOR * np.where(np.arange(len(p)) == len(p) - 1, 1, 1e-3))


def learn(docs: DataFrame, model_path: str, *, text_col: str = "text", lang_col: str = "lang", rounds: int = 2, smoothing: float = 0.1) -> LanguageModel:
    """Learns from all rows of docs with a language and a letter.

    Tasks count words, Spark sums them by language, and each round of expectation-maximisation is one pass over these
    sums. The driver gets a row for each language and piece, no more.
    """
    pieces = vocabulary(model_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
            while seen:  # a language's counts go before the next one's are laid out
                lang, c = seen.popitem()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c, pa.string(), size=len(c)), pa.array(c.values(), pa.int64(), size=len(c))], ["lang", "word", "n"])

        seen: dict[str, Counter] = {}
        for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = words_of(text)
                if own:
                    seen.setdefault(lang, Counter()).update(own)
                    seen[lang][""] += 1  # documents
                if sum(map(len, seen.values())) > 400_000:
                    yield from rows(seen)
        yield from rows(seen)

    with Scratch(docs.sparkSession) as scratch:
        labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        counted = scratch.stage(labelled.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
        documents = {r["lang"]: r["n"] for r in counted.filter("word = ''").collect()}
        languages = sorted(documents)
        words = counted.filter("word <> ''")
        p: np.ndarray | None = None
        for i in range(rounds + 1):
            known = dict(zip(languages, p.T, strict=True)) if p is not None else {}

            def expect(batches: Iterator[pa.RecordBatch], known: dict = known) -> Iterator[pa.RecordBatch]:
                lattice, total = Lattice(pieces), {}
                for b in batches:
                    lang, word, n = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()
                    for k in set(lang):
                        own = np.array([j for j, x in enumerate(lang) if x == k])
                        total[k] = total.get(k, 0) + expected_counts(lattice, [word[j] for j in own], n[own].astype(float), known.get(k))
                for k, t in total.items():
                    at = np.flatnonzero(t)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(t[at])], ["lang", "piece", "n"])

            sums = words.mapInArrow(expect, "lang string, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
            c = np.zeros((len(pieces) + 1, len(languages)))
            column = {k: j for j, k in enumerate(languages)}
            for r in sums:
                c[r["piece"], column[r["lang"]]] = r["n"]
            p = np.stack([normalised(x, smoothing) for x in c.T], axis=1) if languages else c
        n = np.array([documents[k] for k in languages], float)
        return LanguageModel(languages, pieces, p, np.log(n / n.sum()) if languages else n)


class Scorer:
    """Log probabilities of words by language, with a bounded memory of words seen before."""

    def __init__(self, model: LanguageModel, remember: int = 200_000):
        self.model, self.lattice, self.remember = model, Lattice(model.pieces), remember
        self.forget()

    def forget(self) -> None:
        self.index, self.logs = {}, np.zeros((0, len(self.model.languages)))

    def learn(self, words: list[str]) -> None:
        logs = np.empty((len(words), len(self.model.languages)))
        for at, grid, sizes in grids(words):
            alpha, shift = forward_scaled(self.lattice.edges(grid, sizes), len(at), grid.shape[1], self.model.p, max(self.lattice.tables))
            ends = np.arange(len(at)), sizes
            logs[at] = np.log(alpha[ends]) - (0 if shift is None else shift[ends])
        self.index.update(zip(words, range(len(self.logs), len(self.logs) + len(words)), strict=True))
        self.logs = np.concatenate([self.logs, logs])

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; UNKNOWN and 0 without a letter."""
        if not self.model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        words = [words_of(t) for t in texts]
        flat = [w for ws in words for w in ws]
        fresh = [w for w in dict.fromkeys(flat) if w not in self.index]
        if fresh and len(self.index) + len(fresh) > self.remember and self.index:
            self.forget()
            fresh = list(dict.fromkeys(flat))
        self.learn(fresh)
        index = self.index
        at = np.fromiter([index[w] for w in flat], np.int64, len(flat))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        total = np.tile(self.model.prior, (len(texts), 1))
        some = np.flatnonzero(counts)
        if len(some):
            total[some] += np.add.reduceat(self.logs[at], (np.cumsum(counts) - counts)[some], axis=0)
        top = total.argmax(axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.model.languages[j] if n else UNKNOWN for j, n in zip(top, counts, strict=True)], np.where(counts > 0, posterior, 0.0)


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """(id, [kept,] lang_pred, score) for every row: the likeliest language of the whole text and its posterior (0 to 1).

    Texts of any length are judged whole. Null texts and those without a letter are ``und`` with score 0, as is every text where nothing was learned. Ties go
    to the first language in order. Repeated rows are judged each, other columns are ignored; keep is passed through as
    kept and is no input of the prediction, but for its field text_col where it is a struct with one: the text is then sent once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            column = b.column(2) if inside is None else b.column(1).field(inside)
            for i in range(0, b.num_rows, 500):
                lang, score = scorer.score(column.slice(i, 500).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 500), b.column(1).slice(i, 500), pa.array(lang, pa.string()), pa.array(score)], ["id", "kept", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), (F.lit(None).cast("boolean") if keep is None else keep).alias("kept"), F.col(text_col).alias("text"))
    types, kind = dict(rows.dtypes), rows.schema["kept"].dataType
    inside = kind.names.index(text_col) if isinstance(kind, StructType) and kind.names.count(text_col) == 1 else None
    rows = rows if inside is None else rows.drop("text")
    out = rows.mapInArrow(judge, f"id {types['id']}, kept {types['kept']}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col) if keep is not None else out.drop("kept").withColumnRenamed("id", id_col)


def held_out(id_column: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; rows without an id are held out too."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learns from the rows that are not held out, predicts all."""
    model = learn(docs.filter(~held_out(F.col(id_col))), model_path, text_col=text_col, lang_col=lang_col)
    return predict(docs, model, id_col=id_col, text_col=text_col, keep=held_out(F.col(id_col))).withColumnRenamed("kept", "held_out")
