"""Encoding of many texts by one tokenizer file inside a task, with a bounded memory of words already encoded."""

from __future__ import annotations

import itertools
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: Letters and other characters for which the plain pattern below and the library's own splitting are known to agree.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LETTERS}]*")
#: Kinds of the bytes of such texts: white space 0, letters 1 with all bytes of those beyond ASCII, digits 2, others 3.
KINDS = np.array([0 if c in b"\t\n\r " else 1 if c > 127 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)
#: Before a space between a visible character and a letter a new word begins in any case.
CUT = re.compile(rf"(?<=[!-~{LETTERS}]) (?=[{LETTERS}])")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: itself if it prints, else one of those from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


class Numbered(dict):
    """Numbers its keys in order of their first lookup."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n

    def since(self, n: int) -> list[str]:
        """The keys from number n on."""
        return list(itertools.islice(reversed(self), len(self) - n))[::-1]


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts of such characters only, one after the other, and the number of words of each text.

    This is the splitting of byte-level BPE: '(?:[stmd]|re|ve|ll)| ?letters| ?digits| ?others|white space(?!visible)|white space.
    """
    column = pa.array(texts, pa.string())
    edges = np.frombuffer(column.buffers()[1], np.int32, len(texts) + 1)
    size = int(edges[-1])
    data = np.frombuffer(column.buffers()[2], np.uint8, size) if size else np.zeros(0, np.uint8)
    kind = KINDS[data]
    first = np.zeros(size + 3, bool)
    first[edges] = True
    begin = first[: size + 1].copy()
    begin[1:-1] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] > 0) & (kind[:-1] == 0) & ~first[1:size]) + 1  # the last of some white space stands alone, or a space with what follows
    begin[after - 1] = True
    begin[after] = data[after - 1] != ord(" ")
    quote = np.flatnonzero((data == ord("'")) & begin[:-1])
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~first[quote + 1]
    long = (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~first[quote + 1] & ~first[quote + 2]
    begin[quote[short | long] + 1] = False
    begin[quote[short] + 2] = True
    begin[quote[long] + 3] = True
    places = np.flatnonzero(begin)
    words = pa.Array.from_buffers(pa.string(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), column.buffers()[2]])
    return words, np.diff(np.searchsorted(places, edges))


class ByteBpe:
    """Ids of the tokenizers library for byte-level BPE files, texts without added special tokens.

    A word's ids do not depend on its neighbours, so words are encoded by the library once and looked up afterwards, each
    different word of a run of texts once.
    Texts with a special token's string or with characters outside PLAIN go to the library whole.
    """

    def __init__(self, path: str, remember: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.remember = remember
        self.index = Numbered()
        self.starts, self.ids = array("q", [0]), array("i")  # word i has the ids from starts[i] to starts[i + 1]

    def forget(self) -> None:
        """Drops the later half of the words: those met first are the frequent ones."""
        half = self.remember // 2
        self.index = Numbered(itertools.islice(self.index.items(), half))
        del self.starts[half + 1 :]
        del self.ids[self.starts[half] :]

    def learn(self, words: list[str]) -> None:
        """Ids of new words, from the library's model: a word has been split already."""
        tokenize = self.library.model.tokenize
        got = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(BYTE_LETTERS))] for w in words]
        self.starts.extend(itertools.islice(itertools.accumulate(map(len, got), initial=len(self.ids)), 1, None))
        self.ids.extend(itertools.chain.from_iterable(got))

    def plain(self, text: str) -> bool:
        return self.split and PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of the words of plain texts start, one after the other, how many they are, and the number of words of each text."""
        if len(self.index) > self.remember:
            self.forget()
        words, counts = split(texts)
        different = words.dictionary_encode()
        keys = different.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))  # numbers new words as it meets them
        if len(self.index) > known:
            self.learn(self.index.since(known))
        starts, which = np.frombuffer(self.starts, np.int64), different.indices.to_numpy()
        return starts[at][which], (starts[at + 1] - starts[at])[which], counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.plain(t)]
        if plain:
            starts, sizes, counts = self.lookup([texts[i] for i in plain])
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            places = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
            flat = np.frombuffer(self.ids, np.int32)[places] if total else np.zeros(0, np.int32)
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            for i, a, b in zip(plain, bounds[:-1], bounds[1:], strict=True):
                out[i] = flat[a:b]
        rest = [i for i in range(len(texts)) if out[i] is None]
        for i, e in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = np.array(e.ids, np.int32)
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text, without making them."""
        out = np.zeros(len(texts), np.int64)
        plain = [i for i, t in enumerate(texts) if self.plain(t)]
        if plain:
            _, sizes, counts = self.lookup([texts[i] for i in plain])
            sums = np.concatenate([[0], np.cumsum(sizes)])
            ends = np.cumsum(counts)
            out[plain] = sums[ends] - sums[ends - counts]
        rest = sorted(set(range(len(texts))) - set(plain))
        if rest:
            out[rest] = [len(e.ids) for e in self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        return out

    def cut(self, text: str, size: int) -> list[str]:
        """The text in pieces of at least size characters, cut only where a new word begins anyway."""
        return cut_at(text, size, CUT) if self.split else [text]


def cut_at(text: str, size: int, boundary: re.Pattern) -> list[str]:
    """Pieces of at least size characters that end where boundary matches; joined they are the text."""
    out, start = [], 0
    while len(text) - start > size:
        m = boundary.search(text, start + size)
        if m is None:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


class Pieces:
    """Ids of the sentencepiece library for .model files."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        one, two = self.library.encode("a b"), self.library.encode(["a", "b"])
        self.split = one == two[0] + two[1] and self.library.encode("a  b") != one

    def count(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(len, self.library.encode(texts, num_threads=1)), np.int64, len(texts))

    def cut(self, text: str, size: int) -> list[str]:
        """Cut before a lone space, which then goes: the library puts one before each text."""
        if not self.split:
            return [text]
        first, *rest = cut_at(text, size, CUT)
        return [first, *(r[1:] for r in rest)]


_loaded: dict[str, ByteBpe | Pieces] = {}


def load(path: str) -> ByteBpe | Pieces:
    """The encoder of a file, once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path) if path.endswith(".model") else ByteBpe(path)
    return _loaded[path]


def by_bytes(texts: Iterable[str], most: int) -> Iterable[list[str]]:
    """Runs of texts of about equal size in UTF-8; a text over most stands alone."""
    run, size = [], 0
    for t in texts:
        n = len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run
