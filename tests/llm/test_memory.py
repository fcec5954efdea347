"""What a task holds besides its words: the arrays of lattices and the batches on the way to Python."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from barlume.llm import language_id, sentence_pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def made_up(n: int, size: int) -> list[str]:
    rng = random.Random(n)
    return ["".join(rng.choices("etaoinshrdlu", k=size)) for _ in range(n)]


def test_lattices_of_many_words_take_little():
    lattice, words = sentence_pieces.ArrayLattice(sentence_pieces.Vocabulary.load(PIECES)), made_up(5000, 40)
    assert peak_mb(lambda: lattice.encode(words)) < 60
    pieces, rng = language_id.vocabulary(PIECES), np.random.default_rng(1)
    scorer = language_id.Scorer(language_id.LanguageModel(["a", "b", "c", "d"], pieces, rng.random((len(pieces) + 1, 4)) / len(pieces), np.zeros(4)))
    assert peak_mb(lambda: scorer.learn(made_up(40_000, 20))) < 80


def test_texts_are_split_one_by_one():
    v = sentence_pieces.Vocabulary.load(PIECES)
    words = list(dict.fromkeys(sentence_pieces.MARK + w for w in made_up(2000, 5)))
    encoder = sentence_pieces.WordIds(v, words, np.ones(len(words), np.int64), np.arange(len(words), dtype=np.int32))
    rng = random.Random(3)
    texts = [" ".join(w[1:] for w in rng.choices(words, k=250)) for _ in range(700)]
    (flat, sizes), taken = encoder.encode(texts[:2]), peak_mb(lambda: encoder.encode(texts))
    assert flat.tolist() == [words.index(sentence_pieces.MARK + w) for t in texts[:2] for w in t.split(" ")] and sizes.tolist() == [250, 250]
    assert taken < 14, taken


def test_batches_of_long_texts_are_small(spark, frame):
    import corpus_pipeline

    def bytes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = frame([(i, "the word %d " % i * 5000, "en", "web") for i in range(200)], "doc_id bigint, text string, lang string, source string").coalesce(1)
    try:
        out = corpus_pipeline.encode_pieces(spark, docs, "")
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
        got = docs.mapInArrow(bytes_of, "rows bigint, bytes bigint").collect()
        assert sum(r["rows"] for r in got) == 200 and max(r["bytes"] for r in got) < 6e6
        assert {(r["doc_id"], r["n_tokens"] > 5000) for r in out.collect()} == {(i, True) for i in range(200)}
    finally:
        spark.conf.set(name, before)
    kept = {r["doc_id"]: (r["text"][:10], r["n_tokens"]) for r in sentence_pieces.encode_documents(docs, PIECES).limit(3).collect()}
    assert kept and all(text == ("the word %d " % i)[:10] for i, (text, _) in kept.items())
