"""Whole queries and pipeline stages against plain Python, and the odd tables that every operator must take."""

import math
import random
import zlib

import public_tokenizers
import pytest

from barlume.llm import chat, jaccard_join, language_id, sentence_pieces, token_counts, url_filter

PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")

# ---- 5, the whole


def segmentations(word, known):
    """All ways to cut a word into pieces; single characters that are no piece are the unknown one (None)."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in known or n == 1:
            for rest in segmentations(word[n:], known):
                yield [word[:n] if word[:n] in known else None, *rest]


def brute_languages(rows, rounds=2, smoothing=0.1):
    """(held_out, lang_pred, score) of each row by expectation-maximisation over all segmentations."""
    pieces = language_id.vocabulary(PIECES)
    known = set(pieces)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 3 == 1
    counts, docs = {}, {}
    for i, text, lang in rows:
        words = language_id.words_of(text)
        if not held(i) and lang is not None and words:
            docs[lang] = docs.get(lang, 0) + 1
            for w in words:
                counts.setdefault(lang, {})[w] = counts.setdefault(lang, {}).get(w, 0) + 1
    p = {}
    for r in range(rounds + 1):
        for lang in sorted(docs):
            c = dict.fromkeys([*pieces, None], 0.0)
            for w, n in counts[lang].items():
                if r == 0:
                    for a in range(len(w)):
                        for b in range(a + 1, len(w) + 1):
                            if w[a:b] in known or b == a + 1:
                                c[w[a:b] if w[a:b] in known else None] += n
                else:
                    ways = [(s, math.prod(p[lang][x] for x in s)) for s in segmentations(w, known)]
                    total = sum(q for _, q in ways)
                    for s, q in ways:
                        for x in s:
                            c[x] += n * q / total
            every = sum(c.values()) + smoothing * len(c)
            p[lang] = {x: max((v + smoothing) / every, 1e-6 * (1 if x is None else 1e-3)) for x, v in c.items()}
    out = []
    for i, text, _ in rows:
        words, logs = language_id.words_of(text), {}
        for lang in sorted(docs):
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log(sum(math.prod(p[lang][x] for x in s) for s in segmentations(w, known))) for w in words)
        best = max(sorted(logs), key=logs.get) if words and logs else "und"
        out.append((i, held(i), best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()) if best != "und" else 0.0))
    return out


def test_language_query_equals_all_segmentations(spark, frame):
    rng = random.Random(4)
    words = {"aa": ["the", "water", "house", "bird"], "bb": ["der", "wasser", "haus", "vogel"], "cc": ["eau", "maison", "oiseau", "le"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randrange(1, 6))), lang if rng.random() < 0.8 else None) for i, lang in enumerate(rng.choices(list(words), k=40))]
    rows += [(100, None, "aa"), (101, "12 34", "bb"), (None, "the haus", "cc"), (102, "日本 ж", "aa"), (103, "house", None), (103, "house", None)]
    df = frame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, score string, kept int").repartition(3)
    got = language_id.identify(df, PIECES).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted((tuple(r["doc_id"] if c == "doc_id" else r[c] for c in ("doc_id", "held_out", "lang_pred", "score")) for r in got), key=key), sorted(brute_languages(rows), key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6


# ---- the pipeline's stages


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def kept_by_brute_force(rows):
    """Of each group of linked texts the row with the smallest id."""
    s = [shingles(t or "") for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                group[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if r not in best or (d is None, d or 0) < (rows[best[r]][0] is None, rows[best[r]][0] or 0):
            best[r] = i
    return sorted(rows[i][0] for i in best.values())


def clean_by_brute_force(rows, bench):
    split = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() or ord(c) > 127 else " " for c in t or "").split(" ") if w]
    windows = {tuple(w[i : i + 10]) for b in bench for w in [split(b)] for i in range(len(w) - 9)}
    return sorted(d for d, t in rows for w in [split(t)] if not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)))


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 7))) for _ in range(120)]
    rows = []
    for i in range(40):
        t = rng.choices(words, k=rng.randrange(1, 120))
        rows.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):  # near copies, some of them too far
            c = list(t)
            for _ in range(rng.choice([0, 1, 2, 6])):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append(c)
    bench = [" ".join(rng.choices(words, k=25)) for _ in range(3)]
    for k in range(4):
        at = rng.randrange(10)
        rows.append(rng.choices(words, k=30) + bench[k % 3].split()[at : at + (10 if k else 9)] + rng.choices(words, k=20))
    rng.shuffle(rows)
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return [(i, " ".join(t)) for i, t in enumerate(rows)], bench, str(tmp_path)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string, stays string, `id_is_null` int, pii_found string"


def as_documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine", "also", 3, "too") for i, t in rows], SCHEMA).repartition(3)


def test_stages_equal_brute_force_and_keep_all_columns(spark, corpus):
    import corpus_pipeline

    rows, bench, folder = corpus
    docs = as_documents(spark, rows)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert sorted(r["doc_id"] for r in one.collect()) == kept_by_brute_force(rows) and 0 < one.count() < len(rows)
    two = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert sorted(r["doc_id"] for r in two.collect()) == clean_by_brute_force(rows, bench) and two.count() == len(rows) - 3
    for out in (one, two, corpus_pipeline.replace_personal_data(spark, docs, folder), corpus_pipeline.identify_language(spark, docs, folder)):
        assert out.dtypes == docs.dtypes
        assert {(r["text_key"], r["stays"], r["id_is_null"], r["pii_found"]) for r in out.collect()} == {("mine", "also", 3, "too")}


def test_stages_take_empty_tables_and_very_long_texts(spark, corpus):
    import corpus_pipeline

    _, _, folder = corpus
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60_000))
    docs = as_documents(spark, [(1, long), (2, long + " end"), (3, "Alice Zander wrote " + long), (4, None), (5, "")])
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), folder).count() == 0
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()) == [1, 4, 5]
    assert corpus_pipeline.drop_contaminated(spark, docs, folder).count() == 5
    new = {r["doc_id"]: r["text"] for r in corpus_pipeline.replace_personal_data(spark, docs, folder).collect()}
    assert new[1] == long and "Zander" not in new[3] and new[3].endswith(" wrote " + long)
    ids = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.encode_pieces(spark, docs, folder).collect()}
    assert ids[1] > 60_000 and ids[4] == ids[5] == 0


# ---- odd tables


def test_repeated_rows_and_empty_tables(spark, frame):
    rows = [(1, "the same text"), (1, "the same text"), (2, "the same text"), (None, None)]
    df = frame(rows, "doc_id bigint, text string")
    ids = sentence_pieces.encode_documents(df, PIECES).collect()
    assert len(ids) == 4 and len({tuple(r["ids"]) for r in ids if r["doc_id"]}) == 1
    counts = token_counts.count_tokens(df, BPE).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in counts) == [(0, False), (1, True), (1, True), (2, True)]
    assert token_counts.count_tokens(df.limit(0), BPE).count() == 0


def test_very_long_texts_and_urls(spark, frame):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(30_000)]
    rows = [(7, " ".join(words)), (3, " ".join(words[:-100])), (5, " ".join(words[:20_000]))]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame(rows, "doc_id bigint, text string")).collect()}
    assert out == {7: (29_997, 3), 3: (29_897, 3), 5: (19_997, 5)}
    url = "http://" + "a." * 3000 + "example.com/" + "p" * 50_000
    page = url_filter.judge_urls(frame([(1, url)], "page_id int, url string"), [], frame([("example.com",)], "d string")).first()
    assert page["verdict"] == "block" and len(page["path"]) == 50_001
    turns = frame([(1, 0, "user", "x " * 100_000), (1, 1, "assistant", "y")], "conv_id int, turn int, role string, text string")
    views = {r["perspective"]: r for r in chat.rotate_perspectives(turns).collect()}
    assert set(views) == {"user", "assistant"} and all(len(r["rendered"]) > 200_000 for r in views.values())
