"""Fingerprints, hard negatives and the prefix trie against plain Python, with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barlume.llm import fingerprints, hard_negatives, prefix_trie

TEXTS = [None, "", " \n", "a", "One two three", "one two three four five six seven", "word " * 9000, "été 日本語 😀 x y z " * 30, "A b c d e f g h i j k", "a B c d e f g h i j k", "x" * 5000]

# ---- 11


def chain(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >= 2**63 else seed




def shingle_set(text, words=5):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    h = [chain([w]) for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lower).split(" ") if w]
    return {chain(h[i : i + words]) for i in range(max(1, len(h) - words + 1))} if h else set()


def brute_print(spark, text, bins=256):
    """Bins by the high bits; draws of other bins by Spark's own hash of (bin, draw), whose form for ints is not repeated here."""
    s = shingle_set(text)
    if not s:
        return None
    bits = bins.bit_length() - 1
    least = {}
    for x in s:
        b = (x >> (64 - bits)) + bins // 2
        least[b] = min(x, least.get(b, x))
    draws = drawn(spark, bins)
    out = []
    for i in range(bins):
        j = i if i in least else next((j for j in draws["draw"][i] if j in least), None)
        if j is None:
            j = min(least, key=lambda j, i=i: (draws["hash"][i][j] & -bins) + j)
        out.append((least[j] & 255) - 128)
    return out


DRAWN = {}


def drawn(spark, bins):
    if bins not in DRAWN:
        rows = spark.range(bins).select(F.col("id").cast("int").alias("i")).select(
            "i", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.xxhash64("i", j)).alias("h"),
            F.array(*[F.xxhash64("i", F.lit(k - fingerprints.DRAWS)).bitwiseAND(F.lit(bins - 1)) for k in range(fingerprints.DRAWS)]).alias("d"),
        ).orderBy("i").collect()
        DRAWN[bins] = {"hash": [r["h"] for r in rows], "draw": [r["d"] for r in rows]}
    return DRAWN[bins]


def alike(a, b):
    if a is None or b is None:
        return float(a is b)
    agree = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    return max(0.0, (agree - 1 / 256) / (1 - 1 / 256))


def test_fingerprints_equal_brute_force(spark, frame):
    rows = [(3 * i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(None, "no id at all, but words", 1, "y"), (9, "second text of an id", 2, "z")]
    out = fingerprints.fingerprint_documents(frame(rows, "doc_id bigint, text string, print int, before string")).collect()
    key = lambda r: (r[0] is None, -(r[0] or 0), chain([r[1] or ""]))
    order = sorted(rows, key=key)
    want = []
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        text, other = r[1] or "", after[1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        prints = [brute_print(spark, t) for t in (text, edited, other)]
        shown = ["".join(f"{x + 128:02x}" for x in p or []) for p in prints]
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), shown[0], shown[1], round(alike(*prints[:2]), 12), round(alike(prints[0], prints[2]), 12)))
    sort = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert sort((*r[:5], round(r[5], 12), round(r[6], 12)) for r in out) == sort(want)


def test_fingerprints_of_repeats_alone_and_none(spark, frame):
    f = lambda rows: sorted(tuple(r) for r in fingerprints.fingerprint_documents(frame(rows, "doc_id bigint, text string")).collect())
    assert f([]) == []
    [one] = f([(1, "a lonely text of some more words")])
    assert one[6] == 1.0 and one[5] < 1  # it is its own next one, and its end is replaced by its start
    twice = f([(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta")])
    assert len(twice) == 3 and twice[0] == twice[1] and len({r[3] for r in twice}) == 1 and all(r[6] == 1.0 for r in twice)


def test_likeness_estimates_jaccard(spark, frame):
    """Overlaps from 0 to 1: the mean error stays within what 256 bins of 8 bits leave, also for sets smaller than the bins."""
    rng = random.Random(1)
    rows, true = [], []
    for n in (8, 40, 150, 900):
        for share in (0.0, 0.3, 0.6, 0.9):
            for _ in range(12):
                a = [str(rng.random()) for _ in range(n)]
                b = a[: int(n * share)] + [str(rng.random()) for _ in range(n - int(n * share))]
                x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
                rows.append((len(rows), " ".join(a), " ".join(b)))
                true.append(len(x & y) / len(x | y))
    df = frame(rows, "id bigint, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = [r[0] for r in df.orderBy("id").select(fingerprints.likeness(F.col("fa"), F.col("fb"))).collect()]
    error = np.array(got) - np.array(true)
    assert abs(error.mean()) < 0.02 and np.abs(error).mean() < 0.06 and np.abs(error[36:][np.array(true[36:]) == 0]).max() < 0.05


# ---- 12


def brute_negatives(rows, anchor):
    ok = [(i, y, tuple(int(np.floor(256 * float(x))) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in set(filter(lambda r: anchor(r[0]), ok)):
        other = [(-sum(p * q for p, q in zip(a[2], r[2], strict=True)), r[0], r[1] == a[1]) for r in ok if r[0] != a[0] and len(r[2]) == len(a[2])]
        for s, p, _ in sorted(o for o in other if o[2])[:5]:
            for k, (n, i, _) in enumerate(sorted(o for o in other if not o[2] and 80 * -s <= 100 * -o[0] <= 100 * -s)[:5]):
                out.append((a[0], p, k + 1, i, -s, -n))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 24, 1500])
def test_hard_negatives_equal_brute_force(spark, frame, block_bytes):
    rng = random.Random(5)
    vector = lambda d: [rng.choice([0.25, 0.5, 0.75, 1.0, -0.5]) for _ in range(d)]  # noqa: E731  many ties
    rows = [(i, rng.randrange(3), vector(rng.choice([2, 3, 3]))) for i in range(160)]
    rows += [(None, 1, [1.0, 1.0]), (500, None, [1.0, 1.0]), (510, 1, None), (520, 1, [None, 1.0]), (530, 1, [float("nan"), 1.0]), (540, 1, [float("inf"), 1.0]), (550, 1, []), (560, 2, []), (10, 1, [0.5, 0.5]), rows[20], rows[20], (570, 1, [2.0**30, 3.0]), (571, 1, [2.0**12, -3.0]), (572, 2, [2.0**12, 0.0])]
    df = frame([(*r, 1, 2) for r in rows], "vec_id bigint, label int, embedding array<float>, slot int, score int")
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, block_bytes=block_bytes)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0)
    none = hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0)
    assert none.count() == 0 and none.columns == got.columns


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for most in (1000, 2**24, 2**28):
        a, b = rng.integers(-most, most, (7, 33)), rng.integers(-most, most, (9, 33))
        assert (hard_negatives.products(a, b) == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]).all()


def test_best_merges_in_any_order():
    rng = np.random.default_rng(1)
    rows = np.stack([rng.integers(0, 4, 300), rng.integers(0, 9, 300), rng.permutation(300)], axis=1)
    best = hard_negatives.Best(4, 5)
    for part in np.array_split(rows, 11):
        best.offer(*part.T)
    for s in range(4):
        want = sorted((-r[1], r[2]) for r in rows if r[0] == s)[:5]
        assert [(-a, b) for a, b in zip(best.scores[s].tolist(), best.ids[s].tolist(), strict=True)] == want


# ---- 13

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows, rebuilt=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", chain([role or "", text or ""]), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    nodes, ends, kids, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        s = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
        ends[s].append(c)
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    for s in nodes:
        kids[s[:-1]] += bool(s)
    for s, m in nodes.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(m) - 1) * (len(s[-1][1]) if s else 0)
            leaves[s[:d]] += not kids[s]
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()
    return {(min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], digest(s)) for s, m in nodes.items()}


def trie(frame, rows, **more):
    out = prefix_trie.prefix_trie(frame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, path int, depth string"), **more).select(NODE).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def rebuilt():
    return {"base": F.col("conv") - F.col("conv") % 100, "shared": (F.crc32(F.col("conv").cast("string")) % 6).cast("int")}


def test_trie_equals_brute_force(spark, frame):
    rng = random.Random(2)
    rows = []
    for c in [*range(-103, -97), *range(0, 12), *range(95, 115), *range(300, 340), 777]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé😀", ""])) for t in range(rng.randrange(1, 9))]
    rows += [(5, None, None, None), (5, None, "user", "z"), (5, 2, "user", "tie"), (5, 2, "user", "a tie"), (5, 2, "user", "tie"), (None, 1, "user", "nobody's"), (900, 0, "user", "long " * 20_000), (901, 0, "user", "long " * 20_000)]
    rows += [(1000 + i, t, "user", "chain") for i in range(3) for t in range(300 + 40 * i)]  # far deeper than wide
    rows += [(5000 + i, t, "user", "copy") for i in range(60) for t in range(4)]
    rng.shuffle(rows)
    assert trie(frame, rows, **rebuilt()) == brute_trie(rows)
    assert trie(frame, rows) == brute_trie(rows, rebuilt=False)


def test_trie_over_groups_of_neighbours(spark, frame, monkeypatch):
    monkeypatch.setattr(prefix_trie, "GROUP", 3)
    rng = random.Random(4)
    rows = [(c, t, "user", rng.choice("ab")) for c in range(80) for t in range(rng.randrange(1, 7))]
    assert trie(frame, rows, **rebuilt()) == brute_trie(rows)


def test_trie_of_little(spark, frame):
    assert trie(frame, [], **rebuilt()) == set()
    assert trie(frame, [(None, 1, "user", "x")]) == set()
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    one = [(c, 0, "user", "x")]  # its base is absent, so what it would share is gone
    assert trie(frame, one, **rebuilt()) == brute_trie(one) and len(brute_trie(one)) == 1


# ---- 7: shards by space


def test_medians_send_every_row_to_a_leaf_of_its_own_kind():
    from barlume.llm.topk import Medians

    x = np.random.default_rng(0).normal(size=(4000, 3))
    tree = Medians.of(x[:500], 7)
    leaf = tree.leaf(x)
    sizes = np.bincount(leaf)
    assert len(sizes) == 7 and sizes.min() > 0.3 * len(x) / 7 and sizes.max() < 2.5 * len(x) / 7 and (tree.leaf(x[::-1]) == leaf[::-1]).all()
    assert set(Medians.of(np.ones((50, 2)), 4).leaf(x[:, :2])) == {0} and set(Medians.of(x[:0], 4).leaf(x)) == {0}


def test_clustered_vectors_prune_pairs_and_stay_exact(spark, frame, monkeypatch):
    from barlume.llm import topk

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    x = centres[rng.integers(0, 12, 1500)] + 0.1 * rng.normal(size=(1500, 8))
    x[100:400] = x[100]  # a fifth of all rows alike
    df = frame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    met, real = [], topk.pair_bounds
    monkeypatch.setattr(topk, "pair_bounds", lambda b, s: met.append(real(b, s)) or met[-1])
    tried = []
    from pyspark.sql import SparkSession

    make = SparkSession.createDataFrame
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, schema=None, *a, **o: tried.append(len(data)) or make(self, data, schema, *a, **o) if schema == "block int, shard int" else make(self, data, schema, *a, **o))
    got = sorted(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 20 == 0, shard_rows=60, block_rows=3).collect())
    e = np.floor(256 * x).astype(np.int64)
    want = []
    for q in range(0, 1500, 20):
        s = e @ e[q]
        best = sorted((-s[i], i) for i in range(1500) if i != q)[:5]
        want += [(q, r + 1, i, -n) for r, (n, i) in enumerate(best)]
    assert got == sorted(want)
    assert len(met[0]) > 100 and sum(tried) < 0.5 * len(met[0]), (sum(tried), len(met[0]))  # more than half of the pairs never meet
