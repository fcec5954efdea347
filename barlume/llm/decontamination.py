"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive words, the smallest hash of the ``gram``-word runs inside is a fingerprint. A text that
shares a whole window with a benchmark item shares that window's fingerprint, so the fingerprints of both sides, joined by
equality, miss no item. Only documents that share one are read again: there each shared gram gives an alignment of the item
with the document, which is extended word by word to all the windows that really agree.

Items shorter than a window are one window of their own length; where the benchmark has such items, the documents' runs of
these lengths are joined too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.llm.common import Scratch, ascii_lower, stage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def places(count: Column) -> Column:
    """0 to count - 1, empty for a count below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(h: Column, k: int) -> Column:
    """The hash of every run of k words, from the words' hashes."""
    return F.transform(places(F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))


def window_minima(g: Column, count: int) -> Column:
    """The smallest of every count consecutive hashes."""
    return F.transform(places(F.size(g) - (count - 1)), lambda i: F.least(*[F.get(g, i + j) for j in range(count)]))


def fingerprinted(rows: DataFrame, window: int, gram: int, lengths: list[int]) -> DataFrame:
    """Adds n_words, h (word hashes), fps (distinct fingerprints) and runs (hashes of the runs of the given lengths) to rows with a column words."""
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("g", gram_hashes(F.col("h"), gram))
    runs = [gram_hashes(F.col("h"), n) for n in lengths]
    return rows.withColumns({
        "n_words": F.size("words").cast("bigint"),
        "fps": F.array_distinct(window_minima(F.col("g"), window - gram + 1)),
        "runs": F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<bigint>"),
    })


def covered(item: Column, dw: Column, h: Column, g: Column, window: int) -> Column:
    """The places of document words inside an occurrence of one of the item's windows."""
    size = F.size(item["words"])

    def extended(diagonal: Column) -> Column:
        agree = F.transform(item["words"], lambda w, t: F.coalesce(F.get(dw, t + diagonal) == w, F.lit(False)))
        starts = F.filter(places(size - (window - 1)), lambda s: F.forall(F.slice(agree, s + 1, window), lambda x: x))
        return F.flatten(F.transform(starts, lambda s: F.sequence(s + diagonal, s + diagonal + (window - 1))))

    seeds = F.flatten(F.transform(item["seeds"], lambda f: F.transform(F.filter(places(F.size(g)), lambda p: F.get(g, p) == f["hash"]), lambda p: p - f["at"])))
    long = F.flatten(F.transform(F.array_distinct(seeds), extended))
    whole = F.filter(places(F.size(h) - size + 1), lambda p: F.slice(dw, p + 1, size) == item["words"])
    short = F.flatten(F.transform(whole, lambda p: F.sequence(p, p + size - 1)))
    return F.array_distinct(F.when(size >= window, long).otherwise(short))


def spans(hits: str) -> Column:
    """The runs of consecutive places in a sorted array of them, as (first, last)."""
    bounds = lambda step: F.filter(hits, lambda p, i: F.coalesce(F.get(F.col(hits), i + step) != p + step, F.lit(True)))
    return F.arrays_zip(bounds(-1).alias("first"), bounds(1).alias("last"))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5, small: int = 500_000) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for every row of docs.

    n_hit counts the document's words inside any occurrence of a window of an item, n_items the items with such windows,
    items_sha256 is the lowercase hex digest of their ids, sorted as strings and joined by commas, spans lists the hit
    words as (first, last) places. Texts of any length are taken whole. Null texts and texts without words have no words and no hits, items without words match
    nothing, rows with one item id are one item, a null item id counts as ''. Repeated documents are judged each, empty
    tables on either side are fine, other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _mark(docs, benchmark, scratch, id_col, text_col, item_id_col, item_text_col, window, gram, small)


def _mark(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str, text_col: str, item_id_col: str, item_text_col: str, window: int, gram: int, small: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = {"d": F.coalesce(F.col("id").cast("string"), F.lit("")), "t": F.coalesce(F.xxhash64("text"), F.lit(0))}
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(item_text_col)).alias("words")).filter(F.size("words") > 0).distinct()
    lengths = sorted(r["n"] for r in items.filter(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect())  # fewer than window

    own = fingerprinted(items, window, gram, [])
    hashes = F.col("g")
    own = own.withColumn("seeds", F.transform(F.filter(places(F.size(hashes)), lambda p: F.array_contains(F.col("fps"), F.get(hashes, p))), lambda p: F.struct(p.alias("at"), F.get(hashes, p).alias("hash"))))
    run = F.lit(None).cast("bigint")
    for n in lengths:
        run = F.when(F.size("words") == n, F.xxhash64(*[F.get(F.col("h"), F.lit(j)) for j in range(n)])).otherwise(run)
    own = scratch.stage(own.select("item_id", "words", "seeds", "fps", run.alias("run")), "items")

    texts = fingerprinted(rows.withColumns(key | {"words": words(F.col("text"))}), window, gram, lengths)
    texts = scratch.stage(texts.select("id", "d", "t", "n_words", "fps", "runs"), "fingerprints")
    prints = own.select(F.explode("fps").alias("p"), "item_id").distinct()
    found = texts.select("d", "t", F.explode("fps").alias("p")).join(prints, "p").select("d", "t", "item_id")
    if lengths:
        short = own.filter("run IS NOT NULL").select(F.col("run").alias("p"), "item_id").distinct()
        found = found.unionByName(texts.select("d", "t", F.explode("runs").alias("p")).join(short, "p").select("d", "t", "item_id"))
    found = scratch.stage(found.distinct(), "candidates")
    some = found.select("d", "t").distinct()
    # only the candidates' texts are shuffled, once each; while their keys are few, these go to all tasks
    some = F.broadcast(some) if some.count() <= small else some
    texts_hit = rows.withColumns(key).join(some, ["d", "t"], "left_semi").dropDuplicates(["d", "t"]).select("d", "t", "text")

    hit = found.join(own.select("item_id", F.struct("words", "seeds").alias("item")), "item_id").join(texts_hit, ["d", "t"])
    hit = hit.withColumn("dw", words(F.col("text"))).withColumn("h", F.transform("dw", lambda w: F.xxhash64(w))).withColumn("g", gram_hashes(F.col("h"), gram))
    hit = hit.select("d", "t", "item_id", F.array_sort(covered(F.col("item"), F.col("dw"), F.col("h"), F.col("g"), window)).alias("hits"))
    hit = scratch.stage(hit, "hits").filter(F.size("hits") > 0)  # written, as a filter would otherwise do all of the above for each word
    hit = hit.groupBy("d", "t").agg(F.array_sort(F.collect_set("item_id")).alias("names"), F.flatten(F.collect_set(spans("hits"))).alias("spans"))
    hit = hit.withColumn("hits", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["first"], x["last"]))))))
    hit = hit.select("d", "t", "names", F.size("hits").cast("bigint").alias("n_hit"), spans("hits").alias("spans"))

    out = texts.select("id", "d", "t", "n_words").join(hit, ["d", "t"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    out = out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("names"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans",
    )
    return stage(out, "contamination")
