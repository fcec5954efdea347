"""Document fingerprints by one-permutation MinHash.

The hashes of a text's shingles are dealt once over bins by their high bits, and each bin keeps its smallest. A bin without
a hash draws other bins at random until one has a value, which it takes (optimal densification); after ``DRAWS`` draws it
takes that of the bin, of those with one, whose hash with its own number is the smallest, so this ends for certain. Of each value the low bits are stored, packed. Two
such fingerprints also agree by chance where the values differ, once in 2 ** bits, and the likeness is corrected for that.

A neighbour's text is fetched by two equi-joins: documents are ranked by their keys alone, each document then learns who
comes before it and sends its fingerprint and as many characters as are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.llm.common import Scratch, ascii_lower, ranked, stage
from barlume.llm.decontamination import gram_hashes

BITS = 8  # a power of two up to 8; two hexadecimal digits each
DRAWS = 6
SPACE = r"[\x20\x09-\x0D]+"


def shingles(h: Column, words: int) -> Column:
    """The hash of every run of words, given the words' hashes; of the whole sequence if it is shorter, of nothing if it is empty."""
    return F.when(F.size(h) >= words, gram_hashes(h, words)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def with_fingerprint(rows: DataFrame, text: str, out: str, *, words: int = 5, bins: int = 256) -> DataFrame:
    """Adds out, an array<tinyint> with the low bits of every bin less 128, or null for a text without words.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. bins is a power of two.
    """
    shift = 64 - (bins.bit_length() - 1)
    low = (1 << shift) - 1
    # the largest value of every bin stands for none: so the first value of each bin, sorted, is one a bin
    nothing = F.transform(F.sequence(F.lit(-bins // 2), F.lit(bins // 2 - 1)), lambda b: F.shiftleft(b.cast("bigint"), shift).bitwiseOR(F.lit(low)))
    empty = lambda x: x.bitwiseAND(F.lit(low)) == low
    kept = rows.columns
    rows = rows.withColumn("_h", F.transform(F.array_remove(F.split(ascii_lower(F.col(text)), SPACE), ""), lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_s", F.sort_array(F.concat(shingles(F.col("_h"), words), nothing)))
    first = lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get("_s", i - 1), shift))
    rows = rows.withColumn("_m", F.filter("_s", first)).withColumn("_full", F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: ~empty(F.get("_m", i))))

    def borrowed(i: Column) -> Column:
        least = F.array_min(F.transform("_full", lambda j: F.xxhash64(i, j).bitwiseAND(F.lit(-bins)) + j))
        out = F.get("_m", least.bitwiseAND(F.lit(bins - 1)).cast("int"))
        for k in reversed(range(DRAWS)):
            drawn = F.get("_m", F.xxhash64(i, F.lit(k - DRAWS)).bitwiseAND(F.lit(bins - 1)).cast("int"))
            out = F.when(~empty(drawn), drawn).otherwise(out)
        return out

    value = lambda x, i: F.when(empty(x), borrowed(i)).otherwise(x)
    stored = F.transform("_m", lambda x, i: (value(x, i).bitwiseAND(F.lit((1 << BITS) - 1)) - 128).cast("tinyint"))
    return rows.withColumn(out, F.when(F.size("_full") > 0, stored)).select(*kept, out)


def packed(f: Column) -> Column:
    """A fingerprint as text: two hexadecimal digits a bin, nothing for a text without words."""
    digits = F.split(F.lit(",".join(f"{i:02x}" for i in range(1 << BITS))), ",")
    return F.coalesce(F.array_join(F.transform(f, lambda x: F.get(digits, x + F.lit(128))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two fingerprints' sets, 0 to 1. Without words both are alike, one is not."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)
    chance = 1 / (1 << BITS)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (agree - chance) / (1 - chance)))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bins: int = 256) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document
    in descending order of ids; after the last one comes the first. near_edited and near_next are the likeness of the
    fingerprint to the edited text's and the next document's.

    Null texts count as empty. Texts are taken whole. Documents of one id follow each other by a hash of their texts, those
    with a null id come last. Rows alike in id and text are one document, of which each row is returned. A single document
    is its own next one; an empty table gives an empty one; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        text = F.coalesce(F.col(text_col), F.lit(""))
        key = ["d", "z", "t", "u"]
        rows = docs.select(F.coalesce(F.col(id_col), F.lit(0)).alias("d"), F.col(id_col).isNull().alias("z"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u"), text.alias("text"))
        known = scratch.stage(rows.groupBy(*key).agg(F.max(F.char_length("text")).cast("bigint").alias("n")), "documents")
        placed = scratch.stage(ranked(known, [F.asc("z"), F.desc("d"), F.asc("t"), F.asc("u")], scratch), "ranks")
        total = placed.count()
        before = placed.select(*[F.col(c).alias(f"before_{c}") for c in [*key, "n"]], ((F.col("rank") + 1) % max(1, total)).alias("rank"))
        places = scratch.stage(placed.join(before, "rank").drop("rank"), "places")

        # merge joins: the shuffled texts, with their fingerprints, serve both sides of the second one
        own = with_fingerprint(rows, "text", "print", words=words, bins=bins).join(places.hint("merge"), key)
        sent = own.groupBy(*[F.col(f"before_{c}").alias(c) for c in key]).agg(F.first(F.expr("substring(text, 1, CAST(before_n DIV 3 AS INT))")).alias("head"), F.first("print").alias("next_print"))
        out = own.select(*key, "text", "print", "n").join(sent.hint("merge"), key)
        out = out.withColumn("edited", F.concat(F.expr("substring(text, 1, CAST(n - n DIV 3 AS INT))"), "head")).drop("text", "head")
        out = with_fingerprint(out, "edited", "edited_print", words=words, bins=bins)
        out = out.select(
            F.when(~F.col("z"), F.col("d")).alias(id_col), F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("print")).alias("fingerprint"), packed(F.col("edited_print")).alias("edited_fingerprint"),
            likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        )
        return stage(out, "fingerprints")
