"""The corpus pipeline: documents through the stages in order, each over all that its predecessor kept.

Every stage but the last returns the columns of documents. What a stage decides takes effect on the rows it returns:
unidentifiable and repeated and contaminated documents go, personal data is replaced, and the last stage gives the ids of
each text that is left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.llm import decontamination, jaccard_join, language_id, pii, sentence_pieces
from barlume.llm.common import stage

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Posterior below which a language counts as not identified.
LEAST_POSTERIOR = 0.5
#: Keys of rows up to this number are sent to all tasks, some 30 bytes each.
FEW = 1_000_000
#: The key of the surrogates; a deployment sets its own.
PII_KEY = "corpus-pipeline"
#: Bytes of rows that go to Python at once. Spark builds such a batch outside its heap, one for each running task; the
#: default of 64 MB is not needed, as the tasks take slices.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of up to BATCH_BYTES from here on. Who calls a stage runs it later, so the session keeps that."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose likeliest language is not likely enough, go.

    Ids, null or repeated, decide only which rows are learned from. Each row is judged by its own whole text; an empty
    table stays empty, further columns come through.
    """
    small_batches(spark)
    model = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))), PIECES)
    judged = language_id.predict(docs, model, keep=F.struct(*docs.columns))
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_POSTERIOR)).select("kept.*")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def text_key() -> Column:
    """128 bits of a hash of the text, by which verdicts on a text come back; one for all null texts."""
    return F.concat(F.hex(F.xxhash64("text")), F.lit("."), F.hex(F.xxhash64(F.lit(1), F.col("text"))))


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key is not among keys. While these are few, they go to all tasks and no text is shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, on, "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one with the smallest id stays, null being the greatest; of its repeated rows any one.

    Documents without words (null, empty or blank texts) link with nothing, so all of them stay. Texts and not ids are
    compared and looked up, so repeated and null ids do no harm. An empty table stays empty, texts are compared whole,
    further columns come through, whatever their names.
    """
    small_batches(spark)
    text, null, number, stays = fresh(docs, "text_key", "id_is_null", "id_or_zero", "stays")
    row = [null, number, text]
    texts = docs.withColumns({text: text_key(), null: F.col("doc_id").isNull(), number: F.coalesce("doc_id", F.lit(0))})
    judged = jaccard_join.near_duplicates(texts.select(text, "text"), id_col=text).distinct()
    found = texts.groupBy(row).agg(F.count("*").alias("copies")).join(judged.filter("n_shingles > 0"), text)
    best = found.groupBy("component_id").agg(F.min(F.struct(row)).alias("best")).select("best.*", F.lit(True).alias(stays))
    found = found.select(*row, "copies").join(best, row, "left").withColumn(stays, F.coalesce(stays, F.lit(False)))
    touched = stage(found.filter((F.col("copies") > 1) | ~F.col(stays)).select(*row, stays), "touched")
    once = texts.join(F.broadcast(repeated) if (repeated := touched.filter(stays).drop(stays)).count() <= FEW else repeated, row, "left_semi").dropDuplicates(row)
    return without(texts, touched.drop(stays), row).unionByName(once).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, whatever their id: the verdict is one on the text.

    Texts without words, null ones among them, stay; repeated rows go or stay together; an empty table stays empty, texts
    are looked through whole, further columns come through, whatever their names.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    [text] = fresh(docs, "text_key")
    texts = docs.withColumn(text, text_key())
    marked = decontamination.mark_contamination(texts.select(text, "text"), benchmark, id_col=text)
    return without(texts, marked.filter("contaminated").select(text).distinct(), [text]).select(docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; n_chars follows the new text.

    Null texts stay null, with a null n_chars; each row of a repeated id is replaced by its own text; an empty table stays
    empty, texts are taken whole, further columns come through.
    """
    clean = pii.replace_pii(docs, PII_KEY)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every row: no ids for null and empty texts, nothing for an empty table."""
    small_batches(spark)
    return sentence_pieces.encode_documents(docs, PIECES, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("sentence_pieces", encode_pieces),
]

ORACLE_SQL = None  # learning, surrogates and merges have no SQL; tests hold the stages against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *inner, (_, last) = STAGES
    for name, step in inner:
        docs = stage(step(spark, docs, sf_dir), name)  # written and reread: the next stage reads it more than once
    return last(spark, docs, sf_dir)
