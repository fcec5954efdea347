"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm import byte_bpe


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, batch_chars: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    Tokens are counted as the library of the file's kind gives them (tokenizers for .json, sentencepiece for .model),
    without begin, end or added special tokens; nothing is truncated. The texts of an Arrow batch are cut at safe
    boundaries into pieces of about piece_chars and encoded in runs of about batch_chars, so that neither a very long text
    nor many short ones unbalance a call.

    Null and empty texts have 0 bytes and 0 tokens, repeated rows are counted each, an empty table gives an empty one,
    other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe.load(tokenizer_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            pieces, of = [], []
            for i, t in enumerate(texts):
                cut = encoder.cut(t, piece_chars) if len(t) > piece_chars else [t]
                pieces += cut
                of += [i] * len(cut)
            counts = [encoder.count(run) for run in byte_bpe.by_bytes(pieces, batch_chars)]
            n = np.bincount(np.array(of, np.int64), weights=np.concatenate(counts), minlength=len(texts)).astype(np.int64) if of else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
