"""Token-id files: documents as ids in ascending order of their id, coded with one shared frequency table.

A token file is a Parquet table of coded blocks (``blocks``: bucket, block, payload, and the ids and lengths of the
documents listed with the block) beside its shared table (``table``: id, n). Buckets are ranges of document ids, so the
blocks in order of (bucket, block) hold the ids of all documents in order. Blocks do not depend on each other and carry
checkpoints and checksums, see rans.

Both ways the rows of a bucket pass through a task as a stream, some blocks at a time, so that neither a long bucket nor a
long document needs memory for all of it.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.llm import byte_bpe, rans
from barlume.llm.common import Scratch, at_the_end, shared_folder, text_bytes

DOCUMENT = "bucket int, doc_id bigint, n_tokens bigint, ids binary"
AT_ONCE = 32 * rans.BLOCK  # ids that are coded side by side


def bucket_of(keys: np.ndarray, texts: list[str], edges: np.ndarray) -> np.ndarray:
    """The range between edges (ascending) in which each key lies, upper edges included. A key that is several edges, as so many rows have it, is dealt over as many buckets by its texts."""
    low = np.searchsorted(edges, keys, "left")
    for i in np.flatnonzero(np.searchsorted(edges, keys, "right") - low > 1):
        low[i] += zlib.crc32(texts[i].encode("utf-8", "surrogatepass")) % (np.searchsorted(edges, keys[i], "right") - low[i])
    return low.astype(np.int32)


def binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of sizes items of flat as binary values."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def items(column: pa.Array, kind: str) -> np.ndarray:
    """The items of binary values, one after the other."""
    if not len(column):
        return np.zeros(0, kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // np.dtype(kind).itemsize, offsets[0]) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, kind)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, edges: np.ndarray) -> DataFrame:
    """(bucket, doc_id, n_tokens, ids): the ids of each whole text with the end id, as little-endian unsigned 16-bit integers, or 32-bit ones where the vocabulary needs them."""
    kind = id_type(tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe.load(tokenizer_path)
        for b in batches:
            keys, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            done = 0
            for run in byte_bpe.by_bytes(texts, 1 << 20):
                ids = encoder.encode(run)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.insert(np.concatenate(ids), np.cumsum(sizes), end_id).astype(kind)
                own = keys.slice(done, len(run))
                bucket = bucket_of(own.fill_null(-(2**63)).to_numpy(), run, edges)  # null ids come first
                yield pa.RecordBatch.from_arrays([pa.array(bucket), own, pa.array(sizes + 1), binaries(flat, sizes + 1)], ["bucket", "doc_id", "n_tokens", "ids"])
                done += len(run)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, DOCUMENT)


def vocabulary_size(tokenizer_path: str) -> int:
    return byte_bpe.load(tokenizer_path).library.get_vocab_size()


def id_type(tokenizer_path: str) -> str:
    return "<u2" if vocabulary_size(tokenizer_path) <= 1 << 16 else "<u4"


def shared_table(encoded: DataFrame, kind: str) -> DataFrame:
    """(id, n): how often each id occurs in all documents; a task sends one row for each id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(items(b.column(0), kind))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return encoded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def load_table(spark: SparkSession, path: str, size: int) -> rans.Frequencies:
    counts = np.zeros(size, np.int64)
    for r in spark.read.parquet(f"{path}/table").collect():  # a row for each id of the vocabulary at most
        counts[r["id"]] = r["n"]
    return rans.Frequencies.of(counts)


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 4 << 20, most_buckets: int = 100_000) -> None:
    """Writes the token file of docs below path: blocks and table.

    Null texts count as empty and give the end id alone; texts of any length are written whole; repeated rows are kept each,
    rows of one id in an order by their texts; null document ids come first. An empty table gives a file without blocks.
    Other columns are ignored. With more than most_buckets times bucket_bytes, buckets get longer, not tasks' memory.
    """
    spark, size, kind = docs.sparkSession, vocabulary_size(tokenizer_path), id_type(tokenizer_path)
    buckets = min(most_buckets, max(1, math.ceil(text_bytes(docs, text_col) / bucket_bytes)))
    bounds = docs.select(F.col(id_col).cast("bigint").alias("d")).approxQuantile("d", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    edges = np.sort(np.array(bounds, np.int64))
    with Scratch(spark) as scratch:
        encoded = scratch.stage(encode_documents(docs, tokenizer_path, end_id, id_col, text_col, edges), "token-ids")
        shared_table(encoded, kind).write.parquet(f"{path}/table")
        sizes = encoded.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect()  # a row for each bucket
        first = dict(zip([r["bucket"] for r in sizes], np.cumsum([0, *(r["n"] for r in sizes)]).tolist(), strict=False))
        table = spark.sparkContext.broadcast((load_table(spark, path, size), first))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shared, places = table.value
            for k, own in by_bucket(batches):
                block, place, held, listed, lengths = 0, places[k], np.zeros(0, kind), [], []
                for part in chain(own, [None]):
                    if part is not None:
                        held = np.concatenate([held, items(part.column(3), kind)])
                        listed += part.column(1).to_pylist()
                        lengths.append(part.column(2).to_numpy())
                        if len(held) < AT_ONCE:
                            continue
                    now = len(held) if part is None else len(held) // rans.BLOCK * rans.BLOCK
                    blocks = rans.encode_blocks(held[:now].astype(np.int64), place, shared)
                    rest = [None] * (len(blocks) - 1)  # documents are listed with the first block that is made after they came
                    if blocks:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([k] * len(blocks), pa.int32()), pa.array(range(block, block + len(blocks)), pa.int32()),
                                pa.array([listed, *rest], pa.list_(pa.int64())),
                                pa.array([np.concatenate([np.zeros(0, np.int64), *lengths]).astype("<i8").tobytes(), *rest], pa.binary()), pa.array(blocks, pa.binary()),
                            ],
                            ["bucket", "block", "doc_ids", "lengths", "payload"],
                        )
                        listed, lengths = [], []
                    block, place, held = block + len(blocks), place + now, held[now:]

        ordered = encoded.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "ids")
        coded = ordered.mapInArrow(code, "bucket int, block int, doc_ids array<bigint>, lengths binary, payload binary")
        coded.write.option("compression", "none").parquet(f"{path}/blocks")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(bucket, its parts) of rows in order of bucket, their first column. Parts are to be read before the next bucket."""
    parts = (b.slice(s, e - s) for b in batches if b.num_rows for s, e in runs(b.column(0).to_numpy()))
    for k, own in groupby(parts, key=lambda p: p.column(0)[0].as_py()):
        yield k, own


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """The bounds of the stretches of equal values."""
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def read_token_file(spark: SparkSession, path: str, vocabulary: int, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files alone. Buckets are read in parallel; a damaged block fails the read."""
    table = spark.sparkContext.broadcast(load_table(spark, path, vocabulary))
    columns = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in by_bucket(batches):
            held, place, keys, lengths = np.zeros(0, "<u4"), None, [], np.zeros(0, np.int64)
            for part in own:
                for i in range(0, part.num_rows, AT_ONCE // rans.BLOCK):
                    few = part.slice(i, AT_ONCE // rans.BLOCK)
                    got = rans.decode_blocks(few.column(4).to_pylist(), table.value)
                    place = got[0][0] if place is None else place
                    held = np.concatenate([held, *(g[1] for g in got)]).astype("<u4", copy=False)
                    keys += [k for ks in few.column(2).to_pylist() for k in ks or ()]
                    lengths = np.concatenate([lengths, *(np.frombuffer(x, "<i8") for x in few.column(3).to_pylist() if x is not None)])
                    ends = np.cumsum(lengths)
                    n = int(np.searchsorted(ends, len(held), "right"))  # documents that are here whole
                    raw, sizes = memoryview(held).cast("B"), lengths[:n]
                    cut = [raw[4 * (e - s) : 4 * e] for e, s in zip(ends[:n].tolist(), sizes.tolist(), strict=True)]
                    out = [pa.array(keys[:n], pa.int64()), pa.array(place + ends[:n] - sizes), pa.array(sizes), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                    done = int(ends[n - 1]) if n else 0
                    yield pa.RecordBatch.from_arrays([*out, *[binaries(held[:done], sizes)] * with_ids], columns)
                    held, place, keys, lengths = held[done:], place + done, keys[n:], lengths[n:]

    blocks = spark.read.parquet(f"{path}/blocks").select("bucket", "block", "doc_ids", "lengths", "payload")
    ordered = blocks.repartition("bucket").sortWithinPartitions("bucket", "block")
    return ordered.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Writes docs to a new token file in the shared folder and reads it back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-file-{uuid.uuid4().hex}"
    write_token_file(docs, path, tokenizer_path, end_id=end_id)
    at_the_end(spark, path)
    return read_token_file(spark, path, vocabulary_size(tokenizer_path), with_ids=with_ids)
