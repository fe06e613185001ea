"""Token files: documents as Simple-8b coded ids, in ascending doc_id order.

A file is a folder of Parquet shards in id order. Each row is one block of whole
documents: ``shard``, ``block``, ``first`` (ids before it in its shard), ``n_ids``
and ``payload``. The payload, little-endian, is a header of three 64-bit integers
(documents, ids, words), the documents' ids, an offset by document (so one
document decodes alone), null flags, then the words. ``read_blocks`` decodes
blocks independently of each other.

Cases: a null text is an empty one; a null doc_id sorts first; rows that repeat a
doc_id are all kept, ordered by the hash of their text; an empty table gives an
empty file; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import load, partitions, scratch_path, text_chunks, whole_text
from .piece_cache import encoder, public_tokenizer

BLOCK_IDS = 1 << 19
END_ID = 2
BLOCK_SCHEMA = "shard int, block int, first long, n_ids long, payload binary"
DOC_SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def encode_block(doc_ids: list, lens: np.ndarray, ids: np.ndarray) -> bytes:
    words = simple8b.pack(ids)
    head = np.array([len(doc_ids), ids.size, words.size], "<i8")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype("<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(x.tobytes() for x in (head, keys, offsets, nulls, words.astype("<u8")))


def decode_block(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, offsets, token ids) of a block."""
    n, n_ids, n_words = (int(x) for x in np.frombuffer(payload, "<i8", 3))
    keys = np.frombuffer(payload, "<i8", n, 24)
    offsets = np.frombuffer(payload, "<i8", n + 1, 24 + 8 * n)
    nulls = np.frombuffer(payload, np.uint8, n, 32 + 16 * n)
    words = np.frombuffer(payload, "<u8", n_words, 32 + 17 * n)
    ids = simple8b.unpack(words, n_ids).astype("<u4")
    return [None if z else int(k) for k, z in zip(keys, nulls, strict=True)], offsets, ids


def _writer(tokenizer: str, end_id: int, block_ids: int):
    def write(batches):
        enc = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        first = block = 0
        doc_ids: list = []
        lens: list = []
        held: list = []
        size = 0

        def flush():
            nonlocal first, block, size, doc_ids, lens, held
            payload = encode_block(doc_ids, np.concatenate(lens), np.concatenate(held))
            row = pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "first": [first], "n_ids": [size], "payload": pa.array([payload], pa.binary())}
            )
            first, block, size, doc_ids, lens, held = first + size, block + 1, 0, [], [], []
            return row

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in text_chunks(texts, 8 * block_ids):
                ids, counts = enc.encode(texts[i:j])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                doc_ids += keys[i:j]
                lens.append(counts + 1)
                held.append(ids)
                size += ids.size
                if size >= block_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    return write


def write_token_file(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text and write the file; one range partition is one shard."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows.select("doc_id", "text").mapInArrow(_writer(tokenizer, end_id, block_ids), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def _digest(batches):
    for b in batches:
        for shard, first, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            keys, offsets, ids = decode_block(payload.as_buffer().to_pybytes())
            raw = memoryview(ids.tobytes())
            bounds = offsets.tolist()
            n = len(keys)
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard] * n, pa.int32()),
                    "doc_id": pa.array(keys, pa.int64()),
                    "local_start": pa.array(first + offsets[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(bounds, bounds[1:], strict=False)], pa.int64()),
                }
            )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the file.

    The ids before a shard come from one total per shard: as many rows as the
    file has shards, which is the only thing sent to the driver.
    """
    blocks = read_blocks(spark, path)
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, rows = 0, []
    for shard, n in totals:
        rows.append((shard, base))
        base += n
    bases = F.broadcast(spark.createDataFrame(rows, "shard int, base long"))
    docs = blocks.select("shard", "first", "payload").mapInArrow(_digest, DOC_SCHEMA)
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_file(load(spark, sf_dir, "documents"), path, public_tokenizer("byte_bpe_50k.json"))
    return read_digests(spark, path)
