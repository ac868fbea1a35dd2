"""Token ids on disk, compressed document by document with a shared dictionary.

Format (Parquet files as the container, so that Spark's commit protocol and any
of its stores hold): one row per block of documents in ascending id order with
``shard, block, dict_hash, width, before, doc_ids, offsets, counts, data``.
``data`` joins one zstandard frame per document, frame i at
``offsets[i]:offsets[i + 1]``, of ``counts[i]`` little-endian ids of ``width``
bytes (2 where the vocabulary allows, else 4). ``before`` counts the ids of the
shard before the block. ``dict_hash`` names the dictionary (its sha-256) that
lies beside the blocks; one short document is read by unpacking its one frame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwise.llm.bpe import encode_text, encoded, tokenizer_memo, worker_memo

BLOCK_BYTES = 1 << 20
DICT_BYTES = 1 << 16
SAMPLE_DOCS = 512
SAMPLE_CHARS = 16384
LEVEL = 3
_BLOCK = ("shard int, block int, dict_hash string, width int, before long, first_doc long, last_doc long, "
          "doc_ids array<long>, offsets array<long>, counts array<long>, data binary")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """A dictionary from at most SAMPLE_DOCS documents of at most SAMPLE_CHARS
    characters (the bounded sample; it changes sizes, never ids). Empty where
    there is too little to train on."""
    size = F.char_length("text")
    marked = docs.where(size <= SAMPLE_CHARS).withColumn("h", F.xxhash64("doc_id", size))
    places = [r.h for r in marked.select("h").orderBy("h").limit(SAMPLE_DOCS).collect()]
    sample = marked.where(F.col("h").isin(places)).select("text").limit(SAMPLE_DOCS).collect() if places else []
    memo = worker_memo(tokenizer_memo, tokenizer)
    arrays = [_pack_ids(np.frombuffer(encode_text(r.text, memo), "<u4"), end_id, width) for r in sample]
    try:
        return zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _pack_ids(ids: np.ndarray, end_id: int, width: int) -> bytes:
    return np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id",
          text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the
    store to ``folder`` in ascending id order (null ids first; rows that repeat
    an id are written each, in no set order among themselves). Extra columns are
    not read. An empty table gives a store without documents."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    width = 2 if vocabulary <= 1 << 16 else 4
    raw = train_dictionary(rows, tokenizer, end_id, width)
    name = hashlib.sha256(raw).hexdigest()
    shared = spark.sparkContext.broadcast(raw)

    def texts(batches: Iterator[pa.RecordBatch], memo) -> Iterator[tuple]:
        for b in batches:
            for part, ids, first in encoded(b, 1, memo):
                for doc, x, y in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    yield doc, ids[x:y]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo(tokenizer_memo, tokenizer)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            known = [x for x in ids if x is not None]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).astype(np.int64)
            row = {"shard": shard, "block": block, "dict_hash": name, "width": width, "before": before,
                   "first_doc": min(known, default=None), "last_doc": max(known, default=None), "doc_ids": ids,
                   "offsets": offsets.tolist(), "counts": counts, "data": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], _SCHEMA)

        for doc, raw in texts(batches, memo):
            packed = _pack_ids(raw, end_id, width)
            frame = packer.compress(packed)
            ids.append(doc)
            counts.append(len(packed) // width)
            frames.append(frame)
            held += len(frame)
            if held >= block_bytes:
                yield flush()
                block, before = block + 1, before + sum(counts)
                ids, counts, frames, held = [], [], [], 0
        if ids:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The hash spreads rows that repeat one id over several ranges.
    placed = rows.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id")
    placed.mapInArrow(blocks, _BLOCK).write.mode("overwrite").parquet(f"{folder}/blocks")
    spark.createDataFrame([(name, raw)], "dict_hash string, data binary").coalesce(1).write.mode(
        "overwrite").parquet(f"{folder}/dictionary")


_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dict_hash", pa.string()), ("width", pa.int32()),
                     ("before", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
                     ("counts", pa.list_(pa.int64())), ("data", pa.binary())])


def _open(spark: SparkSession, folder: str) -> tuple[DataFrame, str, bytes]:
    stored = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    name, raw = spark.read.parquet(f"{folder}/dictionary").first()
    raw = bytes(raw)
    if hashlib.sha256(raw).hexdigest() != name:
        raise ValueError("the dictionary does not match its hash")
    return stored, name, raw


def _unpack(row: dict, wanted, tool, name: str) -> Iterator[tuple]:
    if row["dict_hash"] != name:
        raise ValueError("a block was written with another dictionary")
    at = row["before"]
    for i, (doc, count) in enumerate(zip(row["doc_ids"], row["counts"])):
        if wanted is None or doc == wanted:
            raw = tool.decompress(row["data"][row["offsets"][i]:row["offsets"][i + 1]], max_output_size=count * row["width"])
            yield doc, row["shard"], at, count, np.frombuffer(raw, f"<u{row['width']}").astype("<u4").tobytes()
        at += count


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian uint32) of each stored document."""
    stored, name, raw = _open(spark, folder)
    shared = spark.sparkContext.broadcast(raw)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for b in batches:
            for i in range(b.num_rows):
                got = list(_unpack(b.slice(i, 1).to_pylist()[0], None, tool, name))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    ["doc_id", "shard", "at", "n_tokens", "ids"])

    docs = stored.mapInArrow(unpack, "doc_id long, shard int, at long, n_tokens long, ids binary")
    # One row per shard: as many as the write had partitions.
    sums = stored.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    return docs.join(F.broadcast(before), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[int]:
    """The ids of one document: only its block is read, only its frame unpacked."""
    stored, name, raw = _open(spark, folder)
    tool = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    for row in stored.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).toLocalIterator():
        for got in _unpack(row.asDict(), doc_id, tool, name):
            return np.frombuffer(got[4], "<u4").tolist()
    raise KeyError(doc_id)


def digests(stored: DataFrame) -> DataFrame:
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
