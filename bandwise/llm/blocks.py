"""Documents in blocks, and questions that blocks put to shards.

A block is a few megabytes of documents, compressed, under a key that is fixed
when the table is written. The table is bucketed by that key, so texts are
shuffled once, however often answers are brought back to them. A block sends
each shard one row with a packed array of hashes, already reduced to distinct
ones, so a passage that is in every document costs a shard one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm import scratch

BLOCK_BYTES = 4 << 20
SHARD_ENTRIES = 2_000_000


def slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text is
    a part of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.maximum.accumulate((np.cumsum(size) - size) // most)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield batch.slice(a, b - a)


def to_blocks(docs: DataFrame, text: int, name: str, most: int = BLOCK_BYTES) -> DataFrame:
    """block, n_bytes, payload: the rows of ``docs`` (text in column number
    ``text``) in compressed blocks, bucketed by block."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in slices(b, text, most):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([part.nbytes], pa.int64()),
                     pa.array([pack(part)], pa.binary())], ["block", "n_bytes", "payload"])
                block += 1

    return scratch.cut_bucketed(docs.mapInArrow(make, "block long, n_bytes long, payload binary"), "block", name)


def pack(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
        writer.write_batch(part)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def shard_count(blocks: DataFrame, bytes_per_entry: float, entries: int = SHARD_ENTRIES) -> int:
    """Shards such that each gets about ``entries`` entries at most."""
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, int(-(-total // int(bytes_per_entry * entries))))


def by_shard(block: int, keys: np.ndarray, columns: list[np.ndarray], shards: int) -> list[dict]:
    """One row per shard with the entries whose key falls to it. ``columns`` are
    joined one after another; wide whole numbers are stored byte by byte, which
    the shuffle's compression likes."""
    place = ((keys >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(shards + 1))
    columns = [c[order] for c in columns]
    return [{"shard": s, "block": block, "n": int(b - a), "data": b"".join(_bytes(c[a:b]) for c in columns)}
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def _bytes(column: np.ndarray) -> bytes:
    if column.dtype == np.int64:
        return np.ascontiguousarray(column.view(np.uint8).reshape(-1, 8).T).tobytes()
    return column.tobytes()


def split(data: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    """The columns that ``by_shard`` joined."""
    out, at = [], 0
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        part = np.frombuffer(data, np.uint8, size, at)
        if kind == "i8":
            part = np.ascontiguousarray(part.reshape(8, n).T).reshape(-1)
        out.append(part.view(kind))
        at += size
    return out


ASK = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
ASK_DDL = "shard long, block long, n long, data binary"
REPLY = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
REPLY_DDL = "block long, n long, data binary"


def ask(blocks: DataFrame, question: Callable[[int, pa.Table], list[dict]]) -> DataFrame:
    """The rows that ``question`` sends from each block to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1)):
                yield pa.RecordBatch.from_pylist(question(block, unpack(payload.as_buffer())), ASK)

    return blocks.select("block", "payload").mapInArrow(run, ASK_DDL)


def answer(asked: DataFrame, reply: Callable[[list[np.ndarray], list[int], list[int]], list[np.ndarray]],
           kinds: list[str]) -> DataFrame:
    """Per shard: ``reply`` gets the columns of all its entries, each entry's row
    number and the rows' blocks, and returns for each entry whether it goes
    back, with the columns of what goes back."""

    def run(table: pa.Table) -> pa.Table:
        ns, blocks = table.column("n").to_pylist(), table.column("block").to_pylist()
        parts = [split(d, n, kinds) for d, n in zip(table.column("data").to_pylist(), ns)]
        columns = [np.concatenate(c) for c in zip(*parts)]
        row = np.repeat(np.arange(len(ns)), ns)
        back, columns = reply(columns, row, np.array(blocks, np.int64))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[back], minlength=len(ns)))])
        columns = [c[back] for c in columns]
        return pa.Table.from_pylist(
            [{"block": blk, "n": int(b - a), "data": b"".join(_bytes(c[a:b]) for c in columns)}
             for blk, a, b in zip(blocks, ends[:-1], ends[1:]) if b > a], REPLY)

    return asked.groupBy("shard").applyInArrow(run, REPLY_DDL)


def replies(table: pa.Table, kinds: list[str]) -> list[np.ndarray]:
    parts = [split(d, n, kinds) for d, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist())]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]


def bring(blocks: DataFrame, answers: DataFrame, use: Callable[[int, pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """Each block together with what came back to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [use(block, unpack(payload.as_buffer()), right)
                 for block, payload in zip(left.column("block").to_pylist(), left.column("payload"))]
        return pa.concat_tables(parts) if parts else None

    return (blocks.select("block", "payload").groupBy("block")
            .cogroup(answers.groupBy("block")).applyInArrow(run, ddl))
