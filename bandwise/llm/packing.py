"""Lexical retrieval packing of documents into fixed windows.

Documents are tokenised; whole windows of a long document are sequences of
their own, and what is left of each document goes to a shard by its content: the
rests are put in the order of their heaviest terms (the terms themselves in a
fixed random order, as in min-hashing) and cut into shards, so that rests which
share heavy terms tend to lie in one. A shard holds a bounded number of tokens
and builds a BM25 inverted index over its rests, with document frequencies and
lengths taken over all rests of the
corpus. A seed's query returns the unused neighbours, best first, which
fill its window; the neighbour that does not fit is cut and its rest becomes
the next seed. Only a shard's last window can be left with room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm import scratch
from bandwise.llm.bpe import encoded, tokenizer_memo, worker_memo

WINDOW = 2048
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75
HEAVY, ORDERED = 8, 4
SPREAD = 2654435761  # multiplicative hashing
_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_OWN_SEQUENCE = 1 << 62  # sequence ids of whole windows; shards count below


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset,
    ids (binary, little-endian uint32).

    A document is its text's ids and ``end_id``; a null text counts as empty and
    gives the end id alone. Each id lies in exactly one piece, offsets are
    gapless from 0 in each sequence, and no sequence is longer than ``window``.
    Rows that repeat an id are packed each for itself. Ties in BM25 go to the
    row read first. Extra columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo(tokenizer_memo, tokenizer)
        counter = TaskContext.get().partitionId() << 38
        for part, all_ids, first in (x for b in batches for x in encoded(b, 1, memo)):
            out, raw = [], all_ids.tobytes()
            for doc, x, y in zip(part.column(0).to_pylist(), (4 * first[:-1]).tolist(), (4 * first[1:]).tolist()):
                ids = raw[x:y] + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    counter += 1
                    piece = ids[4 * at:4 * (at + window)]
                    full = len(piece) == 4 * window
                    out.append((doc, at, len(piece) // 4, n, _OWN_SEQUENCE | counter if full else None, counter, piece))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), _CUT_TYPES)] if out else [pa.array([], t) for t in _CUT_TYPES],
                _CUT_NAMES)

    cuts = scratch.cut(rows.mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, uid long, ids binary"),
        "pieces")
    whole = cuts.where("sequence_id IS NOT NULL").select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "ids")
    rests = cuts.where("sequence_id IS NULL")
    n, tokens = rests.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if not n:
        return whole
    idf = _idf(rests, n)
    shards = max(1, -(-tokens // shard_tokens))
    share = spark_broadcast(docs, (idf, tokens / n))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mean = share.value
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in (*_ORDER, "uid")])
        # Ranges are equal in rows; one with many tokens is cut once more.
        held = np.cumsum(rows.column("length").to_numpy())
        runs = max(1, -(-int(held[-1]) // (2 * shard_tokens)))
        ends = np.unique([0, *np.searchsorted(held, held[-1] * np.arange(1, runs) / runs), rows.num_rows])
        for i, (at, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            first = (TaskContext.get().partitionId() << 10 | i) << 24
            yield from _fill_windows(rows.slice(at, end - at).sort_by("uid"), weights, mean, window, first).to_batches()

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mean = share.value
        for b in batches:
            order = [_heavy_terms(np.frombuffer(x, "<u4"), weights, mean, n) for x in b.column(5).to_pylist()]
            columns = np.array(order, np.int64).reshape(-1, ORDERED).T
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, columns)], [*b.schema.names, *_ORDER])

    rests = rests.select("doc_id", "start", "length", "doc_tokens", "uid", "ids")
    if shards > 1:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rests.schema)
        rests = scratch.cut(rests.mapInArrow(heavy, kinds + "".join(f", {c} long" for c in _ORDER)), "rests")
    else:
        rests = rests.withColumns({c: F.lit(0).cast("long") for c in _ORDER})
    # The row's number in the end, so that equal rests can be cut anywhere.
    packed = rests.repartitionByRange(shards, *_ORDER, "uid").mapInArrow(fill, _PIECE)
    return whole.unionAll(packed)


_ORDER = [f"heavy{i}" for i in range(ORDERED)]
_CUT_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "uid", "ids"]
_CUT_TYPES = [pa.int64()] * 6 + [pa.binary()]


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def _idf(rests: DataFrame, n: int) -> np.ndarray:
    """BM25 weight of each token id, 0 for ids in more than half of all rests.
    At most one row per id of the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids in b.column(0).to_pylist():
                seen = np.unique(np.frombuffer(ids, "<u4"))
                if len(seen) and seen[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(seen[-1]) + 1 - len(total), np.int64)])
                total[seen] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "df"])

    got = (rests.select("ids").mapInArrow(count, "term long, df long")
           .groupBy("term").agg(F.sum("df").alias("df")).toPandas())
    out = np.zeros(int(got.term.max()) + 1, np.float32)
    df = got.df.to_numpy(np.float64)
    out[got.term.to_numpy()] = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))
    return out


def _heavy_terms(ids: np.ndarray, idf: np.ndarray, mean: float, n: int) -> list[int]:
    """What a rest is ordered by: its HEAVY terms of most BM25 weight that another
    rest has too, by their hash, the first ORDERED of them (-1 where there are fewer)."""
    t, tf = np.unique(ids, return_counts=True)
    w = idf[t]
    # Terms of a single rest weigh log((n - 0.5) / 1.5), those of two log((n - 1.5) / 2.5).
    known = (w > 0) & (w < np.log((n - 1) / 2))
    t, tf, w = t[known], tf[known], w[known]
    if len(t) > HEAVY:
        w = w * tf / (tf + K1 * (1 - B + B * len(ids) / mean))
        t = t[np.argsort(-w, kind="stable")[:HEAVY]]
    places = np.sort(t.astype(np.uint64) * np.uint64(SPREAD) & np.uint64(0xFFFFFFFF))[:ORDERED].tolist()
    return places + [-1] * (ORDERED - len(places))


def _fill_windows(rows: pa.Table, idf: np.ndarray, mean: float, window: int, first: int) -> pa.Table:
    ids = [np.frombuffer(x, "<u4") for x in rows.column("ids").to_pylist()]
    n = len(ids)
    terms, owner, weight, queries = [], [], [], []
    for d, x in enumerate(ids):
        t, tf = np.unique(x, return_counts=True)
        known = idf[t] > 0
        t, tf = t[known], tf[known]
        queries.append(t)
        terms.append(t)
        owner.append(np.full(len(t), d, np.int32))
        weight.append(idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean)))
    terms, owner, weight = np.concatenate(terms), np.concatenate(owner), np.concatenate(weight)
    index = _Index(terms, owner, weight, len(idf), n)

    def scores(seed: int) -> np.ndarray:
        return index.scores(queries[seed], used < size)

    doc_ids, base, doc_tokens = (rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
    used = np.zeros(n, np.int64)  # ids of each rest that lie in a piece
    size = np.array([len(x) for x in ids])
    out, sequence, seed = [], first, 0
    while True:
        while seed < n and used[seed] == size[seed]:
            seed += 1
        if seed == n:
            break
        cut = _cut_last(used, size, out)
        room, offset = window, 0
        for d in _neighbours(seed if cut is None else cut, scores, used, size):
            take = min(room, int(size[d] - used[d]))
            at = int(used[d])
            out.append((doc_ids[d], base[d] + at, take, doc_tokens[d], sequence, offset,
                        ids[d][at:at + take].tobytes(), d))
            used[d] += take
            room, offset = room - take, offset + take
            if not room:
                break
        sequence += 1
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.table([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out))], names)


class _Index:
    """Postings of one shard by term. Postings of used documents are dropped
    whenever a third of those it holds is used."""

    def __init__(self, terms: np.ndarray, owner: np.ndarray, weight: np.ndarray, vocabulary: int, n: int):
        order = np.argsort(terms, kind="stable")
        self.vocabulary, self.n, self.live = vocabulary, n, n
        self._set(terms[order], owner[order], weight[order])

    def _set(self, terms: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> None:
        self.terms, self.owner, self.weight = terms, owner, weight
        self.size = np.bincount(terms, minlength=self.vocabulary)
        self.start = np.cumsum(self.size) - self.size

    def scores(self, query: np.ndarray, unused: np.ndarray) -> np.ndarray:
        left = int(unused.sum())
        if 3 * left < 2 * self.live:
            keep = unused[self.owner]
            self._set(self.terms[keep], self.owner[keep], self.weight[keep])
            self.live = left
        size = self.size[query]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[query] - ends + size, size)
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)


def _cut_last(used: np.ndarray, size: np.ndarray, out: list) -> int | None:
    """The rest that the last window cut, if ids of it are left."""
    if out and used[d := out[-1][7]] < size[d]:
        return d
    return None


def _neighbours(seed: int, scores, used: np.ndarray, size: np.ndarray) -> Iterator[int]:
    yield seed
    left = np.flatnonzero(used < size)
    left = left[left != seed]
    if len(left):
        yield from left[np.argsort(-scores(seed)[left], kind="stable")].tolist()


def padding(pieces: DataFrame, window: int = WINDOW) -> float:
    """Share of padded positions when every sequence is filled up to ``window``."""
    total, sequences = pieces.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    return 0.0 if not sequences else 1 - total / (sequences * window)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
