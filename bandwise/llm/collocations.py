"""Phrase mining with counting quotient filters.

1. Documents are written as blocks. Each block sends its distinct words, with their
   counts, to the vocabulary; words of at least ``min_count`` occurrences get dense
   ids (over language and word together), since no phrase occurs more often than
   its words. Ids come back to the blocks by a join.
2. A block packs each run of two or three ids of one piece into 3 b bits, b being
   the bits of the largest id, and permutes it invertibly (an unbalanced Feistel
   network). The top bits of the result choose a shard, the next are the quotient,
   and all that is left is the remainder: nothing is lost, so counts are exact.
3. Each block sends each shard a filter: an occupied bit per quotient, an end bit
   per entry, remainders in whole bytes, and counters where a count exceeds one.
   Shards merge sorted filters. Where there are more than ``FAN`` shards, bundles of
   blocks are merged first, range by range, so that the number of messages grows
   with the input and not with blocks times shards.
4. Phrases at ``min_count`` or more are scored by exact decimals, joined with the
   counts of their parts, and cut to each language's best in two rounds.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm import blocks, scratch
from bandwise.llm.hashing import mix
from bandwise.operators.joins import bounded_broadcast

MIN_COUNT = 10
TOP = 2000
INSIDE = 50
BLOCK_BYTES = 8 << 20
SHARD_ENTRIES = 3_000_000
FAN = 2048
SALTS = 64
MAX_ID_BITS = 36

_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_KIND, _LOWER = _KIND.tobytes(), _LOWER.tobytes()


class Tokens:
    """The words of a table (text, lang): ``pair`` numbers each word's (language,
    word), ``same`` says whether the next word is in the same piece."""

    def __init__(self, table: pa.Table):
        text = pc.binary_join_element_wise(table.column("text").cast(pa.large_string()),
                                           pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        # mapped as bytes: numpy would turn every byte into an eight-byte index first
        kind = np.frombuffer(data.tobytes().translate(_KIND), np.uint8)
        inside = np.concatenate([[False], kind == 0, [False]])
        edge = np.diff(inside.view(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        letters = np.frombuffer(data[kind == 0].tobytes().translate(_LOWER), np.uint8)
        places = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        langs = table.column("lang").combine_chunks().dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        self.langs = langs.dictionary
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.searchsorted(offsets - offsets[0], start, side="right") - 1
        self.pair = lang[doc] * len(self.words) + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        self.same = piece[1:] == piece[:-1]

    def counts(self) -> pa.Table:
        """lang, word, n: each distinct pair."""
        pair, n = np.unique(self.pair, return_counts=True)
        lang, word = np.divmod(pair, max(1, len(self.words)))
        return pa.table({"lang": self.langs.take(pa.array(lang)).cast(pa.string()),
                         "word": self.words.take(pa.array(word)).cast(pa.binary()).cast(pa.string()),
                         "n": pa.array(n.astype(np.int64))})

    def ids(self, known: pa.Table) -> np.ndarray:
        """Each word's id from ``known`` (lang, word, id), 0 where there is none."""
        out = np.zeros(len(self.pair), np.int64)
        if not known.num_rows or not len(out):
            return out
        word = pc.index_in(known.column("word").cast(pa.string()).cast(pa.binary()).cast(pa.large_binary()), self.words)
        lang = pc.index_in(known.column("lang").cast(self.langs.type), self.langs)
        pair = (lang.to_numpy().astype(np.int64) * len(self.words) + word.to_numpy().astype(np.int64))
        order = np.argsort(pair)
        pair, number = pair[order], known.column("id").to_numpy()[order]
        at = np.minimum(np.searchsorted(pair, self.pair), len(pair) - 1)
        return np.where(pair[at] == self.pair, number[at], 0)


class Packing:
    """Three ids of ``bits`` bits as a permuted pair (left, right): the right part
    is a whole number of bytes, the left part has the rest."""

    def __init__(self, bits: int):
        if bits > MAX_ID_BITS:
            raise ValueError(f"word ids of more than {MAX_ID_BITS} bits")
        self.bits, self.whole = bits, 3 * bits
        self.right = self.whole // 2 // 8 * 8
        self.left = self.whole - self.right
        self._left, self._right = (np.uint64((1 << n) - 1) for n in (self.left, self.right))

    def _rounds(self, left: np.ndarray, right: np.ndarray, order) -> tuple[np.ndarray, np.ndarray]:
        for k in order:
            key = np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            if k % 2:
                left = left ^ (mix(right + key) & self._left)
            else:
                right = right ^ (mix(left + key) & self._right)
        return left, right

    def pack(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64(max(0, self.right - self.bits))  # bits of b that lie in the right part
        a, b, c = (x.astype(np.int64, copy=False).view(np.uint64) for x in (a, b, c))
        bits = np.uint64(self.bits)
        if self.right >= self.bits:
            left = (a << (bits - low)) | (b >> low)
            right = ((b & ((np.uint64(1) << low) - np.uint64(1))) << bits) | c
        else:  # c itself is cut
            cut = np.uint64(self.right)
            left = (((a << bits) | b) << (bits - cut)) | (c >> cut)
            right = c & self._right
        return self._rounds(left, right, range(4))

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        left, right = self._rounds(left, right, range(3, -1, -1))
        bits, one = np.uint64(self.bits), np.uint64(1)
        mask = (one << bits) - one
        if self.right >= self.bits:
            low = np.uint64(self.right - self.bits)
            c = right & mask
            b = ((left << low) | (right >> bits)) & mask
            a = left >> (bits - low)
        else:
            cut = np.uint64(self.right)
            c = ((left << cut) | right) & mask
            left = left >> (bits - cut)
            a, b = left >> bits, left & mask
        return [x.astype(np.int64) for x in (a, b, c)]


def counted(left: np.ndarray, right: np.ndarray, n: np.ndarray | None, packing: Packing):
    """Sorted distinct entries with the sums of their counts (one each, if None)."""
    if packing.whole <= 64:
        key = left << np.uint64(packing.right)
        key |= right
        if n is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")  # merges the sorted filters
            key, n = key[order], n[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        key_first = key[first]
        left, right = key_first >> np.uint64(packing.right), key_first & packing._right
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        n = None if n is None else n[order]
        first = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]) if len(left) else np.zeros(0, bool)
        left, right = left[first], right[first]
    at = np.flatnonzero(first)
    if n is None:
        return left, right, np.diff(np.append(at, len(first)))
    return left, right, np.add.reduceat(n, at) if len(at) else n[:0]


def _planes(lane: np.ndarray, k: int) -> bytes:
    return np.ascontiguousarray(lane.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()


def _lane(data: bytes, at: int, n: int, k: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = np.frombuffer(data, np.uint8, n * k, at).reshape(k, n).T
    return out.reshape(-1).view("<u8")


def encode(left: np.ndarray, right: np.ndarray, n: np.ndarray, packing: Packing, shard_bits: int) -> bytes:
    """A counting quotient filter of sorted distinct entries whose top
    ``shard_bits`` bits agree."""
    rest = packing.left - shard_bits
    # as many quotient bits as there are entries to spread, whole bytes being left
    q = max(range(rest % 8, min(rest, len(left).bit_length() + 2) + 1, 8), default=rest % 8)
    low = np.uint64(rest - q)
    quotient = (left >> low) & np.uint64((1 << q) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient.astype(np.int64)] = True
    ends = np.concatenate([quotient[1:] != quotient[:-1], [True]])
    many = n > 1
    extra = n[many] - 2
    long = extra >= 255
    return b"".join([
        struct.pack("<QB", len(left), q), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
        _planes(left & ((np.uint64(1) << low) - np.uint64(1)), (rest - q) // 8), _planes(right, packing.right // 8),
        np.packbits(many).tobytes(), np.minimum(extra, 255).astype(np.uint8).tobytes(), extra[long].astype("<i8").tobytes()])


def decode(data: bytes, shard: int, packing: Packing, shard_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted entries of a filter and their counts."""
    n, q = struct.unpack_from("<QB", data)
    rest, at = packing.left - shard_bits, 9

    def bits(count: int) -> np.ndarray:
        nonlocal at
        size = -(-count // 8)
        out = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count).astype(bool)
        at += size
        return out

    occupied, ends = np.flatnonzero(bits(1 << q)), bits(n)
    run = np.cumsum(ends) - ends
    k = (rest - q) // 8
    low, at = _lane(data, at, n, k), at + n * k
    right, at = _lane(data, at, n, packing.right // 8), at + n * (packing.right // 8)
    left = (np.uint64(shard) << np.uint64(rest)) | (occupied[run].astype(np.uint64) << np.uint64(rest - q)) | low
    many = bits(n)
    extra = np.frombuffer(data, np.uint8, int(many.sum()), at).astype(np.int64)
    extra[extra == 255] = np.frombuffer(data, "<i8", -1, at + len(extra))
    counts = np.ones(n, np.int64)
    counts[many] += extra + 1
    return left, right, counts


_SENT = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
_SENT_DDL = "shard long, block long, data binary"


def _send(block: int, entries, packing: Packing, shard_bits: int) -> pa.Table:
    """One filter per shard that has entries."""
    left, right, n = entries
    shard = (left >> np.uint64(packing.left - shard_bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    return pa.Table.from_pylist(
        [{"shard": int(shard[a]), "block": block, "data": encode(left[a:b], right[a:b], n[a:b], packing, shard_bits)}
         for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b > a], _SENT)


def _merged(table: pa.Table, packing: Packing, shard_bits: int):
    parts = [decode(d.as_py(), s, packing, shard_bits)
             for s, d in zip(table.column("shard").to_pylist(), table.column("data"))]
    columns = [np.concatenate(p) for p in zip(*parts)]
    del parts  # as large as the columns
    return counted(*columns, packing)


def _vocabulary(asked: DataFrame, min_count: int) -> DataFrame:
    """lang, word, f, id: dense ids from 1 on."""
    known = asked.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    known = scratch.cut(known.select(
        "lang", "word", "f", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "words")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    first = known.groupBy("part").agg(F.count("*").alias("size")).select(
        "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return known.join(F.broadcast(first), "part").select(
        "lang", "word", "f", (F.col("first") + F.col("place") + 1).alias("id"))


def _small(df: DataFrame) -> DataFrame:
    return bounded_broadcast(df, max_rows=500_000, max_bytes=48 << 20)[0]


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                  block_bytes: int = BLOCK_BYTES, shard_entries: int = SHARD_ENTRIES, fan: int = FAN):
    """(words, phrases, totals), all written: lang, word, f, id of the words, a, b,
    c, f of the phrases (c is 0 for two words) that occur ``min_count`` times or
    more, and lang, n of all words."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    held = blocks.to_blocks(rows, 0, "phrase-blocks", block_bytes)

    def ask(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Tokens(blocks.unpack(payload.as_buffer())).counts()
                found = found.append_column("block", pa.array(np.full(found.num_rows, block, np.int64)))
                yield from found.to_batches(max_chunksize=1 << 16)

    asked = scratch.cut(held.select("block", "payload").mapInArrow(
        ask, "lang string, word string, n long, block long"), "block-words")
    words = scratch.cut(_vocabulary(asked, min_count), "vocabulary")
    totals = scratch.cut(asked.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    top, tokens = words.agg(F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.sum("f"), F.lit(0))).first()
    packing = Packing(max(3, int(top).bit_length()))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(2 * parts, 2 * tokens // shard_entries)
    shard_bits = min((shards - 1).bit_length(), packing.left)

    def make(block: int, docs_of: pa.Table, known: pa.Table) -> pa.Table:
        tokens = Tokens(docs_of)
        ids, same = tokens.ids(known), tokens.same
        del tokens, known
        two = same & (ids[:-1] > 0) & (ids[1:] > 0)
        three = two[:-1] & two[1:]
        runs = [packing.pack(ids[:-1][two], ids[1:][two], np.zeros(int(two.sum()), np.int64)),
                packing.pack(ids[:-2][three], ids[1:-1][three], ids[2:][three])]
        left, right = (np.concatenate(x) for x in zip(*runs))
        del runs
        return _send(block, counted(left, right, None, packing), packing, level)

    n_blocks = held.count()
    step = fan.bit_length() - 1
    level = shard_bits if shard_bits <= step else step
    answers = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "lang", "word", "id")
    sent = blocks.bring(held, answers, make, _SENT_DDL)
    bundles = n_blocks
    while level < shard_bits:  # merge bundles of blocks inside each range, then cut the ranges
        bundles = -(-bundles // fan)
        sent, level = _finer(sent, packing, level, min(level + step, shard_bits), bundles)

    def merge(table: pa.Table) -> pa.Table:
        left, right, n = _merged(table, packing, shard_bits)
        often = n >= min_count
        a, b, c = packing.unpack(left[often], right[often])
        return pa.table({"a": a, "b": b, "c": c, "f": n[often]})

    phrases = sent.groupBy("shard").applyInArrow(merge, "a long, b long, c long, f long")
    return words, scratch.cut(phrases, "phrases"), totals


def _finer(sent: DataFrame, packing: Packing, level: int, finer: int, bundles: int) -> tuple[DataFrame, int]:
    def split(table: pa.Table) -> pa.Table:
        bundle = table.column("bundle")[0].as_py()
        return _send(bundle, _merged(table, packing, level), packing, finer)

    bundle = F.pmod(F.xxhash64("block"), F.lit(bundles))
    return sent.withColumn("bundle", bundle).groupBy("shard", "bundle").applyInArrow(split, _SENT_DDL), finer


def _score(f: Column, left: Column, right: Column) -> Column:
    """floor(1000000 f f / (left right)), exactly for counts below 10**16."""
    whole = F.lit(1_000_000).cast("decimal(7,0)") * (f.cast("decimal(16,0)") * f.cast("decimal(16,0)")).cast("decimal(31,0)")
    parts = (left.cast("decimal(16,0)") * right.cast("decimal(16,0)")).cast("decimal(38,0)")
    return F.floor(F.call_function("div", whole, parts)).cast("long")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
         inside: int = INSIDE, **sizes) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Phrases are two or three words of one piece that occur ``min_count`` times or
    more. Of a phrase's cuts into two the lowest score floor(10**6 a a / (l r))
    counts, of equal ones the first. A phrase inside a longer one with at least
    ``inside`` percent of its occurrences is left out. Order: score, then a, both
    descending, then the phrase's bytes.

    A null text has no words, a null language is ``und``. Repeated rows count each
    time. An empty table gives no rows; extra columns are not read.
    """
    words, phrases, totals = count_phrases(docs, text_col, lang_col, min_count, **sizes)
    pairs = phrases.where("c = 0").select("a", "b", "f")
    triples = phrases.where("c > 0")
    longer = (triples.select("a", "b", "f").unionAll(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f"))
              .groupBy("a", "b").agg(F.max("f").alias("most")))
    word = [_small(words.select(F.col("id").alias(k), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *extra))
            for k, extra in (("a", ["lang"]), ("b", []), ("c", []))]
    two = (pairs.join(longer, ["a", "b"], "left").where("most IS NULL OR 100 * most < {} * f".format(int(inside)))
           .join(word[0], "a").join(word[1], "b")
           .select("lang", F.concat_ws(" ", "wa", "wb").alias("phrase"), "f", F.col("fa").alias("l"), F.col("fb").alias("r"),
                   _score(F.col("f"), F.col("fa"), F.col("fb")).alias("score")))
    three = (triples.join(pairs.withColumnRenamed("f", "fab"), ["a", "b"])
             .join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("fbc")), ["b", "c"])
             .join(word[0], "a").join(word[1], "b").join(word[2], "c")
             .withColumn("s1", _score(F.col("f"), F.col("fa"), F.col("fbc")))
             .withColumn("s2", _score(F.col("f"), F.col("fab"), F.col("fc"))))
    late = F.col("s2") < F.col("s1")
    three = three.select(
        "lang", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), "f",
        F.when(late, F.col("fab")).otherwise(F.col("fa")).alias("l"),
        F.when(late, F.col("fc")).otherwise(F.col("fbc")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    salted = two.unionAll(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(_small(totals), "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
