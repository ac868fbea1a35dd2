"""Token counts under a unigram model, by dynamic programming along a trie.

The distinct pre-tokens of a batch are walked in sorted order, which is a walk
of their trie: what a pre-token shares with the one before keeps its forward
scores, and only new characters are scored. Terminal counts are kept in a
bounded memo per worker. No shuffle: the plan is one map over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.bpe import worker_memo

START = "▁"  # marks the start of a pre-token in the vocabulary
MEMO = 1_000_000


def read_pieces(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece file with whole-numbered unigram scores: by
    Zipf's law the log probability of the piece of rank r is -log(r + 2) but for
    a constant; kept in millionths so that equal sums are equal."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size())
             if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -round(1e6 * math.log(r + 2)) for r, i in enumerate(plain)}


class TrieCounts:
    """Token counts of pre-tokens: the best segmentation has the largest score,
    then the fewest tokens. A character outside the vocabulary costs one token
    per UTF-8 byte."""

    def __init__(self, pieces: dict[str, int], most: int = MEMO):
        self.pieces, self.most = pieces, most
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = min(pieces.values(), default=0) - 10_000_000
        self.counts: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        new = sorted(w.decode("utf-8", "surrogateescape") for w in words if w not in self.counts)
        if len(self.counts) + len(new) > self.most:
            self.counts = {w: self.counts[w] for w in words if w in self.counts}
        path, forward = START, [(0, 0)]  # forward[j]: best (score, -tokens) of path[:j]
        forward.append(self._best(path, 1, forward))
        for word in new:
            text = START + word
            shared = 0
            for a, b in zip(path, text):
                if a != b:
                    break
                shared += 1
            del forward[shared + 1:]
            path = text
            for j in range(shared + 1, len(text) + 1):
                forward.append(self._best(text, j, forward))
            self.counts[word.encode("utf-8", "surrogateescape")] = -forward[len(text)][1]

    def _best(self, text: str, j: int, forward: list[tuple[int, int]]) -> tuple[int, int]:
        score, tokens = forward[j - 1]
        n = len(text[j - 1].encode("utf-8", "surrogateescape"))
        best = (score + n * self.byte_score, tokens - n)
        pieces = self.pieces
        for i in range(max(0, j - self.longest), j):
            own = pieces.get(text[i:j])
            if own is not None:
                at = forward[i]
                if (got := (at[0] + own, at[1] - 1)) > best:
                    best = got
        return best


def _load(path: str) -> TrieCounts:
    return TrieCounts(read_pieces(path))


def count_tokens(docs: DataFrame, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pretokens, n_tokens.

    Pre-tokens are the runs of ``[^\\x20\\x09-\\x0D]``; null and empty texts have
    none. Rows that repeat an id are counted each for itself; extra columns are
    not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_memo(_load, pieces)
        for b in batches:
            split = [t.split() for t in b.column(1).to_pylist()]
            trie.learn(set().union(*split))
            look = trie.counts.__getitem__
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(w) for w in split], pa.int64()),
                 pa.array([sum(map(look, w)) for w in split], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return rows.mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
