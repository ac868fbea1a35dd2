"""Removal of repeated passages by difference-cover anchors.

A difference cover of a period p is a set of residues whose differences give
every residue. Anchors are runs of ``window - p + 1`` words that start at a
position whose residue is in the cover: two equal windows, wherever they start,
share an anchor at the same distance from their starts. Anchors found once in
the corpus are dropped; the others are extended to whole windows, which are
compared by a 96-bit hash. Of the windows with one word sequence all but the
first are marked (smallest doc_id, then earliest start) and the words they cover
are removed. No pair of occurrences is ever formed.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm import blocks as bl
from bandwise.llm.hashing import Words

WINDOW = 20
# Perfect difference sets by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_ANCHOR, _ENTRY, _MARK = ["u8"], ["u8", "u4", "i8"], ["u8", "u4"]


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    period = max(p for p in COVERS if p == 1 or 3 * p <= 2 * window)
    return period, COVERS[period]


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors' word numbers and hashes (their lowest bit is left free)."""
    period, cover = cover_for(window)
    length = window - period + 1
    fits = np.isin(words.position % period, cover) & (words.left >= length) & (words.counts[words.doc] >= window)
    at = np.flatnonzero(fits)
    return at, words.runs(at, length) & ~np.uint64(1)


def _windows_at(words: Words, anchors: np.ndarray, window: int) -> np.ndarray:
    """Word numbers at which a window with one of these anchors starts."""
    period, _ = cover_for(window)
    hits = np.zeros(words.n + period + 1, np.int64)
    hits[anchors + 1] = 1
    total = np.cumsum(hits)
    return np.flatnonzero((words.left >= window) & (total[period:period + words.n] > total[:words.n]))


def _identity(words: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return words.runs(at, window, 0), (words.runs(at, window, 1) >> np.uint64(32)).astype(np.uint32)


def _later(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Entries whose hash an earlier entry has."""
    order = np.lexsort((h2, h1))
    again = np.concatenate([[False], (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])])
    out = np.zeros(len(h1), bool)
    out[order] = again
    return out


def _opened(table: pa.Table, id_at: int, text_at: int) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """The block's rows in order of id, their texts and ids (null: smallest)."""
    ids = table.column(id_at).fill_null(np.iinfo(np.int64).min).to_numpy()
    order = np.argsort(ids, kind="stable")
    table = table.take(pa.array(order))
    texts = [t or b"" for t in table.column(text_at).cast(pa.binary()).to_pylist()]
    return table, texts, ids[order]


def _first_question(block: int, table: pa.Table, id_at: int, text_at: int, window: int, shards: int) -> list[dict]:
    _, texts, _ = _opened(table, id_at, text_at)
    _, hashes = _anchors(Words(texts), window)
    found, times = np.unique(hashes, return_counts=True)
    return bl.by_shard(block, found, [found | (times > 1).astype(np.uint64)], shards)


def _first_answer(columns, row, blocks):
    """Anchors that are in two blocks, or twice in one."""
    key, twice = columns[0] & ~np.uint64(1), columns[0] & np.uint64(1)
    order = np.argsort(key, kind="stable")
    run = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) if len(key) else np.zeros(0, np.int64)
    shared = (np.bincount(run) > 1) | (np.bincount(run, weights=twice[order]) > 0) if len(key) else np.zeros(0, bool)
    back = np.zeros(len(key), bool)
    back[order] = shared[run]
    return back, [key]


def _second_question(block, table, right, id_at, text_at, window, shards) -> list[dict]:
    (shared,) = bl.replies(right, _ANCHOR)
    if not len(shared):
        return []
    _, texts, ids = _opened(table, id_at, text_at)
    words = Words(texts, 2)
    at, hashes = _anchors(words, window)
    start = _windows_at(words, at[np.isin(hashes, shared)], window)
    h1, h2 = _identity(words, start, window)
    first = ~_later(h1, h2)
    return bl.by_shard(block, h1[first], [h1[first], h2[first], ids[words.doc[start[first]]]], shards)


def _second_answer(columns, row, blocks):
    """Of equal windows those whose first occurrence lies in another block."""
    h1, h2, doc = columns
    order = np.lexsort((blocks[row], doc, h2, h1))
    again = np.concatenate([[False], (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])])[:len(h1)]
    back = np.zeros(len(h1), bool)
    back[order] = again
    return back, [h1, h2]


def _marked(words: Words, window: int, far1: np.ndarray, far2: np.ndarray) -> np.ndarray:
    """Per word: whether a window that also starts earlier covers it."""
    at, hashes = _anchors(words, window)
    _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
    here = _windows_at(words, at[times[back] > 1], window) if len(at) else np.zeros(0, np.int64)
    later = here[_later(*_identity(words, here, window))]
    if len(far1):
        order = np.lexsort((far2, far1))
        far1, far2 = far1[order], far2[order]
        start = np.flatnonzero(words.left >= window)
        h1 = words.runs(start, window, 0)
        place = np.searchsorted(far1, h1)
        hit = np.flatnonzero(far1[np.minimum(place, len(far1) - 1)] == h1)
        start, place = start[hit], place[hit]
        _, h2 = _identity(words, start, window)
        found = np.zeros(len(start), bool)
        while len(place) and (live := (place < len(far1)) & (far1[np.minimum(place, len(far1) - 1)] == h1[hit])).any():
            found |= live & (far2[np.minimum(place, len(far1) - 1)] == h2)
            place = place + 1
        later = np.concatenate([later, start[found]])
    step = np.zeros(words.n + 1, np.int64)
    later = np.unique(later)
    np.add.at(step, later, 1)
    np.add.at(step, later + window, -1)
    return np.cumsum(step[:-1]) > 0


def _layout(text: bytes, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> bytes:
    """The text without its removed words: each kept run of words with the white
    space inside it; what stood around removed words is one line feed."""
    edge = np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8))
    runs = zip(start[np.flatnonzero(edge == 1)].tolist(), end[np.flatnonzero(edge == -1) - 1].tolist())
    return b"\n".join(text[a:b] for a, b in runs)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    layout: bool = False) -> DataFrame:
    """The rows of ``docs`` with all their columns, but the text as it is kept,
    and two more columns in front: ``n_words`` and ``n_removed``.

    The kept text is the kept words joined by one space; with ``layout`` it is
    the text itself where nothing is removed, else its kept runs of words with
    their own white space, joined by line feeds. A null text has no words and is
    kept as empty (null with ``layout``). Texts of fewer than ``window`` words
    lose nothing. Rows that repeat an id are documents of their own, in the order
    of their blocks; a null id comes before all others. An empty table gives no
    rows.
    """
    names = docs.columns
    id_at, text_at = names.index(id_col), names.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.withColumn(f"c{id_at}", F.col(f"c{id_at}").cast("long"))
    blocks = bl.to_blocks(plain, text_at, "passages")
    period, cover = cover_for(window)
    shards = bl.shard_count(blocks, 6 * period / len(cover))
    asked = bl.ask(blocks, lambda block, table: _first_question(block, table, id_at, text_at, window, shards))
    shared = bl.answer(asked, _first_answer, _ANCHOR)
    windows = bl.bring(
        blocks, shared,
        lambda block, table, right: pa.Table.from_pylist(
            _second_question(block, table, right, id_at, text_at, window, shards), bl.ASK), bl.ASK_DDL)
    elsewhere = bl.answer(windows, _second_answer, _ENTRY)
    schema = plain.schema
    ddl = "n_words long, n_removed long, " + ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))

    def finish(block: int, table: pa.Table, right: pa.Table) -> pa.Table:
        table, texts, _ = _opened(table, id_at, text_at)
        words = Words(texts, 2)
        gone = _marked(words, window, *bl.replies(right, _MARK))
        removed = np.bincount(words.doc[gone], minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        kept = []
        for d, text in enumerate(texts):
            span = slice(words.first[d], words.first[d + 1])
            if layout:
                kept.append(_layout(text, words.start[span], words.end[span], ~gone[span]) if removed[d] else text)
            elif removed[d]:
                kept.append(b" ".join(compress(text.split(), (~gone[span]).tolist())))
            else:
                kept.append(b" ".join(text.split()))
        new = pa.array(kept, pa.binary()).cast(pa.string())
        if layout:
            new = pc.if_else(table.column(text_at).is_null().combine_chunks(), pa.scalar(None, pa.string()), new)
        table = table.set_column(text_at, table.schema.names[text_at], new)
        return pa.table([pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), *table.columns],
                        ["n_words", "n_removed", *[f"c{i}" for i in range(len(names))]])

    out = bl.bring(blocks, elsewhere, finish, ddl)
    return out.toDF("n_words", "n_removed", *names)


def digests(kept: DataFrame) -> DataFrame:
    """Needs the words joined by one space, from a table of doc_id and text."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
