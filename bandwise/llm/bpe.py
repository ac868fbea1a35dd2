"""Byte-level BPE encoding and decoding.

``encode_documents`` cuts long texts into overlapping chunks, pre-tokenises the
chunks in parallel, stitches neighbours at a pre-token boundary that both of
them found (from there on they agree, because a match depends only on what
follows it), and encodes each piece. Decoding joins the tokens' raw bytes.

Pre-tokens repeat, so texts are encoded a few megabytes at a time by their distinct
stretches (each a whole number of pre-tokens, found by its bytes): only these are
looked up, in a bounded memo, or encoded, and the ids are gathered by position.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.blocks import slices

CHUNK = 8192
OVERLAP = 512
MEMO = 200_000
SLICE = 8 << 20
# Letters in every version of Unicode that the libraries may use.
_WORD = ("\\A ?[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{17f}\\x{391}-\\x{3a1}\\x{3a3}-\\x{3a9}\\x{3b1}-\\x{3c9}"
         "\\x{410}-\\x{44f}\\x{4e00}-\\x{9fa5}]+\\z")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?"]] = True
# All that any of the libraries takes for white space but spaces and line feeds, a
# gap of two of these, or one at an end.
_ODD = ("[\\x00\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}"
        "\\x{205f}\\x{3000}]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z")

# The pre-tokens of byte-level BPE files, and the bytes that stand
# for themselves in their vocabulary (the others follow from code point 256 on).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Memo(dict):
    """ids (little-endian uint32 bytes) of a stretch of text. Holds two
    generations of at most ``most`` stretches each; what the older one has and
    nobody asks for again is forgotten."""

    def __init__(self, encode: Callable[[str], bytes], most: int = MEMO, single: Callable[[bytes], list[int]] | None = None):
        """``single`` encodes the bytes of one pre-token, if that can be had."""
        super().__init__()
        self.encode, self.most, self.single, self.older = encode, most, single, {}

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        got = self.older.get(text)
        if got is None:
            got = self.encode(text)
        self[text] = got
        return got


def encode_texts(texts: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (none null), one after another, and where each text's
    begin (one more entry than texts).

    Where all white space of a text is single spaces and single line feeds between
    words, each word with the space before it, and each line feed, is a whole number
    of pre-tokens, and so is a stop behind a letter; other texts go the plain way."""
    texts = texts.cast(pa.large_string())
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    plain = texts.filter(pa.array(~odd))
    out = [b""] * len(texts)
    for i in np.flatnonzero(odd).tolist():
        out[i] = memo.encode(texts[i].as_py())
    flat, size = _encode_plain(plain, memo)
    n = np.zeros(len(texts), np.int64)
    n[odd] = [len(out[i]) // 4 for i in np.flatnonzero(odd).tolist()]
    n[~odd] = size
    first = np.concatenate([[0], np.cumsum(n)])
    if not odd.any():
        return flat, first
    ids = np.empty(first[-1], "<u4")
    ids[np.repeat(~odd, n)] = flat
    ids[np.repeat(odd, n)] = np.frombuffer(b"".join(out), "<u4")
    return ids, first


def _encode_plain(texts: pa.LargeStringArray, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts of single gaps, one after another, and each text's number."""
    if not len(texts):
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begin[0]:begin[-1]]
    begin = begin - begin[0]
    starts = np.zeros(len(data) + 1, bool)
    starts[:-1] = (data == 32) | (data == 10)
    starts[1:] |= data == 10
    # a letter and a stop behind it are never in one pre-token
    stops = np.flatnonzero(_STOP[data[2:]]) + 2
    before = data[stops - 1]
    starts[stops[_LETTER[before] | ((data[stops - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))]] = True
    starts[begin] = True
    starts = np.flatnonzero(starts)  # the last one is the end of the data
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    table, size = _encode_distinct(coded.dictionary, memo)
    at = np.cumsum(size) - size
    code = coded.indices.to_numpy(zero_copy_only=False)
    n = size[code]
    total = np.concatenate([[0], np.cumsum(n)])
    ids = table[np.repeat(at[code] - total[:-1], n) + np.arange(total[-1])]
    return ids, np.diff(total[np.searchsorted(starts, begin)])


def _encode_distinct(pieces: pa.LargeStringArray, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces, one after another, and each piece's number."""
    if memo.single:
        word = pc.match_substring_regex(pieces, _WORD).to_numpy(zero_copy_only=False)
    else:
        word = np.zeros(len(pieces), bool)
    lists = list(map(memo.single, pieces.filter(pa.array(word)).cast(pa.large_binary()).to_pylist()))
    known = list(map(memo.__getitem__, pieces.filter(pa.array(~word)).to_pylist()))
    size = np.zeros(len(pieces), np.int64)
    size[word] = np.fromiter(map(len, lists), np.int64, len(lists))
    size[~word] = np.fromiter(map(len, known), np.int64, len(known)) // 4
    table = np.empty(size.sum(), "<u4")
    mine = np.repeat(word, size)
    table[mine] = np.fromiter(chain.from_iterable(lists), np.uint32, int(mine.sum()))
    table[~mine] = np.frombuffer(b"".join(known), "<u4")
    return table, size


def encoded(batch: pa.RecordBatch, text: int, memo: Memo, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the ids of their texts (column number ``text``) and
    where each text's begin."""
    for part in slices(batch, text, most):
        yield part, *encode_texts(part.column(text), memo)


def _uint32(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def rank_memo(path: str, pattern: str) -> tuple[Memo, list[bytes]]:
    """A memo that encodes by a rank file, and the bytes of each id."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(i) for t, i in (x.split() for x in lines if x.strip())}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    find = regex.compile(pattern).fullmatch

    def encode(text: str) -> bytes:
        word = text[1:] if text[:1] == " " else text
        if word.isalpha() and find(text):  # one pre-token
            return _uint32(enc._encode_single_piece(text))
        return _uint32(enc.encode_ordinary(text))

    return Memo(encode, single=enc._core_bpe.encode_single_piece), table


def tokenizer_memo(path: str) -> Memo:
    """A memo that encodes by a tokenizers file; special tokens' strings in a
    text are ordinary text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True

    def encode(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    parts = json.loads(tok.to_str())
    before = parts["pre_tokenizer"] or {}
    if parts["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return Memo(encode)
    # The library's model alone, without its bookkeeping of offsets.
    find, tokenize = regex.compile(BYTE_LEVEL).findall, tok.model.tokenize
    by_rank = _rank_merger(parts["model"], tokenize)
    others = (b for b in range(256) if b not in set(PLAIN_BYTES))
    letters = str.maketrans({b: 256 + i for i, b in enumerate(others)})

    space = " ".translate(letters)

    def encode_parts(text: str) -> bytes:
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            if by_rank:
                return _uint32(by_rank(text.encode()))
            if word.isascii():  # letters stand for themselves
                return _uint32([t.id for t in tokenize(space + word if word is not text else word)])
            pieces = (text,)
        elif word[-1:] in ".,;:!?" and word[:-1].isalpha():
            return memo[text[:-1]] + memo[text[-1]]
        else:
            pieces = find(text)
        if by_rank:
            return _uint32([i for p in pieces for i in by_rank(p.encode())])
        return _uint32([t.id for p in pieces for t in tokenize(p.encode().decode("latin-1").translate(letters))])

    memo = Memo(encode_parts, single=by_rank)
    return memo


def _rank_merger(model: dict, tokenize: Callable) -> Callable[[bytes], list[int]] | None:
    """Merging by the ids of the merged tokens instead of by the list of merges, or
    None where that could differ. It is the same if ids rise with the merges and the
    model gives every token's own text as that token: when the lowest remaining pair
    spells a token, no lower merge is left inside it, so the pair is the listed one."""
    import tiktoken

    others = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    back = {**{chr(b): b for b in PLAIN_BYTES}, **{chr(256 + i): b for i, b in enumerate(others)}}
    vocabulary, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if model.get("dropout") or model.get("ignore_merges") or any(
            model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None
    made = [vocabulary.get(a + b) for a, b in merges]
    plain = {t: i for t, i in vocabulary.items() if len(t) == 1 and t in back}
    if None in made or made != sorted(made) or len(plain) != 256 or made and max(plain.values()) >= made[0]:
        return None
    tokens = {**plain, **{a + b: i for (a, b), i in zip(merges, made)}}
    if any([x.id for x in tokenize(t)] != [i] for t, i in tokens.items()):
        return None
    ranks = {bytes(back[c] for c in t): i for t, i in tokens.items()}
    return tiktoken.Encoding("merges", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


_MEMOS: dict[tuple, object] = {}


def worker_memo(kind: Callable, *args):
    """One memo per Python worker, kept between batches and tasks."""
    if (kind, args) not in _MEMOS:
        _MEMOS[kind, args] = kind(*args)
    return _MEMOS[kind, args]


def encode_text(text: str, memo: Memo) -> bytes:
    """The ids of one text as bytes."""
    return encode_texts(pa.array([text]), memo)[0].tobytes()


def decode_ids(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary, little-endian uint32),
    n_tokens, decoded (binary).

    A null text counts as empty and has no ids. Rows that repeat an id are
    encoded each for itself. Extra columns are not read; an empty table gives no
    rows. Chunks whose overlap holds no common boundary (one pre-token longer
    than ``overlap``) are joined before they are cut.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = "doc_id long, ids binary, n_tokens long, decoded binary"
    size = F.char_length("text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table = worker_memo(rank_memo, ranks, pattern)
        for b in batches:
            for part, ids, first in encoded(b, 1, memo):
                raw, at = ids.tobytes(), (4 * first).tolist()
                yield _encoded(part.column(0), [raw[x:y] for x, y in zip(at[:-1], at[1:])], table)

    whole = rows.where(size <= chunk).mapInArrow(short, out)
    long = rows.where(size > chunk).withColumn("row", F.monotonically_increasing_id())

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, text, row in zip(f.doc_id, f.text, f.row):
                for at in range(0, len(text), chunk):
                    yield pd.DataFrame({"row": [row], "doc_id": [doc], "at": [at],
                                        "text": [text[at:at + chunk + overlap]], "last": [at + chunk >= len(text)]})

    chunks = long.mapInPandas(cut, "row long, doc_id long, at long, text string, last boolean")

    # Boundaries travel as the distances between them, which compress well.
    lengths = "<u2" if chunk + overlap < 1 << 16 else "<u4"

    def pretokenise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = regex.compile(pattern)
        for f in frames:
            ends = [np.array([m.end() for m in find.finditer(t)], "<i4") for t in f.text]
            # The last match of a chunk that goes on may be cut off; a white
            # space run at its end may be shared out otherwise.
            f["ends"] = [np.diff(e if last else e[e < len(t) - 1][:-1], prepend=np.int32(0)).astype(lengths).tobytes()
                         for e, t, last in zip(ends, f.text, f["last"])]
            yield f

    marked = chunks.repartition("row", "at").mapInPandas(
        pretokenise, "row long, doc_id long, at long, text string, last boolean, ends binary")

    def stitch(key, f: pd.DataFrame) -> pd.DataFrame:
        memo, table = worker_memo(rank_memo, ranks, pattern)
        f["ends"] = [np.cumsum(np.frombuffer(e, lengths), dtype="<i4").tobytes() for e in f.ends]
        tokens = stitched(f.sort_values("at"), chunk, overlap, pattern)
        ids = b"".join(map(memo.__getitem__, tokens))
        return _encoded(pa.array([f.doc_id.iloc[0]], pa.int64(), from_pandas=True), [ids], table).to_pandas()

    return whole.unionAll(marked.groupBy("row").applyInPandas(stitch, out))


def stitched(f: pd.DataFrame, chunk: int, overlap: int, pattern: str) -> Iterator[str]:
    """The pre-tokens of one document from its chunks (columns at, text, last,
    ends), in order."""
    find = None
    at, text, ends, start = None, "", np.zeros(0, "<i4"), 0
    for nxt_at, nxt, nxt_ends in zip(f["at"], f["text"], f["ends"]):
        theirs = np.frombuffer(nxt_ends, "<i4")
        if at is None:
            at, text, ends = int(nxt_at), nxt, theirs
            continue
        shift = int(nxt_at) - at
        common = np.intersect1d(ends[ends > shift] - shift, theirs)
        common = common[common + shift >= start]
        if len(common):
            meet = int(common[0])
            for e in ends[(ends > start) & (ends <= meet + shift)].tolist():
                yield text[start:e]
                start = e
            at, text, ends, start = int(nxt_at), nxt, theirs, meet
        else:  # no boundary in common: go on from the last sure one in one piece
            text = text[:shift] + nxt
            find = find or regex.compile(pattern)
            again = np.array([m.end() for m in find.finditer(text, start)], "<i4")
            ends = again if bool(f["last"].iloc[-1]) and nxt_at == f["at"].iloc[-1] else again[again < len(text) - 1][:-1]
    for e in ends[ends > start].tolist():
        yield text[start:e]
        start = e


def _encoded(doc_ids, ids: list[bytes], table: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
         pa.array([decode_ids(x, table) for x in ids], pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
