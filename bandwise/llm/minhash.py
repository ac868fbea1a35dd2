"""Near-duplicate detection by MinHash, banding and exact verification.

1. Each text gives its set of word shingles, reduced to a set identity (rows
   with equal sets form a class, represented by its smallest id), many universal
   hash minima, band keys and a signature of one byte per minimum.
2. In each bucket of a band every representative is paired with the bucket's
   smallest: a star, not all pairs. Pairs whose signatures agree enough are
   verified on the full sets of both texts.
3. Components of the links (large-star, small-star). Buckets that still hold
   more than one component are settled exactly: those members that are not in
   the smallest one's component are compared with every member of another
   component, block against block: by signature, then on the full sets.
4. Each row gets the smallest id of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm import scratch
from bandwise.llm.blocks import slices
from bandwise.llm.components import components
from bandwise.llm.hashing import Words, mix

BANDS, ROWS = 32, 5
SLICE = 2 << 20
BLOCK = 2048
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of the texts (A-Z lower-cased), text by text
    in rising order, and where each text's begin (one more entry than texts).
    A text of fewer than ``width`` words has its whole sequence as one shingle."""
    words = Words([t.translate(_LOWER) for t in texts])
    at = np.flatnonzero((words.left >= width) | ((words.position == 0) & (words.counts[words.doc] < width)))
    length = np.minimum(words.counts[words.doc[at]], width)
    hashes = mix(words.runs(at, length) + length.astype(np.uint64))
    doc = words.doc[at]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    if len(doc):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])
        hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def _minima(hashes: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """n universal hash minima (a * x + b modulo 2**64) of each non-empty set."""
    draw = np.random.default_rng(20240607)
    odd = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 1 << 63, n, dtype=np.uint64)
    out = np.empty((len(begin), n), np.uint64)
    room = np.empty_like(hashes)
    for k in range(n):
        np.multiply(hashes, odd[k], out=room)
        np.add(room, add[k], out=room)
        out[:, k] = np.minimum.reduceat(room, begin)
    return out


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set identity (s1, s2), band keys and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, SLICE):
                yield sketch(part)

    def sketch(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, begin = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), width)
        size = np.diff(begin)
        full = size > 0
        first = begin[:-1][full]
        s1, s2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        keys = np.zeros((len(size), bands), np.uint64)
        marks = np.zeros((len(size), bands * rows), np.uint8)
        if len(first):
            s1[full] = np.add.reduceat(mix(hashes + np.uint64(0x5851F42D4C957F2D)), first)
            s2[full] = np.add.reduceat(mix(hashes ^ np.uint64(0x14057B7EF767814F)), first)
            minima = _minima(hashes, first, bands * rows)
            marks[full] = ((minima >> np.uint64(16)) & np.uint64(255)).astype(np.uint8)
            key = np.zeros((len(first), bands), np.uint64)
            for r in range(rows):
                key = mix(key + minima[:, r::rows])
            keys[full] = key
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(size, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
             pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands),
                                      pa.array(keys.view(np.int64).reshape(-1))),
             pa.array([m.tobytes() for m in marks], pa.binary())],
            ["doc_id", "n_shingles", "s1", "s2", "bands", "signature"])

    return docs.mapInArrow(
        run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary")


def _least_agreement(similarity: float, n: int) -> int:
    """Equal signature bytes below which a pair of that similarity is six standard
    deviations off."""
    return int(np.floor(n * similarity - 6 * np.sqrt(n * similarity * (1 - similarity))))


def _agreeing(pairs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b, sig_a, sig_b) whose signatures agree enough: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            x, y = (np.frombuffer(b"".join(p.column(i).to_pylist()), np.uint8).reshape(p.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(p.columns[:2], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. A row of
    ``texts`` goes to the pairs it is in; nothing is grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in slices(batch, 2, SLICE // 2):
                left, at = shingle_sets(p.column(2).cast(pa.binary()).to_pylist(), width)
                right, bt = shingle_sets(p.column(3).cast(pa.binary()).to_pylist(), width)
                ok = []
                for i in range(p.num_rows):
                    ok.append(_similar(left[at[i]:at[i + 1]], right[bt[i]:bt[i + 1]], percent))
                yield pa.RecordBatch.from_arrays(p.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = (pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b"))
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _open_links(members: DataFrame, least: int, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members (band, key, rep, root, main, bands, signature,
    text) of one bucket that are in different components, one of them outside the
    bucket's main component. Members are dealt into blocks of about BLOCK; a group
    is one block of the outsiders against one block of all, and gives no more
    links than it has members. A pair is looked at in its first common band only."""
    sizes = scratch.cut(members.groupBy("band", "key").agg(
        F.ceil(F.count("*") / BLOCK).alias("all_blocks"),
        F.ceil(F.count(F.when(F.col("root") != F.col("main"), 1)) / BLOCK).alias("out_blocks")), "buckets")
    dealt = members.join(sizes, ["band", "key"]).withColumn("h", F.xxhash64("rep", "band"))
    columns = ("band", "key", "i", "j", "rep", "root", "bands", "signature", "text", "outside")
    every = (dealt.withColumn("j", F.pmod("h", F.col("all_blocks")).cast("long"))
             .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("out_blocks") - 1)))
             .withColumn("outside", F.lit(False)).select(*columns))
    outside = (dealt.where("root <> main").withColumn("i", F.pmod("h", F.col("out_blocks")).cast("long"))
               .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks") - 1)))
               .withColumn("outside", F.lit(True)).select(*columns))

    def run(t: pa.Table) -> pa.Table:
        out = t.column("outside").to_numpy()
        rep, root = t.column("rep").to_numpy(), t.column("root").to_numpy().copy()
        marks = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(rep), -1)
        keys = np.array(t.column("bands").to_pylist(), np.int64)
        band = t.column("band")[0].as_py()
        sets, begin = shingle_sets(t.column("text").cast(pa.binary()).to_pylist(), width)
        other, links = np.flatnonzero(~out), []
        for i in np.flatnonzero(out):
            near = other[(marks[other] == marks[i]).sum(axis=1) >= least]
            near = near[~(keys[near, :band] == keys[i, :band]).any(axis=1)]
            mine = sets[begin[i]:begin[i + 1]]
            for j in near.tolist():
                if root[j] != root[i] and _similar(mine, sets[begin[j]:begin[j + 1]], percent):
                    links.append((rep[i], rep[j]))
                    root[root == root[j]] = root[i]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return every.unionAll(outside).groupBy("band", "key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * intersection >= percent * union of their sets of
    distinct ``width``-word shingles; component_id is the smallest doc_id that can
    be reached. A null or empty text has no shingles and is linked with nothing.
    Rows that repeat an id are one node of the graph; a row with a null id takes
    no part (component_id null, kept). Extra columns are not read; an empty table
    gives no rows. A pair at the threshold shares no band with probability
    (1 - 0.8 ** rows) ** bands, 3e-6 here; nothing else is left to chance.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketch = scratch.cut(sketches(texts, width, bands, rows), "sketches")
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.cut(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    named = classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n_shingles").alias("cn"), "rep")
    same = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn"))
    reps = scratch.cut(
        full.join(named, same & (F.col("doc_id") == F.col("rep")), "left_semi")
        .select(F.col("doc_id").alias("rep"), "bands", "signature"), "representatives")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = scratch.cut(
        banded.groupBy("band", "key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1"),
        "buckets")
    # The members of buckets with more than one, the only ones to be compared.
    banded = scratch.cut(banded.join(buckets, ["band", "key"]), "members")
    least = _least_agreement(percent / 100, bands * rows)
    star = (banded.where("rep <> centre")
            .select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct())
    marked = reps.select("rep", "signature")
    shared = banded.select("rep").distinct()
    own = scratch.cut(texts.join(shared, F.col("doc_id") == F.col("rep"), "left_semi")
                      .select(F.col("doc_id").alias("rep"), "text"), "texts")
    star = (star.join(marked.select(F.col("rep").alias("b"), F.col("signature").alias("sig_b")), "b")
            .join(marked.select(F.col("rep").alias("a"), F.col("signature").alias("sig_a")), "a"))
    # An id that is repeated with other texts is one node: its classes are linked.
    cls = F.struct("s1", "s2", "n_shingles")
    several = full.groupBy("doc_id").agg(F.min(cls).alias("lo"), F.max(cls).alias("hi")).where("lo <> hi")
    repeated = full.join(several.select("doc_id"), "doc_id", "left_semi").join(named, same).select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    first = scratch.cut(_verified(scratch.cut(_agreeing(star, least), "pairs"), own, width, percent).union(repeated),
                        "links")
    roots = scratch.cut(components(first), "roots")
    labelled = (banded.where("n > 2")
                .join(roots, F.col("rep") == F.col("node"), "left")
                .withColumn("root", F.coalesce("root", "rep")))
    open_ = scratch.cut(
        labelled.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                            F.min(F.struct("rep", "root")).alias("c"))
        .where("lo <> hi").select("band", "key", F.col("c.root").alias("main")), "open")
    members = scratch.cut(labelled.select("band", "key", "rep", "root").join(open_, ["band", "key"]), "members")
    members = members.join(reps, "rep").join(own, "rep")
    more = _open_links(members, least, width, percent)
    roots = scratch.cut(components(first.union(more)), "roots")
    known = sketch.join(named, same & F.col("doc_id").isNotNull(), "left")
    out = known.join(roots, F.col("rep") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one id per
    component."""
    gone = near_duplicates(docs, width, percent, id_col, text_col).where("NOT kept").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("doc_id"), "left_anti").select("row.*")
