"""Line deduplication by a log-template tree.

Each line is parsed at a fixed depth: its number of tokens and its leading
tokens lead to a leaf. Tokens with a digit count as variable from the start. In
a leaf, lines that agree in enough positions share a template whose other
positions become variable fields. Templates that occur in many documents are
dropped, line by line, from every document.

Only hashes travel for lines that are alone in their leaf. A leaf with very many
different lines is parsed in rounds: sorted by its tokens from one position on,
it is cut into runs, and what the runs leave, templates and lone lines, goes on
to the next round, which sorts from the next position on. Lines that agree from
some position on lie together in that round. A leaf that has become small enough
is finished in one run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm import blocks as bl
from bandwise.llm import scratch

DEPTH = 3
SIMILAR = 0.6
MIN_DOCS = 10
RUN = 4096
VARIABLE = "<*>"
_DIGIT = re.compile(r"\d")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def masked(line: str) -> str:
    """The line's tokens, one space between them, those with a digit variable."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
    return " ".join(tokens)


def leaf_of(tokens: list[str], depth: int) -> int:
    return _hash(f"{len(tokens)} {' '.join(tokens[:depth])}")


def _constant(tokens: list[str]) -> bool:
    return any(t != VARIABLE for t in tokens)


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def cluster(lines: list[str], similar: float) -> dict[str, str]:
    """Line to template, for those lines of one leaf that share a template with
    another line. Lines are taken in sorted order; each goes to the template it
    agrees with in most positions (the oldest of equals), if in enough."""
    rows = [line.split(" ") for line in sorted(set(lines))]
    width = len(rows[0])
    codes: dict[str, int] = {VARIABLE: -1}
    table = np.array([[codes.setdefault(t, len(codes)) for t in r] for r in rows], np.int64).reshape(len(rows), width)
    templates = np.empty((0, width), np.int64)
    member = np.zeros(len(rows), np.int64)
    for i, row in enumerate(table):
        agree = ((templates == row) & (templates >= 0)).sum(axis=1) if len(templates) else np.zeros(0)
        if len(agree) and agree.max() >= similar * width:
            member[i] = at = int(np.argmax(agree))
            templates[at] = np.where(templates[at] == row, row, -1)
        else:
            member[i] = len(templates)
            templates = np.concatenate([templates, row[None]])
    times = np.bincount(member, minlength=len(templates))
    out = {}
    for r, m in zip(rows, member.tolist()):
        if times[m] > 1:
            out[" ".join(r)] = " ".join(t if c >= 0 else VARIABLE for t, c in zip(r, templates[m].tolist()))
    return out


_FOUND = "line long, template long, text string"


def _found(pairs: list[tuple[str, str]]) -> pa.Table:
    """line, template (their hashes), text (the template's); a template without a
    constant token is none."""
    pairs = [(line, t) for line, t in pairs if _constant(t.split(" "))]
    return pa.table([pa.array([_hash(line) for line, _ in pairs], pa.int64()),
                     pa.array([_hash(t) for _, t in pairs], pa.int64()),
                     pa.array([t for _, t in pairs], pa.string())], ["line", "template", "text"])


def _rounds(items: DataFrame, whole, depth: int, similar: float, run: int, shards: int) -> DataFrame:
    """line, template of the lines that share one, for leaves of more than ``run``
    lines; ``items`` has the columns leaf and line. In round i a leaf is sorted by
    its tokens from the i-th after the leading ones on; there are as many rounds as
    it has such tokens, or fewer if it gets small. ``whole`` does the rest."""

    def generalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            yield from _found(list(cluster(held, similar).items())).to_batches()

        for b in batches:
            for leaf, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (leaf != of or len(held) >= run):
                    yield from flush()
                    held = []
                of = leaf
                held.append(line)
        if held:
            yield from flush()

    def onward(state: DataFrame, step: DataFrame) -> DataFrame:
        step = step.select(F.col("line").alias("at"), F.col("template").alias("to"))
        return state.join(step, "at", "left").select("line", F.coalesce("to", "at").alias("at"))

    items = _hashed(items)
    state, first = scratch.cut(items.select(F.col("at").alias("line"), "at"), "state"), 0
    while True:
        sizes = items.groupBy("leaf").agg(F.count("*").alias("n"), F.first(F.size(F.split("line", " "))).alias("width"))
        large = scratch.cut(sizes.where((F.col("n") > run) & (F.col("width") - depth > first)), "large")
        if not large.count():
            break
        tokens, at = F.split("line", " "), depth + first
        turned = F.concat_ws(" ", F.slice(tokens, at + 1, F.size(tokens)), F.slice(tokens, 1, at))
        mine = items.join(large.select("leaf"), "leaf", "left_semi")
        step = scratch.cut(mine.select("leaf", "line", turned.alias("turned"))
                           .repartitionByRange(shards, "leaf", "turned").sortWithinPartitions("leaf", "turned")
                           .select("leaf", "line").mapInArrow(generalise, _FOUND), "step")
        state = scratch.cut(onward(state, step), "state")
        names = step.select(F.col("line").alias("at"), "template", "text")
        items = scratch.cut(items.join(names, "at", "left").select(
            "leaf", F.coalesce("template", "at").alias("at"), F.coalesce("text", "line").alias("line")).distinct(), "items")
        first += 1
    small = sizes.where(F.col("n") <= run).select("leaf")
    last = scratch.cut(whole(items.join(small, "leaf", "left_semi").select("leaf", "line")), "step")
    state = onward(state, last)
    return state.where("line <> at").select("line", F.col("at").alias("template"))


def _hashed(items: DataFrame) -> DataFrame:
    """``items`` with the hash of each line as ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([_hash(x) for x in b.column(1).to_pylist()], pa.int64()), b.column(1)],
                ["leaf", "at", "line"])

    return scratch.cut(items.select("leaf", "line").mapInArrow(run, "leaf long, at long, line string"), "items")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                         depth: int = DEPTH, similar: float = SIMILAR, run: int = RUN) -> DataFrame:
    """The rows of ``docs`` with all their columns, the text without the lines
    whose template occurs in ``min_docs`` rows or more, and in front ``n_lines``
    and ``n_dropped``.

    Lines end at line feeds. Blank lines, and lines without a constant token, have
    no template and stay. Null and empty texts have one empty line and become
    empty. Each row counts as a document, repeated rows too. An empty table gives
    no rows.
    """
    names = docs.columns
    text_at = names.index(text_col)
    inner = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*inner)
    blocks = bl.to_blocks(plain, text_at, "lines")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1)):
                out = []
                for d, text in enumerate(bl.unpack(payload.as_buffer()).column(text_at).to_pylist()):
                    for line in {masked(x) for x in _lines(text)}:
                        tokens = line.split(" ")
                        if line and _constant(tokens):
                            out.append((block, d, _hash(line), leaf_of(tokens, depth)))
                columns = zip(*out) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["block", "doc", "line", "leaf"])

    lines = scratch.cut(blocks.select("block", "payload").mapInArrow(parse, "block long, doc long, line long, leaf long"),
                        "parsed")
    leaves = scratch.cut(lines.select("leaf", "line").distinct().groupBy("leaf").agg(F.count("*").alias("n"))
                         .where("n > 1"), "leaves")
    wanted = lines.join(leaves, "leaf").select("block", "line", "leaf", (F.col("n") > run).alias("hot")).distinct()

    def texts(block: int, table: pa.Table, right: pa.Table) -> pa.Table:
        want = {x: (leaf, hot) for x, leaf, hot in
                zip(*(right.column(c).to_pylist() for c in ("line", "leaf", "hot")))}
        out = []
        for line in {masked(x) for t in table.column(text_at).to_pylist() for x in _lines(t)} if want else ():
            if (h := _hash(line)) in want:
                leaf, hot = want[h]
                out.append((leaf, hot, line))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()),
                         pa.array(columns[2], pa.string())], ["leaf", "hot", "line"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    shards = max(parts, -(-total // (4 * run)))

    def generalise(table: pa.Table) -> pa.Table:
        groups: dict[int, list[str]] = {}
        for leaf, line in zip(*(table.column(c).to_pylist() for c in ("leaf", "line"))):
            groups.setdefault(leaf, []).append(line)
        return _found([x for group in groups.values() for x in cluster(group, similar).items()])

    def whole(items: DataFrame) -> DataFrame:
        """line, template, text of the leaves, each in one run."""
        return (items.withColumn("shard", F.pmod(F.xxhash64("leaf"), F.lit(shards)))
                .groupBy("shard").applyInArrow(generalise, _FOUND))

    texts_of = bl.bring(blocks, wanted, texts, "leaf long, hot boolean, line string")
    if most > run:
        texts_of = scratch.cut(texts_of, "texts")
    found = whole(texts_of.where("NOT hot")).select("line", "template")
    if most > run:
        found = found.unionAll(_rounds(texts_of.where("hot").select("leaf", "line").distinct(), whole, depth, similar, run, shards))
    templates = scratch.cut(found, "templates")
    known = scratch.cut(lines.select("block", "doc", "line").join(templates, "line", "left").select(
        "block", "doc", "line", F.coalesce("template", "line").alias("template")), "known")
    recurring = scratch.cut(known.select("block", "doc", "template").distinct().groupBy("template")
                            .agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template"), "recurring")
    gone = known.join(recurring, "template").select("block", "doc", "line")

    def finish(block: int, table: pa.Table, right: pa.Table) -> pa.Table:
        drop = set(zip(right.column("doc").to_pylist(), right.column("line").to_pylist()))
        touched = {d for d, _ in drop}
        texts, total, dropped = [], [], []
        for d, text in enumerate(table.column(text_at).to_pylist()):
            all_lines = _lines(text)
            kept = [x for x in all_lines if (d, _hash(masked(x))) not in drop] if d in touched else all_lines
            texts.append("\n".join(kept))
            total.append(len(all_lines))
            dropped.append(len(all_lines) - len(kept))
        table = table.set_column(text_at, inner[text_at], pa.array(texts, pa.string()))
        return pa.table([pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), *table.columns],
                        ["n_lines", "n_dropped", *inner])

    ddl = "n_lines long, n_dropped long, " + ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, plain.schema))
    return bl.bring(blocks, gone, finish, ddl).toDF("n_lines", "n_dropped", *names)


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
