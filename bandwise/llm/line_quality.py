"""Quality rules and cross-document line frequency, in DataFrame functions alone.

1. Rules that need one text are array expressions inside its row. Repeated
   windows are looked for by hash; only where two hashes of a text are equal are
   the windows themselves compared, so the count is exact.
2. Each document's distinct normalised lines become 64-bit keys (host and line
   together), counted with partial aggregation: a line of every document is one
   row per task. Keys above the absolute limit are candidates; a collision can
   only add one.
3. Lines whose key is a candidate are read again with a 128-bit part of their
   sha-256, and the distinct documents of each (host, line) are counted, first by
   (line, document), then by line, so no line's documents meet in one task.
4. Lines above the limits are removed; a document of which too little is left is
   rejected.

Keys are broadcast where there are at most ``SMALL``; beyond that only those
above a ``SMALL``-th of all rows that any key has, of which there are fewer than
``SMALL``, and the others, now without hot keys, go through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.llm import scratch

MAX_DOCS = 10
MAX_PER_MILLE = 1
MAX_REMOVED = 50
MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
SMALL = 500_000

_SPACE = r"[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tag(c: str) -> Column:
    """A text that tells apart any two values, null included, also as a prefix."""
    s = F.col(c).cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("n"))


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("host", _tag("host"))


def _key(rows: DataFrame) -> Column:
    """Identity of a row by all that its result depends on."""
    return F.unhex(F.sha2(F.concat(_tag("doc_id"), "host", "text"), 256))


def _lines(text: str) -> Column:
    """Normalised lines: A-Z in lower case, runs of digits as 0, white space as
    single blanks, none at the ends."""
    plain = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[0-9]+", "0")
    return F.transform(F.split(F.regexp_replace(plain, r"[\x20\x09\x0B-\x0D]+", " "), "\n", -1), lambda x: F.trim(x))


def base_rules(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rows`` (with ``text``) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    names = rows.columns
    out = rows.select(
        *names,
        F.expr(f"array_remove(split(text, '{_SPACE}', -1), '')").alias("_words"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("_raw"))
    out = out.select(
        *names, "_words", "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"),
        F.expr(f"""transform(if(size(_words) < {window}, array(), sequence(1, size(_words) - {window - 1})),
                   i -> xxhash64(slice(_words, i, {window})))""").alias("_runs"))
    names += ["n_words", "word_chars", "n_symbols", "n_dup_lines"]

    def twice(entries: str) -> str:
        """Places of the sorted (v, i) entries whose v a neighbour has too."""
        return (f"transform(filter(transform({entries}, (x, k) -> struct(x.i AS i, "
                f"coalesce(x.v = get({entries}, k - 1).v, false) OR coalesce(x.v = get({entries}, k + 1).v, false) AS again)),"
                f" x -> x.again), x -> x.i)")

    out = out.select(*names, "_words", F.expr(
        "CASE WHEN size(array_distinct(_runs)) < size(_runs) THEN "
        "sort_array(transform(_runs, (h, k) -> struct(h AS v, k + 1 AS i))) END").alias("_hashed"))
    out = out.select(*names, "_words", F.expr(twice("_hashed")).alias("_maybe"))
    out = out.select(*names, F.expr(
        f"sort_array(transform(_maybe, i -> struct(array_join(slice(_words, i, {window}), ' ') AS v, i AS i)))"
    ).alias("_texts"))
    out = out.select(*names, F.expr(f"sort_array({twice('_texts')})").alias("_at"))
    return out.select(*names, F.expr(
        f"""coalesce(aggregate(transform(_at, (x, k) -> least({window}, coalesce(get(_at, k + 1) - x, {window}))),
                               0L, (a, x) -> a + x), 0L)""").alias("n_repeat_words"))


def _having(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among ``keys`` (key, rows: a written table)."""
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if n <= SMALL:
        return rows.join(F.broadcast(keys.select(key)), key, "left_semi")
    hot = F.broadcast(keys.where(F.col("rows") > total // SMALL).select(key))
    cold = keys.where(F.col("rows") <= total // SMALL).select(key)
    return rows.join(hot, key, "left_semi").select(*rows.columns).unionAll(
        rows.join(hot, key, "left_anti").join(cold, key, "left_semi").select(*rows.columns))


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   max_docs: int = MAX_DOCS, max_per_mille: int = MAX_PER_MILLE) -> DataFrame:
    """key, pos, line, words: the lines (by place in their document) that more
    than ``max_docs`` documents and more than ``max_per_mille`` thousandths of the
    documents of their host have."""
    rows = _rows(docs, id_col, text_col, host_col)
    keyed = rows.select("host", _lines("text").alias("lines")).select(F.explode(F.expr(
        "array_distinct(transform(filter(lines, x -> x <> ''), x -> xxhash64(host, x)))")).alias("short"))
    counts = keyed.groupBy("short").agg(F.count("*").alias("rows")).where(F.col("rows") > max_docs)
    candidates = scratch.cut(counts, "line-candidates")

    again = rows.select("doc_id", "host", _key(rows).alias("key"), _lines("text").alias("lines"))
    again = again.select("doc_id", "host", "key", F.posexplode("lines").alias("pos", "text")).where("text <> ''")
    again = again.select("doc_id", "host", "key", "pos", "text", F.xxhash64("host", "text").alias("short"))
    found = _having(again, candidates, "short").select(
        "doc_id", "host", "key", "pos",
        F.substring(F.unhex(F.sha2(F.concat("host", F.lit("\n"), "text"), 256)), 1, 16).alias("line"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"))
    found = scratch.cut(found, "line-places")

    id_tag = _tag("doc_id")
    per_host = rows.select("host", id_tag.alias("id")).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    per_line = (found.groupBy("host", "line", id_tag.alias("id")).agg(F.count("*").alias("rows"))
                .groupBy("host", "line").agg(F.count("*").alias("docs"), F.sum("rows").alias("rows")))
    above = (per_line.where(F.col("docs") > max_docs).join(per_host, "host")
             .where(F.col("docs") * 1000 > F.col("host_docs") * max_per_mille).select("line", "rows"))
    above = scratch.cut(above, "lines-above")
    return _having(found, above, "line").select("key", "pos", "line", "words")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_docs: int = MAX_DOCS, max_per_mille: int = MAX_PER_MILLE, max_removed: int = MAX_REMOVED,
          min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (without the lines above the
    limits), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_line_words (words of the removed lines), base_failed, kept.

    A line is removed where more than ``max_docs`` documents of its host, and more
    than ``max_per_mille`` thousandths of them, have it. A document fails the base rules with
    fewer than ``min_words`` words or more than ``max_repeated`` of its words in
    repeated windows; it is depleted, and not kept, if removed lines hold more
    than ``max_removed`` percent of its words or leave fewer than ``min_words``.

    A null text is an empty one; it and texts without words have no lines and fail
    the base rules. Null hosts are one host. Documents are told apart by id; null
    ids count as one document. Repeated rows count once and all get the same
    verdict; rows that share an id with different texts are judged one by one. An
    empty table gives no rows; extra columns are not read.
    """
    rows = _rows(docs, id_col, text_col, host_col)
    gone = (frequent_lines(docs, id_col, text_col, host_col, max_docs, max_per_mille)
            .groupBy("key", "pos").agg(F.max("words").alias("words"), F.max("line").alias("line"))
            .groupBy("key").agg(F.sum("words").alias("gone_words"), F.collect_set("line").alias("gone")))
    out = base_rules(rows.withColumn("key", _key(rows))).join(gone, "key", "left")
    out = out.withColumn("n_line_words", F.coalesce("gone_words", F.lit(0).cast("long")))
    # the removed lines, found again by their hash; only where text is asked for
    out = out.withColumn("_norm", F.when(F.col("gone").isNotNull(), _lines("text")))
    kept_lines = F.expr(r"""filter(split(text, '\n', -1), (x, k) -> NOT array_contains(
        gone, substring(unhex(sha2(concat(host, '\n', get(_norm, k)), 256)), 1, 16)))""")
    out = out.withColumn("_text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n")))
    failed = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated)
    depleted = (F.col("n_line_words") * 100 > F.col("n_words") * max_removed) | (
        F.col("n_words") - F.col("n_line_words") < min_words)
    return out.select(
        "doc_id", F.col("_text").alias("text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_line_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))
