"""Quality classifier: an interpolated modified Kneser-Ney model of byte 5-grams.

Trusted texts are counted by language; the counts, the continuation counts of
the shorter n-grams and the discounts come from sharded aggregations. N-grams of
order 3 to 5 are dealt into shards by their language and context's last two
bytes, so that an n-gram, its context and all that it backs off to lie in one
shard; the number of shards follows the model's size, which keeps each of them
near ``SHARD_GRAMS`` n-grams.

Documents lie in blocks. Each block sends every shard its distinct 5-grams once;
a shard that is asked very much is dealt out by block, its n-grams to each part.
The join gives a log probability per 5-gram, which goes back to the block and is
added up per document. Neither the model nor the documents pass the driver.
Documents whose perplexity lies above a limit of their language are rejected. The
limit is that quantile of held-out trusted texts which best tells them from the
texts labelled bad; a lower limit is set where it does so too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm import blocks as bl
from bandwise.llm import scratch
from bandwise.llm.blocks import slices

ORDER = 5
SHARD_GRAMS = 2_000_000
BLOCK_BYTES = 16 << 20
SLICE = 1 << 20
HELD = 1 << 21
BROADCAST_IDS = 4_000_000
HIGH, SLACK = 0.995, 1.05
LEAST, STEP = 0.95, 0.0025  # quantiles below LEAST would reject too many good texts
SPREAD = 2654435761  # multiplicative hashing
_PAD = b"\n" * (ORDER - 1)
_LANG = np.uint64(8 * ORDER)


def _grams(texts: list[bytes], langs: np.ndarray, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The 5-gram that ends at each byte of the texts, with its language's number
    above its bytes, and the number of the text each belongs to; ``most`` bytes at
    a time, in the middle of a text too."""
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
    data = np.frombuffer(_PAD + _PAD.join([*texts, b""]), np.uint8)
    codes = langs.astype(np.uint64)
    for first in range(0, int(ends[-1]) if len(ends) else 0, most):
        at = np.arange(first, min(first + most, int(ends[-1])))
        doc = np.searchsorted(ends, at, side="right")
        at = at + (ORDER - 1) * (doc + 1)
        key = codes[doc]
        for back in range(ORDER - 1, -1, -1):
            key = (key << np.uint64(8)) | data[at - back]
        yield key, doc


def _count(langs: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held])
            found, back = np.unique(keys, return_inverse=True)
            total = np.bincount(back, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], ["gram", "c"])

        for b in batches:
            for part in slices(b, 1, SLICE):
                codes = np.array([langs[x] for x in part.column(0).to_pylist()], np.int64)
                for keys, _ in _grams(part.column(1).cast(pa.binary()).to_pylist(), codes):
                    held.append(np.unique(keys, return_counts=True))
                    size += len(held[-1][0])
                    if size > HELD:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic; an id with contrary labels is not trusted."""
    return (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min("quality").alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t"))
            .where("q = 1 AND t = 0").select("doc_id"))


def bad_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled bad and never good."""
    return (labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
            .where("q = 0").select("doc_id"))


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (column doc_id) whose id is in ``ids``. The ids are
    broadcast where their count shows that they are small; else both sides are
    shuffled."""
    ids = scratch.cut(ids, "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, "doc_id", "left_semi")


class Model:
    """Languages, discounts, the bounded tables of orders 1 and 2, and the written
    n-grams of orders 3 to 5 by shard."""

    def __init__(self, trusted: DataFrame, shard_grams: int = SHARD_GRAMS):
        """``trusted`` has the columns lang and text, without nulls."""
        self.langs = {r.lang: i for i, r in enumerate(trusted.select("lang").distinct().orderBy("lang").collect())}
        counts = (trusted.select("lang", "text").mapInArrow(_count(self.langs), "gram long, c long")
                  .groupBy("gram").agg(F.sum("c").alias("c")))
        grams = scratch.cut(counts, "grams5")
        orders = {ORDER: grams}
        for k in range(ORDER - 1, 0, -1):
            # The language's number moves down together with what is cut off in front.
            low = F.expr(f"(gram & {(1 << 8 * k) - 1}L) | (shiftright(gram, {8 * (k + 1)}) << {8 * k})")
            below = orders[k + 1].groupBy(low.alias("gram")).agg(F.count("*").alias("c"))
            orders[k] = scratch.cut(below, f"grams{k}")
        self.discounts = {k: self._discounts(df, k) for k, df in orders.items()}
        self.small = {k: _sorted(orders[k].toPandas()) for k in (1, 2)}  # at most 65,536 rows a language
        high = [orders[k].select("gram", "c", F.lit(k).alias("k"),
                                 F.expr(f"shiftright(gram, 8) & 65535L | (shiftright(gram, {8 * k}) << 16)").alias("place"))
                for k in range(3, ORDER + 1)]
        all_ = high[0].unionAll(high[1]).unionAll(high[2])
        self.shards = max(1, -(-sum(orders[k].count() for k in range(3, ORDER + 1)) // shard_grams))
        self.high = all_.withColumn("shard", F.expr(
            f"shiftright(place * {SPREAD}L & 4294967295L, 8) % {self.shards}")).select("shard", "k", "gram", "c")

    @staticmethod
    def _discounts(df: DataFrame, k: int) -> dict[int, np.ndarray]:
        """Per language [0, D1, D2, D3+], from how many n-grams have count 1 to 4."""
        got = (df.where("c <= 4").groupBy(F.expr(f"shiftright(gram, {8 * k})").alias("lang"), "c")
               .count().collect())
        times: dict[int, list[int]] = {}
        for r in got:
            times.setdefault(r.lang, [0] * 5)[r.c] = r["count"]
        out = {}
        for lang, n in times.items():
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            d = [0.0] + [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3)]
            out[lang] = np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])
        return out

    def tables(self, shard: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """n-grams and counts of one shard by order, sorted. Bounded by the number
        of n-grams a shard holds."""
        return _tables(self.high.where(F.col("shard") == shard).toPandas(), self.small)


def _tables(high: pd.DataFrame, small: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {k: _sorted(high[high.k == k]) for k in range(3, ORDER + 1)} | small


def _sorted(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(f.gram.to_numpy(np.uint64))
    return f.gram.to_numpy(np.uint64)[order], f.c.to_numpy(np.int64)[order]


class Scorer:
    """Log probabilities of 5-grams from the tables of one shard."""

    def __init__(self, tables: dict, discounts: dict, languages: int):
        self.grams = tables
        self.d = {k: np.array([discounts[k].get(i, np.array([0, .5, 1, 1.5])) for i in range(max(languages, 1))])
                  for k in tables}
        self.contexts = {}
        for k, (gram, c) in tables.items():
            context, first = np.unique(gram >> np.uint64(8), return_index=True)
            lang = (gram >> np.uint64(8 * k)).astype(np.int64)
            cut = self.d[k][lang, np.minimum(c, 3)]
            if len(gram):
                self.contexts[k] = (context, np.add.reduceat(c, first), np.add.reduceat(cut, first))
            else:
                self.contexts[k] = (context, c, cut)

    def log(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / 256)
        lang = keys >> _LANG
        for k in range(1, ORDER + 1):
            gram = (keys & np.uint64((1 << 8 * k) - 1)) | (lang << np.uint64(8 * k))
            known, c = self.grams[k]
            context, total, cut = self.contexts[k]
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            mine = np.where(known[at] == gram, c[at], 0)
            mine = mine - np.where(mine > 0, self.d[k][lang.astype(np.int64), np.minimum(mine, 3)], 0)
            ctx = gram >> np.uint64(8)
            at = np.minimum(np.searchsorted(context, ctx), len(context) - 1)
            p = np.where(context[at] == ctx, (mine + cut[at] * p) / total[at], p)
        return np.log(p)


def _spread(keys: np.ndarray) -> np.ndarray:
    """For ``blocks.by_shard``: what the model's ``shard`` is made from."""
    place = ((keys >> np.uint64(8)) & np.uint64(65535)) | ((keys >> _LANG) << np.uint64(16))
    return (place * np.uint64(SPREAD) & np.uint64(0xFFFFFFFF)) >> np.uint64(8) << np.uint64(33)


class _Asker:
    """What blocks of documents ask, and what they make of the answers."""

    def __init__(self, langs: dict[str, int], shards: int, text_at: int, lang_at: int):
        self.langs, self.shards, self.text_at, self.lang_at = langs, shards, text_at, lang_at

    def grams(self, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        texts = [t or b"" for t in table.column(self.text_at).cast(pa.binary()).to_pylist()]
        codes = np.array([self.langs.get(x, 0) for x in table.column(self.lang_at).cast(pa.string()).to_pylist()], np.int64)
        return _grams(texts, codes)

    def distinct(self, table: pa.Table) -> np.ndarray:
        parts = [pd.unique(keys) for keys, _ in self.grams(table)]
        return np.sort(pd.unique(np.concatenate(parts))) if parts else np.zeros(0, np.uint64)

    def question(self, block: int, table: pa.Table) -> list[dict]:
        keys = self.distinct(table)
        return bl.by_shard(block, _spread(keys), [keys.view(np.int64)], self.shards)

    def sums(self, table: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Log probability and number of 5-grams of each text."""
        keys = self.distinct(table)
        # As by_shard ordered what was asked.
        asked = np.argsort((_spread(keys) >> np.uint64(33)) % np.uint64(self.shards), kind="stable")
        parts = right.sort_by("shard").column("data").to_pylist()
        logs = np.empty(len(keys))
        logs[asked] = np.frombuffer(b"".join(parts), np.float64)
        index = pd.Index(keys)
        log_p, n = np.zeros(table.num_rows), np.zeros(table.num_rows, np.int64)
        for found, doc in self.grams(table):
            log_p += np.bincount(doc, weights=logs[index.get_indexer(found)], minlength=table.num_rows)
            n += np.bincount(doc, minlength=table.num_rows)
        return log_p, n


def score(blocks: DataFrame, model: Model, text_at: int, lang_at: int, id_at: int) -> DataFrame:
    """block, row, id, lang, log_p (natural log probability of the text's bytes,
    null where the model does not have its language), n_grams (their number) of
    each row in ``blocks``; text, language and id are the columns so numbered."""
    asker = _Asker(model.langs, model.shards, text_at, lang_at)
    asked = scratch.cut(bl.ask(blocks, asker.question), "asked")
    # One row per shard; shards are no more than 65,536 a language.
    parts = scratch.cut(asked.groupBy("shard").agg(
        F.ceil(F.sum("n") / bl.SHARD_ENTRIES).cast("long").alias("parts")), "parts")
    asked = asked.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")))
    grams = model.high.join(F.broadcast(parts), "shard").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    langs = model.langs
    rest = blocks.sparkSession.sparkContext.broadcast((model.small, model.discounts, len(langs)))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        small, discounts, languages = rest.value
        scorer = Scorer(_tables(right.select(["k", "gram", "c"]).to_pandas(), small), discounts, languages)
        data = []
        for x in left.column("data").to_pylist():
            (keys,) = bl.split(x, len(x) // 8, ["i8"])
            data.append(scorer.log(keys.view(np.uint64)).tobytes())
        return pa.table([left.column("block"), left.column("shard"), pa.array(data, pa.binary())], ["block", "shard", "data"])

    answers = (asked.select("shard", "part", "block", "data").groupBy("shard", "part")
               .cogroup(grams.select("shard", "part", "k", "gram", "c").groupBy("shard", "part"))
               .applyInArrow(answer, "block long, shard long, data binary"))

    def use(block: int, table: pa.Table, right: pa.Table) -> pa.Table:
        log_p, n = asker.sums(table, right)
        lang = table.column(lang_at).cast(pa.string()).to_pylist()
        known = [p if x in langs else None for p, x in zip(log_p.tolist(), lang)]
        return pa.table([pa.array(np.full(len(n), block)), pa.array(np.arange(len(n))), table.column(id_at).cast(pa.int64()),
                         pa.array(lang, pa.string()), pa.array(known, pa.float64()), pa.array(n)],
                        ["block", "row", "id", "lang", "log_p", "n_grams"])

    return bl.bring(blocks, answers, use, "block long, row long, id long, lang string, log_p double, n_grams long")


def _held_out(column: str):
    """A fifth of the ids: their trusted texts are not counted but set the limits,
    which would be too narrow on texts that the model has seen."""
    return F.pmod(F.xxhash64(column), F.lit(5)) == 0


def _limits(known: DataFrame, bad: DataFrame, low: float | None, high: float,
            slack: float) -> dict[str, tuple[float | None, float]]:
    """Lower limit (or None) and upper limit by language.

    Candidates are the quantiles of the trusted perplexities ``known`` from LEAST
    to ``high``, the last times ``slack``, and their mirror images below. Taken is
    the one that rejects the largest share of ``bad`` beyond that of ``known``, the
    widest of equals; so a language without bad texts has the widest upper limit,
    and no lower one. A lower limit is set only if it gains more than 1 - LEAST. A quantile ``low`` sets the lower limit itself. A few rows
    per language come to the driver."""
    steps = max(0, math.floor((high - LEAST) / STEP + 1e-9))
    share = [high - STEP * i for i in range(steps + 1)]  # widest first
    found = known.groupBy("lang").agg(
        F.percentile_approx("perplexity", share, 10000).alias("top"),
        F.percentile_approx("perplexity", [1 - x for x in share], 10000).alias("bottom"),
        F.percentile_approx("perplexity", low or 0.0, 10000).alias("low"))
    found = scratch.cut(found.withColumn("top", F.expr(f"transform(top, (x, i) -> IF(i = 0, x * {slack}D, x))"))
                        .withColumn("bottom", F.expr(f"transform(bottom, (x, i) -> IF(i = 0, x / {slack}D, x))")), "limits")
    rated = known.withColumn("good", F.lit(True)).unionAll(bad.withColumn("good", F.lit(False)))
    # How many candidates reject a text: those from some place in the order on.
    counts = (rated.join(F.broadcast(found), "lang")
              .select("lang", "good", F.expr("size(filter(top, x -> perplexity > x))").alias("above"),
                      F.expr("size(filter(bottom, x -> perplexity < x))").alias("below"))
              .groupBy("lang", "good", "above", "below").count().toPandas())
    out = {}
    for r in found.collect():
        mine = counts[counts.lang == r.lang]
        gain = {}
        for side in ("above", "below"):
            shares = []
            for good in (False, True):
                part = mine[mine.good == good]
                by = np.bincount(part[side], weights=part["count"], minlength=steps + 2)
                # Candidate i rejects a text that steps + 1 - i candidates reject, or more.
                shares.append(np.cumsum(by[::-1])[:steps + 1] / max(1, by.sum()))
            gain[side] = shares[0] - shares[1]
        labelled = not mine.good.all()
        most = r.top[int(np.argmax(gain["above"])) if labelled else 0]
        least = r.low / slack if low is not None else None
        if low is None and labelled and gain["below"].max() > 1 - LEAST:
            least = r.bottom[int(np.argmax(gain["below"]))]
        out[r.lang] = (least, most)
    return out


def _judged(blocks: DataFrame, base: DataFrame, labels: DataFrame, at: tuple[int, int, int], low: float | None,
            high: float, slack: float, shard_grams: int) -> DataFrame:
    """block, row, id, lang, perplexity, kept. ``base`` has the columns doc_id, lang
    and text; ``at`` are the numbers of the columns text, language and id."""
    ids = scratch.cut(trusted_ids(labels), "trusted")
    trusted = _among(base.where("lang IS NOT NULL AND text <> ''").where(~_held_out("doc_id")), ids)
    model = Model(trusted, shard_grams)
    scored = scratch.cut(score(blocks, model, *at).select(
        "block", "row", "id", "lang", F.when(F.col("n_grams") > 0, F.exp(-F.col("log_p") / F.col("n_grams"))).alias("perplexity")),
        "scores")
    rated = scored.where("perplexity IS NOT NULL").withColumnRenamed("id", "doc_id")
    known = _among(rated.where(_held_out("doc_id")), ids).select("lang", "perplexity")
    bad = _among(rated, scratch.cut(bad_ids(labels), "bad")).select("lang", "perplexity")
    keep = F.lit(True)
    for lang, (least, most) in _limits(known, bad, low, high, slack).items():  # one per language
        out = F.col("perplexity") > most
        if least is not None:
            out = out | (F.col("perplexity") < least)
        keep = F.when(F.col("lang") == lang, ~out).otherwise(keep)
    return scored.withColumn("kept", F.coalesce(keep, F.lit(True)))


def _in_blocks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, low, high, slack, shard_grams):
    names = docs.columns
    # Columns that clash with those added are taken by position.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = tuple(names.index(c) for c in (text_col, lang_col, id_col))
    blocks = bl.to_blocks(plain, at[0], "judge", BLOCK_BYTES)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    return plain, blocks, _judged(blocks, base, labels, at, low, high, slack, shard_grams)


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang", low: float | None = None, high: float = HIGH, slack: float = SLACK,
                 shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """doc_id, lang, perplexity, kept of each row, judged as ``classify`` does."""
    _, _, judged = _in_blocks(docs.select(id_col, lang_col, text_col), labels, id_col, text_col, lang_col, low, high,
                              slack, shard_grams)
    return judged.select(F.col("id").alias("doc_id"), "lang", "perplexity", "kept")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", low: float | None = None, high: float = HIGH, slack: float = SLACK,
             shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """The rows of ``docs`` with two columns in front: ``perplexity`` and ``kept``.

    Trusted are the rows whose id has the label quality 1 and not toxic 1. A row
    is rejected when its perplexity per byte is above the upper limit of its language,
    a quantile of the held-out trusted texts between LEAST and ``high`` (that times
    ``slack``) that best tells them from texts labelled quality 0, or below the lower
    one, which is likewise found or, where ``low`` is given, that quantile divided by ``slack``. Null and empty texts, and texts whose language is null or has
    no trusted text, have no perplexity or no limit and are kept. Repeated rows are judged
    alike; without trusted texts all is kept; an empty table gives no rows.
    """
    plain, blocks, judged = _in_blocks(docs, labels, id_col, text_col, lang_col, low, high, slack, shard_grams)

    def attach(block: int, table: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("row")
        return pa.table([right.column("perplexity"), right.column("kept"), *table.columns],
                        ["perplexity", "kept", *table.column_names])

    ddl = "perplexity double, kept boolean, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return bl.bring(blocks, judged.select("block", "row", "perplexity", "kept"), attach, ddl).toDF(
        "perplexity", "kept", *docs.columns)
