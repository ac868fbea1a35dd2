"""Nearest neighbours by a block matrix join over int8 codes.

Every vector is scaled to int8. A tile is one block of queries against one
block of candidates: a product of the code matrices gives each inner product
with a bound on its quantisation error (from the exact norms of the residuals;
vectors are first scaled by a power of two, so that none of this overflows), so a pair whose upper bound is below the k-th best lower bound cannot be among
the tile's k nearest. The surviving pairs are recomputed in double precision;
the tiles' sorted lists are merged by heaps, in two levels. The result is exact.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
QUERY_BLOCK = 1024
MERGE_TILES = 64
_PAIRS = 1 << 18


def int8_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes in [-127, 127] as float64 scaled back, norm of the codes' vector,
    and norm of the residual, per row."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale)
    back = codes * scale
    return (codes.astype(np.int8), scale[:, 0], np.sqrt((back ** 2).sum(1)),
            np.sqrt(((x - back) ** 2).sum(1)))


def _tile_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple]:
    """Exact k nearest of the tile per query: (query_id, vec_id, score)."""
    # A query's own scale does not change its order; a candidate's is put back
    # relative to the tile's largest.
    qe, ce = (np.frexp(np.abs(x).max(axis=1))[1] for x in (q, c))
    back = np.ldexp(1.0, ce - ce.max())
    scaled = np.ldexp(c, -ce[:, None])
    qc, qs, qn, qr = int8_codes(np.ldexp(q, -qe[:, None]))
    cc, cs, _, cr = int8_codes(scaled)
    cn = np.sqrt((scaled ** 2).sum(1)) * back
    cs, cr = cs * back, cr * back
    # Sums of products of codes stay exact in float32 below 2**24.
    kind = np.float32 if q.shape[1] * 127 * 127 < 2 ** 24 else np.float64
    est = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    err = (qn[:, None] * cr[None, :] + qr[:, None] * cn[None, :]) * (1 + 1e-9)
    # the rounding of est and of the double sums, and what these lose where products underflow
    with np.errstate(over="ignore"):
        lost = np.ldexp(float(q.shape[1]), -1074 - qe - ce.max())
    err += 1e-12 * qn[:, None] * cn[None, :] + lost[:, None] + 1e-300
    est[q_ids[:, None] == c_ids[None, :]] = -np.inf
    low = est - err
    kth = min(k, low.shape[1])
    floor = np.partition(low, low.shape[1] - kth, axis=1)[:, low.shape[1] - kth]
    # where sums may overflow in double precision, scores are equal that differ here
    floor[qe + ce.max() + q.shape[1].bit_length() > 1022] = -np.inf
    at_q, at_c = np.nonzero((est + err >= floor[:, None]) & (est > -np.inf))
    with np.errstate(over="ignore", invalid="ignore"):  # from the first component on, as SQL adds
        exact = np.concatenate([np.cumsum(q[at_q[i:i + _PAIRS]] * c[at_c[i:i + _PAIRS]], axis=1)[:, -1]
                                for i in range(0, len(at_q), _PAIRS)] or [np.zeros(0)])
    order = np.lexsort((c_ids[at_c], -exact, at_q))
    at_q, at_c, exact = at_q[order], at_c[order], exact[order]
    first = np.searchsorted(at_q, at_q, side="left")
    keep = np.arange(len(at_q)) - first < k
    return list(zip(q_ids[at_q[keep]].tolist(), c_ids[at_c[keep]].tolist(), exact[keep].tolist()))


def nearest(vectors: DataFrame, k: int = 20, query: str = "vec_id % 20 = 0", id_col: str = "vec_id",
            vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's ``k`` nearest by
    largest inner product in double precision, ties to the smaller id.

    ``query`` is an SQL condition on ``vec_id``. Vectors that are null, zero or
    hold null or non-finite components, and rows with a null id, take no part;
    vectors of different length are never compared. Of rows that repeat an id
    each is a candidate of its own, but none is a neighbour of its own id; a
    repeated query id asks once, with the smallest of its vectors. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    vec = F.col(vector_col)
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0))
    is_query = F.expr(query)
    n, nq = usable.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    n_c, n_q = max(1, -(-n // block)), max(1, -(-nq // query_block))
    keyed = usable.withColumn("h", F.xxhash64("vec_id")).withColumn("dim", F.size("v"))
    cands = keyed.select("vec_id", "v", "dim", F.pmod("h", F.lit(n_c)).cast("int").alias("cb"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    asked = (keyed.where(is_query).groupBy("vec_id", "h").agg(F.min("v").alias("v"))
             .withColumn("dim", F.size("v")))
    queries = asked.select(
        "vec_id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"),
        F.pmod(F.shiftright("h", 20), F.lit(n_q)).cast("int").alias("qb"))
    out = "query_id long, vec_id long, score double, cb int"

    def tile(key, f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f.asks], f[~f.asks]
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "cb": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64", "cb": "int32"})
        rows = _tile_top(left.vec_id.to_numpy(np.int64), np.stack(left.v).astype(np.float64),
                         right.vec_id.to_numpy(np.int64), np.stack(right.v).astype(np.float64), k)
        got = pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])
        got["cb"] = np.int32(key[1])
        return got

    columns = ("qb", "cb", "dim", "vec_id", "v")
    both = (queries.select(*columns, F.lit(True).alias("asks"))
            .unionAll(cands.select(*columns, F.lit(False).alias("asks"))))
    tiles = both.groupBy("qb", "cb", "dim").applyInPandas(tile, out)

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        lists = ([(-s, v) for s, v in zip(g.score, g.vec_id)] for _, g in rows.groupby("cb", sort=False))
        best = list(islice(heapq.merge(*[sorted(x) for x in lists]), k))
        return pd.DataFrame({"query_id": np.full(len(best), key[0], np.int64), "vec_id": [v for _, v in best],
                             "score": [-s for s, _ in best], "cb": np.full(len(best), 0, np.int32)})

    if n_c > MERGE_TILES:
        tiles = (tiles.withColumn("part", F.floor(F.col("cb") / MERGE_TILES))
                 .groupBy("query_id", "part").applyInPandas(merge, out))

    def rank(key, rows: pd.DataFrame) -> pd.DataFrame:
        best = merge(key, rows)
        best.insert(1, "rank", np.arange(1, len(best) + 1, dtype=np.int32))
        return best[["query_id", "rank", "vec_id", "score"]]

    return tiles.groupBy("query_id").applyInPandas(rank, "query_id long, rank int, vec_id long, score double")
