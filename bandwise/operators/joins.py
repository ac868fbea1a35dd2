"""Join helpers: broadcast only behind a measured size bound."""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast relation is held by every executor; keep it well below executor
# memory and below the 8 GB hard limit. The defaults fit dimension tables of a
# few million narrow rows.
DEFAULT_MAX_ROWS = 4_000_000
DEFAULT_MAX_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int


    def fits(self, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
        max_rows, max_bytes = limits(max_rows, max_bytes)
        return 0 <= self.rows <= max_rows and self.bytes <= max_bytes


def row_width(df: DataFrame) -> Column:
    """Bytes of a row as hashed relations lay it out: a null bitmap and one 8-byte
    slot per column, plus the UTF-8 bytes of strings and the elements of arrays."""
    width = F.lit(8 + 8 * len(df.columns))
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            # array header plus 8 bytes and the UTF-8 bytes of every element
            kind = f.dataType.elementType
            if isinstance(kind, T.StructType):
                texts = [g.name for g in kind if isinstance(g.dataType, T.StringType)]
                fixed = 16 + 8 * len(kind)
                elem = (lambda x: sum((F.coalesce(F.octet_length(x[t]), F.lit(0)) for t in texts), F.lit(fixed)))
            else:
                elem = (lambda x: F.coalesce(F.octet_length(x), F.lit(0)) + 8) if isinstance(
                    kind, T.StringType) else (lambda x: F.lit(8))
            width = width + F.coalesce(
                F.aggregate(c, F.lit(16), lambda acc, x: acc + elem(x)), F.lit(0))
    return width


def _size_row(df: DataFrame, name: str) -> DataFrame:
    """One-row aggregate: (name, rows, bytes)."""
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"),
                  F.sum(row_width(df).cast("long")).alias("b"))


# Size proofs already taken in this application, keyed by the plan's semantic
# hash, the files it reads and the state of their folders, so a file rewritten in
# place gives a new key. Relations without files are never
# remembered. A hit is double-checked with sameSemantics.
_PROOFS: OrderedDict[tuple, tuple[DataFrame, Size]] = OrderedDict()
_PROOF_SLOTS = 256


def clear_size_proofs() -> None:
    """Forget every remembered size proof."""
    _PROOFS.clear()


def _proof_key(df: DataFrame, files: list[str], states: dict[str, tuple]) -> tuple | None:
    """None where nothing shows whether the data have changed."""
    if not files:
        return None
    folders = sorted({_folder(f) for f in files})
    state = "\n".join([*files, *(f"{d} {states.get(d)}" for d in folders)])
    digest = hashlib.sha1(state.encode()).hexdigest()
    return (df.sparkSession.sparkContext.applicationId, df.semanticHash(), digest)


_EMPTY_AUTHORITY = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):///")


def _folder(path: str) -> str:
    """``file:///x`` and ``file:/x`` name the same file."""
    return _EMPTY_AUTHORITY.sub(r"\1:/", path).rpartition("/")[0]


def _states(spark: SparkSession, files: list[str]) -> dict[str, tuple]:
    """Per folder, a digest of the path, length and modification time of the files,
    as they are now: one metadata-only listing (the binary-file source reads no
    content for it), one row per folder."""
    if not files:
        return {}
    seen = spark.read.format("binaryFile").load(files).select(
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.xxhash64("path", "length", "modificationTime").alias("h"))
    got = seen.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("h")).collect()
    return {_EMPTY_AUTHORITY.sub(r"\1:/", r["folder"]): (r["n"], r["h"]) for r in got}


def measure_many(frames: dict[str, DataFrame], reuse: bool = True) -> dict[str, Size]:
    """Exact row counts and size estimates of several DataFrames in one job.

    Each is a global aggregate over the columns it selects (partial counts per
    task, one row per task shuffled); the union of the one-row results is
    collected: as many rows as there are inputs. Sizes proven earlier in the same
    application for the same plan over the same files are reused instead of
    recomputed.
    """
    out: dict[str, Size] = {}
    todo: dict[str, tuple[DataFrame, tuple]] = {}
    files = {name: sorted(df.inputFiles()) for name, df in frames.items()}
    states = {}
    if frames:
        spark = next(iter(frames.values())).sparkSession
        states = _states(spark, sorted({f for fs in files.values() for f in fs}))
    for name, df in frames.items():
        key = _proof_key(df, files[name], states)
        hit = _PROOFS.get(key) if reuse and key else None
        if hit is not None and hit[0].sameSemantics(df):
            _PROOFS.move_to_end(key)
            out[name] = hit[1]
        else:
            todo[name] = (df, key)
    if todo:
        parts = [_size_row(df, name) for name, (df, _) in todo.items()]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        for r in union.collect():
            size = Size(int(r["n"] or 0), int(r["b"] or 0))
            df, key = todo[r["name"]]
            out[r["name"]] = size
            if key:
                _PROOFS[key] = (df, size)
            while len(_PROOFS) > _PROOF_SLOTS:
                _PROOFS.popitem(last=False)
    return out


def measure(df: DataFrame) -> Size:
    """Exact row count and in-memory size estimate of ``df``."""
    return measure_many({"df": df})["df"]


def limits(max_rows: int | None = None, max_bytes: int | None = None) -> tuple[int, int]:
    """The broadcast bound, defaulting to the module settings at call time."""
    return (DEFAULT_MAX_ROWS if max_rows is None else max_rows,
            DEFAULT_MAX_BYTES if max_bytes is None else max_bytes)


def bounded_broadcast(df: DataFrame, max_rows: int | None = None,
                      max_bytes: int | None = None,
                      size: Size | None = None) -> tuple[DataFrame, bool]:
    """``(broadcast(df), True)`` when its measured size is within the bound,
    else ``(df, False)`` so the planner shuffles both sides (sort-merge join,
    with AQE splitting skewed partitions). Pass ``size`` if already measured."""
    max_rows, max_bytes = limits(max_rows, max_bytes)
    size = size or measure(df)
    if size.fits(max_rows, max_bytes):
        return F.broadcast(df), True
    return df, False
