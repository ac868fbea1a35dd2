"""Repair of conversations: the cheapest edits that make the roles alternate.

Turns are shuffled once by conversation and sorted inside each partition; a task
streams over them and holds one conversation at a time. Its turns are aligned, by
the Wagner-Fischer recurrence, to target strings of the grammar ``(s?(ua)+)?``.
Targets of even length, ``uaua..``, are prefixes of one another, and so are those
of odd length, ``suaua..``; one table per parity therefore holds the alignments to
every feasible length. Ukkonen's cut-off keeps a table to a band: no alignment of
cost c deletes more than c / 2 turns or inserts more than c / 5. The band starts
narrow and grows until it covers the cost of the best alignment found (the
incumbent), which is then the best of all. Each table is backtraced from the front
by the smallest edit letter that stays on a cheapest alignment; the smaller of the
two audits wins. Only every sqrt(n)-th row of a table is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_BLANKS = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
_FULL = {"u": "user", "a": "assistant"}
_NEVER = 1 << 29
_BATCH = 1000


class _Table:
    """Cheapest completions of the turns from i on, j target turns being behind,
    for the targets of one parity, in a band around j = i.

    A turn is one byte: its role (0 s, 1 u, 2 a, 3 other), 4 if it must go, 8 if
    it is truncated."""

    def __init__(self, turns: bytes, odd: bool, most: int):
        self.turns, self.odd, self.n = turns, odd, len(turns)
        self.down, self.width = min(most // DELETE, self.n), min(most // DELETE, self.n) + most // INSERT + 1
        self.step = isqrt(self.n) + 1
        self.saved = {self.n: self._row(self.n, None)}
        row = self.saved[self.n]
        for i in range(self.n - 1, -1, -1):
            row = self._row(i, row)
            if i % self.step == 0:
                self.saved[i] = row
        self.block = {}
        self.cost = self.at(0, 0)

    def role(self, j: int) -> str:
        return "s" if self.odd and j == 0 else "ua"[(j - self.odd) % 2]

    def _row(self, i: int, later: np.ndarray | None) -> np.ndarray:
        first = i - self.down  # j of column 0
        out = np.full(self.width, _NEVER, np.int64)
        if later is None:
            out[(self.odd - first) % 2::2] = 0  # lengths of this parity
            if self.odd and 0 <= 1 - first < self.width:
                out[1 - first] = _NEVER  # "s" alone
        else:
            t = self.turns[i]
            out[1:] = later[:-1] + DELETE
            if not t & 4:
                extra = TRUNCATED if t & 8 else 0
                for k, role in enumerate((1, 2)):
                    x = (self.odd + k - first) % 2
                    keep = later[x::2] + (extra + (0 if t & 3 == role else REROLE))
                    if self.odd and x <= -first < self.width and (-first - x) % 2 == 0:
                        keep[(-first - x) // 2] = _NEVER if t & 3 else later[-first] + extra
                    out[x::2] = np.minimum(out[x::2], keep)
        if first < 0:
            out[:-first] = _NEVER
        start = out[-first] if self.odd and 0 <= -first < self.width else None
        slope = np.arange(self.width) * INSERT
        out = np.minimum.accumulate((out + slope)[::-1])[::-1] - slope
        if start is not None:
            out[-first] = start  # an "s" cannot be inserted
        return np.minimum(out, _NEVER)

    def at(self, i: int, j: int) -> int:
        x = j - i + self.down
        if i > self.n or not 0 <= x < self.width or j < 0:
            return _NEVER
        if i not in self.block and i not in self.saved:
            top = min(self.n, (i // self.step + 1) * self.step)
            row, self.block = self.saved[top], {}
            for k in range(top - 1, i // self.step * self.step, -1):
                row = self.block[k] = self._row(k, row)
        return int((self.saved[i] if i in self.saved else self.block[i])[x])

    def audit(self) -> str:
        i = j = 0
        out = []
        while True:
            left = self.at(i, j)
            if i == self.n and left == 0:
                return "".join(out)
            if i < self.n and DELETE + self.at(i + 1, j) == left:
                out.append("D")
                i += 1
            elif self.role(j) != "s" and INSERT + self.at(i, j + 1) == left:
                out.append("I")
                j += 1
            else:
                out.append("K" if "sua?"[self.turns[i] & 3] == self.role(j) else "R")
                i, j = i + 1, j + 1


def align(turns: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits; of equally cheap audits the least."""
    most = 2 * INSERT
    while True:
        tables = [_Table(turns, odd, most) for odd in (False, True)]
        cost = min(t.cost for t in tables)
        if cost <= most:
            return cost, min(t.audit() for t in tables if t.cost == cost)
        most = min(cost, 2 * most)


_align_short = lru_cache(1 << 16)(align)


def _repair(rows: list[tuple]) -> dict:
    """All that is found and done about one conversation's (turn, role, text) in order."""
    seen, codes, count = set(), bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        if not _WORD.search(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(_BLANKS)[-1] not in ".!?":
            fault = "truncated"
        else:
            fault = None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        code = "sua".find(role[:1]) if role else 3
        codes.append((code if code >= 0 else 3) | (8 if fault == "truncated" else 4 if fault else 0))
    initials = [role[:1] for _, role, _ in rows]
    numbers = {t for t, _, _ in rows if t is not None}
    cost, audit = (_align_short if len(codes) <= 24 else align)(bytes(codes))
    odd = (len(audit) - audit.count("D")) % 2
    i, turns = 0, []
    for edit in audit:
        j = len(turns)
        if edit in "IR":
            turns.append({"role": _FULL["ua"[(j - odd) % 2]], "text": "" if edit == "I" else rows[i][2]})
        elif edit == "K":
            turns.append({"role": rows[i][1], "text": rows[i][2]})
        i += edit != "I"
    return {"gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, **count,
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit, "turns": turns}


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, turns (array of role and text: the repaired turns).

    Turns are taken by number, nulls first; of equal numbers by role, then text.
    Null roles and texts count as one space, so such a text is blank; a role whose
    first letter is not s, u or a can only be given another role or deleted. Null
    ids are one conversation. Where ``present_col`` is false, a row only names its
    conversation; one without other rows has zeros, an empty audit and no turns.
    Repeated rows are turns like others (duplicates, from the second on). An
    empty table gives no rows; extra columns are not read.
    """
    present = F.lit(True) if present_col is None else F.col(present_col)
    rows = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        present.alias("present"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, done, rows, current, kind = [], [], [], None, None

        def emit() -> pa.RecordBatch:
            columns = [pa.array(ids, kind), *(pa.array([d[c] for d in done], pa.int64()) for c in _FIGURES),
                       pa.array([d["audit"] for d in done], pa.string()), pa.array([d["turns"] for d in done], _TURNS)]
            ids.clear(), done.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *_FIGURES, "audit", "turns"])

        for b in batches:
            kind = b.column(0).type
            for conv, turn, role, text, here in zip(*(c.to_pylist() for c in b.columns)):
                if current is None or current[0] != conv:
                    if current is not None:
                        ids.append(current[0]), done.append(_repair(rows))
                        if len(done) >= _BATCH:
                            yield emit()
                    current, rows = (conv,), []
                if here:
                    rows.append((turn, role, text))
        if current is not None:
            ids.append(current[0]), done.append(_repair(rows))
            yield emit()

    ddl = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _FIGURES) + ", audit string, turns array<struct<role:string,text:string>>"
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
            .mapInArrow(run, ddl))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: the turns with faults that follow from
    crc32(``conv_id:turn``) modulo 20 (nulls count as one space). Dropped turns stay
    as rows that are not present."""
    def filled(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), draw.alias("draw"))
    text = (F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return rows.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"), (F.col("draw") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def digests(repaired: DataFrame) -> DataFrame:
    """The audit with a hash of the repaired turns in place of the turns."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.withColumn("repaired_sha256", F.sha2(joined, 256)).drop("turns")
