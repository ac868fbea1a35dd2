"""Phrase mining, conversation repair and line rules against brute force, and on
awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables,
clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bandwise.llm import collocations, line_quality, turn_repair

SPACE = r"[\x20\x09-\x0D]+"


# ------------------------------------------------------------------ phrases

def _phrases(rows, min_count, top, inside=50):
    count = collections.defaultdict(collections.Counter)
    n = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in count.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and p in (q[:2], q[1:]) for q, b in often.items()):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    pick = random.Random(3)
    words = ["la", "Été", "x", "New", "york", "CITY", "b-c", "ß", "日本", "q"]
    texts = [" ".join(pick.choices(words, k=pick.randrange(1, 60))) for _ in range(60)]
    texts += ["new york city, new york. New\tYork  city\nnew york city"] * 4
    texts += [None, "", " \t\n ", ".,;", "x" * 5000, "la la la la la\x0bla la\rla", "x " * 3000, "nul\x00 nul\x00 nul\x00"]
    langs = ["en", "fr", None, "und", "en"]
    return [(langs[i % 5], t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 300, "shard_entries": 20, "fan": 4}])
def test_phrases(spark, phrase_rows, sizes):
    docs = spark.createDataFrame([(t, lang, 1, 2) for lang, t in phrase_rows], "text string, lang string, a long, f long")
    got = collocations.mine(docs.repartition(3), min_count=3, top=40, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _phrases(phrase_rows, 3, 40)


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(empty).collect() == []
    nulls = spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")
    assert collocations.mine(nulls).collect() == []


@pytest.mark.parametrize("bits", [3, 5, 17, 21, 22, 30, 36])
def test_filters_lose_nothing(bits):
    pick = np.random.default_rng(bits)
    packing = collocations.Packing(bits)
    ids = pick.integers(0, 1 << bits, (3, 4000))
    ids[:, :3] = [[0], [(1 << bits) - 1], [1]]
    for back, x in zip(packing.unpack(*packing.pack(*ids)), ids):
        assert (back == x).all()
    for shard_bits in (0, 3, min(9, packing.left)):
        left, right, n = collocations.counted(*packing.pack(*ids), None, packing)
        n = n * pick.integers(1, 2000, len(n)) ** 3
        parts = []
        shard = (left >> np.uint64(packing.left - shard_bits)).astype(np.int64)
        for s in np.unique(shard):
            m = shard == s
            data = collocations.encode(left[m], right[m], n[m], packing, shard_bits)
            back = collocations.decode(data, int(s), packing, shard_bits)
            assert all((x == y[m]).all() for x, y in zip(back, (left, right, n)))
            parts.append(back)
        twice = [np.concatenate(p) for p in zip(*parts, *parts)]
        merged = collocations.counted(*twice, packing)
        assert all((x == y).all() for x, y in zip(merged, (left, right, 2 * n)))


def test_tokens_take_few_bytes_per_byte():
    """Splitting a block holds no eight-byte number per byte of its text."""
    text = "Some words, of several lengths; in more pieces than one. " * 40_000
    table = pa.table({"text": [text, "", "one"], "lang": ["en", "en", "und"]})
    collocations.Tokens(table)
    tracemalloc.start()
    try:
        found = collocations.Tokens(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found.pair) == 400_001 and int((~found.same).sum()) == 3 * 40_000
    assert peak < 16 * len(text)  # 28 times with numbers per byte


def test_scores_past_64_bits(spark):
    a, left, right = 9 * 10**14, 10**15, 10**15 - 7
    df = spark.createDataFrame([(a, left, right)], "f long, l long, r long")
    got = df.select(collocations._score(df.f, df.l, df.r)).first()[0]
    assert got == 10**6 * a * a // (left * right)


# ------------------------------------------------------------ conversations

def _enumerated(turns):
    """The least (cost, audit) of all edit lists worth trying, one by one."""
    best = [(2 * len(turns), "D" * len(turns))]

    def go(i, made, cost, audit):
        if (cost, audit) > best[0] and cost >= best[0][0]:
            return
        if i == len(turns):
            if re.fullmatch("(s?(ua)+)?", made):
                best[0] = min(best[0], (cost, audit))
        else:
            t = turns[i]
            go(i + 1, made, cost + 2, audit + "D")
            if not t & 4:
                extra = 5 if t & 8 else 0
                go(i + 1, made + "sua?"[t & 3], cost + extra, audit + "K")
                for role in "ua":
                    if role != "sua?"[t & 3]:
                        go(i + 1, made + role, cost + extra + 1, audit + "R")
        for role in "ua":
            go(i, made + role, cost + 5, audit + "I")

    go(0, "", 0, "")
    return best[0]


def _automaton(turns):
    """The same over the grammar's four states, for long inputs."""
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for role, to in moves[state].items():
                    if role != "s":
                        best[to] = min(best.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return best

    best = inserted({0: (0, "")})
    for t in turns:
        new = {state: (cost + 2, audit + "D") for state, (cost, audit) in best.items()}
        for state, (cost, audit) in best.items():
            for role, to in moves[state].items():
                own = "sua?"[t & 3] == role
                if not t & 4 and (own or role != "s"):
                    step = (cost + (0 if own else 1) + (5 if t & 8 else 0), audit + ("K" if own else "R"))
                    new[to] = min(new.get(to, (10**9, "")), step)
        best = inserted(new)
    return min(best[s] for s in (0, 3) if s in best)


CODES = [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11]


def test_alignment_by_enumeration():
    pick = random.Random(1)
    for n in range(5):
        for _ in range(80):
            turns = bytes(pick.choice(CODES) for _ in range(n))
            assert turn_repair.align(turns) == _enumerated(turns) == _automaton(turns)


@pytest.mark.parametrize("n", [7, 30, 200, 600])
def test_long_alignment(n):
    pick = random.Random(n)
    for share in (1, 4):
        turns = bytes(pick.choice(CODES + [1 + i % 2] * 11 * share) for i in range(n))
        assert turn_repair.align(turns) == _automaton(turns)


def _repaired(rows):
    """Digest of one conversation's damaged rows, by the automaton."""
    seen, codes, faults = set(), [], collections.Counter()
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = ("blank" if not words else "duplicate" if (role, text) in seen else
                "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
        faults[kind] += 1
        codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) | {"": 0, "truncated": 8}.get(kind, 4))
    cost, audit = _automaton(codes)
    made = len(audit) - audit.count("D")
    target = ("s" if made % 2 else "") + "ua" * (made // 2)
    out, i = [], 0
    for e in audit:
        if e in "KR":
            out.append((rows[i][1] if e == "K" else {"u": "user", "a": "assistant"}[target[len(out)]]) + ":" + rows[i][2])
        elif e == "I":
            out.append({"u": "user:", "a": "assistant:"}[target[len(out)]])
        i += e != "I"
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"],
            faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_conversations(spark):
    pick = random.Random(8)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(pick.randrange(1, 14)):
            role = pick.choice(["user", "assistant"] * 3 + ["system", "tool", "", None, "User"])
            text = pick.choice(["Hi there.", "What? ", "é!\n", "cut off", None, "", " \t", f"No {turn}.", "a\x0b"])
            rows.append((conv, pick.choice([turn, turn, turn, None]), role, text, True, "D"))
    rows += [(7, None, None, None, False, "K"), (7, 3, "user", "Hi there.", True, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean, audit string")
    got = turn_repair.digests(turn_repair.repair(turn_repair.damage(df.repartition(4)), present_col="present"))
    want = {}
    for conv, turn, role, text, *_ in rows:
        here = want.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        here += [(turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    want = {c: _repaired(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())))
            for c, r in want.items()}
    assert {r.conv_id: tuple(r[1:]) for r in got.collect()} == want
    assert turn_repair.repair(df.limit(0)).collect() == []


def test_repaired_turns(spark):
    rows = [("c", 1, "user", "Hi."), ("c", 2, "user", "Bye."), ("c", 5, "assistant", "So.")]
    got = turn_repair.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).first()
    assert (got.gaps, got.illegal, got.cost, got.audit) == (2, 1, 2, "DKK")
    assert [tuple(t) for t in got.turns] == [("user", "Bye."), ("assistant", "So.")]


# -------------------------------------------------------------------- lines

def _base(text, window=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = collections.defaultdict(list)
    for i in range(len(words) - window + 1):
        at[tuple(words[i:i + window])].append(i)
    covered = {i + j for p in at.values() if len(p) > 1 for i in p for j in range(window)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered))


def _norm(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return re.sub(SPACE, " ", re.sub("[0-9]+", "0", low)).strip(" ")


def _judged(rows, max_docs, per_mille):
    hosts, seen = collections.defaultdict(set), collections.defaultdict(set)
    for i, text, host in rows:
        hosts[host].add(i)
        for line in (text or "").split("\n"):
            if _norm(line):
                seen[host, _norm(line)].add(i)
    out = []
    for i, text, host in rows:
        n, *rest = base = _base(text)
        stays, gone = [], 0
        for line in (text or "").split("\n"):
            d = len(seen[host, _norm(line)])
            if d > max_docs and d * 1000 > per_mille * len(hosts[host]):
                gone += len(_norm(line).split(" "))
            else:
                stays.append(line)
        failed = n < 20 or 100 * rest[-1] > 30 * n
        kept = not failed and not (100 * gone > 50 * n or n - gone < 20)
        out.append((i, "\n".join(stays), *base, gone, failed, kept))
    return out


@pytest.fixture(scope="module")
def line_rows():
    pick = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["Été", "日本", "#x", "a|b", "<p>", "100%"]
    rows = []
    for i in range(40):
        body = [" ".join(pick.choices(words, k=pick.randrange(5, 40))) for _ in range(3)]
        if i % 3:
            body.insert(pick.randrange(4), pick.choice(["Home  | About\t", "HOME | about "]))
        if i % 4 == 0:
            body += [f"Page {i} of 40"]
        if i % 5 == 0:
            body += [" ".join(f"long{j}" for j in range(60))]
        rows.append((i, "\n".join(body), ["a", "b", None][i % 3]))
    again = " ".join(f"r{j}" for j in range(12))
    rows += [(40, None, "a"), (41, "", "a"), (42, " \n\t\n\x0b", None), (43, f"{again} x {again} y z {again[:20]}", "a"),
             (44, "la " * 500, "b"), (45, "x" * 4000 + "\n" + "y " * 25, "a"), (None, rows[1][1], "a"),
             (None, rows[4][1], "a"), (2, rows[4][1], "b"), (46, "same\nsame\n same\nsame", "a")]
    return rows + [rows[3]] * 3


@pytest.mark.parametrize("limits", [(4, 1), (2, 300), (1000, 1)])
def test_lines(spark, line_rows, limits):
    docs = spark.createDataFrame([(*r, 1, True, b"k") for r in line_rows],
                                 "doc_id long, text string, source string, n_words long, kept boolean, key binary")
    got = line_quality.judge(docs.repartition(3), max_docs=limits[0], max_per_mille=limits[1])

    def ordered(rows):
        return sorted(map(tuple, rows), key=str)

    assert ordered(got.collect()) == ordered(_judged(line_rows, *limits))


def test_many_candidates(spark, line_rows, monkeypatch):
    monkeypatch.setattr(line_quality, "SMALL", 3)
    docs = spark.createDataFrame(line_rows, "doc_id long, text string, source string")
    got = line_quality.judge(docs, max_docs=1, max_per_mille=1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(_judged(line_rows, 1, 1), key=str)


def test_no_lines(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_quality.judge(empty).collect() == []


def test_rules_run_in_the_jvm(spark, line_rows):
    docs = spark.createDataFrame(line_rows, "doc_id long, text string, source string")
    plan = line_quality.judge(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
