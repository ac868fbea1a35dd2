"""The pipeline's stages against brute force, runs that follow one another, words
made to collide under polynomial hashes, vectors of extreme size."""

from __future__ import annotations

import collections
import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from bandwise.llm import ann, hashing, minhash, substring
from bandwise.llm.scratch import recording

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _row(i, text, lang="en"):
    return (i, text, lang, "s", len(text or ""))


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(pick.choices(vocabulary, k=n)) for n in (120, 150, 90, 200, 80, 70)]
    near = base[0].split()
    near[60] = "changed"
    passage = " ".join(pick.choices(vocabulary, k=60))
    texts = [*base, base[1], base[1], " ".join(near), None, "", " \n", "few words only",
             f"{base[2]}\nhead one\n{passage}\ntail", f"other start\n{passage}\nother end here", passage]
    out = [_row(i, t) for i, t in enumerate(texts)]
    return out + [out[3], _row(None, base[4]), _row(2, base[5])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


def _plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_exact_copies_by_brute_force(spark, docs, rows):
    got = _plain(corpus_pipeline.exact_copies(spark, docs, ""))
    best = {}
    for r in rows:
        key = r[1] or ""
        best[key] = max(best.get(key, (-1,)), (r[0] if r[0] is not None else -1,))
    assert sorted((r[0] if r[0] is not None else -1, r[1] or "") for r in got) == sorted((i, t) for t, (i,) in best.items())


def test_near_copies_by_brute_force(spark, docs, rows):
    def shingles(text):
        w = _words(text.translate({i: i + 32 for i in range(65, 91)}) if text else "")
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) or a == b:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    want = sorted((r for r in rows if r[0] is None or find(r[0]) == r[0]), key=repr)
    assert _plain(corpus_pipeline.near_copies(spark, docs, "")) == want


def test_repeated_passages_by_brute_force(spark, docs, rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, removed = set(), {}
    for k in order:
        w, gone = _words(rows[k][1]), set()
        for i in range(len(w) - 49):
            if tuple(w[i:i + 50]) in seen:
                gone |= set(range(i, i + 50))
            seen.add(tuple(w[i:i + 50]))
        removed[k] = gone
    # rows of one id come in the order of their blocks, so only ids that occur once are compared
    once = {i for i, n in collections.Counter(r[0] for r in rows).items() if n == 1}
    want = {}
    for k, gone in removed.items():
        w = _words(rows[k][1])
        if rows[k][0] in once and (not gone or len(gone) < len(w)):
            want[rows[k][0]] = [x for i, x in enumerate(w) if i not in gone]
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, "").collect() if r.doc_id in once}
    assert {i: _words(r.text) for i, r in got.items()} == want
    for i, r in got.items():
        whole = next(x[1] for x in rows if x[0] == i)
        if len(want[i]) == len(_words(whole)):
            assert r.text == whole


def _folder(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_a_second_run_leaves_the_first_result_alone(spark, docs, scratch):
    path = _folder(spark, scratch, docs, [(i, 1, 0) for i in range(6)])
    first = corpus_pipeline.run(spark, path)
    again = corpus_pipeline.run(spark, path)
    spark_docs = spark.read.parquet(f"{path}/documents.parquet")
    corpus_pipeline.quality_classifier(spark, spark_docs, path)
    assert _plain(first.select("doc_id", "start", "length")) == _plain(again.select("doc_id", "start", "length"))
    assert first.count() > 0


def test_a_run_deletes_what_its_stages_left(spark, docs, scratch):
    path = _folder(spark, scratch, docs, [])
    with recording() as made:
        out = corpus_pipeline.run(spark, path)
    left = [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert made and all("pieces" in p or "rests" in p for p in left)  # what the last stage's lazy result reads
    assert out.count() > 0


def test_empty_tables(spark, scratch):
    path = _folder(spark, scratch, spark.createDataFrame([], DDL), [])
    assert corpus_pipeline.run(spark, path).collect() == []


def _thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_colliding_words(spark, n):
    """Words that agree under every polynomial hash modulo a power of two."""
    one, two = _thue_morse(n), _thue_morse(n, "b", "a")
    words = hashing.Words([f"{one} {two}".encode()], 2)
    assert all(h[0] != h[1] for h in words.hashes)
    docs = spark.createDataFrame([(0, f"x y z {one}"), (1, f"x y z {two}")], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(docs, width=4).collect()} == {0, 1}
    tail = " ".join(f"t{i}" for i in range(19))
    docs = spark.createDataFrame([(0, f"{one} {tail}"), (1, f"{two} {tail}")], "doc_id long, text string")
    assert {r.n_removed for r in substring.remove_passages(docs).collect()} == {0}


@pytest.mark.parametrize("size", [1e-200, 1e-30, 1.0, 1e100, 1e150])
def test_neighbours_of_extreme_size(spark, size):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(120, 8)) * size
    vectors[::3] *= draw.choice([1e-12, 1e-3, 1.0, 1e5], size=(40, 1))
    data = [(i, v.tolist(), "x", -1.0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, query_id string, score double")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, k=5, block=32, query_block=4).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in range(0, 120, 20):
        scores = np.cumsum(vectors[q] * vectors, axis=1)[:, -1]
        order = sorted((i for i in range(120) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert sorted(got[q]) == [(k, i, scores[i]) for k, i in enumerate(order, 1)]


def test_neighbours_whose_products_overflow(spark):
    data = [(i, [1e200 * (i + 1), 1e199]) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    rows = ann.nearest(df, k=4, block=16).collect()
    assert len(rows) == 3 * 4 and all(r.score == float("inf") for r in rows)
    assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 0] == [1, 2, 3, 4]


def test_repeated_vectors_and_extra_columns(spark):
    data = [(1, [1.0, 2.0], "a"), (1, [3.0, 1.0], "b"), (20, [1.0, 1.0], "c"), (20, [0.5, 9.0], "d"), (5, [2.0, 2.0], "e")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).collect())
    # a repeated query id asks with the smaller of its vectors; its own rows are no neighbours
    assert got == [(20, 1, 5, 19.0), (20, 2, 1, 18.5), (20, 3, 1, 10.5)]


def test_words_are_found_alike():
    pick = random.Random(2)
    texts = ["".join(pick.choices("ab \t\n\x0bé", k=60)).encode() for _ in range(50)] + [b"", b" ", b"x"]
    words = hashing.Words(texts, 2)
    flat = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    assert words.n == len(flat) and words.counts.tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in texts]
    by_word = {w: tuple(h[i] for h in words.hashes) for i, w in enumerate(flat)}
    assert all(by_word[w] == tuple(h[i] for h in words.hashes) for i, w in enumerate(flat))
    assert len(set(by_word.values())) == len(by_word)
