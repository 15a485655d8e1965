"""The set similarity join above its leaves, against the similarity of all pairs."""

import random

import numpy as np
import pytest
from test_operators import components_of, words

from larkspur.llm import minhash_dedup
from larkspur.llm.components import components
from larkspur.llm.workspace import Scratch


def family(rng, base, n, most):
    """Copies of a text with up to ``most`` of its words changed: near its base, less near one another."""
    out = []
    for _ in range(n):
        w = base.split()
        for i in rng.sample(range(len(w)), rng.randint(0, most)):
            w[i] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def recall(spark, texts, shingle):
    want, _ = components_of(texts, shingle, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, shingle).collect()}
    linked = [i for i, c in enumerate(want) if c != i]
    assert all(want[got[i]] == want[i] for i in got), "a link that similarity does not give"
    return np.mean([got[i] == want[i] for i in linked])


@pytest.mark.parametrize(("leaf", "depth"), [(2048, 40), (40, 40), (40, 1)])
def test_recall(spark, leaf, depth, monkeypatch):
    """Nodes that are compared at once, that are branched many times, and that end in blocks."""
    monkeypatch.setattr(minhash_dedup, "LEAF", leaf)
    monkeypatch.setattr(minhash_dedup, "DEPTH", depth)
    rng = random.Random(21)
    texts = [words(rng, rng.randint(5, 60)) for _ in range(60)]
    texts += family(rng, words(rng, 80), 120, 14) + family(rng, words(rng, 80), 60, 4)
    for _ in range(20):
        texts += family(rng, words(rng, 50), 2, 3)
    assert recall(spark, texts, 2) >= (0.99 if leaf > 40 or depth == 1 else 0.95)


def test_cells_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TOKENS", 500)
    rng = random.Random(22)
    assert recall(spark, family(rng, words(rng, 100), 40, 3) + [words(rng, 30), None, ""], 2) >= 0.95


def test_near_copies_of_all_texts_of_a_repeated_id(spark):
    rng = random.Random(23)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (1, b), (7, a + " tail"), (8, b + " tail"), (9, words(rng, 60)), (9, None), (None, a), (3, a), (3, a)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (3, 1), (3, 1), (7, 1), (8, 1), (9, 9), (9, 9)]


def test_very_long_texts(spark):
    rng = random.Random(24)
    long = words(rng, 200_000)
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_all_columns_stay(spark):
    rng = random.Random(25)
    t = words(rng, 50)
    docs = spark.createDataFrame([(1, t, 1, 2, 3), (2, t + " x", 4, 5, 6), (None, None, 7, 8, 9)], "doc_id long, text string, component_id int, rep int, `n.chars` int")
    got = minhash_dedup.drop_near_duplicates(docs)
    assert got.columns == docs.columns and sorted(r["component_id"] for r in got.collect()) == [1, 7]
    assert minhash_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(26)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)] + [(7, 7)]
    root = {x: x for pair in links for x in pair}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(links, "a long, b long")
    with Scratch(spark) as scratch:
        got = {r["node"]: r["component"] for r in components(frame, scratch).collect()}
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in links)}
