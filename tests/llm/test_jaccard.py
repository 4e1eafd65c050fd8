import random
import re

import pytest

from sediment.llm import components as components_
from sediment.llm import ngram_join
from sediment.llm.ngram_join import jaccard_components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[k : k + 5]) for k in range(len(words) - 4)])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), top(i)) for i, s in sets), key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(docs).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def corpus(seed, n_base=8, copies=9, edits=8, length=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=30)
    rows = []
    for b in range(n_base):
        base = rng.choices(vocabulary, k=length)
        if b % 2:
            base[5:35] = passage
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(length)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 4)])
def test_components_match_brute_force(spark, monkeypatch, seed, block):
    """Ordinary settings, and tiny blocks so that block pairs of groups and clusters run."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CLUSTER_BLOCK", block)
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "one two three four five six"), (7, "one two three four five six"), (8, "word " * 3000), (9, "WORD " + "word " * 3000)]
    got = run(spark, [*rows, (None, "a b")])
    assert (None, 1, None) in got
    assert [r for r in got if r[0] is not None] == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 2, 7), (7, 2, 7), (8, 1, 8), (9, 2, 9)], key=str)
    assert run(spark, [])== []


def test_null_id_before_the_same_text(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(None, text), (1, text), (2, text + " more")], "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()), key=str)
    assert got == [(1, 36, 1), (2, 37, 1), (None, 36, None)]


@pytest.mark.parametrize("one_task", [0, 40, 10_000])
def test_components_of_any_graph(spark, monkeypatch, one_task):
    """Contraction alone, contraction and one task, one task alone: paths, stars and random edges."""
    monkeypatch.setattr(components_, "ONE_TASK", one_task)
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 60)] + [(200, 200 + k) for k in range(1, 30)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (500, 501), (501, 500)]
    order = list(range(600))
    rng.shuffle(order)
    edges = [(order[a], order[b]) for a, b in edges]
    parent = list(range(600))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.root for r in components_.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in nodes}
