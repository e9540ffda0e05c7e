"""The signature tree join against brute force, the trees' bounds, and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import links, ngram_join
from tests.llm.tables import documents, words
from tests.llm.test_dedup import brute_components, edited


def some_sets(rng, n, size=60):
    """Sets around a few centres, with links, near misses and strangers."""
    out = []
    centres = [rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2) for _ in range(4)]
    for k in range(n):
        own = centres[k % 4].copy()
        gone = rng.choice(size, int(rng.integers(0, size // 5)), replace=False)
        own[gone] = rng.integers(0, 1 << 63, len(gone)).astype(np.uint64)
        out.append(np.unique(own[: int(rng.integers(size // 2, size + 1))]))
    return [*out, np.array([5], np.uint64), np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))]


def joined(n, pairs):
    forest = links.Forest(n)
    for a, b in pairs:
        forest.join(a, b)
    return [min(k for k in range(n) if forest.root(k) == forest.root(x)) for x in range(n)]


@pytest.mark.parametrize("n,threshold", [(1, 80), (3, 80), (97, 80), (97, 95)])
def test_dual_traversal_loses_no_link(n, threshold):
    sets = some_sets(np.random.default_rng(n), n)
    every = [(a, b) for a in range(len(sets)) for b in range(a) if links.links(sets[a], sets[b], threshold)]
    assert joined(len(sets), ngram_join.linked_by_trees(sets, None, threshold)) == joined(len(sets), every)
    cut = len(sets) // 3
    across = [(a, b) for a, b in every if b < cut <= a]
    got = [(a, b + cut) for a, b in ngram_join.linked_by_trees(sets[:cut], sets[cut:], threshold)] if cut else []
    assert joined(len(sets), got) == joined(len(sets), across)


def test_bounds_leave_strangers_out():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2)) for _ in range(128)]
    tree = ngram_join.SignatureTree(sets, 1024)
    i, _ = ngram_join.candidates(tree, None, 80)
    assert len(i) == 0  # no pair of 8128 comes to the exact comparison


def test_a_bound_holds_for_saturated_bitmaps():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    sets = [base, np.unique(np.concatenate((base[:4800], rng.integers(0, 1 << 63, 200).astype(np.uint64))))]
    tree = ngram_join.SignatureTree(sets, 256)
    assert len(ngram_join.candidates(tree, None, 80)[0]) == 1


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(17)
    base = words(rng, 120)
    texts = [" ".join(words(rng, int(n))) for n in rng.integers(1, 150, 30)]
    texts += [" ".join(edited(rng, base, s)) for s in rng.uniform(0, 0.06, 120)]
    chain = list(base)
    for k in range(25):  # each links with the next ones, the ends do not
        chain = [*chain[4:], *words(rng, 4)]
        texts.append(" ".join(chain))
    texts += [" ".join(base)] * 5 + [" ".join(base).upper(), "a b c", "A  b\tc", "a b d", "one", "", " \n", None, " ".join(words(rng, 20_000))]
    order = rng.permutation(len(texts))
    return [(int(k), texts[k]) for k in order]


@pytest.mark.parametrize("block,leaders", [(128, 4), (8, 1)])
def test_components_equal_brute_force(spark, corpus, monkeypatch, block, leaders):
    monkeypatch.setattr(links, "BLOCK", block)
    monkeypatch.setattr(links, "LEADERS", leaders)
    monkeypatch.setattr(links, "SLICE", 4 * block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(documents(spark, corpus)).collect()}
    assert got == {d: (n, c) for d, (n, c, _) in brute_components(corpus, 80).items()}


def test_repeated_null_and_no_rows(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "a b c d e f"), (4, None), (5, "")])
    got = sorted(map(tuple, ngram_join.jaccard_join(docs).collect()), key=str)
    assert got == sorted([(1, 2, 0), (1, 2, 0), (None, 2, None), (0, 2, 0), (4, 0, 4), (5, 0, 5)], key=str)
    assert ngram_join.jaccard_join(documents(spark, [])).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 200 + k) for k in range(50)] + [(5, 5)]
    got = dict(map(tuple, links.components(spark.createDataFrame(edges, "u long, v long").withColumn("x", F.lit(1))).collect()))
    assert got == {k: 100 for k in range(101, 161)} | {200 + k: 7 for k in range(50)}
