"""Near-dedup and substring dedup against brute force, and their edge cases."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from shelfcast.llm import neardup, substrings
from tests.llm.tables import documents, words

EMPTY = hashlib.sha256(b"").hexdigest()


def edited(rng, base, share):
    out = list(base)
    for k in rng.choice(len(out), int(share * len(out)), replace=False):
        out[k] = f"e{int(rng.integers(1 << 30))}"
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def brute_components(docs, threshold):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(7)
    base = words(rng, 150)
    texts = [" ".join(words(rng, int(n))) for n in rng.integers(1, 200, 40)]
    texts += [" ".join(edited(rng, base, s)) for s in rng.uniform(0, 0.06, 150)]  # a group beyond one block
    texts += [" ".join(base)] * 5 + [" ".join(base).upper(), "a b c", "A  b\tc", "a b d", "one", "", " \n", None]
    passage = " ".join(words(rng, 60))
    texts += [f"{' '.join(words(rng, 30))} {passage} {' '.join(words(rng, 20))}" for _ in range(6)]
    texts.append(" ".join(words(rng, 30_000)))
    order = rng.permutation(len(texts))
    return [(int(k), texts[k]) for k in order]


@pytest.mark.parametrize("threshold", [85, 80])
def test_components_equal_brute_force(spark, corpus, threshold):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(spark, corpus), threshold).collect()}
    assert got == brute_components(corpus, threshold)


def test_signature_meets_at_least_one_band():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(200):
        common = rng.integers(0, 1 << 63, 85).astype(np.uint64)
        a, b = (np.unique(np.concatenate((common, rng.integers(0, 1 << 63, n).astype(np.uint64)))) for n in (8, 7))
        x, y = (neardup.band_hashes(neardup.min_max_signature(s)) for s in (a, b))
        missed += not (x == y).any()
    assert missed == 0


def test_keep_one_keeps_columns_and_clean_rows(spark, corpus):
    docs = documents(spark, corpus)
    kept = neardup.keep_one(docs)
    expected = {d for d, (_, _, kept_) in brute_components(corpus, 80).items() if kept_}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == expected


def test_repeated_and_null_ids(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "a b c d e f g")])
    got = sorted(map(str, neardup.near_duplicates(docs).collect()))
    assert len(got) == 4
    assert sum("component_id=None" in r for r in got) == 1
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def brute_removed(docs):
    seen, out = {}, {}
    for d, t in sorted(docs):
        w = (t or "").encode().split()
        gone, new = [False] * len(w), []
        for k in range(len(w) - 49):
            window = tuple(w[k:k + 50])
            if window in seen:
                gone[k:k + 50] = [True] * 50
            else:
                new.append(window)
        seen.update((x, d) for x in new)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_removed_words_equal_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed_words(documents(spark, corpus)).collect()}
    assert got == brute_removed(corpus)
    assert sum(n > 0 for _, n, _ in got.values()) > 100


def test_cover_is_a_difference_cover():
    residues = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert residues == set(range(substrings.PERIOD))


def test_cut_documents_change_only_what_repeats(spark, corpus):
    docs = documents(spark, corpus)
    out = substrings.cut_documents(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    expected, before = brute_removed(corpus), dict(corpus)
    for r in out.collect():
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == expected[r.doc_id][2]
        if not expected[r.doc_id][1]:
            assert r.text == before[r.doc_id]


def test_substring_edge_rows(spark):
    long = " ".join(f"x{k}" for k in range(80))
    docs = documents(spark, [(5, long), (5, long), (None, long), (7, long.replace(" ", "\n")), (8, None), (9, "")])
    got = sorted(map(tuple, substrings.removed_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    whole = hashlib.sha256(long.encode()).hexdigest()
    assert got == sorted([(5, 80, 0, whole), (5, 80, 0, whole), (None, 80, 0, whole), (7, 80, 80, EMPTY), (8, 0, 0, EMPTY), (9, 0, 0, EMPTY)], key=str)
    assert substrings.removed_words(documents(spark, [])).count() == 0
    assert substrings.cut_documents(documents(spark, [])).count() == 0
