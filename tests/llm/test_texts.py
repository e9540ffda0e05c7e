"""Toxicity, license scan, mixing, fingerprints and pieces: brute force, round trips, held-out accuracy, edge cases."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import license_texts, licenses, mixing, phrases, pieces, toxicity
from tests.conftest import SF_CHECK
from tests.llm.tables import documents, words

EDGE = [None, "", " \n\t ", "a", "one two three", "long " * 60_000, "naïve ▁ 日本 \U0001f600 é", "same text", "same text", (7, "same text")]


# --- toxicity ---------------------------------------------------------------

def test_held_out_accuracy_and_label_blindness(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    hits = [r.predicted == r.toxic for r in rows]
    assert np.mean(hits) >= 0.95
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) <= 0.03
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.fit(docs, flipped).margins, model.margins)


def test_unseen_misspelling_shares_grams():
    rng = np.random.default_rng(3)
    texts = [" ".join(words(rng, 40)) for _ in range(400)]
    toxic = [k % 2 for k in range(400)]
    texts = [t + " scoundrel" * y for t, y in zip(texts, toxic, strict=True)]
    score = toxicity.train([t.encode() for t in texts], toxic).scorer()
    seen, misspelt, clean = score([b"w1 scoundrel w2", b"w1 scoundrell w2", b"w1 w3 w2"])
    assert seen > 0.5 > clean and misspelt > 0.5


def test_score_does_not_depend_on_cache_or_batch():
    model = toxicity.ToxicityModel(np.random.default_rng(0).normal(size=toxicity.BUCKETS), -1.0)
    texts = [b"a bb ccc", b"", b"a", b"ccc " * 500]
    together = model.scorer()(texts)
    alone = [model.scorer()([t])[0] for t in texts]
    assert np.allclose(together, alone) and together[1] == pytest.approx(1 / (1 + np.e))


def test_folds_follow_crc32(spark):
    rows = toxicity.score_documents(documents(spark, ["x"] * 30), toxicity.train([], [])).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_sample_is_bounded_by_bytes_before_it_is_collected(spark, monkeypatch):
    """Long toxic texts are left out, by no order of ids, and the classes keep their shares."""
    texts = [("t " * 500 if k % 2 else "c " * 5) for k in range(200)] + ["long " * 4000] * 2
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(r.doc_id, 1, int(len(r.text) > 10)) for r in docs.collect()], "doc_id long, quality int, toxic int")
    whole = toxicity.training_sample(docs, labels).collect()
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 20_000)
    rows = toxicity.training_sample(docs, labels).collect()
    assert sum(len(r.text) for r in rows) <= 20_000 < sum(len(r.text) for r in whole)
    for k in (0, 1):
        assert sum(r.weight for r in rows if r.toxic == k) == pytest.approx(sum(r.weight for r in whole if r.toxic == k))
    ids = sorted(r.doc_id for r in rows if r.toxic)
    assert 0 < len(ids) and ids != sorted(r.doc_id for r in whole if r.toxic)[:len(ids)]


def test_toxicity_edges(spark):
    docs = documents(spark, EDGE)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score < 0.5 and r.predicted == 0 for r in rows)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score_documents(documents(spark, []), model).count() == 0


# --- license scan -----------------------------------------------------------

def brute_base(text):
    w = licenses.words((text or "").encode())
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.encode().split()
        places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = "under the mit license apache version 2 cc by nc released licensed 0 foo bar".split()
    texts = [" ".join(rng.choice(pool, int(n))) for n in rng.integers(0, 400, 60)]
    texts += ["UNDER the MIT-license, cc by\nnc; cc by nc", "éunder the mit license", *EDGE]
    texts += ["under the " * 3 + "mit license apache license version 2 0"]
    docs = documents(spark, texts)
    got = {(r.doc_id, *r[1:6]) for r in licenses.scan_licenses(docs).collect()}
    assert got == {(r.doc_id, *brute_base(r.text)) for r in docs.collect()}
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def test_notices_are_found_with_gaps_and_not_by_fragments():
    auto = licenses.LicenseAutomaton()
    notice = next(text for label, text in license_texts.notices() if label == "gpl")
    w = [x.decode() for x in licenses.words(notice.encode())]
    whole = auto.scan(f"x {notice} y".encode())
    assert whole[5] == "gpl" and whole[6] == 1.0 and whole[7][0][1:3] == (1, 1 + len(w))
    assert auto.scan(" ".join(w[:9] + ["typo"] + w[10:]).encode())[5] == "gpl"
    assert auto.scan(" ".join(w[:8]).encode())[5] == ""
    assert auto.scan(b"licensed under the terms of use")[5] == ""


PROGRAM = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, "


@pytest.mark.parametrize(("text", "labels"), [
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "cc-by-3.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc-4.0"),
    ("This work is licensed under a Creative Commons Attribution-Non-Commercial 4.0 International License.", "cc-by-nc-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 2.5 License.", "cc-by-nc-nd-2.5"),
    ("This work is licensed under a Creative Commons Attribution 9.9 License.", ""),
    ("CC BY 4.0", "cc-by-4.0"),
    ("https://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa-3.0"),
    ("This work is licensed under the GNU General Public License version 2.", "gpl-2"),
    ("This work is licensed under the GNU General Public License version 3.", "gpl-3"),
    ("This work is licensed under a GNU General Public License version 3.", "gpl-3"),
    ("This work is licensed under the GNU General Public License version 1.", "gpl-1"),
    ("This work is licensed under the GNU General Public License version 9.", ""),
    ("This work is licensed under the GNU Lesser General Public License version 3.", "lgpl-3"),
    (PROGRAM.format("General Public License") + "either version 2 of the License, or (at your option) any later version", "gpl-2"),
    (PROGRAM.format("General Public License") + "either version 3 of the License, or (at your option) any later version", "gpl-3"),
    (PROGRAM.format("Lesser General Public License") + "either version 2.1 of the License", "lgpl-2.1"),
    (PROGRAM.format("Lesser General Public License"), "lgpl"),
    (PROGRAM.format("Affero General Public License") + "either version 3 of the License", "agpl-3"),
    ("Licensed under the Apache License, Version 1.1 (the License); you may not use this file except in compliance with the License", "apache-1.1"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache-2"),
    ("This work is licensed under the GNU General Public License version 2. This work is licensed under the GNU "
     "General Public License version 3.", "gpl-2,gpl-3"),
    ("This work is licensed under the GNU Lesser General Public License version 3. This work is licensed under the GNU "
     "General Public License version 3.", "gpl-3,lgpl-3"),
    ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3"),
    ("SPDX-License-Identifier: MIT", "mit"),
])
def test_near_licences_are_told_apart(text, labels):
    assert licenses.LicenseAutomaton().scan(f"x y {text} z".encode())[5] == labels


@pytest.mark.parametrize("every", [None, 23])
def test_whole_texts_give_their_own_label(every):
    """Every template gives its label and no other, also with every so many words of a long one misspelt."""
    auto = licenses.LicenseAutomaton()
    for label, text in license_texts.notices():
        w = [x.decode() for x in licenses.words(text.encode())]
        if every and len(w) < 3 * every:
            continue
        spoilt = ["typo" if every and k % every == 11 else x for k, x in enumerate(w)]
        found = auto.scan(f"Copyright 2020 {' '.join(spoilt)} end".encode())
        assert set(found[5].split(",")) - set(found[4].split(",")) <= {label} and label in {s[0] for s in found[7]}, (label, text, found)


def test_unaligned_equals_every_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (rng.integers(0, 3, int(n)).tolist() for n in rng.integers(0, 7, 2))
        only_a, only_b = licenses.unaligned(a, b)
        kept = [w for p, w in enumerate(a) if p not in only_a]
        assert kept == [w for p, w in enumerate(b) if p not in only_b]
        common = {c for n in range(len(a) + 1) for c in itertools.combinations(a, n)} & {c for n in range(len(b) + 1) for c in itertools.combinations(b, n)}
        assert len(kept) == max(map(len, common))


def brute_chains(auto, ids):
    """{(template, end, words covered, first word)} of the widest chain behind each run, by trying all of them."""
    out = []
    for k, t in enumerate(auto.templates):
        runs, gap = [], max(2, len(t) // 4)
        for end, at in itertools.product(range(1, len(ids) + 1), range(1, len(t) + 1)):
            n = 0
            while n < min(end, at) and ids[end - n - 1] == t[at - n - 1]:
                n += 1
            if n >= min(auto.min_run, len(t)) and not (end < len(ids) and at < len(t) and ids[end] == t[at]):
                runs.append((end, at, n))

        def ways(last):
            end, at, n = last
            yield n, end - n
            for was in runs:
                fresh = min(n, end - was[0], at - was[1])
                if fresh > 0 and end - fresh - was[0] <= gap:
                    for covered, first in ways(was):
                        yield covered + fresh, first

        out += [(k, end, *max(ways((end, at, n)))) for end, at, n in runs]
    return sorted(out)


def test_chains_equal_brute_force():
    rng = np.random.default_rng(12)
    longest = 0
    for _ in range(150):
        texts = [" ".join(rng.choice(list("abcdef"), int(n))) for n in rng.integers(3, 14, 4)]
        auto = licenses.LicenseAutomaton({"a b c": "p"}, [(f"l{k}", t) for k, t in enumerate(texts)], min_run=2)
        parts = []
        for _ in range(4):
            t = texts[int(rng.integers(0, 4))].split()
            at = int(rng.integers(0, len(t)))
            parts += t[at:at + int(rng.integers(1, 8))] + ["x"] * int(rng.integers(0, 4))
        ids = [auto.ids.get(w.encode()) for w in parts]
        reached = []
        for end in range(1, len(ids) + 1):  # the longest run of any template that ends here, by trying all lengths
            for n in range(end, 0, -1):
                state = 0
                for w in ids[end - n:end]:
                    state = auto.next[state].get(w, -1) if state >= 0 else -1
                if state > 0:
                    reached.append((end, n, state))
                    break
        got = sorted((k, end, covered, first) for covered, k, first, end, _ in auto.chains(ids, reached))
        assert got == brute_chains(auto, ids)
        longest = max([longest, *(n for _, n, _ in reached)])
        # The scan's own pass: every labelled span is one of these chains.
        spans = {(label, first, end) for label, first, end, _ in auto.scan(" ".join(parts).encode())[7]}
        assert spans <= {(auto.labels[k], first, end) for k, end, _, first in got}
    assert longest > 5


def test_a_run_that_another_template_continues_is_not_lost():
    auto = licenses.LicenseAutomaton({"q q q q": "q"}, (("long", "a b c d e f g h i"), ("short", "a b c x y z")))
    assert auto.scan(b"a b c d x y z")[7] == [("short", 0, 7, 1.0)]


def test_far_runs_are_no_chain():
    text = "this work is licensed under the gnu" + " x" * 6 + " general public license version 3"
    assert licenses.LicenseAutomaton().scan(text.encode())[5] == ""


def test_matching_statistics_equal_brute_force():
    """The automaton knows exactly the runs of consecutive template words."""
    auto = licenses.LicenseAutomaton({"a b a b c": "x", "b c a": "y"}, (("z", "c a b"),))
    runs = {tuple(t[i:j]) for t in auto.templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for n in range(1, 5):
        for word in itertools.product(range(len(auto.ids)), repeat=n):
            state = 0
            for w in word:
                state = auto.next[state].get(w, -1) if state >= 0 else -1
            assert (state >= 0) == (word in runs)


# --- mixing -----------------------------------------------------------------

def brute_targets(sizes, weights, share, cap):
    budget, open_, out = share * sum(sizes.values()), dict(weights), {}
    while open_:
        level = budget / sum(open_.values())
        full = [s for s, w in open_.items() if level * w > cap * sizes[s]]
        if not full:
            return out | {s: level * w for s, w in open_.items()}
        for s in full:
            out[s] = cap * sizes[s]
            budget -= out[s]
            del open_[s]
    return out


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(11)
    sources = [*rng.choice(["a", "B", "é", "z"], 300, p=[0.6, 0.1, 0.2, 0.1]).tolist(), *[None] * 20]
    texts = [" ".join(words(rng, int(n))) for n in rng.integers(0, 60, 300)] + ["x y"] * 18 + [None, ""]
    docs = documents(spark, texts, sources)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    sizes = {s: sum(len((t or "").split()) for t, u in zip(texts, sources, strict=True) if u == s) for s in set(sources)}
    order = [*sorted(s for s in sizes if s is not None), None]
    expected = brute_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(expected[s]) for r in own)
        assert abs(sum(r.taken for r in own) - expected[s]) <= 1
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in rows)


def test_mix_edges(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    rows = mixing.mix(documents(spark, [None, "", "  "])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3
    repeated = documents(spark, [(1, "a b"), (1, "a b"), (2, "c d e f")], ["s"] * 3)
    assert mixing.mixed_documents(repeated).count() == sum(r.copies for r in mixing.mix(repeated).collect())


def test_knapsack_finds_the_best_sum():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.choice(np.arange(1, 30), 4, replace=False).tolist()
        counts, budget = rng.integers(0, 4, 4).tolist(), int(rng.integers(0, 120))
        taken = mixing.knapsack(sizes, counts, budget)
        sums = {sum(s * k for s, k in zip(sizes, ks, strict=True)) for ks in itertools.product(*(range(c + 1) for c in counts))}
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert sum(s * t for s, t in zip(sizes, taken, strict=True)) == max(s for s in sums if s <= budget)


def test_fit_counts_fills_large_budgets_exactly():
    sizes, counts = list(range(1, 3000)), [7] * 2999
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    for target in (0.0, 1.0, total * 0.37, float(total), total * 1.9, total * 2.0):
        passes, extra = mixing.fit_counts(sizes, counts, target)
        assert passes * total + sum(s * e for s, e in zip(sizes, extra, strict=True)) == round(target)
        assert all(0 <= e <= n for e, n in zip(extra, counts, strict=True))


# --- phrase fingerprints ----------------------------------------------------

def brute_phrases(text):
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_follow_phrase_sets(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(words(rng, int(n), 300)) for n in rng.integers(0, 400, 60)] + [t for t in EDGE if not isinstance(t, tuple)]
    rows = sorted(phrases.fingerprints(documents(spark, texts)).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    whole = [t or "" for t in texts]
    errors = []
    for k, r in enumerate(rows):
        text, following = whole[k], whole[(k + 1) % len(whole)]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        errors += [r.near_edited - jaccard(brute_phrases(text), brute_phrases(changed)),
                   r.near_next - jaccard(brute_phrases(text), brute_phrases(following))]
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)
    assert max(map(abs, errors)) < 0.3 and abs(np.mean(errors)) < 0.06  # 64 permutations, the same for all texts
    by_text = {}
    for t, r in zip(whole, rows, strict=True):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint


def test_likeness_tends_to_the_jaccard_index(monkeypatch):
    monkeypatch.setattr(phrases, "VALUES", 8192)
    monkeypatch.setattr(phrases, "_FACTORS", phrases.mix64(np.arange(1, 8193, dtype=np.uint64) << np.uint64(20)) | np.uint64(1))
    rng, make = np.random.default_rng(6), phrases.PhraseFingerprint()
    for n in (20, 100, 300):
        a, b = (" ".join(words(rng, n, 200)) for _ in range(2))
        mine, other = make(a, len(a) // 2, b)
        assert abs(phrases.likeness(mine, other) - jaccard(brute_phrases(a), brute_phrases(a[: len(a) // 2] + b))) < 0.025
        assert abs(phrases.likeness(mine, make(b)[0]) - jaccard(brute_phrases(a), brute_phrases(b))) < 0.025


def test_edited_fingerprint_is_that_of_the_edited_text():
    make = phrases.PhraseFingerprint()
    for text, keep, tail in [("abcabcabd", 5, "abab"), ("a", 1, ""), ("", 0, ""), ("xyxyxyxy", 4, "xyxz"), ("aaaa", 2, "b")]:
        assert np.array_equal(make(text, keep, tail)[1], make(text[:keep] + tail if tail else text)[0])


def test_fingerprint_edges(spark):
    assert phrases.fingerprints(documents(spark, [])).count() == 0
    (one,) = phrases.fingerprints(documents(spark, ["abcdef"])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    rows = phrases.fingerprints(documents(spark, [(3, "x"), (3, "y"), (None, None)])).collect()
    assert len(rows) == 3


# --- pieces -----------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(pieces.MODEL)


def every_path(model, text):
    if not text:
        return [(0.0, [])]
    return [(score + s, [*ids, *arc]) for start, s, arc in model._arcs(text, len(text)) for score, ids in every_path(model, text[:start])]


@pytest.mark.parametrize("text", ["hello", "ab", "a cat", "über 1", "a▁b", "\n\tx", "日本", "  x", "aaaaa", " ", "\U0001f600!"])
def test_n_best_equals_all_paths(model, text):
    coder = pieces.Encoder(model, 6)
    ids, scores = coder.encode(text)
    marked = pieces.BLANK + text.replace(pieces.BLANK, pieces._LITERAL).replace(" ", pieces.BLANK)
    paths = sorted(every_path(model, marked), key=lambda p: -p[0])
    assert scores == pytest.approx([s for s, _ in paths[:6]])
    assert any(ids == p and s == pytest.approx(scores[0]) for s, p in paths)
    assert [s for s, _ in model.n_best(marked, 6)] == pytest.approx(scores)
    assert coder.decode(ids) == text


@pytest.mark.parametrize("text", ["hello", "ab", "a cat", "über 1", "a▁b", "日本", "  x", "aaaaa", " ", "\U0001f600!", ""])
def test_n_best_segmentations_are_the_best_paths(model, text):
    coder = pieces.Encoder(model, 6)
    got = coder.n_best(text)
    marked = pieces.BLANK + text.replace(pieces.BLANK, pieces._LITERAL).replace(" ", pieces.BLANK) if text else ""
    paths = {tuple(ids): s for s, ids in every_path(model, marked)}
    assert [s for s, _ in got] == pytest.approx(sorted(paths.values(), reverse=True)[:6])
    assert len({tuple(ids) for _, ids in got}) == len(got)
    assert all(paths[tuple(ids)] == pytest.approx(s) and coder.decode(ids) == text for s, ids in got)


def test_tied_segmentations_are_all_different():
    flat = pieces.PieceModel([("a", -1.0), ("aa", -2.0), ("aaa", -3.0), (pieces.BLANK, -1.0)], {b: 10 + b for b in range(256)})
    for text in ("aaa", "aaa aaa aa", "a a a", "a" * 300):
        got = pieces.Encoder(flat, 4).n_best(text)
        assert len({tuple(ids) for _, ids in got}) == len(got) == (1 if text == "a a a" else 4)
        assert all(pieces.Encoder(flat, 4).decode(ids) == text for _, ids in got)


def test_documents_have_all_their_segmentations(spark, model):
    docs = documents(spark, EDGE)
    coder = pieces.Encoder(model)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pieces.encode_documents(docs).collect():
        paths = pieces.segmentations(r.piece_ids, r.further_paths)
        assert len({tuple(p) for p in paths}) == len(paths) == len(r.n_best_scores)
        assert all(coder.decode(p) == texts[r.doc_id] for p in paths)
        assert paths == [ids for _, ids in coder.n_best(texts[r.doc_id])]
    assert not coder.same_text([model.ids["a"]], [[(0, 1, (model.ids["b"],))]])


def test_ties_and_long_chunks_stay_cheap():
    flat = pieces.PieceModel([("a", -1.0), ("aa", -2.0), ("aaa", -3.0), (pieces.BLANK, -1.0)], {b: 10 + b for b in range(256)})
    coder = pieces.Encoder(flat, 4)
    ids, scores = coder.encode("a" * 20_000)
    assert scores == pytest.approx([-20_001.0] * 4) and coder.decode(ids) == "a" * 20_000


def test_encode_documents(spark, model):
    docs = documents(spark, EDGE)
    rows = pieces.encode_documents(docs).collect()
    assert len(rows) == len(EDGE) and all(r.round_trip for r in rows)
    assert all(r.n_pieces == len(r.piece_ids) and r.n_best_scores == sorted(r.n_best_scores, reverse=True) for r in rows)
    assert [(r.n_pieces, r.score) for r in rows[:2]] == [(0, 0.0)] * 2
    assert pieces.encode_documents(documents(spark, [])).count() == 0


def test_unigram_scores_agree_with_the_library(model):
    """Same lattice, same best score as the model's own tokenizer's path can at most reach."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coder = pieces.Encoder(model)
    names = {i: p for p, i in model.ids.items()}
    for text in ("the quick brown fox", "Größe und Maß", "0.5 % of 12"):
        own = sum(model.scores[names[i]] if i in names else model.byte_score for i in sp.encode(text))
        assert coder.encode(text)[1][0] >= own - 1e-9
        assert sp.decode(coder.encode(text)[0]) == text
