"""The toxicity score against a plain loop, and the mix's choice among rows that repeat an id."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from shelfcast.llm import mixing, toxicity
from tests.llm.tables import documents

_MASK = (1 << 64) - 1


def _mixed(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
    return x ^ x >> 31


def _word_margin(word, margins):
    """The mean margin of a word's n-grams, between marks, and of the word as a whole."""
    marked, hashes = b"<" + word + b">", [zlib.crc32(word) | 1 << 40]
    for n in toxicity.GRAMS:
        for at in range(len(marked) - n + 1):
            h = 0
            for byte in marked[at:at + n]:
                h = (h * 257 + byte + 1) & _MASK
            hashes.append(_mixed((h + (n << 56)) & _MASK))
    return sum(margins[_mixed(h) % toxicity.BUCKETS] for h in hashes) / len(hashes)


def _score(text, model):
    words = [_word_margin(w, model.margins) for w in text.lower().split()]
    z = model.bias + (math.log(sum(math.exp(w) for w in words)) if words else 0.0)
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_loop_over_words():
    rng = np.random.default_rng(6)
    model = toxicity.ToxicityModel(rng.normal(size=toxicity.BUCKETS), -2.0)
    letters = [chr(c) for c in range(97, 105)] + ["é", "\U0001f600", "Z", "-"]
    vocabulary = ["".join(rng.choice(letters, int(n))) for n in rng.integers(1, 12, 300)] + ["a", "<>", "x" * 500]
    texts = ["", " \t\n", "a", *(" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(1, 200, 60))]
    score = model.scorer()
    for part in (texts, texts[::-1]):  # the second time from the cache
        got = score([t.encode() for t in part])
        assert np.allclose(got, [_score(t.encode(), model) for t in part], rtol=1e-9, atol=0)


def test_repeated_ids_give_the_same_texts_in_any_order(spark):
    """Rows with one id, source and length but different texts: which of them the mix repeats is set by their texts."""
    texts = [(k % 5, f"w{k} x y z") for k in range(40)] + [(100 + k, "p q") for k in range(60)]
    sources = [f"s{t[0] % 3}" for t in texts]
    seen = []
    for step in (1, -1):
        docs = documents(spark, texts[::step], sources[::step], clashing=False).repartition(3 if step > 0 else 7)
        seen.append(Counter(r.text for r in mixing.mixed_documents(docs).collect()))
    assert seen[0] == seen[1] and len(set(seen[0].values())) > 1
