"""Collocations against brute force, with collisions forced, and their edge cases."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, best=2000, longest=5):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    counts, totals, where = Counter(), Counter(), {}
    for doc_id, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            ws = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(ws)
            for n in range(1, longest + 1):
                for p in range(len(ws) - n + 1):
                    key = (lang, tuple(ws[p:p + n]))
                    counts[key] += 1
                    where[key] = min(where.get(key, doc_id), doc_id)
    good = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    covered = {}
    for (lang, ws), a in good.items():
        for n in range(2, len(ws)):
            for p in range(len(ws) - n + 1):
                key = (lang, ws[p:p + n])
                covered[key] = max(covered.get(key, 0), a)
    out = []
    for lang in totals:
        ranked = []
        for (own, ws), a in good.items():
            if own != lang or covered.get((lang, ws), 0) >= a:
                continue
            cuts = [(1000 * a * totals[lang] // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(ws).encode(), counts[lang, ws[:k]], counts[lang, ws[k:]], where[lang, ws]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s, d) for i, (s, a, p, left, right, d) in enumerate(sorted(ranked)[:best])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for k in range(120):
        words = [f"W{int(i)}" if rng.random() < 0.1 else f"w{int(i)}" for i in rng.zipf(1.6, int(rng.integers(0, 80))) % 40]
        if k % 3 == 0:
            words += "New york stock exchange é ende".split()
        text = "".join(w + str(rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r", "\x0b"])) for w in words)
        out.append((k, text, [None, "en", "de"][k % 3]))
    return [*out, (500, None, "en"), (501, "", "en"), (502, " .,; ", "fr"), (3, "w1 w1 w1 w1 w1 w1 w1", "en"), (3, "w1 w1 w1 w1 w1 w1 w1", "en"),
            (503, "x " * 20_000, "en")]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "a", "l", "phrase", "size", "fp", "k", "score")})
    return sorted(map(tuple, co.collocations(df, **kw).collect()))


@pytest.mark.parametrize("best", [2000, 7])
def test_equals_brute_force(spark, rows, best):
    got = run(spark, rows, least=8, best=best)
    assert got == brute(rows, 8, best) and len(got) > 15


def in_process(rows, least, at_most):
    """Counts of all frequent phrases by the task functions alone, with the sums that the shuffles form."""
    def batches():
        for k in range(0, len(rows), 25):
            part = rows[k:k + 25]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[2] or "und" for r in part]),
                                              pa.array([r[1] for r in part], pa.string())], names=["doc_id", "lang", "text"])

    def sieve(sizes, before, inner):
        sums = Counter()
        for b in co.count_rows(batches(), sizes, before, inner, at_most):
            for fp, n in zip(b["fp"].to_pylist(), b["n"].to_pylist(), strict=True):
                sums[fp] += n
        bits = np.zeros(1 << 10, np.uint64)
        for fp in (x for x, n in sums.items() if n >= least):
            bits[(fp >> 6) & 1023] |= np.uint64(1) << np.uint64(fp & 63)
        return co.Sieve(bits, 1 << 10)

    one = sieve((1,), None, 0)
    two = sieve((2,), one, 1)
    more = sieve((3, 4, 5), two, 2)
    sums, first = Counter(), {}
    for b in co.phrase_rows(batches(), [one, two, more, more, more]):
        for lang, phrase, size, f, doc in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sums[lang, phrase, size] += f
            first[lang, phrase] = min(doc, first.get((lang, phrase), doc))
    return {k: (f, first[k[:2]]) for k, f in sums.items() if k[2] and f >= least}


@pytest.mark.parametrize("at_most,part,prints", [(1 << 20, 4 << 20, 0), (50, 300, 0), (50, 300, 61)])
def test_task_counts_hold_in_small_parts_and_under_collisions(rows, monkeypatch, at_most, part, prints):
    want = {}
    for doc, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").encode().lower().decode()):
            ws = re.findall(r"[^ \t]+", piece)
            for n in range(1, 6):
                for p in range(len(ws) - n + 1):
                    key = (lang or "und", " ".join(ws[p:p + n]), n)
                    f, d = want.get(key, (0, doc))
                    want[key] = (f + 1, min(d, doc))
    monkeypatch.setattr(co, "PART", part)
    whole = co.mix64
    if prints:  # so few fingerprints that all collide
        monkeypatch.setattr(co, "mix64", lambda x: whole(x) % np.uint64(prints))
    assert in_process(rows, 8, at_most) == {k: v for k, v in want.items() if v[0] >= 8}


def test_word_numbers_do_not_rest_on_hashes():
    words = co.Words(b"aa bb cc aa bb. cc dd", co.Rolling(7))
    words.hashes = np.zeros(len(words), np.uint64)  # every word collides
    assert words.numbers().tolist() == [0, 1, 2, 0, 1, 2, 3]
    full = co.Sieve(np.full(4, ~np.uint64(0)), 4)
    assert full(np.arange(1000, dtype=np.uint64)).all()


def test_whole_numbers_beyond_64_bits(spark):
    # a * n * 1000 passes 64 bits here; the product is formed as the query forms it.
    df = spark.sql("SELECT 4000000000000 a, 9000000000000000 n, 5000000000000 l, 7000000000000 r")
    got = df.select(F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * 1000) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")).first()[0]
    assert got == 1000 * 4000000000000 * 9000000000000000 // (5000000000000 * 7000000000000)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == []
