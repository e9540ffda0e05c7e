"""What the tasks of the collocations hand to the shuffles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from shelfcast.llm import collocations as co


def batches():
    for k in range(20):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array(["en"]), pa.array(["new york stock exchange"])], names=["doc_id", "lang", "text"])


def test_a_phrase_of_many_parts_is_one_row(monkeypatch):
    monkeypatch.setattr(co, "PART", 10)  # every text is a part of its own
    full = co.Sieve(np.full(4, ~np.uint64(0)), 4)
    got = [tuple(r.values()) for b in co.phrase_rows(batches(), [full] * 2) for r in b.to_pylist()]
    assert len(got) == 8 and ("en", "new york", 2, 20, 0) in got and ("en", None, 0, 80, 0) in got
    monkeypatch.setattr(co, "TEXTS", 3)
    few = [tuple(r.values()) for b in co.phrase_rows(batches(), [full] * 2) for r in b.to_pylist()]
    assert len(few) == 160 and sum(r[3] for r in few if r[1] == "new york") == 20


def test_counts_are_sorted_rows_of_short_fingerprints():
    rows = [b for b in co.count_rows(batches(), (1, 2), None, 0, co.KEPT)]
    assert [b.schema.names for b in rows] == [["fp", "n"]]
    fp = rows[0]["fp"].to_pylist()
    assert fp == sorted(fp) and 0 <= fp[0] and fp[-1] < 1 << co.PRINT_BITS and rows[0]["n"].to_pylist() == [20] * 7


def test_a_phrase_is_written_where_its_first_document_lies(spark, monkeypatch):
    """However many tasks have it, a frequent phrase is one row of the last pass."""
    made = []
    stored = co.written
    monkeypatch.setattr(co, "written", lambda df, what: made.append((what, stored(df, what))) or made[-1][1])
    texts = ["new york stock exchange"] * 40 + ["Old york stock. exchange"] * 9
    rows = spark.sparkContext.parallelize([(k, t, "en") for k, t in enumerate(texts)], 7)  # 7 tasks of 7 documents
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, totals = co.frequent_phrases(docs, least=10)
    got = {r.phrase: (r.size, r.f, r.doc_id) for r in counts.collect()}
    assert got == {"new": (1, 40, 0), "york": (1, 49, 0), "stock": (1, 49, 0), "exchange": (1, 49, 0), "new york": (2, 40, 0), "york stock": (2, 49, 0),
                   "stock exchange": (2, 40, 0), "new york stock": (3, 40, 0), "york stock exchange": (3, 40, 0), "new york stock exchange": (4, 40, 0)}
    assert totals.collect() == [("en", 196)]
    assert sum(r.f for r in dict(made)["texts"].where("size > 0").collect()) == 10 * 7  # written by the first task only


def joined(rows, least):
    """The frequent phrases by the task functions alone, with the sums and the join that Spark forms."""
    counted, sieves = {}, []

    def sieve(prints):
        bits = np.zeros(1 << 10, np.uint64)
        for fp in prints:
            bits[(int(fp) >> 6) & 1023] |= np.uint64(1) << np.uint64(int(fp) & 63)
        return co.Sieve(bits, 1 << 10)

    def parts():
        for doc, text in rows:
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array(["en"]), pa.array([text])], names=["doc_id", "lang", "text"])

    for sizes in [(1,), (2,), (3,), (4, 5)]:
        sums = {}
        for b in co.count_rows(parts(), sizes, sieves[-1] if sieves else None, sizes[0] - 1, 50, True):
            for fp, n, check, doc in zip(*(c.to_pylist() for c in b.columns), strict=True):
                had = sums.get((fp, check), (0, doc))
                sums[fp, check] = (had[0] + n, min(had[1], doc))
        sums = {k: v for k, v in sums.items() if v[0] >= least}
        sieves += [sieve(fp for fp, _ in sums)] * len(sizes)
        counted |= sums
    table = pa.RecordBatch.from_arrays([pa.array([k[0] for k in counted], pa.int64()), pa.array([v[1] for v in counted.values()], pa.int64())], names=["fp", "doc_id"])
    firsts = sieve(x & ((1 << 64) - 1) for b in co.pointer_rows(iter([table])) for x in b["fp"].to_pylist())
    found = {}
    for b in co.phrase_rows(parts(), sieves, firsts):
        for _, phrase, size, _, doc, fp, check in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size and counted.get((fp, check), (0, None))[1] == doc:
                found[phrase] = counted[fp, check]
    return found


def test_counts_hold_when_the_first_fingerprints_collide(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(k), " ".join(f"w{i}" for i in rng.zipf(1.6, 60) % 30)) for k in rng.integers(0, 40, 60)]
    want = {}
    for doc, text in rows:
        ws = text.split()
        for n in range(1, 6):
            for p in range(len(ws) - n + 1):
                f, d = want.get(" ".join(ws[p:p + n]), (0, doc))
                want[" ".join(ws[p:p + n])] = (f + 1, min(d, doc))
    want = {k: v for k, v in want.items() if v[0] >= 8}
    monkeypatch.setattr(co, "PART", 300)
    assert joined(rows, 8) == want and len(want) > 100
    monkeypatch.setattr(co.Fingerprints, "__call__", lambda self, words, lang, n: words.hashes[: max(0, len(words) - n + 1)] % np.uint64(61))
    assert joined(rows, 8) == want
