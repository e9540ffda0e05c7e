"""Phrase collocations by Rabin-Karp fingerprints.

Texts are cut to words and pieces in array passes over their bytes. Prefix polynomials
(modulo 2**64) give the hash of every word, and over the words' hashes that of every n-gram.

1. Words are counted: a task counts what its part of the texts holds, and a shuffle adds up. Then pairs of words, but only those of
   two frequent words, then triples of frequent pairs, then the longer n-grams of frequent triples: no other can be frequent.
   ``PRINT_BITS`` bits of a fingerprint, which hold the sieve's, and ``CHECK_BITS`` of a second one tell n-grams apart. The second is made of
   random numbers for the words' bytes, so what collides in the first does not in it. A count has the smallest document as a pointer.
2. What is frequent reaches the tasks as a bit array of fixed size (``SIEVE_BITS``). An n-gram that it lets through
   by chance is counted for nothing; none is lost, however full it gets.
3. A last pass writes out texts, no counts: a second such array holds each frequent phrase with its smallest document, and only where
   that document lies is the phrase written, so there are as many rows as frequent phrases, however many tasks there are. (Where
   documents share an id, or have none, one for each of these parts.) A join with the counts drops what came by chance.
4. Scores are joins of the frequent phrases with themselves: both parts of a frequent phrase are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, mix64, utf8, written

LEAST, LONGEST, BEST = 100, 5, 2000
#: Bytes of text that an array pass takes (a part ends where a piece ends), and distinct n-grams a task keeps before it hands them on.
PART, KEPT = 4 << 20, 1 << 20
#: Different phrases whose texts a task keeps before it hands them on.
TEXTS = 1 << 18
#: Bits of a fingerprint that n-grams are counted by, the sieve's among them. Sorted, few of their bytes differ from row to row.
PRINT_BITS = 40
#: Bits of the second fingerprint. With 2**33 different n-grams, 2**24 of them frequent, two that share all 88 bits meet with a chance of 1e-9.
CHECK_BITS = 48
#: Size of the array that tells tasks what is frequent.
SIEVE_BITS = 27

_BLANK, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)] = 1
_KIND[list(_BREAK)] = 2
#: A number for each place in a word and byte there; places from a prime number on share those of the first.
_TABLES = mix64(np.arange(1, 251 * 256 + 1, dtype=np.uint64)).reshape(251, 256)


class Words:
    """Words and pieces of some bytes, as arrays; A-Z count as a-z."""

    def __init__(self, text: bytes, of_bytes: Rolling):
        self.text = text.lower()
        self.raw = np.frombuffer(self.text, np.uint8)
        kind = _KIND[self.raw]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        self.hashes = of_bytes.spans(self.raw.astype(np.uint64) + np.uint64(1), self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each place lie in one piece."""
        return self.piece[: len(self) - n + 1] == self.piece[n - 1:]

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.text[self.starts[k]:self.ends[k]] for k in range(at, at + n))

    def coded(self, which: np.ndarray | None = None) -> pa.DictionaryArray:
        """The bytes of all words, or of those that a mask names, each different word once."""
        size, inside = self.ends - self.starts, self.raw[_KIND[self.raw] == 0]
        if which is not None:
            inside, size = inside[np.repeat(which, size)], size[which]
        ends = np.cumsum(np.concatenate(([0], size)), dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(inside)]).dictionary_encode()

    def numbers(self) -> np.ndarray:
        """A number for each word, equal for equal words and only for these, whatever their hashes."""
        return self.coded().indices.to_numpy()

    def checks(self, which: np.ndarray) -> np.ndarray:
        """Hashes of the words that a mask names, by tables of random numbers: they have nothing in common with ``hashes``."""
        coded = self.coded(which)
        _, ends, inside = coded.dictionary.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(coded.dictionary) + 1]
        size, inside = np.diff(ends), np.frombuffer(inside, np.uint8)[: ends[-1]]
        place = np.arange(len(inside)) - np.repeat(ends[:-1], size)
        own = np.add.reduceat(_TABLES[place % len(_TABLES), inside], ends[:-1]) + size.astype(np.uint64)
        return mix64(own)[coded.indices.to_numpy()]


class Fingerprints:
    """Hashes of n-grams, by language and length."""

    def __init__(self):
        self.of_bytes, self.of_words = Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93)

    def __call__(self, words: Words, lang: str, n: int) -> np.ndarray:
        own = np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=n))
        return mix64(self.of_words(words.hashes, n) ^ own) if len(words) >= n else np.zeros(0, np.uint64)

    def check(self, words: Words, lang: str, n: int, at: np.ndarray) -> np.ndarray:
        """Second fingerprints, of ``CHECK_BITS`` bits, of the n-grams at these places."""
        which = np.zeros(len(words), bool)
        for k in range(n):
            which[at + k] = True
        own = np.zeros(len(words), np.uint64)
        own[which] = words.checks(which)
        found = np.full(len(at), xxhash.xxh3_64_intdigest(lang.encode(), seed=n + (1 << 32)), np.uint64)
        for k in range(n):
            found = mix64(found ^ own[at + k])
        return found >> np.uint64(64 - CHECK_BITS)


class Sieve:
    """A bit for each fingerprint modulo the size: set for all that are frequent, and by chance for some that are not."""

    def __init__(self, words: np.ndarray, size: int):
        self.words, self.mask = words, np.uint64(size - 1)

    def __call__(self, fingerprints: np.ndarray) -> np.ndarray:
        word = self.words[((fingerprints >> np.uint64(6)) & self.mask).astype(np.int64)]
        return (word >> (fingerprints & np.uint64(63)) & np.uint64(1)).astype(bool)

    @classmethod
    def of(cls, fingerprints: DataFrame, bits: int = SIEVE_BITS) -> Sieve:
        """From a table with the column fp. The driver gets at most 2**(bits - 6) numbers, whatever the table's size."""
        size = 1 << max(0, bits - 6)
        place = F.shiftrightunsigned("fp", 6).bitwiseAND(F.lit(size - 1).cast("long"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("fp").bitwiseAND(F.lit(63).cast("long")).cast("int"))
        found = fingerprints.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits")).toPandas()
        words = np.zeros(size, np.uint64)
        words[found["place"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
        return cls(words, size)


_LOW = np.uint64((1 << PRINT_BITS) - 1)


def _pointers(fp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a sieve for an n-gram with its smallest document."""
    one = mix64(mix64(fp & _LOW) ^ doc.view(np.uint64))
    return one, mix64(one)


def pointer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp: the places of counted n-grams and their documents."""
    for b in batches:
        places = _pointers(b.column("fp").to_numpy().view(np.uint64), b.column("doc_id").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places).view(np.int64))], names=["fp"])


def _parts(batches: Iterator[pa.RecordBatch], of_bytes: Rolling) -> Iterator[tuple[str, Words, np.ndarray]]:
    """(language, words, document of each word) of the texts, some megabytes at a time."""
    waiting: dict[str, tuple[list[bytes], list[int]]] = {}
    size = 0

    def parts() -> Iterator[tuple[str, Words, np.ndarray]]:
        for lang, (texts, ids) in waiting.items():
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            whole, at = b"\n".join(texts), 0
            while at < len(whole):
                end = min(len(whole), at + PART)
                while end < len(whole) and whole[end] not in _BREAK:  # pieces stay whole
                    end += 1
                words = Words(whole[at:end], of_bytes)
                if len(words):
                    yield lang, words, np.array(ids, np.int64)[np.searchsorted(begins, words.starts + at, side="right") - 1]
                at = end
        waiting.clear()

    for batch in batches:
        ids, langs = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
        for doc_id, lang, text in zip(ids, langs, utf8(batch.column("text")), strict=True):
            texts, own = waiting.setdefault(lang, ([], []))
            texts.append(text)
            own.append(doc_id)
            size += len(text)
            if size >= PART:
                yield from parts()
                size = 0
    yield from parts()


def _candidates(words: Words, lang: str, n: int, print_of: Fingerprints, sieve: Sieve | None, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints) of the n-grams all of whose ``inner``-grams pass the sieve."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = words.whole(n)
    if sieve is not None:
        hit = sieve(print_of(words, lang, inner))
        for k in range(n - inner + 1):
            ok = ok & hit[k:k + len(ok)]
    at = np.flatnonzero(ok)
    return at, print_of(words, lang, n)[at]


def _added(fp: np.ndarray, n: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """In the fingerprints' order, with neighbours of one fingerprint (and check) added up; more: check and document."""
    order = np.argsort(fp)
    fp, n, more = fp[order], n[order], [c[order] for c in more]
    new = np.diff(fp, prepend=~fp[:1]) != 0
    if more:
        new[1:] |= more[0][1:] != more[0][:-1]
    edge = np.flatnonzero(new)
    return fp[edge], np.add.reduceat(n, edge), *((more[0][edge], np.minimum.reduceat(more[1], edge)) if more else ())


def count_rows(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], sieve: Sieve | None, inner: int, at_most: int, pointed: bool = False) -> Iterator[pa.RecordBatch]:
    """fp, n, if ``pointed`` also check, doc_id: what a task counts, in the fingerprints' order, added up as far as ``at_most`` distinct n-grams go."""
    print_of, kept, held = Fingerprints(), [], 0

    def merged() -> tuple[np.ndarray, ...]:
        return _added(*(np.concatenate(c) for c in zip(*kept, strict=True)))

    def rows(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["fp", "n", "check", "doc_id"][: len(columns)])

    for lang, words, docs in _parts(batches, print_of.of_bytes):
        for n in sizes:
            at, fp = _candidates(words, lang, n, print_of, sieve, inner)
            if len(at):
                more = (print_of.check(words, lang, n, at), docs[at]) if pointed else ()
                kept.append(_added(fp & _LOW, np.ones(len(at), np.int64), *more))
                held += len(kept[-1][0])
        if held > at_most:
            one = merged()
            kept, held = [one], len(one[0])
            if held > at_most // 2:
                yield rows(one)
                kept, held = [], 0
    if kept:
        yield rows(merged())


def phrase_rows(batches: Iterator[pa.RecordBatch], sieves: list[Sieve], firsts: Sieve | None = None) -> Iterator[pa.RecordBatch]:
    """lang, phrase, size, f, doc_id: the phrases that the sieves let through, added up as far as ``TEXTS`` different ones go; size 0 counts words.

    With ``firsts``, only from the parts where their smallest document lies (f counts these parts), and fp and check too.
    """
    print_of = Fingerprints()
    kept: dict[tuple[str, bytes | None, int], tuple[int, int, int, int]] = {}

    def handed_on() -> pa.RecordBatch:
        lang, phrase, size = zip(*kept, strict=True)
        f, *more = zip(*kept.values(), strict=True)
        more = more[: 1 if firsts is None else 3]
        return pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array([None if p is None else p.decode() for p in phrase], pa.string()), *(pa.array(c, pa.int64()) for c in (size, f, *more))],
            names=["lang", "phrase", "size", "f", "doc_id", "fp", "check"][: 4 + len(more)])

    for lang, words, docs in _parts(batches, print_of.of_bytes):
        rows: list[tuple[bytes | None, int, int, int, int, int]] = [(None, 0, len(words), 0, 0, 0)]
        numbers = None
        for n, sieve in enumerate(sieves, 1):
            at, fp = _candidates(words, lang, n, print_of, sieve, n)
            if not len(at):
                continue
            order = np.argsort(fp, kind="stable")
            at, fp = at[order], fp[order]
            edge = np.flatnonzero(np.diff(fp, prepend=~fp[:1]))
            like = np.repeat(at[edge], np.diff(np.append(edge, len(fp))))
            numbers = words.numbers() if numbers is None else numbers
            if not all(np.array_equal(numbers[at + k], numbers[like + k]) for k in range(n)):  # two phrases with one fingerprint: each on its own
                edge = np.arange(len(at))
            times, first = np.diff(np.append(edge, len(fp))), np.minimum.reduceat(docs[at], edge)
            at, fp = at[edge], fp[edge] & _LOW
            check = np.zeros(len(at), np.uint64)
            if firsts is not None:
                one, two = _pointers(fp, first)
                here = np.flatnonzero(firsts(one) & firsts(two))
                if not len(here):
                    continue
                at, fp, times, first = (c[here] for c in (at, fp, times, first))
                check = print_of.check(words, lang, n, at)
            rows += zip([words.phrase(p, n) for p in at.tolist()], [n] * len(at), *(c.tolist() for c in (times, first, fp, check)), strict=True)
        for phrase, size, f, doc, *prints in rows:
            had = kept.get((lang, phrase, size))
            kept[lang, phrase, size] = (f, doc, *prints) if had is None else (had[0] + f, min(had[1], doc), *prints)
        if len(kept) > TEXTS:
            yield handed_on()
            kept.clear()
    if kept:
        yield handed_on()


def _counted(texts: DataFrame, sizes: tuple[int, ...], sieve: Sieve | None, inner: int, least: int) -> DataFrame:
    """fp, check, n, doc_id of the n-grams of these sizes with at least ``least`` occurrences."""
    shared = texts.sparkSession.sparkContext.broadcast(sieve)
    rows = texts.mapInArrow(lambda batches: count_rows(batches, sizes, shared.value, inner, KEPT, True), "fp long, n long, check long, doc_id long")
    return written(rows.groupBy("fp", "check").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id")).where(F.col("n") >= least), "fingerprints")


def _phrases(texts: DataFrame, sieves: list[Sieve], counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f, doc_id) of all frequent phrases; (lang, n), the number of words."""
    firsts = Sieve.of(counted.select("fp", "doc_id").mapInArrow(pointer_rows, "fp long"))
    shared = texts.sparkSession.sparkContext.broadcast((sieves, firsts))
    rows = texts.mapInArrow(lambda batches: phrase_rows(batches, *shared.value), "lang string, phrase string, size long, f long, doc_id long, fp long, check long")
    rows = written(rows.groupBy("lang", "phrase", "size", "fp", "check").agg(F.sum("f").alias("f"), F.min("doc_id").alias("doc_id")), "texts")
    found = rows.where("size > 0").drop("f").join(counted.withColumnRenamed("n", "f"), ["fp", "check", "doc_id"])
    return written(found.select("lang", "phrase", "size", "f", "doc_id"), "phrases"), rows.where("size = 0").select("lang", F.col("f").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with at least ``least`` occurrences per language, and the number of words per language."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = _counted(texts, (1,), None, 0, least)
    sieves = [Sieve.of(counted)]
    for sizes in [(2,), (3,), tuple(range(4, longest + 1))]:
        if sizes and longest >= sizes[0]:
            one = _counted(texts, sizes, sieves[-1], sizes[0] - 1, least)
            sieves += [Sieve.of(one)] * len(sizes)
            counted = counted.union(one)
    return _phrases(texts, sieves, counted)


def _words_of(phrase: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, first_doc: each language's ``best`` phrases of 2 to ``longest`` words.

    A-Z count as a-z. Texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words; a phrase
    lies within a piece. a, l and r are the occurrences of the phrase and of its two parts at the cut with the lowest
    score floor(1000 * a * n / (l * r)) (the first such cut), n the words of the language. A phrase
    inside a longer candidate that occurs as often is dropped. ``first_doc`` points to the smallest document that has
    the phrase (-1: a document without id). Best first, ties by a, descending, then by phrase.

    A null text is empty, a null lang ``und``. Repeated rows count as often as they occur. Other columns take no part. An empty
    table gives no rows.
    """
    counts, totals = frequent_phrases(docs, least, longest)
    candidates = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.col("doc_id").alias("first_doc"))
    # Each candidate's shorter phrases of two words and more, with how often the longer one occurs.
    inner = candidates.where("size > 2").select("lang", F.col("a").alias("longer"), "phrase", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.select("lang", "longer", "phrase", "k", F.explode(F.sequence(F.lit(1), (F.col("size") - F.col("k") + 1).cast("int"))).alias("p"))
    inner = inner.groupBy("lang", _words_of(F.col("phrase"), F.col("p"), F.col("k").cast("int")).alias("phrase")).agg(F.max("longer").alias("longer"))
    left = candidates.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cuts = left.select("*", F.explode(F.sequence(F.lit(1), (F.col("size") - 1).cast("int"))).alias("k"))
    cuts = cuts.withColumns({"_l": _words_of(F.col("phrase"), F.lit(1), F.col("k")), "_r": _words_of(F.col("phrase"), F.col("k") + 1, (F.col("size") - F.col("k")).cast("int"))})
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("_l", "l"), ["lang", "_l"]).join(part("_r", "r"), ["lang", "_r"]).join(totals, "lang")
    # Whole numbers of up to 38 digits; a lowest score is not above 1000 n / least.
    exact = F.expr("CAST((CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * 1000) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    lowest = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a", "n", "first_doc").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "first_doc")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = rows.withColumn("rank", rank).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "first_doc")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle_sql(least: int = LEAST, best: int = BEST) -> str:
    parts = " || ' ' || ".join
    grams = " UNION ALL ".join(
        f"SELECT lang, doc_id, {k} AS size, {parts(f'ws[p + {j}]' for j in range(k))} AS phrase FROM (SELECT lang, doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS p FROM w)"
        for k in range(1, LONGEST + 1))
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
w AS (SELECT lang, doc_id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, doc_id, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS f, min(doc_id) AS doc_id FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
inside AS (
  SELECT lang, array_to_string(ws[p:p + k - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, f, ws, k, unnest(range(1, CAST(size - k + 2 AS BIGINT))) AS p FROM (SELECT *, unnest(range(2, CAST(size AS BIGINT))) AS k FROM c)) GROUP BY ALL
),
left_over AS (SELECT c.* FROM c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR i.longer < c.f),
cut AS (SELECT *, array_to_string(ws[1:k], ' ') AS first_part, array_to_string(ws[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, CAST(size AS BIGINT))) AS k FROM left_over)),
s AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, total.n, c.doc_id, c.k,
         (1000::HUGEINT * c.f::HUGEINT * total.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_part JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN total ON total.lang = c.lang
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, doc_id AS first_doc FROM q WHERE rank <= {best}
"""


ORACLE_SQL = oracle_sql()
