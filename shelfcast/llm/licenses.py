"""License scans: matching statistics of a text against a generalised suffix automaton.

The automaton holds every run of consecutive words of every template. A text is
streamed through it once: after each word it holds the longest run of template
words that ends there. Runs that a template can't continue are chained, in the order of text and
template, into the span that covers most of the template's words; a template covered widely
enough gives its label, if the span tells its licence from the nearest others: the words that
set them apart come from the differences of the templates themselves. Where spans share covered words,
the one that covers more stands. Places of base phrases fall out of the same pass, since
a phrase ends wherever its state is a suffix of the state reached.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches, utf8
from .license_texts import notices as all_notices

#: Phrases whose places are counted, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Bytes that are no part of a word become blanks; A-Z becomes a-z. Other bytes stay.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def unaligned(a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int]]:
    """Positions of ``a`` and of ``b`` outside a longest common subsequence of the two."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    i = j = 0
    only_a, only_b = [], []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            only_a.append(i)
            i += 1
        else:
            only_b.append(j)
            j += 1
    return [*only_a, *range(i, len(a))], [*only_b, *range(j, len(b))]


class LicenseAutomaton:
    """Generalised suffix automaton over template words, with chaining of its matches.

    ``min_run``: words of a run that takes part in a chain (or the whole template,
    if shorter). ``cover``: share of a template's words that gives its label.
    ``notices``: pairs of label and text, by default those of ``license_texts``.
    """

    def __init__(self, phrases: Mapping[str, str] = PHRASES, notices: Sequence[tuple[str, str]] | None = None,
                 min_run: int = 3, cover: float = 0.8):
        self.min_run, self.cover = min_run, cover
        self.base_labels = list(phrases.values())
        notices = all_notices() if notices is None else notices
        tokens = [words(p.encode()) for p in phrases] + [words(t.encode()) for _, t in notices]
        self.labels = [*phrases.values(), *(label for label, _ in notices)]
        self.ids: dict[bytes, int] = {}
        self.templates = [[self.ids.setdefault(w, len(self.ids)) for w in t] for t in tokens]
        self.shortest = min([min_run, *map(len, tokens)])  # words of the shortest run that can take part in a chain
        self.rivals = self._rivals()
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        for t in self.templates:
            self._add(t)
        self.at: list[list[tuple[int, int]]] = [[] for _ in self.next]  # (template, end) of runs that end in a state
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]  # (phrase, its words) that end in a state
        for k, t in enumerate(self.templates):
            state = 0
            for end, w in enumerate(t, 1):
                state = self.next[state][w]
                up = state
                while up > 0:  # every suffix of a prefix is a run of the template
                    self.at[up].append((k, end))
                    up = self.link[up]
            if k >= len(self.base_labels):
                continue
            for s in range(1, len(self.next)):
                up = s
                while up > 0 and up != state:
                    up = self.link[up]
                if up == state:
                    self.whole[s].append((k, len(t)))

    def _rivals(self) -> list[list[tuple[set[int], Counter]]]:
        """By template, its differences to each near template of another label: (own positions, other's words).

        Near are templates that share at least half of the longer one's words.
        """
        bags = [Counter(t) for t in self.templates]
        rivals: list[list[tuple[set[int], Counter]]] = [[] for _ in self.templates]
        for k, a in enumerate(self.templates):
            for j, b in enumerate(self.templates[:k]):
                if self.labels[j] == self.labels[k] or 2 * (bags[k] & bags[j]).total() < max(len(a), len(b)):
                    continue
                only_a, only_b = unaligned(a, b)
                rivals[k].append((set(only_a), Counter(b[p] for p in only_b)))
                rivals[j].append((set(only_b), Counter(a[p] for p in only_a)))
        return rivals

    def _add(self, template: list[int]) -> None:
        last = 0
        for w in template:
            if w in self.next[last]:
                q = self.next[last][w]
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
                continue
            new = self._state(self.size[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][w]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
            last = new

    def _state(self, size: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.size.append(size)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.size[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def scan(self, text: bytes) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

        ``spans``: (label, first word, end word, share covered) of each labelled chain.
        """
        ids = list(map(self.ids.get, words(text)))
        step, link, size, whole, shortest = self.next, self.link, self.size, self.whole, self.shortest
        base: list[tuple[int, int]] = []  # (first word, phrase)
        reached: list[tuple[int, int, int]] = []  # (end, length, state) after each word that a run may end with
        state = length = 0
        before = -1
        for i in [i for i, t in enumerate(ids) if t is not None]:
            t = ids[i]
            if i != before + 1:
                state = length = 0
            if t in step[state]:
                state = step[state][t]
                length += 1
            else:
                while state > 0 and t not in step[state]:
                    state = link[state]
                length = size[state] + 1
                state = step[state][t]
            for k, n in whole[state]:
                if length >= n:
                    base.append((i + 1 - n, k))
            if length >= shortest:
                reached.append((i + 1, length, state))
            before = i
        labels = {self.base_labels[k] for _, k in base}
        chains = self.chains(ids, reached) if reached else []
        chosen, widest = self._chosen(ids, chains)
        score = 1.0 if base else widest
        starts = [s for s, _ in base]
        return (len(ids), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                ",".join(sorted(labels | {s[0] for s in chosen})), score, chosen)

    def _gap(self, k: int) -> int:
        """Words that may lie between two runs of a template's chain."""
        return max(2, len(self.templates[k]) // 4)

    def runs(self, ids: Sequence[int | None], reached: Sequence[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """By template, the runs (end in the text, end in the template, length) that can't be continued, in text order.

        A run has ``min_run`` words, or the whole template if that is shorter.
        """
        found: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in reached:
            follows = ids[end] if end < len(ids) else None
            seen: set[tuple[int, int]] = set()
            while state > 0 and length >= self.shortest:
                for k, at in self.at[state]:  # the longest suffix at a place comes first
                    t = self.templates[k]
                    if (k, at) in seen:
                        continue
                    seen.add((k, at))
                    if length >= min(self.min_run, len(t)) and (at == len(t) or t[at] != follows):
                        found.setdefault(k, []).append((end, at, length))
                state = self.link[state]
                length = self.size[state]
        return found

    def chains(self, ids: Sequence[int | None], reached: Sequence[tuple[int, int, int]]) -> list[tuple]:
        """The widest chain that ends with each run: (words covered, template, first word, end word, pieces).

        A run follows another one of its template when it ends behind it in text and template; the part
        that lies behind in both counts, and at most the template's gap lies between the two in the text.
        Of equally wide chains the one that begins later stands. ``pieces`` are linked
        (end in the text, end in the template, length), the last first.
        """
        out = []
        for k, runs in self.runs(ids, reached).items():
            gap, ends = self._gap(k), []
            for end, at, length in runs:
                best = (length, end - length, ((end, at, length), None))
                for was_end, was_at, chain in reversed(ends):
                    if was_end < end - length - gap:
                        break  # runs are in text order
                    fresh = min(length, end - was_end, at - was_at)
                    if fresh > 0 and end - fresh - was_end <= gap and (chain[0] + fresh, chain[1]) > best[:2]:
                        best = (chain[0] + fresh, chain[1], ((end, at, fresh), chain[2]))
                ends.append((end, at, best))
                out.append((best[0], k, best[1], end, best[2]))
        return out

    def _chosen(self, ids: Sequence[int | None], chains: list[tuple]) -> tuple[list[tuple[str, int, int, float]], float]:
        """((label, first word, end word, share covered) of each template's best chain that stands, the widest share).

        Where chains share covered words under two labels, the one that covers more words stands, of equals
        the wider, then the earlier. A chain that doesn't tell its licence counts by ``cover`` of its share in the second result.
        """
        able, widest = [], 0.0
        for covered, k, first, end, pieces in chains:
            share = covered / len(self.templates[k])
            if share < self.cover:
                widest = max(widest, share)
            elif self._told(ids, k, first, end, pieces):
                widest = max(widest, share)
                able.append((-covered, -share, first, end, k, pieces))
            else:
                widest = max(widest, share * self.cover)
        owner: dict[int, str] = {}
        best: dict[int, tuple[int, int, float]] = {}
        for _, share, first, end, k, pieces in sorted(able, key=lambda c: c[:5]):
            label, own = self.labels[k], []
            while pieces:
                (stop, _, length), pieces = pieces
                own += range(stop - length, stop)
            if all(owner.get(w, label) == label for w in own):
                owner.update(dict.fromkeys(own, label))
                best.setdefault(k, (first, end, -share))
        return [(self.labels[k], *span) for k, span in sorted(best.items(), key=lambda b: (*b[1][:2], b[0]))], widest

    def _told(self, ids: Sequence[int | None], k: int, first: int, end: int, pieces: tuple | None) -> bool:
        """Whether a chain tells its licence from each rival: ``cover`` of its own words that the rival lacks are
        covered, and not as many of the rival's words that it lacks itself lie between its runs."""
        between, places = Counter(ids[first:end]), set()
        while pieces:
            (_, at, length), pieces = pieces
            places.update(range(at - length, at))
        between.subtract(self.templates[k][p] for p in places)
        between = +between
        return all(
            len(own & places) >= self.cover * len(own) and not (theirs and (theirs & between).total() >= self.cover * theirs.total())
            for own, theirs in self.rivals[k]
        )


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
        T.StructField("end_word", T.LongType()), T.StructField("cover", T.DoubleType()),
    ]))),
])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")],
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()),
                                  ("end_word", pa.int64()), ("cover", pa.float64())]))),
])


def scan_licenses(docs: DataFrame, automaton: LicenseAutomaton | None = None) -> DataFrame:
    """One row per document: counts and places of base phrases, labels, score and covered spans.

    Null and empty texts have no words: counts 0, places null, labels empty,
    score 0, no spans. Repeated rows give repeated results; columns other than
    doc_id and text take no part. ``score`` is the widest cover of any template,
    1 when a phrase occurs; a wide cover without the words that tell the licence
    gives a lower score and no label.
    """
    auto = automaton or LicenseAutomaton()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [auto.scan(t) for t in utf8(batch.column("text"))]
        cols = [list(c) for c in zip(*rows, strict=True)]
        cols[-1] = [[dict(zip(("label", "first_word", "end_word", "cover"), s, strict=True)) for s in c] for c in cols[-1]]
        ids = batch.column("doc_id").cast(pa.int64())
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(cols, list(_ARROW)[1:], strict=True))], schema=_ARROW)

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
