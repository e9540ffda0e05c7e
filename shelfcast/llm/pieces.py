"""SentencePiece encoding and decoding with n-best segmentations.

A text is a path over the lattice of vocabulary pieces. Forward Viterbi scores
give the best way to every place; they are an exact heuristic for a search that
goes backward from the end (A*), so complete paths come out in order of score, and
the search stops after ``n_best``.

No piece reaches from a letter into a blank behind it, so the lattice of a text falls
apart into those of its words, exactly, and words recur. Words not in a bounded cache
are run through the Viterbi recursion together, many words in one array pass,
forward and backward: that gives a word's best path, and what its second best
path costs. Only the n - 1 words of a text whose second paths cost least can
change its n best paths; those are searched by A*. The second to nth path of a text
are given as what they put in place of runs of the best path's ids.

Blanks are written as U+2581 and one is put before the text, as the model's own
tokenizer does. Characters without a piece, and U+2581 itself, are written as byte
pieces, so that decoding returns every text as it was.
"""

from __future__ import annotations

import math
import re
from bisect import insort
from collections.abc import Iterable, Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
BLANK = "▁"
#: Stands for a literal U+2581 while a text is searched. A lone surrogate occurs in no UTF-8 text and no piece.
_LITERAL = "\udc81"
#: Words in each half of the cache, and the longest one kept: longer words are many and seldom come again.
_CACHE_WORDS, _CACHE_CHARS = 150_000, 9
#: The longest word that goes through the array pass, words of one pass, and unknown words looked up at once.
_LONG_WORD, _TOGETHER, _UNKNOWN = 64, 4_000, 30_000
#: What a further path has in place of the best path's ids from one place up to another: (place, end, ids).
Change = tuple[int, int, tuple[int, ...]]
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class PieceModel:
    """Pieces with scores, as read from a SentencePiece model file.

    A model whose scores are merge ranks (BPE) has no probabilities; its piece of
    rank r gets the log of 1 / ((r + 1) * H), Zipf's law over the vocabulary. A byte
    piece scores like the rarest piece, less one.
    """

    def __init__(self, pieces: Sequence[tuple[str, float]], byte_ids: dict[int, int], by_rank: bool = False):
        """``pieces``: (piece, score) by id, with an empty piece at ids that no text can hold."""
        self.ids = {p: k for k, (p, _) in enumerate(pieces) if p}
        self.scores = {p: float(s) for p, s in pieces if p}
        if by_rank:
            ranked = sorted(self.scores, key=self.scores.__getitem__, reverse=True)
            total = math.log(math.fsum(1 / (r + 1) for r in range(len(ranked))))
            self.scores = {p: -math.log(r + 1) - total for r, p in enumerate(ranked)}
        self.byte_ids = byte_ids
        self.byte_score = min(self.scores.values(), default=0.0) - 1
        self.pieces = {p: (s, (self.ids[p],)) for p, s in self.scores.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.name = hash(tuple(sorted(self.scores.items())))

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        pieces = [("" if special[i] else sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
        bytes_ = {int(_BYTE.fullmatch(sp.id_to_piece(i))[1], 16): i for i in range(n) if sp.is_byte(i)}
        # Merge ranks are whole numbers; a unigram model's log probabilities are not.
        return cls(pieces, bytes_, by_rank=all(s == int(s) for p, s in pieces if p))

    @staticmethod
    def raw(c: str) -> bytes:
        """What a character of a marked text stands for."""
        return b" " if c == BLANK else BLANK.encode() if c == _LITERAL else c.encode()

    def _arcs(self, text: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of the pieces that end at ``end``; bytes for a character without a piece of its own."""
        find = self.pieces.get
        arcs = [(start, *hit) for start in range(max(0, end - self.longest), end) if (hit := find(text[start:end]))]
        if not arcs or arcs[-1][0] != end - 1:
            raw = self.raw(text[end - 1])
            arcs.append((end - 1, self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)))
        return arcs

    def n_best(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """(score, ids) of the ``n`` best paths over a text, best first.

        ``best[k]`` is the forward Viterbi score of the first k characters. A
        partial path from place k to the end has priority best[k] + its own
        score, the exact score of its best completion. Every open partial path stands
        for another complete one, so no more are kept open than paths are
        still wanted, however many ties there are. Paths of equal score come in a
        fixed order of no meaning.
        """
        size = len(text)
        # Arcs of a long text are found again when needed rather than kept.
        kept = [self._arcs(text, end) for end in range(1, size + 1)] if size <= _LONG_WORD else None
        best = [0.0]
        for end in range(1, size + 1):
            best.append(max([best[start] + score for start, score, _ in (kept[end - 1] if kept else self._arcs(text, end))]))
        found: list[tuple[float, list[int]]] = []
        # Ascending; (priority, minus the place, a number that settles ties, score behind the place, (ids, what follows))
        wait: list[tuple] = [(best[-1], -size, 0, 0.0, None)]
        count, wanted = 0, n
        while wait and wanted:
            _, at, _, behind, path = wait.pop()
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((behind, ids))
                wanted -= 1
                continue
            for start, score, arc in kept[-at - 1] if kept else self._arcs(text, -at):
                priority = best[start] + score + behind
                if len(wait) >= wanted:
                    if priority <= wait[0][0]:
                        continue
                    del wait[0]
                count -= 1
                insort(wait, (priority, -start, count, score + behind, (arc, path)))
        return found


class Lattices:
    """Best paths of many words at once."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model: PieceModel):
        self.model = model
        by_size: dict[int, list[str]] = {}
        for p in model.ids:
            by_size.setdefault(len(p), []).append(p)
        self.same = [*range(max([0, *model.ids.values()]) + 1), -1]  # one object for each id, -1 the last
        self.tables = {}
        for size, own in by_size.items():
            hashes = self._points("".join(own)).reshape(-1, size)
            h = np.zeros(len(own), np.uint64)
            for k in range(size):
                h = h * self._BASE + hashes[:, k]
            order = np.argsort(h)
            maybe = np.zeros(1 << 18, bool)  # cheaper than a search for most runs that are no piece
            maybe[h >> np.uint64(46)] = True
            self.tables[size] = (maybe, h[order], np.array([model.scores[own[k]] for k in order]), np.array([model.ids[own[k]] for k in order], np.int64))

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)

    def _arcs(self, words: Sequence[str]) -> tuple[np.ndarray, ...]:
        """(start node, size, score, id) of all arcs, by end node; a byte arc has the id -1."""
        points = self._points("".join(words))
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), sizes)
        left = np.cumsum(sizes)[word] - np.arange(len(points))
        node = np.arange(len(points)) + word  # a word of n characters has n + 1 nodes
        found = []
        h = np.zeros(len(points), np.uint64)
        single = np.zeros(len(points), bool)
        for size in range(1, min(self.model.longest, len(points)) + 1):
            h = h[: len(points) - size + 1] * self._BASE + points[size - 1:]
            if size not in self.tables:
                continue
            maybe, known, scores, ids = self.tables[size]
            at = np.flatnonzero((left[: len(h)] >= size) & maybe[h >> np.uint64(46)])
            spot = np.searchsorted(known, h[at])
            spot[spot == len(known)] = 0
            hit = known[spot] == h[at]
            at, spot = at[hit], spot[hit]
            if size == 1:
                single[at] = True
            found.append((node[at], np.full(len(at), size), scores[spot], ids[spot]))
        rest = np.flatnonzero(~single)
        length = np.array([len(self.model.raw(chr(c - 1))) for c in points[rest].tolist()])
        found.append((node[rest], np.ones(len(rest), np.int64), self.model.byte_score * length, np.full(len(rest), -1)))
        start, size, score, ids = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort((start + size) * 64 + size)  # no two arcs are alike in both
        return start[order], size[order], score[order], ids[order]

    def best(self, words: Sequence[str]) -> list[tuple[float, tuple[int, ...], float]]:
        """(score, ids, cost of the second best path or infinity) of each word."""
        n = len(words)
        start, size, score, ids = self._arcs(words)
        end = start + size
        sizes = np.array([len(w) for w in words])
        first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        last = first + sizes
        nodes = int(last[-1]) + 1
        word = np.searchsorted(first, start, side="right") - 1
        ahead = np.full(nodes, -np.inf)
        ahead[first] = 0.0
        via = np.zeros(nodes, np.int64)
        for at in _groups(end - first[word]):
            reached = ahead[start[at]] + score[at]
            node = end[at]
            edge = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            top = np.maximum.reduceat(reached, edge)
            ahead[node[edge]] = top
            hit = np.flatnonzero(reached == np.repeat(top, np.diff(np.append(edge, len(node)))))
            via[node[hit[::-1]]] = at[hit[::-1]]  # the first of equals is written last
        behind = np.full(nodes, -np.inf)
        behind[last] = 0.0
        for at in reversed(_groups(start - first[word])):
            at = at[np.argsort(start[at], kind="stable")]
            node = start[at]
            edge = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            behind[node[edge]] = np.maximum.reduceat(behind[end[at]] + score[at], edge)
        on_path = np.zeros(len(start), bool)
        steps, node, own = [], last.copy(), np.arange(n)
        while len(own):
            arc = via[node[own]]
            steps.append((own, arc))
            on_path[arc] = True
            node[own] = start[arc]
            own = own[node[own] > first[own]]
        # Every other path has an arc off the best one; the best path through such an arc is the second best.
        through = np.where(on_path, -np.inf, ahead[start] + score + behind[end])
        second = np.maximum.reduceat(through, np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))))
        gap = np.maximum(ahead[last] - second, 0.0).tolist()
        step_of = np.concatenate([np.full(len(o), -k) for k, (o, _) in enumerate(steps)])
        owner, arc = (np.concatenate(c) for c in zip(*steps, strict=True))
        order = np.lexsort((step_of, owner))
        owner, arc = owner[order], arc[order]
        flat = tuple(map(self.same.__getitem__, ids[arc].tolist()))
        ends = np.searchsorted(owner, np.arange(n + 1))
        paths = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for k in np.unique(owner[ids[arc] < 0]).tolist():  # bytes for characters without a piece
            places = (start[arc[ends[k]:ends[k + 1]]] - first[k]).tolist()
            paths[k] = tuple(i for piece, p in zip(paths[k], places, strict=True)
                             for i in ([piece] if piece >= 0 else [self.model.byte_ids[b] for b in self.model.raw(words[k][p])]))
        return list(zip(ahead[last].tolist(), paths, gap, strict=True))


def _groups(values: np.ndarray) -> list[np.ndarray]:
    """Indices of equal values, ascending by value, each in the order given."""
    order = np.argsort(values.astype(np.int16), kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order])) + 1)


class Encoder:
    """Encodes and decodes texts with a model; keeps the words it has seen of late."""

    def __init__(self, model: PieceModel, n: int = N_BEST):
        self.model, self.n, self.lattices = model, n, Lattices(model)
        self.known: dict[str, tuple[float, tuple[int, ...], float]] = {}
        self.older: dict[str, tuple[float, tuple[int, ...], float]] = {}
        self.others: dict[str, list[tuple[float, tuple[int, ...] | None]]] = {}
        self.names = {i: p.replace(BLANK, " ").encode() for p, i in model.ids.items()} | {
            i: bytes([b]) for b, i in model.byte_ids.items()
        }
        # Pairs of characters that some piece holds side by side. A text may be cut between any other two; here it
        # is before blanks, and before a mark (an ASCII character that is no letter or digit) that no piece holds behind the character before it.
        behind: dict[str, set[str]] = {}
        for p in model.ids:
            for a, b in zip(p, p[1:], strict=False):
                behind.setdefault(b, set()).add(a)
        self.by_words = behind.get(BLANK, set()) <= {BLANK}
        marks = [c for c in map(chr, range(1, 128)) if not c.isalnum() and c != " "]
        joined = [c for c in marks if behind.get(c)]
        one_of = "".join(map(re.escape, joined))
        held = "|".join(f"(?<=[{re.escape(''.join(sorted(behind[c])))}]){re.escape(c)}" for c in sorted(joined, key=".,".find, reverse=True))
        rest = f"[^{BLANK}{''.join(map(re.escape, marks))}]*+"
        further = f"(?:(?=[{one_of}])(?:{held}){rest})*+" if joined else ""
        self.split = re.compile(f"{BLANK}*+[^{BLANK}]{rest}{further}|{BLANK}+").findall

    def _look_up(self, words: Iterable[str]) -> dict[str, tuple[float, tuple[int, ...], float]]:
        """Score, ids and gap of words that the newer half of the cache lacks; they go there."""
        new, have = [], {}
        for w in words:
            if (entry := self.older.get(w)) is not None:
                have[w] = entry
            elif len(w) <= _LONG_WORD:
                new.append(w)
            else:
                paths = self.model.n_best(w, 2)
                have[w] = (paths[0][0], tuple(paths[0][1]), max(0.0, paths[0][0] - paths[1][0]) if len(paths) > 1 else math.inf)
        for k in range(0, len(new), _TOGETHER):
            part = new[k:k + _TOGETHER]
            have.update(zip(part, self.lattices.best(part), strict=True))
        if len(self.known) > _CACHE_WORDS:
            self.older, self.known = self.known, {}
        self.known.update((w, e) for w, e in have.items() if len(w) <= _CACHE_CHARS)
        return have

    def _further(self, word: str, own: tuple[int, ...]) -> list[tuple[float, tuple[int, ...] | None]]:
        """(cost beyond the best path, ids) of the ``n`` best paths of a word, by A*; None stands for its best path, ``own``."""
        paths = self.others.get(word)
        if paths is None:
            found = self.model.n_best(word, self.n)
            other = [(max(0.0, found[0][0] - s), ids) for s, ids in ((s, tuple(ids)) for s, ids in found) if ids != own]
            # Of many equal paths, own may be none of those found.
            paths = [(0.0, None), *other][: len(found)]
            if len(word) <= _LONG_WORD:
                if len(self.others) >= _CACHE_WORDS:
                    self.others.clear()
                self.others[word] = paths
        return paths

    def encode_many(self, texts: Sequence[str]) -> Iterator[tuple[list[int], list[float], list[list[Change]]]]:
        """Of each text: ids of the best path, scores of the ``n`` best paths, changes to the best path that make each further one.

        An empty text has one empty path. Changes of a path ascend and do not overlap.
        """
        at = 0
        while at < len(texts):
            part, missing = [], dict[str, None]()
            while at < len(texts) and len(missing) < _UNKNOWN:
                text = texts[at]
                marked = BLANK + text.replace(BLANK, _LITERAL).replace(" ", BLANK) if text else ""
                words = (self.split(marked) if self.by_words else [marked]) if text else []
                entries = list(map(self.known.get, words))
                if None in entries:
                    missing.update(dict.fromkeys([w for w, e in zip(words, entries, strict=True) if e is None]))
                part.append((words, entries))
                at += 1
            have = self._look_up(missing)
            for words, entries in part:
                if None in entries:
                    entries = [have[w] if e is None else e for w, e in zip(words, entries, strict=True)]
                yield self._join(words, entries)

    def _join(self, words: list[str], entries: list[tuple[float, tuple[int, ...], float]]) -> tuple[list[int], list[float], list[list[Change]]]:
        ids: list[int] = []
        score, worst, near = 0.0, math.inf, []
        for k, (value, own, gap) in enumerate(entries):
            if gap < worst:
                insort(near, (gap, k, len(ids)))
                if len(near) >= self.n:
                    near.pop()
                if len(near) == self.n - 1:
                    worst = near[-1][0]
            ids += own
            score += value
        paths: list[tuple[float, tuple[Change, ...]]] = [(0.0, ())]
        for _, k, at in near:
            own = entries[k][1]
            end = at + len(own)
            paths = cheapest(paths, [(c, other and (at, end, other)) for c, other in self._further(words[k], own)], self.n)
        return ids, [score - c for c, _ in paths], [sorted(changes) for _, changes in paths[1:]]

    def encode(self, text: str) -> tuple[list[int], list[float]]:
        return next(self.encode_many([text]))[:2]

    def n_best(self, text: str) -> list[tuple[float, list[int]]]:
        """(score, ids) of the ``n`` best segmentations of a text, best first; fewer, if there are fewer."""
        ids, scores, further = next(self.encode_many([text]))
        return list(zip(scores, segmentations(ids, further), strict=True))

    def same_text(self, ids: Sequence[int], further: Iterable[Iterable[Change]]) -> bool:
        """Whether all further paths decode to the bytes that the best one decodes to."""
        raw = lambda part: b"".join(map(self.names.__getitem__, part))
        return all(raw(ids[at:end]) == raw(other) for changes in further for at, end, other in changes)

    def decode(self, ids: Sequence[int]) -> str:
        raw = b"".join(itemgetter(*ids)(self.names)) if len(ids) > 1 else b"".join(self.names[i] for i in ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode()


def cheapest(a: Sequence[tuple], b: Sequence[tuple], n: int) -> list[tuple[float, tuple[Change, ...]]]:
    """The ``n`` cheapest pairs of a path of each, as (cost, changes); both ascend and begin with (0, no change)."""
    pairs = [(x + y, own if change is None else (*own, change)) for i, (x, own) in enumerate(a) for y, change in b[: n // (i + 1) or 1]]
    return sorted(pairs, key=itemgetter(0))[:n]


def segmentations(ids: Sequence[int], further: Iterable[Iterable[Change]]) -> list[list[int]]:
    """Ids of all paths, from those of the best and the changes that make the further ones (rows of ``further_paths`` will do)."""
    out = [list(ids)]
    for changes in further:
        path = list(ids)
        for at, end, other in reversed(list(changes)):
            path[at:end] = other
        out.append(path)
    return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(model: PieceModel, n: int) -> Encoder:
    """The encoder of this Python worker, which serves all tasks with this model."""
    key = (model.name, n)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, n)
    return _ENCODERS[key]


SCHEMA = [
    T.StructField("n_pieces", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n_best_scores", T.ArrayType(T.DoubleType())),
    T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
    T.StructField("further_paths", T.ArrayType(T.ArrayType(T.StructType([
        T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])))),
    T.StructField("round_trip", T.BooleanType()),
]


def encode_batch(coder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of :func:`encode_documents` for doc_id and text of some documents."""
    ids, scores, same, further = [], [], [], []
    texts = [raw.decode() for raw in utf8(batch.column("text"))]
    for text, (own, best, others) in zip(texts, coder.encode_many(texts), strict=True):
        ids.append(np.array(own, np.int32))
        scores.append(best)
        further.append(others)
        same.append(coder.decode(own) == text and coder.same_text(own, others))
    paths = [changes for others in further for changes in others]
    changes = [c for path in paths for c in path]
    replaced = [np.array(c[2], np.int32) for c in changes]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([s[0] for s in scores], pa.float64()),
         pa.array(scores, pa.list_(pa.float64())), _lists(ids, pa.array(_flat(ids))),
         _lists(further, _lists(paths, pa.StructArray.from_arrays(
             [pa.array([c[0] for c in changes], pa.int32()), pa.array([c[1] for c in changes], pa.int32()),
              _lists(replaced, pa.array(_flat(replaced)))], names=["first", "end", "ids"]))),
         pa.array(same)], names=["doc_id", *(f.name for f in SCHEMA)],
    )


def encode_documents(docs: DataFrame, model_path: str = MODEL, n: int = N_BEST) -> DataFrame:
    """One row per document: doc_id, n_pieces, score, n_best_scores, piece_ids, further_paths, round_trip.

    ``score`` is that of the best segmentation, whose ids are ``piece_ids``;
    ``n_best_scores`` has the scores of the ``n`` best (fewer, if there are fewer).
    ``further_paths`` has the second to the last of them, each as the ids that take the
    place of ``piece_ids`` from ``first`` up to ``end``; ``segmentations`` writes them out.
    ``round_trip`` says whether the ids of every path decode to the text. Null and empty texts
    have no pieces, score 0 and one empty path. Repeated rows give repeated
    results; columns other than doc_id and text take no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return encode_batch(encoder(shared.value, n), batch)

    return map_batches(docs.select("doc_id", "text"), run, T.StructType([docs.schema["doc_id"], *SCHEMA]))


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *arrays])


def _lists(parts: Sequence, values: pa.Array) -> pa.ListArray:
    """Lists as long as ``parts`` of the values, one after another."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
