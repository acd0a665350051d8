"""Evaluation passages inside training texts.

A generalised suffix automaton over the words of all normalised passages is
built once and broadcast.  The words of each document are streamed through it,
keeping the longest suffix that occurs in a passage; where it has at least
``SEED`` words, the automaton tells which passages hold it.  A run of
``MIN_WORDS`` words is a leak at once.  Otherwise the stretches of the text
that may hold a leak of the passage are aligned with it: a leak is a window of
at least ``MIN_WORDS`` passage words of which at most a quarter is altered,
added or missing.  Among L words with L / 4 changes at least L / 4 - 2 runs of
``SEED`` words overlap, so no such window is without seeds; every alignment of
every window is considered (:func:`windows`).

Of a passage that leaks, all places in the document are reported: its runs of
``MIN_WORDS`` words and all windows that alignments with the whole passage
give are merged where they overlap, so that a span ends only where the
quotation does, and further copies are spans of their own.

The passages are fixed test material: they are read in blocks of at most
``BLOCK_WORDS`` words; each block's automaton is streamed against all
documents, so that the memory of a worker is bounded and larger test sets take
more scans.

Defined results: null, empty and very short documents and passages leak
nothing; repeated documents are reported each; a passage shorter than
``MIN_WORDS`` leaks where it stands whole, up to a quarter changed; one of
fewer than ``2 * SEED`` words only where it stands unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
MAX_CHANGED = 0.25
#: Words at the ends of a window that may be altered; an exact quotation of
#: fewer than MIN_WORDS - MAX_EDGE words is a shorter quotation, not a leak.
MAX_EDGE = 2
SEED = 3
BLOCK_WORDS = 200_000

_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:nbsp|amp|lt|gt|quot|#\d{1,5});")
_BREAK = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t>]*(?=\w)|[­​‌‍﻿]")
_WORD = re.compile(r"[^\W_]+")


def words_with_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case without markup, and their places in the text."""
    blank = _MARKUP.sub(lambda m: " " * len(m.group()), text) if "<" in text or "&" in text else text
    words, spans = [], []
    joined = {m.start(): m.end() for m in _BREAK.finditer(blank)}
    end = -1
    for m in _WORD.finditer(blank):
        w = m.group().lower()
        if not w.isascii():
            w = unicodedata.normalize("NFKC", w)
        if joined and words and joined.get(end) == m.start():
            words[-1] += w
            spans[-1] = (spans[-1][0], m.end())
        else:
            words.append(w)
            spans.append(m.span())
        end = m.end()
    return words, spans


def words_of(text: str) -> list[str]:
    """The words of :func:`words_with_spans` without their places."""
    if _BREAK.search(text):
        return words_with_spans(text)[0]
    blank = _MARKUP.sub(" ", text) if "<" in text or "&" in text else text
    if blank.isascii():
        return _WORD.findall(blank.lower())
    return [w if w.isascii() else unicodedata.normalize("NFKC", w) for w in map(str.lower, _WORD.findall(blank))]


class Automaton:
    """Suffix automaton of several word sequences.

    The end positions of a state are those of its subtree of suffix links, a
    slice of one list in the order of a walk over that tree.
    """

    def __init__(self, passages: list[tuple[int, list[str]]]) -> None:
        self.ids = [i for i, _ in passages]
        self.vocabulary: dict[str, int] = {}
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in passages]
        self.sets = [frozenset(ws) for ws in self.words]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for k, ws in enumerate(self.words):
            last = 0
            for at, w in enumerate(ws):
                last = self._extend(last, w, own)
                own[last].append((k, at))
        below: list[list[int]] = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            below[self.link[state]].append(state)
        self._places: list[tuple[int, int]] = []
        self._from, self._to = [0] * len(self.next), [0] * len(self.next)
        walk = [(0, False)]
        while walk:
            state, done = walk.pop()
            if done:
                self._to[state] = len(self._places)
                continue
            self._from[state] = len(self._places)
            self._places += own[state]
            walk.append((state, True))
            walk += [(child, False) for child in below[state]]
        # the shortest state of SEED (MIN_WORDS) words or more on the way to the root
        self.seed_state = [-1] * len(self.next)
        self.run_state = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            up = self.link[state]
            for of, least in ((self.seed_state, SEED), (self.run_state, MIN_WORDS)):
                if self.length[state] >= least:
                    of[state] = of[up] if of[up] >= 0 else state
        #: passages that hold the words of a seed state
        self.held_by = {s: sorted({k for k, _ in self.ends(s)}) for s in set(self.seed_state) if s >= 0}
        self.tiny: dict[int, list[int]] = defaultdict(list)
        for k, ws in enumerate(self.words):
            if 0 < len(ws) < SEED:
                self.tiny[ws[0]].append(k)

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(passage, place of the last word) of the words of a state."""
        return self._places[self._from[state] : self._to[state]]

    def _new(self, length: int, own: list[list[tuple[int, int]]]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        own.append([])
        return len(self.next) - 1

    def _extend(self, last: int, w: int, own: list[list[tuple[int, int]]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q, own)
        state = self._new(length[last] + 1, own)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[state] = q if length[q] == length[p] + 1 else self._split(p, w, q, own)
        return state

    def _split(self, p: int, w: int, q: int, own: list[list[tuple[int, int]]]) -> int:
        nxt, link = self.next, self.link
        clone = self._new(self.length[p] + 1, own)
        nxt[clone] = dict(nxt[q])
        link[clone] = link[q]
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    # -------------------------------------------------------------- matching

    def leaks(self, words: list[str], spans: bool = True) -> list[tuple[int, int, int, int, float]]:
        """(passage id, first word, last word, passage words covered, their share of the passage) of each span of each leak.

        Without ``spans`` one place of each passage is enough.
        """
        ids = [self.vocabulary.get(w, -1) for w in words]
        nxt, link, length, seed_state, held_by = self.next, self.link, self.length, self.seed_state, self.held_by
        # the last words of seeds, and of runs of MIN_WORDS words with their places, by passage
        seeds: dict[int, list[int]] = defaultdict(list)
        runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        # stretches of words that passages hold, as long as a seed at least
        held = np.flatnonzero(np.asarray(ids, np.int64) >= 0) if ids else np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.diff(held) > 1)
        for lo, hi in zip(np.concatenate(([0], cuts + 1)), np.concatenate((cuts + 1, [len(held)])), strict=True):
            if hi - lo < SEED:
                continue
            state, n = 0, 0
            at_word = int(held[lo])
            for j in range(at_word, at_word + int(hi - lo)):
                w = ids[j]
                while state and w not in nxt[state]:
                    state = link[state]
                    n = length[state]
                if w in nxt[state]:
                    state = nxt[state][w]
                    n += 1
                if n < SEED:
                    continue
                if n >= MIN_WORDS:
                    for k, at in self.ends(self.run_state[state]):
                        runs[k].append((j - MIN_WORDS + 1, j, at - MIN_WORDS + 1, at))
                for k in held_by[seed_state[state]]:
                    seeds[k].append(j)
        out = []
        for k, hits in seeds.items():
            pieces = runs.get(k, [])
            if pieces and not spans:
                pieces = pieces[:1]
            else:
                pieces = pieces + self._places_of(k, ids, hits, spans)
            size = len(self.words[k])
            out += [(self.ids[k], first, last, n, n / size) for first, last, n in _merged(pieces)]
        if self.tiny:
            out += self._tiny(ids, spans)
        return out

    def _places_of(self, k: int, ids: list[int], hits: list[int], spans: bool) -> list[tuple[int, int, int, int]]:
        """(first word, last word, first passage word, last passage word) of the windows of a passage."""
        item = self.words[k]
        size, least = len(item), min(MIN_WORDS, len(item))
        if least < 2 * SEED:
            return [(j - size + 1, j, 0, size - 1) for j in hits if j >= size - 1 and ids[j - size + 1 : j + 1] == item][: None if spans else 1]
        need = max(1, least - int(least * MAX_CHANGED) - (SEED - 1) * (int(least * MAX_CHANGED) + 1))
        if len(hits) < need:
            return []
        # words of a window that stand before, between and after its seeds
        apart = SEED * (int(size * MAX_CHANGED) + 1) + SEED
        held = self.sets[k]
        out: list[tuple[int, int, int, int]] = []
        start = 0
        for x in range(1, len(hits) + 1):
            if x < len(hits) and hits[x] - hits[x - 1] <= apart:
                continue
            if x - start >= need:
                lo, hi = max(0, hits[start] - apart), min(len(ids), hits[x - 1] + apart + 1)
                for b0, b1 in _dense([w in held for w in ids[lo:hi]], least):
                    text = ids[lo + b0 : lo + b1]
                    while _may_hold(item, text, least) and (got := windows(item, text, least, first=not spans)):
                        out += [(lo + b0 + j, lo + b0 + to_j, i, to_i) for j, to_j, i, to_i in got]
                        if not spans:
                            return out
                        for first, last, _, _ in got:
                            text[first : last + 1] = [_BLOT] * (last + 1 - first)
            start = x
        return out

    def _tiny(self, ids: list[int], spans: bool) -> list[tuple[int, int, int, int, float]]:
        out, seen = [], set()
        for j, w in enumerate(ids):
            for k in self.tiny.get(w, ()) if w >= 0 else ():
                size = len(self.words[k])
                if ids[j : j + size] == self.words[k] and (spans or k not in seen):
                    seen.add(k)
                    out.append((self.ids[k], j, j + size - 1, size, 1.0))
        return out


#: A word of the text that has been found already.
_BLOT = -2


def _dense(held: list[bool], least: int) -> list[tuple[int, int]]:
    """Stretches [from, to) of the text in which windows may lie.

    A window of L passage words keeps at least (1 - c) L of them among at most
    (1 + c) L words of the text, c being ``MAX_CHANGED``: only words that stand
    in some stretch with this share of passage words are in a window.
    """
    share, short = (1 - MAX_CHANGED) / (1 + MAX_CHANGED), least - int(least * MAX_CHANGED)
    if sum(held) < short:
        return []
    sums = np.concatenate(([0.0], np.cumsum(np.asarray(held, np.float64) - share)))
    # for each end the earliest start from which the share holds
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums - 1e-9)
    ends = np.nonzero(np.arange(len(sums)) - first >= short)[0]
    depth = np.zeros(len(sums) + 1, np.int64)
    np.add.at(depth, first[ends], 1)
    np.add.at(depth, ends, -1)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(depth) > 0, [False])).astype(np.int8)))
    return [(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2], strict=True)]


def _may_hold(item: list[int], text: list[int], least: int) -> bool:
    """A bound: whether enough of some window of the passage occurs in the text at all."""
    there = set(text)
    total, before, low = 0.0, [0.0], 0.0
    shortest = least - MAX_EDGE
    for i, w in enumerate(item, 1):
        total += (w in there) - (1 - MAX_CHANGED)
        before.append(total)
        if i >= shortest:
            low = min(low, before[i - shortest])
            # a window that lacks up to MAX_EDGE words counts with them, all of them changed
            if total - low >= -MAX_EDGE * (1 - MAX_CHANGED) - 1e-9:
                return True
    return False


def windows(item: list[int], text: list[int], least: int, first: bool = False) -> list[tuple[int, int, int, int]]:
    """(first word, last word, first passage word, last passage word) of windows that share no word of the text.

    Of windows that overlap the one with most words counts, less three for
    each change, so that no window goes on beyond what is quoted.  With
    ``first`` the search ends at the first length that gives a window.

    For every passage word as a start, and every text word that equals it, the
    least number of words altered, added or missing is kept for each length of
    the window and each end in the text, all starts at once.  A window begins
    and ends with a kept word; one that is up to ``MAX_EDGE`` words short of
    ``least`` counts with them, as altered.
    """
    a, b = np.asarray(item, np.int32), np.asarray(text, np.int32)
    n, m = len(a), len(b)
    big, most = 1 << 13, int(n * MAX_CHANGED)  # no window of the passage may have more changes
    same = a[:, None] == b[None, :]
    along = np.arange(m, dtype=np.int16)
    # cost and first text word of the best alignment of passage words [s, s + size) that ends at text word j
    cost = np.where(same, 0, big).astype(np.int16)
    begin = np.where(same, along[None, :], -1).astype(np.int16 if m < (1 << 15) else np.int32)
    found: list[tuple[int, int, int, int, int]] = []  # worth, words, first passage word, first and last word of the text
    for size in range(1, n + 1):
        starts = n - size + 1
        if size > 1:
            cost, begin = cost[:starts], begin[:starts]
            hit = same[size - 1 :]
            left = np.full_like(cost, big)
            left[:, 1:] = cost[:, :-1]
            left_begin = np.full_like(begin, -1)
            left_begin[:, 1:] = begin[:, :-1]
            kept = np.where(hit, left, big)
            if size >= least - MAX_EDGE:
                wide = max(size, least)
                good = kept <= int(wide * MAX_CHANGED) - (wide - size)
                if wide <= n and good.any():
                    for s, j in zip(*np.nonzero(good), strict=True):
                        found.append((size - 3 * int(kept[s, j]), size, int(s), int(left_begin[s, j]), int(j)))
                    if first:
                        break
            diagonal = left + ~hit
            missing = cost + 1
            new = np.where(diagonal <= missing, diagonal, missing)
            new_begin = np.where(diagonal <= missing, left_begin, begin)
            # words added: the best cell to the left, one more for each word between
            level = new - along
            best = np.minimum.accumulate(level, axis=1)
            source = np.maximum.accumulate(np.where(level == best, along, 0), axis=1)
            cost = np.minimum(best + along, big).astype(np.int16)
            begin = np.take_along_axis(new_begin, source.astype(np.int64), axis=1)
            if not (cost <= most).any():
                break
    out: list[tuple[int, int, int, int]] = []
    for _, size, s, begin_at, last in sorted(found, reverse=True):
        if all(last < x or begin_at > y for x, y, _, _ in out):
            out.append((begin_at, last, s, s + size - 1))
    return out


def _merged(pieces: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(first word, last word, passage words covered): the pieces, merged where they share words of the text."""
    out: list[tuple[int, int, set[int]]] = []
    for first, last, i, to_i in sorted(pieces):
        covered = set(range(i, to_i + 1))
        if out and first <= out[-1][1]:
            start, end, before = out[-1]
            out[-1] = (start, max(end, last), before | covered)
        else:
            out.append((first, last, covered))
    return [(first, last, len(covered)) for first, last, covered in out]


# ------------------------------------------------------------------ operators


def _blocks(items: DataFrame, item_key: str, passage: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Passages as words, in blocks of bounded size."""
    block, size = [], 0
    for r in items.select(item_key, passage).filter(F.col(passage).isNotNull()).distinct().orderBy(item_key, passage).toLocalIterator():
        words = words_with_spans(r[1])[0]
        if not words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0], words))
        size += len(words)
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, *, text: str, key: str, passage: str, item_key: str, spans: bool = True) -> DataFrame:
    """(key, item_key, begin, end, n_words, coverage): each document and passage it leaks, with every place in the text.

    ``n_words`` passage words are covered by the place, the share ``coverage`` of the passage.
    Without ``spans`` there is one row for each document and passage, and no place.
    """
    spark = docs.sparkSession
    out_schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}, begin int, end int, n_words int, coverage double"
    parts = []
    for block in _blocks(items, item_key, passage):
        shared = spark.sparkContext.broadcast(Automaton(block))

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in it:
                rows = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not t:
                        continue
                    if spans:
                        words, at = words_with_spans(t)
                    else:
                        words, at = words_of(t), []
                    for i, a, b, n, share in automaton.leaks(words, spans):
                        rows.append((k, i, at[a][0], at[b][1], n, share) if spans else (k, i, None, None, n, share))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1]), *(pa.array(c, pa.int32()) for c in cols[2:5]), pa.array(cols[5], pa.float64())], names=[key, item_key, "begin", "end", "n_words", "coverage"])

        parts.append(docs.select(key, text).mapInArrow(run, out_schema))
    if not parts:
        return spark.createDataFrame([], out_schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def remove_leaks(docs: DataFrame, leaks: DataFrame, *, text: str, key: str, least_words: int = MIN_WORDS - MAX_EDGE, least_coverage: float = 1 - MAX_CHANGED) -> DataFrame:
    """The documents with the spans found by :func:`find_leaks` cut out; others stay as they are.

    A span is cut if it covers at least ``least_words`` words of its passage
    or the share ``least_coverage`` of it.  Every leak reaches one of the
    limits as they are set.
    """
    leaks = leaks.filter((F.col("n_words") >= least_words) | (F.col("coverage") >= least_coverage))
    spans = leaks.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("__spans"))

    @F.pandas_udf("string")
    def cut(texts, all_spans):
        out = []
        for t, spans in zip(texts, all_spans, strict=True):
            if t is None or spans is None:
                out.append(t)
                continue
            kept, at = [], 0
            for s in spans:
                if s["begin"] > at:
                    kept.append(t[at : s["begin"]])
                at = max(at, s["end"])
            out.append("".join(kept) + t[at:])
        return texts.__class__(out, dtype=object)

    return docs.join(spans, key, "left").withColumn(text, cut(text, "__spans")).drop("__spans")
