"""Free-entered values mapped to a canonical list.

Values are deduplicated before anything is done with them.  Each distinct
value is normalised and cut into the parts that may hold the name.  For each
part, all names that share a character n-gram (also one with a gap, which
survives a transposition) come from an inverted index over the list and are
scored by the cosine of their n-gram weights (inverse document frequency over
the list).  Names above the threshold are checked exactly: a name must be
within the typing errors that its length allows, with the same digits.  The
best cosine is accepted with a margin over the best name of any other entry;
among names whose cosines are close, those with more errors than another fall
back.  Everything else is reported as unmatched.

The list with its other names is small by nature; its size is checked against
``MAX_NAMES`` before it is read to the driver and before the index is broadcast.

Defined results: null and blank values give no row; values that fit two
entries alike, or several entries at once, are unmatched (``UNMATCHED``).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.session import spread

UNMATCHED = -1
MAX_NAMES = 200_000
#: Accepted cosine, margin over the names of other entries, and what counts as close.
MIN_COSINE = 0.25
MIN_MARGIN = 0.02
CLOSE = 0.1


_WORDS = re.compile(r"[^\W_]+")


@lru_cache(1 << 16)
def fold(text: str) -> str:
    """Lower case, no accents, words separated by one blank."""
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("ı", "i").replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("ß", "ss").replace("’", "'"))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return " ".join(_WORDS.findall(text.replace("&", " and ").replace("'", "")))


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; ``most + 1`` where it is larger.

    What both texts begin and end with costs nothing; of the rest only the
    cells within ``most`` of the diagonal are filled.
    """
    far = most + 1
    if abs(len(a) - len(b)) > most:
        return far
    if a == b:
        return 0
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    n, m = len(a), len(b)
    if not n or not m:
        return min(max(n, m), far)
    before: list[int] = []
    prev = [*range(min(m, most) + 1), *([far] * (m - most))]
    for i in range(1, n + 1):
        x = a[i - 1]
        lo, hi = i - most if i > most else 1, i + most if i + most < m else m
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        low = far
        left = row[lo - 1]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = prev[j - 1] if x == y else prev[j - 1] + 1
            if prev[j] + 1 < v:
                v = prev[j] + 1
            if left + 1 < v:
                v = left + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            row[j] = left = v
            if v < low:
                low = v
        if low > most:
            return far
        before, prev = prev, row
    return min(prev[m], far)


def allowed_edits(n: int) -> int:
    """Typing errors that a name of n characters may have."""
    return 0 if n < 3 else 1 if n < 6 else 2 if n < 10 else 3 if n < 15 else 4 if n < 21 else 5


@dataclass
class NameIndex:
    """Inverted n-gram index over (entry, name); ``codes`` are matched as they stand.

    ``generic`` words stand in many names; what is left without them must fit by itself.
    """

    names: list[tuple[int, str]]
    codes: dict[str, set[int]] = field(default_factory=dict)
    generic: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        folded: dict[str, set[int]] = defaultdict(set)
        for ref, name in self.names:
            if f := fold(name):
                folded[f].add(ref)
        # a name of several entries means none of them
        self.entry = {n: next(iter(refs)) if len(refs) == 1 else UNMATCHED for n, refs in folded.items()}
        self.keys = list(self.entry)
        self.cores = [self.core(n) for n in self.keys]
        grams = [self._grams(n) for n in self.keys]
        seen: dict[str, int] = defaultdict(int)
        for g in grams:
            for x in g:
                seen[x] += 1
        self.weight = {x: 1.0 + math.log(len(grams) / n) for x, n in seen.items()}
        self.rare = 1.0 + math.log(len(grams) + 1.0)
        posting: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        for k, g in enumerate(grams):
            norm = math.sqrt(sum((c * self.weight[x]) ** 2 for x, c in g.items()))
            for x, c in g.items():
                posting[x][0].append(k)
                posting[x][1].append(c * self.weight[x] / norm)
        self.posting = {x: (np.asarray(k, np.int32), np.asarray(v)) for x, (k, v) in posting.items()}

    @staticmethod
    def _grams(text: str) -> dict[str, int]:
        padded = f"^{text}$"
        out: dict[str, int] = defaultdict(int)
        for ch in text:
            out[ch] += 1
        for n in (2, 3):
            for i in range(len(padded) - n + 1):
                out[padded[i : i + n]] += 1
        for i in range(len(padded) - 2):
            out[f"{padded[i]}\x00{padded[i + 2]}"] += 1
        return out

    def core(self, folded: str) -> str:
        """The words that are not generic, nor a generic word with a typing error."""
        if not self.generic:
            return folded
        left = []
        for w in folded.split():
            most = 2 if len(w) >= 7 else 1
            if w in self.generic or len(w) < 3 or any(abs(len(g) - len(w)) <= most and osa(w, g, most) <= most for g in self.generic if len(g) > 3 or len(w) < 5):
                continue
            left.append(w)
        return " ".join(left)

    def best(self, part: str) -> tuple[int, float, float]:
        """(entry, score, margin) of the closest name; entry is UNMATCHED where none is close."""
        f = fold(part)
        got = self._best(f)
        if got[0] == UNMATCHED and f not in self.entry and (c := self.core(f)) and c != f and (len(c) > 3 or c in self.entry):
            return self._best(c)
        return got

    def _best(self, f: str) -> tuple[int, float, float]:
        if not f:
            return UNMATCHED, 0.0, 0.0
        if f in self.entry:
            return self.entry[f], 1.0, 1.0
        grams = self._grams(f)
        norm = math.sqrt(sum((c * self.weight.get(x, self.rare)) ** 2 for x, c in grams.items()))
        cosines = np.zeros(len(self.keys))
        for x, c in grams.items():
            if x in self.posting:
                names, weights = self.posting[x]
                cosines[names] += weights * (c * self.weight[x] / norm)
        core = self.core(f)
        fitting: list[tuple[float, int, int]] = []  # cosine, errors, entry
        for k in np.flatnonzero(cosines >= MIN_COSINE).tolist():
            name = self.keys[k]
            most = allowed_edits(max(len(f), len(name)))
            if abs(len(f) - len(name)) > most or (d := osa(f, name, most)) > most or (d and sorted(re.findall(r"\d", f)) != sorted(re.findall(r"\d", name))):
                continue
            if self.generic and core != f:
                other = self.cores[k]
                least = allowed_edits(max(len(core), len(other)))
                if osa(core, other, least) > least:
                    continue
            fitting.append((float(cosines[k]), d, self.entry[name]))
        if not fitting:
            return UNMATCHED, float(cosines.max(initial=0.0)), 0.0
        top = max(fitting)[0]
        by_entry: dict[int, tuple[int, float]] = {}
        for cosine, d, entry in fitting:
            if cosine >= top - CLOSE:
                by_entry[entry] = max(by_entry.get(entry, (-d, cosine)), (-d, cosine))
        (d, score, entry), *others = sorted(((d, c, e) for e, (d, c) in by_entry.items()), reverse=True)
        margin = score - max((c for n, c, _ in others if n == d), default=0.0)
        return (entry if margin >= MIN_MARGIN else UNMATCHED), score, margin


Parts = Callable[[str], list[list[str]]]


def decide(value: str, index: NameIndex, parts: Parts, known_none: int = -2) -> tuple[int, float]:
    """Entry and score of one value.

    ``parts`` gives the readings of the value in order of preference, each a
    list of parts that must all mean the same entry.  The first reading with a
    match decides; entry ``known_none`` marks names known to be outside the list.
    """
    for reading in parts(value):
        got: list[tuple[int, float]] = []
        for p in reading:
            bare = p.strip().strip(".")
            if bare in index.codes:
                refs = index.codes[bare]
                got.append((next(iter(refs)) if len(refs) == 1 else known_none, 1.0))
                continue
            entry, score, _ = index.best(p)
            if entry != UNMATCHED:
                got.append((entry, score))
            elif fold(p) in index.entry:  # a name of several entries
                return UNMATCHED, score
        if got:
            entries = {e for e, _ in got}
            if len(entries) > 1 or known_none in entries or len(got) < len(reading):
                return UNMATCHED, min(s for _, s in got)
            return got[0][0], min(s for _, s in got)
    return UNMATCHED, 0.0


# ------------------------------------------------------------------ operator


def reference_rows(df: DataFrame) -> list:
    """The rows of a reference list; refused before they are read if there are more than ``MAX_NAMES``."""
    if df.limit(MAX_NAMES + 1).count() > MAX_NAMES:
        raise ValueError(f"a reference list may have {MAX_NAMES} rows at most")
    return df.collect()


def map_to_canonical(df: DataFrame, *, value: str, index: NameIndex, parts: Parts) -> DataFrame:
    """(value, ref_id, score) for each distinct value that is neither null nor blank.

    The index is built once, on the driver, and broadcast.
    """
    if len(index.names) > MAX_NAMES:
        raise ValueError(f"the list has {len(index.names)} names; at most {MAX_NAMES} are broadcast")
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        for batch in it:
            values = batch.column(0).to_pylist()
            got = [decide(v, here, parts) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e for e, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], names=[value, "ref_id", "score"])

    distinct = spread(df.select(value).filter(F.regexp_replace(value, r"\s+", "") != "").distinct())
    return distinct.mapInArrow(run, f"`{value}` string, ref_id long, score double")
