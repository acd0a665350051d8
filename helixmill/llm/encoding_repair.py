"""Text decoded with the wrong encoding: find it and restore the original.

1. Sentences are reduced to skeletons: words without their non-ASCII
   characters, names and numbers masked.  Sentences of one skeleton are near
   twins, so a garbled word meets its clean form at the same place.
2. Each garbled word is read under all pairs of encodings; a reading counts if
   it is the clean word of a near twin, which is looked up by skeleton, place
   and word, so that no list of twins is compared pairwise.  The runs of
   non-ASCII characters of both words are aligned, and the pair votes for the
   encodings (true, wrong) that turn one into the other.
3. The mappings that got votes are applied to every record: multi-byte ones to
   each run of characters that is the wrong reading of a valid sequence, as
   often as text was decoded wrongly, single-byte ones to sentences whose words
   are implausible as they stand.

Twins are matched over all rows, counted before they are shuffled; what goes
to the driver is at most one row per pair of encodings and one per letter.

Defined results: null, empty and ASCII texts are never garbled; a text with
replacement characters is garbled and lost, its restored text is null; a table
without twins teaches nothing, and only mappings that the caller names are
applied to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.session import cut_lineage, spread

#: Encodings that are considered as the true or the wrong one.
MULTI_BYTE = "utf-8"
WRONG = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "cp1250", "iso8859-15", "iso8859-5", "mac_cyrillic", "cp1253", "cp1254")
TRUE_SINGLE = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "cp1253", "cp1250", "cp1252", "mac_roman", "cp850")
#: Pairs of aligned runs that must speak for a mapping.
MIN_SUPPORT = 2
#: Sets of encodings that explain the same pairs are weighed on the driver up to so many, beyond that in the cluster.
MAX_SETS = 10_000
LOST = "�"

_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_SENTENCE_END = re.compile(r"((?<=[.!?])[ \t]+|[\r\n]+)")


@lru_cache(None)
def _byte_of(encoding: str) -> dict[str, int]:
    """Byte of each character; where a byte has no character, the control of its number stands for it."""
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        out[ch] = b
    if encoding in ("cp1252", "cp1251", "cp1250", "cp1253", "cp1254"):
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


def _plausible(ch: str) -> bool:
    o = ord(ch)
    return (
        0xA0 <= o <= 0x17F or 0x370 <= o <= 0x45F or 0x490 <= o <= 0x491 or 0x300 <= o <= 0x301 or 0x5D0 <= o <= 0x5EA or 0x600 <= o <= 0x6FF
        or 0x2000 <= o <= 0x206F or 0x20A0 <= o <= 0x20BF or 0x2100 <= o <= 0x22FF or 0x2700 <= o <= 0x27BF or 0x2500 <= o <= 0x25FF or 0x2600 <= o <= 0x26FF
        or 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7AF or 0xFE0F == o or 0xFF00 <= o <= 0xFFEF or 0x1F300 <= o <= 0x1FAFF
        or 0x80 <= o <= 0x9F or 0x2C6 <= o <= 0x2DC or o == 0x192
    )


@lru_cache(None)
def _multi_pattern(wrong: str) -> re.Pattern[str]:
    by = lambda lo, hi: "[" + re.escape("".join(ch for ch, b in _byte_of(wrong).items() if lo <= b <= hi)) + "]"
    tail = by(0x80, 0xBF)
    return re.compile(f"{by(0xF0, 0xF4)}{tail}{{3}}|{by(0xE0, 0xEF)}{tail}{{2}}|{by(0xC2, 0xDF)}{tail}")


_ORDINARY = re.compile(r"^(?:[А-Я]?[а-я]+|[А-Я]+)$")


def _natural(run: str) -> bool:
    """Letters as they stand in an ordinary word, not a wrong reading."""
    return bool(_ORDINARY.match(run))


@lru_cache(1 << 17)
def _undo_run(run: str, wrong: str) -> tuple[str, int]:
    """Decode again the parts of a run of non-ASCII characters that are UTF-8 sequences read as ``wrong``."""
    rx, table = _multi_pattern(wrong), _byte_of(wrong)
    out, done, at, n = [], 0, 0, 0
    while m := rx.search(run, at):
        try:
            ch = bytes(table[c] for c in m.group()).decode()
        except UnicodeDecodeError:
            ch = ""
        if ch and _plausible(ch) and not _natural(m.group()) and not (0xA0 > ord(ch) >= 0x80 and wrong not in ("cp1252", "latin-1")):
            out += [run[done : m.start()], ch]
            done = at = m.end()
            n += 1
        else:
            at = m.start() + 1
    return ("".join(out) + run[done:], n) if n else (run, 0)


def undo_multi(text: str, wrong: str, runs: list[str] | None = None) -> tuple[str, int]:
    """Decode again every run of characters that is a UTF-8 sequence read as ``wrong``."""
    n = sum(_undo_run(r, wrong)[1] for r in (_NON_ASCII.findall(text) if runs is None else runs))
    return (_NON_ASCII.sub(lambda m: _undo_run(m.group(), wrong)[0], text), n) if n else (text, 0)


def undo_single(text: str, true: str, wrong: str) -> str | None:
    """Encode the non-ASCII characters in ``wrong``, decode them from ``true``."""
    table = _byte_of(wrong)
    try:
        return _NON_ASCII.sub(lambda m: bytes(table[c] for c in m.group()).decode(true), text)
    except (KeyError, UnicodeDecodeError):
        return None


def _script(ch: str) -> str:
    o = ord(ch)
    if not ch.isalpha():
        return "box" if 0x2500 <= o <= 0x25FF or 0x80 <= o <= 0x9F else ""
    if o < 0x250:
        return "latin" if o < 128 else "accented"
    return "cyrillic" if 0x400 <= o <= 0x52F else "greek" if 0x370 <= o <= 0x3FF else "other"


_RARE_CYRILLIC = set("ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐґЄєЅѕЇїІі")
_SIGNS = set("¤¦¨¬¯´¸¶·©¢£¥ª¹²³¼¾¿¡ˆ˜ƒ†‡‰‹›€™•√∞≈∆◊∫∂∑∏πΩ⌐₧ⁿ░▒▓└┘├┤┬┴┼╔╗╚╝═║")


_SWAPPED_CASE = re.compile(r"(?<![^\W\d_])[а-яё][А-ЯЁ]{2}")
_CYRILLIC_WORD = re.compile(r"[А-Яа-яЁё]+")


def _capitals(text: str) -> float:
    """Share of Cyrillic words that are written in capitals."""
    words = _CYRILLIC_WORD.findall(text)
    return sum(w.isupper() for w in words) / len(words) if words else 0.0


def oddness(text: str) -> int:
    """How often neighbouring characters do not fit each other."""
    return sum(_word_oddness(w) for w in text.split(" ") if not w.isascii())


@lru_cache(1 << 17)
def _word_oddness(word: str) -> int:
    n = accented = letters = 0
    before, before_ch = "", ""
    for ch in word:
        kind = _script(ch)
        letters += kind in ("accented", "cyrillic", "greek", "other", "latin")
        accented += kind == "accented"
        if kind == "box":
            n += 1
        elif before and kind:
            if {before, kind} & {"cyrillic", "greek"} and before != kind:
                n += 1
            elif before_ch.islower() and ch.isupper() and (kind != "latin" or before != "latin"):
                n += 1
        if ch in _SIGNS and before in ("latin", "accented", "cyrillic", "greek"):
            n += 1
        n += ch in _RARE_CYRILLIC
        before, before_ch = kind, ch
    if accented >= 3 and accented > letters // 2:
        n += 1 + (accented == letters)
    elif _SWAPPED_CASE.search(word):
        n += 1
    return n


Mapping = tuple[str, str]
Letters = dict[str, float]


def unlikeliness(text: str, letters: Letters | None) -> float:
    """Mean surprise of the non-ASCII letters, by how often clean words hold them."""
    if not letters:
        return 0.0
    seen = [letters.get(c, letters[""]) for c in text.lower() if c > "\x7f" and c.isalpha()]
    return round(sum(seen) / len(seen), 2) if seen else 0.0


def repair(text: str | None, mappings: list[Mapping], letters: Letters | None = None) -> tuple[str | None, bool]:
    """The restored text and whether the text was garbled; (None, True) where it is lost.

    ``letters`` (surprise by letter) decides between mappings that both give whole words.
    """
    if not text or text.isascii():
        return text, False
    if LOST in text:
        return None, True
    multi = [w for t, w in mappings if t == MULTI_BYTE]
    single = [m for m in mappings if m[0] != MULTI_BYTE]
    once = _undo_all_multi(text, multi, letters)
    options = [_undo_all_single(once, single, letters)]
    if once != text and oddness(options[0]) > 0:
        options.append(_undo_all_single(text, single, letters))
    best = min(options, key=oddness) if len(options) > 1 else options[0]
    return best, best != text


def _foreign(text: str, runs: list[str], wrong: str, letters: Letters | None) -> bool:
    """Whether what would be decoded again is of no script that the rest of the text has, and gives characters that clean words hold."""
    if not letters:
        return False
    gone: set[str] = set()
    for run in set(runs):
        got, n = _undo_run(run, wrong)
        if n:
            if any(c.lower() not in letters for c in set(got) - set(run)):
                return False
            gone |= {_script(c) for c in run if c.isalpha()}
    return not gone & {_script(c) for run in runs if not _undo_run(run, wrong)[1] for c in run if c.isalpha()}


def _undo_all_multi(text: str, multi: list[str], letters: Letters | None = None) -> str:
    now = text
    while True:  # text may have been decoded wrongly any number of times; each one undone makes it shorter
        best, fixed = now, 0
        before, runs = None, _NON_ASCII.findall(now)
        for wrong in multi:
            got, n = undo_multi(now, wrong, runs)
            if n <= fixed:
                continue
            if n < 4 and wrong not in ("cp1252", "latin-1"):
                before = oddness(now) if before is None else before
                if oddness(got) >= before and not _foreign(now, runs, wrong, letters):
                    continue
            best, fixed = got, n
        if not fixed:
            break
        now = best
    return now


def _undo_all_single(text: str, single: list[Mapping], letters: Letters | None) -> str:
    """Undo single-byte mappings sentence by sentence where that makes the words fit."""
    if not single or text.isascii():
        return text
    parts = _SENTENCE_END.split(text)
    used: Counter[Mapping] = Counter()
    for i, part in enumerate(parts):
        if part.isascii() or (was := oddness(part)) < 1:
            continue
        options = [(oddness(got), unlikeliness(got, letters), k, got) for k, (t, w) in enumerate(single) if (got := undo_single(part, t, w)) is not None]
        if options and (low := min(options))[0] * 4 <= was and was - low[0] >= 2:
            parts[i] = low[3]
            used[single[low[2]]] += 1
    for true, wrong in used:  # parts of the same text with few odd letters, or that look whole only because their case is swapped
        for i, part in enumerate(parts):
            if part.isascii() or (got := undo_single(part, true, wrong)) is None:
                continue
            before, after = oddness(part), oddness(got)
            if before > after == 0 or (_capitals(part) > 0.5 and _capitals(got) == 0 and after <= before):
                parts[i] = got
    return "".join(parts)


# ------------------------------------------------------------------ learning


def _mask(word: str) -> str:
    if word.isascii():
        return "#" if any(c.isdigit() for c in word) else "A" if word[:1].isupper() else word
    return "*" + re.sub(r"\d+", "#", _NON_ASCII.sub("", word))


@lru_cache(1 << 17)
def _suspicious(word: str) -> bool:
    return LOST in word or oddness(word) > 0 or any(undo_multi(word, w)[1] for w in WRONG)


@lru_cache(1 << 16)
def readings(word: str) -> list[str]:
    """What a word would be under each pair of encodings, other than as it stands, where its letters fit each other."""
    out = set()
    runs, rest = _NON_ASCII.findall(word), _NON_ASCII.split(word)
    for wrong in WRONG:
        now = word
        while (got := undo_multi(now, wrong))[1]:
            now = got[0]
            out.add(now)
        table = _byte_of(wrong)
        if any(c not in table for run in runs for c in run):
            continue
        raw = [bytes(table[c] for c in run) for run in runs]
        for true in (MULTI_BYTE, *TRUE_SINGLE):
            try:
                read = [r.decode(true) for r in raw] if true != wrong else []
            except UnicodeDecodeError:
                continue
            if read:
                out.add("".join(x for pair in zip(rest, [*read, ""], strict=True) for x in pair))
    return sorted(w for w in out - {word} if not _word_oddness(w))


def sentence_words(df: DataFrame, text: str) -> DataFrame:
    """(skeleton, place, word, odd, n): non-ASCII words by the skeleton of their sentence, counted per batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seen: Counter[tuple[int, int, str]] = Counter()
            for t in batch.column(0).to_pylist():
                if not t or t.isascii():
                    continue
                for sentence in _SENTENCE_END.split(t):
                    if sentence.isascii():
                        continue
                    words = [w for w in sentence.split(" ") if w]
                    key = xxhash.xxh64_intdigest(" ".join(map(_mask, words))) - (1 << 63)
                    for k, w in enumerate(words):
                        if not w.isascii():
                            seen[key, k, w] += 1
            if seen:
                keys = list(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys]), pa.array([_suspicious(k[2]) for k in keys]), pa.array(list(seen.values()), pa.int64())],
                    names=["skeleton", "place", "word", "odd", "n"],
                )

    return df.select(text).mapInArrow(run, "skeleton long, place int, word string, odd boolean, n long")


def explain_pair(garbled: str, clean: str) -> set[tuple[str, str]]:
    """Mappings (true, wrong) that explain an aligned pair of words."""
    a, b = _NON_ASCII.findall(garbled), _NON_ASCII.findall(clean)
    if not a or len(a) != len(b) or _NON_ASCII.split(garbled) != _NON_ASCII.split(clean):
        return set()
    if all(LOST in x for x in a):
        return {(LOST, LOST)}
    out = set()
    for wrong in WRONG:
        table = _byte_of(wrong)
        if any(c not in table for x in a for c in x):
            continue
        raw = [bytes(table[c] for c in x) for x in a]
        for true in (MULTI_BYTE, *TRUE_SINGLE):
            if true == wrong:
                continue
            try:
                got = [r.decode(true) for r in raw]
            except UnicodeDecodeError:
                continue
            if got == b:
                out.add((true, wrong))
            elif true == MULTI_BYTE and [undo_multi(g, wrong)[0] for g in got] == b:
                out.add((true, wrong))
    return out


def learn_mappings(df: DataFrame, text: str) -> tuple[list[tuple[str, str, int]], Letters]:
    """Mappings with the number of different aligned words that speak for them, strongest first; surprise by letter."""
    words = cut_lineage(sentence_words(df, text).groupBy("skeleton", "place", "word", "odd").agg(F.sum("n").alias("n")))

    @F.pandas_udf("array<string>")
    def read(garbled: pd.Series) -> pd.Series:
        return garbled.map(readings)

    @F.pandas_udf("array<string>")
    def explain(garbled: pd.Series, clean: pd.Series) -> pd.Series:
        return pd.Series([sorted("\t".join(m) for m in explain_pair(g, c)) for g, c in zip(garbled, clean, strict=True)])

    clean = words.filter(~F.col("odd")).select("skeleton", "place", F.col("word").alias("clean"))
    read_as = spread(words.filter("odd").select("skeleton", "place", "word")).select("skeleton", "place", "word", F.explode(read("word")).alias("clean"))
    pairs = read_as.join(clean, ["skeleton", "place", "clean"], "left_semi").select("word", "clean").distinct()
    votes = cut_lineage(pairs.select(explain("word", "clean").alias("mappings")).filter("size(mappings) > 0").groupBy("mappings").agg(F.count("*").alias("n")))
    # one row a letter that clean words hold
    held = words.filter(~F.col("odd")).select(F.explode(F.split(F.lower("word"), "")).alias("letter"), "n").filter("letter > '\\u007f'")
    counts = {r["letter"]: r["n"] for r in held.groupBy("letter").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values()) + len(counts) + 1
    letters = {c: -math.log((n + 1) / total) for c, n in counts.items()} | {"": -math.log(1 / total)}
    if votes.limit(MAX_SETS + 1).count() <= MAX_SETS:
        return choose_mappings({frozenset(tuple(m.split("\t")) for m in r["mappings"]): r["n"] for r in votes.collect()}), letters
    found: list[tuple[str, str, int]] = []
    left = votes
    while True:  # one row a pair of encodings comes back in each round
        totals = {tuple(r["m"].split("\t")): r["n"] for r in left.select(F.explode("mappings").alias("m"), "n").groupBy("m").agg(F.sum("n").alias("n")).collect()}
        if not totals or (best := _strongest(totals))[2] < MIN_SUPPORT:
            return found, letters
        found.append(best)
        left = left.filter(~F.array_contains("mappings", "\t".join(best[:2])))


def _strongest(totals: dict[Mapping, int]) -> tuple[str, str, int]:
    best, n = min(totals.items(), key=lambda x: (-x[1], WRONG.index(x[0][1]), x[0]))
    return (*best, n)


def choose_mappings(votes: dict[frozenset, int]) -> list[tuple[str, str, int]]:
    """The fewest mappings that explain the votes: the strongest first, each counted on what is left."""
    left, out = {k: n for k, n in votes.items() if (LOST, LOST) not in k}, []
    while left:
        total: Counter[tuple[str, str]] = Counter()
        for k, n in left.items():
            for m in k:
                total[m] += n
        if (best := _strongest(total))[2] < MIN_SUPPORT:
            break
        out.append(best)
        left = {k: v for k, v in left.items() if best[:2] not in k}
    return out


# ------------------------------------------------------------------ operator


def restore_encoding(df: DataFrame, *, text: str, key: str, mappings: list[Mapping] | None = None) -> DataFrame:
    """(key, restored) of the garbled rows; ``restored`` is null where characters are lost.

    ``mappings`` (true encoding, wrong encoding) are learned from the rows
    themselves unless they are given.
    """
    found, letters = ([(*m, 0) for m in mappings], None) if mappings is not None else learn_mappings(df, text)
    use = [(t, w) for t, w, _ in found]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got = [(k, r) for k, t in zip(keys, texts, strict=True) for r, bad in [repair(t, use, letters)] if bad]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], batch.column(0).type), pa.array([r for _, r in got], pa.string())], names=[key, "restored"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, restored string")
