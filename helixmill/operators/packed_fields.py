"""Several values packed in one field: split into one value per row.

The delimiter is inferred per source.  One pass over the values cuts each by
every candidate delimiter and rates how regular the pieces are (do they look
like the values this field holds?).  For each source, and within it for each
set of separators that a value holds, the candidates are scored over all
values: how consistent their piece counts are, how regular the types of their
pieces, and how often they apply.  A value takes the candidate with the best
sum of its own regularity and the score of its source, so that a source
decides where a value alone leaves it open, and a value that breaks the habit
of its source is still read by its pieces.  Sources may mix conventions.

Defined results: null, blank and separator-only fields give no row; empty
places are not counted; quotes that enclose a value are removed and doubled
quotes inside it become single; a field in which no candidate is regular is
one value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixmill.session import cut_lineage

# ------------------------------------------------------------------ tokens

_QUOTES = "\"'"
_STRONG = {";", "|", "\t", "\n", "\r"}


def _json_list(text: str) -> list[str] | None:
    if not (text.startswith("[") and text.endswith("]")):
        return None
    try:
        got = json.loads(text)
    except ValueError:
        return None
    if not isinstance(got, list):
        return None
    return [str(x).strip() for x in got if x is not None and str(x).strip()]


def _segments(text: str, quote_chars: str) -> list[tuple[str, bool]]:
    """Cut text into (piece, quoted); a quote protects only where a value begins and ends."""
    if not any(q in text for q in quote_chars):
        return [(text, False)]
    out: list[tuple[str, bool]] = []
    plain: list[str] = []
    i, n, at_start = 0, len(text), True
    while i < n:
        ch = text[i]
        if at_start and ch in quote_chars:
            j, buf, closed = i + 1, [], False
            while j < n:
                if text[j] == ch:
                    if j + 1 < n and text[j + 1] == ch:
                        buf.append(ch)
                        j += 2
                        continue
                    rest = text[j + 1 :].lstrip(" ")
                    if not rest or rest[0] in ",;|\t\n\r/&" or text[j + 1 : j + 2] == " ":
                        closed = True
                        break
                buf.append(text[j])
                j += 1
            if closed:
                if plain:
                    out.append(("".join(plain), False))
                    plain = []
                out.append(("".join(buf).strip(), True))
                i, at_start = j + 1, False
                # what follows a closed quote is a separator; values may start after it
                at_start = True
                continue
        plain.append(ch)
        if ch in ",;|\t\n\r/" or (ch == " " and at_start):
            at_start = True
        elif ch == " ":
            at_start = quote_chars == _QUOTES  # ids may be separated by blanks alone
        else:
            at_start = False
        i += 1
    if plain:
        out.append(("".join(plain), False))
    return out


# ---------------------------------------------------------------- piece types

_WORD = r"(?:[^\W\d_][\w’'\-]*)"
_PARTICLE = r"(?:v[aáàâä]n|d[eéèêë]r|d[eéèêë]n|d[eéèêë]|d[eéèêë]l|della|d[iíì]|d[aáàâä]|dos|d[uúùü]|[eéèêë]l|[aáàâä]l|l[aáàâä]|l[eéèêë]|v[oóòôö]n|zu|bin|ibn|ter|ten|af)"
_INITIALS = r"(?:(?:[^\W\d_]\.[\s\-]?){1,4}|[^\W\d_]{1,3}\.?)"
_GIVEN = re.compile(
    rf"^(?:{_WORD}\.?(?:[ \-]{_WORD})?(?:\s+(?:[^\W\d_]\.?\s?){{1,3}})?|(?:[^\W\d_]\.?[\s\-]?){{1,4}})"
    rf"(?:\s+{_PARTICLE}(?:\s+{_PARTICLE})?)?(?:\s*[\"“][^\"“”;,]+[\"”])?$|^(?:{_PARTICLE}\s+){{1,2}}{_WORD}$"
)
_ONE_GIVEN = re.compile(
    rf"^(?:{_WORD}\.?(?:\s+(?:[^\W\d_]\.?\s?){{1,3}})?|(?:[^\W\d_]\.?[\s\-]?){{1,4}})"
    rf"(?:\s+{_PARTICLE}(?:\s+{_PARTICLE})?)?(?:\s*[\"“][^\"“”;,]+[\"”])?$"
)
_INITIAL_ONLY = re.compile(rf"^(?:[^\W\d_]\.?[\s\-]?){{1,4}}(?:\s+{_PARTICLE}(?:\s+{_PARTICLE})?)?$")
_SURNAME = re.compile(rf"^(?:{_PARTICLE}\s+){{0,2}}{_WORD}(?:\s{_WORD})?$", re.I)
_FULL = re.compile(
    rf"^(?:(?:Dr|Prof|Mr|Mrs|Ms)\.?\s+)?(?:{_PARTICLE}\s+){{0,2}}(?:{_WORD}\.?|(?:[^\W\d_]\.\s?)+)"
    rf"(?:\s+(?:{_WORD}\.?|[^\W\d_]\.|[\"“].+[\"”])){{1,4}}$",
    re.I,
)
#: Words that name a collective or an institution (fixed values).
COLLECTIVE_WORDS = (
    "institute", "institut", "institution", "consortium", "group", "university", "laboratory", "laboratories",
    "network", "team", "survey", "center", "centre", "committee", "initiative", "ministry", "hospital", "program",
    "programme", "project", "service", "society", "association", "department", "division", "agency", "core",
    "alliance", "collaboration", "collaborative", "foundation", "museum", "school", "college", "faculty", "unit",
    "task force", "study", "investigators", "authority", "council", "commission", "office", "bureau", "panel",
)
_COLLECTIVE = frozenset(COLLECTIVE_WORDS)
_TOKEN = re.compile(r"\w+")
_SUBUNIT = re.compile(r"^(?:[\w\-]+\s+)?(?:unit|panel|branch|section|division|core|team|group|wing|node|chapter)(?:\s+\w+)?$", re.I)
_CONJ = re.compile(r"\s+(?:[Aa]nd|AND|&|und|et|y)\s+|\s+(?:[Aa]nd|AND|&)\s*$|^\s*(?:[Aa]nd|AND|&)\s+")


@lru_cache(1 << 17)
def person_pair(piece: str) -> bool:
    """``Surname, Given`` in one piece."""
    a, sep, b = piece.partition(",")
    return bool(sep) and bool(_SURNAME.match(a.strip())) and bool(_GIVEN.match(b.strip()))


def is_person(piece: str) -> bool:
    """One person's name, with or without a comma of its own."""
    return person_pair(piece) or (("," not in piece) and bool(_FULL.match(piece)))


@lru_cache(1 << 17)
def is_collective(piece: str) -> bool:
    """A collective or an institution."""
    low = piece.lower()
    return not _COLLECTIVE.isdisjoint(_TOKEN.findall(low)) or "task force" in low


def _split_conj(piece: str) -> list[str]:
    """Cut at conjunctions between persons; a collective keeps its own ones."""
    if not any(c in piece for c in ("&", "nd", "ND", "et", "y")):
        return [piece.strip(" ,") or piece]
    parts = [p.strip(" ,") for p in _CONJ.split(piece)]
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return parts or [piece]
    if not is_collective(piece):
        return parts
    clear = [person_pair(p) or bool(re.match(r"^(?:Dr\.?\s|[^\W\d_]\.\s)", p)) for p in parts]
    left = 0
    while left < len(parts) and clear[left]:
        left += 1
    right = len(parts)
    while right > left and clear[right - 1]:
        right -= 1
    if left == 0 and right == len(parts):
        return [piece]
    middle_at = piece.find(parts[left]) if left < right else -1
    middle = piece[middle_at : piece.find(parts[right - 1], middle_at) + len(parts[right - 1])] if left < right else ""
    return parts[:left] + ([middle] if middle else []) + parts[right:]


def _comma_pieces(text: str) -> list[str]:
    return [p for p in (re.sub(r"^(?:and|&)\s+", "", x.strip(), flags=re.I).strip() for x in text.split(",")) if p]


def _pairs(text: str) -> list[str] | None:
    """Comma list read as Surname, Given, Surname, Given ..."""
    raw = [x.strip() for x in _CONJ.sub(" , ", text).split(",")]
    raw = [x for x in raw if x]
    if len(raw) < 2 or len(raw) % 2:
        return None
    return [f"{raw[i]}, {raw[i + 1]}" for i in range(0, len(raw), 2)]


def _author_candidates(text: str) -> dict[str, list[str]]:
    """Candidate splits of a piece of text without quotes, by delimiter."""
    out: dict[str, list[str]] = {"none": [text]}
    strong = [p.strip() for p in re.split(r"[;|\t\r\n]+|\s/\s", text)]
    strong = [p for p in strong if p]
    merged: list[str] = []
    for p in strong:
        if merged and is_collective(merged[-1]) and _SUBUNIT.match(p) and not is_person_with_initial(p):
            merged[-1] = text[text.find(merged[-1]) : text.find(p, text.find(merged[-1]) + len(merged[-1])) + len(p)]
        else:
            merged.append(p)
    if len(merged) > 1 or (merged and merged[0] != text.strip()):
        out["strong"] = [q for p in merged for q in _split_conj(re.sub(r"^(?:and|&)\s+", "", p, flags=re.I))]
    conj = _split_conj(text)
    if len(conj) > 1:
        out["conjunction"] = conj
    if "," in text:
        pieces = [q for p in _comma_pieces(text) for q in _split_conj(p)]
        if len(pieces) > 1:
            out["comma"] = pieces
        if (pairs := _pairs(text)) and len(pairs) > 1:
            out["comma_pairs"] = pairs
    return out


def is_person_with_initial(piece: str) -> bool:
    return bool(re.search(r"\b[^\W\d_]\.", piece))


@lru_cache(1 << 17)
def _author_worth(p: str) -> float:
    """How surely a piece is one person or one collective."""
    whole = not any(c in p for c in _STRONG)
    if is_collective(p):
        return 1.0 if whole else 0.3
    if not whole:
        return 0.0
    if person_pair(p):
        a, _, b = p.partition(",")
        # a given name of one word (and initials) is surer than one of two words
        sure = bool(_ONE_GIVEN.match(b.strip())) and (len(a.split()) == 1 or len(a.split()[0]) == 1 or bool(_IS_PARTICLE.match(a.split()[0])) or bool(_INITIAL_ONLY.match(b.strip())))
        return 1.0 if sure else 0.55
    return 0.98 if "," not in p and _FULL.match(p) else 0.0


def _author_regularity(pieces: list[str]) -> float:
    """Share of pieces that are one person or one collective."""
    return sum(map(_author_worth, pieces)) / len(pieces) if pieces else 0.0


_IS_PARTICLE = re.compile(rf"^{_PARTICLE}$", re.I)


def _id_candidates(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {"none": [text.strip()]}
    for name, pattern in (("strong", r"[;|,\t\r\n]+"), ("blank", r"[;|,\s]+"), ("slash", r"[;|,\s/]+")):
        pieces = [p.strip() for p in re.split(pattern, text)]
        out[name] = [p for p in pieces if p]
    return out


_ID = re.compile(r"^[A-Za-z][\w.\-/:@]*\d[\w.\-/:@]*$")


def _shape(piece: str) -> str:
    return re.sub(r"[A-Z]+", "A", re.sub(r"[a-z0-9]+", "9", piece.rsplit("_", 1)[0] if "_" in piece else piece))


def _id_regularity(pieces: list[str]) -> float:
    """Share of pieces that look like an id, less for pieces of several shapes."""
    if not pieces:
        return 0.0
    good = sum(bool(_ID.match(p)) for p in pieces) / len(pieces)
    shapes = len({re.sub(r"[^/]", "", p) + ("_" if "_" in p else "") for p in pieces})
    return good / shapes


@lru_cache(1 << 17)
def _author_type(p: str) -> str:
    return "collective" if is_collective(p) else "pair" if person_pair(p) else "full" if "," not in p and _FULL.match(p) else "other"


FieldKind = tuple[str, Callable[[str], dict[str, list[str]]], Callable[[list[str]], float], Callable[[str], str]]

#: What a field holds: the quotes it uses, its candidate splits, the regularity of pieces, the type of a piece.
KINDS: dict[str, FieldKind] = {
    "person": ('"', _author_candidates, _author_regularity, _author_type),
    "id": (_QUOTES, _id_candidates, _id_regularity, _shape),
}


# ---------------------------------------------------------------- one value

#: Weight of the source's score beside the regularity (up to 1) of the value's own pieces.
SOURCE_WEIGHT = 0.1

#: (candidate delimiter, pieces, regularity)
Candidate = tuple[str, list[str], float]

_EDGES = " \t\r\n,;|/&"
_LEADING_AND = re.compile(r"^(?:and|&)\s+|\s+(?:and|&)$", re.I)
_HELD = (";", "|", "\t", "\n", "\r", " / ", " & ", " and ", '"', "'")


def _bare(p: str) -> str:
    """Without commas and blanks at its ends."""
    while p and (p[0] == "," or p[-1] == "," or p[0].isspace() or p[-1].isspace()):
        p = p.strip(",").strip()
    return p


def _tidy(pieces: list[str]) -> list[str]:
    trimmed = (p.strip(" \t\r\n;|") for p in pieces)
    return [t for p in trimmed if p.strip(" \t\r\n,;|/") and (t := _bare(p))]


def separators_held(text: str) -> str:
    """The separators that a value holds, commas by their number: what its writer had to choose from."""
    low = text.lower()
    return "".join(s for s in _HELD if s in low) + "," * min(low.count(","), 3)


def candidates_of(text: str | None, kind_name: str) -> list[list[Candidate]]:
    """The parts of a field (text between quoted values), each with its candidate splits."""
    if text is None or not text.strip():
        return []
    if (listed := _json_list(text.strip())) is not None:
        return [[("list", [t for x in listed if (t := _bare(x))], 1.0)]]
    kind = KINDS[kind_name]
    parts = _segments(text, kind[0])
    out: list[list[Candidate]] = []
    for part, quoted in parts:
        if quoted:
            if got := _bare(part):
                out.append([("quoted", [got], 1.0)])
            continue
        part = part.strip(_EDGES) if len(parts) > 1 else part
        part = _LEADING_AND.sub("", part.strip()) if kind_name == "person" else part
        if not part.strip(_EDGES):
            continue
        splits = kind[1](part)
        if all(splits.values()):
            out.append([(name, _tidy(pieces), round(kind[2](pieces), 3)) for name, pieces in splits.items()])
    return out


def choose(part: list[Candidate], scores: dict[str, float]) -> Candidate:
    """The candidate with the best sum of its own regularity and the score of its source; of equal ones the finer, then the first."""
    return max(part, key=lambda c: (round(c[2] + SOURCE_WEIGHT * scores.get(c[0], 0.0), 6), len(c[1])))


def split_value(text: str | None, kind_name: str, scores: dict[str, float] | None = None) -> tuple[str, list[str]]:
    """The winning candidate and the values of one field."""
    won = [choose(part, scores or {}) for part in candidates_of(text, kind_name)]
    names = [name for name, _, _ in won]
    return ("quoted" if "quoted" in names else names[0] if names else "empty"), [p for _, pieces, _ in won for p in pieces]


# ---------------------------------------------------------------- operator


def _source_scores(stats: DataFrame) -> DataFrame:
    """(__source, __scores): the score of each candidate in each source.

    The mean of three: piece counts that vary little (one over one plus their
    relative deviation), regular pieces, and pieces of few types (the chance
    that two of them are of one type), as far as the candidate applies to the
    values of the source.
    """
    types = stats.filter("__type is not null").groupBy("__source", "__cand", "__type").agg(F.sum("__pieces").alias("__pieces"))
    share = F.sum(F.col("__pieces") * F.col("__pieces")) / F.pow(F.sum("__pieces"), F.lit(2))
    types = types.groupBy("__source", "__cand").agg(share.alias("__share"))
    s = stats.filter("__type is null").groupBy("__source", "__cand").agg(*(F.sum(c).alias(c) for c in ("__n", "__pieces", "__squares", "__regularity")))
    mean = F.col("__pieces") / F.col("__n")
    deviation = F.sqrt(F.greatest(F.col("__squares") / F.col("__n") - mean * mean, F.lit(0.0))) / F.greatest(mean, F.lit(1.0))
    s = s.join(types, ["__source", "__cand"]).select("__source", "__cand", "__n", ((1 / (1 + deviation) + F.col("__regularity") / F.col("__n") + F.col("__share")) / 3).alias("__score"))
    rows = F.map_from_entries(F.collect_list(F.struct("__cand", F.struct("__n", "__score"))))  # a few candidates a source
    s = s.groupBy("__source").agg(rows.alias("__m"), F.max("__n").alias("__all"))
    return s.select("__source", F.transform_values("__m", lambda _, v: v["__score"] * v["__n"] / F.col("__all")).alias("__scores"))


_OPEN = "array<array<struct<cand:string,pieces:array<string>,regularity:double>>>"


def split_packed(df: DataFrame, *, value: str, source: Column, kind: str) -> DataFrame:
    """Explode the packed column ``value`` into ``pos`` (from 1) and ``item``.

    ``source`` groups rows written by the same hand.  All other columns are
    kept.  Null and blank fields give no row.

    One Python pass cuts and rates the values and counts, batch by batch, what
    the scores of the sources need; values for which one candidate wins
    whatever its source says leave it decided, so that only open ones meet the
    scores (a few rows a source; the planner broadcasts them by their size).
    """
    rows = df.filter(F.length(F.trim(F.col(value))) > 0).withColumn("__source", F.coalesce(source.cast("string"), F.lit("")))
    kept = rows.columns
    extra = "__items array<string>, __open string, __cand string, __type string, __n long, __pieces long, __squares long, __regularity double"
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + list(T._parse_datatype_string(extra).fields))
    arrow = to_arrow_schema(schema)
    at_value, at_source = kept.index(value), kept.index("__source")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            items: list[list[str] | None] = []
            open_: list[str | None] = []
            groups: list[str] = []
            seen: dict[tuple[str, str, str | None], list[float]] = {}
            type_of = KINDS[kind][3]
            for text, src in zip(batch.column(at_value).to_pylist(), batch.column(at_source).to_pylist(), strict=True):
                group = f"{src}\x01{separators_held(text)}"
                parts = candidates_of(text, kind)
                live, undecided = [], False
                for part in parts:
                    for name, pieces, regularity in part:
                        for piece in pieces:
                            seen.setdefault((group, name, type_of(piece)), [0, 0, 0, 0.0])[1] += 1
                        tally = seen.setdefault((group, name, None), [0, 0, 0, 0.0])
                        n = len(pieces)
                        tally[0] += 1
                        tally[1] += n
                        tally[2] += n * n
                        tally[3] += regularity
                    best = max(c[2] for c in part)
                    part = [c for c in part if c[2] >= best - SOURCE_WEIGHT]
                    undecided |= len(part) > 1 and any(c[1] != part[0][1] for c in part)
                    live.append(part)
                groups.append(group)
                items.append(None if undecided else [p for part in live for p in part[0][1]])
                open_.append(json.dumps([[{"cand": c, "pieces": p, "regularity": r} for c, p, r in part] for part in live]) if undecided else None)
            n, m = len(items), len(seen)
            names = arrow.names[len(kept) :]
            rated = {"__items": pa.array(items, pa.list_(pa.string())), "__open": pa.array(open_, pa.string())}
            if n:
                own = [pa.array(groups, pa.string()) if k == at_source else batch.column(k) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, *(rated.get(c, pa.nulls(n, arrow.field(c).type)) for c in names)], names=arrow.names)
            counted = {"__cand": [k[1] for k in seen], "__type": [k[2] for k in seen], **{c: [v[i] for v in seen.values()] for i, c in enumerate(("__n", "__pieces", "__squares", "__regularity"))}}
            if m:
                own = [pa.array([k[0] for k in seen], pa.string()) if k == at_source else pa.nulls(m, arrow.field(k).type) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(counted[c], arrow.field(c).type) if c in counted else pa.nulls(m, arrow.field(c).type) for c in names)], names=arrow.names)

    out = cut_lineage(rows.mapInArrow(run, schema))
    values = out.filter("__cand is null")
    parts = F.from_json("__open", _OPEN)
    total = lambda c: F.round(c["regularity"] + SOURCE_WEIGHT * F.coalesce(F.element_at("__scores", c["cand"]), F.lit(0.0)), 6)
    best = lambda part: F.array_max(F.transform(part, lambda c, i: F.struct(total(c).alias("a"), F.size(c["pieces"]).alias("b"), (-i).alias("c"), c["pieces"].alias("pieces"))))["pieces"]
    closed = values.filter("__open is null").select(*df.columns, "__items")
    settled = values.filter("__open is not null").join(_source_scores(out.filter("__cand is not null")), "__source", "left").select(*df.columns, F.flatten(F.transform(parts, best)).alias("__items"))
    return closed.unionAll(settled).select(*df.columns, F.posexplode("__items").alias("__pos", "item")).withColumn("pos", F.col("__pos") + 1).drop("__pos")
