"""Deeply nested semi-structured records: flat, linked rows from JSON text.

Whole Arrow batches are indexed at once.  Quote, bracket and delimiter bitmaps
over the bytes of the batch give the structural tokens, a prefix sum over the
brackets gives each token's nesting depth, and sorting the tokens by (record,
depth, place) puts the delimiters of one container next to each other, so that
member spans are differences of neighbouring tokens.  No parser runs over the
text; only the spans that are asked for are decoded.

Defined results: null, blank, damaged (unbalanced) payloads and payloads that
are no JSON object give no row; an object that was encoded as a JSON string
(also repeatedly) counts; ``null`` elements are skipped and not counted; a
single element in place of a list is a list of one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes indexed together; a longer record forms a batch of its own.
BATCH_BYTES = 8 << 20


def unwrap(text: str | None) -> str | None:
    """The text of a JSON object, from which string encoding is removed, however often it was applied."""
    if text is None:
        return None
    while True:  # each round makes the text shorter
        text = text.strip().lstrip("﻿")
        if not text.startswith('"'):
            break
        try:
            text = json.loads(text)
        except ValueError:
            return None
        if not isinstance(text, str):
            return None
    return text if text and text.startswith("{") and text.endswith("}") else None


@dataclass
class Members:
    """Members of all containers of a batch: one entry per object member or list element."""

    buf: bytes
    record: np.ndarray  # record number
    level: np.ndarray  # 1 for members of the top object
    parent: np.ndarray  # member whose value is the container, -1 for the top object
    ordinal: np.ndarray  # from 0, in the container
    key_at: np.ndarray  # span of the key with its quotes, -1 in lists
    key_end: np.ndarray
    at: np.ndarray  # span of the value
    end: np.ndarray
    first_child: np.ndarray  # children are neighbours: first_child .. first_child + n_children
    n_children: np.ndarray

    def as_lists(self) -> Members:
        """Plain lists in place of arrays: faster where members are visited one by one."""
        return Members(self.buf, *(getattr(self, f.name).tolist() for f in fields(self)[1:]))

    def key(self, i: int) -> str:
        raw = self.buf[self.key_at[i] + 1 : self.key_end[i] - 1]
        return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode()

    def kind(self, i: int) -> str:
        c = self.buf[self.at[i]]
        return {123: "object", 91: "array", 34: "string", 110: "null", 116: "boolean", 102: "boolean"}.get(c, "number")

    def text(self, i: int) -> str:
        """Scalars as text, containers as their JSON."""
        raw = self.buf[self.at[i] : self.end[i]]
        if raw[:1] == b'"':
            return json.loads(raw) if b"\\" in raw else raw[1:-1].decode()
        return raw.decode()

    def children(self, i: int) -> range:
        return range(self.first_child[i], self.first_child[i] + self.n_children[i])

    def fields(self, i: int) -> dict[str, int]:
        return {self.key(j): j for j in self.children(i) if self.key_at[j] >= 0}

    def elements(self, i: int) -> list[int]:
        """Elements of a list, or the single element in its place, without nulls."""
        kind = self.kind(i)
        if kind == "null":
            return []
        if kind == "array":
            return [j for j in self.children(i) if self.buf[self.at[j]] != 110]
        return [i]


def index_batch(texts: list[str]) -> Members:
    """Index JSON objects given as text; damaged ones get no members."""
    parts = [t.encode() for t in texts]
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    buf = b"\n".join(parts) + b"\n"
    a = np.frombuffer(buf, np.uint8)
    n = len(texts)

    quotes = np.flatnonzero(a == 34)
    if (slashes := np.flatnonzero(a == 92)).size:
        run_begin = np.r_[True, np.diff(slashes) > 1]
        begin_of = slashes[np.maximum.accumulate(np.where(run_begin, np.arange(slashes.size), 0))]
        at = np.searchsorted(slashes, quotes - 1)
        before = (at < slashes.size) & (slashes[np.minimum(at, slashes.size - 1)] == quotes - 1)
        run = np.where(before, quotes - begin_of[np.minimum(at, slashes.size - 1)], 0)
        quotes = quotes[run % 2 == 0]
    quotes_before = np.searchsorted(quotes, starts)

    is_open, is_close = (a == 123) | (a == 91), (a == 125) | (a == 93)
    pos = np.flatnonzero(is_open | is_close | (a == 44) | (a == 58))
    rec = np.searchsorted(starts, pos, "right") - 1
    inside = (np.searchsorted(quotes, pos) - quotes_before[rec]) % 2 == 1
    pos, rec = pos[~inside], rec[~inside]
    opens, closes, byte = is_open[pos], is_close[pos], a[pos]

    delta = opens.astype(np.int64) - closes
    depth = np.cumsum(delta)
    first = np.searchsorted(rec, np.arange(n))
    last = np.searchsorted(rec, np.arange(n), "right") - 1
    has = last >= first
    base = np.where(has, depth[np.minimum(first, max(pos.size - 1, 0))] - delta[np.minimum(first, max(pos.size - 1, 0))], 0) if pos.size else np.zeros(n, np.int64)
    depth = depth - base[rec] if pos.size else depth
    good = has & (np.diff(quotes_before) % 2 == 0)
    if pos.size:
        good &= depth[np.maximum(last, 0)] == 0
        # the top object ends at the last token and nowhere before
        zero = np.bincount(rec[depth <= 0], minlength=n)
        good &= zero == 1
    keep = good[rec]
    pos, rec, opens, closes, byte, depth = (x[keep] for x in (pos, rec, opens, closes, byte, depth))
    level = depth + closes  # of the container that the token belongs to

    order = np.lexsort((pos, level, rec))
    pos, rec, opens, closes, byte, level = (x[order] for x in (pos, rec, opens, closes, byte, level))
    container = np.cumsum(opens) - 1
    open_at = pos[opens]
    # bracket kinds must agree; records in which they don't are dropped
    if open_at.size:
        wrong = closes & (byte != a[open_at[container]] + 2)
        bad = np.unique(rec[wrong])
        if bad.size:
            keep = ~np.isin(rec, bad)
            pos, rec, opens, closes, byte, level = (x[keep] for x in (pos, rec, opens, closes, byte, level))
            container = np.cumsum(opens) - 1
            open_at = pos[opens]

    colon = byte == 58
    cut = np.flatnonzero(~colon)
    left, right = cut[:-1], cut[1:]
    member = ~closes[left]
    left, right = left[member], right[member]
    has_colon = right - left > 1
    in_object = a[open_at[container[left]]] == 123 if left.size else np.zeros(0, bool)

    solid = np.flatnonzero(a > 32)
    filled = np.r_[solid, len(buf)]

    def trim(at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return filled[np.searchsorted(solid, at)], solid[np.searchsorted(solid, end) - 1] + 1 if end.size else end

    key_at, key_end = trim(pos[left] + 1, np.where(has_colon, pos[np.minimum(left + 1, max(pos.size - 1, 0))] if pos.size else 0, pos[left] + 1))
    at, end = trim(np.where(has_colon, pos[np.minimum(left + 1, max(pos.size - 1, 0))] if pos.size else 0, pos[left]) + 1, pos[right])
    real = (at < end) & (has_colon | ~in_object)
    key_at, key_end = np.where(has_colon, key_at, -1), np.where(has_colon, key_end, -1)
    left, at, end, key_at, key_end = left[real], at[real], end[real], key_at[real], key_end[real]
    owner = container[left]
    first_of = np.searchsorted(owner, np.arange(open_at.size))
    count_of = np.searchsorted(owner, np.arange(open_at.size), "right") - first_of
    ordinal = np.arange(owner.size) - first_of[owner] if owner.size else owner

    # the member whose value begins at a container's bracket is its parent
    by_at = np.argsort(at, kind="stable")
    found = np.searchsorted(at[by_at], open_at)
    value_of = np.full(open_at.size, -1)
    ok = found < by_at.size
    hit = by_at[found[ok]]
    value_of[np.flatnonzero(ok)] = np.where(at[hit] == open_at[ok], hit, -1)
    first_child, n_children = np.zeros(owner.size, np.int64), np.zeros(owner.size, np.int64)
    known = value_of >= 0
    first_child[value_of[known]] = first_of[known]
    n_children[value_of[known]] = count_of[known]
    return Members(buf, rec[left], level[left], value_of[owner] if owner.size else owner, ordinal, key_at, key_end, at, end, first_child, n_children)


def _batches(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    rows, got, size = [], [], 0
    for i, t in enumerate(texts):
        if (t := unwrap(t)) is None:
            continue
        if rows and size + len(t) > BATCH_BYTES:
            yield rows, got
            rows, got, size = [], [], 0
        rows.append(i)
        got.append(t)
        size += len(t)
    if rows:
        yield rows, got


# ---------------------------------------------------------------- operators


def flatten_members(df: DataFrame, json_col: str) -> DataFrame:
    """Every member of every payload as a row, linked to its parent.

    Adds ``node`` (number in the record, from 0), ``parent`` (-1 for members of
    the top object), ``depth``, ``key`` (null in lists), ``ordinal`` (from 1),
    ``kind`` and ``value`` (null for containers); the other columns are kept.
    """
    keep = [c for c in df.columns if c != json_col]
    added = [("node", T.LongType()), ("parent", T.LongType()), ("depth", T.IntegerType()), ("key", T.StringType()), ("ordinal", T.IntegerType()), ("kind", T.StringType()), ("value", T.StringType())]
    if clash := {n for n, _ in added} & set(keep):
        raise ValueError(f"columns to be added exist: {sorted(clash)}")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in added])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows, texts in _batches(batch.column(json_col).to_pylist()):
                m = index_batch(texts)
                begin = np.searchsorted(np.sort(m.record), np.arange(len(texts)))
                order = np.argsort(m.record, kind="stable")
                number = np.empty(order.size, np.int64)
                number[order] = np.arange(order.size)
                node = number - begin[m.record] if order.size else number
                parent = np.where(m.parent >= 0, node[m.parent], -1) if order.size else node
                kinds = [m.kind(i) for i in range(node.size)]
                taken = batch.take(pa.array(np.asarray(rows, np.int64)[m.record]))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(c) for c in keep]
                    + [
                        pa.array(node), pa.array(parent), pa.array(m.level.astype(np.int32)),
                        pa.array([m.key(i) if m.key_at[i] >= 0 else None for i in range(node.size)], pa.string()),
                        pa.array((m.ordinal + 1).astype(np.int32)), pa.array(kinds, pa.string()),
                        pa.array([None if k in ("object", "array", "null") else m.text(i) for i, k in enumerate(kinds)], pa.string()),
                    ],
                    names=[*keep, *(n for n, _ in added)],
                )

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class ListRule:
    """Where the elements of one list stand and what is taken of them.

    ``name``: list_name of the rows.  ``top``: the key of the top object under
    which the owners are members; None where the owners are the top members.
    ``field``: the owner's member that is the list; None where the owner's
    value is.  ``inner``: the element's member that holds a list of its own,
    whose elements are then the rows.  ``via``: the element's member that is
    described in its place.  ``parts``: members (or literal text after ``=``)
    whose text is run together; empty for the element's own text.
    """

    name: str
    parts: tuple[str, ...] = ()
    top: str | None = None
    field: str | None = None
    inner: str | None = None
    via: str | None = None


def _item(m: Members, i: int, rule: ListRule) -> str:
    if m.kind(i) != "object":
        return m.text(i)
    f = m.fields(i)
    if rule.via:
        if rule.via not in f or m.kind(f[rule.via]) != "object":
            return ""
        f = m.fields(f[rule.via])
    return "".join(p[1:] if p[0] == "=" else m.text(f[p]) if p in f and m.kind(f[p]) != "null" else "" for p in rule.parts)


def _owners(m: Members, rule: ListRule, tops: dict[str, list[int]], all_tops: list[int]) -> Iterator[tuple[int, int]]:
    """(owner member, list member)"""
    owners = all_tops if rule.top is None else (j for i in tops.get(rule.top, ()) if m.kind(i) == "object" for j in m.children(i))
    for o in owners:
        if rule.field is None:
            yield o, o
        elif m.kind(o) == "object" and (got := m.fields(o).get(rule.field)) is not None:
            yield o, got


def extract_lists(df: DataFrame, *, record_id: str, json_col: str, rules: tuple[ListRule, ...]) -> DataFrame:
    """Rows (record_id, list_name, owner_name, ordinal, sub_ordinal, item) of the lists named by rules."""
    columns = ("record_id", "list_name", "owner_name", "ordinal", "sub_ordinal", "item")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0).to_pylist()
            for rows, texts in _batches(batch.column(1).to_pylist()):
                m = index_batch(texts)
                out: list[tuple] = []
                all_tops = np.flatnonzero(m.level == 1).tolist()
                m = m.as_lists()
                tops: dict[str, list[int]] = {}
                for i in all_tops:
                    tops.setdefault(m.key(i), []).append(i)
                for rule in rules:
                    for o, at in _owners(m, rule, tops, all_tops):
                        rid, owner = ids[rows[m.record[o]]], m.key(o)
                        for k, e in enumerate(m.elements(at), 1):
                            if rule.inner is None:
                                out.append((rid, rule.name, owner, k, 0, _item(m, e, rule)))
                            elif m.kind(e) == "object" and (sub := m.fields(e).get(rule.inner)) is not None:
                                out += [(rid, rule.name, owner, k, s, _item(m, x, rule)) for s, x in enumerate(m.elements(sub), 1)]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("ordinal", "sub_ordinal") else pa.string()) for n, c in zip(columns, cols, strict=True)], names=list(columns))

    return df.select(record_id, json_col).mapInArrow(run, "record_id string, list_name string, owner_name string, ordinal int, sub_ordinal int, item string")


_CHANGE = ("refAa", "pos", "qryAa")

PROCESSED_RULES = (
    ListRule("nucleotideInsertions", ("position", "=:", "sequence"), top="nucleotideInsertions"),
    ListRule("aminoAcidInsertions", ("position", "=:", "sequence"), top="aminoAcidInsertions"),
    ListRule("files", ("fileId",), top="files"),
)
MUTATION_RULES = (
    ListRule("privateSubstitutions", _CHANGE, field="privateSubstitutions"),
    ListRule("privateDeletions", ("refAa", "pos", "=-"), field="privateDeletions"),
    ListRule("labeledSubstitutions", _CHANGE, field="labeledSubstitutions", via="substitution"),
    ListRule("labels", (), field="labeledSubstitutions", inner="labels"),
    ListRule("changes", _CHANGE, field="aaChangesGroups", inner="changes"),
)
