"""Queries on aligned sequences: mutations, insertions, ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mutation:
    """``[segment:][ref]pos[symbol]``: ``.`` is the reference, ``-`` a deletion, no symbol any change."""

    position: int
    symbol: str | None = None
    reference: str | None = None
    segment: str | None = None


_MUTATION = re.compile(r"^(?:([A-Za-z0-9_]+):)?([A-Za-z*])?(\d+)([A-Za-z*.\-])?$")
_INSERTION = re.compile(r"^ins_(?:([A-Za-z0-9_]+):)?(\d+):([A-Za-z*?]+)$", re.I)


def parse_mutation(text: str) -> Mutation | None:
    m = _MUTATION.match(text.strip())
    if not m:
        return None
    seg, ref, pos, sym = m.groups()
    return Mutation(int(pos), sym.upper() if sym else None, ref.upper() if ref else None, seg)


def parse_mutations(text: str) -> list[Mutation]:
    """Comma-separated mutations; what is none is left out."""
    return [m for m in map(parse_mutation, text.split(",")) if m]


def mutation_column(m: Mutation, sequence: Column, reference: Column) -> Column:
    """Whether an aligned sequence carries the mutation."""
    at, ref = F.substring(sequence, m.position, 1), F.substring(reference, m.position, 1)
    known = (F.length(at) > 0) & (F.length(ref) > 0)
    if m.symbol is None:
        return known & (at != ref) & ~at.isin("N", "X")
    if m.symbol == ".":
        return known & (at == ref)
    return known & (at == m.symbol)


def insertion_query(text: str, only_segment: str | None = None) -> tuple[str | None, int, str] | None:
    """(segment, position, regular expression); the segment may be left out where there is just one."""
    m = _INSERTION.match(text.strip())
    got = insertion_pattern(text)
    return (m.group(1) or only_segment, *got) if m and got else None


def has_insertion(insertions: Column, query: tuple[str | None, int, str]) -> Column:
    """Whether one of the insertions (structs of segment, position, sequence) stands at the place and fits the pattern."""
    segment, position, pattern = query
    at = lambda x: (x["position"] == position) & x["sequence"].rlike(pattern)
    return F.exists(insertions, lambda x: at(x) & (x["segment"] == segment) if segment is not None else at(x))


def insertion_pattern(text: str) -> tuple[int, str] | None:
    """(position, regular expression) of ``ins_[seg:]pos:SEQ``; ``?`` stands for any symbols, alone for one at least."""
    m = _INSERTION.match(text.strip())
    if not m:
        return None
    body = m.group(3).upper()
    return int(m.group(2)), "^.+$" if body == "?" else "^" + ".*".join(re.escape(p) for p in body.split("?")) + "$"


def mutations(df: DataFrame, key: str, sequence: str, reference: str, unknown: tuple[str, ...] = ("N", "X")) -> DataFrame:
    """(key, position, reference_symbol, symbol, kind): places where an aligned sequence differs from its reference."""
    n = F.least(F.length(sequence), F.length(reference))
    pairs = F.arrays_zip(F.split(F.substring(F.col(sequence), F.lit(1), n), "").alias("s"), F.split(F.substring(F.col(reference), F.lit(1), n), "").alias("r"))
    rows = df.filter(n > 0).select(key, F.posexplode(pairs).alias("p", "x"))
    rows = rows.select(key, (F.col("p") + 1).alias("position"), F.col("x.r").alias("reference_symbol"), F.col("x.s").alias("symbol"))
    kind = F.when(F.col("symbol") == "-", "deletion").otherwise("substitution")
    return rows.filter((F.col("symbol") != F.col("reference_symbol")) & (F.col("symbol") != "") & ~F.col("symbol").isin(*unknown)).withColumn("kind", kind)


def mutation_profile(df: DataFrame, segment: str, sequence: str, reference: str, *, least: float, unknown: tuple[str, ...] = ("N", "X")) -> DataFrame:
    """(segment, position, symbol, n, proportion): mutations with their share of the sequences that are known at the place.

    Places are counted by symbol once: coverage, counts and shares come from
    that table, which has a row for each segment, place and symbol.
    """
    n = F.least(F.length(sequence), F.length(reference))
    pairs = F.arrays_zip(F.split(F.substring(F.col(sequence), F.lit(1), n), "").alias("s"), F.split(F.substring(F.col(reference), F.lit(1), n), "").alias("r"))
    rows = df.filter(n > 0).select(segment, F.posexplode(pairs).alias("p", "x")).select(segment, (F.col("p") + 1).cast("bigint").alias("position"), F.col("x.s").alias("symbol"), F.col("x.r").alias("reference_symbol"))
    rows = rows.filter((F.col("symbol") != "") & ~F.col("symbol").isin(*unknown)).groupBy(segment, "position", "symbol", "reference_symbol").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(segment, "position"))
    return rows.withColumn("proportion", share).filter((F.col("symbol") != F.col("reference_symbol")) & (F.col("proportion") >= least)).select(segment, "position", "symbol", "n", F.round("proportion", 6).alias("proportion"))


def runs(df: DataFrame, key: str, position: str) -> DataFrame:
    """(key, first, last): runs of neighbouring positions (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(position)
    rows = df.select(key, position).distinct().withColumn("__island", F.col(position) - F.row_number().over(w))
    return rows.groupBy(key, "__island").agg(F.min(position).alias("first"), F.max(position).alias("last")).drop("__island")


def run_labels(df: DataFrame, key: str, position: str) -> DataFrame:
    """Runs of three or more as ``a-b``, shorter ones position by position."""
    long = F.col("last") - F.col("first") >= 2
    return runs(df, key, position).select(
        key, F.explode(F.when(long, F.array(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))).otherwise(F.transform(F.sequence("first", "last"), lambda x: x.cast("string")))).alias("label")
    )


def mask_terminal_gaps(sequence: Column, symbol: str = "N") -> Column:
    """Gaps at both ends become unknown symbols."""
    lead = F.length(F.regexp_extract(sequence, "^(-*)", 1))
    bare = F.regexp_replace(sequence, "^-+|-+$", "")
    tail = F.length(sequence) - lead - F.length(bare)
    return F.concat(F.repeat(F.lit(symbol), lead), bare, F.repeat(F.lit(symbol), tail))


def invalid_symbols(sequence: Column, alphabet: str, most: int = 10) -> Column:
    """The first different symbols outside the alphabet, in order."""
    rest = F.regexp_replace(sequence, f"[{re.escape(alphabet)}]", "")
    return F.slice(F.array_distinct(F.filter(F.split(rest, ""), lambda c: c != "")), 1, most)


def mutation_filter(text: str, sequences: Column, references: dict[str, str], only_segment: str | None = None) -> Column:
    """All mutations of a list on a map of aligned sequences; what is no mutation is left out.

    Where there are several segments each mutation names its own; it is
    looked up without regard to case.  A segment that is not known matches nothing.
    """
    by_lower = {s.lower(): s for s in references}
    out = F.lit(True)
    for m in parse_mutations(text):
        segment = by_lower.get((m.segment or only_segment or "").lower())
        out = out & (F.coalesce(mutation_column(m, F.element_at(sequences, segment), F.lit(references[segment])), F.lit(False)) if segment else F.lit(False))
    return out


def all_mutations(text: str, sequence: Column, reference: Column) -> Column:
    """All mutations of a list; what is no mutation is left out."""
    out = F.lit(True)
    for m in parse_mutations(text):
        out = out & mutation_column(m, sequence, reference)
    return out


def insertion_counts(df: DataFrame, insertion: str) -> DataFrame:
    """(position, sequence, n) of insertions written ``position:sequence``."""
    parts = df.select(F.substring_index(insertion, ":", 1).cast("bigint").alias("position"), F.substring_index(insertion, ":", -1).alias("sequence"))
    return parts.groupBy("position", "sequence").agg(F.count("*").alias("n"))
