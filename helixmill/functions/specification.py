"""Processing specifications: typed parts of names, requirements that depend on other fields, checks of a specification.

What a specification names beyond the functions of :mod:`metadata` is
registered here; everything is columns, so that a whole specification is one
plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions import metadata as M
from helixmill.functions.text import check_authors

PROCESSED, FILES = "processed.", "files."


@dataclass(frozen=True)
class Part:
    """A part of a joined name: its kind, and the column or the text that it takes."""

    kind: str
    value: Column | str | None = None


def _shown(part: Part, accession_version: Column, fallback: Column, today: Column) -> tuple[Column, Column]:
    """(text, whether it cannot be read) of a part."""
    never = F.lit(False)
    if part.kind == "ACCESSION_VERSION":
        return accession_version, never
    if part.kind == "ARG":
        return F.lit(part.value), never
    c = part.value
    if part.kind == "date":
        return F.coalesce(M.past_date(c, today).value, fallback), never
    if part.kind == "timestamp":
        return F.coalesce(M.parse_timestamp(c).value, fallback), never
    if part.kind == "dateRangeString":
        odd = F.coalesce(F.regexp_count(c, F.lit("/")) > 1, never)
        return F.when(M.is_missing(c) | odd, fallback).otherwise(F.replace(F.trim(c), F.lit("/"), F.lit(" TO "))), odd
    if part.kind == "string":
        return F.when(M.is_missing(c), fallback).otherwise(F.trim(c)), never
    raise ValueError(f"no kind of part: {part.kind}")


def joined(parts: Sequence[Part], accession_version: Column, *, fallback: str = "", today: Column | None = None) -> M.Result:
    """Parts by slashes, none at the ends, blanks as underscores; missing or unreadable parts are the fallback.

    A date range with more than one slash is an error.
    """
    today = F.current_date() if today is None else today
    shown = [_shown(p, accession_version, F.lit(fallback.strip()), today) for p in parts]
    text = F.regexp_replace(F.concat_ws("/", *(s for s, _ in shown)), "^/+|/+$", "")
    return M._result(F.replace(text, F.lit(" "), F.lit("_")), [(odd, "unexpected_range") for p, (_, odd) in zip(parts, shown, strict=True) if p.kind == "dateRangeString"])


def identifier(c: Column, ingested: Column, pattern: str | None = None, group: int = 1) -> Column:
    """A value that can stand in a name: as it is without blanks and slashes; else, of direct submissions, what the pattern finds."""
    usable = F.when(F.trim(c) != "", c)
    plain = ~usable.rlike(r"[\s/]")
    if pattern is None:
        return F.when(plain, usable)
    found = M.extract_regex(usable, pattern, group).value
    return F.when(plain, usable).when(~ingested, found)


def display_name(parts: Sequence[Part], accession_version: Column, collector_id: Column, submission_id: Column, ingested: Column, *, pattern: str | None = None, group: int = 1, fallback: str = "unknown", today: Column | None = None) -> M.Result:
    """Joined parts, of which ``IDENTIFIER`` is the collector's id, else the submission id, else the accession.

    Submission ids of ingested records are no identifiers.  That neither could
    be read is a warning for direct submissions if there is a pattern.
    """
    if not any(p.kind == "IDENTIFIER" for p in parts):
        raise ValueError("a display name needs an IDENTIFIER")
    found = F.coalesce(identifier(collector_id, ingested, pattern, group), F.when(~ingested, identifier(submission_id, ingested, pattern, group)))
    named = [Part("string", F.coalesce(found, accession_version)) if p.kind == "IDENTIFIER" else p for p in parts]
    r = joined(named, accession_version, fallback=fallback, today=today)
    return M.Result(r.value, r.errors, F.concat(r.warnings, M._codes((found.isNull() & ~ingested, "identifier_unreadable"))) if pattern else r.warnings)


def lineage_from_references(ha: Column, na: Column, references: Sequence[Column], variants: Sequence[Column], pattern: str, group: int = 1) -> M.Result:
    """Lineage of two segments, with the lineages of all segments read from the names of their references."""
    return M.custom_lineage(ha, na, [M.extract_regex(r, pattern, group, upper=True).value for r in references], variants)


def resolve_host(hosts: DataFrame, host: str, names: DataFrame, *, ingested: str | None = None) -> DataFrame:
    """Adds (taxon_id, host_error, host_warning): digits are an id, other text a name.

    ``names`` has (taxon_id, name, depth); of several taxa of one name the one
    of least depth counts, then the smallest id.  What is not found is an
    error, or a warning for ingested records.
    """
    by_name = names.groupBy(F.lower(F.trim("name")).alias("__name")).agg(F.min_by("taxon_id", F.struct("depth", "taxon_id")).alias("__by_name"))
    by_id = names.select(F.col("taxon_id").cast("string").alias("__id"), F.col("taxon_id").alias("__by_id")).distinct()
    text = F.trim(F.col(host))
    number = text.rlike(r"^\d+$")
    rows = hosts.withColumn("__id", F.when(number, F.regexp_replace(text, "^0+(?=.)", ""))).withColumn("__name", F.when(~number & (text != ""), F.lower(text)))
    rows = rows.join(by_id, "__id", "left").join(by_name, "__name", "left").withColumn("taxon_id", F.coalesce("__by_id", "__by_name"))
    lost = (F.coalesce(text, F.lit("")) != "") & F.col("taxon_id").isNull()
    direct = ~F.col(ingested) if ingested else F.lit(True)
    return rows.withColumn("host_error", F.coalesce(lost & direct, F.lit(False))).withColumn("host_warning", F.coalesce(lost & ~direct, F.lit(False))).drop("__id", "__name", "__by_id", "__by_name")


# -------------------------------------------------------------- requirements


def _authors(c: Column) -> M.Result:
    r = check_authors(c)
    return M.Result(r["value"], F.when(r["error"].isNotNull(), F.array(r["error"])).otherwise(F.array().cast("array<string>")), r["warnings"])


def _range(c: Column, submitted: Column, released: Column | None = None) -> M.Result:
    low, high = M.date_range(c, submitted, released)
    return M._result(M.compact_range(low, high), [(~M.is_missing(c) & low.isNull(), "not_a_date")])


M.FUNCTIONS.update({"check_authors": _authors, "parse_date_into_range": _range, "assign_custom_lineage": lineage_from_references, "build_display_name": display_name, "joined": joined})


@dataclass(frozen=True)
class Needs:
    """When a field must not be empty: always, or when an input, a processed field or files of a category are there."""

    required: bool = False
    when: tuple[str, ...] = ()


def specification_errors(needs: Mapping[str, Needs], inputs: Mapping[str, Sequence[str]], categories: Sequence[str]) -> list[tuple[str, str]]:
    """(field, error) of a specification: exclusive requirements, conditions on itself, unknown categories and fields, cycles."""
    out = []
    for field, n in needs.items():
        if n.required and n.when:
            out.append((field, "required_and_conditional"))
        for c in n.when:
            if c.startswith(FILES):
                if c.removeprefix(FILES) not in categories:
                    out.append((field, "unknown_category"))
            elif c.removeprefix(PROCESSED) == field:
                out.append((field, "requires_itself"))
            elif c.startswith(PROCESSED) and c.removeprefix(PROCESSED) not in inputs:
                out.append((field, "unknown_field"))
    try:
        M.field_order(inputs)
    except ValueError as e:
        out.append(("", "cycle" if "each other" in str(e) else "unknown_field"))
    return sorted(set(out))


def missing_requirements(needs: Mapping[str, Needs], values: Mapping[str, Column], given: Mapping[str, Column], files: Mapping[str, Column], exempt: Column) -> Column:
    """Array of ``field:condition`` for the fields that are empty though they are required; ``exempt`` rows need none.

    ``values`` are processed fields, ``given`` inputs, ``files`` numbers of files by category.
    """
    out: list[Column] = []
    for field, n in needs.items():
        empty = M.is_missing(values[field].cast("string")) & ~exempt
        if n.required:
            out.append(F.when(empty, F.lit(f"{field}:required")))
        for c in n.when:
            there = files[c.removeprefix(FILES)] > 0 if c.startswith(FILES) else ~M.is_missing((values[c.removeprefix(PROCESSED)] if c.startswith(PROCESSED) else given[c]).cast("string"))
            out.append(F.when(empty & F.coalesce(there, F.lit(False)), F.lit(f"{field}:{c}")))
    return F.array_compact(F.array(*out))
