"""Declarative cleaning functions for metadata fields.

Each function takes columns and returns a :class:`Result` of three columns:
the value, the errors and the warnings (arrays of short codes).  ``FUNCTIONS``
is the registry that a processing specification names them from.
"""

from __future__ import annotations

import graphlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Result:
    value: Column
    errors: Column
    warnings: Column


def _codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds."""
    empty = F.array().cast("array<string>")
    return reduce(F.concat, (F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(code))).otherwise(empty) for c, code in pairs), empty)


def _result(value: Column, errors: Sequence[tuple[Column, str]] = (), warnings: Sequence[tuple[Column, str]] = ()) -> Result:
    return Result(value, _codes(*errors), _codes(*warnings))


def is_missing(c: Column) -> Column:
    """Only null and the empty text count as missing."""
    return c.isNull() | (c == "")


def identity(c: Column, kind: str | None = None) -> Result:
    """The value itself, read as ``kind``; falsy inputs give null."""
    given = ~is_missing(c)
    if kind == "int":
        v = F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("bigint"))
        return _result(F.when(given, v), [(given & v.isNull(), "invalid_int")])
    if kind == "float":
        v = F.trim(c).try_cast("double")
        nan, inf = F.isnan(v), v.isin(float("inf"), float("-inf"))
        return _result(F.when(given & ~nan & ~inf, v), [(given & (v.isNull() | inf), "invalid_float")])
    if kind == "boolean":
        low = F.lower(c)
        return _result(F.when(given & low.isin("true", "false"), low == "true"), [(given & ~low.isin("true", "false"), "invalid_boolean")])
    return _result(F.when(given, F.trim(c) if kind else c))


_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"


def _day(c: Column) -> Column:
    return F.when(c.rlike(_DAY), F.try_to_date(c, "y-M-d"))


def _month(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(F.concat(c, F.lit("-1")), "y-M-d"))


def _year(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}$"), F.try_to_date(F.concat(c, F.lit("-1-1")), "y-M-d"))


def check_date(c: Column, today: Column) -> Result:
    """A complete date as it stands; a date after ``today`` is a warning."""
    day, given = _day(c), ~is_missing(c)
    return _result(F.when(given & day.isNotNull(), c), [(given & day.isNull(), "not_a_date")], [(day > today, "in_future")])


def past_date(c: Column, today: Column, released: Column | None = None) -> Result:
    """A date padded with the first month and day; it must not lie after today or the release."""
    given = ~is_missing(c)
    day, month, year = _day(c), _month(c), _year(c)
    v = F.coalesce(day, month, year)
    after = v > released if released is not None else F.lit(False)
    return _result(
        F.when(given, F.date_format(v, "yyyy-MM-dd")),
        [(given & v.isNull(), "not_a_date"), (v > today, "in_future"), (after, "after_release")],
        [(day.isNull() & month.isNotNull(), "day_missing"), (day.isNull() & month.isNull() & year.isNotNull(), "month_missing")],
    )


def _bounds(c: Column) -> tuple[Column, Column]:
    day, month, year = _day(c), _month(c), _year(c)
    return F.coalesce(day, month, year), F.coalesce(day, F.last_day(month), F.last_day(F.add_months(year, 11)))


_PIECE = r"([0-9-]+)"
_LUCENE = rf"^\s*\[{_PIECE}\s*TO\s*{_PIECE}\s*\]\s*$"
_SLASH = rf"^\s*{_PIECE}\s*/\s*{_PIECE}\s*$"


def date_range(c: Column, submitted: Column, released: Column | None = None) -> tuple[Column, Column]:
    """(lower, upper) of a date, month, year or range of them; upper is cut at the earlier of submission and release."""
    limit = F.least(submitted, released) if released is not None else submitted
    pair = F.when(c.rlike(_LUCENE), F.array(F.regexp_extract(c, _LUCENE, 1), F.regexp_extract(c, _LUCENE, 2))).when(c.rlike(_SLASH), F.array(F.regexp_extract(c, _SLASH, 1), F.regexp_extract(c, _SLASH, 2)))
    low_one, high_one = _bounds(c)
    low_pair, high_pair = _bounds(pair[0])[0], _bounds(pair[1])[1]
    both = low_pair.isNotNull() & high_pair.isNotNull()
    low, high = F.coalesce(low_one, F.when(both, low_pair)), F.coalesce(high_one, F.when(both, high_pair))
    return low, F.when(is_missing(c), limit).otherwise(F.least(high, F.when(high.isNotNull(), limit)))


def with_date_range(df: DataFrame, text: str, submitted: str, released: str | None = None, *, low: str = "range_low", high: str = "range_high") -> DataFrame:
    """Adds what :func:`date_range` gives as columns (low, high): of a date, month, year or range of them; high is cut at the earlier of submission and release.

    The two ends of a text are columns of their own before they are read, and
    their days before they are compared: one expression for all of it would be
    too large to be compiled.
    """
    c = F.col(text)
    pattern = F.when(c.rlike(_LUCENE), F.lit(_LUCENE)).when(c.rlike(_SLASH), F.lit(_SLASH))
    first, last = (F.when(pattern.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(c, _LUCENE, k), F.lit("")), F.nullif(F.regexp_extract(c, _SLASH, k), F.lit("")))).otherwise(c) for k in (1, 2))
    ends = df.withColumns({"__a": first, "__b": last, "__limit": F.least(submitted, released) if released is not None else F.col(submitted)})
    read = ends.withColumns({"__low": _bounds(F.col("__a"))[0], "__high": _bounds(F.col("__b"))[1]})
    both = F.col("__low").isNotNull() & F.col("__high").isNotNull()
    upper = F.when(is_missing(c), F.col("__limit")).when(both, F.least("__high", F.col("__limit")))
    return read.withColumns({low: F.when(both, F.col("__low")), high: upper}).drop("__a", "__b", "__limit", "__low", "__high")


def compact_range(low: Column, high: Column) -> Column:
    """The shortest text for a range of days: day, month, year, or two of them with a slash."""
    day, month, year = (lambda c: F.date_format(c, "yyyy-MM-dd")), (lambda c: F.date_format(c, "yyyy-MM")), (lambda c: F.date_format(c, "yyyy"))
    whole_months = (F.dayofmonth(low) == 1) & (high == F.last_day(high))
    whole_years = whole_months & (F.month(low) == 1) & (F.month(high) == 12)
    two = lambda f: F.concat(f(low), F.lit("/"), f(high))
    return (
        F.when(low == high, day(low)).when(whole_months & (month(low) == month(high)), month(low)).when(whole_years & (year(low) == year(high)), year(low))
        .when(whole_years, two(year)).when(whole_months, two(month)).otherwise(two(day))
    )


def parse_timestamp(c: Column) -> Result:
    """The day of a time stamp in ISO form."""
    v = F.try_to_timestamp(c)
    given = ~is_missing(c)
    return _result(F.when(given, F.date_format(v, "yyyy-MM-dd")), [(given & v.isNull(), "not_a_timestamp")])


def concatenate(parts: Sequence[Column], fallback: str = "") -> Result:
    """Parts joined by slashes, none at the ends, blanks as underscores; missing parts become the fallback."""
    joined = F.concat_ws("/", *(F.when(is_missing(p), F.lit(fallback)).otherwise(F.trim(p)) for p in parts))
    return _result(F.regexp_replace(F.regexp_replace(joined, "^/+|/+$", ""), " ", "_"))


def extract_regex(c: Column, pattern: str, group: int, upper: bool = False) -> Result:
    """One group of a pattern that must match from the start."""
    given, text = ~is_missing(c), F.trim(c)
    anchored = f"^(?:{pattern})"
    hit = text.rlike(anchored)
    v = F.regexp_extract(text, anchored, group)
    return _result(F.when(given & hit, F.upper(v) if upper else v), [(given & ~hit, "no_match")])


def check_regex(c: Column, pattern: str) -> Result:
    """The trimmed value if the pattern matches from its start."""
    given, text = ~is_missing(c), F.trim(c)
    hit = text.rlike(f"^(?:{pattern})")
    return _result(F.when(given & hit, text), [(given & ~hit, "no_match")])


def process_options(c: Column, options: Sequence[str], trusted: Column | None = None) -> Result:
    """The listed option that equals the value but for case and blanks; trusted submitters keep others with a warning."""
    norm = lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))
    table = F.create_map(*(F.lit(v) for o in options for v in (" ".join(o.lower().split()), o)))
    given, hit = ~is_missing(c), F.element_at(table, norm(c))
    trusted = F.lit(False) if trusted is None else trusted
    return _result(F.when(given, F.coalesce(hit, F.when(trusted, c))), [(given & hit.isNull() & ~trusted, "not_an_option")], [(given & hit.isNull() & trusted, "not_an_option")])


def is_above_threshold(c: Column, threshold: float) -> Result:
    v, given = F.trim(c).try_cast("double"), ~(c.isNull() | (F.trim(c) == ""))
    return _result(F.when(given, v > threshold), [(given & v.isNull(), "not_a_number")])


def is_variant(mutations: Column, length: Column, rate: float) -> Result:
    """More mutations than the rate allows for the length."""
    n, size = mutations.try_cast("double"), length.try_cast("double")
    given = mutations.isNotNull() & length.isNotNull()
    return _result(F.when(given, n > size * rate), [(given & (n.isNull() | size.isNull()), "not_a_number")])


#: Human lineages that are assigned (fixed values).
HUMAN_LINEAGES = ("H1N1", "H3N2", "H2N2", "H1N1pdm")


def custom_lineage(ha: Column, na: Column, lineages: Sequence[Column], variants: Sequence[Column], pandemic: str = "H1N1PDM") -> Result:
    """Subtype of two segments; marked where internal lineages differ or a segment is a variant."""
    pdm = (lineages[3] == pandemic) & (lineages[5] == pandemic)
    base = F.when(F.coalesce(pdm, F.lit(False)), F.lit("H1N1pdm")).otherwise(F.concat(ha, na))
    distinct = F.size(F.array_distinct(F.filter(F.array(*lineages), lambda x: x.isNotNull())))
    mixed = F.when(distinct > 1, " reassortant").otherwise("")
    changed = F.when(reduce(lambda a, b: a | b, (F.coalesce(v, F.lit(False)) for v in variants)), " (variant)").otherwise("")
    given = ~is_missing(ha) & ~is_missing(na)
    return _result(F.when(given & base.isin(*HUMAN_LINEAGES), F.concat(base, mixed, changed)))


FUNCTIONS: dict[str, Callable[..., Result]] = {
    "identity": identity, "check_date": check_date, "parse_and_assert_past_date": past_date, "parse_timestamp": parse_timestamp, "concatenate": concatenate,
    "extract_regex": extract_regex, "check_regex": check_regex, "process_options": process_options, "is_above_threshold": is_above_threshold, "is_variant": is_variant,
}


def field_order(spec: Mapping[str, Sequence[str]], prefix: str = "processed.") -> list[list[str]]:
    """Fields in the levels in which they can be computed; inputs named ``processed.x`` need field x."""
    graph = {f: {i[len(prefix) :] for i in inputs if i.startswith(prefix)} for f, inputs in spec.items()}
    if unknown := {d for ds in graph.values() for d in ds} - set(graph):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    order = graphlib.TopologicalSorter(graph)
    try:
        order.prepare()
    except graphlib.CycleError as e:
        raise ValueError(f"fields need each other: {e.args[1]}") from None
    levels = []
    while order.is_active():
        ready = sorted(order.get_ready())
        levels.append(ready)
        order.done(*ready)
    return levels


@dataclass(frozen=True)
class Field:
    """One output field of a specification."""

    function: str
    inputs: tuple[str, ...]
    args: tuple = ()
    required: bool = False


def apply_spec(df: DataFrame, spec: Mapping[str, Field], exempt: Column | None = None) -> DataFrame:
    """Adds ``processed`` fields level by level, with ``errors`` and ``warnings`` as arrays of ``field:code``.

    Rows of ``exempt`` submitters need no required fields.
    """
    exempt = F.lit(False) if exempt is None else exempt
    empty = F.array().cast("array<string>")
    out = df.withColumns({"errors": empty, "warnings": empty})
    for level in field_order({f: s.inputs for f, s in spec.items()}):
        new: dict[str, Column] = {}
        errors, warnings = F.col("errors"), F.col("warnings")
        for name in level:
            s = spec[name]
            cols = [F.col(i.removeprefix("processed.").join(("out_", "")) if i.startswith("processed.") else i) for i in s.inputs]
            r = FUNCTIONS[s.function](cols, *s.args) if s.function == "concatenate" else FUNCTIONS[s.function](*cols, *s.args)
            new[f"out_{name}"] = r.value
            tag = lambda codes, name=name: F.transform(codes, lambda x: F.concat(F.lit(f"{name}:"), x))
            errors, warnings = F.concat(errors, tag(r.errors)), F.concat(warnings, tag(r.warnings))
            if s.required:
                errors = F.concat(errors, _codes((is_missing(r.value.cast("string")) & ~exempt, f"{name}:required")))
        out = out.withColumns({**new, "errors": errors, "warnings": warnings})
    return out
