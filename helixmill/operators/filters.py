"""Filters of the query layer: from request values to columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.session import cut_lineage


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions; nothing passes where there are none."""
    return reduce(or_, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def keys_in(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key tuple is listed."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def in_range(field: str, low=None, high=None) -> Column:
    """``field >= low`` and ``field <= high``, either side may be missing."""
    return all_of([*([F.col(field) >= F.lit(low)] if low is not None else []), *([F.col(field) <= F.lit(high)] if high is not None else [])])


def range_overlap(lower: str, upper: str, low, high, *, strict: bool) -> Column:
    """Strict: the record's range lies inside; else the ranges meet."""
    if strict:
        return all_of([in_range(lower, low=low), in_range(upper, high=high)])
    return all_of([in_range(upper, low=low), in_range(lower, high=high)])


def contains_literal(field: str, text: str) -> Column:
    """Case-insensitive substring; pattern characters are literal."""
    return F.contains(F.lower(F.col(field)), F.lower(F.lit(text)))


def multi_field_search(fields: Sequence[str], terms: Sequence[str]) -> Column:
    """Every term occurs in some field."""
    return all_of(any_of(contains_literal(f, t) for f in fields) for t in terms)


def in_or_null(field: str, values: Sequence[str | None]) -> Column:
    """One of the values; None stands for null."""
    given = [v for v in values if v is not None]
    parts = [F.col(field).isin(given)] if given else []
    return any_of([*parts, *([F.col(field).isNull()] if None in values else [])])


def null_filters(filters: dict[str, Sequence[str | None]], *, either: bool = False) -> Column:
    """Several value lists with None in them: combined by AND, or by OR as download requests do."""
    parts = [in_or_null(f, v) for f, v in filters.items()]
    return any_of(parts) if either else all_of(parts)


def parse_accessions(text: str) -> list[str]:
    """Accessions from free text, without versions, in order of appearance."""
    return list(dict.fromkeys(a.split(".")[0] for a in re.split(r"[\t,;\n\s]+", text) if a))


def same_text(a: Column, b: Column) -> Column:
    """Equality that disregards case."""
    return F.lower(a) == F.lower(b)


def equal_or_null(conditions: dict[str, object]) -> Column:
    """Equality by name; None asks for null."""
    return all_of(F.col(k).eqNullSafe(F.lit(v)) for k, v in conditions.items())


_TERM = re.compile(r"^\s*([A-Za-z_]\w*)\s*(>=|<=|=)\s*(.*?)\s*$")


def parse_filter(text: str, fields: Iterable[str], ranges: Iterable[str] = ()) -> Column:
    """``field=value``; ``>=`` and ``<=`` only on range fields."""
    m = _TERM.match(text)
    if not m:
        raise ValueError(f"not a filter: {text!r}")
    field, op, value = m.groups()
    if field not in set(fields):
        raise ValueError(f"unknown field {field!r}")
    if op != "=" and field not in set(ranges):
        raise ValueError(f"{field!r} takes no range")
    return F.col(field) == value if op == "=" else F.col(field) >= value if op == ">=" else F.col(field) <= value


@dataclass(frozen=True)
class Page:
    """Order, limit and offset; the key decides between equal rows."""

    order: str | None
    key: tuple[str, ...]
    limit: int = 100
    offset: int = 0
    descending: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        first = [] if self.order is None else [F.desc(self.order) if self.descending else F.asc(self.order)]
        return df.orderBy(*first, *self.key).offset(self.offset).limit(self.limit)


def placed(df: DataFrame, *order: str | Column, place: str = "place") -> DataFrame:
    """All rows in order, with their place from 1.

    Rows are sorted in ranges, and the sizes of the ranges before are added to
    the places within; no task holds the whole order.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id is the number of the partition, shifted by 33 bits, and the row in it
    ranged = cut_lineage(ranged.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    at = F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(F.broadcast(before), "__part").select(*df.columns, at.alias(place))


def numbered(df: DataFrame, key: str, *order: str | Column, number: str = "number") -> DataFrame:
    """The rows of each key with their place in it, from 1: what a list of them would hold, without a task that holds a list.

    Places come from one sorted order of all rows, less the first place of the key.
    """
    rows = placed(df, key, *order, place="__place")
    first = rows.groupBy(key).agg(F.min("__place").alias("__first"))
    return rows.join(first, key).withColumn(number, F.col("__place") - F.col("__first") + 1).drop("__place", "__first")


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows as they are; one for which the condition does not hold ends the query with the message."""
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
