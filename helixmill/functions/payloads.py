"""JSON payloads as they are delivered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Times that an object may have been encoded as a string to be read by :func:`json_object` (``nested_records`` has no such bound).
ENCODED = 3


def json_object(c: Column) -> Column:
    """The text of a JSON object, from which string encoding is removed; null where there is none."""
    for _ in range(ENCODED):
        c = F.when(F.startswith(F.ltrim(c), F.lit('"')), F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), 0)).otherwise(c)
    return F.when(F.startswith(F.ltrim(c), F.lit("{")) & F.try_parse_json(c).isNotNull(), c)


def elements(c: Column) -> Column:
    """The elements of a JSON list as texts, without nulls; a single value is a list of one."""
    many = F.when(F.startswith(F.ltrim(c), F.lit("[")), F.from_json(c, "array<string>")).when(c.isNotNull() & (c != "null"), F.array(c))
    return F.filter(many, lambda x: x.isNotNull())


def members(c: Column, key: str) -> Column:
    """The members of the object under a top key as a map of texts."""
    return F.from_json(F.get_json_object(c, f"$.{key}"), "map<string,string>")
