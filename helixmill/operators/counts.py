"""Counts, facets and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """(value, n): the count of each of ``values``, 0 where there is none."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    all_values = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")
    return all_values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def facet(df: DataFrame, field: str, filters: dict[str, Column], blank: str = "(blank)") -> DataFrame:
    """Counts of a field's values under all filters but its own; null is shown as blank."""
    others = [c for f, c in filters.items() if f != field]
    kept = df.filter(reduce(lambda a, b: a & b, others)) if others else df
    return kept.groupBy(F.coalesce(F.col(field).cast("string"), F.lit(blank)).alias("value")).agg(F.count("*").alias("n"))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def merged_counts(parts: Sequence[DataFrame], key: str, count: str) -> DataFrame:
    """The sum of counts over several tables."""
    return reduce(DataFrame.unionByName, [p.select(key, count) for p in parts]).groupBy(key).agg(F.sum(count).alias(count))


def equivalence_groups(df: DataFrame, shared: list[str], segment: str, member: str) -> DataFrame:
    """(group_id, member): members that agree in all shared fields, at most one a segment.

    A class with a segment twice is no group: its members stand alone.
    """
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in shared)))
    rows = df.withColumn("__class", digest)
    clash = rows.groupBy("__class", segment).count().groupBy("__class").agg(F.max("count").alias("__most"))
    return rows.join(clash, "__class").select(F.when(F.col("__most") > 1, F.col(member).cast("string")).otherwise(F.col("__class")).alias("group_id"), member)


def natural_key(c):
    """Text by which values sort as people expect: without case, numbers by their size."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")).otherwise(x)), "")
