"""Bookkeeping of work: claims, upkeep of pipelines, collection of what is unused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators.entries import KEY, unprocessed
from helixmill.operators.filters import placed


def claim(entries: DataFrame, processed: DataFrame, *, pipeline_version: int, at: str, limit: int) -> DataFrame:
    """Rows to append for the first unprocessed entries; one writer at a time takes the place of row locks."""
    first = unprocessed(entries, processed, pipeline_version).select(*KEY).orderBy(*KEY).limit(limit)
    return first.select(*KEY, F.lit(pipeline_version).cast("bigint").alias("pipeline_version"), F.lit("IN_PROCESSING").alias("processing_status"), F.lit(at).cast("timestamp_ntz").alias("started_processing_at"))


def keep_recent_pipelines(entries: DataFrame, processed: DataFrame, current: DataFrame) -> DataFrame:
    """Processed rows of the current pipeline of their organism, the one before it and newer ones."""
    of = entries.select(*KEY, "organism").join(current, "organism").select(*KEY, "current")
    return processed.join(of, KEY).filter("pipeline_version >= current - 1").drop("current")


def collect_unused(items: DataFrame, used: DataFrame, key: str, marked: Column) -> DataFrame:
    """(key, action) of items that nothing refers to: mark them in one run, delete them in the next."""
    unused = items.join(used.select(key).distinct(), key, "left_anti")
    return unused.select(key, F.when(marked, "delete").otherwise("mark").alias("action"))


def next_state(status: Column) -> Column:
    """The state that follows; none after the release."""
    return F.when(status == "RECEIVED", "IN_PROCESSING").when(status == "IN_PROCESSING", "PROCESSED").when(status == "PROCESSED", "APPROVED_FOR_RELEASE")


def audit_lines(df: DataFrame, who: Column, what: str) -> DataFrame:
    """(line): who did what to which entry."""
    return df.select(F.concat(who, F.lit(f" {what} "), F.concat_ws(".", "accession", F.col("version").cast("string"))).alias("line"))


def unique_ids(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``unique_id``: the name itself where it comes first, then ``name_1``, ``name_2`` ...

    Suffixes that would give a name that stands in the table are skipped.  Names
    are numbered by their place in one sorted order of all rows, so that a name
    that fills a third of the table is no single task; only names of which
    suffixed forms stand in the table need a window, over those forms and
    their own repeats.
    """
    rows = placed(df.filter(F.col(name).isNotNull()), name, order, place="__place")
    first = rows.groupBy(name).agg(F.min("__place").alias("__first"))
    rows = rows.join(first, name).withColumn("__k", F.col("__place") - F.col("__first"))
    form = r"^(.*)_([1-9]\d{0,17})$"
    taken = df.select(F.regexp_extract(name, form, 1).alias(name), F.regexp_extract(name, form, 2).try_cast("bigint").alias("__s")).filter("__s is not null").distinct()
    taken = taken.join(first.select(name), name, "left_semi").withColumn("__j", F.row_number().over(Window.partitionBy(name).orderBy("__s")))
    # a free number k comes after a taken one if fewer than k numbers before that are free
    marks = taken.select(name, (F.col("__s") - F.col("__j") + 1).alias("__k"), F.lit(1).alias("__taken"))
    repeats = rows.filter("__k > 0").join(taken.select(name).distinct(), name, "left_semi").select(name, "__k", F.lit(0).alias("__taken"))
    w = Window.partitionBy(name).orderBy("__k", F.desc("__taken")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    skipped = marks.unionByName(repeats).withColumn("__skip", F.sum("__taken").over(w)).filter("__taken = 0").select(name, "__k", "__skip")
    number = F.col("__k") + F.coalesce("__skip", F.lit(0))
    named = F.when(F.col("__k") == 0, F.col(name)).otherwise(F.concat_ws("_", F.col(name), number.cast("string")))
    return rows.join(skipped, [name, "__k"], "left").select(*df.columns, named.alias("unique_id"))


def refreshed(candidate: DataFrame, last_good: DataFrame, key: list[str], expected: int) -> DataFrame:
    """The new snapshot if it has the rows that are expected, each key once; else the last good one.

    Both are read lazily; the check is two counts in one pass over the keys.
    """
    n, keys = candidate.agg(F.count("*").alias("n"), F.count_distinct(*key).alias("keys")).first()
    return candidate if n == keys == expected else last_good


def shared_records(existing: DataFrame, asked: DataFrame, key: list[str], record_id: str) -> tuple[DataFrame, DataFrame]:
    """(new records, links): records of a set that stand already are used again, the others get the next ids.

    ``asked`` has (set, *key), ``existing`` (*key, id).
    """
    missing = asked.select(*key).distinct().join(existing.select(*key), key, "left_anti")
    top = existing.agg(F.coalesce(F.max(record_id), F.lit(0)).cast("bigint").alias("__top"))
    new = placed(missing, *key, place="__place").join(F.broadcast(top)).select(*key, (F.col("__place") + F.col("__top")).alias(record_id))  # one row
    links = asked.join(existing.select(*key, F.col(record_id).cast("bigint").alias(record_id)).unionByName(new), key)
    return new, links
