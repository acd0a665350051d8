"""Versions of records: the entry view, states, terms and the release view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("RECEIVED", "IN_PROCESSING", "PROCESSED", "APPROVED_FOR_RELEASE")
RESULTS = ("NO_ISSUES", "HAS_WARNINGS", "HAS_ERRORS")
KEY = ["accession", "version"]


def current_pipelines(entries: DataFrame, processed: DataFrame) -> DataFrame:
    """(organism, current): the newest pipeline version that has processed the organism."""
    return entries.select(*KEY, "organism").join(processed.select(*KEY, "pipeline_version"), KEY).groupBy("organism").agg(F.max("pipeline_version").alias("current"))


def with_default_pipeline(entries: DataFrame, current: DataFrame) -> DataFrame:
    """Pipeline version 1 for organisms that have none yet."""
    missing = entries.select("organism").distinct().join(current, "organism", "left_anti")
    return current.unionByName(missing.withColumn("current", F.lit(1).cast("bigint")))


def status_column() -> Column:
    """State of an entry: a release beats a revocation beats the processing state."""
    return (
        F.when(F.col("released_at").isNotNull(), STATUSES[3])
        .when(F.col("is_revocation"), STATUSES[2])
        .when(F.col("processing_status").isin(*STATUSES[1:3]), F.col("processing_status"))
        .otherwise(STATUSES[0])
    )


def result_column() -> Column:
    """Outcome of processing; null while it runs."""
    size = lambda c: F.coalesce(F.json_array_length(c), F.lit(0))
    return F.when(F.col("processing_status") == STATUSES[1], F.lit(None)).when(size("errors") > 0, RESULTS[2]).when(size("warnings") > 0, RESULTS[1]).otherwise(RESULTS[0])


def entry_view(entries: DataFrame, processed: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Entries with the row of the organism's current pipeline, state and outcome.

    The table of pipelines has one row an organism and is small by definition;
    the planner broadcasts it below its own size threshold.
    """
    current = current_pipelines(entries, processed) if current is None else current
    at_current = processed.withColumnRenamed("pipeline_version", "current")
    joined = entries.join(current, "organism", "left").join(at_current, [*KEY, "current"], "left")
    return (
        joined.withColumn("pipeline_version", F.when(F.col("is_revocation") | F.col("processing_status").isNotNull(), F.col("current")))
        .withColumn("status", status_column())
        .withColumn("processing_result", result_column())
        .drop("current")
    )


def unprocessed(entries: DataFrame, processed: DataFrame, pipeline_version: int) -> DataFrame:
    """Entries that this pipeline version has not seen; revocations need no processing."""
    seen = processed.filter(F.col("pipeline_version") == pipeline_version).select(*KEY)
    return entries.filter(~F.col("is_revocation")).join(seen, KEY, "left_anti")


def version_status(released: DataFrame) -> DataFrame:
    """LATEST_VERSION, REVOKED (a higher version is a revocation) or REVISED."""
    w = Window.partitionBy("accession")
    newest = F.max("version").over(w)
    revoked = F.max(F.when(F.col("is_revocation"), F.col("version"))).over(w)
    return released.withColumn("version_status", F.when(F.col("version") == newest, "LATEST_VERSION").when(revoked > F.col("version"), "REVOKED").otherwise("REVISED"))


def earliest_release(released: DataFrame, *dates: str) -> DataFrame:
    """Running minimum of the release time (and of external date columns) over the versions."""
    w = Window.partitionBy("accession").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.least("released_at", *dates) if dates else F.col("released_at")
    return released.withColumn("earliest_release", F.min(own).over(w))


def newest_terms(history: DataFrame, key: str = "accession", at: str = "change_date") -> DataFrame:
    """The newest terms of each record; equal times stay side by side."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return history.withColumn("__rank", F.rank().over(w)).filter("__rank = 1").drop("__rank")


def resolve_terms(df: DataFrame, today: str, kind: str = "terms", until: str = "restricted_until", changed: str = "change_date") -> DataFrame:
    """Terms on the day ``today``: RESTRICTED only while the limit lies ahead; since when the data are open."""
    restricted = (F.col(kind) == "RESTRICTED") & (F.col(until) > F.lit(today).cast("date"))
    opened = F.when(restricted, F.lit(None)).when(F.col(kind) == "RESTRICTED", F.date_format(until, "yyyy-MM-dd")).otherwise(F.date_format(changed, "yyyy-MM-dd"))
    return df.withColumn("terms_now", F.when(restricted, "RESTRICTED").otherwise("OPEN")).withColumn("open_since", opened)


def merge_external(external: DataFrame, key: list[str], at: str, updater: str, metadata: str) -> DataFrame:
    """One map per key: later updates win, equal times by the updater's name.

    Each name keeps its last value in a partial aggregation before anything is
    moved; a map has as many entries as its key has names, whatever the number
    of updates.
    """
    values = external.select(*key, F.struct(at, updater).alias("__at"), F.explode(metadata).alias("__name", "__value"))
    last = values.groupBy(*key, "__name").agg(F.max_by(F.struct("__value"), "__at").alias("__last"))
    return last.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("__name", F.col("__last.__value").alias("__value")))).alias(metadata))


def revoke(entries: DataFrame, keys: DataFrame, submitter: str, at: str, comment: str) -> DataFrame:
    """New revocation rows, one version above the newest of each accession."""
    newest = entries.groupBy("accession").agg(F.max("version").alias("newest"))
    base = keys.select("accession").distinct().join(newest, "accession")
    head = entries.groupBy("accession").agg(F.max_by(F.struct("organism", "submission_id", "group_id"), "version").alias("h"))
    return base.join(head, "accession").select(
        "accession", (F.col("newest") + 1).alias("version"), "h.organism", "h.submission_id", F.lit(submitter).alias("submitter"), "h.group_id",
        F.lit(at).cast("timestamp_ntz").alias("submitted_at"), F.lit(True).alias("is_revocation"), F.to_json(F.struct(F.lit(comment).alias("comment"))).alias("original_data"),
    )


def approve(view: DataFrame, *, approver: str, at: str, groups: list[int] | None = None, include_warnings: bool = True) -> DataFrame:
    """Release rows for processed entries without errors in scope."""
    ok = (F.col("status") == "PROCESSED") & (F.coalesce(F.col("processing_result"), F.lit("NO_ISSUES")) != "HAS_ERRORS")
    if not include_warnings:
        ok &= F.col("processing_result") == "NO_ISSUES"
    if groups is not None:
        ok &= F.col("group_id").isin(groups)
    return view.filter(ok).select(*KEY, F.lit(approver).alias("approver"), F.lit(at).cast("timestamp_ntz").alias("released_at"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of rows of ``old`` with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def newer_pipeline_ready(entries: DataFrame, processed: DataFrame) -> DataFrame:
    """(organism, pipeline_version): versions to switch to.

    A version qualifies if every row that an older version processed without
    errors is processed without errors by it as well (relational division as
    two aggregations: rows it must cover, rows it covers).
    """
    rows = entries.select(*KEY, "organism").join(processed, KEY)
    good = rows.filter((F.col("processing_status") == "PROCESSED") & (F.coalesce(F.json_array_length("errors"), F.lit(0)) == 0)).select("organism", *KEY, "pipeline_version").distinct()
    versions = rows.select("organism", "pipeline_version").distinct()
    first = good.groupBy("organism", *KEY).agg(F.min("pipeline_version").alias("first"))
    need = versions.join(first.groupBy("organism", "first").count(), "organism").filter("first < pipeline_version").groupBy("organism", "pipeline_version").agg(F.sum("count").alias("need"))
    have = good.join(first, ["organism", *KEY]).filter("first < pipeline_version").groupBy("organism", "pipeline_version").agg(F.count("*").alias("have"))
    ready = need.join(have, ["organism", "pipeline_version"]).filter("need = have")
    return ready.groupBy("organism").agg(F.max("pipeline_version").alias("pipeline_version"))


def joint_metadata(is_revocation: Column, metadata: Column, external: Column) -> Column:
    """Processed metadata with external values laid over it; empty for revocations."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    over = F.coalesce(external, none)
    base = F.map_filter(metadata, lambda k, _: ~F.map_contains_key(over, k))
    return F.when(is_revocation, none).when(metadata.isNull(), F.lit(None)).otherwise(F.map_concat(base, over))
