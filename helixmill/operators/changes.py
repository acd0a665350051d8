"""Change detection between deliveries, and differences of versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.text import md5_fraction


def decide_changes(incoming: DataFrame, latest: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, decision): submit (new), revise (digest differs), unchanged, or suppressed (gone)."""
    a = incoming.select(F.col(key), F.col(digest).alias("new"))
    b = latest.select(F.col(key), F.col(digest).alias("old"))
    decision = F.when(F.col("old").isNull(), "submit").when(F.col("new").isNull(), "suppressed").when(F.col("old") != F.col("new"), "revise").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, decision.alias("decision"))


def decide_ingest(incoming: DataFrame, latest: DataFrame, muted: DataFrame, key: str, digest: str, *, fraction: float = 1.0) -> DataFrame:
    """(key, decision) of each delivered record, by the latest submitted version of it.

    ``sampled_out`` (beyond the fraction by the digest of its key), ``submit``
    (new), ``noop`` (same digest, or one that is muted for the record),
    ``blocked:<status>`` (not released yet), ``blocked:CURATION_ISSUE`` (edited
    by others before), else ``revise``.  ``latest`` has (key, accession,
    digest, status, curated), ``muted`` (accession, digest).
    """
    old = latest.select(key, "accession", F.col(digest).alias("__old"), "status", "curated", F.lit(True).alias("__there"))
    rows = incoming.select(key, F.col(digest).alias("__new")).join(old, key, "left")
    quiet = muted.select("accession", F.col(digest).alias("__new"), F.lit(True).alias("__muted")).distinct()
    rows = rows.join(quiet, ["accession", "__new"], "left")
    decision = (
        F.when(md5_fraction(F.col(key)) > fraction, "sampled_out").when(F.col("__there").isNull(), "submit").when(F.col("__old").eqNullSafe(F.col("__new")) | F.col("__muted"), "noop")
        .when(F.col("status") != "APPROVED_FOR_RELEASE", F.concat(F.lit("blocked:"), "status")).when(F.col("curated"), "blocked:CURATION_ISSUE").otherwise("revise")
    )
    return rows.select(key, decision.alias("decision"))


def decide_regrouping(groups: DataFrame, members: DataFrame, group: str, member: str) -> DataFrame:
    """(group, decision) of delivered groups (group, member) against the groups in which the members stood (member, old_group).

    ``submit`` if no member is known, ``same`` if the old group had the same
    members, ``grown`` if all known members stood in one old group that is
    contained in the new one, else ``regrouped``.
    """
    old_size = members.groupBy("old_group").agg(F.count("*").alias("__old_size"))
    rows = groups.select(group, member).distinct().join(members, member, "left").join(old_size, "old_group", "left")
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.count("old_group").alias("known"), F.count_distinct("old_group").alias("olds"), F.max("__old_size").alias("size"))
    one = (F.col("olds") == 1) & (F.col("known") == F.col("size"))
    return g.select(group, F.when(F.col("known") == 0, "submit").when(one & (F.col("n") == F.col("known")), "same").when(one, "grown").otherwise("regrouped").alias("decision"))


def merge_group_overrides(rows: DataFrame, source: str, group: str, member: str) -> DataFrame:
    """(group, n, status) of groups that several files define, as (source, group, member).

    ``conflicting_definition`` if files give a group different members;
    ``shared_members`` if some of its members stand in another group too and
    the two groups are not equal; else ``ok``.  Groups are compared by their
    size and a digest of their sorted members.
    """
    each = rows.select(source, group, member).distinct()
    defined = each.groupBy(source, group).agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(member)), "\x01")).alias("__members"))
    merged = defined.groupBy(group).agg(F.max("n").alias("n"), F.count_distinct("__members").alias("__k"), F.min("__members").alias("__members"))
    of = each.select(group, member).distinct().join(merged.select(group, "__members"), group)
    shared = of.groupBy(member).agg(F.count_distinct("__members").alias("__sets")).filter("__sets > 1").select(member)
    torn = of.join(shared, member, "left_semi").select(group, F.lit(True).alias("__torn")).distinct()
    status = F.when(F.col("__k") > 1, "conflicting_definition").when(F.col("__torn"), "shared_members").otherwise("ok")
    return merged.join(torn, group, "left").select(group, "n", status.alias("status"))


def list_differences(a: DataFrame, b: DataFrame, key: Sequence[str], segment: str, value: str) -> DataFrame:
    """(key, segment, side, value): what only one of two versions holds, segment by segment."""
    on = [*key, segment, value]
    first = a.select(*on).distinct().join(b.select(*on).distinct(), on, "left_anti").withColumn("side", F.lit("only_first"))
    return first.unionByName(b.select(*on).distinct().join(a.select(*on).distinct(), on, "left_anti").withColumn("side", F.lit("only_second")))


def nearest_earlier(rows: DataFrame, known: DataFrame, base: str, version: str, value: str) -> DataFrame:
    """The value of the same version, else of the nearest earlier version of the same base that has one.

    One sort per base: known values and rows are merged and the last known
    value is carried forward.
    """
    marked = rows.select(base, version, F.lit(None).cast(known.schema[value].dataType).alias("__known"), F.lit(True).alias("__row"))
    given = known.select(base, version, F.col(value).alias("__known"), F.lit(False).alias("__row"))
    w = Window.partitionBy(base).orderBy(version, "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return given.unionByName(marked).withColumn(value, F.last("__known", ignorenulls=True).over(w)).filter("__row").select(base, version, value)


def field_diff(a: DataFrame, b: DataFrame, key: str, field: str, value: str, noisy: tuple[str, ...] = (), hidden: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, change): added, removed, changed, unchanged, noisy or hidden for each field of two versions."""
    x, y = a.select(key, field, F.col(value).alias("va")), b.select(key, field, F.col(value).alias("vb"))
    change = F.when(F.col("va").isNull() & F.col("vb").isNotNull(), "added").when(F.col("va").isNotNull() & F.col("vb").isNull(), "removed").when(F.col("va").eqNullSafe(F.col("vb")), "unchanged")
    change = change.when(F.col(field).isin(*noisy), "noisy") if noisy else change
    change = F.when(F.col(field).isin(*hidden), "hidden").otherwise(change.otherwise("changed")) if hidden else change.otherwise("changed")
    return x.join(y, [key, field], "full_outer").select(key, field, change.alias("change"))


def key_differences(a: DataFrame, b: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(side, n, shown): keys that only one of two tables has; the first ``most`` are shown in the message."""
    parts = []
    for side, x, y in (("only_first", a, b), ("only_second", b, a)):
        gone = x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti")
        shown = F.array_join(F.slice(F.array_sort(F.collect_list(F.col(key).cast("string"))), 1, most), ", ")
        # the list shown is taken of the smallest keys only, so that no task holds all of them
        few = gone.orderBy(F.col(key).cast("string")).limit(most).agg(shown.alias("shown"))
        parts.append(gone.agg(F.count("*").alias("n")).crossJoin(few).select(F.lit(side).alias("side"), "n", "shown"))
    return parts[0].unionByName(parts[1])


def set_difference(a: str, b: str):
    """Elements of one array column that the other lacks, sorted."""
    return F.array_sort(F.array_except(F.col(a), F.col(b)))
