"""Checks of processed records: each returns a column of error codes or a violation flag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symbols of sequences (fixed values).
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWYBZX-*"
ALIGNED_NUCLEOTIDES = "ACGTMRWSYKVHDBN-"
NUCLEOTIDES = "ACGTMRWSYKVHDBN"


def unknown_keys(keys: Column, schema: Sequence[str]) -> Column:
    """Keys outside the schema, sorted."""
    return F.array_sort(F.array_except(keys, F.array(*(F.lit(k) for k in schema))))


def missing_required(values: Mapping[str, Column]) -> Column:
    """Names of required fields that are null."""
    return F.array_compact(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in values.items())))


def json_kind(c: Column) -> Column:
    """Kind of a JSON scalar by its text: the cast would hide that ``1`` is no float."""
    t = F.trim(c)
    return (
        F.when(t.isNull() | (t == "null"), "null").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^-?(0|[1-9]\d*)$"), "int")
        .when(t.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), "float").when(t.startswith('"'), "string").otherwise("other")
    )


def fits_type(c: Column, kind: str) -> Column:
    """Whether a JSON scalar may stand in a field of a type; null always may."""
    k = json_kind(c)
    small = F.trim(c).try_cast("bigint").between(-(1 << 31), (1 << 31) - 1)
    allowed = {"int": (k == "int") & small, "float": k == "float", "number": k.isin("int", "float"), "boolean": k == "boolean", "string": k == "string"}[kind]
    return (k == "null") | F.coalesce(allowed, F.lit(False))


def valid_date(c: Column) -> Column:
    """A day as ``yyyy-MM-dd`` that exists; null passes."""
    return c.isNull() | (c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull())


def wrong_length(c: Column, length: int | Column) -> Column:
    return c.isNotNull() & (F.length(c) != length)


def key_sets_differ(a: Column, b: Column) -> Column:
    """Keys that only one of two maps has, sorted."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def precondition_errors(wanted: DataFrame, entries: DataFrame, key: list[str], statuses: Sequence[str], organism: str) -> DataFrame:
    """(key, error): wanted records that do not exist, are of another organism or in another state."""
    have = entries.select(*key, F.col("organism").alias("__organism"), F.col("status").alias("__status"), F.lit(True).alias("__there"))
    error = F.when(F.col("__there").isNull(), "missing").when(F.col("__organism") != organism, "other_organism").when(~F.col("__status").isin(*statuses), "wrong_state")
    return wanted.select(*key).distinct().join(have, key, "left").select(*key, error.alias("error")).filter("error is not null")


def terms_change_error(old_kind: Column, old_until: Column, new_kind: Column, new_until: Column, today: Column) -> Column:
    """Why a change of terms is refused: open data stay open, limits are not extended and end within a year."""
    return (
        F.when((old_kind == "OPEN") & (new_kind == "RESTRICTED"), "already_open")
        .when((new_kind == "RESTRICTED") & ((new_until < today) | (new_until > F.add_months(today, 12))), "date_out_of_range")
        .when((old_kind == "RESTRICTED") & (new_kind == "RESTRICTED") & (new_until > old_until), "extension")
    )


def read_file_errors(files: DataFrame, key: str, name: str, most: int = 2) -> DataFrame:
    """(key, error): unknown formats, mixed formats, too many files."""
    low = F.lower(F.col(name))
    kind = F.when(low.rlike(r"\.(fastq|fq)(\.gz)?$"), "fastq").when(low.endswith(".bam"), "bam").when(low.endswith(".cram"), "cram")
    g = files.withColumn("__kind", kind).groupBy(key).agg(F.count_distinct("__kind").alias("kinds"), F.sum(F.col("__kind").isNull().cast("int")).alias("unknown"), F.count("*").alias("n"))
    error = F.when(F.col("unknown") > 0, "unknown_format").when(F.col("kinds") > 1, "mixed_formats").when(F.col("n") > most, "too_many_files")
    return g.select(key, error.alias("error")).filter("error is not null")


def alignment_problem(given: Column, aligned: Column) -> Column:
    """Whether none or only some of the given sequences are aligned."""
    aligned = F.when(aligned > 0, aligned).otherwise(0)
    return F.when((given > 0) & (aligned == 0), "none_aligned").when(aligned < given, "some_unaligned")


def alignment_annotations(given: Column, aligned: Column, *, any_is_enough: bool) -> tuple[Column, Column]:
    """(errors, warnings): names of given segments that are not aligned.

    Where all must be aligned each one is an error.  Where one is enough they
    are warnings, and ``*`` is an error if none is aligned.
    """
    lost = F.array_sort(F.array_except(given, aligned))
    none = F.array().cast("array<string>")
    if not any_is_enough:
        return lost, none
    return F.when((F.size(given) > 0) & (F.size(F.array_intersect(given, aligned)) == 0), F.array(F.lit("*"))).otherwise(none), lost


def assign_segments(ids: Column, segments: Sequence[str]) -> Column:
    """struct(assigned, duplicates, leftovers, nothing) of the sequence ids of an entry.

    ``assigned`` maps segments that one id names to it; ``duplicates`` are
    segments named by several ids, ``leftovers`` ids that name no segment.
    """
    named = F.transform(ids, lambda x: F.struct(segment_of(x, segments).alias("segment"), x.alias("id")))
    of = lambda s: F.filter(named, lambda x: x["segment"] == s)
    one = F.array_compact(F.array(*(F.when(F.size(of(s)) == 1, F.struct(F.lit(s).alias("segment"), F.get(of(s), 0)["id"].alias("id"))) for s in segments)))
    twice = F.array_compact(F.array(*(F.when(F.size(of(s)) > 1, F.lit(s)) for s in segments)))
    rest = F.array_sort(F.transform(F.filter(named, lambda x: x["segment"].isNull()), lambda x: x["id"]))
    return F.struct(F.map_from_entries(one).alias("assigned"), twice.alias("duplicates"), rest.alias("leftovers"), ((F.size(one) == 0) & (F.size(twice) == 0)).alias("nothing"))


#: Characters that file names may not hold (fixed values): control characters, blanks, and those that file systems refuse.
FORBIDDEN_IN_NAMES = '/\\:*"?<>|'
MAX_NAME = 255


def file_name_error(name: Column) -> Column:
    """Why a file name is refused."""
    bad = "[\\x00-\\x1f\\s" + "".join("\\" + c for c in FORBIDDEN_IN_NAMES) + "]"
    return F.when(F.coalesce(name, F.lit("")) == "", "empty_name").when(F.length(name) > MAX_NAME, "name_too_long").when(name.rlike(bad), "forbidden_character")


def file_mapping_errors(files: DataFrame, key: Sequence[str], categories: Sequence[str], *, known: DataFrame | None = None) -> DataFrame:
    """(key, category, name, error) of files (key, category, name, file_id): refused names, unknown categories, names that come again, unknown ids.

    ``known`` has the file ids that were uploaded.
    """
    rows = files if known is None else files.join(known.select("file_id", F.lit(True).alias("__known")).distinct(), "file_id", "left")
    twice = rows.groupBy(*key, "category", "name").agg(F.count("*").alias("__n")).filter("__n > 1 and name is not null").select(*key, "category", "name", F.lit("repeated_name").alias("error"))
    codes = [file_name_error(F.col("name")), F.when(~F.col("category").isin(*categories), "unknown_category")]
    if known is not None:
        codes.append(F.when(F.col("__known").isNull(), "unknown_file"))
    single = rows.select(*key, "category", "name", F.explode(F.array_compact(F.array(*codes))).alias("error")).distinct()
    return single.unionByName(twice)


def precondition_report(wanted: DataFrame, entries: DataFrame, key: Sequence[str], *, organism: str, statuses: Sequence[str], groups: Sequence[int] | None = None, most: int = 10) -> DataFrame:
    """(error, n, shown): one message for each kind of violation, with the first keys in order.

    A key may violate several conditions: it is missing; it is of another
    organism, in another state, has errors, or belongs to none of the groups.
    """
    have = entries.select(*key, F.col("organism").alias("__organism"), F.col("status").alias("__status"), F.col("processing_result").alias("__result"), F.col("group_id").alias("__group"), F.lit(True).alias("__there"))
    codes = [
        F.when(F.col("__there").isNull(), "missing"), F.when(F.col("__organism") != organism, "other_organism"), F.when(~F.col("__status").isin(*statuses), "wrong_state"),
        F.when(F.col("__result") == "HAS_ERRORS", "has_errors"), *([F.when(~F.col("__group").isin(*groups), "no_permission")] if groups is not None else []),
    ]
    rows = wanted.select(*key).distinct().join(have, list(key), "left").select(F.struct(*key).alias("__key"), F.explode(F.array_compact(F.array(*codes))).alias("error"))
    # the first keys are kept by small sorted sets, so that no task holds all of a kind
    w = Window.partitionBy("error").orderBy("__key")
    first = rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= most)
    shown = first.groupBy("error").agg(F.array_join(F.transform(F.array_sort(F.collect_list("__key")), lambda x: F.concat_ws(".", *(x[k].cast("string") for k in key))), ", ").alias("shown"))
    return rows.groupBy("error").agg(F.count("*").alias("n")).join(shown, "error").select("error", "n", "shown")


def set_record_errors(records: DataFrame, sets: DataFrame, released: DataFrame, key: str, accession: str, version: str) -> DataFrame:
    """(key, error): sets without records, with an accession that comes again, or with records that are not released.

    A record without a version asks for version 1.
    """
    rows = records.filter(F.col(accession).isNotNull()).select(key, F.col(accession).alias("accession"), F.coalesce(F.col(version), F.lit(1)).cast("bigint").alias("version"))
    empty = sets.select(key).distinct().join(rows.select(key).distinct(), key, "left_anti").select(key, F.lit("empty").alias("error"))
    twice = rows.groupBy(key, "accession").count().filter("count > 1").select(key, F.lit("repeated_accession").alias("error")).distinct()
    closed = rows.join(released.select("accession", F.col("version").cast("bigint").alias("version")).distinct(), ["accession", "version"], "left_anti").select(key, F.lit("not_released").alias("error")).distinct()
    return empty.unionByName(twice).unionByName(closed)


def set_update_error(name: Column, fields: Mapping[str, tuple[Column, Column]]) -> Column:
    """Why an update of a set is refused: a blank name, or no field (old, new) that changes."""
    same = reduce(lambda a, b: a & b, (old.eqNullSafe(new) for old, new in fields.values()))
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "blank_name").when(same, "nothing_changed")


def segment_of(header: Column, segments: Sequence[str]) -> Column:
    """The segment named by the last part of a header after ``_``, or by all of it, in any case."""
    last = F.lower(F.substring_index(header, "_", -1))
    table = F.create_map(*(F.lit(v) for s in segments for v in (s.lower(), s)))
    return F.element_at(table, last)
