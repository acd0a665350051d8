"""Queries of the general training-data problems (1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators.nested_records import MUTATION_RULES, PROCESSED_RULES, extract_lists, flatten_members
from helixmill.operators.packed_fields import split_packed
from helixmill.session import busy, spread, table


def author_spellings(spark: SparkSession, root: str) -> DataFrame:
    """(item): the distinct values of the packed author lists; a list that comes again is split once."""
    rows = spread(table(spark, root, "metadata_post_prepare").select("authors", "ncbi_source_db").filter(F.length(F.trim("authors")) > 0).distinct())
    return split_packed(rows, value="authors", source=F.col("ncbi_source_db"), kind="person").select("item").distinct()


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Each value of authors and of fasta_ids with its place.

    Repeated rows go before the split, while they are one text each.
    """
    out = []
    for field, name, key, source, kind in (("authors", "metadata_post_prepare", "id", "ncbi_source_db", "person"), ("fasta_ids", "cchfv_test_metadata", "sample_id", "sample_type", "id")):
        rows = table(spark, root, name).select(F.col(key).alias("record_id"), F.col(field).alias("value"), F.col(source).alias("source")).filter(F.length(F.trim("value")) > 0)
        split = split_packed(spread(rows.dropDuplicates(["record_id", "value"])), value="value", source=F.col("source"), kind=kind)
        out.append(split.select(F.lit(field).alias("field_name"), "record_id", "pos", "item"))
    return out[0].unionAll(out[1])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Each element of the nested lists of processed records and mutation reports."""
    processed = table(spark, root, "sequence_entries_preprocessed_data").select(
        F.concat("accession", F.lit("."), F.col("version").cast("string"), F.lit("/"), F.col("pipeline_version").cast("string")).alias("record_id"), "processed_data"
    )
    mutations = table(spark, root, "mutations_from_founder_clade").select(F.concat("accession", F.lit("."), F.col("version").cast("string")).alias("record_id"), "mutations")
    return (
        extract_lists(busy(processed), record_id="record_id", json_col="processed_data", rules=PROCESSED_RULES)
        .unionAll(extract_lists(busy(mutations), record_id="record_id", json_col="mutations", rules=MUTATION_RULES))
        .distinct()
    )


def p4_members(spark: SparkSession, root: str) -> DataFrame:
    """All members of the processed records and of the mutation reports as linked rows."""
    key = F.concat_ws(".", "accession", F.col("version").cast("string"))
    processed = table(spark, root, "sequence_entries_preprocessed_data").dropDuplicates(["accession", "version", "pipeline_version"])
    processed = processed.select(F.lit("processed_data").alias("source"), F.concat_ws("/", key, F.col("pipeline_version").cast("string")).alias("record_id"), F.col("processed_data").alias("payload"))
    reports = table(spark, root, "mutations_from_founder_clade").dropDuplicates(["accession", "version"]).select(F.lit("mutations").alias("source"), key.alias("record_id"), F.col("mutations").alias("payload"))
    return flatten_members(processed.unionAll(reports), "payload")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_members": p4_members}
SQL: dict[str, str] = {}
