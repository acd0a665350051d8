"""Queries of the text-corpus problems (2, 3, 5 to 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import lexicon
from helixmill.llm.address_match import match_addresses, place_classes, place_pairs
from helixmill.llm.bpe_encode import encode_corpus
from helixmill.llm.canonical_map import map_to_canonical, reference_rows
from helixmill.llm.encoding_repair import restore_encoding
from helixmill.llm.leak_detection import find_leaks, remove_leaks
from helixmill.llm.name_variants import name_classes, name_pairs, organisation_nodes, person_nodes
from helixmill.session import busy, table
from helixmill.training_queries import author_spellings


def _places(spark: SparkSession, root: str) -> DataFrame:
    """(id, place) of the groups that share a building."""
    return match_addresses(
        table(spark, root, "groups_table"), key="group_id", institution="institution", line1="address_line_1", line2="address_line_2", postal="address_postal_code", city="address_city", country="address_country"
    )


def p2_classes(spark: SparkSession, root: str) -> DataFrame:
    """Each group that shares its building with its place and the number of its links."""
    return place_classes(_places(spark, root)).withColumnRenamed("id", "group_id")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of groups that sit in one building."""
    return place_pairs(_places(spark, root)).select(F.col("a").alias("group_id_a"), F.col("b").alias("group_id_b"))


def _name_nodes(spark: SparkSession, root: str) -> DataFrame:
    """What the author names and the affiliations are parsed into."""
    people = person_nodes(author_spellings(spark, root), "item", "authors").withColumn("orgs", F.lit(False))
    places = organisation_nodes(table(spark, root, "metadata_post_prepare").select("author_affiliations"), "author_affiliations", "author_affiliations").withColumn("orgs", F.lit(True))
    return people.unionAll(places)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of spellings of one person or one organisation."""
    return name_pairs(_name_nodes(spark, root)).withColumnRenamed("field", "field_name")


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    """Each spelling with its class and the number of its links, without writing out the pairs."""
    return name_classes(_name_nodes(spark, root)).withColumnRenamed("field", "field_name")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Each sampling country and host with the entry of the reference list that was meant."""
    countries = [(r.country_id, r.country_name) for r in reference_rows(table(spark, root, "ref_countries"))]
    hosts = [(r.host_taxon_id, r.scientific_name, r.common_name) for r in reference_rows(table(spark, root, "ref_hosts"))]
    out = []
    for name, rows, index, parts in (
        ("geo_loc_country", table(spark, root, "metadata_post_prepare").select(F.col("id").alias("record_id"), F.col("geo_loc_country").alias("value")), lexicon.country_index(spark, countries), lexicon.country_parts),
        ("host", table(spark, root, "submit_metadata").select(F.col("submission_id").alias("record_id"), F.col("host").alias("value")), lexicon.host_index(hosts), lexicon.host_parts),
    ):
        mapped = map_to_canonical(rows, value="value", index=index, parts=parts)
        out.append(rows.distinct().join(mapped, "value").select(F.lit(name).alias("field_name"), "record_id", "ref_id"))
    return out[0].unionAll(out[1]).distinct()


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of each document."""
    return encode_corpus(busy(table(spark, root, "documents").select("doc_id", "text")), text="text", key="doc_id")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the evaluation items that they leak."""
    leaks = find_leaks(busy(table(spark, root, "documents").select("doc_id", "text")), table(spark, root, "eval_items"), text="text", key="doc_id", passage="passage", item_key="item_id", spans=False)
    return leaks.select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """All documents, those that leak without the passages in them."""
    docs = busy(table(spark, root, "documents").select("doc_id", "text"))
    leaks = find_leaks(docs, table(spark, root, "eval_items"), text="text", key="doc_id", passage="passage", item_key="item_id")
    return remove_leaks(docs, leaks, text="text", key="doc_id").select("doc_id", "text")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Garbled documents with the digest of the restored text."""
    restored = restore_encoding(busy(table(spark, root, "documents").select("doc_id", "text")), text="text", key="doc_id")
    return restored.select("doc_id", F.coalesce(F.md5("restored"), F.lit("")).alias("restored_md5")).distinct()


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_classes": p3_classes, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p7_cleaned": p7_cleaned, "p8_found": p8_found}
SQL: dict[str, str] = {}
