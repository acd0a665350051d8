"""One query for each operator of the record engine, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions import metadata as M
from helixmill.functions import text as X
from helixmill.functions import validation as V
from helixmill.operators import changes, counts, entries, filters, hierarchy, sequences
from helixmill.registry import Registry
from helixmill.session import table
from helixmill.sources import readers, writers

query = Registry()

# ------------------------------------------------------------- shared inputs

#: The same base tables in SQL; repeated deliveries count once.
E = "e AS (SELECT DISTINCT * FROM sequence_entries)"
P = "p AS (SELECT DISTINCT * FROM sequence_entries_preprocessed_data)"
CPP = "cpp AS (SELECT organism, max(pipeline_version) AS current FROM e JOIN p USING (accession, version) GROUP BY organism)"
VIEW = (
    f"{E}, {P}, {CPP}, v AS (SELECT e.*, CASE WHEN e.is_revocation OR p.processing_status IS NOT NULL THEN cpp.current END AS pipeline_version, "
    "p.processed_data, p.errors, p.warnings, p.processing_status, p.started_processing_at, p.finished_processing_at, "
    "CASE WHEN released_at IS NOT NULL THEN 'APPROVED_FOR_RELEASE' WHEN is_revocation THEN 'PROCESSED' WHEN processing_status IS NOT NULL THEN processing_status ELSE 'RECEIVED' END AS status, "
    "CASE WHEN processing_status = 'IN_PROCESSING' THEN NULL WHEN coalesce(json_array_length(errors), 0) > 0 THEN 'HAS_ERRORS' WHEN coalesce(json_array_length(warnings), 0) > 0 THEN 'HAS_WARNINGS' ELSE 'NO_ISSUES' END AS processing_result "
    "FROM e LEFT JOIN cpp USING (organism) LEFT JOIN p ON p.accession = e.accession AND p.version = e.version AND p.pipeline_version = cpp.current)"
)
REL = f"{E}, r AS (SELECT * FROM e WHERE released_at IS NOT NULL)"
META = "m AS (SELECT DISTINCT * FROM metadata_post_prepare)"
SUB = "s AS (SELECT DISTINCT * FROM submit_metadata)"
GRP = "g AS (SELECT DISTINCT * FROM groups_table)"


#: Keys of the base tables.  Rows delivered again are equal in every column, so the key tells them apart, and a
#: plan that needs few columns reads, hashes and moves only those and the key.
_KEYS = {
    "sequence_entries": ["accession", "version"], "sequence_entries_preprocessed_data": ["accession", "version", "pipeline_version"],
    "metadata_post_prepare": ["id"], "submit_metadata": ["submission_id"], "groups_table": ["group_id"],
}


def _once(spark: SparkSession, root: str, name: str) -> DataFrame:
    return table(spark, root, name).dropDuplicates(_KEYS[name])


def _e(spark: SparkSession, root: str) -> DataFrame:
    return _once(spark, root, "sequence_entries")


def _e_rows(spark: SparkSession, root: str) -> DataFrame:
    """Entries as delivered: for minima, maxima and sets, to which a repeated row makes no difference."""
    return table(spark, root, "sequence_entries")


def _p(spark: SparkSession, root: str) -> DataFrame:
    return _once(spark, root, "sequence_entries_preprocessed_data")


def _p_rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "sequence_entries_preprocessed_data")


def _v(spark: SparkSession, root: str) -> DataFrame:
    return entries.entry_view(_e(spark, root), _p(spark, root), entries.current_pipelines(_e_rows(spark, root), _p_rows(spark, root)))


def _r(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "sequence_entries").filter("released_at is not null").dropDuplicates(_KEYS["sequence_entries"])


def _r_rows(spark: SparkSession, root: str) -> DataFrame:
    return _e_rows(spark, root).filter("released_at is not null")


def _m(spark: SparkSession, root: str) -> DataFrame:
    return _once(spark, root, "metadata_post_prepare")


def _s(spark: SparkSession, root: str) -> DataFrame:
    return _once(spark, root, "submit_metadata")


def _g(spark: SparkSession, root: str) -> DataFrame:
    return _once(spark, root, "groups_table")


def _day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


# ------------------------------------------------------------ flagship, view


@query("version_status", f"WITH {REL}, w AS (SELECT accession, version, released_at, CASE WHEN version = max(version) OVER a THEN 'LATEST_VERSION' WHEN max(CASE WHEN is_revocation THEN version END) OVER a > version THEN 'REVOKED' ELSE 'REVISED' END AS version_status, min(released_at) OVER (PARTITION BY accession ORDER BY version) AS earliest FROM r WINDOW a AS (PARTITION BY accession)) SELECT version_status, strftime(earliest, '%Y-%m') AS earliest_month, count(*) AS n FROM w GROUP BY ALL")
def version_status(spark, root):
    rows = entries.earliest_release(entries.version_status(_r(spark, root)))
    return rows.groupBy("version_status", F.date_format("earliest_release", "yyyy-MM").alias("earliest_month")).agg(F.count("*").alias("n"))


@query("f06_status", f"WITH {VIEW} SELECT accession, version, status FROM v")
def f06(spark, root):
    return _v(spark, root).select("accession", "version", "status")


@query("f07_result", f"WITH {VIEW} SELECT accession, version, processing_result FROM v")
def f07(spark, root):
    return _v(spark, root).select("accession", "version", "processing_result")


@query("f09_pipeline_version", f"WITH {VIEW} SELECT accession, version, pipeline_version FROM v")
def f09(spark, root):
    return _v(spark, root).select("accession", "version", "pipeline_version")


@query("j01_entry_view", f"WITH {VIEW} SELECT organism, status, coalesce(processing_result, 'RUNNING') AS result, count(*) AS n, count(processed_data) AS with_data FROM v GROUP BY ALL")
def j01(spark, root):
    return _v(spark, root).groupBy("organism", "status", F.coalesce("processing_result", F.lit("RUNNING")).alias("result")).agg(F.count("*").alias("n"), F.count("processed_data").alias("with_data"))


# ------------------------------------------------------------------- sources


@query("s03_fasta_ids", "SELECT sample_id, array_to_string(ids, '|') AS ids, CAST(len(ids) AS BIGINT) AS n, len(ids) <> len(list_distinct(ids)) AS repeated FROM (SELECT DISTINCT sample_id, list_filter(regexp_split_to_array(trim(fasta_ids), '\\s+'), lambda x: x <> '') AS ids FROM cchfv_test_metadata WHERE fasta_ids IS NOT NULL)")
def s03(spark, root):
    ids = readers.fasta_ids(F.col("fasta_ids"))
    rows = table(spark, root, "cchfv_test_metadata").filter("fasta_ids is not null").select("sample_id", "fasta_ids").distinct()
    return rows.select("sample_id", F.array_join(ids, "|").alias("ids"), F.size(ids).cast("bigint").alias("n"), (F.size(ids) != F.size(F.array_distinct(ids))).alias("repeated"))


@query("s05_fasta", f"WITH {E} SELECT accession || '.' || version AS fasta_id, upper(submission_id) AS sequence FROM e WHERE submission_id IS NOT NULL")
def s05(spark, root):
    rows = _e(spark, root).filter("submission_id is not null")
    records = rows.select(F.concat(F.lit(">"), F.col("accession"), F.lit("."), F.col("version").cast("string"), F.lit(" note\n"), F.upper(F.substring("submission_id", 1, 4)), F.lit("\n\n"), F.upper(F.expr("substring(submission_id, 5)"))).alias("value"))
    return readers.parse_fasta(records).select("fasta_id", "sequence")


@query("s15_scan_summary", f"WITH {P} SELECT count(*) AS n, min(pipeline_version) AS first_pipeline, array_to_string(list_sort(list(DISTINCT processing_status)), ',') AS statuses FROM p")
def s15(spark, root):
    return _p(spark, root).agg(F.count("*").alias("n"), F.min("pipeline_version").alias("first_pipeline"), F.array_join(F.array_sort(F.collect_set("processing_status")), ",").alias("statuses"))


@query("s17_scan", f"WITH {E} SELECT accession, version, submission_id FROM e WHERE organism = 'cchf'")
def s17(spark, root):
    return table(spark, root, "sequence_entries").filter("organism = 'cchf'").select("accession", "version", "organism", "submission_id", "submitted_at").distinct().select("accession", "version", "submission_id")


# --------------------------------------------------------------------- sinks


@query("k02_tsv_lines", f"WITH {SUB} SELECT concat_ws(chr(9), submission_id, coalesce(country, ''), coalesce(division, ''), coalesce(region_name, '')) AS line FROM s")
def k02(spark, root):
    meta = F.create_map(F.lit("country"), F.col("country"), F.lit("division"), F.col("division"), F.lit("region"), F.col("region_name"))
    rows = _s(spark, root).withColumn("metadata", F.map_filter(meta, lambda _, v: v.isNotNull()))
    return writers.tsv_lines(rows, ["submission_id"], "metadata", ["country", "division", "region"])


@query("k03_fasta_records", f"WITH {E} SELECT '>' || accession || '|' || organism || chr(10) || upper(submission_id) AS record FROM e")
def k03(spark, root):
    return writers.fasta_records(_e(spark, root).withColumn("seq", F.upper("submission_id")), ["accession", "organism"], "seq")


@query("k09_upload_entries", f"WITH {SUB} SELECT submission_id, group_id, array_to_string(list_sort(list(country || '=' || coalesce(division, ''))), ';') AS sequences FROM s WHERE country IS NOT NULL GROUP BY ALL")
def k09(spark, root):
    parts = F.array_join(F.array_sort(F.collect_list(F.concat("country", F.lit("="), F.coalesce("division", F.lit(""))))), ";")
    return _s(spark, root).filter("country is not null").groupBy("submission_id", "group_id").agg(parts.alias("sequences"))


# ------------------------------------------------------------------- filters


@query("f01_equality", f"WITH {VIEW} SELECT accession, version FROM v WHERE organism IN ('cchf', 'rvf') AND status = 'APPROVED_FOR_RELEASE' AND group_id < 50")
def f01(spark, root):
    v = _v(spark, root)
    return v.filter(filters.all_of([F.col("organism").isin("cchf", "rvf"), F.col("status") == "APPROVED_FOR_RELEASE", F.col("group_id") < 50])).select("accession", "version")


@query("f02_key_tuples", f"WITH {E}, {P} SELECT accession, version, organism FROM e WHERE (accession, version) IN (SELECT accession, version FROM p WHERE pipeline_version = 2)")
def f02(spark, root):
    return filters.keys_in(_e(spark, root), _p(spark, root).filter("pipeline_version = 2"), ["accession", "version"]).select("accession", "version", "organism")


@query("f03_or_fold", f"WITH {E} SELECT accession, version FROM e WHERE submitter = 'user_15' OR submitter = 'user_85'")
def f03(spark, root):
    return _e(spark, root).filter(filters.any_of(F.col("submitter") == u for u in ("user_15", "user_85"))).select("accession", "version")


@query("f04_result_filter", f"WITH {VIEW} SELECT accession, version, status FROM v WHERE processing_result IN ('HAS_ERRORS', 'HAS_WARNINGS') OR NOT status = 'PROCESSED'")
def f04(spark, root):
    return _v(spark, root).filter(F.col("processing_result").isin("HAS_ERRORS", "HAS_WARNINGS") | (F.col("status") != "PROCESSED")).select("accession", "version", "status")


@query("f05_scope", f"WITH {E}, {GRP} SELECT accession, version FROM e WHERE group_id IN (SELECT group_id FROM g WHERE address_country = 'Kenya')")
def f05(spark, root):
    return _e(spark, root).join(_g(spark, root).filter("address_country = 'Kenya'").select("group_id"), "group_id", "left_semi").select("accession", "version")


@query("f10_f11_json", f"WITH {E} SELECT accession, version, json_extract_string(original_data, '$.metadata.hash') AS hash, json_extract_string(original_data, '$.metadata.none') AS missing FROM e")
def f10(spark, root):
    meta = F.from_json(F.get_json_object("original_data", "$.metadata"), "map<string,string>")
    return _e(spark, root).select("accession", "version", F.element_at(meta, "hash").alias("hash"), F.element_at(meta, "none").alias("missing"))


@query("f12_range", f"WITH {SUB} SELECT submission_id FROM s WHERE collection_date >= '2019-01-01' AND collection_date <= '2020-12-31'")
def f12(spark, root):
    return _s(spark, root).filter(filters.in_range("collection_date", "2019-01-01", "2020-12-31")).select("submission_id")


_SPANS = f"WITH {P} SELECT accession, version, pipeline_version FROM p WHERE "


@query("f13_overlap", _SPANS + "finished_processing_at >= TIMESTAMP '2023-01-01' AND started_processing_at <= TIMESTAMP '2023-03-31'")
def f13(spark, root):
    low, high = F.lit("2023-01-01").cast("timestamp_ntz"), F.lit("2023-03-31").cast("timestamp_ntz")
    return _p(spark, root).filter(filters.range_overlap("started_processing_at", "finished_processing_at", low, high, strict=False)).select("accession", "version", "pipeline_version")


@query("f13_overlap_strict", _SPANS + "started_processing_at >= TIMESTAMP '2023-01-01' AND finished_processing_at <= TIMESTAMP '2023-03-31'")
def f13s(spark, root):
    low, high = F.lit("2023-01-01").cast("timestamp_ntz"), F.lit("2023-03-31").cast("timestamp_ntz")
    return _p(spark, root).filter(filters.range_overlap("started_processing_at", "finished_processing_at", low, high, strict=True)).select("accession", "version", "pipeline_version")


@query("f14_substring", f"WITH {GRP} SELECT group_id FROM g WHERE contains(lower(institution), 'inst.')")
def f14(spark, root):
    return _g(spark, root).filter(filters.contains_literal("institution", "Inst.")).select("group_id")


@query("f15_percentage", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_discount >= 5 / 100.0")
def f15(spark, root):
    return table(spark, root, "lineitem").filter(F.col("l_discount") >= 5 / 100.0).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("f16_multi_field", f"WITH {GRP} SELECT group_id FROM g WHERE (contains(lower(institution), 'vet') OR contains(lower(address_line_1), 'vet')) AND (contains(lower(institution), 'a') OR contains(lower(address_line_1), 'a'))")
def f16(spark, root):
    return _g(spark, root).filter(filters.multi_field_search(["institution", "address_line_1"], ["vet", "a"])).select("group_id")


@query("f17_null_filter", f"WITH {SUB} SELECT submission_id FROM s WHERE (country IS NULL OR country = 'Kenya') AND (region_name IS NULL OR region_name = 'Africa')")
def f17(spark, root):
    return _s(spark, root).filter(filters.null_filters({"country": [None, "Kenya"], "region_name": [None, "Africa"]})).select("submission_id")


@query("f17_null_filter_or", f"WITH {SUB} SELECT submission_id FROM s WHERE country IS NULL OR country = 'Kenya' OR division IS NULL OR division = 'Pefudatim'")
def f17or(spark, root):
    return _s(spark, root).filter(filters.null_filters({"country": [None, "Kenya"], "division": [None, "Pefudatim"]}, either=True)).select("submission_id")


@query("f18_accession_list", f"WITH {E} SELECT accession, version FROM e WHERE accession IN ('LOC_00000K', 'LOC_00001D', 'LOC_000026')")
def f18(spark, root):
    return _e(spark, root).filter(F.col("accession").isin(filters.parse_accessions("LOC_00000K.1, LOC_00001D;\nLOC_000026.2"))).select("accession", "version")


@query("f19_filter_text", f"WITH {SUB} SELECT submission_id FROM s WHERE country = 'Kenya' AND collection_date >= '2018-01-01'")
def f19(spark, root):
    terms = ["country=Kenya", "collection_date>=2018-01-01"]
    return _s(spark, root).filter(filters.all_of(filters.parse_filter(t, ["country", "collection_date"], ["collection_date"]) for t in terms)).select("submission_id")


@query("f21_latest", f"WITH {REL} SELECT accession, version FROM (SELECT *, max(version) OVER (PARTITION BY accession) AS newest FROM r) WHERE version = newest AND NOT is_revocation")
def f21(spark, root):
    return entries.version_status(_r(spark, root)).filter("version_status = 'LATEST_VERSION' and not is_revocation").select("accession", "version")


@query("f22_metadata_equality", f"WITH {META} SELECT id FROM m WHERE segment = 'L' AND ncbi_source_db = 'GenBank'")
def f22(spark, root):
    return _m(spark, root).filter(filters.all_of([F.col("segment") == "L", F.col("ncbi_source_db") == "GenBank"])).select("id")


@query("f23_null_strip_fill", f"WITH {SUB} SELECT submission_id, CAST((country IS NOT NULL)::INT + (division IS NOT NULL)::INT + (host IS NOT NULL)::INT AS BIGINT) AS stored, country, host FROM s")
def f23(spark, root):
    stored = F.map_filter(F.create_map(F.lit("country"), F.col("country"), F.lit("division"), F.col("division"), F.lit("host"), F.col("host")), lambda _, v: v.isNotNull())
    rows = _s(spark, root).withColumn("stored", stored)
    return rows.select("submission_id", F.size("stored").cast("bigint").alias("n"), F.element_at("stored", "country").alias("country"), F.element_at("stored", "host").alias("host")).withColumnRenamed("n", "stored")


@query("f24_upper", f"WITH {P} SELECT accession, version, pipeline_version, upper(json_extract_string(processed_data, '$.unalignedNucleotideSequences.main')) AS main FROM p WHERE json_valid(processed_data) AND processed_data LIKE '{{%'")
def f24(spark, root):
    seqs = F.transform_values(F.from_json(F.get_json_object("processed_data", "$.unalignedNucleotideSequences"), "map<string,string>"), lambda _, v: F.upper(v))
    rows = _p(spark, root).filter(F.try_parse_json("processed_data").isNotNull() & F.startswith("processed_data", F.lit("{")))
    return rows.select("accession", "version", "pipeline_version", F.element_at(seqs, "main").alias("main"))


@query("f25_exists", f"WITH {P} SELECT count(*) > 0 AS found FROM p WHERE processing_status = 'IN_PROCESSING'")
def f25(spark, root):
    return _p(spark, root).filter("processing_status = 'IN_PROCESSING'").limit(1).agg((F.count("*") > 0).alias("found"))


@query("f26_stale", f"WITH {P} SELECT accession, version, pipeline_version FROM p WHERE processing_status = 'IN_PROCESSING' AND started_processing_at < TIMESTAMP '2023-06-01' - INTERVAL 60 SECOND")
def f26(spark, root):
    return _p(spark, root).filter((F.col("processing_status") == "IN_PROCESSING") & (F.col("started_processing_at") < F.expr("timestamp_ntz'2023-06-01 00:00:00' - interval 60 seconds"))).select("accession", "version", "pipeline_version")


@query("f27_condition_dict", f"WITH {SUB} SELECT submission_id FROM s WHERE host IS NULL AND region_name = 'Africa'")
def f27(spark, root):
    return _s(spark, root).filter(filters.equal_or_null({"host": None, "region_name": "Africa"})).select("submission_id")


@query("f28_distinct_from", f"WITH {E} SELECT accession, version FROM e WHERE approver IS DISTINCT FROM submitter")
def f28(spark, root):
    return _e(spark, root).filter(~F.col("approver").eqNullSafe(F.col("submitter"))).select("accession", "version")


@query("f29_same_text", f"WITH {SUB} SELECT submission_id, host FROM s WHERE lower(host) = 'homo sapiens'")
def f29(spark, root):
    return _s(spark, root).filter(filters.same_text(F.col("host"), F.lit("Homo Sapiens"))).select("submission_id", "host")


# --------------------------------------------------------------------- joins


@query("j02_newest_terms", "SELECT user_id, event_type, CAST(ts AS DATE)::VARCHAR AS day, event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC) AS k FROM events) WHERE k = 1")
def j02(spark, root):
    rows = table(spark, root, "events").withColumn("day", F.to_date("ts"))
    return entries.newest_terms(rows, "user_id", "day").select("user_id", "event_type", _day("day").alias("day"), "event_id")


@query("j03_unprocessed", f"WITH {E}, {P} SELECT accession, version FROM e WHERE NOT is_revocation AND NOT EXISTS (SELECT 1 FROM p WHERE p.accession = e.accession AND p.version = e.version AND p.pipeline_version = 2)")
def j03(spark, root):
    return entries.unprocessed(_e(spark, root), _p(spark, root), 2).select("accession", "version")


@query("j04_theta", f"WITH {VIEW} SELECT p.accession, p.version, p.pipeline_version FROM p JOIN v ON p.accession = v.accession AND p.version = v.version AND p.pipeline_version >= v.pipeline_version")
def j04(spark, root):
    v = _v(spark, root).select("accession", "version", F.col("pipeline_version").alias("current"))
    return _p(spark, root).join(v, ["accession", "version"]).filter("pipeline_version >= current").select("accession", "version", "pipeline_version")


@query("j05_array_membership", f"WITH {META}, t AS (SELECT DISTINCT sample_id, unnest(regexp_split_to_array(trim(fasta_ids), '\\s+')) AS fasta_id FROM cchfv_test_metadata WHERE fasta_ids IS NOT NULL) SELECT sample_id, count(*) AS n FROM t WHERE ends_with(fasta_id, '_S') GROUP BY sample_id")
def j05(spark, root):
    ids = table(spark, root, "cchfv_test_metadata").filter("fasta_ids is not null").select("sample_id", F.explode(readers.fasta_ids(F.col("fasta_ids"))).alias("fasta_id")).distinct()
    segment_s = ids.select("fasta_id").filter(F.endswith("fasta_id", F.lit("_S"))).distinct()
    return ids.join(segment_s, "fasta_id").groupBy("sample_id").agg(F.count("*").alias("n"))


@query("j06_next_version", f"WITH {E}, {SUB} SELECT s.submission_id, e.accession, max(e.version) + 1 AS next_version FROM s JOIN e ON e.submission_id = s.submission_id GROUP BY ALL")
def j06(spark, root):
    return _s(spark, root).select("submission_id").join(_e(spark, root), "submission_id").groupBy("submission_id", "accession").agg((F.max("version") + 1).alias("next_version"))


@query("j07_download", f"WITH {VIEW} SELECT v.accession, v.version, e.original_data FROM v JOIN e ON v.accession = e.accession AND v.version = e.version WHERE v.status = 'PROCESSED'")
def j07(spark, root):
    return _v(spark, root).filter("status = 'PROCESSED'").select("accession", "version", "original_data")


@query("j08_pipeline_statistics", f"WITH {E}, {P} SELECT organism, pipeline_version, count(*) AS n FROM e JOIN p USING (accession, version) GROUP BY ALL")
def j08(spark, root):
    return _e(spark, root).select("accession", "version", "organism").join(_p(spark, root).select("accession", "version", "pipeline_version"), ["accession", "version"]).groupBy("organism", "pipeline_version").agg(F.count("*").alias("n"))


@query(
    "j09_newer_pipeline",
    f"WITH {E}, {P}, ep AS (SELECT e.organism, p.* FROM e JOIN p USING (accession, version)), good AS (SELECT DISTINCT organism, accession, version, pipeline_version FROM ep WHERE processing_status = 'PROCESSED' AND coalesce(json_array_length(errors), 0) = 0) "
    "SELECT organism, max(pipeline_version) AS pipeline_version FROM (SELECT DISTINCT organism, pipeline_version FROM ep) t WHERE EXISTS (SELECT 1 FROM good o WHERE o.organism = t.organism AND o.pipeline_version < t.pipeline_version) "
    "AND NOT EXISTS (SELECT 1 FROM good o WHERE o.organism = t.organism AND o.pipeline_version < t.pipeline_version AND NOT EXISTS (SELECT 1 FROM good n WHERE n.accession = o.accession AND n.version = o.version AND n.pipeline_version = t.pipeline_version)) GROUP BY organism",
)
def j09(spark, root):
    return entries.newer_pipeline_ready(_e(spark, root), _p(spark, root))


@query("j09_division_orders", "SELECT p.o_orderpriority AS priority FROM (SELECT DISTINCT o_orderpriority FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_orderstatus FROM orders) s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = p.o_orderpriority AND o.o_orderstatus = s.o_orderstatus))")
def j09o(spark, root):
    pairs = table(spark, root, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    need = pairs.agg(F.count_distinct("o_orderstatus").alias("need"))
    have = pairs.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("have"))
    return have.join(F.broadcast(need), F.col("have") == F.col("need")).select("priority")  # one row


@query("j10_outdated", f"WITH {E}, {P} SELECT accession, version, pipeline_version FROM p WHERE pipeline_version < 2 AND (accession, version) IN (SELECT accession, version FROM e WHERE organism = 'cchf')")
def j10(spark, root):
    cchf = _e(spark, root).filter("organism = 'cchf'").select("accession", "version")
    return _p(spark, root).filter("pipeline_version < 2").join(cchf, ["accession", "version"], "left_semi").select("accession", "version", "pipeline_version")


@query("j11_orphans", f"WITH {GRP}, {E} SELECT g.group_id FROM g LEFT JOIN (SELECT group_id FROM e WHERE organism = 'rvf' UNION SELECT group_id FROM documents WHERE lang = 'ru') u ON u.group_id = g.group_id WHERE u.group_id IS NULL")
def j11(spark, root):
    used = _e(spark, root).filter("organism = 'rvf'").select("group_id").unionByName(table(spark, root, "documents").filter("lang = 'ru'").select("group_id")).distinct()
    return _g(spark, root).join(used, "group_id", "left_anti").select("group_id")


@query("j12_groups_of_user", f"WITH {E}, {GRP} SELECT DISTINCT e.submitter, g.group_id, g.group_name FROM e JOIN g ON g.group_id = e.group_id WHERE e.submitter = 'user_15'")
def j12(spark, root):
    users = _e(spark, root).filter("submitter = 'user_15'").select("submitter", "group_id").distinct()
    return users.join(_g(spark, root), "group_id").select("submitter", "group_id", "group_name")


@query("j17_default_join", f"WITH {SUB}, t AS (SELECT DISTINCT submission_id, organism FROM sequence_entries WHERE organism = 'rvf' AND version = 1) SELECT s.submission_id, coalesce(t.organism, '') AS organism FROM s LEFT JOIN t USING (submission_id)")
def j17(spark, root):
    t = table(spark, root, "sequence_entries").filter("organism = 'rvf' and version = 1").select("submission_id", "organism").distinct()
    return _s(spark, root).join(t, "submission_id", "left").select("submission_id", F.coalesce("organism", F.lit("")).alias("organism"))


@query("j18_exclusion", f"WITH {META} SELECT id FROM m WHERE insdc_accession_base NOT IN (SELECT insdc_accession_base FROM m WHERE ncbi_source_db = 'RefSeq' AND insdc_accession_base IS NOT NULL) OR insdc_accession_base IS NULL")
def j18(spark, root):
    m = _m(spark, root)
    return m.join(m.filter("ncbi_source_db = 'RefSeq'").select("insdc_accession_base"), "insdc_accession_base", "left_anti").select("id")


_HASHED = "SELECT accession, md5(coalesce(max_by(original_data, version), '')) AS digest FROM e WHERE version {} GROUP BY accession"


@query(
    "j20_change_detection",
    f"WITH {E}, a AS ({_HASHED.format('>= 2')}), b AS ({_HASHED.format('= 1')}) SELECT coalesce(a.accession, b.accession) AS accession, CASE WHEN b.digest IS NULL THEN 'submit' WHEN a.digest IS NULL THEN 'suppressed' WHEN a.digest <> b.digest THEN 'revise' ELSE 'unchanged' END AS decision FROM a FULL JOIN b ON a.accession = b.accession",
)
def j20(spark, root):
    e = _e(spark, root)
    digest = lambda df: df.groupBy("accession").agg(F.md5(F.coalesce(F.max_by("original_data", "version"), F.lit(""))).alias("digest"))
    return changes.decide_changes(digest(e.filter("version >= 2")), digest(e.filter("version = 1")), "accession", "digest")


@query("j21_suppressed", f"WITH {REL}, {SUB} SELECT DISTINCT accession FROM r WHERE submission_id NOT IN (SELECT submission_id FROM s)")
def j21(spark, root):
    return _r(spark, root).join(_s(spark, root).select("submission_id"), "submission_id", "left_anti").select("accession").distinct()


@query("j22_as_of", f"WITH {E}, k AS (SELECT accession, version, submitter FROM e WHERE version % 2 = 1) SELECT e.accession, e.version, k.submitter FROM e ASOF LEFT JOIN k ON k.accession = e.accession AND k.version <= e.version")
def j22(spark, root):
    e = _e(spark, root)
    return changes.nearest_earlier(e, e.filter("version % 2 = 1"), "accession", "version", "submitter")


_TREE = "t AS (SELECT p_partkey AS id, p_partkey // 10 AS parent FROM part)"


@query("j24_closure", f"WITH RECURSIVE {_TREE}, c(node, ancestor, distance) AS (SELECT id, parent, 1 FROM t WHERE parent <> id UNION ALL SELECT c.node, t.parent, c.distance + 1 FROM c JOIN t ON t.id = c.ancestor WHERE t.parent <> t.id), n AS (SELECT id AS node FROM t UNION SELECT parent FROM t) SELECT node, node AS ancestor, 0::BIGINT AS distance FROM n UNION ALL SELECT node, ancestor, distance::BIGINT FROM c")
def j24(spark, root):
    tree = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).alias("parent"))
    return hierarchy.closure(tree, "id", "parent")


@query("j25_nearest_named", f"WITH RECURSIVE {_TREE}, named AS (SELECT p_partkey AS id, p_brand AS name FROM part WHERE p_size > 40), c(node, ancestor, distance) AS (SELECT id, id, 0 FROM t UNION ALL SELECT c.node, t.parent, c.distance + 1 FROM c JOIN t ON t.id = c.ancestor WHERE t.parent <> t.id) SELECT c.node, arg_min(named.name, c.distance) AS name FROM c JOIN named ON named.id = c.ancestor GROUP BY c.node")
def j25(spark, root):
    tree = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).alias("parent"), F.when(F.col("p_size") > 40, F.col("p_brand")).alias("name"))
    nodes = tree.select(F.col("id").alias("node"))
    return hierarchy.nearest_with(tree, "id", "parent", "name").join(nodes, "node", "left_semi")


@query("j28_versions_by_organism", f"WITH {E}, {P} SELECT organism, pipeline_version FROM (SELECT DISTINCT organism FROM e) CROSS JOIN (SELECT DISTINCT pipeline_version FROM p)")
def j28(spark, root):
    # both sides are configuration: a row an organism, a row a pipeline version
    return _e(spark, root).select("organism").distinct().crossJoin(_p(spark, root).select("pipeline_version").distinct())


# -------------------------------------------------------------- aggregations


@query("a01_latest_version", f"WITH {REL} SELECT accession, max(version) AS version FROM r GROUP BY accession")
def a01(spark, root):
    return _r_rows(spark, root).groupBy("accession").agg(F.max("version").alias("version"))


@query("a02_latest_revocation", f"WITH {REL} SELECT accession, max(version) AS version FROM r WHERE is_revocation GROUP BY accession")
def a02(spark, root):
    return _r_rows(spark, root).filter("is_revocation").groupBy("accession").agg(F.max("version").alias("version"))


@query("a03_count", f"WITH {REL} SELECT count(*) AS n FROM r")
def a03(spark, root):
    return _r(spark, root).agg(F.count("*").alias("n"))


@query("a04_status_counts", f"WITH {VIEW} SELECT k.status, count(v.accession) AS n FROM (VALUES ('RECEIVED'), ('IN_PROCESSING'), ('PROCESSED'), ('APPROVED_FOR_RELEASE')) k(status) LEFT JOIN v ON v.status = k.status GROUP BY k.status")
def a04(spark, root):
    return counts.zero_filled(_v(spark, root), "status", entries.STATUSES)


@query("a05_result_counts", f"WITH {VIEW} SELECT k.processing_result, count(v.accession) AS n FROM (VALUES ('NO_ISSUES'), ('HAS_WARNINGS'), ('HAS_ERRORS')) k(processing_result) LEFT JOIN v ON v.processing_result = k.processing_result AND v.status = 'PROCESSED' GROUP BY k.processing_result")
def a05(spark, root):
    return counts.zero_filled(_v(spark, root).filter("status = 'PROCESSED'"), "processing_result", entries.RESULTS)


@query("a09_organisms", "SELECT DISTINCT organism FROM sequence_entries")
def a09(spark, root):
    return table(spark, root, "sequence_entries").select("organism").distinct()


@query("a10_filtered_max", f"WITH {E} SELECT organism, max(version) AS version FROM e WHERE NOT is_revocation GROUP BY organism")
def a10(spark, root):
    return _e_rows(spark, root).filter("not is_revocation").groupBy("organism").agg(F.max("version").alias("version"))


@query("a11_recent_count", f"WITH {E} SELECT group_id, count(*) AS n FROM e WHERE submitted_at >= TIMESTAMP '2024-01-08' - INTERVAL 7 DAY AND submitted_at < TIMESTAMP '2024-01-08' GROUP BY group_id")
def a11(spark, root):
    return _e(spark, root).filter("submitted_at >= timestamp_ntz'2024-01-01 00:00:00' and submitted_at < timestamp_ntz'2024-01-08 00:00:00'").groupBy("group_id").agg(F.count("*").alias("n"))


@query("a12_repeated", "SELECT accession, version, count(*) AS n FROM sequence_entries GROUP BY ALL HAVING count(*) > 1")
def a12(spark, root):
    return counts.repeated(table(spark, root, "sequence_entries"), "accession", "version")


@query("a13_facet", f"WITH {SUB} SELECT coalesce(region_name, '(blank)') AS value, count(*) AS n FROM s WHERE collection_date >= '2018' GROUP BY 1")
def a13(spark, root):
    conditions = {"region_name": F.col("region_name") == "Asia", "collection_date": F.col("collection_date") >= "2018"}
    return counts.facet(_s(spark, root), "region_name", conditions)


@query("a14_grouped", f"WITH {META} SELECT segment, ncbi_source_db, geo_loc_country IS NULL AS no_country, count(*) AS n FROM m GROUP BY ALL")
def a14(spark, root):
    return _m(spark, root).groupBy("segment", "ncbi_source_db", F.col("geo_loc_country").isNull().alias("no_country")).agg(F.count("*").alias("n"))


@query("a15_lineage_counts", f"WITH RECURSIVE {_TREE}, q AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1), c(node, ancestor) AS (SELECT id, id FROM (SELECT id FROM t UNION SELECT parent FROM t) UNION ALL SELECT c.node, t.parent FROM c JOIN t ON t.id = c.ancestor WHERE t.parent <> t.id) SELECT ancestor, CAST(sum(n) AS BIGINT) AS n FROM (SELECT DISTINCT node, ancestor FROM c) JOIN q ON q.id = node GROUP BY ancestor")
def a15(spark, root):
    tree = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).alias("parent"))
    n = table(spark, root, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return hierarchy.descendant_counts(tree, "id", "parent", n, "l_partkey", "n")


@query("a16_organism_statistics", f"WITH {REL}, w AS (SELECT *, max(CASE WHEN is_revocation THEN version END) OVER (PARTITION BY accession) AS revoked FROM r) SELECT organism, count(*) FILTER (version = 1) AS total, count(*) FILTER (version = 1 AND released_at >= TIMESTAMP '2024-01-01') - count(*) FILTER (version = 1 AND released_at >= TIMESTAMP '2024-01-01' AND revoked > version) AS recent FROM w GROUP BY organism")
def a16(spark, root):
    rows = entries.version_status(_r(spark, root))
    revoked = F.max(F.when(F.col("is_revocation"), F.col("version"))).over(Window.partitionBy("accession")) > F.col("version")
    first, late = F.col("version") == 1, F.col("released_at") >= F.lit("2024-01-01").cast("timestamp_ntz")
    return rows.withColumn("revoked", revoked).groupBy("organism").agg(F.count_if(first).alias("total"), (F.count_if(first & late) - F.count_if(first & late & F.col("revoked"))).alias("recent"))


@query("a17_merged_counts", "SELECT value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT geo_loc_country AS value, count(*) AS n FROM metadata_post_prepare GROUP BY 1 UNION ALL SELECT country, count(*) FROM submit_metadata GROUP BY 1) WHERE value IS NOT NULL GROUP BY value")
def a17(spark, root):
    parts = [table(spark, root, t).filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")) for t, c in (("metadata_post_prepare", "geo_loc_country"), ("submit_metadata", "country"))]
    return counts.merged_counts(parts, "value", "n")


@query("a18_group_counts", f"WITH {REL} SELECT group_id, organism, count(*) AS n FROM r GROUP BY ALL")
def a18(spark, root):
    return _r(spark, root).groupBy("group_id", "organism").agg(F.count("*").alias("n"))


@query("a21_best_hit", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_totalprice IS NOT NULL) WHERE k = 1")
def a21(spark, root):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("b")
    return table(spark, root, "orders").filter("o_totalprice is not null").groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("a22_sets", f"WITH {E} SELECT organism, array_to_string(list_sort(list(DISTINCT CAST(version AS VARCHAR))), ',') AS versions FROM e GROUP BY organism")
def a22(spark, root):
    return _e_rows(spark, root).groupBy("organism").agg(F.array_join(F.array_sort(F.collect_set(F.col("version").cast("string"))), ",").alias("versions"))


@query("a23_equivalence_groups", f"WITH {META}, c AS (SELECT id, segment, md5(concat_ws(chr(31), coalesce(geo_loc_country, chr(0)), coalesce(sample_collection_date, chr(0)), coalesce(authors, chr(0)))) AS k FROM m), b AS (SELECT k, max(n) AS most FROM (SELECT k, segment, count(*) AS n FROM c GROUP BY ALL) GROUP BY k) SELECT CASE WHEN most > 1 THEN id ELSE k END AS group_id, id FROM c JOIN b USING (k)".replace("chr(0)", "'~'"))
def a23(spark, root):
    m = _m(spark, root)
    cols = ["geo_loc_country", "sample_collection_date", "authors"]
    return counts.equivalence_groups(m.withColumns({c: F.coalesce(c, F.lit("~")) for c in cols}), cols, "segment", "id")


@query("a24_group_bounds", f"WITH {META} SELECT count(DISTINCT insdc_accession_base) AS groups, count(*) AS n, count(DISTINCT insdc_accession_base) <= count(*) AS within FROM m")
def a24(spark, root):
    g = F.count_distinct("insdc_accession_base")
    return _m(spark, root).agg(g.alias("groups"), F.count("*").alias("n"), (g <= F.count("*")).alias("within"))


@query("a25_agreement", f"WITH {E} SELECT accession, min(organism) AS organism, count(DISTINCT organism) = 1 AS agree FROM e GROUP BY accession")
def a25(spark, root):
    return _e_rows(spark, root).groupBy("accession").agg(F.min("organism").alias("organism"), (F.count_distinct("organism") == 1).alias("agree"))


@query("a26_names_pivot", "SELECT n_regionkey AS region, array_to_string(list_sort(list(n_name) FILTER (n_nationkey % 2 = 0)), '; ') AS even, array_to_string(list_sort(list(n_name) FILTER (n_nationkey % 2 = 1)), '; ') AS odd FROM nation GROUP BY n_regionkey")
def a26(spark, root):
    rows = table(spark, root, "nation").withColumn("cls", F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd"))
    names = F.array_join(F.array_sort(F.collect_list("n_name")), "; ")
    return rows.groupBy(F.col("n_regionkey").alias("region")).pivot("cls", ["even", "odd"]).agg(names).select("region", *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("even", "odd")))


@query("a28_highest_version", f"WITH {E} SELECT accession, max(version) AS version FROM e GROUP BY accession")
def a28(spark, root):
    return _e_rows(spark, root).groupBy("accession").agg(F.max("version").alias("version"))


@query("a30_newest_update", f"WITH {E}, {P} SELECT organism, strftime(max(greatest(submitted_at, coalesce(released_at, submitted_at))), '%Y-%m-%d') AS newest FROM e GROUP BY organism")
def a30(spark, root):
    return _e(spark, root).groupBy("organism").agg(_day(F.max(F.greatest("submitted_at", "released_at"))).alias("newest"))


# ------------------------------------------------------------------- windows


@query("w01_is_newest", f"WITH {E} SELECT accession, version, version = max(version) OVER (PARTITION BY accession) AS newest FROM e")
def w01(spark, root):
    return _e(spark, root).select("accession", "version", (F.max("version").over(Window.partitionBy("accession")) == F.col("version")).alias("newest"))


@query("w04_earliest_release", f"WITH {REL} SELECT accession, version, strftime(min(released_at) OVER (PARTITION BY accession ORDER BY version), '%Y-%m-%d') AS earliest FROM r")
def w04(spark, root):
    return entries.earliest_release(_r(spark, root)).select("accession", "version", _day("earliest_release").alias("earliest"))


@query("w05_cumulative", f"WITH {E}, d AS (SELECT organism, strftime(submitted_at, '%Y-%m-%d') AS day, count(*) AS n FROM e GROUP BY ALL) SELECT organism, day, CAST(sum(n) OVER (PARTITION BY organism ORDER BY day) AS BIGINT) AS total FROM d")
def w05(spark, root):
    days = _e(spark, root).groupBy("organism", _day("submitted_at").alias("day")).agg(F.count("*").alias("n"))
    return days.select("organism", "day", F.sum("n").over(Window.partitionBy("organism").orderBy("day")).alias("total"))


@query("w06_latest_with_fallback", f"WITH {E} SELECT accession, max(version) AS version, max_by(original_data, version) FILTER (NOT is_revocation) AS original_data, count(DISTINCT submitter) > 1 AS curated FROM e GROUP BY accession")
def w06(spark, root):
    data = F.max_by(F.when(~F.col("is_revocation"), F.col("original_data")), F.when(~F.col("is_revocation"), F.col("version")))
    return _e_rows(spark, root).groupBy("accession").agg(F.max("version").alias("version"), data.alias("original_data"), (F.count_distinct("submitter") > 1).alias("curated"))


@query("w07_ranges", "SELECT l_suppkey, min(p) AS first, max(p) AS last FROM (SELECT l_suppkey, p, p - row_number() OVER (PARTITION BY l_suppkey ORDER BY p) AS g FROM (SELECT DISTINCT l_suppkey, l_partkey AS p FROM lineitem)) GROUP BY l_suppkey, g")
def w07(spark, root):
    return sequences.runs(table(spark, root, "lineitem"), "l_suppkey", "l_partkey")


@query("w09_latest_unrevoked", f"WITH {E} SELECT accession, max(version) AS version, max_by(submission_id, version) AS submission_id FROM e WHERE NOT is_revocation GROUP BY accession")
def w09(spark, root):
    return _e_rows(spark, root).filter("not is_revocation").groupBy("accession").agg(F.max("version").alias("version"), F.max_by("submission_id", "version").alias("submission_id"))


@query("w12_deposition", f"WITH {REL} SELECT accession, max(version) AS version FROM r WHERE NOT is_revocation AND submitter <> 'insdc_ingest_user' GROUP BY accession")
def w12(spark, root):
    return _r(spark, root).filter("not is_revocation and submitter <> 'insdc_ingest_user'").groupBy("accession").agg(F.max("version").alias("version"))


# -------------------------------------------------------- order, limits, sets


@query("l01_release_order", f"WITH {REL} SELECT accession, version, row_number() OVER (ORDER BY accession, version) AS place FROM r")
def l01_whole(spark, root):
    return filters.placed(_r(spark, root).select("accession", "version"), "accession", "version")


@query("l02_page", f"WITH {REL} SELECT accession, version FROM r ORDER BY accession, version LIMIT 25 OFFSET 50")
def l02(spark, root):
    return filters.Page(None, ("accession", "version"), limit=25, offset=50).apply(_r(spark, root).select("accession", "version"))


@query("l04_page_by_column", f"WITH {REL} SELECT accession, version, organism FROM r ORDER BY organism DESC, accession, version LIMIT 100 OFFSET 100")
def l04(spark, root):
    return filters.Page("organism", ("accession", "version"), limit=100, offset=100, descending=True).apply(_r(spark, root).select("accession", "version", "organism"))


@query("l03_first_unprocessed", f"WITH {E}, {P} SELECT accession, version FROM e WHERE NOT is_revocation AND NOT EXISTS (SELECT 1 FROM p WHERE p.accession = e.accession AND p.version = e.version AND p.pipeline_version = 1) ORDER BY accession, version LIMIT 100")
def l03(spark, root):
    return entries.unprocessed(_e(spark, root), _p(spark, root), 1).select("accession", "version").orderBy("accession", "version").limit(100)


@query("u01_key_difference", f"WITH {SUB}, {E}, a AS (SELECT submission_id FROM s EXCEPT SELECT submission_id FROM e WHERE version = 1), b AS (SELECT submission_id FROM e WHERE version = 1 EXCEPT SELECT submission_id FROM s) SELECT 'only_first' AS side, count(*) AS n, coalesce((SELECT string_agg(submission_id, ', ' ORDER BY submission_id) FROM (SELECT * FROM a ORDER BY 1 LIMIT 10)), '') AS shown FROM a UNION ALL SELECT 'only_second', count(*), coalesce((SELECT string_agg(submission_id, ', ' ORDER BY submission_id) FROM (SELECT * FROM b ORDER BY 1 LIMIT 10)), '') FROM b")
def u01(spark, root):
    return changes.key_differences(_s(spark, root), _e(spark, root).filter("version = 1"), "submission_id")


@query("u02_union", "SELECT group_id FROM sequence_entries UNION SELECT group_id FROM documents UNION SELECT group_id FROM submit_metadata")
def u02(spark, root):
    parts = [table(spark, root, t).select("group_id") for t in ("sequence_entries", "documents", "submit_metadata")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("u04_unknown_keys", f"WITH {P} SELECT accession, version, pipeline_version, array_to_string(list_sort(list_filter(json_keys(processed_data), lambda k: k NOT IN ('metadata', 'files'))), ',') AS unknown FROM p WHERE json_valid(processed_data) AND processed_data LIKE '{{%'")
def u04(spark, root):
    rows = _p(spark, root).filter(F.try_parse_json("processed_data").isNotNull() & F.startswith("processed_data", F.lit("{")))
    unknown = V.unknown_keys(F.json_object_keys("processed_data"), ["metadata", "files"])
    return rows.select("accession", "version", "pipeline_version", F.array_join(unknown, ",").alias("unknown"))


@query("u05_array_difference", f"WITH {E}, k AS (SELECT organism, list(DISTINCT version) FILTER (is_revocation) AS a, list(DISTINCT version) FILTER (NOT is_revocation) AS b FROM e GROUP BY organism) SELECT organism, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS only_first FROM k")
def u05(spark, root):
    k = _e_rows(spark, root).groupBy("organism").agg(F.collect_set(F.when(~F.col("is_revocation"), F.col("version"))).alias("b"), F.collect_set(F.when(F.col("is_revocation"), F.col("version"))).alias("a"))
    return k.select("organism", F.array_join(F.transform(changes.set_difference("b", "a"), lambda x: x.cast("string")), ",").alias("only_first"))


@query(
    "u06_field_diff",
    f"WITH {E}, f AS (SELECT accession, version, unnest(['submitter', 'approver', 'organism', 'data']) AS field, unnest([submitter, approver, organism, original_data]) AS value FROM e), a AS (SELECT * FROM f WHERE version = 1), b AS (SELECT * FROM f WHERE version = 2) "
    "SELECT a.accession, a.field, CASE WHEN a.value IS NULL AND b.value IS NOT NULL THEN 'added' WHEN a.value IS NOT NULL AND b.value IS NULL THEN 'removed' WHEN a.value IS NOT DISTINCT FROM b.value THEN 'unchanged' ELSE 'changed' END AS change FROM a JOIN b USING (accession, field)",
)
def u06(spark, root):
    long = _e(spark, root).select("accession", "version", F.expr("stack(4, 'submitter', submitter, 'approver', approver, 'organism', organism, 'data', original_data) as (field, value)"))
    a, b = long.filter("version = 1"), long.filter("version = 2")
    both = b.select("accession").distinct()
    return changes.field_diff(a.join(both, "accession", "left_semi"), b.join(a.select("accession").distinct(), "accession", "left_semi"), "accession", "field", "value")


@query("u08_missing_taxa", "SELECT DISTINCT host_taxon_id AS taxon FROM metadata_post_prepare WHERE host_taxon_id IS NOT NULL AND host_taxon_id NOT IN (SELECT CAST(host_taxon_id AS VARCHAR) FROM ref_hosts WHERE host_taxon_id < 710200)")
def u08(spark, root):
    known = table(spark, root, "ref_hosts").filter("host_taxon_id < 710200").select(F.col("host_taxon_id").cast("string").alias("taxon"))
    return table(spark, root, "metadata_post_prepare").filter("host_taxon_id is not null").select(F.col("host_taxon_id").alias("taxon")).distinct().join(known, "taxon", "left_anti")


# ------------------------------------------------------------------ functions


@query("x01_identity", f"WITH {META} SELECT id, try_cast(CASE WHEN regexp_full_match(trim(host_taxon_id), '[+-]?[0-9]+') THEN trim(host_taxon_id) END AS BIGINT) AS as_int, CASE WHEN host_taxon_id <> '' THEN NOT regexp_full_match(trim(host_taxon_id), '[+-]?[0-9]+') ELSE false END AS failed FROM m")
def x01(spark, root):
    r = M.identity(F.col("host_taxon_id"), "int")
    return _m(spark, root).select("id", r.value.alias("as_int"), (F.size(r.errors) > 0).alias("failed"))


@query("x02_check_date", f"WITH {META}, d AS (SELECT id, sample_collection_date AS c, CASE WHEN regexp_full_match(sample_collection_date, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime(sample_collection_date, '%Y-%m-%d') END AS t FROM m) SELECT id, CASE WHEN t IS NOT NULL THEN c END AS value, coalesce(c <> '' AND t IS NULL, false) AS failed FROM d")
def x02(spark, root):
    r = M.check_date(F.col("sample_collection_date"), F.lit("2026-01-01").cast("date"))
    return _m(spark, root).select("id", r.value.alias("value"), (F.size(r.errors) > 0).alias("failed"))


_PAD = "CASE WHEN regexp_full_match(c, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN try_strptime(c, '%Y-%m-%d') WHEN regexp_full_match(c, '[0-9]{4}-[0-9]{1,2}') THEN try_strptime(c || '-01', '%Y-%m-%d') WHEN regexp_full_match(c, '[0-9]{4}') THEN try_strptime(c || '-01-01', '%Y-%m-%d') END"


@query("x03_past_date", f"WITH {META}, d AS (SELECT id, sample_collection_date AS c, ncbi_release_date AS r FROM m), t AS (SELECT *, {_PAD} AS v FROM d) SELECT id, strftime(v, '%Y-%m-%d') AS value, coalesce(c <> '' AND v IS NULL, false) AS unreadable, coalesce(v > r, false) AS late FROM t")
def x03(spark, root):
    r = M.past_date(F.col("sample_collection_date"), F.lit("2100-01-01").cast("date"), F.col("ncbi_release_date"))
    return _m(spark, root).select("id", r.value.alias("value"), F.array_contains(r.errors, "not_a_date").alias("unreadable"), F.array_contains(r.errors, "after_release").alias("late"))


_UP = "CASE WHEN regexp_full_match(c, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN try_strptime(c, '%Y-%m-%d')::DATE WHEN regexp_full_match(c, '[0-9]{4}-[0-9]{1,2}') THEN last_day(try_strptime(c || '-01', '%Y-%m-%d')::DATE) WHEN regexp_full_match(c, '[0-9]{4}') THEN try_strptime(c || '-12-31', '%Y-%m-%d')::DATE END"


@query(
    "x04_x05_date_range",
    f"WITH {SUB}, d AS (SELECT submission_id, CASE WHEN ascii(right(submission_id, 1)) % 3 = 0 THEN left(collection_date, 4) WHEN ascii(right(submission_id, 1)) % 3 = 1 THEN left(collection_date, 7) ELSE collection_date END AS c, submitted_at::DATE AS sub FROM s), t AS (SELECT submission_id, c, ({_PAD})::DATE AS lo, least({_UP}, sub) AS hi FROM d WHERE c <> '') "
    "SELECT submission_id, strftime(lo, '%Y-%m-%d') AS lower, strftime(hi, '%Y-%m-%d') AS upper, CASE WHEN lo = hi THEN strftime(lo, '%Y-%m-%d') WHEN day(lo) = 1 AND hi = last_day(hi) AND strftime(lo, '%Y-%m') = strftime(hi, '%Y-%m') THEN strftime(lo, '%Y-%m') WHEN strftime(lo, '%m-%d') = '01-01' AND strftime(hi, '%m-%d') = '12-31' AND year(lo) = year(hi) THEN strftime(lo, '%Y') "
    "WHEN strftime(lo, '%m-%d') = '01-01' AND strftime(hi, '%m-%d') = '12-31' THEN strftime(lo, '%Y') || '/' || strftime(hi, '%Y') WHEN day(lo) = 1 AND hi = last_day(hi) THEN strftime(lo, '%Y-%m') || '/' || strftime(hi, '%Y-%m') ELSE strftime(lo, '%Y-%m-%d') || '/' || strftime(hi, '%Y-%m-%d') END AS compact FROM t",
)
def x04(spark, root):
    k = F.ascii(F.right("submission_id", F.lit(1))) % 3
    c = F.when(k == 0, F.left("collection_date", F.lit(4))).when(k == 1, F.left("collection_date", F.lit(7))).otherwise(F.col("collection_date"))
    rows = _s(spark, root).select("submission_id", c.alias("c"), F.to_date("submitted_at").alias("submitted")).filter("c <> ''")
    rows = M.with_date_range(rows, "c", "submitted", low="low", high="high")
    low, high = F.col("low"), F.col("high")
    return rows.select("submission_id", _day(low).alias("lower"), _day(high).alias("upper"), M.compact_range(low, high).alias("compact"))


@query("x07_concatenate", f"WITH {META} SELECT id, replace(regexp_replace(concat_ws('/', CASE WHEN coalesce(geo_loc_country, '') = '' THEN 'unknown' ELSE trim(geo_loc_country, ' ') END, id, CASE WHEN coalesce(segment, '') = '' THEN 'unknown' ELSE trim(segment, ' ') END), '^/+|/+$', '', 'g'), ' ', '_') AS name FROM m")
def x07(spark, root):
    return _m(spark, root).select("id", M.concatenate([F.col("geo_loc_country"), F.col("id"), F.col("segment")], "unknown").value.alias("name"))


@query("x10_extract_regex", f"WITH {META} SELECT id, CASE WHEN regexp_matches(trim(sample_collection_date), '^([0-9]{{4}})-([0-9]{{2}})') THEN regexp_extract(trim(sample_collection_date), '^([0-9]{{4}})-([0-9]{{2}})', 2) END AS value FROM m")
def x10(spark, root):
    return _m(spark, root).select("id", M.extract_regex(F.col("sample_collection_date"), r"([0-9]{4})-([0-9]{2})", 2).value.alias("value"))


@query("x11_check_regex", f"WITH {META} SELECT id, CASE WHEN regexp_matches(trim(sample_collection_date), '^[0-9]{{4}}') THEN trim(sample_collection_date) END AS value FROM m")
def x11(spark, root):
    return _m(spark, root).select("id", M.check_regex(F.col("sample_collection_date"), "[0-9]{4}").value.alias("value"))


@query("x12_options", f"WITH {SUB}, o AS (SELECT unnest(['Africa', 'Asia', 'Americas']) AS opt) SELECT submission_id, coalesce(opt, CASE WHEN group_id = 1 THEN region_name END) AS value, region_name <> '' AND opt IS NULL AND group_id <> 1 AS failed FROM s LEFT JOIN o ON lower(trim(region_name)) = lower(opt) WHERE region_name IS NOT NULL")
def x12(spark, root):
    r = M.process_options(F.col("region_name"), ["Africa", "Asia", "Americas"], F.col("group_id") == 1)
    return _s(spark, root).filter("region_name is not null").select("submission_id", r.value.alias("value"), (F.size(r.errors) > 0).alias("failed"))


@query("x13_threshold", "SELECT event_id, value > 50 AS above FROM events")
def x13(spark, root):
    return table(spark, root, "events").select("event_id", M.is_above_threshold(F.col("value").cast("string"), 50).value.alias("above"))


@query("x14_variant", "SELECT p_partkey, p_size > p_retailprice * 0.02 AS variant FROM part")
def x14(spark, root):
    return table(spark, root, "part").select("p_partkey", M.is_variant(F.col("p_size"), F.col("p_retailprice"), 0.02).value.alias("variant"))


@query("x17_host_by_name", f"WITH {META} SELECT m.id, h.host_taxon_id AS taxon FROM m LEFT JOIN ref_hosts h ON lower(h.scientific_name) = lower(trim(m.host_name_scientific)) WHERE m.host_name_scientific IS NOT NULL")
def x17(spark, root):
    hosts = table(spark, root, "ref_hosts").select(F.lower("scientific_name").alias("k"), F.col("host_taxon_id").alias("taxon"))
    return _m(spark, root).filter("host_name_scientific is not null").select("id", F.lower(F.trim("host_name_scientific")).alias("k")).join(hosts, "k", "left").select("id", "taxon")


@query("x18_name_from_id", "SELECT DISTINCT m.id, h.scientific_name AS name, h.common_name AS common FROM metadata_post_prepare m JOIN ref_hosts h ON CAST(h.host_taxon_id AS VARCHAR) = trim(m.host_taxon_id)")
def x18(spark, root):
    hosts = table(spark, root, "ref_hosts").select(F.col("host_taxon_id").cast("string").alias("k"), F.col("scientific_name").alias("name"), F.col("common_name").alias("common"))
    return table(spark, root, "metadata_post_prepare").select("id", F.trim("host_taxon_id").alias("k")).distinct().join(hosts, "k").select("id", "name", "common")


@query("x20_x21_required", f"WITH {SUB} SELECT submission_id, coalesce(country, '') = '' AND group_id <> 1 AS country_missing, coalesce(host, '') = '' AND group_id <> 1 AS host_missing FROM s")
def x20(spark, root):
    spec = {"country": M.Field("identity", ("country",), ("string",), required=True), "host": M.Field("identity", ("host",), (None,), required=True)}
    rows = M.apply_spec(_s(spark, root), spec, exempt=F.col("group_id") == 1)
    has = lambda code: F.array_contains("errors", code)
    return rows.select("submission_id", has("country:required").alias("country_missing"), has("host:required").alias("host_missing"))


@query("x36_mask_gaps", "SELECT s, repeat('N', len(regexp_extract(s, '^-*'))) || regexp_replace(regexp_replace(s, '^-+', ''), '-+$', '') || repeat('N', CASE WHEN regexp_full_match(s, '-*') THEN 0 ELSE len(regexp_extract(s, '-*$')) END) AS masked FROM (SELECT DISTINCT repeat('-', CAST(p_size % 4 AS INT)) || p_brand || repeat('-', CAST(p_partkey % 3 AS INT)) AS s FROM part)")
def x36(spark, root):
    rows = table(spark, root, "part").select(F.concat(F.expr("repeat('-', p_size % 4)"), F.col("p_brand"), F.expr("repeat('-', cast(p_partkey % 3 as int))")).alias("s")).distinct()
    return rows.select("s", sequences.mask_terminal_gaps(F.col("s")).alias("masked"))


@query("x37_trim_n", f"WITH {P} SELECT accession, version, pipeline_version, regexp_replace(regexp_replace(json_extract_string(processed_data, '$.unalignedNucleotideSequences.main'), '^[Nn]+', ''), '[Nn]+$', '') AS trimmed FROM p WHERE json_valid(processed_data) AND processed_data LIKE '{{%'")
def x37(spark, root):
    rows = _p(spark, root).filter(F.try_parse_json("processed_data").isNotNull() & F.startswith("processed_data", F.lit("{")))
    return rows.select("accession", "version", "pipeline_version", F.regexp_replace(F.get_json_object("processed_data", "$.unalignedNucleotideSequences.main"), "^[Nn]+|[Nn]+$", "").alias("trimmed"))


@query("x51_md5", "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def x51(spark, root):
    return table(spark, root, "documents").filter("text is not null").select("doc_id", F.md5("text").alias("digest"))


@query("x53_subsample", "SELECT doc_id FROM documents WHERE CAST(('0x' || left(md5(CAST(doc_id AS VARCHAR)), 13)) AS BIGINT) / 4503599627370496.0 <= 0.1")
def x53(spark, root):
    return table(spark, root, "documents").filter(X.md5_fraction(F.col("doc_id").cast("string")) <= 0.1).select("doc_id")


@query("x54_compound_country", f"WITH {META} SELECT id, CASE WHEN contains(geo_loc_country, ':') THEN trim(split_part(geo_loc_country, ':', 1)) ELSE geo_loc_country END AS country, CASE WHEN contains(geo_loc_country, ':') THEN trim(substr(geo_loc_country, instr(geo_loc_country, ':') + 1)) END AS division FROM m WHERE geo_loc_country IS NOT NULL")
def x54(spark, root):
    country, division = X.split_compound(F.col("geo_loc_country"))
    return _m(spark, root).filter("geo_loc_country is not null").select("id", country.alias("country"), division.alias("division"))


@query("x55_host_fallback", f"WITH {META} SELECT id, coalesce(nullif(host_taxon_id, ''), nullif(host_name_scientific, '')) AS host FROM m")
def x55(spark, root):
    return _m(spark, root).select("id", F.coalesce(F.nullif("host_taxon_id", F.lit("")), F.nullif("host_name_scientific", F.lit(""))).alias("host"))


@query("x57_sorted_authors", f"WITH {META} SELECT id, array_to_string(list_sort(list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x, ' ')), lambda x: x <> '')), '; ') AS authors FROM m WHERE authors IS NOT NULL")
def x57(spark, root):
    return _m(spark, root).filter("authors is not null").select("id", X.sorted_authors(F.col("authors")).alias("authors"))


@query("x59_country_levels", f"WITH {META} SELECT id, concat_ws(', ', CASE WHEN trim(geo_loc_country, ' ') <> '' THEN geo_loc_country END, CASE WHEN trim(geo_loc_admin1, ' ') <> '' THEN geo_loc_admin1 END) AS place FROM m")
def x59(spark, root):
    return _m(spark, root).select("id", X.country_with_levels(F.col("geo_loc_country"), F.col("geo_loc_admin1")).alias("place"))


@query("x60_joint_key", f"WITH {META} SELECT biosample_accession, array_to_string(list(insdc_accession_base || '.' || segment ORDER BY segment, insdc_accession_base), '/') AS joint FROM m WHERE biosample_accession <> '' AND insdc_accession_base IS NOT NULL AND segment IS NOT NULL GROUP BY biosample_accession")
def x60(spark, root):
    rows = _m(spark, root).filter("biosample_accession <> '' and insdc_accession_base is not null and segment is not null")
    ordered = F.array_sort(F.collect_list(F.struct("segment", "insdc_accession_base")))
    return rows.groupBy("biosample_accession").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["insdc_accession_base"], F.lit("."), x["segment"])), "/").alias("joint"))


@query("x61_terms", f"WITH {REL}, t AS (SELECT *, CASE WHEN version > 1 THEN 'RESTRICTED' ELSE 'OPEN' END AS terms, (submitted_at::DATE + 365) AS until FROM r) SELECT accession, version, CASE WHEN terms = 'RESTRICTED' AND until > DATE '2024-06-01' THEN 'RESTRICTED' ELSE 'OPEN' END AS terms_now, CASE WHEN terms = 'RESTRICTED' AND until > DATE '2024-06-01' THEN NULL WHEN terms = 'RESTRICTED' THEN strftime(until, '%Y-%m-%d') ELSE strftime(submitted_at, '%Y-%m-%d') END AS open_since FROM t")
def x61(spark, root):
    rows = _r(spark, root).withColumns({"terms": F.when(F.col("version") > 1, "RESTRICTED").otherwise("OPEN"), "restricted_until": F.date_add(F.to_date("submitted_at"), 365), "change_date": F.col("submitted_at")})
    return entries.resolve_terms(rows, "2024-06-01").select("accession", "version", "terms_now", "open_since")


@query("x63_x64_released", f"WITH {REL} SELECT accession || '.' || version AS accession_version, organism, submitter, group_id, CAST(epoch(date_trunc('second', released_at)) AS BIGINT) AS released_seconds, strftime(submitted_at, '%Y-%m-%d') AS submitted_date, is_revocation FROM r")
def x63(spark, root):
    return _r(spark, root).select(
        F.concat_ws(".", "accession", F.col("version").cast("string")).alias("accession_version"), "organism", "submitter", "group_id",
        F.expr("unix_seconds(cast(released_at as timestamp))").alias("released_seconds"), _day("submitted_at").alias("submitted_date"), "is_revocation",
    )


@query("x65_version_key", f"WITH {E} SELECT DISTINCT accession || '.' || version AS av, accession AS base, version FROM e")
def x65(spark, root):
    av = _e(spark, root).select(F.concat_ws(".", "accession", F.col("version").cast("string")).alias("av"))
    return av.select("av", X.base(F.col("av")).alias("base"), X.version_of(F.col("av")).alias("version")).distinct()


@query("x67_prune", f"WITH RECURSIVE {_TREE}, keep AS (SELECT p_partkey AS id FROM part WHERE p_size > 25), c(node, ancestor, distance) AS (SELECT id, parent, 1 FROM t WHERE parent <> id UNION ALL SELECT c.node, t.parent, c.distance + 1 FROM c JOIN t ON t.id = c.ancestor WHERE t.parent <> t.id) SELECT k.id AS node, x.parent FROM keep k LEFT JOIN (SELECT node, arg_min(ancestor, distance) AS parent FROM c WHERE ancestor IN (SELECT id FROM keep) GROUP BY node) x ON x.node = k.id")
def x67(spark, root):
    part = table(spark, root, "part")
    tree = part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).alias("parent"))
    return hierarchy.prune(tree, "id", "parent", part.filter("p_size > 25").select("p_partkey"))


@query("x68_depth", f"WITH RECURSIVE {_TREE}, c(node, ancestor, distance) AS (SELECT id, id, 0 FROM t UNION ALL SELECT c.node, t.parent, c.distance + 1 FROM c JOIN t ON t.id = c.ancestor WHERE t.parent <> t.id) SELECT node, CAST(max(distance) AS BIGINT) AS depth FROM c GROUP BY node")
def x68(spark, root):
    tree = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).alias("parent"))
    return hierarchy.closure(tree, "id", "parent").groupBy("node").agg(F.max("distance").alias("depth")).join(tree.select(F.col("id").alias("node")), "node", "left_semi")


# ---------------------------------------------------------------- validation


@query("v02_required", f"WITH {SUB} SELECT submission_id, array_to_string(list_filter([CASE WHEN country IS NULL THEN 'country' END, CASE WHEN division IS NULL THEN 'division' END, CASE WHEN host IS NULL THEN 'host' END], lambda x: x IS NOT NULL), ',') AS missing FROM s")
def v02(spark, root):
    missing = V.missing_required({c: F.col(c) for c in ("country", "division", "host")})
    return _s(spark, root).select("submission_id", F.array_join(missing, ",").alias("missing"))


@query("v04_date_format", f"WITH {META} SELECT id, sample_collection_date IS NULL OR (regexp_full_match(sample_collection_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime(sample_collection_date, '%Y-%m-%d') IS NOT NULL) AS valid FROM m")
def v04(spark, root):
    return _m(spark, root).select("id", F.coalesce(V.valid_date(F.col("sample_collection_date")), F.lit(False)).alias("valid"))


@query("v05_length", f"WITH {E} SELECT accession, version, submission_id IS NOT NULL AND len(submission_id) <> 8 AS wrong FROM e")
def v05(spark, root):
    return _e(spark, root).select("accession", "version", V.wrong_length(F.col("submission_id"), 8).alias("wrong"))


@query("v07_key_sets", f"WITH {P}, k AS (SELECT accession, version, pipeline_version, json_keys(processed_data, '$.unalignedNucleotideSequences') AS a, json_keys(processed_data, '$.sequenceNameToFastaId') AS b FROM p WHERE json_valid(processed_data) AND processed_data LIKE '{{%') SELECT accession, version, pipeline_version, array_to_string(list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))), ',') AS differ FROM k WHERE a IS NOT NULL AND b IS NOT NULL")
def v07(spark, root):
    rows = _p(spark, root).filter(F.try_parse_json("processed_data").isNotNull() & F.startswith("processed_data", F.lit("{")))
    keys = lambda n: F.json_object_keys(F.get_json_object("processed_data", f"$.{n}"))
    rows = rows.withColumns({"a": keys("unalignedNucleotideSequences"), "b": keys("sequenceNameToFastaId")}).filter("a is not null and b is not null")
    return rows.select("accession", "version", "pipeline_version", F.array_join(V.key_sets_differ(F.col("a"), F.col("b")), ",").alias("differ"))


@query("v08_invalid_symbols", f"WITH {E} SELECT DISTINCT submission_id, regexp_replace(upper(submission_id), '[ACGTMRWSYKVHDBN]', '', 'g') <> '' AS invalid FROM e")
def v08(spark, root):
    bad = sequences.invalid_symbols(F.upper("submission_id"), V.NUCLEOTIDES)
    return _e(spark, root).select("submission_id", (F.size(bad) > 0).alias("invalid")).distinct()


@query("v12_preconditions", f"WITH {VIEW}, w AS (SELECT DISTINCT accession, version + 1 AS version FROM e WHERE organism = 'cchf') SELECT w.accession, w.version, CASE WHEN v.accession IS NULL THEN 'missing' WHEN v.organism <> 'cchf' THEN 'other_organism' WHEN v.status <> 'PROCESSED' THEN 'wrong_state' END AS error FROM w LEFT JOIN v ON v.accession = w.accession AND v.version = w.version WHERE v.accession IS NULL OR v.organism <> 'cchf' OR v.status <> 'PROCESSED'")
def v12(spark, root):
    wanted = _e(spark, root).filter("organism = 'cchf'").select("accession", (F.col("version") + 1).alias("version"))
    return V.precondition_errors(wanted, _v(spark, root), ["accession", "version"], ["PROCESSED"], "cchf")


@query("v13_terms_change", f"WITH {E}, t AS (SELECT accession, version, CASE WHEN group_id % 2 = 0 THEN 'OPEN' ELSE 'RESTRICTED' END AS ok, CASE WHEN version > 1 THEN 'OPEN' ELSE 'RESTRICTED' END AS nk, submitted_at::DATE + 100 AS ou, submitted_at::DATE + 200 AS nu FROM e) SELECT accession, version, CASE WHEN ok = 'OPEN' AND nk = 'RESTRICTED' THEN 'already_open' WHEN nk = 'RESTRICTED' AND (nu < DATE '2023-01-01' OR nu > DATE '2024-01-01') THEN 'date_out_of_range' WHEN ok = 'RESTRICTED' AND nk = 'RESTRICTED' AND nu > ou THEN 'extension' END AS error FROM t")
def v13(spark, root):
    kind = lambda c: F.when(c, "OPEN").otherwise("RESTRICTED")
    day = F.to_date("submitted_at")
    error = V.terms_change_error(kind(F.col("group_id") % 2 == 0), F.date_add(day, 100), kind(F.col("version") > 1), F.date_add(day, 200), F.lit("2023-01-01").cast("date"))
    return _e(spark, root).select("accession", "version", error.alias("error"))


@query("v15_version_parse", f"WITH {META} SELECT DISTINCT insdc_accession_base || '.' || insdc_version AS av, CASE WHEN regexp_full_match(insdc_accession_base || '.' || insdc_version, '[^.]+\\.[1-9][0-9]*') THEN CAST(insdc_version AS BIGINT) END AS version FROM m WHERE insdc_accession_base IS NOT NULL AND insdc_version IS NOT NULL")
def v15(spark, root):
    av = F.concat("insdc_accession_base", F.lit("."), F.col("insdc_version").cast("string"))
    return _m(spark, root).filter("insdc_accession_base is not null and insdc_version is not null").select(av.alias("av"), X.version_of(av).alias("version")).distinct()


# ----------------------------------------------------------- sequence queries

@query("q06_private_mutations", "SELECT DISTINCT accession, version, k AS cds, CAST(json_extract_string(s, '$.pos') AS BIGINT) AS pos FROM (SELECT accession, version, k, unnest(from_json(json_extract(mutations, '$.\"' || k || '\".privateSubstitutions'), '[\"JSON\"]')) AS s FROM (SELECT *, unnest(json_keys(mutations)) AS k FROM mutations_from_founder_clade WHERE json_valid(mutations) AND mutations LIKE '{%') WHERE json_type(mutations, '$.\"' || k || '\".privateSubstitutions') = 'ARRAY') WHERE json_type(s) = 'OBJECT'")
def q06p(spark, root):
    rows = table(spark, root, "mutations_from_founder_clade").filter(F.try_parse_json("mutations").isNotNull() & F.startswith("mutations", F.lit("{"))).select("accession", "version", "mutations").distinct()
    by_cds = rows.select("accession", "version", F.explode(F.from_json("mutations", "map<string,struct<privateSubstitutions:string>>")).alias("cds", "x"))
    subs = by_cds.filter(F.startswith("x.privateSubstitutions", F.lit("["))).select("accession", "version", "cds", F.explode(F.from_json("x.privateSubstitutions", "array<struct<pos:string>>")).alias("s"))
    return subs.filter("s is not null").select("accession", "version", "cds", F.col("s.pos").cast("bigint").alias("pos")).distinct()


@query("q08_fasta_headers", f"WITH {REL} SELECT accession || '.' || version || '|' || organism || '|' || strftime(released_at, '%Y-%m-%d') AS header, upper(submission_id) AS sequence FROM r")
def q08(spark, root):
    return _r(spark, root).select(F.concat_ws("|", F.concat_ws(".", "accession", F.col("version").cast("string")), "organism", _day("released_at")).alias("header"), F.upper("submission_id").alias("sequence"))


@query("q12_open_only", f"WITH {REL} SELECT accession, version FROM r WHERE NOT (version > 1 AND submitted_at::DATE + 365 > DATE '2024-06-01')")
def q12(spark, root):
    rows = _r(spark, root).withColumns({"terms": F.when(F.col("version") > 1, "RESTRICTED").otherwise("OPEN"), "restricted_until": F.date_add(F.to_date("submitted_at"), 365), "change_date": F.col("submitted_at")})
    return entries.resolve_terms(rows, "2024-06-01").filter("terms_now = 'OPEN'").select("accession", "version")


# ------------------------------------------------------- state and bookkeeping


@query("t03_reset_stale", f"WITH {P} SELECT accession, version, pipeline_version FROM p WHERE NOT (processing_status = 'IN_PROCESSING' AND started_processing_at < TIMESTAMP '2024-01-01')")
def t03(spark, root):
    stale = (F.col("processing_status") == "IN_PROCESSING") & (F.col("started_processing_at") < F.lit("2024-01-01").cast("timestamp_ntz"))
    return _p(spark, root).filter(~stale).select("accession", "version", "pipeline_version")


@query("t05_approve", f"WITH {VIEW} SELECT accession, version, 'admin' AS approver FROM v WHERE status = 'PROCESSED' AND coalesce(processing_result, 'NO_ISSUES') <> 'HAS_ERRORS' AND group_id IN (1, 2, 3)")
def t05(spark, root):
    return entries.approve(_v(spark, root), approver="admin", at="2025-01-01 00:00:00", groups=[1, 2, 3]).select("accession", "version", "approver")


@query("t06_revoke", f"WITH {REL}, n AS (SELECT accession, max(version) + 1 AS version FROM e GROUP BY accession) SELECT DISTINCT n.accession, n.version, 'withdrawn' AS comment FROM n JOIN r ON r.accession = n.accession WHERE r.organism = 'rvf'")
def t06(spark, root):
    out = entries.revoke(_e(spark, root), _r(spark, root).filter("organism = 'rvf'"), "admin", "2025-01-01 00:00:00", "withdrawn")
    return out.select("accession", "version", F.get_json_object("original_data", "$.comment").alias("comment"))


@query("t07_delete", f"WITH {VIEW} SELECT e.accession, e.version FROM e WHERE (e.accession, e.version) NOT IN (SELECT accession, version FROM v WHERE status = 'PROCESSED' AND processing_result = 'HAS_WARNINGS')")
def t07(spark, root):
    gone = _v(spark, root).filter("status = 'PROCESSED' and processing_result = 'HAS_WARNINGS'").select("accession", "version")
    return _e(spark, root).join(gone, ["accession", "version"], "left_anti").select("accession", "version")


@query("t13_upsert", f"WITH {E}, o AS (SELECT accession, max(version) AS version, max_by(submission_id, version) AS submission_id FROM e WHERE released_at IS NOT NULL GROUP BY accession), n AS (SELECT accession, max(version) AS version, max_by(submission_id, version) AS submission_id FROM e WHERE released_at IS NULL GROUP BY accession) SELECT * FROM n UNION ALL SELECT * FROM o WHERE accession NOT IN (SELECT accession FROM n)")
def t13_whole(spark, root):
    def newest(rows):
        return rows.groupBy("accession").agg(F.max("version").alias("version"), F.max_by("submission_id", "version").alias("submission_id"))

    e = _e(spark, root).select("accession", "version", "submission_id", "released_at")
    return entries.upsert(newest(e.filter("released_at is not null")), newest(e.filter("released_at is null")), ["accession"])


@query("r03_release_times", f"WITH {REL}, d AS (SELECT DISTINCT accession FROM documents WHERE accession IS NOT NULL) SELECT r.accession, r.version, strftime(r.released_at, '%Y-%m-%d') AS released FROM r WHERE r.accession IN (SELECT accession FROM d)")
def r03(spark, root):
    wanted = table(spark, root, "documents").filter("accession is not null").select("accession")
    return filters.keys_in(_r(spark, root), wanted, ["accession"]).select("accession", "version", _day("released_at").alias("released"))


@query("r04_group_mismatch", f"WITH {E} SELECT DISTINCT d.doc_id FROM documents d JOIN e ON e.accession = d.accession WHERE e.group_id <> d.group_id")
def r04(spark, root):
    groups = _e(spark, root).select("accession", F.col("group_id").alias("entry_group")).distinct()
    return table(spark, root, "documents").join(groups, "accession").filter("entry_group <> group_id").select("doc_id").distinct()


@query("r07_routing", f"WITH {E}, {SUB}, k AS (SELECT submission_id, max(version) AS newest, min(accession) AS accession FROM e GROUP BY submission_id) SELECT s.submission_id, CASE WHEN k.submission_id IS NULL THEN 'submit' WHEN k.newest > 1 THEN 'revise' ELSE 'unchanged' END AS bucket, k.accession FROM s LEFT JOIN k USING (submission_id)")
def r07(spark, root):
    known = _e(spark, root).groupBy("submission_id").agg(F.max("version").alias("newest"), F.min("accession").alias("accession"))
    bucket = F.when(F.col("newest").isNull(), "submit").when(F.col("newest") > 1, "revise").otherwise("unchanged")
    return _s(spark, root).join(known, "submission_id", "left").select("submission_id", bucket.alias("bucket"), "accession")


@query("r08_fallback_fields", f"WITH {META} SELECT id, coalesce(nullif(specimen_collector_sample_id, ''), nullif(biosample_accession, ''), id) AS name FROM m")
def r08(spark, root):
    return _m(spark, root).select("id", F.coalesce(F.nullif("specimen_collector_sample_id", F.lit("")), F.nullif("biosample_accession", F.lit("")), "id").alias("name"))


@query("r12_set_records", f"WITH {REL} SELECT d.doc_id, r.accession, max(r.version) AS version FROM documents d JOIN r ON r.accession = d.accession GROUP BY d.doc_id, r.accession")
def r12(spark, root):
    newest = _r(spark, root).groupBy("accession").agg(F.max("version").alias("version"))
    return table(spark, root, "documents").select("doc_id", "accession").join(newest, "accession").select("doc_id", "accession", "version")


@query("r14_groups_by_name", f"WITH {GRP} SELECT group_id, group_name FROM g WHERE lower(group_name) LIKE 'a%' OR lower(group_name) LIKE 'm%'")
def r14(spark, root):
    return _g(spark, root).filter(F.lower("group_name").startswith("a") | F.lower("group_name").startswith("m")).select("group_id", "group_name")


@query("r16_default_pipeline", f"WITH {E}, {P}, c AS (SELECT organism, max(pipeline_version) AS current FROM e JOIN p USING (accession, version) WHERE organism <> 'rvf' GROUP BY organism) SELECT organism, coalesce(current, 1) AS current FROM (SELECT DISTINCT organism FROM e) LEFT JOIN c USING (organism)")
def r16(spark, root):
    e = _e(spark, root)
    return entries.with_default_pipeline(e, entries.current_pipelines(e.filter("organism <> 'rvf'"), _p(spark, root)))


# ------------------------------------------------ no SQL: tested on small cases


@query("x08_authors")
def x08(spark, root):
    return _m(spark, root).select("id", X.check_authors(F.col("authors")).alias("r")).select("id", "r.value", "r.error", F.array_join("r.warnings", ",").alias("warnings"))


_LUHN = "0123456789ABCDEFGHJKLMNPQRSTUVWXYZ"
_STEP = "CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END * ((p_partkey // CAST(pow(34, i) AS BIGINT)) % 34)"


@query(
    "x50_accessions",
    f"WITH t AS (SELECT p_partkey, list_sum([v // 34 + v % 34 for v in [{_STEP} for i in range(0, 6)]]) AS total FROM part) "
    f"SELECT p_partkey, 'LOC_' || array_to_string([substr('{_LUHN}', CAST(1 + (p_partkey // CAST(pow(34, i) AS BIGINT)) % 34 AS BIGINT), 1) for i in [5, 4, 3, 2, 1, 0]], '') || substr('{_LUHN}', CAST(1 + (34 - total % 34) % 34 AS BIGINT), 1) AS accession FROM t",
)
def x50(spark, root):
    return table(spark, root, "part").select("p_partkey", X.accession_column(F.col("p_partkey"), "LOC_").alias("accession"))


QUERIES, SQL = query.queries, query.sql
