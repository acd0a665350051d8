"""Specifications, preconditions, regrouping and written tables: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions import specification as S
from helixmill.functions import text as X
from helixmill.functions import validation as V
from helixmill.functions.payloads import elements, members
from helixmill.operators import changes, counts, entries, filters, hierarchy, state
from helixmill.plans.aligned_queries import OBJ, _payloads
from helixmill.plans.reference_queries import _PAD, GRP, META, REL, SUB, VIEW, E, _e, _e_rows, _g, _m, _r, _s, _v
from helixmill.registry import Registry
from helixmill.session import scratch_folder, table
from helixmill.sources import readers, writers
from helixmill.streaming import poll

query = Registry()

KEY3 = ("accession", "version", "pipeline_version")
_SHOW = "regexp_replace(replace({}, ' ', '_'), '^/+|/+$', '', 'g')"
_DATE = f"coalesce(strftime({_PAD}, '%Y-%m-%d'), 'unknown')"

# ----------------------------------------------------------- specifications


@query(
    "x07_typed_concatenation",
    f"WITH {META}, d AS (SELECT *, sample_collection_date AS c FROM m) SELECT id, {_SHOW.format(f'''concat_ws('/', 'own', coalesce(nullif(trim(geo_loc_country, ' '), ''), 'unknown'), id, {_DATE}, coalesce(nullif(trim(replace(geo_loc_admin1, '/', ' TO '), ' '), ''), 'unknown'), strftime(ncbi_release_date, '%Y-%m-%d'))''')} AS name, coalesce(len(geo_loc_admin1) - len(replace(geo_loc_admin1, '/', '')) > 1, false) AS failed FROM d",
)
def x07(spark, root):
    country = F.when(F.trim("geo_loc_country") != "", F.col("geo_loc_country"))
    region = F.when(F.trim("geo_loc_admin1") != "", F.col("geo_loc_admin1"))
    parts = [S.Part("ARG", "own"), S.Part("string", country), S.Part("ACCESSION_VERSION"), S.Part("date", F.col("sample_collection_date")), S.Part("dateRangeString", region), S.Part("timestamp", F.col("ncbi_release_date").cast("string"))]
    r = S.joined(parts, F.col("id"), fallback="unknown")
    return _m(spark, root).select("id", r.value.alias("name"), (F.size(r.errors) > 0).alias("failed"))


_OWN = "CASE WHEN trim({0}, ' ') <> '' THEN CASE WHEN NOT regexp_matches({0}, '[\\s/]') THEN {0} WHEN ncbi_source_db <> 'RefSeq' THEN nullif(regexp_extract(trim({0}, ' '), '^(?:[^/]+/([^/ ]+)/)', 1), '') END END"


@query(
    "x16_display_name",
    f"WITH {META}, d AS (SELECT *, sample_collection_date AS c, CASE WHEN insdc_version = 1 THEN specimen_collector_sample_id WHEN insdc_version = 2 THEN geo_loc_country || '/' || segment || '/x' ELSE author_affiliations END AS own, CASE WHEN insdc_version = 3 THEN biosample_accession END AS sub FROM m), "
    f"k AS (SELECT *, coalesce({_OWN.format('own')}, CASE WHEN ncbi_source_db <> 'RefSeq' THEN {_OWN.format('sub')} END) AS found FROM d) SELECT id, {_SHOW.format(f'''concat_ws('/', coalesce(nullif(segment, ''), 'unknown'), coalesce(trim(found, ' '), id), {_DATE})''')} AS name, found IS NULL AND ncbi_source_db <> 'RefSeq' AS warned FROM k",
)
def x16(spark, root):
    v = F.col("insdc_version")
    own = F.when(v == 1, F.col("specimen_collector_sample_id")).when(v == 2, F.concat("geo_loc_country", F.lit("/"), "segment", F.lit("/x"))).otherwise(F.col("author_affiliations"))
    ingested = F.col("ncbi_source_db") == "RefSeq"
    parts = [S.Part("string", F.col("segment")), S.Part("IDENTIFIER"), S.Part("date", F.col("sample_collection_date"))]
    r = S.display_name(parts, F.col("id"), own, F.when(v == 3, F.col("biosample_accession")), ingested, pattern=r"[^/]+/([^/ ]+)/")
    return _m(spark, root).select("id", r.value.alias("name"), (F.size(r.warnings) > 0).alias("warned"))


@query(
    "x15_lineage_from_references",
    "WITH d AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'H3' ELSE 'H1' END AS ha, CASE WHEN c_nationkey % 3 = 0 THEN 'N2' ELSE 'N1' END AS na, CASE WHEN c_nationkey % 3 = 1 THEN 'H1N1PDM' ELSE 'SEA' END AS a, CASE WHEN c_custkey % 2 = 0 THEN 'OLD' END AS b, c_acctbal > 5000 AS changed FROM customer) "
    "SELECT c_custkey, CASE WHEN a = 'H1N1PDM' THEN 'H1N1pdm' ELSE ha || na END || CASE WHEN b IS NOT NULL THEN ' reassortant' ELSE '' END || CASE WHEN changed THEN ' (variant)' ELSE '' END AS lineage FROM d",
)
def x15r(spark, root):
    ref = F.when(F.col("c_nationkey") % 3 == 1, "seg-h1n1pdm").otherwise("seg-sea")
    refs = [ref, F.when(F.col("c_custkey") % 2 == 0, "seg-old").otherwise("no reference"), *[ref] * 6]
    third = F.col("c_nationkey") % 3 == 0
    r = S.lineage_from_references(F.when(third, "H3").otherwise("H1"), F.when(third, "N2").otherwise("N1"), refs, [F.col("c_acctbal") > 5000], r"[^-]+-([^-]+)$")
    return table(spark, root, "customer").select("c_custkey", r.value.alias("lineage"))


_TREE = "t AS (SELECT p_partkey AS id, p_partkey // 10 AS parent FROM part), c(node, ancestor, d) AS (SELECT id, id, 0 FROM t UNION ALL SELECT c.node, t.parent, c.d + 1 FROM c JOIN t ON t.id = c.ancestor WHERE t.parent <> t.id), depth AS (SELECT node AS id, max(d) AS depth FROM c GROUP BY node), n AS (SELECT p_partkey AS taxon_id, p_brand AS name, depth FROM part JOIN depth ON id = p_partkey)"
_ASKED = "a AS (SELECT DISTINCT q, direct FROM (SELECT ' ' || lower(p_brand) || ' ' AS q, true AS direct FROM part UNION ALL SELECT '00' || p_partkey, true FROM part UNION ALL SELECT p_type, p_size > 25 FROM part))"


@query("x17_resolve_host", f"WITH RECURSIVE {_TREE}, {_ASKED}, b AS (SELECT lower(name) AS name, arg_min(taxon_id, (depth, taxon_id)) AS taxon_id FROM n GROUP BY 1) SELECT q, direct, coalesce(i.taxon_id, b.taxon_id) AS taxon_id, coalesce(i.taxon_id, b.taxon_id) IS NULL AND direct AS failed, coalesce(i.taxon_id, b.taxon_id) IS NULL AND NOT direct AS warned FROM a LEFT JOIN n i ON regexp_full_match(q, '[0-9]+') AND i.taxon_id = TRY_CAST(q AS BIGINT) LEFT JOIN b ON b.name = lower(trim(q, ' '))")
def x17r(spark, root):
    part = table(spark, root, "part")
    tree = part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).alias("parent"))
    depth = hierarchy.closure(tree, "id", "parent").groupBy("node").agg(F.max("distance").alias("depth"))
    names = part.select(F.col("p_partkey").alias("taxon_id"), F.col("p_brand").alias("name")).join(depth, F.col("taxon_id") == F.col("node")).select("taxon_id", "name", "depth")
    asked = part.select(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")).alias("q"), F.lit(True).alias("direct")).unionAll(part.select(F.concat(F.lit("00"), F.col("p_partkey").cast("string")), F.lit(True))).unionAll(part.select("p_type", F.col("p_size") > 25)).distinct()
    got = S.resolve_host(asked.withColumn("ingested", ~F.col("direct")), "q", names, ingested="ingested")
    return got.select("q", "direct", "taxon_id", F.col("host_error").alias("failed"), F.col("host_warning").alias("warned"))


_EMPTY = "coalesce({}, '') = ''"


@query(
    "x20_conditional_requirements",
    f"WITH {SUB} SELECT submission_id, array_to_string(list_filter([CASE WHEN {_EMPTY.format('country')} THEN 'country:required' END, CASE WHEN {_EMPTY.format('division')} AND coalesce(country, '') <> '' THEN 'division:processed.country' END, CASE WHEN {_EMPTY.format('host')} AND coalesce(region_name, '') <> '' THEN 'host:region_name' END, CASE WHEN {_EMPTY.format('host')} AND group_id % 2 = 0 THEN 'host:files.rawReads' END], lambda x: x IS NOT NULL AND group_id <> 1), ',') AS missing FROM s",
)
def x20r(spark, root):
    needs = {"country": S.Needs(required=True), "division": S.Needs(when=("processed.country",)), "host": S.Needs(when=("region_name", "files.rawReads"))}
    values = {c: F.col(c) for c in ("country", "division", "host")}
    missing = S.missing_requirements(needs, values, {"region_name": F.col("region_name")}, {"rawReads": F.when(F.col("group_id") % 2 == 0, 1).otherwise(0)}, F.col("group_id") == 1)
    return _s(spark, root).select("submission_id", F.array_join(missing, ",").alias("missing"))


@query("x23_specification_errors", "SELECT * FROM (VALUES ('', 'cycle'), ('a', 'required_and_conditional'), ('b', 'requires_itself'), ('c', 'unknown_category'), ('d', 'unknown_field')) t(field, error)")
def x23(spark, root):
    needs = {"a": S.Needs(True, ("x",)), "b": S.Needs(when=("processed.b",)), "c": S.Needs(when=("files.photos", "files.rawReads")), "d": S.Needs(when=("processed.none",)), "e": S.Needs(True)}
    errors = S.specification_errors(needs, {"a": ["x"], "b": ["processed.c"], "c": ["processed.b"], "d": ["x"], "e": ["y"]}, ["rawReads"])
    return spark.createDataFrame(errors, "field string, error string")


# --------------------------------------------------------------- validation


_KEYS_OF = "list_filter(coalesce(json_keys(d, '$.{0}'), []), lambda k: json_extract_string(d, '$.{0}.\"' || k || '\"') IS NOT NULL)"


@query(
    "v10_alignment_any_all",
    f"WITH {OBJ}, k AS (SELECT *, {_KEYS_OF.format('unalignedNucleotideSequences')} AS given, {_KEYS_OF.format('alignedNucleotideSequences')} AS aligned FROM ok), l AS (SELECT *, list_sort(list_filter(given, lambda x: NOT list_contains(aligned, x))) AS lost, len(given) > 0 AND len(list_filter(given, lambda x: list_contains(aligned, x))) = 0 AS none FROM k) "
    "SELECT accession, version, pipeline_version, array_to_string(lost, ',') AS all_errors, CASE WHEN none THEN '*' ELSE '' END AS any_errors, array_to_string(lost, ',') AS any_warnings FROM l",
)
def v10r(spark, root):
    given, aligned = (F.map_keys(F.map_filter(F.coalesce(members(F.col("d"), f"{k}NucleotideSequences"), F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())) for k in ("unaligned", "aligned"))
    rows = _payloads(spark, root).select(*KEY3, given.alias("given"), aligned.alias("aligned"))
    whole, _ = V.alignment_annotations(F.col("given"), F.col("aligned"), any_is_enough=False)
    errors, warnings = V.alignment_annotations(F.col("given"), F.col("aligned"), any_is_enough=True)
    return rows.select(*KEY3, F.array_join(whole, ",").alias("all_errors"), F.array_join(errors, ",").alias("any_errors"), F.array_join(warnings, ",").alias("any_warnings"))


@query(
    "v11_segment_assignment",
    "WITH i AS (SELECT DISTINCT sample_id, fasta_ids, list_filter(regexp_split_to_array(trim(fasta_ids), '\\s+'), lambda x: x <> '') AS ids FROM cchfv_test_metadata WHERE fasta_ids IS NOT NULL), "
    "g AS (SELECT sample_id, ids, [s for s in ['L', 'M', 'S'] if len(list_filter(ids, lambda x: lower(regexp_extract(x, '[^_]*$')) = lower(s))) = 1] AS one, [s for s in ['L', 'M', 'S'] if len(list_filter(ids, lambda x: lower(regexp_extract(x, '[^_]*$')) = lower(s))) > 1] AS many, list_sort(list_filter(ids, lambda x: lower(regexp_extract(x, '[^_]*$')) NOT IN ('l', 'm', 's'))) AS rest FROM i) "
    "SELECT sample_id, array_to_string(one, ',') AS assigned, array_to_string(many, ',') AS duplicates, array_to_string(rest, '|') AS leftovers, len(one) = 0 AND len(many) = 0 AS nothing FROM g",
)
def v11r(spark, root):
    rows = table(spark, root, "cchfv_test_metadata").filter("fasta_ids is not null").select("sample_id", "fasta_ids").distinct()
    rows = rows.select("sample_id", V.assign_segments(readers.fasta_ids(F.col("fasta_ids")), ["L", "M", "S"]).alias("a"))
    return rows.select("sample_id", F.array_join(F.map_keys("a.assigned"), ",").alias("assigned"), F.array_join("a.duplicates", ",").alias("duplicates"), F.array_join("a.leftovers", "|").alias("leftovers"), "a.nothing")


@query(
    "v12_precondition_report",
    f"WITH {VIEW}, w AS (SELECT DISTINCT accession, version FROM sequence_entries UNION SELECT 'none' || doc_id, 1 FROM documents WHERE lang = 'ru'), j AS (SELECT w.accession, w.version, v.accession IS NOT NULL AS there, organism, status, processing_result, group_id FROM w LEFT JOIN v ON v.accession = w.accession AND v.version = w.version), "
    "x AS (SELECT accession, version, 'missing' AS error FROM j WHERE NOT there UNION ALL SELECT accession, version, 'other_organism' FROM j WHERE organism <> 'cchf' UNION ALL SELECT accession, version, 'wrong_state' FROM j WHERE status <> 'PROCESSED' UNION ALL SELECT accession, version, 'has_errors' FROM j WHERE processing_result = 'HAS_ERRORS' UNION ALL SELECT accession, version, 'no_permission' FROM j WHERE group_id NOT IN (1, 2, 3)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY error ORDER BY accession, version) AS k FROM x) SELECT error, count(*) AS n, string_agg(accession || '.' || version, ', ' ORDER BY accession, version) FILTER (k <= 10) AS shown FROM r GROUP BY error",
)
def v12r(spark, root):
    wanted = _e_rows(spark, root).select("accession", "version").unionByName(table(spark, root, "documents").filter("lang = 'ru'").select(F.concat(F.lit("none"), F.col("doc_id").cast("string")).alias("accession"), F.lit(1).cast("bigint").alias("version")))
    return V.precondition_report(wanted, _v(spark, root), ["accession", "version"], organism="cchf", statuses=["PROCESSED"], groups=[1, 2, 3])


_FILES = (
    f"{OBJ}, v AS (SELECT accession, version, pipeline_version, category, json_extract(d, '$.files.\"' || category || '\"') AS v FROM (SELECT *, unnest(json_keys(d, '$.files')) AS category FROM ok)), "
    "w AS (SELECT * EXCLUDE (v), unnest(CASE json_type(v) WHEN 'ARRAY' THEN from_json(v, '[\"JSON\"]') WHEN 'NULL' THEN [] ELSE [v] END) AS e FROM v), "
    "f AS (SELECT accession, version, pipeline_version, category, e->>'$.name' AS name, e->>'$.fileId' AS file_id FROM w WHERE json_type(e) = 'OBJECT')"
)


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(accession, version, pipeline_version, category, name, file_id): all files of the payloads."""
    parts = _payloads(spark, root).select(*KEY3, F.explode(members(F.col("d"), "files")).alias("category", "v"))
    one = parts.select(*KEY3, "category", F.explode(elements(F.col("v"))).alias("e")).filter(F.startswith("e", F.lit("{")))
    f = F.from_json("e", "name string, fileId string")
    return one.select(*KEY3, "category", f["name"].alias("name"), f["fileId"].alias("file_id"))


@query(
    "v14_file_mapping",
    f"WITH {_FILES}, g AS (SELECT accession, version, pipeline_version, category, CASE WHEN category = 'reports' THEN replace(name, '_', ' ') WHEN category = 'annotations' THEN 'all.gz' ELSE name END AS name, file_id FROM f), u AS (SELECT DISTINCT file_id FROM f WHERE category <> 'annotations'), "
    "x AS (SELECT DISTINCT accession, version, pipeline_version, category, name, CASE WHEN coalesce(name, '') = '' THEN 'empty_name' WHEN len(name) > 255 THEN 'name_too_long' WHEN regexp_matches(name, '[\\s/\\\\:*\"?<>|]') THEN 'forbidden_character' END AS error FROM g UNION ALL SELECT DISTINCT accession, version, pipeline_version, category, name, 'unknown_category' FROM g WHERE category NOT IN ('rawReads', 'reports') "
    "UNION ALL SELECT DISTINCT accession, version, pipeline_version, category, name, 'unknown_file' FROM g LEFT JOIN u USING (file_id) WHERE u.file_id IS NULL UNION ALL SELECT accession, version, pipeline_version, category, name, 'repeated_name' FROM g WHERE name IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT * FROM x WHERE error IS NOT NULL",
)
def v14r(spark, root):
    files = _files(spark, root)
    changed = files.withColumn("name", F.when(F.col("category") == "reports", F.replace("name", F.lit("_"), F.lit(" "))).when(F.col("category") == "annotations", "all.gz").otherwise(F.col("name")))
    return V.file_mapping_errors(changed, KEY3, ["rawReads", "reports"], known=files.filter("category <> 'annotations'"))


@query(
    "v18_set_records",
    f"WITH {GRP}, {REL}, q AS (SELECT group_id, accession, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 + doc_id % 3 END AS BIGINT) AS version FROM documents WHERE accession IS NOT NULL), q1 AS (SELECT group_id, accession, coalesce(version, 1) AS version FROM q) "
    "SELECT group_id, 'empty' AS error FROM g WHERE group_id NOT IN (SELECT group_id FROM q WHERE group_id IS NOT NULL) UNION ALL SELECT DISTINCT group_id, 'repeated_accession' FROM (SELECT group_id, accession FROM q1 GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT DISTINCT q1.group_id, 'not_released' FROM q1 LEFT JOIN r ON r.accession = q1.accession AND r.version = q1.version WHERE r.accession IS NULL",
)
def v18r(spark, root):
    docs = table(spark, root, "documents").select("group_id", "accession", F.when(F.col("doc_id") % 2 == 0, 1 + F.col("doc_id") % 3).alias("version"))
    return V.set_record_errors(docs, _g(spark, root), _r(spark, root), "group_id", "accession", "version")


# ------------------------------------------------------ changes and regrouping


@query(
    "j20_ingest_decisions",
    f"WITH {E}, l AS (SELECT accession AS id, accession, md5(coalesce(arg_max_null(original_data, version) FILTER (version = 1), '')) AS digest, CASE WHEN max(released_at) IS NULL THEN 'PROCESSED' ELSE 'APPROVED_FOR_RELEASE' END AS status, count(DISTINCT submitter) > 1 AS curated FROM e WHERE group_id % 7 <> 0 GROUP BY accession), "
    "i AS (SELECT accession AS id, md5(coalesce(arg_max_null(original_data, version), '')) AS digest FROM e GROUP BY accession), u AS (SELECT DISTINCT accession, digest FROM (SELECT id AS accession, digest FROM i) WHERE right(accession, 1) IN ('A', 'B', 'C')), "
    "k AS (SELECT id, CASE WHEN ('0x' || left(md5(id), 13))::BIGINT / 4503599627370496.0 > 0.9 THEN 'sampled_out' END AS s FROM i) "
    "SELECT i.id, CASE WHEN k.s IS NOT NULL THEN k.s WHEN l.id IS NULL THEN 'submit' WHEN l.digest = i.digest OR u.digest IS NOT NULL THEN 'noop' WHEN l.status <> 'APPROVED_FOR_RELEASE' THEN 'blocked:' || l.status WHEN l.curated THEN 'blocked:CURATION_ISSUE' ELSE 'revise' END AS decision FROM i JOIN k USING (id) LEFT JOIN l ON l.id = i.id LEFT JOIN u ON u.accession = l.accession AND u.digest = i.digest",
)
def j20r(spark, root):
    e = _e(spark, root)
    data = lambda which: F.md5(F.coalesce(F.max_by(F.when(which, F.col("original_data")), F.when(which, F.col("version"))), F.lit("")))
    status = F.when(F.max("released_at").isNull(), "PROCESSED").otherwise("APPROVED_FOR_RELEASE")
    latest = e.filter("group_id % 7 <> 0").groupBy("accession").agg(data(F.col("version") == 1).alias("digest"), status.alias("status"), (F.count_distinct("submitter") > 1).alias("curated")).withColumn("id", F.col("accession"))
    incoming = e.groupBy(F.col("accession").alias("id")).agg(data(F.lit(True)).alias("digest"))
    muted = incoming.filter(F.right("id", F.lit(1)).isin("A", "B", "C")).select(F.col("id").alias("accession"), "digest")
    return changes.decide_ingest(incoming, latest, muted, "id", "digest", fraction=0.9)


_OLD_GROUPS = "old AS (SELECT l_partkey AS member, min(l_orderkey) AS old_group FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), new AS (SELECT DISTINCT l_orderkey AS grp, l_partkey AS member FROM lineitem)"


@query("j20_regrouping", f"WITH {_OLD_GROUPS}, z AS (SELECT old_group, count(*) AS size FROM old GROUP BY 1), g AS (SELECT grp, count(*) AS n, count(old_group) AS known, count(DISTINCT old_group) AS olds, max(size) AS size FROM new LEFT JOIN old USING (member) LEFT JOIN z USING (old_group) GROUP BY grp) SELECT grp, CASE WHEN known = 0 THEN 'submit' WHEN olds = 1 AND known = size AND n = known THEN 'same' WHEN olds = 1 AND known = size THEN 'grown' ELSE 'regrouped' END AS decision FROM g")
def j20g(spark, root):
    lines = table(spark, root, "lineitem")
    old = lines.filter("l_linenumber <= 3").groupBy(F.col("l_partkey").alias("member")).agg(F.min("l_orderkey").alias("old_group"))
    return changes.decide_regrouping(lines.select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("member")), old, "grp", "member")


@query(
    "u09_override_conflicts",
    "WITH o AS (SELECT 'one' AS source, p_brand || '-' || (p_size % 5) AS grp, p_partkey AS member FROM part WHERE p_size % 4 <> 0 UNION ALL SELECT 'two', p_brand || '-' || (p_size % 5), p_partkey FROM part WHERE p_size % 4 <> 0 AND p_size % 5 <> 1 UNION ALL SELECT 'two', p_brand || '-' || (p_size % 5), p_partkey FROM part WHERE p_size % 4 = 1 AND p_size % 5 = 1 UNION ALL SELECT 'three', p_brand || '-again', p_partkey FROM part WHERE p_size % 4 <> 0 AND p_size % 5 = 2 UNION ALL SELECT 'three', p_brand || '-mixed', p_partkey FROM part WHERE p_size % 4 <> 0 AND p_size % 10 = 3), "
    "d AS (SELECT source, grp, list_sort(list(DISTINCT member)) AS m FROM o GROUP BY ALL), g AS (SELECT grp, max(len(m)) AS n, count(DISTINCT m) AS k FROM d GROUP BY grp), s AS (SELECT DISTINCT x.grp FROM (SELECT grp, md5(array_to_string(list_transform(m, lambda v: CAST(v AS VARCHAR)), ',')) AS h, unnest(m) AS member FROM (SELECT grp, min(m) AS m FROM d GROUP BY grp)) x JOIN (SELECT grp, md5(array_to_string(list_transform(m, lambda v: CAST(v AS VARCHAR)), ',')) AS h, unnest(m) AS member FROM (SELECT grp, min(m) AS m FROM d GROUP BY grp)) y ON x.member = y.member AND x.h <> y.h) "
    "SELECT g.grp, n, CASE WHEN k > 1 THEN 'conflicting_definition' WHEN s.grp IS NOT NULL THEN 'shared_members' ELSE 'ok' END AS status FROM g LEFT JOIN s ON s.grp = g.grp",
)
def u09r(spark, root):
    part = table(spark, root, "part")
    group = F.concat("p_brand", F.lit("-"), (F.col("p_size") % 5).cast("string"))
    member = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    of = lambda source, where, name: part.filter(where).select(F.lit(source).alias("source"), name.alias("grp"), member.alias("member"))
    rows = of("one", "p_size % 4 <> 0", group).unionAll(of("two", "p_size % 4 <> 0 and p_size % 5 <> 1", group)).unionAll(of("two", "p_size % 4 = 1 and p_size % 5 = 1", group))
    rows = rows.unionAll(of("three", "p_size % 4 <> 0 and p_size % 5 = 2", F.concat("p_brand", F.lit("-again")))).unionAll(of("three", "p_size % 4 <> 0 and p_size % 10 = 3", F.concat("p_brand", F.lit("-mixed"))))
    return changes.merge_group_overrides(rows, "source", "grp", "member")


_MUT = "SELECT DISTINCT accession, version, k AS segment, json_extract_string(s, '$.refAa') || json_extract_string(s, '$.pos') || json_extract_string(s, '$.qryAa') AS mutation FROM (SELECT accession, version, k, unnest(from_json(json_extract(mutations, '$.\"' || k || '\".privateSubstitutions'), '[\"JSON\"]')) AS s FROM (SELECT *, unnest(json_keys(mutations)) AS k FROM mutations_from_founder_clade WHERE json_valid(mutations) AND mutations LIKE '{%') WHERE json_type(mutations, '$.\"' || k || '\".privateSubstitutions') = 'ARRAY') WHERE json_type(s) = 'OBJECT'"


@query("u05_mutation_difference", f"WITH x AS ({_MUT}), a AS (SELECT * FROM x WHERE version = 1 AND mutation IS NOT NULL), b AS (SELECT * FROM x WHERE version = 2 AND mutation IS NOT NULL) SELECT accession, segment, 'only_first' AS side, mutation FROM (SELECT accession, segment, mutation FROM a EXCEPT SELECT accession, segment, mutation FROM b) UNION ALL SELECT accession, segment, 'only_second', mutation FROM (SELECT accession, segment, mutation FROM b EXCEPT SELECT accession, segment, mutation FROM a)")
def u05m(spark, root):
    from helixmill.functions import aligner as A

    rows = table(spark, root, "mutations_from_founder_clade").filter(F.try_parse_json("mutations").isNotNull() & F.startswith("mutations", F.lit("{"))).select("accession", "version", "mutations").distinct()
    subs = A.private_substitutions(rows, ["accession", "version"], "mutations").select("accession", "version", F.col("cds").alias("segment"), F.concat("ref", F.col("pos").cast("string"), "qry").alias("mutation")).filter("mutation is not null")
    return changes.list_differences(subs.filter("version = 1"), subs.filter("version = 2"), ["accession"], "segment", "mutation")


_NATURAL = "array_to_string([CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(coalesce(nullif(ltrim(x, '0'), ''), '0'), 20, '0') ELSE x END for x in regexp_extract_all(lower({}), '[0-9]+|[^0-9]+')], '')"


@query("a13_facet_in_natural_order", f"WITH {META}, f AS (SELECT coalesce(nullif(split_part(specimen_collector_sample_id, '_', 1), ''), '(blank)') AS value, count(*) AS n FROM m GROUP BY 1) SELECT value, n, row_number() OVER (ORDER BY {_NATURAL.format('value')}, value) AS place FROM f")
def a13r(spark, root):
    value = F.coalesce(F.nullif(F.substring_index("specimen_collector_sample_id", "_", 1), F.lit("")), F.lit("(blank)"))
    facet = _m(spark, root).groupBy(value.alias("value")).agg(F.count("*").alias("n")).withColumn("__k", counts.natural_key(F.col("value")))
    return filters.placed(facet, "__k", "value").select("value", "n", "place")


# ------------------------------------------- lists as numbered rows, citations


@query("j15_citation_lists", "SELECT accession, row_number() OVER (PARTITION BY accession ORDER BY doc_id) AS number, doc_id FROM documents WHERE accession IS NOT NULL")
def j15(spark, root):
    return filters.numbered(table(spark, root, "documents").filter("accession is not null").select("accession", "doc_id"), "accession", "doc_id")


@query("j26_children", "SELECT p_partkey // 10 AS parent, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS number, p_partkey AS child FROM part")
def j26(spark, root):
    return filters.numbered(table(spark, root, "part").select(F.floor(F.col("p_partkey") / 10).alias("parent"), F.col("p_partkey").alias("child")), "parent", "child")


@query("w10_history", f"WITH {E} SELECT accession, row_number() OVER (PARTITION BY accession ORDER BY version) AS number, version, is_revocation FROM e")
def w10(spark, root):
    return filters.numbered(_e(spark, root).select("accession", "version", "is_revocation"), "accession", "version")


@query("w11_terms_history", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number, event_type FROM events")
def w11(spark, root):
    return filters.numbered(table(spark, root, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "number", "event_type")


@query("r13_linked_documents", "SELECT doc_id, accession, count(*) OVER (PARTITION BY accession) - 1 AS n_linked FROM documents WHERE accession IS NOT NULL")
def r13(spark, root):
    docs = table(spark, root, "documents").filter("accession is not null").select("doc_id", "accession")
    return docs.join(docs.groupBy("accession").agg((F.count("*") - 1).alias("n_linked")), "accession").select("doc_id", "accession", "n_linked")


_CITED = "CASE WHEN doc_id % 2 = 0 THEN accession ELSE accession || '.' || (1 + doc_id % 3) END"


@query("j14_citations", f"WITH {REL}, {GRP}, d AS (SELECT doc_id, group_id, {_CITED} AS cited FROM documents WHERE accession IS NOT NULL) SELECT d.doc_id, g.group_name, r.accession, r.version, r.organism FROM d JOIN g ON g.group_id = d.group_id JOIN r ON cited = r.accession OR cited = r.accession || '.' || r.version")
def j14(spark, root):
    cited = F.when(F.col("doc_id") % 2 == 0, F.col("accession")).otherwise(F.concat_ws(".", "accession", (1 + F.col("doc_id") % 3).cast("string")))
    docs = table(spark, root, "documents").filter("accession is not null").select("doc_id", "group_id", cited.alias("cited"))
    docs = docs.join(_g(spark, root).select("group_id", "group_name"), "group_id").withColumns({"accession": X.base(F.col("cited")), "asked": X.version_of(F.col("cited"))})
    both = docs.join(_r(spark, root).select("accession", "version", "organism"), "accession")
    return both.filter("asked is null or asked = version").select("doc_id", "group_name", "accession", "version", "organism")


@query("j16_hash_lookup", f"WITH {META} SELECT m.id, x.hash FROM m JOIN (SELECT id, hash FROM m) x ON x.id = m.id WHERE m.hash <> ''")
def j16(spark, root):
    m = _m(spark, root)
    found = m.filter("hash <> ''").select("id").join(m.select("id", "hash"), "id", "left")
    return filters.require(found, F.col("hash").isNotNull(), "a record has no sequence hash").select("id", "hash")


@query("j19_complete_join", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def j19(spark, root):
    both = table(spark, root, "nation").join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return filters.require(both, F.col("r_name").isNotNull(), "a nation has no region").select("n_nationkey", "n_name", "r_name")


@query("q09_details", f"WITH {REL} SELECT accession, version, organism FROM (SELECT *, max(version) OVER (PARTITION BY accession) AS newest FROM r) WHERE version = newest AND accession = 'LOC_00000K'")
def q09(spark, root):
    found = entries.version_status(_r(spark, root).filter("accession = 'LOC_00000K'")).filter("version_status = 'LATEST_VERSION'").select("accession", "version", "organism")
    n = F.count("*").over(Window.partitionBy(F.lit(1)))  # the versions of one accession
    return filters.require(found.withColumn("n", n), F.col("n") == 1, "expected one result").drop("n")


@query("r09_version_changes", f"WITH {E} SELECT b.accession, b.version, json_extract_string(b.original_data, '$.metadata.hash') IS DISTINCT FROM json_extract_string(a.original_data, '$.metadata.hash') AS sequence_changed, json_extract_string(b.original_data, '$.metadata.segments') IS DISTINCT FROM json_extract_string(a.original_data, '$.metadata.segments') OR b.organism IS DISTINCT FROM a.organism AS fields_changed, b.submitter IS DISTINCT FROM a.submitter OR b.group_id IS DISTINCT FROM a.group_id AS manifest_changed FROM e b JOIN e a ON a.accession = b.accession AND a.version = b.version - 1")
def r09(spark, root):
    field = lambda n: F.get_json_object("original_data", f"$.metadata.{n}")
    e = _e(spark, root).select("accession", "version", field("hash").alias("sequence"), F.struct(field("segments").alias("s"), "organism").alias("fields"), F.struct("submitter", "group_id").alias("manifest"))
    before = e.select("accession", (F.col("version") + 1).alias("version"), *(F.col(c).alias(f"old_{c}") for c in ("sequence", "fields", "manifest")))
    return e.join(before, ["accession", "version"]).select("accession", "version", *((~F.col(c).eqNullSafe(F.col(f"old_{c}"))).alias(f"{c}_changed") for c in ("sequence", "fields", "manifest")))


_UUID = "regexp_replace(md5(accession), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"


@query("s04_file_cells", f"WITH {E} SELECT accession, version, CASE WHEN version = 1 THEN 'raw:1.fq' ELSE 'b.fq' END AS name, CASE WHEN group_id % 3 = 0 THEN 'none' ELSE {_UUID} END AS file_id, group_id % 3 <> 0 AS valid, CASE WHEN group_id % 3 = 0 THEN 'invalid_file' WHEN group_id % 5 = 0 THEN 'repeated_name' END AS error FROM e")
def s04(spark, root):
    digest = F.regexp_replace(F.md5("accession"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    token = F.concat(F.when(F.col("version") == 1, "raw:1.fq").otherwise("b.fq"), F.lit(":"), F.when(F.col("group_id") % 3 == 0, "none").otherwise(digest))
    cell = F.when(F.col("group_id") % 5 == 0, F.concat_ws("  ", token, token)).otherwise(F.concat(F.lit(" "), token))
    rows = _e(spark, root).select("accession", "version", F.explode(readers.file_cell(cell)).alias("f"), readers.file_cell_error(cell).alias("error"))
    return rows.select("accession", "version", "f.*", "error").distinct()


_ESCAPED = "array_to_string([CASE WHEN x = chr(10) THEN '\\n' WHEN x = chr(13) THEN '\\r' WHEN x = chr(9) THEN '\\t' WHEN x = '\"' THEN '\\\"' WHEN x = '\\' THEN '\\\\' WHEN unicode(x) > 65535 THEN '\\u' || format('{{:04x}}', 55296 + (unicode(x) - 65536) // 1024) || '\\u' || format('{{:04x}}', 56320 + (unicode(x) - 65536) % 1024) WHEN unicode(x) > 126 OR unicode(x) < 32 THEN '\\u' || format('{{:04x}}', unicode(x)) ELSE x END for x in string_split({0}, '')], '')"


@query("x52_content_hash", f"WITH {META} SELECT id, md5('{{' || array_to_string(list_filter([CASE WHEN geo_loc_country <> '' THEN '\"country\": \"' || {_ESCAPED.format('geo_loc_country')} || '\"' END, CASE WHEN geo_loc_admin1 <> '' THEN '\"region\": \"' || {_ESCAPED.format('geo_loc_admin1')} || '\"' END], lambda x: x IS NOT NULL), ', ') || '}}' || coalesce(hash, '')) AS digest FROM m")
def x52(spark, root):
    return _m(spark, root).select("id", X.content_hash({"country": F.col("geo_loc_country"), "region": F.col("geo_loc_admin1")}, F.coalesce("hash", F.lit(""))).alias("digest"))


@query("x56_title_case", "SELECT p_partkey, array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) for w in string_split(p_type, ' ')], ' ') AS name FROM part")
def x56(spark, root):
    return table(spark, root, "part").select("p_partkey", F.initcap("p_type").alias("name"))


# ------------------------------------------------- snapshots, sets, addresses


@query("x62_file_urls", f"WITH {REL} SELECT accession, version, '/files/get/' || accession || '/' || version || '/raw/' || submission_id || '%20%231.fq' AS site, 's3/files/' || md5(submission_id) AS stored FROM r WHERE submission_id IS NOT NULL")
def x62(spark, root):
    site = X.file_url("/files/get", F.col("accession"), F.col("version"), "raw", F.concat("submission_id", F.lit(" #1.fq")))
    stored = X.file_url("s3", F.col("accession"), F.col("version"), "raw", F.col("submission_id"), mode="storage", file_id=F.md5("submission_id"))
    return _r(spark, root).filter("submission_id is not null").select("accession", "version", site.alias("site"), stored.alias("stored"))


@query("x66_taxon_alias", "SELECT host_taxon_id, scientific_name || CASE WHEN host_taxon_id % 3 <> 0 THEN '; ' || common_name ELSE '' END || ' [Taxon ' || host_taxon_id || ']' AS alias FROM ref_hosts")
def x66(spark, root):
    common = F.when(F.col("host_taxon_id") % 3 != 0, F.col("common_name"))
    return table(spark, root, "ref_hosts").select("host_taxon_id", F.concat(F.concat_ws("; ", "scientific_name", common), F.format_string(" [Taxon %d]", "host_taxon_id")).alias("alias"))


@query("a27_assembly_counter", f"WITH {META}, c AS (SELECT insdc_accession_base AS assembly, segment, count(*) AS n FROM m WHERE insdc_accession_base <> '' AND segment IS NOT NULL GROUP BY ALL) SELECT segment, CAST(sum(n) AS BIGINT) AS n, count(*) AS assemblies, count(*) FILTER (n > 1) AS duplicated FROM c GROUP BY segment")
def a27(spark, root):
    once = _m(spark, root).filter("insdc_accession_base <> '' and segment is not null").groupBy("insdc_accession_base", "segment").agg(F.count("*").alias("n"))
    return once.groupBy("segment").agg(F.sum("n").alias("n"), F.count("*").alias("assemblies"), F.count_if(F.col("n") > 1).alias("duplicated"))


@query("r11_set_records", f"WITH {E}, x AS (SELECT DISTINCT accession, organism FROM e WHERE version = 1), k AS (SELECT accession, row_number() OVER (ORDER BY accession) AS id FROM (SELECT DISTINCT accession FROM x WHERE organism = 'cchf')), a AS (SELECT DISTINCT group_id, accession FROM documents WHERE accession IS NOT NULL), w AS (SELECT accession, row_number() OVER (ORDER BY accession) + (SELECT max(id) FROM k) AS id FROM (SELECT DISTINCT accession FROM a WHERE accession NOT IN (SELECT accession FROM k))) SELECT group_id, a.accession, coalesce(k.id, w.id) AS id, k.id IS NOT NULL AS shared FROM a LEFT JOIN k USING (accession) LEFT JOIN w USING (accession)")
def r11(spark, root):
    cchf = _e_rows(spark, root).filter("version = 1 and organism = 'cchf'").select("accession").distinct()
    existing = filters.placed(cchf, "accession", place="id")
    asked = table(spark, root, "documents").filter("accession is not null").select("group_id", "accession").distinct()
    new, links = state.shared_records(existing, asked, ["accession"], "id")
    return links.join(new.select("accession", F.lit(True).alias("fresh")), "accession", "left").select("group_id", "accession", "id", F.col("fresh").isNull().alias("shared"))


@query("v19_set_updates", f"WITH {GRP} SELECT group_id, CASE WHEN coalesce(trim(institution, ' '), '') = '' THEN 'blank_name' WHEN institution IS NOT DISTINCT FROM group_name AND address_line_1 IS NOT DISTINCT FROM address_line_2 THEN 'nothing_changed' END AS error FROM g")
def v19(spark, root):
    # the institution and first line as the new name and text, the group's name and second line as the old ones
    error = V.set_update_error(F.col("institution"), {"name": (F.col("group_name"), F.col("institution")), "text": (F.col("address_line_2"), F.col("address_line_1"))})
    return _g(spark, root).select("group_id", error.alias("error"))


@query("t16_snapshot", f"WITH {E} SELECT accession, version FROM e WHERE released_at IS NOT NULL")
def t16(spark, root):
    whole = _r(spark, root).select("accession", "version")
    broken = _e_rows(spark, root).filter("released_at is not null").select("accession", "version")  # rows that came twice
    expected = whole.count()
    good = state.refreshed(whole, broken, ["accession", "version"], expected)
    return state.refreshed(broken.unionAll(broken.limit(1)), good, ["accession", "version"], expected)


@query("u06_field_classes", f"WITH {E}, f AS (SELECT accession, version, unnest(['submitter', 'approver', 'organism', 'data']) AS field, unnest([submitter, approver, organism, original_data]) AS value FROM e), a AS (SELECT * FROM f WHERE version = 1), b AS (SELECT * FROM f WHERE version = 2) SELECT a.accession, a.field, CASE WHEN a.field = 'organism' THEN 'hidden' WHEN a.value IS NULL AND b.value IS NOT NULL THEN 'added' WHEN a.value IS NOT NULL AND b.value IS NULL THEN 'removed' WHEN a.value IS NOT DISTINCT FROM b.value THEN 'unchanged' WHEN a.field = 'approver' THEN 'noisy' ELSE 'changed' END AS change FROM a JOIN b USING (accession, field)")
def u06h(spark, root):
    long = _e(spark, root).filter("version in (1, 2)").select("accession", "version", F.expr("stack(4, 'submitter', submitter, 'approver', approver, 'organism', organism, 'data', original_data) as (field, value)"))
    a, b = long.filter("version = 1"), long.filter("version = 2")
    keep = lambda x, y: x.join(y.select("accession").distinct(), "accession", "left_semi")
    return changes.field_diff(keep(a, b), keep(b, a), "accession", "field", "value", noisy=("approver",), hidden=("organism",))


@query("s10_report_columns", "SELECT DISTINCT accession, version, json_extract_string(original_data, '$.metadata.hash') AS hash, json_extract_string(original_data, '$.metadata.segments') AS segments, CASE WHEN original_data IS NOT NULL THEN '2024' END AS year, 'a,b' AS names, CAST(NULL AS VARCHAR) AS nothing FROM sequence_entries WHERE original_data IS NOT NULL")
def s10(spark, root):
    rows = _e_rows(spark, root).filter("original_data is not null").select("accession", "version", F.concat(F.lit('{"report":'), "original_data", F.lit(',"year":2023.6,"names":["a","b"]}')).alias("d")).distinct()
    mapping = {"hash": "report.metadata.hash", "segments": "report.metadata.segments", "year": "year", "names": "names", "nothing": "report.none"}
    return rows.select("accession", "version", *readers.report_columns(F.col("d"), mapping, lists=["names"], numbers=["year"]))


# ------------------------------------------------------------ written tables


@query("k01_ndjson_lines", f"WITH {REL} SELECT accession || '.' || version AS id, organism, approver FROM r")
def k01(spark, root):
    path = scratch_folder(spark)
    rows = _r(spark, root).select(F.concat_ws(".", "accession", F.col("version").cast("string")).alias("id"), "organism", "approver")
    writers.write_ndjson(rows, path)
    return readers.read_ndjson(spark, path, "id string, organism string, approver string")


@query("k04_archive_entries", f"WITH {REL}, a AS (SELECT accession, version, organism, submission_id FROM r ORDER BY accession, version LIMIT 500) SELECT 'metadata' AS part, accession || chr(9) || version || chr(9) || organism AS line FROM a UNION ALL SELECT 'sequences', '>' || accession || '|' || version || chr(10) || upper(submission_id) FROM a WHERE submission_id IS NOT NULL")
def k04(spark, root):
    path = scratch_folder(spark)
    rows = _r(spark, root).select("accession", "version", F.create_map(F.lit("organism"), F.col("organism")).alias("metadata"), F.upper("submission_id").alias("sequence"))
    writers.write_archive(rows, path, ["accession", "version"], "metadata", "sequence", ["accession", "version"])
    metadata = spark.read.text(f"{path}/metadata").select(F.lit("metadata").alias("part"), F.col("value").alias("line"))
    fasta = readers.read_fasta_records(spark, f"{path}/sequences")
    return metadata.unionAll(fasta.select(F.lit("sequences").alias("part"), F.concat(F.lit(">"), "header", F.lit("\n"), "sequence").alias("line")))


@query("k05_decision_buckets", f"WITH {E} SELECT CASE WHEN is_revocation THEN 'revoke' WHEN version = 1 THEN 'submit' ELSE 'revise' END AS decision, accession, version FROM e")
def k05(spark, root):
    path = scratch_folder(spark)
    decision = F.when(F.col("is_revocation"), "revoke").when(F.col("version") == 1, "submit").otherwise("revise")
    writers.write_ndjson(_e(spark, root).select(decision.alias("decision"), "accession", "version"), path, partition_by=["decision"])
    return spark.read.schema("accession string, version bigint, decision string").json(path)


@query("k06_taxon_table", "SELECT host_taxon_id, scientific_name, lower(common_name) AS common FROM ref_hosts")
def k06(spark, root):
    path = scratch_folder(spark)
    rows = table(spark, root, "ref_hosts").select("host_taxon_id", "scientific_name", F.lower("common_name").alias("common"))
    writers.write_lookup_table(rows, path, "host_taxon_id")
    return spark.read.parquet(path)


@query("k07_stripped_payloads", f"WITH {SUB} SELECT submission_id, country, division, host FROM s")
def k07(spark, root):
    path = scratch_folder(spark)
    values = F.create_map(*(x for c in ("country", "division", "host") for x in (F.lit(c), F.col(c))))
    writers.write_stripped(_s(spark, root).select("submission_id", values.alias("data")), path, "data")
    data = F.from_json("data", "map<string,string>")
    return spark.read.parquet(path).select("submission_id", *(F.element_at(data, c).alias(c) for c in ("country", "division", "host")))


@query(
    "k08_flat_file",
    f"WITH {META} SELECT id, 'ID   ' || insdc_accession_base || '; SV ' || insdc_version || '; ' || len(hash) || ' BP.' || chr(10) || 'DE   ' || id || chr(10) || 'FT   source          1..' || len(hash) || CASE WHEN coalesce(geo_loc_country, '') <> '' THEN chr(10) || 'FT                   /country=\"' || geo_loc_country || '\"' ELSE '' END || chr(10) || "
    "'FT   CDS             1..9' || chr(10) || 'FT                   /gene=\"' || segment || '\"' || chr(10) || 'SQ   Sequence ' || len(hash) || ' BP;' || CASE WHEN hash <> '' THEN chr(10) || '     ' || lower(hash) ELSE '' END || chr(10) || '//' AS entry FROM m WHERE insdc_accession_base IS NOT NULL AND hash IS NOT NULL AND segment IS NOT NULL AND insdc_version IS NOT NULL",
)
def k08(spark, root):
    features = F.array(F.struct(F.lit("CDS").alias("kind"), F.lit(1).alias("begin"), F.lit(9).alias("end"), F.col("segment").alias("gene")))
    rows = _m(spark, root).filter("insdc_accession_base is not null and hash is not null and segment is not null and insdc_version is not null")
    entry = writers.flat_file(F.col("insdc_accession_base"), F.col("insdc_version"), F.col("id"), F.col("hash"), country=F.coalesce("geo_loc_country", F.lit("")), features=features)
    return rows.select("id", entry.alias("entry"))


@query("k08_flat_file_authors")
def k08a(spark, root):
    authors = X.embl_author_column(F.col("authors"))
    rows = _m(spark, root).filter("authors is not null and hash is not null").select("id", "insdc_version", "hash", authors.alias("people"))
    return rows.select("id", writers.flat_file(F.col("id"), F.coalesce("insdc_version", F.lit(1)), F.col("id"), F.col("hash"), authors=F.col("people")).alias("entry"))


@query("s11_unquoted_table", f"WITH {GRP} SELECT CAST(group_id AS VARCHAR) AS group_id, replace(replace(group_name, '\\', '/'), '\"', '') || '\" x' AS name FROM g WHERE group_name IS NOT NULL")
def s11(spark, root):
    path = scratch_folder(spark)
    name = F.concat(F.replace(F.replace("group_name", F.lit("\\"), F.lit("/")), F.lit('"'), F.lit("")), F.lit('" x'))
    writers.write_tsv(_g(spark, root).filter("group_name is not null").select("group_id", name.alias("name")), path)
    return readers.read_tsv(spark, path, quoted=False)


@query("t10_poll_twice", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def t10(spark, root):
    path = scratch_folder(spark)
    schema = table(spark, root, "events").schema
    for _ in range(2):  # the second poll finds nothing new
        poll.process_available(spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(root), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


QUERIES, SQL = query.queries, query.sql
