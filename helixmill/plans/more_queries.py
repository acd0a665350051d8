"""Further operators of the record engine: parsers, aligner output, validation, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions import aligner as A
from helixmill.functions import metadata as M
from helixmill.functions import text as X
from helixmill.functions import validation as V
from helixmill.operators import entries, filters, sequences, state
from helixmill.plans.reference_queries import E, GRP, META, P, REL, SUB, VIEW, _day, _e, _g, _m, _p, _r, _s, _v
from helixmill.registry import Registry
from helixmill.session import table
from helixmill.sources import readers, writers

query = Registry()

_OBJ = "json_valid(processed_data) AND processed_data LIKE '{%'"


def _objects(spark: SparkSession, root: str) -> DataFrame:
    """Processed rows whose payload is a JSON object."""
    return _p(spark, root).filter(F.try_parse_json("processed_data").isNotNull() & F.startswith("processed_data", F.lit("{")))


KEY3 = ("accession", "version", "pipeline_version")

# ------------------------------------------------------------ sources, sinks


@query("s01_submission_entries", f"WITH {SUB} SELECT submission_id, CAST((country <> '' AND country IS NOT NULL)::INT + (coalesce(division, '') <> '')::INT AS BIGINT) AS n, nullif(country, '') AS country FROM s")
def s01(spark, root):
    cells = _s(spark, root).select(F.col("submission_id").alias("submissionId"), "country", "division")
    got = readers.submission_entries(cells)
    return got.select("submission_id", F.size("metadata").cast("bigint").alias("n"), F.element_at("metadata", "country").alias("country"))


@query("s02_revision_entries", f"WITH {E} SELECT submission_id, accession, organism FROM e WHERE version > 1")
def s02(spark, root):
    cells = _e(spark, root).filter("version > 1").select(F.col("submission_id").alias("id"), "accession", "organism")
    return readers.submission_entries(cells, revision=True).select("submission_id", "accession", F.element_at("metadata", "organism").alias("organism"))


@query("s07_s09_records", f"WITH {P} SELECT accession, version, pipeline_version, json_extract_string(processed_data, '$.metadata.sampleCollectionDate') AS collected, TRY_CAST(json_extract_string(processed_data, '$.metadata.qc') AS DOUBLE) AS qc FROM p WHERE {_OBJ}")
def s07(spark, root):
    rows = _objects(spark, root).withColumn("r", F.from_json("processed_data", "metadata struct<sampleCollectionDate: string, qc: double>"))
    return rows.select(*KEY3, F.col("r.metadata.sampleCollectionDate").alias("collected"), F.col("r.metadata.qc").alias("qc"))


@query("s12_assembly_segments", f"WITH {META} SELECT insdc_accession_base AS assembly, count(*) AS segments, count(DISTINCT segment) = count(*) AS distinct_segments FROM m WHERE insdc_accession_base <> '' GROUP BY 1")
def s12(spark, root):
    rows = _m(spark, root).filter("insdc_accession_base <> ''")
    return rows.groupBy(F.col("insdc_accession_base").alias("assembly")).agg(F.count("*").alias("segments"), (F.count_distinct("segment") == F.count("segment")).alias("same"), F.count("segment").alias("__n")).select(
        "assembly", "segments", (F.col("same") & (F.col("__n") == F.col("segments"))).alias("distinct_segments")
    )


@query("s13_dump_fields", f"WITH {GRP} SELECT group_id, nullif(trim(coalesce(group_name, ''), ' '), '') AS name, nullif(trim(coalesce(address_state, ''), ' '), '') AS state FROM g")
def s13(spark, root):
    lines = _g(spark, root).select(F.concat(F.col("group_id").cast("string"), F.lit("\t|\t"), F.coalesce("group_name", F.lit("")), F.lit("\t|\t"), F.coalesce("address_state", F.lit("")), F.lit("\t|")).alias("value"))
    parts = readers.dump_fields(F.col("value"), ["group_id", "name", "state"])
    return lines.select(*parts).select(F.col("group_id").cast("int").alias("group_id"), "name", "state")


@query("s14_record_count_guard", f"WITH {REL} SELECT count(*) AS n, count(*) = count(DISTINCT accession || '.' || version) AS complete FROM r")
def s14(spark, root):
    return _r(spark, root).agg(F.count("*").alias("n"), (F.count("*") == F.count_distinct("accession", "version")).alias("complete"))


@query("s16_sequence_fetch", f"WITH {P} SELECT accession, version, pipeline_version, json_extract_string(processed_data, '$.alignedNucleotideSequences.L') AS sequence FROM p WHERE {_OBJ} AND json_extract_string(processed_data, '$.alignedNucleotideSequences.L') IS NOT NULL")
def s16(spark, root):
    seq = F.get_json_object("processed_data", "$.alignedNucleotideSequences.L")
    return _objects(spark, root).select(*KEY3, seq.alias("sequence")).filter("sequence is not null")


# ------------------------------------------------------- views, joins, windows


@query("f08_joint_metadata", f"WITH {VIEW} SELECT accession, version, CASE WHEN is_revocation THEN NULL ELSE json_extract_string(processed_data, '$.metadata.sampleCollectionDate') END AS collected, CASE WHEN is_revocation THEN NULL WHEN processed_data IS NULL THEN NULL WHEN group_id = 1 THEN 'external' ELSE json_extract_string(processed_data, '$.metadata.hostAge') END AS host_age FROM v WHERE processed_data IS NULL OR ({_OBJ})")
def f08(spark, root):
    v = _v(spark, root).filter(F.col("processed_data").isNull() | (F.try_parse_json("processed_data").isNotNull() & F.startswith("processed_data", F.lit("{"))))
    external = F.when(F.col("group_id") == 1, F.create_map(F.lit("hostAge"), F.lit("external")))
    joint = entries.joint_metadata(F.col("is_revocation"), F.from_json(F.get_json_object("processed_data", "$.metadata"), "map<string,string>"), external)
    return v.withColumn("m", joint).select("accession", "version", F.element_at("m", "sampleCollectionDate").alias("collected"), F.element_at("m", "hostAge").alias("host_age"))


@query("f20_selection", f"WITH {REL} SELECT accession || '.' || version AS accession_version FROM r WHERE accession || '.' || version IN ('LOC_00000K.1', 'LOC_00000S.1', 'LOC_00001D.1')")
def f20(spark, root):
    av = F.concat_ws(".", "accession", F.col("version").cast("string"))
    return _r(spark, root).select(av.alias("accession_version")).filter(F.col("accession_version").isin("LOC_00000K.1", "LOC_00000S.1", "LOC_00001D.1"))


@query("j13_citations_by_year", f"WITH {REL} SELECT d.doc_id, year(d.created_at) AS year, r.accession FROM documents d JOIN r ON r.accession = d.accession AND r.version = 1")
def j13(spark, root):
    docs = table(spark, root, "documents").select("doc_id", F.year("created_at").cast("bigint").alias("year"), "accession")
    return docs.join(_r(spark, root).filter("version = 1").select("accession"), "accession").select("doc_id", "year", "accession")


@query("j23_first_listed", "WITH l AS (SELECT * FROM (VALUES (0, 'BUILDING'), (1, 'MACHINERY'), (2, 'AUTOMOBILE')) t(place, seg)) SELECT c_nationkey, arg_min(seg, place) AS segment FROM customer JOIN l ON seg = c_mktsegment GROUP BY c_nationkey")
def j23(spark, root):
    listed = spark.createDataFrame([(["BUILDING", "MACHINERY", "AUTOMOBILE"],)], "l array<string>").select(F.posexplode("l").alias("place", "c_mktsegment"))
    return table(spark, root, "customer").join(listed, "c_mktsegment").groupBy("c_nationkey").agg(F.min_by("c_mktsegment", "place").alias("segment"))


@query("j27_visibility", f"WITH {REL} SELECT accession, version FROM r WHERE NOT is_revocation AND released_at < TIMESTAMP '2024-01-01' AND submitter <> 'insdc_ingest_user'")
def j27(spark, root):
    return _r(spark, root).filter("not is_revocation and released_at < timestamp_ntz'2024-01-01 00:00:00' and submitter <> 'insdc_ingest_user'").select("accession", "version")


@query("a06_organism_pipeline", f"WITH {E}, {P} SELECT organism, pipeline_version, processing_status, count(*) AS n FROM e JOIN p USING (accession, version) GROUP BY ALL")
def a06(spark, root):
    return _e(spark, root).select("accession", "version", "organism").join(_p(spark, root), ["accession", "version"]).groupBy("organism", "pipeline_version", "processing_status").agg(F.count("*").alias("n"))


@query("a08_object_aggregate", f"WITH {META} SELECT biosample_accession, array_to_string(list_sort(list(DISTINCT segment || ':' || coalesce(hash, ''))), ',') AS segments FROM m WHERE biosample_accession <> '' AND segment IS NOT NULL GROUP BY 1")
def a08(spark, root):
    rows = _m(spark, root).filter("biosample_accession <> '' and segment is not null")
    return rows.groupBy("biosample_accession").agg(F.array_join(F.array_sort(F.collect_set(F.concat("segment", F.lit(":"), F.coalesce("hash", F.lit(""))))), ",").alias("segments"))


@query("a29_lineage_values", f"WITH {META} SELECT array_to_string(list_sort(list(DISTINCT segment) FILTER (segment IS NOT NULL)), ',') AS segments, count(DISTINCT host_taxon_id) AS hosts FROM m")
def a29(spark, root):
    return _m(spark, root).agg(F.array_join(F.array_sort(F.collect_set("segment")), ",").alias("segments"), F.count_distinct("host_taxon_id").alias("hosts"))


@query("w02_newest_by_rank", f"WITH {P} SELECT accession, version, pipeline_version FROM (SELECT *, rank() OVER (PARTITION BY accession ORDER BY finished_processing_at DESC NULLS LAST) AS k FROM p) WHERE k = 1")
def w02(spark, root):
    w = Window.partitionBy("accession").orderBy(F.desc_nulls_last("finished_processing_at"))
    return _p(spark, root).withColumn("k", F.rank().over(w)).filter("k = 1").select(*KEY3)


@query("w03_version_status", f"WITH {REL} SELECT accession, version, CASE WHEN version = max(version) OVER a THEN 'LATEST_VERSION' WHEN max(CASE WHEN is_revocation THEN version END) OVER a > version THEN 'REVOKED' ELSE 'REVISED' END AS version_status FROM r WINDOW a AS (PARTITION BY accession)")
def w03(spark, root):
    return entries.version_status(_r(spark, root)).select("accession", "version", "version_status")


@query("l05_multi_key_descending", "SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_custkey DESC, o_totalprice DESC, o_orderkey DESC) AS place FROM orders")
def l05_whole(spark, root):
    return filters.placed(table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), F.desc("o_custkey"), F.desc("o_totalprice"), F.desc("o_orderkey"))


@query("l07_depth_order", "WITH RECURSIVE t AS (SELECT p_partkey AS id, p_partkey // 10 AS parent FROM part), c(node, ancestor, d) AS (SELECT id, id, 0 FROM t UNION ALL SELECT c.node, t.parent, c.d + 1 FROM c JOIN t ON t.id = c.ancestor WHERE t.parent <> t.id) SELECT node, CAST(max(d) AS BIGINT) AS depth, row_number() OVER (ORDER BY max(d), node) AS place FROM c GROUP BY node")
def l07_whole(spark, root):
    from helixmill.operators import hierarchy

    tree = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).alias("parent"))
    depth = hierarchy.closure(tree, "id", "parent").join(tree.select(F.col("id").alias("node")), "node", "left_semi").groupBy("node").agg(F.max("distance").alias("depth"))
    return filters.placed(depth, "depth", "node")


@query("u07_partition_marks", f"WITH {E} SELECT CASE WHEN approver IS NULL THEN 'marked' ELSE 'new' END AS part, count(*) AS n FROM e GROUP BY 1")
def u07(spark, root):
    return _e(spark, root).groupBy(F.when(F.col("approver").isNull(), "marked").otherwise("new").alias("part")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ functions


@query("x06_timestamp", f"WITH {SUB} SELECT submission_id, strftime(TRY_CAST(collection_date AS TIMESTAMP), '%Y-%m-%d') AS day FROM s WHERE collection_date <> ''")
def x06(spark, root):
    return _s(spark, root).filter("collection_date <> ''").select("submission_id", M.parse_timestamp(F.col("collection_date")).value.alias("day"))


@query("x15_custom_lineage", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'H3N2' || CASE WHEN c_custkey % 2 = 0 THEN ' reassortant' ELSE '' END || CASE WHEN c_acctbal > 5000 THEN ' (variant)' ELSE '' END END AS lineage FROM customer")
def x15(spark, root):
    lines = [F.lit("A"), F.when(F.col("c_custkey") % 2 == 0, "B").otherwise("A"), *[F.lit("A")] * 6]
    r = M.custom_lineage(F.when(F.col("c_nationkey") % 3 == 0, "H3").otherwise("H5"), F.lit("N2"), lines, [F.col("c_acctbal") > 5000])
    return table(spark, root, "customer").select("c_custkey", r.value.alias("lineage"))


@query("x30_dotted_path", f"WITH {P} SELECT accession, version, pipeline_version, CAST(json_extract_string(processed_data, '$.metadata.qc') AS DOUBLE) AS qc FROM p WHERE {_OBJ}")
def x30(spark, root):
    return _objects(spark, root).select(*KEY3, A.dotted(F.col("processed_data"), "metadata.qc").cast("double").alias("qc"))


_SUBS = f"SELECT DISTINCT accession, version, k, s FROM (SELECT accession, version, k, unnest(from_json(json_extract(mutations, '$.\"' || k || '\".privateSubstitutions'), '[\"JSON\"]')) AS s FROM (SELECT *, unnest(json_keys(mutations)) AS k FROM mutations_from_founder_clade WHERE json_valid(mutations) AND mutations LIKE '{{%') WHERE json_type(mutations, '$.\"' || k || '\".privateSubstitutions') = 'ARRAY') WHERE json_type(s) = 'OBJECT'"


@query("x33_founder_mutations", f"WITH x AS ({_SUBS}) SELECT accession, version, string_agg(k || ':' || json_extract_string(s, '$.refAa') || json_extract_string(s, '$.pos') || json_extract_string(s, '$.qryAa'), ' ' ORDER BY k, CAST(json_extract_string(s, '$.pos') AS BIGINT), json_extract_string(s, '$.qryAa')) AS mutations FROM x GROUP BY accession, version")
def x33(spark, root):
    rows = table(spark, root, "mutations_from_founder_clade").filter(F.try_parse_json("mutations").isNotNull() & F.startswith("mutations", F.lit("{"))).select("accession", "version", "mutations").distinct()
    subs = A.private_substitutions(rows, ["accession", "version"], "mutations")
    text = F.concat("cds", F.lit(":"), "ref", F.col("pos").cast("string"), "qry")
    ordered = F.array_sort(F.collect_set(F.struct("cds", "pos", "qry", text.alias("t"))))
    return subs.groupBy("accession", "version").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("mutations"))


@query("x32_stop_codons", "SELECT p_partkey, 'N:' || (p_size + 1) AS stops FROM part")
def x32(spark, root):
    payload = F.to_json(F.array(F.struct(F.lit("N").alias("cdsName"), F.col("p_size").alias("codon"))))
    return table(spark, root, "part").select("p_partkey", A.stop_codons(payload).alias("stops"))


@query("x35_phenotype", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS value FROM part")
def x35(spark, root):
    payload = F.to_json(F.array(F.struct(F.lit("other").alias("name"), F.lit(0).alias("value")), F.struct(F.lit("escape").alias("name"), F.col("p_size").alias("value"))))
    return table(spark, root, "part").select("p_partkey", A.phenotype(payload, "escape").alias("value"))


@query("x38_split_insertions", "SELECT p_partkey, 'S:' || p_size || ':AC|N:' || p_partkey || ':G' AS kept FROM part")
def x38(spark, root):
    cell = F.concat(F.lit("S:"), F.col("p_size").cast("string"), F.lit(":AC, X:1:T,N:"), F.col("p_partkey").cast("string"), F.lit(":G"))
    return table(spark, root, "part").select("p_partkey", F.array_join(A.known_gene_insertions(cell, ["S", "N"]), "|").alias("kept"))


@query("x39_gene_suffix", "SELECT DISTINCT p_brand || '-ref' AS gene FROM part")
def x39(spark, root):
    return table(spark, root, "part").select(F.concat_ws("-", "p_brand", F.lit("ref")).alias("gene")).distinct()


@query("x40_segment_lengths", f"WITH {P} SELECT accession, version, pipeline_version, CAST(coalesce(len(json_extract_string(processed_data, '$.unalignedNucleotideSequences.L')), 0) AS BIGINT) AS length_l, CAST(coalesce(len(json_extract_string(processed_data, '$.unalignedNucleotideSequences.main')), 0) AS BIGINT) AS length_main FROM p WHERE {_OBJ}")
def x40(spark, root):
    seqs = F.from_json(F.get_json_object("processed_data", "$.unalignedNucleotideSequences"), "map<string,string>")
    length = lambda k: F.coalesce(F.length(F.element_at(seqs, k)), F.lit(0)).cast("bigint")
    return _objects(spark, root).select(*KEY3, length("L").alias("length_l"), length("main").alias("length_main"))


@query("x41_protein_id", "SELECT DISTINCT p_brand AS id FROM part")
def x41(spark, root):
    return table(spark, root, "part").select(F.regexp_replace(F.concat("p_brand", F.lit("|CDS"), F.col("p_size").cast("string")), r"\|CDS\d+$", "").alias("id")).distinct()


# ---------------------------------------------------------------- validation


@query("v01_unknown_metadata", f"WITH {P} SELECT accession, version, pipeline_version, array_to_string(list_sort(list_filter(json_keys(processed_data, '$.metadata'), lambda k: k NOT IN ('qc', 'hostAge'))), ',') AS unknown FROM p WHERE {_OBJ} AND json_type(processed_data, '$.metadata') = 'OBJECT'")
def v01(spark, root):
    keys = F.json_object_keys(F.get_json_object("processed_data", "$.metadata"))
    rows = _objects(spark, root).select(*KEY3, keys.alias("k")).filter("k is not null")
    return rows.select(*KEY3, F.array_join(V.unknown_keys(F.col("k"), ["qc", "hostAge"]), ",").alias("unknown"))


@query("v03_json_types", f"WITH {P} SELECT accession, version, pipeline_version, coalesce(json_type(processed_data, '$.metadata.hostAge'), 'NULL') IN ('NULL', 'UBIGINT', 'BIGINT') AS age_ok, coalesce(json_type(processed_data, '$.metadata.qc'), 'NULL') IN ('NULL', 'DOUBLE') AS qc_ok FROM p WHERE {_OBJ}")
def v03(spark, root):
    raw = F.from_json("processed_data", "metadata map<string,string>")["metadata"]
    return _objects(spark, root).select(*KEY3, V.fits_type(F.element_at(raw, "hostAge"), "int").alias("age_ok"), V.fits_type(F.element_at(raw, "qc"), "float").alias("qc_ok"))


@query("v06_unknown_segments", f"WITH {P} SELECT accession, version, pipeline_version, array_to_string(list_sort(list_filter(json_keys(processed_data, '$.alignedNucleotideSequences'), lambda k: k NOT IN ('L', 'M', 'S'))), ',') AS unknown FROM p WHERE {_OBJ} AND json_type(processed_data, '$.alignedNucleotideSequences') = 'OBJECT'")
def v06(spark, root):
    keys = F.json_object_keys(F.get_json_object("processed_data", "$.alignedNucleotideSequences"))
    rows = _objects(spark, root).select(*KEY3, keys.alias("k")).filter("k is not null")
    return rows.select(*KEY3, F.array_join(V.unknown_keys(F.col("k"), ["L", "M", "S"]), ",").alias("unknown"))


@query("v10_alignment_required", f"WITH {P}, k AS (SELECT *, len(json_keys(processed_data, '$.unalignedNucleotideSequences')) AS given, coalesce(len(list_filter(json_keys(processed_data, '$.alignedNucleotideSequences'), lambda x: json_type(processed_data, '$.alignedNucleotideSequences.' || x) = 'VARCHAR')), 0) AS aligned FROM p WHERE {_OBJ}) SELECT accession, version, pipeline_version, CASE WHEN given > 0 AND aligned = 0 THEN 'none_aligned' WHEN aligned < given THEN 'some_unaligned' END AS problem FROM k")
def v10(spark, root):
    given = F.size(F.json_object_keys(F.get_json_object("processed_data", "$.unalignedNucleotideSequences")))
    aligned = F.from_json(F.get_json_object("processed_data", "$.alignedNucleotideSequences"), "map<string,string>")
    return _objects(spark, root).select(*KEY3, V.alignment_problem(given, F.size(F.filter(F.map_values(aligned), lambda x: x.isNotNull()))).alias("problem"))


@query("v11_segment_by_header", "WITH i AS (SELECT DISTINCT sample_id, unnest(regexp_split_to_array(trim(fasta_ids), '\\s+')) AS f FROM cchfv_test_metadata WHERE fasta_ids IS NOT NULL) SELECT sample_id, f AS fasta_id, CASE WHEN lower(regexp_extract(f, '[^_]*$')) IN ('l', 'm', 's') THEN upper(regexp_extract(f, '[^_]*$')) END AS segment FROM i WHERE f <> ''")
def v11(spark, root):
    ids = table(spark, root, "cchfv_test_metadata").filter("fasta_ids is not null").select("sample_id", F.explode(readers.fasta_ids(F.col("fasta_ids"))).alias("fasta_id")).distinct()
    return ids.select("sample_id", "fasta_id", V.segment_of(F.col("fasta_id"), ["L", "M", "S"]).alias("segment"))


@query("v17_read_files", "SELECT p_brand, 'too_many_files' AS error FROM part GROUP BY p_brand HAVING count(*) > 2")
def v17(spark, root):
    files = table(spark, root, "part").select("p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit("_1.FASTQ.gz")).alias("name"))
    return V.read_file_errors(files, "p_brand", "name")


# ----------------------------------------------------------- sequence queries


@query("q10_details", f"WITH {REL} SELECT accession, version, organism, submitter FROM r WHERE organism = 'mpox' ORDER BY accession, version LIMIT 20 OFFSET 5")
def q10(spark, root):
    return filters.Page(None, ("accession", "version"), limit=20, offset=5).apply(_r(spark, root).filter("organism = 'mpox'").select("accession", "version", "organism", "submitter"))


@query("q11_lineage_search", "WITH RECURSIVE t AS (SELECT p_partkey AS id, p_partkey // 10 AS parent FROM part), d(id) AS (SELECT 12 UNION ALL SELECT t.id FROM t JOIN d ON t.parent = d.id WHERE t.parent <> t.id) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT id FROM d)")
def q11(spark, root):
    from helixmill.operators import hierarchy

    tree = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).alias("parent"))
    below = hierarchy.closure(tree, "id", "parent").filter("ancestor = 12").select(F.col("node").alias("l_partkey"))
    return table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(below, "l_partkey", "left_semi").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


# ------------------------------------------------------------- state, routing


@query("t02_claim", f"WITH {E}, {P} SELECT accession, version, 'IN_PROCESSING' AS processing_status FROM e WHERE NOT is_revocation AND NOT EXISTS (SELECT 1 FROM p WHERE p.accession = e.accession AND p.version = e.version AND p.pipeline_version = 2) ORDER BY accession, version LIMIT 30")
def t02(spark, root):
    return state.claim(_e(spark, root), _p(spark, root), pipeline_version=2, at="2025-01-01 00:00:00", limit=30).select("accession", "version", "processing_status")


@query("t08_keep_current_pipelines", f"WITH {E}, {P}, c AS (SELECT organism, max(pipeline_version) AS current FROM e JOIN p USING (accession, version) GROUP BY organism) SELECT p.accession, p.version, p.pipeline_version FROM p JOIN e ON e.accession = p.accession AND e.version = p.version JOIN c ON c.organism = e.organism WHERE p.pipeline_version >= c.current - 1")
def t08(spark, root):
    e, p = _e(spark, root), _p(spark, root)
    return state.keep_recent_pipelines(e, p, entries.current_pipelines(e, p)).select(*KEY3)


@query("t09_change_tracker", f"WITH {E}, {P} SELECT organism, pipeline_version, strftime(max(finished_processing_at), '%Y-%m-%d %H:%M') AS newest FROM e JOIN p USING (accession, version) GROUP BY ALL")
def t09(spark, root):
    rows = _e(spark, root).select("accession", "version", "organism").join(_p(spark, root), ["accession", "version"])
    return rows.groupBy("organism", "pipeline_version").agg(F.date_format(F.max("finished_processing_at"), "yyyy-MM-dd HH:mm").alias("newest"))


@query("t11_two_phase_collection", f"WITH {GRP}, {E}, u AS (SELECT DISTINCT group_id FROM e WHERE organism = 'rvf') SELECT g.group_id, CASE WHEN g.group_id % 2 = 0 THEN 'delete' ELSE 'mark' END AS action FROM g WHERE g.group_id NOT IN (SELECT group_id FROM u)")
def t11(spark, root):
    marked = F.col("group_id") % 2 == 0
    used = _e(spark, root).filter("organism = 'rvf'").select("group_id")
    return state.collect_unused(_g(spark, root), used, "group_id", marked).select("group_id", "action")


@query("r01_edit_lookup", f"WITH {VIEW} SELECT accession, version, status, is_revocation AS refused FROM v WHERE accession = 'LOC_00000K'")
def r01(spark, root):
    return _v(spark, root).filter("accession = 'LOC_00000K'").select("accession", "version", "status", F.col("is_revocation").alias("refused"))


@query("r02_file_by_name", f"WITH {P} SELECT accession, version, pipeline_version, json_extract_string(processed_data, '$.files.rawReads[0].fileId') AS file_id FROM p WHERE {_OBJ} AND json_extract_string(processed_data, '$.files.rawReads[0].name') = 'run_1.fq.gz'")
def r02(spark, root):
    files = F.from_json(F.get_json_object("processed_data", "$.files.rawReads"), "array<struct<fileId:string,name:string>>")
    rows = _objects(spark, root).filter(F.startswith(F.get_json_object("processed_data", "$.files.rawReads"), F.lit("[")))
    hit = F.get(F.filter(files, lambda x: x["name"] == "run_1.fq.gz"), 0)
    return rows.select(*KEY3, hit["fileId"].alias("file_id")).filter("file_id is not null")


@query("r10_result_keys", f"WITH {P} SELECT DISTINCT accession, version, k AS segment FROM (SELECT accession, version, unnest(json_keys(processed_data, '$.sequenceNameToFastaId')) AS k FROM p WHERE {_OBJ} AND json_type(processed_data, '$.sequenceNameToFastaId') = 'OBJECT') WHERE starts_with(k, 'm')")
def r10(spark, root):
    keys = F.json_object_keys(F.get_json_object("processed_data", "$.sequenceNameToFastaId"))
    return _objects(spark, root).select("accession", "version", F.explode(keys).alias("segment")).filter(F.startswith("segment", F.lit("m"))).distinct()


# ------------------------------------------------- counters, order, smaller steps


@query("a31_counters", f"WITH {E} SELECT organism, count(*) AS submitted, count(*) FILTER (is_revocation) AS revoked, count(released_at) AS released FROM e GROUP BY organism")
def a31(spark, root):
    return _e(spark, root).groupBy("organism").agg(F.count("*").alias("submitted"), F.count_if("is_revocation").alias("revoked"), F.count("released_at").alias("released"))


@query("l06_first_key", f"WITH {E} SELECT organism, first(accession || '.' || version ORDER BY accession, version) AS first_key FROM e GROUP BY organism")
def l06(spark, root):
    first = F.min(F.struct("accession", "version"))
    return _e(spark, root).groupBy("organism").agg(first.alias("k")).select("organism", F.concat_ws(".", "k.accession", F.col("k.version").cast("string")).alias("first_key"))


@query("l08_any", f"WITH {E} SELECT count(*) > 0 AS found FROM (SELECT 1 FROM e WHERE is_revocation LIMIT 1)")
def l08(spark, root):
    return table(spark, root, "sequence_entries").filter("is_revocation").limit(1).agg((F.count("*") > 0).alias("found"))


@query("r05_dataset_names", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment || '-set' END AS dataset, c_mktsegment = 'AUTOMOBILE' AS ambiguous FROM customer")
def r05(spark, root):
    listed = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("name")) for k, v in (("BUILDING", "BUILDING-set"), ("MACHINERY", "MACHINERY-set"), ("AUTOMOBILE", "a"), ("AUTOMOBILE", "b"))))
    name, ambiguous = A.only_match(listed, F.col("c_mktsegment"))
    return table(spark, root, "customer").select("c_custkey", name.alias("dataset"), ambiguous.alias("ambiguous"))


@query("r06_accepted_matches", "SELECT p_brand, array_to_string(list_sort(list_distinct(list_concat(['self', p_brand], CASE WHEN p_size > 25 THEN ['wide', 'self'] ELSE [] END))), ',') AS accepted FROM (SELECT p_brand, max(p_size) AS p_size FROM part GROUP BY p_brand)")
def r06(spark, root):
    brands = table(spark, root, "part").groupBy("p_brand").agg(F.max("p_size").alias("p_size"))
    more = F.when(F.col("p_size") > 25, F.array(F.lit("wide"), F.lit("self"))).otherwise(F.array().cast("array<string>"))
    return brands.select("p_brand", F.array_join(F.array_sort(F.array_union(F.array(F.lit("self"), "p_brand"), more)), ",").alias("accepted"))


@query("r15_metadata_upsert", f"WITH {P}, c AS (SELECT accession, version, pipeline_version AS updater, coalesce(processed_data, '') AS metadata FROM p), n AS (SELECT accession, version, max(updater) AS updater, max_by(metadata, updater) AS metadata FROM c WHERE updater > 1 GROUP BY accession, version) SELECT accession, version, updater, metadata FROM n UNION ALL SELECT accession, version, updater, metadata FROM c WHERE updater = 1 AND NOT EXISTS (SELECT 1 FROM n WHERE n.accession = c.accession AND n.version = c.version)")
def r15_whole(spark, root):
    p = _p(spark, root).select("accession", "version", F.col("pipeline_version").alias("updater"), F.coalesce("processed_data", F.lit("")).alias("metadata"))
    newer = p.filter("updater > 1").groupBy("accession", "version").agg(F.max("updater").alias("updater"), F.max_by("metadata", "updater").alias("metadata"))
    return entries.upsert(p.filter("updater = 1"), newer, ["accession", "version"])


@query("s08_external_metadata", f"WITH {META} SELECT id, insdc_accession_base AS base, ncbi_source_db AS source FROM m")
def s08(spark, root):
    lines = _m(spark, root).select(F.to_json(F.struct("id", F.struct(F.col("insdc_accession_base").alias("base"), F.col("ncbi_source_db").alias("source")).alias("externalMetadata"))).alias("value"))
    return lines.select(F.from_json("value", "id string, externalMetadata struct<base:string,source:string>").alias("r")).select("r.id", "r.externalMetadata.base", "r.externalMetadata.source")


@query("t01_tumbling_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t01(spark, root):
    return table(spark, root, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("t04_next_states", f"WITH {VIEW} SELECT status, CASE status WHEN 'RECEIVED' THEN 'IN_PROCESSING' WHEN 'IN_PROCESSING' THEN 'PROCESSED' WHEN 'PROCESSED' THEN 'APPROVED_FOR_RELEASE' END AS next, count(*) AS n FROM v GROUP BY ALL")
def t04(spark, root):
    return _v(spark, root).groupBy("status", state.next_state(F.col("status")).alias("next")).agg(F.count("*").alias("n"))


@query("t14_audit_lines", f"WITH {REL} SELECT approver || ' approved ' || accession || '.' || version AS line FROM r")
def t14(spark, root):
    return state.audit_lines(_r(spark, root), F.col("approver"), "approved").select("line")


@query("u03_recursive_union", "WITH RECURSIVE t AS (SELECT p_partkey AS id, p_partkey // 10 AS parent FROM part), c(id) AS (SELECT id FROM t WHERE id > 150 UNION SELECT t.parent FROM c JOIN t ON t.id = c.id WHERE t.parent <> t.id) SELECT id FROM c")
def u03(spark, root):
    from helixmill.operators import hierarchy

    tree = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).alias("parent"))
    start = tree.filter("id > 150").select(F.col("id").alias("node"))
    return hierarchy.closure(tree, "id", "parent").join(start, "node", "left_semi").select(F.col("ancestor").alias("id")).distinct()


@query("x19_common_name", "WITH RECURSIVE t AS (SELECT p_partkey AS id, p_partkey // 10 AS parent FROM part), k AS (SELECT p_partkey AS id, p_type AS name FROM part WHERE p_partkey % 7 = 0), c(node, ancestor, d) AS (SELECT id, id, 0 FROM t UNION ALL SELECT c.node, t.parent, c.d + 1 FROM c JOIN t ON t.id = c.ancestor WHERE t.parent <> t.id) SELECT c.node, arg_min(k.name, c.d) AS name FROM c JOIN k ON k.id = c.ancestor GROUP BY c.node")
def x19(spark, root):
    from helixmill.operators import hierarchy

    tree = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).alias("parent"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).alias("name"))
    return hierarchy.nearest_with(tree, "id", "parent", "name").join(tree.select(F.col("id").alias("node")), "node", "left_semi")


@query("x22_x23_field_levels", "SELECT * FROM (VALUES ('date', 0), ('country', 0), ('name', 1), ('title', 2)) t(field, level)")
def x22(spark, root):
    levels = M.field_order({"title": ["processed.name"], "name": ["processed.date", "processed.country"], "date": ["d"], "country": ["c"]})
    return spark.createDataFrame([(f, k) for k, fields in enumerate(levels) for f in fields], "field string, level int")


_LABELED = "SELECT DISTINCT accession, version, k, s FROM (SELECT accession, version, k, unnest(from_json(json_extract(mutations, '$.\"' || k || '\".labeledSubstitutions'), '[\"JSON\"]')) AS s FROM (SELECT *, unnest(json_keys(mutations)) AS k FROM mutations_from_founder_clade WHERE json_valid(mutations) AND mutations LIKE '{%') WHERE json_type(mutations, '$.\"' || k || '\".labeledSubstitutions') = 'ARRAY') WHERE json_type(s) = 'OBJECT'"


@query("x34_labelled_mutations", f"SELECT accession, version, k || ':' || json_extract_string(s, '$.substitution.refAa') || json_extract_string(s, '$.substitution.pos') || json_extract_string(s, '$.substitution.qryAa') AS mutation FROM ({_LABELED}) GROUP BY ALL")
def x34(spark, root):
    rows = table(spark, root, "mutations_from_founder_clade").filter(F.try_parse_json("mutations").isNotNull() & F.startswith("mutations", F.lit("{"))).select("accession", "version", "mutations").distinct()
    return A.labelled_substitutions(rows, ["accession", "version"], "mutations").select("accession", "version", F.concat("cds", F.lit(":"), "ref", "pos", "qry").alias("mutation")).distinct()


QUERIES, SQL = query.queries, query.sql
