"""Operators on aligned sequences, insertions and identifiers, over whole payloads: all segments, all elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import aligner as A
from helixmill.functions import text as X
from helixmill.functions import validation as V
from helixmill.functions.payloads import elements, json_object, members
from helixmill.operators import entries, sequences, state
from helixmill.plans.reference_queries import _LUHN, META, P, _e_rows, _m, _p
from helixmill.registry import Registry
from helixmill.session import table

query = Registry()

KEY3 = ("accession", "version", "pipeline_version")
#: A reference sequence for each segment.
REFERENCES = {"L": "ACGTTGCA" * 8, "M": "CATGGTAC" * 8, "S": "GGATCCTA" * 8, "main": "TTAGCACG" * 8}

# the same payloads in SQL: string encoding removed, objects only
_UNWRAP = "SELECT * REPLACE (CASE WHEN json_valid(d) THEN CASE WHEN json_type(d) = 'VARCHAR' THEN d->>'$' ELSE d END END AS d) FROM "
OBJ = f"{P}, u0 AS (SELECT accession, version, pipeline_version, processed_data AS d FROM p), u1 AS ({_UNWRAP}u0), u2 AS ({_UNWRAP}u1), u3 AS ({_UNWRAP}u2), ok AS (SELECT * FROM (SELECT *, CASE WHEN json_valid(d) THEN json_type(d) END AS kind FROM u3) WHERE kind = 'OBJECT')"
_INS = (
    f"{OBJ}, v AS (SELECT accession, version, pipeline_version, segment, json_extract(d, '$.nucleotideInsertions.\"' || segment || '\"') AS v FROM (SELECT *, unnest(json_keys(d, '$.nucleotideInsertions')) AS segment FROM ok)), "
    "w AS (SELECT * EXCLUDE (v), unnest(CASE json_type(v) WHEN 'ARRAY' THEN from_json(v, '[\"JSON\"]') WHEN 'NULL' THEN [] ELSE [v] END) AS e FROM v), "
    "t AS (SELECT * EXCLUDE (e), CASE json_type(e) WHEN 'VARCHAR' THEN e->>'$' WHEN 'OBJECT' THEN (e->>'$.position') || ':' || (e->>'$.sequence') END AS ins FROM w), "
    "i AS (SELECT DISTINCT accession, version, pipeline_version, segment, TRY_CAST(split_part(ins, ':', 1) AS BIGINT) AS position, split_part(ins, ':', 2) AS sequence FROM t WHERE ins IS NOT NULL)"
)
_REF = "CASE segment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REFERENCES.items()) + " END"
_ALIGNED = (
    f"{OBJ}, q AS (SELECT accession, version, pipeline_version, segment, seq, {_REF} AS ref FROM (SELECT *, json_extract_string(d, '$.alignedNucleotideSequences.\"' || segment || '\"') AS seq FROM (SELECT *, unnest(json_keys(d, '$.alignedNucleotideSequences')) AS segment FROM ok)) WHERE seq IS NOT NULL)"
)


def _payloads(spark: SparkSession, root: str) -> DataFrame:
    return _p(spark, root).select(*KEY3, json_object(F.col("processed_data")).alias("d")).filter("d is not null")


def _insertions(spark: SparkSession, root: str) -> DataFrame:
    """(accession, version, pipeline_version, segment, position, sequence): all insertions of all segments."""
    parts = _payloads(spark, root).select(*KEY3, F.explode(members(F.col("d"), "nucleotideInsertions")).alias("segment", "v"))
    one = parts.select(*KEY3, "segment", F.explode(elements(F.col("v"))).alias("e"))
    as_object = F.from_json("e", "position string, sequence string")
    text = F.when(F.startswith("e", F.lit("{")), F.concat_ws(":", as_object["position"], as_object["sequence"])).otherwise(F.col("e"))
    split = one.select(*KEY3, "segment", F.split(text, ":").alias("x"))
    return split.select(*KEY3, "segment", F.get("x", 0).try_cast("bigint").alias("position"), F.coalesce(F.get("x", 1), F.lit("")).alias("sequence")).distinct()


def _aligned(spark: SparkSession, root: str) -> DataFrame:
    """(accession, version, pipeline_version, segment, seq, ref): all aligned sequences."""
    ref = F.create_map(*(F.lit(x) for kv in REFERENCES.items() for x in kv))
    parts = _payloads(spark, root).select(*KEY3, F.explode(members(F.col("d"), "alignedNucleotideSequences")).alias("segment", "seq")).filter("seq is not null")
    return parts.withColumn("ref", F.element_at(ref, F.col("segment")))


def _sequences(spark: SparkSession, root: str) -> DataFrame:
    """(accession, version, pipeline_version, seqs): the aligned sequences as a map."""
    seqs = members(F.col("d"), "alignedNucleotideSequences")
    return _payloads(spark, root).select(*KEY3, seqs.alias("seqs")).filter("seqs is not null")


def _at(segment: str, position: int) -> str:
    return f"substr(json_extract_string(d, '$.alignedNucleotideSequences.{segment}'), {position}, 1)"


@query("q01_mutation_filter", f"WITH {OBJ} SELECT accession, version, pipeline_version FROM ok WHERE {_at('main', 2)} NOT IN ('', 'T', 'N', 'X')")
def q01(spark, root):
    return _sequences(spark, root).filter(sequences.mutation_filter("2", F.col("seqs"), REFERENCES, "main")).select(*KEY3)


@query("q02_symbol_filter", f"WITH {OBJ} SELECT accession, version, pipeline_version FROM ok WHERE {_at('S', 3)} = 'C'")
def q02(spark, root):
    return _sequences(spark, root).filter(sequences.mutation_filter("s:A3C", F.col("seqs"), REFERENCES)).select(*KEY3)


@query("q04_q05_mutation_list", f"WITH {OBJ} SELECT accession, version, pipeline_version FROM ok WHERE {_at('L', 1)} = 'A' AND {_at('M', 2)} NOT IN ('', 'A', 'N', 'X')")
def q04(spark, root):
    return _sequences(spark, root).filter(sequences.mutation_filter("L:A1., nonsense, M:2", F.col("seqs"), REFERENCES)).select(*KEY3)


@query("q06_mutations", f"WITH {_ALIGNED}, x AS (SELECT *, unnest(generate_series(1, least(len(seq), len(ref)))) AS position FROM q) SELECT accession, version, pipeline_version, segment, position, substr(ref, position, 1) AS reference_symbol, substr(seq, position, 1) AS symbol, CASE WHEN substr(seq, position, 1) = '-' THEN 'deletion' ELSE 'substitution' END AS kind FROM x WHERE substr(seq, position, 1) <> substr(ref, position, 1) AND substr(seq, position, 1) NOT IN ('N', 'X')")
def q06(spark, root):
    rows = _aligned(spark, root).withColumn("key", F.struct(*KEY3, "segment"))
    found = sequences.mutations(rows, "key", "seq", "ref")
    return found.select("key.*", F.col("position").cast("bigint").alias("position"), "reference_symbol", "symbol", "kind")


@query("a19_mutation_profile", f"WITH {_ALIGNED}, x AS (SELECT segment, seq, ref, unnest(generate_series(1, least(len(seq), len(ref)))) AS position FROM q), k AS (SELECT segment, position, substr(ref, position, 1) AS r, substr(seq, position, 1) AS s FROM x), c AS (SELECT segment, position, count(*) AS coverage FROM k WHERE s NOT IN ('N', 'X') GROUP BY ALL) SELECT segment, position, s AS symbol, count(*) AS n, round(count(*) / any_value(coverage), 6) AS proportion FROM k JOIN c USING (segment, position) WHERE s <> r AND s NOT IN ('N', 'X') GROUP BY segment, position, s HAVING count(*) / any_value(coverage) >= 0.05")
def a19(spark, root):
    return sequences.mutation_profile(_aligned(spark, root), "segment", "seq", "ref", least=0.05)


@query("a20_insertion_counts", f"WITH {_INS} SELECT segment, position, sequence, count(*) AS n FROM i GROUP BY ALL")
def a20(spark, root):
    return _insertions(spark, root).groupBy("segment", "position", "sequence").agg(F.count("*").alias("n"))


@query("q03_insertion_filter", f"WITH {_INS} SELECT DISTINCT accession, version, pipeline_version FROM i WHERE segment = 'main' AND position = (SELECT min(position) FROM i WHERE segment = 'main') AND regexp_matches(sequence, '^.+$')")
def q03(spark, root):
    rows = _insertions(spark, root)
    first = rows.filter("segment = 'main'").agg(F.min("position").alias("first"))  # one row: the place that is asked for
    at = F.filter("i", lambda x: (x["position"] == F.col("first")) & (x["segment"] == "main"))
    lists = rows.groupBy(*KEY3).agg(F.collect_list(F.struct("segment", "position", "sequence")).alias("i"))  # the insertions of one record
    asked = sequences.insertion_query("ins_main:1:?")
    moved = F.transform(at, lambda x: F.struct(x["segment"].alias("segment"), F.lit(1).alias("position"), x["sequence"].alias("sequence")))
    return lists.crossJoin(F.broadcast(first)).filter(sequences.has_insertion(moved, asked)).select(*KEY3)


@query("q03_insertion_pattern", f"WITH {_INS} SELECT DISTINCT accession, version, pipeline_version FROM i WHERE segment = 'L' AND position BETWEEN 1000 AND 1999 AND regexp_matches(sequence, '^A.*C$')")
def q03p(spark, root):
    lists = _insertions(spark, root).filter("position between 1000 and 1999").groupBy(*KEY3).agg(F.collect_list(F.struct("segment", F.lit(1).alias("position"), "sequence")).alias("i"))
    return lists.filter(sequences.has_insertion(F.col("i"), sequences.insertion_query("ins_L:1:A?C"))).select(*KEY3)


@query("q07_insertions", f"WITH {_INS} SELECT * FROM i")
def q07(spark, root):
    return _insertions(spark, root)


@query("v09_iupac", f"WITH {OBJ}, q AS (SELECT accession, version, pipeline_version, segment, json_extract_string(d, '$.unalignedNucleotideSequences.\"' || segment || '\"') AS seq FROM (SELECT *, unnest(json_keys(d, '$.unalignedNucleotideSequences')) AS segment FROM ok)) SELECT accession, version, pipeline_version, segment, regexp_replace(seq, '[ACGTMRWSYKVHDBN]', '', 'g') <> '' AS invalid, regexp_matches(seq, '-') AS gaps, segment NOT IN ('L', 'M', 'S', 'main') AS excess FROM q WHERE seq IS NOT NULL")
def v09(spark, root):
    parts = _payloads(spark, root).select(*KEY3, F.explode(members(F.col("d"), "unalignedNucleotideSequences")).alias("segment", "seq")).filter("seq is not null")
    return parts.select(*KEY3, "segment", (F.size(sequences.invalid_symbols(F.col("seq"), V.NUCLEOTIDES)) > 0).alias("invalid"), F.contains("seq", F.lit("-")).alias("gaps"), (~F.col("segment").isin(*REFERENCES)).alias("excess"))


# ---------------------------------------------------- identifiers and texts


@query(
    "w08_unique_ids",
    "WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN accession || '_' || (1 + doc_id % 3) ELSE accession END AS name FROM documents WHERE accession IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1 AS k FROM n), "
    "b AS (SELECT *, s - row_number() OVER (PARTITION BY name ORDER BY s) AS c FROM (SELECT DISTINCT regexp_extract(name, '^(.*)_([1-9][0-9]*)$', 1) AS name, CAST(nullif(regexp_extract(name, '^(.*)_([1-9][0-9]*)$', 2), '') AS BIGINT) AS s FROM n) WHERE s IS NOT NULL) "
    "SELECT doc_id, CASE WHEN k = 0 THEN name ELSE name || '_' || (k + (SELECT count(*) FROM b WHERE b.name = k.name AND b.c < k.k)) END AS unique_id FROM k",
)
def w08(spark, root):
    name = F.when(F.col("doc_id") % 5 == 0, F.concat_ws("_", "accession", (1 + F.col("doc_id") % 3).cast("string"))).otherwise(F.col("accession"))
    docs = table(spark, root, "documents").filter("accession is not null").select("doc_id", name.alias("name"))
    return state.unique_ids(docs, "name", "doc_id").select("doc_id", "unique_id")


_EVENT_VALUES = "SELECT user_id, event_type AS name, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v, ts, event_id FROM events"


@query("a07_external_merge", f"WITH x AS ({_EVENT_VALUES}), k AS (SELECT user_id, name, arg_max(coalesce(v, ''), (ts, event_id)) AS v FROM x GROUP BY ALL) SELECT user_id, string_agg(name || '=' || v, ',' ORDER BY name) AS metadata FROM k GROUP BY user_id")
def a07(spark, root):
    value = F.coalesce(F.floor("value").cast("bigint").cast("string"), F.lit(""))
    external = table(spark, root, "events").select("user_id", "ts", F.col("event_id").alias("updater"), F.create_map(F.col("event_type"), value).alias("metadata"))
    merged = entries.merge_external(external, ["user_id"], "ts", "updater", "metadata")
    return merged.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("metadata"))


#: Author lists and how they must come out (fixed cases).
AUTHOR_CASES = (
    ("Xi,L;Yu,X.;", "Xi, L.; Yu, X.", "", ""), ("Xi,;Yu,X.;", "Xi, ; Yu, X.", "", ""), ("Smith, John II; Doe, A.B.C.; Lee, J D", "Smith, John II; Doe, A. B. C.; Lee, J. D.", "", ""), ("SMITH, AMY; Smith, AD; Black, W. C. IV", "SMITH, AMY; Smith, A. D.; Black, W. C. IV", "", ""),
    ("Diclaro, J.W.II; Ramirez, II II; Xu, X.L", "Diclaro, J. W. II; Ramirez, I. I. II; Xu, X. L.", "", ""), ("Tandoc, A. 3rd", "Tandoc, A. 3rd", "", ""), ("Smith, Anna; Perez, Tom J. and Xu X. L.", "Smith, Anna; Perez, Tom J. and Xu X. L.", "", "conjunction"),
    ("Smith9, Anna;", None, "invalid:Smith9, Anna", ""), ("a; b; c; d; e", None, "invalid:a; b; c and 2 others", ""), ("Smith, Anna Maria Berta", "Smith, Anna Maria Berta", "", "separators"),
)


@query("x08_x09_author_cases", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in c) + ")" for c in AUTHOR_CASES) + ") t(authors, value, error, warnings)")
def x08_cases(spark, root):
    rows = spark.createDataFrame([(c[0],) for c in AUTHOR_CASES], "authors string").withColumn("r", X.check_authors(F.col("authors")))
    return rows.select("authors", "r.value", F.coalesce("r.error", F.lit("")).alias("error"), F.array_join("r.warnings", ",").alias("warnings"))


@query("x09_author_helpers")
def x09(spark, root):
    flags = X.author_flags(F.col("authors"))
    return _m(spark, root).filter("authors is not null").select("id", flags.alias("f")).select("id", "f.*")


@query("x31_frame_shifts", "SELECT p_partkey, 'S:' || (p_size + 1) || '-' || (p_size + 3) || '(nt:' || (p_size * 3 + 1) || '-' || (p_size * 3 + 4) || ';' || (p_size * 3 + 9) || '),N:' || (p_size + 1) || '(nt:)' AS shifts FROM part")
def x31(spark, root):
    span = lambda a, b: F.struct(a.alias("begin"), b.alias("end"))
    n = F.col("p_size").cast("bigint")
    shift = lambda cds, codon, places: F.struct(F.lit(cds).alias("cdsName"), codon.alias("codon"), places.alias("nucAbs"))
    none = F.filter(F.array(span(n, n)), lambda x: F.lit(False))
    payload = F.to_json(F.array(shift("S", span(n, n + 3), F.array(span(n * 3, n * 3 + 4), span(n * 3 + 8, n * 3 + 9))), shift("N", span(n, n + 1), none)))
    return table(spark, root, "part").select("p_partkey", A.frame_shifts(payload).alias("shifts"))


_BLANK = "'^[\\s]+|[\\s]+$'"
_GIVEN = "CASE WHEN instr(e, ',') > 0 THEN substr(e, instr(e, ',') + 1) ELSE '' END"


@query(
    "x58_embl_authors",
    f"WITH {META}, a AS (SELECT id, [x for x in string_split(authors, ';') if regexp_replace(x, {_BLANK}, '', 'g') <> ''] AS parts FROM m WHERE authors IS NOT NULL) "
    f"SELECT id, regexp_replace(strip_accents(array_to_string([regexp_replace(regexp_replace(split_part(e, ',', 1), {_BLANK}, '', 'g') || ' ' || array_to_string([upper(w[1]) || '.' for w in regexp_split_to_array({_GIVEN}, '[\\s.\\-]+') if w <> ''], ''), {_BLANK}, '', 'g') for e in parts], ', ')), '[^\\x00-\\x7f]', '', 'g') AS authors FROM a",
)
def x58(spark, root):
    return _m(spark, root).filter("authors is not null").select("id", X.embl_author_column(F.col("authors")).alias("authors"))


@query(
    "v16_check_symbol",
    f"WITH b AS (SELECT DISTINCT accession, upper(substr(accession, 5)) AS body FROM sequence_entries), c AS (SELECT *, regexp_full_match(body, '[{_LUHN}]{{2,}}') AS fits, [instr('{_LUHN}', x) - 1 for x in string_split(reverse(substr(body, 1, len(body) - 1)), '')] AS digits FROM b), "
    f"t AS (SELECT *, list_sum([v // 34 + v % 34 for v in [digits[i] * (CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END) for i in range(1, len(digits) + 1)]]) AS total FROM c) "
    f"SELECT accession, starts_with(accession, 'LOC_') AND fits AND substr('{_LUHN}', CAST(1 + (34 - total % 34) % 34 AS BIGINT), 1) = right(body, 1) AS valid FROM t",
)
def v16(spark, root):
    return _e_rows(spark, root).select("accession").distinct().select("accession", X.valid_accession_column(F.col("accession"), "LOC_").alias("valid"))


QUERIES, SQL = query.queries, query.sql
