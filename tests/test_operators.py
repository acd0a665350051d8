import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from helixmill.functions import metadata as M
from helixmill.functions import text as X
from helixmill.functions import validation as V
from helixmill.operators import changes, counts, entries, filters, hierarchy, sequences
from helixmill.sources import readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_version_status_against_model(spark):
    rng = random.Random(3)
    data = [(f"a{k}", v, rng.random() < 0.3) for k in range(30) for v in range(1, rng.randrange(2, 6))]
    df = spark.createDataFrame(data, "accession string, version int, is_revocation boolean")
    got = {(r.accession, r.version): r.version_status for r in entries.version_status(df).collect()}
    for a, v, _ in data:
        higher = [(w, rev) for b, w, rev in data if b == a and w > v]
        want = "LATEST_VERSION" if not higher else "REVOKED" if any(r for _, r in higher) else "REVISED"
        assert got[a, v] == want


def test_newest_terms_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z")], "accession string, change_date int, kind string")
    assert {r.kind for r in entries.newest_terms(df).collect()} == {"y", "z"}


def test_merge_external_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "u", {"k": "1", "m": "0"}), ("a", 2, "u", {"k": "2"}), ("a", 2, "t", {"k": "9"})], "acc string, at int, by string, m map<string,string>")
    assert entries.merge_external(df, ["acc"], "at", "by", "m").first().m == {"k": "2", "m": "0"}


def test_newer_pipeline(spark):
    e = spark.createDataFrame([("a", 1, "o"), ("b", 1, "o"), ("c", 1, "q"), ("d", 1, "q")], "accession string, version int, organism string")
    p = [("a", 1, 1, "[]"), ("b", 1, 1, "[]"), ("a", 1, 2, "[]"), ("b", 1, 2, None), ("c", 1, 1, "[]"), ("d", 1, 1, "[]"), ("c", 1, 2, "[]"), ("d", 1, 2, '["bad"]')]
    p = spark.createDataFrame([(*x, "PROCESSED") for x in p], "accession string, version int, pipeline_version int, errors string, processing_status string")
    assert rows(entries.newer_pipeline_ready(e, p)) == [("o", 2)]


def test_earliest_release_with_external_dates(spark):
    df = spark.createDataFrame([("a", 1, datetime(2024, 1, 5), None), ("a", 2, datetime(2024, 2, 1), datetime(2023, 1, 1)), ("a", 3, datetime(2022, 1, 1), None)], "accession string, version int, released_at timestamp_ntz, insdc timestamp_ntz")
    got = [r.earliest_release for r in entries.earliest_release(df, "insdc").orderBy("version").collect()]
    assert got == [datetime(2024, 1, 5), datetime(2023, 1, 1), datetime(2022, 1, 1)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Kenya", "a.b"), (2, None, "axb"), (3, "Chad", None)], "id int, country string, note string")
    ids = lambda c: [r.id for r in df.filter(c).orderBy("id").collect()]
    assert ids(filters.any_of([])) == []
    assert ids(filters.in_or_null("country", [None, "Chad"])) == [2, 3]
    assert ids(filters.contains_literal("note", "A.B")) == [1]
    assert ids(filters.equal_or_null({"country": None})) == [2]
    assert filters.parse_accessions("A1.2, A2;\nA1") == ["A1", "A2"]
    with pytest.raises(ValueError):
        filters.parse_filter("country>=x", ["country"])
    with pytest.raises(ValueError):
        filters.parse_filter("what=x", ["country"])


def test_facet_ignores_its_own_filter(spark):
    df = spark.createDataFrame([("x", 1), (None, 1), ("y", 2)], "f string, g int")
    got = rows(counts.facet(df, "f", {"f": F.col("f") == "x", "g": F.col("g") == 1}))
    assert got == [("(blank)", 1), ("x", 1)]


def test_equivalence_groups_explode_clashes(spark):
    df = spark.createDataFrame([("1", "L", "a"), ("2", "M", "a"), ("3", "L", "b"), ("4", "L", "b"), ("5", "S", None)], "id string, seg string, k string")
    got = {r.id: r.group_id for r in counts.equivalence_groups(df, ["k"], "seg", "id").collect()}
    assert got["1"] == got["2"]
    assert (got["3"], got["4"]) == ("3", "4")


def test_mutations_and_ranges(spark):
    df = spark.createDataFrame([("a", "ACNT-", "AGGTA"), ("b", "", "AC"), ("c", None, "AC")], "k string, s string, r string")
    assert rows(sequences.mutations(df, "k", "s", "r")) == [("a", 2, "G", "C", "substitution"), ("a", 5, "A", "-", "deletion")]
    pos = spark.createDataFrame([("a", p) for p in (1, 2, 3, 5, 6, 9)], "k string, p int")
    assert rows(sequences.runs(pos, "k", "p")) == [("a", 1, 3), ("a", 5, 6), ("a", 9, 9)]
    assert {r.label for r in sequences.run_labels(pos, "k", "p").collect()} == {"1-3", "5", "6", "9"}


def test_mutation_texts():
    assert sequences.parse_mutation("HA:A12T") == sequences.Mutation(12, "T", "A", "HA")
    assert sequences.parse_mutation("12.") == sequences.Mutation(12, ".")
    assert sequences.parse_mutation("nonsense") is None
    assert [m.position for m in sequences.parse_mutations("A1T, x, 7-")] == [1, 7]
    assert sequences.insertion_pattern("ins_L:5:A?C") == (5, "^A.*C$")
    assert sequences.insertion_pattern("ins_5:?") == (5, "^.+$")


def test_mask_terminal_gaps(spark):
    df = spark.createDataFrame([("--AC-G-",), ("---",), ("AC",)], "s string")
    assert [r[0] for r in df.select(sequences.mask_terminal_gaps(F.col("s"))).collect()] == ["NNAC-GN", "NNN", "AC"]


def test_hierarchy(spark):
    tree = spark.createDataFrame([(1, 1, "root"), (2, 1, None), (3, 2, None), (4, 3, "leaf"), (5, 9, None)], "id long, parent long, name string")
    got = {(r.node, r.ancestor, r.distance) for r in hierarchy.closure(tree, "id", "parent").collect()}
    assert (4, 1, 3) in got and (3, 3, 0) in got and (5, 9, 1) in got and (9, 9, 0) in got
    assert dict(hierarchy.nearest_with(tree, "id", "parent", "name").collect())[3] == "root"
    keep = spark.createDataFrame([(1,), (4,)], "id long")
    assert rows(hierarchy.prune(tree, "id", "parent", keep)) == [(1, None), (4, 1)]
    n = spark.createDataFrame([(4, 2), (2, 1)], "id long, n long")
    assert dict(hierarchy.descendant_counts(tree, "id", "parent", n, "id", "n").collect())[2] == 3
    with pytest.raises(ValueError):
        hierarchy.closure(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"), "id", "parent")


def test_changes(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "k string, d string")
    b = spark.createDataFrame([("y", "2"), ("z", "9"), ("w", "0")], "k string, d string")
    assert rows(changes.decide_changes(a, b, "k", "d")) == [("w", "suppressed"), ("x", "submit"), ("y", "unchanged"), ("z", "revise")]
    r = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "base string, v int")
    k = spark.createDataFrame([("a", 2, "g2"), ("a", 3, "g3"), ("b", 3, "late")], "base string, v int, g string")
    assert rows(changes.nearest_earlier(r, k, "base", "v", "g")) == [("a", 1, None), ("a", 3, "g3"), ("b", 2, None)]


def _value(spark, function, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    r = function(F.col("c"), **kw)
    return [(x.v, list(x.e), list(x.w)) for x in df.select(r.value.alias("v"), r.errors.alias("e"), r.warnings.alias("w")).collect()]


def test_identity(spark):
    assert _value(spark, M.identity, ["7", "x", "", None], kind="int") == [(7, [], []), (None, ["invalid_int"], []), (None, [], []), (None, [], [])]
    assert _value(spark, M.identity, ["1.5", "NaN", "Infinity"], kind="float") == [(1.5, [], []), (None, [], []), (None, ["invalid_float"], [])]
    assert _value(spark, M.identity, ["TRUE", "maybe"], kind="boolean") == [(True, [], []), (None, ["invalid_boolean"], [])]


def test_dates(spark):
    today = F.lit("2024-06-01").cast("date")
    got = _value(spark, M.past_date, ["2024-2-3", "2023-05", "2020", "2030-01-01", "2023-13-01", "x"], today=today)
    assert got == [("2024-02-03", [], []), ("2023-05-01", [], ["day_missing"]), ("2020-01-01", [], ["month_missing"]), ("2030-01-01", ["in_future"], []), (None, ["not_a_date"], []), (None, ["not_a_date"], [])]
    df = spark.createDataFrame([("2020",), ("2020-02",), ("2020-02-05",), ("[2020-01 TO 2021-03]",), ("2020/2021",), ("2020-01-02/2020-03",), ("2030",), (None,), ("bad",)], "c string")
    low, high = M.date_range(F.col("c"), F.lit("2024-06-01").cast("date"))
    got = [r[0] for r in df.select(M.compact_range(low, high)).collect()]
    assert got[:6] == ["2020", "2020-02", "2020-02-05", "2020-01/2021-03", "2020/2021", "2020-01-02/2020-03-31"]
    bounds = [tuple(r) for r in df.select(low, high).collect()]
    limited = M.with_date_range(df.withColumn("limit", F.lit("2024-06-01").cast("date")), "c", "limit")
    assert [(r.range_low, r.range_high) for r in limited.collect()] == bounds
    assert bounds[6][1] == date(2024, 6, 1) and bounds[7] == (None, date(2024, 6, 1)) and bounds[8] == (None, None)


def test_concatenate_and_options(spark):
    df = spark.createDataFrame([(None, "A b", "x"), ("K", "", None)], "a string, b string, c string")
    assert [r[0] for r in df.select(M.concatenate([F.col("a"), F.col("b"), F.col("c")], "").value).collect()] == ["A_b/x", "K"]
    got = _value(spark, M.process_options, [" north  SEA", "other", None], options=["North Sea"])
    assert got == [("North Sea", [], []), (None, ["not_an_option"], []), (None, [], [])]


def test_custom_lineage(spark):
    cols = [f"l{i}" for i in range(8)]
    df = spark.createDataFrame([("H1", "N1", *["H1N1PDM"] * 8, True), ("H3", "N2", "A", *["B"] * 7, False), ("H5", "N1", *["A"] * 8, False), (None, "N1", *["A"] * 8, False)], ", ".join(f"{c} string" for c in ["ha", "na", *cols]) + ", v boolean")
    r = M.custom_lineage(F.col("ha"), F.col("na"), [F.col(c) for c in cols], [F.col("v")])
    assert [x[0] for x in df.select(r.value).collect()] == ["H1N1pdm (variant)", "H3N2 reassortant", None, None]


def test_spec_levels_and_required(spark):
    spec = {"d": M.Field("parse_timestamp", ("t",)), "n": M.Field("concatenate_", ("processed.d",))}
    assert M.field_order({"a": ["processed.b"], "b": ["x"], "c": ["processed.a"]}) == [["b"], ["a"], ["c"]]
    with pytest.raises(ValueError):
        M.field_order({"a": ["processed.b"], "b": ["processed.a"]})
    with pytest.raises(KeyError):
        M.apply_spec(spark.createDataFrame([("x",)], "t string"), spec)


def test_accessions_and_authors():
    for n in (0, 1, 33, 34, 999_999):
        a = X.accession(n, "LOC_")
        assert X.valid_accession(a, "LOC_")
        swapped = a[:-1] + ("0" if a[-1] != "0" else "1")
        assert not X.valid_accession(swapped, "LOC_")
    assert X.format_author("Xu ,X.L.") == "Xu, X. L."
    assert X.format_author("Perez, Tom J") == "Perez, Tom J."
    assert X.invalid_authors("Smith, A; nobody; Doe, B") == ["nobody"]
    assert X.non_latin("Šmid, ж") == ["ж"]
    assert X.embl_authors("Müller, Anna B.; Xu,;") == "Muller A.B., Xu"


def test_json_kinds(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ('"1"',), ("true",), ("null",), ("99999999999",)], "c string")
    got = [tuple(r) for r in df.select(V.json_kind(F.col("c")), V.fits_type(F.col("c"), "int"), V.fits_type(F.col("c"), "float")).collect()]
    assert got == [("int", True, False), ("float", False, True), ("string", False, False), ("boolean", False, False), ("null", True, True), ("int", False, False)]


def test_terms_change(spark):
    d = date(2024, 1, 1)
    df = spark.createDataFrame([("OPEN", None, "RESTRICTED", date(2024, 5, 1)), ("RESTRICTED", date(2024, 5, 1), "RESTRICTED", date(2024, 6, 1)), ("RESTRICTED", date(2024, 5, 1), "RESTRICTED", date(2026, 6, 1)), ("RESTRICTED", date(2024, 5, 1), "OPEN", None)], "a string, b date, c string, e date")
    got = [r[0] for r in df.select(V.terms_change_error(F.col("a"), F.col("b"), F.col("c"), F.col("e"), F.lit(d))).collect()]
    assert got == ["already_open", "extension", "date_out_of_range", None]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("submissionId\tcountry\tfastaIds\na 1\tKenya\tx y\nb\t\tz z\n")
    got = {r.submission_id: r for r in readers.submission_entries(readers.read_tsv(spark, str(tmp_path / "m.tsv"))).collect()}
    assert got["a 1"].error == "id_with_blank" and got["a 1"].fasta_ids == ["x", "y"] and got["a 1"].metadata == {"country": "Kenya"}
    assert got["b"].error == "fasta_id_repeated" and got["b"].metadata == {}
    (tmp_path / "s.fasta").write_text(">one first\nAC\n\nGT\n>two\nTT\n>three\n")
    fasta = {r.fasta_id: (r.sequence, r.error) for r in readers.read_fasta(spark, str(tmp_path / "s.fasta")).collect()}
    assert fasta == {"one": ("ACGT", None), "two": ("TT", None), "three": ("", "empty_sequence")}
    df = spark.createDataFrame([(1, "AC"), (2, None)], "id int, seq string")
    assert [r.record for r in writers.fasta_records(df, ["id"], "seq").collect()] == [">1\nAC"]
    writers.write_ndjson(spark.createDataFrame([("x", 1), ("y", None)], "d string, n int"), str(tmp_path / "out"), partition_by=["d"])
    assert rows(readers.read_ndjson(spark, str(tmp_path / "out"), "n int, d string")) == [(1, "x"), (None, "y")]
    with pytest.raises(ValueError):
        readers.submission_entries(spark.createDataFrame([("a",)], "country string"))


def test_file_cell(spark):
    df = spark.createDataFrame([("a:b.fq:123e4567-e89b-12d3-a456-426614174000 bad:1",)], "c string")
    a, b = df.select(readers.file_cell(F.col("c"))).first()[0]
    assert (a.name, a.valid, b.valid) == ("a:b.fq", True, False)


def test_stream_takes_what_is_new(spark, tmp_path):
    from helixmill.streaming import poll

    src = str(tmp_path / "in")
    spark.range(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for want in (3, 5):
        q = poll.process_available(poll.new_records(spark, src, schema), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == want
        spark.range(2).write.mode("append").parquet(src)


def test_whole_order_has_the_place_of_every_row(spark):
    rows = [((i * 37) % 501, i % 7) for i in range(501)]
    got = filters.placed(spark.createDataFrame(rows, "a int, b int"), F.desc("b"), "a").collect()
    assert [tuple(r) for r in got] == [(*r, n) for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)]
    assert filters.placed(spark.createDataFrame([], "a int"), "a").count() == 0


def test_whole_orders_and_upserts_take_all_rows(spark, data_root):
    import __spark_entry__ as entry

    def rows(name):
        return entry.queries()[name](spark, data_root).collect()

    def table(name):
        return spark.read.parquet(f"{data_root}/{name}.parquet")

    released = table("sequence_entries").filter("released_at is not null").select("accession", "version").distinct().count()
    for name, n in (("l01_release_order", released), ("l05_multi_key_descending", table("orders").count()), ("l07_depth_order", table("part").count())):
        assert [r.place for r in rows(name)] == list(range(1, n + 1)), name
    for name, of, key in (("t13_upsert", "sequence_entries", ["accession"]), ("r15_metadata_upsert", "sequence_entries_preprocessed_data", ["accession", "version"])):
        got = [tuple(r[k] for k in key) for r in rows(name)]
        assert sorted(got) == sorted(tuple(r) for r in table(of).select(*key).distinct().collect()), name


@pytest.mark.parametrize(
    ("ids", "want"),
    [
        (["sample", "sample_1", "other"], ["sample", "sample_1", "other"]),
        (["sample", "sample", "sample"], ["sample", "sample_1", "sample_2"]),
        (["sample", "sample", "sample_1", "sample"], ["sample", "sample_2", "sample_1", "sample_3"]),
        (["sample", "other", "sample", "other"], ["sample", "other", "sample_1", "other_1"]),
        (["a", "a_2", "a", "a_4", "a", "a_5", "a", "a_3"], ["a", "a_2", "a_1", "a_4", "a_6", "a_5", "a_7", "a_3"]),
        (["a_1", "a_1", "a", "a"], ["a_1", "a_1_1", "a", "a_2"]),
    ],
)
def test_unique_ids_skip_what_stands_in_the_table(spark, ids, want):
    from helixmill.operators.state import unique_ids

    rows = spark.createDataFrame(list(enumerate(ids)), "at int, id string")
    assert [r.unique_id for r in unique_ids(rows, "id", "at").orderBy("at").collect()] == want


def test_external_updates_merge(spark):
    from helixmill.operators.entries import merge_external

    rows = [("k", 1, "a", {"x": "1", "y": "1"}), ("k", 2, "b", {"x": "2"}), ("k", 2, "c", {"x": "3", "z": None}), ("l", 1, "a", {"x": "9"})]
    df = spark.createDataFrame(rows, "id string, at int, updater string, metadata map<string,string>")
    assert {r.id: r.metadata for r in merge_external(df, ["id"], "at", "updater", "metadata").collect()} == {"k": {"x": "3", "y": "1", "z": None}, "l": {"x": "9"}}


def test_insertions_have_place_and_pattern(spark):
    from pyspark.sql import functions as F

    from helixmill.operators import sequences as Q

    rows = [(1, [("main", 5, "AC"), ("main", 9, "ATTC")]), (2, [("main", 9, "GG")]), (3, [("L", 9, "ATTC")]), (4, [])]
    df = spark.createDataFrame(rows, "id int, ins array<struct<segment:string,position:int,sequence:string>>")
    hit = lambda q, seg=None: [r.id for r in df.filter(Q.has_insertion(F.col("ins"), Q.insertion_query(q, seg))).orderBy("id").collect()]
    assert hit("ins_9:A?C") == [1, 3] and hit("ins_9:A?C", "main") == [1] and hit("ins_L:9:?") == [3] and hit("ins_5:A?T") == [] and hit("ins_main:5:AC") == [1]
    assert Q.insertion_query("ins_x") is None


def test_mutations_of_several_segments(spark):
    from pyspark.sql import functions as F

    from helixmill.operators import sequences as Q

    refs = {"L": "ACGT", "S": "TTTT"}
    df = spark.createDataFrame([(1, {"L": "ACGA", "S": "TTTT"}), (2, {"L": "ACGT", "S": "TATT"}), (3, {"L": "NCGA"})], "id int, seqs map<string,string>")
    hit = lambda q, seg=None: [r.id for r in df.filter(Q.mutation_filter(q, F.col("seqs"), refs, seg)).orderBy("id").collect()]
    assert hit("L:4") == [1, 3] and hit("l:T4A, S:2.") == [1] and hit("s:2A") == [2] and hit("4A") == [] and hit("4A", "L") == [1, 3] and hit("M:1A") == []


def test_payloads(spark):
    from pyspark.sql import functions as F

    from helixmill.functions.payloads import elements, json_object, members

    texts = ['{"a":{"x":[1,null,"b",{"c":2}],"y":"one","z":null}}', '"{\\"a\\":{\\"x\\":[]}}"', '"\\"{}\\""', '{"a":', "[1]", "null", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("d", json_object(F.col("t")))
    assert [r.i for r in df.filter("d is not null").orderBy("i").collect()] == [0, 1, 2]
    got = df.filter("i = 0").select(F.explode(members(F.col("d"), "a")).alias("k", "v")).select("k", elements(F.col("v")).alias("e")).collect()
    assert {r.k: r.e for r in got} == {"x": ["1", "b", '{"c":2}'], "y": ["one"], "z": None}
