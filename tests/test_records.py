"""Specifications, preconditions, regrouping and written tables on small cases."""

import os

import pytest
from pyspark.sql import functions as F

from helixmill import session
from helixmill.functions import metadata as M
from helixmill.functions import specification as S
from helixmill.functions import validation as V
from helixmill.operators import changes, counts
from helixmill.sources import readers, writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_joined_parts(spark):
    df = spark.createDataFrame([("Asia", "2022-11", "2020/2021", "a b"), (None, "bad", "1/2/3", None), ("", "2022-01-02", None, "/x/")], "c string, d string, r string, s string")
    r = S.joined([S.Part("string", F.col("c")), S.Part("ACCESSION_VERSION"), S.Part("date", F.col("d")), S.Part("dateRangeString", F.col("r")), S.Part("string", F.col("s"))], F.lit("LOC_1.1"), fallback="none")
    assert [tuple(x) for x in df.select(r.value, r.errors).collect()] == [("Asia/LOC_1.1/2022-11-01/2020_TO_2021/a_b", []), ("none/LOC_1.1/none/none/none", ["unexpected_range"]), ("none/LOC_1.1/2022-01-02/none//x", [])]
    with pytest.raises(ValueError, match="kind"):
        S.joined([S.Part("other", F.col("c"))], F.lit("x"))


def test_display_names(spark):
    data = [("id1", "sub", False), ("a/b/id2/d", "sub", False), ("has blank", "sub", False), ("has blank", "x y", False), ("a/b/id2/d", "sub", True), ("id3", None, True), (None, "sub 1", False)]
    df = spark.createDataFrame(data, "own string, sub string, ingested boolean")
    parts = [S.Part("ARG", "v"), S.Part("IDENTIFIER")]
    r = S.display_name(parts, F.lit("LOC_1.1"), F.col("own"), F.col("sub"), F.col("ingested"), pattern=r"\w+/\w+/(\w+)/\w+")
    assert [tuple(x) for x in df.select(r.value, r.warnings).collect()] == [("v/id1", []), ("v/id2", []), ("v/sub", []), ("v/LOC_1.1", ["identifier_unreadable"]), ("v/LOC_1.1", []), ("v/id3", []), ("v/LOC_1.1", ["identifier_unreadable"])]
    with pytest.raises(ValueError, match="IDENTIFIER"):
        S.display_name([], F.lit("x"), F.col("own"), F.col("sub"), F.col("ingested"))


def test_requirements(spark):
    df = spark.createDataFrame([(None, "x", "y", 1, False), ("v", "", None, 0, False), (None, None, None, 2, True), ("v", None, "y", 2, False)], "a string, b string, c string, files int, ours boolean")
    needs = {"a": S.Needs(required=True), "b": S.Needs(when=("processed.a", "c", "files.raw"))}
    missing = S.missing_requirements(needs, {"a": F.col("a"), "b": F.col("b")}, {"c": F.col("c")}, {"raw": F.col("files")}, F.col("ours"))
    assert [r[0] for r in df.select(missing).collect()] == [["a:required"], ["b:processed.a"], [], ["b:processed.a", "b:c", "b:files.raw"]]
    assert S.specification_errors({"a": S.Needs(True)}, {"a": ["x"]}, []) == []


def test_specification_names_every_function(spark):
    assert {"check_authors", "parse_date_into_range", "assign_custom_lineage", "build_display_name", "joined"} <= set(M.FUNCTIONS)
    df = spark.createDataFrame([("Smith, A B; Doe, C.",), ("nobody",)], "authors string")
    out = M.apply_spec(df, {"people": M.Field("check_authors", ("authors",), required=True)}).select("out_people", "errors").collect()
    assert [tuple(r) for r in out] == [("Smith, A. B.; Doe, C.", []), (None, ["people:invalid:nobody", "people:required"])]


def test_hosts(spark):
    names = spark.createDataFrame([(5, "Cat", 3), (7, "cat", 2), (6, "CAT ", 2), (12, "Dog", 1)], "taxon_id long, name string, depth int")
    hosts = spark.createDataFrame([(" cat", False), ("0012", False), ("99", True), ("bird", False), ("", False), (None, False)], "host string, ingested boolean")
    got = S.resolve_host(hosts, "host", names, ingested="ingested")
    assert {r.host: (r.taxon_id, r.host_error, r.host_warning) for r in got.collect()} == {" cat": (6, False, False), "0012": (12, False, False), "99": (None, False, True), "bird": (None, True, False), "": (None, False, False), None: (None, False, False)}


def test_alignment_and_segments(spark):
    df = spark.createDataFrame([(["L", "S"], ["L"]), (["L"], []), ([], []), (["L"], ["L"])], "g array<string>, a array<string>")
    whole = V.alignment_annotations(F.col("g"), F.col("a"), any_is_enough=False)
    some = V.alignment_annotations(F.col("g"), F.col("a"), any_is_enough=True)
    assert [tuple(r) for r in df.select(*whole, *some).collect()] == [(["S"], [], [], ["S"]), (["L"], [], ["*"], ["L"]), ([], [], [], []), ([], [], [], [])]
    ids = spark.createDataFrame([(["a_l", "a_M", "b_m", "x", "S"],), (["q"],), ([],)], "ids array<string>").select(V.assign_segments(F.col("ids"), ["L", "M", "S"]).alias("r")).select("r.*")
    assert [tuple(r) for r in ids.collect()] == [({"L": "a_l", "S": "S"}, ["M"], ["x"], False), ({}, [], ["q"], True), ({}, [], [], True)]


def test_file_mappings(spark):
    data = [(1, "raw", "a.fq", "f1"), (1, "raw", "a.fq", "f2"), (1, "odd", "b c", "f3"), (1, "raw", None, "f9"), (1, "raw", "x" * 256, "f1"), (2, "raw", "a.fq", "f1")]
    files = spark.createDataFrame(data, "id int, category string, name string, file_id string")
    known = spark.createDataFrame([("f1",), ("f2",), ("f3",), ("f1",)], "file_id string")
    got = rows(V.file_mapping_errors(files, ["id"], ["raw"], known=known))
    assert got == sorted([(1, "raw", "a.fq", "repeated_name"), (1, "odd", "b c", "forbidden_character"), (1, "odd", "b c", "unknown_category"), (1, "raw", None, "empty_name"), (1, "raw", None, "unknown_file"), (1, "raw", "x" * 256, "name_too_long")], key=str)


def test_sets(spark):
    records = spark.createDataFrame([(1, "A", None), (1, "A", 2), (2, "B", 1), (3, "C", 5), (4, None, None)], "s int, acc string, v int")
    sets = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "s int")
    released = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "accession string, version long")
    assert rows(V.set_record_errors(records, sets, released, "s", "acc", "v")) == sorted([(1, "repeated_accession"), (3, "not_released"), (4, "empty"), (5, "empty")], key=str)


def test_ingest_decisions(spark):
    latest = spark.createDataFrame([("a", "A", "1", "APPROVED_FOR_RELEASE", False), ("b", "B", "1", "PROCESSED", False), ("c", "C", "1", "APPROVED_FOR_RELEASE", True), ("d", "D", "1", "APPROVED_FOR_RELEASE", False), ("e", "E", "2", "APPROVED_FOR_RELEASE", False)], "id string, accession string, digest string, status string, curated boolean")
    incoming = spark.createDataFrame([(x, "2") for x in "abcdef"], "id string, digest string")
    muted = spark.createDataFrame([("D", "2"), ("D", "2")], "accession string, digest string")
    assert dict(rows(changes.decide_ingest(incoming, latest, muted, "id", "digest"))) == {"a": "revise", "b": "blocked:PROCESSED", "c": "blocked:CURATION_ISSUE", "d": "noop", "e": "noop", "f": "submit"}
    assert {d for _, d in rows(changes.decide_ingest(incoming, latest, muted, "id", "digest", fraction=0.0))} == {"sampled_out"}


def test_regrouping(spark):
    new = spark.createDataFrame([("n1", "a"), ("n1", "b"), ("n2", "c"), ("n2", "x"), ("n3", "y"), ("n4", "d"), ("n5", "e"), ("n5", "f")], "g string, m string")
    old = spark.createDataFrame([("a", "o1"), ("b", "o1"), ("c", "o2"), ("d", "o3"), ("z", "o3"), ("e", "o4"), ("f", "o5")], "m string, old_group string")
    assert dict(rows(changes.decide_regrouping(new, old, "g", "m"))) == {"n1": "same", "n2": "grown", "n3": "submit", "n4": "regrouped", "n5": "regrouped"}


def test_override_groups(spark):
    data = [("f1", "g", "a"), ("f1", "g", "b"), ("f2", "g", "b"), ("f2", "g", "a"), ("f2", "same", "a"), ("f2", "same", "b"), ("f1", "h", "c"), ("f2", "h", "d"), ("f1", "i", "e"), ("f1", "i", "k"), ("f2", "j", "e")]
    got = {g: s for g, _, s in rows(changes.merge_group_overrides(spark.createDataFrame(data, "f string, g string, m string"), "f", "g", "m"))}
    assert got == {"g": "ok", "same": "ok", "h": "conflicting_definition", "i": "shared_members", "j": "shared_members"}


def test_natural_order(spark):
    values = ["b2", "B10", "b1", "a", "b02x", "10", "9"]
    df = spark.createDataFrame([(v,) for v in values], "v string").orderBy(counts.natural_key(F.col("v")))
    assert [r.v for r in df.collect()] == ["9", "10", "a", "b1", "b2", "b02x", "B10"]


def test_written_tables(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "quoted\\ name', {"x": "1", "y": None}), (1, "b", {"x": None, "y": None})], "id int, name string, data map<string,string>")
    writers.write_tsv(df.select("id", F.replace("name", F.lit("\\"), F.lit("/")).alias("name")), str(tmp_path / "t"))
    assert rows(readers.read_tsv(spark, str(tmp_path / "t"), quoted=False)) == [("1", "b"), ("2", 'a "quoted/ name')]
    writers.write_stripped(df, str(tmp_path / "s"), "data")
    assert {r.id: r.data for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {2: '{"x":"1"}', 1: "{}"}
    with pytest.raises(ValueError, match="metadata names"):
        before, writers.MAX_NAMES = writers.MAX_NAMES, 1
        try:
            writers.metadata_keys(df, "data")
        finally:
            writers.MAX_NAMES = before


def test_flat_file(spark):
    feature = F.array(F.struct(F.lit("CDS").alias("kind"), F.lit(1).alias("begin"), F.lit(9).alias("end"), F.lit("NP").alias("gene")))
    df = spark.createDataFrame([("A", 1, "text", "ACGT" * 20, "Doe J.", "Kenya"), ("B", 2, "text", "", "", "")], "a string, v int, d string, s string, p string, c string")
    got = [r[0] for r in df.select(writers.flat_file(F.col("a"), F.col("v"), F.col("d"), F.col("s"), authors=F.col("p"), country=F.col("c"), features=feature)).collect()]
    assert got[0].split("\n") == ["ID   A; SV 1; 80 BP.", "DE   text", "RA   Doe J.;", "FT   source          1..80", 'FT                   /country="Kenya"', "FT   CDS             1..9", 'FT                   /gene="NP"', "SQ   Sequence 80 BP;", "     " + "acgt" * 15, "     " + "acgt" * 5, "//"]
    assert got[1].split("\n")[-2:] == ["SQ   Sequence 0 BP;", "//"]


def test_checkpoint_folder(spark):
    assert session.scratch_folder(spark) != session.scratch_folder(spark)

    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Elsewhere)
    assert os.environ.get("PYTHONPATH")


def test_json_text_equals_the_json_writer(spark):
    import json

    from helixmill.functions import text as X

    texts = ["plain", 'a "quote" \\ back', "line\nend\r\ttab", "é ß 中 🦠 \x01 \x7f", "", "~ [x]"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.json_text(F.col("t"))).collect()]
    assert got == [json.dumps(t) for t in texts]


def test_numbered_rows_and_requirements(spark):
    from helixmill.operators import filters

    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert rows(filters.numbered(df, "k", "v")) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1), ("b", 5, 2)]
    assert filters.numbered(df.limit(0), "k", "v").count() == 0
    assert filters.require(df, F.col("v") > 0, "small").count() == 5
    with pytest.raises(Exception, match="too small"):
        filters.require(df, F.col("v") > 1, "too small").collect()


def test_file_cells(spark):
    one = "6a51fc55-ef0e-80ea-1111-0123456789ab"
    cells = [f"a.fq:{one} b:c.fq:{one}", f"a.fq:{one} a.fq:{one}", "a.fq:no", f":{one}", "  ", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(readers.file_cell_error(F.col("c"))).collect()]
    assert got == [None, "repeated_name", "invalid_file", "invalid_file", None, None]


def test_snapshots_and_shared_records(spark):
    from helixmill.operators import state

    good = spark.createDataFrame([(1,), (2,)], "k int")
    worse = spark.createDataFrame([(1,), (1,)], "k int")
    assert rows(state.refreshed(good, worse, ["k"], 2)) == [(1,), (2,)] and rows(state.refreshed(worse, good, ["k"], 2)) == [(1,), (2,)] and rows(state.refreshed(good, worse, ["k"], 3)) == [(1,), (1,)]
    existing = spark.createDataFrame([("a", 4), ("b", 7)], "acc string, id long")
    asked = spark.createDataFrame([(1, "a"), (1, "c"), (2, "c"), (2, "d")], "s int, acc string")
    new, links = state.shared_records(existing, asked, ["acc"], "id")
    assert rows(new) == [("c", 8), ("d", 9)] and rows(links.select("s", "acc", "id")) == [(1, "a", 4), (1, "c", 8), (2, "c", 8), (2, "d", 9)]
    assert rows(state.shared_records(existing.limit(0), asked, ["acc"], "id")[0]) == [("a", 1), ("c", 2), ("d", 3)]


def test_set_updates_and_addresses(spark):
    from helixmill.functions import text as X

    df = spark.createDataFrame([("n", "n", "t", "t"), ("n", "m", "t", "t"), ("n", " ", "t", "u"), (None, "n", None, None)], "a string, b string, c string, d string")
    got = [r[0] for r in df.select(V.set_update_error(F.col("b"), {"name": (F.col("a"), F.col("b")), "text": (F.col("c"), F.col("d"))})).collect()]
    assert got == ["nothing_changed", None, "blank_name", None]
    with pytest.raises(ValueError, match="mode"):
        X.file_url("x", F.lit("a"), F.lit(1), "raw", F.lit("n"), mode="other")
    with pytest.raises(ValueError, match="id"):
        X.file_url("x", F.lit("a"), F.lit(1), "raw", F.lit("n"), mode="storage")
