from pyspark.sql import functions as F

from helixmill.functions import aligner as A
from helixmill.functions import text as X
from helixmill.functions import validation as V
from helixmill.operators import entries, sequences, state
from helixmill.sources import readers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_aligner_texts(spark):
    shifts = '[{"cdsName":"S","codon":{"begin":4,"end":6},"nucAbs":[{"begin":12,"end":18},{"begin":20,"end":21}]}]'
    assert one(spark, A.frame_shifts(F.col("j")), j=shifts) == "S:5-6(nt:13-18;21)"
    assert one(spark, A.frame_shifts(F.col("j")), j="[]") == ""
    assert one(spark, A.stop_codons(F.col("j")), j='[{"cdsName":"N","codon":9},{"cdsName":"M","codon":0}]') == "N:10,M:1"
    assert one(spark, A.phenotype(F.col("j"), "b"), j='[{"name":"a","value":1},{"name":"b","value":2.5},{"name":"b","value":3}]') == "2.5"
    assert one(spark, A.phenotype(F.col("j"), "z"), j='[{"name":"a","value":1}]') is None
    assert one(spark, A.dotted(F.col("j"), "a.b.*.c"), j='{"a":{"b":{"x":1}}}') == '{"x":1}'
    assert one(spark, A.dotted(F.col("j"), "a.q", missing_as_text=True), j='{"a":{}}') == "None"
    assert one(spark, A.known_gene_insertions(F.col("c"), ["S"]), c="S:1:A, X:2:C,,S:3:G") == ["S:1:A", "S:3:G"]


def test_text_helpers(spark):
    import hashlib
    import json

    want = hashlib.md5((json.dumps({"a": 'x"y', "b": "z"}, sort_keys=True) + "h").encode()).hexdigest()
    df = spark.createDataFrame([('x"y', "z", "", "h")], "a string, b string, c string, s string")
    assert df.select(X.content_hash({"b": F.col("b"), "a": F.col("a"), "c": F.col("c")}, F.col("s"))).first()[0] == want
    assert one(spark, X.file_url("/f", F.lit("A"), F.lit(2), "raw", F.col("n")), n="a b/ü.fq") == "/f/A/2/raw/a%20b%2F%C3%BC.fq"
    assert [one(spark, c, v="Kenya: Rift:x") for c in X.split_compound(F.col("v"))] == ["Kenya", "Rift:x"]
    assert one(spark, X.version_of(F.col("v")), v="A.0") is None and one(spark, X.version_of(F.col("v")), v="A.12") == 12


def test_validation_helpers(spark):
    assert one(spark, V.segment_of(F.col("h"), ["L", "M"]), h="sample_1_m") == "M"
    assert one(spark, V.segment_of(F.col("h"), ["L", "M"]), h="l") == "L"
    assert one(spark, V.segment_of(F.col("h"), ["L", "M"]), h="sample_x") is None
    assert one(spark, V.alignment_problem(F.col("g"), F.col("a")), g=2, a=0) == "none_aligned"
    assert one(spark, V.alignment_problem(F.col("g"), F.col("a")), g=2, a=1) == "some_unaligned"
    assert one(spark, V.alignment_problem(F.col("g"), F.col("a")), g=2, a=2) is None


def test_joint_metadata(spark):
    df = spark.createDataFrame([(False, {"a": "1", "b": "2"}, {"b": "9"}), (False, {"a": "1"}, None), (True, {"a": "1"}, None), (False, None, {"x": "y"})], "r boolean, m map<string,string>, e map<string,string>")
    got = [r[0] for r in df.select(entries.joint_metadata(F.col("r"), F.col("m"), F.col("e"))).collect()]
    assert got == [{"a": "1", "b": "9"}, {"a": "1"}, {}, None]


def test_state(spark):
    e = spark.createDataFrame([("a", 1, "o", False), ("b", 1, "o", False), ("c", 1, "o", True)], "accession string, version int, organism string, is_revocation boolean")
    p = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 3)], "accession string, version int, pipeline_version int")
    assert [r.accession for r in state.claim(e, p, pipeline_version=1, at="2025-01-01 00:00:00", limit=5).collect()] == ["b"]
    current = spark.createDataFrame([("o", 3)], "organism string, current int")
    assert sorted(r.pipeline_version for r in state.keep_recent_pipelines(e, p, current).collect()) == [2, 3]
    items = spark.createDataFrame([(1, True), (2, False), (3, False)], "k int, marked boolean")
    got = {r.k: r.action for r in state.collect_unused(items, items.filter("k = 3"), "k", F.col("marked")).collect()}
    assert got == {1: "delete", 2: "mark"}


def test_insertions_and_lists(spark):
    df = spark.createDataFrame([("5:AC",), ("5:AC",), ("7:G",)], "i string")
    assert sorted(map(tuple, sequences.insertion_counts(df, "i").collect())) == [(5, "AC", 2), (7, "G", 1)]
    df = spark.createDataFrame([("ACGT",), ("AGGT",)], "s string")
    assert [r.s for r in df.filter(sequences.all_mutations("C2G, ?, 4.", F.col("s"), F.lit("ACGT"))).collect()] == ["AGGT"]


def test_dump_fields(spark):
    df = spark.createDataFrame([("7\t|\tname one\t|\t\t|",)], "value string")
    assert tuple(df.select(*readers.dump_fields(F.col("value"), ["id", "name", "rest"])).first()) == ("7", "name one", None)


def test_zip_and_gzip(spark, tmp_path):
    import gzip
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.tsv", "id\tx\r\na\t1\n")
    assert [r.value for r in readers.read_zipped_lines(spark, str(tmp_path / "a.zip")).collect()] == ["id\tx", "a\t1"]
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as f:
        f.write('id\tx\na\t"q\n')
    assert [tuple(r) for r in readers.read_tsv(spark, str(tmp_path / "m.tsv.gz"), quoted=False).collect()] == [("a", '"q')]


def test_archive(spark, tmp_path):
    from helixmill.sources import writers

    df = spark.createDataFrame([(k, {"c": f"v{k}"}, "AC") for k in range(510)], "id int, m map<string,string>, seq string")
    writers.write_archive(df, str(tmp_path / "out"), ["id"], "m", "seq", ["id"])
    assert spark.read.text(str(tmp_path / "out" / "metadata")).count() == writers.ARCHIVE_ENTRIES
    assert spark.read.text(str(tmp_path / "out" / "sequences")).count() == 2 * writers.ARCHIVE_ENTRIES


def test_unique_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "n string, o int")
    assert sorted(r.unique_id for r in state.unique_ids(df, "n", "o").collect()) == ["a", "a_1", "b"]


def test_windowed_stream(spark, tmp_path):
    from datetime import datetime

    from helixmill.streaming import poll

    src = str(tmp_path / "ev")
    spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "a") for m in (1, 2, 40)] + [(datetime(2024, 1, 2), "a")], "ts timestamp, kind string").write.parquet(src)
    stream = poll.windowed_counts(poll.new_records(spark, src, spark.read.parquet(src).schema), "ts", "kind", "30 minutes", "10 minutes")
    poll.process_available(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(90)
    got = {r.start.minute: r.n for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {0: 2, 30: 1}
