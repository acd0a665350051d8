import pytest
from pyspark.sql import functions as F

from helixmill.operators.packed_fields import split_packed, split_value

PERSON = [
    ("Smith, J.; Doe, Anna B.", ["Smith, J.", "Doe, Anna B."]),
    ("Smith, J.;; ;Doe, A.;", ["Smith, J.", "Doe, A."]),
    ("Smith, J., Doe, A., van der Berg, C.", ["Smith, J.", "Doe, A.", "van der Berg, C."]),
    ("Anna Doe, John Smith and Carl Berg", ["Anna Doe", "John Smith", "Carl Berg"]),
    ("Smith, J.; Doe, A.; and Berg, C.", ["Smith, J.", "Doe, A.", "Berg, C."]),
    ("Smith, J. & Doe, A.", ["Smith, J.", "Doe, A."]),
    ('"Smith, J.", "Doe, A."', ["Smith, J.", "Doe, A."]),
    ('["Smith, J.", "Doe, A."]', ["Smith, J.", "Doe, A."]),
    ('Smith, Nikolai ""Kolya""; Doe, A.', ['Smith, Nikolai ""Kolya""', "Doe, A."]),
    ('"Smith, Nikolai ""Kolya"""; "Doe, A."', ['Smith, Nikolai "Kolya"', "Doe, A."]),
    ('Smith, J.; "Working Group on Viruses; Panel 2"', ["Smith, J.", "Working Group on Viruses; Panel 2"]),
    ("Institute for Tick and Flea Research", ["Institute for Tick and Flea Research"]),
    ("Field Team, Lower River; Smith, J.", ["Field Team, Lower River", "Smith, J."]),
    ("Smith, J. | Doe, A. / Berg, C.; Lee, D.", ["Smith, J.", "Doe, A.", "Berg, C.", "Lee, D."]),
    ("Smith, J.\r\nDoe, A.", ["Smith, J.", "Doe, A."]),
    ("Smith, J.", ["Smith, J."]),
    (None, []),
    ("", []),
    (" ; , ", []),
]
IDS = [
    ("a1_L a1_M  a1_S", ["a1_L", "a1_M", "a1_S"]),
    ("a1_L,,a1_M,", ["a1_L", "a1_M"]),
    ("'tick pool 7_L';'tick pool 8_M'", ["tick pool 7_L", "tick pool 8_M"]),
    ('"lot 1_L" "lot 2_M"', ["lot 1_L", "lot 2_M"]),
    ("Z1.1.L/Z2.1.M_L|Z1.1.L/Z2.1.M_M", ["Z1.1.L/Z2.1.M_L", "Z1.1.L/Z2.1.M_M"]),
    ('["a1:L@3"]', ["a1:L@3"]),
    ("a1_M", ["a1_M"]),
    ("   ", []),
]


@pytest.mark.parametrize(("text", "items"), PERSON)
def test_person_lists(text, items):
    assert split_value(text, "person")[1] == items


@pytest.mark.parametrize(("text", "items"), IDS)
def test_id_lists(text, items):
    assert split_value(text, "id")[1] == items


def test_very_long_list():
    many = "; ".join(f"Name{chr(97 + i % 26)}x, A." for i in range(5000))
    assert len(split_value(many, "person")[1]) == 5000


def test_operator_keeps_columns_and_places(spark):
    rows = spark.createDataFrame([("r1", "Smith, J.; Doe, A.", "s", 1), ("r2", None, None, 2), ("r3", " ", "s", 3)], "id string, authors string, source string, item_count int")
    got = split_packed(rows, value="authors", source=F.col("source"), kind="person").select("id", "item_count", "pos", "item").collect()
    assert sorted(map(tuple, got)) == [("r1", 1, 1, "Smith, J."), ("r1", 1, 2, "Doe, A.")]


def test_empty_table(spark):
    rows = spark.createDataFrame([], "id string, authors string, source string")
    assert split_packed(rows, value="authors", source=F.col("source"), kind="person").count() == 0


def test_the_source_decides_where_values_alone_do_not(spark):
    lists = ["ab1/CD2", "ab5", "CD9", "ab1/CD3/ab4", "CD8/ab2/ab7"]
    whole = ["ab1/CD2", "ab3/CD4", "ab5/CD6"]
    rows = [(f"l{k}", v, "lists") for k, v in enumerate(lists)] + [(f"w{k}", v, "whole") for k, v in enumerate(whole)]
    got = split_packed(spark.createDataFrame(rows, "id string, ids string, source string"), value="ids", source=F.col("source"), kind="id").collect()
    items = {}
    for r in sorted(got, key=lambda r: r.pos):
        items.setdefault(r.id, []).append(r.item)
    assert items == {f"l{k}": v.split("/") for k, v in enumerate(lists)} | {f"w{k}": [v] for k, v in enumerate(whole)}


def test_names_of_columns_may_clash_and_sources_may_be_null(spark):
    rows = spark.createDataFrame([("x", None, "Smith, J.; Doe, A.", [1]), ("x", None, "Smith, J.; Doe, A.", [1])], "item string, source string, authors string, pos array<int>")
    got = split_packed(rows.withColumnsRenamed({"item": "item_of_row", "pos": "pos_of_row"}), value="authors", source=F.col("source"), kind="person")
    assert got.count() == 4
