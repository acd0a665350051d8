import random

import pytest

from helixmill.llm.address_match import PASSES, institution_key, match_addresses, parse_record, place_classes, place_pairs, same_place, sorted_neighbours
from helixmill.llm.components import connected_components

COLUMNS = {"key": "group_id", "institution": "inst", "line1": "l1", "line2": "l2", "postal": "zip", "city": "city", "country": "land"}
SCHEMA = "group_id int, inst string, l1 string, l2 string, zip string, city string, land string, id string"


def pairs(spark, data):
    df = spark.createDataFrame([(*r, "x") for r in data], SCHEMA)
    return {tuple(r) for r in place_pairs(match_addresses(df, **COLUMNS)).collect()}


@pytest.mark.parametrize(
    ("record", "want"),
    [
        (("Dabon Vet. Inst.", "159 Bridge Ln., Rukiva", None, "11601", "-", "USA"), ("rukiva", "11601", "159", "bridge", "lane", "dabon", "institute veterinary")),
        (("Inst of Virology, Dabon", "Bobad Cad. No: 18b", None, "00000", "Nuti 7", "TR"), ("nuti", "", "18b", "bobad", "caddesi", "dabon", "institute virology")),
        (("Dabon PH Laboratory", "80 R. de Hofit", None, "", "10742 Peze", "France"), ("peze", "10742", "80", "hofit", "rue", "dabon", "health laboratory public")),
        (("X Research Centre", "Main entrance", "Meadow Ave., No. 193", None, "Munu, Kenya", "Kenya"), ("munu", "", "193", "meadow", "avenue", "x", "centre research")),
        (("X Research Centre", "Zusisipel-Str. 11", None, None, "Debo", None), ("debo", "", "11", "zusisipel", "street", "x", "centre research")),
        ((None, None, None, None, None, None), ("", "", "", "", "", "", "")),
    ],
)
def test_parse(record, want):
    assert parse_record(*record) == want


def test_institution_words_in_any_order():
    assert institution_key("Virology Institute Bogaz") == institution_key("INST. OF VIROLOGY, BOGAZ")


def test_cases(spark):
    data = [
        (1, "Alpha Research Centre", "12 Bridge Street", None, "10061", "Munusehul", "Kenya"),
        (2, "Beta Institute of Virology", "Bridge Str., No. 12", "3rd floor", "10061", "Münusehul", "KE"),
        (3, "Alpha Research Centre", "12 Brigde Street", None, "00000", "Munusheul", "Kenya"),
        (4, "Alpha Research Centre", "12a Bridge Street", None, "10061", "Munusehul", "Kenya"),
        (5, "Gamma Research Centre", "12 Bridge Lane", None, "10061", "Munusehul", "Kenya"),
        (6, "Gamma Research Centre", "P.O. Box", None, "10061", "Munusehul", "Kenya"),
        (7, "Alpha Research Centre", "Bridge Street", None, "10061", "Munusehul", "Kenya"),
        (8, "Alpha Research Centre", "12 Bridge Street", None, "10299", "Nerobakam", "Kenya"),
        (9, None, None, None, None, None, None),
        (1, "Alpha Research Centre", "12 Bridge Street", None, "10061", "Munusehul", "Kenya"),
    ]
    got = pairs(spark, data)
    # 7 lacks a number and its institution has two buildings in the street, so it joins none of them
    assert got == {(1, 2), (1, 3), (2, 3), (5, 6)}


def test_a_building_with_many_spellings_does_not_hide_another(spark):
    street = "aldermeadow"
    spellings = [street, *(street[:k] + "x" + street[k + 1 :] for k in range(2, 10)), *(street[:k] + "q" + street[k + 1 :] for k in range(2, 10))]
    data = [(i, "Alpha Research Centre", f"11 {w} Street", None, "10061", "Munusehul", "Kenya") for i, w in enumerate(spellings)]
    # buildings elsewhere, which end each sort order
    data += [(200 + i, "Zeta Research Centre", f"{9901 + i} Zzulvz Street", None, "99999", "Zzorok", "Kenya") for i in range(15)]
    weak = (98, "Alpha Research Centre", "P.O. Box", None, "10061", "Munusehul", "Kenya")
    building = {(a, b) for a in range(len(spellings)) for b in range(a + 1, len(spellings))}
    assert pairs(spark, [*data, weak]) == building | {(i, 98) for i in range(len(spellings))}
    other = (99, "Alpha Research Centre", "95 Zelkovay Lane", None, "10061", "Munusehul", "Kenya")
    assert pairs(spark, [*data, weak, other]) == building


def test_empty(spark):
    assert pairs(spark, []) == set()


def test_windows_find_what_all_pairs_find(spark):
    rng = random.Random(5)
    streets = ["bridgeview", "castlegate", "meadowpark", "harbourside"]
    rows = []
    for i in range(160):
        s = list(rng.choice(streets))
        if rng.random() < 0.4:
            k = rng.randrange(1, len(s) - 1)
            s[k], s[k + 1] = s[k + 1], s[k]
        rows.append((i, f"city{rng.randrange(2)}", str(10000 + rng.randrange(2)), str(rng.randrange(1, 12)), "".join(s), "lane", f"inst{rng.randrange(9)}x", "centre research"))
    cols = ["id", "city", "postal", "number", "street", "kind", "inst", "inst_kind"]
    dicts = [dict(zip(cols, r, strict=True)) for r in rows]
    want = {(a["id"], b["id"]) for i, a in enumerate(dicts) for b in dicts[i + 1 :] if same_place(a, b) == "full"}
    df = spark.createDataFrame(rows, "id long, city string, postal string, number string, street string, kind string, inst string, inst_kind string").selectExpr("*", "reverse(street) as rstreet", "reverse(inst) as rinst")
    got = {(r.a, r.b) for r in sorted_neighbours(df, PASSES).collect() if r.how == "full"}
    assert got <= want
    assert len(got) >= 0.97 * len(want)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100


def test_countries_keep_equal_codes_apart(spark):
    data = [
        (1, "Alpha Research Centre", "12 Main Street", None, "12345", "Springfield", "USA"),
        (2, "Alpha Research Centre", "12 Main Street", None, "12345", "Lyon", "France"),
        (3, "Beta Clinic", "Main St. 12", None, "12345", "Springfeild", "United States"),
        (4, "Beta Clinic", "12, Main Street", None, "12345", "-", "FR"),
        (5, "Beta Clinic", "12 Main Street", None, "12345", "Springfield", None),
    ]
    assert pairs(spark, data) == {(1, 3), (1, 5), (3, 5), (2, 4)}


def test_towns_of_one_code_stay_apart(spark):
    towns = [(10 + i, "X Clinic", f"{20 + i} Hill Road", None, "54321", town, "Kenya") for i, town in enumerate(["Northam"] * 4 + ["Southwell"] * 4)]
    data = [(1, "Alpha Clinic", "5 Mill Lane", None, "54321", "Northam", "Kenya"), (2, "Beta Clinic", "5 Mill Ln.", None, "54321", "Southwell", "Kenya"), (3, "Beta Clinic", "5 Mill Lane", None, "54321", "Nortahm", "Kenya")]
    assert pairs(spark, data + towns) == {(1, 3)}


def test_a_city_of_several_codes(spark):
    data = [
        (1, "Alpha Clinic", "5 Mill Lane", None, "10001", "Bigcity", "Kenya"),
        (2, "Beta Clinic", "5 Mill Lane", None, "10002", "Bigcity", "Kenya"),
        (3, "Gamma Clinic", "77 Oak Road", None, "10002", "Bigcity", "Kenya"),
        (4, "Gamma Clinic", "77 Oka Road", None, None, "Bigcity", "Kenya"),
    ]
    assert pairs(spark, data) == {(3, 4)}


def test_windows_grow_while_code_number_and_kind_agree(spark):
    rng = random.Random(3)
    streets = sorted({"".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(400)})
    a, b = "qbcdefghi", "bqcdefghz"  # apart from either end
    data = [(i, "X Clinic", f"7 {s} Street", None, "10001", "Bigcity", "Kenya") for i, s in enumerate([a, b, *streets])]
    assert (0, 1) in pairs(spark, data)


@pytest.mark.parametrize("parts", [1, 3, 7, 40])
def test_borders_of_any_partitions(spark, parts):
    streets = [f"{'abcdefghijklmnop'[i // 4]}street{'wxyz'[i % 4]}" for i in range(64)]
    rows = [(i, "c", "1", "5", s, "lane", "", "") for i, s in enumerate(streets)]
    df = spark.createDataFrame(rows, "id long, city string, postal string, number string, street string, kind string, inst string, inst_kind string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r.a, r.b) for r in sorted_neighbours(df, ((["street"], 0),), window=5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {(a, b) for a in range(64) for b in range(a + 1, min(a + 6, 64)) if a // 4 == b // 4 or sum(x != y for x, y in zip(streets[a], streets[b])) <= 2}


def test_classes_count_links(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (7, 7)], "id long, place long")
    assert {tuple(r) for r in place_classes(df).collect()} == {(1, 5, 2), (2, 5, 2), (3, 5, 2), (7, 7, 0)}
