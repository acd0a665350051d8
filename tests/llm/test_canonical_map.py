import random

import pytest

from helixmill.llm import lexicon
from helixmill.llm.canonical_map import UNMATCHED, NameIndex, decide, fold, map_to_canonical, osa


def test_distance_counts_transpositions():
    assert osa("abcd", "abdc", 3) == 1
    assert osa("abc", "", 3) == 3
    assert osa("abcdef", "uvwxyz", 2) == 3
    assert fold("Côte d’Ivoire & Ålesund ") == "cote divoire and alesund"


def test_distance_equals_the_full_table():
    def full(a, b):
        t = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
        return t[-1][-1]

    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        for most in (0, 1, 2, 3, 5):
            assert osa(a, b, most) == min(full(a, b), most + 1)


def test_no_candidate_is_left_out():
    # many names of one entry are closer than the only name of the other, and none of them fits
    names = [(1, f"carbonara{c}{d}xyz") for c in "abcdefgh" for d in "abcdefgh"] + [(2, "carbonarum")]
    assert NameIndex(names).best("carbonarun")[0] == 2


def test_lists_beyond_the_limit_are_refused_unread(spark, monkeypatch):
    from helixmill.llm import canonical_map

    rows = spark.range(5)
    assert len(canonical_map.reference_rows(rows)) == 5
    monkeypatch.setattr(canonical_map, "MAX_NAMES", 4)
    with pytest.raises(ValueError, match="at most"):
        canonical_map.reference_rows(rows)


def test_margin_and_threshold():
    index = NameIndex([(1, "Niger"), (2, "Nigeria"), (3, "Republic of Kenya"), (4, "Republic of Korea")], generic=("republic", "of"))
    assert index.best("Nigeria")[0] == 2
    assert index.best("Nigre")[0] == 1
    assert index.best("Republic of Kenia")[0] == 3
    assert index.best("Republic of Zonotigan")[0] == UNMATCHED
    assert index.best("")[0] == UNMATCHED


@pytest.fixture(scope="module")
def countries(spark):
    names = ["Niger", "Nigeria", "Georgia", "USA", "Cote d'Ivoire", "Germany", "Republic of the Congo", "Democratic Republic of the Congo", "Dominica", "Dominican Republic", "Pakistan", "Iran", "Myanmar", "Ireland", "Belarus"]
    return {n: i for i, n in enumerate(names)}, lexicon.country_index(spark, [(i, n) for i, n in enumerate(names)])


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Germany", "Germany"), ("DEU", "Germany"), ("Allemagne: Bavaria", "Germany"), ("gERMANY.", "Germany"), ("Gemrany (Ulm)", "Germany"), ("Ulm, Federal Republic of Germany", "Germany"), ('"Deutschland"', "Germany"),
        ("Georgia, USA", "USA"), ("Republic of Georgia", "Georgia"), ("Elfenbeinküste", "Cote d'Ivoire"), ("Burma", "Myanmar"), ("Byelorussia", "Belarus"), ("Congo-Kinshasa", "Democratic Republic of the Congo"), ("Republic of teh Congo", "Republic of the Congo"),
        ("Dominicana", None), ("Dominican Republc", "Dominican Republic"), ("Balochistan (Pakistan), near Iran border", "Pakistan"), ("Congo", None), ("Niger or Nigeria", None), ("Iceland", None), ("Europe", None), ("Zonotigan", None), ("Kingdom of Zonotigan", None), ("??", None),
    ],
)
def test_countries(countries, value, want):
    ids, index = countries
    got = decide(value, index, lexicon.country_parts)[0]
    assert got == (UNMATCHED if want is None else ids[want]) or (value == "Dominicana" and got in (UNMATCHED, ids["Dominican Republic"], ids["Dominica"]))


HOSTS = [(710013, "Homo sapiens", "human"), (710027, "Bos taurus", "cattle"), (710043, "Bos indicus", "zebu"), (710340, "Hyalomma marginatum", "Mediterranean tick"), (710482, "Culex quinquefasciatus", "southern house mosquito"), (710286, "Meleagris gallopavo", "turkey")]


@pytest.mark.parametrize(
    ("value", "want"),
    [("Homo sapiens", 710013), ("Hono spaiens (female)", 710013), ("710027.0", 710027), ("txid710027", 710027), ("B. taurus, adult", 710027), ("Bos taurus indicus; blood", 710043), ("Rind", 710027), ("H. marginatum - pooled", 710340), ("cattle [Bos taurus], age 3", 710027), ("Culex pipiens quinquefasciatus", 710482), ("TURKEY", 710286), ("Hyalomma sp.", -1), ("tick", -1), ("cow or goat (unclear)", -1), ("elephant", -1), ("Bos_taurus", 710027)],
)
def test_hosts(value, want):
    assert decide(value, lexicon.host_index(HOSTS), lexicon.host_parts)[0] == want


def test_operator(spark):
    rows = spark.createDataFrame([("cow", 1), ("cow", 2), (None, 3), ("  ", 4), ("nothing", 5)], "value string, ref_key int")
    got = {r.value: r.ref_id for r in map_to_canonical(rows, value="value", index=lexicon.host_index(HOSTS), parts=lexicon.host_parts).collect()}
    assert got == {"cow": 710027, "nothing": UNMATCHED}
    assert map_to_canonical(rows.limit(0), value="value", index=lexicon.host_index(HOSTS), parts=lexicon.host_parts).count() == 0
