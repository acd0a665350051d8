import random

import pytest

from helixmill.llm.canonical_map import osa
from helixmill.llm import name_variants
from helixmill.llm.name_variants import Trie, index_shards, organisation_variants, parse_organisation, parse_person, name_classes, person_nodes, person_variants, query_shards, same_given, same_person, trie_join


def mutate(rng, w):
    k, kind = rng.randrange(len(w)), rng.randrange(4)
    if kind == 0:
        return w[:k] + w[k + 1 :]
    if kind == 1:
        return w[:k] + rng.choice("abc") + w[k:]
    if kind == 2:
        return w[:k] + rng.choice("abc") + w[k + 1 :]
    return w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]


def test_automaton_equals_distance():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(4, 9))) for _ in range(300)]
    trie = Trie(words)
    for q in words[:60]:
        assert dict(trie.near(q, 2)) == {w: osa(q, w, 2) for w in words if osa(q, w, 2) <= 2}


def test_shards_lose_no_pair_within_one_error():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 11)))
        b = mutate(rng, a)
        if b != a and len(b) >= 4:
            assert set(index_shards(a)) & set(query_shards(b))


def test_trie_join(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 8))) for _ in range(150)}
    words |= {mutate(rng, w) for w in words}
    words = sorted(w for w in words if len(w) >= 4)
    got = {tuple(r) for r in trie_join(spark.createDataFrame([(w,) for w in words], "key string")).collect()}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if osa(a, b, 1) <= 1}


GIVEN = {"anna", "zoltan", "andrew", "emre"}


@pytest.mark.parametrize(
    ("name", "own", "given", "middle"),
    [
        ("Netiviros, Alexander S.", "netiviros", "alexander", ["s"]),
        ("Netiviros, A.S.", "netiviros", "a", ["s"]),
        ("Dr. Zoltan Netiviros", "netiviros", "zoltan", []),
        ("Netiviros  Emre L.", "netiviros", "emre", ["l"]),
        ("Hogakefek XN", "hogakefek", "x", ["n"]),
        ("A. T. O'Mofafitet", "o##mofafitet", "a", ["t"]),
        ("O Mofafitet, Andrew T.", "o##mofafitet", "andrew", ["t"]),
        ("van der Defifuge, M.", "vanderdefifuge", "m", []),
        ("Defifuge, M. van der", "vanderdefifuge", "m", []),
        ("Anna, Netiviros", "netiviros", "anna", []),
        ("Rusudolum, Mat.", "rusudolum", "mat.", []),
        ("samufoje, d.", "samufoje", "d", []),
    ],
)
def test_parse_person(name, own, given, middle):
    keys, g, m, _ = parse_person(name, GIVEN)
    assert (keys[0], g, m) == (own, given, middle)


def test_given_names():
    assert same_given("charles", "chuck") and same_given("c", "chuck") and same_given("cha.", "charles")
    assert same_given("jontahan", "jonathan") and not same_given("anna", "zoltan") and not same_given("a", "zoltan")
    assert same_person(("anna", "", ""), ("anna", "b", "")) and not same_person(("anna", "c", ""), ("anna", "b", ""))
    assert same_person(("olga", "", "olya"), ("olya", "", ""))


def test_person_variants(spark):
    names = ["Kodobohot, Charles S.", "Kodobohot, C. S.", "Chuck Kodobohot", "Kodobohto, Cha.", "Kodobohot, Yusuf", "KODOBOHOT, Yusuf", "D'Kodobohot, C.", "Other, Yusuf", "Third, Charles", "Fourth, Chuck", "Fifth, Chuck", "Sixth, Chuck", " ", None, "Kodobohot, C. S."]
    got = {tuple(r) for r in person_variants(spark.createDataFrame([(n,) for n in names], "item string"), "item").collect()}
    one = sorted(["Kodobohot, Charles S.", "Kodobohot, C. S.", "Chuck Kodobohot", "Kodobohto, Cha."])
    assert got == {(a, b) for i, a in enumerate(one) for b in one[i + 1 :]} | {("KODOBOHOT, Yusuf", "Kodobohot, Yusuf")}


def test_turned_names_of_rare_words(spark):
    names = ["Johannes, Rusudolum", "Rusudolum, Johannes", "Rusudolm, Johannes S.", "Rusudolum, J.", "Joyce Fotinivon", "Fotinivon Joyce", "Fotinivon, Joy", "Johannes, Fotinivon", "Rusudolum, Emre"]
    got = {tuple(r) for r in person_variants(spark.createDataFrame([(n,) for n in names], "item string"), "item").collect()}
    one, two = sorted(names[:4]), sorted(names[4:7])
    assert got == {(a, b) for g in (one, two) for i, a in enumerate(g) for b in g[i + 1 :]}


def test_organisations(spark):
    assert parse_organisation("Department of Microbiology, Institute of Virology, Duni") == parse_organisation("INST. VIROLOGY DUNI")
    names = ["Bogazimun Institute of Virology", "Bogazimun Virology Institute", "Sequencing Unit, Inst. of Virology, Bogazimn", "Bogazimun General Hospital", "Gen Hospital of Bogazimun", "", None]
    got = {tuple(r) for r in organisation_variants(spark.createDataFrame([(n,) for n in names], "v string"), "v").collect()}
    assert got == {("Bogazimun Institute of Virology", "Bogazimun Virology Institute"), ("Bogazimun Institute of Virology", "Sequencing Unit, Inst. of Virology, Bogazimn"), ("Bogazimun Virology Institute", "Sequencing Unit, Inst. of Virology, Bogazimn"), ("Bogazimun General Hospital", "Gen Hospital of Bogazimun")}


def test_empty(spark):
    assert person_variants(spark.createDataFrame([], "item string"), "item").count() == 0


def pairs_of(spark, names):
    return {tuple(r) for r in person_variants(spark.createDataFrame([(n,) for n in names], "item string"), "item").collect()}


def test_chains_of_similar_surnames_do_not_run_together(spark):
    got = pairs_of(spark, ["Lang, John", "Lange, John", "Langer, John", "Danger, John"])
    assert ("Danger, John", "Lang, John") not in got
    assert {("Lang, John", "Lange, John"), ("Lange, John", "Langer, John"), ("Danger, John", "Langer, John")} <= got


def test_short_surnames(spark):
    got = pairs_of(spark, ["Kim, Sung", "Kiim, Sung", "Lim, Sung", "Lee, Anna", "Leee, Anna", "Lea, Anna", "Eel, Anna", "Ng, Wei", "Gn, Wei", "X, Wei"])
    assert got == {("Kiim, Sung", "Kim, Sung"), ("Lee, Anna", "Leee, Anna"), ("Gn, Wei", "Ng, Wei")}


def test_columns_of_shards_equal_the_functions(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(200)})
    index, query = name_variants._shards(name_variants.F.col("key"))
    for r in spark.createDataFrame([(w,) for w in words], "key string").select("key", index.alias("i"), query.alias("q")).collect():
        assert set(r.i) == set(index_shards(r.key)) and set(r.q) == set(query_shards(r.key))


def test_hot_shards_are_cut_into_a_grid(spark, monkeypatch):
    monkeypatch.setattr(name_variants, "TRIE_WORDS", 7)
    monkeypatch.setattr(name_variants, "TRIE_QUERIES", 11)
    rng = random.Random(9)
    words = sorted({"stem" + "".join(rng.choice("abc") for _ in range(4)) for _ in range(120)})
    got = {tuple(r) for r in trie_join(spark.createDataFrame([(w,) for w in words], "key string")).collect()}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if osa(a, b, 1) <= 1}


def test_classes_count_the_links_of_the_pairs(spark):
    names = ["Kodobohot, Charles S.", "Kodobohot, C. S.", "kodobohot, c.s.", "Chuck Kodobohot", "Kodobohto, Cha.", "Kodobohot, Yusuf", "Third, Charles", "Fourth, Chuck", "Fifth, Chuck", None]
    df = spark.createDataFrame([(n,) for n in names], "item string")
    rows = {r.name: r for r in name_classes(person_nodes(df, "item")).collect()}
    links = pairs_of(spark, names)
    assert set(rows) == {n for n in names if n}
    for n, r in rows.items():
        assert r.n_links == sum(n in p for p in links)
    assert len({rows[n].class_id for n in names[:5]}) == 1 and rows[names[5]].class_id != rows[names[0]].class_id
