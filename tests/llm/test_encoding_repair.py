import pytest

from helixmill.llm.encoding_repair import choose_mappings, explain_pair, learn_mappings, oddness, repair, restore_encoding

GERMAN = "Für das Segment fehlen noch Einträge; bitte prüfen Sie die Länge – „jetzt“."
SPANISH = "Después de días a 37 °C, la señal disminuyó más; ¿quién cambió el huésped?"
RUSSIAN = "Хозяин указан как «mouton», но в таблице другое значение. Мутация подтверждена."


def as_read(text, true, wrong):
    out = []
    for b in text.encode(true):
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", [GERMAN, SPANISH, RUSSIAN])
def test_multi_byte(text, wrong):
    bad = as_read(text, "utf-8", wrong)
    assert repair(bad, [("utf-8", wrong), ("utf-8", "cp1252")]) == (text, True)
    half = text + " " + bad
    assert repair(half, [("utf-8", wrong), ("utf-8", "cp1252")]) == (text + " " + text, True)


@pytest.mark.parametrize("wrong", ["cp866", "cp1252"])
def test_single_byte(wrong):
    bad = as_read(RUSSIAN, "cp1251", wrong)
    assert repair(bad, [("utf-8", "cp1252"), ("cp1251", wrong)]) == (RUSSIAN, True)


def test_letters_decide_between_inverse_mappings():
    letters = {c: 1.0 for c in "оеаинтсрвлкм"} | {"": 5.0}
    both = [("cp1251", "koi8-r"), ("koi8-r", "cp1251")]
    for true, wrong in both:
        text = RUSSIAN.replace("«", "").replace("»", "")
        assert repair(as_read(text, true, wrong), both, letters) == (text, True)


def test_twice():
    bad = as_read(as_read(SPANISH, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert repair(bad, [("utf-8", "cp1252")]) == (SPANISH, True)


@pytest.mark.parametrize("text", [GERMAN, SPANISH, RUSSIAN, "Â-grade “buffer” ½ ≥ №7 Ω", "SÃO PAULO É ASSIM", "検体 7 は 届いた。", "étude; zero​width; nbsp\xa0here", "", "plain", "naïve Ø 3 µl × 2"])
def test_clean_texts_stay(text):
    everything = [("utf-8", w) for w in ("cp1252", "cp1251", "cp437", "mac_roman", "cp850", "cp866")] + [("cp1251", "cp866"), ("cp1251", "cp1252")]
    assert repair(text, everything) == (text, False)


def test_lost_and_null():
    assert repair("gepr�ft", []) == (None, True)
    assert repair(None, []) == (None, False)


def test_alignment_and_choice():
    assert ("utf-8", "cp1252") in explain_pair("geprÃ¼ft", "geprüft")
    assert ("cp1251", "cp866") in explain_pair("╧Ёш", "При")
    assert explain_pair("abc", "äbc") == set()
    a, b = ("utf-8", "cp1252"), ("utf-8", "latin-1")
    assert choose_mappings({frozenset([a, b]): 5, frozenset([a]): 3, frozenset([b]): 1}) == [("utf-8", "cp1252", 8)]
    assert oddness("При") == 0 and oddness("╧Ёш") > 0


def test_learns_from_near_twins(spark):
    clean = ["Die Probe B1-2 aus Ulm wurde am 3.4.2020 erneut geprüft und für gültig erklärt.", "Die Gruppe aus Bonn möchte A7 zurückziehen, weil die Länge nicht stimmt."]
    rows = [(i, s.replace("Ulm", f"Ort{i}")) for i in range(6) for s in clean]
    bad = [as_read(s.replace("B1-2", "Z9-9"), "utf-8", "mac_roman") for s in clean]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)] + [(100 + k, t) for k, t in enumerate(bad)] + [(200, None), (201, ""), (202, "x � y"), (203, bad[0])], "doc_id long, text string")
    assert ("utf-8", "mac_roman") in {m[:2] for m in learn_mappings(df, "text")[0]}
    got = {r.doc_id: r.restored for r in restore_encoding(df, text="text", key="doc_id").collect()}
    assert got == {100: clean[0].replace("B1-2", "Z9-9"), 101: clean[1], 202: None, 203: clean[0].replace("B1-2", "Z9-9")}
    assert restore_encoding(df.limit(0), text="text", key="doc_id").count() == 0


@pytest.mark.parametrize("times", [2, 4, 6])
def test_any_number_of_wrong_decodings(times):
    bad = GERMAN
    for _ in range(times):
        bad = as_read(bad, "utf-8", "cp1252")
    assert repair(bad, [("utf-8", "cp1252")]) == (GERMAN, True)


@pytest.mark.parametrize("wrong", ["koi8-r", "cp1250", "iso8859-15", "cp1253"])
def test_every_listed_encoding_can_be_learned(spark, wrong):
    clean = ["Die Probe wurde in Köln erneut geprüft und für gültig erklärt.", "Die Gruppe möchte die Daten zurückziehen, weil die Länge nicht stimmt."]
    df = spark.createDataFrame([(i, s) for i in range(4) for s in clean] + [(9, as_read(s, "utf-8", wrong)) for s in clean], "doc_id long, text string")
    assert ("utf-8", wrong) in {m[:2] for m in learn_mappings(df, "text")[0]}


def test_a_twin_need_not_be_the_commonest_word_of_its_place(spark):
    rows = ["Вчера пришёл новый отчёт."] * 9 + ["Вчера пришла новая проба.", as_read("Вчера пришла новая проба.", "utf-8", "cp1251")]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert ("utf-8", "cp1251") in {m[:2] for m in learn_mappings(df, "text")[0]}
    assert {r.doc_id: r.restored for r in restore_encoding(df, text="text", key="doc_id").collect()} == {10: rows[9]}


def test_nothing_is_known_beforehand(spark):
    bad = as_read(GERMAN, "utf-8", "cp1252")
    df = spark.createDataFrame([(1, bad), (2, "plain")], "doc_id long, text string")
    assert restore_encoding(df, text="text", key="doc_id").count() == 0
    assert [r.restored for r in restore_encoding(df, text="text", key="doc_id", mappings=[("utf-8", "cp1252")]).collect()] == [GERMAN]


def test_single_garbled_signs_are_restored_where_their_script_is_foreign():
    letters = {c: 2.0 for c in "×±ё№“”а"} | {"": 9.0}
    use = [("utf-8", "mac_roman"), ("utf-8", "cp1251")]
    for clean in ("A grid of 58×58 cells.", "Kept at 4 ±1 degrees.", "They wrote “wrong segment”."):
        for wrong in ("mac_roman", "cp1251"):
            assert repair(as_read(clean, "utf-8", wrong), use, letters) == (clean, True)
            assert repair(clean, use, letters) == (clean, False)


def test_sets_are_weighed_alike_on_the_driver_and_in_the_cluster(spark, monkeypatch):
    from helixmill.llm import encoding_repair

    clean = ["Die Probe wurde in Köln erneut geprüft und für gültig erklärt.", "Вчера пришла новая проба из области."]
    rows = clean * 3 + [as_read(s, "utf-8", w) for s in clean for w in ("cp1252", "mac_roman")]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = learn_mappings(df, "text")[0]
    monkeypatch.setattr(encoding_repair, "MAX_SETS", 0)
    assert learn_mappings(df, "text")[0] == want and want
