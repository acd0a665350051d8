import random

from helixmill.llm.leak_detection import MAX_CHANGED, MAX_EDGE, MIN_WORDS, SEED, Automaton, find_leaks, remove_leaks, windows, words_of, words_with_spans


def sentence(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def test_matching_statistics_of_the_automaton():
    rng = random.Random(1)
    passages = [(i, sentence(rng, 30, 12)) for i in range(5)]
    a = Automaton(passages)
    text = sentence(rng, 300, 12)
    state, n = 0, 0
    for j, w in enumerate(text):
        c = a.vocabulary.get(w, -1)
        while state and c not in a.next[state]:
            state = a.link[state]
            n = a.length[state]
        if c in a.next[state]:
            state, n = a.next[state][c], n + 1
        want = max(k for k in range(j + 2) if k == 0 or any(text[j - k + 1 : j + 1] == p[i : i + k] for _, p in passages for i in range(len(p))))
        assert n == want
        if n >= SEED:
            ends = {(k, at) for k, at in a.ends(a.seed_state[state])}
            assert ends == {(k, i + SEED - 1) for k, (_, p) in enumerate(passages) for i in range(len(p) - SEED + 1) if p[i : i + SEED] == text[j - SEED + 1 : j + 1]}


def test_altered_passages():
    rng = random.Random(4)
    passages = [(i, sentence(rng, 70)) for i in range(20)]
    a = Automaton(passages)
    missed = wrong = 0
    for trial in range(200):
        k = rng.randrange(20)
        start, size = rng.randrange(40), rng.randrange(24, 30)
        part = list(passages[k][1][start : start + size])
        for at in rng.sample(range(2, size - 2), int(size * (MAX_CHANGED - 0.05))):
            part[at] = "altered"
        doc = sentence(rng, 40) + part + sentence(rng, 40)
        found = {x[0] for x in a.leaks(doc)}
        missed += k not in found
        wrong += bool(found - {k})
        short = sentence(rng, 40) + passages[k][1][start : start + MIN_WORDS - 8] + sentence(rng, 40)
        wrong += bool(a.leaks(short))
    assert missed == 0 and wrong == 0


def test_normalisation():
    text = "The <b>Quick</b>, brown **fox**\njum-\nped­ over &nbsp;[it] _now_"
    assert words_with_spans(text)[0] == ["the", "quick", "brown", "fox", "jumped", "over", "it", "now"]


def test_operator_and_removal(spark):
    rng = random.Random(6)
    p = " ".join(sentence(rng, 40))
    quoted = p.upper().replace(" ", ",  ")
    docs = spark.createDataFrame([(1, f"Before. {quoted} After."), (2, "nothing"), (3, None), (4, ""), (5, f"Before. {quoted} After."), (6, "short test")], "doc_id long, text string")
    items = spark.createDataFrame([(7, p), (7, p), (8, None), (9, "short test")], "item_id long, passage string")
    found = find_leaks(docs, items, text="text", key="doc_id", passage="passage", item_key="item_id")
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 7), (5, 7), (6, 9)]
    left = {r.doc_id: r.text for r in remove_leaks(docs, found, text="text", key="doc_id").collect()}
    assert left[1].startswith("Before. ") and "W" not in left[1] and left[2] == "nothing" and left[3] is None
    assert find_leaks(docs, items.limit(0), text="text", key="doc_id", passage="passage", item_key="item_id").count() == 0
    assert find_leaks(docs.limit(0), items, text="text", key="doc_id", passage="passage", item_key="item_id").count() == 0


def test_all_spans_of_a_passage():
    p = [f"p{i}" for i in range(80)]
    rng = random.Random(8)
    a = Automaton([(1, p)])
    gap = sentence(rng, 30)
    assert sorted(x[1:4] for x in a.leaks(gap + p + gap + p + gap)) == [(30, 109, 80), (140, 219, 80)]
    assert sorted(x[1:4] for x in a.leaks(p + p)) == [(0, 79, 80), (80, 159, 80)]
    altered = [*p[:29], "altered", *p[30:]]
    assert [x[1:4] for x in a.leaks(gap + altered + gap)] == [(30, 109, 80)]
    # an exact part and, far from it, another with changed words
    changed = [w if i % 6 else "altered" for i, w in enumerate(p[40:70])]
    assert sorted(x[1:3] for x in a.leaks(gap + p[:25] + gap + changed + gap)) == [(30, 54), (86, 114)]


def test_removal_of_all_copies_and_limits(spark):
    rng = random.Random(9)
    p = [f"p{i}" for i in range(80)]
    altered = " ".join([*p[:29], "altered", *p[30:]])
    rest = " ".join(sentence(rng, 25))
    docs = spark.createDataFrame([(1, f"{rest} {' '.join(p)} {rest} {altered} {rest}"), (2, f"{rest} {' '.join(p[:24])}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(p))], "item_id long, passage string")
    found = find_leaks(docs, items, text="text", key="doc_id", passage="passage", item_key="item_id")
    left = {r.doc_id: r.text for r in remove_leaks(docs, found, text="text", key="doc_id").collect()}
    assert left == {1: f"{rest}  {rest}  {rest}", 2: f"{rest} "}
    # 24 of 80 words exceed neither a limit of 30 words nor one of half the passage
    kept = {r.doc_id: r.text for r in remove_leaks(docs, found, text="text", key="doc_id", least_words=30, least_coverage=0.5).collect()}
    assert kept == {1: f"{rest}  {rest}  {rest}", 2: f"{rest} {' '.join(p[:24])}"}


def test_words_without_places_are_the_same_words():
    for text in ["The <b>Quick</b>, brown **fox**\njum-\nped­ over &nbsp;[it] _now_", "plain Words, 12 of_them", "Straße ÄÖÜ İstanbul ﬁne № 7", "a < b > c & d", ""]:
        assert words_of(text) == words_with_spans(text)[0]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_windows_equal_all_pairs_of_windows():
    rng = random.Random(11)
    for trial in range(40):
        item = [rng.randrange(9) for _ in range(12)]
        text = [rng.randrange(9) for _ in range(10)]
        at = rng.randrange(3)
        text[at : at + 9] = [w if rng.random() < 0.8 else 99 for w in item[2:11]]
        least = 8
        want = any(
            max(size, least) <= len(item) and edits(item[i : i + size], text[j : to]) + max(size, least) - size <= int(max(size, least) * MAX_CHANGED)
            for size in range(least - MAX_EDGE, len(item) + 1) for i in range(len(item) - size + 1)
            for j in range(len(text)) if text[j] == item[i]
            for to in range(j + 1, len(text) + 1) if text[to - 1] == item[i + size - 1]
        )
        assert bool(windows(item, text, least)) == want, trial


def test_passages_of_any_length():
    p = [f"p{i}" for i in range(5)]
    a = Automaton([(1, ["x"]), (2, ["x", "y"]), (3, p), (4, [])])
    assert sorted(x[:3] for x in a.leaks(["q", "x", "y", "x", *p, "p0", "p1"])) == [(1, 1, 1), (1, 3, 3), (2, 1, 2), (3, 4, 8)]
    assert sorted({x[0] for x in a.leaks(["x", "y", *p], False)}) == [1, 2, 3] and not a.leaks(["p0", "p1", "p2", "p3"])


def test_every_copy_of_a_passage_among_frequent_phrases():
    rng = random.Random(12)
    phrase = ["for", "the", "record", "we", "state"]
    passages = [(i, [*phrase, *sentence(rng, 20), *phrase, *sentence(rng, 20)]) for i in range(12)]
    a = Automaton(passages)
    doc = []
    for _ in range(60):
        doc += [*phrase, *sentence(rng, 3)]
    for _ in range(3):
        part = list(passages[5][1])
        for at in (7, 13, 20, 29, 38, 44):
            part[at] = "altered"
        doc += [*part, *sentence(rng, 12)]
    doc += phrase * 10
    found = a.leaks(doc)
    assert {x[0] for x in found} == {5} and len(found) == 3
