import json
import random

from helixmill.operators.nested_records import MUTATION_RULES, PROCESSED_RULES, extract_lists, flatten_members, index_batch, unwrap


def rebuild(m, i):
    kind = m.kind(i)
    if kind == "object":
        return {m.key(j): rebuild(m, j) for j in m.children(i)}
    if kind == "array":
        return [rebuild(m, j) for j in m.children(i)]
    return json.loads(m.buf[m.at[i] : m.end[i]])


def top(m, record):
    return {m.key(i): rebuild(m, i) for i in range(len(m.record)) if m.record[i] == record and m.level[i] == 1}


def random_value(rng, depth=0):
    pick = rng.random()
    if depth > 4 or pick < 0.45:
        return rng.choice([1, -2.5, True, None, "", "a,b:{[", 'q"u\\', "é中", "x" * 40])
    if pick < 0.75:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}\"{i}": random_value(rng, depth + 1) for i in range(rng.randrange(4))}


def test_index_equals_parser():
    rng = random.Random(7)
    docs = [{f"t{i}": random_value(rng) for i in range(rng.randrange(5))} for _ in range(200)]
    texts = [json.dumps(d, ensure_ascii=bool(k % 2), indent=2 if k % 3 == 0 else None) for k, d in enumerate(docs)]
    m = index_batch(texts)
    for k, d in enumerate(docs):
        assert top(m, k) == d


def test_damaged_payloads_do_not_disturb_neighbours():
    m = index_batch(['{"a": [1, 2}', '{"a": "x', '{"a": 1}', '{"a": {"b": 1}', '{"a": 2}}', '{"b": [true]}'])
    assert sorted({int(r) for r in m.record}) == [2, 5]


def test_unwrap():
    assert unwrap(None) is None
    assert unwrap(" ") is None
    assert unwrap("null") is None
    assert unwrap("[1]") is None
    assert unwrap(json.dumps(json.dumps({"a": 1}))) == '{"a": 1}'


def test_processed_rules(spark):
    payload = {"nucleotideInsertions": {"L": ["1:AC", None, {"position": "2", "sequence": "G"}], "M": "3:T", "S": None}, "files": {"raw": {"fileId": "f1", "name": "n"}, "none": []}, "metadata": {"files": {"x": "y"}}}
    rows = spark.createDataFrame([("r1", json.dumps(payload)), ("r2", json.dumps(json.dumps(payload))), ("r3", json.dumps(payload)[:-5]), ("r4", None), ("r5", "")], "id string, j string")
    got = {tuple(r) for r in extract_lists(rows, record_id="id", json_col="j", rules=PROCESSED_RULES).collect()}
    one = {("nucleotideInsertions", "L", 1, 0, "1:AC"), ("nucleotideInsertions", "L", 2, 0, "2:G"), ("nucleotideInsertions", "M", 1, 0, "3:T"), ("files", "raw", 1, 0, "f1")}
    assert got == {(r, *x) for r in ("r1", "r2") for x in one}


def test_mutation_rules(spark):
    sub = {"pos": "7", "refAa": "A", "qryAa": "G"}
    payload = {"HA": {"privateSubstitutions": sub, "privateDeletions": [{"pos": 3, "refAa": "K"}], "labeledSubstitutions": [None, {"substitution": sub, "labels": "x"}], "aaChangesGroups": [{"changes": [sub, sub]}]}, "NA": None}
    rows = spark.createDataFrame([("r", json.dumps(payload))], "id string, j string")
    got = {tuple(r)[1:] for r in extract_lists(rows, record_id="id", json_col="j", rules=MUTATION_RULES).collect()}
    assert got == {("privateSubstitutions", "HA", 1, 0, "A7G"), ("privateDeletions", "HA", 1, 0, "K3-"), ("labeledSubstitutions", "HA", 1, 0, "A7G"), ("labels", "HA", 1, 1, "x"), ("changes", "HA", 1, 1, "A7G"), ("changes", "HA", 1, 2, "A7G")}


def test_members_are_linked(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": [10, null]}, "c": "t"}'), (2, None)], "rid int, j string")
    got = {(r.rid, r.key, r.depth): r for r in flatten_members(rows, "j").collect()}
    assert set(got) == {(1, "a", 1), (1, "c", 1), (1, "b", 2), (1, None, 3)}
    assert got[1, "b", 2].parent == got[1, "a", 1].node
    assert got[1, "a", 1].parent == -1
    assert got[1, "c", 1].value == "t"


def test_empty_table(spark):
    rows = spark.createDataFrame([], "id string, j string")
    assert extract_lists(rows, record_id="id", json_col="j", rules=PROCESSED_RULES).count() == 0


def test_payloads_encoded_many_times():
    import json

    from helixmill.operators.nested_records import unwrap

    text = '{"a":1}'
    for times in range(8):
        assert unwrap(text) == '{"a":1}', times
        text = json.dumps(text)
