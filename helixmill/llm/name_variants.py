"""Variant spellings of names that people type.

Names are parsed into an own part (surname of a person, place name of an
organisation) and a rest (given names and initials; the bag of general words
that tells the kind of organisation).  Own parts are joined with a trie join:
they are sharded by the pieces that one typing error leaves intact, each shard
is put into tries, and every own part is run over the tries of its shards by a
Levenshtein automaton that counts a transposition of neighbours as one error.
In own parts of fewer than ``SHORT`` letters only a doubled letter or two
swapped ones are an error; another letter makes another name there.

Which part of a person's name is the surname is told by all names together:
words that follow commas after many different surnames are given names, so
that reordered parts fall into place.  However rare its words are, a name of
two parts also stands under its other order (a turned reading); it meets the
names read as they are where both swapped parts agree as full words within one
error or as short forms.

Spellings that are parsed alike are one node.  Nodes whose own parts are
within one error are linked if their rests agree: initials, short forms,
nicknames and missing middle initials do; other given names or kinds do not.
Two nodes mean one entity if links connect them, their own parts are equal,
linked, or both linked to a third one, and their rests agree: the own parts
are compared for every pair, so that chains of similar names do not run
together.

Defined results: null and blank names are no names; names without a given part
or kind match only by equal rests; one name delivered repeatedly counts once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.address_match import institution_key
from helixmill.llm.canonical_map import fold, osa
from helixmill.llm.components import connected_components
from helixmill.session import cut_lineage, spread

# ---------------------------------------------------------------- trie join


class Trie:
    """A trie walked by a Levenshtein automaton (with transpositions)."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w

    def near(self, query: str, most: int) -> Iterator[tuple[str, int]]:
        """(word, distance) of all words within ``most`` errors."""
        first = list(range(len(query) + 1))
        # the automaton's state: the row of distances to all prefixes of the query
        stack = [(self.root, first, None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if row[-1] <= most:
                        yield child, row[-1]
                    continue
                new = [row[0] + 1]
                for j in range(1, len(query) + 1):
                    v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (query[j - 1] != ch))
                    if before is not None and j > 1 and query[j - 1] == last and query[j - 2] == ch and before[j - 2] + 1 < v:
                        v = before[j - 2] + 1
                    new.append(v)
                if min(new) <= most:
                    stack.append((child, new, row, ch))


def index_shards(key: str) -> list[str]:
    """What one error leaves intact of a key: either half, or both ends around a transposition at the middle."""
    n, m = len(key), len(key) // 2
    return [f"{n}<{key[:m]}", f"{n}>{key[m:]}", f"{n}={key[: max(m - 1, 0)]}|{key[m + 1 :]}"]


def query_shards(key: str) -> list[str]:
    """The shards in which keys within one error of this key stand."""
    n = len(key)
    out = []
    for other in (n - 1, n, n + 1):
        if other < 1:
            continue
        m = other // 2
        out += [f"{other}<{key[:m]}", f"{other}>{key[n - (other - m) :] if other - m <= n else ''}"]
    m = n // 2
    return [*out, f"{n}={key[: max(m - 1, 0)]}|{key[m + 1 :]}"]


#: Index words in one trie, and queries that run over it in one piece of work; larger shards are cut into a grid of such pieces.
TRIE_WORDS = 20_000
TRIE_QUERIES = 100_000
#: Keys of fewer letters: only doubled or swapped letters are errors.
SHORT = 4
#: Hot shards (at most 10 for every ``TRIE_WORDS`` keys) are broadcast up to so many.
MAX_HOT = 100_000

_REPEATED = re.compile(r"(.)\1+")


def one_slip(a: str, b: str) -> bool:
    """Whether two different keys within one error may be one name."""
    if min(len(a), len(b)) >= SHORT:
        return True
    return _REPEATED.sub(r"\1", a) == _REPEATED.sub(r"\1", b) or (len(a) == len(b) and sorted(a) == sorted(b))


def _shards(key: Column) -> tuple[Column, Column]:
    """Columns of :func:`index_shards` and :func:`query_shards`."""
    n = F.length(key)
    text = lambda other: other.cast("string")
    half = lambda other: F.floor(other / 2).cast("int")
    left = lambda other: F.concat(text(other), F.lit("<"), F.substr(key, F.lit(1), half(other)))
    right = lambda other: F.concat(text(other), F.lit(">"), F.when(other > half(other), F.right(key, other - half(other))).otherwise(""))
    ends = F.concat(text(n), F.lit("="), F.substr(key, F.lit(1), F.greatest(half(n) - 1, F.lit(0))), F.lit("|"), F.substr(key, half(n) + 2))
    shorter = F.when(n > 1, F.array(left(n - 1), right(n - 1))).otherwise(F.array().cast("array<string>"))
    return F.array(left(n), right(n), ends), F.array_distinct(F.concat(shorter, F.array(left(n), right(n), left(n + 1), right(n + 1), ends)))


def trie_join(keys: DataFrame) -> DataFrame:
    """(key_a, key_b): pairs of different keys within one error, key_a < key_b.

    ``keys`` has one column ``key`` of distinct strings.  Shards are hashed
    into partitions and sorted, so that each is read once.  A shard with more
    words than a trie or more queries than a piece of work may hold is cut into
    a grid: each piece of its index words meets each piece of its queries.
    """
    spark = keys.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def match(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trie, words = None, None, []
        a, b = [], []
        for batch in it:
            for *s, q, k in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if s != shard:
                    shard, trie, words = s, None, []
                if not q:
                    words.append(k)
                    continue
                if words:  # index words stand before the queries of their shard
                    trie, words = Trie(words), []
                for other, d in trie.near(k, 1) if trie else ():
                    if d and k < other and one_slip(k, other):
                        a.append(k)
                        b.append(other)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["key_a", "key_b"])
                a, b = [], []

    index, query = _shards(F.col("key"))
    named = keys.filter("key <> ''").select("key")
    rows = named.select(F.explode(index).alias("shard"), F.lit(False).alias("query"), "key").unionAll(named.select(F.explode(query).alias("shard"), F.lit(True).alias("query"), "key"))
    sizes = rows.groupBy("shard").agg((F.count_if(~F.col("query")) / TRIE_WORDS).alias("n"), (F.count_if("query") / TRIE_QUERIES).alias("m"))
    hot = cut_lineage(sizes.filter("n > 1 or (n > 0 and m > 1)").select("shard", F.ceil("n").alias("n"), F.ceil("m").alias("m")))
    few = hot.limit(MAX_HOT + 1).count()
    if few:
        rows = rows.join(F.broadcast(hot) if few <= MAX_HOT else hot, "shard", "left").fillna(1, ["n", "m"])
        own = lambda n: F.array(F.pmod(F.xxhash64("key"), F.col(n)))
        every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
        rows = rows.withColumn("i", F.explode(F.when(F.col("query"), every("n")).otherwise(own("n")))).withColumn("j", F.explode(F.when(F.col("query"), own("m")).otherwise(every("m"))))
    else:
        rows = rows.withColumns({"i": F.lit(0).cast("bigint"), "j": F.lit(0).cast("bigint")})
    grid = ["shard", "i", "j"]
    ordered = rows.select(*grid, "query", "key").repartition(parts, *grid).sortWithinPartitions(*grid, "query")
    return ordered.mapInArrow(match, "key_a string, key_b string").distinct()


# ------------------------------------------------------------------- persons

#: Short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sascha xander al lex", "andrew": "andy drew", "anthony": "tony", "beatrix": "bea trixie trix", "benjamin": "ben benny benji", "charles": "chuck charlie chas", "christopher": "chris kit topher", "cyril": "cy", "diana": "di",
    "dmitri": "dima mitya", "dorothy": "dot dottie dolly", "edward": "ned ed ted eddie teddy", "ekaterina": "katya katia", "elizabeth": "liz beth betty lizzie eliza bess", "esther": "essie hettie", "francisco": "paco pancho", "frederick": "fritz fred freddie freddy",
    "gabriella": "gabi gabby ella", "giuseppe": "beppe peppe pino pepe", "gregory": "greg", "henry": "harry hal hank", "isabella": "bella izzy isa", "ivana": "iva", "johannes": "hannes hans jo", "jonathan": "jon jonny nathan", "jose": "pepe chepe", "joyce": "joy",
    "katherine": "kate kathy katie kit kitty", "leonard": "len leo lenny", "ludmila": "mila luda", "margaret": "peggy maggie meg greta marge", "maria": "masha mia mary marie", "matthias": "matze matt mattias hias", "mehmet": "memo", "michael": "mike mick mickey misha",
    "milan": "mile", "mirjana": "mira", "nadia": "nadya", "nathaniel": "nat nate nathan", "nikolai": "kolya nick nik", "olga": "olya", "patricia": "pat tricia patty trish", "pavel": "pasha", "quentin": "quin", "rebecca": "becky becca", "richard": "dick rick rich ricky",
    "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "silvia": "silvi", "susanna": "sue sanna susie suzy sanne", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "ursula": "uschi ulla", "valentina": "valya vali tina", "vera": "verochka",
    "viktor": "vitya vik", "vladimir": "vova volodya vlad", "william": "bill will billy liam willy", "yevgeny": "zhenya", "zachary": "zach zack", "zoltan": "zoli",
}
_FULL_OF: dict[str, set[str]] = defaultdict(set)
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL_OF[_s].add(_full)

_PARTICLES = ("van der", "van den", "van de", "von der", "de la", "van", "der", "de", "del", "el", "al", "la", "le", "von", "di", "da", "bin", "ibn")
_TITLE = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|sir)\b\.?\s*)+", re.I)


def _initials(word: str) -> list[str] | None:
    """Initials written as ``A. B.``, ``A.B.``, ``AB`` or ``A``."""
    if re.fullmatch(r"(?:[^\W\d_]\.[\s\-]*){1,4}[^\W\d_]?", word):
        return [c.lower() for c in word if c.isalpha()]
    if re.fullmatch(r"[^\W\d_]{1,3}", word) and (word.isupper() or len(word) == 1) and not (len(word) > 1 and re.search(r"[aeiou]", word.lower()) and len(word) == 3):
        return [c.lower() for c in word]
    return None


_CLAN = re.compile(r"^((?:.*\s)?)([DdOo])(?:\s*[’'`]\s*|\s+)(?=[^\W\d_]{3})")


def _own(surname: str) -> str:
    """Surname without accents, blanks, hyphens and apostrophes; its particle stands in front.

    D' and O' make another surname: they are set off by more than one error.
    """
    clan = ""
    if m := _CLAN.match(surname):
        clan, surname = m.group(2).lower() + "##", m.group(1) + surname[m.end() :]
    return clan + fold(re.sub(r"[’'`\-]", "", surname)).replace(" ", "")


def word_positions(name: str) -> list[tuple[str, str, bool]]:
    """(word, surname, certain) of names written ``Surname, Given``: what all names together tell of given names."""
    a, sep, b = _TITLE.sub("", name).partition(",")
    if not sep:
        return []
    words = [w for w in re.sub(r"[\"“].*?[\"”]", " ", b).split() if _initials(w) is None and len(fold(w)) > 2]
    return [(fold(words[0]), _own(a), True)] if len(words) == 1 and fold(words[0]) else []


def parse_person(name: str, given: set[str]) -> tuple[list[str], str, list[str], str] | None:
    """(surname keys, given name, middle initials, nickname); the given name may be an initial or end with a full stop."""
    text = _TITLE.sub("", " ".join(name.replace(" ", " ").split(" ")).strip())
    nick = ""
    if m := re.search(r"\s[\"“]([^\"”]+)[\"”]", text):
        nick, text = fold(m.group(1)), (text[: m.start()] + text[m.end() :]).strip()
    particle = ""
    gap = bool(re.search(r"\S\s{2,}\S", text)) and "," not in text
    first, sep, second = text.partition(",")
    if not sep and gap:
        first, second = re.split(r"\s{2,}", text, maxsplit=1)
        sep = ","
    if sep:
        first, second = first.strip(), second.strip()
        for p in _PARTICLES:  # "Name, A. van der" and "Given, van der Name"
            if m := re.search(rf"(?i)\s+{p}$", " " + second):
                second, first = (" " + second)[: m.start()].strip(), f"{p} {first}"
                break
            if re.match(rf"(?i){p}\s+\S", second) and len(first.split()) == 1:
                first, second = second, first
                break
        words = second.split()
        if len(first.split()) == 1 and len(words) == 1 and _initials(second) is None and fold(first) in given and fold(second) not in given:
            first, second = second, first
        surname, rest = first, second.split()
    else:
        words = text.split()
        if len(words) < 2:
            return None
        for p in _PARTICLES:
            if m := re.search(rf"(?i)\s+{p}$", text):
                particle, words = p + " ", text[: m.start()].split()
                break
        lows = [w.lower() for w in words]
        at = next((k for k in range(len(words)) if any(lows[k : k + len(p.split())] == p.split() for p in _PARTICLES) and k + 1 < len(words)), None)
        if at is not None and at > 0:
            rest, surname = words[:at], " ".join(words[at:])
        elif at == 0:
            span = max((len(p.split()) for p in _PARTICLES if lows[: len(p.split())] == p.split()), default=1)
            surname, rest = " ".join(words[: span + 1]), words[span + 1 :]
        elif _initials(words[-1]) is not None:
            surname, rest = " ".join(words[:-1]), words[-1:]
            if len(words) > 2 and fold(words[0]) in given and _initials(words[-1]) is not None:
                surname, rest = words[1], [words[0], *words[2:]]
        elif _initials(words[0]) is not None:
            k = next(i for i, w in enumerate(words) if _initials(w) is None)
            surname, rest = " ".join(words[k:]), words[:k]
        elif fold(words[-1]) in given and fold(words[0]) not in given:
            surname, rest = words[0], words[1:]
        else:
            k = next((i for i in range(len(words) - 1, 0, -1) if _initials(words[i]) is not None), 0) + 1
            surname, rest = " ".join(words[k:]), words[:k]
        surname = particle + surname
    own = _own(surname)
    if not own:
        return None
    keys = [own]
    low = surname.lower()
    head = next((p for p in _PARTICLES if low.startswith(p + " ")), "")
    body = surname[len(head) :].strip()
    if "-" in body:
        keys.append(_own(head + body.split("-")[0]))
    elif not head and not _CLAN.match(body) and len(body.split()) == 2:
        keys.append(_own(body.split()[0]))
    flat: list[str] = []
    for w in rest:
        got = _initials(w)
        flat += got if got is not None else [fold(w) + ("." if w.endswith(".") else "")]
    flat = [f for f in flat if f.strip(".")]
    return keys, flat[0] if flat else "", [f[0] for f in flat[1:]], nick


def turned_readings(name: str, keys: list[str], given: str) -> list[tuple[list[str], str, list[str]]]:
    """(surname keys, given name, middle initials) of a name of two full parts in the orders other than the one read."""
    text = re.sub(r"\s[\"“][^\"”]+[\"”]", "", _TITLE.sub("", " ".join(name.replace("\xa0", " ").split())))
    first, sep, second = text.partition(",")
    sides = [first.split(), second.split()] if sep else [[w] for w in text.split()]
    middle = [c for side in sides for w in side for c in _initials(w) or ()]
    full = [[w for w in side if _initials(w) is None] for side in sides]
    full = [side for side in full if fold(" ".join(side))]
    if len(full) != 2 or any(w.endswith(".") for side in full for w in side):
        return []
    out = []
    for own, rest in (full, full[::-1]):
        surname = " ".join(own)
        got = [_own(surname), *([_own(surname.split("-")[0])] if "-" in surname else [])]
        word = fold(rest[0])
        if word and got[0] and (got[0] != keys[0] or word != given):
            out.append((got, word, [fold(w)[:1] for w in rest[1:]] + middle))
    return out


@lru_cache(1 << 16)
def _fulls(word: str) -> frozenset[str]:
    """The given names that a word may stand for."""
    out = {word} | _FULL_OF.get(word, set())
    if len(word) > 2 and word not in NICKNAMES and word not in _FULL_OF:
        out |= {f for s, fs in _FULL_OF.items() if len(s) > 3 and osa(word, s, 1) <= 1 for f in fs}
    return frozenset(out)


@lru_cache(1 << 18)
def same_given(a: str, b: str, errors: int = 1) -> bool:
    """Given names, short forms or initials that may belong to one person.

    ``errors`` is 2 where both are known to be linked to a third spelling.
    """
    if not a or not b:
        return not a and not b
    if len(a) == 1 or len(b) == 1:
        x, y = (a, b) if len(a) == 1 else (b, a)
        return x in {f[0] for f in _fulls(y.rstrip("."))} if len(y) > 1 else x == y
    for x, y in ((a, b), (b, a)):
        if x.endswith("."):
            stem = x.rstrip(".")
            if any(f.startswith(stem) or (errors > 1 and f[0] == stem[0] and osa(f[: len(stem)], stem, 1) <= 1) for f in _fulls(y.rstrip("."))):
                return True
    if a.endswith(".") or b.endswith("."):
        return False
    if a == b:
        return True
    most = errors if min(len(a), len(b)) < 8 else errors + 1
    if min(len(a), len(b)) > 2 + errors and osa(a, b, most) <= most:
        return True
    fa, fb = _fulls(a), _fulls(b)
    return bool(fa & fb) or any(len(x) > 4 and len(y) > 4 and osa(x, y, 1) <= 1 for x in fa for y in fb)


def same_person(a: tuple[str, str, str], b: tuple[str, str, str], errors: int = 1) -> bool:
    """(given, middle initials, nickname) that agree."""
    if a[1] and b[1] and not (a[1].startswith(b[1]) or b[1].startswith(a[1])):
        return False
    return same_given(a[0], b[0], errors) or bool(a[2] and same_given(a[2], b[0], errors)) or bool(b[2] and same_given(a[0], b[2], errors))


def same_turned(a: tuple[str, str, str], b: tuple[str, str, str]) -> bool:
    """(given, middle initials, nickname) of a turned reading and another: full words within one error, or short forms."""
    x, y = a[0], b[0]
    if min(len(x), len(y)) < 2 or x.endswith(".") or y.endswith("."):
        return False
    if a[1] and b[1] and not (a[1].startswith(b[1]) or b[1].startswith(a[1])):
        return False
    return x == y or (min(len(x), len(y)) >= SHORT and osa(x, y, 1) <= 1) or bool(_fulls(x) & _fulls(y))


def first_letters(given: str, nick: str) -> list[str]:
    """Initials under which a given name may be met; names of one person share one."""
    out = {f[0] for w in (given.rstrip("."), nick) if w for f in _fulls(w)}
    return sorted(out) or [""]


# ------------------------------------------------------------------ operators

#: A node: what a spelling is parsed into.  Names of organisations have their kind in the place of the given name.
_NODE = ("field", "turned", "keys", "given", "middle", "nick")


def given_names(names: DataFrame, name: str, *, least: int = 3) -> DataFrame:
    """Words that stand after the comma of at least ``least`` different surnames."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [p for n in batch.column(0).to_pylist() if n for p in word_positions(n)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["word", "own"])

    return names.select(name).mapInArrow(run, "word string, own string").distinct().groupBy("word").count().filter(F.col("count") >= least).select("word")


def needs_given(name: str) -> bool:
    """Whether the reading of a name depends on which of its words are given names."""
    first, sep, second = name.partition(",")
    if sep:
        return len(first.split()) == 1 and len(second.split()) == 1
    return len(name.split()) > 1


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["name", *_NODE, "letters"])


_NODE_SCHEMA = "name string, field string, turned boolean, keys array<string>, given string, middle string, nick string, letters array<string>"


def person_nodes(names: DataFrame, name: str, field: str = "") -> DataFrame:
    """(name, node, letters) of each distinct person name; a name of two parts has a node for each order."""
    base = cut_lineage(spread(names.select(F.col(name).alias("name")).filter(F.length(F.trim("name")) > 0).distinct()))
    known = given_names(base, "name")

    @F.pandas_udf("array<string>")
    def words(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted({w for w in fold(t.replace(",", " ")).split() if len(w) > 2}) if needs_given(t) else [])

    has = base.select("name", F.explode(words("name")).alias("word")).join(known, "word").groupBy("name").agg(F.collect_set("word").alias("given"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for n, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if got := parse_person(n, set(g or ())):
                    for t, r in enumerate([got[:3], *turned_readings(n, got[0], got[1])]):
                        if keys := list(dict.fromkeys(k for k in r[0] if k)):
                            rows.append((n, field, t > 0, keys, r[1], "".join(r[2]), got[3], first_letters(r[1], got[3])))
            yield _nodes(rows)

    return base.join(has, "name", "left").select("name", "given").mapInArrow(run, _NODE_SCHEMA)


def organisation_nodes(names: DataFrame, name: str, field: str = "") -> DataFrame:
    """(name, node, letters) of each distinct organisation; a department in front is left out."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parsed = ((n, *parse_organisation(n)) for n in batch.column(0).to_pylist())
            yield _nodes([(n, field, False, [own], kind, "", "", [kind]) for n, own, kind in parsed if own])

    return spread(names.select(name).filter(F.length(F.trim(F.col(name))) > 0).distinct()).mapInArrow(run, _NODE_SCHEMA)


def parse_organisation(text: str) -> tuple[str, str]:
    """(place name, kind); parts in front of an organisation that is named whole are left out."""
    bare = text
    while "," in bare:
        rest = bare.split(",", 1)[1].strip()
        own, kind = institution_key(rest)
        if not own or not kind:
            break
        bare = rest
    return institution_key(bare)


def _agree(orgs: pd.Series, errors: pd.Series, ta: pd.Series, tb: pd.Series, ga: pd.Series, ma: pd.Series, na: pd.Series, gb: pd.Series, mb: pd.Series, nb: pd.Series) -> pd.Series:
    """Whether the rests of two nodes agree; of two readings one may be turned in a link."""
    out = []
    for org, most, t, u, *rest in zip(orgs, errors, ta, tb, ga, ma, na, gb, mb, nb, strict=True):
        a, b = tuple(rest[:3]), tuple(rest[3:])
        if org:
            out.append(a == b)
        elif t or u:
            out.append(same_person(a, b, most) if most > 1 else t != u and same_turned(a, b))
        else:
            out.append(same_person(a, b, most))
    return pd.Series(out, dtype=bool)


def _candidates(nodes: DataFrame, near: DataFrame, errors: int, *same: str) -> DataFrame:
    """(a, b): pairs of nodes, a <= b, whose own parts are ``near``, that share an initial and the columns ``same``, and whose rests agree.

    The join keys are an own part and an initial.  Frequent ones are split by
    the skew handling of adaptive execution; both joins are plain shuffle
    joins, which it can split on either side.
    """
    rows = nodes.withColumn("key", F.explode("keys")).withColumn("letter", F.explode("letters"))
    what = ["id", "orgs", "turned", "given", "middle", "nick"]
    left = rows.select("field", "letter", *same, F.col("key").alias("key_a"), *(F.col(c).alias(f"{c}_a") for c in what))
    right = rows.select("field", "letter", *same, F.col("key").alias("key_b"), *(F.col(c).alias(f"{c}_b") for c in what))
    both = left.join(near, "key_a").join(right, ["key_b", "field", "letter", *same]).filter("id_a <= id_b")
    if errors == 1:
        both = both.filter("id_a < id_b and not (turned_a and turned_b)")
    both = both.select(*(f"{c}_{x}" for x in "ab" for c in what)).distinct()
    rest = [f"{c}_{x}" for x in "ab" for c in ("given", "middle", "nick")]
    return both.filter(F.pandas_udf(_agree, "boolean")("orgs_a", F.lit(errors), "turned_a", "turned_b", *rest)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def linked_nodes(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, name) of the spellings of each node, and (a, b), a <= b, of the nodes that mean one entity.

    ``parts`` has the nodes of one or several fields (:func:`person_nodes`,
    :func:`organisation_nodes`); nodes of different fields are never linked.
    A node is paired with itself where two of its spellings would be.
    """
    node = F.concat_ws("\x01", "field", F.col("turned").cast("string"), F.concat_ws("\x02", "keys"), "given", "middle", "nick")
    parts = cut_lineage(parts.withColumn("id", node))
    nodes = parts.dropDuplicates(["id"]).withColumn("orgs", F.lit(False) if "orgs" not in parts.columns else F.col("orgs"))
    nodes = cut_lineage(nodes.drop("name"))
    keys = cut_lineage(nodes.select(F.explode("keys").alias("key")).distinct())
    close = cut_lineage(trie_join(keys))
    equal = keys.select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))
    either = close.unionAll(close.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    links = cut_lineage(_candidates(nodes, equal.unionAll(either), 1))
    # a turned reading that meets no name read as it stands says nothing
    of = nodes.join(connected_components(links).withColumnRenamed("node", "id"), "id", "left").filter("not turned or component is not null")
    of = cut_lineage(of.withColumn("component", F.coalesce("component", "id")))
    # own parts that links stand for, and those that are both linked to a third one
    own = lambda x: of.select(F.col("id").alias(x), F.explode("keys").alias(f"key_{x}"))
    used = links.join(own("a"), "a").join(own("b"), "b").select("key_a", "key_b").distinct()
    used = either.join(used.unionAll(used.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"))).distinct(), ["key_a", "key_b"], "left_semi")
    used = cut_lineage(used)
    third = used.join(used.select(F.col("key_a").alias("key_b"), F.col("key_b").alias("third")), "key_b").select("key_a", F.col("third").alias("key_b"))
    near = equal.unionAll(used).unionAll(third).distinct()
    return parts.select("id", "name"), _candidates(of, near, 2, "component")


def name_pairs(parts: DataFrame) -> DataFrame:
    """(field, name_a, name_b): pairs of different spellings of one entity, name_a < name_b by code point."""
    spelt, pairs = linked_nodes(parts)
    both = pairs.join(spelt.select(F.col("id").alias("a"), F.col("name").alias("x")), "a").join(spelt.select(F.col("id").alias("b"), F.col("name").alias("y")), "b").filter("x <> y")
    return both.select(F.substring_index("a", "\x01", 1).alias("field"), F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b")).distinct()


def name_classes(parts: DataFrame) -> DataFrame:
    """(field, name, class_id, n_links): each spelling with its class and the number of other spellings it is linked with.

    The pairs of a class are not written out: links are counted between nodes
    by the number of their spellings.  A spelling that has several readings
    counts the spellings that it meets under each.
    """
    spelt, pairs = linked_nodes(parts)
    pairs = cut_lineage(pairs)
    sizes = spelt.groupBy("id").agg(F.count("*").alias("n"))
    ways = pairs.filter("a <> b").unionAll(pairs.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ways.join(sizes.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "n")
    itself = pairs.filter("a = b").select(F.col("a").alias("id")).join(sizes, "id").select("id", (F.col("n") - 1).alias("n"))
    links = others.unionAll(itself).groupBy("id").agg(F.sum("n").alias("n_links"))
    named = F.concat(F.lit("\x03"), F.substring_index("id", "\x01", 1), F.lit("\x01"), "name")
    of = connected_components(pairs.filter("a <> b").unionAll(spelt.select(named.alias("a"), F.col("id").alias("b"))))
    rows = spelt.join(links, "id", "left").withColumn("node", named).groupBy("node", F.substring_index("id", "\x01", 1).alias("field"), "name").agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"))
    return rows.join(of, "node").select("field", "name", F.md5("component").alias("class_id"), "n_links")


def person_variants(names: DataFrame, name: str) -> DataFrame:
    """(name_a, name_b): pairs of spellings of one person, name_a < name_b by code point."""
    return name_pairs(person_nodes(names, name)).drop("field")


def organisation_variants(names: DataFrame, name: str) -> DataFrame:
    """(name_a, name_b): pairs of spellings of one organisation, name_a < name_b by code point."""
    return name_pairs(organisation_nodes(names, name).withColumn("orgs", F.lit(True))).drop("field")
