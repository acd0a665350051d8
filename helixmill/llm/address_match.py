"""Postal addresses of one place, written differently.

Records are parsed into components: country, city, number with its letter,
street name and kind, institution name and kind.  In several passes the records
are sorted by keys that put the components into different orders (sorted
neighbourhoods); neighbours within a window are compared, and a window grows
while the first components of its key agree: all records of one postal code or
city with one number and kind of street are compared, however many there are.
Two full addresses are one place if the countries do not differ, the numbers
are equal, the kinds of street are equal, and city and street agree but for
typing errors (edit distance that counts a transposition as one).  Records
without number or street join the building of their institution in the city
where there is just one; for that, all buildings of the institution are joined
by its name, not those in a window.

Addresses that are equal after normalising are one row in the passes, so that
copies never fill a window; institutions take part only in the passes for
records that lack number or street.

Defined results: null and empty columns are missing components; a record
without a city, or without both an address and an institution, matches
nothing; repeated rows count once; a country that is not recognised counts as
missing; a city with several postal codes keeps them apart only where both
records have one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import lexicon
from helixmill.llm.canonical_map import fold, osa
from helixmill.llm.components import connected_components
from helixmill.session import cut_lineage, spread

#: Neighbours on each side that a record is compared with, at least.
WINDOW = 12

#: Kinds of street and their abbreviations (the first is the kind).
STREET_KINDS = {
    "street": ("street", "str", "st", "strasse"), "road": ("road", "rd"), "avenue": ("avenue", "ave", "av"), "lane": ("lane", "ln", "la"), "square": ("square", "sq"),
    "boulevard": ("boulevard", "blvd", "bd", "boul"), "drive": ("drive", "dr"), "court": ("court", "ct"), "way": ("way",), "place": ("place", "pl"), "terrace": ("terrace", "ter"),
    "caddesi": ("caddesi", "cad", "cd"), "sokak": ("sokak", "sok", "sk"), "rue": ("rue", "r"), "calle": ("calle", "cl", "c"), "platz": ("platz", "pl"), "weg": ("weg",), "allee": ("allee",), "via": ("via",), "plaza": ("plaza",),
}
_KIND_OF = {a: k for k, names in STREET_KINDS.items() for a in names}
_LINKS = {"of", "the", "de", "du", "des", "la", "le", "del", "no", "nr", "num", "number", "and", "for", "in", "at"}
#: General words of institutions with their abbreviations and forms; what is left of a name is its own part.
INSTITUTION_WORDS = {
    k: (k, *v.split()) for k, v in {
        "institute": "inst institut institution", "centre": "center ctr cent", "research": "res", "university": "univ uni u", "laboratory": "lab labs laboratories", "hospital": "hosp hospitals", "clinic": "clin clinics",
        "national": "natl nat natural", "general": "gen", "public": "publ", "health": "hlth", "school": "sch", "college": "coll", "faculty": "fac", "academy": "acad", "ministry": "min", "agency": "ag", "museum": "mus",
        "department": "dept", "division": "div", "service": "serv services", "station": "sta", "society": "soc", "foundation": "found", "association": "assoc", "council": "", "authority": "auth", "bureau": "", "office": "off",
        "veterinary": "vet veterinarian", "medical": "med medicine", "science": "sci sciences", "technology": "tech technological", "agriculture": "agr agric agricultural", "animal": "anim animals", "food": "", "plant": "", "marine": "mar",
        "virology": "virol", "microbiology": "microbiol", "biology": "biol biological", "epidemiology": "epidemiol", "immunology": "immunol", "parasitology": "parasitol", "entomology": "entomol", "genetics": "genet genomics", "pathology": "pathol",
        "hygiene": "hyg", "zoology": "zool zoological", "botany": "bot", "ecology": "ecol", "history": "hist", "infection": "infectious infections", "disease": "dis diseases", "zoonosis": "zoonoses zoonotic", "tropical": "trop", "control": "contr",
        "prevention": "prev", "surveillance": "surv", "diagnostic": "diagn diagnostics", "reference": "ref", "safety": "", "environment": "env environmental", "central": "centr", "federal": "fed", "regional": "reg", "state": "", "international": "intl int", "military": "mil",
    }.items()
}
_WORD_OF = {a: k for k, names in INSTITUTION_WORDS.items() for a in names}
_INSIDE = re.compile(r"\b(?:\d+(?:st|nd|rd|th)?\s*floor|floor|room|wing|building\s+[a-z]\b|campus|reception|entrance|main building|department|dept|p\.?\s?o\.?\s*box|c/o|lab wing|unit)\b", re.I)
_NUMBER = re.compile(r"(?<![\w.])(?:no\.?|nr\.?|n°|№|#)?\s*:?\s*(\d{1,5})([a-z](?![\w.]))?(?!\w)", re.I)


def _blank(s: str | None) -> bool:
    return s is None or not re.search(r"[^\W_]", s) or fold(s) in {"n a", "na", "none", "unknown", "null", "nil"}


def _pairs_of_letters(w: str) -> set[str]:
    return {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)}


_FORMS_WITH: dict[str, list[str]] = defaultdict(list)
for _form in _WORD_OF:
    for _g in _pairs_of_letters(_form) if len(_form) > 5 else ():
        _FORMS_WITH[_g].append(_form)


@lru_cache(1 << 16)
def _general_word(w: str) -> str | None:
    """The general word that is meant, also with a typing error (two in long words): those share two pairs of letters at least."""
    if w in _WORD_OF or len(w) < 5:
        return _WORD_OF.get(w)
    shared = Counter(a for g in _pairs_of_letters(w) for a in _FORMS_WITH.get(g, ()))
    near = {a for a, n in shared.items() if n > 1 and abs(len(a) - len(w)) < 3 and osa(w, a, 2) <= (2 if len(a) > 8 else 1)}
    return next((k for a, k in _WORD_OF.items() if a in near), None) if near else None


@lru_cache(1 << 16)
def _near_street_kind(w: str) -> str | None:
    if w in _KIND_OF:
        return _KIND_OF[w]
    near = next((a for a in _KIND_OF if len(w) > 3 and len(a) > 3 and osa(w, a, 2) <= (2 if len(a) > 6 else 1)), None)
    return _KIND_OF[near] if near else None


def institution_key(text: str | None) -> tuple[str, str]:
    """(own name, kind): the kind is the bag of general words in it."""
    own, kind = [], []
    for w in re.sub(r"\bph (?=lab)", "public health ", fold(text or "")).split():
        if w in _LINKS or (len(w) in (2, 3) and w not in _WORD_OF and any(osa(w, x, 1) <= 1 for x in ("of", "for", "the"))):
            continue
        k = _general_word(w)
        (kind if k else own).append(k or w)
    return "".join(own), " ".join(sorted(set(kind)))


def street_parts(line: str) -> tuple[str, str, str] | None:
    """(number, street, kind) of an address line, or None if it names no street; number may be empty."""
    text = line.replace("ß", "ss").strip(" ,;")
    number = ""
    if m := next((m for m in _NUMBER.finditer(text)), None):
        number = m.group(1).lstrip("0") + (m.group(2) or "").lower()
        text = text[: m.start()] + " " + text[m.end() :]
    words = [w for w in fold(re.sub(r"(?i)\bno\b\.?\s*:?", " ", text)).split() if w not in {"no", "nr"}]
    if not words:
        return None
    kind, name = "", []
    for k, w in enumerate(words):
        if not kind and k in (0, len(words) - 1) and len(words) > 1 and (near := _near_street_kind(w)):
            kind = near
        else:
            name.append(w)
    if kind in ("rue", "calle"):
        name = [w for w in name if w not in {"de", "du", "des", "la", "del"}] or name
    joined = "".join(name)
    if not kind and (m := re.match(r"^(.{4,}?)(strasse|str|strase|srtasse|strsse|platz|weg|allee)$", joined)):
        joined, kind = m.group(1), "street" if m.group(2).startswith(("str", "srt")) else m.group(2)
    elif not kind and len(joined) > 11 and osa(joined[-7:], "strasse", 2) <= 2:
        joined, kind = joined[:-7], "street"
    if not kind:
        return None
    return (number, joined, kind) if joined else None


def parse_record(institution: str | None, line1: str | None, line2: str | None, postal: str | None, city: str | None, country: str | None) -> tuple[str, str, str, str, str, str, str]:
    """(city, postal, number, street, street kind, institution, institution kind)"""
    post = re.sub(r"\D", "", postal or "")
    post = "" if not post.strip("0") else post
    town = "" if _blank(city) else city
    lands = {fold(country or "")} - {""}
    if town:
        bits = [b.strip() for b in town.split(",") if b.strip()]
        town = next((b for b in bits if fold(b) not in lands), town)
        if not post and (m := re.search(r"\b(\d{4,6})\b", town)):
            post = m.group(1)
        town = fold(re.sub(r"\d+", " ", town))
    best: tuple[str, str, str] | None = None
    inst = institution_key(institution)
    for line in (line1, line2):
        if _blank(line):
            continue
        pieces = [p.strip() for p in line.split(",") if p.strip()]
        merged: list[str] = []
        for p in pieces:
            if merged and re.fullmatch(r"(?i)(?:no\.?\s*:?\s*)?\d{1,5}\s?[a-z]?", p):
                merged[-1] += " " + p
            elif re.fullmatch(r"\d{1,5}\s?[a-zA-Z]?", merged[-1]) if merged else False:
                merged[-1] += " " + p
            else:
                merged.append(p)
        for k, p in enumerate(merged):
            if _INSIDE.search(p) and not re.search(r"(?i)\b(?:street|road|avenue|lane|rue|calle|caddesi)\b", p):
                continue
            got = street_parts(p)
            if got and (best is None or (got[0] and not best[0])):
                if institution_key(p) == inst and not got[0]:
                    continue
                best = got
            elif not got and k and not town and not re.search(r"\d", p) and institution_key(p)[1] == "":
                town = fold(p)
        if not town and len(merged) > 1 and not _blank(merged[-1]) and not street_parts(merged[-1]) and not _INSIDE.search(merged[-1]) and institution_key(merged[-1])[1] == "":
            town = fold(re.sub(r"\d+", " ", merged[-1]))
            post = post or "".join(re.findall(r"\b\d{4,6}\b", merged[-1])[:1])
    number, street, kind = best or ("", "", "")
    return town, post, number, street, kind, inst[0], inst[1]


_FIELDS = ("country", "city", "postal", "number", "street", "kind", "inst", "inst_kind")
_ADDRESS = _FIELDS[:6]


def parse_addresses(df: DataFrame, *, key: str, institution: str, line1: str, line2: str, postal: str, city: str, country: str) -> DataFrame:
    """The components of each record; countries as codes (the names of all countries are some thousand words)."""
    codes = lexicon.country_codes(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, str] = {}
        for batch in it:
            cols = [batch.column(k).to_pylist() for k in range(1, 7)]
            got = []
            for r in zip(*cols, strict=True):
                if r[5] not in known:
                    known[r[5]] = country_code(r[5], codes)
                got.append((known[r[5]], *parse_record(*r)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([g[k] for g in got], pa.string()) for k in range(len(_FIELDS)))], names=["id", *_FIELDS])

    return df.select(key, institution, line1, line2, postal, city, country).mapInArrow(run, "id long, " + ", ".join(f"{f} string" for f in _FIELDS))


def country_code(text: str | None, codes: dict[str, str]) -> str:
    """Code of a country as it is typed, with one typing error in a longer name; empty where none, or several, may be meant."""
    name = fold(text or "")
    for form in (name, name.replace(" ", "")):
        if form in codes:
            return codes[form]
    near = {c for n, c in codes.items() if len(name) > 4 and len(n) > 4 and osa(name, n, 1) == 1}
    return near.pop() if len(near) == 1 else ""


def resolve_cities(parsed: DataFrame) -> DataFrame:
    """Fill in country, city and postal code by what the records with the same code or city say.

    A postal code gives its commonest city to records of it without a city;
    other frequent cities of the code stay, and a rare one becomes the frequent
    one that it misspells, or else the commonest.  A city gives its postal code if it has just one, and code and city
    together give the country if there is just one.  Rows that have nothing
    to look up take part in no join.
    """
    seen = parsed.filter("city <> '' and postal <> ''").groupBy("country", "postal", "city").agg(F.count("*").alias("n"))
    lands = seen.filter("country <> ''").groupBy("postal", "city").agg(F.min("country").alias("land"), F.count("*").alias("k")).filter("k = 1").drop("k")
    rows = parsed.filter("country = '' and city <> '' and postal <> ''").join(lands, ["postal", "city"], "left").withColumn("country", F.coalesce("land", "country")).select("id", *_FIELDS)
    rows = rows.unionAll(parsed.filter("not (country = '' and city <> '' and postal <> '')").select("id", *_FIELDS))
    top = seen.groupBy("country", "postal").agg(F.max_by("city", F.struct("n", "city")).alias("top"), F.max("n").alias("top_n"))
    stays = (F.col("city") == F.col("top")) | ((F.col("n") >= 2) & (F.col("n") >= F.col("top_n") * 0.2) & (F.levenshtein("city", "top") > 2))
    cities = seen.join(top, ["country", "postal"]).withColumn("stays", stays)
    kept = cities.filter("stays").select("country", "postal", F.col("city").alias("kept"), F.col("n").alias("kept_n"))
    far = F.levenshtein("city", "kept")
    nearest = cities.filter("not stays").join(kept, ["country", "postal"]).groupBy("country", "postal", "city", "top").agg(F.min_by("kept", F.struct(far, -F.col("kept_n"), "kept")).alias("near"), F.min(far).alias("far"))
    city_of = cities.filter("stays").select("country", "postal", "city", F.col("city").alias("resolved"))
    city_of = city_of.unionAll(nearest.select("country", "postal", "city", F.when(F.col("far") <= 3, F.col("near")).otherwise(F.col("top"))))
    both = rows.filter("postal <> '' and city <> ''").join(city_of, ["country", "postal", "city"], "left").withColumn("city", F.coalesce("resolved", "city"))
    no_city = rows.filter("postal <> '' and city = ''").join(top, ["country", "postal"], "left").withColumn("city", F.coalesce("top", "city"))
    code_of = city_of.groupBy("country", F.col("resolved").alias("city")).agg(F.min("postal").alias("code"), F.count_distinct("postal").alias("k")).filter("k = 1").drop("k")
    no_code = rows.filter("postal = '' and city <> ''").join(code_of, ["country", "city"], "left").withColumn("postal", F.coalesce("code", "postal"))
    parts = [both, no_city, no_code, rows.filter("postal = '' and city = ''")]
    return parts[0].select("id", *_FIELDS).unionAll(parts[1].select("id", *_FIELDS)).unionAll(parts[2].select("id", *_FIELDS)).unionAll(parts[3].select("id", *_FIELDS))


# ---------------------------------------------------- sorted neighbourhoods


def same_place(a: dict, b: dict) -> str | None:
    """'full' for two addresses of one building, 'inst' where one lacks number or street but the institution agrees."""
    if (la := a.get("country")) and (lb := b.get("country")) and la != lb:
        return None
    if a["postal"] and b["postal"] and a["postal"] != b["postal"]:
        return None
    if (a["city"] and b["city"] or not (a["postal"] and b["postal"])) and osa(a["city"], b["city"], 2) > 2:
        return None
    full_a, full_b = bool(a["number"] and a["street"]), bool(b["number"] and b["street"])
    if full_a and full_b:
        if a["number"] != b["number"] or a["kind"] != b["kind"]:
            return None
        most = 1 if min(len(a["street"]), len(b["street"])) < 5 else 2 if min(len(a["street"]), len(b["street"])) < 9 else 3
        return "full" if osa(a["street"], b["street"], most) <= most else None
    if not a["inst"] or a["inst_kind"] != b["inst_kind"] or osa(a["inst"], b["inst"], 2) > (2 if len(a["inst"]) > 6 else 1):
        return None
    if a["street"] and b["street"] and (a["kind"] != b["kind"] or osa(a["street"], b["street"], 2) > 2):
        return None
    return None if a["number"] and b["number"] and a["number"] != b["number"] else "inst"


#: Components of a sort key, and how many of them must agree for a window to grow (0: it never does).
Pass = tuple[list[str], int]


def _compare(a: dict, b: dict, found: dict[tuple[int, int], tuple[str, int]]) -> None:
    pair = (a["id"], b["id"]) if a["id"] < b["id"] else (b["id"], a["id"])
    if pair[0] != pair[1] and pair not in found and (how := same_place(a, b)):
        found[pair] = (how, osa(a["inst"], b["inst"], 2))


def sorted_neighbours(rows: DataFrame, passes: tuple[Pass, ...], *, window: int = WINDOW, lacking: bool = False) -> DataFrame:
    """(a, b, how, inst_distance) of the matches within the window of any sort order.

    With ``lacking`` two records that both have number and street are not compared.

    Each row stands once in each pass; the passes are sorted together, the
    number of the pass being the first part of the key.  Rows are
    range-partitioned by the part of the key that lets windows grow, or, where
    they do not, by the whole key and the id, so that no key, however frequent,
    makes a partition of its own.  The first and last ``window`` rows of each
    partition meet those of the partitions around by their rank in the whole
    order: ranks are cut into overlapping ranges, each compared by itself.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows if "country" in rows.columns else rows.withColumn("country", F.lit(""))
    keys = [F.concat_ws("\x01", F.lit(f"{k:02d}"), *key) for k, (key, _) in enumerate(passes)]
    grow = [F.concat_ws("\x01", F.lit(f"{k:02d}"), *key[:n]) if n else F.lit("") for k, (key, n) in enumerate(passes)]
    usable = [F.lit(True) if not n else reduce(lambda x, y: x & y, (F.col(c) != "" for c in key[:n] if c != "country")) for key, n in passes]
    orders = F.filter(F.array(*(F.when(u, F.struct(k.alias("key"), g.alias("grow"))) for k, g, u in zip(keys, grow, usable, strict=True))), lambda x: x.isNotNull())
    fields = ["id", *_FIELDS]
    ordered = rows.select(F.explode(orders).alias("__o"), *fields).select(F.col("__o.key").alias("__key"), F.col("__o.grow").alias("__grow"), *fields)
    ordered = ordered.withColumn("__range", F.when(F.col("__grow") == "", F.col("__key")).otherwise(F.col("__grow"))).withColumn("__spread", F.when(F.col("__grow") == "", F.col("id")).otherwise(0))
    ordered = ordered.repartitionByRange(parts, "__range", "__spread").sortWithinPartitions("__range", "__key", "id")
    schema = "part int, at long, a long, b long, how string, inst_distance int, " + ", ".join(f"{f} string" for f in _FIELDS)

    def emit(found: dict, border: list[tuple[int, int, dict]]) -> pa.RecordBatch:
        pairs = list(found.items())
        n, m = len(pairs), len(border)
        return pa.RecordBatch.from_arrays(
            [pa.array([None] * n + [p for p, _, _ in border], pa.int32()), pa.array([None] * n + [at for _, at, _ in border], pa.int64()), pa.array([p[0] for p, _ in pairs] + [r.get("id") for _, _, r in border], pa.int64()), pa.array([p[1] for p, _ in pairs] + [None] * m, pa.int64()), pa.array([v[0] for _, v in pairs] + [None] * m, pa.string()), pa.array([v[1] for _, v in pairs] + [None] * m, pa.int32())]
            + [pa.array([None] * n + [r.get(f) for _, _, r in border], pa.string()) for f in _FIELDS],
            names=["part", "at", "a", "b", "how", "inst_distance", *_FIELDS],
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        head: list[tuple[int, int, dict]] = []
        near: list[dict] = []  # the rows before that are in the window, or share what lets it grow
        at = 0
        for batch in it:
            found: dict = {}
            for r in batch.to_pylist():
                g = r["__grow"]
                if len(near) > window and (not g or near[0]["__grow"] != g):
                    near = [x for x in near[:-window] if g and x["__grow"] == g] + near[-window:]
                whole = lacking and bool(r["number"] and r["street"])
                for x in near:
                    if not (whole and x["number"] and x["street"]):
                        _compare(x, r, found)
                if at < window:
                    head.append((part, at, r))
                near.append(r)
                at += 1
            if found:
                yield emit(found, [])
        tail = [(part, at - len(near[-window:]) + k, r) for k, r in enumerate(near[-window:])]
        # one row more that tells how many rows the partition has
        yield emit({}, head + [x for x in tail if x[1] >= len(head)] + [(part, at, {})])

    out = cut_lineage(ordered.mapInArrow(run, schema))
    counts = {r["part"]: r["at"] for r in out.filter("part is not null and a is null").select("part", "at").collect()}  # a row a partition
    first, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        first.append((p, total))
        total += counts.get(p, 0)
    border = out.filter("part is not null and a is not null")
    if first:
        border = border.join(F.broadcast(spark.createDataFrame(first, "part int, first long")), "part").withColumn("rank", F.col("first") + F.col("at"))
    else:
        border = border.withColumn("rank", F.col("at"))
    low = F.floor(F.col("rank") / window)
    border = border.withColumn("bucket", F.explode(F.array(low, low + 1))).withColumn("id", F.col("a"))

    def across(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[dict] = []
        for batch in it:
            found: dict = {}
            for r in batch.to_pylist():
                near = [x for x in near if x["bucket"] == r["bucket"] and r["rank"] - x["rank"] <= window]
                whole = lacking and bool(r["number"] and r["street"])
                for x in near:
                    if x["part"] != r["part"] and not (whole and x["number"] and x["street"]):
                        _compare(x, r, found)
                near.append(r)
            if found:
                yield emit(found, [])

    met = border.select("bucket", "rank", "part", *fields).repartition("bucket").sortWithinPartitions("bucket", "rank").mapInArrow(across, schema)
    return out.filter("part is null").unionAll(met).select("a", "b", "how", "inst_distance")


#: The passes: components in differing orders; ``rstreet`` is the street from its end.
STREET_PASSES: tuple[Pass, ...] = (
    (["country", "postal", "number", "kind", "street"], 4),
    (["country", "city", "number", "kind", "rstreet"], 4),
    (["street", "number", "postal", "city", "kind"], 0),
    (["rstreet", "kind", "number", "city"], 0),
)
INSTITUTION_PASSES: tuple[Pass, ...] = (
    (["inst", "inst_kind", "postal", "city", "street", "number"], 0),
    (["country", "postal", "inst_kind", "inst", "street", "number"], 3),
    (["country", "city", "inst_kind", "rinst", "number"], 3),
)
PASSES = (*STREET_PASSES, *INSTITUTION_PASSES)


def buildings_of_institution(open_side: DataFrame, weak: DataFrame, full: DataFrame) -> DataFrame:
    """(a, place, d): all buildings that a record without number or street may mean.

    The institution is looked up as the record names it and as each record
    that it was matched with (``open_side``: a and the names of b) names it, in
    the postal code, or in the city where one of the two has no code; ``d`` is
    the distance of the names.
    """
    where = ("inst", "inst_kind", "postal", "city")
    named = cut_lineage(weak.select(F.col("id").alias("a"), *where).unionAll(open_side.select("a", *where)).distinct())
    right = full.select(*(F.col(f).alias(f"b_{f}") for f in _FIELDS), "place").distinct()
    same = (F.col("inst") == F.col("b_inst")) & (F.col("inst_kind") == F.col("b_inst_kind"))
    coded = named.filter("postal <> ''").join(right, same & (F.col("postal") == F.col("b_postal")))
    uncoded = named.join(right, same & (F.col("city") == F.col("b_city"))).filter("postal = '' or b_postal = ''")
    pairs = coded.unionAll(uncoded).select("a", "place", *(f"b_{f}" for f in _FIELDS)).distinct()
    pairs = pairs.join(weak.select(F.col("id").alias("a"), *(F.col(f).alias(f"a_{f}") for f in _FIELDS)), "a")

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = []
            for r in batch.to_pylist():
                x, y = ({f: r[f"{side}_{f}"] for f in _FIELDS} for side in "ab")
                if same_place(x, y) == "inst":
                    got.append((r["a"], r["place"], osa(x["inst"], y["inst"], 2)))
            cols = list(zip(*got, strict=True)) if got else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["a", "place", "d"])

    return pairs.mapInArrow(check, "a long, place long, d int").groupBy("a", "place").agg(F.min("d").alias("d"))


def match_addresses(df: DataFrame, **columns: str) -> DataFrame:
    """(id, place) of each record that shares its building with another one."""
    rows = cut_lineage(parse_addresses(spread(df.select(*columns.values()).distinct()), **columns))
    rows = cut_lineage(resolve_cities(rows).filter("city <> '' or postal <> ''").distinct())
    is_full = F.expr("number <> '' and street <> ''")
    # copies: equal addresses, or equal components of records that lack number or street, under several ids
    least = rows.filter(is_full).groupBy(*_ADDRESS).agg(F.min("id").alias("first"))
    weak_least = rows.filter(~is_full & (F.col("inst") != "")).groupBy(*_FIELDS).agg(F.min("id").alias("first"))
    streets = least.select(F.col("first").alias("id"), *_ADDRESS, F.reverse("street").alias("rstreet")).withColumns({"inst": F.lit(""), "inst_kind": F.lit("")})
    of_address = rows.filter(is_full).join(least, list(_ADDRESS))
    weak = weak_least.withColumnRenamed("first", "id").withColumn("is_full", F.lit(False))
    named = of_address.filter("inst <> ''").groupBy(*_FIELDS).agg(F.min("first").alias("id")).withColumn("is_full", F.lit(True))
    copies = of_address.unionByName(rows.filter(~is_full & (F.col("inst") != "")).join(weak_least, list(_FIELDS))).filter("first <> id").select(F.col("first").alias("a"), F.col("id").alias("b"))
    place_of = connected_components(sorted_neighbours(streets, STREET_PASSES).select("a", "b").distinct())
    # records that lack number or street: the buildings of their institution.  An address stands once for each of its institutions
    reps = cut_lineage(named.unionByName(weak).withColumn("row", F.xxhash64("is_full", *_FIELDS)))
    met = sorted_neighbours(reps.select(F.col("row").alias("id"), *_FIELDS, F.reverse("street").alias("rstreet"), F.reverse("inst").alias("rinst")), INSTITUTION_PASSES, lacking=True)
    met = cut_lineage(met.filter("how = 'inst'").select("a", "b", "inst_distance").distinct())
    met = met.unionAll(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "inst_distance"))
    one = reps.filter("not is_full").select(F.col("row").alias("a"), F.col("id").alias("a_id"))
    other = reps.select(F.col("row").alias("b"), F.col("id").alias("b_id"), "is_full", "inst", "inst_kind", "postal", "city")
    open_side = met.join(one, "a").join(other, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "is_full", "inst_distance", "inst", "inst_kind", "postal", "city")
    open_side = cut_lineage(open_side)
    full = reps.filter("is_full").join(place_of, F.col("id") == F.col("node"), "left").withColumn("place", F.coalesce("component", "id"))
    to_full = cut_lineage(buildings_of_institution(open_side, reps.filter("not is_full"), full))
    best = to_full.groupBy("a").agg(F.min("d").alias("d"))
    counted = cut_lineage(to_full.join(best, ["a", "d"]).groupBy("a").agg(F.count("*").alias("n"), F.min("place").alias("b")))
    ambiguous = counted.filter("n > 1").select("a")
    among = open_side.filter("not is_full and inst_distance <= 1").select("a", "b")
    among = among.join(ambiguous, "a", "left_anti").join(ambiguous.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b")
    links = place_of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(counted.filter("n = 1").select("a", "b")).unionAll(among).unionAll(copies)
    return connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("place"))


def place_classes(places: DataFrame) -> DataFrame:
    """(id, place, n_links): each record with its place and the number of other records there, without writing out the pairs."""
    sizes = places.groupBy("place").agg((F.count("*") - 1).alias("n_links"))
    return places.join(sizes, "place").select("id", "place", "n_links")


def place_pairs(places: DataFrame) -> DataFrame:
    """(a, b) of all records of one place, a < b."""
    left, right = places.select("place", F.col("id").alias("a")), places.select("place", F.col("id").alias("b"))
    return left.join(right, "place").filter("a < b").select("a", "b")
