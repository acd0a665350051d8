"""Other names of countries and hosts, and the readings of free-entered values.

Names of countries in many languages and their codes come from the JVM's own
locale data; only what it lacks is listed here.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from helixmill.llm.canonical_map import NameIndex, fold

#: Entry of names that are known to be outside a list (not the same as no match).
OUTSIDE = -2

#: Languages whose country names are taken.
LANGUAGES = "en de fr es pt it nl pl cs hu ro hr sl sq tr az uz kk ru uk el sv nb fi id sw vi ar zh ja ko fa hi ka hy".split()

#: Codes of listed countries whose usual English name differs (public ISO codes).
CODE_OF = {
    "USA": "US", "Viet Nam": "VN", "Democratic Republic of the Congo": "CD", "Republic of the Congo": "CG", "Myanmar": "MM",
    "Kosovo": "XK", "South Korea": "KR", "Cote d'Ivoire": "CI", "Turkey": "TR", "Czechia": "CZ", "Bosnia and Herzegovina": "BA",
}

#: Former, formal, native and short names that locale data lacks.
COUNTRY_NAMES = {
    "Afghanistan": ["Islamic Republic of Afghanistan"], "Albania": ["Shqiperia"], "Algeria": ["Al Jazair", "People's Democratic Republic of Algeria"],
    "Argentina": ["Argentine Republic"], "Armenia": ["Hayastan"], "Australia": ["Commonwealth of Australia"], "Austria": ["Oesterreich"],
    "Belarus": ["Byelorussia", "White Russia", "Weissrussland", "Belorussia"], "Benin": ["Dahomey"], "Bolivia": ["Plurinational State of Bolivia"],
    "Bosnia and Herzegovina": ["Bosnia", "BiH", "Bosnia-Herzegovina"], "Burkina Faso": ["Upper Volta", "Haute-Volta"], "Bulgaria": ["Balgariya"],
    "Cambodia": ["Kampuchea", "Khmer Republic"], "Central African Republic": ["C.A.R.", "CAR", "Centrafrique", "République centrafricaine"],
    "China": ["PR China", "P.R. China", "PRC", "People's Republic of China", "Zhongguo", "Mainland China"], "Colombia": ["Republic of Colombia"],
    "Cote d'Ivoire": ["Ivory Coast", "Elfenbeinküste", "Republic of Cote d'Ivoire"], "Croatia": ["Hrvatska"], "Czechia": ["Czech Republic", "Ceska republika", "Cesko"],
    "Democratic Republic of the Congo": ["DR Congo", "D.R. Congo", "DRC", "Congo-Kinshasa", "Congo (Kinshasa)", "Zaire", "Congo, Democratic Republic of the", "Congo, The Democratic Republic of the", "République démocratique du Congo", "Belgian Congo"],
    "Dominica": ["Commonwealth of Dominica"], "Dominican Republic": ["Dom. Rep.", "Dominican Rep.", "República Dominicana"], "Egypt": ["Arab Republic of Egypt", "Misr"],
    "Equatorial Guinea": ["Eq. Guinea", "Spanish Guinea"], "Eswatini": ["Swaziland", "Kingdom of Eswatini"], "Ethiopia": ["Abyssinia"],
    "France": ["République française", "French Republic"], "Gambia": ["The Gambia", "Republic of The Gambia"], "Georgia": ["Sakartvelo", "Republic of Georgia", "Gruziya"],
    "Germany": ["Federal Republic of Germany", "BRD", "Bundesrepublik Deutschland"], "Ghana": ["Gold Coast"], "Greece": ["Hellas", "Hellenic Republic", "Ellada"],
    "Guinea": ["Guinea-Conakry", "Republic of Guinea", "French Guinea"], "Guinea-Bissau": ["Guiné-Bissau", "Portuguese Guinea", "Guinea Bissau"],
    "Hungary": ["Magyarorszag"], "India": ["Bharat", "Republic of India"], "Indonesia": ["Republik Indonesia", "Dutch East Indies"],
    "Iran": ["Islamic Republic of Iran", "Persia", "Iran, Islamic Republic of"], "Ireland": ["Eire", "Republic of Ireland"], "Israel": ["State of Israel"],
    "Japan": ["Nippon", "Nihon"], "Kazakhstan": ["Qazaqstan"], "Kosovo": ["XKX", "Kosova", "Republic of Kosovo"], "Laos": ["Lao PDR", "Lao People's Democratic Republic", "Lao"],
    "Libya": ["State of Libya", "Libyan Arab Jamahiriya"], "Malawi": ["Nyasaland"], "Mali": ["République du Mali", "French Sudan"], "Mauritius": ["Ile Maurice", "Maurice"],
    "Mexico": ["United Mexican States", "Estados Unidos Mexicanos"], "Mongolia": ["Mongol Uls"], "Myanmar": ["Burma", "Birma", "Birmanie"], "Netherlands": ["Holland", "Pays-Bas", "The Netherlands"],
    "Niger": ["République du Niger"], "Nigeria": ["Federal Republic of Nigeria"], "North Macedonia": ["FYROM", "Macedonia", "Severna Makedonija", "Former Yugoslav Republic of Macedonia"],
    "Oman": ["Sultanate of Oman", "Muscat and Oman"], "Pakistan": ["Islamic Republic of Pakistan"], "Portugal": ["República Portuguesa", "Portuguese Republic"],
    "Republic of the Congo": ["Congo-Brazzaville", "Congo (Brazzaville)", "République du Congo", "Rep. of the Congo", "Congo Republic", "Congo, Republic of the"], "Romania": ["Rumania", "Roumania"],
    "Russia": ["Russian Federation", "Rossiya"], "Saudi Arabia": ["KSA", "Kingdom of Saudi Arabia"], "Serbia": ["Srbija"], "Sierra Leone": ["S. Leone"], "Slovakia": ["Slovak Republic", "Slovensko"],
    "Slovenia": ["Slovenija"], "South Africa": ["RSA", "Republic of South Africa", "Rep. of South Africa"], "South Korea": ["Republic of Korea", "Korea, Republic of", "S. Korea", "ROK", "Korea (South)", "Hanguk"],
    "South Sudan": ["S. Sudan", "Republic of South Sudan"], "Spain": ["Kingdom of Spain"], "Sudan": ["Republic of the Sudan"], "Switzerland": ["Swiss Confederation", "Helvetia"],
    "Tajikistan": ["Tojikiston"], "Tanzania": ["United Republic of Tanzania", "Tanzania, United Republic of", "Tanganyika"], "Thailand": ["Siam", "Kingdom of Thailand"],
    "Turkey": ["Türkiye", "Republic of Türkiye"], "USA": ["U.S.A.", "U.S.", "US", "United States", "United States of America", "America", "EE. UU.", "Etats-Unis"],
    "Ukraine": ["Ukraina"], "United Arab Emirates": ["UAE", "U.A.E.", "Emirates", "Trucial States"], "United Kingdom": ["UK", "U.K.", "Great Britain", "Britain", "United Kingdom of Great Britain and Northern Ireland"],
    "Uzbekistan": ["O'zbekiston"], "Viet Nam": ["Vietnam", "Socialist Republic of Viet Nam"], "Zambia": ["Northern Rhodesia"], "Zimbabwe": ["Southern Rhodesia", "Rhodesia"],
}

#: Names of several entries, of former unions and of regions.
NO_COUNTRY = ["Congo", "Kongo", "Korea", "North Korea", "Czechoslovakia", "Yugoslavia", "Soviet Union", "USSR", "Serbia and Montenegro", "East Africa", "West Africa", "Central Asia", "Middle East", "Europe", "Balkans", "Africa", "Asia", "Scandinavia", "Caucasus", "Rhodesia and Nyasaland"]

FORMAL = ("Republic of {}", "Republic of the {}", "{} Republic", "Kingdom of {}", "State of {}", "República de {}", "République du {}", "République de {}")
#: Words of formal names.
GENERIC = ("republic", "of", "the", "kingdom", "state", "federal", "commonwealth", "peoples", "islamic", "democratic", "socialist", "republica", "republique", "republik", "de", "du", "sultanate", "plurinational", "arab")
#: Entries whose formal names mean another entry.
NO_FORMAL = {"Republic of the Congo", "Democratic Republic of the Congo", "Dominica", "Dominican Republic", "Central African Republic", "USA", "South Korea", "United Kingdom", "United Arab Emirates"}


def country_index(spark: SparkSession, listed: list[tuple[int, str]]) -> NameIndex:
    """Names and codes of the listed countries, and names of those outside the list."""
    locale = spark._jvm.java.util.Locale
    codes = [str(c) for c in locale.getISOCountries()]
    codes += [] if "XK" in codes else ["XK"]
    places = {c: locale("", c) for c in codes}
    tongues = [locale(x) for x in LANGUAGES]
    english = {c: p.getDisplayCountry(locale("en")) for c, p in places.items()}
    by_name = {fold(n): c for c, n in english.items()}
    names: list[tuple[int, str]] = []
    exact: dict[str, set[int]] = {}
    used = set()
    for ref, name in listed:
        names.append((ref, name))
        names += [(ref, x) for x in COUNTRY_NAMES.get(name, [])]
        if name not in NO_FORMAL:
            names += [(ref, f.format(name)) for f in FORMAL]
        code = CODE_OF.get(name) or by_name.get(fold(name))
        if code is None:
            continue
        used.add(code)
        for tongue in tongues:
            names += [(ref, x.strip()) for x in re.split(r"[()]", places[code].getDisplayCountry(tongue)) if x.strip()]
        short = [code] if code == "XK" else [code, places[code].getISO3Country()]
        short += [x for x in COUNTRY_NAMES.get(name, []) if x.isupper() and len(x) <= 6]
        for c in short:
            exact.setdefault(c, set()).add(ref)
            exact.setdefault(c.replace(".", ""), set()).add(ref)
    names += [(OUTSIDE, x) for x in NO_COUNTRY]
    names += [(OUTSIDE, x.strip()) for c in codes if c not in used for x in re.split(r"[()]", english[c]) if x.strip()]
    # a name that stands in the list itself, or among its plain other names, wins over foreign words
    plain = {fold(n): r for r, n in listed} | {fold(x): r for r, n in listed for x in COUNTRY_NAMES.get(n, [])}
    none = {fold(x) for x in NO_COUNTRY}
    names = [(r, n) for r, n in names if (fold(n) not in plain or plain[fold(n)] == r) and (fold(n) not in none or r == OUTSIDE)]
    return NameIndex(list(dict.fromkeys(names)), exact, GENERIC)


def country_codes(spark: SparkSession) -> dict[str, str]:
    """Code of each country by its name in English and in its own languages, its other names and its codes."""
    locale = spark._jvm.java.util.Locale
    english = locale("en")
    codes = sorted({str(c) for c in locale.getISOCountries()} | {"XK"})
    usual = {c: n for n, c in CODE_OF.items()}
    out: dict[str, str] = {}
    for code in codes:
        name = str(locale("", code).getDisplayCountry(english))
        listed = usual.get(code, name)
        for x in (name, *COUNTRY_NAMES.get(listed, []), *(() if listed in NO_FORMAL else (f.format(listed) for f in FORMAL))):
            out.setdefault(fold(x), code)
    for own in locale.getAvailableLocales():
        if own.getCountry() in codes:
            out.setdefault(fold(own.getDisplayCountry(own)), own.getCountry())
    for code in codes:
        out.setdefault(fold(code), code)
        if code != "XK":
            out.setdefault(fold(locale("", code).getISO3Country()), code)
    return {n: c for n, c in out.items() if n and n not in {fold(x) for x in NO_COUNTRY}}


_REMARK = re.compile(r"\b(?:near|close to|bordering|next to|imported from|travel(?:led)? from|via)\b.*$", re.I)
_SEVERAL = re.compile(r"\s+(?:or|and/or|oder|ou)\s+|\s*/\s*", re.I)


def country_parts(value: str) -> list[list[str]]:
    """Readings of a country field: whole, before a colon or bracket, after the last comma."""
    v = value.strip().strip("\"'[]{}<>").strip()
    v = re.sub(r"^(?:country|location|geo_?loc(?:ation)?|origin)\s*[:=]\s*", "", v, flags=re.I)
    v = _REMARK.sub("", v).strip(" ,;.")
    if not v:
        return []
    out = [[v]]
    if len(several := [x for x in _SEVERAL.split(v) if x]) > 1:
        return [several]
    if ":" in v:
        head = v.split(":", 1)[0].strip()
        return [[head], *([[head.split("(")[0]]] if "(" in head else [])]
    if "(" in v or "[" in v:
        head = re.split(r"[(\[]", v)[0].strip()
        inner = re.findall(r"[(\[]([^)\]]*)", v)
        out += [[head], inner]
    for sep in (",", ";", " - ", "|"):
        if sep in v:
            pieces = [p.strip() for p in v.split(sep) if p.strip()]
            rest = v.split(sep, 1)[1].strip()  # "place, country" where the country has the sign itself
            out += [*([[rest]] if rest else []), [pieces[-1]], [pieces[0]]] if pieces else []
    return out


#: Other names of hosts: synonyms of the scientific and the common names.
HOST_NAMES = {
    "Homo sapiens": ["humans", "human being", "human beings", "Mensch", "humain", "humano", "man", "woman", "patient", "people", "homme", "H. sapiens sapiens", "Homo sapiens sapiens"],
    "Bos taurus": ["cow", "dairy cow", "domestic cow", "bovine", "calf", "ox", "Rind", "vaca", "vache", "bull", "heifer", "Kuh", "domestic cattle", "taurine cattle"],
    "Bos indicus": ["humped cattle", "Bos taurus indicus", "zebu cattle", "indicine cattle", "Bos primigenius indicus"],
    "Ovis aries": ["ewe", "lamb", "ovine", "ram", "domestic sheep", "mouton", "Schaf", "oveja", "Ovis orientalis aries", "brebis"],
    "Capra hircus": ["caprine", "domestic goat", "Ziege", "cabra", "chèvre", "Capra aegagrus hircus", "billy goat", "nanny goat"],
    "Camelus dromedarius": ["Arabian camel", "one-humped camel", "dromedary", "Dromedar", "dromadaire"], "Camelus bactrianus": ["two-humped camel", "Trampeltier"],
    "Equus caballus": ["equine", "mare", "stallion", "Pferd", "caballo", "cheval", "domestic horse", "Equus ferus caballus", "foal"],
    "Equus asinus": ["ass", "domestic donkey", "Esel", "burro", "Equus africanus asinus", "jackass", "âne"], "Sus scrofa": ["boar", "Eurasian wild pig", "wild pig", "Wildschwein", "sanglier", "jabalí"],
    "Sus domesticus": ["hog", "domestic pig", "swine", "porcine", "Sus scrofa domesticus", "Schwein", "cerdo", "porc", "sow", "piglet", "Sus scrofa domestica"],
    "Canis lupus familiaris": ["canine", "Hund", "chien", "perro", "domestic dog", "Canis familiaris"], "Felis catus": ["cat", "feline", "house cat", "Katze", "chat", "gato", "Felis silvestris catus", "Felis domesticus"],
    "Mus musculus": ["common house mouse", "Hausmaus", "Mus musculus domesticus", "laboratory mouse", "lab mouse", "suckling mouse", "mouse"], "Rattus norvegicus": ["Norway rat", "Norwegian rat", "sewer rat", "Wanderratte", "street rat", "laboratory rat"],
    "Rattus rattus": ["ship rat", "roof rat", "Hausratte", "house rat"], "Lepus europaeus": ["brown hare", "Feldhase", "European brown hare"], "Erinaceus europaeus": ["common hedgehog", "West European hedgehog", "Western European hedgehog", "Braunbrustigel", "Igel"],
    "Hemiechinus auritus": ["long eared hedgehog"], "Gallus gallus": ["hen", "broiler", "domestic fowl", "Gallus gallus domesticus", "Gallus domesticus", "Huhn", "poulet", "gallina", "rooster", "domestic chicken", "layer hen", "poule"],
    "Anas platyrhynchos": ["mallard duck", "wild duck", "Stockente", "wild mallard"], "Meleagris gallopavo": ["domestic turkey", "wild turkey", "Truthahn", "dinde", "Pute", "turkey hen", "turkey poult"], "Struthio camelus": ["common ostrich", "farmed ostrich", "Strauss", "autruche", "avestruz"],
    "Corvus corone": ["Rabenkrähe", "corneille noire", "Corvus corone corone"], "Passer domesticus": ["English sparrow", "Haussperling", "moineau domestique"],
    "Hyalomma marginatum": ["Hyalomma marginatum marginatum", "Hyalomma m. marginatum"], "Hyalomma anatolicum": ["Hyalomma anatolicum anatolicum", "Hyalomma a. anatolicum"], "Hyalomma asiaticum": ["Hyalomma asiaticum asiaticum", "Hyalomma a. asiaticum"],
    "Rhipicephalus microplus": ["Boophilus microplus", "Rhipicephalus (Boophilus) microplus", "Rh. (Boophilus) microplus", "southern cattle tick", "Asian blue tick"], "Ixodes ricinus": ["castor-bean tick", "sheep tick", "wood tick"],
    "Amblyomma variegatum": ["bont tick, tropical", "variegated tick"], "Culex pipiens": ["common house mosquito", "Culex pipiens pipiens"], "Culex quinquefasciatus": ["Culex pipiens quinquefasciatus", "Culex fatigans"],
    "Aedes aegypti": ["Stegomyia aegypti"], "Rhipicephalus sanguineus": ["kennel tick"],
    "Aedes albopictus": ["tiger mosquito", "Stegomyia albopicta", "forest day mosquito"], "Anopheles gambiae": ["Anopheles gambiae s.s.", "Anopheles gambiae sensu stricto"], "Rousettus aegyptiacus": ["Egyptian rousette", "Rousettus egyptiacus"],
    "Macaca mulatta": ["rhesus monkey", "rhesus"], "Chlorocebus aethiops": ["African green monkey", "Cercopithecus aethiops", "vervet", "green monkey"], "Mastomys natalensis": ["multimammate rat", "Natal multimammate rat", "multimammate mouse", "Praomys natalensis"],
    "Eidolon helvum": ["straw-colored fruit bat", "African straw-coloured fruit bat"], "Dermacentor marginatus": ["sheep tick, ornate"],
}

#: Names of animal groups above the species (fixed values); those that the list itself implies are derived from it.
GROUPS = (
    "arthropod arthropods insect insects tick ticks hard_tick mosquito mosquitoes ixodidae culicidae bird birds wild_bird bat bats fruit_bat rodent rodents livestock ruminant ruminants "
    "poultry mammal mammals primate primates monkey monkeys ape apes"
).split()
#: Words that stand for no host at all.
NO_HOST = ("unknown", "not applicable", "environment", "cell culture")


def host_groups(listed: list[tuple[int, str, str]]) -> list[str]:
    """Names that mean several hosts: genera, and the last words of common names of two words or more."""
    out = [g.replace("_", " ") for g in GROUPS]
    for genus in sorted({scientific.split()[0] for _, scientific, _ in listed}):
        out += [genus, f"{genus} sp.", f"{genus} spp."]
    own = {fold(common) for _, _, common in listed}
    for noun in sorted({fold(common).split()[-1] for _, _, common in listed if len(fold(common).split()) > 1} - own):
        out += [noun, f"{noun}s"]
    return out


def host_index(listed: list[tuple[int, str, str]]) -> NameIndex:
    """Names of the listed hosts with abbreviated genera; ids as codes."""
    names: list[tuple[int, str]] = []
    codes: dict[str, set[int]] = {}
    for ref, scientific, common in listed:
        more = HOST_NAMES.get(scientific, [])
        names += [(ref, x) for x in (scientific, common, *more)]
        for x in (scientific, *more):
            words = x.split()
            if len(words) > 1 and words[0][0].isupper() and words[1].islower() and fold(x) != fold(common) and x not in HOST_COMMON:
                rest = " ".join(words[1:])
                names += [(ref, f"{words[0][:n]}. {rest}") for n in (1, 2)]
                if words[0] == "Culex":
                    names.append((ref, f"Cx. {rest}"))
        codes.setdefault(str(ref), set()).add(ref)
        codes.setdefault(f"{ref}.0", set()).add(ref)
    given = {fold(n) for _, n in names}
    names += [(OUTSIDE, x) for x in (*host_groups(listed), *NO_HOST) if fold(x) not in given]
    return NameIndex(list(dict.fromkeys(names)), codes)


#: Common names that begin with a capital letter and are never abbreviated.
HOST_COMMON = {"Arabian camel", "Norway rat", "English sparrow", "Eurasian wild pig", "Egyptian rousette", "African green monkey", "European brown hare", "West European hedgehog", "Western European hedgehog", "Norwegian rat", "Asian blue tick", "Natal multimammate rat", "African straw-coloured fruit bat"}

_HOST_REMARK = re.compile(
    r"(?:[,;]\s*(?:adult|juvenile|nymph|larva|larvae|age\s*\d+.*|blood|serum|swab|tissue|whole tick|male|female|engorged|questing|sex.*|pool(?:ed)?.*|stage.*))+$"
    r"|\s*\((?:fe)?male\)$|\s*\((?:adult|juvenile|pooled|nymph|larva|pool)\)$|\s+-\s+(?:pooled|pool.*|adult|blood|serum)$|\s+(?:serum|blood|swab|plasma|pool|sample|tissue)$",
    re.I,
)


def host_parts(value: str) -> list[list[str]]:
    """Readings of a host field without remarks: whole, before a bracket, in brackets."""
    v = value.strip().strip("\"'").strip()
    v = re.sub(r"^(?:host|species|organism|animal)\s*[:=]\s*", "", v, flags=re.I)
    for _ in range(4):
        shorter = _HOST_REMARK.sub("", v).strip()
        if shorter == v:
            break
        v = shorter
    v = v.replace("_", " ").strip(" ,;")
    if not v:
        return []
    if code := re.match(r"^(?:ncbi\s*)?(?:txid|tax(?:on(?:omy)?)?[ _]?(?:id)?)\s*[:=#]?\s*(\d+)$", v, re.I):
        return [[code.group(1)]]
    if len(several := [x for x in re.split(r"\s+(?:or|and/or|oder|ou)\s+", re.sub(r"\([^)]*\)", "", v)) if x.strip()]) > 1:
        return [several]
    out = [[v]]
    if re.search(r"[(\[]", v):
        head = re.split(r"[(\[]", v)[0].strip()
        inner = [x for x in re.findall(r"[(\[]([^)\]]*)", v) if x.strip()]
        out += [[head], inner]
    for sep in (",", ";", " - ", "|"):
        if sep in v:
            out.append([v.split(sep)[0]])
    return out
