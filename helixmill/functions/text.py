"""Small functions on text: accessions, digests, authors, countries."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols of accessions: digits and capitals without I and O (fixed value).
ACCESSION_ALPHABET = "0123456789ABCDEFGHJKLMNPQRSTUVWXYZ"


def check_symbol(code: str) -> str:
    """Check symbol by Luhn's rule in the alphabet's base."""
    n, total, factor = len(ACCESSION_ALPHABET), 0, 2
    for ch in reversed(code):
        v = factor * ACCESSION_ALPHABET.index(ch)
        total += v // n + v % n
        factor = 3 - factor
    return ACCESSION_ALPHABET[-total % n]


def accession(number: int, prefix: str = "", width: int = 6) -> str:
    """Prefix, the number in the alphabet's base, check symbol."""
    n, digits = len(ACCESSION_ALPHABET), ""
    while number:
        number, r = divmod(number, n)
        digits = ACCESSION_ALPHABET[r] + digits
    digits = digits.rjust(width, "0")
    return prefix + digits + check_symbol(digits)


def valid_accession(text: str, prefix: str = "") -> bool:
    body = text.removeprefix(prefix).upper()
    return text.startswith(prefix) and len(body) > 1 and all(c in ACCESSION_ALPHABET for c in body) and check_symbol(body[:-1]) == body[-1]


def accession_column(number: Column, prefix: str = "") -> Column:
    @F.pandas_udf("string")
    def make(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if pd.isna(x) else accession(int(x), prefix))

    return make(number)


def base(c: Column) -> Column:
    """Accession without its version."""
    return F.substring_index(c, ".", 1)


def version_of(c: Column) -> Column:
    """Version of ``accession.version``; null unless there is one dot and a positive whole number."""
    return F.when(c.rlike(r"^[^.]+\.[1-9]\d*$"), F.substring_index(c, ".", -1).try_cast("bigint"))


def md5_fraction(c: Column) -> Column:
    """The first 52 bits of the md5 digest as a fraction of 1."""
    return F.conv(F.substring(F.md5(c), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def split_compound(c: Column, sep: str = ":") -> tuple[Column, Column]:
    """``a:b`` as (a, b); (value, null) without the separator."""
    at = F.instr(c, sep)
    return F.when(at > 0, F.trim(F.substring_index(c, sep, 1))).otherwise(c), F.when(at > 0, F.trim(F.substr(c, at + 1)))


def sorted_authors(c: Column, sep: str = ";") -> Column:
    """Authors in order of their names."""
    parts = F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_sort(parts), f"{sep} ")


def country_with_levels(*parts: Column) -> Column:
    """Country and administrative levels joined by commas, without missing ones."""
    return F.concat_ws(", ", *(F.when(F.trim(p) != "", p) for p in parts))


#: Last letter of the Latin blocks in which author names may be written (fixed value).
LAST_LATIN = 0x24F
#: Generation suffixes (fixed values).
GENERATIONS = ("II", "III", "IV", "V", "VI")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)(?!\w)")


def _name_part(part: str) -> bool:
    """Words of Latin letters, apostrophes, full stops, hyphens and ordinal numbers."""
    for word in part.split():
        if m := _ORDINAL.match(word):
            word = word[m.end() :]
        if any(not (ch in "'.-" or (ch.isalpha() and ord(ch) <= LAST_LATIN and unicodedata.name(ch, "").startswith("LATIN"))) for ch in word):
            return False
    return True


def valid_author(entry: str) -> bool:
    """``Surname, given names`` with one comma; the surname begins with a letter, an apostrophe or an ordinal."""
    surname, comma, given = entry.partition(",")
    first = surname.strip()[:1]
    return bool(comma) and "," not in given and bool(first) and first not in ".-" and _name_part(surname) and _name_part(given)


def invalid_authors(authors: str) -> list[str]:
    """Entries of a semicolon list that are not ``Surname, given names``."""
    return [a.strip() for a in authors.split(";") if a and not valid_author(a)]


def authors_accepted(authors: str) -> bool:
    """Whether a list as a whole is well formed: entries between semicolons, one more at the end at most."""
    entries = authors.split(";")
    if len(entries) > 1 and not entries[-1]:
        entries.pop()
    return all(map(valid_author, entries))


def authors_look_wrong(authors: str) -> bool:
    """A list without semicolons that has more than three words was probably separated by something else."""
    return ";" not in authors and len([w for w in re.split(r"[,\s]", authors.strip()) if w]) > 3


def holds_conjunction(authors: str) -> bool:
    """Whether the word ``and`` stands in a list."""
    return "and" in authors.split()


def non_latin(text: str) -> list[str]:
    """Letters beyond the Latin blocks."""
    return [c for c in text if c.isalpha() and ord(c) > LAST_LATIN]


def to_ascii(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def _generation(given: str) -> tuple[str, str]:
    """Given names without, and with, the generation suffix that follows them after a blank or a full stop."""
    at = max(given.rfind(" "), given.rfind("."))
    suffix = given[at + 1 :].upper()
    return (given[:at] if given[at] == " " else given[: at + 1], suffix) if at > 0 and suffix in GENERATIONS else (given, "")


def _written_apart(word: str, capitals_are_initials: bool) -> str:
    """Initials with a full stop and a blank each; a name as it stands."""
    pieces = [p for p in word.split(".") if p]
    dotted = "." in word and len(pieces) > 0 and all(len(p) == 1 for p in pieces[:-1]) and (len(pieces) > 1 or len(pieces[0]) == 1)
    if dotted and all(p.isascii() and p.isalpha() for p in pieces) or len(word) == 1:
        return " ".join(f"{ch.upper()}." for p in pieces for ch in p)
    if len(word) < 5 and word.isupper() and word.isalpha() and capitals_are_initials:
        return " ".join(f"{ch}." for ch in word)
    return word


def format_author(entry: str) -> str:
    """``Surname, A. B. Given`` with initials written apart, and the generation as it stands.

    Words in capitals are initials unless the surname is in capitals as well.
    """
    surname, _, given = (" ".join(p.split()) for p in entry.partition(","))
    given, suffix = _generation(given)
    words = [_written_apart(w, not surname.isupper()) for w in given.split()]
    return f"{surname}, {' '.join([*words, suffix] if suffix else words)}"


def format_authors(authors: str) -> str:
    """All entries of a list, by semicolons."""
    return "; ".join(format_author(a) for a in authors.split(";") if a).strip()


def check_authors(c: Column) -> Column:
    """struct(value, error, warnings): formatted authors, the reason why they are refused, what to look at.

    Letters beyond the Latin blocks and malformed entries are errors (the first
    three entries are named).  A list that looks separated by something else
    than semicolons, or that holds the word ``and``, is a warning.
    """

    @F.pandas_udf("value string, error string, warnings array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for a in s:
            if not a or not a.strip():
                rows.append((None, None, []))
            elif non_latin(a):
                rows.append((None, "non_latin", []))
            elif not authors_accepted(a):
                bad = invalid_authors(a)
                rows.append((None, f"invalid:{'; '.join(bad[:3])}" + (f" and {len(bad) - 3} others" if len(bad) > 3 else ""), []))
            else:
                rows.append((format_authors(a), None, [w for w, there in (("separators", authors_look_wrong(a)), ("conjunction", holds_conjunction(a))) if there]))
        return pd.DataFrame(rows, columns=["value", "error", "warnings"])

    return run(c)


def author_flags(c: Column) -> Column:
    """struct(accepted, n_invalid, non_latin, separators, conjunction) of a list."""

    @F.pandas_udf("accepted boolean, n_invalid int, non_latin boolean, separators boolean, conjunction boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 5 if a is None else (authors_accepted(a), len(invalid_authors(a)), bool(non_latin(a)), authors_look_wrong(a), holds_conjunction(a)) for a in s]
        return pd.DataFrame(rows, columns=["accepted", "n_invalid", "non_latin", "separators", "conjunction"]).astype({"n_invalid": "Int32"})

    return run(c)


def embl_authors(authors: str) -> str:
    """Surnames with initials, in ASCII, by commas: the author line of flat files."""
    out = []
    for entry in filter(str.strip, authors.split(";")):
        last, _, first = entry.partition(",")
        out.append(f"{last.strip()} {''.join(f'{w[0].upper()}.' for w in re.split(r'[\s.\-]+', first.strip()) if w)}".strip())
    return to_ascii(", ".join(out))


def embl_author_column(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else embl_authors(a))

    return run(c)


def valid_accession_column(c: Column, prefix: str = "") -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: a is not None and valid_accession(a, prefix))

    return run(c)


def first_filled(*names: str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names))


def json_text(c: Column) -> Column:
    """A text as JSON writes it in ASCII: quotes, backslashes and controls escaped, other characters as ``\\uXXXX``."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(ch: Column) -> Column:
        n = F.ascii(ch)
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
        named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
        out = F.when(n > 0xFFFF, pair).when((n > 126) | (n < 32), unit(n)).otherwise(ch)
        for plain, text in named.items():
            out = F.when(ch == plain, text).otherwise(out)
        return out

    whole = F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), escaped), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r'^[ !#-\[\]-~]*$'), c).otherwise(whole), F.lit('"'))


def content_hash(fields: dict[str, Column], sequence_hash: Column) -> Column:
    """md5 over the sorted JSON text of the filled fields and the hash of the sequence.

    The text has a blank after commas and colons and only ASCII characters.
    """
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f'"{n}": '), json_text(c))) for n, c in sorted(fields.items())]
    return F.md5(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"), sequence_hash))


#: How file addresses are given: by the site that serves them, or by the place where they are stored.
URL_MODES = ("website", "storage")


def file_url(base_url: str, acc: Column, version: Column, category: str, name: Column, *, mode: str = "website", file_id: Column | None = None) -> Column:
    """Address of a file; the name is encoded for a path.  Stored files are addressed by their id."""
    if mode not in URL_MODES:
        raise ValueError(f"no mode of addresses: {mode}")
    encoded = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    if mode == "storage":
        if file_id is None:
            raise ValueError("stored files are addressed by their id")
        return F.concat_ws("/", F.lit(base_url), F.lit("files"), file_id)
    return F.concat_ws("/", F.lit(base_url), acc, version.cast("string"), F.lit(category), encoded)
