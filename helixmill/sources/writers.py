"""Writers: tables, sequences and JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_ndjson(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), compression: str = "gzip") -> None:
    """JSON lines, in a folder for each value of the partition columns."""
    df.write.mode("errorifexists").partitionBy(*partition_by).option("compression", compression).option("ignoreNullFields", False).json(path)


#: Metadata names that a table may have; the schema of an organism is far below.
MAX_NAMES = 10_000


def metadata_keys(df: DataFrame, metadata: str) -> list[str]:
    """Names used in a metadata map; refused if there are more than a table may have."""
    names = df.select(F.explode(F.map_keys(metadata)).alias("k")).distinct().limit(MAX_NAMES + 1).collect()
    if len(names) > MAX_NAMES:
        raise ValueError(f"the records use more than {MAX_NAMES} metadata names")
    return sorted(r[0] for r in names)


def tsv_lines(df: DataFrame, header: Sequence[str], metadata: str, keys: Sequence[str]) -> DataFrame:
    """(line): fixed columns, then the metadata names in order; missing values are empty."""
    clean = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\r\n]+", " ")
    cells = [clean(F.col(h)) for h in header] + [clean(F.element_at(metadata, k)) for k in keys]
    return df.select(F.concat_ws("\t", *cells).alias("line"))


def fasta_records(df: DataFrame, header: Sequence[str | Column], sequence: str, sep: str = "|") -> DataFrame:
    """(record): ``>header`` and the sequence; rows without a sequence are left out."""
    parts = [F.coalesce(F.col(h).cast("string") if isinstance(h, str) else h, F.lit("")) for h in header]
    return df.filter(F.col(sequence).isNotNull()).select(F.concat(F.lit(">"), F.concat_ws(sep, *parts), F.lit("\n"), F.col(sequence)).alias("record"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header in each file, without quoting."""
    df.write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "\u0000").option("escapeQuotes", False).csv(path)


def write_text(df: DataFrame, path: str, compression: str | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.option("compression", compression) if compression else writer).text(path)


def _wrapped(tag: str, text: Column, width: int = 60) -> Column:
    """Lines of a tag and at most ``width`` symbols of the text each."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(.{{1,{width}}})"), F.lit(0)), lambda x: F.concat(F.lit(f"{tag:<5}"), x)), "\n")


def flat_file(accession: Column, version: Column, description: Column, sequence: Column, *, authors: Column | None = None, country: Column | None = None, features: Column | None = None) -> Column:
    """A flat-file entry: id line, description, authors, source, features, sequence in lines of 60, end mark.

    ``features`` is an array of struct(kind, begin, end, gene), places from 1.
    """
    head = F.concat(F.lit("ID   "), accession, F.lit("; SV "), version.cast("string"), F.lit("; "), F.length(sequence).cast("string"), F.lit(" BP."))
    lines = [head, F.concat(F.lit("DE   "), description)]
    if authors is not None:
        lines.append(F.when(authors != "", F.concat(F.lit("RA   "), authors, F.lit(";"))))
    place = F.concat(F.lit("FT   source          1.."), F.length(sequence).cast("string"))
    if country is not None:
        place = F.concat(place, F.when(country != "", F.concat(F.lit('\nFT                   /country="'), country, F.lit('"'))).otherwise(""))
    lines.append(place)
    if features is not None:
        one = lambda x: F.concat(F.lit("FT   "), F.rpad(x["kind"], 16, " "), x["begin"].cast("string"), F.lit(".."), x["end"].cast("string"), F.lit('\nFT                   /gene="'), x["gene"], F.lit('"'))
        lines.append(F.when(F.size(features) > 0, F.array_join(F.transform(features, one), "\n")))
    lines += [F.concat(F.lit("SQ   Sequence "), F.length(sequence).cast("string"), F.lit(" BP;")), F.when(sequence != "", _wrapped("", F.lower(sequence))), F.lit("//")]
    return F.concat_ws("\n", *lines)


#: Entries that one archive may hold.
ARCHIVE_ENTRIES = 500


def archive_entries(df: DataFrame, key: Sequence[str], limit: int = ARCHIVE_ENTRIES) -> DataFrame:
    """The first entries by key, as many as an archive may hold."""
    return df.orderBy(*key).limit(limit)


def write_archive(df: DataFrame, path: str, header: Sequence[str], metadata: str, sequence: str, key: Sequence[str]) -> None:
    """A folder with the metadata table and the sequences of at most :data:`ARCHIVE_ENTRIES` entries."""
    rows = archive_entries(df, key)
    write_text(tsv_lines(rows, header, metadata, metadata_keys(rows, metadata)), f"{path}/metadata")
    write_text(fasta_records(rows, header, sequence), f"{path}/sequences")


def write_lookup_table(df: DataFrame, path: str, key: str) -> None:
    """A table sorted by its key in ranges, so that a look-up reads few row groups (the statistics are its index)."""
    df.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def write_stripped(df: DataFrame, path: str, payload: str) -> None:
    """A map column stored as JSON text without its nulls, in zstd."""
    stored = F.to_json(F.map_filter(payload, lambda _, v: v.isNotNull()))
    df.withColumn(payload, stored).write.mode("errorifexists").option("compression", "zstd").parquet(path)
