"""Readers: tables of text, sequences and JSON records as DataFrames.

Readers that parse lines take a DataFrame of lines (column ``value``), so that
files, streams and tests share them; ``*_files`` read paths.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv(spark: SparkSession, path: str, *, quoted: bool = True) -> DataFrame:
    """Tab-separated text with a header, all columns as strings; gzip and bzip2 by extension."""
    reader = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).option("mode", "FAILFAST")
    return (reader if quoted else reader.option("quote", "").option("escape", "\\")).csv(path)


ID_COLUMNS = ("id", "submissionId")
FASTA_IDS = "fastaIds"


def submission_entries(table: DataFrame, *, revision: bool = False) -> DataFrame:
    """(submission_id, [accession,] fasta_ids, metadata, error) of a submission table.

    One of the two id columns is required.  An id is not empty and has no
    blanks; the metadata map holds all other columns that are filled.
    """
    ids = [c for c in ID_COLUMNS if c in table.columns]
    if len(ids) != 1:
        raise ValueError(f"one of the columns {ID_COLUMNS} is required, found {ids}")
    if revision and "accession" not in table.columns:
        raise ValueError("a revision needs the column accession")
    meta = [c for c in table.columns if c not in (*ID_COLUMNS, FASTA_IDS, "accession" if revision else "") and not c.startswith("files.")]
    if not meta:
        raise ValueError("no metadata columns")
    sid = F.trim(F.col(ids[0]))
    values = F.map_filter(F.map_from_arrays(F.array(*(F.lit(c) for c in meta)), F.array(*(F.col(f"`{c}`") for c in meta))), lambda _, v: F.coalesce(v, F.lit("")) != "")
    fasta = fasta_ids(F.col(FASTA_IDS)) if FASTA_IDS in table.columns else F.array(sid)
    error = F.when(F.coalesce(sid, F.lit("")) == "", "id_missing").when(sid.rlike(r"\s"), "id_with_blank").when(F.size(fasta) != F.size(F.array_distinct(fasta)), "fasta_id_repeated")
    return table.select(sid.alias("submission_id"), *([F.trim("accession").alias("accession")] if revision else []), fasta.alias("fasta_ids"), values.alias("metadata"), error.alias("error"))


def fasta_ids(c: Column) -> Column:
    """Ids of a cell, by blanks, without empty ones."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


_UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def file_cell(c: Column) -> Column:
    """array of struct(name, file_id, valid) of a cell of ``name:uuid`` tokens; the last colon separates."""
    tokens = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    return F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, r"^(.*):([^:]+)$", 1).alias("name"), F.regexp_extract(t, r"^(.*):([^:]+)$", 2).alias("file_id"), F.regexp_extract(t, r"^(.*):([^:]+)$", 2).rlike(_UUID).alias("valid")))


def file_cell_error(c: Column) -> Column:
    """Why a file cell is refused: a token without a valid id, or a name that comes again; blank cells name no files."""
    files = file_cell(c)
    names = F.transform(files, lambda f: f["name"])
    bad = F.exists(files, lambda f: ~f["valid"] | (f["name"] == ""))
    return F.when(F.trim(c) == "", None).when(bad, "invalid_file").when(F.size(names) != F.size(F.array_distinct(names)), "repeated_name")


def parse_fasta(records: DataFrame, value: str = "value") -> DataFrame:
    """(fasta_id, sequence, error) of records that begin with ``>`` (the sign may be cut off as separator).

    The id is the first word of the header; lines are joined, blank lines skipped.
    """
    text = F.regexp_replace(F.col(value), r"^\s*>", "")
    header = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.expr(f"substring(__t, instr(__t, '\\n') + 1)"), r"\s+", "")).otherwise("")
    rows = records.withColumn("__t", text).filter(F.trim("__t") != "")
    return rows.select(F.regexp_extract(F.trim(header), r"^(\S+)", 1).alias("fasta_id"), body.alias("sequence"), F.when(body == "", "empty_sequence").alias("error"))


def read_fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence) of sequence files, headers whole."""
    text = F.regexp_replace(F.col("value"), r"^\s*>", "")
    rows = spark.read.option("lineSep", "\n>").text(path).select(text.alias("t")).filter(F.trim("t") != "")
    return rows.select(F.substring_index("t", "\n", 1).alias("header"), F.regexp_replace(F.expr("substring(t, length(substring_index(t, '\n', 1)) + 2)"), r"\s+", "").alias("sequence"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequence files; each record is one row of the text source, so large files are split."""
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a fixed schema; a bad line ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def report_columns(json_col: Column, mapping: Mapping[str, str], lists: Sequence[str] = (), numbers: Sequence[str] = ()) -> list[Column]:
    """Columns out of a nested report: dotted path by name; listed names are joined by commas, numbers have no decimals."""
    out = []
    for name, path in mapping.items():
        v = F.get_json_object(json_col, f"$.{path}")
        if name in lists:
            v = F.array_join(F.from_json(v, "array<string>"), ",")
        elif name in numbers:
            v = F.format_string("%.0f", v.try_cast("double"))
            v = F.when(F.get_json_object(json_col, f"$.{path}").try_cast("double").isNotNull(), v)
        out.append(v.alias(name))
    return out


def dump_fields(line: Column, columns: Sequence[str]) -> list[Column]:
    r"""Fields of a line separated by ``\t|\t``; the line ends in ``\t|``."""
    parts = F.split(F.regexp_replace(line, r"\s*\|\s*$", ""), r"\s*\|\s*")
    return [F.when(F.get(parts, F.lit(i)) != "", F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(columns)]


def read_dump(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Dump files as in :func:`dump_fields`."""
    return spark.read.text(path).select(*dump_fields(F.col("value"), columns))


def read_zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of zip files that hold one file each; other codecs are read by the text source itself."""
    import io
    import zipfile

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    if len(names) != 1:
                        raise ValueError(f"a zip file of one entry is expected, found {len(names)}")
                    lines: list[str] = []
                    with z.open(names[0]) as f:
                        for line in io.TextIOWrapper(f, "utf-8"):
                            lines.append(line.rstrip("\r\n"))
                            if len(lines) == 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
                                lines = []
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")
