"""Text and rows out of the aligner's JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dotted(json_col: Column, path: str, *, missing_as_text: bool = False) -> Column:
    """The value at a dotted path; a wildcard ends the path.  Missing values are null, or the word None."""
    keys = path.split("*")[0].strip(".").split(".")
    v = F.get_json_object(json_col, "$" + "".join(f"['{k}']" for k in keys))
    return F.coalesce(v, F.lit("None")) if missing_as_text else v


_SHIFT = "array<struct<cdsName:string,codon:struct<begin:bigint,end:bigint>,nucAbs:array<struct<begin:bigint,end:bigint>>>>"


def _range(r: Column) -> Column:
    """A half-open range counted from 0, as text counted from 1."""
    first, last = r["begin"] + 1, r["end"]
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def frame_shifts(json_col: Column) -> Column:
    """``cds:codons(nt:places;...)`` of each shift, by commas."""
    one = lambda x: F.concat(x["cdsName"], F.lit(":"), _range(x["codon"]), F.lit("(nt:"), F.array_join(F.transform(x["nucAbs"], _range), ";"), F.lit(")"))
    return F.array_join(F.transform(F.from_json(json_col, _SHIFT), one), ",")


def stop_codons(json_col: Column) -> Column:
    """``cds:codon`` counted from 1, by commas."""
    return F.array_join(F.transform(F.from_json(json_col, "array<struct<cdsName:string,codon:bigint>>"), lambda x: F.concat(x["cdsName"], F.lit(":"), (x["codon"] + 1).cast("string"))), ",")


def phenotype(json_col: Column, name: str) -> Column:
    """The value of the first phenotype of a name."""
    return F.get(F.filter(F.from_json(json_col, "array<struct<name:string,value:string>>"), lambda x: x["name"] == name), 0)["value"]


def known_gene_insertions(cell: Column, genes: Sequence[str]) -> Column:
    """``gene:...`` parts of a comma list whose gene is known."""
    parts = F.filter(F.transform(F.split(cell, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(parts, lambda x: F.substring_index(x, ":", 1).isin(*genes))


def private_substitutions(df: DataFrame, key: Sequence[str], json_col: str) -> DataFrame:
    """(key, cds, ref, pos, qry) of the substitutions against the founder of a clade."""
    by_cds = df.select(*key, F.explode(F.from_json(json_col, "map<string,struct<privateSubstitutions:string>>")).alias("cds", "x"))
    listed = by_cds.filter(F.startswith("x.privateSubstitutions", F.lit("[")))
    one = listed.select(*key, "cds", F.explode(F.from_json("x.privateSubstitutions", "array<struct<refAa:string,pos:string,qryAa:string>>")).alias("s"))
    return one.filter("s is not null").select(*key, "cds", F.col("s.refAa").alias("ref"), F.col("s.pos").try_cast("bigint").alias("pos"), F.col("s.qryAa").alias("qry"))


def labelled_substitutions(df: DataFrame, key: Sequence[str], json_col: str) -> DataFrame:
    """(key, cds, ref, pos, qry) of the substitutions that carry labels."""
    by_cds = df.select(*key, F.explode(F.from_json(json_col, "map<string,struct<labeledSubstitutions:string>>")).alias("cds", "x"))
    listed = by_cds.filter(F.startswith("x.labeledSubstitutions", F.lit("[")))
    one = listed.select(*key, "cds", F.explode(F.from_json("x.labeledSubstitutions", "array<struct<substitution:struct<refAa:string,pos:string,qryAa:string>>>")).alias("s"))
    return one.filter("s.substitution is not null").select(*key, "cds", F.col("s.substitution.refAa").alias("ref"), F.col("s.substitution.pos").alias("pos"), F.col("s.substitution.qryAa").alias("qry"))


def only_match(listed: Column, key: Column) -> tuple[Column, Column]:
    """(name, ambiguous): the name listed for a key; none where several are."""
    hits = F.filter(listed, lambda x: x["key"] == key)
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["name"]), F.size(hits) > 1
