"""Report rows and serialised reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.text import blank_to_null, sentence_case

MISSING = "Not found in drawing"


def joined(*parts: Column) -> Column:
    """Non-empty parts with a middle dot between; null if none."""
    return F.nullif(F.concat_ws(" · ", *[blank_to_null(p) for p in parts]), F.lit(""))


def field_rows(records: DataFrame, key: str, fields: list[tuple[str, str]]) -> DataFrame:
    """(key, seq, field, information): one row for each field, in order, nulls as empty strings."""
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(label).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("information")) for i, (label, c) in enumerate(fields, 1)])
    return records.select(key, F.explode(rows).alias("_r")).select(key, "_r.*")


def section_report(records: DataFrame, key: str, lists: list[tuple[str, str]]) -> DataFrame:
    """(key, section_no, heading, seq, text): bullets of the lists that hold any, sections numbered over those present only."""
    parts = F.array(*[F.struct(F.lit(h).alias("heading"), F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: blank_to_null(x).isNotNull()).alias("items")) for h, c in lists])
    present = records.select(key, F.posexplode(F.filter(parts, lambda p: F.size(p["items"]) > 0)).alias("_s", "_p"))
    rows = present.select(key, (F.col("_s") + 1).alias("section_no"), F.col("_p.heading").alias("heading"), F.posexplode("_p.items").alias("_i", "_t"))
    return rows.select(key, "section_no", "heading", (F.col("_i") + 1).alias("seq"), sentence_case(F.trim("_t")).alias("text"))


def shown(x: Column) -> Column:
    """A value for the report: what is missing says so."""
    return F.coalesce(blank_to_null(x), F.lit(MISSING))


def json_report(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, report): the columns as one JSON object, nulls left out."""
    return records.select(key, F.to_json(F.struct(*columns)).alias("report"))
