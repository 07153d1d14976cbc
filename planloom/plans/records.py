"""Queries on the records' dates and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.operators.packed import ADDRESSES, CUT, DOUBLED, QUOTE, SHEETS, Packing, unpack
from planloom.operators.timestamps import MomentDictionary, normalise_moments
from planloom.session import table


def dated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every typed date with its record and the zone of the record's site."""
    projects = table(spark, d, "projects")
    own = projects.select(F.lit("projects").alias("rec_table"), F.col("id").alias("rec_id"), F.col("due_date").alias("typed"), "site_zone")
    zones = projects.select(F.col("id").alias("rec_id"), "site_zone")
    bids = table(spark, d, "requirement").select(F.lit("requirement").alias("rec_table"), F.col("doc_id").alias("rec_id"), F.col("date").alias("typed"))
    return own.unionByName(bids.where(F.col("typed").isNotNull()).join(zones, "rec_id", "left"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_moments(dated_rows(spark, d), "rec_table", "typed", "site_zone", MomentDictionary.shared(spark), stated_only=True).select("rec_table", "rec_id", "norm_value").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    requirement = table(spark, d, "requirement").select("doc_id", "sheet_index", "site_addresses")
    fields = (("sheet_index", SHEETS), ("site_addresses", ADDRESSES))
    sheets, sites = (unpack(requirement, ["doc_id"], f, how, least=2).withColumn("field_name", F.lit(f)) for f, how in fields)
    return sheets.unionByName(sites).select("doc_id", "field_name", "entry_no", "value_no", "value_text")


_EDGE = r"[;,|/•&\t\r\n]"
_QUOTED = rf'(^\s*|{_EDGE}\s*|\s[Aa][Nn][Dd]\s+)"([^"]*)"(\s*$|\s*{_EDGE}|\s+[Aa][Nn][Dd]\s)'


def _unpacked_sql(field: str, how: Packing) -> str:
    """The values of one field's entries, for an independent engine: the same patterns, without look-around in either."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    mark = lambda x: f"regexp_replace({x}, {text(_QUOTED)}, {text(chr(92) + '1' + QUOTE + chr(92) + '2' + QUOTE + chr(92) + '3')}, 'g')"
    piece = "p" if how.weak is None else f"regexp_replace(p, {text(f'(?:{how.weak})+({how.start})')}, {text(CUT + chr(92) + '1')}, 'g')"
    if how.edge_comma:
        piece = f"CASE WHEN regexp_matches({piece}, {text(r'^[[:space:]]*,|,[[:space:]]*$')}) THEN replace({piece}, ',', {text(CUT)}) ELSE {piece} END"
    cut = f"list_transform(string_split(regexp_replace({piece}, {text(how.strong)}, {text(CUT)}, 'g'), {text(CUT)}), lambda t: regexp_replace(t, {text(r'^(?:[[:space:];,|/•&]|-[[:space:]])+|[[:space:];,|/•&]+$')}, '', 'g'))"
    return f"""SELECT doc_id, '{field}' AS field_name, entry_no::INT AS entry_no, unnest(v) AS value_text, generate_subscripts(v, 1)::INT AS value_no FROM (
  SELECT doc_id, entry_no, list_filter(list_transform(flatten(list_transform(string_split({mark(mark(f"replace(e, {text(chr(34) * 2)}, {text(DOUBLED)})"))}, {text(QUOTE)}), lambda p, i: CASE WHEN i % 2 = 0 THEN [trim(p)] ELSE {cut} END)),
    lambda t: regexp_replace(replace(t, {text(DOUBLED)}, chr(34)), '^[[:space:]]+|[[:space:]]+$', '', 'g')), lambda t: t <> '' AND NOT regexp_matches(t, {text('^(?:[Aa][Nn][Dd]|[[:space:];,|/•&"]*)$')})) AS v
  FROM (SELECT doc_id, unnest({field}) AS e, generate_subscripts({field}, 1) AS entry_no FROM requirement) WHERE e IS NOT NULL) WHERE len(v) >= 2"""


SQL = {"p3_found": "SELECT doc_id, field_name, entry_no, value_no, value_text FROM (" + _unpacked_sql("sheet_index", SHEETS) + " UNION ALL " + _unpacked_sql("site_addresses", ADDRESSES) + ")"}

QUERIES = {"p1_found": p1_found, "p3_found": p3_found}
