"""Requirements made fit for a report: values, lists and sections without what a drawing's chrome left in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.text import title_case, truncate
from planloom.operators import patterns as P
from planloom.operators import predicates as Q
from planloom.operators.sections import without_repeats

#: Longest values, and most entries of lists. Fixed values.
FIELDS = {
    "provider_company": 80, "provider_agent": 60, "provider_phone": 40, "provider_fax": 40, "provider_address": 120, "aor_license": 20, "client": 100, "project_title": 100, "work_type": 80, "site_address": 120, "district_address": 120,
    "job_number": 40, "dsa_number": 20, "date": 40, "document_status": 60,
}
LISTS = {"site_addresses": (120, 4), "sheet_index": (100, 40), "project_summary": (280, 12), "applicable_codes": (140, 8), "limits_of_work": (160, 8), "alternates": (160, 10)}
CONSULTANTS_MOST, ITEMS_MOST, SECTIONS_MOST, OTHER_SECTIONS_MOST, ITEM_LENGTH, NOTES_MOST = 12, 40, 8, 6, 500, 5


def clean_value(x: Column, most: int, personish: bool = False, no_disclaimer: bool = False) -> Column:
    """A value for the report; null for labels, letter-spaced words, and on demand for disclaimers and what is no person. Cut at ``most``."""
    t = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ :.\-]+|[ :.\-]+$", "")
    bad = (t == "") | Q.has(t, P.BAD_VALUE) | t.rlike(P.SPACED_LETTERS)
    if no_disclaimer:
        bad = bad | Q.has(t, P.REPORT_DISCLAIMER)
    if personish:
        bad = bad | (F.size(Q.words(t)) > 4) | Q.has(t, P.NOT_PERSONISH)
    return F.when(~bad, truncate(t, most))


def clean_field(name: str, x: Column) -> Column:
    t = clean_value(x, FIELDS[name], personish=name == "provider_agent", no_disclaimer=name in ("client", "project_title"))
    if name == "job_number":
        return F.when(~Q.has(t, "sheet|title|date"), t)
    if name == "dsa_number":
        return F.when(t.rlike(r"^0\d-\d{5,7}$"), t)
    return t


def distinct_entries(entries: Column, key, most: int) -> Column:
    """The first entry of each key, in order, at most ``most``: the cap is what the report shows."""
    keys = F.transform(entries, key)
    return F.slice(F.filter(entries, lambda x, i: F.array_position(keys, key(x)) == i + 1), 1, most)


def clean_list(name: str, values: Column) -> Column:
    length, most = LISTS[name]
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: clean_value(v, length)), lambda t: t.isNotNull() & ~(Q.has(t, P.REPORT_DISCLAIMER) & (F.length(t) > 120)))
    return distinct_entries(clean, lambda t: F.upper(t), most)


def clean_consultants(consultants: Column) -> Column:
    """Each discipline and firm once, both present; twelve at most."""
    each = F.transform(
        F.coalesce(consultants, F.array().cast("array<struct<discipline:string,firm:string,phone:string,address:string>>")),
        lambda c: F.struct(clean_value(c["discipline"], 60).alias("discipline"), clean_value(c["firm"], 80).alias("firm"), clean_value(c["phone"], 40).alias("phone"), clean_value(c["address"], 100).alias("address")),
    )
    named = F.filter(each, lambda c: c["discipline"].isNotNull() & c["firm"].isNotNull())
    return distinct_entries(named, lambda c: F.upper(F.concat_ws("\u0001", c["discipline"], c["firm"])), CONSULTANTS_MOST)


def clean_title(title: Column) -> Column:
    """A section's title without a sheet number, in title case if it is in capitals."""
    bare = F.regexp_replace(F.regexp_replace(Q.squeezed(title), r"^[ :.\-]+|[ :.\-]+$", ""), r"(?i)^SHT\s+\d+\s*[-–]?\s*", "")
    return F.when(Q.is_capitals(bare) & (F.length(bare) > 4), title_case(bare)).otherwise(bare)


def clean_item(item: Column) -> Column:
    """A scope item for the report, cut at 500; null for short ones, sheet lists, disclaimers, chrome, dimensions and callouts."""
    t = Q.squeezed(item)
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    bad = (
        (F.length(t) < 20) | Q.is_sheet_list(t) | (Q.has(t, P.REPORT_DISCLAIMER) & (F.length(t) > 160)) | (Q.has(t, P.REPORT_CHROME) & ~Q.has(t, P.REPORT_VERB)) | (Q.has(t, P.REPORT_KEYNOTE) & (letters < 40))
        | (Q.has(t, P.CALLOUT) & t.rlike(P.CALLOUT_CODE))
    )
    return F.when(~bad, F.when(F.length(t) > ITEM_LENGTH, F.concat(F.rtrim(F.substring(t, 1, ITEM_LENGTH - 3)), F.lit("…"))).otherwise(t))


def section_rank(title: Column) -> Column:
    """What a title is worth: named scopes and the plant's trades first, bare ones last."""
    up = F.upper(title)
    named = F.when(Q.is_generic_title(title), -2).when(up.contains("SCOPE OF WORK") | up.endswith(" SCOPE"), 5).otherwise(0)
    return named + F.when(up.rlike(P.FIRST_TRADES), 8).otherwise(0) + F.when(up.rlike(P.OTHER_TRADES), 4).otherwise(0) + F.when(up.isin(*P.VAGUE_TITLES), -3).otherwise(0)


def clean_items(records: DataFrame, key: str, sections: str = "scope_sections") -> DataFrame:
    """(key, section_no, title, items): each section's titles and items for the report; a vague title keeps sentences only, two at least."""
    each = records.select(key, F.posexplode(sections).alias("_p", "_s")).select(key, (F.col("_p") + 1).alias("section_no"), clean_title(F.coalesce("_s.title", F.lit(""))).alias("title"), F.col("_s.items").alias("_raw"))
    each = each.withColumn("_all", F.filter(F.transform(F.coalesce("_raw", F.array().cast("array<string>")), clean_item), lambda t: t.isNotNull()))
    sentences = F.filter("_all", lambda t: (F.length(t) > 45) & ~t.rlike(P.CALLOUT_START))
    vague = F.upper("title").isin(*P.VAGUE_TITLES)
    return each.select(key, "section_no", "title", F.when(~vague, F.col("_all")).when(F.size(sentences) >= 2, sentences).otherwise(F.slice("_all", 1, 0)).alias("items"))


def report_sections(records: DataFrame, key: str, sections: str = "scope_sections") -> DataFrame:
    """(key, rank, title, items): the sections of the report: without repeats, by ``section_rank`` and then length, eight at most.

    Records without a titled scope show their first six sections as they stand. Items
    beyond forty are left out of the report.
    """
    held = clean_items(records, key, sections).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_no", "title", F.slice("items", 1, ITEMS_MOST).alias("items")))).alias("_s"))
    kept = held.select(key, without_repeats(F.col("_s")).alias("_k"))
    scoped = F.filter("_k", lambda s: F.upper(s["title"]).contains("SCOPE") | F.upper(s["title"]).contains("SUMMARY"))
    ranked = F.array_sort(F.transform(scoped, lambda s, i: F.struct((-section_rank(s["title"])).alias("r"), (-F.size(s["items"])).alias("n"), i.alias("i"), s.alias("s"))))
    shown = F.when(F.size(scoped) > 0, F.slice(F.transform(ranked, lambda x: x["s"]), 1, SECTIONS_MOST)).otherwise(F.slice("_k", 1, OTHER_SECTIONS_MOST))
    return kept.select(key, F.posexplode(shown).alias("_p", "_s")).select(key, (F.col("_p") + 1).alias("rank"), F.col("_s.title").alias("title"), F.col("_s.items").alias("items"))
