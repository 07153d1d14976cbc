"""Scope sections: quality of their items, likeness, and removal of sections that repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.operators.predicates import is_generic_title, is_quality_item, list_score

#: Letters of an item that are compared, share of items at which two lists are alike, and sections reported. Fixed values.
KEY_LETTERS, ALIKE_SHARE, TOP_SECTIONS = 96, 0.7, 8


def item_key(x: Column) -> Column:
    """An item for comparison: white space collapsed, upper case, its first letters."""
    return F.substring(F.upper(F.trim(F.regexp_replace(x, r"\s+", " "))), 1, KEY_LETTERS)


def section_score(items: Column) -> Column:
    """Sum over items of +3 for a work verb, -5 for title-block chrome, +1 for more than 40 characters; -1 for none."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(-1)).otherwise(list_score(F.transform(items, lambda x: F.coalesce(x, F.lit("")))))


def shared_share(a: Column, b: Column) -> Column:
    """Share of the smaller item set that both hold, by item keys; 0 where one is empty."""
    ka, kb = (F.array_distinct(F.filter(F.transform(x, item_key), lambda k: k != "")) for x in (a, b))
    return F.when((F.size(ka) > 0) & (F.size(kb) > 0), F.size(F.array_intersect(ka, kb)) / F.least(F.size(ka), F.size(kb))).otherwise(F.lit(0.0))


def without_repeats(sections: Column) -> Column:
    """Sections (structs with title and items) in order, without those much like an earlier one.

    A fold in order: of two alike sections one with a particular title replaces one with
    a general title in its place, else the one with more items stays, the earlier if equal.
    """
    kind = "array<struct<title:string,items:array<string>>>"

    def step(acc: Column, s: Column) -> Column:
        alike = F.transform(acc, lambda k: shared_share(k["items"], s["items"]) >= ALIKE_SHARE)
        at = F.array_position(alike, F.lit(True))
        old = F.try_element_at(acc, F.greatest(at, F.lit(1)).cast("int"))
        better = (is_generic_title(old["title"]) & ~is_generic_title(s["title"])) | ((is_generic_title(old["title"]) == is_generic_title(s["title"])) & (F.size(s["items"]) > F.size(old["items"])))
        put = F.transform(acc, lambda k, i: F.when(i + 1 == at, s).otherwise(k))
        return F.when(at == 0, F.array_append(acc, s)).when(better, put).otherwise(acc)

    plain = F.transform(F.filter(sections, lambda s: F.size(s["items"]) > 0), lambda s: F.struct(s["title"].alias("title"), s["items"].alias("items")))
    return F.aggregate(plain, F.array().cast(kind), step)


def section_rows(records: DataFrame, key: str, sections: str) -> DataFrame:
    """(key, section_no, title, items, kept): each section with its real items in ``kept``; missing items are empty arrays."""
    each = records.select(key, F.posexplode(sections).alias("_p", "_s"))
    items = F.coalesce(F.filter(F.col("_s.items"), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return each.select(key, (F.col("_p") + 1).alias("section_no"), F.col("_s.title").alias("title"), items.alias("items"), F.filter(items, is_quality_item).alias("kept"))


def top_sections(rows: DataFrame, key: str, most: int = TOP_SECTIONS) -> DataFrame:
    """(key, rank, section_no, score): the ``most`` best sections of each record; equal ones in order."""
    scored = rows.select(key, "section_no", section_score(F.col("items")).alias("score"))
    best = scored.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), "section_no"))), 1, most).alias("_all"))
    return best.select(key, F.posexplode("_all").alias("_p", "_m")).select(key, (F.col("_p") + 1).alias("rank"), F.col("_m.section_no").alias("section_no"), (-F.col("_m._s")).alias("score"))
