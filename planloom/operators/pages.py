"""Which pages of a document are its cover, and which may hold a scope of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What speaks for a cover and against it, with its weight; pages looked at; scores that suffice.
COVER_SIGNS = (
    (r"PROJECT OWNER", 8),
    (r"SCHOOL DISTRICT|UNIFIED", 6),
    (r"AGENT:|THE GARLAND", 5),
    (r"JOB NUMBER|\b\d{5}\.\d{2}\b", 4),
    (r"SHEET INDEX|DRAWING INDEX", 4),
    (r"CONSULTANTS", 3),
    (r"\b\d{5}\.\d{2}\b[\s\S]*CONSTRUCTION DOCUMENT|CONSTRUCTION DOCUMENT[\s\S]*\b\d{5}\.\d{2}\b", 3),
    (r"ABBREVIATIONS|DRAFTING ITEMS", -10),
    (r"PARTIAL LIST OF APPLICABLE|TITLE 24", -6),
    (r"\(E\) ACCESSIBLE|SAFETY DISPERSAL AREA", -5),
)
FIRST_PAGES, SURE, NEIGHBOUR, FALLBACK = 12, 10, 4, 3
SCOPE_SIGN = r"\b(SCOPE(\s+OF\s+WORK)?|SUMMARY\s+OF\s+WORK|GENERAL\s+NOTES)\b"


def cover_score(text: Column) -> Column:
    """Sum of the weights of the signs a page's text shows; 0 for null."""
    t = F.upper(F.coalesce(text, F.lit("")))
    return sum((F.when(t.rlike(sign), weight).otherwise(0) for sign, weight in COVER_SIGNS), F.lit(0))


def cover_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """(doc, page_number, score) of each document's cover pages.

    Of the first pages the best is the cover, alone if its score suffices, else with
    those beside it that score well. Where no page speaks for itself, the first three.
    The smaller page wins a tie. Only scores are gathered by document, of twelve pages at most.
    """
    early = pages.where(F.col(page) <= FIRST_PAGES).select(doc, F.struct(F.col(page).alias("page_number"), cover_score(F.col(text)).alias("score")).alias("_p"))
    held = early.groupBy(doc).agg(F.array_sort(F.collect_list("_p")).alias("_all"))
    ranked = F.array_sort(F.transform(F.filter("_all", lambda p: p["score"] > 0), lambda p: F.struct((-p["score"]).alias("minus"), p["page_number"].alias("page_number"))))
    best = F.try_element_at(ranked, F.lit(1))
    told = held.withColumn("_b", best)
    chosen = (
        F.when(F.col("_b").isNull(), F.slice("_all", 1, FALLBACK))
        .when(-F.col("_b.minus") >= SURE, F.filter("_all", lambda p: p["page_number"] == F.col("_b.page_number")))
        .otherwise(F.filter("_all", lambda p: (p["page_number"] == F.col("_b.page_number")) | ((F.abs(p["page_number"] - F.col("_b.page_number")) == 1) & (p["score"] >= NEIGHBOUR))))
    )
    return told.select(doc, F.explode(chosen).alias("_c")).select(doc, "_c.page_number", "_c.score")


def scope_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """The pages whose text announces a scope of work, a summary of work or general notes."""
    return pages.where(F.col(text).rlike(f"(?i){SCOPE_SIGN}"))


def within_cap(pages: DataFrame, most: int, page: str = "page_number") -> tuple[DataFrame, Column]:
    """(the pages up to the cap, whether a document's page total goes beyond it): the cap is a setting of the reader."""
    return pages.where(F.col(page) <= most), F.col("total_pages") > most
