"""Queries of the extraction, clean-up and record look-up operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planloom.operators import blocks, cleanup, fields, pages, predicates, requirement, scopes
from planloom.operators.lines import document_lines, exploded, line_array
from planloom.operators.sections import without_repeats
from planloom.plans.extraction_sql import SQL
from planloom.session import table

LISTED = ["site_addresses", "sheet_index", "project_summary", "applicable_codes", "limits_of_work", "alternates"]
PAGE_CAP = 8


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(table(spark, d, "documents").select("doc_id", "text"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a drawing of one page."""
    return table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")


# ---- lines and pages


def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What the lines of all documents are: one count for each combination that occurs."""
    t = F.col("text")
    kinds = {
        "label": predicates.is_label, "disclaimer": predicates.is_disclaimer, "path": predicates.is_path_or_url, "person": predicates.is_person, "heading": predicates.is_scope_heading, "chrome": predicates.is_title_block, "schedule": predicates.is_schedule,
        "sheets": predicates.is_sheet_list, "prose": predicates.is_work_prose, "quality": predicates.is_quality_item,
    }
    told = exploded(_docs(spark, d)).select(*[test(t).alias(name) for name, test in kinds.items()])
    return told.groupBy(*kinds).agg(F.count(F.lit(1)).alias("lines"))


def page_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("text").isNotNull())
    t = F.col("text")
    upper = F.transform(line_array(t, keep_cell_labels=False), lambda x: F.struct(F.upper(x).alias("up")))
    told = rows.select("doc_id", predicates.has(t, pages.SCOPE_SIGN).alias("scope_page"), requirement.has_title_block(t).alias("title_page"), blocks.is_architect_set(upper).alias("architect_set"), pages.cover_score(t).alias("cover_score"))
    return told.where(F.col("scope_page") | F.col("title_page") | F.col("architect_set") | (F.col("cover_score") != 0))


def building_codes(spark: SparkSession, d: str) -> DataFrame:
    return fields.building_codes(_docs(spark, d))


def limits_of_work(spark: SparkSession, d: str) -> DataFrame:
    return fields.limits_of_work(_docs(spark, d))


# ---- title blocks, sections, requirements


def vendor_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.vendor_block(blocks.with_lines(_docs(spark, d)), "doc_id")


def architect_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.architect_block(blocks.with_lines(_docs(spark, d)), "doc_id")


def consultant_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = blocks.with_lines(_docs(spark, d)).select("doc_id", F.posexplode(blocks.consultants_found()).alias("_p", "_c"))
    return found.select("doc_id", (F.col("_p") + 1).alias("consultant_no"), "_c.*")


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(blocks.summary_bullets(F.col("lines"))).alias("_p", "entry")).select("doc_id", (F.col("_p") + 1).alias("position"), "entry")


def sections_found(spark: SparkSession, d: str) -> DataFrame:
    each = requirement.page_lines(_pages(spark, d), "doc_id", "page_number", "text").where(predicates.has(F.col("text"), pages.SCOPE_SIGN))
    return scopes.scope_sections(each, "doc", "page_number", "plain").select(F.col("doc").alias("doc_id"), "heading_no", "title", F.size("items").alias("items"), "score")


def notes_found(spark: SparkSession, d: str) -> DataFrame:
    return scopes.loose_notes(_docs(spark, d)).select("doc_id", F.posexplode("items").alias("_p", "text")).select("doc_id", (F.col("_p") + 1).alias("note_no"), "text")


def requirements_found(spark: SparkSession, d: str) -> DataFrame:
    return requirement.requirement_rows(_pages(spark, d))


# ---- clean-up of recorded requirements


def report_values(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "requirement")
    held = [f for f in cleanup.FIELDS if f in r.columns]
    return r.select("doc_id", *[cleanup.clean_field(f, F.col(f)).alias(f) for f in held])


def report_lists(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "requirement")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("list_name"), cleanup.clean_list(n, F.col(n)).alias("entries")) for n in LISTED])).alias("_e")
    return r.select("doc_id", each).select("doc_id", "_e.list_name", F.posexplode("_e.entries").alias("_p", "entry")).select("doc_id", "list_name", (F.col("_p") + 1).alias("position"), "entry")


def report_consultants(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "requirement").select("doc_id", F.posexplode(cleanup.clean_consultants(F.col("consultants"))).alias("_p", "_c"))
    return r.select("doc_id", (F.col("_p") + 1).alias("position"), "_c.*")


def report_items(spark: SparkSession, d: str) -> DataFrame:
    each = cleanup.clean_items(table(spark, d, "requirement"), "doc_id")
    return each.select("doc_id", "section_no", "title", cleanup.section_rank(F.col("title")).alias("worth"), F.posexplode("items").alias("_p", "text")).select("doc_id", "section_no", "title", "worth", (F.col("_p") + 1).alias("item_no"), "text")


def report_scopes(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.report_sections(table(spark, d, "requirement"), "doc_id").select("doc_id", "rank", "title", F.size("items").alias("items"))


def sections_kept(spark: SparkSession, d: str) -> DataFrame:
    """How many sections each requirement has, and keeps when repeats are left out."""
    s = F.col("scope_sections")
    return table(spark, d, "requirement").where(F.size(s) > 0).select("doc_id", F.size(s).alias("sections"), F.size(without_repeats(s)).alias("kept"))


# ---- records


def projects_done(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").where("status = 'done'").select("id", "filename", "created_at")


def pages_cut(spark: SparkSession, d: str) -> DataFrame:
    """Documents with more pages than are read, and how many are."""
    _, beyond = pages.within_cap(table(spark, d, "detections"), PAGE_CAP)
    return table(spark, d, "requirement").select("doc_id", "total_pages", F.least("total_pages", F.lit(PAGE_CAP)).alias("pages_read"), F.coalesce(beyond, F.lit(False)).alias("truncated"))


def page_names(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "detections").where(F.col("page_number") <= PAGE_CAP).select("doc_id", "page_number").distinct()
    return seen.select("doc_id", "page_number", F.format_string("page_%03d.png", F.col("page_number")).alias("file_name"))


def lines_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Lines of known projects, numbered by device type within the project."""
    known = table(spark, d, "projects").select(F.col("id").alias("project_id"))
    lines = table(spark, d, "device_lines").join(known, "project_id", "left_semi")
    return lines.select("id", "project_id", "device_type", F.row_number().over(Window.partitionBy("project_id").orderBy("device_type", "id")).alias("line_no"))


def project_details(spark: SparkSession, d: str) -> DataFrame:
    """Each project with the counts of its lines and of those still to be reviewed."""
    counts = table(spark, d, "device_lines").groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("lines"), F.sum("count").alias("devices"), F.count_if("needs_review").alias("to_review"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, d, "projects").select("id", "filename", "status", "title", "client").join(counts, "id", "left").select("id", "filename", "status", "title", "client", zero("lines"), zero("devices"), zero("to_review"))


def identities_merged(spark: SparkSession, d: str) -> DataFrame:
    """Of each name of a project the first that is believable: the title block's, the requirement's, the first consultant's."""
    own = table(spark, d, "projects").select("id", "title")
    bid = table(spark, d, "requirement").select(F.col("doc_id").alias("id"), "project_title")
    good = lambda c: F.when(~predicates.has(F.col(c), r"^(PROJECT\s+NAME|SCHOOL\s+NAME|PROJECT\s+TITLE|SHEET\s+TITLE)\b") & (F.trim(c) != ""), F.col(c))
    return own.join(bid, "id", "left").select("id", F.coalesce(good("title"), good("project_title")).alias("title"))


__all__ = ["QUERIES", "SQL"]

QUERIES = {f.__name__: f for f in (
    line_kinds, page_gates, building_codes, limits_of_work, vendor_blocks, architect_blocks, consultant_blocks, summaries, sections_found, notes_found, requirements_found,
    report_values, report_lists, report_consultants, report_items, report_scopes, sections_kept, projects_done, pages_cut, page_names, lines_ordered, project_details, identities_merged,
)}
