"""Queries of the document, detection and record operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planloom.functions.text import fingerprint, format_phone, letter_ratio, phone_digits, prettify, sentence_case, stem_name, truncate
from planloom.operators import changes, detections, fields, labels, lines, reports, sections
from planloom.operators.lines import document_lines, exploded
from planloom.operators.predicates import is_work_prose
from planloom.plans.reference_sql import SQL
from planloom.session import table

# ---- documents as lines


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(table(spark, d, "documents").select("doc_id", "text"))


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return exploded(_docs(spark, d)).select("doc_id", "line_no", "text")


def page_stats(spark: SparkSession, d: str) -> DataFrame:
    return lines.page_stats(table(spark, d, "documents"))


def first_phone(spark: SparkSession, d: str) -> DataFrame:
    caught = fields.caught(F.col("text"), f"({fields.PHONE})")
    return lines.first_match(exploded(_docs(spark, d)), "doc_id", {"phone": format_phone(caught)}).where(F.col("phone").isNotNull())


def header_fields(spark: SparkSession, d: str) -> DataFrame:
    found = fields.header_fields(_docs(spark, d))
    return found.where(F.coalesce(*[F.col(c) for c in found.columns[1:]]).isNotNull())


def sheet_index(spark: SparkSession, d: str) -> DataFrame:
    return fields.sheet_index(_docs(spark, d))


def alternates(spark: SparkSession, d: str) -> DataFrame:
    return fields.alternates(_docs(spark, d))


def two_line_addresses(spark: SparkSession, d: str) -> DataFrame:
    return fields.two_line_addresses(_docs(spark, d))


def numbered_items(spark: SparkSession, d: str) -> DataFrame:
    return lines.numbered_items(_docs(spark, d), ends=lambda t: t.rlike("(?i)^(Regards|Thanks),?$"))


def next_line_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lines.next_lines(_docs(spark, d), lambda t: t.rlike("(?i)^(NAME|TEL|MAIL) ")).where(F.col("follower").isNotNull())


def bounded_scan(spark: SparkSession, d: str) -> DataFrame:
    return lines.first_in_range(_docs(spark, d), lambda t: t.rlike("(?i)^SCOPE OF WORK"), lambda t: t.rlike("(?i)job [0-9]{5}"), after=19, before=2)


def near_anchor(spark: SparkSession, d: str) -> DataFrame:
    all_lines = exploded(_docs(spark, d))
    return lines.nearest_to_anchor(all_lines, F.col("text").rlike("(?i)job [0-9]{5}"), F.col("text").rlike(f"(?i){fields.DATE}"), reach=15)


def best_heading(spark: SparkSession, d: str) -> DataFrame:
    t = F.upper("text")
    hit = lambda pattern, points: F.when(t.rlike(pattern), points).otherwise(0)
    score = hit("SCHOOL|DISTRICT", 6) + hit("JOB NUMBER|[0-9]{5}\\.[0-9]{2}", 4) + hit("SHEET INDEX|DRAWING INDEX", 4) + hit("ADDENDUM", 3) + hit("SCOPE OF WORK", 5) + F.when(F.length("text") > 80, -5).otherwise(0)
    return lines.best_line(exploded(_docs(spark, d)), "doc_id", score, 1)


def scope_segments(spark: SparkSession, d: str) -> DataFrame:
    cut = lines.segments(_docs(spark, d), lambda t: t.rlike("(?i)^(SCOPE OF WORK|GENERAL NOTES|NOTAS GENERALES|NOTES GÉNÉRALES):?$"), most=90)
    return cut.select("doc_id", "segment_no", "title", F.size("body").alias("body_lines"), F.array_join("body", "\n").alias("body"))


def captured_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.while_open(_docs(spark, d), lambda t: t.rlike("(?i)^(GENERAL NOTES|SCOPE OF WORK):?$"), lambda t: t.rlike("(?i)^(REGARDS|THANKS|ADDENDUM NO|RE: job|Minutes of)"))


def work_prose(spark: SparkSession, d: str) -> DataFrame:
    return exploded(_docs(spark, d)).where(is_work_prose(F.col("text"))).select("doc_id", "line_no", letter_ratio(F.col("text")).alias("letters"))


def label_map(spark: SparkSession, d: str) -> DataFrame:
    return labels.map_labels(_docs(spark, d), labels.aliases(spark))


# ---- requirements and projects


def consultants_distinct(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "requirement").select("doc_id", F.posexplode("consultants").alias("line_no", "_c")).select("doc_id", "line_no", F.trim("_c.discipline").alias("discipline"), F.trim("_c.firm").alias("firm"))
    named = each.where((F.col("discipline") != "") & (F.col("firm") != "")).withColumn("entry", F.concat_ws(" — ", "discipline", "firm"))
    return lines.ordered_distinct(named, "doc_id", "line_no", "entry", 12)


def section_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = sections.section_rows(table(spark, d, "requirement"), "doc_id", "scope_sections")
    return rows.select("doc_id", "section_no", "title", F.size("items").alias("items"), F.size("kept").alias("kept"), sections.section_score(F.col("items")).alias("score"))


def top_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.top_sections(sections.section_rows(table(spark, d, "requirement"), "doc_id", "scope_sections"), "doc_id")


def section_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much any two sections of a requirement share; pairs that share nothing are left out."""
    none = F.array().cast("array<string>")
    each = table(spark, d, "requirement").select("doc_id", F.col("scope_sections").alias("_s"), F.posexplode("scope_sections").alias("_i", "_a"))
    pairs = each.select("doc_id", "_i", F.col("_a.items").alias("_x"), F.posexplode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("_k", "_b"))
    told = pairs.select("doc_id", (F.col("_i") + 1).alias("section_no"), (F.col("_i") + F.col("_k") + 2).alias("other_no"), F.round(sections.shared_share(F.coalesce("_x", none), F.coalesce("_b.items", none)), 6).alias("shared"))
    return told.where("shared > 0")


def section_dedupe(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "requirement").select("doc_id", F.posexplode(sections.without_repeats(F.col("scope_sections"))).alias("_p", "_s"))
    return kept.select("doc_id", (F.col("_p") + 1).alias("section_no"), F.col("_s.title").alias("title"), F.size("_s.items").alias("items"))


def metadata_merged(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "projects").select("id", "title", "client", "architect", "engineer", "project_address")
    bid = table(spark, d, "requirement").select(F.col("doc_id").alias("id"), "project_title", F.col("client").alias("bid_client"), "provider_company", "site_address", F.get("consultants", F.lit(0))["firm"].alias("first_firm"))
    both = own.join(bid, "id", "left")
    pick = changes.by_precedence
    return both.select("id", pick(F.col("title"), F.col("project_title")).alias("title"), pick(F.col("client"), F.col("bid_client")).alias("client"), pick(F.col("architect"), F.col("provider_company")).alias("architect"), pick(F.col("engineer"), F.col("first_firm")).alias("engineer"), pick(F.col("project_address"), F.col("site_address")).alias("project_address"))


def provider_summary(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "requirement")
    return r.select("doc_id", reports.joined(F.col("provider_company"), F.col("provider_agent"), F.col("provider_phone"), F.col("provider_address")).alias("summary"))


def provider_phones(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "requirement").where(F.col("provider_phone").isNotNull())
    return r.select("doc_id", phone_digits(F.col("provider_phone")).alias("digits"), format_phone(F.col("provider_phone")).alias("shown"), fingerprint(F.col("provider_address")).alias("address_key"))


def stamp_firms(spark: SparkSession, d: str) -> DataFrame:
    """Firms of records that name none, by the stamp (phone or street) they are recorded with elsewhere."""
    r = table(spark, d, "requirement").select("doc_id", F.trim("provider_company").alias("firm"), fields.stamp_tokens(F.col("provider_phone"), F.col("provider_address")).alias("tokens"))
    bare = F.coalesce(F.upper("firm"), F.lit("")).isin("", "N/A", "TBD")
    return fields.firms_by_stamp(r.where(bare), "doc_id", "tokens", r.where(~bare).select("firm", F.explode("tokens").alias("token")))


def projects_recent(spark: SparkSession, d: str) -> DataFrame:
    """Whole list, newest first, by month so that no task ranks all rows: rank within the month."""
    p = table(spark, d, "projects").withColumn("month", F.date_format("created_at", "yyyy-MM"))
    return p.select("id", "month", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("created_at"), "id")).alias("newest_no"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").select("id", stem_name(F.col("filename"), " requirement.pdf").alias("pdf_name"), stem_name(F.col("filename"), "_report.csv").alias("csv_name"))


def report_fields(spark: SparkSession, d: str) -> DataFrame:
    shown = [("Project Title", "title"), ("Client", "client"), ("Architect", "architect"), ("Engineer", "engineer"), ("Project Address", "project_address"), ("Due Date", "due_date")]
    return reports.field_rows(table(spark, d, "projects"), "id", shown)


def report_sections(spark: SparkSession, d: str) -> DataFrame:
    shown = [("Project Summary", "project_summary"), ("Limits of Work", "limits_of_work"), ("Applicable Codes", "applicable_codes"), ("Bid Alternates", "alternates"), ("Notes", "notes")]
    return reports.section_report(table(spark, d, "requirement"), "doc_id", shown)


def report_json(spark: SparkSession, d: str) -> DataFrame:
    return reports.json_report(table(spark, d, "projects"), "id", ["id", "title", "client", "architect"])


def cleaned_titles(spark: SparkSession, d: str) -> DataFrame:
    t = F.trim(F.regexp_replace("project_title", r"\s+", " "))
    return table(spark, d, "requirement").where(t != "").select("doc_id", truncate(sentence_case(t), 40).alias("title"), reports.shown(F.col("client")).alias("client"))


# ---- detections and changes


def device_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "detections").drop("loaded_at")
    return detections.counts_by(detections.distinct_rows(rows, rows.columns), ["doc_id", "device_type"], "detected")


def device_names(spark: SparkSession, d: str) -> DataFrame:
    counts = detections.counts_by(table(spark, d, "detections"), ["device_type"], "rows")
    return detections.looked_up(counts, table(spark, d, "rates"), "device_type", "display_name", prettify(F.col("device_type")), "missing")


def best_detections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "detections").where(F.col("confidence").isNotNull()).select("doc_id", "page_number", "device_type", "confidence")
    return detections.best_of(rows, ["doc_id"], "confidence", ["page_number", "device_type"])


def clamped_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = detections.clamp_box(F.col("detection.box"), 1000, 800)
    rows = table(spark, d, "detections").where(F.col("detection.score") >= 0.5).select("doc_id", box.alias("b")).select("doc_id", "b.*")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("boxes"), F.sum((F.col("x2") - F.col("x1")).cast("long")).alias("widths"), F.sum((F.col("y2") - F.col("y1")).cast("long")).alias("heights"))


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", detections.argmax(F.col("embedding")).alias("best"), F.round(F.array_max(detections.softmax(F.col("embedding"))), 6).alias("share"))


def _rules() -> dict:
    return {"count": changes.finite_between(F.col("count").cast("double"), 0, 100000), "unit_cost": changes.finite_between(F.col("unit_cost"), 0, 1e7)}


def override_rejects(spark: SparkSession, d: str) -> DataFrame:
    _, bad = changes.split_valid(table(spark, d, "overrides").select("line_id", "count", "unit_cost", "changed_at").distinct(), _rules())
    return bad.select("line_id", "changed_at", F.array_join("broken", ",").alias("broken"))


def lines_changed(spark: SparkSession, d: str) -> DataFrame:
    good, _ = changes.split_valid(table(spark, d, "overrides"), _rules())
    latest = changes.latest_values(good, "line_id", ["changed_at"], ["count"])
    rows = table(spark, d, "device_lines").select("id", "project_id", "device_type", "count", "detected_count")
    return changes.with_changes(rows, "id", latest, ["count"])


def lines_left(spark: SparkSession, d: str) -> DataFrame:
    """Lines left when failed projects are deleted with all that belongs to them."""
    gone = table(spark, d, "projects").where("status = 'failed'").select("id")
    return changes.without_parents(table(spark, d, "device_lines").select("id", "project_id", "device_type"), "project_id", gone)


def lines_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Lines after the projects with detections but no lines were run again: their rows are cleared and made anew."""
    old = table(spark, d, "device_lines").select("project_id", "device_type", "detected_count")
    fresh = device_counts(spark, d).select(F.col("doc_id").alias("project_id"), "device_type", F.col("detected").cast("int").alias("detected_count")).join(old.select("project_id").distinct(), "project_id", "left_anti")
    return changes.replaced(old, fresh, "project_id")


__all__ = ["QUERIES", "SQL"]

QUERIES = {f.__name__: f for f in (
    text_lines, page_stats, first_phone, header_fields, sheet_index, alternates, two_line_addresses, numbered_items, next_line_pairs, bounded_scan, near_anchor, best_heading, scope_segments, captured_lines, work_prose, label_map,
    consultants_distinct, section_scores, top_sections, section_overlap, section_dedupe, metadata_merged, provider_summary, provider_phones, stamp_firms, projects_recent, file_names, report_fields, report_sections, report_json, cleaned_titles,
    device_counts, device_names, best_detections, clamped_boxes, class_scores, override_rejects, lines_changed, lines_left, lines_replaced,
)}
