"""The requirement read from a document's pages: cover first, then every page with a title block, then the lists and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.calendar import normal_day
from planloom.functions.text import format_phone, title_case
from planloom.operators import blocks as B
from planloom.operators import fields, patterns as P, predicates as Q
from planloom.operators.fields import status_name
from planloom.operators.lines import document_lines, line_array
from planloom.operators.pages import cover_pages
from planloom.operators.scopes import document_sections, loose_notes, scope_sections
from planloom.session import materialise

#: Fields that identify a requirement, in the order they are reported.
IDENTITY = (
    "provider_company", "provider_agent", "provider_phone", "provider_fax", "provider_address", "aor_license", "client", "project_title", "site_address", "job_number", "date",
)
EARLY = 80
NO_TEXT = "No extractable text found in the PDF."
NO_SCOPE = "No explicit scope section found (SCOPE OF WORK / SUMMARY OF WORK / GENERAL NOTES)."

_LINES = "array<struct<text:string>>"
_CONSULTANTS = "array<struct<discipline:string,firm:string,phone:string,address:string>>"


def page_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page_number, text, lines, plain): a page's lines without names of cells, as structs, and all of them as strings."""
    lines = F.transform(F.coalesce(line_array(F.col(text), keep_cell_labels=False), F.array().cast("array<string>")), lambda t: F.struct(t.alias("text")))
    return pages.select(F.col(doc).alias("doc"), F.col(page).alias("page_number"), F.coalesce(F.col(text), F.lit("")).alias("text"), lines.alias("lines"), F.coalesce(line_array(F.col(text)), F.array().cast("array<string>")).alias("plain"))


def has_title_block(text: Column) -> Column:
    """A page that shows a title block and isn't a sheet of abbreviations."""
    up = F.upper(text)
    return Q.has(text, P.TITLE_PAGE) & ~(up.contains("ABBREVIATIONS") & up.contains("DRAFTING ITEMS"))


def _upper(lines: Column | str) -> Column:
    return F.transform(lines, lambda x: F.struct(F.upper(x["text"]).alias("up")))


def _units(gathered: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, ord, kind, lines, architect): the sets of lines that are read as title blocks, in the order they are believed."""
    cover = gathered.select("doc", F.lit(0).alias("ord"), F.lit("cover").alias("kind"), F.col("cover").alias("lines"), F.col("architect"))
    again = gathered.where(~F.col("architect")).select("doc", F.lit(1).alias("ord"), F.lit("cover again").alias("kind"), F.col("cover").alias("lines"), F.lit(True).alias("architect"))
    held = pages.where(has_title_block(F.col("text")) & (F.size("lines") > 0))
    told = held.select("doc", "page_number", "lines", (B.is_architect_set(_upper("lines")) | F.upper("text").contains("PROJECT OWNER")).alias("architect"))
    own = told.select("doc", (F.col("page_number") * 2).alias("ord"), F.lit("page").alias("kind"), "lines", "architect")
    gaps = told.where(~F.col("architect")).select("doc", (F.col("page_number") * 2 + 1).alias("ord"), F.lit("gaps").alias("kind"), "lines", F.lit(True).alias("architect"))
    return cover.unionByName(again).unionByName(own).unionByName(gaps)


def _blocks(units: DataFrame) -> DataFrame:
    """(doc, ord, kind, IDENTITY, consultants) of each unit; the two kinds of title block are each read on their own rows only."""
    keyed = units.withColumn("unit", F.struct("doc", "ord", "kind"))
    architect = B.architect_block(B.with_lines(keyed.where("architect")), "unit")
    vendor = B.vendor_block(B.with_lines(keyed.where("NOT architect")), "unit")
    rows = architect.unionByName(vendor, allowMissingColumns=True)
    # A consultant's heading is rare; only cover and own pages are read for them.
    consultants = B.with_lines(keyed.where(F.col("kind").isin("cover", "page"))).select(F.col("unit").alias("_u"), B.consultants_found().cast(_CONSULTANTS).alias("consultants"))
    joined = rows.join(consultants, rows["unit"] == consultants["_u"], "left")
    return joined.select("unit.doc", "unit.ord", "unit.kind", *IDENTITY, F.coalesce("consultants", F.array().cast(_CONSULTANTS)).alias("consultants"))


def _believable(field: str, value: Column) -> Column:
    good = F.when(value != "", value)
    if field == "project_title":
        return F.when(~Q.has(value, P.BAD_TITLE), good)
    if field == "provider_agent":
        return F.when(~Q.has(value, P.BAD_AGENT) & Q.is_person(value), good)
    return good


def merged_identity(blocks: DataFrame) -> DataFrame:
    """(doc, IDENTITY, consultants): of each field the first believable value in order.

    A title or agent that can't be one gives way to a later one. An architect's block read
    from a vendor's cover counts only where that cover names neither provider nor client,
    one read from a page only while licence or job number is missing. Consultants are
    joined, each discipline and firm once. One fold over a document's title blocks.
    """
    kind = "struct<" + ",".join(f"{f}:string" for f in IDENTITY) + f",consultants:{_CONSULTANTS}>"
    start = F.struct(*[F.lit(None).cast("string").alias(f) for f in IDENTITY], F.array().cast(_CONSULTANTS).alias("consultants")).cast(kind)

    def step(acc: Column, u: Column) -> Column:
        active = (
            F.when(u["kind"] == "cover again", acc["provider_company"].isNull() & acc["client"].isNull())
            .when(u["kind"] == "gaps", acc["aor_license"].isNull() | acc["job_number"].isNull())
            .otherwise(F.lit(True))
        )

        def value(f: str) -> Column:
            new = F.when(u["kind"].startswith("cover"), F.nullif(u[f], F.lit(""))).otherwise(_believable(f, u[f]))
            old = _believable(f, acc[f]) if f in ("project_title", "provider_agent") else acc[f]
            return F.coalesce(old, F.when(active, new), acc[f]).alias(f)

        key = lambda c: F.upper(F.concat_ws("\u0001", c["discipline"], c["firm"]))
        known = F.transform(acc["consultants"], key)
        return F.struct(*[value(f) for f in IDENTITY], F.concat(acc["consultants"], F.filter(u["consultants"], lambda c: ~F.array_contains(known, key(c)))).alias("consultants")).cast(kind)

    held = blocks.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", *IDENTITY, "consultants"))).alias("_u"))
    return held.select("doc", F.aggregate("_u", start, step).alias("_m")).select("doc", "_m.*")


def _swept(rows: DataFrame) -> DataFrame:
    """Fields still missing, looked for in all lines of the document; rows have ``_l``."""
    L = B.L
    far = lambda x: F.when(x["one"] & ~Q.has(x["text"], r"\b(CA|CALIFORNIA)\b") & (F.coalesce(F.upper("provider_company").contains("GARLAND"), F.lit(False)) | Q.has(x["text"], r"\b(OHIO|OH|NY|TX|FL|IL|PA)\b")), Q.squeezed(x["text"]))
    other = lambda c: F.when(~F.coalesce(B.fingerprint(c) == B.fingerprint(F.col("site_address")), F.lit(False)), c)
    office = F.coalesce(B.first_of(F.transform(L, far)), B.first_of(F.transform(L, lambda x: other(B.two_lines(x)))))
    label = B.first(lambda x: Q.has(x["text"], P.AGENT_LABEL))
    value = B.labelled(label, P.AGENT_LABEL)
    below = B.first(lambda x: Q.is_capitals(x["text"]) & Q.is_person(x["text"]), B.between(label["i"] + 1, label["i"] + B.AGENT_REACH))["text"]
    person = F.coalesce(F.when(Q.is_person(value), F.when(Q.is_capitals(value), title_case(value)).otherwise(value)), title_case(below))
    whole = B.first(lambda x: Q.has(F.trim(x["text"]), P.LICENCE_LINE))["text"]
    found = {
        "provider_address": office, "date": B.labelled_date(), "job_number": B.job_number(), "provider_phone": B.any_phone(), "provider_fax": format_phone(B.first_of(F.transform(L, lambda x: Q.caught(x["text"], P.FAX)))),
        "provider_agent": person, "aor_license": F.upper(F.trim(whole)),
    }
    return rows.select(*[F.coalesce(F.col(c), found[c]).alias(c) if c in found else F.col(c) for c in rows.columns])


def _lists(docs: DataFrame) -> DataFrame:
    """(doc, sheet_index, applicable_codes, limits_of_work, alternates) as arrays."""
    kinds = {"sheet_index": fields.sheet_index, "applicable_codes": fields.building_codes, "limits_of_work": fields.limits_of_work, "alternates": fields.alternates}
    rows = None
    for name, read in kinds.items():
        own = read(docs, doc="doc").withColumn("kind", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    each = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.struct("position", "entry")))), lambda x: x["entry"]).alias(name)
    return rows.groupBy("doc").agg(*[each(name) for name in kinds])


def requirement_rows(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """One row for each document: the identity fields, status, lists, consultants, scope sections, notes and page counts.

    Null and empty pages count as pages without text; a document without any text has
    nulls, empty lists and a note. Pages are read in order of their number, whatever the
    order of the rows. Everything of a document is worked out in its row, so a document
    is the unit of work and no key can be hot.
    """
    each = materialise(page_lines(pages, doc, page, text), "page-lines")
    covers = cover_pages(each, doc="doc").groupBy("doc").agg(F.collect_set("page_number").alias("_c"))
    held = each.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page_number", "lines"))).alias("_p"), F.count(F.lit(1)).alias("total_pages"), F.count_if(F.trim("text") != "").alias("pages_with_text"))
    gathered = held.join(covers, "doc", "left")
    gathered = gathered.select("doc", "total_pages", "pages_with_text", F.flatten(F.transform("_p", lambda p: p["lines"])).alias("all"), F.flatten(F.transform(F.filter("_p", lambda p: F.array_contains("_c", p["page_number"])), lambda p: p["lines"])).alias("cover"))
    gathered = materialise(gathered.withColumn("architect", B.is_architect_set(_upper("cover")) | B.is_architect_set(_upper(F.slice("all", 1, EARLY)))), "documents-of-lines")
    identity = merged_identity(materialise(_blocks(_units(gathered, each)), "title-blocks"))
    swept = _swept(B.with_lines(gathered, "all").join(identity, "doc"))
    covered = swept.withColumn("_cover", F.transform("cover", lambda x: F.struct(x["text"].alias("text"), F.upper(x["text"]).alias("up"))))
    covered = covered.withColumn("dsa_number", B.state_number(F.col("_cover"), F.transform("_l", lambda x: F.struct(x["text"].alias("text"), x["up"].alias("up")))))
    status = B.first_of(F.transform(F.concat(F.transform("_cover", lambda x: x["text"]), F.transform("_l", lambda x: x["text"])), lambda t: Q.caught(t, P.STATUS)))
    covered = covered.withColumn("document_status", F.when(status.isNotNull(), status_name(status))).withColumn("work_type", B.work_type(F.col("project_title"), F.col("_l")))
    covered = covered.withColumn("district_address", B.district_address(F.col("client"), F.col("site_address"), F.col("provider_address")))
    covered = covered.withColumn("site_addresses", B.site_addresses(F.col("site_address"), F.col("district_address"), F.col("provider_address"))).withColumn("site_address", F.coalesce("site_address", F.get("site_addresses", F.lit(0))))
    covered = covered.withColumn("date", normal_day(F.col("date"))).withColumn("provider_company", F.coalesce("provider_company", B.firm_by_stamp(F.col("provider_phone"), F.col("provider_fax"), F.col("provider_address"))))
    plain = document_lines(each.select("doc", "page_number", "text"), doc="doc", page="page_number")
    summary = plain.select("doc", B.summary_bullets(F.col("lines")).alias("project_summary"))
    announced = each.where(Q.has(F.col("text"), P.SCOPE_PAGE))
    sections = document_sections(scope_sections(announced, "doc", "page_number", "plain"), "doc")
    notes = loose_notes(document_lines(announced.select("doc", "page_number", "text"), doc="doc", page="page_number"), "doc").select("doc", F.array(F.struct(F.lit("General Notes").alias("title"), F.col("items"))).alias("_loose"))
    rows = covered.join(_lists(plain), "doc", "left").join(summary, "doc", "left").join(sections, "doc", "left").join(notes, "doc", "left")
    none = F.array().cast("array<string>")
    silent = F.col("pages_with_text") == 0
    found = F.size(F.coalesce("scope_sections", F.array().cast("array<struct<title:string,items:array<string>>>"))) > 0
    note = F.when(silent, F.array(F.lit(NO_TEXT))).when(~found, F.array(F.lit(NO_SCOPE))).otherwise(none)
    strings = [*IDENTITY, "work_type", "district_address", "dsa_number", "document_status"]
    lists = ["site_addresses", "sheet_index", "project_summary", "applicable_codes", "limits_of_work", "alternates"]
    return rows.select(
        F.col("doc").alias(doc), *[F.when(~silent, F.col(c)).alias(c) for c in strings], *[F.coalesce(F.when(~silent, F.col(c)), none).alias(c) for c in lists], "consultants",
        F.when(found, F.col("scope_sections")).otherwise(F.coalesce("_loose", F.array().cast("array<struct<title:string,items:array<string>>>"))).alias("scope_sections"), note.alias("notes"), F.col("pages_with_text").cast("int"), F.col("total_pages").cast("int"),
    )
