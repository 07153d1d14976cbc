"""What a line is: labels, names, headings, chrome of a title block, cells of a schedule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planloom.operators import patterns as P
from planloom.operators.lines import CELL_LABELS


def has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def caught(text: Column, pattern: str, group: int = 1) -> Column:
    """What the pattern catches, in any case; null where it doesn't match or catches nothing."""
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))


def is_label(text: Column) -> Column:
    return has(text, P.LABEL)


def is_cell_label(text: Column) -> Column:
    return has(text, CELL_LABELS)


def is_disclaimer(text: Column) -> Column:
    return has(text, P.DISCLAIMER)


def is_path_or_url(text: Column) -> Column:
    """A line with a slash or backslash, or that begins or ends like a file or an address of the web."""
    up = F.upper(text)
    return text.contains("/") | text.contains("\\") | up.startswith("AUTODESK") | up.startswith("WWW.") | up.rlike(P.FILE_NAME)


def is_capitals(text: Column) -> Column:
    """At least one letter, and none in lower case."""
    return text.rlike(r"\p{Lu}") & (F.upper(text) == text)


def is_person(text: Column) -> Column:
    """Two or three words of letters that may be a person's name: no label, firm, district, phone, postcode or word of a sheet."""
    bare = F.regexp_replace(text, r"^[ :.\-]+|[ :.\-]+$", "")
    parts = words(bare)
    other = is_label(bare) | has(bare, P.COMPANY) | has(bare, P.DISTRICT) | has(bare, P.NOT_A_NAME) | bare.rlike(P.STANDALONE_PHONE) | bare.rlike(P.ZIP_LINE)
    shaped = F.size(parts).between(2, 3) & F.forall(parts, lambda w: w.rlike(r"^[A-Za-z][A-Za-z.'-]*$")) & bare.rlike("[A-Za-z]{2}") & (F.length(bare).between(3, 40))
    return shaped & ~other & ~F.upper(F.try_element_at(parts, F.lit(-1))).isin("ES", "MS", "HS", "ES.", "MS.", "HS.")


def is_scope_heading(text: Column) -> Column:
    """A section's title, not a sentence that mentions the scope of work."""
    t = squeezed(text)
    few = (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) <= 8) | t.endswith(":")
    titled = has(t, P.SCOPE_HEADING) & ~has(t, P.HEADING_SENTENCE) & few
    return (t != "") & (F.length(t) < 80) & ~has(t, r"^SHT\b") & (has(t, P.NOTES_HEADING) | titled)


def is_generic_title(title: Column) -> Column:
    return has(F.trim(F.regexp_replace(F.trim(title), ":+$", "")), P.GENERIC_TITLE)


def is_title_block(text: Column) -> Column:
    """Chrome of a title block: contact lines, and parties and places without a work verb."""
    t = squeezed(text)
    party = t.rlike(P.STANDALONE_PHONE) | has(t, P.COMPANY) | has(t, P.DISTRICT) | has(t, P.STREET)
    return (t == "") | has(t, P.TITLE_BLOCK) | has(t, P.ONE_LINE_ADDRESS) | (party & ~has(t, P.WORK_VERB))


def is_schedule(text: Column) -> Column:
    """A cell of a product schedule or sheet index."""
    t = squeezed(text)
    cell = (F.length(t) <= 24) & ~t.rlike(P.NUMBERED) & (t.rlike(P.PART_NUMBER) | F.upper(t).isin(*P.SCHEDULE_CELLS))
    return (t == "") | has(t, P.SCHEDULE) | cell


def is_sheet_list(text: Column) -> Column:
    """Mostly codes of sheets: three of them, a sheet total, or two with words of plans."""
    codes = F.regexp_count(text, F.lit(P.SHEET_CODE))
    return (codes >= 3) | has(text, P.SHEETS_TOTAL) | (has(text, P.PLAN_WORDS) & (codes >= 2))


def is_work_prose(text: Column) -> Column:
    """A sentence of the work: letters mostly, no chrome, dimension or code, and a work verb or more than 60 characters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    noise = has(text, P.JUNK_ITEM) | is_title_block(text) | text.rlike(P.DIMENSION) | text.rlike(r"^[\d.\sA-Z/-]{1,20}$")
    shaped = (F.length(text) >= 28) & text.rlike(r"^[A-Za-z(]") & (letters >= 18) & (letters > 0.45 * F.length(text))
    return shaped & ~noise & (has(text, P.WORK_VERB) | (F.length(text) > 60))


def is_quality_item(text: Column) -> Column:
    """A scope item worth keeping: 20 characters, three words of letters, no noise, and a work verb or 50 characters."""
    t = squeezed(text)
    noise = has(t, P.JUNK_ITEM) | is_title_block(t) | is_schedule(t) | (t.rlike(P.DIMENSION) & (F.length(t) < 80)) | has(t, P.TECHNOLOGY_SHEET)
    spoken = F.size(F.filter(words(t), lambda w: w.rlike("[A-Za-z]{3}"))) >= 3
    return (F.length(t) >= 20) & ~noise & spoken & (has(t, P.WORK_VERB) | (F.length(t) >= 50))


def item_points(text: Column) -> Column:
    """What an item says for its list: a work verb 3, chrome -5, more than 40 characters 1."""
    return F.when(has(text, P.WORK_VERB), 3).otherwise(0) + F.when(is_title_block(text), -5).otherwise(0) + F.when(F.length(text) > 40, 1).otherwise(0)


def list_score(items: Column) -> Column:
    return F.when(F.size(items) < 1, -1).otherwise(F.aggregate(items, F.lit(0), lambda s, x: s + item_points(x)))
