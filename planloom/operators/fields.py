"""Fields read from a document's lines: identifiers, parties, dates, indexes, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.text import fingerprint, format_phone, phone_digits, title_case
from planloom.operators.lines import exploded, first_match, next_lines, numbered_items, ordered_distinct
from planloom.operators.patterns import BUILDING_CODE
from planloom.operators.predicates import is_disclaimer
from planloom.operators.predicates import is_person as is_person_name

# What the fields look like in drawings.
PHONE = r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
LICENSE = r"\b(C-[0-9]{4,6})\b"
STATE_NUMBER = r"\b(0[0-9]-[0-9]{5,7})\b"
JOB_NUMBER = r"\b([0-9]{4,6}\.[0-9]{2})\b"
STATUS = r"\b(CONSTRUCTION\s+DOCUMENTS?|BID\s+SET|FOR\s+BID|DSA\s+SUBMITTAL|ISSUED\s+FOR\s+[A-Z][A-Z\s]{2,40})\b"
WORK_TYPE = r"\b(ROOF\s+RESTORATION|ROOF\s+REPLACEMENT|MODERNIZATION(?:\s*&\s*SITE\s+IMPROVEMENTS?)?|SITE\s+IMPROVEMENTS?|INFRASTRUCTURE\s+UPGRADE|HVAC\s+REPLACEMENT)\b"
DATE = r"\b([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{1,2}\s+(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\s+[0-9]{4})\b"
NUMBERED_SHEET = r"^SHT\s+([0-9]+)\s*[-–]\s*(.+)$"
CODED_SHEET = r"^([0-9]?[A-Z]{1,3}-?[0-9]{2,3}[A-Z]?)\s+([A-Z][A-Z0-9\s/&.,'-]{3,60})$"
NO_SHEET_TITLE = r"\b(ABBREVIATION|SYMBOL|LEGEND|NORTH|PENNY|POUND)\b"
ALTERNATE = r"^(?:BID\s+)?ALTERNATE\s*(?:NO\.?\s*)?#?\s*([A-Z0-9]+)(?:\s*[-–—:]\s*(.+))?$"
LIMITS = r"\b(LIMITS?\s+OF\s+WORK|MODERNIZATION\s+INC\.?\s*[0-9]+|INCREMENT\s+[0-9]+)\b"
STREET_LINE = r"^[0-9]{1,6}\s+[A-Z0-9][\w\s.,#'-]{3,80}$"
STATE_ZIP = r"\b[A-Z]{2}\s+[0-9]{5}(?:-[0-9]{4})?\b"
ALTERNATE_NOISE = r"\b(MATERIALS?|DESIGNS?|METHODS?\s+OF\s+CONSTRUCTION|WASTE\s+REDUCTION|ALUMINUM|ABBREVIATION|WORKING\s+WITH\s+LOCAL)\b"
CODE_NAME = r"CALIFORNIA\s+(?:BUILDING|ELECTRICAL|MECHANICAL|PLUMBING|FIRE|GREEN\s+BUILDING|ENERGY|ADMINISTRATIVE)\s+CODE"
SHEETS_MOST, ALTERNATES_MOST, CODES_MOST, LIMITS_MOST, SITES_MOST = 40, 10, 8, 8, 4


def caught(text: Column, pattern: str, group: int = 1) -> Column:
    """What the pattern catches, in any case; null where it doesn't match."""
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))


def status_name(raw: Column) -> Column:
    """A document status in its usual form, else in title case."""
    text = F.upper(F.regexp_replace(raw, r"\s+", " "))
    return F.when(text.contains("CONSTRUCTION DOCUMENT"), "Construction Document").when(text.contains("BID SET") | (text == "FOR BID"), "Bid Set").when(text.contains("DSA SUBMITTAL"), "DSA Submittal").otherwise(title_case(F.trim(text)))


def is_state_number_line(text: Column) -> Column:
    """A line that states the project's own number: short, one number, no building feature."""
    return (F.length(text) <= 60) & (F.regexp_count(text, F.lit(STATE_NUMBER)) <= 1) & ~text.rlike(r"(?i)\((?:E)\)|\b(RAMP|RESTROOM|SOLAR|PLAYGROUND|PARKING|BUILDING|BLDG)\b")


def header_fields(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, job_number, license, state_number, phone, status, work_type, date_text): the first of each by line; null where none."""
    text = F.col("text")
    found = {
        "job_number": caught(text, JOB_NUMBER),
        "license": F.upper(caught(text, LICENSE)),
        "state_number": F.when(is_state_number_line(text), caught(text, STATE_NUMBER)),
        "phone": format_phone(caught(text, f"({PHONE})")),
        "status": F.when(caught(text, STATUS).isNotNull(), status_name(caught(text, STATUS))),
        "work_type": F.when(caught(text, WORK_TYPE).isNotNull(), title_case(F.regexp_replace(caught(text, WORK_TYPE), r"\s+", " "))),
        "date_text": caught(text, DATE),
    }
    return first_match(exploded(docs, doc), doc, found)


def sheet_index(docs: DataFrame, doc: str = "doc_id", most: int = SHEETS_MOST) -> DataFrame:
    """(doc, position, entry): distinct sheets listed, in order; the first ``most`` are the index."""
    t = F.col("text")
    code, title = caught(t, CODED_SHEET), F.trim(caught(t, CODED_SHEET, 2))
    coded = F.when((F.size(F.split(title, r"\s+")) >= 2) & ~title.rlike(f"(?i){NO_SHEET_TITLE}"), F.concat(F.upper(code), F.lit(" — "), title))
    entry = F.coalesce(F.concat(F.lit("SHT "), caught(t, NUMBERED_SHEET), F.lit(" — "), F.trim(caught(t, NUMBERED_SHEET, 2))), coded)
    entries = exploded(docs, doc).where(F.length(t) <= 90).withColumn("entry", entry).where(F.col("entry").isNotNull())
    return ordered_distinct(entries, doc, "line_no", "entry", most)


def alternates(docs: DataFrame, doc: str = "doc_id", most: int = ALTERNATES_MOST) -> DataFrame:
    """(doc, position, entry): distinct bid alternates."""
    t = F.regexp_replace("text", r"^[0-9]+\.\s+", "")
    label = F.upper(caught(t, ALTERNATE))
    entry = F.concat_ws(" — ", F.concat(F.lit("Alternate "), label), F.nullif(F.trim(caught(t, ALTERNATE, 2)), F.lit("")))
    real = label.isNotNull() & (F.length(label) <= 6) & ~label.isin("ALT") & ~t.rlike(f"(?i){ALTERNATE_NOISE}") & (F.length(entry) <= 160)
    return ordered_distinct(exploded(docs, doc).where(real).withColumn("entry", entry), doc, "line_no", "entry", most)


def building_codes(docs: DataFrame, doc: str = "doc_id", most: int = CODES_MOST) -> DataFrame:
    """(doc, position, entry): distinct building codes listed: lines that begin with a code's name; of a long line the name alone."""
    t = F.col("text")
    long = (F.length(t) > 120) | (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) > 18)
    line = F.when(long, caught(t, rf"({CODE_NAME}(?:\s*\([^)]{{0,40}}\))?)")).otherwise(t)
    entry = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"\s+", " "), "^[ –-]+|[ –-]+$", ""), r"^20[0-9]{2}\s+", "")
    listed = t.rlike(f"(?i){BUILDING_CODE}") & ~is_disclaimer(t) & line.rlike(rf"(?i)^(?:20[0-9]{{2}}\s+)?{CODE_NAME}\b")
    return ordered_distinct(exploded(docs, doc).where(listed).withColumn("entry", entry), doc, "line_no", "entry", most)


def limits_of_work(docs: DataFrame, doc: str = "doc_id", most: int = LIMITS_MOST) -> DataFrame:
    """(doc, position, entry): distinct lines on the limits of the work."""
    found = exploded(docs, doc).where(F.col("text").rlike(f"(?i){LIMITS}") & F.length("text").between(8, 160) & ~is_disclaimer(F.col("text"))).withColumn("entry", F.col("text"))
    return ordered_distinct(found, doc, "line_no", "entry", most)


def two_line_addresses(docs: DataFrame, doc: str = "doc_id", most: int = SITES_MOST) -> DataFrame:
    """(doc, position, entry): distinct addresses of a street line and the town line below it."""
    pairs = next_lines(docs, lambda t: t.rlike(f"(?i){STREET_LINE}"), doc=doc).where(F.col("follower").rlike(f"(?i){STATE_ZIP}") & ~F.col("text").rlike(f"(?i){STATE_ZIP}"))
    entries = pairs.withColumn("entry", F.concat_ws(", ", F.regexp_replace("text", r"[\s,;]+$", ""), "follower"))
    return ordered_distinct(entries, doc, "line_no", "entry", most, fingerprint(F.col("entry")))


#: House number and first word of the street, a direction between them left out.
STAMP_STREET = r"\b([0-9]+)\s+(?:(?:north|south|east|west|[nsew])\b\.?\s+)?([a-z]{3,})"


def stamp_tokens(phone: Column, address: Column) -> Column:
    """Tokens by which a firm's stamp is known: the phone's last seven digits, and house number with street; a town or postcode alone is too weak."""
    digits = F.right(phone_digits(phone), F.lit(7))
    street = F.lower(F.coalesce(address, F.lit("")))
    house = F.when(street.rlike(STAMP_STREET), F.concat_ws(" ", F.regexp_extract(street, STAMP_STREET, 1), F.regexp_extract(street, STAMP_STREET, 2)))
    return F.filter(F.array(digits, house), lambda t: t.isNotNull())


def firms_by_stamp(records: DataFrame, key: str, tokens: str, stamps: DataFrame) -> DataFrame:
    """(key, firm): the firm most recorded with one of the record's tokens.

    stamps: (firm, token), one row for each record that shows both. A token's best firm is
    found before the join, so a token held by many spellings or rows pairs with one row.
    """
    counted = stamps.groupBy("token", "firm").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("token").agg(F.max(F.struct("n", "firm")).alias("_b"))
    each = records.select(key, F.explode(tokens).alias("token")).join(best, "token")
    return each.groupBy(key).agg(F.max("_b")["firm"].alias("firm"))


__all__ = ["alternates", "building_codes", "firms_by_stamp", "header_fields", "is_person_name", "limits_of_work", "numbered_items", "sheet_index", "stamp_tokens", "status_name", "two_line_addresses"]
