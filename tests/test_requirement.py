"""Title blocks, sections and whole requirements on small drawings."""

import pytest
from pyspark.sql import functions as F

from planloom.operators import blocks, scopes
from planloom.operators.requirement import NO_SCOPE, NO_TEXT, requirement_rows

VENDOR_COVER = """
Mt. Diablo Unified School District
AYERS ELEMENTARY ROOF RESTORATION
5120 MYRTLE DR, CONCORD, CA 94521
SHT 1  - COVER SHEET
SHT 2  - SCOPE OF WORK & TYPICAL DETAIL
SHT 3 -  ROOF PLAN
SHT 4 -  DETAILS
SHT 5 -  DETAILS
DATE:
CHK BY:
DWG BY:
PHONE (800) 321-9336 / FAX (216) 641-0633
3800 EAST 91st STREET - CLEVELAND, OHIO 44105-2197
THE GARLAND COMPANY INC
AGENT:
GARLAND
DOUG CLARK
1-13-25
"""
VENDOR_SCOPE = """
LIQUID APPLIED ROOF RESTORATION SCOPE:
1.
REMOVE AND DISPOSE OF ALL VERTICAL FLASHINGS AND DETAIL FLASHINGS.
2.
INSTALL NEW FLASHINGS USING STRESSBASE 80 PLUS.
3.
POWER WASH ROOF SYSTEM USING TSP AND WATER SOLUTION.
SCOPE OF WORK:
1.
TEST ALL DRAINS AND DOWNSPOUT PRIOR TO CONSTRUCTION.
2.
CLEAN WORK SITE AT END OF EVERY WORK DAY.
"""
BARE_HEADING = VENDOR_SCOPE.split("SCOPE OF WORK:")[0] + "SCOPE OF WORK:\n5120 MYRTLE DR, CONCORD, CA 94521\nTHE GARLAND COMPANY INC\nPHONE (800) 321-9336\n"
ARCHITECT_COVER = """
PROJECT OWNER & TITLE
MOUNT DIABLO UNIFIED SCHOOL DISTRICT
1936 Carlotta Drive
Concord, California 94519
MEADOW HOMES ES MODERNIZATION
1371 Detroit Ave
Concord, CA 94520
DATE:
AUGUST 01, 2025
JOB NUMBER:
23119.01
C I V I L   E N G I N E E R
CARROLL ENGINEERING
1101 South Winchester Blvd., Suite H184
San Jose, CA 95128
TEL (408) 261-9800
M E C H A N I C A L   E N G I N E E R
CYPRESS ENGINEERING GROUP
9 Harris Court, Suite A8
Monterey, CA 93940
TEL (831) 218-1802
"""
SPLIT_COVER = """
CONSULTANTS
PROJECT OWNER & TITLE
SHEET NO.
C-36107
REN. 01-31-25
991 W HEDDING ST., SUITE 101
SAN JOSE, CA 95126
TEL (408) 715-4470
SHEET INDEX & OVERALL SITE
PLAN
RIO VISTA ES
MODERNIZATION &
SITE IMPROVEMENTS
SEPTEMBER 27, 2024
23118.01
611 Pacifica Ave
Bay Point, CA 94565
MOUNT DIABLO UNIFIED
SCHOOL DISTRICT
1936 Carlotta Dr. Concord
Concord, CA 94519
CONSTRUCTION DOCUMENT
BASE Design Inc.
www.BASEdesigninc.com
"""
LOGO_COVER = """
CONSULTANTS
PROJECT OWNER & TITLE
SHEET NO.
C-36107
REN. 01-31-25
991 W. HEDDING STREET, SUITE 101
SAN JOSE, CA 95126
TEL (408) 715-4470
LOMA VISTA ADULT CENTER
TECHNOLOGY INFRASTRUCTURE UPGRADE
NOVEMBER 18, 2024
24103.01
1266 San Carlos Ave.
Concord, CA 94518
MOUNT DIABLO UNIFIED
SCHOOL DISTRICT
1936 Carlotta Dr.
Concord, CA 94519
CONSTRUCTION DOCUMENT
"""
TRADE_SCOPES = """
1. THE CONTRACTOR SHALL FULLY RE-CABLE THE DATA NETWORK, COPPER AND FIBER.
2. THE CONTRACTOR WILL ESTABLISH (N) MDF AND IDF LOCATIONS AS INDICATED ON THE PLANS.
3. THE CONTRACTOR SHALL PROVIDE A (N) BOGEN NYQUIST INTERCOM SYSTEM IN ACCORDANCE WITH THE PLANS.
TECHNOLOGY SCOPE OF WORK:
1. PRIOR TO BEGINNING ANY SITE WORK, AN ON-SITE PRE-CONSTRUCTION MEETING SHALL BE HELD WITH THE LOW VOLTAGE DESIGNER.
2. CONDUIT BODIES AND LB FITTINGS ARE PROHIBITED IN ANY PATHWAY CONTAINING DATA CABLING.
PAINT SCOPE OF WORK:
1. CONTRACTOR SHALL PATCH AND PAINT ALL WALL AND CEILING SURFACES DISTURBED BY DEMO.
2. CONTRACTOR SHALL CLEAN, PRIME, AND PAINT ALL (N) CONDUIT AND J-BOXES ON FINISHED WALLS.
3. CONTRACTOR SHALL COORDINATE WITH DISTRICT REPRESENTATIVE FOR PAINT COLORS.
DATA LOCATION, CAT6A JACK/CABLE,
SEE 27 10 00
PANDUIT
"""
PROSE_SCOPE = """
EXTERIOR REPAINTING SCOPE OF WORK:
1.
2.
REPAIR ALL DAMAGED SURFACES TO ACHIEVE A FLUSH, CLEAN FINISH.
SAND, CLEAN, AND RE-PRIME ALL EXISTING SURFACES.
REPAINT ALL EXISTING PAINTED SURFACES, INCLUDING BUT NOT LIMITED TO WALLS,
WALKWAY SOFFITS, CONDUITS, PIPES, GUTTERS, DOWNSPOUTS, TRIM, AND DOOR AND
WINDOW FRAMES OF EXISTING BUILDINGS.
TYP. 09.91.B
"""
CODES = """
PARTIAL LIST OF APPLICABLE CODES AS OF JANUARY 1, 2023
CALIFORNIA BUILDING CODE (CBC) - CCR, TITLE 24, PART 2
CALIFORNIA MECHANICAL CODE (CMC) - CCR, TITLE 24, PART 4
PROJECT DESCRIPTION
- REPLACEMENT IN-KIND OF HVAC EQUIPMENT IN SOME BUILDINGS, EQUIPMENT TUNE-UP IN OTHERS.
- PROVIDE NEW HVAC CONTROLS WHERE INDICATED ON THE MECHANICAL DRAWINGS.
LIMITS OF WORK
MODERNIZATION INC. 2 - THIS SET
BID ALTERNATE A — ADDITIONAL ROOFTOP UNIT REPLACEMENT AT BUILDING 4
"""
STATE_COVER = """
EL DORADO MIDDLE SCHOOL MULTI-PURPOSE
MT. DIABLO UNIFIED SCHOOL DISTRICT
1936 CARLOTTA DR, CONCORD, CA 94519
600 Q Street, Suite 100
Sacramento, CA 95811
DSA #
01-121540
JOB NO.
23100.01
DSA SUBMITTAL
GENERAL SCOPE OF WORK INCLUDES BUT IS NOT LIMITED TO:
PROVIDE NEW HVAC SYSTEMS THROUGHOUT THE BUILDING, INCLUDING THE KITCHEN.
MECHANICAL SCOPE OF WORK:
1. DEMOLISH EXISTING HVAC EQUIPMENT AS SHOWN.
2. INSTALL NEW PACKAGED ROOFTOP UNITS PER SCHEDULE.
"""
NO_HEADING = "SOME RANDOM DRAWING\nACME CORP INC\nPHONE (555) 123-4567\n123 MAIN STREET\nSPRINGFIELD, IL 62701\n"
ABOVE = """
1.
REMOVE AND DISPOSE OF ALL ROOFING, EDGE METAL, AND COUNTER-FLASHING DOWN TO STRUCTURAL DECK.
2.
PERFORM ANY REPAIRS AS NEEDED.
3.
NAIL RED ROSIN PAPER.
4.
INSTALL NEW KYNAR COATED EDGE METAL AND COUNTERFLASHING.
SCOPE OF WORK: REPLACEMENT
PHONE (800) 321-9336 / FAX (216) 641-0633
THE GARLAND COMPANY INC.
GLENBROOK MIDDLE SCHOOL
Mt. Diablo Unified School District
2351 OLIVERA RD, CONCORD, CA 94520
"""
DRAWINGS = {
    "vendor": [VENDOR_COVER, VENDOR_SCOPE], "bare": [BARE_HEADING], "architect": [ARCHITECT_COVER, TRADE_SCOPES], "split": [SPLIT_COVER, PROSE_SCOPE, CODES], "logo": [LOGO_COVER], "state": [STATE_COVER], "none": [NO_HEADING], "empty": [""], "null": [None, None],
    "above": [ABOVE],
}


@pytest.fixture(scope="module")
def rows(spark):
    pages = spark.createDataFrame([(k, n, t) for k, texts in DRAWINGS.items() for n, t in enumerate(texts, 1)], "doc_id string, page_number int, text string")
    return {r["doc_id"]: r for r in requirement_rows(pages).collect()}


def titled(row):
    return {s["title"]: s["items"] for s in row["scope_sections"]}


def test_a_vendors_drawing(rows):
    r = rows["vendor"]
    assert (r["provider_company"], r["provider_agent"], r["provider_phone"], r["provider_fax"]) == ("THE GARLAND COMPANY INC", "Doug Clark", "(800) 321-9336", "(216) 641-0633")
    assert r["provider_address"] == "3800 EAST 91st STREET - CLEVELAND, OHIO 44105-2197"
    assert (r["client"], r["project_title"], r["site_address"]) == ("Mt. Diablo Unified School District", "AYERS ELEMENTARY ROOF RESTORATION", "5120 MYRTLE DR, CONCORD, CA 94521")
    assert (r["date"], r["work_type"]) == ("2025-01-13", "Roof Restoration")
    assert r["sheet_index"] == ["SHT 1 — COVER SHEET", "SHT 2 — SCOPE OF WORK & TYPICAL DETAIL", "SHT 3 — ROOF PLAN", "SHT 4 — DETAILS", "SHT 5 — DETAILS"]
    assert {t: len(i) for t, i in titled(r).items()} == {"LIQUID APPLIED ROOF RESTORATION SCOPE": 3, "SCOPE OF WORK": 2}


def test_a_heading_without_a_body_takes_nothing(rows):
    assert list(titled(rows["bare"])) == ["LIQUID APPLIED ROOF RESTORATION SCOPE"]


def test_an_architects_drawing(rows):
    r = rows["architect"]
    assert (r["client"], r["job_number"], r["date"], r["site_address"]) == ("PROJECT OWNER & TITLE MOUNT DIABLO UNIFIED SCHOOL DISTRICT", "23119.01", "2025-08-01", "1371 Detroit Ave, Concord, CA 94520")
    assert [(c["discipline"], c["firm"], c["phone"]) for c in r["consultants"]] == [("Civil Engineer", "CARROLL ENGINEERING", "(408) 261-9800"), ("Mechanical Engineer", "CYPRESS ENGINEERING GROUP", "(831) 218-1802")]
    assert r["consultants"][0]["address"] == "1101 South Winchester Blvd., Suite H184, San Jose, CA 95128"
    by = titled(r)
    assert list(by) == ["TECHNOLOGY SCOPE OF WORK", "PAINT SCOPE OF WORK"] and [len(i) for i in by.values()] == [3, 3]
    assert "RE-CABLE" in by["TECHNOLOGY SCOPE OF WORK"][0] and not any("PANDUIT" in i or "CAT6A" in i for i in by["PAINT SCOPE OF WORK"])


def test_a_split_title_block(rows):
    r = rows["split"]
    assert (r["client"], r["project_title"]) == ("MOUNT DIABLO UNIFIED SCHOOL DISTRICT", "RIO VISTA ES MODERNIZATION & SITE IMPROVEMENTS")
    assert (r["job_number"], r["date"], r["site_address"]) == ("23118.01", "2024-09-27", "611 Pacifica Ave, Bay Point, CA 94565")
    assert (r["provider_phone"], r["provider_address"], r["provider_company"], r["aor_license"]) == ("(408) 715-4470", "991 W HEDDING ST., SUITE 101, SAN JOSE, CA 95126", "BASE Design Inc.", "C-36107")
    assert (r["document_status"], r["work_type"]) == ("Construction Document", "Modernization & Site Improvements")
    assert "Carlotta" in r["district_address"]
    assert [c[:24] for c in r["applicable_codes"]] == ["CALIFORNIA BUILDING CODE", "CALIFORNIA MECHANICAL CO"]
    assert len(r["project_summary"]) == 2 and all("HVAC" in b for b in r["project_summary"])
    assert any("INC. 2" in x for x in r["limits_of_work"]) and r["alternates"] == ["Alternate A — ADDITIONAL ROOFTOP UNIT REPLACEMENT AT BUILDING 4"]
    assert [i[:18] for i in titled(r)["EXTERIOR REPAINTING SCOPE OF WORK"]][0] == "REPAIR ALL DAMAGED"


def test_a_firm_known_by_its_stamp_only(rows):
    assert (rows["logo"]["provider_company"], rows["logo"]["aor_license"], rows["logo"]["job_number"]) == ("196 Architects", "C-36107", "24103.01")


def test_a_state_number_below_its_label(rows):
    r = rows["state"]
    assert (r["dsa_number"], r["document_status"]) == ("01-121540", "DSA Submittal")
    assert any("HVAC" in b for b in r["project_summary"]) and "MECHANICAL SCOPE OF WORK" in titled(r)


def test_no_scope_and_no_text(rows):
    assert rows["none"]["provider_company"] == "ACME CORP INC" and rows["none"]["notes"] == [NO_SCOPE] and rows["none"]["provider_phone"] == "(555) 123-4567"
    for k in ("empty", "null"):
        assert rows[k]["notes"] == [NO_TEXT] and rows[k]["pages_with_text"] == 0 and rows[k]["scope_sections"] == [] and rows[k]["client"] is None
    assert rows["null"]["total_pages"] == 2


def test_chrome_never_becomes_an_item(rows):
    items = [i for s in rows["above"]["scope_sections"] for i in s["items"]]
    assert any("NAIL RED ROSIN" in i for i in items) and not any("PHONE" in i or "GARLAND" in i or "GLENBROOK" in i for i in items)


def test_no_pages(spark):
    assert requirement_rows(spark.createDataFrame([], "doc_id string, page_number int, text string")).count() == 0


def test_firms_in_logos(spark):
    cases = [(["196 ARCHITECTS", "991 W. HEDDING STREET"], "196 Architects"), (["196", "ARCHITECTS", "SAN JOSE"], "196 Architects"), (["Base Design Inc.", "TEL 1"], "Base Design Inc."), (["SAN JOSE", None], None), ([], None)]
    got = spark.createDataFrame([(c,) for c, _ in cases], "lines array<string>").select(blocks.firm_of_logo(F.col("lines"))).collect()
    assert [r[0] for r in got] == [x for _, x in cases]


def test_loose_notes(spark):
    text = [("a", ["GENERAL NOTES:", "short", "A NOTE THAT IS LONG ENOUGH TO KEEP", "DATE:", "ANOTHER NOTE THAT COMES TOO LATE"]), ("b", ["nothing"])]
    df = spark.createDataFrame(text, "doc_id string, l array<string>").select("doc_id", F.transform("l", lambda t: F.struct(t.alias("text"))).alias("lines"))
    assert [tuple(r) for r in scopes.loose_notes(df).collect()] == [("a", ["A NOTE THAT IS LONG ENOUGH TO KEEP"])]
