import pytest
from pyspark.sql import functions as F

from planloom.operators import fields, labels, lines

SCOPE = "SCOPE OF WORK:\n1.\nREMOVE AND DISPOSE OF EXISTING GRAVEL\nFROM THE ROOF\n2. NAIL BASE SHEET\nTHANKS,\nlost line\n3. APPLY COATING\x0bTO ALL"


def docs(spark, *texts):
    return lines.document_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_document_lines_over_pages(spark):
    pages = spark.createDataFrame([("a", 2, "x\n\n y "), ("a", 1, "p q"), ("b", 1, None), ("b", 2, "")], "doc_id string, page_number int, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["lines"]] for r in lines.document_lines(pages, page="page_number").collect()}
    assert got == {"a": [(1, 1, "p"), (1, 2, "q"), (2, 3, "x"), (2, 4, "y")], "b": []}


def test_numbered_items(spark):
    got = rows(lines.numbered_items(docs(spark, SCOPE), ends=lambda t: t.rlike("^THANKS")).orderBy("item_no"))
    assert got == [(0, 1, 1, "REMOVE AND DISPOSE OF EXISTING GRAVEL FROM THE ROOF"), (0, 2, 2, "NAIL BASE SHEET"), (0, 3, 3, "APPLY COATING TO ALL")]
    assert rows(lines.numbered_items(docs(spark, None, "", "no items"))) == []


def test_positional_lookups(spark):
    d = docs(spark, "a\nKEY\nb\nhit 1\nhit 2", "KEY", None)
    assert rows(lines.next_lines(d, lambda t: t == "KEY").orderBy("doc_id")) == [(0, 2, "KEY", "b"), (1, 1, "KEY", None)]
    assert rows(lines.first_in_range(d, lambda t: t == "KEY", lambda t: t.rlike("hit"), after=2)) == [(0, 2, 4, "hit 1")]
    assert rows(lines.first_in_range(d, lambda t: t == "KEY", lambda t: t.rlike("hit"), after=1)) == []
    assert rows(lines.first_in_range(d, lambda t: t.rlike("hit 2"), lambda t: t == "a", after=0, before=9)) == [(0, 5, 1, "a")]
    all_lines = lines.exploded(d)
    assert rows(lines.nearest_to_anchor(all_lines, F.col("text") == "KEY", F.col("text").rlike("hit"), 15)) == [(0, "hit 1", 4, 13)]
    assert rows(lines.best_line(all_lines, "doc_id", F.when(F.col("text").rlike("hit"), 5).otherwise(0), 1)) == [(0, "hit 1", 4, 5)]


def test_segments_and_capture(spark):
    d = docs(spark, "x\nHEAD 1\na\nb\nHEAD 2\nHEAD 3\nc")
    assert rows(lines.segments(d, lambda t: t.rlike("^HEAD")).orderBy("segment_no")) == [(0, 1, "HEAD 1", ["a", "b"]), (0, 2, "HEAD 2", []), (0, 3, "HEAD 3", ["c"])]
    assert rows(lines.segments(d, lambda t: t.rlike("^HEAD"), most=1).orderBy("segment_no"))[0] == (0, 1, "HEAD 1", ["a"])
    assert [r[2] for r in rows(lines.while_open(d, lambda t: t == "HEAD 1", lambda t: t == "HEAD 2"))] == ["a", "b"]


def test_ordered_distinct_keeps_first_and_caps(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "X"), ("a", 2, "y"), ("a", 4, "z"), ("b", 1, "q")], "g string, n int, v string")
    assert rows(lines.ordered_distinct(df, "g", "n", "v", 2).orderBy("g", "position")) == [("a", 1, "X"), ("a", 2, "y"), ("b", 1, "q")]


STACKED = "PROJECT TITLE\nRiverside Tower\nCLIENT\nMeridian Group\nCONSULTANT\nApex\nISSUE DATE\n2026-08-15"
LABELLED = [
    (STACKED, {"title": "Riverside Tower", "client": "Meridian Group", "engineer": "Apex", "due_date": "2026-08-15"}),
    ("Client: ACME Corp\nArchitect: Studio 9\nDue Date: 15/08/2026", {"client": "ACME Corp", "architect": "Studio 9", "due_date": "15/08/2026"}),
    ("CL1ENT\nNorthwind Holdings", {"client": "Northwind Holdings"}),
    ("ARCHITECT / ENGINEER\nOmni Design-Build LLP", {"architect": "Omni Design-Build LLP", "engineer": "Omni Design-Build LLP"}),
    ("DRAWING NO\nM-301\nSCALE\n1:100", {}),
    ("CLIENT\nFirst Corp\nOWNER\nSecond Corp", {"client": "First Corp"}),
]


@pytest.mark.parametrize(("text", "expected"), LABELLED)
def test_label_map(spark, text, expected):
    got = labels.map_labels(docs(spark, text), labels.aliases(spark)).collect()
    assert {r["field"]: r["value"] for r in got} == expected


COVER = """ROOF RESTORATION
JOB NUMBER: 23118.01
C-36107
TEL (408) 715-4470
DSA # 01-121540
CONSTRUCTION  DOCUMENTS
SHT 1 - COVER
SHT 1 - COVER
M-101 ROOF PLAN DETAILS
M-102 SYMBOL LEGEND
BID ALTERNATE NO. 1 - NEW CURBS
196 Hedding Street
SAN JOSE, CA 95126
2026-08-15"""


def test_fields(spark):
    d = docs(spark, COVER, None, "nothing here")
    got = {r["doc_id"]: r.asDict() for r in fields.header_fields(d).collect()}
    assert got[0] == {"doc_id": 0, "job_number": "23118.01", "license": "C-36107", "state_number": "01-121540", "phone": "(408) 715-4470", "status": "Construction Document", "work_type": "Roof Restoration", "date_text": "2026-08-15"}
    assert all(v is None for k, v in got[2].items() if k != "doc_id")
    assert [r["entry"] for r in fields.sheet_index(d).orderBy("position").collect()] == ["SHT 1 — COVER", "M-101 — ROOF PLAN DETAILS"]
    assert [r["entry"] for r in fields.alternates(d).collect()] == ["Alternate 1 — NEW CURBS"]
    assert [r["entry"] for r in fields.two_line_addresses(d).collect()] == ["196 Hedding Street, SAN JOSE, CA 95126"]
    people = spark.createDataFrame([("Jane Doe",), ("SHEET TITLE",), ("Jane",), ("Loma Vista ES",)], "t string").select(fields.is_person_name(F.col("t"))).collect()
    assert [r[0] for r in people] == [True, False, False, False]
