from pyspark.sql import functions as F

from planloom.operators.pages import cover_pages, cover_score, scope_pages, within_cap

PAGES = [
    ("sure", 1, "ABBREVIATIONS"), ("sure", 2, "PROJECT OWNER\nUNIFIED SCHOOL DISTRICT"), ("sure", 3, "JOB NUMBER"),
    ("near", 1, "SHEET INDEX"), ("near", 2, "UNIFIED"), ("near", 3, "CONSULTANTS"), ("near", 4, "JOB NUMBER"),
    ("none", 1, None), ("none", 2, "x"), ("none", 3, ""), ("none", 4, "y"), ("none", 13, "PROJECT OWNER"),
    ("tie", 1, "a"), ("tie", 2, "CONSULTANTS"), ("tie", 5, "CONSULTANTS"),
]


def test_covers(spark):
    df = spark.createDataFrame(PAGES, "doc_id string, page_number int, text string")
    got = {}
    for r in cover_pages(df).collect():
        got.setdefault(r["doc_id"], set()).add(r["page_number"])
    assert got == {"sure": {2}, "near": {1, 2}, "none": {1, 2, 3}, "tie": {2}}
    assert cover_pages(df.limit(0)).count() == 0
    assert df.where("doc_id = 'sure' and page_number = 2").select(cover_score(F.col("text"))).first()[0] == 14


def test_scope_and_cap(spark):
    df = spark.createDataFrame([(1, "Scope of work:"), (2, "telescope"), (3, None), (4, "GENERAL NOTES")], "page_number int, text string")
    assert [r["page_number"] for r in scope_pages(df).orderBy("page_number").collect()] == [1, 4]
    kept, _ = within_cap(df, 2)
    assert kept.count() == 2
