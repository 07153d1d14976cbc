import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from planloom.operators import changes, detections, reports, sections
from planloom.operators.skew import heavy_key_join
from planloom.sources import files


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_heavy_key_join_keeps_every_row(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", "h", 500)] + [(f"k{i}", "c", 1) for i in range(0, 300, 2)], "k string, v string, n int")
    got = heavy_key_join(left, right, ["k"], "n")
    assert got.count() == 650 and set(got.columns) == {"k", "i", "v"}


def test_valid_and_latest(spark):
    data = [("a", 5, 1.0, 1), ("a", None, 2.0, 3), ("a", 7, None, 2), ("b", -1, 1.0, 1), ("c", 1, float("nan"), 1), ("d", 1, float("inf"), 1), ("e", None, None, 1)]
    df = spark.createDataFrame(data, "k string, count int, cost double, at int")
    good, bad = changes.split_valid(df, {"count": changes.finite_between(F.col("count").cast("double"), 0, 100000), "cost": changes.finite_between(F.col("cost"), 0, 1e7)})
    assert sorted((r["k"], r["broken"]) for r in bad.collect()) == [("b", ["count"]), ("c", ["cost"]), ("d", ["cost"])]
    latest = {r["k"]: (r["count"], r["cost"]) for r in changes.latest_values(good, "k", ["at"], ["count", "cost"]).collect()}
    assert latest == {"a": (7, 2.0), "e": (None, None)}
    base = spark.createDataFrame([("a", 1, 9.0), ("z", 2, 8.0)], "k string, count int, cost double")
    changed = changes.with_changes(base, "k", changes.latest_values(good, "k", ["at"], ["count", "cost"]), ["count", "cost"])
    assert sorted(rows(changed)) == [("a", 7, 2.0), ("z", 2, 8.0)]


def test_merge_replace_delete_and_columns(spark):
    df = spark.createDataFrame([("a", 2, "late", None), ("a", 1, " ", "x"), ("a", 3, "later", "y")], "k string, page int, u string, v string")
    assert rows(changes.merged_in_order(df, "k", "page", ["u", "v"])) == [("a", "late", "x")]
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert sorted(rows(changes.replaced(table, spark.createDataFrame([("a", 5), ("a", 6)], "k string, n int"), "k"))) == [("a", 5), ("a", 6), ("b", 2)]
    assert rows(changes.without_parents(table, "k", spark.createDataFrame([("a",), ("a",)], "id string"))) == [("b", 2)]
    assert changes.with_columns(table, {"n": "int", "m": "string"}).columns == ["k", "n", "m"]


def test_sections(spark):
    work = ["REMOVE EXISTING ROOF GRAVEL AND DISPOSE", "INSTALL NEW BASE SHEET OVER DECK"]
    data = [("a", [("Scope of Work", work), ("Roof Scope", work + ["TEST ALL DRAINS BEFORE WORK"]), ("Other", ["PAINT ALL EXPOSED METAL SURFACES"]), ("Empty", []), ("Null", None)])]
    df = spark.createDataFrame(data, "k string, s array<struct<title:string,items:array<string>>>")
    kept = df.select(sections.without_repeats(F.col("s")).alias("s")).first()["s"]
    assert [(x["title"], len(x["items"])) for x in kept] == [("Roof Scope", 3), ("Other", 1)]
    scored = {r["section_no"]: r["score"] for r in sections.top_sections(sections.section_rows(df, "k", "s"), "k").collect()}
    assert scored[4] == scored[5] == -1 and scored[2] == 9
    items = spark.createDataFrame([("PHONE (408) 715-4470 EXT",), ("V.I.F.",), (work[0],)], "x string").select(sections.is_quality_item(F.col("x"))).collect()
    assert [r[0] for r in items] == [False, False, True]


def test_detections(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],), (None,)], "x array<double>")
    got = rows(df.select(detections.argmax(F.col("x")), detections.softmax(F.col("x"))))
    assert got[0][0] == 1 and abs(sum(got[0][1]) - 1) < 1e-9 and got[1][0] is None and got[2][0] is None
    box = spark.createDataFrame([((-3.5, 2.9, 99999.0, 5.0),)], "b struct<x1:double,y1:double,x2:double,y2:double>").select(detections.clamp_box(F.col("b"), 100, 50).alias("c")).first()["c"]
    assert tuple(box) == (0, 2, 100, 5)
    best = detections.best_of(spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9), ("a", 4, None)], "k string, p int, s double"), ["k"], "s", ["p"])
    assert rows(best) == [("a", 2, 0.9)]


def test_report_rows(spark):
    df = spark.createDataFrame([("a", "T", None, ["FIRST LINE OF THE SUMMARY TEXT", " "], None)], "k string, t string, c string, s array<string>, l array<string>")
    assert rows(reports.field_rows(df, "k", [("Title", "t"), ("Client", "c")])) == [("a", 1, "Title", "T"), ("a", 2, "Client", "")]
    assert rows(reports.section_report(df, "k", [("Limits", "l"), ("Summary", "s")])) == [("a", 1, "Summary", 1, "First line of the summary text")]
    assert json.loads(reports.json_report(df, "k", ["t", "c"]).first()["report"]) == {"t": "T"}


def test_rate_files(spark, tmp_path):
    good = tmp_path / "r.json"
    good.write_text(json.dumps({"currency": "USD", "default_unit_cost": 100.0, "rates": {"vav_box": {"display_name": "VAV Box", "unit_cost": 850.0}}}))
    entries, meta = files.rates_from_json(spark, str(good))
    assert rows(entries) == [("vav_box", "VAV Box", Decimal("850.0000"))] and meta.first()["default_unit_cost"] == Decimal("100.0000")
    for text in ("{", json.dumps({"rates": {"x": {"display_name": "X", "unit_cost": "dear"}}}), json.dumps({"currency": "USD"})):
        bad = tmp_path / "bad.json"
        bad.write_text(text)
        with pytest.raises(files.RatesError):
            files.rates_from_json(spark, str(bad))
    with pytest.raises(files.RatesError):
        files.rates_from_json(spark, str(tmp_path / "none.json"))


def test_pdf_files_and_upright_text(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"not")
    (tmp_path / "c.pdf").write_bytes(b"")
    good, bad = files.pdf_files(spark, str(tmp_path))
    assert good.count() == 1 and {r["error"] for r in bad.collect()} == {"not a PDF"}
    assert {r["error"] for r in files.pdf_files(spark, str(tmp_path), most_bytes=5)[1].collect()} == {"file too large", "not a PDF"}
    spans = [("d", 1, 900.0, 10.0, 0.0, -1.0, "low"), ("d", 1, 902.0, 90.0, 0.0, -1.0, "high"), ("d", 1, 950.0, 5.0, 0.0, 1.0, "right"), ("d", 1, 10.0, 5.0, 0.0, 1.0, "left side"), ("d", 1, 900.0, 5.0, 1.0, 0.0, "level")]
    df = spark.createDataFrame(spans, "doc_id string, page_number int, x0 double, y0 double, dx double, dy double, text string")
    assert files.upright_text(df, 1000.0).first()["text"] == "high\nlow\nright"


def test_stream_of_new_files(spark, tmp_path):
    from planloom.streaming.incremental import follow_folder

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int")
    df.write.parquet(src)
    for _ in range(2):
        follow_folder(spark, src, df.schema, lambda b: b.groupBy("k").count(), out, str(tmp_path / "cp")).awaitTermination()
    assert [(r["k"], r["count"]) for r in spark.read.parquet(out).collect()] == [("a", 2)]
