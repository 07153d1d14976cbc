import pytest

from planloom.functions.dates import read_moment
from planloom.operators.timestamps import MomentDictionary, normalise_moments

LA = "America/Los_Angeles"


@pytest.mark.parametrize(
    ("typed", "zone", "expected"),
    [
        ("2026-08-15", LA, "2026-08-15"),
        ("15/08/2026", LA, "2026-08-15"),
        ("08/15/2026", LA, "2026-08-15"),
        ("03/04/2026", LA, "2026-04-03"),
        ("03/04/26", LA, "2026-03-04"),
        ("1/2/69", LA, "1969-01-02"),
        ("15.08.2026", LA, "2026-08-15"),
        ("August 15, 2026", LA, "2026-08-15"),
        ("15 Aug 2026", LA, "2026-08-15"),
        ("27th September 2025", LA, "2025-09-27"),
        ("11 de abril de 2023", LA, "2023-04-11"),
        ("29 décembre 2023", LA, "2023-12-29"),
        ("DATE:  Monday, December 2, 2024 ", LA, "2024-12-02"),
        ("20240617", LA, "2024-06-17"),
        ("2022-11-03T18:59:00Z", LA, "2022-11-03T18:59:00.000000Z"),
        ("2024-05-13T16:00:35.5-05:00", LA, "2024-05-13T21:00:35.500000Z"),
        ("2023-06-16 11:15 [America/Denver]", LA, "2023-06-16T17:15:00.000000Z"),
        ("9:00 a.m. EST, 3 de noviembre de 2024", LA, "2024-11-03T14:00:00.000000Z"),
        ("April 19, 2022, 14:00 PT", "America/New_York", "2022-04-19T21:00:00.000000Z"),
        ("2nd July 2022, 12:00 noon", LA, "2022-07-02T19:00:00.000000Z"),
        ("09.03.2019 12:00am", LA, "2019-03-09T08:00:00.000000Z"),
        ("20260423T210000Z", LA, "2026-04-23T21:00:00.000000Z"),
        ("1736789454", LA, "2025-01-13T17:30:54.000000Z"),
        ("1784233800000", LA, "2026-07-16T20:30:00.000000Z"),
        # Around clock changes: the first of two, and the offset before a gap.
        ("2026-11-01 01:30", LA, "2026-11-01T08:30:00.000000Z"),
        ("2026-11-01 01:30 PST", LA, "2026-11-01T09:30:00.000000Z"),
        ("2026-03-08 02:30", LA, "2026-03-08T10:30:00.000000Z"),
        ("2026-07-01 12:00", "America/Phoenix", "2026-07-01T19:00:00.000000Z"),
        ("2026-07-01 12:00", None, None),
        ("2026-07-01 12:00 +02:00", None, "2026-07-01T10:00:00.000000Z"),
        ("2022-02-30", LA, None),
        ("00/00/0000", LA, None),
        ("26/22/2025", LA, None),
        ("Q3 2023", LA, None),
        ("April 2024", LA, None),
        ("2024", LA, None),
        ("TBD", LA, None),
        ("within 10 days of award", LA, None),
        ("2024-05-06 to 2024-05-09", LA, None),
        ("", LA, None),
        (None, LA, None),
        ("x" * 200_000, LA, None),
    ],
)
def test_read_moment(typed, zone, expected):
    assert read_moment(typed, zone) == expected


ROWS = "source string, raw string, zone string, norm_value string, _n int"


def test_rows_keep_repeats_nulls_and_clashing_columns(spark):
    rows = [("a", "2026-08-15", LA, "mine", 1)] * 3 + [("a", None, LA, "n", 2), ("a", " ", None, "b", 3), ("a", "TBD", LA, "t", 4), (None, "2026-08-15", LA, "s", 5)]
    df = spark.createDataFrame(rows, ROWS)
    got = sorted((r["norm_value"], r["_n"], r["day"]) for r in normalise_moments(df, "source", "raw", "zone", out="day").collect())
    assert got == sorted([("mine", 1, "2026-08-15")] * 3 + [("n", 2, None), ("b", 3, None), ("t", 4, None), ("s", 5, None)])
    assert normalise_moments(df.limit(0), "source", "raw", "zone", out="day").count() == 0


def test_dictionary_parses_only_what_is_new(spark, tmp_path):
    kept = MomentDictionary(spark, str(tmp_path / "d"))
    first = spark.createDataFrame([("a", "2026-08-15", LA)], "source string, raw string, zone string")
    both = spark.createDataFrame([("a", "2026-08-15", LA), ("a", "TBD", LA)], "source string, raw string, zone string")
    assert kept.update(first).count() == 1
    assert {(r["raw"], r["norm_value"]) for r in kept.update(both).collect()} == {("2026-08-15", "2026-08-15"), ("TBD", None)}
    assert spark.read.parquet(kept.path).count() == 2


def test_the_query_keeps_its_dictionary(spark, small, monkeypatch):
    from pyspark.sql import DataFrame

    from planloom.plans.records import p1_found

    parsed = []
    plain = DataFrame.mapInPandas
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda df, *a, **k: parsed.append((df.count(), df.rdd.getNumPartitions())) or plain(df, *a, **k))
    first = {tuple(r) for r in p1_found(spark, small).collect()}
    assert all(parts >= spark.sparkContext.defaultParallelism for _n, parts in parsed)
    parsed.clear()
    assert {tuple(r) for r in p1_found(spark, small).collect()} == first and not parsed
    kept = MomentDictionary.shared(spark).entries()
    assert kept.count() == kept.dropDuplicates(["source", "raw", "zone"]).count() > 0
