import random

from planloom.llm.canonical import UNMATCHED, map_to_list
from planloom.llm.disciplines import discipline_names
from planloom.llm.pigeonhole import pigeonhole_candidates


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_candidates_are_all_pairs_within_the_edits(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abc", k=n))
    refs = sorted({word(rng.randrange(1, 13)) for _ in range(80)})
    values = sorted({word(rng.randrange(0, 14)) for _ in range(300)})
    steps = ((4, 1), (8, 2))
    allowed = lambda r: 2 if len(r) >= 8 else 1 if len(r) >= 4 else 0
    got = pigeonhole_candidates(spark.createDataFrame([(v,) for v in [*values, None]], "v string"), spark.createDataFrame([(r,) for r in [*refs, None]], "r string"), "v", "r", steps)
    assert {(x["v"], x["r"], x["distance"]) for x in got.collect()} == {(v, r, lev(v, r)) for v in values for r in refs if lev(v, r) <= allowed(r)}


TYPED = {
    "MECHANICAL ENGINEERING": "D01", "M E C H A N I C A L   E N G .": "D01", "Mcchanical Enqineering": "D01", "Engineering (Electrical)": "D02", "Sub: S.E.": "D03", "Materials - Hazardous #2": "D16",
    "HVAC Consultant Consultant": "D01", "Ingeniería eléctrica": "D02", "Consultant: Fire Protection": "D06", "Title Company": UNMATCHED, "Consultant": UNMATCHED, "-": UNMATCHED, "N/A": UNMATCHED, "x" * 50_000: UNMATCHED,
}


def test_disciplines(spark):
    refs = spark.read.parquet("/root/testdata/sf0.001/discipline_ref.parquet")
    data = [(v, "mine", 1) for v in TYPED] + [("Acoustics", "mine", 2)] * 2 + [(None, "n", 3), ("  ", "b", 4)]
    df = spark.createDataFrame(data, "typed string, code string, _n int")
    names = discipline_names(spark, refs)
    got = map_to_list(df, "typed", names, "discipline_code", "discipline_name")
    rows = got.collect()
    assert {r["typed"]: r["discipline_code"] for r in rows} == {**TYPED, "Acoustics": "D08"}
    assert len(rows) == len(TYPED) + 2 and {r["code"] for r in rows} == {"mine"}
    assert map_to_list(df.limit(0), "typed", names, "discipline_code", "discipline_name").count() == 0
    none = map_to_list(df, "typed", names.limit(0), "discipline_code", "discipline_name")
    assert {r["discipline_code"] for r in none.collect()} == {UNMATCHED}


def test_ties_go_to_the_smaller_code(spark):
    refs = spark.createDataFrame([("B", "roofinga"), ("A", "roofingb")], "code string, name string")
    got = map_to_list(spark.createDataFrame([("roofingc",)], "v string"), "v", refs, "code", "name").first()
    assert got["code"] == "A"
