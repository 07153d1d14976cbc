import pytest
from pyspark.sql import functions as F

from planloom.operators.packed import ADDRESSES, SHEETS, split_values, unpack

CASES = [
    (SHEETS, 'A-574 FIRE ALARM PLAN, "S210 TITLE SHEET"', ["A-574 FIRE ALARM PLAN", "S210 TITLE SHEET"]),
    (SHEETS, '"M-542 12"" DUCT HANGER DETAIL", "SHT 45 - COVER SHEET"', ['M-542 12" DUCT HANGER DETAIL', "SHT 45 - COVER SHEET"]),
    (SHEETS, 'SHT 4 - 12" DUCT HANGER DETAIL | M-278 PLAN; AREA B', ['SHT 4 - 12" DUCT HANGER DETAIL', "M-278 PLAN; AREA B"]),
    (SHEETS, 'M-1 X;A441 12" DUCT', ["M-1 X", 'A441 12" DUCT']),
    (SHEETS, "M-101 PARTS, PART 2 / E-202 POWER / SIGNAL PLAN", ["M-101 PARTS, PART 2", "E-202 POWER / SIGNAL PLAN"]),
    (SHEETS, "A-101 ONE\r\nA-102 TWO\tA-103 THREE || A-104 FOUR;;", ["A-101 ONE", "A-102 TWO", "A-103 THREE", "A-104 FOUR"]),
    (SHEETS, "FA-289 PHASING; AREA B", ["FA-289 PHASING; AREA B"]),
    (ADDRESSES, "1 Elm St, Town, CA 90001; 22 Oak Ave, Suite 3, Other, NM 87001 & 3 Fir Rd", ["1 Elm St, Town, CA 90001", "22 Oak Ave, Suite 3, Other, NM 87001", "3 Fir Rd"]),
    (ADDRESSES, '"1 Elm St, Town", 2753 Castnick Drive - Brum CA 99497, 4825 CASTTOCK DR', ["1 Elm St, Town", "2753 Castnick Drive - Brum CA 99497", "4825 CASTTOCK DR"]),
    (ADDRESSES, "Toslond, CA 95607 - 1320 Lelshuby Road", ["Toslond, CA 95607 - 1320 Lelshuby Road"]),
    (ADDRESSES, "1 Elm and 2 Oak; ", ["1 Elm", "2 Oak"]),
    (ADDRESSES, '"open quote; 2 Oak', ['"open quote', "2 Oak"]),
    (ADDRESSES, "", []),
    (ADDRESSES, ' ; ""', []),
    (SHEETS, None, None),
]


@pytest.mark.parametrize(("how", "entry", "expected"), CASES)
def test_split_values(spark, how, entry, expected):
    assert spark.createDataFrame([(entry,)], "e string").select(split_values(F.col("e"), how)).first()[0] == expected


def test_positions_repeats_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", ["A-101 X", "A-102 Y; A-103 Z", None, "A-102 Y; A-103 Z"], "mine"), ("b", [], "x"), ("c", None, None)], "doc_id string, l array<string>, value_text string")
    got = [tuple(r) for r in unpack(df, ["doc_id"], "l", SHEETS, least=2).orderBy("entry_no", "value_no").collect()]
    assert got == [("a", 2, 1, "A-102 Y"), ("a", 2, 2, "A-103 Z"), ("a", 4, 1, "A-102 Y"), ("a", 4, 2, "A-103 Z")]
    assert unpack(df.limit(0), ["doc_id"], "l", SHEETS).count() == 0


def test_round_trip(spark):
    values = [f'M-{100 + i} TITLE {i}, PART "{i}"; X' for i in range(300)]
    entry = ", ".join('"' + v.replace('"', '""') + '"' for v in values)
    assert spark.createDataFrame([(entry,)], "e string").select(split_values(F.col("e"), SHEETS)).first()[0] == values
