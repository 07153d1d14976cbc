import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from planloom.functions import similarity as sim
from planloom.functions import text as T


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


def test_scalars(spark):
    assert one(spark, T.clean_line, " a \t b\u0000 ") == "a b"
    assert one(spark, T.fingerprint, "12 Elm St., #4") == "12ELMST4"
    assert one(spark, T.phone_digits, "1 (408) 715-4470") == "4087154470"
    assert one(spark, T.phone_digits, "12-34") is None
    assert one(spark, T.format_phone, "408.715.4470") == "(408) 715-4470"
    assert one(spark, T.format_phone, " 123 ") == "123"
    assert one(spark, T.title_case, "M&E O'NEIL 3RD") == "M&E O'Neil 3Rd"
    assert one(spark, T.prettify, "smoke_damper") == "Smoke Damper"
    assert one(spark, T.sentence_case, "REPLACE ALL ROOFTOP UNITS") == "Replace all rooftop units"
    assert one(spark, T.sentence_case, "HVAC") == "HVAC"
    assert one(spark, T.escape_markup, "a<b&c>") == "a&lt;b&amp;c&gt;"
    assert one(spark, T.label_key, " CLIENT NAME: ") == "client name"
    assert one(spark, lambda x: T.stem_name(x, " r.pdf"), "x/My Set.v2.PDF") == "My Set.v2 r.pdf"
    assert one(spark, T.blank_to_null, "   ") is None
    assert one(spark, lambda x: T.truncate(x, 5), "abcdefgh") == "abcd…"
    for f in (T.clean_line, T.fingerprint, T.phone_digits, T.format_phone, T.title_case, T.sentence_case, T.label_key, T.blank_to_null):
        assert one(spark, f, None) is None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_lcs_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abcd", k=rng.randrange(9))), "".join(rng.choices("abcd", k=rng.randrange(9)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sim.lcs_length(F.col("a"), F.col("b")).alias("n"), sim.ratio(F.col("a"), F.col("b")).alias("r"), sim.ratio_from(F.col("a"), F.col("b"), 70).alias("f")).collect()
    for r in got:
        expected = 100 * 2 * lcs(r["a"], r["b"]) / (len(r["a"]) + len(r["b"])) if r["a"] or r["b"] else 100
        assert r["n"] == lcs(r["a"], r["b"])
        assert abs(r["r"] - expected) < 1e-9
        assert abs(r["f"] - (expected if expected >= 70 else 0)) < 1e-9


def test_token_set_ratio(spark):
    cases = [("architect / engineer", "engineer", 100), ("name", "client name", 100), ("drawing no", "drawing title", None), ("", "x", 0)]
    for a, b, expected in cases:
        got = spark.createDataFrame([(a, b)], "a string, b string").select(sim.token_set_ratio(F.col("a"), F.col("b"))).first()[0]
        assert got == expected if expected is not None else got < 85
    assert SequenceMatcher


def test_lcs_as_bits_and_the_letter_bound_against_brute_force(spark):
    rng = random.Random(11)
    pairs = [("".join(rng.choices("abcde1", k=rng.randrange(12))), "".join(rng.choices("abcde1", k=rng.randrange(12)))) for _ in range(300)] + [(None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sim.lcs_similarity(F.col("a"), F.col("b")).alias("s"), sim.differing_letters(sim.letter_mask(F.col("a")), sim.letter_mask(F.col("b"))).alias("d")).collect()
    for r in got:
        if r["a"] is None:
            assert r["s"] is None
            continue
        n = lcs(r["a"], r["b"])
        assert sim.lcs_of(r["a"], r["b"]) == n and r["d"] <= len(r["a"]) + len(r["b"]) - 2 * n
        assert abs(r["s"] - (2 * n / (len(r["a"]) + len(r["b"])) if r["a"] or r["b"] else 1.0)) < 1e-12
