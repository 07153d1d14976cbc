import random

from pyspark.sql import functions as F

import planloom.llm.addresses as addresses
import planloom.llm.pairs as pairs
from planloom.functions.similarity import edits_within
from planloom.llm.addresses import ALIKE, CARRIED, LEVELS, PARTS, agreement, building_of, candidates, estimate_weights, taken_apart

SAME = [
    ["421 Skusmelen Avenue, Suite 337, Pleirtstaby Falls, CA 92205", "#337, 421 SKUSMELEN AVE, PLEIRTSTABY FALLS 92205", "421 Skusemlen, Ste 337; Pleirtstaby Falls, CA 92205-5873", "Pleirtstaby Falls, California 92205 - 421 Skusmelen Av.", "# 421 Skusme1en Ave. 92205"],
    ["780 South Boaxshuby Drive, Brumbater Mesa, CA 94523", "Unit 114, 780 Boaxshiiby Dr South, Brumbater Mesa, CA 94523", "780 s boaxshuby dr., brumbater mesa"],
    ["780 North Boaxshuby Drive, Brumbater Mesa, CA 94523"],
    ["780 South Boaxshuby Lane, Brumbater Mesa, CA 94523"],
    ["782 South Boaxshuby Drive, Brumbater Mesa, CA 94523"],
    ["780 South Boaxshuby Drive, Toslond, CA 95607", "780 So. Boaxshuby Drv., Toslond 95607"],
    ["3690 South Cralsheth Way, Skondbater, HI 96709", "SKONDBATER 96709, 3690 SOUTH CRALSHETH WY"],
]
NOWHERE = ["N/A", "See cover sheet", "", None, "90210", "Toslond, CA"]


def records(spark, names=tuple(map(tuple, SAME))):
    data = [(f"r{i}/{j}", n, "mine") for i, group in enumerate(names) for j, n in enumerate(group)] + [(f"n{i}", n, "x") for i, n in enumerate(NOWHERE)]
    return spark.createDataFrame(data, "rec string, place string, raw string")


def test_parts(spark):
    cases = {
        "No. 5 East Elm St., Apt 4B, Old Town, New York 10001-1234": ("5", "e", "elm", "st", "old town", "10001"),
        "6655 Plautuwy Wy Toslond CA 95607": ("6655", None, "plautuwy", "way", "toslond", "95607"),
        "12 Quem": ("12", None, "quem", None, None, None),
    }
    got = taken_apart(spark.createDataFrame([(k, 1) for k in cases], "raw string, n long"))
    assert {r["raw"]: tuple(r[p] for p in PARTS) for r in got.collect()} == cases


def test_same_building_and_different_ones(spark):
    by = {}
    for r in building_of(records(spark), "rec", "place").collect():
        by.setdefault(r["building"], set()).add(r["key"].split("/")[0])
    assert sorted(map(sorted, by.values())) == [[f"r{i}"] for i in range(len(SAME))]


def test_empty_and_repeats(spark):
    df = records(spark)
    assert building_of(df.limit(0), "rec", "place").count() == 0
    assert building_of(df.unionByName(df), "rec", "place").count() == 2 * sum(map(len, SAME))
    assert building_of(df.where(F.col("rec").startswith("n")), "rec", "place").count() == 0


def test_weights_tell_matches_from_chance():
    match, chance = (0, 0, 0, 0), (3, 1, 3, 4)
    posterior, tables = estimate_weights([(match, 900), ((1, 2, 0, 0), 60), (chance, 40)], [(chance, 950), ((3, 1, 0, 4), 50)])
    assert posterior[match] > 0.99 and posterior[(1, 2, 0, 0)] > 0.9 and posterior[chance] < 0.1
    assert len(tables) == len(LEVELS)
    assert estimate_weights([], [])[0] == {}


def test_the_bound_before_the_ratio_is_not_one_too_few(spark):
    rows = [("abcde", "abdce"), ("abcdefghij", "badcefghij"), ("abcde", "abxyz")]
    df = spark.createDataFrame(rows, "a_street string, b_street string").select("*", *[F.lit(None).cast("string").alias(f"{s}_{p}") for s in "ab" for p in PARTS if p != "street"])
    level = agreement(lambda p: F.col(f"a_{p}"), lambda p: F.col(f"b_{p}"))["street"]
    assert {r["a_street"] + r["b_street"]: r["level"] for r in df.select("*", level.alias("level")).collect()} == {a + b: x for (a, b), x in zip(rows, (1, 1, 3))}
    total = spark.range(1, 200)
    for least, per in ((ALIKE, 20), (0.9, 10), (0.84, 16)):
        whole = F.floor(F.col("id") * per / 100)
        assert total.where(edits_within(least, F.col("id")) != whole).count() == 0


GARBLED = ["6489 Veilbyby Dr, Tumnulen Falls, CA 91369", "9 Elm St, Toslond", "6489 Vellbuby, Tumnulen Falls"]


def test_weights_decide_on_garbled_streets(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(("bra", "ske", "lun", "tor", "vif", "dax", "pom", "gri")) for _ in range(3))
    places = [(100 + i, word(), word(), 90000 + i) for i in range(60)]
    data = [(f"{i}/{j}", n) for i, (no, street, town, code) in enumerate(places) for j, n in enumerate((f"{no} {street} Avenue, {town}, CA {code}", f"{no} {street} Ave, {town}", f"{no} {street[:4]}{street[5]}{street[4]}{street[6:]} Ave., {town} {code}"))] + [(f"g{j}", n) for j, n in enumerate(GARBLED)]
    df = spark.createDataFrame(data, "k string, v string")

    def linked(least):
        monkeypatch.setattr(addresses, "PROBABILITY", least)
        got = {r["key"]: r["building"] for r in building_of(df, "k", "v").collect()}
        return got["g0"] == got["g2"], sum(got[f"{i}/0"] == got[f"{i}/1"] == got[f"{i}/2"] for i in range(60))

    assert linked(0.9) == (True, 60)
    assert not linked(1 - 1e-12)[0]


def test_what_both_leave_out_is_no_agreement(spark):
    row = spark.createDataFrame([(None, None)], "a_direction string, b_direction string").select("*", *[F.lit("x").alias(f"{s}_{p}") for s in "ab" for p in PARTS if p != "direction"])
    assert LEVELS["direction"][row.select(agreement(lambda p: F.col(f"a_{p}"), lambda p: F.col(f"b_{p}"))["direction"]).first()[0]] == "both"


def test_candidates_against_all_pairs_also_in_slices(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"f{i:02}", 1, 6, rng.choice("12"), None, rng.choice(("elm", "elms", "oak", "oke")), "st", rng.choice((None, "ayton", "beeton")), rng.choice((None, "90001", "90002"))) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, n long, full int, number string, direction string, street string, type string, town string, postcode string")
    sound = {"elm": "E450", "elms": "E452", "oak": "O200", "oke": "O200"}
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3] and (sound[a[5]] == sound[b[5]] or (a[7] and a[7] == b[7]) or (a[8] and a[8] == b[8]))}
    for size in (3, 500):
        monkeypatch.setattr(pairs, "BLOCK", size)
        got = [tuple(sorted((r["a_id"], r["b_id"]))) for r in candidates(df.select(*CARRIED)).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
