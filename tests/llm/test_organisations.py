import itertools
import random

from pyspark.sql import functions as F

import planloom.llm.organisations as organisations
import planloom.llm.pairs as pairs
from planloom.functions.similarity import lcs_of
from planloom.llm.forest import roots_of
from planloom.llm.organisations import organisation_of
from planloom.llm.pairs import SLICE, class_pairs

SAME = [
    ["Katherine Wauststalen & Victoria Bomlusk Design Group Corp.", "Kate Wauststalen & Vicky Bomusk Design Group, Corp.", "Wauststalen, Katherine & Bomlusk, Victoria Design Group", "k. wauststalen + v. bomlusk"],
    ["North Birgeden Breindhelen Community College", "N. Birgeden Breindhe1en Comm. Coll.", "Birgeden Breindhelen Community College (North)", "nORTH bIRGEDEN bREINDHELEN cOMMUNITY cOLLEGE"],
    ["South Birgeden Breindhelen Community College", "Community College of S. Birgeden Breindhelen"],
    ["Zeiswond Feisgund Community College", "Z E I S W O N D F E I S G U N D   C O M M U N I T Y   C O L L E G E", "2eiswond Feisgund CC"],
    ["Tilkryden Premhurn Design Group", "Tilkryden + Premhurn", "By Tilkryden Premhurn Design Gp (AOR)"],
]
NOBODY = ["N/A", "TBD", "", "  ", "-", None, "Architects Inc."]


def records(spark):
    data = [(f"r{i}/{j}", n, "mine") for i, names in enumerate(SAME) for j, n in enumerate(names)] + [(f"n{i}", n, "x") for i, n in enumerate(NOBODY)]
    return spark.createDataFrame(data, "rec string, name string, raw string")


def test_variants_are_one_and_like_named_owners_two(spark):
    got = organisation_of(records(spark), "rec", "name").collect()
    by = {}
    for r in got:
        by.setdefault(r["organisation"], set()).add(r["key"].split("/")[0])
    assert sorted(map(sorted, by.values())) == [[f"r{i}"] for i in range(len(SAME))]
    assert len(got) == sum(map(len, SAME))


def test_frequent_words_that_are_alike_stay_apart(spark):
    data = [(f"a{i}", "Fosryck & Bomstorick Associates") for i in range(40)] + [(f"b{i}", "Fosryck & Bomsturick Associates") for i in range(40)] + [("c", "Fosryck & Bomstroick Associates")]
    got = {r["key"]: r["organisation"] for r in organisation_of(spark.createDataFrame(data, "k string, v string"), "k", "v").collect()}
    assert len({got[f"a{i}"] for i in range(40)} | {got[f"b{i}"] for i in range(40)}) == 2
    assert got["c"] in (got["a0"], got["b0"])


def test_empty_repeats_and_long(spark):
    df = records(spark)
    assert organisation_of(df.limit(0), "rec", "name").count() == 0
    again = organisation_of(df.unionByName(df), "rec", "name")
    assert again.count() == 2 * sum(map(len, SAME))
    long = spark.createDataFrame([("k", "Word " * 20_000)], "rec string, name string")
    assert organisation_of(long, "rec", "name").count() == 1


def test_roots_of_a_chain(spark):
    nodes = spark.createDataFrame([(str(i),) for i in range(40)], "id string")
    parents = spark.createDataFrame([(str(i), str(i + 1)) for i in range(37)], "id string, parent string")
    assert {r["id"]: r["root"] for r in roots_of(nodes, parents).collect()} == {str(i): "37" if i <= 37 else str(i) for i in range(40)}


def test_class_pairs_against_all_pairs(spark):
    assert SLICE > 0
    data = [(f"k{i:03}", f"v{i % 7}", f"c{i % 3}") for i in range(120)]
    got = {tuple(r) for r in class_pairs(spark.createDataFrame(data, "key string, raw string, cls string"), "cls").collect()}
    assert got == {(a, b) for a, u, x in data for b, v, y in data if a < b and u != v and x == y}


def test_a_large_class_is_sliced(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SLICE", 10)
    data = [(f"k{i:03}", f"v{i % 5}", "c") for i in range(95)]
    df = pairs.class_pairs(spark.createDataFrame(data, "key string, raw string, cls string"), "cls")
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) == sum(1 for a, u, _ in data for b, v, _ in data if a < b and u != v)


def test_common_blocks_in_slices_of_one_against_whole_blocks(spark, monkeypatch):
    rest = ["".join(p) for p in itertools.product(("bom", "kel"), ("lus", "fen"), ("ka", "dim"))] + ["bomluska", "bomusdim", "bolmuska", "klefenka", "kelfnka"]
    words = spark.createDataFrame([(w, 60 if len(w) == 8 and w.startswith(("bom", "kel")) else 1) for w in rest], "word string, f long")
    monkeypatch.setattr(pairs, "BLOCK", 1)
    got = {tuple(r) for r in organisations.word_spellings(words).collect()}
    monkeypatch.setattr(pairs, "BLOCK", 1_000_000)
    assert got and got == {tuple(r) for r in organisations.word_spellings(words).collect()}


def test_a_word_with_one_error_shares_a_key_wherever_it_is(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghiklmnoprstuvwz", k=n)) for n in (6, 7, 8, 9, 11, 13) for _ in range(6)]
    pairs = []
    for w in words:
        for i in range(len(w)):
            pairs += [(w, w[:i] + "q" + w[i + 1 :]), (w, w[:i] + w[i + 1 :]), (w, w[:i] + "q" + w[i:])]
            if i + 1 < len(w):
                pairs.append((w, w[:i] + w[i + 1] + w[i] + w[i + 2 :]))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("met", F.arrays_overlap(F.transform(organisations.suffix_keys(F.col("a")), lambda k: k["key"]), F.transform(organisations.suffix_keys(F.col("b")), lambda k: k["key"])))
    missed = [r for r in df.where("not met").collect()]
    assert all(len(r["a"]) <= 7 for r in missed) and len(missed) < 0.03 * len(pairs)


def test_spellings_against_brute_force(spark):
    rng = random.Random(5)
    right = ["".join(rng.choice(x) for x in (("bro", "sta", "kel"), ("ax", "um", "int"), ("kat", "vit", "ros"), ("er", "all", "ick"))) for _ in range(40)]
    words = {w: 80 for w in right}
    for w in list(words):
        i = rng.randrange(len(w) - 1)
        for x in (w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]):
            words.setdefault(x, 1)
    rows = [(r["word"], r["spelling"]) for r in organisations.word_spellings(spark.createDataFrame(list(words.items()), "word string, f long")).collect()]
    got = set(rows)
    assert len(rows) == len(got)
    expected = set()
    for w, f in words.items():
        alike = {v: 2 * lcs_of(w, v) / (len(w) + len(v)) for v, g in words.items() if v != w and f <= max(organisations.RARE_COUNT, organisations.RARE_SHARE * g) and (g, v) > (f, w)}
        alike = {v: r for v, r in alike.items() if r >= organisations.CANDIDATE}
        if any(r >= organisations.WORD_RATIO and words[v] == 80 for v, r in alike.items()):
            alike = {v: r for v, r in alike.items() if words[v] == 80}
        expected |= {(w, v) for v, r in alike.items() if r >= max(alike.values()) - organisations.ABOUT}
    assert len(got & expected) >= 0.98 * len(expected) and len(got - expected) <= 0.02 * len(got)


PEOPLE = ["John Miller Architects", "Jack Miller Architects Inc.", "J. Miller Architects", "Mary Miller Architects", "M. Miller, Architect"]


def test_given_names_tell_like_named_firms_apart(spark):
    got = {r["raw"]: r["organisation"] for r in organisation_of(spark.createDataFrame([(str(i), n) for i, n in enumerate(PEOPLE)], "k string, v string"), "k", "v").collect()}
    assert got[PEOPLE[0]] == got[PEOPLE[1]] == got[PEOPLE[2]] != got[PEOPLE[3]] == got[PEOPLE[4]]


def test_given_names_that_name_a_place_or_are_all_there_is(spark):
    names = ["San Jose Unified School District", "San Unified School District", "Charles & Thomas Architects", "Ben Jose Studio", "Richard Carlos Design", "Carlos, Richard Design Inc."]
    got = {r["raw"]: r["organisation"] for r in organisation_of(spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "k string, v string"), "k", "v").collect()}
    assert set(got) == set(names) and len(set(got.values())) == 5 and got[names[4]] == got[names[5]]


def test_errors_in_every_word_and_words_run_together(spark):
    data = [(f"a{i}", "Wondshyden & Jondshond Engineers") for i in range(3)] + [("b", "Wondshdyen-Jondshonnd Engineers"), ("c", "WondshydenJondshnd Engrs"), ("d", "WONDSHYDENJONDSHOND")]
    got = {r["key"]: r["organisation"] for r in organisation_of(spark.createDataFrame(data, "k string, v string"), "k", "v").collect()}
    assert len(set(got.values())) == 1 and len(got) == 6


def test_a_rare_word_is_a_spelling_of_the_nearest_word_not_of_the_nearest_name(spark):
    data = [(f"a{i}", "Dinduter & Thustbirick") for i in range(10)] + [(f"b{i}", f"Thustfarick & {x}") for i, x in enumerate(["Kaundriston"] * 60)] + [("c", "Dinduter Thusstfarick"), ("d", "Dinduter Thustfarick")]
    got = {r["key"]: r["organisation"] for r in organisation_of(spark.createDataFrame(data, "k string, v string"), "k", "v").collect()}
    assert got["c"] == got["d"] != got["a0"]


def test_an_edit_in_the_middle_of_the_rest_is_met_in_a_common_block(spark):
    syllables = ("bal", "cor", "dim", "fen", "gyr", "hox", "jup")
    data = [(f"m{i}", f"Wauststalen & {x}{y}") for i, (x, y) in enumerate(itertools.product(syllables, syllables))]
    data += [("a0", "Wauststalen & Bomlusk"), ("a1", "Wauststalen & Bomlusk"), ("b", "Wauststalen & Bomusk")]
    got = {r["key"]: r["organisation"] for r in organisation_of(spark.createDataFrame(data, "k string, v string"), "k", "v").collect()}
    assert got["a0"] == got["a1"] == got["b"] != got["m0"]
