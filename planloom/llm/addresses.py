"""Postal addresses that denote the same building, by probabilistic linkage.

An address is taken apart into number, direction, street, type, town and postcode.
Candidates share the number and the postcode, the street's sound or the town.
Agreement levels, with a level of their own for a part one side leaves out, are
counted over all candidate pairs; expectation-maximisation turns the counts into
weights. Each form of an address is attached to its best more complete form among
those whose weight reaches the threshold and that contradict none of its parts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.similarity import lcs_similarity
from planloom.llm.canonical import despaced
from planloom.llm.forest import roots_of
from planloom.llm.organisations import smooth
from planloom.llm.pairs import block_pairs, in_slices
from planloom.operators.skew import heavy_key_join
from planloom.session import materialise, spread

TYPES = {
    "st": "street str st strt", "ave": "avenue ave av aven", "blvd": "boulevard blvd boul", "dr": "drive dr drv", "ln": "lane ln", "rd": "road rd", "ct": "court ct crt", "cir": "circle cir circ",
    "pkwy": "parkway pkwy pky parkwy", "way": "way wy", "pl": "place pl", "ter": "terrace ter terr", "hwy": "highway hwy", "sq": "square sq", "trl": "trail trl", "aly": "alley aly", "loop": "loop",
}
DIRECTIONS = {"n": "north no n nth", "s": "south so s sth", "e": "east e", "w": "west w", "ne": "northeast ne", "nw": "northwest nw", "se": "southeast se", "sw": "southwest sw"}
STATE_NAMES = (
    "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana maine maryland massachusetts michigan minnesota "
    "mississippi missouri montana nebraska nevada ohio oklahoma oregon pennsylvania tennessee texas utah vermont virginia washington wisconsin wyoming"
).split() + ["new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "rhode island", "south carolina", "south dakota", "west virginia"]
# The codes of Connecticut and Wyoming are left out: they are short forms of Court and Way too.
STATE_CODES = "al ak az ar ca co de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi".split()

#: Least ratio at which two different street or town words are alike, and at which two streets are near: so garbled that the other parts must speak for them.
ALIKE, NEAR = 0.8, 0.65
#: Levels of agreement of each compared part; "both" and "one" say which side leaves it out.
LEVELS = {"street": ("equal", "alike", "near", "other"), "direction": ("equal", "both", "one", "other"), "type": ("equal", "both", "one", "other"), "place": ("equal", "alike", "both", "one", "other")}
#: Least probability of a match by the weights.
EM_ROUNDS, PROBABILITY = 40, 0.999
PARTS = ["number", "direction", "street", "type", "town", "postcode"]


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for short, words in table.items() for w in words.split() for x in (w, short)])


def _type_of(word: Column) -> Column:
    """Short form of a street type, also of a long one with a typing error; else null."""
    found = F.try_element_at(_lookup(TYPES), word)
    for short, words in TYPES.items():
        full = words.split()[0]
        if len(full) >= 5:
            edits = 2 if len(full) >= 6 else 1
            # With a limit the distance of words that are too different, most of them, isn't worked out; it is -1.
            found = F.coalesce(found, F.when((F.length(word) >= 5) & (F.levenshtein(word, F.lit(full), edits) >= 0), F.lit(short)))
    return found


def address_text(raw: Column) -> Column:
    """A typed address in lower case without number signs, suites, units and states."""
    t = F.lower(despaced(F.replace(raw, F.lit("\u00a0"), F.lit(" "))))
    t = F.regexp_replace(t, r"^\W*(?:#|no\.?|nr\.?)\s*(?=[0-9]+\s+[0-9]?[a-z])|(?<=[\s,;])(?:#|no\.)\s*(?=[0-9]+\s+[0-9]?[a-z])", "")
    t = F.regexp_replace(t, r"(?:(?<=^|[\s,;\-])(?:suite|ste|unit|apartment|apt|room|rm|floor)\b\.?\s*#?\s*(?:[a-z]?-?[0-9]+[a-z]?|[a-z])\b|#\s*[a-z]?[0-9]+[a-z]?\b)\s*,?", " ")
    t = F.regexp_replace(t, rf"(?<=[\s,])(?:{'|'.join(STATE_NAMES)})\b\.?(?=\s*(?:$|[,;\n]|-\s|[0-9]{{5}}))", " ")
    t = F.regexp_replace(t, rf"(?<=[\s,])(?:{'|'.join(STATE_CODES)})\b\.?(?=\s*(?:$|[,;\n]|-\s|[0-9]{{5}}))", " , ")
    return t


def taken_apart(distinct: DataFrame) -> DataFrame:
    """(raw, n) -> (raw, n, PARTS); an address without number and street has neither."""
    # In steps with names, so that what several parts are read from is worked out once.
    d = distinct.withColumn("_t", address_text(F.col("raw")))
    d = d.withColumn("postcode", F.nullif(F.regexp_extract("_t", r"(?<!^)(?<![0-9])([0-9]{5})(?:-[0-9]{4})?(?![0-9])(?!.*[0-9]{5})", 1), F.lit("")))
    bare = F.regexp_replace("_t", r"(?<!^)(?<![0-9])[0-9]{5}(?:-[0-9]{4})?(?![0-9])", " , ")
    parts = F.filter(F.transform(F.split(bare, r"[,;\n\r\t|]|\s-(?:\s|$)"), lambda p: F.trim(F.regexp_replace(F.replace(p, F.lit("."), F.lit(" ")), r"[^a-z0-9]+", " "))), lambda p: p != "")
    d = d.withColumn("_parts", parts)
    head = F.try_element_at(F.filter("_parts", lambda p: p.rlike(r"^[0-9]+[a-z]? [0-9]?[a-z]")), F.lit(1))
    place = F.try_element_at(F.filter("_parts", lambda p: ~p.rlike(r"[0-9]")), F.lit(1))
    d = d.withColumn("head", head).withColumn("place", place)
    d = d.withColumn("_w", F.split("head", " "))
    words = F.transform(F.slice("_w", 2, F.size("_w")), lambda w: F.when(w.rlike("[a-z]{2}"), smooth(F.translate(w, "0125689", "olzsbgg"))).otherwise(w))
    directed = F.try_element_at(_lookup(DIRECTIONS), F.get("_w", F.lit(1)))
    d = d.withColumn("number", F.get("_w", F.lit(0))).withColumn("_pre", F.when(F.size("_w") > 2, directed)).withColumn("_w", words)
    d = d.withColumn("_w", F.when(F.col("_pre").isNotNull(), F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1)))).otherwise(F.col("_w")))
    # The type is the first such word after the street's first word.
    d = d.withColumn("_t", F.transform("_w", lambda w, i: F.when(i > 0, _type_of(w))))
    d = d.withColumn("_at", F.array_min(F.filter(F.transform("_t", lambda t, i: F.when(t.isNotNull(), i)), lambda i: i.isNotNull())))
    d = d.withColumn("type", F.get("_t", F.col("_at"))).withColumn("_end", F.coalesce(F.col("_at"), F.lit(0)) + 1)
    post = F.try_element_at(_lookup(DIRECTIONS), F.get("_w", F.col("_end")))
    d = d.withColumn("street", F.array_join(F.slice("_w", 1, F.coalesce(F.col("_at"), F.lit(1))), " ")).withColumn("_post", post)
    rest = F.slice("_w", F.col("_end") + 1 + F.when(F.col("_post").isNotNull(), 1).otherwise(0), F.size("_w") + 1)
    d = d.withColumn("direction", F.coalesce("_pre", "_post")).withColumn("town", F.coalesce(F.nullif(F.array_join(rest, " "), F.lit("")), F.array_join(F.transform(F.split("place", " "), lambda w: smooth(w)), " ")))
    return d.select("raw", "n", *PARTS)


def with_known_places(forms: DataFrame) -> DataFrame:
    """Town and postcode completed from each other where the data pair them: a postcode's town is the one most written with it."""
    pairs = materialise(forms.where(F.col("town").isNotNull() & F.col("postcode").isNotNull()).groupBy("postcode", "town").agg(F.sum("n").alias("_n")), "places")
    town_of = pairs.groupBy("postcode").agg(F.max(F.struct("_n", "town"))["town"].alias("_town"))
    code_of = pairs.groupBy("town").agg(F.max(F.struct("_n", "postcode"))["postcode"].alias("_code"))
    # A town that is alike the postcode's is that town, mistyped; one that is not alike stands as written.
    d = forms.join(town_of, "postcode", "left")
    alike = F.col("town").isNull() | (F.levenshtein("town", "_town") <= F.greatest(F.lit(2), F.floor(F.length("_town") * 0.25)))
    d = d.withColumn("town", F.when(F.col("_town").isNotNull() & alike, F.col("_town")).otherwise(F.col("town"))).drop("_town")
    return d.join(code_of, "town", "left").withColumn("postcode", F.coalesce("postcode", "_code")).drop("_code")


def agreement(a, b) -> dict[str, Column]:
    """Level (index into LEVELS) of each compared part; ``a`` and ``b`` give a part's column by name."""
    no = lambda x: F.coalesce(x, F.lit(False))

    def simple(part: str) -> Column:
        return F.when(a(part).isNull() & b(part).isNull(), 1).when(a(part).isNull() | b(part).isNull(), 2).when(a(part) == b(part), 0).otherwise(3)

    streets, towns = lcs_similarity(a("street"), b("street")), lcs_similarity(a("town"), b("town"))
    street = F.when(a("street") == b("street"), 0).when(streets >= ALIKE, 1).when(streets >= NEAR, 2).otherwise(3)
    town_out, code_out = a("town").isNull() | b("town").isNull(), a("postcode").isNull() | b("postcode").isNull()
    codes = a("postcode") == b("postcode")
    place = (
        F.when(no(a("town") == b("town")), 0)
        .when(~town_out & no(towns >= ALIKE) & (code_out | no(codes)), 1)
        .when(town_out & no(codes), 0)
        .when(town_out & code_out, F.when(F.coalesce(a("town"), a("postcode"), b("town"), b("postcode")).isNull(), 2).otherwise(3))
        .otherwise(4)
    )
    return {"street": street, "direction": simple("direction"), "type": simple("type"), "place": place}


def estimate_weights(patterns: list[tuple[tuple[int, ...], int]], chance: list[tuple[tuple[int, ...], int]]) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """Match probability of each agreement pattern by expectation-maximisation, and the (m, u) table of each part.

    patterns: (level of each part in LEVELS' order, pairs) of the candidates; chance: the
    same of pairs taken at random, which fixes u, how often levels agree among different
    places. m and the share of matches are estimated. Both lists are at most as long as
    there are combinations of levels, whatever the number of records. No patterns give no weights.
    """
    names = list(LEVELS)
    m = [[0.9 if i == 0 else 0.1 / (len(LEVELS[p]) - 1) for i in range(len(LEVELS[p]))] for p in names]
    # One imaginary pair a level keeps a level that wasn't seen from ruling a pattern out for good.
    at_random = sum(n for _, n in chance)
    u = [[(sum(n for p, n in chance if p[k] == x) + 1) / (at_random + len(LEVELS[part])) for x in range(len(LEVELS[part]))] for k, part in enumerate(names)]
    share, total = 0.5, sum(n for _, n in patterns)
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(EM_ROUNDS if total else 0):
        for levels, _n in patterns:
            pm = share * math.prod(m[k][x] for k, x in enumerate(levels))
            pu = (1 - share) * math.prod(u[k][x] for k, x in enumerate(levels))
            posterior[levels] = pm / (pm + pu)
        matched = sum(posterior[p] * n for p, n in patterns)
        share = min(max(matched / total, 1e-6), 1 - 1e-6)
        for k, part in enumerate(names):
            for x in range(len(LEVELS[part])):
                m[k][x] = (sum(posterior[p] * n for p, n in patterns if p[k] == x) + 1) / (matched + len(LEVELS[part]))
    return posterior, [dict(zip(LEVELS[p], zip(m[k], u[k]))) for k, p in enumerate(names)]


def compared(pairs: DataFrame) -> DataFrame:
    """Pairs with columns ``a_`` and ``b_`` (id, n, full, PARTS) as (id, other, ra, rb) with their agreement levels; ra and rb rank the sides by completeness."""
    rank = lambda s: F.struct(F.col(f"{s}_full").alias("full"), F.col(f"{s}_n").alias("n"), F.col(f"{s}_id").alias("id"))
    return pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"), rank("a").alias("ra"), rank("b").alias("rb"), *[level.alias(part) for part, level in agreement(lambda p: F.col(f"a_{p}"), lambda p: F.col(f"b_{p}")).items()])


#: Columns a candidate carries through its blocks.
CARRIED = ["id", "n", "full", *PARTS]


def candidates(forms: DataFrame) -> DataFrame:
    """Pairs of forms that share the number and the postcode, the street's sound or the town, each pair once.

    A pair that shares several keys is met in the first of them only, so nothing has to
    be made distinct; common blocks are cut into slices.
    """
    keys = [F.concat_ws("|", F.lit("p"), "postcode", "number"), F.concat_ws("|", F.lit("s"), F.soundex("street"), "number"), F.concat_ws("|", F.lit("t"), "town", "number")]
    held = F.filter(F.array(F.when(F.col("postcode").isNotNull(), keys[0]), F.when(F.col("street").isNotNull(), keys[1]), F.when(F.col("town").isNotNull(), keys[2])), lambda k: k.isNotNull())
    blocks = in_slices(forms.withColumn("key", F.explode(held)).withColumn("kind", F.left("key", F.lit(1))), "key", "id")
    pairs = block_pairs(blocks, "key", [*CARRIED, "kind"])
    post = F.coalesce(F.col("a_postcode") == F.col("b_postcode"), F.lit(False))
    sound = F.coalesce(F.soundex("a_street") == F.soundex("b_street"), F.lit(False))
    return pairs.where(F.when(F.col("a_kind") == "s", ~post).when(F.col("a_kind") == "t", ~post & ~sound).otherwise(F.lit(True)))


def _counts(pairs: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    return [(tuple(r[p] for p in LEVELS), r["count"]) for r in pairs.groupBy(*LEVELS).count().collect()]


def building_of(records: DataFrame, key: str, address: str) -> DataFrame:
    """(key, raw, building): the id of the building each typed address denotes.

    Null, blank and stand-in addresses, and those without number and street, denote
    nothing and are left out. Suites don't matter. A part left out contradicts nothing:
    such an address goes with the building it fits best. Repeated rows are kept; very
    long texts are taken apart like others, once each.
    """
    spark = records.sparkSession
    rows = records.where(F.col(address).rlike("[0-9]")).select(F.col(key).alias("key"), F.col(address).alias("raw"))
    counted = spread(rows.groupBy("raw").agg(F.count(F.lit(1)).alias("n")), "raw")
    # What has no street is left out when the parts are read back: a condition on them before would have them worked out twice.
    typed = materialise(with_known_places(materialise(taken_apart(counted), "address-parts").where(F.col("number").isNotNull())).withColumn("id", F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in PARTS])), "address-forms")
    forms = typed.groupBy("id").agg(F.sum("n").alias("n"), *[F.first(p).alias(p) for p in PARTS])
    forms = materialise(forms.withColumn("full", F.size(F.filter(F.array(*PARTS), lambda p: p.isNotNull()))), "address-form-ids")
    pairs = materialise(compared(candidates(forms)), "address-pairs")
    # Pairs at random: each form with the one its hash points to, about one a form.
    count = max(forms.count(), 1)
    spot = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).alias("spot")
    one, other = (forms.select(spot(seed), *[F.col(c).alias(f"{side}_{c}") for c in CARRIED]) for side, seed in (("a", 1), ("b", 2)))
    chance = compared(one.join(other, "spot").where(F.col("a_id") != F.col("b_id")))
    posterior, _tables = estimate_weights(_counts(pairs), _counts(chance))
    # One row for each pattern of levels, of which there are 320.
    weights = spark.createDataFrame([(*p, float(w)) for p, w in posterior.items()], ", ".join(f"{p} int" for p in LEVELS) + ", weight double")
    # The exact check after the weights: parts that both sides write must not contradict each other.
    last = {part: len(levels) - 1 for part, levels in LEVELS.items()}
    agreed = pairs.join(F.broadcast(weights), list(LEVELS)).where(F.col("weight") >= PROBABILITY)
    for part, other_level in last.items():
        agreed = agreed.where(F.col(part) < other_level)
    up = F.col("rb") > F.col("ra")
    out = lambda part: F.when(F.col(part) == LEVELS[part].index("one"), 1).otherwise(0)
    close, said = -(F.col("street") + F.least(F.col("place"), F.lit(LEVELS["place"].index("both")))), -(out("direction") + out("type"))
    links = agreed.select(F.when(up, F.col("id")).otherwise(F.col("other")).alias("id"), F.when(up, F.col("other")).otherwise(F.col("id")).alias("parent"), close.alias("close"), said.alias("said"), "weight", F.greatest("ra", "rb").alias("rank"))
    parents = materialise(links.groupBy("id").agg(F.max(F.struct("close", "said", "weight", F.col("rank.n").alias("n"), "parent"))["parent"].alias("parent")), "address-parents")
    building = roots_of(forms.select("id"), parents)
    entries = typed.select("raw", "id", "n").join(building, "id").select("raw", F.col("root").alias("building"), "n")
    return heavy_key_join(rows, entries, ["raw"], "n").select("key", "raw", "building")
