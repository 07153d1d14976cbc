"""Variant spellings of organisations: typed names to the organisation each one means.

A typed name is cut into words; words that say what kind of office or owner it is, its
legal form, a given name or a note are told apart (with typing errors) from the words
that name it. The naming words are blocked by their suffixes and compared by
longest-common-subsequence ratio; a rare word is a spelling of a frequent one it is alike
enough. A name's words are then resolved together: among the spellings about as alike,
the name that is written elsewhere wins. Given names, where both sides write them, must
be able to be the same persons'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.functions.similarity import differing_letters, lcs_similarity, letter_mask
from planloom.llm.canonical import despaced
from planloom.llm.forest import roots_of
from planloom.llm.pairs import block_matches, block_pairs, in_slices
from planloom.llm.pigeonhole import pigeonhole_candidates
from planloom.operators.skew import heavy_key_join
from planloom.session import materialise, spread

#: Shortest suffix that is indexed by itself; shorter ones are refined by the word's first letters.
SUFFIX = 5
#: Least ratio of two spellings of a word; of one that isn't clear by frequency; of a name as a whole; of two names one of which is run together or one word.
CANDIDATE, WORD_RATIO, NAME_RATIO, WHOLE_RATIO = 0.75, 0.8, 0.87, 0.9
#: Spellings that are less alike than the best by no more than this are left to the name to decide.
ABOUT = 0.06
#: A word is a spelling of another only if it is rarer: this share of the other at most, or this count. Only the share is proof by itself: under it the
#: right word needn't be written elsewhere in the same name, and may be less alike if the name as a whole is.
RARE_SHARE, RARE_COUNT = 0.08, 2
#: Longest name whose spellings are combined; in one of more words each word takes its best spelling.
COMBINED = 3

_OWNER = "school sch district dist elementary elem unified unif union un high hs sd usd esd uhsd community comm college coll cc housing hsg authority auth ha health hlth system sys healthcare property properties prop pg city county hospital university univ"
_TRADE = (
    "engineers engineer engineering engr engrs engrg eng engg engnrs ingenieros architects architect architecture arch archs archit archts architectural arquitectos design designs designers dsgn group grp gp "
    "associates assocs assoc associate partnership ptnrshp pship partners studio studios stu consulting conslt cons consultants consultant consult collaborative services company co"
)
_FORM = "inc llc ltd pc corp llp lp pllc corporation incorporated limited professional plc sa gmbh a"
_NOTE = "of the and by see owner aor attn bid desk dept department facilities facility record client provider c o m s g vendor for at on sheet"
_STAND_IN = "tbd tbc tba na none unknown pending null nil various same as above unassigned not applicable available"
_DIRECTION = {"north": "N", "south": "S", "east": "E", "west": "W", "upper": "U", "lower": "L", "no": "N", "so": "S"}
#: Given names that may be one person's, a group each.
_GIVEN = (
    "francisco paco", "josephine jo josie", "rosalind roz", "jennifer jen jenny", "susannah sue susan susie", "nathaniel nate nathan", "benjamin ben", "michael mike", "katherine kate kathy kathryn catherine",
    "anthony tony", "theodore ted theo", "alexander alex sasha", "frederick fred fritz", "gregory greg", "deborah debbie deb", "guadalupe lupe", "patricia pat patty trish", "robert bob rob bobby",
    "margaret peggy maggie meg", "victoria vicky", "william bill will billy", "elizabeth liz beth betty", "stephen steve steven", "edward ed eddie ned ted", "richard rick dick", "james jim jimmy", "john jack jon",
    "joseph joe jo", "thomas tom", "charles charlie chuck", "christopher chris", "daniel dan", "matthew matt", "samuel sam", "david dave", "andrew andy", "lawrence larry", "donald don", "kenneth ken",
    "ronald ron", "barbara barb", "dorothy dot", "helen", "nancy", "mary maria", "jose", "jesus", "luis", "carlos", "juan",
)


def vocabulary(spark: SparkSession) -> DataFrame:
    """(word, kind) of the words that don't name an organisation; fixed lists, not data."""
    kinds = {"form": _FORM, "trade": _TRADE, "owner": _OWNER, "note": _NOTE, "none": _STAND_IN, "given": " ".join(_GIVEN), "direction": " ".join(_DIRECTION)}
    first: dict[str, str] = {}
    for kind, words in kinds.items():
        for w in words.split():
            first.setdefault(w, kind)
    return spark.createDataFrame(list(first.items()), "word string, kind string")


def name_words(raw: Column) -> Column:
    """Array of the lower-case words of a typed name; run-together capitals are parted, noise digits made letters."""
    t = F.replace(raw, F.lit("\u00a0"), F.lit(" "))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = F.when(t.rlike(r"\b[a-z][A-Z]{3,}"), F.translate(t, lower + upper, upper + lower)).otherwise(t)
    t = despaced(t)
    t = F.regexp_replace(t, r"([a-z])([A-Z])", "$1 $2")
    t = F.translate(F.lower(t), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    t = F.regexp_replace(t, r"\b(?:c\s?/\s?o|m\s?/\s?s|n\s?/\s?a|a\s?/\s?e)\b", " ")
    t = F.regexp_replace(t, r"(?<=\b[a-z])\.(?=[a-z]\b)|['’]", "")
    t = F.regexp_replace(t, r"[^a-z0-9]+", " ")
    words = F.filter(F.split(t, " "), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    return F.transform(words, lambda w: F.when(w.rlike("[a-z]"), F.translate(w, "015869", "olsbgg")).otherwise(w))


def smooth(word: Column) -> Column:
    """Letter groups that scanning mixes up, written one way."""
    for pair, one in (("ii", "u"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h")):
        word = F.replace(word, F.lit(pair), F.lit(one))
    return word


def typed_organisations(counted: DataFrame) -> DataFrame:
    """(raw, n) -> (raw, n, direction, names): names is the array of naming words; names that name nobody are left out."""
    spark = counted.sparkSession
    words = materialise(counted.select("raw", F.posexplode(name_words(F.col("raw"))).alias("pos", "word")), "name-words")
    distinct = words.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    vocab = vocabulary(spark)
    near = pigeonhole_candidates(distinct.select("word"), vocab.withColumnRenamed("word", "known"), "word", "known", ((5, 1), (8, 2)))
    # A distinguishing direction must be spelled right, or almost; given names and all others may carry an error.
    kinds = materialise(near.groupBy("word").agg(F.min(F.struct("distance", "known", "kind")).alias("_b")).select("word", F.col("_b.kind").alias("kind"), F.col("_b.known").alias("known")).join(distinct, "word"), "word-kinds")
    told = heavy_key_join(words, kinds, ["word"], "_n").select("raw", "pos", "word", "kind", "known")
    rest = words.join(kinds.select("word"), "word", "left_anti").select("raw", "pos", "word", F.lit("name").alias("kind"), F.lit(None).cast("string").alias("known"))
    entry = F.sort_array(F.collect_list(F.struct("pos", "word", "kind", "known")))
    whole = told.unionByName(rest).groupBy("raw").agg(entry.alias("_w"))
    owner = F.exists("_w", lambda w: w["kind"] == "owner")
    letter = F.create_map(*[x for k, v in _DIRECTION.items() for x in (F.lit(k), F.lit(v))])
    # One letter before an owner's name is a direction, before a person's an initial.
    directions = F.transform(F.filter("_w", lambda w: (w["kind"] == "direction") | (owner & w["word"].isin("n", "s", "e", "w") & (w["pos"] < 5))), lambda w: F.coalesce(F.try_element_at(letter, F.coalesce(w["known"], w["word"])), F.upper(w["word"])))
    given = lambda w: (w["kind"] == "given") & (F.length(w["word"]) > 1)
    # In an owner's name a given name names a place.
    names = F.transform(F.filter("_w", lambda w: ((w["kind"] == "name") & (F.length(w["word"]) > 1)) | (owner & given(w))), lambda w: smooth(w["word"]))
    persons = F.when(owner, F.array().cast("array<string>")).otherwise(F.transform(F.filter("_w", given), lambda w: w["known"]))
    initials = F.transform(F.filter("_w", lambda w, i: F.lit(True) & (F.length(w["word"]) == 1) & w["word"].rlike("[a-z]") & (F.get("_w", i + 1)["kind"] == "name") & (F.length(F.get("_w", i + 1)["word"]) > 1)), lambda w: w["word"])
    parsed = whole.select("raw", F.coalesce(F.try_element_at(directions, F.lit(1)), F.lit("")).alias("direction"), names.alias("names"), persons.alias("persons"), F.when(owner, F.array().cast("array<string>")).otherwise(initials).alias("initials"))
    # A name made of given names only is named by them.
    bare = F.size("names") == 0
    parsed = parsed.withColumn("names", F.when(bare, F.col("persons")).otherwise(F.col("names"))).withColumn("givens", F.when(bare, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat("persons", "initials")))))
    return parsed.select("raw", "direction", "names", "givens").where(F.size("names") > 0).join(counted, "raw")


def suffix_keys(word: Column) -> Column:
    """Array of a word's block keys with their kinds: its suffix, and shorter suffixes refined by as many first letters.

    A word with one error shares a key with the right one wherever the error is, from
    six letters on.
    """
    return F.array(*[F.struct(F.lit(n).alias("kind"), F.concat(F.lit(str(n)), key).alias("key")) for n, key in enumerate(_key_parts(word))])


def _key_parts(word: Column) -> list[Column]:
    return [F.right(word, F.lit(SUFFIX)), *[F.concat(F.left(word, F.lit(n)), F.lit("~"), F.right(word, F.lit(SUFFIX - n))) for n in range(1, SUFFIX)], F.left(word, F.lit(SUFFIX))]


def _met_first(kind: Column, a: Column, b: Column) -> Column:
    """Whether a pair shares no key of an earlier kind: it is compared in the first block that both are in, so pairs needn't be made distinct."""
    same = [x == y for x, y in zip(_key_parts(a), _key_parts(b))]
    met = F.lit(True)
    for n in range(1, len(same)):
        met = F.when(kind == n, ~F.greatest(*same[:n]) if n > 1 else ~same[0]).otherwise(met)
    return met


def _unmatched(least: float, total: Column) -> Column:
    """Letters that a ratio of ``least`` may leave unmatched in words of this total length; never one too few by floating point."""
    return F.floor((1 - least) * total + 1e-9)


def _spelt(both: DataFrame) -> DataFrame:
    """(word, spelling, ratio, clear) of pairs of block rows that are alike enough, the rarer word first; each pair once."""
    total = F.col("a_n") + F.col("b_n")
    share = F.least("a_f", "b_f") <= RARE_SHARE * F.greatest("a_f", "b_f")
    rare = share | (F.least("a_f", "b_f") <= RARE_COUNT)
    # Bounds that no pair of this ratio exceeds, cheapest first: lengths, letters.
    near = (F.abs(F.col("a_n") - F.col("b_n")) <= _unmatched(CANDIDATE, total)) & (differing_letters(F.col("a_m"), F.col("b_m")) <= _unmatched(CANDIDATE, total))
    up = F.struct("b_f", "b_word") > F.struct("a_f", "a_word")
    pairs = both.where(rare & near & _met_first(F.col("a_kind"), F.col("a_word"), F.col("b_word")))
    told = pairs.select(F.when(up, F.col("a_word")).otherwise(F.col("b_word")).alias("word"), F.when(up, F.col("b_word")).otherwise(F.col("a_word")).alias("spelling"), share.alias("clear"))
    return told.withColumn("ratio", lcs_similarity(F.col("word"), F.col("spelling"))).where(F.col("ratio") >= CANDIDATE)


def word_spellings(words: DataFrame) -> DataFrame:
    """(word, spelling, ratio, clear): the more frequent words that each word of (word, f) may be a spelling of, those about as alike as the best; clear ones are more frequent by RARE_SHARE."""
    told = words.select("word", "f", F.length("word").alias("n"), letter_mask(F.col("word")).alias("m"), F.explode(suffix_keys(F.col("word"))).alias("_k")).select("word", "f", "n", "m", "_k.*")
    columns = ["word", "f", "n", "m", "kind"]
    common = F.col("f") > RARE_COUNT
    by_frequent = materialise(_spelt(block_matches(in_slices(told, "key", "word"), "key", columns, common)), "word-spellings")
    # What a far more frequent word explains needs no comparison with words as rare as itself.
    explained = by_frequent.where(F.col("clear") & (F.col("ratio") >= WORD_RATIO)).select("word").distinct()
    rest = in_slices(told.where(~common).join(explained, "word", "left_anti"), "key", "word")
    alike = by_frequent.unionByName(materialise(_spelt(block_pairs(rest, "key", columns)), "rare-word-spellings"))
    best = alike.groupBy("word").agg(F.max("ratio").alias("_best"))
    return alike.join(best, "word").where(F.col("ratio") >= F.col("_best") - ABOUT).select("word", "spelling", "ratio", "clear")


def resolved_names(cores: DataFrame) -> DataFrame:
    """(id, core): the name each core (id, direction, names, n) is a spelling of, itself included; ``core`` has the form of an id."""
    words = materialise(cores.select("n", F.explode(F.array_distinct("names")).alias("word")).groupBy("word").agg(F.sum("n").alias("f")), "organisation-words")
    spellings = materialise(word_spellings(words), "organisation-spellings")
    each = cores.select("id", F.posexplode("names").alias("pos", "word")).join(spellings.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("spelling", "ratio", "clear"))).alias("_s")), "word", "left")
    itself_type = "array<struct<spelling:string,ratio:double,clear:boolean>>"
    itself = F.array(F.struct(F.col("word").alias("spelling"), F.lit(1.0).alias("ratio"), F.lit(True).alias("clear")))
    # A word is its own spelling too, unless another is so by frequency alone.
    spelt = F.when(F.exists("_s", lambda x: x["clear"]), F.col("_s")).otherwise(F.concat(F.coalesce("_s", F.array().cast(itself_type)), itself))
    slots = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", spelt.alias("s"), "word"))).alias("_slots"), F.max(F.col("_s").isNotNull()).alias("_open"))
    open_ = cores.join(slots.where("_open"), "id")
    best_of = lambda s: F.array_max(F.transform(s, lambda x: F.struct(x["ratio"].alias("ratio"), x["spelling"].alias("spelling"), x["clear"].alias("clear"))))
    choices = F.transform("_slots", lambda x: F.when(F.size("_slots") <= COMBINED, x["s"]).otherwise(F.transform(F.array(best_of(x["s"])), lambda y: F.struct(y["spelling"].alias("spelling"), y["ratio"].alias("ratio"), y["clear"].alias("clear")))))
    empty = F.array(F.struct(F.array().cast("array<string>").alias("names"), F.lit(0.0).cast("double").alias("same"), F.lit(1.0).cast("double").alias("least"), F.lit(True).alias("clear")))
    size = lambda x, c: F.length(x["word"]) + F.length(c["spelling"])
    joined = F.aggregate(
        F.arrays_zip(F.col("_slots").alias("slot"), choices.alias("choice")),
        empty,
        lambda done, x: F.flatten(F.transform(done, lambda d: F.transform(x["choice"], lambda c: F.struct(F.concat(d["names"], F.array(c["spelling"])).alias("names"), (d["same"] + (1 - c["ratio"]) * size(x["slot"], c)).cast("double").alias("same"), F.least(d["least"], c["ratio"]).cast("double").alias("least"), (d["clear"] & c["clear"]).alias("clear"))))),
    )
    combos = open_.select("id", "direction", F.size("names").alias("k"), F.length(F.array_join("names", "")).alias("_len"), F.explode(joined).alias("_c")).select(
        "id", "k", F.concat_ws("|", "direction", F.array_join(F.sort_array("_c.names"), " ")).alias("core"), (1 - F.col("_c.same") / (F.col("_len") + F.length(F.array_join("_c.names", "")))).alias("ratio"), F.col("_c.least").alias("least"), F.col("_c.clear").alias("clear")
    )
    fits = F.when(F.col("k") == 1, F.col("ratio") >= WHOLE_RATIO).otherwise((F.col("ratio") >= NAME_RATIO) & (F.col("clear") | (F.col("least") >= WORD_RATIO)))
    fitting = materialise(combos.where(fits & (F.col("core") != F.col("id"))).join(cores.select(F.col("id").alias("core"), F.col("n").alias("support")), "core", "left").where(F.col("support").isNotNull() | (F.col("clear") & (F.col("least") >= WORD_RATIO))), "organisation-choices")
    # A name written elsewhere goes before one that only its words speak for, unless it is much less alike.
    top = fitting.groupBy("id").agg(F.max("ratio").alias("_top"), F.max(F.when(F.col("support").isNotNull(), F.col("ratio"))).alias("_held"))
    held = F.coalesce(F.col("_held") >= F.col("_top") - 2 * ABOUT, F.lit(False))
    near = F.when(held, F.col("support").isNotNull() & (F.col("ratio") >= F.col("_held") - ABOUT / 2)).otherwise(F.col("ratio") >= F.col("_top") - ABOUT / 2)
    chosen = fitting.join(top, "id").where(near).groupBy("id").agg(F.max(F.struct(F.coalesce("support", F.lit(0)).alias("support"), "ratio", "core"))["core"].alias("parent"))
    # Each step takes a more frequent spelling of a word, so chains end.
    return roots_of(cores.select("id"), chosen).select("id", F.col("root").alias("core"))


def run_together(cores: DataFrame, resolved: DataFrame) -> DataFrame:
    """(id, core): names of one word that are the words of another written together, blocked by the suffix and the first letters of the whole."""
    named = cores.join(resolved, "id").groupBy("core").agg(F.sum("n").alias("n")).withColumn("_p", F.split("core", r"\|")).withColumn("direction", F.get("_p", F.lit(0))).withColumn("names", F.split(F.get("_p", F.lit(1)), " "))
    one = F.size("names") == 1
    end = 2 * SUFFIX - 2

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.where(F.length("whole") >= end).withColumn("mask", letter_mask(F.col("whole"))).withColumn("key", F.explode(F.array(F.concat_ws("|", "direction", F.right("whole", F.lit(end))), F.concat_ws("|", F.lit("<"), "direction", F.left("whole", F.lit(end))))))

    single = keyed(named.where(one).select("core", "direction", F.get("names", F.lit(0)).alias("whole"))).select("key", F.col("core").alias("id"), F.col("whole").alias("a"), F.col("mask").alias("ma"))
    orders = F.array(F.array_join("names", ""), F.array_join(F.reverse("names"), ""))
    several = keyed(named.where(~one).select("core", "n", "direction", F.explode(F.array_distinct(orders)).alias("whole"))).select("key", "core", "n", F.col("whole").alias("b"), F.col("mask").alias("mb"))
    total = F.length("a") + F.length("b")
    near = (F.abs(F.length("a") - F.length("b")) <= _unmatched(WHOLE_RATIO, total)) & (differing_letters(F.col("ma"), F.col("mb")) <= _unmatched(WHOLE_RATIO, total))
    pairs = single.join(several, "key").where(near).select("id", "core", "n", "a", "b").distinct().withColumn("ratio", lcs_similarity(F.col("a"), F.col("b"))).where(F.col("ratio") >= WHOLE_RATIO)
    return pairs.groupBy("id").agg(F.max(F.struct("ratio", "n", "core"))["core"].alias("core"))


def given_labels() -> dict[str, list[str]]:
    """Given name -> labels of the groups it is in and of the first letters these may be shortened to."""
    labels: dict[str, set[str]] = {}
    for i, group in enumerate(_GIVEN):
        words = group.split()
        for w in words:
            labels.setdefault(w, set()).update({f"g{i}", *(f"i{x[0]}" for x in words)})
    return {w: sorted(x) for w, x in labels.items()}


def same_persons(written: DataFrame) -> DataFrame:
    """(core, givens, persons) of (core, givens, n): given names of one core that can't be the same persons' are told apart.

    Each set of given names goes with the most complete, then most frequent, set that
    holds one fitting each of its own; nicknames and initials fit. One that is left out
    contradicts nothing, so a name without any goes with the most frequent set.
    """
    table = F.create_map(*[x for w, ls in given_labels().items() for x in (F.lit(w), F.array(*map(F.lit, ls)))])
    sets = materialise(written.groupBy("core", "givens").agg(F.sum("n").alias("n")).withColumn("id", F.concat_ws("|", "core", F.array_join("givens", "+"))), "given-sets")
    several = sets.join(sets.groupBy("core").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("core"), "core")
    told = several.withColumn("labels", F.transform("givens", lambda g: F.coalesce(F.try_element_at(table, g), F.array(F.concat(F.lit("i"), F.left(g, F.lit(1)))))))
    rank = F.struct(F.size("givens").alias("size"), F.aggregate("givens", F.lit(0), lambda s, g: s + F.when(F.length(g) > 1, 1).otherwise(0)).alias("full"), "n", "id")
    keyed = told.select("core", "id", "labels", rank.alias("rank"), F.explode(F.array_distinct(F.filter(F.flatten("labels"), lambda x: x.startswith("i")))).alias("key"))
    groups = lambda x: F.filter(x, lambda y: y.startswith("g"))
    fit = lambda x, y: F.when((F.size(groups(x)) > 0) & (F.size(groups(y)) > 0), F.arrays_overlap(groups(x), groups(y))).otherwise(F.arrays_overlap(x, y))
    a, b = (keyed.select("core", "key", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "labels", "rank")]) for side in "ab")
    above = a.join(b, ["core", "key"]).where((F.col("b_rank") > F.col("a_rank")) & F.forall("a_labels", lambda x: F.exists("b_labels", lambda y: fit(x, y))))
    links = above.groupBy(F.col("a_id").alias("id")).agg(F.max("b_rank")["id"].alias("parent"))
    most = told.where(F.size("givens") > 0).groupBy("core").agg(F.max(F.struct("n", "id"))["id"].alias("parent"))
    without = told.where(F.size("givens") == 0).select("core", "id").join(most, "core").select("id", "parent")
    roots = roots_of(several.select("id"), materialise(links.unionByName(without), "given-links"))
    return sets.join(roots, "id", "left").select("core", "givens", F.coalesce("root", "id").alias("persons"))


def organisation_of(records: DataFrame, key: str, name: str) -> DataFrame:
    """(key, raw, organisation): the id of the organisation each typed name means.

    Null and blank names, stand-ins and names without a naming word name nobody and are
    left out. Repeated rows are kept; extra columns don't matter. Very long texts are
    parsed like others, once each.
    """
    rows = records.where(F.trim(F.replace(F.col(name), F.lit("\u00a0"), F.lit(" "))) != "").select(F.col(key).alias("key"), F.col(name).alias("raw"))
    counted = materialise(rows.groupBy("raw").agg(F.count(F.lit(1)).alias("n")), "typed-names")
    typed = materialise(typed_organisations(counted).withColumn("names", F.sort_array(F.array_distinct("names"))).withColumn("id", F.concat_ws("|", "direction", F.array_join("names", " "))), "typed-organisations")
    cores = materialise(typed.groupBy("id").agg(F.sum("n").alias("n"), F.first("direction").alias("direction"), F.first("names").alias("names")), "organisation-cores")
    resolved = materialise(resolved_names(cores), "resolved-names")
    parted = run_together(cores, resolved).select(F.col("id").alias("core"), F.col("core").alias("_parted"))
    named = resolved.join(parted, "core", "left").select("id", F.coalesce("_parted", "core").alias("core"))
    written = materialise(typed.select("raw", "id", "givens", "n").join(named, "id").select("raw", "core", "givens", "n"), "written-names")
    entries = written.join(same_persons(written), ["core", "givens"]).select("raw", F.col("persons").alias("organisation"), "n")
    return heavy_key_join(rows, entries, ["raw"], "n").select("key", "raw", "organisation")
