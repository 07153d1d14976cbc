"""Freely typed values mapped to the closest entry of a reference list; the rest reported.

Everything is SQL expressions: texts are brought to compact keys, the keys joined to
the keys of the reference strings by ``pigeonhole_candidates``, and what has no entry
is found by anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planloom.llm.pigeonhole import pigeonhole_candidates
from planloom.operators.skew import heavy_key_join
from planloom.session import materialise

UNMATCHED = "UNMATCHED"

#: (from length of the reference key, edits allowed). Scanning noise may turn one letter into two.
STEPS = ((5, 1), (9, 2))

_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def despaced(text: Column) -> Column:
    """Words set with a space between all letters, put together: ``A C E   B`` gives ``ACE B``."""
    one = F.trim(F.replace(text, F.lit("\u00a0"), F.lit(" ")))
    joined = F.replace(F.replace(F.regexp_replace(one, r"\s{2,}", "\u0001"), F.lit(" "), F.lit("")), F.lit("\u0001"), F.lit(" "))
    return F.when(one.rlike(r"^(?:\S\s+){2,}\S$"), joined).otherwise(one)


def plain(text: Column) -> Column:
    """Lower case without accents, letter spacing and outer white space."""
    return F.translate(F.lower(despaced(text)), *_ACCENTS)


def _words(text: Column) -> Column:
    """Words of a plain text, without a leading or trailing "consultant" unless it is all there is."""
    t = F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))
    bare = F.trim(F.regexp_replace(t, r"(?:\s+consultants?)+$|^(?:consultants?\s+)+", ""))
    return F.when(bare.rlike(r"^consultants?$"), t).otherwise(bare)


def _key(order: str, rank: int, words: Column) -> Column:
    return F.struct(F.lit(order).alias("order"), F.lit(rank).alias("rank"), F.replace(words, F.lit(" "), F.lit("")).alias("key"))


def _ranked(words: Column) -> Column:
    return F.array_join(F.sort_array(F.split(words, " ")), "")


def typed_keys(text: Column) -> Column:
    """Array of structs (order, rank, key) of a typed text: its words as typed, turned at a separator (``B, A`` and ``B (A)`` are ``A B``), and sorted."""
    t = plain(text)
    for pattern in (r"^(?:consultant|discipline|sub|trade)\s*[:\-]+\s*", r"\s*(?:#\s*[0-9]+|\(\s*sub\s*\)|-\s*of record|[:*])\s*$"):
        t = F.regexp_replace(t, pattern, "")
    words = _words(t)
    turned = _words(F.regexp_replace(t, r"^(.*?)\s*(?:,|\s-|\()\s*(.*)$", "$2 $1"))
    return F.array(_key("typed", 0, words), _key("typed", 1, turned), _key("ranked", 2, _ranked(words)))


def reference_keys(refs: DataFrame, code: str, name: str) -> DataFrame:
    """(code, order, key) of reference strings; equal keys of one code appear once."""
    words = F.trim(F.regexp_replace(plain(F.col(name)), r"[^a-z0-9]+", " "))
    return refs.where(F.col(name).isNotNull()).select(F.col(code).alias("code"), F.explode(F.array(_key("typed", 0, words), _key("ranked", 2, _ranked(words)))).alias("_k")).select("code", "_k.order", "_k.key").distinct()


def map_to_list(values: DataFrame, value: str, refs: DataFrame, code: str, name: str, steps: tuple[tuple[int, int], ...] = STEPS) -> DataFrame:
    """``values`` with column ``code``: the reference entry meant, or UNMATCHED.

    refs: reference strings with their code; several strings (names, abbreviations,
    other languages) may share a code. The closest wins; words as typed go before words
    in another order, then the smaller code. Null and blank values are left out; texts
    without letters or digits are UNMATCHED; repeated rows are kept, as are all other
    columns under any name. An empty list leaves everything UNMATCHED.
    """
    keyed = values.where(F.trim(F.replace(F.col(value), F.lit("\u00a0"), F.lit(" "))) != "").select(F.struct("*").alias("_row"), F.col(value).alias("_value"))
    counted = materialise(keyed.groupBy("_value").agg(F.count(F.lit(1)).alias("_n")), "typed-values")
    keys = counted.select("_value", F.explode(typed_keys(F.col("_value"))).alias("_k")).select("_value", "_k.*").where(F.col("key") != "")
    distinct = keys.select("order", F.col("key").alias("typed")).distinct()
    pairs = pigeonhole_candidates(distinct, reference_keys(refs, code, name), "typed", "key", steps, ["order"])
    ranked = keys.withColumnRenamed("key", "typed").join(pairs.select("order", "typed", "code", "distance"), ["order", "typed"])
    best = materialise(ranked.groupBy("_value").agg(F.min(F.struct("distance", "rank", "code")).alias("_b")).select("_value", F.col("_b.code").alias("code")), "mapped-values")
    rest = counted.join(best, "_value", "left_anti").select("_value", F.lit(UNMATCHED).alias("code"))
    entries = best.unionByName(rest).join(counted, "_value")
    return heavy_key_join(keyed, entries, ["_value"], "_n").select("_row.*", F.col("code").alias(code))
