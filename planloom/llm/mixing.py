"""Records of several sources mixed to shares of the total size.

Weights come from source sizes and targets by one exponent, bisected to meet a target
entropy or the repetition limits; they are realised as passes over each source: whole
passes use every text, the last pass a part of a permutation that meets the budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planloom.session import materialise

#: Parts of a permutation whose sizes are summed to find where the last pass ends; only the part that holds the end is sorted.
PARTS = 4096
ROUNDS = 60


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(sizes: dict[str, float], exponent: float, targets: dict[str, float] | None = None) -> dict[str, float]:
    """Normalised weights: size shares to the power ``exponent``; with targets, ``size share ^ (1 - exponent) * target ^ exponent``."""
    total = sum(sizes.values())
    raw = {s: ((n / total) ** exponent if targets is None else (n / total) ** (1 - exponent) * targets[s] ** exponent) if n > 0 else 0.0 for s, n in sizes.items()}
    norm = sum(raw.values())
    return {s: w / norm for s, w in raw.items()} if norm else raw


def _bisect(ok, low: float, high: float) -> float:
    """Largest x in [low, high] with ok(x), for ok true at first and false from some point on."""
    if ok(high):
        return high
    for _ in range(ROUNDS):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def exponent_for_entropy(sizes: dict[str, float], wanted: float) -> float:
    """Exponent in [0, 1] at which size shares have the wanted entropy: 1 leaves them as they are, 0 makes them equal."""
    return _bisect(lambda x: entropy(tempered(sizes, x)) >= wanted, 0.0, 1.0)


def largest_budget(sizes: dict[str, float], weights: dict[str, float], repeats: dict[str, int]) -> float:
    """The most that can be mixed in these weights with no text used more often than allowed."""
    limits = [sizes[s] * repeats[s] / w for s, w in weights.items() if w > 0]
    return min(limits) if limits else 0.0


def mixing_weights(sizes: dict[str, float], targets: dict[str, float], repeats: dict[str, int], budget: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, budget, exponent). Without a budget the targets are met exactly, with as much as the limits allow.

    With a budget the exponent is the largest, between size shares (0) and targets (1),
    at which the budget keeps to the repetition limits. Targets of sources without texts
    are shared out over the rest.
    """
    present = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t > 0}
    norm = sum(present.values())
    wanted, held = {s: t / norm for s, t in present.items()}, {s: sizes[s] for s in present}
    if not present:
        return {}, 0.0, 1.0
    if budget is None:
        return wanted, largest_budget(held, wanted, repeats), 1.0
    fits = lambda x: largest_budget(held, tempered(held, x, wanted), repeats) >= budget
    exponent = _bisect(fits, 0.0, 1.0)
    weights = tempered(held, exponent, wanted)
    return weights, min(budget, largest_budget(held, weights, repeats)), exponent


def distinct_texts(docs: DataFrame, key: str, source: str, text: str, size: str) -> DataFrame:
    """(key, source, size) of one row for each distinct text: the smallest key holds it, so a text has one source and one limit."""
    held = docs.where(F.col(text).isNotNull() & F.col(source).isNotNull() & (F.col(size) > 0)).select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col(size).alias("_n"), F.sha2(text, 256).alias("_h"))
    return held.groupBy("_h").agg(F.min(F.struct("_k", "_s", "_n")).alias("_m")).select(F.col("_m._k").alias(key), F.col("_m._s").alias(source), F.col("_m._n").alias(size))


def mixing_plan(sizes: dict[str, float], targets: dict[str, float], repeats: dict[str, int], budget: float | None = None, least_entropy: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, budget, exponent) of a mixture: by ``mixing_weights``, or, with ``least_entropy``, size shares tempered to that entropy.

    An entropy that even equal shares don't reach gives equal shares. The budget is cut
    to what the repetition limits allow.
    """
    if least_entropy is None:
        return mixing_weights(sizes, targets, repeats, budget)
    held = {s: sizes[s] for s in targets if sizes.get(s, 0) > 0}
    if not held:
        return {}, 0.0, 1.0
    exponent = exponent_for_entropy(held, least_entropy)
    weights = tempered(held, exponent)
    most = largest_budget(held, weights, repeats)
    return weights, most if budget is None else min(budget, most), exponent


@dataclass
class Mixture:
    """The uses of texts, and what they were planned by."""

    uses: DataFrame
    weights: dict[str, float]
    budget: float
    exponent: float


def mix(texts: DataFrame, key: str, source: str, size: str, targets: DataFrame, budget: float | None = None, seed: int = 0) -> DataFrame:
    """``mixture(...).uses``."""
    return mixture(texts, key, source, size, targets, budget, seed=seed).uses


def mixture(texts: DataFrame, key: str, source: str, size: str, targets: DataFrame, budget: float | None = None, least_entropy: float | None = None, passes_of_all: float | None = None, seed: int = 0) -> Mixture:
    """(key, source, copy_no, mix_order, size): the mixture, one row for each use of a text.

    texts: distinct texts (see ``distinct_texts``). targets: (source, target_share,
    max_repeats), one row for each source, few enough for the driver. Sources without a
    target are not used. ``budget`` is a size; ``passes_of_all`` gives it as a multiple of
    the size of all texts. Sorting by ``mix_order`` interleaves the sources; within a
    source each pass is a permutation of its own. An empty input gives an empty mixture.
    """
    spark = texts.sparkSession
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect()}
    used = materialise(texts.join(F.broadcast(targets.select(F.col("source").alias(source)).distinct()), source).select(key, source, size), "mixture-texts")
    sizes = {r[source]: float(r["n"]) for r in used.groupBy(source).agg(F.sum(size).alias("n")).collect()}
    if passes_of_all is not None:
        budget = passes_of_all * sum(sizes.values())
    weights, total, exponent = mixing_plan(sizes, {s: w for s, (w, _) in wanted.items()}, {s: r for s, (_, r) in wanted.items()}, budget, least_entropy)
    passes = [(s, min(int(weights[s] * total / sizes[s] + 1e-9), wanted[s][1])) for s in weights]
    whole = dict(passes)
    rest = {s: max(0.0, weights[s] * total - whole[s] * sizes[s]) if whole[s] < wanted[s][1] else 0.0 for s in weights}
    spot = lambda n: F.pmod(F.xxhash64(F.lit(seed), n, F.col(source), F.col(key)), F.lit(1 << 40))
    plan = spark.createDataFrame([(s, n) for s, n in whole.items()] or [("", 0)], "_s string, _whole int")
    planned = used.join(F.broadcast(plan), F.col(source) == F.col("_s")).drop("_s")
    full = planned.where("_whole > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_whole")))).withColumn("_spot", spot(F.col("copy_no")))
    # The last pass: sum the parts of the permutation, take those before the end whole, and sort only the part that holds the end.
    last = planned.withColumn("copy_no", F.col("_whole") + 1).withColumn("_spot", spot(F.col("copy_no"))).withColumn("_part", F.floor(F.col("_spot") / ((1 << 40) // PARTS)).cast("int"))
    sums: dict[str, list[tuple[int, float]]] = {}
    for r in last.groupBy(source, "_part").agg(F.sum(size).alias("n")).orderBy(source, "_part").collect():
        sums.setdefault(r[source], []).append((r["_part"], float(r["n"])))
    ends = []
    for s, left in rest.items():
        for part, n in sums.get(s, []):
            if n > left:
                ends.append((s, part, left))
                break
            left -= n
        else:
            ends.append((s, PARTS, 0.0))
    cut = spark.createDataFrame(ends or [("", 0, 0.0)], "_s string, _end int, _left double")
    last = last.join(F.broadcast(cut), F.col(source) == F.col("_s")).drop("_s").where(F.col("_part") <= F.col("_end"))
    order = Window.partitionBy(source).orderBy("_spot", key)
    edge = last.where(F.col("_part") == F.col("_end")).withColumn("_sum", F.sum(size).over(order)).where(F.col("_sum") <= F.col("_left")).drop("_sum")
    partial = last.where(F.col("_part") < F.col("_end")).unionByName(edge).drop("_part", "_end", "_left")
    uses = full.unionByName(partial).select(key, source, "copy_no", F.xxhash64(F.lit(seed + 1), "_spot").alias("mix_order"), size)
    return Mixture(uses, weights, total, exponent)


def mixture_report(mixture: DataFrame, source: str, size: str, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, uses, texts_used, most_uses, tokens, reached_share) of each source with a target; unused ones with zeros."""
    by = mixture.groupBy(source).agg(F.count(F.lit(1)).alias("uses"), F.count_if(F.col("copy_no") == 1).alias("texts_used"), F.max("copy_no").cast("int").alias("most_uses"), F.sum(size).alias("tokens"))
    joined = targets.join(by, targets["source"] == by[source], "left").select(targets["source"], "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("uses", "texts_used", "most_uses", "tokens")])
    # One row a source, so one partition holds them.
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return joined.withColumn("reached_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
