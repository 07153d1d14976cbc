"""Items of varying length packed into containers of fixed capacity.

The plan is made on the histogram of lengths, whose size depends on the capacity and
not on the number of items. In rounds, shallow combinations (at most three different
lengths, each repeated) that fill a window below the capacity are enumerated where they
use most of what is left; their repeat counts are solved against the histogram by
non-negative least squares and rounded. What no round places is packed greedily, also by
counts. Items are then given the slots of their length by their rank in it.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planloom.session import materialise

#: Steps of the capacity in which lengths are counted, rounded up; lengths are exact for capacities up to it.
BINS = 4096
#: Part of the capacity a combination may leave free, steps of the solver, and combinations kept for each length and round.
WINDOW, STEPS, KEPT = 1 / 1024, 120, 2
#: Rounds end when one places less than this share of the items left.
LEAST_GAIN = 0.005
#: Shards of a length within which items are ranked, so that a length held by very many items is no single task's work.
SHARDS = 64


@dataclass
class Plan:
    """Kinds of containers: the bins in each (repeated as often as they occur) and how many containers are of the kind.

    The first ``solved`` kinds come from combinations, the others from the greedy part.
    """

    unit: float
    kinds: list[tuple[tuple[int, ...], int]]
    solved: int = 0

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.kinds)

    def solved_share(self) -> dict[str, float]:
        """Share of the containers, items and length that combinations place."""
        sums = [[sum(n for _, n in part), sum(len(k) * n for k, n in part), sum(sum(k) * n for k, n in part)] for part in (self.kinds[: self.solved], self.kinds)]
        return {name: x / y if y else 0.0 for name, x, y in zip(("containers", "items", "length"), *sums)}


def combinations(left: np.ndarray, room: int, window: int) -> np.ndarray:
    """Columns (a, times a, b, times b, c): KEPT combinations for each held length a, those that use most of what is left.

    a and b are taken once, twice, half as often as they fit or as often; c, taken once,
    closes the window if it has to. b and c may be 0 (none). A length is repeated at most
    as often as it occurs.
    """
    held = np.flatnonzero(left)
    if not len(held):
        return np.zeros((5, 0), dtype=np.int64)
    weight = np.zeros(room + 1)
    # Long lengths are the hard ones to place, so they weigh by their length.
    weight[held] = np.sqrt(left[held]) * held
    # The best length to close each rest: of those in [rest - window, rest] the one that occurs most.
    closing = np.zeros(room + 1, dtype=np.int64)
    for back in range(window + 1):
        shifted = np.maximum(np.arange(room + 1) - back, 0)
        closing = np.where(weight[shifted] > weight[closing], shifted, closing)
    found = []
    for a in held.tolist():
        fit = min(room // a, int(left[a]))
        for k in sorted({1, min(2, fit), max(1, fit // 2), fit}):
            rest = room - k * a
            if rest <= window:
                found.append((a, k, 0, 0, 0))
                continue
            b = held[held <= rest]
            if not len(b):
                continue
            most = np.minimum(rest // b, left[b])
            m = np.stack([np.ones_like(b), np.minimum(2, most), np.maximum(1, most // 2), most])
            last = rest - m * b
            c = np.where(last <= window, 0, closing[last])
            filled = (last <= window) | (c > 0)
            score = np.where(filled, (k * weight[a] + m * weight[b] + weight[c]) / (k + m + (c > 0)), -1.0)
            flat = score.ravel()
            for i in np.argpartition(-flat, min(KEPT, flat.size - 1))[:KEPT].tolist():
                if flat[i] > 0:
                    row, at = divmod(i, len(b))
                    found.append((a, k, int(b[at]), int(m[row, at]), int(c[row, at])))
    return np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 5).T


def solve_repeats(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient, a length's misfit weighed by the length; the matrix of counts is never built."""
    a, k, b, m, c = combos
    n = combos.shape[1]
    if not n:
        return np.zeros(0)
    size, once = len(histogram), (c > 0).astype(float)
    by = np.arange(size) / (size - 1)

    def times(x: np.ndarray) -> np.ndarray:
        return by * (np.bincount(a, x * k, size) + np.bincount(b, x * m, size) + np.bincount(c, x * once, size))

    def back(y: np.ndarray) -> np.ndarray:
        y = by * y
        return k * y[a] + m * y[b] + once * y[c]

    v = np.ones(n)
    for _ in range(20):
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1 / max(float(v @ back(times(v))), 1e-9)
    x = z = np.zeros(n)
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, z - step * back(times(z) - by * histogram))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def greedy(left: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of what is left, longest first, by counts: each step uses up a length or a kind of open container."""
    done: list[tuple[tuple[int, ...], int]] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # the keys of open_, in order

    def put(kind: tuple[int, ...], count: int, free: int) -> None:
        if not free:
            done.append((kind, count))
            return
        if free not in open_:
            open_[free] = []
            bisect.insort(rooms, free)
        open_[free].append((kind, count))

    for b in range(len(left) - 1, 0, -1):
        n = int(left[b])
        while n:
            at = bisect.bisect_left(rooms, b)
            if at == len(rooms):
                fit = room // b
                full, rest = divmod(n, fit)
                if full:
                    put((b,) * fit, full, room - b * fit)
                if rest:
                    put((b,) * rest, 1, room - b * rest)
                break
            free = rooms[at]
            kind, count = open_[free].pop()
            if not open_[free]:
                del open_[free], rooms[at]
            each = max(1, min(free // b, -(-n // count)))
            used = min(count, n // each)
            if used < count:
                put(kind, count - used, free)
            put(kind + (b,) * each, used, free - b * each)
            n -= used * each
    return done + [k for kinds in open_.values() for k in kinds]


def plan_containers(lengths: dict[int, int], capacity: int, bins: int = BINS) -> Plan:
    """Containers for a histogram (length -> items) of lengths from 1 to ``capacity``."""
    room = min(capacity, bins)
    unit = capacity / room
    histogram = np.zeros(room + 1)
    for length, n in lengths.items():
        histogram[int(np.ceil(length / unit))] += n
    left, kinds, window = histogram.astype(np.int64), [], max(1, int(room * WINDOW))
    while left.sum():
        combos = combinations(left, room, window)
        repeats = solve_repeats(combos, left.astype(float))
        before = int(left.sum())
        # Rounded half up, the largest first, as far as the lengths last; what rounding leaves is solved again in the next round.
        for i in np.argsort(-repeats, kind="stable"):
            wanted = int(repeats[i] + 0.5)
            if wanted < 1 and before - int(left.sum()) > 0:
                break
            a, k, b, m, c = combos[:, i].tolist()
            need: dict[int, int] = {}
            for length, count in ((a, k), (b, m), (c, 1)):
                if length:
                    need[length] = need.get(length, 0) + count
            n = min(max(wanted, 1), min(int(left[x]) // y for x, y in need.items()))
            if n > 0:
                for x, y in need.items():
                    left[x] -= y * n
                kinds.append((tuple(sorted((x for x, y in need.items() for _ in range(y)), reverse=True)), n))
        if before - int(left.sum()) <= LEAST_GAIN * before:
            break
    return Plan(unit, kinds + greedy(left, room), len(kinds))


def slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bin: first rank of each run of slots, items each container of the run takes, first container of the run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for kind, n in plan.kinds:
        values, counts = np.unique(kind, return_counts=True)
        for b, m in zip(values.tolist(), counts.tolist()):
            runs.setdefault(b, []).append((used.get(b, 0), m, base))
            used[b] = used.get(b, 0) + m * n
        base += n
    return {b: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for b, r in runs.items()}


def items_of(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, start_token, n_tokens): an item longer than the capacity in pieces of it, others whole; items of no size are left out."""
    n = F.col(size)
    at = F.explode(F.sequence(F.lit(0), F.ceil(n / capacity).cast("int") - 1)).alias("_p")
    return sizes.where(n > 0).select(key, n.alias("_n"), at).select(key, (F.col("_p") + 1).alias("piece_no"), (F.col("_p") * capacity + 1).alias("start_token"), F.least(F.lit(capacity), F.col("_n") - F.col("_p") * capacity).cast("int").alias("n_tokens"))


def pack(sizes: DataFrame, key: str, size: str, capacity: int, bins: int = BINS) -> DataFrame:
    """(container_id, key, piece_no, start_token, n_tokens): every item in exactly one container, no container over capacity.

    ``key`` must be unique. Items of null or no size are left out; an item is cut only
    if it is longer than the capacity. Ties are settled by a hash of the key. What the
    driver gets is one count for each length up to the capacity, whatever the input.
    """
    items = materialise(items_of(sizes, key, size, capacity), "items")
    lengths = {r["n_tokens"]: r["count"] for r in items.groupBy("n_tokens").count().collect()}
    plan = plan_containers(lengths, capacity, bins)
    table, unit = slots(plan), plan.unit
    binned = items.withColumn("_bin", F.ceil(F.col("n_tokens") / unit).cast("int")).withColumn("_shard", F.pmod(F.xxhash64(key, "piece_no"), F.lit(SHARDS)))
    before = Window.partitionBy("_bin").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = binned.groupBy("_bin", "_shard").agg(F.count(F.lit(1)).alias("_c")).select("_bin", "_shard", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy("_bin", "_shard").orderBy(F.xxhash64(F.lit(7), key, "piece_no"), key, "piece_no")
    ranked = binned.withColumn("_own", F.row_number().over(own)).join(offsets, ["_bin", "_shard"]).withColumn("_rank", F.col("_from") + F.col("_own") - 1)
    columns = [key, "piece_no", "start_token", "n_tokens"]
    schema = "container_id bigint, " + ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in columns)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.empty(len(b), dtype=np.int64)
            at, ranks = b["_bin"].to_numpy(), b["_rank"].to_numpy()
            for value in np.unique(at):
                chosen = at == value
                first, each, base = table[int(value)]
                run = np.searchsorted(first, ranks[chosen], side="right") - 1
                out[chosen] = base[run] + (ranks[chosen] - first[run]) // each[run]
            yield b[columns].assign(container_id=out)[["container_id", *columns]]

    return ranked.select(*columns, "_bin", "_rank").mapInPandas(place, schema)
