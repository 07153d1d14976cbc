import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planloom.llm import mixing, packing, tokens


def sizes(spark, lengths):
    return spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens int")


@pytest.mark.parametrize("capacity", [1, 7, 64, 256, 3000])
def test_every_item_once_and_no_container_over(spark, capacity):
    rng = random.Random(capacity)
    lengths = [rng.randrange(0, 2 * capacity + 2) for _ in range(700)] + [None, 0] + [max(1, capacity // 3)] * 500
    packed = packing.pack(sizes(spark, lengths), "doc_id", "n_tokens", capacity).collect()
    whole, room = {}, {}
    for r in packed:
        whole.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
        room[r["container_id"]] = room.get(r["container_id"], 0) + r["n_tokens"]
    assert max(room.values()) <= capacity
    for i, n in enumerate(lengths):
        pieces = sorted(whole.get(i, []))
        assert sum(p[2] for p in pieces) == (n or 0)
        assert len(pieces) == -(-(n or 0) // capacity)
        assert [p[1] for p in pieces] == [1 + k * capacity for k in range(len(pieces))]
    assert sum(room.values()) >= 0.93 * capacity * len(room)


def test_plan_uses_each_length_exactly(spark):
    plan = packing.plan_containers({40: 1000, 30: 2000, 10: 5, 100: 3}, 100)
    used = {}
    for kind, n in plan.kinds:
        assert sum(kind) <= 100
        for b in kind:
            used[b] = used.get(b, 0) + n
    assert used == {40: 1000, 30: 2000, 10: 5, 100: 3}
    assert plan.containers <= 1010
    assert packing.plan_containers({}, 100).containers == 0
    assert packing.pack(sizes(spark, []), "doc_id", "n_tokens", 10).count() == 0


def test_combinations_place_most_and_fill_the_window():
    rng = random.Random(1)
    lengths = {}
    for _ in range(60_000):
        n = min(4096, max(1, int(rng.lognormvariate(5.2, 1.0))))
        lengths[n] = lengths.get(n, 0) + 1
    for capacity in (256, 1024, 4096):
        held = {n: c for n, c in lengths.items() if n <= capacity}
        plan = packing.plan_containers(held, capacity)
        used = {}
        for kind, n in plan.kinds:
            for b in kind:
                used[b] = used.get(b, 0) + n
        assert used == held
        assert all(capacity - sum(kind) <= max(1, capacity // 1024) for kind, _ in plan.kinds[: plan.solved])
        assert plan.solved_share()["items"] > 0.8
        assert sum(n * c for n, c in held.items()) > 0.995 * capacity * plan.containers


def test_repeats_solve_a_known_histogram():
    combos = np.array([[60, 1, 40, 1, 0], [50, 2, 0, 0, 0], [30, 3, 10, 1, 0]]).T
    histogram = np.zeros(101)
    histogram[[60, 40, 50, 30, 10]] = [7, 7, 10, 12, 4]
    assert packing.solve_repeats(combos, histogram) == pytest.approx([7, 5, 4], abs=0.05)


def test_temperature():
    sizes_ = {"a": 900.0, "b": 90.0, "c": 10.0}
    assert mixing.tempered(sizes_, 1.0)["a"] == pytest.approx(0.9) and mixing.tempered(sizes_, 0.0)["c"] == pytest.approx(1 / 3)
    x = mixing.exponent_for_entropy(sizes_, 0.9)
    assert mixing.entropy(mixing.tempered(sizes_, x)) == pytest.approx(0.9, abs=1e-6)
    targets, repeats = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 4}
    weights, budget, exponent = mixing.mixing_weights(sizes_, targets, repeats)
    assert weights == pytest.approx(targets) and budget == pytest.approx(200) and exponent == 1
    weights, budget, exponent = mixing.mixing_weights(sizes_, targets, repeats, budget=800)
    assert 0 < exponent < 1 and all(weights[s] * budget <= sizes_[s] * repeats[s] * (1 + 1e-6) for s in weights)
    assert mixing.mixing_weights({}, targets, repeats) == ({}, 0.0, 1.0)


def test_mixture_meets_shares_and_limits(spark):
    rng = random.Random(2)
    docs = [(i, f"text {i % 900}", rng.choices(["a", "b", "c", "d", None], [70, 20, 5, 4, 1])[0], rng.randrange(1, 40)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens int").withColumn("n_tokens", F.length("text") + F.lit(3))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    texts = mixing.distinct_texts(df, "doc_id", "source", "text", "n_tokens")
    assert texts.count() == 900 or texts.count() < 900
    mixture = mixing.mix(texts, "doc_id", "source", "n_tokens", targets)
    text_of = {d[0]: d[1] for d in docs}
    uses = {}
    for r in mixture.collect():
        uses.setdefault((text_of[r["doc_id"]]), []).append((r["source"], r["copy_no"]))
    limit = {"a": 1, "b": 2, "c": 3}
    assert all(len(u) == len(set(u)) <= limit[u[0][0]] for u in uses.values())
    report = {r["source"]: r for r in mixing.mixture_report(mixture, "source", "n_tokens", targets).collect()}
    assert report["none"]["tokens"] == 0 and sum(r["reached_share"] for r in report.values()) == pytest.approx(1)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert report[s]["reached_share"] == pytest.approx(share, abs=0.02)
    assert mixing.mix(texts.limit(0), "doc_id", "source", "n_tokens", targets).count() == 0


def test_a_budget_and_an_entropy_are_met_by_bisection(spark):
    rows = [(i, "a" if i < 800 else "b" if i < 950 else "c", 10) for i in range(1000)]
    texts = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(texts, "doc_id", "source", "n_tokens", targets, passes_of_all=1.0)
    report = {r["source"]: r for r in mixing.mixture_report(mixed.uses, "source", "n_tokens", targets).collect()}
    assert 0 < mixed.exponent < 1 and mixed.budget == pytest.approx(10_000, rel=1e-6)
    assert all(r["most_uses"] <= r["max_repeats"] for r in report.values())
    assert all(report[s]["reached_share"] == pytest.approx(w, abs=0.01) for s, w in mixed.weights.items())
    assert mixing.largest_budget({"a": 8000.0, "b": 1500.0, "c": 500.0}, mixing.tempered({"a": 8000.0, "b": 1500.0, "c": 500.0}, mixed.exponent + 0.01, {"a": 0.5, "b": 0.3, "c": 0.2}), {"a": 1, "b": 2, "c": 3}) < 10_000
    mixed = mixing.mixture(texts, "doc_id", "source", "n_tokens", targets, least_entropy=1.0)
    assert mixing.entropy(mixed.weights) == pytest.approx(1.0, abs=1e-6) and mixed.exponent < 1


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a " * 30_000), (5, "<|endoftext|>")], "id long, t string")
    got = {r["id"]: r["n_tokens"] for r in tokens.token_counts(df, ["id"], "t").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 30_000 and got[5] > 1
