import random
from collections import defaultdict

import pytest

from claimloom.llm.packing import pack, plan


def containers(slots):
    out = defaultdict(list)
    for length, first, last, per, container, offset in slots:
        for rank in range(first, last + 1):
            step = rank - first
            out[container + step // per].append((offset + step % per * length, length))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_item_once_without_overlap(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 100])
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
    slots, number = plan(histogram, capacity)
    ranks = defaultdict(list)
    for length, first, last, *_ in slots:
        ranks[length] += range(first, last + 1)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    held = containers(slots)
    assert sorted(held) == list(range(number))
    for items in held.values():
        items.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(items, items[1:], strict=False)) and items[-1][0] + items[-1][1] <= capacity
    # best fit by decreasing length needs at most 11/9 of the least number, and 1 more
    assert number <= 11 / 9 * -(-sum(k * n for k, n in histogram.items()) // capacity) + 1 or max(histogram) * 2 > capacity


def first_best_fit(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, f in enumerate(free) if f >= s]
        if fit:
            free[min(fit, key=lambda i: free[i])] -= s
        else:
            free.append(capacity - s)
    return len(free)


@pytest.mark.parametrize("seed", range(5))
def test_as_few_containers_as_item_by_item(seed):
    rng = random.Random(seed)
    sizes = [min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(600)]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    assert plan(histogram, 100)[1] == first_best_fit(sizes, 100)


def test_bad_length():
    with pytest.raises(ValueError, match="within"):
        plan({11: 1}, 10)


def test_items(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 7, 7, 7, 10, 11, 20, 25, 63]), "x") for i in range(900)] + [(900, None, "x"), (901, -3, "x"), (902, 1000, "x"), (3, 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n int, rank string")
    got = pack(spark, df, "doc_id", "n", 10).collect()
    total = defaultdict(int)
    held = defaultdict(list)
    for r in got:
        total[r["doc_id"]] += r["length"]
        assert r["item_start"] == r["piece"] * 10
        if r["length"]:
            held[r["container_id"]].append((r["start"], r["length"]))
    want = defaultdict(int)
    for k, n, _ in rows:
        want[k] += max(0, n or 0)
    assert total == want
    for items in held.values():
        items.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(items, items[1:], strict=False)) and items[-1][0] + items[-1][1] <= 10
    assert all(r["length"] == 10 for r in got if r["doc_id"] == 902) and sorted(held) == list(range(len(held)))
    assert {r["container_id"] for r in got if not r["length"]} <= set(held)


def test_empty_and_only_empty_items(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n int")
    assert pack(spark, df.where("false"), "doc_id", "n").collect() == []
    assert [(r["doc_id"], r["container_id"], r["length"]) for r in pack(spark, df, "doc_id", "n").orderBy("doc_id").collect()] == [(1, 0, 0), (2, 0, 0)]
