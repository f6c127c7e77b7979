import random
import re
from fractions import Fraction

from claimloom.llm import near_duplicates as nd

SCHEMA = "tbl string, key string, text string, cls int, id int"


def brute(rows, threshold=Fraction(4, 5)):
    sets = {(t, k): set(re.findall("[a-zA-Z0-9]+", (x or "").lower())) for t, k, x, *_ in rows if k is not None}
    names = sorted(k for k, s in sets.items() if s)
    out = set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if a[0] == b[0]:
                n = len(sets[a] & sets[b])
                if n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                    out.add((a[0], a[1], b[1]))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    got = [tuple(r) for r in nd.expand_pairs(*nd.near_duplicates(df)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, sizes, n, words=400):
    rng = random.Random(seed)
    common = [f"the{i}" for i in range(8)]
    vocabulary = [f"word{i}" for i in range(words)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            t = rng.choice(rows)[2].split()
            for _ in range(rng.randint(0, 1 + len(t) // 5)):
                at = rng.randrange(len(t))
                what = rng.random()
                if what < 0.4:
                    t[at] = rng.choice(vocabulary)
                elif what < 0.7 and len(t) > 1:
                    del t[at]
                else:
                    t.insert(at, rng.choice(vocabulary))
            rng.shuffle(t)
        else:
            t = common[: rng.randint(0, 8)] + rng.choices(vocabulary, k=rng.choice(sizes))
        rows.append((rng.choice("ab"), f"k{i:04}", " ".join(t)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1, [1, 2, 3, 5, 8, 13, 21, 34, 55], 500)
    want = brute(rows)
    assert len(want) > 100
    assert found(spark, rows) == want


def test_long_texts(spark):
    rows = corpus(2, [90, 130, 400], 90, words=3000)
    assert found(spark, rows) == brute(rows) != set()


def test_same_template_everywhere(spark):
    """All texts share most of their words, as boilerplate does."""
    rng = random.Random(3)
    rows = [("a", f"k{i:03}", " ".join([f"t{j}" for j in range(14)] + [f"w{rng.randrange(60)}" for _ in range(8)])) for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_nulls_copies_and_repeats(spark):
    rows = [("a", "k1", None), ("a", "k2", ""), ("a", "k3", "  ...!"), ("a", "k4", "One, two!"), ("a", "k5", "two ONE one"), ("b", "k6", "one two"), ("a", None, "one two"), ("a", "k4", "One, two!"), ("a", "k7", "x" * 300_000), ("a", "k8", "X" * 300_000)]
    assert found(spark, rows) == {("a", "k4", "k5"), ("a", "k7", "k8")}


def test_empty(spark):
    assert found(spark, []) == set()


def test_bounds_hold_for_all_sizes():
    p = nd.SimilarityJoin()
    cuts = p.intervals()
    for a in range(1, 300):
        for b in range(a, int(a / p.threshold) + 1):
            need = -(-(a + b) * 4 // 9)  # least overlap at the threshold
            assert a + b - 2 * need <= p.max_difference(a + b)
            k = max(i for i, (low, _) in enumerate(cuts) if low <= a)
            assert cuts[k][0] <= b <= cuts[k + 1][1]
    for _, high in cuts[:30]:
        d = p.max_difference(2 * high)
        assert p.coordinates(high) >= d + (1 if d + 2 > p.pair_limit else 2)
