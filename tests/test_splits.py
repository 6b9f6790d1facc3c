"""Allocation by flows and iterative stratification: contracts, known cases, and a plain loop."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from farfield.operators import splits
from farfield.operators.allocation import allocate


def holds(counts, sizes):
    share, n = allocate(counts, sizes), sum(counts.values())
    assert [sum(x[p] for x in share.values()) for p in range(len(sizes))] == list(sizes)
    assert all(sum(share[c]) == k for c, k in counts.items()) and min(min(x) for x in share.values()) >= 0
    for a in (0, 1):
        for v in {c[a] for c in counts}:
            of = sum(k for c, k in counts.items() if c[a] == v)
            for p, size in enumerate(sizes):
                assert of * size // n <= sum(x[p] for c, x in share.items() if c[a] == v) <= -(-of * size // n)
    return share


@pytest.mark.parametrize("cells", [(5, 5, 5, 5), (8, 2, 2, 8), (9, 1, 1, 9)])
def test_two_classes_and_regions_of_twenty(cells):
    share = holds(dict(zip((("0", "A"), ("0", "B"), ("1", "A"), ("1", "B")), cells, strict=True)), (16, 2, 2))
    for p in (1, 2):
        assert sum(x[p] for c, x in share.items() if c[0] == "0") == sum(x[p] for c, x in share.items() if c[1] == "A") == 1


def test_known_cases():
    assert holds({(0, "R"): 3, (1, "R"): 5, (2, "R"): 2}, (8, 1, 1))[1, "R"][0] == 4
    holds({("0", "A"): 2, ("0", "B"): 4, ("1", "A"): 4, ("1", "B"): 1}, (7, 2, 2))
    even = holds({(c, r): 25 for c in "01" for r in "AB"}, (80, 10, 10))
    assert all(x[p] in (2, 3) for x in even.values() for p in (1, 2))
    sparse = holds({(r, c): 1 for r in "AB" for c in range(30)}, (48, 6, 6))
    assert all(sum(x[p] for c, x in sparse.items() if c[0] == "A") == 3 for p in (1, 2))
    assert allocate({}, (0, 0)) == {} and holds({(1, None): 7, (2, None): 0}, (5, 1, 1))[2, None] == [0, 0, 0]
    with pytest.raises(ValueError, match="add up"):
        allocate({(1, 1): 3}, (1, 1))


def test_random_tables_of_two_to_five_parts():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.choice([10, 11, 20, 60, 400, 5000])
        counts = Counter((rng.randrange(rng.randint(1, 7)), rng.randrange(rng.randint(1, 5))) for _ in range(n))
        p = -(-n // 10)
        holds(dict(counts), (n - 2 * p, p, p))
        holds(dict(counts), (n - n // 5, n // 5))
    wide = {(c, r): rng.randrange(900) for c in range(12) for r in range(9)} | {(0, 0): 60_000}
    n = sum(wide.values())
    holds(wide, (n - 4 * (n // 9), *[n // 9] * 4))


def stated(labels, sizes, seed):
    """The rounds of the iterative stratification in plain Python; ``labels``: sets by key."""
    h = lambda *a: hashlib.md5("|".join(map(str, a)).encode()).hexdigest()
    n, room, out = len(labels), dict(sizes), {}
    left = Counter(x for s in labels.values() for x in s)
    wants = {x: {p: k * size / n for p, size in sizes.items()} for x, k in left.items()}
    open_ = dict(labels)
    while open_:
        label = min((x for x in left if left[x]), key=lambda x: (left[x], x), default=None)
        now = {k: s for k, s in open_.items() if label is None or label in s}
        got, need = Counter(), {p: float(r) for p, r in room.items()} if label is None else dict(wants[label])
        for _ in now:
            best = max((p for p in sizes if got[p] < room[p]), key=lambda p: (need[p] - got[p], room[p] - got[p]))
            got[best] += 1
        rarest = sorted((x for x in left if left[x]), key=lambda x: (left[x], x))
        others = {k: (sorted(rarest.index(x) for x in s if x != label) + [len(rarest)] * 2)[:2] for k, s in now.items()}
        line = sorted(now, key=lambda k: (others[k], h(seed, "multilabel", k), k))
        by_size, parts = sorted(sizes, key=lambda p: (got[p], p)), [None] * len(line)
        places = list(range(len(line)))
        for j, p in enumerate(by_size[:-1]):
            n_, start = len(places), 0
            start = (seed * 7919 + j * 104729) % n_ if n_ else 0
            taken = [q for i, q in enumerate(places) if ((i + 1) * got[p] + start) // n_ > (i * got[p] + start) // n_]
            for q in taken:
                parts[q] = p
            places = [q for q in places if q not in set(taken)]
        parts = [p or by_size[-1] for p in parts]
        for k, p in zip(line, parts, strict=True):
            out[k] = p
            room[p] -= 1
            for x in open_.pop(k):
                wants[x][p] -= 1
                left[x] -= 1
    return out


def label_sets(n, labels, seed, most=3):
    rng = np.random.default_rng(seed)
    return {k: tuple(sorted({int(x) for x in rng.integers(0, labels, size=rng.integers(1, most + 1))})) for k in range(n)}


def stratified(spark, sets, sizes, seed):
    df = spark.createDataFrame([(k, list(s)) for k, s in sets.items()], "k long, labels array<int>").repartition(3)
    return {r["k"]: r["partition"] for r in splits.partition_multilabel(df, "labels", "k", sizes, seed).collect()}


def test_stratification_is_that_of_plain_rounds(spark):
    sets = label_sets(120, 5, 1) | {500: (), 501: (), 502: (3,)}
    sizes = {"train": 99, "val": 12, "test": 12}
    assert stratified(spark, sets, sizes, 0) == stated(sets, sizes, 0)


@pytest.mark.parametrize("seed", [0, 1])
def test_labels_are_near_their_quotas(spark, seed):
    sets = label_sets(400, 8, 2)
    sizes = {"train": 320, "val": 40, "test": 40}
    got = stratified(spark, sets, sizes, seed)
    assert Counter(got.values()) == sizes
    for p, size in sizes.items():
        have = Counter(x for k, q in got.items() if q == p for x in sets[k])
        for x, n in Counter(x for s in sets.values() for x in s).items():
            assert have[x] >= 0.75 * n * size / 400 and abs(have[x] - n * size / 400) <= 4


def test_single_labels_meet_their_quotas_exactly(spark):
    sets = {k: s[:1] for k, s in label_sets(600, 6, 4).items()}
    sizes = {"train": 480, "val": 60, "test": 60}
    one, two = (stratified(spark, sets, sizes, seed) for seed in (0, 1))
    assert one != two
    for x, n in Counter(s[0] for s in sets.values()).items():
        for p, size in sizes.items():
            assert n * size // 600 <= sum(sets[k][0] == x and q == p for k, q in one.items()) <= -(-n * size // 600)


def test_stratification_of_odd_tables(spark):
    with pytest.raises(ValueError, match="sum to"):
        stratified(spark, label_sets(3, 2, 0), {"train": 1, "test": 1}, 0)
    empty = spark.createDataFrame([], "k long, labels array<int>")
    assert splits.partition_multilabel(empty, "labels", "k", {"train": 0}, 0).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None), (3, [1])], "k long, labels array<int>").withColumn("partition_", F.lit(1))
    assert Counter(r["partition"] for r in splits.partition_multilabel(nulls, "labels", "k", {"a": 2, "b": 1}, 0).collect()) == {"a": 2, "b": 1}


def test_dealing_by_levels_is_dealing_one_by_one():
    rng = random.Random(3)
    for _ in range(300):
        wants = {p: rng.uniform(-5, 40) for p in "abc"}
        room = {p: rng.randint(0, 40) for p in "abc"}
        count = rng.randint(0, sum(room.values()))
        got = Counter(dict.fromkeys("abc", 0))
        for _ in range(count):
            got[max((p for p in "abc" if got[p] < room[p]), key=lambda p: (wants[p] - got[p], room[p] - got[p]))] += 1
        assert splits.dealt(count, wants, room) == got
