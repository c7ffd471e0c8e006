"""Candidates of the rare-word net among long lines, and the test of the pairs that are left."""

import random
from collections import Counter

import numpy as np

from kdframe.llm import line_dedup as ld

SIZES = (50, 100, 180, 200, 370, 400, 600)


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(8))


def lines(rng, copies):
    found = []
    for size in SIZES:
        words = [word(rng) for _ in range(size)]
        found.append(words)
        for _ in range(copies):
            changed = list(words)
            for at in rng.sample(range(size), size // 10):
                changed[at] = word(rng)
            found.append(changed + ["twice"] * rng.randrange(4))
    return [" ".join(words) for words in found]


def digested(parts):
    return ld.digests(parts, rarity=np.full(ld.COUNT_SLOTS, 100, dtype=np.uint64))[3:]


def test_wide_parities_differ_in_no_more_bits_than_words():
    parts = lines(random.Random(1), 3)
    wide = digested(parts)[1]
    assert sorted({len(x) for x in wide.to_pylist()}) == [0, 32, 64, 128]
    seen = 0
    for place, bits in ld.folded(wide):
        for i, j in ((i, j) for i in range(len(parts)) for j in range(i) if place[i] >= 0 and place[j] >= 0):
            a, b = (Counter(parts[k].split()) for k in (i, j))
            assert np.bitwise_count(bits[place[i]] ^ bits[place[j]]).sum() <= ((a - b) + (b - a)).total()
            seen += 1
    assert seen > 300


def test_long_lines_that_differ_are_no_candidates_of_the_first_pass(spark):
    rng = random.Random(2)
    parts = [line for _ in range(12) for line in lines(rng, 1)]
    net, wide = (x.to_pylist() for x in digested(parts))
    # all lines of one bucket, and no groups yet
    rows = [(i, {**x, "keys": [1 << 32]}, y) for i, (x, y) in enumerate(zip(net, wide))]
    nodes = spark.createDataFrame(rows, f"node long, net {ld.NET}, wide binary")
    want = {(i, i + 1) for i in range(0, len(parts), 2)}
    assert {(r["a"], r["b"]) for r in ld.close_pairs(nodes, 80, False).collect()} == want
    assert {(r["a"], r["b"]) for r in ld.close_pairs(nodes, 80, True).collect()} == want
    assert ld.close_pairs(nodes.drop("wide"), 80, False).count() > 2 * len(want)


def test_near_is_the_bound_of_the_distance():
    rng = random.Random(3)
    for _ in range(5000):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 15))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b[at : at + (kind != 0)] = [] if kind == 2 and len(b) > 1 else [rng.randrange(6)]
        most = rng.randrange(5)
        assert ld.near(np.array(a), np.array(b), most) == (ld.distance(a, b) <= most)
