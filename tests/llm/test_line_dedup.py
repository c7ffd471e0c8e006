"""Line removal against brute force, on small tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kdframe.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def simhash(words):
    return int(ld.digests([" ".join(w.decode() for w in words)], ld.VISIBLE)[2][0]) % (1 << 64)


def share_blocks(a, b):
    return sum((a ^ b) >> 16 * i & 0xFFFF == 0 for i in range(4)) >= 2


def may_be_close(a, b, similarity):
    """Cheap bounds on the distance, which spare nearly all of them."""
    most = (100 - similarity) * max(len(a), len(b)) // 100
    return abs(len(a) - len(b)) <= most and max(len(a), len(b)) - (Counter(a) & Counter(b)).total() <= most


def brute(rows, similarity=80, blocks=True):
    """All pairs of lines; with ``blocks`` only those that share SimHash blocks are compared."""
    places = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        places += [(doc, at, tuple(ld.normal(line))) for at, line in enumerate(lines) if ld.normal(line)]
    forms = sorted({f for _, _, f in places})
    sims = [simhash(f) for f in forms]
    group = {f: f for f in forms}

    def find(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, a in enumerate(forms):
        for j in range(i):
            if (share_blocks(sims[i], sims[j]) if blocks else may_be_close(a, forms[j], similarity)) and 100 * distance(a, forms[j]) <= (100 - similarity) * max(len(a), len(forms[j])):
                group[find(a)] = find(forms[j])
    first = {}
    for doc, at, form in places:
        first[find(form)] = min((doc, at), first.get(find(form), (doc, at)))
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None, 0))
            continue
        gone = {at for d, at, f in places if d == doc and first[find(f)] != (doc, at)}
        out.append((doc, "\n".join(x for at, x in enumerate(text.split("\n")) if at not in gone), len(gone)))
    return sorted(out)


def table():
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("or", "ein", "ux", "é", "ST")]
    common = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))) for _ in range(12)]

    def line():
        kind = rng.random()
        if kind < 0.3:
            return rng.choice(common)
        words = rng.choice(common).split()
        if kind < 0.6:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.7:
            words = [w.upper() + "," for w in words]
        elif kind < 0.8:
            return rng.choice(["", " ", "--", "12 34", "!"])
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))]
        return " ".join(words)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 9)))) for i in range(70)]
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (503, rows[4][1]), (504, rows[5][1].upper())]


def test_against_brute_force(spark):
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("unit", F.lit("own")).repartition(3)
    got = ld.dedup_lines(df, complete=False, removed_col="n").select("doc_id", "text", "n").collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == want
    assert sum(n for _, _, n in want) > 100


def test_distance():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        assert ld.distance(a, b) == distance(a, b)
    long = [rng.choice("abcdefgh") for _ in range(300)]
    other = [x for x in long if rng.random() > 0.1]
    assert ld.distance(long, other) == distance(long, other)


def test_bags():
    a, b = ld.bag([5, 3, 5, 5, 9]), ld.bag([9, 5, 5, 1])
    assert len(set(a.tolist())) == 5 and len(set(a.tolist()) & set(b.tolist())) == 3


def test_simhashes_are_weighted_majorities():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64)
    weights = rng.integers(1, 12, 500)
    starts = np.array([0, 1, 7, 250])
    got = ld.simhashes(hashes, weights, starts)
    for at, (a, b) in enumerate(zip(starts, [1, 7, 250, 500])):
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1)
        want = np.packbits(2 * (bits * weights[a:b, None]).sum(axis=0) > weights[a:b].sum()).view(np.int64)[0]
        assert got[at] == want


def test_digests_follow_the_normal_form():
    forms = ["One, two three", "one two  THREE 4!", "two one three", "é à", "", " 12 ", "onetwo three", "one"]
    numbers, hashes, sims = ld.digests(forms)
    assert numbers.tolist() == [0, 1, 2, 3, 6, 7] and hashes[0] == hashes[1] and sims[0] == sims[1] == sims[2]
    assert len(set(hashes.tolist())) == 5
    for at, form in zip(numbers, hashes):
        assert ld.digests([forms[at]])[1][0] == form
    assert ld.digests(["12", " ", "1 2"], ld.VISIBLE)[0].tolist() == [0, 2]


def test_near_lines_are_close():
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}".encode() for i in range(200)]
    near = [*words[:100], b"other", *words[101:]]
    assert (simhash(words) ^ simhash(near)).bit_count() <= 5


@pytest.mark.parametrize("unit", ["x" * 4100, "ab " * 3000, "y" * 1999 + " " + "z" * 2001])
def test_units_of_long_lines(unit):
    text = f"a\n{unit}\n\nb"
    lines = {}
    for number, part in ld.units(text):
        assert len(part) <= ld.UNIT
        lines.setdefault(number, []).append(part)
    assert "\n".join("".join(p) for p in lines.values()) == text


def test_long_lines_and_repeated_rows(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    rows = [(1, "head\n" + long), (2, long + "\ntail"), (2, long + "\ntail"), (None, "head\nmiddle"), (3, "middle")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ld.dedup_lines(df).collect()), key=str)
    # a null id sorts first
    assert got == sorted([(1, long), (2, "tail"), (2, "tail"), (None, "head\nmiddle"), (3, "")], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ld.dedup_lines(df).count() == 0


def test_sketches_and_bounds():
    rng = random.Random(12)
    vocabulary = [rng.getrandbits(62) for _ in range(60)]
    units = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 50))] for _ in range(80)]
    units += [u[: len(u) // 2] + [1] + u[len(u) // 2 + 1 :] for u in units]
    sketches = [ld.sketch(u) for u in units]
    n = len(units)
    pairs = [(i, j) for i in range(n) for j in range(i)]
    far = ld.differing_bits([sketches[i] for i, _ in pairs], [sketches[j] for _, j in pairs])
    sizes = [np.array([len(units[p[k]]) for p in pairs]) for k in (0, 1)]
    most, apart = ld.bounds(sizes, 80)
    close = 0
    for (i, j), bits, edits, limit in zip(pairs, far, most, apart):
        if distance(units[i], units[j]) <= edits:
            close += 1
            assert bits <= limit
    assert close > 50


def test_clashing_columns(spark):
    rows = [(1, "alpha beta gamma delta epsilon\nx", 1, 2), (2, "alpha beta gamma delta epsilon", 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key int, _gone int")
    got = ld.dedup_lines(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], (2, "", 3, 4)]
