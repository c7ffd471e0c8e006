"""Near-duplicate groups against all pairs, on small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kdframe.llm import near_duplicates as nd

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute(rows, size, similarity=80):
    sets = [shingle_set(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or (a and b and 100 * len(a & b) >= similarity * len(a | b)):
                group[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            best[find(i)] = min(doc, best.get(find(i), doc))
    return sorted((doc, len(s), best.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def copies(rng, n, length, vocabulary, edits):
    base = [rng.choice(vocabulary) for _ in range(length)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(length)] = rng.choice(vocabulary)
        yield " ".join(words)


def table():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))) for _ in range(80)]
    for length, edits in ((200, 14), (60, 5), (25, 3), (9, 2), (4, 1)):
        texts += copies(rng, 50, length, vocabulary, edits)
    texts += ["", None, " \t\n", "one", "ONE", "one\x0bone", "a b", "A  B ", "É b", "é b", "a b c"]
    texts += texts[:10] * 3
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words", [2, 5])
@pytest.mark.parametrize("block", [1000, 7])
def test_against_all_pairs(spark, words, block, monkeypatch):
    monkeypatch.setattr(nd.grouped, "__defaults__", (block,))
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("own")).repartition(3)
    got = nd.near_duplicates(df, words=words).collect()
    assert sorted(map(tuple, got)) == brute(rows, words)


def test_repeated_and_missing_ids(spark):
    text = "the same few words in a text that is long enough"
    rows = [(5, text), (5, text), (3, text.upper()), (7, "other"), (7, "words"), (9, None)]
    df = spark.createDataFrame([*rows, (None, text), (None, "alone"), (None, None)], "doc_id long, text string")
    got = nd.near_duplicates(df).withColumn("kept", nd.is_kept()).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [
        (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True), (9, 9, True)
    ]
    assert sorted((str(r["component_id"]), r["kept"]) for r in got if r["doc_id"] is None) == [("3", False), ("None", True), ("None", True)]
    left = nd.drop_near_duplicates(df.withColumn("_x", F.lit(1))).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == [3, 7, 7, 9]
    assert sum(r["doc_id"] is None for r in left) == 3 and left[0]["_x"] == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(df).count() == 0
    assert nd.drop_near_duplicates(df).count() == 0
