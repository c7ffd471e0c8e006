"""Pairs of lines near the limit of similarity, against brute force over edit distances alone."""

import random

import numpy as np
import pytest
from test_line_dedup import distance

from kdframe.llm import line_dedup as ld


def letters(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.6:
            words[at] = letters(rng)
        elif kind < 0.8:
            words.insert(at, letters(rng))
        elif len(words) > 1:
            del words[at]
    return words


def pairs():
    rng = random.Random(80)
    vocabulary = [letters(rng) for _ in range(2000)]
    for size in (5, 6, 9, 12, 20, 35, 60, 120, 200):
        for share in (0.02, 0.05, 0.1, 0.15, 0.2, 0.23):
            for _ in range(4):
                words = [vocabulary[int(2000 * rng.random() ** 3)] for _ in range(size)]
                yield words, edited(words, max(1, int(size * share)), rng)


def test_all_pairs_above_the_limit_are_found(spark):
    rows, close = [], []
    for a, b in pairs():
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
        close.append(5 * distance(a, b) <= max(len(a), len(b)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    removed = {r["doc_id"] for r in ld.dedup_lines(df, complete=True, removed_col="n").where("n > 0").collect()}
    assert [2 * i + 1 in removed for i in range(len(close))] == close
    assert sum(close) > 120 and not all(close)
    # the SimHash blocks alone lose many of them
    alone = {r["doc_id"] for r in ld.dedup_lines(df, complete=False, removed_col="n").where("n > 0").collect()}
    assert alone < removed and len(alone) < 0.7 * len(removed)


@pytest.mark.parametrize("members", [ld.BUCKET_MEMBERS, 2])
def test_groups_against_brute_force(spark, monkeypatch, members):
    import test_line_dedup

    monkeypatch.setattr(test_line_dedup, "share_blocks", lambda a, b: True)
    monkeypatch.setattr(ld, "BUCKET_MEMBERS", members)
    rows = test_line_dedup.table()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ld.dedup_lines(df, complete=True, removed_col="n").select("doc_id", "text", "n").collect()
    assert sorted(map(tuple, got)) == test_line_dedup.brute(rows)


def test_nets_in_parts(monkeypatch):
    rng = random.Random(3)
    parts = [" ".join(letters(rng) for _ in range(rng.randrange(1, 30))) for _ in range(50)]
    rarity = np.zeros(ld.COUNT_SLOTS, dtype=np.uint64)
    whole = ld.digests(parts, rarity=rarity)[3].to_pylist()
    monkeypatch.setattr(ld, "NET_UNITS", 7)
    assert ld.digests(parts, rarity=rarity)[3].to_pylist() == whole
    assert [len(x["keys"]) for x in whole] == [x["n"] // 5 + 1 if x["n"] > 3 else 0 for x in whole]
