"""Benchmark passages against brute force over word windows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kdframe.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, ids = WORD.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if found := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    ids |= found
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def result(df):
    rows = df.select(
        "doc_id",
        "hits.n_words",
        dc.n_hit(),
        F.size("hits.items"),
        F.sha2(F.array_join("hits.items", ","), 256),
        dc.is_contaminated(),
    ).collect()
    return sorted(map(tuple, rows), key=str)


def cases():
    rng = random.Random(3)
    words = ["aa", "Bb", "c1", "é", "dd"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 5, 12, 13, 14, 30, 60]))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "?!"), (None, text(14)), (0, items[0][1]), (93, items[7][1])]
    docs = [(i, text(rng.randrange(0, 80))) for i in range(60)]
    for i in range(60):
        item = rng.choice(items)[1] or ""
        docs.append((100 + i, text(rng.randrange(300)) + " zz " + item.upper() + " yy " + text(rng.randrange(9))))
    return [*docs, (200, None), (201, ""), (202, " .. "), (None, text(20)), docs[0], (203, items[5][1] * 400)], items


@pytest.mark.parametrize("block_words", [500_000, 90])
@pytest.mark.parametrize("short", [True, False])
def test_against_brute_force(spark, block_words, short):
    docs, items = cases()
    if not short:
        items = [x for x in items if len(WORD.findall(x[1] or "")) >= 13]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits_n", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    assert result(dc.find_hits(d, b, block_words=block_words)) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert dc.find_hits(d.limit(0), b).count() == 0
    assert result(dc.find_hits(d, b.limit(0))) == brute(docs, [])


def test_removal(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    filler = " ".join(f"x{i}" for i in range(400))
    rows = [(1, f"{filler} [{passage}] end."), (2, f"short {passage}"), (3, filler), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hits", F.lit("own"))
    b = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = dict(dc.decontaminate(d.drop("_hits"), b).select("doc_id", "text").collect())
    assert got == {1: f"{filler} [] end.", 3: filler, 4: None}


@pytest.mark.parametrize("block_words", [500_000, 90])
def test_clashing_columns(spark, block_words):
    docs, items = cases()
    names = ["key", "hit", "spans", "items", "_key", "_spans", "_items", "_hits", "item", "words"]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit("own") for n in names})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({n: F.lit("own") for n in names})
    found = dc.find_hits(d.withColumn("hits", F.lit("old")), b, block_words=block_words)
    assert result(found) == brute(docs, items)
    assert all(r[n] == "own" for r in found.collect() for n in names)
    kept = dc.decontaminate(d, b, block_words=block_words)
    assert kept.columns == d.columns and all(r[n] == "own" for r in kept.collect() for n in names)
    assert sorted(kept.select("doc_id").toPandas()["doc_id"].dropna()) == sorted(r[0] for r in brute(docs, items) if not r[5] and r[0] is not None)


def test_blocks_are_bounded_and_hold_every_window(spark):
    rng = random.Random(8)
    items = [(str(i), " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 5, 13, 40, 5000])))) for i in range(300)]
    n, dealt = dc.blocks(spark.createDataFrame(items, "item string, words string"), 20_000)
    got = list(dealt)
    assert n == len(got) > 5 and max(sum(len(w) for _, w in b) for b in got) <= 25_000

    def windows(sequences):
        return {(i, tuple(w[k : k + 13])) for i, w in sequences for k in range(max(1, len(w) - 12))}

    assert windows(p for b in got for p in b) == windows((i, dc.words_of(t)) for i, t in items)
