import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kdframe.llm import substrings as ss


def brute(rows, window):
    """doc_id, n_words, n_removed and digest, from the windows of all documents."""
    words = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1) if d is not None else ():
            at = tuple(w[i : i + window])
            least[at] = min(d, least.get(at, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def passages(rng, size, words=200):
    return [f"w{int(words * rng.random() ** 2)}" for _ in range(size)]


def corpus(rng, shared=6):
    """Texts with shared passages, near copies, runs of one word and copies."""
    common = [passages(rng, rng.randrange(8, 70)) for _ in range(shared)]
    rows = []
    for d in rng.sample(range(1000), 60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += passages(rng, rng.randrange(0, 30)) + (rng.choice(common) if rng.random() < 0.7 else ["so"] * rng.randrange(40))
        if rows and rng.random() < 0.3:
            words = rng.choice(rows)[1].split()
            words[rng.randrange(len(words) + 1) :][:1] = ["new"]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(words) or "x"))
    return rows


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ss.repeated_passages(df, **options).withColumn("told", ss.digest("text"))
    return sorted(map(tuple, found.select("doc_id", "told.n_words", "told.n_removed", "told.kept_sha256").collect()), key=str)


@pytest.mark.parametrize("window, group", [(12, 50_000), (12, 40), (5, 1), (50, 50_000), (1, 100)])
def test_against_brute_force(spark, window, group):
    rng = random.Random(window * group)
    rows = corpus(rng)
    rows += [(None, rows[0][1]), (2000, None), (2001, ""), (2002, " \n"), rows[1], rows[1], (rows[2][0], rows[3][1])]
    expected = brute(rows, window)
    assert result(spark, rows, window=window, group=group) == expected
    if window > 1:
        assert 0 < sum(r[2] > 0 for r in expected) < len(rows)


def test_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    body = passages(rng, 900, 10_000)
    rows = [(1, " ".join(body)), (2, " ".join(passages(rng, 77) + body[100:700] + ["é"] + body[701:])), (3, "a " * 700), (4, "a " * 500)]
    hashes = [ss.word_hashes(t) for _, t in rows]
    monkeypatch.setattr(ss, "PART_BYTES", 100)
    assert all((ss.word_hashes(t) == h).all() for (_, t), h in zip(rows, hashes))
    assert result(spark, rows) == brute(rows, 50)
    rolling, whole = ss.Rolling(), np.concatenate(hashes)
    monkeypatch.setattr(ss, "CHUNK", 64)
    starts = [np.repeat(a, n) + np.concatenate([np.arange(x) for x in n]) for _, _, a, n in ss.segments_of(whole, 50, rolling)]
    assert np.concatenate(starts).tolist() == list(range(len(whole) - 49))


def test_subtrees():
    suffixes = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 4], [5, 2, 3], [1, 2, 3]])
    alive, node = ss.deep_nodes(np.array([0, 0, 0, 0, 1]), 3, lambda which, at: suffixes[which, at])
    assert alive.tolist() == [0, 1] and len(set(node.tolist())) == 1


def test_drop_and_clashing_columns(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, f"x {a}", 0, 0, 0), (2, f"{a}\ny  z", 0, 0, 0), (3, "keep  this\n", 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long, row long, _passages long")
    got = ss.drop_passages(df)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: f"x {a}", 2: "y z", 3: "keep  this\n"}
    assert ss.drop_passages(df.limit(0)).collect() == []
    other = df.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))
    assert {r["id"]: r["body"] for r in ss.drop_passages(other, id_col="id", text_col="body").collect()}["2"] == "y z"
