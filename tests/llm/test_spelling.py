import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kdframe.llm import spelling as sp


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def counted(rows, thinned=31, shortest=7, least=2):
    """The contract's words, one run after the other."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if h % thinned == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def brute(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], counts.get(form[w]), root))
    return sorted(out)


def table(rng):
    """Words with chains of variants, of letters inside and outside of ASCII."""
    letters = "abcdeéüÿ×"
    rows = []
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 11)))
        n = rng.choice([1, 2, 30, 400])
        while n >= 1:
            rows += [word] * int(n)
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:at] + ("" if kind == 0 else rng.choice(letters)) + word[at + (kind < 2) :]
            n /= rng.choice([9, 10, 11, 14])
    rng.shuffle(rows)
    texts = []
    while rows:
        k = rng.randrange(1, 40)
        texts.append((len(texts), rng.choice([" ", "-", "Ā", "1"]).join(w.upper() if rng.random() < 0.2 else w for w in rows[:k])))
        rows = rows[k:]
    return texts


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sp.variants(sp.count_words(df, thinned=31), **options)
    return sorted(map(tuple, found.select("word", "n", "n_near", "form", "form_n", "root").collect()))


@pytest.mark.parametrize("symbols", [sp.SYMBOLS, 2, 1])
def test_against_brute_force(spark, symbols, monkeypatch):
    monkeypatch.setattr(sp, "COUNTED_AT_ONCE", 50)
    rng = random.Random(11)
    rows = [*table(rng), (None, "abcdefgh"), (5000, None), (5001, ""), (5002, "the 1 2")]
    rows += rows[:3]
    expected = brute(counted([("" if d is None else d, t) for d, t in rows]))
    assert result(spark, rows, symbols=symbols) == expected
    assert any(r[5] not in (r[0], r[3]) for r in expected) and any(r[3] is None and r[2] for r in expected)


def test_neighbourhood_is_full():
    reduced = sp.Reduced(3)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    reduced.read(words)
    symbol = [tuple(reduced.symbol[b : b + n]) for b, n in zip(reduced.begin, reduced.size)]
    got = [set() for _ in words]
    for owner, key in reduced.neighbours():
        for i, k in zip(owner, key.tolist()):
            got[i].add(k)

    def key(x):
        total = sum(int(reduced.values[s]) * pow(int(sp.BASE), i, 1 << 64) for i, s in enumerate(x)) % (1 << 64)
        return int(reduced.finished(np.array([total], dtype=np.uint64), np.array([len(x)]))[0])

    for s, found in zip(symbol, got):
        near = {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}
        near |= {s[:i] + (c,) + s[i + 1 :] for i in range(len(s)) for c in range(3)}
        near |= {s[:i] + (c,) + s[i:] for i in range(len(s) + 1) for c in range(3)}
        assert found == {key(x) for x in near}


def test_small_cases(spark, monkeypatch):
    monkeypatch.setattr(sp, "CELLS_AT_ONCE", 100)
    long = "ab" * 3000
    rows = [(1, f"{long} {long} {long}c {long}c"), (2, "İstanbul İstanbul")]
    assert result(spark, rows) == brute(counted(rows))
    assert {r[0] for r in result(spark, rows)} >= {"stanbul"}
    assert result(spark, rows[:0]) == []
    vocabulary = spark.createDataFrame([("reading", 100, 1), ("reeding", 100, 2), ("reding", 10, 3)], "word string, n long, root int")
    got = {r["word"]: (r["form"], r["n_near"], r["root"]) for r in sp.variants(vocabulary).collect()}
    assert got == {"reading": (None, 2, "reading"), "reeding": (None, 2, "reeding"), "reding": ("reading", 2, "reading")}
