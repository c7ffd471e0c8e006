"""Packing: exact round trip of token ids, and little padding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kdframe.llm import packing

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
TOKENIZER = Tokenizer.from_file(FILES[0])

ODD = [
    None,
    "",
    " ",
    "a <|endoftext|> b",
    "tabs\t\tand\r\n\r\n  lines  \x0b\x0c\x85\xa0 x y　z",
    "日本語 ελληνικά русский العربية हिन्दी 😀 é ①²½Ⅷ",
    "'s 'S don't I'LL 12ab3 _a__b  !!??",
    "x" * 5000 + " " * 3000 + "1" * 2000 + "\n" * 2000 + "?!" * 900,
    "ȿ ɏ ɐ ­ soft “quoted” – dash … €5    ",
]


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def docs():
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice(["some", "wörter", "in", "text,", "énd.\n"]) for _ in range(rng.randrange(2500)))) for i in range(150)]
    return [*rows, rows[-1], (None, "no id"), (7777, "again " * 1023)]


def check(rows, pieces):
    want = sorted((str(i), tuple(ids_of(t))) for i, t in rows)
    by_doc = {}
    for p in pieces:
        assert p["length"] == len(p["ids"]) > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        by_doc.setdefault(str(p["doc_id"]), []).append(p)
    got = []
    for doc, own in by_doc.items():
        copies = sum(1 for d, _ in want if d == doc)
        own.sort(key=lambda p: (p["start"], p["length"]))
        assert sum(p["length"] for p in own) == copies * own[0]["doc_tokens"]
        if copies == 1:
            assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
            got.append((doc, tuple(i for p in own for i in p["ids"])))
    single = [w for w in want if sum(1 for d, _ in want if d == w[0]) == 1]
    assert sorted(got) == single
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 1024
    return sequences


@pytest.mark.parametrize("ranks", [FILES[1], None])
@pytest.mark.parametrize("group_items", [2048, 40])
def test_round_trip(spark, ranks, group_items):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    pieces = [r.asDict() for r in packing.pack(packing.tokenize(df, FILES[0], ranks), group_items=group_items).collect()]
    sequences = check(rows, pieces)
    total = sum(len(ids_of(t)) for _, t in rows)
    groups = 1 if group_items == 2048 else 6
    assert len(sequences) <= -(-total // 1024) + groups


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.tokenize(df, *FILES)).count() == 0


def test_differencing_is_balanced():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 400)
    window = packing.differencing(sizes, 20)
    sums = np.bincount(window, weights=sizes, minlength=20)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 3
    # the textbook case: 8, 7, 6, 5, 4 in two windows differ by 2
    sums = np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert abs(sums[0] - sums[1]) == 2


@pytest.mark.parametrize("windows", [1, 2, 7, 60, 500])
def test_differencing_covers_all_items(windows):
    rng = np.random.default_rng(windows)
    sizes = rng.integers(1, 256, 300)
    window = packing.differencing(sizes, windows)
    assert window.min() >= 0 and window.max() < windows and len(window) == 300
    sums = np.bincount(window, weights=sizes, minlength=windows)
    if windows <= 60:
        assert sums.max() - sums.min() <= sizes.max()
    else:
        assert sums.max() == sizes.max()


def test_window_count_rises(monkeypatch):
    counts = []
    given = packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda sizes, n: counts.append(n) or given(sizes, n))
    # three items of 6 need 18 of 2 * 9, but no two fit in a window of 9
    pieces = packing.fill(np.array([6, 6, 6]), 9, cut=9)
    assert counts == [2, 3] and sorted(p[3] for p in pieces) == [0, 1, 2]
    counts.clear()
    # parts of 3 fit in two windows at once
    pieces = packing.fill(np.array([6, 6, 6]), 9, cut=3)
    assert counts == [2] and sum(p[2] for p in pieces) == 18


def test_parts_are_whole_and_windows_nearly_full():
    rng = np.random.default_rng(3)
    rose = 0
    for _ in range(40):
        lengths = rng.integers(1, 1024, rng.integers(1, 400))
        pieces = packing.fill(lengths, 1024)
        used = {}
        covered = [0] * len(lengths)
        for item, start, size, at, offset in sorted(pieces, key=lambda p: (p[0], p[1])):
            assert start == covered[item] and 0 < size
            covered[item] += size
            used.setdefault(at, []).append((offset, size))
        assert covered == lengths.tolist()
        for places in used.values():
            places.sort()
            assert [a for a, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
            assert sum(n for _, n in places) <= 1024
        least = -(-int(lengths.sum()) // 1024)
        rose += len(used) > least
        assert len(used) <= least * 1.05 + 1
    assert rose
    assert packing.fill(np.array([1]), 1024) == [(0, 0, 1, 0, 0)]
