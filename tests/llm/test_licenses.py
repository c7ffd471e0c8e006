"""Licence matches against brute force."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from kdframe.llm import licenses as lc


def grams(text):
    words = lc.normal_words(text or "")
    return {(a, b) for a, b in zip(words, words[1:])} or {(w,) for w in words}


def best(unit, number, run=0):
    found = []
    for name, text in lc.TEMPLATES.items():
        a, b = grams(unit), grams(text)
        dice = 2.0 * len(a & b) / (len(a) + len(b)) if a else 0.0
        if dice >= 0.8:
            found.append((-dice, name))
    return [(-min(found)[0], min(found)[1], number, run)] if found else []


def brute(text):
    text = text or ""
    lines = text.split("\n")
    found = best(text, 0) + ([m for i, line in enumerate(lines, 1) for m in best(line, i)] if len(lines) > 1 else [])
    parts = [[]]
    for line in lines[:-1]:
        # a blank line ends a paragraph; the first and the last line of a text have no line break on one side
        if line.strip(" \t\r") or not any(parts):
            parts[-1].append(line)
        elif parts[-1]:
            parts.append([])
    parts[-1].append(lines[-1])
    for at in range(len(parts)):
        for run in range(1, min(6, len(parts) - at) + 1):
            if run < len(parts) and (run > 1 or len(parts[at]) > 1):
                found += best("\n".join(x for p in parts[at : at + run] for x in p), at + 1, run)
    return found


def texts():
    rng = random.Random(12)
    found = []
    for name, text in lc.TEMPLATES.items():
        words = text.split()
        for _ in range(25):
            own = [w if rng.random() > 0.06 else rng.choice(words + ["other", "the"]) for w in words]
            own = own[rng.randrange(3) : len(own) - rng.randrange(3)]
            unit = " ".join(own if rng.random() > 0.2 else [w.upper() for w in own])
            rest = "\n".join(rng.choice(["some prose here", "", "the software license", unit, "License"]) for _ in range(rng.randrange(4)))
            found.append(rng.choice([unit, unit + "\n" + rest, rest + "\n" + unit, unit + " " + rest]))
    return [*found, None, "", "\n", "license", "reserved", "all", "word " * 5000]


def wrapped(name, mark="# ", breaks=()):
    """A licence at 76 columns behind comment marks, with code before and after it."""
    text = " ".join(lc.TEMPLATES[name].split())
    for b in breaks:
        text = text.replace(b, "\0" + b)
    block = "\n\n".join("\n".join(mark + x for x in textwrap.wrap(part, 76)) for part in text.split("\0"))
    return f"#!/usr/bin/env python\n\n{mark}Copyright 2020 Some Author\n{block}\n \t\n\nimport os\n\n\ndef main():\n    return os.getcwd()\n"


WRAPPED = [("apache-2.0-header", "# ", ("Unless",)), ("gpl-3.0-header", "// ", ("You should", "This program is d")), ("mpl-2.0", " * ", ())]
WRAPPED += [("mit-full", "", ("The above", "THE SOFTWARE")), ("bsd-3-clause-full", "", ("1. ", "2. ", "3. ", "THIS SOFTWARE"))]


def test_wrapped_notices_above_code_are_found(spark):
    df = spark.createDataFrame([(name, wrapped(name, mark, breaks)) for name, mark, breaks in WRAPPED], "name string, text string")
    got = {r["name"]: {m["license"] for m in r["licenses"] if m["paragraphs"]} for r in lc.find_licenses(df).collect()}
    assert all(name in found for name, found in got.items()), got


def test_many_blank_lines(spark):
    text = "license\n" + "\n" * 200_000 + wrapped("mit-full") + " \n" * 100_000 + "x\n\n" * 20_000
    got = lc.find_licenses(spark.createDataFrame([(text,)], "text string")).first()["licenses"]
    assert {m["license"] for m in got} >= {"mit-full"}


def test_against_brute_force(spark):
    rows = list(enumerate(texts() + [wrapped(*x) for x in WRAPPED] + [wrapped("mit-full").replace("\n\n", "\n \n\n"), "\n\nlicense\n\n", "a\n\n"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("own") for n in ("license", "_words", "_anchored")})
    rows_found = lc.find_licenses(df).collect()
    assert all(r[n] == "own" for r in rows_found for n in ("license", "_words", "_anchored"))
    got = {r["doc_id"]: [tuple(m) for m in r["licenses"]] for r in rows_found}
    want = {i: brute(t) for i, t in rows}
    assert {i: [(round(d, 9), *m) for d, *m in ms] for i, ms in got.items()} == {i: [(round(d, 9), *m) for d, *m in ms] for i, ms in want.items()}
    assert sum(map(len, want.values())) > 150


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_anchors_cover_all_sets_that_reach_the_threshold(threshold):
    rng = random.Random(1)
    for text in lc.TEMPLATES.values():
        own = lc.template_bigrams(text)
        anchor = lc.anchors(own, threshold)
        low, high = lc.bounds(len(own), threshold)
        for _ in range(300):
            kept = rng.sample(own, rng.randrange(len(own) + 1))
            extra = rng.randrange(5)
            size = len(kept) + extra
            if size and 2 * len(kept) / (size + len(own)) >= threshold:
                assert low <= size <= high and any(not anchor.isdisjoint(g.split()) for g in kept)


def test_plan_is_native(spark):
    df = lc.find_licenses(spark.createDataFrame([], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and df.count() == 0
