"""Measures and verdicts of the quality rules against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kdframe.llm import quality_rules as qr

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(11)
    few = ["a", "b", "é😀", "c#", "$$", "<d>", "x\xa0y"]
    found = ["".join(rng.choice(few) + rng.choice([" ", "\n", "  ", "\t", "\r\n", "\x0b"]) for _ in range(rng.randrange(120))) for _ in range(200)]
    many = [f"word{i}" for i in range(400)]
    found += [" ".join(rng.choice(many) for _ in range(rng.randrange(60, 300))) for _ in range(50)]
    return [*found, None, "", " \n ", "a", "a b", "a a a", "a a a a", " lead", "trail ", "x " * 5000, found[0]]


def test_measures(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit("own"), "lines": F.lit(1)})
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = qr.apply_rules(df).select("doc_id", *names, "kept", "words").collect()
    assert {r[0]: tuple(r[1:7]) for r in got} == {i: brute(t) for i, t in rows}
    assert all(not (r["base_failed"] and r["kept"]) for r in got)
    assert sum(r["kept"] for r in got) >= 50 and all(r["words"] == "own" for r in got)


def test_verdicts(spark):
    clean = " ".join(f"Clean{i} wordings" for i in range(40)) + "."
    rows = {
        "clean": clean,
        "few words": "too short",
        "symbols": clean.replace(" ", "#$ "),
        "repeated lines": "\n".join([*clean.split(". ")] + ["same line here"] * 4),
        "few letters": " ".join(f"{i} {i * 7}" for i in range(1000, 1060)),
        "exclamations": clean.replace(" ", "!! "),
        "bullets": "\n".join(f"- point{i} of{i} ten" for i in range(20)),
        "ellipses": "\n".join(f"point{i} of{i} ten and..." for i in range(20)),
        "word length": " ".join(f"{'long' * 5}{i}" for i in range(60)),
    }
    df = spark.createDataFrame(list(rows.items()), "doc_id string, text string")
    # in the order of the list; a text can fail several rules
    got = {r["doc_id"]: r["failed_rule"] for r in qr.cascade(qr.measures(df), qr.RULES).collect()}
    assert got == {name: None if name == "clean" else name for name in rows}


def test_order_is_by_rejections_per_cost(spark):
    df = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string")
    slow = qr.Rule("never", lambda c: F.lit(False))
    quick = qr.Rule("always", lambda c: F.lit(True))
    assert [r.name for r in qr.ordered(df, [slow, quick])] == ["always", "never"]


def test_cost_includes_the_measures(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(3000))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dear = qr.Rule("dear", lambda c: c("n_repeat_words") >= 0)
    cheap = qr.Rule("cheap", lambda c: c("n_symbols") >= 0)
    assert [r.name for r in qr.ordered(df, [dear, cheap])] == ["cheap", "dear"]


def test_sample_comes_from_the_whole_table(spark):
    # the first half of the table never fails, the second always
    df = spark.range(0, 20_000, numPartitions=8).select(F.when(F.col("id") < 10_000, "a").otherwise("b").alias("text"))
    second = qr.Rule("second", lambda c: c("plain") == "b")
    never = qr.Rule("never", lambda c: F.lit(False))
    assert [r.name for r in qr.ordered(df, [never, second])] == ["second", "never"]


@pytest.mark.parametrize("rules", [qr.RULES, qr.RULES[::-1]])
def test_order_does_not_change_verdicts(spark, rules):
    df = qr.measures(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string"))
    kept = [r[0] for r in qr.cascade(df, rules).where("failed_rule is null").select("doc_id").orderBy("doc_id").collect()]
    assert kept == [r[0] for r in qr.cascade(df, qr.RULES).where("failed_rule is null").select("doc_id").orderBy("doc_id").collect()]


def test_plan_is_native(spark):
    df = qr.apply_rules(spark.createDataFrame([], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and df.count() == 0
