"""Language identification: held-out accuracy, and results that don't depend on the batch."""

import random

import numpy as np
from pyspark.sql import functions as F

from kdframe.llm import language

ALPHABETS = {"aa": "abcdeé", "bb": "cdefgü", "cc": "efghñ", "zz": "αβγδε"}


def text(rng, label, n):
    return " ".join("".join(rng.choice(ALPHABETS[label]) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def rows():
    rng = random.Random(2)
    found = [(i, text(rng, label, rng.randrange(5, 60)), label) for i in range(400) for label in [rng.choice(list(ALPHABETS))]]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 .. 3", "cc"), (1003, "abc", None), (None, "αβγ δε", "aa")]
    return found + odd + found[:3]


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    held = F.coalesce(language.fold("doc_id") == 2, F.lit(False))
    model = language.fit(df.where(~held))
    assert model.languages == sorted(ALPHABETS)
    got = df.withColumn("found", language.predictor(df, model)("text")).withColumn("held", held).collect()
    assert len(got) == len(rows())
    usual = [r for r in got if r["held"] and r["doc_id"] < 1000]
    assert len(usual) > 50 and np.mean([r["found"]["lang_pred"] == r["lang"] for r in usual]) > 0.98
    assert all(0 <= r["found"]["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r["found"]["lang_pred"] for r in got if r["doc_id"] is None or r["doc_id"] >= 1000}
    assert odd[1000] == odd[1001] == odd[1002] == "und"
    assert odd[1003] in ALPHABETS and odd[None] == "zz"


def test_fold_is_the_checksum_of_the_id_as_text(spark):
    import zlib

    got = spark.range(50).select("id", language.fold("id").alias("fold")).collect()
    assert all(r["fold"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)


def test_scores_do_not_depend_on_the_batch():
    rng = random.Random(4)
    matrix = np.random.default_rng(0).integers(-40000, 0, (3, 1 << 10)).astype(np.int32)
    model = language.Model(["x", "y", "z"], matrix)
    texts = [text(rng, "aa", rng.randrange(0, 30)) for _ in range(50)] + ["a", "É", None, "..", "q" * 50]
    assert model.predict(texts) == [model.predict([t])[0] for t in texts]
    long = text(rng, "bb", 400_000)
    assert len(long) > language.PART and model.predict([long, "b"])[0] == model.predict([long])[0]


def test_long_texts_are_scored_whole(monkeypatch):
    rng = random.Random(4)
    matrix = np.random.default_rng(0).integers(-40000, 0, (2, 1 << 10)).astype(np.int32)
    model = language.Model(["x", "y"], matrix)
    sample = text(rng, "cc", 300).replace(" ", "")
    whole = model.predict([sample])
    found = sum(len(language.ngrams(batch, 1 << 10)[0]) for _, batch in language.parts([sample]))
    monkeypatch.setattr(language, "PART", 97)
    cut = list(language.parts([sample]))
    assert "".join(t[:97] for _, b in cut for t in b[:]) .startswith(sample[:97]) and len(cut) > 5
    assert found > 0 and model.predict([sample])[0][0] == whole[0][0]


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.languages == []
    assert {r[0]["lang_pred"] for r in df.select(language.predictor(df, model)("text")).collect()} == {"und"}
    assert language.fit(df.limit(0)).languages == []
