"""Weak supervision: recovered accuracies, held-out accuracy, defined cases."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kdframe.llm import quality_model as qm

DATA = "/root/testdata/sf0.01"


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65])
    votes = np.where(rng.random((20_000, 7)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = qm.estimate(patterns, counts.astype(float))
    assert np.abs(model.accuracies() - right).max() < 0.03 and abs(model.prior[1] - 0.8) < 0.03
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95


def test_nothing_to_estimate():
    model = qm.estimate(np.empty((0, 7), dtype=int), np.empty(0))
    assert np.isfinite(model.posterior(np.zeros((1, 7), dtype=int))).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_accuracy_on_labels_that_it_never_saw(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    got = qm.classify(docs.select("doc_id", "text")).join(labels, "doc_id").collect()
    assert np.mean([r["good"] == (r["quality"] == 1) for r in got]) > 0.93
    bad = [r for r in got if r["quality"] == 0]
    assert np.mean([not r["good"] for r in bad]) > 0.7


def test_defined_cases(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["several", "plain", "words", "in", "order"]) + str(i) * 0 for i in range(40)) + "." for _ in range(20)]
    bad = ["$$ ## !! " * 20 for _ in range(10)]
    rows = list(enumerate([*good, *bad, None, "", " \n", "x", good[0], "word " * 50_000])) + [(None, good[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"votes": F.lit("own"), "_scores": F.lit("own"), "good": F.lit("old")})
    got = {(r["doc_id"], i): r for i, r in enumerate(qm.classify(df).collect())}
    assert len(got) == len(rows) and all(r["votes"] == r["_scores"] == "own" for r in got.values())
    empty = [r for r in got.values() if r["doc_id"] in (30, 31, 32)]
    assert all(r["quality_score"] == 0 and r["weak_score"] == 0 and not r["good"] for r in empty)
    assert all(0 <= r["quality_score"] <= 1 for r in got.values())
    assert qm.classify(df.limit(0)).count() == 0
