"""Texts put together from runs of deltas, and the stream's state calls."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kdframe.streaming import flows

KIND = "request_id long, seq long, delta string"


def brute(rows):
    """Deltas in order of place and text, up to the first stop, which comes before the texts of its place."""
    found = {}
    for request in {r for r, _, _ in rows}:
        own = [(s is not None, s or 0, "" if d in flows.STOPS else d or "", d in flows.STOPS) for r, s, d in rows if r == request]
        text = ""
        for _, _, delta, stopped in sorted(own):
            if stopped:
                break
            text += delta
        found[request] = text
    return {k: v for k, v in found.items() if v}


@pytest.mark.parametrize("part", [4, 4096])
def test_deltas_in_any_order_and_repeated(spark, monkeypatch, part):
    monkeypatch.setattr(flows, "PART_CHUNKS", part)
    rng = random.Random(part)
    rows = []
    for request in [*range(12), None]:
        own = [(request, i, rng.choice(["é", " ab", "", None, "x", "日本"])) for i in range(rng.randrange(1, 30))]
        own += rng.sample(own, len(own) // 2) if request and request % 3 == 0 else []
        own += [(request, 5, "<|endoftext|>"), (request, 5, "a")] if request and request % 4 == 1 else []
        own += [(request, None, "n"), (request, None, "m")] if request == 2 else []
        own += own if request == 7 else []
        if request and request % 2:
            rng.shuffle(own)
        rows += own
    df = spark.createDataFrame(rows, KIND).repartition(3) if part == 4 else spark.createDataFrame(rows, KIND).coalesce(1)
    assert {r["request_id"]: r["text"] for r in flows.final_text(df).collect()} == brute(rows)


def test_deltas_in_line_are_one_row(spark):
    rows = spark.range(3000).coalesce(1).select((F.col("id") / 1000).cast("long").alias("request_id"), (F.col("id") % 1000).alias("seq"), F.lit(" w").alias("delta"))
    assert flows.delta_runs(rows).count() == 3
    assert {r["n"] for r in flows.final_text(rows).select(F.length("text").alias("n")).collect()} == {2000}


class State:
    def __init__(self, calls):
        self.value, self.calls = None, calls

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "update":
                self.value = args[0]
            return {"exists": self.value is not None, "get": self.value, "containsKey": False}.get(name)

        return call


def test_a_new_request_in_line_makes_few_state_calls():
    calls = []

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return State(calls)

        getMapState = getValueState  # noqa: N815

        def registerTimer(self, _):  # noqa: N802
            calls.append("registerTimer")

    request = flows.Assembly(1000)
    request.init(Handle())
    ts = pd.Timestamp("2024-01-01")
    batch = pd.DataFrame({"seq": [0, 1, 2], "delta": ["a", None, "b"], "ts": [ts] * 3})
    (out,) = request.handleInputRows((1,), iter([batch]), None)
    assert out.values.tolist() == [[1, 2, "ab", 2, False, False]]
    assert sorted(calls) == ["exists", "registerTimer", "update", "update"]
