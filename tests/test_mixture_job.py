"""The mixture job against a plain restatement, and how often its wide rows travel."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kdframe.operators import adapters, mixture, ranking
from kdframe.operators.mixture import Source

SPEC = [
    Source("chat", 0.5, adapters.sharegpt, ("a", "b")),
    Source("tasks", 0.3, adapters.alpaca, ("id",)),
    Source("none", 0.2, adapters.qa, ("id",)),
]


@pytest.fixture
def given(spark):
    chat = [(i % 7, i, [("human", f"h{j}") for j in range(i % 4)]) for i in range(60)]
    turn = "array<struct<`from`:string,value:string>>"
    return {
        "chat": spark.createDataFrame(chat, f"a int, b int, conversations {turn}"),
        "tasks": spark.createDataFrame([(i, f"do {i}", "", f"done {i}") for i in range(9)], "id string, instruction string, input string, output string"),
        "none": spark.createDataFrame([], "id int, question string, answer string"),
    }


def restated(given, target):
    order = lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i)
    shards = []
    for line in SPEC:
        rows = {":".join(str(r[c]) for c in line.ids): r for r in given[line.name].collect()}
        n = len(rows) if target is None else min(int(target * line.weight), len(rows))
        kept = sorted(rows, key=order)[:n]
        if line.name == "chat":
            shards.append([[v for _, v in rows[i]["conversations"]] for i in kept if len(rows[i]["conversations"]) >= 2])
        else:
            shards.append([[rows[i]["instruction"], rows[i]["output"]] for i in kept])
    longest = max(map(len, shards))
    return sorted((r * 3 + s, SPEC[s].name, shard[r % len(shard)]) for r in range(longest) for s, shard in enumerate(shards) if shard)


@pytest.mark.parametrize("target", [None, 20, 45, 10_000])
def test_mix(spark, given, target):
    got = mixture.mix(given, SPEC, target)
    rows = [(r["out_pos"], r["source"], [t["value"] for t in r["conversations"]]) for r in got.collect()]
    assert sorted(rows) == restated(given, target)


def exchanged(df, column):
    """Exchanges that a column goes through."""
    plan = df._jdf.queryExecution().explainString(spark_mode(df))
    nodes = re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]\s*\nArguments: ([^\n]*)", plan)
    assert nodes
    return [arguments for columns, arguments in nodes if re.search(rf"\b{column}#", columns)]


def spark_mode(df):
    return df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")


def test_wide_rows_travel_once(spark, given, tmp_path):
    for name, df in given.items():
        df.write.parquet(str(tmp_path / name))
    stored = {name: spark.read.parquet(str(tmp_path / name)) for name in given}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exchanged(mixture.mix(stored, SPEC, 45), "conversations")
        # one exchange over the union of the sources
        assert len(found) == 1 and "hashpartitioning(source" in found[0]
        docs = spark.range(100).select(F.col("id").alias("doc"), F.lit("x").alias("source"), F.repeat(F.lit("t"), 9).alias("text"))
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
        placed = docs.select("doc", "source", F.col("doc").alias("place"))
        found = exchanged(mixture.interleave(placed, ["x"], "place", wide=docs, ids=["doc"]), "text")
        assert len(found) == 1 and "RoundRobin" not in found[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_short_shards_are_cycled_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixture, "REPEAT_CHUNK", 4)
    rows = [("a", i, i) for i in range(23)] + [("b", 0, 0), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "source string, id int, place int")
    wide = df.select("source", "id", F.concat("source", F.col("id").cast("string")).alias("text"))
    got = mixture.interleave(df, ["a", "b"], "place", wide=wide, ids=["id"]).select("out_pos", "text").collect()
    assert sorted(map(tuple, got)) == sorted([(2 * r, f"a{r}") for r in range(23)] + [(2 * r + 1, f"b{r % 2}") for r in range(23)])
    plain = mixture.interleave(df, ["a", "b"], "place").select("out_pos").collect()
    assert sorted(r[0] for r in plain) == list(range(46))


def test_buckets_follow_the_size(spark):
    small = spark.range(10)
    assert ranking.key_digits(small) == ranking.LEAST_DIGITS
    assert ranking.key_digits(spark.range(10**12)) > ranking.LEAST_DIGITS
    assert ranking.key_digits(spark.range(10**18)) == ranking.MOST_DIGITS
