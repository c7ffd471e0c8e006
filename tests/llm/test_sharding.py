"""The lookup table, and the split of large shards."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from kdframe.llm import sharding as sh


def brute(shards, slots):
    """Preference lists written out; shards take turns."""
    import hashlib

    lists = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        start, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        lists.append([(start + j * step) % slots for j in range(slots)])
        assert sorted(lists[-1]) == list(range(slots))
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(lists):
            if len(owner) < slots:
                owner[next(s for s in order if s not in owner)] = i
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize("n,slots", [(1, 2), (3, 7), (5, 101), (7, 211)])
def test_table_against_brute_force(n, slots):
    shards = [f"s{i}" for i in range(n)]
    assert sh.lookup_table(shards, slots) == brute(shards, slots)


def test_shares_are_even_and_stable():
    names = [f"shard-{i}" for i in range(50)]
    table = sh.lookup_table(names, 65_537)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sh.lookup_table(names[:-1], 65_537)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 49)
    assert moved < 0.1 * len(table)


@pytest.mark.parametrize("shards,slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(shards, slots):
    with pytest.raises(ValueError):
        sh.lookup_table(shards, slots)


def test_placement(spark, tmp_path):
    rows = [(i if i % 3 else 7, f"t{i}", "own") for i in range(600)] + [(None, "x", "own"), (None, None, "own")]
    df = spark.createDataFrame(rows, "key long, text string, _parts string")
    names = ["a", "b", "c"]
    placed = sh.assign_shards(df, ["key"], names, slots=211)
    table = sh.lookup_table(names, 211)
    got = placed.collect()
    assert len(got) == len(rows) and all(r["shard"] == names[table[r["slot"]]] for r in got)
    assert len({r["shard"] for r in got if r["key"] == 7}) == 1 and len({r["shard"] for r in got if r["key"] is None}) == 1
    split = sh.split_shards(placed, ["text"], F.lit(1), part_bytes=50)
    assert max(Counter((r["shard"], r["part"]) for r in split.collect()).values()) < 110
    assert all(r["_parts"] == "own" for r in split.collect())
    path = str(tmp_path / "out")
    sh.write_shards(split, path)
    assert spark.read.parquet(path).count() == len(rows)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_empty(spark):
    df = spark.createDataFrame([], "key long")
    assert sh.split_shards(sh.assign_shards(df, ["key"], ["a"], slots=7), ["key"], F.lit(1)).count() == 0


def test_clashing_columns(spark):
    names = ["_slot", "_shard", "_of", "_parts", "_part"]
    df = spark.createDataFrame([(i, i) for i in range(60)], "key long, Part long").withColumns({n: F.lit("own") for n in names})
    plain = sh.split_shards(sh.assign_shards(df.select("key"), ["key"], ["a", "b"], slots=7), ["key"], F.lit(1), part_bytes=9)
    want = {r["key"]: (r["slot"], r["shard"], r["part"]) for r in plain.collect()}
    taken = df.withColumns({"slot": F.lit("x"), "shard": F.lit("y")})
    for _ in range(2):  # the second time, results stand where the first ones stood
        taken = sh.split_shards(sh.assign_shards(taken, ["key"], ["a", "b"], slots=7), ["key"], F.lit(1), part_bytes=9)
        rows = taken.collect()
        assert {r["key"]: (r["slot"], r["shard"], r["part"]) for r in rows} == want
        assert all(r[n] == "own" for r in rows for n in names) and len(taken.columns) == 9
    by_taken = sh.assign_shards(df.withColumn("slot", F.col("key")), ["slot"], ["a", "b"], slots=7)
    assert {r["key"]: r["slot"] for r in by_taken.collect()} == {k: v[0] for k, v in want.items()}
