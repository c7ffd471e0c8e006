"""Disk, memory and candidates of line dedup, on small tables."""

import random
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from kdframe.llm import line_dedup as ld
from kdframe.llm.common import SLICE_BYTES, bounded_batches
from kdframe.session import SHUFFLE_CLEANUP, materialize


def shuffle_files(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    return sum(1 for folder in manager.localDirs() for _ in Path(folder.toString()).glob("*/shuffle_*.data"))


def test_a_written_table_keeps_no_shuffle_files(spark):
    spark.conf.unset(SHUFFLE_CLEANUP)
    before = shuffle_files(spark)
    table = materialize(spark.range(5000).groupBy((F.col("id") * 7 % 1000).alias("k")).count())
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert table.count() == 1000
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"


def test_batches_of_long_texts_are_bounded(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        bounded_batches(spark)

        def sizes(batches):
            for batch in batches:
                yield batch.select([]).from_arrays([ld.pa.array([batch.nbytes])], names=["n"])

        texts = spark.range(5000).coalesce(1).select(F.repeat(F.lit("x"), 5000).alias("text"))
        found = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
        assert len(found) > 1 and max(found) < 2 * SLICE_BYTES
    finally:
        spark.conf.set(setting, before)


def test_values_are_those_of_the_normal_form():
    parts = ["One, two three", "", "12 34 12", "one TWO three!", "é b", "two two", " "]
    got = ld.valued(parts).to_pylist()
    assert [len(x["words"]) for x in got] == [len(ld.normal(p)) for p in parts]
    assert got[0] == got[3] and got[2]["words"][0] == got[2]["words"][2]
    assert all(x["sketch"] == ld.sketch(x["words"]) for x in got)
    assert ld.differing_bits([got[5]["sketch"]], [got[1]["sketch"]])[0] == 2


def test_long_lines_that_differ_are_no_candidates(spark):
    rng = random.Random(4)
    words = [[f"rare{i // 20}", *(rng.randrange(10**6) for _ in range(200))] for i in range(60)]
    words += [[*w[:150], "other", *w[151:]] for w in words[:5]]
    parts = [" ".join(w if isinstance(w, str) else "w" + "".join(chr(97 + int(c)) for c in str(w)) for w in line) for line in words]
    rarity = np.full(ld.COUNT_SLOTS, 100, dtype=np.uint64)
    net = ld.digests(parts, rarity=rarity)[3].to_pylist()
    # all lines of one bucket
    rows = [(i, i, {**x, "keys": [1 << 32]}, v["sketch"][: ld.WIDE_BYTES]) for i, (x, v) in enumerate(zip(net, ld.valued(parts).to_pylist()))]
    nodes = spark.createDataFrame(rows, f"node long, group long, net {ld.NET}, wide binary")
    got = {(r["a"], r["b"]) for r in ld.close_pairs(nodes, 80, False).collect()}
    assert got == {(i, 60 + i) for i in range(5)}
    assert ld.close_pairs(nodes.drop("wide"), 80, False).count() > 100
    # a line without them is told apart by its net alone
    some = nodes.withColumn("wide", F.when(F.col("node") != 0, F.col("wide")))
    assert {(r["a"], r["b"]) for r in ld.close_pairs(some, 80, False).where("a != 0").collect()} == got - {(0, 60)}
