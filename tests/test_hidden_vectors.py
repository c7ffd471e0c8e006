"""Projection and pooling in Arrow batches: against plain arithmetic, and what their plans move."""

import random

import pytest
from pyspark.sql import functions as F

from kdframe.operators import kd_hidden as hid


def states(rng, rows=60, width=3):
    out = []
    for i in range(rows):
        vector = [rng.uniform(-1, 1) for _ in range(width)] if rng.random() < 0.9 else None
        out.append((i % 7, rng.choice([0, 1, 2, None]), i, vector, rng.choice([0, 1, None])))
    return out


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("bound, cell", [(1 << 23, 1 << 16), (0, 5), (0, 1000)])
def test_project(spark, monkeypatch, bound, cell):
    monkeypatch.setattr(hid, "BROADCAST_FLOATS", bound)
    monkeypatch.setattr(hid, "CELL_ROWS", cell)
    rows = states(random.Random(1))
    weights = [(layer, o, [float(layer + o - j) for j in range(3)], o / 2) for layer in (0, 1, 5) for o in range(4)]
    df = spark.createDataFrame(rows, "seq_id int, layer int, pos int, h array<float>, mask int").repartition(3)
    known = spark.createDataFrame(weights, "layer int, out_idx int, w array<double>, bias double").repartition(2)
    found = hid.project(df, known)
    assert found.columns == df.columns
    got = {r["pos"]: r["h"] for r in found.collect()}
    wanted = {p: h and [sum(w * x for w, x in zip(row[2], h)) + row[3] for row in weights if row[0] == layer] for _, layer, p, h, _ in rows if layer in (0, 1)}
    assert got.keys() == wanted.keys()
    assert all((a is None and b is None) or a == pytest.approx(b, abs=1e-5) for a, b in ((got[p], wanted[p]) for p in got))
    # by another column, and without any weights
    moved = df.withColumn("layer2", F.col("layer") - 1)
    assert {r["pos"] for r in hid.project(moved, known, on="layer2").collect()} == {p for _, layer, p, _, _ in rows if layer in (1, 2)}
    assert hid.project(df, known.limit(0)).collect() == []


def test_project_reads_the_states_once(spark, monkeypatch, tmp_path):
    df = spark.range(50).select((F.col("id") % 9).cast("int").alias("layer"), F.col("id").alias("pos"), F.array(F.lit(1.0)).alias("h"))
    df.write.parquet(str(tmp_path / "h"))
    weights = spark.range(9).select(F.col("id").cast("int").alias("layer"), F.lit(0).alias("out_idx"), F.array(F.lit(2.0)).alias("w"), F.lit(0.0).alias("bias"))
    for bound in (0, 1 << 23):
        monkeypatch.setattr(hid, "BROADCAST_FLOATS", bound)
        plan = hid.project(spark.read.parquet(str(tmp_path / "h")), weights)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("h#" in line for line in plan.splitlines() if "Relation [" in line) == 1


def test_pooled(spark):
    rng = random.Random(2)
    rows = [(i % 5, [rng.uniform(-1, 1) for _ in range(4)], rng.choice([0, 1, None]), [rng.uniform(-1, 1) for _ in range(2)], 1) for i in range(400)]
    rows += [(9, [1.0] * 4, 0, None, 1), (8, [1.0] * 4, 0, [2.0] * 2, 0), (None, [1.0] * 4, 1, [3.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "seq_id int, s array<double>, s_mask int, t array<double>, t_mask int").repartition(7)
    found = hid.pooled(df, {"s": "s_mask", "t": "t_mask"}, ["seq_id"])
    assert "Generate" not in plan_of(found) and plan_of(found).count("Relation") <= 1
    got = {r["seq_id"]: (r["s"], r["t"]) for r in found.collect()}
    assert got.keys() == {0, 1, 2, 3, 4, 8, None}
    for key, vectors in got.items():
        own = [r for r in rows if r[0] == key]
        for at, mean in zip((1, 3), vectors):
            kept = [r[at] for r in own if r[at + 1]]
            assert mean == pytest.approx([sum(x) / max(len(kept), 1) for x in zip(*kept)] if kept else [0.0] * len(own[0][at]))
    assert hid.pooled(df.limit(0), {"s": "s_mask"}, ["seq_id"]).collect() == []


def test_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(50).select((F.col("id") / 20).cast("int").alias("layer"), F.col("id").cast("double").alias("x")).withColumn("h", F.array("x", "x"))
        got = {r["layer"]: r["pooled"] for r in hid.mean_pool(df.withColumn("mask", F.lit(1)), ["layer"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {0: [9.5, 9.5], 1: [29.5, 29.5], 2: [44.5, 44.5]}
