"""Worked examples with known results, and errors that must be raised."""

import pytest
from pyspark.sql import functions as F

from kdframe.operators import conversation, kd_hidden, preference, tokens
from kdframe.operators.eval_reports import humantime
from kdframe.operators.eval_scoring import normalise_final, normalise_math
from kdframe.operators.mixture import interleave

ARRAYS = "batch_id int, row int, attention_mask array<int>, input_ids array<int>, loss_mask array<int>"


def test_flush_left_example(spark):
    rows = [
        (0, 0, [0, 0, 1, 1, 1], [9, 9, 2, 3, 4], [0, 0, 0, 1, 1]),
        (0, 1, [0, 1, 1, 0, 0], [9, 5, 6, 9, 9], [0, 0, 1, 0, 0]),
    ]
    out = preference.flush_left(spark.createDataFrame(rows, ARRAYS), "attention_mask", ["input_ids", "loss_mask"])
    got = {r.row: (r.attention_mask, r.input_ids) for r in out.collect()}
    assert got == {0: ([1, 1, 1], [2, 3, 4]), 1: ([1, 1, 0], [5, 6, 9])}


def test_flush_left_keeps_columns_with_holes_until_the_first_empty_one(spark):
    rows = [(0, 0, [1, 0, 1], [1, 2, 3], [0, 0, 1]), (0, 1, [0, 1, 0], [4, 5, 6], [0, 1, 0])]
    out = preference.flush_left(spark.createDataFrame(rows, ARRAYS), "attention_mask", ["input_ids"])
    assert sorted(r.input_ids for r in out.collect()) == [[1], [5]]


def test_flush_left_rejects_empty_row(spark):
    rows = spark.createDataFrame([(0, 0, [0, 0], [1, 2], [0, 0])], ARRAYS)
    with pytest.raises(Exception, match="needs a 1 in its mask"):
        preference.flush_left(rows, "attention_mask", ["input_ids"]).collect()


def test_logits_to_keep_example(spark):
    rows = [(0, 0, [1] * 7, [0] * 7, [0, 0, 0, 1, 1, 1, 1]), (0, 1, [1] * 7, [0] * 7, [0, 0, 0, 1, 1, 1, 0])]
    out = preference.logits_to_keep(spark.createDataFrame(rows, ARRAYS))
    assert {r.logits_to_keep for r in out.collect()} == {5}


def test_flatten_example(spark):
    rows = [(0, 0, [1, 1, 1, 0], [1, 2, 3, 0], [0, 1, 1, 0]), (0, 1, [1, 1, 1, 1], [4, 5, 6, 7], [0, 0, 1, 1])]
    df = spark.createDataFrame(rows, ARRAYS)
    flat = preference.flatten_batch(df, "row")
    got = [(r.input_ids, r.position_id) for r in flat.orderBy("flat_pos").collect()]
    assert got == [(1, 0), (2, 1), (3, 2), (4, 0), (5, 1), (6, 2), (7, 3)]
    back = preference.unflatten_batch(df, flat.withColumn("v", F.col("input_ids") * 10), "v", "row")
    assert [r.v for r in back.orderBy("row", "pos").collect()] == [10, 20, 30, 0, 40, 50, 60, 70]


def test_truncation_modes(spark):
    df = spark.createDataFrame([(0, 0, [1, 1, 0], [1, 2, 0], [0, 1, 0])], ARRAYS)
    cut = lambda mode, n: preference.truncate_batch(df, ["input_ids"], n, mode).first().input_ids
    assert cut("keep_end", 2) == [2, 0] and cut("keep_start", 2) == [1, 2] and cut("keep_end", 9) == [1, 2, 0]
    with pytest.raises(ValueError):
        cut("keep_middle", 2)


def test_interleave_documented_example(spark):
    rows = [("a", i, i) for i in range(3)] + [("b", i, 10 + i) for i in range(4)] + [("c", i, 20 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "source string, place long, v int")
    out = interleave(df, ["a", "b", "c"], "place").orderBy("out_pos").collect()
    assert [r.v for r in out] == [0, 10, 20, 1, 11, 21, 2, 12, 22, 0, 13, 23, 1, 10, 24]
    assert [r.out_pos for r in out] == list(range(15))


@pytest.mark.parametrize(
    "raw, wanted",
    [
        (r"\frac12", r"\frac{1}{2}"),
        (r"\frac{abc}{bef}", r"\frac{abc}{bef}"),
        (r"\frac123", r"\frac{1}{2}3"),
        (r"\sqrt3", r"\sqrt{3}"),
        (r"\sqrt35", r"\sqrt{3}5"),
        ("100,000", "100000"),
        ("x=5", "5"),
        ("12 units", "12"),
        (r"\text{a $7$ b}", "7"),
        ("(1,2)", "(1,2)"),
    ],
)
def test_final_answer(spark, raw, wanted):
    df = spark.createDataFrame([(raw,)], "a string")
    assert df.select(normalise_final(F.col("a"))).first()[0] == wanted


@pytest.mark.parametrize(
    "raw, wanted",
    [
        (None, ""),
        ("no box", ""),
        (r"first \boxed{1} then \boxed{\frac{1}{2}} end }", r"\frac{1}{2}"),
        (r"\boxed 12$ rest", "12"),
        (r"\fbox{x45}", "45"),
        (r"\boxed{open", ""),
        (r"\boxed{}", ""),
    ],
)
def test_boxed_answer(spark, raw, wanted):
    df = spark.createDataFrame([(raw,)], "a string")
    assert df.select(normalise_math(F.col("a"))).first()[0] == wanted


@pytest.mark.parametrize("student, teacher", [(3, 6), (4, 6), (5, 11), (12, 24), (24, 24), (2, 2)])
def test_layer_map_rounds_halves_to_even(spark, student, teacher):
    df = spark.range(student).select(kd_hidden.map_layer(F.col("id"), student, teacher).alias("t"))
    assert [r.t for r in df.collect()] == [round(i * (teacher - 1) / (student - 1)) for i in range(student)]


def test_layer_map_of_one_layer_is_an_error():
    with pytest.raises(ValueError):
        kd_hidden.map_layer(None, 1, 4)


def test_unknown_loss_and_shapes(spark):
    df = spark.createDataFrame([(0, [1.0], [1.0, 2.0])], "layer int, s array<double>, t array<double>")
    with pytest.raises(ValueError, match="no loss is called"):
        kd_hidden.layer_loss(df, "l1")
    with pytest.raises(Exception, match="different width"):
        kd_hidden.layer_loss(kd_hidden.checked_shapes(df)).collect()


def test_humantime(spark):
    df = spark.createDataFrame([(5,), (65,), (3600,), (3725,), (None,)], "s long")
    assert [r[0] for r in df.select(humantime(F.col("s"))).collect()] == ["5s", "1m 5s", "1h 0m 0s", "1h 2m 5s", None]


def test_hoisted_system_turns_come_out_reversed(spark):
    talk = [("system", "s1"), ("human", "h"), ("system", "s2"), ("tool", "x"), ("gpt", None)]
    df = spark.createDataFrame([(talk,)], "c array<struct<from:string,value:string>>")
    out = df.select(conversation.hoist_system(conversation.map_roles(F.col("c"))).alias("m")).first().m
    assert [(m.role, m.content) for m in out] == [("system", "s2"), ("system", "s1"), ("user", "h"), ("assistant", "")]


def test_context_limit_and_pad_id(spark):
    row = spark.range(1).select(
        tokens.context_limit(F.lit(None).cast("int"), F.lit(2048), F.lit(4096)).alias("a"),
        tokens.context_limit(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(9000)).alias("b"),
        tokens.pad_id(F.lit(None).cast("int"), F.lit(7)).alias("c"),
        tokens.pad_id(F.lit(None).cast("int"), F.lit(None).cast("int")).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (2048, 4096, 7, 0)
