"""Skewed inputs, the paths beyond the broadcast bounds, and independence of the partitioning."""

import pytest
from pyspark.sql import functions as F

from kdframe.operators import eval_prompts, kd_hidden, mixture, ranking, tokens
from kdframe.operators.mixture import Source
from kdframe.operators.ranking import prefix_sum, range_bucket, shuffled_rank, take_first


def ranks(df):
    return {r.id: r["rank"] for r in df.collect()}


def test_rank_does_not_depend_on_partitions(spark):
    one, many = spark.range(0, 3000, 1, 1), spark.range(0, 3000, 1, 8)
    assert ranks(shuffled_rank(one, ["id"])) == ranks(shuffled_rank(many, ["id"]))
    assert sorted(ranks(shuffled_rank(many, ["id"])).values()) == list(range(3000))


def test_prefix_sum_over_many_buckets_of_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, "hot").otherwise("cold").alias("g"), "id")
    out = prefix_sum(df, ["id"], [range_bucket(F.col("id"), 7)], value=F.col("id"), by=["g"], name="s")
    for r in out.collect():
        low = 0 if r.g == "hot" else 1500
        assert r.s == sum(range(low, r.id))


def test_quota_of_a_hot_source(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("source"), "id")
    spec = [Source("big", 0.5), Source("small", 0.9), Source("absent", 0.1)]
    kept = mixture.weighted_quota(df, spec, 1333, ["id"])
    assert {r.source: r["count"] for r in kept.groupBy("source").count().collect()} == {"big": 666, "small": 1000}
    assert mixture.weighted_quota(df, spec, None, ["id"]).count() == 3000
    first = {r.id for r in shuffled_rank(df.where("source = 'big'"), ["id"]).where("rank < 666").collect()}
    assert {r.id for r in kept.where("source = 'big'").collect()} == first


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 5000])
def test_take_first_sizes(spark, n):
    df = spark.range(1000)
    got = take_first(df, lambda total: F.least(F.lit(n), total), ["id"], range_bucket(F.col("id"), 64))
    assert sorted(r.id for r in got.collect()) == list(range(min(n, 1000)))


def test_split_is_exact_and_optional(spark):
    out = mixture.train_test_split(spark.range(101), 0.05, ["id"])
    assert out.where("split = 'test'").count() == 6
    assert mixture.train_test_split(spark.range(5), 0, ["id"]).where("split = 'train'").count() == 5


def test_shuffle_of_copies_numbers_every_row(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("v"))
    out = mixture.shuffle_without_id(df).collect()
    assert sorted(r.position for r in out) == list(range(900))
    same = sorted(r.position for r in out if r.v == "same")
    assert len(same) == 300 and same[-1] - same[0] == 299


def test_long_runs_are_written_in_chunks(spark):
    df = spark.createDataFrame([(1, 10_000), (2, 0), (3, 1)], "k int, n int")
    out = mixture.repeat_rows(df, F.col("n")).groupBy("k").agg(F.count("*").alias("c"), F.max("copy").alias("m"))
    assert {(r.k, r.c, r.m) for r in out.collect()} == {(1, 10_000, 9_999), (3, 1, 0)}


def test_interleave_of_a_tiny_and_a_long_shard(spark):
    rows = [("tiny", 0)] + [("long", i) for i in range(9000)]
    df = spark.createDataFrame(rows, "source string, place long")
    out = mixture.interleave(df, ["tiny", "long"], "place")
    assert out.count() == 18_000 and out.select("out_pos").distinct().count() == 18_000


def test_lookup_beyond_the_broadcast_bound(spark):
    words = spark.range(5000).select(F.concat(F.lit("w"), F.floor(F.sqrt("id")).cast("string")).alias("piece"), "id")
    seqs = words.select(F.lit(1).alias("seq"), F.col("id").alias("pos"), "piece")
    vocabulary = tokens.build_vocabulary(seqs)
    whole = tokens.lookup_ids(seqs, vocabulary)
    split = tokens.lookup_ids(seqs, vocabulary, broadcast_rows=10)
    assert sorted(map(tuple, whole.select("pos", "id").collect())) == sorted(map(tuple, split.select("pos", "id").collect()))
    assert sorted(r.id for r in vocabulary.collect()) == list(range(3, 3 + vocabulary.count()))


def test_long_sequences_are_cut_exactly(spark):
    rows = [(1, i, f"word{i} ") for i in range(2000)] + [(2, 0, "a b c")]
    df = spark.createDataFrame(rows, "conv_id int, place int, fragment string")
    out = tokens.sequence_tokens(df, 50)
    text = {r.conv_id: r.t for r in out.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("t")
    ).collect()}
    assert text[2] == "a b c"
    assert "".join(f"word{i} " for i in range(2000)).startswith(text[1])
    assert out.where("conv_id = 1").count() == 50


def test_projection_layer_by_layer(spark, monkeypatch):
    hidden = spark.createDataFrame(
        [(0, layer, pos, [float(layer), 1.0]) for layer in range(3) for pos in range(2)],
        "seq_id int, layer int, pos int, h array<double>",
    )
    weights = spark.createDataFrame(
        [(layer, o, [1.0 * o, 2.0], 0.5) for layer in range(2) for o in range(3)],
        "layer int, out_idx int, w array<double>, bias double",
    )
    small = sorted(map(tuple, kd_hidden.project(hidden, weights).collect()))
    monkeypatch.setattr(kd_hidden, "BROADCAST_FLOATS", 2)
    monkeypatch.setattr(kd_hidden, "CELL_ROWS", 1)
    assert sorted(map(tuple, kd_hidden.project(hidden, weights).collect())) == small
    assert len(small) == 4 and small[-1][3] == [2.5, 3.5, 4.5]


def test_few_shots_never_show_the_item_itself(spark):
    df = spark.range(50).select(F.lit("t").alias("task"), F.col("id").alias("item_id"), F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">")).alias("example"))
    for select in ("random", "sequential"):
        out = eval_prompts.few_shots(df, df, 4, select=select, same_split=True).collect()
        assert len(out) == 50
        for r in out:
            assert r.few_shot.count("<") == 4 and f"<{r.item_id}>" not in r.few_shot
    assert {r.few_shot for r in eval_prompts.few_shots(df, df, 0).collect()} == {""}


def test_head_and_sample_modes(spark):
    df = spark.range(500)
    assert sorted(r.id for r in mixture.cap_rows(df, 10, ["id"], mode="head").collect()) == list(range(10))
    sample = {r.id for r in mixture.cap_rows(df, 10, ["id"]).collect()}
    assert sample == {r.id for r in shuffled_rank(df, ["id"]).where("rank < 10").collect()}
    with pytest.raises(ValueError):
        mixture.cap_rows(df, 10, ["id"], mode="tail")


def test_length_groups_save_padding(spark):
    df = spark.range(4000).select("id", (F.col("id") * 37 % 501 + 1).alias("n"))
    pad = lambda d: tokens.padding_per_batch(d, "batch_id", "n").agg(F.sum("padding")).first()[0]
    grouped = tokens.length_grouped_batches(df, ["id"], "n", 8)
    assert grouped.groupBy("batch_id").count().where("count = 8").count() == 500
    assert pad(grouped) < 0.2 * pad(tokens.assign_batches(df, ["id"], 8))


def test_local_masters():
    from kdframe.session import is_local

    assert all(is_local(m) for m in ("local", "local[4]", "local[*]", "local[2,3]"))
    assert not any(is_local(m) for m in ("local-cluster[3,2,1024]", "yarn", "k8s://host", "spark://host:7077"))


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from kdframe.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(session)


def test_ranges_of_a_skewed_vocabulary(spark):
    """Nine of ten pieces occur once: the ranges of the rank are still of about equal size."""
    rare = spark.range(90_000).select(F.concat(F.lit("th"), F.col("id").cast("string")).alias("piece"), F.lit(1).alias("n"))
    common = spark.range(10_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("piece"), (F.col("id") + 2).cast("int").alias("n"))
    df = rare.union(common)
    order = [F.col("n").desc(), F.col("piece")]
    sizes = [r["count"] for r in ranking.range_ordered(df, order).groupBy(F.shiftright("_at", 33)).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) == 8
    ranked = ranking.range_rank(df, order)
    assert "Window" not in ranked._jdf.queryExecution().toString()
    rows = ranked.collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: (-r["n"], r["piece"]))] == list(range(100_000))
    assert ranking.range_rank(df.limit(0), order).count() == 0
