"""Losses from one narrow row per token, and batches cut by packed masks."""

import math
import random

from pyspark.sql import functions as F

from kdframe.operators import kd_logits as kd
from kdframe.operators import preference as pref


def logits(spark, rng):
    rows = []
    for seq in range(8):
        for pos in range(5):
            rows.append((seq, pos, [rng.uniform(-3, 3) for _ in range(6)], [rng.uniform(-3, 3) for _ in range(6)], rng.randrange(6),
                         int(0 < pos < 4), seq // 2, "chosen" if seq % 2 == 0 else "rejected", seq // 4, "train"))
    return rows, spark.createDataFrame(rows, "seq_id int, pos int, teacher array<double>, student array<double>, label int, "
                                             "loss_mask int, pair_id int, side string, batch_id int, split string")


def lse(a):
    return math.log(sum(map(math.exp, a)))


def test_scalars_and_the_losses_on_them(spark):
    rows, df = logits(spark, random.Random(5))
    tokens = kd.token_scalars(df).cache()
    got = {(r["seq_id"], r["pos"]): r for r in tokens.collect()}
    for seq, pos, t, s, label, mask, *_ in rows:
        r = got[seq, pos]
        assert r["label_or_zero"] == label * mask and r["width"] == 6
        for name, a in (("logp", s), ("ref_logp", t)):
            assert abs(r[name] - mask * (a[label] - lse(a))) < 1e-9
        assert abs(r["adjustment"] - lse([2 * (x - lse(s)) for x in s])) < 1e-9
        assert abs(r["kl"] - sum(math.exp(x - lse(t)) * ((x - lse(t)) - (y - lse(s))) for x, y in zip(t, s))) < 1e-9
        assert abs(r["logit_sum"] - sum(s)) < 1e-9

    def same(a, b):
        a, b = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()) for df in (a, b))
        assert a == b and a

    scored = kd.token_logps(df, "student")
    same(kd.policy_weights(tokens), kd.policy_weights(scored, "student"))
    same(kd.chosen_nll(tokens, by=["batch_id"]), kd.chosen_nll(scored, "student", ["batch_id"]))
    same(kd.batchmean_kl(tokens, 1.0, ["batch_id"]), kd.batchmean_kl(df, 1.0, ["batch_id"]))
    same(kd.mean_logits(tokens, None, ["side"]), kd.mean_logits(df, "student", ["side"]))
    policy = kd.pivot_sides(kd.sequence_logps(scored, ["seq_id", "pair_id", "side"]), ["pair_id"])
    same(kd.scored_pairs(tokens, ["seq_id", "pair_id", "side"], ["pair_id"]).select("pair_id", "chosen", "rejected"), policy)
    tokens.unpersist()


def test_no_logits_in_an_exchange(spark, tmp_path):
    from test_mixture_job import exchanged

    logits(spark, random.Random(6))[1].write.parquet(str(tmp_path / "logits"))
    df = spark.read.parquet(str(tmp_path / "logits"))
    tokens = kd.token_scalars(df)
    for plan in (
        kd.policy_weights(tokens),
        kd.scored_pairs(tokens, ["seq_id", "pair_id", "side"], ["pair_id"]),
        kd.chosen_nll(tokens, by=["batch_id"]),
        kd.batchmean_kl(tokens, 1.0, ["batch_id"]),
        kd.shifted_cross_entropy(df, "student", "label"),
    ):
        assert not exchanged(plan, "student") and not exchanged(plan, "teacher")


def test_cross_entropy_beyond_the_bound(spark, monkeypatch):
    _, df = logits(spark, random.Random(7))
    small = kd.shifted_cross_entropy(df, "student", "label").first()[0]
    monkeypatch.setattr(kd, "BROADCAST_LABELS", 3)
    assert abs(kd.shifted_cross_entropy(df, "student", "label").first()[0] - small) < 1e-12


def test_flush_left_of_wide_batches(spark):
    rng = random.Random(8)
    rows = []
    for batch, width in enumerate((1, 31, 32, 33, 64, 65, 100, 200)):
        for row in range(3):
            first, last = sorted(rng.sample(range(width + 1), 2))
            mask = [int(first <= i < last) for i in range(width)]
            if row == 2 and width > 40:
                mask = [1, *([0] * (width // 2 - 1)), *([1] * (width - width // 2))]  # a gap that others fill, or not
            rows.append((batch, row, mask, [rng.randrange(1, 99) for _ in mask]))
    df = spark.createDataFrame(rows, "batch_id int, row int, mask array<int>, ids array<int>").repartition(4)
    got = {(r["batch_id"], r["row"]): (r["mask"], r["ids"]) for r in pref.flush_left(df, "mask", ["ids"]).collect()}
    for batch in range(8):
        own = [(r, m, i, m.index(1)) for b, r, m, i in rows if b == batch]
        turned = {r: (m[k:] + m[:k], i[k:] + i[:k]) for r, m, i, k in own}
        size = len(own[0][1])
        width = next((at for at in range(size) if not any(m[at] for m, _ in turned.values())), size)
        for r, (m, i) in turned.items():
            assert got[batch, r] == (m[:width], i[:width])


def test_no_array_is_gathered_by_batch(spark, tmp_path):
    from test_mixture_job import exchanged

    df = spark.createDataFrame([(1, 1, [0, 1], [5, 6])], "batch_id int, row int, mask array<int>, ids array<int>")
    df.write.parquet(str(tmp_path / "b"))
    cut = pref.used_columns(spark.read.parquet(str(tmp_path / "b")), "mask", "batch_id")
    assert not exchanged(cut, "mask")
    assert "collect_list" not in pref.flush_left(df, "mask", ["ids"])._jdf.queryExecution().toString()
    assert cut.select(F.col("_width")).first()[0] == 0
