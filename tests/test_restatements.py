"""Operators against plain Python on small random rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kdframe.operators import eval_scoring, kd_hidden, kd_logits, tokens
from kdframe.operators.ranking import order_key

random.seed(7)


def logsumexp(xs):
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def vector(n):
    return [random.uniform(-9, 9) for _ in range(n)]


def test_log_softmax_gather_and_kl(spark):
    rows = [(i, vector(9), vector(7), random.randrange(7)) for i in range(20)]
    df = spark.createDataFrame(rows, "seq_id int, teacher array<double>, student array<double>, label int")
    got = {r.seq_id: r for r in df.select("seq_id", kd_logits.selective_log_softmax(F.col("student"), F.col("label")).alias("lp")).collect()}
    kl = {r.seq_id: r.kl for r in kd_logits.sequence_kl(kd_logits.align_vocabularies(df), 2.0).collect()}
    for i, teacher, student, label in rows:
        assert got[i].lp == pytest.approx(student[label] - logsumexp(student))
        t, s = [x / 2 for x in teacher], [x / 2 for x in student + [0.0, 0.0]]
        zt, zs = logsumexp(t), logsumexp(s)
        assert kl[i] == pytest.approx(sum(math.exp(a - zt) * ((a - zt) - (b - zs)) for a, b in zip(t, s)))


def test_large_logits_stay_finite(spark):
    df = spark.createDataFrame([([1e4, 0.0, -1e4],)], "a array<double>")
    assert df.select(kd_logits.selective_log_softmax(F.col("a"), F.lit(0))).first()[0] == 0.0
    assert df.select(kd_logits.softplus(F.lit(800.0))).first()[0] == 800.0


def span_scan(ids, start, end):
    """Labels by walking the sequence."""
    labels, i, n = [-100] * len(ids), 0, len(ids)
    while i + len(start) <= n:
        if ids[i : i + len(start)] != start:
            i += 1
            continue
        j = i + len(start)
        while j < n and ids[j : j + len(end)] != end:
            labels[j] = ids[j]
            j += 1
        i = j + 1
    return labels


@pytest.mark.parametrize("start, end", [([1, 5, 6], [2]), ([1, 5], [2, 3])])
def test_span_labels(spark, start, end):
    rows, wanted = [], {}
    for seq in range(150):
        ids = [random.choice([1, 5, 6, 2, 3, 4]) for _ in range(random.randrange(1, 30))]
        if seq % 3 == 0:
            at = random.randrange(len(ids) + 1)
            ids[at:at] = start
        wanted[seq] = span_scan(ids, start, end)
        rows += [(seq, pos, i) for pos, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "seq int, pos int, id int")
    marked = tokens.mark_spans(df, start, end, seq=["seq"], value="id")
    labelled = marked.withColumn("label", tokens.span_labels(F.col("supervised"), F.col("id")))
    got = {r.seq: r.labels for r in tokens.collect_ids(labelled, ["seq"], "label", "labels").collect()}
    assert got == wanted


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_rouge_l(spark):
    draw = lambda: " ".join(random.choice("abcdef") for _ in range(random.randrange(0, 80)))
    rows = [(i, draw(), draw()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r.id: r.rouge_l for r in eval_scoring.rouge_l(df, "a", "b").collect()}
    for i, a, b in rows:
        x, y = a.split(), b.split()
        common = lcs(x, y)
        assert got[i] == pytest.approx(2 * common / (len(x) + len(y)) if x or y else 0.0)


@pytest.mark.parametrize("strict", [True, False])
def test_masked_losses(spark, strict):
    rows = [(layer, vector(4), vector(4), random.randrange(2), random.randrange(2)) for layer in (0, 1) for _ in range(6)]
    df = spark.createDataFrame(rows, "layer int, s array<double>, t array<double>, s_mask int, t_mask int")
    for kind in kd_hidden.LOSSES:
        got = {r.layer: r.loss for r in kd_hidden.masked_layer_loss(df, kind, strict=strict).collect()}
        for layer in (0, 1):
            top, kept = 0.0, 0
            for which, s, t, sm, tm in rows:
                if which != layer:
                    continue
                m = sm * tm
                kept += m
                gaps = [a - b for a, b in zip(s, t)]
                if kind == "mse":
                    top += m * sum(g * g for g in gaps)
                elif kind == "huber":
                    top += m * sum(0.5 * g * g if abs(g) <= 1 else abs(g) - 0.5 for g in gaps)
                else:
                    cos = sum(a * b for a, b in zip(s, t)) / math.hypot(*s) / math.hypot(*t)
                    top += 1 - cos * m if strict else (1 - cos) * m
            width = 1 if strict or kind == "cosine" else 4
            assert got[layer] == pytest.approx(top / max(kept * width, 1))


def test_policy_weights_keep_the_rolled_alignment(spark):
    rows, wanted = [], {}
    for pair in range(3):
        mean = {}
        for side in ("chosen", "rejected"):
            logits = [vector(5) for _ in range(4)]
            labels = [random.randrange(1, 5) for _ in range(4)]
            mask = [1, 1, 1, 0]
            rows += [(pair * 2 + (side == "rejected"), p, logits[p], labels[p], mask[p], pair, side) for p in range(4)]
            logp = [(logits[p][labels[p]] - logsumexp(logits[p])) * mask[p] for p in range(4)]
            rolled = logp[-1:] + logp[:-1]
            adjust = [logsumexp([2 * (x - logsumexp(row)) for x in row]) for row in logits]
            mean[side] = sum((rolled[p] - adjust[p]) * mask[p] for p in range(4)) / sum(mask)
        wanted[pair] = min(1.0, math.exp(mean["chosen"] + mean["rejected"]))
    df = spark.createDataFrame(
        rows, "seq_id int, pos int, student array<double>, label int, loss_mask int, pair_id int, side string"
    )
    scored = kd_logits.token_logps(df, "student")
    got = {r.pair_id: r.policy_weight for r in kd_logits.policy_weights(scored, "student").collect()}
    assert got == pytest.approx(wanted)


def test_guarded_total(spark):
    rows = [(0, None, 2.0), (500, math.nan, 2.0), (500, 4.0, 2.0), (5000, 4.0, 2.0), (0, 4.0, 2.0)]
    df = spark.createDataFrame(rows, "step int, loss_xe double, loss_kd double")
    got = [(round(r.alpha, 6), round(r.loss_total, 6)) for r in kd_hidden.guarded_total(df, 0.7).collect()]
    assert got == [(1.0, 2.0), (1.0, 2.0), (0.35, 3.3), (0.7, 2.6), (0.0, 4.0)]


def test_tokenisers_lose_nothing(spark):
    texts = ["<|im_start|>user\nHé llo, 世界 42!<|im_end|>\n", "", "  \t😀<| x", "a\r\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in tokens.TOKENISERS:
        back = [r[0] for r in df.select(F.array_join(tokens.pieces(F.col("t"), name), "")).collect()]
        assert back == texts


def test_order_key_matches_plain_md5(spark):
    import hashlib

    key = spark.range(3).select(order_key(42, "id")).collect()
    assert [k[0] for k in key] == [hashlib.md5(f"42:{i}".encode()).hexdigest() for i in range(3)]


def test_normalised_answers(spark):
    rows = [("The  Cat, sat!", ["a cat sat", "dog"], 1), ("cats", ["cat"], 0), ("", ["the"], 1), ("x", None, 0)]
    df = spark.createDataFrame(rows, "p string, g array<string>, want int")
    assert all(r[0] == r[1] for r in df.select(eval_scoring.match_any(F.col("p"), F.col("g")), "want").collect())
    numbers = [("so 1,234.", "#### 1234", 1), ("#### 5 then 7", "5", 1), ("none", "5", 0), ("-3.5", "#### -3.5", 1)]
    df = spark.createDataFrame(numbers, "p string, g string, want int")
    assert all(r[0] == r[1] for r in df.select(eval_scoring.number_match(F.col("p"), F.col("g")), "want").collect())


def test_spans_in_text_equal_spans_in_tokens(spark):
    start, end = "<|im_start|>assistant\n", "<|im_end|>"
    bits = [start, end, "<|im_start|>user\n", "hi there", " assistant\n", "\n", "x1 "]
    rows = [(i, 0, "".join(random.choice(bits) for _ in range(random.randrange(1, 14)))) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id int, place int, fragment string")
    limit = 15
    marked = tokens.mark_spans(
        tokens.sequence_tokens(df, limit), ["<|im_start|>", "assistant", "\n"], [end]
    )
    by_token = {(r.conv_id, r.pos): (r.piece, r.supervised) for r in marked.collect()}
    found = F.slice(tokens.supervised_pieces(F.col("text"), start, end), 1, limit)
    texts = tokens.sequence_texts(df, limit)
    by_text = {
        (r.conv_id, r.pos): (r.t.piece, r.t.supervised)
        for r in texts.select("conv_id", F.posexplode(found).alias("pos", "t")).collect()
    }
    assert by_text == by_token
    for r in tokens.sequence_budget(df, limit, start, end).collect():
        mine = [v for k, v in by_token.items() if k[0] == r.conv_id]
        assert (r.tokens, r.supervised_tokens) == (len(mine), sum(v[1] for v in mine))
