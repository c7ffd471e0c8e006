"""Queries L1-L17 and H1-H16: loss audits over saved logits and hidden states."""

from __future__ import annotations

from pyspark.sql import functions as F

from kdframe.functions.vectors import log_softmax, softmax, vsum
from kdframe.operators import kd_hidden as hid
from kdframe.operators import kd_logits as kd
from kdframe.plans import tables
from kdframe.plans.catalog import query, r6
from kdframe.session import materialize


def aligned(spark, root):
    return kd.align_vocabularies(tables.logits(spark, root))


def R(x):  # noqa: N802  (short name for SQL texts)
    return f"round({x}, 6) + 0.0"


@query(
    "l1_align_vocabularies",
    f"""SELECT seq_id, pos, len(student)::INT AS width, {R("list_sum(student)")} AS student_sum, {R("list_sum(teacher)")} AS teacher_sum
        FROM aligned""",
)
def l1(spark, root):
    return aligned(spark, root).select(
        "seq_id",
        "pos",
        F.size("student").alias("width"),
        r6(vsum(F.col("student"))).alias("student_sum"),
        r6(vsum(F.col("teacher"))).alias("teacher_sum"),
    )


@query(
    "l2_softmax",
    f"""SELECT seq_id, pos, {R("exp(teacher[label + 1] / 2) / list_sum(list_transform(teacher, lambda x: exp(x / 2)))")} AS p_label,
               {R("list_max(list_transform(student, lambda x: x / 2)) - sz2")} AS best_log_q FROM logz2""",
)
def l2(spark, root):
    return aligned(spark, root).select(
        "seq_id",
        "pos",
        r6(F.element_at(softmax(F.col("teacher"), 2.0), F.col("label") + 1)).alias("p_label"),
        r6(F.array_max(log_softmax(F.col("student"), 2.0))).alias("best_log_q"),
    )


_KL2 = """SELECT seq_id, batch_id, list_sum(list_transform(range(1, 65), lambda i:
            exp(teacher[i] / 2 - tz2) * ((teacher[i] / 2 - tz2) - (student[i] / 2 - sz2)))) AS kl FROM logz2"""


@query(
    "l3_batchmean_kl",
    f"""SELECT batch_id, {R("sum(kl) / count(DISTINCT seq_id) * 4")} AS kd FROM ({_KL2}) GROUP BY batch_id""",
)
def l3(spark, root):
    losses = kd.batchmean_kl(aligned(spark, root), 2.0, ["batch_id"])
    return losses.select("batch_id", r6("kd").alias("kd"))


@query(
    "l3_sequence_kl",
    f"SELECT seq_id, {R('sum(kl)')} AS kl FROM kl_tokens GROUP BY seq_id",
)
def l3_sequences(spark, root):
    return kd.sequence_kl(aligned(spark, root), 1.0).select("seq_id", r6("kl").alias("kl"))


@query(
    "l4_length_normalised",
    f"""SELECT {R("sum(kl) / count(DISTINCT seq_id) * 4 / 5 * 1000")} AS kd_per_mille FROM ({_KL2})""",
)
def l4(spark, root):
    total = kd.batchmean_kl(aligned(spark, root), 2.0)
    return total.select(r6(F.col("kd") / 5 * 1000).alias("kd_per_mille"))


_CE = """SELECT batch_id, avg(sz - student[next + 1]) AS ce FROM (
           SELECT *, lead(target) OVER (PARTITION BY seq_id ORDER BY pos) AS next FROM (
             SELECT *, CASE WHEN loss_mask = 1 THEN label ELSE -100 END AS target FROM logz)) WHERE next <> -100 GROUP BY batch_id"""


@query(
    "l5_blend",
    f"""SELECT batch_id, {R("0.5 * kd / 2048 + 0.5 * ce")} AS loss FROM ({_CE})
        JOIN (SELECT batch_id, sum(kl) / count(DISTINCT seq_id) * 4 AS kd FROM ({_KL2}) GROUP BY batch_id) USING (batch_id)""",
)
def l5(spark, root):
    rows = aligned(spark, root)
    ce = cross_entropy(rows)
    divergence = kd.batchmean_kl(rows, 2.0, ["batch_id"])
    both = divergence.join(ce, "batch_id")
    return both.select("batch_id", r6(kd.blend(F.col("kd") / 2048, F.col("ce"), 0.5)).alias("loss"))


def cross_entropy(rows):
    target = rows.withColumn("target", F.when(F.col("loss_mask") == 1, F.col("label")).otherwise(kd.IGNORE))
    return kd.shifted_cross_entropy(target, "student", "target", ["batch_id"])


@query("l6_cross_entropy", f"SELECT batch_id, {R('ce')} AS ce FROM ({_CE})")
def l6(spark, root):
    return cross_entropy(aligned(spark, root)).select("batch_id", r6("ce").alias("ce"))


@query(
    "l7_selective_log_softmax",
    f"SELECT seq_id, pos, {R('student[label + 1] - sz')} AS logp FROM logz",
)
def l7(spark, root):
    return aligned(spark, root).select(
        "seq_id", "pos", r6(kd.selective_log_softmax(F.col("student"), F.col("label"))).alias("logp")
    )


def scored(spark, root, logits="student"):
    return kd.token_logps(aligned(spark, root), logits)


def scalars(spark, root):
    """One narrow row per token, from one scan of the logits; several losses are read from it."""
    return materialize(kd.token_scalars(aligned(spark, root)))


SEQ = ["seq_id", "pair_id", "side", "batch_id", "split"]


@query(
    "l8_sequence_logps",
    f"SELECT seq_id, side, {R('sum(logp)')} AS logp FROM token_scores GROUP BY seq_id, side",
)
def l8(spark, root):
    return kd.sequence_logps(scored(spark, root), ["seq_id", "side"]).select("seq_id", "side", r6("logp").alias("logp"))


@query(
    "l9_per_token_logps",
    f"SELECT seq_id, side, {R('sum(logp) / sum(loss_mask)')} AS logp FROM token_scores GROUP BY seq_id, side",
)
def l9(spark, root):
    means = kd.sequence_logps(scored(spark, root), ["seq_id", "side"], per_token=True)
    return means.select("seq_id", "side", r6("logp").alias("logp"))


@query("l10_policy_weights", f"SELECT pair_id, {R('policy_weight')} AS policy_weight FROM weights")
def l10(spark, root):
    return kd.policy_weights(scored(spark, root), "student").select("pair_id", r6("policy_weight").alias("policy_weight"))


@query("l11_chosen_nll", f"SELECT batch_id, {R('nll')} AS nll FROM batch_nll")
def l11(spark, root):
    return kd.chosen_nll(scored(spark, root), "student", ["batch_id"]).select("batch_id", r6("nll").alias("nll"))


PAIR = ["pair_id", "batch_id", "split"]


def reference_pairs(spark, root):
    return kd.pivot_sides(kd.sequence_logps(scored(spark, root, "teacher"), SEQ), PAIR, prefix="ref_")


def rewarded(spark, root):
    policy = kd.pivot_sides(kd.sequence_logps(scored(spark, root), SEQ), PAIR)
    return kd.preference_loss(policy.join(reference_pairs(spark, root), PAIR))


@query(
    "l12_preference_loss",
    f"""SELECT pair_id, {R("loss")} AS loss, {R("reward_chosen")} AS reward_chosen, {R("reward_rejected")} AS reward_rejected
        FROM rewards""",
)
def l12(spark, root):
    return rewarded(spark, root).select(
        "pair_id", *[r6(c).alias(c) for c in ("loss", "reward_chosen", "reward_rejected")]
    )


@query(
    "l13_reference_logps",
    f"""SELECT pair_id, {R("CASE WHEN pair_id % 3 = 0 THEN -pair_id / 10 ELSE ref_chosen END")} AS ref_chosen,
               {R("CASE WHEN pair_id % 3 = 0 THEN -pair_id / 5 ELSE ref_rejected END")} AS ref_rejected FROM pairs""",
)
def l13(spark, root):
    computed = reference_pairs(spark, root)
    stored = computed.where("pair_id % 3 < 2").select(
        "pair_id",
        (-F.col("pair_id") / 10).alias("ref_chosen"),
        F.when(F.col("pair_id") % 3 == 0, -F.col("pair_id") / 5).alias("ref_rejected"),
    )
    merged = kd.stored_or_computed(computed, stored, ["pair_id"])
    return merged.select("pair_id", r6("ref_chosen").alias("ref_chosen"), r6("ref_rejected").alias("ref_rejected"))


@query(
    "l14_combined_loss",
    f"""SELECT pair_id, {R("(loss + 0.5 * coalesce(nll, 0)) * policy_weight + 0.01 * 2.0 + 0.001 * kd")} AS loss FROM rewards
        JOIN weights USING (pair_id) LEFT JOIN batch_nll USING (batch_id) JOIN batch_kd USING (batch_id)""",
)
def l14(spark, root):
    tokens = scalars(spark, root)
    rows = (
        kd.preference_loss(kd.scored_pairs(tokens, SEQ, PAIR))
        .join(kd.policy_weights(tokens), "pair_id")
        .join(kd.chosen_nll(tokens, by=["batch_id"]), "batch_id", "left")
        .join(kd.batchmean_kl(tokens, 1.0, ["batch_id"]), "batch_id")
    )
    loss = kd.combined_loss(
        F.col("loss"),
        F.col("kd"),
        nll=F.coalesce("nll", F.lit(0.0)),
        rpo_alpha=0.5,
        weight=F.col("policy_weight"),
        aux=F.lit(2.0),
        aux_coefficient=0.01,
    )
    return rows.select("pair_id", r6(loss).alias("loss"))


@query(
    "l15_response_mse",
    f"SELECT batch_id, {R('avg((chosen - ref_chosen) ** 2)')} AS mse FROM pairs GROUP BY batch_id",
)
def l15(spark, root):
    return kd.response_mse(rewarded(spark, root), "chosen", "ref_chosen", ["batch_id"]).select("batch_id", r6("mse").alias("mse"))


@query(
    "l16_batch_metrics",
    f"""WITH means AS (
          SELECT batch_id, split, avg(reward_chosen) AS "rewards/chosen", avg(reward_rejected) AS "rewards/rejected",
                 avg((reward_chosen > reward_rejected)::INT) AS "rewards/accuracies", avg(reward_chosen - reward_rejected) AS "rewards/margins",
                 avg(chosen) AS "logps/chosen", avg(rejected) AS "logps/rejected", any_value(kd) AS "logits/kd", any_value(nll) AS nll_loss,
                 any_value(lc) AS "logits/chosen", any_value(lr) AS "logits/rejected"
          FROM rewards JOIN (SELECT batch_id, avg(list_avg(student)) FILTER (WHERE side = 'chosen') AS lc,
                                    avg(list_avg(student)) FILTER (WHERE side = 'rejected') AS lr
                             FROM aligned WHERE loss_mask = 1 GROUP BY batch_id) USING (batch_id) JOIN batch_kd USING (batch_id) LEFT JOIN batch_nll USING (batch_id) GROUP BY batch_id, split)
        SELECT batch_id, split, CASE WHEN split = 'eval' THEN 'eval_' ELSE '' END || metric AS metric, {R("value")} AS value
        FROM means UNPIVOT INCLUDE NULLS (value FOR metric IN ("rewards/chosen", "rewards/rejected", "rewards/accuracies",
          "rewards/margins", "logps/chosen", "logps/rejected", "logits/kd", "logits/chosen", "logits/rejected", nll_loss))""",
)
def l16(spark, root):
    tokens = scalars(spark, root)
    means = kd.mean_logits(tokens, None, ["batch_id", "side"])
    rows = (
        kd.preference_loss(kd.scored_pairs(tokens, SEQ, PAIR))
        .join(kd.batchmean_kl(tokens, 1.0, ["batch_id"]), "batch_id")
        .join(kd.chosen_nll(tokens, by=["batch_id"]), "batch_id", "left")
        .join(kd.pivot_sides(means, ["batch_id"], "mean_logit", "logit_"), "batch_id")
    )
    return kd.batch_metrics(rows).select("batch_id", "split", "metric", r6("value").alias("value"))


@query(
    "l17_mean_logits",
    f"""SELECT batch_id, side, {R("sum(list_sum(student)) / sum(len(student))")} AS mean_logit
        FROM aligned WHERE loss_mask = 1 GROUP BY batch_id, side""",
)
def l17(spark, root):
    return kd.mean_logits(aligned(spark, root), "student", ["batch_id", "side"]).select(
        "batch_id", "side", r6("mean_logit").alias("mean_logit")
    )


# ---- hidden states --------------------------------------------------------------------------


def projected(spark, root):
    return hid.project(tables.hidden_student(spark, root), tables.projection(spark, root))


def mapped_pairs(spark, root):
    """Projected student layers next to the teacher layers they map to, positions trimmed."""
    student = projected(spark, root).withColumnRenamed("layer", "student_layer")
    student = student.withColumn("layer", hid.map_layer(F.col("student_layer"), 4, 6))
    pairs = hid.pair_positions(student, tables.hidden_teacher(spark, root), ["seq_id", "layer", "pos"])
    return pairs.withColumn("layer", F.col("student_layer")).drop("student_layer")


def _losses(df):
    return df.select("layer", r6("loss").alias("loss"))


def _typed(df):
    return df.select("loss_type", "layer", r6("loss").alias("loss"))


@query(
    "h1_layer_map",
    """SELECT s.seq_id, s.layer, count(*) AS positions, max(t.layer)::INT AS teacher_layer
       FROM hidden_student s JOIN hidden_teacher t ON t.seq_id = s.seq_id AND t.pos = s.pos
        AND t.layer = round_even(s.layer * 5 / 3, 0)
       GROUP BY s.seq_id, s.layer""",
)
def h1(spark, root):
    student = tables.hidden_student(spark, root).withColumn("teacher_layer", hid.map_layer(F.col("layer"), 4, 6))
    teacher = tables.hidden_teacher(spark, root).select("seq_id", "pos", F.col("layer").alias("teacher_layer"))
    return (
        student.join(teacher, ["seq_id", "pos", "teacher_layer"])
        .groupBy("seq_id", "layer")
        .agg(F.count(F.lit(1)).alias("positions"), F.max("teacher_layer").alias("teacher_layer"))
    )


@query(
    "h2_projection",
    f"SELECT seq_id, layer, pos, {R('list_sum(s)')} AS total, {R('s[1]')} AS first, {R('s[64]')} AS last FROM projected",
)
def h2(spark, root):
    return projected(spark, root).select(
        "seq_id",
        "layer",
        "pos",
        r6(vsum(F.col("h"))).alias("total"),
        r6(F.element_at("h", 1)).alias("first"),
        r6(F.element_at("h", 64)).alias("last"),
    )


@query(
    "h3_shape_rejects",
    "SELECT seq_id, pos, len(student)::INT AS student_width, len(teacher)::INT AS teacher_width FROM logits WHERE pos % 2 = 0",
)
def h3(spark, root):
    uneven = tables.logits(spark, root).select(
        "seq_id", "pos", F.when(F.col("pos") % 2 == 0, F.col("student")).otherwise(F.col("teacher")).alias("s"), F.col("teacher").alias("t")
    )
    return hid.shape_rejects(uneven).select(
        "seq_id", "pos", F.size("s").alias("student_width"), F.size("t").alias("teacher_width")
    )


@query("h4_mse", f"SELECT layer, {R('sum(sq) / (count(*) * 64)')} AS loss FROM errors GROUP BY layer")
def h4(spark, root):
    return _losses(hid.layer_loss(hid.checked_shapes(mapped_pairs(spark, root)), "mse"))


@query("h5_cosine", f"SELECT layer, {R('avg(1 - cos)')} AS loss FROM errors GROUP BY layer")
def h5(spark, root):
    return _losses(hid.layer_loss(mapped_pairs(spark, root), "cosine"))


@query("h6_huber", f"SELECT layer, {R('sum(hu) / (count(*) * 64)')} AS loss FROM errors GROUP BY layer")
def h6(spark, root):
    return _losses(hid.layer_loss(mapped_pairs(spark, root), "huber"))


@query(
    "h7_all_loss_types",
    f"""SELECT 'mse' AS loss_type, layer, {R('sum(sq) / (count(*) * 64)')} AS loss FROM errors GROUP BY layer
        UNION ALL SELECT 'cosine', layer, {R('avg(1 - cos)')} FROM errors GROUP BY layer
        UNION ALL SELECT 'huber', layer, {R('sum(hu) / (count(*) * 64)')} FROM errors GROUP BY layer""",
)
def h7(spark, root):
    return _typed(hid.layer_losses(mapped_pairs(spark, root)))


@query(
    "h8_scaled_layer_mean",
    f"SELECT {R('avg(loss) / 8')} AS kd FROM (SELECT layer, sum(sq) / (count(*) * 64) AS loss FROM errors GROUP BY layer)",
)
def h8(spark, root):
    return hid.scaled_layer_mean(hid.layer_loss(mapped_pairs(spark, root)), 64).select(r6("kd").alias("kd"))


@query(
    "h9_masked_losses",
    f"""SELECT 'mse' AS loss_type, layer, {R('sum(sq * m) / greatest(sum(m), 1)')} AS loss FROM errors GROUP BY layer
        UNION ALL SELECT 'cosine', layer, {R('sum(1 - cos * m) / greatest(sum(m), 1)')} FROM errors GROUP BY layer
        UNION ALL SELECT 'huber', layer, {R('sum(hu * m) / greatest(sum(m), 1)')} FROM errors GROUP BY layer""",
)
def h9(spark, root):
    return _typed(hid.masked_layer_losses(mapped_pairs(spark, root)))


@query(
    "h9_masked_losses_plain",
    f"""SELECT 'mse' AS loss_type, layer, {R('sum(sq * m) / greatest(sum(m) * 64, 1)')} AS loss FROM errors GROUP BY layer
        UNION ALL SELECT 'cosine', layer, {R('sum((1 - cos) * m) / greatest(sum(m), 1)')} FROM errors GROUP BY layer""",
)
def h9_plain(spark, root):
    return _typed(hid.masked_layer_losses(mapped_pairs(spark, root), ("mse", "cosine"), strict=False))


@query(
    "h10_mean_pool",
    f"""SELECT seq_id, layer, {R("sum(v)")} AS total, {R("max(v)")} AS largest FROM (
          SELECT seq_id, layer, d, sum(h[d] * mask) / greatest(sum(mask), 1) AS v
          FROM hidden_student CROSS JOIN (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL) GROUP BY seq_id, layer""",
)
def h10(spark, root):
    return hid.mean_pool(tables.hidden_student(spark, root)).select(
        "seq_id", "layer", r6(vsum(F.col("pooled"))).alias("total"), r6(F.array_max("pooled")).alias("largest")
    )


@query("h11_pooled_cosine", f"SELECT layer, {R('loss')} AS loss FROM pooled_loss")
def h11(spark, root):
    return _losses(hid.pooled_layer_loss(mapped_pairs(spark, root)))


def last_pairs(spark, root):
    student, teacher = hid.last_layers(tables.hidden_student(spark, root), tables.hidden_teacher(spark, root), 2)
    student = hid.project(student, tables.projection(spark, root), on="projection")
    pairs = hid.pair_positions(
        student.drop("layer"), teacher.drop("layer"), ["seq_id", "pair", "pos"]
    )
    return pairs.withColumnRenamed("pair", "layer")


@query(
    "h12_last_layers",
    f"""SELECT layer, {R("sum(1 - list_cosine_similarity(s, t) * s_mask * t_mask) / greatest(sum(s_mask * t_mask), 1)")} AS loss,
               (layer + 1)::INT AS projection FROM last_pairs GROUP BY layer""",
)
def h12(spark, root):
    losses = hid.masked_layer_loss(last_pairs(spark, root), "cosine", ["layer", "projection"])
    return losses.select("layer", "projection", r6("loss").alias("loss"))


@query(
    "h13_common_positions",
    """SELECT s.seq_id, s.layer, count(*) AS positions FROM hidden_student s
       JOIN hidden_teacher t ON t.seq_id = s.seq_id AND t.layer = s.layer AND t.pos = s.pos
       WHERE t.pos < 3 + s.seq_id % 3 GROUP BY s.seq_id, s.layer""",
)
def h13(spark, root):
    shorter = tables.hidden_teacher(spark, root).where(F.col("pos") < 3 + F.col("seq_id") % 3)
    pairs = hid.pair_positions(tables.hidden_student(spark, root), shorter, ["seq_id", "layer", "pos"])
    return pairs.groupBy("seq_id", "layer").agg(F.count(F.lit(1)).alias("positions"))


def trainlog(spark, root):
    return tables.trainlog_of(tables.base(spark, root, "events"))


@query(
    "h14_schedule",
    f"""SELECT step, (step < 1000)::INT AS use_pooled_kd, {R("least(0.7::DOUBLE, 0.7::DOUBLE * step / 1000)")} AS alpha FROM trainlog""",
)
def h14(spark, root):
    step = F.col("step")
    return trainlog(spark, root).select(
        "step", hid.use_pooled(step).cast("int").alias("use_pooled_kd"), r6(hid.ramped_alpha(step, 0.7)).alias("alpha")
    )


@query(
    "h15_guarded_total",
    """SELECT step, CASE WHEN bad THEN 0 ELSE loss_xe END AS loss_xe,
              CASE WHEN bad THEN loss_kd ELSE a * loss_kd + (1 - a) * loss_xe END AS loss_total
       FROM (SELECT *, loss_xe IS NULL OR isnan(loss_xe) AS bad, least(0.7::DOUBLE, 0.7::DOUBLE * step / 1000) AS a FROM trainlog)""",
)
def h15(spark, root):
    return hid.guarded_total(trainlog(spark, root), 0.7).select("step", "loss_xe", "loss_total")


@query(
    "h16_layer_mean",
    f"""SELECT {R("avg(loss)")} AS kd FROM pooled_loss""",
)
def h16(spark, root):
    return hid.layer_mean(hid.pooled_layer_loss(mapped_pairs(spark, root))).select(r6("kd").alias("kd"))
