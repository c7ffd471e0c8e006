"""Loss audits over saved logits: one row per ``(seq_id, pos)``, vocabulary-wide arrays.

Each row's vocabulary work is row-local, so only scalars are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kdframe.functions.vectors import (
    doubles,
    kl_divergence,
    let,
    log_softmax,
    logsumexp,
    pad_zeros,
    vsum,
)
from kdframe.session import broadcast_if_fits, materialize

# fixed values
IGNORE = -100
KD_COEFFICIENT = 0.001
BROADCAST_LABELS = 1_000_000


def align_vocabularies(df: DataFrame, student: str = "student", teacher: str = "teacher") -> DataFrame:
    """Pad the narrower side with zeros; a zero logit still takes probability mass."""
    width = F.greatest(F.size(student), F.size(teacher))
    return df.withColumn("_width", width).withColumns(
        {
            student: pad_zeros(doubles(F.col(student)), F.col("_width")),
            teacher: pad_zeros(doubles(F.col(teacher)), F.col("_width")),
        }
    ).drop("_width")


def sequence_kl(df: DataFrame, temperature: float, by: Sequence[str] = ()) -> DataFrame:
    """Divergence from the student to the teacher summed over all positions of a sequence.

    Rows of ``token_scalars`` have it at temperature 1.
    """
    known = temperature == 1.0 and "kl" in df.columns
    kl = F.col("kl") if known else kl_divergence(F.col("teacher"), F.col("student"), temperature)
    return df.groupBy(*by, "seq_id").agg(F.sum(kl).alias("kl"))


def batchmean_kl(df: DataFrame, temperature: float, by: Sequence[str] = ()) -> DataFrame:
    """Sum over everything, divided by the number of sequences, times the squared temperature.

    Masks play no part: padding positions count too.
    """
    return sequence_kl(df, temperature, by).groupBy(*by).agg(
        (F.sum("kl") / F.count(F.lit(1)) * (temperature**2)).alias("kd")
    )


def blend(kd: Column, ce: Column, alpha: Column | float) -> Column:
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    return alpha * kd + (1 - alpha) * ce


def selective_log_softmax(logits: Column, index: Column) -> Column:
    """Log-probability of one vocabulary entry."""
    return F.element_at(logits, (index + 1).cast("int")) - logsumexp(logits)


def shifted_cross_entropy(
    df: DataFrame, logits: str, label: str, by: Sequence[str] = (), seq: str = "seq_id"
) -> DataFrame:
    """Mean next-token loss over the positions whose next label is not ignored.

    The next label is found on ids and labels alone. Up to ``BROADCAST_LABELS`` supervised positions
    (counted) are brought to the logits, which then stay where they are; beyond that, only the rows
    of supervised positions are shuffled.
    """
    follows = F.lead(label).over(Window.partitionBy(seq).orderBy("pos"))
    wanted = df.select(seq, "pos", follows.alias("_next")).where(F.col("_next").isNotNull() & (F.col("_next") != IGNORE))
    shifted = df.join(broadcast_if_fits(materialize(wanted), BROADCAST_LABELS), [seq, "pos"])
    return shifted.groupBy(*by).agg(F.avg(-selective_log_softmax(F.col(logits), F.col("_next"))).alias("ce"))


def token_scalars(
    df: DataFrame, student: str = "student", teacher: str = "teacher", label: str = "label", mask: str = "loss_mask"
) -> DataFrame:
    """All that the losses of a token need, without its logits; from aligned vocabularies.

    ``label_or_zero``: the label, read as entry 0 where masked. ``logp`` and ``ref_logp``: its
    log-probability under the student and the teacher, 0 where masked. ``adjustment``: the logarithm
    of the student's summed squared probabilities. ``kl``: the divergence from the student to the
    teacher. ``logit_sum`` and ``width``: of the student's logits. One pass over the vocabulary-wide
    arrays; every loss is an aggregate of these numbers.
    """
    kept = [c for c in df.columns if c not in (student, teacher)]
    wanted = F.when(F.col(mask) == 1, F.col(label)).otherwise(F.lit(0))
    lse = df.withColumns(
        {"label_or_zero": wanted, "_s": logsumexp(F.col(student)), "_t": logsumexp(F.col(teacher))}
    )

    def scored(logits: str, total: str) -> Column:
        entry = F.element_at(logits, (F.col("label_or_zero") + 1).cast("int"))
        return F.when(F.col(mask) == 1, entry - F.col(total)).otherwise(F.lit(0.0))

    def term(t: Column, s: Column) -> Column:
        return F.exp(t - F.col("_t")) * ((t - F.col("_t")) - (s - F.col("_s")))

    return lse.select(
        *kept,
        "label_or_zero",
        scored(student, "_s").alias("logp"),
        scored(teacher, "_t").alias("ref_logp"),
        (logsumexp(F.transform(student, lambda x: 2.0 * x)) - 2.0 * F.col("_s")).alias("adjustment"),
        vsum(F.zip_with(teacher, student, term)).alias("kl"),
        vsum(F.col(student)).alias("logit_sum"),
        F.size(student).alias("width"),
    )


def token_logps(df: DataFrame, logits: str, label: str = "label", mask: str = "loss_mask") -> DataFrame:
    """``logp`` of the aligned label, 0 where masked. A masked label is read as entry 0."""
    wanted = F.when(F.col(mask) == 1, F.col(label)).otherwise(F.lit(0))
    scored = F.when(F.col(mask) == 1, selective_log_softmax(F.col(logits), wanted)).otherwise(F.lit(0.0))
    return df.withColumn("label_or_zero", wanted).withColumn("logp", scored)


def sequence_logps(tokens: DataFrame, by: Sequence[str], per_token: bool = False, mask: str = "loss_mask") -> DataFrame:
    """Sum of token log-probabilities; ``per_token`` divides by the row's masked length."""
    total = F.sum("logp")
    # a row without loss tokens has no mean
    value = F.try_divide(total, F.sum(mask)) if per_token else total
    return tokens.groupBy(*by).agg(value.alias("logp"))


def policy_weights(
    tokens: DataFrame, logits: str | None = None, pair: str = "pair_id", strict: bool = True, mask: str = "loss_mask"
) -> DataFrame:
    """``min(1, exp(wc + wr))`` per pair, ``w`` the masked mean of ``logp - logsumexp(2 log p)``.

    Without ``logits``, ``tokens`` are those of ``token_scalars``.

    ``strict`` keeps the original alignment: log-probabilities rolled by one position (cyclically)
    against adjustments and mask that are not. Otherwise all three are taken at the same position.
    """
    adjustment = F.col("adjustment") if logits is None else let(
        log_softmax(F.col(logits)), lambda lp: logsumexp(F.transform(lp, lambda x: 2.0 * x))
    )
    # vocabulary-wide work is done before the window, so that only scalars are shuffled
    tokens = tokens.select(pair, "side", "seq_id", "pos", "logp", mask, adjustment.alias("_adjustment"))
    if strict:
        row = Window.partitionBy("seq_id").orderBy("pos")
        whole = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        logp = F.coalesce(F.lag("logp").over(row), F.last("logp").over(whole))
    else:
        logp = F.col("logp")
    terms = tokens.withColumn("_term", (logp - F.col("_adjustment")) * F.col(mask))
    weights = terms.groupBy(pair, "side").agg(F.try_divide(F.sum("_term"), F.sum(mask)).alias("_w"))
    return weights.groupBy(pair).agg(
        F.least(F.exp(F.sum("_w")), F.lit(1.0)).alias("policy_weight")
    )


def chosen_nll(tokens: DataFrame, logits: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Cross-entropy on the chosen side, skipping every label 0 (a real token 0 included).

    Without ``logits``, ``tokens`` are those of ``token_scalars``.
    """
    wanted = tokens.where((F.col("side") == "chosen") & (F.col("label_or_zero") != 0))
    # a label that is not 0 is not masked
    loss = -F.col("logp") if logits is None else -selective_log_softmax(F.col(logits), F.col("label_or_zero"))
    return wanted.groupBy(*by).agg(F.avg(loss).alias("nll"))


def pivot_sides(sequences: DataFrame, by: Sequence[str], value: str = "logp", prefix: str = "") -> DataFrame:
    return sequences.groupBy(*by).agg(
        F.max(F.when(F.col("side") == "chosen", F.col(value))).alias(f"{prefix}chosen"),
        F.max(F.when(F.col("side") == "rejected", F.col(value))).alias(f"{prefix}rejected"),
    )


def softplus(x: Column) -> Column:
    """``log(1 + exp(x))`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def preference_loss(df: DataFrame, beta: float = 0.1) -> DataFrame:
    """Pair loss and rewards from policy (``chosen``, ``rejected``) and ``ref_*`` log-probabilities."""
    chosen = beta * (F.col("chosen") - F.col("ref_chosen"))
    rejected = beta * (F.col("rejected") - F.col("ref_rejected"))
    return (
        df.withColumn("reward_chosen", chosen)
        .withColumn("reward_rejected", rejected)
        .withColumn("loss", softplus(-(F.col("reward_chosen") - F.col("reward_rejected"))))
    )


def stored_or_computed(computed: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reference log-probabilities: the stored pair when both values are there, else the computed."""
    kept = stored.select(*keys, F.col("ref_chosen").alias("_c"), F.col("ref_rejected").alias("_r"))
    both = F.col("_c").isNotNull() & F.col("_r").isNotNull()
    return (
        computed.join(kept, list(keys), "left")
        .withColumn("ref_chosen", F.when(both, F.col("_c")).otherwise(F.col("ref_chosen")))
        .withColumn("ref_rejected", F.when(both, F.col("_r")).otherwise(F.col("ref_rejected")))
        .drop("_c", "_r")
    )


def combined_loss(
    loss: Column,
    kd: Column,
    nll: Column | None = None,
    rpo_alpha: float | None = None,
    weight: Column | None = None,
    aux: Column | None = None,
    aux_coefficient: float = 0.0,
) -> Column:
    """Pair loss, plus the chosen-side term, times the policy weight, plus aux and divergence terms."""
    total = loss
    if rpo_alpha is not None and nll is not None:
        total = total + rpo_alpha * nll
    if weight is not None:
        total = total * weight
    if aux is not None:
        total = total + aux_coefficient * aux
    return total + KD_COEFFICIENT * kd


def response_mse(df: DataFrame, student: str, teacher: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(student) - F.col(teacher), 2)).alias("mse"))


def mean_logits(tokens: DataFrame, logits: str | None, by: Sequence[str], mask: str = "loss_mask") -> DataFrame:
    """Mean logit over masked-in tokens and the whole vocabulary.

    Without ``logits``, ``tokens`` are those of ``token_scalars``.
    """
    kept = tokens.where(F.col(mask) == 1)
    total, width = (F.col("logit_sum"), F.col("width")) if logits is None else (vsum(F.col(logits)), F.size(logits))
    return kept.groupBy(*by).agg((F.sum(total) / F.sum(width)).alias("mean_logit"))


def scored_pairs(tokens: DataFrame, seq: Sequence[str], pair: Sequence[str]) -> DataFrame:
    """Log-probabilities of both sides of each pair, of the student and (``ref_``) of the teacher, from ``token_scalars``."""
    whole = tokens.groupBy(*seq).agg(F.sum("logp").alias("logp"), F.sum("ref_logp").alias("ref_logp"))
    sides = [
        F.max(F.when(F.col("side") == side, F.col(f"{prefix}logp"))).alias(f"{prefix}{side}")
        for prefix in ("", "ref_")
        for side in ("chosen", "rejected")
    ]
    return whole.groupBy(*pair).agg(*sides)


# fixed values: names of the logged metrics and the columns they average
METRICS = {
    "rewards/chosen": "reward_chosen",
    "rewards/rejected": "reward_rejected",
    "rewards/accuracies": "accuracy",
    "rewards/margins": "margin",
    "logps/chosen": "chosen",
    "logps/rejected": "rejected",
    "logits/chosen": "logit_chosen",
    "logits/rejected": "logit_rejected",
    "logits/kd": "kd",
    "nll_loss": "nll",
    "aux_loss": "aux",
}


def batch_metrics(pairs: DataFrame, by: Sequence[str] = ("batch_id", "split")) -> DataFrame:
    """Long-form means per batch and split; evaluation metrics get the ``eval_`` prefix.

    Metrics whose column is absent (switched off) are left out.
    """
    scored = pairs.withColumn(
        "accuracy", (F.col("reward_chosen") > F.col("reward_rejected")).cast("double")
    ).withColumn("margin", F.col("reward_chosen") - F.col("reward_rejected"))
    present = {name: c for name, c in METRICS.items() if c in scored.columns}
    wide = scored.groupBy(*by).agg(*[F.avg(c).alias(name) for name, c in present.items()])
    tall = wide.unpivot(list(by), list(present), "metric", "value")
    prefix = F.when(F.col("split") == "eval", "eval_").otherwise("")
    return tall.withColumn("metric", F.concat(prefix, F.col("metric")))
