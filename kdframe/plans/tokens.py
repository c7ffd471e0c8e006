"""Queries T1-T9 and P1-P7: encoding, batches, labels, budgets and preference batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kdframe.operators import preference as pref
from kdframe.operators import tokens as tok
from kdframe.operators import conversation as chat
from kdframe.operators.conversation import ASSISTANT_START, preference_format
from kdframe.operators.mixture import concat_sides, train_test_split
from kdframe.plans import tables
from kdframe.plans.catalog import digest, query, r6
from kdframe.session import materialize

LENGTH = 512
BATCH = 8
START, END = ASSISTANT_START, chat.END
START_PIECES = ["<|im_start|>", "assistant", "\n"]


def vocabulary(spark, root, tokeniser):
    """Built once from the whole text and kept on shared storage for the lookups."""
    raw = tok.explode_pieces(tables.fragments(spark, root), "fragment", [], tokeniser)
    return materialize(tok.build_vocabulary(raw))


def token_rows(spark, root, tokeniser="student", length=LENGTH):
    return tok.sequence_tokens(tables.fragments(spark, root), length, tokeniser=tokeniser)


def ids_of(spark, root, tokeniser, name, length=LENGTH, whole=None):
    if whole is None:
        whole = tok.sequence_texts(tables.fragments(spark, root), length)
    rows = tok.text_tokens(whole, length, tokeniser=tokeniser)
    return tok.collect_ids(tok.lookup_ids(rows, vocabulary(spark, root, tokeniser)), ["conv_id"], name=name)


def encoded(spark, root, length=LENGTH):
    """Ids of both tokenisers, of at most ``length`` tokens; of whole conversations without one."""
    whole = materialize(tok.sequence_texts(tables.fragments(spark, root), length))  # grouped once, for both
    student = ids_of(spark, root, "student", "input_ids", length, whole)
    return student.join(ids_of(spark, root, "teacher", "teacher_input_ids", length, whole), "conv_id")


def listing(name):
    return digest(tok.join_ints(F.col(name))).alias(name)


def _sql_list(column):
    return f"md5(array_to_string({column}, ','))"


@query("t1_vocabulary", "SELECT piece, n, id FROM student_vocabulary")
def t1_vocabulary(spark, root):
    return tok.build_vocabulary(tok.explode_pieces(tables.fragments(spark, root), "fragment", []))


@query("t1_vocabulary_teacher", "SELECT piece, n, id FROM teacher_vocabulary")
def t1_vocabulary_teacher(spark, root):
    return tok.build_vocabulary(tok.explode_pieces(tables.fragments(spark, root), "fragment", [], "teacher"))


@query(
    "t1_encode",
    f"""SELECT conv_id, len(input_ids)::INT AS n, len(teacher_input_ids)::INT AS teacher_n, {_sql_list("input_ids")} AS input_ids,
               {_sql_list("teacher_input_ids")} AS teacher_input_ids FROM encoded_whole""",
)
def t1_encode(spark, root):
    return encoded(spark, root, None).select(
        "conv_id",
        F.size("input_ids").alias("n"),
        F.size("teacher_input_ids").alias("teacher_n"),
        listing("input_ids"),
        listing("teacher_input_ids"),
    )


@query(
    "t2_truncate",
    f"SELECT conv_id, least(len(input_ids), 128)::INT AS n, {_sql_list('input_ids[1:128]')} AS input_ids FROM encoded",
)
def t2(spark, root):
    limit = tok.context_limit(F.lit(None).cast("int"), F.lit(128), F.lit(4096))
    cut = encoded(spark, root).withColumn("input_ids", tok.truncate(F.col("input_ids"), limit))
    return cut.select("conv_id", F.size("input_ids").alias("n"), listing("input_ids"))


def fixed(spark, root):
    """Padded to the full length; no pad token, so the end-of-text id fills."""
    fill = tok.pad_id(F.lit(None).cast("int"), F.lit(0))
    rows = encoded(spark, root)
    mask = tok.pad_right(tok.attention_mask(F.col("input_ids")), 0, LENGTH)
    return rows.withColumn("attention_mask", mask).withColumn(
        "input_ids", tok.pad_right(F.col("input_ids"), fill, LENGTH)
    )


_FIXED = f"input_ids || list_transform(range({LENGTH} - len(input_ids)), lambda x: 0)"


@query(
    "t3_pad_fixed",
    f"""SELECT conv_id, {_sql_list(_FIXED)} AS input_ids, {_sql_list(f"list_transform(range({LENGTH}), lambda k: (k < len(input_ids))::INT)")} AS attention_mask
        FROM encoded""",
)
def t3(spark, root):
    return fixed(spark, root).select("conv_id", listing("input_ids"), listing("attention_mask"))


def batched(spark, root):
    return tok.assign_batches(encoded(spark, root), ["conv_id"], BATCH, accumulation=4)


@query(
    "t4_dynamic_pad",
    f"""SELECT conv_id, batch_id, width::INT AS width,
               {_sql_list("input_ids || list_transform(range(width - len(input_ids)), lambda x: 0)")} AS input_ids,
               {_sql_list("teacher_input_ids || list_transform(range(width - len(teacher_input_ids)), lambda x: 2)")} AS teacher_input_ids,
               {_sql_list("input_ids || list_transform(range(width - len(input_ids)), lambda x: -100)")} AS labels,
               len(input_ids)::INT AS kept, len(teacher_input_ids)::INT AS teacher_kept FROM (
          SELECT *, least({LENGTH}, max(greatest(len(input_ids), len(teacher_input_ids))) OVER (PARTITION BY batch_id)) AS width FROM (
            SELECT e.*, place // {BATCH} AS batch_id FROM encoded e JOIN conv_batches USING (conv_id)))""",
)
def t4(spark, root):
    rows = batched(spark, root).withColumn("labels", tok.copied_labels(F.col("input_ids")))
    padded = tok.pad_batch(rows, "batch_id", "input_ids", "teacher_input_ids", LENGTH, teacher_fill=2, labels="labels")

    def kept(mask):
        return F.aggregate(mask, F.lit(0), lambda s, x: s + x)

    return padded.select(
        "conv_id",
        "batch_id",
        "width",
        listing("input_ids"),
        listing("teacher_input_ids"),
        listing("labels"),
        kept("input_ids_mask").alias("kept"),
        kept("teacher_input_ids_mask").alias("teacher_kept"),
    )


@query(
    "t5_copied_labels",
    f"SELECT conv_id, {_sql_list(_FIXED)} AS labels FROM encoded",
)
def t5(spark, root):
    return fixed(spark, root).withColumn("labels", tok.copied_labels(F.col("input_ids"))).select(
        "conv_id", listing("labels")
    )


_LABELS = """SELECT conv_id, md5(string_agg(CASE WHEN supervised THEN id ELSE -100 END, ',' ORDER BY pos)) AS labels
       FROM supervised JOIN student_vocabulary USING (piece) GROUP BY conv_id"""


def labelled(spark, root, marked):
    found = tok.lookup_ids(marked, vocabulary(spark, root, "student"))
    labels = found.withColumn("label", tok.span_labels(F.col("supervised"), F.col("id")))
    return tok.collect_ids(labels, ["conv_id"], "label", "labels").select("conv_id", listing("labels"))


@query("t6_span_labels", _LABELS)
def t6(spark, root):
    """Spans found in the text."""
    texts = tok.sequence_texts(tables.fragments(spark, root), LENGTH)
    marked = F.slice(tok.supervised_pieces(F.col("text"), START, END), 1, LENGTH)
    rows = texts.select("conv_id", F.posexplode(marked).alias("pos", "_t")).select("conv_id", "pos", "_t.*")
    return labelled(spark, root, rows)


@query("t6_span_labels_tokens", _LABELS)
def t6_tokens(spark, root):
    """Spans found in the token rows, for markers of any kind."""
    return labelled(spark, root, tok.mark_spans(token_rows(spark, root), START_PIECES, [END]))


@query(
    "t7_batches",
    f"SELECT conv_id, place // {BATCH} AS batch_id, place // {BATCH * 4} AS step_id FROM conv_batches",
)
def t7(spark, root):
    convs = tables.turns(spark, root).select("conv_id").distinct()
    return tok.assign_batches(convs, ["conv_id"], BATCH, accumulation=4)


def lengths(spark, root):
    """Token count of every conversation, untruncated."""
    counts = F.size(tok.pieces(F.col("fragment")))
    return tables.fragments(spark, root).groupBy("conv_id").agg(F.sum(counts).alias("length"))


@query(
    "t8_length_grouped",
    """SELECT batch_id, count(*) AS n_rows, sum(length)::BIGINT AS tokens, (max(length) * count(*))::BIGINT AS padded,
              (max(length) * count(*) - sum(length))::BIGINT AS padding FROM (
         SELECT length, (place // 20) * 5 + (row_number() OVER (PARTITION BY place // 20 ORDER BY length DESC, place) - 1) // 4 AS batch_id
         FROM conv_batches JOIN (SELECT conv_id, count(*) AS length FROM student_raw GROUP BY conv_id) USING (conv_id))
       GROUP BY batch_id""",
)
def t8(spark, root):
    grouped = tok.length_grouped_batches(lengths(spark, root), ["conv_id"], "length", 4, factor=5)
    return tok.padding_per_batch(grouped, "batch_id", "length")


@query(
    "t9_token_budget",
    f"""SELECT conv_id, full_tokens, tokens, supervised_tokens, (full_tokens > {LENGTH})::INT AS truncated FROM
          (SELECT conv_id, count(*) AS full_tokens FROM student_raw GROUP BY conv_id)
          JOIN (SELECT conv_id, count(*) AS tokens, count(*) FILTER (WHERE supervised) AS supervised_tokens
                FROM supervised GROUP BY conv_id) USING (conv_id)""",
)
def t9(spark, root):
    return budgets(spark, root).withColumn("truncated", (F.col("full_tokens") > LENGTH).cast("int"))


def budgets(spark, root):
    kept = tok.sequence_budget(tables.fragments(spark, root), LENGTH, START, END)
    return lengths(spark, root).withColumnRenamed("length", "full_tokens").join(kept, "conv_id")


@query(
    "t9_budget_report",
    f"""SELECT coalesce(split, 'ALL') AS split, coalesce(opening, 'ALL') AS opening, count(*) AS sequences, sum(tokens)::BIGINT AS tokens,
               sum(sup)::BIGINT AS supervised_tokens, count(*) FILTER (WHERE full_tokens > {LENGTH}) AS truncated,
               count(*) FILTER (WHERE sup = 0) AS unsupervised, quantile_cont(tokens, 0.5)::DOUBLE AS median_tokens,
               round(1 - sum(tokens) / (count(*) * {LENGTH}), 6) + 0.0 AS padding_ratio
        FROM (SELECT conv_id, count(*) AS full_tokens FROM student_raw GROUP BY conv_id)
        JOIN (SELECT conv_id, count(*) AS tokens, count(*) FILTER (WHERE supervised) AS sup FROM supervised GROUP BY conv_id) USING (conv_id)
        JOIN (SELECT conv_id, CASE WHEN place < ceil(0.1 * (SELECT count(*) FROM conv_batches)) THEN 'test' ELSE 'train' END AS split FROM conv_batches) USING (conv_id)
        JOIN (SELECT conv_id, role AS opening FROM conversations WHERE turn = 0) USING (conv_id)
        GROUP BY ROLLUP (split, opening)""",
)
def t9_report(spark, root):
    opening = tables.turns(spark, root).where("turn = 0").select("conv_id", F.col("role").alias("opening"))
    rows = train_test_split(budgets(spark, root), 0.1, ["conv_id"]).join(opening, "conv_id")
    report = tok.budget_report(rows, ["split", "opening"], LENGTH)
    return report.select(
        F.coalesce("split", F.lit("ALL")).alias("split"),
        F.coalesce("opening", F.lit("ALL")).alias("opening"),
        "sequences",
        "tokens",
        "supervised_tokens",
        "truncated",
        "unsupervised",
        r6("median_tokens").alias("median_tokens"),
        r6("padding_ratio").alias("padding_ratio"),
    )


# ---- preference batches ---------------------------------------------------------------------

PAIRS = 4


def pair_ids(spark, root):
    """Prompt and completion ids of both sides of every pair, in batches of four pairs.

    The vocabulary counts the text as the model sees it, prompts once per side. Encoding handles
    each text once and gives the prompt to both sides afterwards.
    """
    pairs = preference_format(tables.preferences(spark, root), keep=("conv_id", "turn"))
    batched_pairs = tok.assign_batches(pairs, ["conv_id", "turn"], PAIRS)
    keys = ["conv_id", "turn", "batch_id"]
    texts = F.inline(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("text")) for c in ("prompt", "chosen", "rejected")]))
    seen = concat_sides(pairs, ["conv_id", "turn", "prompt"], "chosen", "rejected")
    seen = seen.select(F.explode(F.array("prompt", "completion")).alias("text"))
    vocabulary_ = materialize(tok.build_vocabulary(tok.explode_pieces(seen, "text", [])))
    rows = tok.explode_pieces(batched_pairs.select(*keys, texts), "text", [*keys, "part"]).withColumnRenamed("at", "pos")
    found = tok.lookup_ids(rows, vocabulary_)
    ordered = lambda part: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("pos", "id")))), lambda t: t["id"].cast("int")
    ).alias(part)
    whole = found.groupBy(*keys).agg(ordered("prompt"), ordered("chosen"), ordered("rejected"))
    return concat_sides(whole, [*keys, F.col("prompt").alias("prompt_ids")], "chosen", "rejected").withColumnRenamed(
        "completion", "completion_ids"
    )


def pair_batches(spark, root):
    """Padded batches: prompts on the left, completions on the right, chosen rows first."""
    batch = Window.partitionBy("batch_id")
    width = lambda c: F.max(F.size(c)).over(batch)
    rows = pair_ids(spark, root).withColumn(
        "row_no", F.row_number().over(batch.orderBy("side", "conv_id", "turn")).cast("long") - 1
    )
    ones = lambda c: tok.attention_mask(F.col(c))
    sized = rows.withColumn("_p", width("prompt_ids")).withColumn("_c", width("completion_ids"))
    return sized.select(
        "batch_id",
        "row_no",
        tok.pad_left(F.col("prompt_ids"), 0, F.col("_p")).alias("prompt_ids"),
        tok.pad_left(ones("prompt_ids"), 0, F.col("_p")).alias("prompt_mask"),
        tok.pad_right(F.col("completion_ids"), 0, F.col("_c")).alias("completion_ids"),
        tok.pad_right(ones("completion_ids"), 0, F.col("_c")).alias("completion_mask"),
    )


def joined(spark, root):
    full = pref.join_prompt_completion(pair_batches(spark, root))
    return full.select("batch_id", "row_no", "input_ids", "attention_mask", "loss_mask")


def flushed(spark, root):
    return pref.flush_left(materialize(joined(spark, root)), "attention_mask", ["input_ids", "loss_mask"])


def total(name):
    return F.aggregate(name, F.lit(0), lambda s, x: s + x).alias(name)


@query(
    "p1_join_prompt_completion",
    f"""SELECT batch_id, row_no, (pw + cw)::INT AS width, {_sql_list('''list_transform(range(pw - len(p)), lambda x: 0) || p || c
                || list_transform(range(cw - len(c)), lambda x: 0)''')} AS input_ids,
               (len(p) + len(c))::INT AS attention_mask, len(c)::INT AS loss_mask FROM pref_padded""",
)
def p1(spark, root):
    return joined(spark, root).select(
        "batch_id", "row_no", F.size("input_ids").alias("width"), listing("input_ids"), total("attention_mask"), total("loss_mask")
    )


def _mask(first, last):
    return f"list_transform(range(tw), lambda k: (k >= {first} AND k < {last})::INT)"


@query(
    "p2_flush_left",
    f"""SELECT batch_id, row_no, tw::INT AS width, {_sql_list("ids")} AS input_ids,
               {_sql_list(_mask("0", "np + nc"))} AS attention_mask, {_sql_list(_mask("np", "np + nc"))} AS loss_mask FROM pref_flushed""",
)
def p2(spark, root):
    return flushed(spark, root).select(
        "batch_id",
        "row_no",
        F.size("input_ids").alias("width"),
        listing("input_ids"),
        listing("attention_mask"),
        listing("loss_mask"),
    )


def _truncated(spark, root, mode):
    cut = pref.truncate_batch(flushed(spark, root), ["input_ids", "attention_mask", "loss_mask"], 100, mode)
    return cut.select("batch_id", "row_no", listing("input_ids"), total("attention_mask"), total("loss_mask"))


@query(
    "p3_keep_end",
    f"""SELECT batch_id, row_no, {_sql_list("ids[greatest(tw - 100, 0) + 1 : tw]")} AS input_ids,
               greatest(np + nc - greatest(tw - 100, 0), 0)::INT AS attention_mask,
               greatest(np + nc - greatest(np, tw - 100), 0)::INT AS loss_mask FROM pref_flushed""",
)
def p3_end(spark, root):
    return _truncated(spark, root, "keep_end")


@query(
    "p3_keep_start",
    f"""SELECT batch_id, row_no, {_sql_list("ids[1:100]")} AS input_ids, least(np + nc, 100)::INT AS attention_mask,
               greatest(least(np + nc, 100) - np, 0)::INT AS loss_mask FROM pref_flushed""",
)
def p3_start(spark, root):
    return _truncated(spark, root, "keep_start")


@query(
    "p4_logits_to_keep",
    f"""SELECT batch_id, row_no, keep::INT AS logits_to_keep, {_sql_list("(ids[2:] || ids[1:1])[tw - keep + 1 : tw]")} AS labels
        FROM (SELECT *, tw - min(np) OVER (PARTITION BY batch_id) + 1 AS keep FROM pref_flushed)""",
)
def p4(spark, root):
    counted = pref.logits_to_keep(flushed(spark, root))
    labels = pref.keep_last(pref.roll(F.col("input_ids"), -1), F.col("logits_to_keep"))
    return counted.withColumn("labels", labels).select("batch_id", "row_no", "logits_to_keep", listing("labels"))


@query(
    "p5_flatten",
    """SELECT batch_id, row_no, pos::INT AS position_id, id AS input_id, (pos >= np)::INT AS loss_mask,
              (row_number() OVER (PARTITION BY batch_id ORDER BY row_no, pos) - 1)::INT AS flat_pos
       FROM pref_cells WHERE pos < np + nc""",
)
def p5(spark, root):
    flat = pref.flatten_batch(flushed(spark, root), "row_no")
    return flat.select(
        "batch_id",
        "row_no",
        F.col("position_id").cast("int").alias("position_id"),
        F.col("input_ids").alias("input_id"),
        "loss_mask",
        "flat_pos",
    )


@query(
    "p5_unflatten",
    """SELECT batch_id, row_no, md5(string_agg(CASE WHEN pos < np + nc THEN id * 2 ELSE 0 END, ',' ORDER BY pos)) AS vals
       FROM pref_cells GROUP BY batch_id, row_no""",
)
def p5_back(spark, root):
    rows = materialize(flushed(spark, root))  # read by both ways
    flat = pref.flatten_batch(rows, "row_no").withColumn("value", F.col("input_ids") * 2)
    grid = pref.unflatten_batch(rows, flat, "value", "row_no")
    return tok.collect_ids(grid, ["batch_id", "row_no"], "value", "vals").select("batch_id", "row_no", listing("vals"))


@query(
    "p6_align_labels",
    f"""SELECT batch_id, row_no, {_sql_list("ids[2:] || ids[1:1]")} AS labels,
               {_sql_list(_mask("np - 1", "np + nc - 1"))} AS loss_mask FROM pref_flushed""",
)
def p6(spark, root):
    return pref.align_labels(flushed(spark, root)).select("batch_id", "row_no", listing("labels"), listing("loss_mask"))


@query(
    "p7_masked_labels",
    f"""SELECT batch_id, row_no, {_sql_list("list_transform(range(tw), lambda k: CASE WHEN k >= np - 1 AND k < np + nc - 1 THEN ids[k + 2] ELSE 0 END)")} AS labels
        FROM pref_flushed""",
)
def p7(spark, root):
    aligned = pref.align_labels(flushed(spark, root))
    labels = pref.masked(F.col("labels"), F.col("loss_mask"))
    return aligned.withColumn("labels", labels).select("batch_id", "row_no", listing("labels"))
