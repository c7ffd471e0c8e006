"""Queries E1-E22 and U1-U4: prompts, scoring, reports and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kdframe import registry
from kdframe.operators import adapters, eval_prompts, eval_reports, eval_scoring
from kdframe.operators.conversation import render_with_template
from kdframe.operators.ranking import prefix_sum, range_bucket
from kdframe.operators.tokens import pieces
from kdframe.plans import tables
from kdframe.plans.catalog import digest, query, r6, spoken
from kdframe.session import fresh_path
from kdframe.sources.benchmarks import compare_benchmark_models
from kdframe.sources.tables import read_reports, write_reports


def R(x):  # noqa: N802  (short name for SQL texts)
    return f"round({x}, 6) + 0.0"


def prompts_of(df, *keys):
    return df.select(*keys, digest("query").alias("query"), digest(F.array_join("choices", "|")).alias("choices"), "gold_index")


# ---- prompts --------------------------------------------------------------------------------


_WIKI = "replace(regexp_replace(replace({}, ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ')"


@query(
    "e1_hellaswag",
    rf"""SELECT doc_id, md5({_WIKI.format("source || ': ' || 'Step [title] one  two' || ' ' || upper(text[1:1]) || lower(text[2:]) || ' '")}) AS query,
                md5(' ' || {_WIKI.format("'end [cut] ' || text")} || '| ' || {_WIKI.format("'  [title]' || lang")}) AS choices,
                CASE WHEN doc_id % 4 = 3 THEN -1 ELSE doc_id % 4 END::INT AS gold_index FROM documents""",
)
def e1(spark, root):
    rows = tables.texts(spark, root).select(
        "doc_id",
        F.col("source").alias("activity_label"),
        F.lit("Step [title] one  two").alias("ctx_a"),
        F.col("text").alias("ctx_b"),
        F.array(F.concat(F.lit("end [cut] "), "text"), F.concat(F.lit("  [title]"), "lang")).alias("endings"),
        F.when(F.col("doc_id") % 4 == 3, "").otherwise((F.col("doc_id") % 4).cast("string")).alias("label"),
    )
    return prompts_of(eval_prompts.hellaswag(rows), "doc_id")


def commonsense(spark, root):
    return eval_prompts.commonsense_qa(
        tables.texts(spark, root).select(
            "doc_id",
            F.col("text").alias("question"),
            F.array(*[F.lit(c) for c in "ABCDE"]).alias("labels"),
            F.array(F.col("lang"), F.col("source"), F.lit("x"), F.lit("y"), F.lit("z")).alias("texts"),
            F.concat(F.lit(" "), F.element_at(F.array(*[F.lit(c) for c in "ABCDEF"]), (F.col("doc_id") % 6 + 1).cast("int")), F.lit("\n")).alias("answer_key"),
        )
    )


@query(
    "e2_commonsense_qa",
    """SELECT doc_id, md5(text) AS query, md5(' ' || lang || '| ' || source || '| x| y| z') AS choices, (doc_id % 6)::INT AS gold_index
       FROM documents WHERE doc_id % 6 < 5""",
)
def e2(spark, root):
    return prompts_of(commonsense(spark, root)[0], "doc_id")


@query("e2_commonsense_qa_rejects", "SELECT doc_id FROM documents WHERE doc_id % 6 = 5")
def e2_rejects(spark, root):
    return commonsense(spark, root)[1].select("doc_id")


@query(
    "e3_mmlu_pro",
    """SELECT doc_id, md5('The following are multiple choice questions (with answers) about topic ' || lang || '.' || chr(10) || chr(10)
         || text || chr(10) || 'A. ' || source || chr(10) || 'B. ' || lang || chr(10) || 'C. none' || chr(10) || 'Answer:') AS query,
         md5('A|B|C') AS choices, (doc_id % 3)::INT AS gold_index FROM documents""",
)
def e3(spark, root):
    rows = tables.texts(spark, root).select(
        "doc_id",
        F.concat(F.lit("topic_"), "lang").alias("category"),
        F.col("text").alias("question"),
        F.array(F.col("source"), F.col("lang"), F.lit("none")).alias("options"),
        (F.col("doc_id") % 3).cast("int").alias("answer_index"),
    )
    return prompts_of(eval_prompts.mmlu_pro(rows), "doc_id")


@query(
    "e4_bbh",
    """SELECT item_id, md5('Question: ' || input || chr(10) || 'Answer: ') AS query, md5(target) AS choices, 0::INT AS gold_index
       FROM items WHERE task = 'bbh'""",
)
def e4(spark, root):
    return prompts_of(eval_prompts.bbh(tables.items(spark, root).where("task = 'bbh'")), "item_id")


@query(
    "e5_math",
    """SELECT item_id, md5('Problem:' || chr(10) || input || chr(10) || chr(10) || 'Solution:' || chr(10)) AS query,
              md5(target || chr(10)) AS choices, 0::INT AS gold_index FROM items WHERE task = 'math'""",
)
def e5(spark, root):
    rows = tables.items(spark, root).where("task = 'math'").withColumnsRenamed({"input": "problem", "target": "solution"})
    return prompts_of(eval_prompts.math(rows), "item_id")


@query(
    "e6_rewrite",
    """SELECT CASE WHEN item_id % 2 = 0 THEN 'id-' || item_id ELSE (row_number() OVER (ORDER BY item_id) - 1)::VARCHAR END AS item,
              'Rewrite the text to be clearer, friendlier, and concise, preserving meaning. Return only the rewritten text.'
              || chr(10) || chr(10) || 'Text:' || chr(10) || source AS query FROM rewrites""",
)
def e6(spark, root):
    rows = tables.rewrites(spark, root)
    numbered = prefix_sum(rows, ["item_id"], [range_bucket(F.col("item_id"), 1 << 20)], name="place")
    own = numbered.withColumn("id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("id-"), F.col("item_id").cast("string"))))
    return eval_prompts.rewrite(own, "place").select("item", "query")


@query(
    "e7_question_answer",
    """SELECT item_id, md5('Question: ' || input || chr(10) || CASE WHEN task = 'arc'
         THEN 'A. ' || target || chr(10) || 'B. ' || subset || chr(10) ELSE '' END || 'Answer:') AS query FROM items""",
)
def e7(spark, root):
    options = F.array("target", "subset")
    built = F.when(F.col("task") == "arc", eval_prompts.question_answer(F.col("input"), options)).otherwise(
        eval_prompts.question_answer(F.col("input"))
    )
    return tables.items(spark, root).select("item_id", digest(built).alias("query"))


def examples(spark, root):
    example = F.concat(F.lit("Question: "), "subset", F.lit(" "), "target")
    return tables.items(spark, root).withColumn("example", example)


def _few(df):
    return df.select("item_id", "task", "few_shot")


@query(
    "e8_few_shots_random",
    """SELECT item_id, task, coalesce(shots, '') AS few_shot FROM items LEFT JOIN (
         SELECT task, string_agg('Question: ' || subset || ' ' || target || chr(10) || chr(10), '' ORDER BY k) AS shots FROM (
           SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('42:' || item_id), item_id) AS k FROM items WHERE split = 'train')
         WHERE k <= 5 GROUP BY task) USING (task) WHERE split = 'test'""",
)
def e8_random(spark, root):
    rows = examples(spark, root)
    return _few(eval_prompts.few_shots(rows.where("split = 'test'"), rows.where("split = 'train'"), 5))


@query(
    "e8_few_shots_sequential",
    """SELECT item_id, task, coalesce(shots, '') AS few_shot FROM items LEFT JOIN (
         SELECT task, string_agg('Question: ' || subset || ' ' || target || chr(10) || chr(10), '' ORDER BY k) AS shots FROM (
           SELECT *, row_number() OVER (PARTITION BY task ORDER BY item_id) AS k FROM items WHERE split = 'validation')
         WHERE k <= 4 GROUP BY task) USING (task) WHERE split = 'test'""",
)
def e8_sequential(spark, root):
    rows = examples(spark, root)
    return _few(
        eval_prompts.few_shots(rows.where("split = 'test'"), rows.where("split = 'validation'"), 4, select="sequential")
    )


@query(
    "e8_few_shots_same_split",
    """SELECT item_id, task, coalesce(string_agg(shot, '' ORDER BY k), '') AS few_shot FROM (
         SELECT item_id, task, shot, k, row_number() OVER (PARTITION BY item_id ORDER BY k) AS place FROM
           (SELECT item_id, task FROM items WHERE split = 'train')
           JOIN (SELECT task, item_id AS shot_id, 'Question: ' || subset || ' ' || target || chr(10) || chr(10) AS shot,
                        row_number() OVER (PARTITION BY task ORDER BY md5('42:' || item_id), item_id) AS k
                 FROM items WHERE split = 'train') USING (task) WHERE k <= 4 AND shot_id <> item_id) WHERE place <= 3 GROUP BY ALL""",
)
def e8_same(spark, root):
    rows = examples(spark, root).where("split = 'train'")
    return _few(eval_prompts.few_shots(rows, rows, 3, same_split=True))


@query(
    "e9_stops_and_caps",
    r"""SELECT item_id, md5(out) AS output, md5(array_to_string(regexp_extract_all(out,
               '<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|\n| ?\p{L}+| ?\p{N}+|[^\p{L}\p{N}]')[1:256], '')) AS capped FROM (
         SELECT item_id, CASE WHEN item_id % 3 = 0 THEN input || ' Question' ELSE input || CASE WHEN item_id % 3 = 1 THEN '' ELSE ' Problem ' END END AS out
         FROM items)""",
)
def e9(spark, root):
    tail = (
        F.when(F.col("item_id") % 3 == 0, " QuestionProblem: more Question: end")
        .when(F.col("item_id") % 3 == 1, "Problem: and Question")
        .otherwise(" Problem ")
    )
    generated = tables.items(spark, root).select("item_id", F.concat("input", tail).alias("out"))
    cut = generated.withColumn("out", eval_prompts.cut_at_stops(F.col("out"), ["Question:", "Problem:"]))
    return cut.select(
        "item_id", digest("out").alias("output"), digest(eval_prompts.cap_tokens(F.col("out"), 256)).alias("capped")
    )


SUITE = ["custom|arc|0|1", "custom|bbh|3|1", "custom|math|4|1", "custom|gsm8k|5|1"]


def plan_of(spark, suite=SUITE):
    """The suite's lines with the registry's fields."""
    lines = spark.createDataFrame([(line,) for line in suite], "value string")
    return eval_prompts.expand_suite(eval_prompts.parse_suite(lines), eval_prompts.task_registry(spark))


def suite_items(spark, root):
    """Items of the suite's kinds, each with the columns of its prompt."""
    rows = tables.suite_items(spark, root)
    family = F.split("task", ":")[0]
    labels = F.array(F.lit("A"), F.lit("B"))
    return {
        "arc": rows.where(family == "arc").select(
            "task", "item_id", "split", F.col("input").alias("question"), labels.alias("labels"), F.array("source", "lang").alias("texts"),
            F.when(F.col("item_id") % 2 == 0, "A").otherwise(" B\n").alias("answer_key"),
        ),
        "bbh": rows.where(family == "bbh"),
        "math": rows.where(family == "math").withColumnsRenamed({"input": "problem", "target": "solution"}),
        "gsm8k": rows.where(family == "gsm8k").withColumnsRenamed({"input": "question", "target": "answer"}),
    }


@query(
    "e8_suite_prompts",
    """WITH asked AS (
         SELECT *, CASE prompt WHEN 'bbh' THEN 3 WHEN 'math' THEN 4 WHEN 'gsm8k' THEN 5 ELSE 0 END AS shots,
                CASE prompt WHEN 'bbh' THEN 'Question: ' || input || chr(10) || 'Answer: '
                     WHEN 'math' THEN 'Problem:' || chr(10) || input || chr(10) || chr(10) || 'Solution:' || chr(10)
                     ELSE 'Question: ' || input || chr(10) || 'Answer:' END AS query,
                CASE prompt WHEN 'bbh' THEN target WHEN 'math' THEN target || chr(10) WHEN 'gsm8k' THEN ' ' || target
                     ELSE ' ' || CASE WHEN item_id % 2 = 0 THEN source ELSE lang END END AS right_choice
         FROM suite_items WHERE prompt IN ('arc', 'bbh', 'math', 'gsm8k')),
       pool AS (
         SELECT task, item_id AS shot_id, query || right_choice || chr(10) || chr(10) AS shot, row_number() OVER (PARTITION BY task
                  ORDER BY CASE WHEN few_shot_select = 'sequential' THEN '' ELSE md5('42:' || item_id) END, item_id) AS k
         FROM asked JOIN (SELECT task, few_shot_select, few_shot_split FROM registry) USING (task)
         WHERE split = coalesce(few_shot_split, 'train')),
       shown AS (
         SELECT item_id, string_agg(shot, '' ORDER BY k) AS few_shot FROM (
           SELECT item_id, shot, k, shots, row_number() OVER (PARTITION BY item_id ORDER BY k) AS place
           FROM asked JOIN pool USING (task) WHERE k <= shots + 1 AND shot_id <> item_id) WHERE place <= shots GROUP BY item_id)
       SELECT item_id, task, shots::INT AS shots, generation_size, md5(coalesce(few_shot, '') || query) AS prompt
       FROM asked JOIN (SELECT task, generation_size, evaluation_splits FROM registry) USING (task) LEFT JOIN shown USING (item_id)
       WHERE list_contains(evaluation_splits, split)""",
)
def e8_suite(spark, root):
    asked = eval_prompts.suite_prompts(registry.build_prompts(suite_items(spark, root)), plan_of(spark))
    return asked.select("item_id", "task", "shots", "generation_size", digest(F.concat("few_shot", "query")).alias("prompt"))


@query(
    "e9_suite_outputs",
    r"""WITH outputs AS (
          SELECT item_id, task, stops, generation_size,
                 input || [' Question: more Problem: end', 'Problem: and Question', ' end'][item_id % 3 + 1] AS out
          FROM suite_items JOIN (SELECT task, stops, generation_size FROM registry) USING (task)),
        cut AS (
          SELECT *, coalesce(out[1:list_min(list_filter(list_transform(stops, lambda s: strpos(out, s)), lambda p: p > 0)) - 1], out) AS kept FROM outputs)
        SELECT item_id, task, md5(CASE WHEN generation_size IS NULL THEN kept ELSE array_to_string(regexp_extract_all(kept,
               '<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|
| ?\p{L}+| ?\p{N}+|[^\p{L}\p{N}]')[1:generation_size], '') END) AS output FROM cut""",
)
def e9_suite(spark, root):
    tails = F.array(*map(F.lit, (" Question: more Problem: end", "Problem: and Question", " end")))
    said = F.concat("input", F.get(tails, (F.col("item_id") % 3).cast("int")))
    # broadcast: the registry has 42 fixed rows
    rows = tables.suite_items(spark, root).join(F.broadcast(eval_prompts.task_registry(spark)), "task")
    cut = rows.withColumn("out", eval_prompts.cut_at_stops(said, F.col("stops")))
    return cut.select("item_id", "task", digest(eval_prompts.cap_tokens(F.col("out"), F.col("generation_size"))).alias("output"))


# ---- scoring --------------------------------------------------------------------------------


@query(
    "e10_choice_accuracy",
    f"""SELECT gold, count(*) AS items, {R("avg(hit)")} AS acc FROM (
          SELECT gold, (list_position(scores, list_max(scores)) - 1 = gold)::INT AS hit FROM (
            SELECT gold, list_transform(range(1, 5), lambda i: logps[i] / length(ltrim(choices[i]))) AS scores FROM choices))
        GROUP BY gold""",
)
def e10(spark, root):
    hits = tables.choices(spark, root).withColumn(
        "acc", eval_scoring.choice_hit(F.col("logps"), F.col("choices"), F.col("gold"))
    )
    return eval_scoring.corpus_mean(hits, "acc", ["gold"]).select("gold", "items", r6("acc").alias("acc"))


@query(
    "e11_exact_match",
    f"""SELECT CASE WHEN conv_id % 3 = 0 THEN 'changed' ELSE 'same' END AS task, count(*) AS items,
               {R("avg((conv_id % 3 <> 0 OR turn % 2 = 1)::INT)")} AS em FROM qa GROUP BY 1""",
)
def e11(spark, root):
    changed = (F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 0)
    pairs = tables.qa(spark, root).select(
        F.when(F.col("conv_id") % 3 == 0, "changed").otherwise("same").alias("task"),
        F.concat(F.lit(" \t\n"), "answer", F.when(changed, "!").otherwise(" \n")).alias("prediction"),
        F.col("answer").alias("gold"),
    )
    hits = pairs.withColumn("em", eval_scoring.exact_match(F.col("prediction"), F.col("gold")))
    return eval_scoring.corpus_mean(hits, "em").select("task", "items", r6("em").alias("em"))


_PLAIN = r"""array_to_string(list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'),
  lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"""


@query(
    "e12_quasi_exact_match",
    f"""SELECT task, count(*) AS items, {R("avg((p = g OR p = 'other ' || task)::INT)")} AS qem FROM (
          SELECT source AS task, {_PLAIN.format("lower(text)")} AS g, {_PLAIN.format("""CASE doc_id % 4 WHEN 0 THEN 'The  ' || text || '!!'
            WHEN 1 THEN text || ' an. the a' WHEN 2 THEN ' ''other'' ' || source || chr(10) ELSE text || ' wrong' END""")} AS p FROM documents)
        GROUP BY task""",
)
def e12(spark, root):
    kind = F.col("doc_id") % 4
    answer = (
        F.when(kind == 0, F.concat(F.lit("The  "), "text", F.lit("!!")))
        .when(kind == 1, F.concat("text", F.lit(" an. the a")))
        .when(kind == 2, F.concat(F.lit(" 'other' "), "source", F.lit("\n")))
        .otherwise(F.concat("text", F.lit(" wrong")))
    )
    rows = tables.texts(spark, root).select(
        F.col("source").alias("task"),
        answer.alias("prediction"),
        F.array(F.lower("text"), F.concat(F.lit("other "), "source")).alias("golds"),
    )
    hits = rows.withColumn("qem", eval_scoring.match_any(F.col("prediction"), F.col("golds")))
    return eval_scoring.corpus_mean(hits, "qem").select("task", "items", r6("qem").alias("qem"))


@query(
    "e13_number_match",
    f"""SELECT lang AS task, count(*) AS items, {R("avg((doc_id % 3 < 2)::INT)")} AS qem FROM documents GROUP BY lang""",
)
def e13(spark, root):
    kind = F.col("doc_id") % 3
    n = F.format_number("n_chars", 0)
    answer = (
        F.when(kind == 0, F.concat("text", F.lit(" so it is "), n, F.lit(".")))
        .when(kind == 1, F.concat("text", F.lit(" #### "), F.col("n_chars").cast("string"), F.lit(" not 17")))
        .otherwise(F.concat("text", F.lit(" = -3.5")))
    )
    rows = tables.texts(spark, root).select(
        F.col("lang").alias("task"),
        answer.alias("prediction"),
        F.concat(F.lit("work 1 2 3 #### "), F.col("n_chars").cast("string")).alias("gold"),
    )
    hits = rows.withColumn("qem", eval_scoring.number_match(F.col("prediction"), F.col("gold")))
    return eval_scoring.corpus_mean(hits, "qem").select("task", "items", r6("qem").alias("qem"))


@query(
    "e14_math_normaliser",
    r"""SELECT doc_id, CASE doc_id % 13 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN '\frac{' || n || '}{7}'
          WHEN 3 THEN '\frac{1}{' || n[1:1] || '}' || n[2:] WHEN 4 THEN n WHEN 5 THEN n
          WHEN 6 THEN '\sqrt{' || n[1:1] || '}' || n[2:] WHEN 7 THEN '1000' || n WHEN 8 THEN n
          WHEN 9 THEN n || '3' ELSE '' END AS answer
        FROM (SELECT doc_id, n_chars::VARCHAR AS n FROM documents)""",
)
def e14(spark, root):
    pairs = tables.math_pairs(spark, root)
    return pairs.select("doc_id", eval_scoring.normalise_math(F.col("pred")).alias("answer"))


@query(
    "e14_math_match",
    f"""SELECT source AS task, count(*) AS items, {R("avg((doc_id % 4 = 0 OR (doc_id % 4 = 1 AND doc_id % 13 IN (0, 1, 4, 5, 8)) OR "
         "(doc_id % 4 > 1 AND (doc_id % 13 IN (0, 4, 10, 11) OR false)))::INT)")} AS qem FROM documents GROUP BY source""",
)
def e14_match(spark, root):
    pairs = tables.math_pairs(spark, root).withColumnRenamed("source", "task")
    hits = pairs.withColumn("qem", eval_scoring.math_match(F.col("pred"), F.col("gold")))
    return eval_scoring.corpus_mean(hits, "qem").select("task", "items", r6("qem").alias("qem"))


# the subsequence length as a row-by-row table walk
_LCS = """
list_reduce(list_transform(a, lambda w: struct_pack(w := w, r := []::INT[])), lambda acc, x: struct_pack(w := x.w, r := list_reduce(
    list_transform(range(1, len(b) + 1), lambda j: struct_pack(r := []::INT[], j := j)),
    lambda s, y: struct_pack(r := s.r || [CASE WHEN b[y.j] = x.w THEN coalesce(acc.r[y.j - 1], 0) + 1
                             ELSE greatest(coalesce(acc.r[y.j], 0), coalesce(s.r[len(s.r)], 0)) END], j := y.j),
    struct_pack(r := []::INT[], j := 0::BIGINT)).r),
  struct_pack(w := '', r := list_transform(b, lambda z: 0))).r[len(b)]"""


@query(
    "e15_rouge_l",
    f"""SELECT item_id, {R("2.0 * lcs / (len(a) + len(b))")} AS rouge_l FROM (
          SELECT item_id, a, b, {_LCS} AS lcs FROM (
            SELECT item_id, regexp_extract_all(lower(output), '[a-z0-9]+') AS a, regexp_extract_all(lower(reference), '[a-z0-9]+') AS b
            FROM rewrites))""",
)
def e15(spark, root):
    scored = eval_scoring.rouge_l(tables.rewrites(spark, root), "output", "reference")
    return scored.select("item_id", r6("rouge_l").alias("rouge_l"))


@query(
    "e16_corpus_mean",
    f"SELECT source AS task, count(quality) AS items, {R('avg(quality)')} AS quality FROM labels JOIN documents USING (doc_id) GROUP BY source",
)
def e16(spark, root):
    rows = tables.base(spark, root, "labels").join(
        tables.base(spark, root, "documents").select("doc_id", F.col("source").alias("task")), "doc_id"
    )
    return eval_scoring.corpus_mean(rows, "quality").select("task", "items", r6("quality").alias("quality"))


@query(
    "e17_suite_rollup",
    f"""SELECT coalesce(suite, 'ALL') AS suite, coalesce(task, 'ALL') AS task, coalesce(subset, 'ALL') AS subset,
               sum(n)::BIGINT AS items, {R("sum(s) / sum(n)")} AS micro, {R("avg(s / n)")} AS macro
        FROM (SELECT suite, task, subset, sum(hit) AS s, count(*) AS n FROM (
                SELECT CASE WHEN prompt IN ('arc', 'bbh', 'math', 'gsm8k') THEN 'custom' ELSE 'extended' END AS suite,
                       split_part(task, ':', 1) AS task, CASE WHEN contains(task, ':') THEN split_part(task, ':', 2) ELSE '-' END AS subset,
                       (n_chars % 3 = 0)::INT AS hit
                FROM suite_items WHERE prompt IN ('arc', 'bbh', 'math', 'gsm8k', 'triviaqa', 'winogrande')) GROUP BY ALL)
        GROUP BY ROLLUP (suite, task, subset)""",
)
def e17(spark, root):
    plan = plan_of(spark, [*SUITE, "extended|trivia_qa|0|0", "extended|winogrande|0|1"]).select("suite", "task")
    hits = tables.suite_items(spark, root).select("task", (F.col("n_chars") % 3 == 0).cast("int").alias("hit"))
    # broadcast: at most one row per line of the suite and task of the registry
    rolled = eval_scoring.suite_rollup(hits.join(F.broadcast(plan), "task"), "hit", name="task", suite="suite")
    every = F.lit("ALL")
    return rolled.select(
        *(F.coalesce(level, every).alias(level) for level in ("suite", "task", "subset")), "items", r6("micro").alias("micro"), r6("macro").alias("macro")
    )


@query(
    "e18_pick_score",
    f"""SELECT doc_id, {R("CASE WHEN doc_id % 8 < 4 THEN (quality || '.' || doc_id % 10)::DOUBLE END")} AS score FROM reports JOIN labels USING (doc_id)""",
)
def e18(spark, root):
    result = eval_scoring.first_result(F.col("report"))
    return tables.reports(spark, root).select("doc_id", r6(eval_scoring.pick_score(result)).alias("score"))


_HUMAN = """CASE WHEN sec >= 3600 THEN sec // 3600 || 'h ' ELSE '' END
         || CASE WHEN sec >= 60 THEN sec % 3600 // 60 || 'm ' ELSE '' END || sec % 60 || 's'"""


@query(
    "e19_progress",
    f"""SELECT done, 16::BIGINT AS total, sec AS elapsed_sec, {_HUMAN} AS elapsed_human
       FROM (SELECT count(*) FILTER (WHERE status = 'done') AS done FROM latest)
       CROSS JOIN (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS sec FROM status)""",
)
def e19(spark, root):
    updates = tables.status_of(tables.base(spark, root, "events"))
    return eval_reports.progress(eval_reports.task_table(eval_reports.suite_table(spark), updates), updates)


_NAMES = ", ".join(f"'{name}'" for name, _, _ in eval_reports.SUITE)


@query(
    "e19_task_table",
    f"""SELECT task_id, ([{_NAMES}])[task_id + 1] AS name, coalesce(status, 'pending') AS status, {R("score")} AS score,
               CASE WHEN sec IS NOT NULL THEN {_HUMAN} END AS runtime, ([{_NAMES}])[task_id + 1] || '.json' AS report
        FROM (SELECT unnest(range(16)) AS task_id) LEFT JOIN latest USING (task_id) LEFT JOIN (SELECT task_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS sec FROM status GROUP BY task_id) USING (task_id)""",
)
def e19_table(spark, root):
    updates = tables.status_of(tables.base(spark, root, "events"))
    table = eval_reports.task_table(eval_reports.suite_table(spark), updates)
    return table.select("task_id", "name", "status", r6("score").alias("score"), "runtime", F.col("report.path").alias("report"))


@query(
    "e19_report_table",
    f"""SELECT task_id, ([{_NAMES}])[task_id + 1] AS name, coalesce(l.status, 'pending') AS status,
               CASE WHEN last % 8 < 4 THEN round((quality || '.' || last % 10)::DOUBLE, 6) END AS score,
               coalesce(last % 8 NOT IN (4, 7), false)::INT AS "exists"
        FROM (SELECT unnest(range(16)) AS task_id) LEFT JOIN latest l USING (task_id) LEFT JOIN task_reports USING (task_id)""",
)
def e19_reports(spark, root):
    path = fresh_path(spark, "reports")
    write_reports(tables.task_reports(spark, root), path)
    suite, updates = eval_reports.suite_table(spark), tables.status_of(tables.base(spark, root, "events"))
    read = read_reports(spark, path, suite.select(F.col("name").alias("task")))
    table = eval_reports.task_table(suite, updates, reports=read)
    return table.select("task_id", "name", "status", r6("score").alias("score"), F.col("report.exists").cast("int").alias("exists"))


def _stats(df):
    return [r6(c).alias(c) for c in ("avg_generation_time", "avg_tokens_generated", "avg_tokens_per_second")]


@query(
    "e20_generation_stats",
    f"""SELECT model, responses, {R("avg_generation_time")} AS avg_generation_time, {R("avg_tokens_generated")} AS avg_tokens_generated,
               {R("avg_tokens_per_second")} AS avg_tokens_per_second FROM stats WHERE model <> 'error'""",
)
def e20(spark, root):
    runs = tables.runs(spark, root).withColumn("failed", F.col("model") == "error")
    stats = eval_reports.generation_stats(runs, failed="failed")
    return stats.select("model", "responses", *_stats(stats))


@query(
    "e20_response_speed",
    f"SELECT model, prompt_idx, {R('tokens_per_second')} AS tokens_per_second FROM speeds",
)
def e20_speed(spark, root):
    return eval_reports.with_speed(tables.runs(spark, root)).select(
        "model", "prompt_idx", r6("tokens_per_second").alias("tokens_per_second")
    )


@query(
    "e21_compare_models",
    f"""SELECT a.model AS model_a, b.model AS model_b, {R("a.avg_tokens_per_second")} AS speed_a, {R("b.avg_tokens_per_second")} AS speed_b,
               {R("(b.avg_tokens_per_second / a.avg_tokens_per_second - 1) * 100")} AS speed_change_pct
        FROM stats a CROSS JOIN stats b WHERE a.model = (SELECT min(model) FROM stats) AND b.model = (SELECT max(model) FROM stats)""",
)
def e21(spark, root):
    compared = eval_reports.compare_models(eval_reports.generation_stats(tables.runs(spark, root)))
    return compared.select(
        "model_a",
        "model_b",
        r6("avg_tokens_per_second_a").alias("speed_a"),
        r6("avg_tokens_per_second_b").alias("speed_b"),
        r6("speed_change_pct").alias("speed_change_pct"),
    )


@query(
    "e21_first_and_last",
    f"""SELECT a.position AS position_a, b.position AS position_b, a.model AS model_name_a, b.model AS model_name_b,
               a.total_params AS total_params_a, b.total_params AS total_params_b, {R("a.model_size_gb")} AS model_size_gb_a,
               {R("b.model_size_gb")} AS model_size_gb_b, {R("a.avg_generation_time")} AS avg_generation_time_a,
               {R("b.avg_generation_time")} AS avg_generation_time_b,
               {R("(b.avg_tokens_per_second / a.avg_tokens_per_second - 1) * 100")} AS speed_change_pct
        FROM (SELECT * FROM models JOIN stats USING (model)) a CROSS JOIN (SELECT * FROM models JOIN stats USING (model)) b
        WHERE a.position = 0 AND b.position = (SELECT max(position) FROM models)""",
)
def e21_documents(spark, root):
    compared = compare_benchmark_models(tables.benchmark_file(spark, root))
    numbers = [f"{c}_{side}" for c in ("model_size_gb", "avg_generation_time") for side in "ab"]
    names = [f"{c}_{side}" for c in ("position", "model_name", "total_params") for side in "ab"]
    return compared.select(*names, *(r6(c).alias(c) for c in [*numbers, "speed_change_pct"]))


@query(
    "e22_aligned_responses",
    f"""SELECT a.prompt_idx, a.response AS response_a, b.response AS response_b, {R("a.tokens_per_second")} AS speed_a,
               {R("b.tokens_per_second")} AS speed_b
        FROM (SELECT * FROM speeds WHERE model = 'click') a LEFT JOIN (SELECT * FROM speeds WHERE model = 'view') b USING (prompt_idx)""",
)
def e22(spark, root):
    runs = eval_reports.with_speed(tables.runs(spark, root))
    rows = eval_reports.aligned_responses(runs, "click", "view")
    return rows.select(
        "prompt_idx", "response_a", "response_b",
        r6("tokens_per_second_a").alias("speed_a"), r6("tokens_per_second_b").alias("speed_b"),
    )


# ---- registries -----------------------------------------------------------------------------


@query(
    "u1_adapter_registry",
    "SELECT conv_id, turn, md5('human=Q: ' || question || '|gpt=' || answer) AS digest FROM qa",
)
def u1(spark, root):
    def asked(df, keep=()):
        return adapters.qa(df.withColumn("question", F.concat(F.lit("Q: "), "question")), keep)

    registry.register_adapter("asked", asked)
    adapted = registry.adapt(tables.qa(spark, root), "asked", ("conv_id", "turn"))
    return adapted.select("conv_id", "turn", digest(spoken("conversations")).alias("digest"))


@query(
    "u2_prompt_registry",
    """SELECT item_id, md5('Question: ' || input || chr(10) || 'Answer: ') AS query, md5(target) AS choices, 0::INT AS gold_index FROM items""",
)
def u2(spark, root):
    return prompts_of(registry.PROMPTS["bbh"](tables.items(spark, root)), "item_id")


@query(
    "u3_metric_registry",
    f"""SELECT source AS task, count(*) AS items, {R("sqrt(avg(power((length(text) > 500)::INT, 2)))")} AS score FROM documents GROUP BY source""",
)
def u3(spark, root):
    registry.register_metric(
        "long_enough",
        lambda prediction, gold: (F.length(prediction) > gold).cast("double"),
        lambda score: F.sqrt(F.avg(score * score)),
    )
    rows = tables.base(spark, root, "documents").select(F.col("source").alias("task"), "text", F.lit(500).alias("gold"))
    scored = registry.score(rows, "long_enough", "text", "gold")
    return scored.select("task", "items", r6("score").alias("score"))


@query(
    "u4_template_and_tokeniser_registry",
    r"""SELECT doc_id, md5(string_agg('<' || role || '>' || content || ';', '' ORDER BY i) || '<assistant>') AS digest,
               sum(len(regexp_extract_all('<' || role || '>' || content || ';', '\s|\S')))::INT + 11 AS n
        FROM spoken_roles WHERE role IN ('user', 'assistant', 'system') GROUP BY doc_id""",
)
def u4(spark, root):
    from kdframe.operators.conversation import TEMPLATES, Template
    from kdframe.plans.prompts import mapped

    registry.register_template("angle", Template("<", ">", ";", "<assistant>"))
    registry.register_tokeniser("characters", r"\s|\S")
    text = render_with_template(F.col("messages"), TEMPLATES["angle"])
    rendered = mapped(spark, root).where(F.size("messages") > 0).select("doc_id", text.alias("text"))
    return rendered.select(
        "doc_id", digest("text").alias("digest"), F.size(pieces(F.col("text"), "characters")).alias("n")
    )
