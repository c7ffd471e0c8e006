"""Evaluation prompts, the task registry, few-shot selection and output trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kdframe.functions.text import strip
from kdframe.operators.ranking import order_key
from kdframe.operators.tokens import pieces
from kdframe.session import broadcast_if_fits, materialize

BROADCAST_TASKS = 1000

# ---- prompt builders ------------------------------------------------------------------------


def _clean_wiki(text: Column) -> Column:
    titled = F.replace(text, F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(titled, r"(?d)\[.*?\]", ""), F.lit("  "), F.lit(" "))


def _capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def hellaswag(df: DataFrame) -> DataFrame:
    """From ``activity_label, ctx_a, ctx_b, endings, label``."""
    context = F.concat("ctx_a", F.lit(" "), _capitalize(F.col("ctx_b")), F.lit(" "))
    return df.withColumns(
        {
            "query": _clean_wiki(F.concat("activity_label", F.lit(": "), context)),
            "choices": F.transform("endings", lambda e: F.concat(F.lit(" "), _clean_wiki(e))),
            "gold_index": F.when(F.col("label") == "", -1).otherwise(F.col("label").cast("int")),
        }
    )


def commonsense_qa(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``question, labels, texts, answer_key``. Rows whose key is no label come back as rejects."""
    built = df.withColumns(
        {
            "query": F.col("question"),
            "choices": F.transform("texts", lambda t: F.concat(F.lit(" "), t)),
            "gold_index": (F.array_position("labels", strip(F.col("answer_key"))) - 1).cast("int"),
        }
    )
    return built.where("gold_index >= 0"), built.where("gold_index < 0")


def _letter(index: Column) -> Column:
    return F.chr((index + 65).cast("long"))


def mmlu_pro(df: DataFrame) -> DataFrame:
    """From ``category, question, options, answer_index``."""
    topic = F.replace(F.col("category"), F.lit("_"), F.lit(" "))
    instruction = F.concat(
        F.lit("The following are multiple choice questions (with answers) about "), topic, F.lit(".\n\n")
    )
    lines = F.transform("options", lambda o, i: F.concat(_letter(i), F.lit(". "), o, F.lit("\n")))
    return df.withColumns(
        {
            "instruction": instruction,
            "query": F.concat(instruction, "question", F.lit("\n"), F.array_join(lines, ""), F.lit("Answer:")),
            "choices": F.transform("options", lambda o, i: _letter(i)),
            "gold_index": F.col("answer_index"),
        }
    )


def bbh(df: DataFrame) -> DataFrame:
    """From ``input, target``."""
    return df.withColumns(
        {
            "query": F.concat(F.lit("Question: "), "input", F.lit("\nAnswer: ")),
            "choices": F.array("target"),
            "gold_index": F.lit(0),
        }
    )


def math(df: DataFrame) -> DataFrame:
    """From ``problem, solution``."""
    return df.withColumns(
        {
            "query": F.concat(F.lit("Problem:\n"), "problem", F.lit("\n\nSolution:\n")),
            "choices": F.array(F.concat("solution", F.lit("\n"))),
            "gold_index": F.lit(0),
        }
    )


def rewrite(df: DataFrame, index: str) -> DataFrame:
    """From ``source, reference`` and an optional ``id``; ``index`` numbers rows without an id."""
    text = (
        "Rewrite the text to be clearer, friendlier, and concise, preserving meaning. "
        "Return only the rewritten text.\n\nText:\n"
    )
    own = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {"query": F.concat(F.lit(text), "source"), "item": F.coalesce(own, F.col(index).cast("string"))}
    )


def first_available(spark: SparkSession, names: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Dataset under the first name that can be read."""
    from pyspark.errors import AnalysisException

    for name in names[:-1]:
        try:
            return spark.read.format(fmt).load(name)
        except AnalysisException:
            continue
    return spark.read.format(fmt).load(names[-1])


def question_answer(question: Column, choices: Column | None = None) -> Column:
    """Our generic builder for tasks whose own prompt text is not public here."""
    if choices is None:
        return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))
    lines = F.transform(choices, lambda c, i: F.concat(_letter(i), F.lit(". "), c, F.lit("\n")))
    return F.concat(F.lit("Question: "), question, F.lit("\n"), F.array_join(lines, ""), F.lit("Answer:"))


def asked_choices(df: DataFrame) -> DataFrame:
    """Multiple choice without letters, from ``question, labels, texts, answer_key``: arc and openbookqa."""
    return df.withColumns(
        {
            "query": question_answer(F.col("question")),
            "choices": F.transform("texts", lambda t: F.concat(F.lit(" "), t)),
            "gold_index": (F.array_position("labels", strip(F.col("answer_key"))) - 1).cast("int"),
        }
    )


def asked_answer(df: DataFrame) -> DataFrame:
    """An open question with one worked answer, from ``question, answer``: gsm8k."""
    query = question_answer(F.col("question"))
    return df.withColumns({"query": query, "choices": F.array(F.concat(F.lit(" "), "answer")), "gold_index": F.lit(0)})


def asked_aliases(df: DataFrame) -> DataFrame:
    """An open question with several right answers, from ``question, aliases``: triviaqa. All choices are gold."""
    return df.withColumns({"query": question_answer(F.col("question")), "choices": F.col("aliases"), "gold_index": F.lit(0)})


def filled_gap(df: DataFrame) -> DataFrame:
    """A sentence with a gap ``_``, from ``sentence, option1, option2, answer``: winogrande. The choices are the
    options with the rest of the sentence."""
    at = F.instr("sentence", F.lit("_"))
    rest = F.substr("sentence", at + 1)
    return df.withColumns(
        {
            "query": F.substr("sentence", F.lit(1), at - 1),
            "choices": F.array(*(F.concat(F.col(option), rest) for option in ("option1", "option2"))),
            "gold_index": F.try_to_number("answer", F.lit("9")).cast("int") - 1,
        }
    )


# ---- task registry --------------------------------------------------------------------------

# fixed values: base tasks as (task, prompt, subset, metric, generation size, stops, few-shot split,
# few-shot selection, evaluation splits)
_QUESTION_STOPS = ["Question:", "Question"]
_CHOICE = "loglikelihood_acc_norm_nospace"
BASE_TASKS = [
    ("arc:easy", "arc", "ARC-Easy", _CHOICE, None, [], None, None, ["test"]),
    ("arc:challenge", "arc", "ARC-Challenge", _CHOICE, None, [], None, None, ["test"]),
    ("openbook_qa", "openbookqa", "main", _CHOICE, None, [], None, None, []),
    ("commonsense_qa", "commonsense_qa", "default", _CHOICE, None, [], None, None, []),
    ("winogrande", "winogrande", "winogrande_xl", _CHOICE, None, [], None, None, []),
    ("trivia_qa", "triviaqa", "rc.nocontext", "quasi_exact_match_triviaqa", 20, _QUESTION_STOPS,
     None, "random_sampling_from_train", ["validation"]),
    ("mmlu_pro", "mmlu_pro", "default", _CHOICE, None, [], "validation", None, ["test"]),
    ("gsm8k", "gsm8k", "main", "quasi_exact_match_gsm8k", 256, _QUESTION_STOPS,
     None, "random_sampling_from_train", ["test"]),
]
# fixed values: subset names
BBH_SUBSETS = [
    "boolean_expressions",
    "causal_judgement",
    "date_understanding",
    "disambiguation_qa",
    "dyck_languages",
    "formal_fallacies",
    "geometric_shapes",
    "hyperbaton",
    "logical_deduction_five_objects",
    "logical_deduction_seven_objects",
    "logical_deduction_three_objects",
    "movie_recommendation",
    "multistep_arithmetic_two",
    "navigate",
    "object_counting",
    "penguins_in_a_table",
    "reasoning_about_colored_objects",
    "ruin_names",
    "salient_translation_error_detection",
    "snarks",
    "sports_understanding",
    "temporal_sequences",
    "tracking_shuffled_objects_five_objects",
    "tracking_shuffled_objects_seven_objects",
    "tracking_shuffled_objects_three_objects",
    "web_of_lies",
    "word_sorting",
]
MATH_SUBSETS = [
    "algebra",
    "counting_and_probability",
    "geometry",
    "intermediate_algebra",
    "number_theory",
    "prealgebra",
    "precalculus",
]
TASK_FIELDS = (
    "task string, prompt string, subset string, metric string, generation_size int, "
    "stops array<string>, few_shot_split string, few_shot_select string, evaluation_splits array<string>"
)


def registry_rows() -> list[tuple]:
    """Base tasks, and one row per subset for the two families."""
    families = {
        "bbh": (BBH_SUBSETS, ("exact_match", None, _QUESTION_STOPS, "train", None, ["train"])),
        "math": (MATH_SUBSETS, ("qem", 1024, ["Problem:"], "fewshot", "sequential", ["test"])),
    }
    rows = list(BASE_TASKS)
    for family, (subsets, rest) in families.items():
        rows += [(f"{family}:{subset}", family, subset, *rest) for subset in subsets]
    return rows


def task_registry(spark: SparkSession) -> DataFrame:
    """The task dimension."""
    return spark.createDataFrame(registry_rows(), TASK_FIELDS)


def parse_suite(lines: DataFrame, line: str = "value") -> DataFrame:
    """``suite|task|shots|truncate`` lines as typed columns."""
    part = F.split(line, r"\|")
    return lines.where(F.col(line) != "").select(
        *[c for c in lines.columns if c != line],
        part[0].alias("suite"),
        part[1].alias("task"),
        part[2].cast("int").alias("shots"),
        (part[3].cast("int") == 1).alias("truncate"),
    )


def expand_suite(suite: DataFrame, tasks: DataFrame) -> DataFrame:
    """What a suite asks for: its lines with the registry's fields, one row per task. A line that names a family
    (``bbh``) stands for all of its tasks."""
    family = F.split("task", ":")[0]
    named = tasks.withColumn("_line", F.explode(F.array_distinct(F.array("task", family))))
    lines = suite.select(F.col("task").alias("_line"), "suite", "shots", "truncate")
    return lines.join(named, "_line").drop("_line")


# ---- few-shot examples ----------------------------------------------------------------------


def few_shots(
    items: DataFrame,
    pool: DataFrame,
    shots: int,
    select: str = "random",
    same_split: bool = False,
    seed: int = 42,
    task: str = "task",
    item: str = "item_id",
    text: str = "example",
) -> DataFrame:
    """Few-shot prefix of every item: ``shots`` examples of its task, joined by blank lines.

    ``random`` takes examples in seeded order, ``sequential`` by id. When the pool is the evaluation
    split itself, an item never shows its own answer; one spare example per task covers that. The
    per-task limit is applied before the shuffle, so a huge task costs a handful of rows.
    """
    if select == "random":
        key = order_key(seed, item)
    elif select == "sequential":
        key = F.col(item)
    else:
        raise ValueError(f"unknown few-shot selection {select!r}")
    nth = F.row_number().over(Window.partitionBy(task).orderBy("_key", item))
    ranked = pool.select(task, item, text, key.alias("_key")).withColumn("_nth", nth)
    best = ranked.where(F.col("_nth") <= shots + (1 if same_split else 0))
    lists = materialize(best.groupBy(task).agg(
        F.sort_array(F.collect_list(F.struct("_nth", F.col(item).alias("_id"), F.col(text).alias("_text")))).alias("_shots")
    ))
    joined = items.join(broadcast_if_fits(lists, BROADCAST_TASKS), task, "left")
    others = F.filter("_shots", lambda s: s["_id"] != F.col(item)) if same_split else F.col("_shots")
    chosen = F.transform(F.slice(others, 1, shots), lambda s: F.concat(s["_text"], F.lit("\n\n")))
    return joined.withColumn("few_shot", F.coalesce(F.array_join(chosen, ""), F.lit(""))).drop("_shots")


#: Split of a task that names none: to take examples from, and to evaluate on.
DEFAULT_POOL, DEFAULT_SPLIT = "train", "validation"


def suite_prompts(prompts: DataFrame, plan: DataFrame, seed: int = 42, item: str = "item_id") -> DataFrame:
    """Prompts of a suite, from ``expand_suite`` and (task, item, split, query, choices, gold_index) of all splits.

    Each task has its own number of examples, split to take them from, order (by id, or seeded) and
    splits to evaluate; an item never shows its own answer. Adds ``few_shot`` and the plan's fields.
    An example is a query with its right choice. The largest number asked for bounds what a task
    costs before the shuffle, the task's own number what it shows.
    """
    plan = materialize(plan)
    most = plan.agg(F.coalesce(F.max("shots"), F.lit(0))).scalar()
    wanted = plan.groupBy("task").agg(
        F.max("shots").alias("_k"),
        F.max(F.coalesce("few_shot_split", F.lit(DEFAULT_POOL))).alias("_pool"),
        F.max(F.coalesce(F.col("few_shot_select") == "sequential", F.lit(False))).alias("_by_id"),
    )
    pool = prompts.join(broadcast_if_fits(wanted, BROADCAST_TASKS), "task").where(F.col("split") == F.col("_pool"))
    answer = F.get("choices", F.col("gold_index"))
    # rows that go by id have equal keys
    key = F.when(F.col("_by_id"), F.lit("")).otherwise(order_key(seed, item))
    nth = F.row_number().over(Window.partitionBy("task").orderBy("_key", item))
    ranked = pool.select("task", item, F.concat("query", answer).alias("_text"), key.alias("_key"), "_k").withColumn("_nth", nth)
    best = ranked.where(F.col("_nth") <= F.lit(most + 1)).where(F.col("_nth") <= F.col("_k") + 1)
    listed = best.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("_nth", F.col(item).alias("_id"), "_text"))).alias("_shots"))
    listed = materialize(listed)
    asked = prompts.join(broadcast_if_fits(plan, BROADCAST_TASKS), "task")
    splits = F.when(F.size("evaluation_splits") > 0, F.col("evaluation_splits")).otherwise(F.array(F.lit(DEFAULT_SPLIT)))
    asked = asked.where(F.array_contains(splits, F.col("split"))).join(broadcast_if_fits(listed, BROADCAST_TASKS), "task", "left")
    others = F.filter("_shots", lambda s: s["_id"] != F.col(item))
    chosen = F.transform(F.slice(others, F.lit(1), F.col("shots")), lambda s: F.concat(s["_text"], F.lit("\n\n")))
    return asked.withColumn("few_shot", F.coalesce(F.array_join(chosen, ""), F.lit(""))).drop("_shots")


# ---- model output ---------------------------------------------------------------------------


def cut_at_stops(text: Column, stops: Sequence[str] | Column) -> Column:
    """Text before the earliest stop string. ``stops`` may be an array column, so that each row has its own."""
    each = stops if isinstance(stops, Column) else F.array(*map(F.lit, stops))
    found = F.filter(F.transform(each, lambda s: F.position(s, text)), lambda place: place > 0)
    first = F.array_min(found)
    return F.when(first.isNull(), text).otherwise(F.substr(text, F.lit(1), first - 1))


def cap_tokens(text: Column, limit: int | Column, tokeniser: str = "student") -> Column:
    """At most ``limit`` tokens of generated text; all of them where a row has no limit."""
    if not isinstance(limit, Column):
        limit = F.lit(limit)
    capped = F.array_join(F.slice(pieces(text, tokeniser), F.lit(1), limit), "")
    return F.when(limit.isNull(), text).otherwise(capped)
