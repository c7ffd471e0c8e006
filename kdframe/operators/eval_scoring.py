"""Item-level metrics as columns, and their corpus means and roll-ups."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from kdframe.functions.text import strip
from kdframe.functions.vectors import let

# tasks receive the helpers of this module by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---- choices and exact matches --------------------------------------------------------------


def choice_hit(logps: Column, choices: Column, gold: Column) -> Column:
    """1 when the choice with the best log-likelihood per character is the gold one.

    The length ignores leading spaces. The first of equal scores wins.
    """
    scores = F.zip_with(
        logps, choices, lambda lp, c: lp.cast("double") / F.greatest(F.length(F.ltrim(c)), F.lit(1))
    )
    return let(scores, lambda s: ((F.array_position(s, F.array_max(s)) - 1) == gold).cast("int"))


def exact_match(prediction: Column, gold: Column) -> Column:
    return F.coalesce(strip(prediction) == strip(gold), F.lit(False)).cast("int")


def normalise_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    kept = F.filter(F.split(plain, r"(?U)\s+"), lambda w: ~w.isin("", "a", "an", "the"))
    return F.array_join(kept, " ")


def match_any(prediction: Column, golds: Column) -> Column:
    """1 when the normalised prediction equals any normalised gold answer."""
    return let(
        normalise_answer(prediction),
        lambda p: F.coalesce(F.exists(golds, lambda g: normalise_answer(g) == p), F.lit(False)).cast("int"),
    )


def last_number(text: Column) -> Column:
    """The number after ``####``, else the last number in the text; thousands commas dropped."""
    numbers = F.regexp_extract_all(text, F.lit(r"-?[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    marked = F.regexp_extract(text, r"####\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    found = F.coalesce(F.nullif(marked, F.lit("")), F.try_element_at(numbers, F.lit(-1)))
    return F.replace(found, F.lit(","), F.lit(""))


def number_match(prediction: Column, gold: Column) -> Column:
    return F.coalesce(last_number(prediction) == last_number(gold), F.lit(False)).cast("int")


# ---- mathematical answers -------------------------------------------------------------------

# fixed values: replacements, in this order
SUBSTITUTIONS = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
# fixed values: removed expressions, in this order
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units",
    "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm",
    "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# fixed values: patterns and replacements, in this order; (?d) makes "." stop at "\n" only
REWRITES = [
    (r"(?d)(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(?d)(\\text\{)(.*?)(\})", "$2"),
    (r"(?d)(\\textbf\{)(.*?)(\})", "$2"),
    (r"(?d)(\\overline\{)(.*?)(\})", "$2"),
    (r"(?d)(\\boxed\{)(.*)(\})", "$2"),
    (r"(?d)(frac)([^{])(.)", "frac{$2}{$3}"),
    (r"(?d)(sqrt)([^{])", "sqrt{$2}"),
]


def _closing_brace(text: Column) -> Column:
    """Length of ``text`` up to the brace that closes its first open one, 0 when none does.

    Walks the braces only: every segment ends in one.
    """
    segments = F.regexp_extract_all(text, F.lit(r"[^{}]*[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("taken"), F.lit(0).alias("end"))

    def step(acc: Column, segment: Column) -> Column:
        opening = F.endswith(segment, F.lit("{"))
        depth = acc["depth"] + F.when(opening, 1).otherwise(-1)
        taken = acc["taken"] + F.length(segment)
        closed = ~opening & (depth == 0)
        moved = F.struct(
            depth.alias("depth"), taken.alias("taken"), F.when(closed, taken).otherwise(0).alias("end")
        )
        return F.when(acc["end"] > 0, acc).otherwise(moved)

    return F.aggregate(segments, start, step)["end"]


def boxed_answer(text: Column) -> Column:
    """Content of the last box: ``\\boxed x$``, ``\\boxed{x}`` or, failing those, ``\\fbox{x}``.

    One character too many is cut after ``\\fbox``, as in the original. NULL without a box.
    """
    spaced = F.substring_index(F.substring_index(text, "\\boxed ", -1), "$", 1)

    def inside(marker: str) -> Column:
        tail = F.concat(F.lit(marker), F.substring_index(text, marker, -1))
        return let(
            tail,
            lambda t: let(
                _closing_brace(t), lambda end: F.when(end > 0, F.substr(t, F.lit(8), F.greatest(end - 8, F.lit(0))))
            ),
        )

    return (
        F.when(F.contains(text, F.lit("\\boxed ")), spaced)
        .when(F.contains(text, F.lit("\\boxed")), inside("\\boxed"))
        .when(F.contains(text, F.lit("\\fbox")), inside("\\fbox"))
    )


def normalise_final(answer: Column) -> Column:
    answer = F.substring_index(answer, "=", -1)
    for old, new in SUBSTITUTIONS:
        answer = F.replace(answer, F.lit(old), F.lit(new))
    for expression in REMOVED:
        answer = F.replace(answer, F.lit(expression), F.lit(""))
    for pattern, replacement in REWRITES:
        answer = F.regexp_replace(answer, pattern, replacement)
    answer = F.replace(answer, F.lit("$"), F.lit(""))
    return let(
        answer,
        lambda a: F.when(
            F.replace(a, F.lit(","), F.lit("")).rlike(r"^[0-9]+$"), F.replace(a, F.lit(","), F.lit(""))
        ).otherwise(a),
    )


def normalise_math(text: Column) -> Column:
    """Normalised boxed answer; the empty string without text or box."""
    return F.coalesce(normalise_final(boxed_answer(text)), F.lit(""))


def math_match(prediction: Column, gold: Column) -> Column:
    return (normalise_math(strip(prediction)) == normalise_math(strip(gold))).cast("int")


# ---- ROUGE-L --------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Lower-case alphanumeric words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def _common_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence, one bit per word of ``a`` and one pass over ``b``."""
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hits = row & where.get(word, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_common_length(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_l(df: DataFrame, output: str, reference: str, name: str = "rouge_l") -> DataFrame:
    """F1 of the longest common word subsequence of whole texts, 0 without common words."""
    sized = df.withColumn("_a", words(F.col(output))).withColumn("_b", words(F.col(reference)))
    scored = sized.withColumn("_lcs", common_length("_a", "_b"))
    total = F.size("_a") + F.size("_b")
    return scored.withColumn(name, F.coalesce(F.try_divide(2.0 * F.col("_lcs"), total), F.lit(0.0))).drop(
        "_a", "_b", "_lcs"
    )


# ---- corpus level ---------------------------------------------------------------------------


def corpus_mean(df: DataFrame, score: str, by: Sequence[str] = ("task",)) -> DataFrame:
    total = F.coalesce(F.sum(score), F.lit(0)) / F.greatest(F.count(score), F.lit(1))
    return df.groupBy(*by).agg(F.count(score).alias("items"), total.alias(score))


def suite_rollup(df: DataFrame, score: str, name: str = "name", suite: str | None = None) -> DataFrame:
    """Scores per subset, task and overall from ``task:subset`` names, and per suite if there is a column for it.

    ``micro`` weighs every item equally, ``macro`` every subset.
    """
    part = F.split(name, ":")
    levels = {"task": part[0], "subset": F.coalesce(F.get(part, 1), F.lit("-"))}
    if suite:
        levels = {"suite": F.col(suite)} | levels
    cells = (
        df.select(*(c.alias(level) for level, c in levels.items()), score)
        .groupBy(*levels)
        .agg(F.sum(score).alias("_sum"), F.count(score).alias("_n"))
    )
    return cells.rollup(*levels).agg(
        F.sum("_n").alias("items"),
        (F.sum("_sum") / F.sum("_n")).alias("micro"),
        F.avg(F.col("_sum") / F.col("_n")).alias("macro"),
    )


# fixed values: metric names in lookup order, at the top level and below "metrics"
SCORE_KEYS = ("accuracy", "acc", "rougeL", "pass@1", "exact_match", "score")
NESTED_SCORE_KEYS = ("accuracy", "acc", "rougeL", "pass@1", "em", "score")


def first_result(report: Column) -> Column:
    """JSON text of the first entry of ``results``; further entries are not read."""
    results = F.from_json(F.get_json_object(report, "$.results"), "map<string,string>")
    return F.get(F.map_values(results), F.lit(0))


def pick_score(result: Column) -> Column:
    """First numeric score by lookup order, else the first score below ``metrics``."""

    def found(parsed: Column) -> Column:
        numeric = []
        for key in SCORE_KEYS:
            kind = F.schema_of_variant(F.try_variant_get(parsed, f'$["{key}"]', "variant"))
            is_number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
            numeric.append(F.when(is_number, F.try_variant_get(parsed, f'$["{key}"]', "double")))
        nested = [F.try_variant_get(parsed, f'$.metrics["{key}"]', "double") for key in NESTED_SCORE_KEYS]
        return F.coalesce(*numeric, *nested)

    return found(F.try_parse_json(result))
