"""Extension points: adapters, prompts, metrics, templates and tokenisers by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.operators import adapters, eval_prompts, eval_scoring
from kdframe.operators.conversation import TEMPLATES, Template
from kdframe.operators.tokens import TOKENISERS

ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "sharegpt": adapters.sharegpt,
    "alpaca": adapters.alpaca,
    "qa": adapters.qa,
    "code": adapters.code,
    "messages": adapters.messages,
}
PROMPTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "hellaswag": eval_prompts.hellaswag,
    "mmlu_pro": eval_prompts.mmlu_pro,
    "bbh": eval_prompts.bbh,
    "math": eval_prompts.math,
    "arc": eval_prompts.asked_choices,
    "openbookqa": eval_prompts.asked_choices,
    # rows whose key is no label are left out
    "commonsense_qa": lambda df: eval_prompts.commonsense_qa(df)[0],
    "gsm8k": eval_prompts.asked_answer,
    "triviaqa": eval_prompts.asked_aliases,
    "winogrande": eval_prompts.filled_gap,
}
# a metric is a per-item column builder and a corpus aggregate
METRICS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[Column], Column]]] = {
    "exact_match": (eval_scoring.exact_match, F.avg),
    "quasi_exact_match_triviaqa": (eval_scoring.match_any, F.avg),
    "quasi_exact_match_gsm8k": (eval_scoring.number_match, F.avg),
    "qem": (eval_scoring.math_match, F.avg),
    # the prediction is a struct of the choices and their log-probabilities, the gold value an index
    "loglikelihood_acc_norm_nospace": (lambda p, gold: eval_scoring.choice_hit(p["logps"], p["choices"], gold), F.avg),
}


def register_adapter(name: str, adapter: Callable[..., DataFrame]) -> None:
    ADAPTERS[name] = adapter


def register_prompt(name: str, prompt: Callable[[DataFrame], DataFrame]) -> None:
    PROMPTS[name] = prompt


def register_metric(
    name: str, per_item: Callable[[Column, Column], Column], corpus: Callable[[Column], Column] = F.avg
) -> None:
    """``per_item`` may wrap a pandas UDF."""
    METRICS[name] = (per_item, corpus)


def register_template(name: str, template: Template) -> None:
    TEMPLATES[name] = template


def register_tokeniser(name: str, pattern: str) -> None:
    """``pattern`` must cover every character and keep the special tokens whole."""
    TOKENISERS[name] = pattern


def adapt(df: DataFrame, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.transform(ADAPTERS[name], keep)


def build_prompts(items: dict[str, DataFrame], keep: tuple[str, ...] = ("task", "item_id", "split")) -> DataFrame:
    """``query``, ``choices`` and ``gold_index`` of items of several kinds, each by the prompt of its name."""
    built = [PROMPTS[name](df).select(*keep, "query", "choices", "gold_index") for name, df in items.items()]
    return reduce(DataFrame.unionByName, built)


def score(df: DataFrame, metric: str, prediction: str, gold: str, by: tuple[str, ...] = ("task",)) -> DataFrame:
    """Corpus score of a registered metric per group."""
    per_item, corpus = METRICS[metric]
    scored = df.withColumn("_score", per_item(F.col(prediction), F.col(gold)))
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), corpus(F.col("_score")).alias("score"))
