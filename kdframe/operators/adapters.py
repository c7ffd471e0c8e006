"""Adapters that turn source records into ``conversations: ARRAY<STRUCT<from, value>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: accepted field names, in order of preference
PROMPT_FIELDS = ("prompt", "instruction", "question")
RESPONSE_FIELDS = ("response", "completion", "solution", "output")


def turn(speaker: str, value: Column) -> Column:
    return F.struct(F.lit(speaker).alias("from"), value.alias("value"))


def exchange(human: Column, assistant: Column) -> Column:
    """Two-turn conversation; a missing side becomes the empty string."""
    return F.array(
        turn("human", F.coalesce(human, F.lit(""))), turn("gpt", F.coalesce(assistant, F.lit("")))
    )


def optional(df: DataFrame, name: str) -> Column:
    """The column when the source has it, else the default for an absent field."""
    return F.col(name) if name in df.columns else F.lit("")


def _put(df: DataFrame, conversations: Column, keep: tuple[str, ...]) -> DataFrame:
    return df.select(*keep, conversations.alias("conversations"))


def alpaca_conversation(df: DataFrame) -> Column:
    instruction, extra = optional(df, "instruction"), optional(df, "input")
    # a missing instruction next to a non-empty input is rendered as the word None
    with_input = F.concat(F.coalesce(instruction, F.lit("None")), F.lit("\n\nInput:\n"), extra)
    user = F.when(F.length(extra) > 0, with_input).otherwise(instruction)
    return exchange(user, optional(df, "output"))


def sharegpt(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _put(df, F.col("conversations"), keep)


def alpaca(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _put(df, alpaca_conversation(df), keep)


def qa(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _put(df, exchange(optional(df, "question"), optional(df, "answer")), keep)


def code(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """First non-empty prompt field and first non-empty response field that the source has."""
    from kdframe.functions.text import first_present

    user = first_present(*[F.col(c) for c in PROMPT_FIELDS if c in df.columns])
    reply = first_present(*[F.col(c) for c in RESPONSE_FIELDS if c in df.columns])
    return _put(df, exchange(user, reply), keep)


def messages(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep user and assistant messages; a record with none is read as instruction/input/output."""
    wanted = F.filter(
        F.coalesce(F.col("messages"), F.array().cast("array<struct<role:string,content:string>>")),
        lambda m: F.coalesce(m["role"].isin("user", "assistant"), F.lit(False)),
    )
    mapped = F.transform(
        wanted,
        lambda m: F.struct(
            F.when(m["role"] == "user", "human").otherwise("gpt").alias("from"),
            m["content"].alias("value"),
        ),
    )
    return _put(df, F.when(F.size(wanted) > 0, mapped).otherwise(alpaca_conversation(df)), keep)
