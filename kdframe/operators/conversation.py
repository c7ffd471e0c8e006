"""Chat messages and prompt text.

Row-local functions work on ``ARRAY<STRUCT<...>>`` columns. The ``*_turns`` functions do the same
over a flat table of turns, so that a very long conversation is never gathered into one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kdframe.functions.text import strip
from kdframe.operators.ranking import prefix_sum, prefix_sums, range_bucket

# fixed values: default system prompts and the markers of the chat format
DEFAULT_SYSTEM = "You are a helpful assistant."
CHATBOT_SYSTEM = "You are a helpful assistant chatbot."
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT_START = "<|im_start|>assistant\n"
COMPLETION_SUFFIX = "<|im_end|>n"

TURN_RANGE = 65536


def message(role: str | Column, content: str | Column) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(as_column(role).alias("role"), as_column(content).alias("content"))


def map_roles(conversations: Column, keep_system: bool = True) -> Column:
    """human/gpt/system turns as user/assistant/system messages; other speakers are dropped."""
    speakers = ["human", "gpt", "system"] if keep_system else ["human", "gpt"]
    known = F.filter(conversations, lambda t: F.coalesce(t["from"].isin(*speakers), F.lit(False)))
    return F.transform(
        known,
        lambda t: message(
            F.when(t["from"] == "human", "user").when(t["from"] == "gpt", "assistant").otherwise("system"),
            F.coalesce(t["value"], F.lit("")),
        ),
    )


def hoist_system(messages: Column) -> Column:
    """System messages first. Each was pushed to the front, so several come out reversed."""
    return F.concat(
        F.reverse(F.filter(messages, lambda m: m["role"] == "system")),
        F.filter(messages, lambda m: m["role"] != "system"),
    )


def ensure_system(messages: Column, system: str = DEFAULT_SYSTEM) -> Column:
    """Put the default system message first when there is none at all."""
    has = F.exists(messages, lambda m: m["role"] == "system")
    return F.when(has, messages).otherwise(F.concat(F.array(message("system", system)), messages))


def force_system(conversations: Column, system: str = CHATBOT_SYSTEM) -> Column:
    """Drop the conversation's own system turns and use a fixed one."""
    return F.concat(F.array(message("system", system)), map_roles(conversations, keep_system=False))


def render_message(role: Column, content: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), content, F.lit(END + "\n"))


def render_chat(messages: Column, generation_prompt: bool = True, system: str = DEFAULT_SYSTEM) -> Column:
    """Chat-format text, with the default system turn when the first message is not a system one."""
    first_role = F.get(messages, F.lit(0))["role"]
    default = render_message(F.lit("system"), F.lit(system))
    body = F.array_join(F.transform(messages, lambda m: render_message(m["role"], m["content"])), "")
    return F.concat(
        F.when(first_role != "system", default).otherwise(F.lit("")),
        body,
        F.lit(ASSISTANT_START if generation_prompt else ""),
    )


@dataclass(frozen=True)
class Template:
    """A chat format as the text around each message and before the model's answer, and the system turn that it
    puts before a conversation without one."""

    prefix: str
    role_end: str
    suffix: str
    gen_prefix: str
    default_system: str | None = None


# the second format is ours: the teacher's own template text is not public here
TEMPLATES = {
    "chat": Template(START, "\n", END + "\n", ASSISTANT_START, DEFAULT_SYSTEM),
    "tagged": Template("[", "]: ", "\n", "[assistant]: "),
}


def render_with_template(messages: Column, template: Template) -> Column:
    def one(role: Column, content: Column) -> Column:
        return F.concat(F.lit(template.prefix), role, F.lit(template.role_end), content, F.lit(template.suffix))

    body = F.array_join(F.transform(messages, lambda m: one(m["role"], m["content"])), "")
    if template.default_system is not None:
        lacking = F.get(messages, F.lit(0))["role"] != "system"
        body = F.concat(F.when(lacking, one(F.lit("system"), F.lit(template.default_system))).otherwise(F.lit("")), body)
    return F.concat(body, F.lit(template.gen_prefix))


def student_and_teacher_text(
    df: DataFrame, messages: str, student: Template | None, teacher: Template
) -> DataFrame:
    """Both renderings of each conversation. The student falls back on the teacher's template."""
    return df.withColumn(
        "student_text", render_with_template(F.col(messages), student or teacher)
    ).withColumn("teacher_text", render_with_template(F.col(messages), teacher))


def preference_format(df: DataFrame, suffix: str = COMPLETION_SUFFIX, keep: tuple[str, ...] = ()) -> DataFrame:
    """``prompt``, ``chosen`` and ``rejected`` text; an empty system prompt is left out.

    Each part is rendered on its own, so a lone user turn also gets the default system turn.
    """
    system = render_message(F.lit("system"), F.col("system"))
    user = F.concat(
        render_message(F.lit("system"), F.lit(DEFAULT_SYSTEM)),
        render_message(F.lit("user"), F.col("question")),
        F.lit(ASSISTANT_START),
    )
    return df.select(
        *keep,
        F.concat(F.when(F.length("system") > 0, system).otherwise(F.lit("")), user).alias("prompt"),
        F.concat("chosen", F.lit(suffix)).alias("chosen"),
        F.concat("rejected", F.lit(suffix)).alias("rejected"),
    )


def plain_prompt(prompt: Column, rendered: Column | None = None) -> Column:
    """Rendered prompt, or a plain one when the model has no template."""
    plain = F.concat(F.lit("User: "), prompt, F.lit("\nAssistant:"))
    return plain if rendered is None else F.coalesce(rendered, plain)


def transcript(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    return df.where(strip(F.col(text)) != "")


# ---- flat twins: one row per turn ----------------------------------------------------------


def _placed(turns: DataFrame, conv: str) -> DataFrame:
    """Turns of known speakers with their ``place``: system turns are negative, the last one first."""
    place = F.when(F.col("role") == "system", -1 - F.col("turn")).otherwise(F.col("turn"))
    return turns.where(F.col("role").isin("user", "assistant", "system")).select(
        conv, place.alias("place"), "role", "text"
    )


def with_system_turns(turns: DataFrame, conv: str = "conv_id", system: str = DEFAULT_SYSTEM) -> DataFrame:
    """Flat form of ``ensure_system(hoist_system(...))``: ``place`` orders the turns.

    Only rows are relabelled, and a default row is added where there is no system turn; nothing is
    gathered per conversation.
    """
    placed = _placed(turns, conv)
    has = placed.groupBy(conv).agg(F.max((F.col("role") == "system").cast("int")).alias("_has"))
    default = has.where("_has = 0").select(
        conv, F.lit(-1).cast("long").alias("place"), F.lit("system").alias("role"), F.lit(system).alias("text")
    )
    return placed.unionByName(default)


def render_turns(
    turns: DataFrame, generation_prompt: bool = True, conv: str = "conv_id", system: str = DEFAULT_SYSTEM
) -> DataFrame:
    """Text fragment of every turn, plus the default system turn and the generation prompt.

    Concatenating the fragments in ``place`` order gives the conversation's text. Both added
    fragments come from one narrow aggregate per conversation.
    """
    placed = _placed(turns, conv)
    summary = placed.groupBy(conv).agg(
        F.max((F.col("role") == "system").cast("int")).alias("_has"), F.max("place").alias("_last")
    )
    piece = lambda place, text: F.struct(place.alias("place"), text.alias("fragment"))
    opening = piece(F.lit(-1).cast("long"), render_message(F.lit("system"), F.lit(system)))
    added = [F.when(F.col("_has") == 0, opening)]
    if generation_prompt:
        added.append(piece(F.col("_last") + 1, F.lit(ASSISTANT_START)))
    extra = F.filter(F.array(*added), lambda f: f.isNotNull())
    fragments = placed.select(conv, "place", render_message(F.col("role"), F.col("text")).alias("fragment"))
    return fragments.unionByName(summary.select(conv, F.inline(extra)))


def chat_context(
    turns: DataFrame, system: str, last_n: int | None = None, conv: str = "conv_id"
) -> DataFrame:
    """Messages of the next request of every chat: the system prompt, then the history.

    The whole history is sent; ``last_n`` keeps only the latest messages. ``message`` numbers the
    rows from 0.
    """
    history = turns
    if last_n is not None:
        latest = Window.partitionBy(conv).orderBy(F.desc("turn"))
        history = turns.withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= last_n).drop("_back")
    placed = prefix_sum(history, ["turn"], [range_bucket(F.col("turn"), TURN_RANGE)], by=[conv], name="message")
    body = placed.select(conv, (F.col("message") + 1).alias("message"), "role", F.col("text").alias("content"))
    head = turns.select(conv).distinct()
    return body.unionByName(
        head.select(
            conv, F.lit(0).cast("long").alias("message"), F.lit("system").alias("role"), F.lit(system).alias("content")
        )
    )


def context_sizes(turns: DataFrame, system: str, conv: str = "conv_id") -> DataFrame:
    """Messages and characters sent when each user turn is processed, from running sums."""
    bucket = [range_bucket(F.col("turn"), TURN_RANGE)]
    narrow = turns.select(conv, "turn", "role", F.length("text").cast("long").alias("_chars"))
    summed = prefix_sums(narrow, ["turn"], bucket, {"_earlier": F.lit(1), "_before": F.col("_chars")}, by=[conv])
    return summed.where("role = 'user'").select(
        conv,
        "turn",
        (F.col("_earlier") + 2).alias("messages"),
        (F.col("_before") + F.col("_chars") + len(system)).alias("chars"),
    )
