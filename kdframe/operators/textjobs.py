"""Prompt tables for text jobs, tool-call audit and title cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.functions.text import strip
from kdframe.operators.conversation import message

# fixed values: prompts and sampling parameters of the text jobs
SUMMARISE_SYSTEM = (
    "Concisely summarize the main points of the input text in up to three sentences, "
    "focusing on key information and events."
)
SUMMARISE_PREFILL = "This is a short summary of the text:"
REWRITE_SYSTEM = (
    "You are an AI writing assistant. Your task is to rewrite the user's email to make it more "
    "professional and approachable while maintaining its main points and key message. "
    "Do not return any text other than the rewritten message."
)
REWRITE_PREFIX = (
    "Rewrite the message below to make it more professional and approachable while maintaining its "
    "main points and key message. Do not add any new information or return any text other than the "
    "rewritten message\nThe message:"
)
TITLE_PREFIX = "Create a title for this conversation:"
JOB_FIELDS = (
    "job:string,system:string,prefix:string,prefill:string,"
    "temperature:double,top_p:double,top_k:int,repeat_penalty:double,max_tokens:int"
)
JOBS = [
    ("summarise", SUMMARISE_SYSTEM, "", SUMMARISE_PREFILL, 0.1, 0.9, 50, 1.2, 1024),
    ("question", None, None, None, 0.1, 0.9, 50, 1.2, 1024),
    ("rewrite", REWRITE_SYSTEM, REWRITE_PREFIX, None, 0.4, 0.9, 0, 1.0, 1024),
    ("title", None, TITLE_PREFIX, None, 0.6, 0.9, 0, 1.1, 128),
]
# fixed values: tool names the agent knows
TOOLS = ["get_random_number_between", "get_current_time", "open_webbrowser", "get_weather"]

CALLS = "array<struct<name:string,arguments:map<string,string>>>"


def job_rows() -> Column:
    """The four jobs as an array literal, so that crossing them with texts needs no join."""
    rows = [F.struct(*[F.lit(v) for v in job]) for job in JOBS]
    return F.array(*rows).cast(f"array<struct<{JOB_FIELDS}>>")


def job_messages(text: Column, question: Column | None = None) -> Column:
    """Messages of one request, from a text and a row of the job table."""
    asked = F.lit("") if question is None else question
    follow_up = F.concat(F.lit("Original text:\n"), text, F.lit("\n\nQuestion: "), asked)
    prompt = F.when(F.col("job") == "question", follow_up).otherwise(F.concat(F.col("prefix"), F.lit("\n"), text))
    optional = F.array(
        F.when(F.col("system").isNotNull(), message("system", F.col("system"))),
        message("user", prompt),
        F.when(F.col("prefill").isNotNull(), message("assistant", F.col("prefill"))),
    )
    return F.filter(optional, lambda m: m.isNotNull())


def text_requests(texts: DataFrame, text: str, question: Column | None = None) -> DataFrame:
    """One request per text and job."""
    return texts.select("*", F.inline(job_rows())).withColumn("messages", job_messages(F.col(text), question))


def parse_tool_calls(df: DataFrame, text: str = "text", tools: list[str] | None = None) -> DataFrame:
    """One row per tool call of the first tagged block; without calls, the raw text is kept.

    A missing tag, an empty list, unreadable JSON, a call without a name and a call of a known tool
    without arguments all count as no call.
    """
    names = TOOLS if tools is None else tools
    body = F.regexp_extract(F.col(text), r"(?s)<tool_call>(.*?)</tool_call>", 1)
    calls = F.from_json(F.when(body.rlike(r"^\s*\["), body), CALLS)
    complete = F.forall(calls, lambda c: c["name"].isNotNull() & (~c["name"].isin(names) | c["arguments"].isNotNull()))
    usable = (F.size(calls) > 0) & complete
    parsed = df.withColumn("_calls", F.when(usable, calls))
    exploded = parsed.select(*df.columns, F.posexplode_outer("_calls").alias("call", "_one"))
    known = F.col("_one.name").isin(names)
    return (
        exploded.withColumn("tool", F.col("_one.name"))
        .withColumn("arguments", F.col("_one.arguments"))
        .withColumn("known", F.when(F.col("call").isNotNull(), F.coalesce(known, F.lit(False))))
        .withColumn(
            "outcome",
            F.when(F.col("call").isNull(), F.col(text))
            .when(F.col("known"), "call")
            .otherwise(F.concat(F.lit("Tool "), F.col("tool"), F.lit(" not found."))),
        )
        .drop("_one")
    )


def clean_title(title: Column) -> Column:
    """First 50 characters, trimmed, with path separators replaced."""
    return F.translate(strip(F.substring(title, 1, 50)), "/\\", "--")
