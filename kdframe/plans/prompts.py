"""Queries C1-C14: conversations, prompt text, text jobs and tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from kdframe.operators import conversation as chat
from kdframe.operators import textjobs
from kdframe.plans import tables
from kdframe.plans.catalog import digest, listed, query

_LISTED = "string_agg(role || '=' || content, '|' ORDER BY i)"
_KNOWN = "SELECT * FROM spoken_roles WHERE role IN ('user', 'assistant', 'system')"
# system messages come first, the last of them leading; place -1000000 is the default one
_HOISTED = f"""
SELECT doc_id, CASE WHEN role = 'system' THEN -1 - i ELSE i END AS i, role, content FROM ({_KNOWN})
UNION ALL
SELECT doc_id, -1000000, 'system', 'You are a helpful assistant.' FROM spoken_roles
GROUP BY doc_id HAVING count(*) FILTER (WHERE role = 'system') = 0"""


def mapped(spark, root):
    return tables.threads(spark, root).select(
        "doc_id", chat.map_roles(F.col("conversations")).alias("messages")
    )


def prepared(spark, root):
    """Role mapping, hoisted system turns and the default one."""
    hoisted = mapped(spark, root).withColumn("messages", chat.hoist_system(F.col("messages")))
    return hoisted.withColumn("messages", chat.ensure_system(F.col("messages")))


def _messages(df):
    return df.select("doc_id", F.size("messages").alias("n"), digest(listed("messages")).alias("digest"))


@query(
    "c1_role_map",
    f"""SELECT doc_id, count(role)::INT AS n, md5(coalesce(string_agg(role || '=' || content, '|' ORDER BY i), '')) AS digest
        FROM (SELECT doc_id, i, CASE WHEN role <> 'tool' THEN role END AS role, content FROM spoken_roles) GROUP BY doc_id""",
)
def c1(spark, root):
    return _messages(mapped(spark, root))


@query(
    "c2_hoist_system",
    f"""SELECT d.doc_id, count(k.role)::INT AS n, md5(coalesce(string_agg(k.role || '=' || k.content, '|'
          ORDER BY CASE WHEN k.role = 'system' THEN -1 - k.i ELSE k.i END), '')) AS digest
        FROM documents d LEFT JOIN ({_KNOWN}) k USING (doc_id) GROUP BY d.doc_id""",
)
def c2(spark, root):
    return _messages(mapped(spark, root).withColumn("messages", chat.hoist_system(F.col("messages"))))


@query(
    "c3_default_system",
    f"SELECT doc_id, count(*)::INT AS n, md5({_LISTED}) AS digest FROM ({_HOISTED}) GROUP BY doc_id",
)
def c3(spark, root):
    return _messages(prepared(spark, root))


@query(
    "c3_default_system_turns",
    """SELECT conv_id, CASE WHEN role = 'system' THEN -1 - turn ELSE turn END AS place, role, text FROM conversations
       UNION ALL SELECT conv_id, -1, 'system', 'You are a helpful assistant.' FROM conversations
       GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') = 0""",
)
def c3_turns(spark, root):
    return chat.with_system_turns(tables.turns(spark, root))


@query(
    "c4_force_system",
    """SELECT d.doc_id, (1 + count(k.role))::INT AS n, md5('system=You are a helpful assistant chatbot.' ||
          coalesce('|' || string_agg(k.role || '=' || k.content, '|' ORDER BY k.i), '')) AS digest
       FROM documents d LEFT JOIN (SELECT * FROM spoken_roles WHERE role IN ('user', 'assistant')) k USING (doc_id)
       GROUP BY d.doc_id""",
)
def c4(spark, root):
    return _messages(
        tables.threads(spark, root).select("doc_id", chat.force_system(F.col("conversations")).alias("messages"))
    )


_RENDER = "'<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10)"


@query(
    "c5_render_chat",
    f"""SELECT d.doc_id, md5(coalesce(
          CASE WHEN arg_min(k.role, k.i) <> 'system'
               THEN '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) ELSE '' END
          || string_agg({_RENDER}, '' ORDER BY k.i), '') || '<|im_start|>assistant' || chr(10)) AS digest
        FROM documents d LEFT JOIN ({_KNOWN}) k USING (doc_id) GROUP BY d.doc_id""",
)
def c5(spark, root):
    text = chat.render_chat(F.col("messages"))
    return mapped(spark, root).select("doc_id", digest(text).alias("digest"))


@query("c5_render_turns", "SELECT conv_id, place, fragment FROM fragments")
def c5_turns(spark, root):
    return tables.fragments(spark, root)


@query(
    "c6_two_templates",
    f"""SELECT doc_id, md5(string_agg({_RENDER}, '' ORDER BY i) || '<|im_start|>assistant' || chr(10)) AS student_text,
               md5(string_agg('[' || role || ']: ' || content || chr(10), '' ORDER BY i) || '[assistant]: ') AS teacher_text
        FROM ({_HOISTED}) GROUP BY doc_id""",
)
def c6(spark, root):
    both = chat.student_and_teacher_text(
        prepared(spark, root), "messages", chat.TEMPLATES["chat"], chat.TEMPLATES["tagged"]
    )
    return both.select(
        "doc_id", digest("student_text").alias("student_text"), digest("teacher_text").alias("teacher_text")
    )


@query(
    "c7_preference_format",
    "SELECT conv_id, turn, md5(prompt) AS prompt, md5(chosen) AS chosen, md5(rejected) AS rejected FROM pref_text",
)
def c7(spark, root):
    pairs = chat.preference_format(tables.preferences(spark, root), keep=("conv_id", "turn"))
    return pairs.select("conv_id", "turn", *[digest(c).alias(c) for c in ("prompt", "chosen", "rejected")])


@query(
    "c8_plain_prompt",
    """SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10)
              ELSE 'User: ' || text || chr(10) || 'Assistant:' END AS prompt FROM benchmark""",
)
def c8(spark, root):
    rendered = F.when(F.col("item_id") % 2 == 0, chat.render_message(F.lit("user"), F.col("text")))
    return tables.base(spark, root, "benchmark").select(
        "item_id", chat.plain_prompt(F.col("text"), rendered).alias("prompt")
    )


@query(
    "c9_transcript",
    f"SELECT doc_id, md5(string_agg(role || ': ' || content, chr(10) ORDER BY i)) AS digest FROM ({_HOISTED}) GROUP BY doc_id",
)
def c9(spark, root):
    return prepared(spark, root).select("doc_id", digest(chat.transcript(F.col("messages"))).alias("digest"))


_QUOTED = {
    name: "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, text in {
        "sum": textjobs.SUMMARISE_SYSTEM,
        "pre": textjobs.SUMMARISE_PREFILL,
        "rsys": textjobs.REWRITE_SYSTEM,
        "rpre": textjobs.REWRITE_PREFIX,
        "title": textjobs.TITLE_PREFIX,
    }.items()
}


@query(
    "c10_text_jobs",
    f"""SELECT doc_id, job, md5(CASE job
          WHEN 'summarise' THEN 'system=' || {_QUOTED["sum"]} || '|user=' || chr(10) || text || '|assistant=' || {_QUOTED["pre"]}
          WHEN 'question' THEN 'user=Original text:' || chr(10) || text || chr(10) || chr(10) || 'Question: What about ' || source || '?'
          WHEN 'rewrite' THEN 'system=' || {_QUOTED["rsys"]} || '|user=' || {_QUOTED["rpre"]} || chr(10) || text
          ELSE 'user=' || {_QUOTED["title"]} || chr(10) || text END) AS digest, temperature, top_k, max_tokens
        FROM documents CROSS JOIN (VALUES ('summarise', 0.1::DOUBLE, 50, 1024), ('question', 0.1::DOUBLE, 50, 1024),
          ('rewrite', 0.4::DOUBLE, 0, 1024), ('title', 0.6::DOUBLE, 0, 128)) AS j(job, temperature, top_k, max_tokens)""",
)
def c10(spark, root):
    question = F.concat(F.lit("What about "), "source", F.lit("?"))
    requests = textjobs.text_requests(tables.base(spark, root, "documents"), "text", question)
    return requests.select("doc_id", "job", digest(listed("messages")).alias("digest"), "temperature", "top_k", "max_tokens")


@query(
    "c11_chat_context",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message, role, text AS content FROM conversations
       UNION ALL SELECT DISTINCT conv_id, 0, 'system', 'Be brief.' FROM conversations""",
)
def c11(spark, root):
    return chat.chat_context(tables.turns(spark, root), "Be brief.")


@query(
    "c11_last_messages",
    """SELECT conv_id, k2 AS message, role, text AS content FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k2 FROM (
           SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 5)
       UNION ALL SELECT DISTINCT conv_id, 0, 'system', 'Be brief.' FROM conversations""",
)
def c11_last(spark, root):
    return chat.chat_context(tables.turns(spark, root), "Be brief.", last_n=5)


@query(
    "c11_context_sizes",
    """SELECT conv_id, turn, messages, chars FROM (
         SELECT conv_id, turn, role, 1 + row_number() OVER w AS messages, (9 + sum(length(text)) OVER w)::BIGINT AS chars
         FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""",
)
def c11_sizes(spark, root):
    return chat.context_sizes(tables.turns(spark, root), "Be brief.")


@query(
    "c12_drop_blank",
    r"SELECT doc_id, i, md5(line) AS digest FROM lines WHERE NOT regexp_full_match(line, '\s*')",
)
def c12(spark, root):
    lines = tables.base(spark, root, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return chat.drop_blank(lines.withColumn("i", F.col("i").cast("long")), "line").select(
        "doc_id", "i", digest("line").alias("digest")
    )


@query(
    "c13_tool_calls",
    """SELECT doc_id, calls.call::INT AS call, calls.tool, calls.known, calls.args,
              coalesce(calls.outcome, md5(text)) AS outcome
       FROM agent_out LEFT JOIN (VALUES
         (0, 0, 'get_weather', 1, 'city=Oslo', 'call'), (1, 0, 'get_current_time', 1, '', 'call'),
         (1, 1, 'fly', 0, 'to=7', 'Tool fly not found.'), (4, 0, 'fly', 0, 'to=8', 'Tool fly not found.'))
         AS calls(kind, call, tool, known, args, outcome) ON doc_id % 7 = calls.kind""",
)
def c13(spark, root):
    audited = textjobs.parse_tool_calls(tables.agent_outputs(spark, root))
    entries = F.array_join(F.transform(F.map_entries("arguments"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return audited.select(
        "doc_id",
        "call",
        "tool",
        F.col("known").cast("int").alias("known"),
        entries.alias("args"),
        F.when(F.col("call").isNull(), digest("outcome")).otherwise(F.col("outcome")).alias("outcome"),
    )


@query(
    "c14_clean_title",
    r"""SELECT page_id, translate(regexp_replace(left(url || ' \', 50), '^\s+|\s+$', '', 'g'), '/\', '--') AS title FROM pages""",
)
def c14(spark, root):
    return tables.base(spark, root, "pages").select(
        "page_id", textjobs.clean_title(F.concat("url", F.lit(" \\"))).alias("title")
    )
