"""Queries S1-S11 and D1-D16: sources, sinks and dataset shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from kdframe.operators import adapters, mixture
from kdframe.operators.eval_prompts import parse_suite, task_registry
from kdframe.operators.eval_reports import latest_state, suite_table
from kdframe.operators.eval_scoring import first_result
from kdframe.operators.mixture import Source
from kdframe.operators.ranking import shuffled_rank
from kdframe.plans import tables
from kdframe.plans.catalog import digest, query, r6, spoken
from kdframe.session import fresh_path, materialize
from kdframe.sources import benchmarks
from kdframe.sources import tables as sources

# ---- sources and sinks ----------------------------------------------------------------------


@query("s1_load_split", "SELECT doc_id, lang, md5(text) AS digest FROM documents WHERE lang = 'de'")
def s1(spark, root):
    data = sources.load_split(spark, f"{root}/documents.parquet", "de", column="lang")
    return data.select("doc_id", "lang", digest("text").alias("digest"))


@query(
    "s2_load_subset",
    "SELECT source, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source",
)
def s2(spark, root):
    data = sources.load_subset(spark, root, "documents.parquet", tasks=8)
    return data.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@query("s3_text_column", "SELECT page_id, md5(html) AS digest, length(html)::BIGINT AS n_chars FROM pages")
def s3(spark, root):
    pages = sources.text_column(tables.base(spark, root, "pages"), "html", keep=("page_id",))
    return pages.select("page_id", digest("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query(
    "s4_suite_lines",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'extended' ELSE 'custom' END AS suite, source AS task,
              (doc_id % 6)::INT AS shots, (doc_id % 2)::INT AS truncate
       FROM documents""",
)
def s4(spark, root):
    line = F.concat_ws(
        "|",
        F.when(F.col("doc_id") % 5 == 0, "extended").otherwise("custom"),
        "source",
        (F.col("doc_id") % 6).cast("string"),
        (F.col("doc_id") % 2).cast("string"),
    )
    lines = tables.base(spark, root, "documents").select("doc_id", line.alias("value"))
    return parse_suite(lines).withColumn("truncate", F.col("truncate").cast("int"))


@query(
    "s5_task_registry",
    """SELECT task, metric, array_to_string(stops, ',') AS stops, generation_size, count(*) AS items, sum(n_chars)::BIGINT AS n_chars
       FROM suite_items JOIN registry USING (task) GROUP BY ALL""",
)
def s5(spark, root):
    named = tables.suite_items(spark, root).select("task", "n_chars")
    # broadcast: the registry has 42 fixed rows
    return (
        named.join(F.broadcast(task_registry(spark)), "task")
        .groupBy("task", "metric", F.array_join("stops", ",").alias("stops"), "generation_size")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("n_chars").alias("n_chars"))
    )


@query(
    "s6_report_first_result",
    """SELECT doc_id, (json_extract(json_valid_or_null, '$.results.a') IS NOT NULL)::INT AS has_result
       FROM (SELECT doc_id, CASE WHEN json_valid(report) THEN report END AS json_valid_or_null FROM reports)""",
)
def s6(spark, root):
    return tables.reports(spark, root).select(
        "doc_id", first_result(F.col("report")).isNotNull().cast("int").alias("has_result")
    )


RUN_FIELDS = ("prompt", "response", "generation_time", "tokens_generated")
RUN_SCHEMA = (
    "model string, part long, responses array<struct<prompt_idx:long,prompt:string,response:string,"
    "generation_time:double,tokens_generated:long>>"
)


@query(
    "s7_nested_runs",
    """SELECT model, prompt_idx // 1000 AS part, count(*)::INT AS responses, sum(tokens_generated)::BIGINT AS tokens
       FROM runs GROUP BY ALL""",
)
def s7(spark, root):
    nested = sources.nest_runs(tables.runs(spark, root), RUN_FIELDS)
    tokens = F.aggregate("responses", F.lit(0).cast("long"), lambda s, r: s + r["tokens_generated"])
    return nested.select("model", "part", F.size("responses").alias("responses"), tokens.alias("tokens"))


@query(
    "s8_read_runs",
    "SELECT model, prompt_idx, prompt, response, generation_time, tokens_generated FROM runs",
)
def s8(spark, root):
    path = fresh_path(spark, "runs")
    sources.write_runs(tables.runs(spark, root), path, RUN_FIELDS)
    return sources.read_runs(spark, path, RUN_SCHEMA)


@query(
    "s6_report_files",
    """SELECT task_id, CASE WHEN last % 8 < 4 THEN round((quality || '.' || last % 10)::DOUBLE, 6) END AS score,
              (last % 8 NOT IN (4, 7))::INT AS "exists"
       FROM task_reports""",
)
def s6_files(spark, root):
    path = fresh_path(spark, "reports")
    sources.write_reports(tables.task_reports(spark, root), path)
    suite = suite_table(spark).select("task_id", F.col("name").alias("task"))
    return sources.read_reports(spark, path, suite).select("task_id", r6("score").alias("score"), F.col("exists").cast("int").alias("exists"))


@query(
    "s7_benchmark_documents",
    """SELECT position, prompt_idx // 1000 AS part, model AS model_name, model_path, total_params, round(model_size_gb, 6) AS model_size_gb,
              round(s.avg_generation_time, 6) AS avg_generation_time, round(s.avg_tokens_generated, 6) AS avg_tokens_generated,
              round(s.avg_tokens_per_second, 6) AS avg_tokens_per_second, count(*)::INT AS n_responses,
              md5(string_agg(response, '|' ORDER BY prompt_idx)) AS digest
       FROM runs JOIN stats s USING (model) JOIN models USING (model) WHERE model <> 'error' GROUP BY ALL""",
)
def s7_documents(spark, root):
    runs = tables.runs(spark, root).withColumn("failed", F.col("model") == "error")
    documents = benchmarks.benchmark_documents(runs, tables.benchmark_models(spark, root), failed="failed")
    answers = F.array_join(F.transform("responses", lambda r: r["response"]), "|")
    numbers = ("model_size_gb", "avg_generation_time", "avg_tokens_generated", "avg_tokens_per_second")
    return documents.select(
        "position", "part", "model_name", "model_path", "total_params", *(r6(c).alias(c) for c in numbers),
        F.size("responses").alias("n_responses"), digest(answers).alias("digest"),
    )


@query(
    "s8_benchmark_responses",
    """SELECT position, model AS model_name, prompt_idx, prompt, response, tokens_generated, round(tokens_per_second, 6) AS tokens_per_second
       FROM speeds JOIN models USING (model)""",
)
def s8_responses(spark, root):
    rows = benchmarks.benchmark_responses(tables.benchmark_file(spark, root))
    return rows.select(
        "position", "model_name", "prompt_idx", "prompt", "response", "tokens_generated", r6("tokens_per_second").alias("tokens_per_second")
    )


@query(
    "s9_snapshot",
    "SELECT task_id, status, round(score, 6) + 0.0 AS score, epoch_us(ts) AS ts_us FROM latest",
)
def s9(spark, root):
    out = fresh_path(spark, "snapshot")
    updates = tables.status_of(tables.base(spark, root, "events"))
    sources.write_snapshot(latest_state(updates.where("status = 'running'")), out, 0)
    sources.write_snapshot(latest_state(updates), out, 1)
    newest = sources.read_snapshot(spark, out)
    return newest.select("task_id", "status", r6("score").alias("score"), F.unix_micros("ts").alias("ts_us"))


@query(
    "s10_sessions",
    "SELECT chat_id, turn, role, content, epoch_us(ts) AS ts_us FROM sessions",
)
def s10(spark, root):
    path = fresh_path(spark, "sessions")
    sources.write_sessions(tables.sessions(spark, root), path)
    back = sources.read_sessions(spark, path)
    return back.select(F.col("chat_id").cast("long").alias("chat_id"), "turn", "role", "content", F.unix_micros("ts").alias("ts_us"))


@query(
    "s10_chat_ids",
    """SELECT chat_id, CASE WHEN chat_id % 3 = 0 THEN 'chat ' || chat_id ELSE strftime(min(ts), '%Y%m%d_%H%M%S') END AS name
       FROM sessions GROUP BY chat_id""",
)
def s10_ids(spark, root):
    started = tables.sessions(spark, root).groupBy("chat_id").agg(F.min("ts").alias("started"))
    title = F.when(F.col("chat_id") % 3 == 0, F.concat(F.lit("chat "), F.col("chat_id").cast("string"))).otherwise("")
    return started.select("chat_id", sources.chat_id(title, F.col("started")).alias("name"))


@query(
    "s11_saved_splits",
    """SELECT doc_id, md5(text) AS digest FROM (
         SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)
       WHERE k <= ceil(n * 0.1)""",
)
def s11(spark, root):
    path = fresh_path(spark, "splits")
    sources.save_splits(mixture.train_test_split(tables.base(spark, root, "documents"), 0.1, ["doc_id"]), path)
    test = sources.load_split(spark, path, "test")
    return test.select("doc_id", digest("text").alias("digest"))


# ---- shaping --------------------------------------------------------------------------------


@query(
    "d1_seeded_shuffle",
    "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM documents",
)
def d1(spark, root):
    return mixture.shuffle(tables.base(spark, root, "documents").select("doc_id"), ["doc_id"])


@query(
    "d1_shuffle_without_id",
    """SELECT event_type, hour, row_number() OVER (
         ORDER BY md5('42:{"event_type":"' || event_type || '","hour":' || hour || '}')) - 1 AS position
       FROM (SELECT event_type, hour(ts) AS hour FROM events)""",
)
def d1_without_id(spark, root):
    events = tables.base(spark, root, "events").select("event_type", F.hour("ts").cast("long").alias("hour"))
    return mixture.shuffle_without_id(events)


@query(
    "d2_cap_sample",
    "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 300",
)
def d2_sample(spark, root):
    docs = tables.base(spark, root, "documents").select("doc_id", "source")
    return mixture.cap_rows(docs, 300, ["doc_id"], mode="sample")


@query(
    "d2_cap_head",
    """SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position
       FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 300)""",
)
def d2_head(spark, root):
    docs = tables.base(spark, root, "documents").select("doc_id")
    return mixture.shuffle(mixture.cap_rows(docs, 300, ["doc_id"], mode="head"), ["doc_id"])


SPEC = [Source("en", 0.45), Source("de", 0.20), Source("es", 0.10), Source("fr", 0.25)]
TARGET = 700
_QUOTA = f"""
SELECT doc_id, lang, k, wanted FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k,
         CASE lang WHEN 'en' THEN floor({TARGET} * 0.45) WHEN 'de' THEN floor({TARGET} * 0.20)
                   WHEN 'es' THEN floor({TARGET} * 0.10) ELSE floor({TARGET} * 0.25) END AS wanted
  FROM documents WHERE lang IN ('en', 'de', 'es', 'fr')) WHERE k <= wanted"""


def quota_rows(spark, root):
    docs = tables.base(spark, root, "documents").select("doc_id", "lang")
    return mixture.weighted_quota(docs, SPEC, TARGET, ["doc_id"], source="lang")


@query("d3_weighted_quota", f"SELECT doc_id, lang FROM ({_QUOTA})")
def d3(spark, root):
    return quota_rows(spark, root)


JOB = [
    Source("threads", 0.35, adapters.sharegpt, ("doc_id",)),
    Source("tasks", 0.30, adapters.alpaca, ("doc_id",)),
    Source("dialogue", 0.15, adapters.qa, ("conv_id", "turn")),
    Source("web", 0.20, adapters.code, ("page_id",)),
]
_ASKED = "CASE source " + " ".join(f"WHEN '{line.name}' THEN {int(TARGET * line.weight)}" for line in JOB) + " END"


@query(
    "d3_mixture_job",
    f"""WITH everything AS (
          SELECT 0 AS s, 'threads' AS source, doc_id::VARCHAR AS id, count(*) AS turns,
                 string_agg(speaker || '=' || coalesce(value, '<none>'), '|' ORDER BY i) AS body FROM said GROUP BY doc_id
          UNION ALL
          SELECT 1, 'tasks', doc_id::VARCHAR, 2, 'human=' || CASE WHEN input <> ''
                 THEN coalesce(instruction, 'None') || chr(10) || chr(10) || 'Input:' || chr(10) || input
                 ELSE coalesce(instruction, '') END || '|gpt=' || coalesce(output, '') FROM alpaca
          UNION ALL
          SELECT 2, 'dialogue', conv_id || ':' || turn, 2, 'human=' || question || '|gpt=' || answer FROM qa
          UNION ALL
          SELECT 3, 'web', page_id::VARCHAR, 2, 'human=' || url || '|gpt=' || html FROM pages),
        cut AS (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY key) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM (
            SELECT *, md5('42:' || id) AS key, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || id), id) AS k FROM everything)
          WHERE k <= {_ASKED} AND turns >= 2)
        SELECT source, r AS round, r * 4 + s AS out_pos, md5(body) AS digest
        FROM (SELECT unnest(range((SELECT max(n) FROM cut))) AS r) JOIN cut ON place = r % n""",
)
def d3_job(spark, root):
    pages = tables.base(spark, root, "pages").select("page_id", F.col("url").alias("prompt"), F.col("html").alias("solution"))
    given = {
        "threads": tables.threads(spark, root),
        "tasks": tables.alpaca(spark, root),
        "dialogue": tables.qa(spark, root),
        "web": pages,
    }
    mixed = mixture.mix(given, JOB, TARGET)
    return mixed.select("source", "round", "out_pos", digest(spoken("conversations")).alias("digest"))


def _adapted(df, key="doc_id"):
    return df.select(key, F.size("conversations").alias("turns"), digest(spoken("conversations")).alias("digest"))


_SAID = "string_agg(speaker || '=' || coalesce(value, '<none>'), '|' ORDER BY i)"


@query(
    "d4_adapter_sharegpt",
    f"SELECT doc_id, count(*)::INT AS turns, md5({_SAID}) AS digest FROM said GROUP BY doc_id",
)
def d4(spark, root):
    return _adapted(adapters.sharegpt(tables.threads(spark, root), keep=("doc_id",)))


@query(
    "d5_adapter_alpaca",
    """SELECT doc_id, 2::INT AS turns, md5('human=' || CASE WHEN input <> ''
         THEN coalesce(instruction, 'None') || chr(10) || chr(10) || 'Input:' || chr(10) || input
         ELSE coalesce(instruction, '') END || '|gpt=' || coalesce(output, '')) AS digest
       FROM alpaca""",
)
def d5(spark, root):
    return _adapted(adapters.alpaca(tables.alpaca(spark, root), keep=("doc_id",)))


@query(
    "d6_adapter_qa",
    "SELECT conv_id, turn, md5('human=' || question || '|gpt=' || answer) AS digest FROM qa",
)
def d6(spark, root):
    adapted = adapters.qa(tables.qa(spark, root), keep=("conv_id", "turn"))
    return adapted.select("conv_id", "turn", digest(spoken("conversations")).alias("digest"))


@query(
    "d7_adapter_code",
    """SELECT conv_id, turn, md5('human=' || CASE WHEN conv_id % 3 = 0 THEN '' ELSE question END || '|gpt=' ||
         CASE WHEN turn % 4 = 0 THEN answer ELSE question END) AS digest FROM qa""",
)
def d7(spark, root):
    pairs = tables.qa(spark, root).select(
        "conv_id",
        "turn",
        F.when(F.col("conv_id") % 3 == 1, F.col("question")).otherwise("").alias("instruction"),
        F.when(F.col("conv_id") % 3 == 2, F.col("question")).alias("question"),
        F.when(F.col("turn") % 4 == 0, F.col("answer")).alias("response"),
        F.col("question").alias("output"),
    )
    return adapters.code(pairs, keep=("conv_id", "turn")).select(
        "conv_id", "turn", digest(spoken("conversations")).alias("digest")
    )


@query(
    "d8_adapter_messages",
    """SELECT doc_id, CASE WHEN n = 0 THEN 2 ELSE n END::INT AS turns,
              md5(CASE WHEN n = 0 THEN 'human=Summarise ' || source || '|gpt=' || source ELSE body END) AS digest
       FROM (SELECT doc_id, source, count(*) FILTER (WHERE ok) AS n,
                    string_agg(speaker || '=' || coalesce(value, ''), '|' ORDER BY i) FILTER (WHERE ok) AS body
             FROM (SELECT *, speaker IN ('human', 'gpt') AND doc_id % 7 <> 6 AS ok FROM said) GROUP BY doc_id, source)""",
)
def d8(spark, root):
    return _adapted(adapters.messages(tables.messages(spark, root), keep=("doc_id",)))


@query(
    "d9_missing_sides",
    """SELECT doc_id, md5('human=' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END || '|gpt=' ||
              CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END) AS digest FROM documents""",
)
def d9(spark, root):
    human = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    reply = F.when(F.col("doc_id") % 4 != 0, F.col("source"))
    return tables.base(spark, root, "documents").select(
        "doc_id", digest(spoken(adapters.exchange(human, reply))).alias("digest")
    )


@query(
    "d10_enough_turns",
    "SELECT doc_id, count(*)::INT AS turns FROM said GROUP BY doc_id HAVING count(*) >= 2",
)
def d10(spark, root):
    kept = mixture.enough_turns(tables.threads(spark, root))
    return kept.select("doc_id", F.size("conversations").alias("turns"))


@query(
    "d11_map_and_drop",
    f"SELECT md5({_SAID}) AS digest FROM said GROUP BY doc_id",
)
def d11(spark, root):
    mapped = adapters.sharegpt(tables.threads(spark, root))
    return mapped.select(digest(spoken("conversations")).alias("digest"))


@query(
    "d12_interleave",
    f"""SELECT r * 4 + s AS out_pos, r AS round, lang, doc_id, md5(text) AS digest FROM
          (SELECT unnest(range((SELECT max(c) FROM (SELECT count(*) AS c FROM ({_QUOTA}) GROUP BY lang)))) AS r)
          CROSS JOIN (SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS s
                      FROM ({_QUOTA}) GROUP BY lang) AS sizes
          JOIN (SELECT doc_id, lang, k FROM ({_QUOTA})) AS kept USING (lang) JOIN (SELECT doc_id, text FROM documents) USING (doc_id)
        WHERE k - 1 = r % n""",
)
def d12(spark, root):
    # sizes and rounds are both read from it
    placed = materialize(shuffled_rank(quota_rows(spark, root), ["doc_id"], by=["lang"], name="place"))
    docs = tables.base(spark, root, "documents").select("doc_id", "lang", "text")
    mixed = mixture.interleave(placed, [line.name for line in SPEC], "place", source="lang", wide=docs, ids=["doc_id"])
    return mixed.select("out_pos", "round", "lang", "doc_id", digest("text").alias("digest"))


@query(
    "d13_union_shards",
    f"""SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || lang || ':' || doc_id), lang, doc_id) - 1 AS position
        FROM ({_QUOTA})""",
)
def d13(spark, root):
    kept = materialize(quota_rows(spark, root))
    shards = {line.name: kept.where(F.col("lang") == line.name).select("doc_id") for line in SPEC}
    return mixture.shuffle(mixture.union_shards(shards, "lang"), ["lang", "doc_id"])


@query(
    "d14_mixture_report",
    f"""WITH rows_ AS (
          SELECT lang, any_value(asked) AS asked, any_value(have) AS available, count(k) AS kept FROM
            (SELECT lang, CASE lang WHEN 'en' THEN floor({TARGET} * 0.45) WHEN 'de' THEN floor({TARGET} * 0.20)
                   WHEN 'es' THEN floor({TARGET} * 0.10) ELSE floor({TARGET} * 0.25) END::BIGINT AS asked, count(*) AS have
             FROM documents GROUP BY lang) AS a LEFT JOIN (SELECT lang, k FROM ({_QUOTA})) AS b USING (lang) GROUP BY lang),
        full_ AS (SELECT *, max(kept) OVER () AS interleaved FROM rows_)
        SELECT coalesce(lang, 'TOTAL') AS source, sum(asked)::BIGINT AS asked, sum(available)::BIGINT AS available,
               sum(kept)::BIGINT AS kept, sum(interleaved)::BIGINT AS interleaved,
               round(sum(kept) / (SELECT sum(kept) FROM full_), 6) + 0.0 AS kept_share,
               round(sum(interleaved) / (SELECT sum(interleaved) FROM full_), 6) + 0.0 AS effective_share
        FROM full_ GROUP BY ROLLUP (lang)""",
)
def d14(spark, root):
    report = mixture.mixture_report(
        tables.base(spark, root, "documents").select("lang"), quota_rows(spark, root), SPEC, TARGET, source="lang"
    )
    return report.select(
        F.coalesce("lang", F.lit("TOTAL")).alias("source"),
        "asked",
        "available",
        "kept",
        "interleaved",
        r6("kept_share").alias("kept_share"),
        r6("effective_share").alias("effective_share"),
    )


@query(
    "d15_train_test_split",
    """SELECT doc_id, CASE WHEN k <= ceil(n * 0.05) THEN 'test' ELSE 'train' END AS split FROM (
         SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)""",
)
def d15(spark, root):
    return mixture.train_test_split(tables.base(spark, root, "documents").select("doc_id"), 0.05, ["doc_id"])


@query(
    "d16_sides",
    """SELECT conv_id, turn, md5(chosen) AS chosen, md5(rejected) AS rejected FROM preferences""",
)
def d16(spark, root):
    pairs = tables.preferences(spark, root)
    both = mixture.concat_sides(pairs, ["conv_id", "turn"], "chosen", "rejected")
    return mixture.split_sides(both, ["conv_id", "turn"]).select(
        "conv_id", "turn", digest("chosen").alias("chosen"), digest("rejected").alias("rejected")
    )
