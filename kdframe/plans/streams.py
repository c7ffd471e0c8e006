"""Queries X1-X7: streaming flows over file sources, checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from kdframe.plans import tables
from kdframe.plans.catalog import digest, query, r6
from kdframe.session import fresh_path
from kdframe.sources.tables import read_snapshot
from kdframe.streaming import flows


def event_stream(spark, root):
    return flows.read_stream(spark, root, "events.parquet")


_PROBE = """
SELECT step, printf('%.4f', loss_kd) AS kd, CASE WHEN loss_xe IS NULL THEN 'N/A' WHEN isnan(loss_xe) THEN 'NaN'
         ELSE printf('%.4f', loss_xe) END AS ce, coalesce(printf('%.3f', alpha), 'N/A') AS alpha
FROM trainlog WHERE step = 1 OR step % 100 = 0"""


@query("x1_training_probe", _PROBE)
def x1(spark, root):
    return flows.drain(flows.training_probe(tables.trainlog_of(event_stream(spark, root))), "probe")


@query("x1_training_probe_batch", _PROBE)
def x1_batch(spark, root):
    return flows.training_probe(tables.trainlog_of(tables.base(spark, root, "events")))


@query("x2_live_tasks", "SELECT task_id, status, round(score, 6) + 0.0 AS score, epoch_us(ts) AS ts_us FROM latest")
def x2(spark, root):
    out = fresh_path(spark, "tasks")
    flows.follow_tasks(tables.status_of(event_stream(spark, root)), out, fresh_path(spark, "tasks-state"))
    newest = read_snapshot(spark, out)
    return newest.select("task_id", "status", r6("score").alias("score"), F.unix_micros("ts").alias("ts_us"))


@query(
    "x3_growing_prefix",
    """SELECT request_id, seq, (sum(length(delta)) OVER (PARTITION BY request_id ORDER BY seq))::BIGINT AS prefix_chars FROM kept""",
)
def x3_prefix(spark, root):
    return flows.growing_prefix(tables.chunks(spark, root))


_FINAL = "SELECT request_id, md5(string_agg(delta, '' ORDER BY seq)) AS digest FROM kept GROUP BY request_id"


@query("x3_final_text", _FINAL)
def x3_final(spark, root):
    return flows.final_text(tables.chunks(spark, root)).select("request_id", digest("text").alias("digest"))


@query("x3_assembled_stream", _FINAL)
def x3_stream(spark, root):
    source = fresh_path(spark, "chunks")
    tables.chunks(spark, root).write.parquet(source)
    assembled = flows.drain(flows.assemble_stream(flows.read_stream(spark, source, "*.parquet")), "assembled").where("not late")
    pieces = F.sort_array(F.collect_list(F.struct("last_seq", "new_text")))
    text = F.array_join(F.transform(pieces, lambda p: p["new_text"]), "")
    return assembled.groupBy("request_id").agg(digest(text).alias("digest")).where(F.col("digest") != F.md5(F.lit("").cast("binary")))


@query(
    "x4_new_suffixes",
    """SELECT request_id, (x).seq::INT AS seq, md5((x).new_text) AS new_text FROM (
         SELECT request_id, unnest(list_reduce(
           [{'text': '', 'added': []::STRUCT(seq BIGINT, new_text VARCHAR)[]}] ||
             list({'text': text, 'added': [{'seq': seq::BIGINT, 'new_text': ''}]} ORDER BY seq),
           lambda last, x: CASE WHEN NOT starts_with(x.text, last.text) THEN last
             WHEN length(x.text) = length(last.text) THEN last
             ELSE {'text': x.text, 'added': last.added || [{'seq': x.added[1].seq, 'new_text': x.text[length(last.text) + 1:]}]} END
         ).added) AS x FROM emitted GROUP BY request_id)""",
)
def x4(spark, root):
    grown = flows.new_suffixes(tables.emitted(spark, root))
    return grown.select("request_id", "seq", digest("new_text").alias("new_text"))


@query(
    "x5_modified_sessions",
    "SELECT DISTINCT chat_id, (chat_id % 2 = 0 OR chat_id % 5 = 4)::INT AS modified FROM sessions",
)
def x5(spark, root):
    return flows.modified_sessions(tables.sessions(spark, root), tables.saved_sessions(spark, root))


@query(
    "x6_list_sessions",
    """SELECT chat_id, epoch_us(last_ts) AS last_us, messages, row_number() OVER (ORDER BY chat_id DESC) - 1 AS place_by_id,
              row_number() OVER (ORDER BY last_ts DESC, chat_id DESC) - 1 AS place_by_time
       FROM (SELECT chat_id, max(ts) AS last_ts, count(*) AS messages FROM sessions GROUP BY chat_id)""",
)
def x6(spark, root):
    listed = flows.list_sessions(tables.sessions(spark, root))
    return listed.select(
        "chat_id", F.unix_micros("last_ts").alias("last_us"), "messages", "place_by_id", "place_by_time"
    )


@query(
    "x7_windowed_health",
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS steps, round(avg(loss_kd), 9) + 0.0 AS mean_kd,
              round(avg(loss_xe) FILTER (WHERE NOT isnan(loss_xe)), 9) + 0.0 AS mean_xe
       FROM trainlog GROUP BY 1
       HAVING max(time_bucket(INTERVAL 1 HOUR, ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM trainlog) - INTERVAL 10 MINUTE""",
)
def x7(spark, root):
    health = flows.drain(flows.windowed_health(tables.trainlog_of(event_stream(spark, root))), "health")
    return health.select(
        F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"),
        "steps",
        F.round("mean_kd", 9).alias("mean_kd"),
        F.round("mean_xe", 9).alias("mean_xe"),
    )


@query(
    "x7_windowed_health_batch",
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS steps, round(avg(loss_kd), 9) + 0.0 AS mean_kd,
              round(avg(loss_xe) FILTER (WHERE NOT isnan(loss_xe)), 9) + 0.0 AS mean_xe FROM trainlog GROUP BY 1""",
)
def x7_batch(spark, root):
    """All windows, the open ones included."""
    health = flows.windowed_health(tables.trainlog_of(tables.base(spark, root, "events")))
    return health.select(
        F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"),
        "steps",
        F.round("mean_kd", 9).alias("mean_kd"),
        F.round("mean_xe", 9).alias("mean_xe"),
    )


@query(
    "x7_stepped_health",
    """SELECT step // 500 AS block, count(*) AS steps, round(avg(loss_kd), 6) + 0.0 AS mean_kd,
              round(avg(loss_xe) FILTER (WHERE NOT isnan(loss_xe)), 6) + 0.0 AS mean_xe FROM trainlog GROUP BY 1""",
)
def x7_steps(spark, root):
    health = flows.stepped_health(tables.trainlog_of(tables.base(spark, root, "events")), 500)
    return health.select("block", "steps", r6("mean_kd").alias("mean_kd"), r6("mean_xe").alias("mean_xe"))
