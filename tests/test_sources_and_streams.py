"""Files in and out, and streaming flows against their batch meaning."""

import json

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kdframe import registry
from kdframe.operators import adapters, conversation, eval_prompts, kd_logits, textjobs, tokens
from kdframe.operators.eval_reports import compare_models, generation_stats, latest_state
from kdframe.operators.eval_scoring import first_result, pick_score
from kdframe.sources import tables as sources
from kdframe.streaming import flows


def test_suite_files(spark, tmp_path):
    (tmp_path / "suite.txt").write_text("custom|arc|0|1\nextended|ifeval|5|0\n\n")
    rows = sources.read_suite(spark, str(tmp_path / "suite.txt")).collect()
    assert [tuple(r) for r in rows] == [("custom", "arc", 0, True), ("extended", "ifeval", 5, False)]


def test_first_available_dataset(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "second"))
    names = [str(tmp_path / "first"), str(tmp_path / "second")]
    assert eval_prompts.first_available(spark, names).count() == 4


def test_splits_are_pruned_on_read(spark, tmp_path):
    path = str(tmp_path / "data")
    sources.save_splits(spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train")), path)
    test = sources.load_split(spark, path, "test")
    assert sorted(r.id for r in test.collect()) == [0, 1, 2]
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()
    assert sources.load_subset(spark, str(tmp_path), "data", "train", tasks=2).count() == 7


def test_registry_has_42_tasks(spark):
    registry = eval_prompts.task_registry(spark)
    assert registry.count() == 42 and registry.where("task LIKE 'bbh:%'").count() == 27
    assert registry.where("task LIKE 'math:%' AND generation_size = 1024").count() == 7


def test_every_task_has_its_prompt_and_metric(spark):
    tasks = eval_prompts.task_registry(spark).collect()
    assert {t.prompt for t in tasks} <= set(registry.PROMPTS)
    assert {t.metric for t in tasks} <= set(registry.METRICS)


def test_prompts_of_the_registry(spark):
    row = ("What?", ["A", "B"], ["x", "y"], "B", "42", ["p", "q"], "The _ is full.", "cup", "jar", "2")
    kind = "question string, labels array<string>, texts array<string>, answer_key string, answer string, aliases array<string>, sentence string, option1 string, option2 string"
    df = spark.createDataFrame([row[:9]], kind)
    got = {n: registry.PROMPTS[n](df).select("query", "choices", "gold_index").first() for n in ("arc", "openbookqa", "commonsense_qa", "gsm8k", "triviaqa")}
    asked = "Question: What?\nAnswer:"
    assert tuple(got["arc"]) == tuple(got["openbookqa"]) == (asked, [" x", " y"], 1)
    assert tuple(got["commonsense_qa"]) == ("What?", [" x", " y"], 1)
    assert tuple(got["gsm8k"]) == (asked, [" 42"], 0) and tuple(got["triviaqa"]) == (asked, ["p", "q"], 0)
    gap = registry.PROMPTS["winogrande"](df.withColumn("answer", F.lit("2"))).select("query", "choices", "gold_index").first()
    assert tuple(gap) == ("The ", ["cup is full.", "jar is full."], 1)
    scored = spark.createDataFrame([("t", ([-2.0, -3.0], [" a", " bbbb"]), 1)], "task string, p struct<logps:array<double>,choices:array<string>>, gold int")
    assert registry.score(scored, "loglikelihood_acc_norm_nospace", "p", "gold").first().score == 1.0


def test_reports_missing_and_corrupt(spark, tmp_path):
    (tmp_path / "arc.json").write_text(json.dumps({"results": {"x": {"acc": 0.25}, "y": {"acc": 9}}}, indent=1))
    (tmp_path / "bbh.json").write_text("{broken")
    tasks = spark.createDataFrame([("arc",), ("bbh",), ("math",)], "task string")
    got = {r.task: (r.score, r.exists) for r in sources.read_reports(spark, str(tmp_path), tasks).collect()}
    assert got == {"arc": (0.25, True), "bbh": (None, False), "math": (None, False)}


@pytest.mark.parametrize(
    "metrics, wanted",
    [
        ({"score": 1, "accuracy": 0.5}, 0.5),
        ({"acc": "high", "score": 2}, 2.0),
        ({"metrics": {"em": 0.75, "exact_match": 1}}, 0.75),
        ({"exact_match": 0.5, "metrics": {"acc": 1}}, 0.5),
        ({"pass@1": 0.125}, 0.125),
        ({"other": 3}, None),
    ],
)
def test_score_lookup_order(spark, metrics, wanted):
    df = spark.createDataFrame([(json.dumps({"results": {"t": metrics}}),)], "r string")
    assert df.select(pick_score(first_result(F.col("r")))).first()[0] == wanted


def test_runs_round_trip_in_parts(spark, tmp_path):
    rows = [("m", i, f"r{i}") for i in range(2500)] + [("k", 0, "x")]
    df = spark.createDataFrame(rows, "model string, prompt_idx long, response string")
    out = str(tmp_path / "runs")
    sources.write_runs(df, out, ["response"])
    schema = "model string, part long, responses array<struct<prompt_idx:long,response:string>>"
    back = sources.read_runs(spark, out, schema)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert spark.read.schema(schema).json(out).where("model = 'm'").count() == 3


def test_hand_made_benchmark_file(spark, tmp_path):
    models = [{"model": "a", "responses": [{"prompt_idx": 0, "response": "x"}]}, {"model": "b", "responses": []}]
    (tmp_path / "b.json").write_text(json.dumps(models, indent=2))
    schema = "model string, responses array<struct<prompt_idx:long,response:string>>"
    rows = sources.read_runs(spark, str(tmp_path / "b.json"), schema, multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("a", 0, "x")]


def test_snapshot_reader_takes_the_newest_committed(spark, tmp_path):
    root = str(tmp_path / "snap")
    sources.write_snapshot(spark.range(3), root, 0)
    sources.write_snapshot(spark.range(5), root, 1)
    (tmp_path / "snap" / "version=2").mkdir()
    assert sources.read_snapshot(spark, root).count() == 5
    assert sources.read_snapshot(spark, root, below=1).count() == 3


def test_adapters_edge_cases(spark):
    df = spark.createDataFrame(
        [(None, "in", None), ("do", "", "out"), (None, None, "o"), ("do", "in", "out")],
        "instruction string, input string, output string",
    )
    got = [[t.value for t in r.conversations] for r in adapters.alpaca(df).collect()]
    assert got == [["None\n\nInput:\nin", ""], ["do", "out"], ["", "o"], ["do\n\nInput:\nin", "out"]]
    plain = spark.createDataFrame([("x",)], "unrelated string")
    assert [[t.value for t in r.conversations] for r in adapters.qa(plain).collect()] == [["", ""]]
    assert [[t.value for t in r.conversations] for r in adapters.code(plain).collect()] == [["", ""]]


def test_tool_calls(spark):
    rows = [
        (0, 'x <tool_call>[{"name":"get_weather","arguments":{"city":"Oslo"}}]</tool_call>'),
        (1, "<tool_call>[]</tool_call>"),
        (2, "<tool_call>not json</tool_call>"),
        (3, "plain"),
        (4, '<tool_call>[\n{"name":"fly"},\n{"name":"get_current_time","arguments":{}}]</tool_call>'),
        (5, '<tool_call>[{"arguments":{}}]</tool_call>'),
        (6, '<tool_call>[{"name":"get_weather"},{"name":"fly"}]</tool_call>'),
    ]
    out = textjobs.parse_tool_calls(spark.createDataFrame(rows, "id int, text string"))
    got = sorted((r.id, -1 if r.call is None else r.call, r.outcome) for r in out.collect())
    assert got == [
        (0, 0, "call"), (1, -1, rows[1][1]), (2, -1, rows[2][1]), (3, -1, "plain"),
        (4, 0, "Tool fly not found."), (4, 1, "call"), (5, -1, rows[5][1]), (6, -1, rows[6][1]),
    ]


def test_titles(spark):
    df = spark.createDataFrame([("  a/b\\c \t",), ("x" * 60,)], "t string")
    assert [r[0] for r in df.select(textjobs.clean_title(F.col("t"))).collect()] == ["a-b-c", "x" * 50]


def test_generation_stats_and_comparison(spark):
    rows = [("a", 1.0, 10), ("a", 3.0, 10), ("b", 0.0, 5), ("c", 2.0, 40)]
    df = spark.createDataFrame(rows, "model string, generation_time double, tokens_generated long")
    stats = generation_stats(df)
    got = {r.model: r.avg_tokens_per_second for r in stats.collect()}
    assert got == {"a": 5.0, "b": 0.0, "c": 20.0}
    assert compare_models(stats).first().speed_change_pct == pytest.approx(300.0)
    assert compare_models(stats, "a", "a").count() == 0
    assert compare_models(stats, "b", "a").first().speed_change_pct is None


CHUNKS = "request_id long, seq long, delta string, ts timestamp"


def chunk_rows():
    words = {1: ["He", "llo", "", " you"], 2: ["a", "<end_action>", "b"], 3: ["<|endoftext|>", "z"], 4: ["x"] * 40}
    rows = [(k, i, w) for k, ws in words.items() for i, w in enumerate(ws)]
    return rows, {1: "Hello you", 2: "a", 4: "x" * 40}


def test_stream_assembles_out_of_order_chunks(spark, tmp_path):
    rows, wanted = chunk_rows()
    rows = sorted(rows, key=lambda r: (r[1] * 7919 + r[0]) % 31)
    for i in range(0, len(rows), 12):
        part = spark.createDataFrame(rows[i : i + 12], "request_id long, seq long, delta string")
        part.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flows.read_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    out = flows.drain(flows.assemble_stream(stream), "t").orderBy("last_seq").collect()
    got = {}
    for r in out:
        got[r.request_id] = got.get(r.request_id, "") + r.new_text
        assert r.prefix_chars == len(got[r.request_id])
    assert {k: v for k, v in got.items() if v} == wanted
    batch = spark.createDataFrame([(*r, None) for r in rows], CHUNKS)
    assert {r.request_id: r.text for r in flows.final_text(batch).collect()} == wanted


def test_final_text_over_part_borders(spark, monkeypatch):
    monkeypatch.setattr(flows, "PART_CHUNKS", 4)
    rows = [(1, i, str(i % 10)) for i in range(30)] + [(2, i, "<end_action>" if i == 9 else "a") for i in range(30)]
    df = spark.createDataFrame([(*r, None) for r in rows], CHUNKS)
    got = {r.request_id: r.text for r in flows.final_text(df).collect()}
    assert got == {1: "".join(str(i % 10) for i in range(30)), 2: "a" * 9}
    prefix = flows.growing_prefix(df).groupBy("request_id").agg(F.max("prefix_chars").alias("m"), F.count("*").alias("n"))
    assert {(r.request_id, r.m, r.n) for r in prefix.collect()} == {(1, 30, 30), (2, 9, 9)}


def test_live_tasks_over_several_batches(spark, tmp_path):
    base = spark.range(60).select(
        (F.col("id") % 5).alias("task_id"),
        F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"),
        F.when(F.col("id") > 50, "done").otherwise("running").alias("status"),
        F.col("id").cast("double").alias("score"),
    )
    for low in (40, 0, 20):
        base.where((F.col("score") >= low) & (F.col("score") < low + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flows.read_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    flows.follow_tasks(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sources.read_snapshot(spark, str(tmp_path / "out")).select("task_id", "ts", "status", "score")
    want = latest_state(base).select("task_id", "ts", "status", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_new_suffixes(spark):
    rows = [(1, 0, "a"), (1, 1, "ab"), (1, 2, "ab"), (1, 3, "x"), (1, 4, "xyz")]
    df = spark.createDataFrame(rows, "request_id int, seq int, text string")
    assert [(r.seq, r.new_text) for r in flows.new_suffixes(df).orderBy("seq").collect()] == [(0, "a"), (1, "b")]
    rows = [(1, 0, "ab"), (1, 1, "x"), (1, 2, "abc"), (2, 0, "ab"), (2, 1, "a"), (2, 2, "abc"), (3, 0, None), (3, 1, "q")]
    df = spark.createDataFrame(rows, "request_id int, seq int, text string")
    got = [(r.request_id, r.seq, r.new_text) for r in flows.new_suffixes(df).orderBy("request_id", "seq").collect()]
    assert got == [(1, 0, "ab"), (1, 2, "c"), (2, 0, "ab"), (2, 2, "c"), (3, 1, "q")]


class Handle:
    """State of one key, as the engine would hold it."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):  # noqa: N802
        return Value()

    def getMapState(self, name, key, value):  # noqa: N802
        return Kept()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Kept(dict):
    containsKey, getValue, removeKey, updateValue = dict.__contains__, dict.__getitem__, dict.__delitem__, dict.__setitem__  # noqa: N815

    def iterator(self):
        return iter(self.items())


def test_a_delta_that_is_sent_again_is_given_out_once():
    def deltas(*rows):
        return pd.DataFrame([(s, d, pd.Timestamp("2024-01-01")) for s, d in rows], columns=["seq", "delta", "ts"])

    request, handle, out = flows.Assembly(5000), Handle(), []
    request.init(handle)
    for batch in ([(0, "a"), (1, "b")], [(1, "b"), (0, "a")], [(2, "c"), (4, "e")]):
        out += [r for frame in request.handleInputRows((1,), iter([deltas(*batch)]), None) for r in frame["new_text"]]
    assert handle.timers == {pd.Timestamp("2024-01-01").timestamp() * 1000 + 5000}
    assert dict(request.waiting) == {(4,): ("e",)}
    out += [r for frame in request.handleExpiredTimer((1,), None, None) for r in frame["new_text"]]
    assert out == ["ab", "c", "e"] and not request.waiting
    after = [r for frame in request.handleInputRows((1,), iter([deltas((0, "a"), (3, "d"), (5, "f"))]), None) for r in frame.to_dict("records")]
    assert [(r["last_seq"], r["new_text"], r["late"]) for r in after] == [(5, "f", True)]


def test_deltas_after_eviction_go_to_the_side_table(spark, tmp_path):
    given = [
        [(1, 0, "a", "00:00:00"), (1, 2, "c", "00:00:01"), (2, 0, "x", "00:00:00")],
        [(3, 0, "z", "03:00:00")],  # moves the watermark on
        [(3, 1, "z", "03:00:01")],  # and by then requests 1 and 2 are evicted
        [(1, 0, "a", "03:00:02"), (1, 3, "d", "03:00:02"), (2, 1, "y", "03:00:02"), (3, 2, "<end_action>", "03:00:03"), (3, 3, "q", "03:00:03")],
    ]
    for i, rows in enumerate(given):
        part = spark.createDataFrame(rows, "request_id long, seq long, delta string, ts string")
        part = part.withColumn("ts", F.concat(F.lit("2024-01-01 "), "ts").cast("timestamp")).coalesce(1)
        part.write.parquet(str(tmp_path / "in" / f"part={i}"))
        os.utime(next((tmp_path / "in" / f"part={i}").glob("*.parquet")), (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema("request_id long, seq long, delta string, ts timestamp").option("recursiveFileLookup", "true")
    stream = source.option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    texts, late, state = (str(tmp_path / x) for x in ("texts", "late", "state"))
    flows.assemble_into(stream, texts, late, state, idle="1 minute", late="1 minute")
    found = {}
    for r in spark.read.parquet(texts).sort("request_id", "last_seq").collect():
        found[r["request_id"]] = found.get(r["request_id"], "") + r["new_text"]
    assert found == {1: "ac", 2: "x", 3: "zz"}
    assert {(r["request_id"], r["seq"], r["delta"]) for r in spark.read.parquet(late).collect()} == {(1, 3, "d"), (2, 1, "y")}


def test_many_growing_texts_of_one_request(spark):
    """A third of all rows may be one request: its texts stream past, and are never gathered."""
    n = 20_000
    rows = spark.range(n).select(
        F.lit(7).alias("request_id"), F.col("id").alias("seq"), F.repeat(F.lit("ab"), F.col("id").cast("int")).alias("text")
    )
    grown = flows.new_suffixes(rows)
    plan = grown._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan
    got = grown.agg(F.count("*"), F.sum(F.length("new_text")), F.max("seq")).first()
    assert tuple(got) == (n - 1, 2 * (n - 1), n - 1)


def test_suffix_folds_start_anew(spark):
    rows = [(1, 0, "a"), (1, 1, None), (1, 2, "ab"), (1, 3, "x"), (1, 4, "abc"), (2, 0, "abcd"), (None, 0, "abcde"), (None, 1, "abcde")]
    df = spark.createDataFrame(rows, "request_id int, seq int, text string")
    got = {(r["request_id"], r["seq"], r["new_text"]) for r in flows.new_suffixes(df).collect()}
    assert got == {(1, 0, "a"), (1, 2, "b"), (1, 4, "c"), (2, 0, "abcd"), (None, 0, "abcde")}


def test_chats_with_text_ids_and_microseconds(spark, tmp_path):
    rows = [("My title", 0, "user", "x", "2024-01-01 01:02:03.456789"), ("20240101_010203", 0, "user", "y", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "chat_id string, turn long, role string, content string, ts string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    sources.write_sessions(df, str(tmp_path / "chats"))
    back = sources.read_sessions(spark, str(tmp_path / "chats"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_a_row_without_loss_tokens_has_no_mean(spark):
    df = spark.createDataFrame([(1, -0.5, 1), (1, -0.25, 1), (2, -0.5, 0)], "seq_id int, logp double, loss_mask int")
    got = {r.seq_id: r.logp for r in kd_logits.sequence_logps(df, ["seq_id"], per_token=True).collect()}
    assert got == {1: -0.375, 2: None}


def test_pieces_outside_the_vocabulary_keep_their_place(spark):
    seqs = spark.createDataFrame([(1, 0, "a"), (1, 1, "zz"), (1, 2, "b")], "seq int, pos int, piece string")
    vocabulary = spark.createDataFrame([("a", 3), ("b", 4)], "piece string, id long")
    for rows in (10, 1):
        got = tokens.lookup_ids(seqs, vocabulary, broadcast_rows=rows, unknown=7).orderBy("pos").collect()
        assert [r.id for r in got] == [3, 7, 4]


def test_modified_sessions(spark):
    schema = "chat_id int, turn int, role string, content string, ts string"
    now = [(1, 0, "user", "x", "t"), (2, 0, "user", "x", "t"), (3, 0, "user", "x", "t"), (4, 0, "user", None, "t")]
    then = [(1, 0, "user", "x", "t"), (2, 0, "user", "y", "t"), (4, 0, "user", None, "t"), (4, 1, "user", "z", "t")]
    out = flows.modified_sessions(spark.createDataFrame(now, schema), spark.createDataFrame(then, schema))
    assert {r.chat_id: r.modified for r in out.collect()} == {1: 0, 2: 1, 3: 1, 4: 1}


def test_chats_with_text_ids_are_listed(spark):
    ids = ["b", "a title", "a titles", "ä", "20240101_010203", "20240101_010204", ""]
    rows = [(c, 0, f"2024-01-01 00:0{i % 3}:00") for i, c in enumerate(ids)]
    df = spark.createDataFrame(rows, "chat_id string, turn long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = flows.list_sessions(df).collect()
    assert [r.chat_id for r in sorted(got, key=lambda r: r.place_by_id)] == sorted(ids, key=lambda c: c.encode(), reverse=True)
    by_time = sorted(rows, key=lambda r: (r[2], r[0].encode()), reverse=True)
    assert [r.chat_id for r in sorted(got, key=lambda r: r.place_by_time)] == [r[0] for r in by_time]


def test_the_chat_template_renders_as_the_chat_format(spark):
    kind = "id int, messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, [("user", "hi")]), (2, [("system", "s"), ("user", "hi")])], kind)
    template = conversation.TEMPLATES["chat"]
    got = df.select(conversation.render_with_template(F.col("messages"), template), conversation.render_chat(F.col("messages"))).collect()
    assert all(a == b for a, b in got)
