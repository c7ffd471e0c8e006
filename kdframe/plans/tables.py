"""Operator inputs derived from the base tables. Everything here is a lazy plan over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kdframe.functions.vectors import doubles
from kdframe.operators.conversation import render_turns
from kdframe.operators.eval_prompts import registry_rows
from kdframe.operators.eval_reports import SUITE
from kdframe.operators.ranking import prefix_sum
from kdframe.session import fresh_path, spread
from kdframe.sources import benchmarks


def base(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def texts(spark: SparkSession, root: str) -> DataFrame:
    """Documents for work that is heavy per row, at least one partition per core."""
    return spread(base(spark, root, "documents"))


def turns(spark: SparkSession, root: str) -> DataFrame:
    return base(spark, root, "conversations")


def threads(spark: SparkSession, root: str) -> DataFrame:
    """Nested conversations: the lines of a document as turns of alternating speakers.

    Some lines are system turns (also in the middle), some come from an unknown speaker, and every
    ninth line of some documents has no value.
    """
    docs = texts(spark, root)

    def one(line: Column, i: Column) -> Column:
        speaker = (
            F.when((F.col("doc_id") + i) % 11 == 10, "system")
            .when((F.col("doc_id") + i) % 13 == 12, "tool")
            .when(i % 2 == 0, "human")
            .otherwise("gpt")
        )
        missing = (F.col("doc_id") + i) % 9 == 8
        return F.struct(speaker.alias("from"), F.when(~missing, line).alias("value"))

    return docs.select("doc_id", "source", F.transform(F.split("text", "\n"), one).alias("conversations"))


def messages(spark: SparkSession, root: str) -> DataFrame:
    """The same with role and content; every seventh document has no messages but other fields."""
    roles = F.transform(
        "conversations",
        lambda t: F.struct(
            F.when(t["from"] == "human", "user")
            .when(t["from"] == "gpt", "assistant")
            .otherwise(t["from"])
            .alias("role"),
            F.coalesce(t["value"], F.lit("")).alias("content"),
        ),
    )
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return threads(spark, root).select(
        "doc_id",
        "source",
        F.when(F.col("doc_id") % 7 == 6, empty).otherwise(roles).alias("messages"),
        F.concat(F.lit("Summarise "), "source").alias("instruction"),
        F.lit("").alias("input"),
        F.col("source").alias("output"),
    )


def alpaca(spark: SparkSession, root: str) -> DataFrame:
    docs = base(spark, root, "documents")
    return docs.select(
        "doc_id",
        "source",
        F.when(F.col("doc_id") % 17 != 16, F.concat(F.lit("Summarise source "), "source")).alias("instruction"),
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("input"),
        F.when(F.col("doc_id") % 5 != 4, F.col("lang")).alias("output"),
    )


def qa(spark: SparkSession, root: str) -> DataFrame:
    """A user turn and the assistant turn right after it, by an equi-join on (conversation, turn)."""
    all_turns = turns(spark, root)
    asked = all_turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = all_turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answered, ["conv_id", "turn"])


def preferences(spark: SparkSession, root: str) -> DataFrame:
    """Pairs from ``qa``: the rejected answer has the words of the chosen one in reverse order."""
    opening = turns(spark, root).where("turn = 0 AND role = 'system'").select("conv_id", F.col("text").alias("_sys"))
    reverse = F.array_join(F.reverse(F.split("answer", " ")), " ")
    return (
        qa(spark, root)
        .join(opening, "conv_id", "left")
        .select(
            "conv_id",
            "turn",
            F.coalesce("_sys", F.lit("")).alias("system"),
            "question",
            F.col("answer").alias("chosen"),
            reverse.alias("rejected"),
        )
    )


def fragments(spark: SparkSession, root: str) -> DataFrame:
    """Rendered turns of every conversation, with the default system turn and generation prompt."""
    return render_turns(turns(spark, root))


def _neighbours(spark: SparkSession, root: str) -> DataFrame:
    """Every vector with the next one (cyclically), as doubles."""
    vectors = base(spark, root, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("v"))
    n = vectors.agg((F.max("vec_id") + 1).alias("n")).scalar()
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    last = n - 1
    after = after.withColumn("vec_id", F.when(F.col("vec_id") < 0, last).otherwise(F.col("vec_id")))
    return vectors.join(after, "vec_id")


def logits(spark: SparkSession, root: str) -> DataFrame:
    """Teacher and student logits per (sequence, position) with the aligned label and loss mask."""
    seq = F.floor(F.col("vec_id") / 5)
    pos = (F.col("vec_id") % 5).cast("int")
    return _neighbours(spark, root).select(
        seq.alias("seq_id"),
        pos.alias("pos"),
        F.col("v").alias("teacher"),
        F.slice("w", 1, 60).alias("student"),
        F.col("label").alias("label"),
        ((pos > 0) & (pos < 4)).cast("int").alias("loss_mask"),
        F.floor(seq / 2).alias("pair_id"),
        F.when(seq % 2 == 0, "chosen").otherwise("rejected").alias("side"),
        F.floor(seq / 8).alias("batch_id"),
        F.when(F.floor(seq / 8) % 4 == 3, "eval").otherwise("train").alias("split"),
    )


def hidden_student(spark: SparkSession, root: str) -> DataFrame:
    """Four student layers of five positions."""
    return _hidden(_neighbours(spark, root), "w", 4, 7)


def hidden_teacher(spark: SparkSession, root: str) -> DataFrame:
    """Six teacher layers of five positions."""
    return _hidden(_neighbours(spark, root), "v", 6, 6)


def _hidden(vectors: DataFrame, column: str, layers: int, masked: int) -> DataFrame:
    v = F.col("vec_id")
    return vectors.select(
        F.floor(v / (5 * layers)).alias("seq_id"),
        (F.floor(v / 5) % layers).cast("int").alias("layer"),
        (v % 5).cast("int").alias("pos"),
        F.col(column).alias("h"),
        (v % masked != 0).cast("int").alias("mask"),
    )


def projection(spark: SparkSession, root: str) -> DataFrame:
    """Projection weights of the student layers, from the layers that occur in the data."""
    layers = hidden_student(spark, root).select("layer").distinct()
    return layers.select("layer", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("out_idx")).select(
        "layer",
        "out_idx",
        F.transform(
            F.sequence(F.lit(0), F.lit(63)), lambda j: ((F.col("layer") + F.col("out_idx") + j) % 7 - 3) / 64.0
        ).alias("w"),
        (F.col("out_idx") * 0.01).alias("bias"),
    )


def choices(spark: SparkSession, root: str) -> DataFrame:
    vectors = base(spark, root, "embeddings")
    texts = [F.repeat(F.lit(word), (F.col("label") % 3 + 1).cast("int")) for word in (" yes", " no way", "perhaps", "a")]
    return vectors.select(
        F.col("vec_id").alias("item_id"),
        F.slice("embedding", 1, 4).alias("logps"),
        F.array(*texts).alias("choices"),
        (F.col("label") % 4).alias("gold"),
    )


def items(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation items of three tasks, with subsets and splits."""
    doc = F.col("doc_id")
    return texts(spark, root).select(
        doc.alias("item_id"),
        F.when(doc % 3 == 0, "bbh").when(doc % 3 == 1, "math").otherwise("arc").alias("task"),
        F.col("source").alias("subset"),
        F.col("text").alias("input"),
        F.concat(F.col("lang"), F.lit(" "), F.col("n_chars").cast("string")).alias("target"),
        F.when(doc % 10 < 2, "validation").when(doc % 10 < 4, "test").otherwise("train").alias("split"),
        "lang",
        "n_chars",
    )


def suite_items(spark: SparkSession, root: str) -> DataFrame:
    """Items of all tasks of the registry, in four splits."""
    names = F.array(*[F.lit(row[0]) for row in registry_rows()])
    splits = F.array(*[F.lit(split) for split in ("test", "validation", "train", "fewshot", "train")])
    doc = F.col("doc_id")
    return texts(spark, root).select(
        doc.alias("item_id"),
        F.get(names, (doc % len(registry_rows())).cast("int")).alias("task"),
        F.get(splits, (F.floor(doc / len(registry_rows())) % 5).cast("int")).alias("split"),
        F.col("text").alias("input"),
        F.concat(F.lit("answer "), F.col("n_chars").cast("string")).alias("target"),
        "lang",
        "source",
        "n_chars",
    )


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Generation runs: every event type is a model, its events in time order are its prompts."""
    events = base(spark, root, "events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    ranked = prefix_sum(events, ["ts", "event_id"], [hour], by=["event_type"], name="prompt_idx")
    return ranked.select(
        F.col("event_type").alias("model"),
        "prompt_idx",
        F.concat(F.lit("prompt "), F.col("prompt_idx").cast("string")).alias("prompt"),
        F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("response"),
        F.col("value").alias("generation_time"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens_generated"),
    )


def benchmark_models(spark: SparkSession, root: str) -> DataFrame:
    """What is known of each model of ``runs``; models stand in the order of their first events."""
    counted = base(spark, root, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.min(F.struct("ts", "event_id")).alias("began"), F.sum(F.col("user_id") * 1000).alias("total_params")
    )
    # one row per model, so the window is small
    position = F.row_number().over(Window.orderBy("began")) - 1
    return counted.select(
        "model",
        position.cast("long").alias("position"),
        F.concat(F.lit("models/"), "model").alias("model_path"),
        "total_params",
        (F.col("total_params") * 2 / 1024**3).alias("model_size_gb"),
    )


def benchmark_file(spark: SparkSession, root: str) -> DataFrame:
    """The documents of all models, written and read back."""
    path = fresh_path(spark, "benchmark")
    benchmarks.write_benchmark(benchmarks.benchmark_documents(runs(spark, root), benchmark_models(spark, root)), path)
    return benchmarks.read_benchmark(spark, path)


def status_of(events: DataFrame) -> DataFrame:
    """Task state changes, from a batch or a stream of events."""
    state = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done")
    return events.select(
        (F.col("user_id") % 16).alias("task_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        state.otherwise("running").alias("status"),
        F.col("value").alias("score"),
    )


def trainlog_of(events: DataFrame) -> DataFrame:
    """Training log, from a batch or a stream of events; some losses are missing or not a number."""
    step = F.col("event_id")
    return events.select(
        step.alias("step"),
        F.when(step % 97 == 0, None)
        .when(step % 89 == 0, F.lit(float("nan")))
        .otherwise(F.col("value"))
        .alias("loss_xe"),
        (F.col("value") / 10).alias("loss_kd"),
        F.when(step % 300 != 0, F.least(F.lit(0.7), 0.7 * step / 1000)).alias("alpha"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def chunks(spark: SparkSession, root: str) -> DataFrame:
    """Text deltas: the words of whole documents; some are empty, and some documents stop early."""
    words = texts(spark, root).select(
        F.col("doc_id").alias("request_id"), F.posexplode(F.split("text", " ")).alias("seq", "_word")
    )
    stopped = (F.col("seq") == 30) & (F.col("request_id") % 4 == 0)
    return words.select(
        "request_id",
        F.col("seq").cast("long").alias("seq"),
        F.when(stopped, "<|endoftext|>").when(F.col("seq") == 0, F.col("_word"))
        .when(F.col("_word") == "", "").otherwise(F.concat(F.lit(" "), "_word")).alias("delta"),
        F.timestamp_micros(1_704_067_200_000_000 + F.col("seq") * 1000).alias("ts"),
    )


def emitted(spark: SparkSession, root: str) -> DataFrame:
    """Four emitted texts per document: half of it, a rejected restart for some, all of it, and more, the same or a restart."""
    docs = base(spark, root, "documents")
    half = F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    second = F.when(F.col("doc_id") % 2 == 0, F.lit("so")).otherwise(F.substr("text", F.lit(1), F.lit(2)))
    third = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" end"))).when(
        F.col("doc_id") % 3 == 1, F.col("text")
    ).otherwise(F.concat(F.lit("again "), "text"))
    return docs.select(
        F.col("doc_id").alias("request_id"), F.posexplode(F.array(half, second, F.col("text"), third)).alias("seq", "text")
    )


def sessions(spark: SparkSession, root: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return turns(spark, root).select(
        F.col("conv_id").alias("chat_id"),
        "turn",
        "role",
        F.col("text").alias("content"),
        F.timestamp_micros(
            F.unix_micros(start) + (F.col("turn") + F.col("conv_id") % 1000) * 60_000_000
        ).alias("ts"),
    )


def saved_sessions(spark: SparkSession, root: str) -> DataFrame:
    """The saved copies: even chats lack their last turn, every fifth chat was never saved."""
    current = sessions(spark, root)
    last = current.groupBy("chat_id").agg(F.max("turn").alias("_last"))
    kept = current.join(last, "chat_id").where((F.col("chat_id") % 2 == 1) | (F.col("turn") < F.col("_last")))
    return kept.where("chat_id % 5 <> 4").drop("_last")


def agent_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Agent answers: whole documents followed by calls of several kinds."""
    kind = F.col("doc_id") % 7
    tail = (
        F.when(kind == 0, '<tool_call>[{"name": "get_weather", "arguments": {"city": "Oslo"}}]</tool_call>')
        .when(kind == 1, '<tool_call>[{"name": "get_current_time", "arguments": {}},\n{"name": "fly", "arguments": {"to": "7"}}]</tool_call>')
        .when(kind == 2, '<tool_call>[{"name": "open_webbrowser"</tool_call>')
        .when(kind == 3, "<tool_call>[]</tool_call>")
        .when(kind == 4, '<tool_call>[{"name": "fly", "arguments": {"to": "8"}}]</tool_call> and <tool_call>[]</tool_call>')
        .when(kind == 5, '<tool_call>{"name": "get_weather"}</tool_call>')
        .otherwise("")
    )
    return texts(spark, root).select("doc_id", F.concat("text", tail).alias("text"))


def math_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Predicted and gold solutions: whole documents ending in boxed answers of many forms."""
    n = F.col("n_chars").cast("string")
    doc = F.col("doc_id")
    forms = [
        (r"\boxed{", n, "}"),
        (r"\boxed{x=", n, "}"),
        (r"\boxed{\frac{", n, r"}{7}} and more"),
        (r"\boxed{\frac1", n, "}"),
        (r"\fbox{7", n, "}"),
        (r"\boxed ", n, "$ tail"),
        (r"\boxed{\sqrt", n, r"\text{ cm}}"),
        (r"\boxed{1,000,", n, "}"),
        (r"\boxed{\text{a ", n, r"} units}"),
        (r"\boxed{\$", n, r" dollars, \text{and} 3^\circ}"),
        (r"no box ", n, ""),
        (r"\boxed{open ", n, ""),
    ]
    def pick(offset: int) -> Column:
        answer = F.lit(None).cast("string")
        for i, (left, middle, right) in enumerate(forms):
            answer = F.when((doc + offset) % 13 == i, F.concat(F.lit(left), middle, F.lit(right))).otherwise(answer)
        return F.concat("text", F.lit(" "), answer)

    gold = F.when(doc % 4 == 0, pick(0)).when(doc % 4 == 1, F.concat(F.lit(r"so \boxed{"), n, F.lit("}"))).otherwise(pick(1))
    return texts(spark, root).select("doc_id", "source", pick(0).alias("pred"), gold.alias("gold"))


def rewrites(spark: SparkSession, root: str) -> DataFrame:
    """Texts and a rewrite: every third word removed, the second half put first."""
    kept = F.filter(F.split("text", " "), lambda w, i: i % 3 != 2)
    texts = base(spark, root, "benchmark").withColumn("_kept", kept).withColumn("_half", F.floor(F.size("_kept") / 2).cast("int"))
    swapped = F.concat(
        F.slice("_kept", F.col("_half") + 1, F.size("_kept")), F.slice("_kept", F.lit(1), F.col("_half"))
    )
    return texts.select(
        "item_id",
        F.col("text").alias("source"),
        F.col("text").alias("reference"),
        F.array_join(swapped, " ").alias("output"),
    )


def reports(spark: SparkSession, root: str) -> DataFrame:
    """Metric reports as JSON text, one per labelled document."""
    labels = base(spark, root, "labels")
    q = F.concat(F.col("quality").cast("string"), F.lit("."), (F.col("doc_id") % 10).cast("string"))
    kind = F.col("doc_id") % 8
    text = (
        F.when(kind == 0, F.concat(F.lit('{"results": {"a": {"acc": '), q, F.lit('}, "b": {"accuracy": 9}}}')))
        .when(kind == 1, F.concat(F.lit('{"results": {"a": {"score": 3, "accuracy": '), q, F.lit("}}}")))
        .when(kind == 2, F.concat(F.lit('{"results": {"a": {"metrics": {"em": '), q, F.lit(', "score": 7}}}}')))
        .when(kind == 3, F.concat(F.lit('{"results": {"a": {"acc": "text", "pass@1": '), q, F.lit("}}}")))
        .when(kind == 4, F.lit('{"results": {"a": {"acc": '))
        .when(kind == 5, F.lit('{"results": {}}'))
        .when(kind == 6, F.lit('{"other": 1}'))
    )
    return labels.select("doc_id", "toxic", text.alias("report"))


def task_reports(spark: SparkSession, root: str) -> DataFrame:
    """One report per task of the suite: that of the task's last labelled document."""
    names = F.array(*(F.lit(name) for name, _, _ in SUITE))
    task = F.get(names, (F.col("doc_id") % 16).cast("int"))
    return reports(spark, root).groupBy(task.alias("task")).agg(F.max_by("report", "doc_id").alias("report"))
