"""Incremental flows: training probe, live task table, text assembly, sessions, training health."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kdframe.operators.eval_reports import latest_state
from kdframe.operators.ranking import prefix_sums, range_bucket, range_rank
from kdframe.session import fresh_path, materialize
from kdframe.sources.tables import read_snapshot, write_snapshot

# tasks receive the helpers of this module by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: deltas that end a generated text
STOPS = ("<end_action>", "<|endoftext|>")
PROBE_EVERY = 100
PART_CHUNKS = 4096
IDLE = "1 hour"
FOLDED_ROWS = 64
RUN_MICROS = 1_000_000
BUCKETS = 4096


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the parquet files called ``name`` (a glob) in ``folder``."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available into a table on shared storage, and read it back."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# ---- training probe -------------------------------------------------------------------------


def _shown(name: str, pattern: str) -> Column:
    return F.when(F.col(name).isNull(), "N/A").otherwise(F.format_string(pattern, F.col(name)))


def training_probe(log: DataFrame) -> DataFrame:
    """Lines shown at step 1 and at every hundredth step; missing values read ``N/A``."""
    due = log.where((F.col("step") == 1) | (F.col("step") % PROBE_EVERY == 0))
    return due.select(
        "step",
        _shown("loss_kd", "%.4f").alias("kd"),
        _shown("loss_xe", "%.4f").alias("ce"),
        _shown("alpha", "%.3f").alias("alpha"),
    )


# ---- live task table ------------------------------------------------------------------------


def follow_tasks(updates: DataFrame, root: str, checkpoint: str, time: str = "ts") -> None:
    """Keep the latest state of every task as versioned snapshots below ``root``.

    Every micro-batch reduces its own updates to one row per task, merges them with the newest
    version and writes the next one. Re-running a batch rewrites the same version.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = batch
        if batch_id > 0:
            changed = changed.unionByName(read_snapshot(spark, root, below=batch_id))
        write_snapshot(latest_state(changed, time=time), root, batch_id)

    (
        updates.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


# ---- text from deltas -----------------------------------------------------------------------


def growing_prefix(chunks: DataFrame) -> DataFrame:
    """Length of the text after every delta that counts: not empty, and before the first stop.

    The prefix shown after a delta is that many characters of the final text, so the growing text
    is described without writing it out once per delta.
    """
    stop = F.col("delta").isin(*STOPS)
    sums = {"_before": F.length("delta"), "_stops": stop.cast("int")}
    summed = prefix_sums(chunks, ["seq"], [range_bucket(F.col("seq"), PART_CHUNKS)], sums, by=["request_id"])
    kept = summed.where((F.col("_stops") == 0) & ~stop & (F.length("delta") > 0))
    return kept.select("request_id", "seq", (F.col("_before") + F.length("delta")).alias("prefix_chars"))


def delta_runs(chunks: DataFrame) -> DataFrame:
    """Deltas put together where they lie in line in the input: (request_id, first, text, ends, stopped).

    A run has deltas of one request and part, each with the ``seq`` after the last one's; a stop delta ends it and has no
    text. ``ends`` is where each delta ends in the text.
    """
    rows = chunks.select("request_id", F.col("seq").cast("long").alias("seq"), "delta")
    border = PART_CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            request, seq, delta = batch.columns
            stop = pc.fill_null(pc.is_in(delta, value_set=pa.array(STOPS, delta.type)), False)
            text = pc.if_else(stop, "", pc.fill_null(delta, ""))
            stop = stop.to_numpy(zero_copy_only=False)
            at, given = pc.fill_null(seq, 0).to_numpy(), seq.is_valid().to_numpy(zero_copy_only=False)
            new = ~given | (at % border == 0)
            new[0] = True
            other = pc.fill_null(pc.not_equal(request[1:], request[:-1]), True).to_numpy(zero_copy_only=False)
            new[1:] |= other | (at[1:] != at[:-1] + 1) | ~given[:-1] | stop[:-1]
            starts = np.flatnonzero(new)
            edges = np.append(starts, len(batch)).astype(np.int32)
            size = pc.utf8_length(text).to_numpy().astype(np.int32)
            ends = np.cumsum(size)
            ends = ends - np.repeat(ends[starts] - size[starts], np.diff(edges))
            columns = [
                request.take(pa.array(starts)),
                seq.take(pa.array(starts)),
                pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), text), ""),
                pa.ListArray.from_arrays(pa.array(edges), pa.array(ends.astype(np.int32))),
                pa.array(stop[edges[1:] - 1]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["request_id", "first", "text", "ends", "stopped"])

    kind = rows.schema["request_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"request_id {kind}, first long, text string, ends array<int>, stopped boolean")


def final_text(chunks: DataFrame) -> DataFrame:
    """The assembled text of every request, put together in runs, parts and then from parts.

    Each part ends at its first stop delta, and the text ends with the first part that has one.
    Requests with no text at all are left out. Where runs of a part overlap, as deltas are sent twice or lie in another
    order, they are taken apart again.
    """

    def joined(parts: Column) -> Column:
        """Concatenate up to and including the first stopped part."""
        first = F.array_position(F.transform(parts, lambda p: p["stopped"]), True).cast("int")
        upto = F.when(first > 0, F.slice(parts, F.lit(1), first)).otherwise(parts)
        return F.array_join(F.transform(upto, lambda p: p["text"]), "")

    def deltas(run: Column) -> Column:
        def one(end: Column, i: Column) -> Column:
            start = F.when(i > 0, F.get(run["ends"], i - 1)).otherwise(0)
            stopped = run["stopped"] & (i == F.size(run["ends"]) - 1)
            return F.struct((run["first"] + i).alias("seq"), F.substr(run["text"], start + 1, end - start).alias("text"), stopped.alias("stopped"))

        return F.transform(run["ends"], one)

    runs = F.col("_runs")
    behind = F.zip_with(
        F.slice(runs, F.lit(1), F.size(runs) - 1),
        F.slice(runs, F.lit(2), F.size(runs) - 1),
        lambda a, b: F.coalesce(a["first"] + F.size(a["ends"]) <= b["first"], F.lit(False)),
    )
    apart = F.forall(behind, lambda x: x)
    text = F.when(apart, joined(runs)).otherwise(joined(F.sort_array(F.flatten(F.transform(runs, deltas)))))
    parts = (
        delta_runs(chunks)
        .groupBy("request_id", F.floor(F.col("first") / PART_CHUNKS).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("first", "text", "stopped", "ends"))).alias("_runs"))
        .select("request_id", F.struct("part", text.alias("text"), F.exists(runs, lambda r: r["stopped"]).alias("stopped")).alias("_part"))
    )
    whole = parts.groupBy("request_id").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    return whole.select("request_id", joined(F.col("_parts")).alias("text")).where(F.length("text") > 0)


ASSEMBLED = "request_id long, last_seq long, new_text string, prefix_chars long, done boolean, late boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrived_runs(chunks: DataFrame) -> DataFrame:
    """Deltas put together as they arrive: (request, first, text, ends, at, ts), so that few rows reach the state.

    A run has deltas of one request, in line by ``seq`` and of one second; a stop delta and one without a text are runs
    of their own. ``ends`` is where each delta ends in the text, ``ts`` the newest time and ``at`` its milliseconds.
    A delta without a ``seq`` counts as one before the first. Deltas of an Arrow batch need not lie in order.
    """
    rows = chunks.select(F.col("request_id").cast("long"), F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"), "delta", "ts")
    names = ["request", "first", "text", "ends", "at", "ts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            owner = pc.fill_null(batch.column(0).dictionary_encode().indices, -1).to_numpy()
            at = batch.column(1).to_numpy()
            if np.any((owner[1:] < owner[:-1]) | ((owner[1:] == owner[:-1]) & (at[1:] < at[:-1]))):
                order = np.lexsort((at, owner))  # equal ones stay as they came
                batch, owner, at = batch.take(pa.array(order)), owner[order], at[order]
            request, seq, delta, ts = batch.columns
            timed = ts.is_valid().to_numpy(zero_copy_only=False)
            time = pc.fill_null(ts.cast(pa.int64()), -1).to_numpy()
            alone = pc.fill_null(pc.is_in(delta, value_set=pa.array(STOPS, delta.type)), False)
            alone = pc.or_(alone, delta.is_null()).to_numpy(zero_copy_only=False)
            new = np.ones(len(batch), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1) | alone[1:] | alone[:-1]
            new[1:] |= (time[1:] // RUN_MICROS != time[:-1] // RUN_MICROS) | (timed[1:] != timed[:-1])
            starts = np.flatnonzero(new)
            edges = np.append(starts, len(batch)).astype(np.int32)
            size = pc.fill_null(pc.utf8_length(delta), 0).to_numpy().astype(np.int32)
            ends = np.cumsum(size)
            ends = (ends - np.repeat(ends[starts] - size[starts], np.diff(edges))).astype(np.int32)
            newest = np.maximum.reduceat(time, starts)
            columns = [
                request.take(pa.array(starts)).cast(pa.string()),
                seq.take(pa.array(starts)),
                pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), delta), ""),
                pa.ListArray.from_arrays(pa.array(edges), pa.array(ends)),
                pa.array(newest // 1000),
                pa.array(newest, mask=~timed[starts]).cast(ts.type),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["ts"].dataType.simpleString()
    return rows.mapInArrow(run, f"request string, first long, text string, ends array<int>, at long, ts {kind}")


def _deltas(runs: list[tuple]) -> Iterator[tuple[int, str | None]]:
    """The deltas of runs with their ``seq``, as they came."""
    for first, text, ends in runs:
        start = 0
        for i, end in enumerate(ends):
            yield first + i, None if text is None else text[start:end]
            start = end


def _frame(rows: list[tuple]) -> pd.DataFrame:
    request, last_seq, new_text, chars, done, late = map(list, zip(*rows))
    columns = {"request_id": pd.array(request, dtype="Int64"), "last_seq": last_seq, "new_text": new_text}
    return pd.DataFrame(columns | {"prefix_chars": pd.array(chars, dtype="Int64"), "done": done, "late": late})


class Assembly(StatefulProcessor):
    """The readable text of one request.

    ``progress`` is a few numbers, ``waiting`` a map of deltas that came early: a delta that is next in
    line never touches it, and one that fills a gap reads only what follows. A timer of event time
    evicts an idle request: what still waits is given out, the map is emptied and a mark stays, so that
    deltas that come after that are told apart as late.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "next_seq long, chars long, done boolean, evicted boolean")
        self.waiting = handle.getMapState("waiting", "seq long", "delta string")
        self.due = handle.getValueState("due", "at long")

    def _remind(self, latest: int, known: bool) -> None:
        if known and self.due.exists():
            (before,) = self.due.get()
            if before >= latest + self.idle_ms:
                return
            self.handle.deleteTimer(before)
        self.due.update((latest + self.idle_ms,))
        self.handle.registerTimer(latest + self.idle_ms)

    def take(self, runs: list[tuple], latest: int) -> list[tuple]:
        """Rows (last_seq, new_text, prefix_chars, done, late) for runs (first, text, ends) up to the time ``latest``."""
        # of a request that is new nothing waits and nothing is due: that is not asked for
        known = self.progress.exists()
        next_seq, chars, done, evicted = self.progress.get() if known else (0, 0, False, False)
        if evicted or done:
            # after a stop nothing counts; after eviction a delta is told as late, at its place
            late = {seq: delta for seq, delta in _deltas(runs) if seq >= next_seq} if evicted else {}
            return [(seq, late[seq], None, True, True) for seq in sorted(late)]
        text: list[str] = []
        fresh: dict[int, str | None] = {}
        in_line = sorted(runs, key=lambda run: run[0])
        if all(run[0] == before for run, before in zip(in_line, accumulate((len(r[2]) for r in in_line), initial=next_seq))):
            # all come in line, as they mostly do: up to a stop they are taken at once
            for _, part, ends in in_line:
                next_seq += len(ends)
                done = len(ends) == 1 and part in STOPS
                if done:
                    break
                text.append(part or "")
        else:
            # a delta that is sent again after it was given out is dropped
            fresh.update((seq, delta) for seq, delta in _deltas(runs) if seq >= next_seq)
        while not done:
            if next_seq in fresh:
                delta = fresh.pop(next_seq)
            elif known and self.waiting.containsKey((next_seq,)):
                (delta,) = self.waiting.getValue((next_seq,))
                self.waiting.removeKey((next_seq,))
            else:
                break
            next_seq += 1
            done = delta in STOPS
            text += [] if done else [delta or ""]
        joined = "".join(text)
        chars += len(joined)
        if not done:
            for seq, delta in fresh.items():
                self.waiting.updateValue((seq,), (delta,))
            self._remind(latest, known)
        elif known:
            self.waiting.clear()
        self.progress.update((next_seq, chars, done, False))
        return [(next_seq - 1, joined, chars, done, False)] if joined or done else []

    def evict(self) -> list[tuple]:
        """Rows, as of ``take``, for what the request still holds when its time is up."""
        next_seq, chars, done, evicted = self.progress.get()
        self.due.clear()
        if done or evicted:
            return []
        text = []
        for (seq,), (delta,) in sorted(self.waiting.iterator()):
            next_seq = seq + 1
            if delta in STOPS:
                break
            text.append(delta or "")
        self.waiting.clear()
        joined = "".join(text)
        self.progress.update((next_seq, chars + len(joined), False, True))
        return [(next_seq - 1, joined, chars + len(joined), True, False)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        runs: list[tuple] = []
        latest = 0
        for batch in rows:
            latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
            runs += [(seq, delta, (len(delta or ""),)) for seq, delta in zip(batch["seq"].tolist(), batch["delta"].tolist())]
        if found := self.take(runs, latest):
            yield _frame([(key[0], *row) for row in found])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if found := self.evict():
            yield _frame([(key[0], *row) for row in found])

    def close(self) -> None:
        pass


class HeldValue:
    """A value of one request while its bucket works on it."""

    def __init__(self, value: tuple | None):
        self.value = value

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value

    def clear(self) -> None:
        self.value = None


class HeldWaiting:
    """The waiting deltas of one request, in the map of its bucket; ``count`` of none saves asking for them."""

    def __init__(self, bucket: Assemblies, request: str | None, count: int, found: list[tuple] = ()):
        self.bucket, self.request, self.count, self.found = bucket, request, count, found

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        return self.count > 0 and self.bucket.waiting.containsKey((self.request, *key))

    def getValue(self, key: tuple) -> tuple:  # noqa: N802
        return self.bucket.waiting.getValue((self.request, *key))

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        self.bucket.waiting.removeKey((self.request, *key))
        self.count -= 1

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self.count += not self.containsKey(key)
        self.bucket.waiting.updateValue((self.request, *key), value)

    def iterator(self) -> Iterator[tuple]:
        return iter(self.found)

    def clear(self) -> None:
        if self.count:
            self.bucket.left.add(self.request)
            self.count = 0


class Held:
    """The handle that ``Assembly`` sees: the states of one request out of those of its bucket."""

    def __init__(self, progress: tuple | None, due: int | None, waiting: HeldWaiting):
        self.states = {"progress": HeldValue(progress), "due": HeldValue(None if due is None else (due,)), "waiting": waiting}

    def getValueState(self, name: str, schema: str) -> HeldValue:  # noqa: N802
        return self.states[name]

    def getMapState(self, name: str, key: str, value: str) -> HeldWaiting:  # noqa: N802
        return self.states[name]

    def registerTimer(self, at: int) -> None:  # noqa: N802
        """The bucket keeps the timer: what is due is in ``due``."""

    deleteTimer = registerTimer  # noqa: N815


class Assemblies(StatefulProcessor):
    """The readable texts of the requests of one bucket, each by ``Assembly``.

    A call of the processor takes milliseconds and so do the questions to its state, so the requests of a bucket share
    both. ``open`` and ``closed`` are the progress of each request, ``waiting`` the early deltas of all. One timer, in
    ``clock`` (0 for none), wakes the bucket at the time its first open request is due, or before that.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "request string", "next_seq long, chars long, due long, early long")
        self.closed = handle.getMapState("closed", "request string", "next_seq long, chars long, done boolean, evicted boolean")
        self.waiting = handle.getMapState("waiting", "request string, seq long", "delta string")
        self.clock = handle.getValueState("clock", "at long")
        self.left: set[str | None] = set()

    def _work(self, held: Held) -> Assembly:
        request = Assembly(self.idle_ms)
        request.init(held)
        return request

    def _held(self, request: str | None, known: bool) -> tuple[Held, bool]:
        """What is held of a request, and whether it is open in the state."""
        if known and (row := self.open.getValue((request,))):
            next_seq, chars, due, early = row
            return Held((next_seq, chars, False, False), due, HeldWaiting(self, request, early)), True
        row = self.closed.getValue((request,)) if known else None
        return Held(row and tuple(row), None, HeldWaiting(self, request, 0)), False

    def _keep(self, request: str | None, work: Assembly, opened: bool) -> None:
        next_seq, chars, done, evicted = work.progress.get()
        if done or evicted:
            self.closed.updateValue((request,), (next_seq, chars, done, evicted))
            if opened:
                self.open.removeKey((request,))
        else:
            (due,) = work.due.get()
            self.open.updateValue((request,), (next_seq, chars, due, work.waiting.count))

    def _sweep(self) -> None:
        """Remove the waiting deltas of requests that are closed."""
        if self.left:
            for key in [key for key in self.waiting.keys() if key[0] in self.left]:
                self.waiting.removeKey(key)
            self.left.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        runs: dict[str | None, list[tuple]] = {}
        latest: dict[str | None, int] = {}
        for batch in rows:
            for request, first, text, ends, at in zip(*(batch[c].tolist() for c in ("request", "first", "text", "ends", "at"))):
                runs.setdefault(request, []).append((first, text, ends))
                latest[request] = max(latest.get(request, 0), at)
        known = self.clock.exists()
        found, dues = [], []
        for request, arrived in runs.items():
            held, opened = self._held(request, known)
            work = self._work(held)
            before = work.progress.get()
            rest = work.take(arrived, latest[request])
            found += [(None if request is None else int(request), *row) for row in rest]
            if work.progress.get() is not before:
                self._keep(request, work, opened)
                if not work.progress.get()[2]:
                    dues += work.due.get()
        self._sweep()
        set_to = self.clock.get()[0] if known else 0
        due = min(dues, default=0)
        if due and (not set_to or due < set_to):
            if set_to:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(due)
            self.clock.update((due,))
        elif not known:
            self.clock.update((0,))
        if found:
            yield _frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        idle, first = {}, 0
        for (request,), (next_seq, chars, due, early) in self.open.iterator():
            if due < watermark or due <= fired:
                idle[request] = (next_seq, chars, due, early)
            else:
                first = min(first or due, due)
        waiting: dict[str | None, list[tuple]] = {request: [] for request, state in idle.items() if state[3]}
        if waiting:
            for (request, seq), delta in self.waiting.iterator():
                if request in waiting:
                    waiting[request].append(((seq,), delta))
        found = []
        for request, (next_seq, chars, due, early) in idle.items():
            work = self._work(Held((next_seq, chars, False, False), due, HeldWaiting(self, request, early, waiting.get(request, []))))
            found += [(None if request is None else int(request), *row) for row in work.evict()]
            self._keep(request, work, True)
        self._sweep()
        if first:
            self.handle.registerTimer(first)
        self.clock.update((first,))
        if found:
            yield _frame(found)

    def close(self) -> None:
        pass


def assemble_stream(chunks: DataFrame, idle: str = IDLE, late: str = IDLE) -> DataFrame:
    """Newly readable text of every request per micro-batch.

    Deltas may arrive out of order: early ones wait in the state by ``seq``, and only the
    contiguous text is given out; one that is sent again is dropped. A request that is idle for
    ``idle`` of event time is evicted, and what it still holds is given out then. A delta that comes
    after that is a row marked ``late``, with its own ``seq`` and text: a request never starts again.
    The engine drops rows more than ``late`` behind the newest before they get here; deltas that arrive in line within
    a second are kept if one of them is.
    """
    idle_ms = int(pd.Timedelta(idle) / pd.Timedelta(milliseconds=1))
    # this state needs the store that has maps and timers
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        arrived_runs(chunks)
        .withWatermark("ts", late)
        .withColumn("bucket", F.pmod(F.hash("request"), F.lit(BUCKETS)))
        .groupBy("bucket")
        .transformWithStateInPandas(Assemblies(idle_ms), ASSEMBLED, "append", "EventTime")
    )


def assemble_into(chunks: DataFrame, texts: str, late_deltas: str, checkpoint: str, **options) -> None:
    """``assemble_stream`` into two tables: the texts, and what came after a request was evicted.

    Each micro-batch has a folder of its own in both, so that a batch that runs again replaces its rows.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        stored = materialize(batch)  # a micro-batch must be worked out once
        kept = stored.where("not late").drop("late")
        kept.write.mode("overwrite").parquet(f"{texts}/batch={batch_id}")
        side = stored.where("late").select("request_id", F.col("last_seq").alias("seq"), F.col("new_text").alias("delta"))
        side.write.mode("overwrite").parquet(f"{late_deltas}/batch={batch_id}")

    (
        assemble_stream(chunks, **options)
        .writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def new_suffixes(texts: DataFrame) -> DataFrame:
    """What each text adds to the last accepted one; a text that does not extend that is not accepted.

    The texts of a request stream past in order, one at a time, and only the last accepted one is
    held: memory doesn't grow with the number of texts of a request.
    """
    rows = texts.select("request_id", "seq", "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, last, started = None, "", False
        for batch in batches:
            # few rows at a time, as a text may be long
            for at in range(0, len(batch), FOLDED_ROWS):
                part = batch.slice(at, FOLDED_ROWS)
                chosen, added = [], []
                for i in range(len(part)):
                    request, text = part.column(0)[i].as_py(), part.column(2)[i].as_py()
                    if not started or request != owner:
                        owner, last, started = request, "", True
                    if text is not None and text.startswith(last):
                        if len(text) > len(last):
                            chosen.append(i)
                            added.append(text[len(last) :])
                        last = text
                columns = part.take(pa.array(chosen, pa.int32())).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(added, pa.string())], names=["request_id", "seq", "text", "new_text"])

    ordered = rows.repartition("request_id").sortWithinPartitions("request_id", "seq", "text")
    return ordered.mapInArrow(fold, f"{kinds}, new_text string")


# ---- sessions -------------------------------------------------------------------------------


def modified_sessions(current: DataFrame, saved: DataFrame, chat: str = "chat_id") -> DataFrame:
    """Whether each open chat differs from its saved copy; an unsaved chat with messages does.

    Messages are compared one by one on ``(chat, turn)``, so no session is gathered.
    """
    fields = ("role", "content", "ts")
    left = current.select(chat, "turn", F.struct(*fields).alias("_now"))
    right = saved.select(chat, "turn", F.struct(*fields).alias("_then"))
    changed = ~F.col("_now").eqNullSafe(F.col("_then"))
    return (
        left.join(right, [chat, "turn"], "full")
        .groupBy(chat)
        .agg(F.max(changed.cast("int")).alias("modified"))
    )


def list_sessions(messages: DataFrame, chat: str = "chat_id") -> DataFrame:
    """Saved chats with their place by falling id and by falling last message time.

    Ids are numbers, or texts such as titles. However ids and times are distributed, their sampled
    ranges are of about equal size.
    """
    chats = messages.groupBy(chat).agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("messages"))
    by_id = range_rank(chats, [F.col(chat).desc()], "place_by_id")
    return range_rank(by_id, [F.col("last_ts").desc(), F.col(chat).desc()], "place_by_time")


# ---- training health ------------------------------------------------------------------------


def windowed_health(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean losses per time window; rows later than the watermark are dropped by the engine."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", window))
        .agg(
            F.count(F.lit(1)).alias("steps"),
            F.avg("loss_kd").alias("mean_kd"),
            F.avg(F.when(~F.isnan("loss_xe"), F.col("loss_xe"))).alias("mean_xe"),
        )
        .select(F.col("window.start").alias("start"), "steps", "mean_kd", "mean_xe")
    )


def stepped_health(log: DataFrame, steps: int) -> DataFrame:
    """Mean losses per block of training steps."""
    return log.groupBy(F.floor(F.col("step") / steps).alias("block")).agg(
        F.count(F.lit(1)).alias("steps"),
        F.avg("loss_kd").alias("mean_kd"),
        F.avg(F.when(~F.isnan("loss_xe"), F.col("loss_xe"))).alias("mean_xe"),
    )
