"""Streaming forms: files arrive in drops, keyed state lives in the state store, late rows fall behind a watermark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.sources.buckets import BucketedTable
from tessera.sources.scratch import new_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Files that a drop is written as, and that a batch of the stream takes.
FILES = 4


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int = FILES) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def in_drops(df: DataFrame, drop: Column, n: int, files: int = FILES) -> str:
    """df written in n drops of so many files to one folder, by the number that drop gives, in order: what a landing folder
    would get. A drop of fewer rows than files is filled up with what comes after it."""
    path = new_path(df.sparkSession, "drops")
    for k in range(n):
        df.filter(drop == k).repartition(files).write.mode("append").parquet(path)
    return path


#: Rows of a file of a drop, about, where that makes more than FILES of them.
FILE_ROWS = 200_000


def landed(df: DataFrame, drop: Column, n: int) -> DataFrame:
    """The stream of df's n drops, a batch each. Files are as many as the largest drop's rows need, so no writer grows with the rows."""
    most = df.groupBy(drop.alias("drop")).count().agg(F.max("count")).first()[0] or 0
    files = max(FILES, -(-most // FILE_ROWS))
    return stream_of(df.sparkSession, in_drops(df, drop, n, files), df.schema, files)


#: Parts of a stream's state for each core.
STATE_PARTS = 2


def _run(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """The stream drained, its state in a few parts for each core: a part costs about half a second a batch, however few its rows.

    A query takes the session's settings when it starts; the session's own number of parts stays, and is kept where it is smaller.
    """
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    spark.conf.set(key, min(int(was), STATE_PARTS * spark.sparkContext.defaultParallelism))
    try:
        q = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, was)
    q.awaitTermination()
    return q


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that the stream gives on the files present, appended to a table and read back."""
    spark = stream.sparkSession
    path, state = new_path(spark, name), new_path(spark, f"{name}-state")
    _run(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state), spark)
    return spark.read.schema(stream.schema).parquet(path)


def drained_with_progress(stream: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """drained, and a table of its batches with input: (batch, n_rows, watermark, late).

    n_rows is what the stream's observe named landed counts; late tells whether a state operator dropped rows behind the
    watermark, which stood where watermark says when the batch began. One row a batch, of the query's own progress.
    """
    spark = stream.sparkSession
    path, state = new_path(spark, name), new_path(spark, f"{name}-state")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 10_000)
    q = _run(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state), spark)
    rows = []
    for p in q.recentProgress:
        landed = (p.observedMetrics or {}).get("landed")
        if landed is not None and landed["n"]:
            rows.append((p.batchId, landed["n"], (p.eventTime or {}).get("watermark"), any(o.numRowsDroppedByWatermark > 0 for o in p.stateOperators)))
    progress = spark.createDataFrame(rows, "batch long, n_rows long, watermark string, late boolean")
    return spark.read.schema(stream.schema).parquet(path), progress


def upserted(stream: DataFrame, keys: list[str], recency: str, name: str, created: str | None = None, mode: str = "append", path: str | None = None) -> DataFrame:
    """The stream folded into a table by upsert: each batch rewrites the buckets of its keys, and no others.

    Nothing is held in the driver; a restart from the same path goes on where it stopped, and a repeated batch changes
    nothing. With mode update the stream may aggregate: each batch then brings the groups that changed.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, name)
    schema = stream.schema

    def table(of: SparkSession) -> BucketedTable:
        return BucketedTable(of, f"{path}/rows", schema, keys)

    def fold(batch: DataFrame, epoch: int) -> None:
        table(batch.sparkSession).upsert(batch, recency, created)

    _run(stream.writeStream.foreachBatch(fold).outputMode(mode).option("checkpointLocation", f"{path}/state"), spark)
    return table(spark).read()


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, delay: str, size: str, keys: list[str]) -> DataFrame:
    """Counts by window; rows behind the watermark are dropped."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"))


def idle_sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """(key, started, ended, n) of sessions that the watermark has closed: a session ends after a gap without rows."""
    s = stream.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def daily_totals(stream: DataFrame, key: str, ts: str, amount: Column, delay: str) -> DataFrame:
    """(key, day, used): sums that grow by batch, for update mode."""
    d = stream.withWatermark(ts, delay).groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.sum(amount).alias("used"))
    return d.select(key, F.col("w.start").alias("day"), "used")


#: Groups that the keys of a stream are dealt to: a call of a processor and its state are those of a group.
GROUPS = 256
#: Bytes of rows that a task puts together before it packs them.
PACKED_BYTES = 16 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(state_group, packed): of so many bytes of rows those of each group as one value, an Arrow stream."""
    held: list[pa.RecordBatch] = []

    def pack() -> pa.RecordBatch:
        every = pa.Table.from_batches(held)
        group = every["state_group"].to_numpy()
        order = np.argsort(group, kind="stable")
        rows = every.drop_columns(["state_group"]).take(order).combine_chunks()
        groups, starts = np.unique(group[order], return_index=True)
        values = []
        for at, end in zip(starts, [*starts[1:], len(group)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows.slice(at, end - at))
            values.append(sink.getvalue().to_pybytes())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(values, pa.binary())], ["state_group", "packed"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= PACKED_BYTES:
            yield pack()
    if held:
        yield pack()


def _together(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of a call, packed or not, as one table."""
    frames = list(rows)
    if "packed" not in frames[0]:
        return pd.concat(frames)
    tables = [pa.ipc.open_stream(value).read_all() for frame in frames for value in frame["packed"]]
    return pa.concat_tables(tables).to_pandas(integer_object_nulls=True)


def keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, timers: bool = False, groups: int = GROUPS) -> DataFrame:
    """The rows that the processor makes of each key's; with timers the stream needs a watermark, which they follow.

    A call for each key costs some 10 ms, however few its rows, so keys are dealt to groups by a hash, and a processor gets the rows of a group with
    state_key, which tells its keys apart. A group's state and rows of a batch are in memory: more keys need more groups.
    Spark hands rows to a processor one by one, so they come packed by group; with timers they do not, as the watermark is told by
    a column of the rows. Of the stream only the columns that the processor reads should come here.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    dealt = stream.withColumn("state_group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")).withColumn("state_key", F.to_json(F.struct(*keys)))
    if not timers:
        dealt = dealt.mapInArrow(_packed, "state_group int, packed binary")
    return dealt.groupBy("state_group").transformWithStateInPandas(processor, schema, "Append", "EventTime" if timers else "None")


class _OfGroup(StatefulProcessor):
    """A processor whose state is a table of its group's keys, kept as one value: an Arrow stream, as values of many objects cost more than the rows."""

    #: Columns of the state and their types.
    KEPT: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", "rows binary")

    def kept(self) -> pd.DataFrame:
        if not self.state.exists():
            return pd.DataFrame({c: pd.Series([], dtype=KINDS[t]) for c, t in self.KEPT.items()})
        return pa.ipc.open_stream(self.state.get()[0]).read_all().to_pandas()

    def kept_rows(self) -> Iterator[tuple]:
        kept = self.kept()
        return zip(*[kept[c].tolist() for c in self.KEPT], strict=True)

    def keep(self, table: pd.DataFrame) -> None:
        rows = pa.Table.from_pandas(table[list(self.KEPT)], pa.schema([(c, ARROW[t]) for c, t in self.KEPT.items()]), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        self.state.update((sink.getvalue().to_pybytes(),))

    def close(self) -> None:
        pass


#: What a column of the state is in pandas, and in Arrow.
KINDS = {"string": object, "double": "float64", "int": "int64", "bigint": "int64", "array<bigint>": object}
ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}


def _in_order(kept: pd.DataFrame, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """What is kept of the keys, in its order, before the rows of the batch, by time and event; old tells which is which."""
    new = _together(rows).sort_values(["ts", "event_id"], kind="stable")
    # What is not kept is filled with some value of the column, so that whole numbers stay such.
    filled = {c: new[c].iloc[0] for c in new.columns if c not in kept}
    every = pd.concat([kept.assign(**filled, old=True), new.assign(old=False)], ignore_index=True) if len(kept) else new.assign(old=False)
    return every.sort_values("state_key", kind="stable", ignore_index=True)


def _active(every: pd.DataFrame, high: float, low: float, k: int, least: int) -> pd.DataFrame:
    """every with voice and active: a voice holds between the two thresholds, and least of a key's last k make it active."""
    voice = np.where(every["value"] >= high, 1.0, np.where(every["value"] <= low, 0.0, np.nan))
    if "voice" in every:
        voice = np.where(every["old"], every["voice"], voice)
    every["voice"] = pd.Series(voice, index=every.index).groupby(every["state_key"]).ffill().fillna(0).astype("int64")
    by_key = every.groupby("state_key")["voice"]
    every["active"] = sum(by_key.shift(j).fillna(0) for j in range(k)) >= least
    return every


class RepeatedHigh(_OfGroup):
    """Of each key's readings those at which the last three are all above the target: event_id, user_id, event_type."""

    KEPT = {"state_key": "string", "value": "double"}

    def __init__(self, target: float):
        self.target = target

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = _in_order(self.kept(), rows)
        by_key = every.groupby("state_key")
        low = np.fmin(every["value"], np.fmin(by_key["value"].shift(1), by_key["value"].shift(2)))
        out = every[~every["old"] & (by_key.cumcount() >= 2) & (low > self.target)]
        self.keep(by_key.tail(2))
        yield out[["event_id", "user_id", "event_type"]]


class Activity(_OfGroup):
    """Two-threshold activity with hold over each user's rows: event_id, voice, active."""

    KEPT = {"state_key": "string", "voice": "bigint"}

    def __init__(self, high: float, low: float, k: int, least: int):
        self.high, self.low, self.k, self.least = high, low, k, least

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = _active(_in_order(self.kept(), rows), self.high, self.low, self.k, self.least)
        self.keep(every.groupby("state_key").tail(self.k))
        yield every.loc[~every["old"], ["event_id", "voice", "active"]]


class Segments(_OfGroup):
    """Segments of activity as Activity finds it: user_id, segment, started, ended, n, each once it has ended.

    A segment ends when gap seconds have passed without an active row: a timer under event time tells it as soon as the
    watermark has gone by, without a further row of the user, and not before, though a later row may have come. Seconds
    are whole.
    """

    KEPT = {"state_key": "string", "voice": "bigint"}
    OPEN = {"state_key": "string", "user_id": "bigint", "segment": "bigint", "started": "bigint", "ended": "bigint", "n": "bigint", "told": "bigint"}

    def __init__(self, high: float, low: float, k: int, least: int, gap: int):
        self.high, self.low, self.k, self.least, self.gap = high, low, k, least, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # Of each user the last segment, told or not, and those before it that are not told yet.
        self.open = handle.getValueState("open", ", ".join(f"{c} array<{t}>" for c, t in self.OPEN.items()))
        self.timer = handle.getValueState("timer", "at bigint")

    def _segments(self) -> pd.DataFrame:
        values = self.open.get() if self.open.exists() else [[] for _ in self.OPEN]
        return pd.DataFrame({c: pd.Series(list(v), dtype=object if c == "user_id" else KINDS[t]) for (c, t), v in zip(self.OPEN.items(), values, strict=True)})

    def _told(self, segments: pd.DataFrame, watermark: int) -> pd.DataFrame:
        """The segments that the watermark has passed and that were not told; the state and the timer are set for the rest."""
        at = (segments["ended"] + self.gap + 1) * 1000
        now = (segments["told"] == 0) & (at <= watermark)
        segments["told"] = segments["told"].where(~now, 1)
        last = segments["segment"] == segments.groupby("state_key")["segment"].transform("max")
        self.open.update(tuple(segments.loc[last | (segments["told"] == 0), c].tolist() for c in self.OPEN))
        waits = at[segments["told"] == 0]
        due = int(waits.min()) if len(waits) else -1
        was = self.timer.get()[0] if self.timer.exists() else -1
        if due != was:
            if was > watermark:
                self.handle.deleteTimer(was)
            if due >= 0:
                self.handle.registerTimer(due)
            self.timer.update((due,))
        return segments.loc[now, ["user_id", "segment", "started", "ended", "n"]]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = _active(_in_order(self.kept(), rows), self.high, self.low, self.k, self.least)
        self.keep(every.groupby("state_key").tail(self.k))
        new = every[~every["old"] & every["active"]][["state_key", "user_id", "ts"]]
        users = pd.Series([None if pd.isna(u) else int(u) for u in new["user_id"]], new.index, dtype=object)
        new = new.assign(at=np.array([t.timestamp() // 1 for t in new["ts"]], np.int64), user_id=users)
        segments = self._segments()
        last = segments.loc[segments.groupby("state_key")["segment"].idxmax()].set_index("state_key") if len(segments) else segments.set_index("state_key")
        before = new.groupby("state_key")["at"].shift(1)
        before = before.fillna(new["state_key"].map(last["ended"]))
        starts = (before.isna() | (new["at"] - before > self.gap)).astype("int64")
        number = starts.groupby(new["state_key"]).cumsum() + new["state_key"].map(last["segment"]).fillna(0).astype("int64")
        found = new.assign(segment=number, n=1, told=0).groupby(["state_key", "segment"], as_index=False).agg(
            user_id=("user_id", "first"), started=("at", "min"), ended=("at", "max"), n=("n", "sum"), told=("told", "min"))
        merged = pd.concat([segments, found[list(self.OPEN)]], ignore_index=True).groupby(["state_key", "segment"], as_index=False).agg(
            user_id=("user_id", "first"), started=("started", "min"), ended=("ended", "max"), n=("n", "sum"), told=("told", "max"))
        yield self._told(merged[list(self.OPEN)], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._told(self._segments(), timerValues.getCurrentWatermarkInMs())


class Compaction(_OfGroup):
    """Emits the older turns of a conversation whenever more than trigger are held, and keeps the last: conv_id, batch, first_turn, last_turn."""

    KEPT = {"state_key": "string", "turns": "array<bigint>", "batches": "int"}

    def __init__(self, trigger: int, keep: int):
        self.trigger, self.most = trigger, keep

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = {k: (list(t), b) for k, t, b in self.kept_rows()}
        out = []
        for name, of_key in _together(rows).sort_values("turn").groupby("state_key"):
            held, batches = state.get(name, ([], 0))
            conv = of_key["conv_id"].iloc[0]
            for turn in of_key["turn"].tolist():
                held.append(turn)
                if len(held) > self.trigger:
                    out.append((conv, batches, held[0], held[-self.most - 1]))
                    held, batches = held[-self.most :], batches + 1
            state[name] = held, batches
        self.keep(pd.DataFrame({"state_key": list(state), "turns": [t for t, _ in state.values()], "batches": [b for _, b in state.values()]}))
        yield pd.DataFrame(out, columns=["conv_id", "batch", "first_turn", "last_turn"])


class Sentences(_OfGroup):
    """Joins text fragments and emits sentences: the first ends at any pause mark, later ones at sentence marks; last flushes."""

    KEPT = {"state_key": "string", "text": "string", "emitted": "int"}
    PAUSE, STOP = "，,、。.！!？?；;：:\n", "。.！!？?；;\n"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pause, stop = re.compile(f"[{self.PAUSE}]"), re.compile(f"[{self.STOP}]")
        state = {k: (t, n) for k, t, n in self.kept_rows()}
        out = []
        new = _together(rows).sort_values(["state_key", "no"], kind="stable", ignore_index=True)
        # Fragments up to a last one are read as one text: they lie together now.
        names, last, fragments = new["state_key"].tolist(), new["last"].to_numpy(bool), new["fragment"].tolist()
        convs, turns = new["conv_id"].tolist(), new["turn"].tolist()
        ends = np.flatnonzero(last | np.append(new["state_key"].to_numpy()[1:] != new["state_key"].to_numpy()[:-1], True)) + 1
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            name, conv, turn = names[begin], convs[begin], turns[begin]
            held, emitted = state.get(name, ("", 0))
            text, at = held + "".join(fragments[begin:end]), 0
            while mark := (stop if emitted else pause).search(text, at):
                if said := text[at : mark.end()].strip():
                    out.append((conv, turn, emitted, said))
                    emitted += 1
                at = mark.end()
            text = text[at:]
            if last[end - 1] and text.strip():
                out.append((conv, turn, emitted, text.strip()))
                text, emitted = "", emitted + 1
            state[name] = text, emitted
        self.keep(pd.DataFrame({"state_key": list(state), "text": [t for t, _ in state.values()], "emitted": [n for _, n in state.values()]}))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "sentence_no", "sentence"])
