"""Structured Streaming forms. Sources are any streaming DataFrame (Kafka, files); the logic is shared with the batch twins."""

from __future__ import annotations

import pickle
import threading
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from echogrid import schemas
from echogrid.operators.transducer import Machine
from echogrid.session import scratch_path
from echogrid.streaming import steps


def envelope_stream(spark: SparkSession, fmt: str, options: dict[str, str], path: str | None = None, schema: str | None = None) -> DataFrame:
    """Raw envelope stream: Kafka (`subscribe`, `startingOffsets`) or a folder of files with the same JSON text."""
    reader = spark.readStream.format(fmt).options(**({"startingOffsets": "latest"} if fmt == "kafka" else {}), **options)
    if schema:
        reader = reader.schema(schema)
    raw = reader.load(path) if path else reader.load()
    return raw.selectExpr("cast(value AS string) AS value", "topic", "timestamp AS received_at") if fmt == "kafka" else raw


def parse_envelopes(raw: DataFrame, kind: str, text: str = "value") -> DataFrame:
    """Typed rows of one message kind."""
    kept = [c for c in raw.columns if c != text]
    body = F.from_json(text, schemas.BY_KIND[kind])
    return raw.withColumn("__m", body).filter(F.col("__m.kind") == kind).select(*[F.col(c) for c in kept if c not in ("device_id", "ts", "seq")], "__m.*")


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The event table, one file or a folder of parts, as a file stream with event time usable for watermarks."""
    # a file stream takes a folder or a pattern, so the one name is written as a pattern
    stream = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


#: Timers beside state need this store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_to_table(stream: DataFrame, name: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Run a stream over everything available and read its output table back; `timers` for streams with ordered machines."""
    spark = stream.sparkSession
    if timers:
        for key, value in STATE_STORE.items():
            spark.conf.set(key, value)
    path = scratch_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def dedup_stream(stream: DataFrame, delay: str, keys=("device_id", "seq", "ts")) -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def sliding_features(stream: DataFrame, delay: str | None, width: str, stride: str, aggs) -> DataFrame:
    """Sliding windows per device: `delay` sets the watermark on a stream and is left out for a batch table."""
    source = stream.withWatermark("ts", delay) if delay else stream
    out = source.groupBy(F.window("ts", width, stride).alias("w"), "device_id").agg(*aggs)
    return out.select(F.col("w.start").alias("start"), *[c for c in out.columns if c != "w"])


def sessions_stream(stream: DataFrame, delay: str, gap: str) -> DataFrame:
    out = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "device_id").agg(F.count("*").alias("rows"))
    return out.select("device_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")


def command_ack_stream(commands: DataFrame, acks: DataFrame, delay: str, timeout: str) -> DataFrame:
    """Stream-stream left outer interval join on the command id; unanswered commands appear once the watermark passes."""
    c = commands.withWatermark("ts", delay).alias("c")
    a = acks.withColumnRenamed("cmd_id", "ack_cmd").withWatermark("ack_ts", delay).alias("a")
    within = F.expr(f"cmd_id = ack_cmd AND ack_ts >= ts AND ack_ts <= ts + INTERVAL {timeout}")
    return c.join(a, within, "leftOuter").drop("ack_cmd")


#: Event time after which the state of a silent device goes: longer than every cooldown and timeout in use.
IDLE_S = 30 * 86_400


class _Rows:
    """How rows of a stream go through a machine."""

    def __init__(self, make: Callable[[], Machine], order: list[str], inputs: list[str], kept: list[str], outputs: list[str], time: str):
        self.make, self.order, self.inputs, self.kept, self.outputs, self.time = make, order, inputs, kept, outputs, time

    def restore(self, saved: bytes | None) -> Machine:
        machine = self.make()
        if saved:
            vars(machine).update(pickle.loads(saved))
        return machine

    def run(self, machine: Machine, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(self.order, kind="stable")
        out = machine.run(*[rows[c].to_numpy(dtype=float) for c in self.inputs])
        return rows[self.kept].assign(**{c: out[c] for c in self.outputs})

    def run_columns(self, machine: Machine, rows: dict[str, np.ndarray]) -> pd.DataFrame:
        """`run` for arrays: frames cost more than the few rows of a key."""
        by = np.lexsort([rows[c] for c in reversed(self.order)])
        rows = {c: v[by] for c, v in rows.items()}
        out = machine.run(*[rows[c].astype(float) for c in self.inputs])
        return pd.DataFrame({**{c: rows[c] for c in self.kept}, **{c: out[c] for c in self.outputs}}, copy=False)

    def millis(self, rows: pd.DataFrame) -> np.ndarray:
        return rows[self.time].astype("datetime64[ms]").astype("int64").to_numpy()

    def times(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.time].astype("datetime64[ms]").astype("int64")


class _OrderedProcessor(StatefulProcessor):
    """Holds rows of a key until the watermark has passed them, then runs them in order; timers wake and end a silent key."""

    def __init__(self, rows: _Rows, idle_ms: int):
        self.rows, self.idle_ms = rows, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "machine binary, waiting binary, seen bigint, wake bigint")

    def _advance(self, saved: bytes | None, waiting: dict[str, np.ndarray], seen: int, watermark: int) -> Iterator[pd.DataFrame]:
        machine, at = self.rows.restore(saved), self.rows.times(waiting)
        due = at <= watermark
        if due.any():
            yield self.rows.run_columns(machine, {c: v[due] for c, v in waiting.items()})
        rest = {c: v[~due] for c, v in waiting.items()}
        wake = max(int(at[~due].min()) + 1 if not due.all() else seen + self.idle_ms, watermark + 1)
        self.handle.registerTimer(wake)
        self.state.update((pickle.dumps(vars(machine)), pickle.dumps(rest), seen, wake))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        saved, held, seen, _ = self.state.get() or (None, None, 0, 0)
        parts = [*([pickle.loads(held)] if held else []), *[{c: f[c].to_numpy() for c in self.rows.kept} for f in rows]]
        waiting = {c: np.concatenate([p[c] for p in parts]) for c in self.rows.kept}
        yield from self._advance(saved, waiting, max(seen, int(self.rows.times(waiting).max())), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, state = timerValues.getCurrentWatermarkInMs(), self.state.get()
        if state is None:
            return
        saved, held, seen, wake = state
        if wake > watermark:  # a timer of before the last rows; the one that counts is still to come
            return
        waiting = pickle.loads(held)
        if not len(waiting[self.rows.time]) and watermark >= seen + self.idle_ms:
            self.state.clear()
            return
        yield from self._advance(saved, waiting, seen, watermark)

    def close(self) -> None:
        pass


def machine_stream(stream: DataFrame, key: str, order: list[str], inputs: list[str], make: Callable[[], Machine], outputs: str, delay: str, ordered: bool, idle_s: int, time: str = "ts") -> DataFrame:
    """The stream with a machine's outputs on every row; batches run through the machine as arrays.

    `delay` sets the watermark of `time` (made from the clock where it is missing); rows behind it do not reach the machine (see `late_split`). With `ordered`, rows wait
    until the watermark has passed them and then run in order, whatever file brought them; without, they run as they come, sorted
    inside a micro-batch. A device that is silent for `idle_s` of event time loses its state.
    """
    if time not in stream.columns:
        stream = stream.withColumn(time, F.timestamp_micros((F.col(inputs[0]) * 1e6).cast("bigint")))
    source = stream.withWatermark(time, delay)
    more = StructType.fromDDL(outputs)
    kept = [key, *[c for c in source.columns if c != key]]
    rows, idle_ms = _Rows(make, order, inputs, kept, more.fieldNames(), time), idle_s * 1000
    kind = StructType([StructField(c, source.schema[c].dataType) for c in kept] + more.fields)
    if ordered:
        return source.groupBy(key).transformWithStateInPandas(statefulProcessor=_OrderedProcessor(rows, idle_ms), outputStructType=kind, outputMode="Append", timeMode="EventTime")

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        saved, seen = state.get if state.exists else (None, 0)
        machine, fresh = rows.restore(saved), pd.concat(list(frames))
        seen = max(seen, int(rows.millis(fresh).max()))
        out = rows.run(machine, fresh)
        state.update((pickle.dumps(vars(machine)), seen))
        state.setTimeoutTimestamp(max(seen + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield out

    return source.groupBy(key).applyInPandasWithState(run, kind, "machine binary, seen bigint", "append", GroupStateTimeout.EventTimeTimeout)


def fall_vote_stream(results: DataFrame, threshold: float, cooldown_s: float, delay: str = "0 seconds", ordered: bool = False, idle_s: int = IDLE_S) -> DataFrame:
    """States per result from the running vote; `results` has device_id, seq, ts, inferred_at, proba_fall."""
    source = results.withColumn("now", F.unix_micros("inferred_at") / 1e6)
    return machine_stream(source, "device_id", ["now", "ts", "seq"], ["now", "proba_fall"], partial(steps.FallVote, threshold=threshold, cooldown_s=cooldown_s),
                          "raw int, majority int, state string, fall_count bigint, new_fall boolean", delay, ordered, idle_s)


def presence_stream(ticks: DataFrame, delay: str = "0 seconds", ordered: bool = False, idle_s: int = IDLE_S, **settings) -> DataFrame:
    """Presence status per tick; `ticks` has device_id, seq, ts, now, mv, wander."""
    return machine_stream(ticks, "device_id", ["now", "seq"], ["now", "mv", "wander"], partial(steps.Presence, **settings),
                          "mv_current double, wander_ratio double, wander_confirmed boolean, state string, last_activity_at double, just_changed boolean", delay, ordered, idle_s)


def motion_fall_stream(ticks: DataFrame, delay: str = "0 seconds", ordered: bool = False, idle_s: int = IDLE_S, **settings) -> DataFrame:
    """Motion machine per tick; `ticks` has device_id, seq, ts, now, mv."""
    return machine_stream(ticks, "device_id", ["now", "seq"], ["now", "mv"], partial(steps.MotionFall, **settings), "state string, just_triggered boolean, state_entered_at double", delay, ordered, idle_s)


def throttle_stream(reports: DataFrame, interval_s: float, delay: str = "0 seconds", ordered: bool = False, idle_s: int = IDLE_S) -> DataFrame:
    """device_id, seq, `written` per report; `reports` has device_id, seq, now, online (and ts)."""
    out = machine_stream(reports, "device_id", ["now", "seq"], ["now", "online"], partial(steps.Throttle, interval_s=interval_s), "written boolean", delay, ordered, idle_s)
    return out.select("device_id", "seq", "written")


def late_split(path: str, time: str, delay_s: float):
    """`foreachBatch` writer of two tables: `kept` and `late`, the rows more than `delay_s` behind the newest earlier batch.

    Both folders and the newest time seen are keyed by batch id and overwritten on replay, so kept and late add up to the input.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema("newest timestamp, batch bigint").parquet(f"{path}/newest").where(F.col("batch") < batch_id).agg(F.max("newest").alias("newest"))
        marked = batch.withColumn("__newest", seen.scalar())
        late = F.coalesce(F.col("__newest").cast("double") - F.col(time).cast("double") > delay_s, F.lit(False))
        marked = marked.withColumn("late", late).drop("__newest").persist()
        marked.where("not late").drop("late").write.mode("overwrite").parquet(f"{path}/kept/batch={batch_id}")
        marked.where("late").drop("late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        batch.agg(F.max(F.col(time).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")
        marked.unpersist()

    return write


def run_late_split(stream: DataFrame, time: str, delay_s: float) -> tuple[DataFrame, DataFrame]:
    """(kept, late) after running over everything available; every table exists also when no row is late."""
    spark = stream.sparkSession
    path = scratch_path(spark, "late")
    nothing = spark.createDataFrame([], stream.schema)
    for name in ("kept", "late"):
        nothing.write.parquet(f"{path}/{name}/batch=-1")
    spark.createDataFrame([], "newest timestamp").write.parquet(f"{path}/newest/batch=-1")
    stream.writeStream.foreachBatch(late_split(path, time, delay_s)).option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    kept, late = (spark.read.schema(stream.schema).parquet(f"{path}/{name}").select(*stream.columns) for name in ("kept", "late"))
    return kept, late


class Counters(StreamingQueryListener):
    """Adds up the metrics that a stream observes under `name`, by batch, so that a replayed batch counts once."""

    def __init__(self, name: str = "counters"):
        self.name, self.batches, self.done = name, {}, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and any(row.asDict().values()):
            self.batches[event.progress.batchId] = {k: v or 0 for k, v in row.asDict().items()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.done.set()

    @property
    def totals(self) -> dict[str, int]:
        return {k: sum(b[k] for b in self.batches.values()) for k in (next(iter(self.batches.values())) if self.batches else {})}


def counted(stream: DataFrame, kind: Column, reason: Column, kinds: list[str], reasons: list[str], name: str = "counters") -> DataFrame:
    """The stream, observed: forwarded and rejected rows, forwarded rows by kind, rejected rows by reason."""
    count = lambda of, alias: F.count_if(F.coalesce(of, F.lit(False))).alias(alias)
    metrics = [count(reason.isNull(), "forwarded"), count(reason.isNotNull(), "rejected")]
    metrics += [count(reason.isNull() & (kind == k), f"kind_{k}") for k in kinds] + [count(reason == r, f"reason_{r}") for r in reasons]
    return stream.observe(name, *metrics)


def run_counted(stream: DataFrame, name: str = "counters", wait_s: float = 60.0) -> dict[str, int]:
    """Totals of an observed stream after running over everything available."""
    spark, listener = stream.sparkSession, Counters(name)
    spark.streams.addListener(listener)
    try:
        path = scratch_path(spark, name)
        stream.writeStream.format("noop").option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
        if not listener.done.wait(wait_s):
            raise RuntimeError("the stream's listener was not told of its end")
    finally:
        spark.streams.removeListener(listener)
    return listener.totals


def offline_stream(reports: DataFrame, delay: str, limit_s: float) -> DataFrame:
    """Event-time timer per device: one `offline` row when a device stays silent, one `online` row when it returns."""
    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen, _ = state.get
            state.update((seen, False))
            yield pd.DataFrame({"device_id": [keys[0]], "event": ["offline"], "at": [seen + limit_s]})
            return
        seen, online = state.get if state.exists else (None, None)
        out = []
        for now in sorted(pd.concat(list(frames))["now"]):
            if seen is not None and online and now - seen >= limit_s:
                out.append(("offline", seen + limit_s))
                online = False
            if seen is not None and online is False:
                out.append(("online", now))
            seen, online = max(now, seen or now), True
        state.update((seen, online))
        state.setTimeoutTimestamp(max(int((seen + limit_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"device_id": [keys[0]] * len(out), "event": [e for e, _ in out], "at": [a for _, a in out]})

    timed = reports.withWatermark("ts", delay)
    return timed.groupBy("device_id").applyInPandasWithState(run, "device_id bigint, event string, at double", "seen double, online boolean", "append", GroupStateTimeout.EventTimeTimeout)
