"""Streams over many files in shuffled order inside the watermark must equal the batch result."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.session import scratch_path
from echogrid.streaming import state, streams

SCHEMA = "device_id long, seq long, ts timestamp, proba_fall double"


@pytest.fixture(scope="module")
def results(spark):
    rng = np.random.default_rng(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(d, k, t0 + dt.timedelta(seconds=int(s)), float(rng.random())) for d in (1, 2, 3) for k, s in enumerate(np.cumsum(rng.integers(1, 5, 90)))]
    return spark.createDataFrame(rows, SCHEMA)


def _folder(spark, df, parts):
    path = scratch_path(spark, "in")
    for k in range(parts):
        df.filter(F.floor(F.col("seq") * parts / 90) == k).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("parts", [1, 3])
def test_fall_vote_stream_equals_batch(spark, results, parts):
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(_folder(spark, results, parts)).withColumn("inferred_at", F.col("ts"))
    got = streams.run_to_table(streams.fall_vote_stream(src, 0.4, 10.0), "vote").select("device_id", "seq", "state", "fall_count", "new_fall")
    want = state.fall_vote(results.withColumn("inferred_at", F.col("ts")), 0.4, 10.0, 60).select("device_id", "seq", "state", "fall_count", "new_fall")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_throttle_stream_equals_batch(spark, results):
    rows = results.select("device_id", "seq", (F.unix_micros("ts") / 1e6).alias("now"), (F.col("proba_fall") < 0.8).alias("online"))
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(_folder(spark, rows, 3))
    got = streams.run_to_table(streams.throttle_stream(src, 12.0), "throttle")
    want = state.throttled_write(rows, ["device_id"], ["now", "seq"], "now", "online", 12.0, 30).select("device_id", "seq", "written")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_unanswered_commands_surface_after_the_watermark(spark):
    t0 = dt.datetime(2024, 1, 1)
    cmd = spark.createDataFrame([(1, t0), (2, t0), (3, t0 + dt.timedelta(hours=2))], "cmd_id long, ts timestamp")
    ack = spark.createDataFrame([(1, t0 + dt.timedelta(seconds=5), "done"), (9, t0 + dt.timedelta(hours=2), "done")], "cmd_id long, ack_ts timestamp, status string")
    paths = [scratch_path(spark, n) for n in ("cmd", "ack")]
    cmd.write.parquet(paths[0])
    ack.write.parquet(paths[1])
    s = streams.command_ack_stream(spark.readStream.schema(cmd.schema).parquet(paths[0]), spark.readStream.schema(ack.schema).parquet(paths[1]), "1 minute", "30 seconds")
    got = {(r.cmd_id, r.status) for r in streams.run_to_table(s, "pairs").collect()}
    assert (1, "done") in got and (2, None) in got


def test_replayed_batch_stores_each_fall_once(spark, results):
    from echogrid.streaming import sinks

    path = scratch_path(spark, "store")
    devices = spark.createDataFrame([(1, 7, "n", "r"), (2, 8, "n", "r")], "device_id long, facility_id int, name string, room string")
    links = spark.createDataFrame([], "resident_id long, device_id long, is_primary boolean")
    people = spark.createDataFrame([], "resident_id long, resident_name string, resident_room string, created_rank int")
    falls = results.filter("seq < 3").select("device_id", "seq", "ts", "proba_fall", F.lit("7").alias("tenant"))
    write = sinks.store_falls(path, devices, links, people)
    write(falls, 0)
    write(falls, 0)
    write(falls, 1)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 9
    reasons = {r.device_id: r.reject_reason for r in rows}
    assert reasons == {1: None, 2: "tenant_mismatch", 3: "unknown_device"}


def test_log_rows_for_accepted_falls_only(spark):
    from echogrid.streaming import sinks

    rows = [("k1", "Kim", "101", 0.81234, 5, 1, 7, None), ("k2", "Lee", "102", 0.9, 6, 2, 7, "tenant_mismatch")]
    df = spark.createDataFrame(rows, "event_key string, resident_name string, room string, proba_fall double, resident_id int, device_id int, facility_id int, reject_reason string")
    out = sinks.log_rows(df).collect()
    assert [(r.event_key, r.level, r.msg) for r in out] == [("k1", "FALL", "Kim (101) 낙상 감지 · 신뢰도 0.812")]


def _shuffled(spark, df, parts, seed):
    """Files in which rows come up to 40 seconds out of order, and one last row that moves the watermark past all others."""
    rows = df.collect()
    rng = np.random.default_rng(seed)
    order = sorted(rows, key=lambda r: r.ts.timestamp() + rng.integers(0, 40))
    path = scratch_path(spark, "mixed")
    for k in range(parts):
        part = order[k * len(order) // parts:(k + 1) * len(order) // parts]
        rng.shuffle(part)
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    last = dict(zip(df.columns, rows[0], strict=True)) | {"device_id": 99, "ts": rows[0].ts + dt.timedelta(days=40)}
    spark.createDataFrame([tuple(last[c] for c in df.columns)], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _equal(stream, batch, names):
    got = streams.run_to_table(stream, "machine", timers=True).filter("device_id < 99").select(*names)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, batch.select(*names).collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_machine_streams_equal_batch_over_shuffled_files(spark, results, seed):
    votes = results.withColumn("inferred_at", F.col("ts"))
    _equal(streams.fall_vote_stream(_shuffled(spark, votes, 4, seed), 0.4, 10.0, "90 seconds", ordered=True), state.fall_vote(votes, 0.4, 10.0, 60), ["device_id", "seq", "state", "fall_count", "new_fall"])
    ticks = results.select("device_id", "seq", "ts", (F.unix_micros("ts") / 1e6).alias("now"), (F.col("proba_fall") * 4).alias("mv"), (F.col("seq") % 7 / 3).alias("wander"))
    args = dict(mv_threshold=2.0, min_duration_s=3.0, timeout_s=6.0)
    _equal(streams.presence_stream(_shuffled(spark, ticks, 3, seed), "90 seconds", ordered=True, **args), state.presence(ticks, ["device_id"], ["ts", "seq"], "now", F.floor(F.col("now") / 50), **args),
           ["device_id", "seq", "state", "last_activity_at", "just_changed"])


def test_ordered_motion_and_throttle_streams_equal_batch(spark, results):
    from echogrid.streaming.steps import MotionFall

    ticks = results.select("device_id", "seq", "ts", (F.unix_micros("ts") / 1e6).alias("now"), (F.col("proba_fall") * 2).alias("mv"), (F.col("proba_fall") < 0.8).alias("online"))
    args = dict(threshold=0.8, min_duration_s=2.0, merge_gap_s=1.0, max_duration_s=9.0, cooldown_s=6.0)
    _equal(streams.motion_fall_stream(_shuffled(spark, ticks.drop("online"), 4, 3), "90 seconds", ordered=True, **args),
           state.motion_fall(ticks, ["device_id"], ["ts", "seq"], "now", "mv", F.floor(F.col("now") / 70), MotionFall(**args)), ["device_id", "seq", "state", "just_triggered"])
    _equal(streams.throttle_stream(_shuffled(spark, ticks.drop("mv"), 4, 4), 12.0, "90 seconds", ordered=True), state.throttled_write(ticks, ["device_id"], ["now", "seq"], "now", "online", 12.0, 30), ["device_id", "seq", "written"])


@pytest.mark.parametrize("ordered", [True, False])
def test_state_of_a_silent_device_goes(spark, ordered):
    """After the silence the device starts anew: its first hits count no falls of before."""
    t0 = dt.datetime(2024, 1, 1)
    at = [*range(8), *range(2000, 2008)]
    rows = [(1, k, t0 + dt.timedelta(seconds=s), 0.9) for k, s in enumerate(at)] + [(2, 50 + k, t0 + dt.timedelta(seconds=s), 0.1) for k, s in enumerate((500, 1000, 1500, 9000))]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[2]), SCHEMA).withColumn("inferred_at", F.col("ts"))
    path = scratch_path(spark, "silent")
    for low, high in ((0, 400), (400, 700), (700, 1200), (1200, 1800), (1800, 5000), (5000, 10_000)):
        df.filter((F.col("ts") >= F.lit(t0 + dt.timedelta(seconds=low))) & (F.col("ts") < F.lit(t0 + dt.timedelta(seconds=high)))).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = streams.run_to_table(streams.fall_vote_stream(src, 0.5, 10.0, "1 second", ordered=ordered, idle_s=300), "vote", timers=True)
    counts = [r.fall_count for r in out.filter("device_id = 1").orderBy("seq").collect()]
    assert counts == [0, 0, 0, 0, 1, 1, 1, 1] * 2


def test_kept_and_late_rows_are_the_input(spark, results):
    src = _shuffled(spark, results, 5, 6)
    kept, late = streams.run_late_split(src, "ts", 15.0)
    rows = sorted(map(str, map(tuple, kept.collect())))
    behind = sorted(map(str, map(tuple, late.select(*results.columns).collect())))
    assert len(behind) > 0 and sorted([r for r in rows if "99" not in r.split(",")[0]] + behind) == sorted(map(str, map(tuple, results.collect())))


def test_replayed_late_split_and_log_rows_count_once(spark, results):
    from echogrid.streaming import sinks

    path = scratch_path(spark, "store")
    devices = spark.createDataFrame([(1, 7, "n", "r"), (2, 8, "n", "r")], "device_id long, facility_id int, name string, room string")
    links = spark.createDataFrame([], "resident_id long, device_id long, is_primary boolean")
    people = spark.createDataFrame([], "resident_id long, resident_name string, resident_room string, created_rank int")
    falls = results.filter("seq < 3").select("device_id", "seq", "ts", "proba_fall", F.lit("7").alias("tenant"))
    write = sinks.store_falls(f"{path}/falls", devices, links, people, f"{path}/logs")
    for batch in (0, 0, 1, 1, 2):
        write(falls if batch else falls.filter("seq < 2"), batch)
    write(falls.limit(0), 3)
    assert spark.read.parquet(f"{path}/falls").count() == 9
    logs = spark.read.parquet(f"{path}/logs").collect()
    assert len(logs) == 3 and {r.device_id for r in logs} == {1} and len({r.event_key for r in logs}) == 3


def test_counters_of_a_stream_without_rows(spark):
    path = scratch_path(spark, "none")
    spark.createDataFrame([], "kind string, reason string").write.parquet(path)
    src = spark.readStream.schema("kind string, reason string").parquet(path)
    assert sum(streams.run_counted(streams.counted(src, F.col("kind"), F.col("reason"), ["a"], ["b"])).values()) == 0
