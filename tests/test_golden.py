"""Hand-sized cases with known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.operators import joins as j
from echogrid.operators import quality as q
from echogrid.operators import series as w
from echogrid.operators import signals as g
from echogrid.operators import stats
from echogrid.sources import recordings as rec
from echogrid.streaming import state, steps

def fixed():
    return F.floor(F.col("t") / 2)



def test_window_event_range_edges(spark):
    starts = spark.createDataFrame([(1, s) for s in (0, 15, 20, 30, 45, 55, 60)], "rec int, start int")
    runs = spark.createDataFrame([(1, 40, 50)], "rec int, a int, b int")
    out = {r.start: (r.kept, r.y) for r in j.window_event_labels(starts, runs, ["rec"], 30, 5).collect()}
    assert [s for s in sorted(out) if out[s][0]] == [0, 20, 30, 55, 60]
    assert [out[s][1] for s in (0, 20, 30, 55, 60)] == [0, 1, 1, 0, 0]


def test_unwrap_clock_at_32_bits(spark):
    rows = spark.createDataFrame([(1, 0, 2**32 - 10), (1, 1, 5), (1, 2, 15)], "k int, t int, clock long")
    got = [r.unwrapped for r in w.unwrap_clock(rows, ["k"], ["t"], "clock", chunk=fixed()).orderBy("t").collect()]
    assert got == [2**32 - 10, 2**32 + 5, 2**32 + 15]


def test_opposite_channels_do_not_cancel(spark):
    wave = np.sin(np.linspace(0, 12, 120))
    df = spark.createDataFrame([(1, [wave.tolist(), (-wave).tolist()])], "id int, channels array<array<double>>")
    m = g.channel_acf_maps(df, 40.0).first()
    assert np.isclose(np.mean(m.mean_map[:64]), 1.0)
    avg = g.channel_variant(df, "mean_signal", 40.0).first().channels[0]
    assert np.allclose(avg, 0)


def test_split_guard_rejects_a_group_on_both_sides(spark):
    rows = [("a", "source", "train", "g1", "p1"), ("b", "target", "test", "g1", "p2"), ("c", "external", "external", "g2", "p3")]
    out = q.split_guard(spark.createDataFrame(rows, "id string, role string, split string, `group` string, path string")).collect()
    assert [(r.rule, r.subject_key) for r in out] == [("group_spans_splits", "g1")]


def test_fall_vote_counts_once_and_ignores_repeats(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, k, t0 + dt.timedelta(milliseconds=250 * k), 0.9) for k in range(5)]
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, "device_id int, seq int, ts timestamp, proba_fall double").withColumn("inferred_at", F.col("ts"))
    out = state.fall_vote(state.dedup(df), 0.5, 10.0, 3600).orderBy("seq").collect()
    assert [r.state for r in out] == ["SUSPECT"] * 4 + ["FALL"]
    assert [r.new_fall for r in out] == [False] * 4 + [True] and out[-1].fall_count == 1


@pytest.mark.parametrize("chunk_s", [1, 7, 3600])
def test_fall_vote_twin_equals_step_machine(spark, chunk_s):
    rng = np.random.default_rng(5)
    t0, rows = dt.datetime(2024, 1, 1), []
    for dev, share in ((1, 0.5), (2, 0.8), (3, 0.3)):
        at = np.cumsum(rng.integers(1, 4, 120))
        rows += [(dev, k, t0 + dt.timedelta(seconds=int(s)), float(rng.random() < share)) for k, s in enumerate(at)]
    df = spark.createDataFrame(rows, "device_id int, seq int, ts timestamp, proba_fall double").withColumn("inferred_at", F.col("ts"))
    got = {(r.device_id, r.seq): (r.state, r.fall_count, r.new_fall) for r in state.fall_vote(df, 0.5, 10.0, chunk_s).collect()}
    for dev in (1, 2, 3):
        m = steps.FallVote(threshold=0.5, cooldown_s=10.0)
        for d, k, ts, p in rows:
            if d == dev:
                assert got[(d, k)] == m.step((ts - t0).total_seconds(), p)


def test_presence_timeout_and_single_change():
    p = steps.Presence(mv_threshold=1.0, timeout_s=6.0, smooth=False)
    assert p.step(0.0, 1.5, 0.0)["state"] == "PRESENT"
    assert p.step(5.9, 0.0, 0.0)["state"] == "PRESENT"
    late = p.step(6.1, 0.0, 0.0)
    assert (late["state"], late["just_changed"]) == ("ABSENT", True)
    assert p.step(6.2, 0.0, 0.0)["just_changed"] is False


@pytest.mark.parametrize("wander_can_enter", [True, False])
def test_presence_twin_equals_step_machine(spark, wander_can_enter):
    rng = np.random.default_rng(11)
    rows = [(d, k, float(t), float(rng.random() * 2), float(rng.random() * 2)) for d in (1, 2) for k, t in enumerate(np.cumsum(rng.integers(1, 3, 150)))]
    df = spark.createDataFrame(rows, "d int, k int, now double, mv double, wander double")
    args = dict(mv_threshold=1.5, wander_baseline=0.5, ratio_threshold=1.2, min_duration_s=2.0, timeout_s=4.0, wander_can_enter=wander_can_enter)
    got = {(r.d, r.k): (r.state, r.last_activity_at, r.just_changed, r.wander_confirmed) for r in state.presence(df, ["d"], ["k"], "now", F.floor(F.col("k") / 9), **args).collect()}
    for d in (1, 2):
        m = steps.Presence(**args)
        for row in rows:
            if row[0] == d:
                r = m.step(row[2], row[3], row[4])
                assert got[(d, row[1])] == (r["state"], r["last_activity_at"], r["just_changed"], r["wander_confirmed"])


def test_debounce_needs_an_unbroken_streak(spark):
    rows = [(1, 0.0, True), (1, 1.5, True), (1, 1.6, False), (1, 3.5, True), (1, 5.6, True)]
    df = spark.createDataFrame(rows, "k int, t double, hot boolean")
    out = w.debounce_confirm(df, ["k"], ["t"], "t", F.col("hot"), 2.0, 1.0, fixed()).orderBy("t").collect()
    assert [r.confirmed for r in out] == [False, False, False, False, True]


def test_upload_gate_linger_and_unknown(spark):
    rows = [(1, 0.0, "present"), (1, 5.0, "absent"), (1, 11.0, "absent"), (1, 12.0, None)]
    df = spark.createDataFrame(rows, "k int, t double, s string")
    out = state.upload_gate(df, ["k"], ["t"], "t", F.col("s"), fixed()).orderBy("t").collect()
    assert [r.gate_reason for r in out] == ["present", "forced", None, "forced"]


def test_online_is_three_valued(spark):
    devices = spark.createDataFrame([(1,), (2,), (3,)], "device_id int").withColumn("last_seen", F.lit(None).cast("timestamp_ntz"))
    seen = spark.createDataFrame([(2, dt.datetime(2024, 1, 1, 0, 0, 50), "present"), (3, dt.datetime(2024, 1, 1), "absent")], "device_id int, live_seen timestamp_ntz, state string")
    out = j.live_overlay(devices, seen, F.lit("2024-01-01 00:01:00").cast("timestamp"), 15.0).orderBy("device_id").collect()
    assert [r.online for r in out] == [None, True, False] and out[1].presence == "PRESENT"


def test_nearest_asof_ties_go_back_and_ends_clamp(spark):
    src = spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "k int, t int, v string")
    tgt = spark.createDataFrame([(1, 0), (1, 15), (1, 16), (1, 99)], "k int, t int")
    out = j.nearest_asof(src, tgt, ["k"], "t", ["v"]).orderBy("t").collect()
    assert [r.v for r in out] == ["a", "a", "b", "b"]


def test_stitched_lab_parts_repair_one_gap(spark):
    rows = [(1, p * 10 + k, k * 100_000) for p in range(2) for k in range(10)]
    df = spark.createDataFrame(rows, "rec int, i int, t long")
    out = w.repair_gaps(df, ["rec"], ["i"], "t", 100_000.0, F.floor(F.col("i") / 7)).orderBy("i").collect()
    assert sum(r.repaired for r in out) == 1 and [r.clock for r in out] == [k * 100_000.0 for k in range(20)]


def test_bad_recording_name_stops_a_strict_scan(spark):
    df = spark.createDataFrame([("E1_S02_C03_A05_T06.csv",), ("nonsense.csv",)], "path string")
    lenient = {r.path: r for r in rec.recording_index(df, "path", strict=False).collect()}
    assert lenient["E1_S02_C03_A05_T06.csv"].is_fall and lenient["nonsense.csv"].env is None
    with pytest.raises(Exception, match="bad recording name"):
        rec.recording_index(df, "path").collect()


def test_small_groups_have_no_effect_size(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 3.0), ("b", 4.0)], "g string, v double")
    r = stats.pair_statistics(df, [], "g", "v", ["a", "b"]).first()
    assert r.delta is None and r.ks_d is None and (r.n_a, r.n_b) == (2, 3)


def test_tails(spark):
    r = spark.range(1).select(stats.normal_two_sided(F.lit(1.959964)).alias("z"), stats.chi2_tail(F.lit(3.841459), F.lit(1.0)).alias("c1"),
                              stats.chi2_tail(F.lit(18.307), F.lit(10.0)).alias("c10"), stats.ks_tail(F.lit(0.1358), F.lit(200), F.lit(200)).alias("ks")).first()
    assert abs(r.z - 0.05) < 1e-6 and abs(r.c1 - 0.05) < 1e-6 and abs(r.c10 - 0.05) < 1e-5 and abs(r.ks - 0.05) < 2e-3
