"""Registered queries: live state, streams and their batch twins. Event gaps are hours, so time limits are scaled."""

from pyspark.sql import functions as F

from echogrid.operators import joins as j
from echogrid.operators import ordered as o
from echogrid.plans.joins import PRIMARY_SQL
from echogrid.registry import query
from echogrid.session import scratch_path
from echogrid.sources import scoring
from echogrid.sources import tables as t
from echogrid.sources.tables import r6, rnd, with_views
from echogrid.streaming import sinks, state, streams
from echogrid.streaming.steps import MotionFall

DAY, HOUR = 86_400, 3_600
CHUNK_S = 6 * HOUR
#: Chunks of the machine scans: some twenty rows of a device each, several of them a device.
SCAN_S = 10 * DAY


def _chunk():
    return o.time_chunk("ts", CHUNK_S)


def _results(spark, sf):
    """Inference results with every seventh one delivered twice."""
    r = t.inference(spark, sf)
    return r.unionByName(r.filter("seq % 7 = 0"))


def _result_stream(spark, sf):
    e = streams.event_stream(spark, sf)
    return e.selectExpr("user_id AS device_id", "event_id AS seq", "ts", "least(value / 100.0D, 1.0D) AS proba_fall", "ts AS inferred_at", "event_type", "value")


# --- delivery ---------------------------------------------------------------------------------------------

@query("s5_envelope_stream", "SELECT user_id AS device_id, count(*) AS n, min(event_id) AS first_seq FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def s5(spark, sf):
    text = F.to_json(F.struct(
        F.lit(1).alias("schema_version"), F.col("user_id").cast("string").alias("device_id"), F.lit("home-1").alias("tenant_id"), "ts",
        F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view"), "presence").otherwise("telemetry").alias("kind"), F.col("value").alias("mv_current")))
    path = scratch_path(spark, "envelopes")
    t.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(text.alias("value")).write.parquet(path)
    raw = streams.envelope_stream(spark, "parquet", {"maxFilesPerTrigger": "2"}, path, "value string")
    rows = streams.run_to_table(streams.parse_envelopes(raw, "presence").select("device_id", "seq", "ts"), "envelopes")
    return rows.groupBy(F.col("device_id").cast("bigint").alias("device_id")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("s6_presence_append", "SELECT CAST(ts AS DATE) AS date, count(*) AS n, count(DISTINCT user_id) AS devices FROM events GROUP BY 1")
def s6(spark, sf):
    path = scratch_path(spark, "presence")
    rows = streams.event_stream(spark, sf).selectExpr("ts", "user_id AS device_id", "event_type AS state", "value AS mv_current")
    sinks.presence_append(rows, f"{path}/out", f"{path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("date").agg(F.count("*").alias("n"), F.countDistinct("device_id").alias("devices"))


_FALLS_IN = "SELECT device_id, seq, ts, proba_fall, CASE WHEN seq % 50 = 0 THEN 'x' ELSE CAST(device_id % 25 AS VARCHAR) END AS tenant FROM inference WHERE proba_fall > 0.6"
_DEVICES25 = "d25 AS (SELECT device_id, device_id % 25 AS facility_id, name, room FROM devices WHERE device_id % 40 <> 7)"


def _falls_in(spark, sf):
    return t.inference(spark, sf).filter("proba_fall > 0.6").selectExpr("device_id", "seq", "ts", "proba_fall", "if(seq % 50 = 0, 'x', cast(device_id % 25 AS string)) AS tenant")


def _devices25(spark, sf):
    return t.devices(spark, sf).filter("device_id % 40 <> 7").withColumn("facility_id", F.col("device_id") % 25)


_S7_SQL = with_views("inference devices resident_devices residents", PRIMARY_SQL + f""", {_DEVICES25}, f AS ({_FALLS_IN})
SELECT f.device_id || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ':' || seq AS event_key, CASE WHEN d.device_id IS NULL THEN 'unknown_device' WHEN f.tenant <> CAST(d.facility_id AS VARCHAR) THEN 'tenant_mismatch' END AS reject_reason,
  CASE WHEN d.device_id IS NOT NULL THEN COALESCE(pr.resident_name, d.name) END AS resident_name FROM f LEFT JOIN d25 d ON d.device_id = f.device_id LEFT JOIN pr ON pr.device_id = f.device_id WHERE seq % 10 <> 3""")


@query("s7_idempotent_event_sink", _S7_SQL)
def s7(spark, sf):
    falls = _falls_in(spark, sf)
    from echogrid.functions import scalars as fx

    stored = falls.filter("seq % 10 = 3").select(fx.event_key(F.col("device_id"), F.col("ts"), F.col("seq")).alias("event_key"))
    twice = falls.unionByName(falls.filter("seq % 2 = 0"))
    return sinks.fall_rows(twice, _devices25(spark, sf), t.resident_devices(spark, sf), t.residents(spark, sf), stored).select("event_key", "reject_reason", "resident_name")


def _stored_falls(spark, sf):
    """Paths of the fall and log tables after the event sink has run over four overlapping files in which a third of the falls comes twice."""
    path = scratch_path(spark, "falls")
    e = _shuffled_parts(spark, sf)
    r = e.selectExpr("user_id AS device_id", "event_id AS seq", "cast(ts AS timestamp_ntz) AS local", "ts", "least(value / 100.0D, 1.0D) AS proba_fall").filter("proba_fall > 0.6")
    r = r.selectExpr("device_id", "seq", "ts", "proba_fall", "if(seq % 50 = 0, 'x', cast(device_id % 25 AS string)) AS tenant", "explode(if(seq % 3 = 0, array(1, 2), array(1))) AS copy").drop("copy")
    sink = sinks.event_sink(r, "3 days", f"{path}/out", f"{path}/log", f"{path}/ckpt", _devices25(spark, sf), t.resident_devices(spark, sf), t.residents(spark, sf))
    sink.trigger(availableNow=True).start().awaitTermination()
    return f"{path}/out", f"{path}/log"


@query("s7_event_sink_stream", _S7_SQL.replace("WHERE seq % 10 <> 3", ""))
def s7s(spark, sf):
    return spark.read.parquet(_stored_falls(spark, sf)[0]).select("event_key", "reject_reason", "resident_name")


@query("s7_fall_log_stream", with_views("inference devices resident_devices residents", PRIMARY_SQL + f""", {_DEVICES25}, f AS ({_FALLS_IN})
SELECT f.device_id || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ':' || seq AS event_key, 'FALL' AS level, COALESCE(pr.resident_name, d.name) || ' (' || COALESCE(pr.resident_room, d.room) || ') 낙상 감지 · 신뢰도 ' || CAST(CAST(CAST(proba_fall AS VARCHAR) AS DECIMAL(30, 20)) AS DECIMAL(10, 3)) AS msg,
  pr.resident_id, f.device_id, d.facility_id FROM f JOIN d25 d ON d.device_id = f.device_id LEFT JOIN pr ON pr.device_id = f.device_id WHERE f.tenant = CAST(d.facility_id AS VARCHAR)"""))
def s7l(spark, sf):
    """One FALL log row with every accepted fall, written with it under the same batch id."""
    return spark.read.parquet(_stored_falls(spark, sf)[1]).select("event_key", "level", "msg", "resident_id", "device_id", "facility_id")


@query("m1_stream_dedup", "SELECT user_id AS device_id, event_id AS seq FROM events")
def m1(spark, sf):
    return state.dedup(_results(spark, sf)).select("device_id", "seq")


@query("m1_dedup_stream", "SELECT user_id AS device_id, event_id AS seq FROM events")
def m1s(spark, sf):
    s = _result_stream(spark, sf).select("device_id", "seq", "ts")
    twice = s.withColumn("copy", F.explode(F.when(F.col("seq") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    return streams.run_to_table(streams.dedup_stream(twice, "40 days"), "dedup").select("device_id", "seq")


# --- fall vote --------------------------------------------------------------------------------------------

VOTE_SQL = f"""
, nn AS (SELECT device_id, seq, ts, proba_fall, epoch_us(ts) / 1e6 AS now, CASE WHEN proba_fall >= 0.3 THEN 1 ELSE 0 END AS raw, row_number() OVER w AS n FROM inference WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq)),
vv AS (SELECT *, CASE WHEN n >= 5 AND sum(raw) OVER (PARTITION BY device_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 THEN 1 ELSE 0 END AS maj FROM nn),
walk AS (SELECT device_id, n, seq, ts, proba_fall, raw, maj, CASE WHEN raw = 1 THEN 'SUSPECT' ELSE 'IDLE' END AS state, CAST(-1 AS DOUBLE) AS until, CAST(0 AS BIGINT) AS cnt, false AS fresh FROM vv WHERE n = 1
 UNION ALL SELECT v.device_id, v.n, v.seq, v.ts, v.proba_fall, v.raw, v.maj,
  CASE WHEN w.state = 'COOLDOWN' AND v.now < w.until THEN 'COOLDOWN' WHEN v.maj = 1 THEN 'FALL' WHEN w.state = 'FALL' THEN 'COOLDOWN' WHEN v.raw = 1 THEN 'SUSPECT' ELSE 'IDLE' END,
  CASE WHEN NOT (w.state = 'COOLDOWN' AND v.now < w.until) AND v.maj = 0 AND w.state = 'FALL' THEN v.now + {DAY} ELSE w.until END,
  w.cnt + CASE WHEN NOT (w.state = 'COOLDOWN' AND v.now < w.until) AND v.maj = 1 AND w.state <> 'FALL' THEN 1 ELSE 0 END,
  NOT (w.state = 'COOLDOWN' AND v.now < w.until) AND v.maj = 1 AND w.state <> 'FALL' FROM walk w JOIN vv v ON v.device_id = w.device_id AND v.n = w.n + 1)"""
_VOTE = with_views("inference", VOTE_SQL + " SELECT device_id, seq, state, cnt AS fall_count, fresh AS new_fall FROM walk", recursive=True)


def _vote(spark, sf):
    return state.fall_vote(state.dedup(_results(spark, sf)), 0.3, DAY, SCAN_S)


@query("m2_fall_vote_fsm", _VOTE)
def m2(spark, sf):
    return _vote(spark, sf).select("device_id", "seq", "state", "fall_count", "new_fall")


@query("m2_fall_vote_stream", _VOTE)
def m2s(spark, sf):
    s = streams.fall_vote_stream(_result_stream(spark, sf).select("device_id", "seq", "ts", "inferred_at", "proba_fall"), 0.3, DAY)
    return streams.run_to_table(s, "vote").select("device_id", "seq", "state", "fall_count", "new_fall")


_ORDERED = with_views("inference", VOTE_SQL + """ SELECT device_id, seq, state, cnt AS fall_count, fresh AS new_fall FROM walk
WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) - 172800000 FROM inference)""", recursive=True)


def _shuffled_parts(spark, sf, parts=4):
    """The event table as files that arrive one by one, each row up to a day late."""
    path = scratch_path(spark, "parts")
    e = t.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = e.agg(F.min("ts").alias("t")).first()["t"]
    at = (F.unix_micros("ts") - F.unix_micros(F.lit(first))) / (1e6 * DAY) + F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000
    dealt = e.withColumn("part", F.least(F.floor(at * parts / 30), F.lit(parts - 1)))
    for k in range(parts):
        dealt.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("m2_fall_vote_ordered_stream", _ORDERED)
def m2o(spark, sf):
    """Four files whose rows overlap by a day: rows wait for a watermark of two days and run in order."""
    e = _shuffled_parts(spark, sf)
    s = e.selectExpr("user_id AS device_id", "event_id AS seq", "ts", "least(value / 100.0D, 1.0D) AS proba_fall", "ts AS inferred_at")
    out = streams.run_to_table(streams.fall_vote_stream(s, 0.3, DAY, "2 days", ordered=True), "vote", timers=True)
    return out.select("device_id", "seq", "state", "fall_count", "new_fall")


# --- presence ---------------------------------------------------------------------------------------------

_TICKS = "SELECT device_id, seq, t_us / 1e6 AS now, value / 20.0::DOUBLE AS mv, ((seq * 37) % 100) / 40.0::DOUBLE AS wander FROM packets"


def _ticks(df):
    return df.selectExpr("device_id", "seq", "ts", "unix_micros(cast(ts AS timestamp)) / 1e6D AS now", "value / 20.0D AS mv", "((seq * 37) % 100) / 40.0D AS wander")


_PRESENCE = with_views("packets", f"""
, tk AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq) AS n FROM ({_TICKS})),
sm AS (SELECT *, CASE WHEN n >= 3 THEN 0.4*mv + 0.3*lag(mv) OVER w + 0.3*lag(mv, 2) OVER w WHEN n = 2 THEN 0.6*mv + 0.4*lag(mv) OVER w ELSE mv END AS m FROM tk WINDOW w AS (PARTITION BY device_id ORDER BY n)),
wk AS (SELECT device_id, n, seq, now, m, wander / 0.5 >= 2 AS hot, CASE WHEN wander / 0.5 >= 2 THEN now END AS since, CASE WHEN m >= 1.6 THEN now END AS last, CASE WHEN m >= 1.6 THEN 'PRESENT' ELSE 'ABSENT' END AS state, m >= 1.6 AS chg FROM sm WHERE n = 1
 UNION ALL SELECT s.device_id, s.n, s.seq, s.now, s.m, s.wander / 0.5 >= 2, x.since2, y.last2, CASE WHEN y.last2 IS NOT NULL AND s.now - y.last2 < 21600 THEN 'PRESENT' ELSE 'ABSENT' END,
  (CASE WHEN y.last2 IS NOT NULL AND s.now - y.last2 < 21600 THEN 'PRESENT' ELSE 'ABSENT' END) <> wk.state
  FROM wk JOIN sm s ON s.device_id = wk.device_id AND s.n = wk.n + 1, LATERAL (SELECT CASE WHEN s.wander / 0.5 >= 2 THEN COALESCE(wk.since, s.now) END AS since2) x,
  LATERAL (SELECT CASE WHEN s.m >= 1.6 OR (wk.state = 'PRESENT' AND x.since2 IS NOT NULL AND s.now - x.since2 >= 7200) THEN s.now ELSE wk.last END AS last2) y)
SELECT device_id, seq, {r6("m")} AS mv_current, state, {r6("last", 3)} AS last_activity_at, chg AS just_changed FROM wk""", recursive=True)
_SETTINGS = {"mv_threshold": 1.6, "wander_baseline": 0.5, "ratio_threshold": 2.0, "min_duration_s": 7200.0, "timeout_s": 21_600.0}


@query("m3_presence_fsm", _PRESENCE)
def m3(spark, sf):
    p = state.presence(_ticks(t.packets(spark, sf)), ["device_id"], ["ts", "seq"], "now", o.time_chunk("ts", SCAN_S), **_SETTINGS)
    return p.select("device_id", "seq", rnd("mv_current").alias("mv_current"), "state", rnd("last_activity_at", 3).alias("last_activity_at"), "just_changed")


@query("m3_presence_stream", _PRESENCE)
def m3s(spark, sf):
    s = streams.presence_stream(_ticks(_result_stream(spark, sf)), **_SETTINGS)
    p = streams.run_to_table(s, "presence")
    return p.select("device_id", "seq", rnd("mv_current").alias("mv_current"), "state", rnd("last_activity_at", 3).alias("last_activity_at"), "just_changed")


_PRESENCE_ROWS = _PRESENCE[:_PRESENCE.rindex("SELECT device_id, seq,")] + f"""
SELECT epoch_us(p.ts) AS ts_us, 'home-1' AS tenant_id, CAST(wk.device_id AS VARCHAR) AS device_id, state, {r6("m")} AS mv_current, ((wk.seq * 37) % 100) / 40.0::DOUBLE AS wander_current, 1.6::DOUBLE AS mv_threshold, 0.5::DOUBLE AS wander_baseline,
  2.0::DOUBLE AS wander_ratio_threshold, {r6("((wk.seq * 37) % 100) / 40.0::DOUBLE / 0.5")} AS wander_ratio, COALESCE(now - since >= 7200, false) AS wander_confirmed, {r6("last", 3)} AS last_activity_at, {r6("now - last", 3)} AS seconds_since_activity, chg AS just_changed
FROM wk JOIN packets p ON p.device_id = wk.device_id AND p.seq = wk.seq"""


@query("s6_presence_samples", _PRESENCE_ROWS)
def s6r(spark, sf):
    """All 14 columns of every presence sample, written by the append sink of the presence stream."""
    path = scratch_path(spark, "samples")
    stream = streams.presence_stream(_ticks(_result_stream(spark, sf)), **_SETTINGS)
    rows = sinks.presence_rows(stream, F.lit("home-1"), *[_SETTINGS[k] for k in ("mv_threshold", "wander_baseline", "ratio_threshold")])
    sinks.presence_append(rows, f"{path}/out", f"{path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema(rows.schema).parquet(f"{path}/out")
    digits = {"mv_current": 6, "wander_ratio": 6, "last_activity_at": 3, "seconds_since_activity": 3}
    return back.select(F.unix_micros("ts").alias("ts_us"), *[rnd(c, digits[c]).alias(c) if c in digits else F.col(c) for c in back.columns if c not in ("ts", "date")])


_MACHINE = {"threshold": 1.5, "min_duration_s": 3600.0, "merge_gap_s": 14_400.0, "max_duration_s": 36_000.0, "cooldown_s": 28_800.0}
_MOTION = with_views("packets", f"""
, tk AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq) AS n FROM ({_TICKS})),
wk AS (SELECT device_id, n, seq, CASE WHEN mv >= 1.5 THEN 'SUSPECT' ELSE 'IDLE' END AS state, CASE WHEN mv >= 1.5 THEN now END AS entered, now AS st, now AS above, false AS hit FROM tk WHERE n = 1
 UNION ALL SELECT k.device_id, k.n, k.seq, z.ns, CASE WHEN z.ns <> wk.state THEN k.now ELSE wk.entered END, CASE WHEN wk.state = 'IDLE' THEN k.now ELSE wk.st END,
  CASE WHEN k.mv >= 1.5 AND wk.state IN ('IDLE', 'SUSPECT') THEN k.now ELSE wk.above END, wk.state = 'SUSPECT' AND z.ns = 'FALL' FROM wk JOIN tk k ON k.device_id = wk.device_id AND k.n = wk.n + 1,
  LATERAL (SELECT CASE wk.state WHEN 'IDLE' THEN CASE WHEN k.mv >= 1.5 THEN 'SUSPECT' ELSE 'IDLE' END
   WHEN 'SUSPECT' THEN CASE WHEN k.mv >= 1.5 THEN CASE WHEN k.now - wk.st >= 3600 THEN 'FALL' ELSE 'SUSPECT' END WHEN k.now - wk.above > 14400 THEN 'IDLE' ELSE 'SUSPECT' END
   WHEN 'FALL' THEN CASE WHEN k.now - wk.entered >= 36000 OR k.mv < 1.5 THEN 'COOLDOWN' ELSE 'FALL' END ELSE CASE WHEN k.now - wk.entered >= 28800 THEN 'IDLE' ELSE 'COOLDOWN' END END AS ns) z)
SELECT device_id, seq, state, hit AS just_triggered FROM wk""", recursive=True)


@query("m4_mv_fall_fsm", _MOTION)
def m4(spark, sf):
    m = state.motion_fall(_ticks(t.packets(spark, sf)).drop("wander"), ["device_id"], ["ts", "seq"], "now", "mv", o.time_chunk("ts", SCAN_S), MotionFall(**_MACHINE))
    return m.select("device_id", "seq", "state", "just_triggered")


@query("m4_mv_fall_stream", _MOTION)
def m4s(spark, sf):
    return streams.run_to_table(streams.motion_fall_stream(_ticks(_result_stream(spark, sf)).drop("wander"), **_MACHINE), "motion").select("device_id", "seq", "state", "just_triggered")


@query("m5_upload_gate", with_views("packets", """
, s AS (SELECT device_id, seq, t_us / 1e6 AS now, CASE event_type WHEN 'click' THEN 'present' WHEN 'error' THEN NULL ELSE 'absent' END AS st, seq % 97 = 0 AS forced FROM packets),
l AS (SELECT *, last_value(CASE WHEN st = 'present' THEN now END IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY seq) AS lp FROM s),
r AS (SELECT device_id, seq, CASE WHEN forced THEN 'calibration' WHEN st = 'present' THEN 'present' WHEN st IS NULL THEN 'forced' WHEN now - lp < 28800 THEN 'forced' END AS gate_reason FROM l)
SELECT *, gate_reason IS NOT NULL AS gate_open FROM r"""))
def m5(spark, sf):
    p = t.packets(spark, sf).selectExpr("device_id", "seq", "ts", "t_us / 1e6D AS now", "event_type")
    st = F.expr("CASE event_type WHEN 'click' THEN 'present' WHEN 'error' THEN NULL ELSE 'absent' END")
    return state.upload_gate(p, ["device_id"], ["ts", "seq"], "now", st, _chunk(), 28_800.0, forced=F.col("seq") % 97 == 0).select("device_id", "seq", "gate_reason", "gate_open")


_SLIDE = f"""
, w AS (SELECT device_id, value, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '3 hours' AS start FROM packets, range(0, 4) r(k))
SELECT epoch_us(start) AS start_us, device_id, count(*) AS n, {r6("avg(value)")} AS mean FROM w GROUP BY ALL"""


def _slide_aggs():
    return [F.count("*").alias("n"), F.avg("value").alias("mean")]


@query("m6_sliding_features", with_views("packets", _SLIDE))
def m6(spark, sf):
    p = t.packets(spark, sf).select("device_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return streams.sliding_features(p, None, "12 hours", "3 hours", _slide_aggs()).select(F.unix_micros("start").alias("start_us"), "device_id", "n", rnd("mean").alias("mean"))


@query("m6_sliding_feature_stream", with_views("packets", _SLIDE + " HAVING start + INTERVAL '12 hours' <= (SELECT max(ts) FROM packets)"))
def m6s(spark, sf):
    s = _result_stream(spark, sf).select("device_id", "ts", "value")
    out = streams.run_to_table(streams.sliding_features(s, "0 seconds", "12 hours", "3 hours", _slide_aggs()), "sliding")
    return out.select(F.unix_micros("start").alias("start_us"), "device_id", "n", rnd("mean").alias("mean"))


@query("m7_score_stream", f"SELECT event_id AS seq, {r6('1 / (1 + exp(-(value * 0.02 - 0.5)))')} AS proba_fall, 0.468::DOUBLE AS threshold, 'linear-1' AS model_version FROM events")
def m7(spark, sf):
    s = _result_stream(spark, sf).select("seq", F.array("value").alias("x"))
    out = streams.run_to_table(scoring.score(s, "x", scoring.linear_scorer([0.02], -0.5), "linear-1", t.THRESHOLD), "scores")
    return out.withColumn("proba_fall", rnd("proba_fall"))


@query("m8_latest_state", with_views("packets", """
SELECT device_id, arg_max(value, seq) FILTER (event_type = 'click') AS presence, arg_max(value, seq) FILTER (event_type = 'view') AS link, arg_max(value, seq) FILTER (event_type = 'purchase') AS fall,
  max(ts) FILTER (event_type = 'view') AS last_seen FROM packets GROUP BY 1"""))
def m8(spark, sf):
    v = F.col("value")
    p = t.packets(spark, sf).withColumn("kind", F.expr("CASE event_type WHEN 'click' THEN 'presence' WHEN 'view' THEN 'link' WHEN 'purchase' THEN 'fall' END"))
    return state.latest_state(p, "device_id", "kind", F.struct("ts", "seq"), {"presence": v, "link": v, "fall": v}, "link", "ts")


_SILENCE = """, g AS (SELECT device_id, t_us / 1e6 AS now, lead(t_us / 1e6) OVER (PARTITION BY device_id ORDER BY seq) AS nx, (SELECT max(t_us) / 1e6 FROM packets) AS e FROM packets)"""


@query("m9_offline_sweep", with_views("packets", _SILENCE + f" SELECT device_id, {r6('now', 3)} AS last_seen, {r6('now + 43200', 3)} AS offline_at, {r6('nx', 3)} AS back_at FROM g WHERE COALESCE(nx, e) - now >= 43200"))
def m9(spark, sf):
    p = t.packets(spark, sf).selectExpr("device_id", "seq", "ts", "t_us / 1e6D AS now")
    return state.offline_transitions(p, ["device_id"], ["ts", "seq"], "now", 43_200.0, _chunk()).withColumns({c: rnd(c, 3) for c in ("last_seen", "offline_at", "back_at")})


@query("m9_offline_stream", with_views("packets", _SILENCE + f"""
SELECT device_id, 'offline' AS event, {r6('now + 43200', 3)} AS moment FROM g WHERE nx - now >= 43200 OR (nx IS NULL AND now + 43200 <= e - 1) UNION ALL SELECT device_id, 'online', {r6('nx', 3)} FROM g WHERE nx - now >= 43200"""))
def m9s(spark, sf):
    s = _result_stream(spark, sf).select("device_id", "ts", (F.unix_micros("ts") / 1e6).alias("now"))
    return streams.run_to_table(streams.offline_stream(s, "1 second", 43_200.0), "offline").select("device_id", "event", rnd("at", 3).alias("moment"))


_THROTTLE = with_views("packets", f"""
, tk AS (SELECT device_id, seq, t_us / 1e6 AS now, value < 60 AS flag, row_number() OVER (PARTITION BY device_id ORDER BY seq) AS n FROM packets),
wk AS (SELECT device_id, n, seq, flag, now AS lw, true AS written FROM tk WHERE n = 1 UNION ALL SELECT k.device_id, k.n, k.seq, k.flag, CASE WHEN k.flag <> wk.flag OR k.now - wk.lw >= 28800 THEN k.now ELSE wk.lw END, (k.flag <> wk.flag OR k.now - wk.lw >= 28800)
 FROM wk JOIN tk k ON k.device_id = wk.device_id AND k.n = wk.n + 1) SELECT device_id, seq, written FROM wk""", recursive=True)


@query("m10_throttled_write", _THROTTLE)
def m10(spark, sf):
    p = t.packets(spark, sf).selectExpr("device_id", "seq", "t_us / 1e6D AS now", "value < 60 AS online")
    return state.throttled_write(p, ["device_id"], ["now", "seq"], "now", "online", 28_800.0, SCAN_S).select("device_id", "seq", "written")


@query("m10_throttle_stream", _THROTTLE)
def m10s(spark, sf):
    s = _result_stream(spark, sf).select("device_id", "seq", "ts", (F.unix_micros("ts") / 1e6).alias("now"), (F.col("value") < 60).alias("online"))
    return streams.run_to_table(streams.throttle_stream(s, 28_800.0), "throttle").select("device_id", "seq", "written")


@query("m11_coalesce_latest", with_views("packets", """
SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) AS start_us, device_id, count(*) AS n, arg_max(seq, seq) AS seq, arg_max(value, seq) AS value FROM packets WHERE device_id % 3 = 0 GROUP BY ALL"""))
def m11(spark, sf):
    p = t.packets(spark, sf).filter("device_id % 3 = 0").withColumn("ts", F.col("ts").cast("timestamp"))
    c = state.coalesce_latest(p, "ts", "6 hours", "device_id", F.struct("ts", "seq"), ["seq", "value"])
    return c.withColumn("start_us", F.unix_micros("start")).drop("start")


@query("m12_priority_shed", with_views("packets", """
, r AS (SELECT device_id, seq, CAST(ts AS DATE) AS batch, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY CASE WHEN event_type = 'view' THEN 1 ELSE 0 END, ts DESC, seq DESC) AS rn FROM packets) SELECT * FROM r WHERE rn <= 250"""))
def m12(spark, sf):
    p = t.packets(spark, sf).select("device_id", "seq", "ts", "event_type", F.to_date("ts").alias("batch"))
    return state.priority_shed(p, ["batch"], F.when(F.col("event_type") == "view", 1).otherwise(0), [F.col("ts").desc(), F.col("seq").desc()], 250).select("device_id", "seq", "batch", "rn")


@query("m13_loss_detect", with_views("packets", """
, c AS (SELECT device_id, seq, (seq // 150) % 40 AS counter FROM packets), l AS (SELECT *, counter - lag(counter) OVER (PARTITION BY device_id ORDER BY seq) AS d FROM c)
SELECT device_id, sum(CASE WHEN d > 1 THEN d - 1 ELSE 0 END)::BIGINT AS lost, count(*) FILTER (d < 0) AS reboots FROM l GROUP BY 1"""))
def m13(spark, sf):
    p = t.packets(spark, sf).selectExpr("device_id", "seq", "ts", "(seq div 150) % 40 AS counter")
    return state.loss_detect(p, ["device_id"], ["ts", "seq"], "counter", _chunk()).groupBy("device_id").agg(F.sum("lost").alias("lost"), F.count_if("reboot").alias("reboots"))


@query("m14_notification_fanout", with_views("inference devices resident_devices residents recipients", VOTE_SQL + PRIMARY_SQL + f"""
, fl AS (SELECT w.device_id, w.seq, w.ts, w.proba_fall, d.facility_id, pr.resident_id FROM walk w JOIN devices d ON d.device_id = w.device_id LEFT JOIN pr ON pr.device_id = w.device_id WHERE fresh),
fc AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN resident_id IS NULL THEN 'd' || device_id ELSE 'r' || resident_id END ORDER BY ts, seq) AS fall_count FROM fl)
SELECT fc.device_id, fc.seq, r.recipient_id, fc.resident_id, fall_count, '낙상이 감지되었습니다.' || chr(10) || '시각: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || '확률: ' || printf('%.1f', round(proba_fall * 100, 1)) || '% (누적 ' || fall_count || '회)' AS message
FROM fc JOIN recipients r ON r.facility_id = fc.facility_id AND (r.resident_id IS NULL OR r.resident_id = fc.resident_id) WHERE r.enabled AND r.push AND r.topic IS NOT NULL""", recursive=True))
def m14(spark, sf):
    """Which devices had a confirmed fall, when, and who must be told?"""
    d = t.devices(spark, sf)
    new = _vote(spark, sf).filter("new_fall").join(d.select("device_id", F.col("facility_id").cast("string").alias("tenant")), "device_id")
    falls = sinks.fall_rows(new.select("device_id", "tenant", "ts", "seq", "proba_fall"), d, t.resident_devices(spark, sf), t.residents(spark, sf))
    n = sinks.notifications(falls, t.recipients(spark, sf))
    return n.select("device_id", "seq", "recipient_id", "resident_id", "fall_count", "message")


@query("m15_late_data", with_views("packets", """
, a AS (SELECT device_id, seq, t_us / 1e6 - (CASE WHEN seq % 11 = 0 THEN 200000 ELSE 0 END) AS t FROM packets), m AS (SELECT *, max(t) OVER (PARTITION BY device_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM a)
SELECT device_id, count(*) FILTER (COALESCE(hi - t > 86400, false)) AS late, count(*) AS rows FROM m GROUP BY 1"""))
def m15(spark, sf):
    p = t.packets(spark, sf).selectExpr("device_id", "seq", "ts", "t_us / 1e6D - if(seq % 11 = 0, 200000, 0) AS t")
    return state.late_rows(p, ["device_id"], ["ts", "seq"], "t", 86_400.0, _chunk()).groupBy("device_id").agg(F.count_if("late").alias("late"), F.count("*").alias("rows"))


_ARRIVAL = """
, a AS (SELECT device_id, seq, t_us - (CASE WHEN seq % 11 = 0 THEN 200000000000 ELSE 0 END) AS t, (seq - min(seq) OVER ()) * 6 // (max(seq) OVER () - min(seq) OVER () + 1) AS part FROM packets),
h AS (SELECT part, max(max(t)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM a GROUP BY part)
SELECT device_id, seq, COALESCE(hi - t > 86400000000, false) AS late FROM a JOIN h USING (part)"""


@query("m15_late_table", with_views("packets", _ARRIVAL))
def m15t(spark, sf):
    """Rows of six files in order of arrival, dealt to a kept and a late table; together they are the input."""
    path, p = scratch_path(spark, "arrivals"), t.packets(spark, sf)
    ends = p.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    shifted = p.selectExpr("device_id", "seq", "timestamp_micros(t_us - if(seq % 11 = 0, 200000000000, 0)) AS ts")
    for k in range(6):
        shifted.where(F.expr(f"(seq - {ends['a']}) * 6 div {ends['b'] - ends['a'] + 1} = {k}")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(shifted.schema).option("maxFilesPerTrigger", 1).parquet(path)
    kept, late = streams.run_late_split(stream, "ts", 86_400.0)
    return kept.select("device_id", "seq", F.lit(False).alias("late")).unionByName(late.select("device_id", "seq", F.lit(True).alias("late")))


_KINDS, _REASONS = ["presence", "signal", "telemetry", "ack"], ["invalid_json", "unknown_field", "missing_seq", "bad_kind", "bad_value"]


@query("a23_counter_stream", """
WITH r AS (SELECT event_id % 10 AS bad, CASE event_type WHEN 'click' THEN 'presence' WHEN 'view' THEN 'signal' WHEN 'error' THEN 'telemetry' ELSE 'ack' END AS kind FROM events),
c AS (SELECT *, CASE bad WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'unknown_field' WHEN 2 THEN 'missing_seq' WHEN 3 THEN 'bad_kind' WHEN 4 THEN 'bad_value' END AS reason FROM r),
n AS (SELECT 'forwarded' AS counter, count(*) FILTER (reason IS NULL) AS n FROM c UNION ALL SELECT 'rejected', count(*) FILTER (reason IS NOT NULL) FROM c
  UNION ALL SELECT 'kind_' || kind, count(*) FROM c WHERE reason IS NULL GROUP BY kind UNION ALL SELECT 'reason_' || reason, count(*) FROM c WHERE reason IS NOT NULL GROUP BY reason)
SELECT * FROM n""")
def a23s(spark, sf):
    """What a listener adds up from the metrics of an envelope stream: forwarded, rejected, by kind and by reason."""
    from echogrid.operators import quality as q

    path = scratch_path(spark, "envelopes")
    kind = "CASE event_type WHEN 'click' THEN 'presence' WHEN 'view' THEN 'signal' WHEN 'error' THEN 'telemetry' ELSE 'ack' END"
    t.table(spark, sf, "events").selectExpr("event_id", "event_id % 10 AS bad", f"{kind} AS kind", "value").selectExpr(
        "case bad when 0 then '{oops' when 1 then concat('{\"seq\":', event_id, ',\"kind\":\"', kind, '\",\"p\":0.5,\"extra\":1}') when 2 then concat('{\"kind\":\"', kind, '\",\"p\":0.5}') "
        "when 3 then concat('{\"seq\":', event_id, ',\"kind\":\"other\",\"p\":0.5}') when 4 then concat('{\"seq\":', event_id, ',\"kind\":\"', kind, '\",\"p\":1.5}') "
        "else concat('{\"seq\":', event_id, ',\"kind\":\"', kind, '\",\"p\":', value / 1000.0D, '}') end AS value").repartition(3).write.parquet(path)
    raw = streams.envelope_stream(spark, "parquet", {"maxFilesPerTrigger": "1"}, path, "value string").withColumnRenamed("value", "text")
    checked = q.schema_reject(raw, "text", "seq long, kind string, p double", ["seq", "kind"], {"bad_kind": F.col("value.kind").isin(*_KINDS), "bad_value": F.col("value.p").between(0.0, 1.0)})
    totals = streams.run_counted(streams.counted(checked, F.col("value.kind"), F.col("reject_reason"), _KINDS, _REASONS))
    return spark.createDataFrame(sorted(totals.items()), "counter string, n bigint")


_SESSIONS = """, g AS (SELECT device_id, t_us, t_us - lag(t_us) OVER (PARTITION BY device_id ORDER BY seq) AS gap FROM packets),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY t_us) AS sid FROM g),
z AS (SELECT device_id, min(t_us) AS a, max(t_us) + 14400000000 AS b, count(*) AS rows FROM s GROUP BY device_id, sid)"""


@query("m16_activity_sessions", with_views("packets", _SESSIONS + f" SELECT device_id, {r6('a / 1e6', 3)} AS start, {r6('b / 1e6', 3)} AS \"end\", rows FROM z"))
def m16(spark, sf):
    p = t.packets(spark, sf).selectExpr("device_id", "seq", "ts", "t_us / 1e6D AS now")
    return state.activity_sessions(p, ["device_id"], ["ts", "seq"], "now", 14_400.0, _chunk()).select("device_id", rnd("start", 3).alias("start"), rnd("end", 3).alias("end"), "rows")


@query("m16_session_stream", with_views("packets", _SESSIONS + " SELECT device_id, a AS start_us, b AS end_us, rows FROM z WHERE b <= (SELECT max(t_us) FROM packets)"))
def m16s(spark, sf):
    s = streams.sessions_stream(_result_stream(spark, sf).select("device_id", "ts"), "0 seconds", "4 hours")
    out = streams.run_to_table(s, "sessions")
    return out.select("device_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "rows")


@query("m17_command_ack_join", with_views("packets", """
, c AS (SELECT seq AS cmd_id, device_id, ts FROM packets WHERE event_type = 'click'), a AS (SELECT seq - seq % 5 AS cmd_id, ts, event_type AS status, value AS progress FROM packets WHERE event_type <> 'click'),
b AS (SELECT c.cmd_id, arg_max(status, a.ts) AS status, arg_max(progress, a.ts) AS progress FROM c JOIN a ON a.cmd_id = c.cmd_id AND a.ts >= c.ts AND a.ts <= c.ts + INTERVAL 15 MINUTE GROUP BY 1)
SELECT c.cmd_id, c.device_id, status, progress, b.cmd_id IS NOT NULL AS answered FROM c LEFT JOIN b ON b.cmd_id = c.cmd_id"""))
def m17(spark, sf):
    p = t.packets(spark, sf)
    commands = p.filter("event_type = 'click'").selectExpr("seq AS cmd_id", "device_id", "ts")
    acks = p.filter("event_type <> 'click'").selectExpr("seq - seq % 5 AS cmd_id", "ts", "event_type AS status", "value AS progress")
    return state.command_ack(commands, acks, 900.0).drop("ts")
