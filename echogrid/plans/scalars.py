"""Registered queries: scalar and array functions."""

from pyspark.sql import functions as F

from echogrid.functions import scalars as fx
from echogrid.registry import query
from echogrid.sources import tables as t
from echogrid.sources.tables import r6, rnd, with_views


@query("x1_parse_complex", """
WITH c AS (SELECT o_orderkey AS id, CAST(o_orderkey % 97 - 48 AS VARCHAR) || '+' || CAST(o_custkey % 61 - 30 AS VARCHAR) ||
  (CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'i' END) AS cell, o_orderkey % 97 - 48 AS a, o_custkey % 61 - 30 AS b, o_orderkey % 11 <> 0 AS ok
  FROM orders)
SELECT id, CASE WHEN ok THEN CAST(a AS DOUBLE) END AS re, CASE WHEN ok THEN CAST(b AS DOUBLE) END AS im,
  CASE WHEN ok THEN (round(sqrt(CAST(a*a + b*b AS DOUBLE)), 6) + 0) END AS magnitude FROM c""")
def x1(spark, sf):
    cells = t.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id",
        "concat(o_orderkey % 97 - 48, '+', o_custkey % 61 - 30, if(o_orderkey % 11 = 0, '', 'i')) AS cell",
    )
    value = fx.parse_complex(F.col("cell"))
    return cells.select("id", value["re"].alias("re"), value["im"].alias("im"), rnd(fx.complex_magnitude(F.col("cell"))).alias("magnitude"))


@query("x2_iq_amplitude", with_views("windows", f"""
, c AS (SELECT vec_id, list_transform(CASE WHEN vec_id % 17 = 0 THEN x[1:63] ELSE x END, lambda v: CAST(round(v * 100) AS INT)) AS flat FROM windows)
SELECT vec_id, CASE WHEN len(flat) = 64 THEN 32 END AS pairs, CASE WHEN len(flat) = 64 THEN
  {r6("list_sum(list_transform(range(0, 32), lambda k: sqrt(CAST(flat[2*k+1]*flat[2*k+1] + flat[2*k+2]*flat[2*k+2] AS DOUBLE))))")} END AS total FROM c"""))
def x2(spark, sf):
    flat = t.windows(spark, sf).selectExpr(
        "vec_id", "transform(if(vec_id % 17 = 0, slice(x, 1, 63), x), v -> cast(round(v * 100) AS int)) AS flat")
    out = flat.withColumn("amp", fx.iq_amplitude(F.col("flat"), 32))
    return out.select("vec_id", F.when(F.col("amp").isNotNull(), F.size("amp")).alias("pairs"), rnd(fx.array_sum(F.col("amp"))).alias("total"))


@query("x3_topic", """
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'bad/' || c_mktsegment ELSE c_mktsegment END AS tenant FROM customer),
q AS (SELECT c_custkey AS device_id, CASE WHEN strpos(tenant, '/') = 0 THEN 'sense/' || tenant || '/' || c_custkey || '/presence' END AS topic FROM p)
SELECT device_id, topic, split_part(topic, '/', 2) AS tenant, split_part(topic, '/', 4) AS leaf,
  CASE WHEN topic IS NULL THEN NULL ELSE 4 END AS parts FROM q""")
def x3(spark, sf):
    src = t.table(spark, sf, "customer").selectExpr(
        "c_custkey AS device_id", "if(c_custkey % 13 = 0, concat('bad/', c_mktsegment), c_mktsegment) AS tenant_in")
    out = src.withColumn("topic", fx.device_topic("sense", F.col("tenant_in"), F.col("device_id"), F.lit("presence")))
    parsed = fx.parse_topic(F.col("topic"))
    return out.select("device_id", "topic", parsed["tenant"].alias("tenant"), parsed["leaf"].alias("leaf"),
                      F.when(F.col("topic").isNotNull(), parsed["parts"]).alias("parts"))


@query("x4_ids", with_views("file_index", """
SELECT recording_id, printf('E%d_S%02d_C%02d_A%02d_T%02d', env, subject, 1, activity, trial) AS task_id,
  recording_id || '_rx' || env || '_s' || trial * 48 AS sample_id, 'w' || lpad(CAST(recording_id AS VARCHAR), 4, '0') AS window_id FROM file_index"""))
def x4(spark, sf):
    return t.file_index(spark, sf).select(
        "recording_id", fx.recording_name("env", "subject", F.lit(1), "activity", "trial").alias("task_id"),
        fx.sample_id(F.col("recording_id"), F.col("env"), F.col("trial") * 48).alias("sample_id"),
        fx.window_id(F.col("recording_id")).alias("window_id"))


@query("x5_total_rss_dbm", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 45 AS a, l_suppkey % 40 AS b, (l_partkey + l_suppkey) % 50 AS c, l_quantity AS agc FROM lineitem),
p AS (SELECT *, (CASE WHEN a > 0 THEN pow(10.0, a / 10.0) ELSE 0 END) + (CASE WHEN b > 0 THEN pow(10.0, b / 10.0) ELSE 0 END)
  + (CASE WHEN c > 0 THEN pow(10.0, c / 10.0) ELSE 0 END) AS mag FROM r)
SELECT l_orderkey, l_linenumber, a, b, c, CASE WHEN mag > 0 THEN {r6("10 * log10(mag) - 44 - agc")} END AS dbm FROM p""")
def x5(spark, sf):
    rows = t.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey % 45 AS a", "l_suppkey % 40 AS b", "(l_partkey + l_suppkey) % 50 AS c", "l_quantity AS agc")
    return rows.select("l_orderkey", "l_linenumber", "a", "b", "c",
                       rnd(fx.total_rss_dbm([F.col("a"), F.col("b"), F.col("c")], F.col("agc"))).alias("dbm"))


@query("x6_epoch_to_ts", """
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 10 = 0 THEN 1e300 WHEN event_id % 10 = 1 THEN NULL
  ELSE CAST(1700000000 + event_id * 60 AS DOUBLE) + 0.5 END AS epoch FROM events)
SELECT event_id, CASE WHEN epoch < 2e11 THEN strftime(make_timestamp(CAST(epoch * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS at,
  user_id || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ':' || event_id AS event_key FROM e""")
def x6(spark, sf):
    e = t.table(spark, sf, "events").withColumn("epoch", F.expr(
        "case when event_id % 10 = 0 then 1e300D when event_id % 10 = 1 then null else cast(1700000000 + event_id * 60 as double) + 0.5D end"))
    return e.select("event_id", F.date_format(fx.epoch_to_timestamp(F.col("epoch")), "yyyy-MM-dd HH:mm:ss").alias("at"),
                    fx.event_key(F.col("user_id"), F.col("ts"), F.col("event_id")).alias("event_key"))


_ACTIVITY_CASE = "CASE activity " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fx.ACTIVITY_NAMES.items()) + " END"


@query("x7_enum_labels", with_views("file_index fall_events", f"""
SELECT recording_id, {_ACTIVITY_CASE} AS activity_name, (SELECT CASE response WHEN 'PENDING' THEN '대기중' WHEN 'ACKNOWLEDGED' THEN '확인함' ELSE '오탐지' END FROM fall_events WHERE id = recording_id) AS response_label,
  CASE WHEN abs(trial / 40.0 - 0.2) < 0.147 THEN 'negligible' WHEN abs(trial / 40.0 - 0.2) < 0.33 THEN 'small'
       WHEN abs(trial / 40.0 - 0.2) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM file_index"""))
def x7(spark, sf):
    labels = t.fall_events(spark, sf).select(F.col("id").alias("recording_id"), fx.label_of(fx.RESPONSE_LABELS, F.col("response")).alias("response_label"))
    rows = t.file_index(spark, sf).select("recording_id", fx.label_of(fx.ACTIVITY_NAMES, F.col("activity")).alias("activity_name"),
                                          fx.cliff_magnitude(F.col("trial") / 40.0 - 0.2).alias("magnitude"))
    return rows.join(labels, "recording_id", "left")


@query("x8_normalize_text", """
SELECT c_custkey, lower(trim('  ' || c_name || ' ')) AS email, upper(trim(lower(c_mktsegment))) AS state FROM customer""")
def x8(spark, sf):
    return t.table(spark, sf, "customer").select(
        "c_custkey", fx.normal_text(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("email"),
        fx.normal_text(F.lower("c_mktsegment"), upper=True).alias("state"))


@query("x9_zone_label", """
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS a, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 9 END AS b FROM part)
SELECT p_partkey, CASE WHEN a IS NULL THEN 'F?' ELSE 'F' || a END AS by_first,
  CASE WHEN a IS NULL THEN 'F?' WHEN b IS NULL THEN 'F' || a || '-?' ELSE 'F' || a || '-' || b END AS by_pair FROM p""")
def x9(spark, sf):
    p = t.table(spark, sf, "part").selectExpr("p_partkey", "if(p_size % 5 = 0, null, p_size) AS a", "if(p_partkey % 4 = 0, null, p_partkey % 9) AS b")
    return p.select("p_partkey", fx.zone_label(F.col("a"), F.col("b")).alias("by_first"), fx.zone_label(F.col("a"), F.col("b"), "ab").alias("by_pair"))


@query("x10_device_mapping", """
WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 10 END AS device,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN CAST([] AS BIGINT[]) ELSE [c_custkey % 7, c_custkey % 10, c_custkey % 7] END AS devs FROM customer),
s AS (SELECT id, device, COALESCE(devs, CASE WHEN device IS NULL THEN CAST([] AS BIGINT[]) ELSE [device] END) AS src FROM r),
d AS (SELECT id, device, list_filter(src, lambda v, k: list_position(src, v) = k) AS ids FROM s)
SELECT id, CASE WHEN list_contains(ids, device) THEN device WHEN len(ids) > 0 THEN ids[1] END AS main_device,
  array_to_string(ids, ',') AS ids FROM d""")
def x10(spark, sf):
    r = t.table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "if(c_custkey % 6 = 0, null, c_custkey % 10) AS device",
        "case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then cast(array() as array<bigint>) else array(c_custkey % 7, c_custkey % 10, c_custkey % 7) end AS devs")
    m = fx.device_mapping(F.col("device"), F.col("devs"))
    return r.select("id", m["primary"].alias("main_device"), F.array_join(m["ids"].cast("array<string>"), ",").alias("ids"))


@query("x11_percentile_scale", with_views("windows", f"""
, a AS (SELECT vec_id, x, list_transform(x, lambda v: abs(v)) AS m FROM windows),
s AS (SELECT vec_id, x, quantile_cont(u, 0.9) AS scale FROM (SELECT vec_id, x, unnest(m) AS u FROM a) GROUP BY vec_id, x)
SELECT vec_id, {r6("scale")} AS scale, {r6("list_sum(list_transform(x, lambda v: greatest(least(v / scale, 1e0), -1e0)))")} AS clipped_sum FROM s"""))
def x11(spark, sf):
    w = t.windows(spark, sf).withColumn("s", fx.percentile_scale(F.col("x"), 0.9))
    return w.select("vec_id", rnd("s").alias("scale"), rnd(fx.array_sum(fx.clip_to_scale(F.col("x"), F.col("s")))).alias("clipped_sum"))


@query("x12_linear_resize", with_views("windows", f"""
, g AS (SELECT vec_id, x, k, k * 63 / 19.0::DOUBLE AS pos FROM windows, range(0, 20) r(k)),
h AS (SELECT *, CAST(least(floor(pos), 62) AS INT) AS lo FROM g)
SELECT vec_id, CAST(k AS INT) AS bin, {r6("x[lo+1] + (x[lo+2] - x[lo+1]) * (pos - lo)")} AS v FROM h"""))
def x12(spark, sf):
    return t.windows(spark, sf).select("vec_id", F.posexplode(fx.linear_resize(F.col("x"), 20)).alias("bin", "v")).select("vec_id", "bin", rnd("v").alias("v"))


@query("x13_block_pool", with_views("windows", f"""
, e AS (SELECT vec_id, x, generate_subscripts(x, 1) - 1 AS p FROM windows),
c AS (SELECT vec_id, x[p+1] AS v, (p // 8) // 2 AS bi, (p % 8) // 2 AS bj FROM e)
SELECT vec_id, CAST(bi * 4 + bj AS INT) AS cell, {r6("avg(v)")} AS mean, {r6("ln(1 + 10 * greatest(avg(v), 0))")} AS log_mean FROM c GROUP BY vec_id, bi, bj"""))
def x13(spark, sf):
    pooled = t.windows(spark, sf).select("vec_id", F.posexplode(fx.block_pool(F.col("x"), 8, 8, 4, 4)).alias("cell", "m"))
    return pooled.select("vec_id", "cell", rnd("m").alias("mean"), rnd(fx.log_scale(F.col("m"), 10.0)).alias("log_mean"))


@query("x14_message_text", with_views("fall_events", """
SELECT id, '낙상이 감지되었습니다.' || chr(10) || '시각: ' || strftime(occurred_at, '%Y-%m-%d %H:%M:%S') || chr(10) || '확률: ' ||
  CASE WHEN id % 9 = 0 THEN 'N/A' ELSE printf('%.1f', round(confidence * 100, 1)) || '%' END || ' (누적 ' || (id % 5) || '회)' AS message FROM fall_events"""))
def x14(spark, sf):
    return t.fall_events(spark, sf).select("id", fx.notification_text(
        F.col("occurred_at"), F.when(F.col("id") % 9 != 0, F.col("confidence")), F.col("id") % 5).alias("message"))


@query("x15_stable_hashes", """
WITH b AS (SELECT c_nationkey AS arm, c_custkey // 4096 AS block, sha1(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey)) AS h
  FROM customer GROUP BY ALL)
SELECT arm, left(sha1(string_agg(h, ',' ORDER BY block)), 10) AS split_hash FROM b GROUP BY arm""")
def x15(spark, sf):
    return fx.membership_hash(t.table(spark, sf, "customer").withColumnRenamed("c_nationkey", "arm"), ["arm"], "c_custkey").withColumnRenamed("digest", "split_hash")
