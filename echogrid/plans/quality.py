"""Registered queries: filters, predicates, data quality."""

from pyspark.sql import functions as F

from echogrid.functions import scalars as fx
from echogrid.operators import ordered as o
from echogrid.operators import quality as q
from echogrid.registry import query
from echogrid.sources import tables as t
from echogrid.sources.tables import r6, rnd, with_views

HOUR = 3600


@query("f1_recording_filter", with_views("file_index", """
SELECT * FROM file_index WHERE env IN (1, 2) AND activity IN (2, 3, 5) AND is_fall ORDER BY env, subject, activity, trial, recording_id LIMIT 40"""))
def f1(spark, sf):
    return q.recording_filter(t.file_index(spark, sf), env=[1, 2], activity=[2, 3, 5], fall_only=True, max_files=40,
                              order=("env", "subject", "activity", "trial", "recording_id"))


@query("f2_tenant_scope", with_views("devices", """
, s AS (SELECT device_id, CASE WHEN device_id % 3 = 0 THEN NULL ELSE facility_id END AS facility_id, CASE WHEN device_id % 3 = 0 THEN facility_id END AS owner_user_id FROM devices)
SELECT device_id, facility_id, COALESCE(CAST(facility_id AS VARCHAR), 'home-' || owner_user_id) AS tenant FROM s WHERE facility_id = 7"""))
def f2(spark, sf):
    s = t.devices(spark, sf).selectExpr("device_id", "if(device_id % 3 = 0, null, facility_id) AS facility_id", "if(device_id % 3 = 0, facility_id, null) AS owner_user_id")
    return q.tenant_scope(s, facility_id=7).select("device_id", "facility_id", q.tenant_key(F.col("facility_id"), F.col("owner_user_id")).alias("tenant"))


@query("f3_falls_query", with_views("fall_events", """
, f AS (SELECT * FROM fall_events WHERE response = 'ACKNOWLEDGED' AND occurred_at >= '1996-01-01' AND occurred_at <= '1998-12-31')
SELECT id, device_id, resident_id, occurred_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY occurred_at DESC, id DESC LIMIT 50 OFFSET 20"""))
def f3(spark, sf):
    from echogrid.operators.topk import ordered_page

    f = q.falls_query(t.fall_events(spark, sf), response="ACKNOWLEDGED", from_ts="1996-01-01", to_ts="1998-12-31")
    return ordered_page(f.select("id", "device_id", "resident_id", "occurred_at"), "occurred_at", "id", limit=50, offset=20, max_limit=200)


@query("f4_logs_query", with_views("event_logs", """
SELECT id, level, resident_id, n_chars FROM event_logs WHERE level = 'EN' AND msg ILIKE '%the th%'"""))
def f4(spark, sf):
    return q.logs_query(t.event_logs(spark, sf), level="EN", text=" The th ").select("id", "level", "resident_id", "n_chars")


_TENANT_SQL = "'00000000-0000-0000-0000-' || lpad(CAST(n AS VARCHAR), 12, '0')"


@query("f5_identity_check", f"""
WITH m AS (SELECT event_id, event_id % 9 AS bad, user_id, user_id % 25 AS n, event_type FROM events),
p AS (SELECT event_id, bad, CAST(user_id AS VARCHAR) AS dev, {_TENANT_SQL} AS ten FROM m),
x AS (SELECT event_id, CASE bad WHEN 0 THEN 'sense/' || ten || '/' || dev WHEN 1 THEN 'sense/lobby/' || dev || '/presence'
   WHEN 2 THEN 'sense/' || ten || '/' || dev || '/cmd' ELSE 'sense/' || ten || '/' || dev || '/presence' END AS topic,
   CASE bad WHEN 3 THEN 'other' ELSE dev END AS pd, CASE bad WHEN 4 THEN 'other' ELSE ten END AS pt, bad FROM p)
SELECT event_id, CASE bad WHEN 0 THEN 'malformed_topic' WHEN 1 THEN 'bad_tenant' WHEN 2 THEN 'not_uplink' WHEN 3 THEN 'device_mismatch' WHEN 4 THEN 'tenant_mismatch' END AS reject_reason,
  CASE WHEN bad = 0 THEN NULL ELSE split_part(topic, '/', 4) END AS leaf FROM x""")
def f5(spark, sf):
    m = t.table(spark, sf, "events").selectExpr(
        "event_id", "event_id % 9 AS bad", "cast(user_id AS string) AS dev",
        "concat('00000000-0000-0000-0000-', lpad(cast(user_id % 25 AS string), 12, '0')) AS ten")
    msgs = m.selectExpr(
        "event_id",
        "case bad when 0 then concat_ws('/', 'sense', ten, dev) when 1 then concat_ws('/', 'sense', 'lobby', dev, 'presence') "
        "when 2 then concat_ws('/', 'sense', ten, dev, 'cmd') else concat_ws('/', 'sense', ten, dev, 'presence') end AS topic",
        "if(bad = 3, 'other', dev) AS payload_device", "if(bad = 4, 'other', ten) AS payload_tenant")
    return q.identity_check(msgs, "sense").select("event_id", "reject_reason", "leaf")


@query("f6_schema_reject", """
WITH r AS (SELECT event_id, event_id % 10 AS bad FROM events)
SELECT CASE WHEN bad = 0 THEN 'invalid_json' WHEN bad = 1 THEN 'unknown_field' WHEN bad = 2 THEN 'missing_seq' WHEN bad = 3 THEN 'bad_kind'
  WHEN bad = 4 THEN 'bad_value' END AS reject_reason, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY 1""")
def f6(spark, sf):
    raw = t.table(spark, sf, "events").selectExpr("event_id", "event_id % 10 AS bad", "event_type", "value").selectExpr(
        "event_id",
        "case bad when 0 then '{oops' when 1 then concat('{\"seq\":', event_id, ',\"kind\":\"presence\",\"p\":0.5,\"extra\":1}') "
        "when 2 then '{\"kind\":\"presence\",\"p\":0.5}' when 3 then concat('{\"seq\":', event_id, ',\"kind\":\"other\",\"p\":0.5}') "
        "when 4 then concat('{\"seq\":', event_id, ',\"kind\":\"signal\",\"p\":1.5}') "
        "else concat('{\"seq\":', event_id, ',\"kind\":\"signal\",\"p\":', value / 1000.0D, '}') end AS text")
    checked = q.schema_reject(raw, "text", "seq long, kind string, p double", ["seq", "kind"], {
        "bad_kind": F.col("value.kind").isin("presence", "signal", "telemetry", "ack"),
        "bad_value": F.col("value.p").between(0.0, 1.0)})
    return checked.groupBy("reject_reason").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_KIND_SQL = "CASE event_type WHEN 'click' THEN 'presence' WHEN 'view' THEN 'signal' WHEN 'error' THEN 'telemetry' ELSE 'ack' END"


@query("f7_kind_router", f"""
WITH k AS (SELECT {_KIND_SQL} AS kind FROM events)
SELECT CASE kind WHEN 'presence' THEN 'presence_sink' WHEN 'signal' THEN 'scoring' ELSE 'status' END AS destination, kind, count(*) AS n FROM k GROUP BY ALL""")
def f7(spark, sf):
    msgs = t.table(spark, sf, "events").select(F.expr(_KIND_SQL).alias("kind"))
    routed = [df.select(F.lit(name).alias("destination"), "kind") for name, df in q.kind_router(msgs).items()]
    return o.union_all(routed).groupBy("destination", "kind").agg(F.count("*").alias("n"))


@query("f8_label_normalize", """
WITH l AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN ' A10 ' WHEN 3 THEN 'Fall' WHEN 4 THEN 'a3' WHEN 5 THEN 'weird' ELSE 'none' END AS raw FROM lineitem),
n AS (SELECT *, lower(trim(COALESCE(raw, 'none'))) AS label FROM l)
SELECT label, label <> 'weird' AS ok, label IN ('a10','a11','a12','fall','1') AS positive, count(*) AS n FROM n GROUP BY ALL""")
def f8(spark, sf):
    raw = F.expr("case l_linenumber when 1 then null when 2 then ' A10 ' when 3 then 'Fall' when 4 then 'a3' when 5 then 'weird' else 'none' end")
    rows = t.table(spark, sf, "lineitem").select(q.label_normalize(raw).alias("l"))
    return rows.groupBy("l.label", "l.ok", "l.positive").agg(F.count("*").alias("n"))


@query("f9_constraint_audit", with_views("fall_events", """
, v AS (SELECT id, resident_id, confidence, response, facility_id FROM fall_events)
SELECT 'response_enum' AS rule, id AS row_id FROM v WHERE NOT (response IN ('PENDING', 'ACKNOWLEDGED'))
UNION ALL SELECT 'confidence_range', id FROM v WHERE NOT (confidence BETWEEN 0 AND 0.99)
UNION ALL SELECT 'scope_xor', id FROM v WHERE NOT ((facility_id > 3) <> (resident_id > 90))
UNION ALL SELECT 'responder_required', id FROM v WHERE NOT (response = 'PENDING' OR resident_id > 2)"""))
def f9(spark, sf):
    return q.constraint_audit(t.fall_events(spark, sf), "id", {
        "response_enum": F.col("response").isin("PENDING", "ACKNOWLEDGED"),
        "confidence_range": F.col("confidence").between(0.0, 0.99),
        "scope_xor": (F.col("facility_id") > 3) != (F.col("resident_id") > 90),
        "responder_required": (F.col("response") == "PENDING") | (F.col("resident_id") > 2)})


# A device clock that jumps back now and then, built from the event stream.
_JUMPY = "seq, device_id, ts, t_us - (CASE WHEN seq % 7 = 0 THEN 20000000000 ELSE 0 END) AS clock"


@query("f10_drop_nonmonotonic", with_views("packets", f"""
, j AS (SELECT {_JUMPY} FROM packets), l AS (SELECT *, lag(clock) OVER (PARTITION BY device_id ORDER BY seq) AS p FROM j)
SELECT device_id, seq, clock FROM l WHERE p IS NULL OR clock > p"""))
def f10(spark, sf):
    jumpy = t.packets(spark, sf).selectExpr(*_JUMPY_COLS)
    return q.drop_nonmonotonic(jumpy, ["device_id"], ["ts", "seq"], "clock", o.time_chunk("ts", 6 * HOUR)).select("device_id", "seq", "clock")


_JUMPY_COLS = ["seq", "device_id", "ts", "t_us - if(seq % 7 = 0, 20000000000, 0) AS clock"]


@query("f11_sort_unique_time", with_views("packets", """
, c AS (SELECT device_id, seq, t_us // 3600000000 AS hour, value FROM packets),
r AS (SELECT *, row_number() OVER (PARTITION BY device_id, hour ORDER BY seq) AS rn FROM c)
SELECT device_id, hour, seq, value FROM r WHERE rn = 1"""))
def f11(spark, sf):
    rows = t.packets(spark, sf).selectExpr("device_id", "seq", "t_us div 3600000000 AS hour", "value")
    return q.sort_unique_time(rows, ["device_id"], ["seq"], "hour")


@query("f12_truncate_corrupt_tail", with_views("packets", """
, g AS (SELECT device_id, seq, t_us, t_us - lag(t_us) OVER (PARTITION BY device_id ORDER BY seq) AS gap FROM packets),
m AS (SELECT device_id, median(gap) AS med FROM g WHERE gap > 0 GROUP BY device_id),
b AS (SELECT g.*, max(CASE WHEN gap > med * 4 THEN 1 ELSE 0 END) OVER (PARTITION BY g.device_id ORDER BY seq) AS bad FROM g JOIN m ON g.device_id = m.device_id)
SELECT device_id, seq, t_us FROM b WHERE bad = 0"""))
def f12(spark, sf):
    rows = t.packets(spark, sf).select("device_id", "seq", "ts", "t_us")
    return q.truncate_corrupt_tail(rows, ["device_id"], ["ts", "seq"], "t_us", 4.0, o.time_chunk("ts", 6 * HOUR)).select("device_id", "seq", "t_us")


@query("f13_boundary_dedup", with_views("packets", f"""
, p AS (SELECT device_id, seq, t_us // 86400000000 AS part, t_us + (CASE WHEN seq % 5 = 0 THEN 9000000000 ELSE 0 END) AS t FROM packets),
e AS (SELECT device_id, part, max(t) AS hi FROM p GROUP BY ALL),
s AS (SELECT *, max(hi) OVER (PARTITION BY device_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
SELECT p.device_id, p.part, sum(CASE WHEN seen IS NULL OR t > seen THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN seen IS NULL OR t > seen THEN 0 ELSE 1 END)::BIGINT AS dropped,
  min(CASE WHEN seen IS NULL OR t > seen THEN t - seen END) AS boundary_gap FROM p JOIN s ON p.device_id = s.device_id AND p.part = s.part GROUP BY ALL"""))
def f13(spark, sf):
    rows = t.packets(spark, sf).selectExpr("device_id", "seq", "t_us div 86400000000 AS part", "t_us + if(seq % 5 = 0, 9000000000, 0) AS t")
    return q.boundary_stats(rows, ["device_id"], "part", "t")


@query("f14_usable_columns", f"""
WITH f AS (SELECT l_quantity AS a, CASE WHEN l_linenumber = 7 THEN 'nan'::DOUBLE ELSE l_discount END AS b, l_tax AS c, 5.0::DOUBLE AS d FROM lineitem),
g AS (SELECT * FROM f WHERE NOT isnan(b)),
s AS (SELECT count(*) AS rows, stddev_pop(a) AS a, stddev_pop(b) AS b, stddev_pop(c) AS c, stddev_pop(d) AS d FROM g)
SELECT rows, feature, {r6("sd")} AS sd, sd > 1e-12 AS kept FROM s UNPIVOT (sd FOR feature IN (a, b, c, d))""")
def f14(spark, sf):
    rows = t.table(spark, sf, "lineitem").selectExpr("l_quantity AS a", "if(l_linenumber = 7, double('NaN'), l_discount) AS b", "l_tax AS c", "5.0D AS d")
    return q.usable_columns(rows, ["a", "b", "c", "d"]).withColumn("sd", rnd("sd"))


@query("f15_channel_pick", with_views("windows", f"""
, k AS (SELECT CAST(round_even(j * 61 / 19.0, 0) AS INT) AS pos FROM range(0, 20) r(j)),
u AS (SELECT CASE WHEN pos < 31 THEN pos ELSE pos + 2 END AS slot FROM k)
SELECT vec_id, slot, {r6("x[slot + 1]")} AS v FROM windows, u"""))
def f15(spark, sf):
    slots = q.channel_pick(64, [31, 32], 20)
    picked = t.windows(spark, sf).select("vec_id", F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.get("x", F.lit(s)).alias("v")) for s in slots])).alias("p"))
    return picked.select("vec_id", "p.slot", rnd("p.v").alias("v"))


@query("f16_min_slice", with_views("file_index", """
, c AS (SELECT env, activity, subject % 4 AS band, count(*) AS n, sum(CASE WHEN trial % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS positives FROM file_index GROUP BY ALL)
SELECT *, CASE WHEN n < 4 THEN 'too_small' WHEN positives = 0 OR positives = n THEN 'one_class' END AS skip_reason FROM c"""))
def f16(spark, sf):
    rows = t.file_index(spark, sf).selectExpr("env", "activity", "subject % 4 AS band", "trial % 2 = 0 AS y")
    return q.min_slice(rows, ["env", "activity", "band"], "y", 4)


_RECORDS = """c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN 'bad id' ELSE 'r' || (c_custkey % 1490) END AS id,
  CASE c_custkey % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'target' ELSE 'external' END AS role,
  CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE CASE WHEN c_custkey % 20 = 0 THEN 'val' ELSE 'external' END END AS split,
  CASE WHEN c_custkey % 90 = 1 THEN c_custkey - 1 ELSE c_custkey END AS "group", 'p' || (c_custkey % 1495) AS path"""


@query("f17_split_guard", f"""
WITH r AS (SELECT {_RECORDS} FROM customer)
SELECT 'bad_id' AS rule, id AS subject_key FROM r WHERE id = 'bad id'
UNION ALL SELECT 'duplicate_id', id FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'bad_role_split', id FROM r WHERE role = 'external' AND split = 'val'
UNION ALL SELECT 'group_spans_splits', CAST("group" AS VARCHAR) FROM r GROUP BY "group" HAVING count(DISTINCT role || split) > 1
UNION ALL SELECT 'repeated_path', path FROM r GROUP BY path HAVING count(*) > 1""")
def f17(spark, sf):
    r = t.table(spark, sf, "customer").selectExpr(
        "if(c_custkey % 50 = 0, 'bad id', concat('r', c_custkey % 1490)) AS id",
        "case c_custkey % 3 when 0 then 'source' when 1 then 'target' else 'external' end AS role",
        "case c_custkey % 3 when 0 then 'train' when 1 then 'test' else if(c_custkey % 20 = 0, 'val', 'external') end AS split",
        "if(c_custkey % 90 = 1, c_custkey - 1, c_custkey) AS group", "concat('p', c_custkey % 1495) AS path")
    return q.split_guard(r)


@query("f18_frame_usability", """
WITH f AS (SELECT CAST(event_id % 16 AS INT) AS flags FROM events)
SELECT CASE WHEN flags & 1 = 0 THEN 'not_valid' WHEN flags & 6 <> 0 THEN 'diagnostic' END AS reason, count(*) AS n FROM f GROUP BY 1""")
def f18(spark, sf):
    flags = t.table(spark, sf, "events").selectExpr("cast(event_id % 16 AS int) AS flags")
    return flags.groupBy(q.frame_usability(F.col("flags"), 1, 6).alias("reason")).agg(F.count("*").alias("n"))
