"""Registered queries: joins."""

from pyspark.sql import functions as F

from echogrid.operators import joins as j
from echogrid.operators import ordered as o
from echogrid.operators import quality as q
from echogrid.registry import query
from echogrid.sources import tables as t
from echogrid.sources.tables import r6, rnd, with_views

SIX_HOURS = 6 * 3600

PRIMARY_SQL = """, ranked AS (SELECT d.device_id, r.resident_id, r.resident_name, r.resident_room,
  row_number() OVER (PARTITION BY d.device_id ORDER BY is_primary DESC, created_rank, r.resident_id) AS rn
  FROM resident_devices d JOIN residents r ON d.resident_id = r.resident_id), pr AS (SELECT * FROM ranked WHERE rn = 1)"""


def _shared_links(spark, sf):
    """Residents linked to more than one device and devices with more than one resident."""
    links = t.resident_devices(spark, sf)
    return links.unionByName(links.selectExpr("(resident_id + 7) % 100 AS resident_id", "device_id", "false AS is_primary"))


_LINKS_SQL = """, links AS (SELECT * FROM resident_devices UNION ALL SELECT (resident_id + 7) % 100, device_id, false FROM resident_devices)"""


@query("j1_primary_resident", with_views("devices resident_devices residents", _LINKS_SQL + PRIMARY_SQL.replace("resident_devices d", "links d") + """
SELECT d.device_id, pr.resident_id, COALESCE(pr.resident_name, d.name) AS resident_name, COALESCE(pr.resident_room, d.room) AS room
FROM devices d LEFT JOIN pr ON d.device_id = pr.device_id"""))
def j1(spark, sf):
    d = t.devices(spark, sf)
    return j.attach_resident(d.select("device_id"), d, _shared_links(spark, sf), t.residents(spark, sf)).drop("facility_id")


@query("j2_recipient_fanout", with_views("fall_events recipients", """
, f AS (SELECT *, count(*) OVER (PARTITION BY CASE WHEN resident_id < 50 THEN 'r' || resident_id ELSE 'd' || device_id END) AS cnt FROM fall_events),
g AS (SELECT id, device_id, facility_id, CASE WHEN resident_id < 50 THEN resident_id END AS rid, cnt FROM f),
p AS (SELECT g.id, r.recipient_id, g.cnt FROM g JOIN recipients r ON r.facility_id = g.facility_id AND (r.resident_id IS NULL OR r.resident_id = g.rid)
  WHERE r.enabled AND r.push AND r.topic IS NOT NULL)
SELECT id, count(*) AS recipients, min(recipient_id) AS first_recipient, max(cnt) AS fall_count FROM p GROUP BY id"""))
def j2(spark, sf):
    falls = t.fall_events(spark, sf).selectExpr("id", "device_id", "facility_id", "if(resident_id < 50, resident_id, null) AS resident_id")
    # pairs grow with falls times recipients of a scope; their totals do not need them one by one
    scopes = j.recipient_fanout(falls, t.recipients(spark, sf), totals={"recipients": F.count("*"), "first_recipient": F.min("recipient_id")})
    return scopes.groupBy("id").agg(F.sum("recipients").alias("recipients"), F.min("first_recipient").alias("first_recipient"), F.max("fall_count").alias("fall_count"))


@query("j3_scope_anti", with_views("devices", "SELECT DISTINCT l_partkey AS device_id FROM lineitem WHERE l_partkey NOT IN (SELECT device_id FROM devices WHERE facility_id < 12)"))
def j3(spark, sf):
    requested = t.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("device_id")).distinct()
    return j.scope_anti(requested, t.devices(spark, sf).filter("facility_id < 12"), "device_id")


@query("j4_dedup_anti", with_views("fall_events", """
, inc AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS seq FROM lineitem), st AS (SELECT id, CAST(id % 7 + 1 AS INT) AS seq FROM fall_events WHERE id % 2 = 0)
SELECT id, seq FROM inc WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.id = inc.id AND st.seq = inc.seq)"""))
def j4(spark, sf):
    incoming = t.table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS seq")
    stored = t.fall_events(spark, sf).filter("id % 2 = 0").selectExpr("id", "cast(id % 7 + 1 AS int) AS seq")
    return j.dedup_anti(incoming, stored, ["id", "seq"])


@query("j5_aligned_pair_join", """
SELECT d.doc_id, l.quality AS label, d.n_chars, (l.quality = d.doc_id % 2) AS label_ok FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.n_chars > 200""")
def j5(spark, sf):
    left = t.table(spark, sf, "labels").selectExpr("doc_id", "quality AS label")
    right = t.table(spark, sf, "documents").filter("n_chars > 200").selectExpr("doc_id", "n_chars", "cast(doc_id % 2 AS int) AS label")
    return j.aligned_pair_join(left, right, "doc_id", "label")


@query("j6_nearest_asof", with_views("packets", """
, b AS (SELECT device_id, min(t_us) AS t0, max(t_us) AS t1 FROM packets GROUP BY 1),
g AS (SELECT device_id, t0 + k * 7200000000 AS t_us FROM b, (SELECT unnest(range(0, (SELECT CAST(max((t1 - t0) / 7200000000) AS BIGINT) + 2 FROM b))) AS k) r WHERE t0 + k * 7200000000 <= t1),
l AS (SELECT g.device_id, g.t_us, p.t_us AS lt, p.seq AS ls FROM g ASOF LEFT JOIN packets p ON g.device_id = p.device_id AND g.t_us >= p.t_us),
r AS (SELECT g.device_id, g.t_us, p.t_us AS rt, p.seq AS rs FROM g ASOF LEFT JOIN packets p ON g.device_id = p.device_id AND g.t_us <= p.t_us)
SELECT l.device_id, l.t_us, CASE WHEN rt IS NULL OR l.t_us - lt <= rt - l.t_us THEN lt ELSE rt END AS source_time,
  CASE WHEN rt IS NULL OR l.t_us - lt <= rt - l.t_us THEN ls ELSE rs END AS seq FROM l JOIN r ON l.device_id = r.device_id AND l.t_us = r.t_us"""))
def j6(spark, sf):
    p = t.packets(spark, sf)
    step = 7_200_000_000
    ends = p.groupBy("device_id").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"))
    grid = ends.select("device_id", F.explode(F.sequence("t0", "t1", F.lit(step))).alias("t_us"))
    return j.nearest_asof(p, grid, ["device_id"], "t_us", ["seq"], F.floor(F.col("t_us") / (SIX_HOURS * 1_000_000)))


# Event runs per recording: stretches of samples above a level; windows of 16 samples every 4.
_RUNS_SQL = """, f AS (SELECT recording_id, i, bool_or(x > 0.3) AS hot FROM samples GROUP BY ALL),
k AS (SELECT *, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS grp FROM f WHERE hot),
ev AS (SELECT recording_id, min(i) AS a, max(i) + 1 AS b FROM k GROUP BY recording_id, grp),
w AS (SELECT DISTINCT recording_id, CAST(s AS INT) AS start FROM samples, range(0, 49, 4) r(s))"""


def _runs(spark, sf):
    flags = t.samples(spark, sf).groupBy("recording_id", "i").agg(F.max(F.col("x") > 0.3).alias("hot"))
    r = o.runs(flags, ["recording_id"], ["i"], F.col("hot"), [F.min("i").alias("a"), (F.max("i") + 1).alias("b")], F.floor(F.col("i") / 4096))
    return r.filter("value").select("recording_id", "a", "b")


def _starts(spark, sf):
    recs = t.windows(spark, sf).select("recording_id").distinct()
    return recs.select("recording_id", F.explode(F.sequence(F.lit(0), F.lit(48), F.lit(4))).alias("start"))


@query("j7_window_event_range", with_views("samples", _RUNS_SQL + """
, h AS (SELECT w.recording_id, start, max(CASE WHEN (a + b - 1) / 2.0 >= start AND (a + b - 1) / 2.0 < start + 16
    AND greatest(0, least(start + 16, b) - greatest(start, a)) / CAST(least(16, b - a) AS DOUBLE) > 0.5 THEN 1 ELSE 0 END) AS y,
  max(CASE WHEN least(start + 16, b + 3) > greatest(start, a - 3) THEN 1 ELSE 0 END) AS guarded
  FROM w LEFT JOIN ev ON w.recording_id = ev.recording_id GROUP BY ALL)
SELECT recording_id, start, CAST(y AS INT) AS y, (y = 1 OR guarded = 0) AS kept FROM h"""))
def j7(spark, sf):
    return j.window_event_labels(_starts(spark, sf), _runs(spark, sf), ["recording_id"], 16, 3)


@query("j8_interval_rules", with_views("samples", _RUNS_SQL + """
SELECT w.recording_id, start, COALESCE(bool_or((a + b - 1) // 2 >= start AND (a + b - 1) // 2 < start + 16), false) AS midpoint,
  COALESCE(bool_or(start <= a AND b <= start + 16), false) AS contains FROM w LEFT JOIN ev ON w.recording_id = ev.recording_id GROUP BY ALL"""))
def j8(spark, sf):
    return j.interval_rules(_starts(spark, sf), _runs(spark, sf), ["recording_id"], 16)


@query("j9_interval_to_grid", with_views("packets", """
, n AS (SELECT device_id, t_us, row_number() OVER (PARTITION BY device_id ORDER BY seq) - 1 AS i, value > 50 AS hot FROM packets),
k AS (SELECT *, i - row_number() OVER (PARTITION BY device_id ORDER BY i) AS grp FROM n WHERE hot),
ev AS (SELECT device_id, min(i) AS a, max(i) + 1 AS b FROM k GROUP BY device_id, grp),
z AS (SELECT device_id, min(t_us) AS t0, max(t_us) AS t1 FROM packets GROUP BY 1)
SELECT ev.device_id, a, b, greatest(0, least(CAST(floor((t1 - t0) * 0.01 / 1e6) AS BIGINT), CAST(round_even((na.t_us - t0) * 0.01 / 1e6, 0) AS BIGINT))) AS ga,
  greatest(0, least(CAST(floor((t1 - t0) * 0.01 / 1e6) AS BIGINT), CAST(round_even((nb.t_us - t0) * 0.01 / 1e6, 0) AS BIGINT))) + 1 AS gb
FROM ev JOIN n na ON na.device_id = ev.device_id AND na.i = ev.a JOIN n nb ON nb.device_id = ev.device_id AND nb.i = ev.b - 1 JOIN z ON z.device_id = ev.device_id"""))
def j9(spark, sf):
    from echogrid.session import materialize

    chunk = o.time_chunk("ts", SIX_HOURS)
    n = materialize(o.number_rows(t.packets(spark, sf), ["device_id"], ["ts", "seq"], "i", chunk))
    ev = o.runs(n, ["device_id"], ["i"], F.col("value") > 50, [F.min("i").alias("a"), (F.max("i") + 1).alias("b")], F.floor(F.col("i") / 4096))
    return j.interval_to_grid(ev.filter("value").select("device_id", "a", "b"), n, ["device_id"], "i", "t_us", 0.01)


# Phases each protocol class asks for.
PROTOCOL = {1: (1, 2, 3), 2: (2, 4), 3: (1, 5, 6, 7)}


@query("j10_session_division", with_views("file_index", """
, s AS (SELECT env, subject, CAST(trial % 3 + 1 AS INT) AS klass, activity % 8 AS phase FROM file_index),
p(klass, phase) AS (VALUES (1,1),(1,2),(1,3),(2,2),(2,4),(3,1),(3,5),(3,6),(3,7)),
d AS (SELECT DISTINCT env, subject, klass FROM s),
m AS (SELECT d.env, d.subject, d.klass, p.phase, s.phase AS got FROM d JOIN p ON d.klass = p.klass
  LEFT JOIN (SELECT DISTINCT * FROM s) s ON s.env = d.env AND s.subject = d.subject AND s.klass = d.klass AND s.phase = p.phase)
SELECT env, subject, klass, count(*) FILTER (got IS NULL) = 0 AS complete,
  COALESCE(string_agg(CAST(phase AS VARCHAR), ',' ORDER BY phase) FILTER (got IS NULL), '') AS missing FROM m GROUP BY env, subject, klass"""))
def j10(spark, sf):
    s = t.file_index(spark, sf).selectExpr("env", "subject", "cast(trial % 3 + 1 AS int) AS klass", "activity % 8 AS phase")
    return j.session_division(s, PROTOCOL, ["env", "subject", "klass"], "klass", "phase")


@query("j11_group_pairs", """
WITH g AS (SELECT DISTINCT l_returnflag AS metric, l_linenumber AS grp FROM lineitem)
SELECT a.metric, a.grp AS group_a, b.grp AS group_b FROM g a JOIN g b ON a.metric = b.metric AND a.grp < b.grp""")
def j11(spark, sf):
    g = t.table(spark, sf, "lineitem").selectExpr("l_returnflag AS metric", "l_linenumber AS grp").distinct()
    return j.group_pairs(g, ["metric"], "grp")


@query("j12_live_overlay", with_views("devices packets", """
, s AS (SELECT device_id, max(ts) AS live_seen, arg_max(event_type, seq) AS state FROM packets GROUP BY 1), n AS (SELECT max(ts) AS now FROM packets)
SELECT d.device_id, d.facility_id, CASE WHEN live_seen IS NULL THEN NULL ELSE date_diff('microsecond', live_seen, now) / 1e6 < 43200 END AS online,
  COALESCE(live_seen, TIMESTAMP '2023-01-01') AS last_seen, upper(state) AS presence FROM devices d CROSS JOIN n LEFT JOIN s ON s.device_id = d.device_id"""))
def j12(spark, sf):
    p = t.packets(spark, sf)
    latest = p.groupBy("device_id").agg(F.max("ts").alias("live_seen"), F.max_by("event_type", "seq").alias("state"))
    d = t.devices(spark, sf).select("device_id", "facility_id", F.lit("2023-01-01").cast("timestamp_ntz").alias("last_seen"))
    d = d.withColumn("now", p.agg(F.max("ts").alias("now")).scalar())
    out = j.live_overlay(d, latest, F.col("now").cast("timestamp"), 43_200)
    return out.select("device_id", "facility_id", "online", "last_seen", "presence")


@query("j13_enrich_metadata", with_views("file_index", """
SELECT l_orderkey, l_linenumber, f.env, f.activity, f.is_fall FROM lineitem LEFT JOIN file_index f ON l_partkey = f.recording_id"""))
def j13(spark, sf):
    rows = t.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey AS recording_id")
    return rows.join(t.file_index(spark, sf).select("recording_id", "env", "activity", "is_fall"), "recording_id", "left").drop("recording_id")


@query("j14_composition_match", f"""
WITH m AS (SELECT l_returnflag AS grp, l_linenumber AS activity, avg(l_quantity) AS m FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linenumber = 7) GROUP BY ALL),
w AS (SELECT l_linenumber AS activity, count(*) AS w FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
SELECT grp, {r6("sum(w * m) / sum(w)")} AS matched_mean, count(*) AS cells FROM m JOIN w ON m.activity = w.activity GROUP BY grp""")
def j14(spark, sf):
    rows = t.table(spark, sf, "lineitem").selectExpr("l_returnflag AS grp", "l_linenumber AS activity", "l_quantity", "l_suppkey")
    cells = rows.filter("NOT (grp = 'R' AND activity = 7)")
    return j.composition_match(cells, rows.filter("l_suppkey % 3 = 0"), "grp", "activity", "l_quantity").withColumn("matched_mean", rnd("matched_mean"))


@query("j15_paired_gap", f"""
WITH s AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'IN' ELSE 'CROSS' END AS arm, l_suppkey AS env, l_linenumber AS rep, avg(l_quantity) AS auc FROM lineitem GROUP BY ALL),
d AS (SELECT a.auc - b.auc AS d FROM s a JOIN s b ON a.env = b.env AND a.rep = b.rep WHERE a.arm = 'IN' AND b.arm = 'CROSS')
SELECT count(*) AS n_pairs, {r6("avg(d)")} AS gap_mean, {r6("stddev_samp(d)")} AS gap_sd, {r6("avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END)")} AS win_rate,
  {r6("quantile_cont(d, 0.025)")} AS gap_lo, {r6("quantile_cont(d, 0.975)")} AS gap_hi, {r6("2.8 * stddev_samp(d) / sqrt(count(*))")} AS mde80,
  abs(avg(d)) < 2.8 * stddev_samp(d) / sqrt(count(*)) AS underpowered FROM d""")
def j15(spark, sf):
    s = t.table(spark, sf, "lineitem").groupBy(
        F.when(F.col("l_returnflag") == "A", "IN").otherwise("CROSS").alias("arm"), F.col("l_suppkey").alias("env"), F.col("l_linenumber").alias("rep")
    ).agg(F.avg("l_quantity").alias("auc"))
    g = j.paired_gap(s, "IN", "CROSS", "auc", ["env", "rep"])
    return g.withColumns({c: rnd(c) for c in ("gap_mean", "gap_sd", "win_rate", "gap_lo", "gap_hi", "mde80")})


@query("j16_cell_template_match", with_views("file_index", """
, w AS (SELECT activity, is_fall, count(*) AS wanted FROM file_index WHERE env = 1 GROUP BY ALL),
p AS (SELECT f.*, row_number() OVER (PARTITION BY activity, is_fall ORDER BY md5('42:' || recording_id), recording_id) AS rn FROM file_index f WHERE env = 2 AND subject <= 20)
SELECT p.recording_id, p.activity, p.subject FROM p JOIN w ON p.activity = w.activity AND p.is_fall = w.is_fall WHERE rn <= wanted"""))
def j16(spark, sf):
    f = t.file_index(spark, sf)
    picked, _ = j.cell_template_match(f.filter("env = 1"), f.filter("env = 2 AND subject <= 20"), ["activity", "is_fall"], "recording_id", 42)
    return picked.select("recording_id", "activity", "subject")


@query("j17_signal_presence_context", with_views("packets", """
SELECT device_id, seq, last_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY seq) AS state_in_force FROM packets"""))
def j17(spark, sf):
    out = j.state_in_force(t.packets(spark, sf).select("device_id", "seq", "ts", "event_type"), ["device_id"], ["ts", "seq"],
                           F.col("event_type").isin("click", "purchase"), F.col("event_type"), o.time_chunk("ts", SIX_HOURS))
    return out.select("device_id", "seq", "state_in_force")


@query("j18_sensor_sessions", """
WITH f AS (SELECT 's' || (c_custkey % 4) || '_' || lpad(CAST(c_custkey // 4 AS VARCHAR), 6, '0') || '_' || lower(c_mktsegment[1:1]) || '.csv' AS path FROM customer),
p AS (SELECT path, regexp_extract(path, '^(s\\d+)_(\\d+)_(\\w+)\\.csv$', 1) AS sensor, regexp_extract(path, '^(s\\d+)_(\\d+)_(\\w+)\\.csv$', 2) AS tag,
  regexp_extract(path, '^(s\\d+)_(\\d+)_(\\w+)\\.csv$', 3) AS suffix FROM f)
SELECT tag, suffix, string_agg(sensor || '=' || path, ';' ORDER BY sensor) AS paths, count(*) AS sensors FROM p GROUP BY tag, suffix""")
def j18(spark, sf):
    files = t.table(spark, sf, "customer").selectExpr(
        "concat('s', c_custkey % 4, '_', lpad(cast(c_custkey div 4 AS string), 6, '0'), '_', lower(substr(c_mktsegment, 1, 1)), '.csv') AS path")
    s = j.sensor_sessions(files, r"^(s\d+)_(\d+)_(\w+)\.csv$")
    text = F.array_join(F.transform(F.map_entries("paths"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return s.select("tag", "suffix", text.alias("paths"), "sensors").orderBy(F.col("tag").desc())
