"""Registered queries: set operations."""

from pyspark.sql import functions as F

from echogrid.operators import sets as s
from echogrid.plans.ordering import Q_SQL, channel_q
from echogrid.registry import query
from echogrid.sources import tables as t
from echogrid.sources.tables import r6, rnd, with_views


@query("u1_stitch_phases", with_views("samples", f"""
, p AS (SELECT recording_id // 5 AS session, ch, recording_id % 5 AS phase, i, x FROM samples),
z AS (SELECT session, ch, phase, max(i) + 1 AS n FROM p GROUP BY ALL), o AS (SELECT *, COALESCE(sum(n) OVER (PARTITION BY session, ch ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM z)
SELECT p.session, p.ch, p.phase, p.i, st + p.i AS pos, {r6("(st + p.i) / 320.0::DOUBLE")} AS t, {r6("x")} AS x FROM p JOIN o ON o.session = p.session AND o.ch = p.ch AND o.phase = p.phase"""))
def u1(spark, sf):
    """Whole phases of every channel, one after the other on the session's clock."""
    p = t.samples(spark, sf).selectExpr("recording_id div 5 AS session", "ch", "recording_id % 5 AS phase", "i", "x")
    rows, _ = s.stitch_phases(p, ["session", "ch"], "phase", "i", 320.0)
    return rows.select("session", "ch", "phase", "i", "pos", rnd("t").alias("t"), rnd("x").alias("x"))


@query("u2_order_parts", with_views("packets", """
, f AS (SELECT device_id, event_type AS part, min(t_us) AS first_time FROM packets GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY first_time, part) AS position FROM f"""))
def u2(spark, sf):
    return s.order_parts(t.packets(spark, sf), ["device_id"], "event_type", "t_us").withColumnRenamed("event_type", "part")


@query("u3_missing_keys", "SELECT DISTINCT l_orderkey AS k FROM lineitem EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def u3(spark, sf):
    return s.missing_keys(t.table(spark, sf, "lineitem").selectExpr("l_orderkey AS k"), t.table(spark, sf, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS k"), ["k"])


@query("u4_common_keys", "SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def u4(spark, sf):
    return s.common_keys(t.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").selectExpr("l_orderkey AS k"), t.table(spark, sf, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS k"), ["k"])


@query("u5_leakage_canary", with_views("file_index", """
, a AS (SELECT activity AS arm, subject, recording_id AS file, subject * 100 + trial AS session, CASE WHEN recording_id % 10 < 7 THEN 1 ELSE 2 END AS side FROM file_index),
l AS (SELECT arm, side, unnest(['subject', 'file', 'session']) AS level, unnest([subject, file, session]) AS m FROM a), g AS (SELECT arm, level, m FROM l GROUP BY ALL HAVING count(DISTINCT side) = 2)
SELECT arm, count(*) FILTER (level = 'subject') AS subject_overlap, count(*) FILTER (level = 'file') AS file_overlap, count(*) FILTER (level = 'session') AS session_overlap, count(level) = 0 AS ok
FROM (SELECT DISTINCT arm FROM a) LEFT JOIN g USING (arm) GROUP BY arm"""))
def u5(spark, sf):
    a = t.file_index(spark, sf).selectExpr("activity AS arm", "subject", "recording_id AS file", "subject * 100 + trial AS session", "recording_id % 10 < 7 AS tr")
    return s.leakage_canary(a.filter("tr"), a.filter("NOT tr"), "arm", ["subject", "file", "session"])


@query("u6_refit_union", with_views("file_index", "SELECT * FROM file_index WHERE env = 1 UNION ALL SELECT * FROM file_index WHERE env = 2"))
def u6(spark, sf):
    f = t.file_index(spark, sf)
    return s.refit_union(f.filter("env = 1"), f.filter("env = 2"))


@query("u7_four_mode_union", with_views("samples", Q_SQL + f"""
, m AS (SELECT recording_id, ch, q, unnest(['free', 'ant' || (ch % 3) || '_only']) AS selection_mode FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, selection_mode ORDER BY q DESC, ch) AS rank FROM m), h AS (SELECT * FROM r WHERE rank <= 3),
z AS (SELECT *, count(*) OVER w AS n, q / (sum(q) OVER w + 1e-10) AS share FROM h WINDOW w AS (PARTITION BY recording_id, selection_mode)),
f AS (SELECT *, max(CASE WHEN share >= 1.0 / n THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, selection_mode) AS anyp FROM z)
SELECT recording_id, selection_mode, ch, rank, {r6("share")} AS share, (share >= 1.0 / n OR (anyp = 0 AND rank = 1)) AS selected FROM f"""))
def u7(spark, sf):
    u = s.four_mode_union(channel_q(spark, sf), ["recording_id"], "ch", F.col("ch") % 3, 3, 3)
    return u.select("recording_id", "selection_mode", "ch", "rank", rnd("share").alias("share"), "selected")
