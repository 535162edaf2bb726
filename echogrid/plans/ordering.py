"""Registered queries: sorting, limits, top-k, sampling."""

from pyspark.sql import functions as F

from echogrid.operators import ordered as o
from echogrid.operators import series as w
from echogrid.operators import topk as k
from echogrid.registry import query
from echogrid.sources import tables as t
from echogrid.sources.tables import r6, rnd, with_views


@query("t1_ordered_page", """
SELECT o_orderkey, o_orderdate, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200 OFFSET 100""")
def t1(spark, sf):
    return k.ordered_page(t.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "o_orderkey", 200, 100, max_limit=500)


# q per channel: moving variance over +-3 samples, its maximum over its mean.
Q_SQL = """, mv AS (SELECT recording_id, ch, i, greatest(avg(x * x) OVER w - pow(avg(abs(x)) OVER w, 2), 0) AS v FROM samples
  WINDOW w AS (PARTITION BY recording_id, ch ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
q AS (SELECT recording_id, ch, max(v) / greatest(avg(v), 1e-8) AS q FROM mv GROUP BY ALL)"""


def channel_q(spark, sf):
    return w.q_metric(t.samples(spark, sf), ["recording_id", "ch"], "i", "x", 3)


@query("t2_topk_streams", with_views("samples", Q_SQL + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY q DESC, ch) AS rank FROM q), h AS (SELECT * FROM r WHERE rank <= 6),
s AS (SELECT *, q / (sum(q) OVER (PARTITION BY recording_id) + 1e-10) AS share FROM h), f AS (SELECT *, max(CASE WHEN share >= 1.0 / 6 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id) AS anyp FROM s)
SELECT recording_id, ch, rank, {r6("q")} AS q, {r6("share")} AS share, (share >= 1.0 / 6 OR (anyp = 0 AND rank = 1)) AS selected FROM f"""))
def t2(spark, sf):
    s = k.topk_streams(channel_q(spark, sf), ["recording_id"], "ch", 6)
    return s.select("recording_id", "ch", "rank", rnd("q").alias("q"), rnd("share").alias("share"), "selected")


@query("t3_argmax_peak", with_views("samples", f"""
SELECT recording_id, ch, arg_max(i, ord) AS peak, {r6("max(x)")} AS peak_value FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, ch ORDER BY x, i DESC) AS ord FROM samples) GROUP BY ALL"""))
def t3(spark, sf):
    return k.argmax_peak(t.samples(spark, sf), ["recording_id", "ch"], "i", "x").withColumn("peak_value", rnd("peak_value"))


@query("t4_crop_around_peak", with_views("samples", f"""
, v AS (SELECT recording_id, ch, i, x, greatest(avg(x * x) OVER w - pow(avg(abs(x)) OVER w, 2), 0) AS mv FROM samples WINDOW w AS (PARTITION BY recording_id, ch ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
s AS (SELECT *, round(sum(mv) OVER (PARTITION BY recording_id, ch ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 12) AS e FROM v),
p AS (SELECT recording_id, ch, arg_max(i, ord) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, ch ORDER BY e, i DESC) AS ord FROM s) GROUP BY ALL),
b AS (SELECT *, CASE WHEN peak - 10 < 0 THEN 0 WHEN peak + 10 > 64 THEN 44 ELSE peak - 10 END AS crop_start FROM p)
SELECT b.recording_id, b.ch, peak, CAST(crop_start AS INT) AS crop_start, CAST(s.i - crop_start AS INT) AS pos, {r6("s.x")} AS x FROM b JOIN s ON s.recording_id = b.recording_id AND s.ch = b.ch AND s.i >= crop_start AND s.i < crop_start + 20"""))
def t4(spark, sf):
    out = w.crop_around_peak(t.samples(spark, sf), ["recording_id", "ch"], "i", "x", 20, 2, 4)
    return out.select("recording_id", "ch", "peak", "crop_start", "pos", rnd("x").alias("x"))


@query("t5_stratified_sample", with_views("file_index", """
, h AS (SELECT *, md5('7:' || recording_id) AS hr, md5('7:' || subject) AS hs FROM file_index),
d AS (SELECT *, row_number() OVER (PARTITION BY env, is_fall, subject ORDER BY hr, recording_id) AS depth FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY env, is_fall ORDER BY depth, hs, subject) AS rn FROM d WHERE depth <= 25)
SELECT env, is_fall, recording_id, subject, depth, rn FROM r WHERE rn <= 25"""))
def t5(spark, sf):
    return k.balanced_sample(t.file_index(spark, sf), ["env", "is_fall"], "subject", "recording_id", 25, 7).select("env", "is_fall", "recording_id", "subject", "depth", "rn")


@query("t5_cell_sample", with_views("file_index", """
, r AS (SELECT env, is_fall, recording_id, row_number() OVER (PARTITION BY env, is_fall ORDER BY md5('7:' || recording_id), recording_id) AS rn FROM file_index)
SELECT env, is_fall, recording_id, rn FROM r WHERE rn <= 25"""))
def t5_cells(spark, sf):
    return k.stratified_sample(t.file_index(spark, sf), ["env", "is_fall"], "recording_id", 25, 7).select("env", "is_fall", "recording_id", "rn")


@query("t6_even_subsample", with_views("packets", """
, n AS (SELECT device_id, seq, row_number() OVER (PARTITION BY device_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY device_id) AS n FROM packets),
p AS (SELECT DISTINCT device_id, CAST(round_even(j * (n - 1) / 8.0::DOUBLE, 0) AS BIGINT) AS pos FROM n, range(0, 9) r(j))
SELECT n.device_id, n.seq, n.i FROM n LEFT JOIN p ON p.device_id = n.device_id AND p.pos = n.i WHERE n.n <= 9 OR p.pos IS NOT NULL"""))
def t6(spark, sf):
    return k.even_subsample(t.packets(spark, sf).select("device_id", "seq"), ["device_id"], ["seq"], 9).select("device_id", "seq", "i")


@query("t7_split_assign", with_views("file_index", """
, x AS (SELECT recording_id, env, CASE env WHEN 1 THEN 'source' WHEN 2 THEN 'target' ELSE 'external' END AS role FROM file_index),
r AS (SELECT *, row_number() OVER (PARTITION BY env, role ORDER BY md5('3:' || recording_id), recording_id) - 1 AS rank, count(*) OVER (PARTITION BY env, role) AS n FROM x),
p AS (SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS INT)) AS part FROM r)
SELECT recording_id, role, rank, n, CASE WHEN role = 'external' THEN 'external' WHEN rank < part THEN 'val' WHEN role = 'target' AND rank < 2 * part THEN 'test' ELSE 'train' END AS split FROM p"""))
def t7(spark, sf):
    role = F.expr("CASE env WHEN 1 THEN 'source' WHEN 2 THEN 'target' ELSE 'external' END")
    return k.split_assign(t.file_index(spark, sf), ["env"], "recording_id", role, 3).select("recording_id", "role", "rank", "n", "split")


@query("t7_label_split", with_views("file_index", """
, x AS (SELECT recording_id, env, is_fall, CASE env WHEN 1 THEN 'source' WHEN 2 THEN 'target' ELSE 'external' END AS role FROM file_index),
r AS (SELECT *, row_number() OVER (PARTITION BY env, is_fall, role ORDER BY md5('3:' || recording_id), recording_id) - 1 AS rank, count(*) OVER (PARTITION BY env, is_fall, role) AS n FROM x),
p AS (SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS INT)) AS part FROM r)
SELECT recording_id, is_fall, role, rank, n, CASE WHEN role = 'external' THEN 'external' WHEN n < CASE role WHEN 'target' THEN 3 ELSE 2 END THEN 'too_few'
  WHEN rank < part THEN 'val' WHEN role = 'target' AND rank < 2 * part THEN 'test' ELSE 'train' END AS split FROM p"""))
def t7_labels(spark, sf):
    role = F.expr("CASE env WHEN 1 THEN 'source' WHEN 2 THEN 'target' ELSE 'external' END")
    return k.split_assign(t.file_index(spark, sf), ["env", "is_fall"], "recording_id", role, 3).select("recording_id", "is_fall", "role", "rank", "n", "split")


@query("t7_leave_env_out", with_views("file_index", """
, r AS (SELECT recording_id, env, row_number() OVER (PARTITION BY env ORDER BY md5('3:' || recording_id), recording_id) - 1 AS rank, count(*) OVER (PARTITION BY env) AS n FROM file_index),
f AS (SELECT DISTINCT env AS fold FROM file_index WHERE env IS NOT NULL)
SELECT fold, recording_id, CASE WHEN env = fold THEN 'test' WHEN rank < greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM r, f WHERE env IS NOT NULL"""))
def t7_folds(spark, sf):
    return k.leave_one_out(t.file_index(spark, sf), "env", "recording_id", 3).select("fold", "recording_id", "split")


@query("t8_recent_history", with_views("packets", """
, r AS (SELECT device_id, seq, ts, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) AS rn FROM packets) SELECT * FROM r WHERE rn <= 20"""))
def t8(spark, sf):
    return k.bounded_top(t.packets(spark, sf).select("device_id", "seq", "ts"), ["device_id"], [F.col("ts").desc(), F.col("seq").desc()], 20)


@query("t9_first_per_cell", with_views("file_index", """
, r AS (SELECT *, row_number() OVER (PARTITION BY activity, env ORDER BY subject, recording_id) AS rn FROM file_index WHERE trial = 3) SELECT activity, env, recording_id, subject FROM r WHERE rn = 1"""))
def t9(spark, sf):
    f = t.file_index(spark, sf).filter("trial = 3")
    first = f.groupBy("activity", "env").agg(F.min(F.struct("subject", "recording_id")).alias("m"))
    return first.select("activity", "env", "m.recording_id", "m.subject")
