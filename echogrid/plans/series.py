"""Registered queries: ordered window functions."""

from pyspark.sql import functions as F

from echogrid.functions import scalars as fx
from echogrid.operators import ordered as o
from echogrid.operators import series as w
from echogrid.registry import query
from echogrid.session import materialize
from echogrid.sources import tables as t
from echogrid.sources.tables import r6, rnd, with_views

SIX_HOURS = 6 * 3600
CH = ["recording_id", "ch"]
NEAR = "(PARTITION BY recording_id, ch ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


def _chunk():
    return o.time_chunk("ts", SIX_HOURS)


def _indexed(spark, sf, *extra):
    """Device series with a dense row number (events are ordered by time)."""
    p = t.packets(spark, sf).selectExpr("device_id", "seq", "ts", "t_us", "value", *extra)
    return materialize(o.number_rows(p, ["device_id"], ["ts", "seq"], "i", _chunk()))


@query("w1_moving_stats", with_views("samples", f"""
SELECT recording_id, ch, i, {r6("avg(x) OVER w")} AS mean, {r6("greatest(avg(x*x) OVER w - pow(avg(x) OVER w, 2), 0)")} AS variance FROM samples WINDOW w AS {NEAR}"""))
def w1(spark, sf):
    return w.moving_stats(t.samples(spark, sf), CH, "i", "x", 3).select(*CH, "i", rnd("mean").alias("mean"), rnd("variance").alias("variance"))


_PAD = """, p AS (SELECT recording_id, ch, j AS i, x FROM samples, LATERAL (SELECT unnest(CASE WHEN i = 0 THEN [-4,-3,-2,-1,0] WHEN i = 63 THEN [63,64,65,66,67] ELSE [i] END) AS j)),
mv AS (SELECT recording_id, ch, i, x, (avg(x*x) OVER w - pow(avg(abs(x)) OVER w, 2)) * 9 / 8 AS v FROM p WINDOW w AS (PARTITION BY recording_id, ch ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))"""


@query("w2_moving_variance_padded", with_views("samples", _PAD + f" SELECT recording_id, ch, i, {r6('v')} AS variance FROM mv WHERE i BETWEEN 0 AND 63"))
def w2(spark, sf):
    s = t.samples(spark, sf).withColumn("x", F.abs("x"))
    return w.moving_variance_padded(s, CH, "i", "x", 4).select(*CH, "i", rnd("variance").alias("variance"))


@query("w3_moving_sum", with_views("samples", f"SELECT recording_id, ch, i, {r6('sum(x) OVER w')} AS s FROM samples WINDOW w AS {NEAR}"))
def w3(spark, sf):
    return w.moving_stats(t.samples(spark, sf), CH, "i", "x", 3).select(*CH, "i", rnd("sum").alias("s"))


@query("w4_q_metric", with_views("samples", _PAD + f"""
, a AS (SELECT recording_id, ch, max(v) / avg(v) AS q FROM mv WHERE i BETWEEN 0 AND 63 GROUP BY ALL),
m2 AS (SELECT recording_id, ch, i, greatest(avg(x*x) OVER w - pow(avg(abs(x)) OVER w, 2), 0) AS v FROM samples WINDOW w AS {NEAR}),
b AS (SELECT recording_id, ch, max(v) / greatest(avg(v), 1e-8) AS q FROM m2 GROUP BY ALL)
SELECT recording_id, ch, {r6("a.q")} AS q_padded, {r6("b.q")} AS q_truncated FROM a JOIN b USING (recording_id, ch)"""))
def w4(spark, sf):
    s = t.samples(spark, sf)
    a = w.q_metric_padded(s, CH, "i", "x", 4).withColumnRenamed("q", "q_padded")
    return a.join(w.q_metric(s, CH, "i", "x", 3).withColumnRenamed("q", "q_truncated"), CH).withColumns({c: rnd(c) for c in ("q_padded", "q_truncated")})


_WRAPPED = "device_id, seq, ts, (t_us // 20) % 4294967296 AS clock"


@query("w5_unwrap_clock", with_views("packets", f"""
, c AS (SELECT {_WRAPPED} FROM packets), g AS (SELECT *, clock - lag(clock) OVER (PARTITION BY device_id ORDER BY seq) AS gap FROM c),
s AS (SELECT *, sum(CASE WHEN gap < -2147483648 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY seq)::BIGINT AS wraps,
  sum(CASE WHEN gap < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY seq)::BIGINT AS back FROM g)
SELECT device_id, seq, wraps, clock + wraps * 4294967296 AS unwrapped, clock + back * 4294967296 AS unwrapped_any FROM s"""))
def w5(spark, sf):
    c = t.packets(spark, sf).selectExpr("device_id", "seq", "ts", "(t_us div 20) % 4294967296 AS clock")
    one = w.unwrap_clock(c, ["device_id"], ["ts", "seq"], "clock", chunk=_chunk())
    two = w.unwrap_clock(c, ["device_id"], ["ts", "seq"], "clock", any_backward=True, chunk=_chunk()).select("device_id", "seq", F.col("unwrapped").alias("unwrapped_any"))
    return one.select("device_id", "seq", "wraps", "unwrapped").join(two, ["device_id", "seq"])


@query("w6_device_reset_epochs", with_views("packets", """
, c AS (SELECT device_id, seq, (t_us - (CASE WHEN seq % 41 = 0 THEN 3600000000000 ELSE 0 END)) / 1e6 AS t FROM packets), g AS (SELECT *, t - lag(t) OVER (PARTITION BY device_id ORDER BY seq) AS gap FROM c)
SELECT device_id, seq, sum(CASE WHEN gap IS NOT NULL AND NOT (gap BETWEEN -0.5 AND 86400) THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY seq)::BIGINT AS epoch FROM g"""))
def w6(spark, sf):
    c = t.packets(spark, sf).selectExpr("device_id", "seq", "ts", "(t_us - if(seq % 41 = 0, 3600000000000, 0)) / 1e6D AS t")
    return w.reset_epochs(c, ["device_id"], ["ts", "seq"], "t", ahead_s=86_400.0, chunk=_chunk()).select("device_id", "seq", "epoch")


@query("w7_repair_gaps", with_views("packets", f"""
, c AS (SELECT device_id, seq, t_us - (CASE WHEN seq % 7 = 0 THEN 20000000000 ELSE 0 END) AS t FROM packets), g AS (SELECT *, t - lag(t) OVER (PARTITION BY device_id ORDER BY seq) AS gap FROM c)
SELECT device_id, seq, COALESCE(gap <= 0, false) AS repaired, {r6("sum(CASE WHEN gap IS NULL THEN 0 WHEN gap <= 0 THEN 1e6 ELSE gap END) OVER (PARTITION BY device_id ORDER BY seq)", 1)} AS clock FROM g"""))
def w7(spark, sf):
    c = t.packets(spark, sf).selectExpr("device_id", "seq", "ts", "t_us - if(seq % 7 = 0, 20000000000, 0) AS t")
    return w.repair_gaps(c, ["device_id"], ["ts", "seq"], "t", 1e6, _chunk()).select("device_id", "seq", "repaired", rnd("clock", 1).alias("clock"))


_RUNS = """, n AS (SELECT device_id, value > 40 AS f, row_number() OVER (PARTITION BY device_id ORDER BY seq) - 1 AS i FROM packets),
k AS (SELECT device_id, i, i - row_number() OVER (PARTITION BY device_id ORDER BY i) AS grp FROM n WHERE f), r AS (SELECT device_id, min(i) AS a, max(i) + 1 AS b FROM k GROUP BY device_id, grp)"""


@query("w8_runs", with_views("packets", _RUNS + " SELECT * FROM r"))
def w8(spark, sf):
    return w.true_runs(_indexed(spark, sf), ["device_id"], "i", F.col("value") > 40)


@query("w9_longest_run", with_views("packets", _RUNS + ", z AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY b - a DESC, a) AS rn FROM r) SELECT device_id, a, b FROM z WHERE rn = 1"))
def w9(spark, sf):
    return w.longest_run(w.true_runs(_indexed(spark, sf), ["device_id"], "i", F.col("value") > 40), ["device_id"])


@query("w10_segments", with_views("samples", f"""
, s AS (SELECT recording_id, ch, i, i / 16.0::DOUBLE AS t, abs(x) AS v FROM samples), k AS (SELECT *, i - row_number() OVER (PARTITION BY recording_id, ch ORDER BY i) AS grp FROM s WHERE v > 0.1),
g AS (SELECT recording_id, ch, min(t) AS s, max(t) AS e, avg(v) AS q FROM k GROUP BY recording_id, ch, grp), f AS (SELECT * FROM g WHERE e - s >= 0.0625),
l AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY recording_id, ch ORDER BY s) <= 0.25 THEN 0 ELSE 1 END AS nw FROM f),
m AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id, ch ORDER BY s) AS grp FROM l),
a AS (SELECT recording_id, ch, min(s) AS s, max(e) AS e, list_reduce(list(q ORDER BY s), lambda x, y: (x + y) / 2) AS q FROM m GROUP BY recording_id, ch, grp)
SELECT recording_id, ch, {r6("CASE WHEN e - s > 0.5 THEN (s + e) / 2 - 0.25 ELSE s END")} AS start_s, {r6("CASE WHEN e - s > 0.5 THEN (s + e) / 2 + 0.25 ELSE e END")} AS end_s,
  {r6("CASE WHEN e - s > 0.5 THEN 0.5 ELSE e - s END")} AS duration, {r6("q")} AS avg FROM a"""))
def w10(spark, sf):
    s = t.samples(spark, sf).selectExpr("recording_id", "ch", "i", "i / 16.0D AS t", "abs(x) AS v")
    return w.threshold_segments(s, CH, "i", "t", "v", 0.1, 0.0625, 0.25, 0.5).withColumns({c: rnd(c) for c in ("start_s", "end_s", "duration", "avg")})


@query("w11_minmax_motion", with_views("samples", _PAD + f"""
, o AS (SELECT * FROM mv WHERE i BETWEEN 0 AND 63), q AS (SELECT recording_id, ch, max(v) / avg(v) AS q FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY q DESC, ch) AS rn FROM q),
a AS (SELECT o.recording_id, o.i, avg(v) AS m FROM o JOIN r ON o.recording_id = r.recording_id AND o.ch = r.ch WHERE rn <= 4 GROUP BY ALL)
SELECT recording_id, i, {r6("(m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w)")} AS mv_norm FROM a WINDOW w AS (PARTITION BY recording_id)"""))
def w11(spark, sf):
    return w.minmax_motion(t.samples(spark, sf), ["recording_id"], "ch", "i", "x", 4, 4).select("recording_id", "i", rnd("mv_norm").alias("mv_norm"))


@query("w12_centered_mode", with_views("packets", """
, n AS (SELECT device_id, seq, CASE WHEN value > 30 THEN 1 ELSE 0 END AS f FROM packets),
v AS (SELECT *, sum(f) OVER a AS s5, count(*) OVER a AS c5, sum(f) OVER b AS s4, count(*) OVER b AS c4 FROM n
 WINDOW a AS (PARTITION BY device_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), b AS (PARTITION BY device_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING))
SELECT device_id, seq, CASE WHEN c5 < 5 THEN f WHEN 2 * s5 > 5 THEN 1 ELSE 0 END AS mode5, CASE WHEN c4 < 4 OR 2 * s4 = 4 THEN f WHEN 2 * s4 > 4 THEN 1 ELSE 0 END AS mode4 FROM v"""))
def w12(spark, sf):
    n = _indexed(spark, sf, "if(value > 30, 1, 0) AS f")
    five = w.centered_mode(n, ["device_id"], "i", "f", 5).select("device_id", "seq", F.col("mode").alias("mode5"))
    return five.join(w.centered_mode(n, ["device_id"], "i", "f", 4).select("device_id", "seq", F.col("mode").alias("mode4")), ["device_id", "seq"])


@query("w13_causal_majority", with_views("inference", """
, n AS (SELECT device_id, seq, CASE WHEN proba_fall >= 0.468 THEN 1 ELSE 0 END AS raw FROM inference),
v AS (SELECT *, sum(raw) OVER a AS s, count(*) OVER a AS c FROM n WINDOW a AS (PARTITION BY device_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT device_id, seq, raw, CASE WHEN c = 5 AND s >= 3 THEN 1 ELSE 0 END AS majority FROM v"""))
def w13(spark, sf):
    n = _indexed(spark, sf, "if(least(value / 100.0D, 1.0D) >= 0.468D, 1, 0) AS raw")
    return w.causal_majority(n, ["device_id"], "i", "raw").select("device_id", "seq", "raw", "majority")


@query("w14_weighted_smooth", with_views("packets", f"""
, l AS (SELECT device_id, seq, value AS v, lag(value) OVER w AS a, lag(value, 2) OVER w AS b FROM packets WINDOW w AS (PARTITION BY device_id ORDER BY seq))
SELECT device_id, seq, {r6("CASE WHEN b IS NOT NULL THEN 0.4*v+0.3*a+0.3*b WHEN a IS NOT NULL THEN 0.6*v+0.4*a ELSE v END")} AS smoothed FROM l"""))
def w14(spark, sf):
    return w.weighted_smooth(_indexed(spark, sf), ["device_id"], "i", "value").select("device_id", "seq", rnd("smoothed").alias("smoothed"))


@query("w15_debounce_confirm", with_views("packets", """
, a AS (SELECT device_id, seq, t_us, value > 20 AS active FROM packets), g AS (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY seq) AS grp FROM a),
m AS (SELECT *, min(CASE WHEN active THEN t_us END) OVER (PARTITION BY device_id, grp) AS st FROM g)
SELECT device_id, seq, active, (active AND (t_us - st) / 1e6 >= 21600) AS confirmed FROM m"""))
def w15(spark, sf):
    p = t.packets(spark, sf).select("device_id", "seq", "ts", "t_us", "value")
    return w.debounce_confirm(p, ["device_id"], ["ts", "seq"], "t_us", F.col("value") > 20, 21_600, chunk=_chunk()).select("device_id", "seq", "active", "confirmed")


_REFLECT = "abs(CASE WHEN {k} > 63 THEN 126 - ({k}) ELSE {k} END)"


@query("w16_hampel", with_views("windows", f"""
, s AS (SELECT vec_id, x, CAST(unnest(range(0, 64)) AS INT) AS i FROM windows),
n AS (SELECT vec_id, i, x[i + 1] AS v, list_transform(range(i - 2, i + 3), lambda k: x[{_REFLECT.format(k="k")} + 1]) AS near FROM s),
m AS (SELECT *, list_sort(near)[3] AS med FROM n), d AS (SELECT *, list_sort(list_transform(near, lambda u: abs(u - med)))[3] AS mad FROM m)
SELECT vec_id, i, {r6("CASE WHEN abs(v - med) > 3 * 1.4826 * greatest(mad, 1e-8) THEN med ELSE v END")} AS y FROM d"""))
def w16(spark, sf):
    return t.windows(spark, sf).select("vec_id", F.posexplode(w.hampel(F.col("x"), 5)).alias("i", "y")).withColumn("y", rnd("y"))


@query("w17_savgol2", with_views("windows", f"""
, s AS (SELECT vec_id, x, CAST(unnest(range(0, 64)) AS INT) AS i FROM windows)
SELECT vec_id, i, {r6(f"list_sum(list_transform(range(-3, 4), lambda k: 3.0 * (35 - 5 * k * k) / 315 * x[{_REFLECT.format(k='(i + k)')} + 1]))")} AS y FROM s"""))
def w17(spark, sf):
    return t.windows(spark, sf).select("vec_id", F.posexplode(w.savgol2(F.col("x"), 7)).alias("i", "y")).withColumn("y", rnd("y"))


@query("w18_difference_detrend", with_views("samples", f"""
, a AS (SELECT recording_id * 10 + ch AS vec_id, i, x, lag(x) OVER (PARTITION BY recording_id, ch ORDER BY i) AS p, avg(x) OVER (PARTITION BY recording_id, ch) AS m,
  regr_slope(x, 2.0 * i / 63 - 1) OVER (PARTITION BY recording_id, ch) AS slope FROM samples)
SELECT vec_id, i, {r6("COALESCE(x - p, 0)")} AS diff, {r6("x - m")} AS centered, {r6("x - m - slope * (2.0 * i / 63 - 1)")} AS detrended FROM a"""))
def w18(spark, sf):
    x = F.col("x")
    z = t.windows(spark, sf).select("vec_id", F.posexplode(F.arrays_zip(w.difference(x).alias("d"), w.center(x).alias("c"), w.detrend(x).alias("t"))).alias("i", "z"))
    return z.select("vec_id", "i", rnd("z.d").alias("diff"), rnd("z.c").alias("centered"), rnd("z.t").alias("detrended"))


@query("w19_native_rate", with_views("packets", f"""
, g AS (SELECT device_id, t_us - lag(t_us) OVER (PARTITION BY device_id ORDER BY seq) AS gap FROM packets), m AS (SELECT device_id, median(gap) AS med FROM g WHERE gap > 0 GROUP BY 1)
SELECT device_id, {r6("med", 1)} AS median_gap, {r6("1e11 / med")} AS fs, greatest(round_even(1e11 / med / 0.25, 0) * 0.25::DOUBLE, 0.25::DOUBLE) AS fs_grid FROM m"""))
def w19(spark, sf):
    p = t.packets(spark, sf).select("device_id", "seq", "ts", "t_us")
    return w.native_rate(p, ["device_id"], ["ts", "seq"], "t_us", _chunk(), unit=1e11).withColumns({"median_gap": rnd("median_gap", 1), "fs": rnd("fs")})


@query("w20_avg_rank", "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS avg_rank FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)")
def w20(spark, sf):
    r = t.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return o.average_rank(r, ["l_returnflag"], "l_quantity").drop("l_quantity")


@query("w21_bh_fdr", f"""
WITH p AS (SELECT o_orderkey AS id, o_orderstatus AS fam, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE pow(o_totalprice / 500001.0::DOUBLE, 4) END AS p FROM orders),
r AS (SELECT *, p * count(p) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p NULLS LAST, id) AS raw FROM p)
SELECT id, fam, {r6("CASE WHEN p IS NOT NULL THEN least(1e0, min(raw) OVER (PARTITION BY fam ORDER BY p DESC NULLS FIRST, id DESC)) END")} AS q_value FROM r""")
def w21(spark, sf):
    p = t.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS fam", "if(o_orderkey % 10 = 0, null, pow(o_totalprice / 500001.0D, 4)) AS p")
    return w.bh_fdr(p, ["fam"], "p", "id").select("id", "fam", rnd("q_value").alias("q_value"))


@query("w22_trial_block", with_views("file_index", "SELECT recording_id, trial, CASE WHEN trial <= 6 THEN 'early' WHEN trial <= 13 THEN 'mid' ELSE 'late' END AS block FROM file_index"))
def w22(spark, sf):
    return t.file_index(spark, sf).select("recording_id", "trial", w.trial_block(F.col("trial")).alias("block"))


_PEAKS = _PAD + """,
v AS (SELECT recording_id, ch, i, greatest(v, 0) AS v FROM mv WHERE i BETWEEN 0 AND 63),
q AS (SELECT recording_id, ch, CASE WHEN avg(v) < 1e-10 THEN 0.0 ELSE max(v) / avg(v) END AS q FROM v GROUP BY ALL), l AS (SELECT recording_id, quantile_cont(q, 0.75) AS lim FROM q GROUP BY 1),
a AS (SELECT v.recording_id, i, avg(v) AS m FROM v JOIN q ON q.recording_id = v.recording_id AND q.ch = v.ch JOIN l ON l.recording_id = v.recording_id WHERE q > lim GROUP BY ALL),
n AS (SELECT *, lag(m) OVER w AS lo, lead(m) OVER w AS hi, avg(m) OVER g + stddev_pop(m) OVER g AS level, max(i) OVER g AS last FROM a WINDOW w AS (PARTITION BY recording_id ORDER BY i), g AS (PARTITION BY recording_id)),
c AS (SELECT recording_id, i, last, row_number() OVER (PARTITION BY recording_id ORDER BY m DESC, i DESC) AS rn FROM n WHERE m > lo AND m > hi AND m >= level),
r(recording_id, rn, kept) AS (SELECT recording_id, rn, [i] FROM c WHERE rn = 1
  UNION ALL SELECT r.recording_id, c.rn, CASE WHEN len(list_filter(r.kept, lambda k: abs(k - c.i) < 10)) = 0 THEN list_append(r.kept, c.i) ELSE r.kept END FROM r JOIN c ON c.recording_id = r.recording_id AND c.rn = r.rn + 1),
f AS (SELECT recording_id, unnest(arg_max(kept, rn)) AS peak FROM r GROUP BY 1), e AS (SELECT recording_id, max(i) AS last FROM a GROUP BY 1)
SELECT f.recording_id, CAST(peak AS INT) AS peak, CAST(greatest(0, peak - 5) AS INT) AS a, CAST(least(last, peak + 20) AS INT) AS b FROM f JOIN e ON e.recording_id = f.recording_id"""


@query("w23_peak_segments", with_views("samples", _PEAKS, recursive=True))
def w23(spark, sf):
    return w.peak_segments(t.samples(spark, sf), ["recording_id"], "ch", "i", "x", 4, 10, 5, 20)
