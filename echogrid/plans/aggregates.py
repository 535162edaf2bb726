"""Registered queries: aggregations."""

from pyspark.sql import functions as F

from echogrid.operators import aggregates as a
from echogrid.operators import ordered as o
from echogrid.registry import query
from echogrid.sources import tables as t
from echogrid.sources.tables import r6, rnd, with_views

SIX_HOURS = 6 * 3600


def _round(df, *cols, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in cols})


@query("a1_link_summary", f"""
SELECT l_returnflag, l_linestatus, l_linenumber, {r6("avg(l_quantity)")} AS mean, {r6("stddev_samp(l_quantity)")} AS std, min(l_quantity) AS min,
  max(l_quantity) AS max, count(l_quantity) AS count FROM lineitem GROUP BY ALL""")
def a1(spark, sf):
    return _round(a.link_summary(t.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity"), "mean", "std")


@query("a2_multi_dim_stats", f"""
WITH l AS (SELECT unnest(['flag', 'status', 'line']) AS dim, unnest([l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)]) AS level, l_extendedprice AS v FROM lineitem)
SELECT dim, level, count(*) AS n_rows, {r6("avg(v)", 4)} AS mean, {r6("stddev_samp(v)", 4)} AS std, min(v) AS min, max(v) AS max,
  {r6("quantile_cont(v, 0.25)", 4)} AS q25, {r6("quantile_cont(v, 0.5)", 4)} AS median, {r6("quantile_cont(v, 0.75)", 4)} AS q75 FROM l GROUP BY ALL""")
def a2(spark, sf):
    l = t.table(spark, sf, "lineitem").selectExpr("l_returnflag AS flag", "l_linestatus AS status", "l_linenumber AS line", "l_extendedprice AS v")
    return _round(a.multi_dim_stats(l, ["flag", "status", "line"], "v"), "mean", "std", "q25", "median", "q75", digits=4)


_META_COLS = ("device_id, seq, ts, t_us - (CASE WHEN seq % 19 = 0 THEN 9000000000 ELSE 0 END) AS t, value AS agc, seq % 41 AS rssi_a, seq % 37 AS rssi_b, seq % 43 AS rssi_c, "
              "CAST(CASE WHEN device_id % 2 = 0 THEN -127 ELSE -90 - seq % 3 END AS INT) AS noise, seq % 4 AS rate")


@query("a3_recording_metadata", with_views("packets", f"""
, m AS (SELECT {_META_COLS} FROM packets),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY device_id ORDER BY seq) AS gap,
  (CASE WHEN rssi_a > 0 THEN pow(10.0, rssi_a / 10.0) ELSE 0 END) + (CASE WHEN rssi_b > 0 THEN pow(10.0, rssi_b / 10.0) ELSE 0 END) + (CASE WHEN rssi_c > 0 THEN pow(10.0, rssi_c / 10.0) ELSE 0 END) AS mag FROM m),
h AS (SELECT *, CASE WHEN mag > 0 THEN 10 * log10(mag) - 44 - agc END AS rss FROM g),
rc AS (SELECT device_id, rate, row_number() OVER (PARTITION BY device_id ORDER BY count(*) DESC, rate) AS rn FROM h GROUP BY device_id, rate),
s AS (SELECT device_id, count(*) AS n_packets, COALESCE(sum(gap) FILTER (gap > 0) / 1e6, 0) AS duration_sec, avg(gap) FILTER (gap > 0) / 1000 AS mean_gap_ms,
  stddev_pop(gap) FILTER (gap > 0) / avg(gap) FILTER (gap > 0) AS gap_cv, avg(CASE WHEN gap > 14400000000 THEN 1.0 ELSE 0.0 END) FILTER (gap > 0) AS frac_gap_gt_2x,
  count(*) FILTER (gap <= 0) AS n_nonpositive_gaps, COALESCE(count(*) FILTER (gap <= 0) / nullif(count(gap), 0)::DOUBLE, 0) AS frac_nonpositive,
  avg(agc) AS agc_mean, stddev_pop(agc) AS agc_std, min(agc) AS agc_min, max(agc) AS agc_max, avg(rssi_a) AS ra, avg(rssi_b) AS rb, avg(rssi_c) AS rc,
  avg(rss) AS rss_dbm_mean, stddev_pop(rss) AS rss_dbm_std, min(noise) = max(noise) AND min(noise) = -127 AS noise_is_dead,
  quantile_cont(gap, 0.5) FILTER (gap > 0) AS med, quantile_cont(gap, 0.95) FILTER (gap > 0) AS p95 FROM h GROUP BY device_id)
SELECT s.device_id, n_packets, {r6("duration_sec", 3)} AS duration_sec, {r6("mean_gap_ms", 3)} AS mean_gap_ms, {r6("gap_cv")} AS gap_cv, {r6("frac_gap_gt_2x")} AS frac_gap_gt_2x,
  n_nonpositive_gaps, {r6("frac_nonpositive")} AS frac_nonpositive, {r6("agc_mean")} AS agc_mean, {r6("agc_std")} AS agc_std, agc_min, agc_max,
  CASE WHEN ra >= rb AND ra >= rc.rc THEN 0 WHEN rb >= rc.rc THEN 1 ELSE 2 END AS rssi_best_ant, {r6("greatest(ra, rb, rc.rc) - least(ra, rb, rc.rc)")} AS rssi_spread,
  {r6("rss_dbm_mean")} AS rss_dbm_mean, {r6("rss_dbm_std")} AS rss_dbm_std, noise_is_dead, {r6("med / 1000", 2)} AS median_gap_ms, {r6("p95 / 1000", 2)} AS gap_p95_ms,
  {r6("1e6 / med", 9)} AS est_fs_hz, COALESCE(1e6 / med < 0.0002, false) AS is_lowrate, rc2.rate AS rate_mode
FROM s JOIN (SELECT device_id, rc FROM s) rc ON rc.device_id = s.device_id LEFT JOIN rc rc2 ON rc2.device_id = s.device_id AND rc2.rn = 1""".replace("LEFT JOIN rc rc2", "LEFT JOIN rmode rc2").replace("rc AS (SELECT device_id, rate, row", "rmode AS (SELECT device_id, rate, row")))
def a3(spark, sf):
    p = t.packets(spark, sf).selectExpr(
        "device_id", "seq", "ts", "t_us - if(seq % 19 = 0, 9000000000, 0) AS t", "value AS agc", "seq % 41 AS rssi_a", "seq % 37 AS rssi_b", "seq % 43 AS rssi_c",
        "cast(if(device_id % 2 = 0, -127, -90 - seq % 3) AS int) AS noise", "seq % 4 AS rate")
    m = a.recording_metadata(p, ["device_id"], ["ts", "seq"], "t", 7_200_000_000.0, 0.0004, o.time_chunk("ts", SIX_HOURS))
    m = m.drop("rssi_a_mean", "rssi_b_mean", "rssi_c_mean")
    m = _round(m, "gap_cv", "frac_gap_gt_2x", "frac_nonpositive", "agc_mean", "agc_std", "rssi_spread", "rss_dbm_mean", "rss_dbm_std")
    m = _round(m, "duration_sec", "mean_gap_ms", digits=3)
    return _round(_round(m, "median_gap_ms", "gap_p95_ms", digits=2), "est_fs_hz", digits=9)


@query("a4_gap_diagnostics", with_views("packets", """
, g AS (SELECT device_id, t_us - lag(t_us) OVER (PARTITION BY device_id ORDER BY seq) AS gap FROM packets),
s AS (SELECT *, greatest(1, CAST(round_even(gap / 3.6e9, 0) AS BIGINT)) AS steps FROM g), f AS (SELECT *, steps <= 6 AND abs(gap - steps * 3.6e9) <= 1.2e9 AS fits FROM s)
SELECT device_id, count(*) AS row_count, count(gap) AS diff_count, count(*) FILTER (gap <= 0) AS nonpositive_count, count(*) FILTER (gap > 0 AND NOT fits) AS irregular_count,
  COALESCE(sum(steps - 1) FILTER (gap > 0 AND fits), 0)::BIGINT AS missing_steps, count(*) FILTER (gap > 0) AS positive_diff_count FROM f GROUP BY device_id"""))
def a4(spark, sf):
    p = t.packets(spark, sf).select("device_id", "seq", "ts", "t_us")
    return a.gap_diagnostics(p, ["device_id"], ["ts", "seq"], "t_us", 3.6e9, 1.2e9, 6, o.time_chunk("ts", SIX_HOURS))


_PRED = "CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 40 OR (l_linenumber = 3 AND l_quantity > 15) THEN 1 ELSE 0 END AS p"


@query("a5_confusion_metrics", f"""
WITH r AS (SELECT l_returnflag AS grp, {_PRED} FROM lineitem),
c AS (SELECT grp, count(*) FILTER (y=0 AND p=0) AS tn, count(*) FILTER (y=0 AND p=1) AS fp, count(*) FILTER (y=1 AND p=0) AS fn, count(*) FILTER (y=1 AND p=1) AS tp FROM r GROUP BY grp)
SELECT grp, tn, fp, fn, tp, {r6("(tp+tn)/(tn+fp+fn+tp)::DOUBLE")} AS accuracy, {r6("tp/(tp+fp)::DOUBLE")} AS precision, {r6("tp/(tp+fn)::DOUBLE")} AS recall,
  {r6("2*tp/(2*tp+fp+fn)::DOUBLE")} AS f1, {r6("tn/(tn+fn)::DOUBLE")} AS neg_precision, {r6("tn/(tn+fp)::DOUBLE")} AS specificity, {r6("2*tn/(2*tn+fp+fn)::DOUBLE")} AS neg_f1,
  {r6("(tp/(tp+fn)::DOUBLE + tn/(tn+fp)::DOUBLE)/2")} AS balanced_accuracy, {r6("(2*tp/(2*tp+fp+fn)::DOUBLE + 2*tn/(2*tn+fp+fn)::DOUBLE)/2")} AS macro_f1 FROM c""")
def a5(spark, sf):
    r = t.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), *[F.expr(e) for e in _split(_PRED)])
    return _round(a.confusion_metrics(r, ["grp"], "y", "p"), "accuracy", "precision", "recall", "f1", "neg_precision", "specificity", "neg_f1", "balanced_accuracy", "macro_f1")


def _split(text):
    head, tail = text.split(" AS y, ")
    return [f"{head} AS y", tail]


_SCORE = "SELECT l_returnflag AS grp, l_quantity AS score, CASE WHEN (l_partkey * 7 + l_suppkey) % 100 < l_quantity THEN 1 ELSE 0 END AS y FROM lineitem"


def _scores(spark, sf):
    return t.table(spark, sf, "lineitem").selectExpr("l_returnflag AS grp", "l_quantity AS score", "CASE WHEN (l_partkey * 7 + l_suppkey) % 100 < l_quantity THEN 1 ELSE 0 END AS y")


@query("a6_auroc_ap", f"""
WITH s AS ({_SCORE}), d AS (SELECT grp, score, sum(y) AS pos, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w - n AS below, sum(pos) OVER w - pos AS pos_below, sum(n) OVER (PARTITION BY grp) AS total, sum(pos) OVER (PARTITION BY grp) AS pt FROM d WINDOW w AS (PARTITION BY grp ORDER BY score))
SELECT grp, max(pt)::BIGINT AS positives, max(total - pt)::BIGINT AS negatives, {r6("sum(pos * ((below - pos_below) + (n - pos) / 2.0)) / (max(pt) * max(total - pt))::DOUBLE")} AS auroc,
  {r6("sum(pos * (pt - pos_below) / (total - below)::DOUBLE) / max(pt)")} AS ap FROM c GROUP BY grp""")
def a6(spark, sf):
    return _round(a.auroc_ap(_scores(spark, sf), ["grp"], "score", "y"), "auroc", "ap")


@query("a7_oracle_threshold", f"""
WITH s AS ({_SCORE}), th AS (SELECT DISTINCT grp, score AS t FROM s),
b AS (SELECT th.grp, t, (avg(CASE WHEN score >= t THEN 1.0 ELSE 0.0 END) FILTER (y = 1) + avg(CASE WHEN score < t THEN 1.0 ELSE 0.0 END) FILTER (y = 0)) / 2 AS ba FROM th JOIN s ON s.grp = th.grp GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(ba, 12) DESC, t) AS rn FROM b)
SELECT grp, {r6("ba")} AS balanced_accuracy, t AS threshold FROM r WHERE rn = 1""")
def a7(spark, sf):
    return _round(a.oracle_threshold(_scores(spark, sf), ["grp"], "score", "y"), "balanced_accuracy")


@query("a8_recording_rule", f"""
WITH r AS (SELECT l_suppkey AS rec, CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 49 OR (l_suppkey % 4 = 0 AND l_quantity > 48) THEN 1 ELSE 0 END AS p FROM lineitem),
w AS (SELECT rec, max(y) AS y, CASE WHEN sum(p) >= 15 THEN 1 ELSE 0 END AS p FROM r GROUP BY rec),
c AS (SELECT count(*) FILTER (y=0 AND p=0) AS tn, count(*) FILTER (y=0 AND p=1) AS fp, count(*) FILTER (y=1 AND p=0) AS fn, count(*) FILTER (y=1 AND p=1) AS tp FROM w)
SELECT tn, fp, fn, tp, {r6("(tp+tn)/(tn+fp+fn+tp)::DOUBLE")} AS accuracy, {r6("fn/(fn+tp)::DOUBLE")} AS miss_rate, {r6("fp/(fp+tn)::DOUBLE")} AS false_alarm_rate FROM c""")
def a8(spark, sf):
    r = t.table(spark, sf, "lineitem").selectExpr("l_suppkey AS rec", "if(l_suppkey % 4 = 0, 1, 0) AS y", "if(l_quantity > 49 OR (l_suppkey % 4 = 0 AND l_quantity > 48), 1, 0) AS p")
    return _round(a.recording_rule(r, "rec", "y", "p", 15), "accuracy", "miss_rate", "false_alarm_rate").select("tn", "fp", "fn", "tp", "accuracy", "miss_rate", "false_alarm_rate")


@query("a9_unit_mean_score", f"""
SELECT l_orderkey, {r6("avg(l_discount)")} AS score, arg_min(l_returnflag, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100) AS label,
  arg_min(l_suppkey, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100) AS subject FROM lineitem GROUP BY l_orderkey""")
def a9(spark, sf):
    r = t.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_discount AS score", "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS ord", "l_returnflag AS label", "l_suppkey AS subject")
    return _round(a.unit_mean_score(r, "l_orderkey", "score", "ord", ["label", "subject"]), "score")


_TRAIN = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 'nan'::DOUBLE ELSE l_quantity END AS q, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS d, l_tax AS x FROM lineitem"
_TRAIN_COLS = ["l_orderkey", "l_linenumber", "if(l_linenumber = 2, double('NaN'), l_quantity) AS q", "if(l_linenumber = 3, null, l_discount) AS d", "l_tax AS x"]
_FIT_SQL = f"""r AS ({_TRAIN}), f AS (SELECT CASE WHEN isnan(q) THEN NULL ELSE q END AS q, d, x FROM r WHERE l_orderkey % 5 <> 0),
m AS (SELECT median(q) AS q, median(d) AS d, median(x) AS x FROM f),
l AS (SELECT unnest(['q','d','x']) AS "column", unnest([m.q, m.d, m.x]) AS median, unnest([COALESCE(f.q, m.q), COALESCE(f.d, m.d), COALESCE(f.x, m.x)]) AS v FROM f, m),
st AS (SELECT "column", max(median) AS median, avg(v) AS mean, greatest(stddev_pop(v), 1e-6) AS std FROM l GROUP BY 1)"""


@query("a10_normalization_fit", f"""
WITH {_FIT_SQL} SELECT "column", {r6("median")} AS median, {r6("mean")} AS mean, {r6("std")} AS std FROM st
UNION ALL (SELECT 'map', NULL, {r6("avg(v)")}, {r6("stddev_pop(v)")} FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id % 5 <> 0))""")
def a10(spark, sf):
    train = t.table(spark, sf, "lineitem").filter("l_orderkey % 5 <> 0").selectExpr(*_TRAIN_COLS)
    cells = a.fit_map_normalization(t.windows(spark, sf).filter("vec_id % 5 <> 0"), "x").withColumn("column", F.lit("map"))
    return _round(o.union_all([a.fit_scalar_normalization(train, ["q", "d", "x"]), cells]), "median", "mean", "std")


@query("a11_normalization_apply", f"""
WITH {_FIT_SQL}, w AS (SELECT max(CASE WHEN "column"='q' THEN median END) AS mq, max(CASE WHEN "column"='q' THEN mean END) AS aq, max(CASE WHEN "column"='q' THEN std END) AS sq,
  max(CASE WHEN "column"='d' THEN median END) AS md, max(CASE WHEN "column"='d' THEN mean END) AS ad, max(CASE WHEN "column"='d' THEN std END) AS sd FROM st)
SELECT l_orderkey, l_linenumber, {r6("(CASE WHEN isnan(q) THEN mq ELSE q END - aq) / sq")} AS q_z, CASE WHEN isnan(q) THEN 1 ELSE 0 END AS q_missing,
  {r6("(COALESCE(d, md) - ad) / sd")} AS d_z, CASE WHEN d IS NULL THEN 1 ELSE 0 END AS d_missing FROM r, w""")
def a11(spark, sf):
    rows = t.table(spark, sf, "lineitem")
    stats = a.fit_scalar_normalization(rows.filter("l_orderkey % 5 <> 0").selectExpr(*_TRAIN_COLS), ["q", "d"])
    out = a.apply_scalar_normalization(rows.selectExpr(*_TRAIN_COLS), stats, ["q", "d"])
    return _round(out, "q_z", "d_z").select("l_orderkey", "l_linenumber", "q_z", "q_missing", "d_z", "d_missing")


@query("a12_sample_summary", with_views("file_index", """
, c AS (SELECT env || '|' || is_fall AS cell, subject, activity FROM file_index), p AS (SELECT cell, subject, count(*) AS n FROM c GROUP BY ALL)
SELECT p.cell, sum(n)::BIGINT AS n_files, count(*) AS n_subjects, string_agg(printf('S%02d', subject), ', ' ORDER BY subject) AS subjects,
  round(max(n) / sum(n)::DOUBLE, 3) AS max_subject_share, (SELECT count(DISTINCT activity) FROM c WHERE c.cell = p.cell) AS n_activities FROM p GROUP BY p.cell"""))
def a12(spark, sf):
    return a.sample_summary(t.file_index(spark, sf).withColumn("cell", F.concat(F.col("env"), F.lit("|"), F.col("is_fall").cast("string"))), "cell", "subject", "activity")


@query("a13_crosstab", f"""
SELECT l_linenumber, {r6("count(*) FILTER (l_returnflag = 'A') / count(*)::DOUBLE")} AS "A", {r6("count(*) FILTER (l_returnflag = 'N') / count(*)::DOUBLE")} AS "N",
  {r6("count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE")} AS "R", 0.0::DOUBLE AS "X" FROM lineitem GROUP BY 1""")
def a13(spark, sf):
    return _round(a.crosstab(t.table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", ["A", "N", "R", "X"], normalize=True), "A", "N", "R", "X")


@query("a14_group_share", f"SELECT l_returnflag, l_linenumber, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag)::DOUBLE')} AS share FROM lineitem GROUP BY 1, 2")
def a14(spark, sf):
    return _round(a.group_share(t.table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber"), "share")


@query("a15_qc_summary", f"""
SELECT l_linenumber AS env, count(*) AS n, {r6("avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)")} AS padded_rate,
  {r6("avg(CASE WHEN l_discount < 0.01 OR l_discount > 0.9 THEN 1.0 ELSE 0.0 END)")} AS degenerate_rate, {r6("median(l_discount)")} AS ratio, {r6("median(l_tax)")} AS tax,
  {r6("median(l_quantity)")} AS qty FROM lineitem GROUP BY 1""")
def a15(spark, sf):
    r = t.table(spark, sf, "lineitem").selectExpr("l_linenumber AS env", "l_returnflag = 'R' AS padded", "l_discount AS ratio", "l_tax AS tax", "l_quantity AS qty")
    return _round(a.qc_summary(r, "env", "padded", "ratio", ["ratio", "tax", "qty"]), "padded_rate", "degenerate_rate", "ratio", "tax", "qty")


@query("a16_concentration", f"""
WITH v AS (SELECT l_suppkey, l_discount AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount) AS idx, sum(l_discount) OVER (PARTITION BY l_suppkey) AS s,
  count(*) OVER (PARTITION BY l_suppkey) AS n, avg(l_discount) OVER (PARTITION BY l_suppkey) AS m FROM lineitem)
SELECT l_suppkey, {r6("2 * sum(idx * v) / (max(n) * max(s)) - (max(n) + 1) / max(n)::DOUBLE")} AS gini,
  {r6("-sum(CASE WHEN v > 0 THEN v / s * ln(v / s) END) / ln(count(*) FILTER (v > 0))")} AS norm_entropy,
  {r6("exp(-sum(CASE WHEN v > 0 THEN v / s * ln(v / s) END))", 4)} AS effective_rank, {r6("avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3")} AS excess_kurtosis FROM v GROUP BY 1""")
def a16(spark, sf):
    c = a.concentration(t.table(spark, sf, "lineitem").select("l_suppkey", "l_discount"), ["l_suppkey"], "l_discount")
    return _round(_round(c, "gini", "norm_entropy", "excess_kurtosis"), "effective_rank", digits=4)


@query("a17_protocol_summary", f"""
WITH l AS (SELECT l_returnflag AS analysis, l_linestatus AS model, unnest(['qty', 'disc']) AS metric, unnest([l_quantity, l_discount]) AS v FROM lineitem)
SELECT analysis, model, metric, {r6("avg(v)")} AS mean, {r6("stddev_pop(v)")} AS std, min(v) AS min, max(v) AS max, count(v) AS count, {r6("median(v)")} AS median FROM l GROUP BY ALL""")
def a17(spark, sf):
    r = t.table(spark, sf, "lineitem").selectExpr("l_returnflag AS analysis", "l_linestatus AS model", "l_quantity AS qty", "l_discount AS disc")
    return _round(a.protocol_summary(r, ["analysis", "model"], ["qty", "disc"]), "mean", "std", "median")


@query("a18_overlap_record", f"""
WITH r AS (SELECT l_returnflag AS grp, l_linenumber % 2 AS y, CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS a, CASE WHEN l_discount > 0.04 THEN 1 ELSE 0 END AS b FROM lineitem),
c AS (SELECT grp, count(*) AS n, count(*) FILTER (a=y AND b=y) AS bc, count(*) FILTER (a=y AND b<>y) AS ao, count(*) FILTER (a<>y AND b=y) AS bo, count(*) FILTER (a<>y AND b<>y) AS bw, count(*) FILTER (a<>b) AS dis FROM r GROUP BY grp)
SELECT grp, n, bc AS both_correct, ao AS a_only_correct, bo AS b_only_correct, bw AS both_wrong, dis AS disagreement, {r6("(n - bw) / n::DOUBLE")} AS oracle_accuracy,
  {r6("(n - bw) / n::DOUBLE - greatest((bc + ao) / n::DOUBLE, (bc + bo) / n::DOUBLE)")} AS oracle_gain, {r6("bo / greatest(bo + bw, 1)::DOUBLE")} AS b_recovers_a, {r6("ao / greatest(ao + bw, 1)::DOUBLE")} AS a_recovers_b FROM c""")
def a18(spark, sf):
    r = t.table(spark, sf, "lineitem").selectExpr("l_returnflag AS grp", "l_linenumber % 2 AS y", "if(l_quantity > 20, 1, 0) AS a", "if(l_discount > 0.04D, 1, 0) AS b")
    return _round(a.overlap_record(r, ["grp"], "y", "a", "b"), "oracle_accuracy", "oracle_gain", "b_recovers_a", "a_recovers_b")


_LABELLED = """, l AS (SELECT recording_id, ch, i // 16 AS win, i, 'A0' || CAST(floor(abs(x) * 12) AS INT) AS act FROM samples)"""


def _labelled(spark, sf):
    return t.samples(spark, sf).selectExpr("recording_id", "ch", "i div 16 AS win", "i", "concat('A0', cast(floor(abs(x) * 12) AS int)) AS act")


@query("a19_label_composition", with_views("samples", _LABELLED + """
, c AS (SELECT recording_id, ch, win, act, count(*) AS n FROM l GROUP BY ALL), q AS (SELECT *, lag(act) OVER (PARTITION BY recording_id, ch, win ORDER BY i) AS p FROM l)
SELECT a.recording_id, a.ch, a.win, counts_text, sequence_text FROM
 (SELECT recording_id, ch, win, string_agg(act || ':' || n, ';' ORDER BY act) AS counts_text FROM c GROUP BY ALL) a JOIN
 (SELECT recording_id, ch, win, string_agg(act, ';' ORDER BY i) AS sequence_text FROM q WHERE p IS NULL OR p <> act GROUP BY ALL) b USING (recording_id, ch, win)"""))
def a19(spark, sf):
    return a.label_composition(_labelled(spark, sf), ["recording_id", "ch", "win"], "i", "act")


@query("a20_window_majority_label", with_views("samples", _LABELLED + """
, c AS (SELECT recording_id, ch, win, act, count(*) AS n, min(i) AS f, max(CASE WHEN i % 16 = 8 THEN 1 ELSE 0 END) AS h FROM l GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY recording_id, ch, win ORDER BY n DESC, h DESC, f) AS rn FROM c),
z AS (SELECT recording_id, ch, win, max(CASE WHEN h = 1 THEN act END) AS center, arg_min(act, f) FILTER (act IN ('A02', 'A05')) AS ff FROM c GROUP BY ALL)
SELECT m.recording_id, m.ch, m.win, m.act AS majority, center, CASE WHEN center IN ('A02', 'A05') THEN center ELSE COALESCE(ff, center) END AS any_fall
FROM m JOIN z USING (recording_id, ch, win) WHERE rn = 1"""))
def a20(spark, sf):
    return a.window_majority_label(_labelled(spark, sf), ["recording_id", "ch", "win"], "i", "act", F.col("win") * 16 + 8, ["A02", "A05"])


@query("a21_presence_counts", """
SELECT c_nationkey AS facility_id, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS present, count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS absent,
  count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) AS unknown, max(CASE WHEN c_acctbal > 5000 THEN 2 WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS worst FROM customer GROUP BY 1""")
def a21(spark, sf):
    c = t.table(spark, sf, "customer").withColumnRenamed("c_nationkey", "facility_id")
    state = F.expr("CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'PRESENT' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'ABSENT' END")
    return a.presence_counts(c, ["facility_id"], state, F.expr("CASE WHEN c_acctbal > 5000 THEN 2 WHEN c_acctbal > 0 THEN 1 ELSE 0 END"))


@query("a22_recipients_by_resident", with_views("recipients", """
SELECT COALESCE('resident-' || resident_id, 'shared') AS owner, recipient_id, row_number() OVER (PARTITION BY COALESCE('resident-' || resident_id, 'shared') ORDER BY recipient_id) - 1 AS position FROM recipients"""))
def a22(spark, sf):
    return a.recipients_by_resident(t.recipients(spark, sf).select("recipient_id", "resident_id")).select("owner", "recipient_id", "position")


@query("a23_stream_counters", with_views("packets", """
, n AS (SELECT max(ts) AS now FROM packets), l AS (SELECT device_id, max(ts) AS last FROM packets GROUP BY 1)
SELECT event_type AS counter, count(*) FILTER (value < 50) AS a, count(*) FILTER (value >= 50) AS b FROM packets GROUP BY 1
UNION ALL SELECT 'devices', count(*), count(*) FILTER (date_diff('microsecond', last, now) / 1e6 < 43200) FROM l, n"""))
def a23(spark, sf):
    p = t.packets(spark, sf).withColumn("reject", F.when(F.col("value") >= 50, "range"))
    kinds = a.kind_counters(p, "event_type", "reject").toDF("counter", "a", "b")
    return kinds.unionByName(a.device_totals(p, "device_id", "ts", 43_200).toDF("a", "b").withColumn("counter", F.lit("devices")))


@query("a24_link_rate", with_views("packets", f"""
, e AS (SELECT device_id, min(t_us) AS t0, max(t_us) AS t1 FROM packets GROUP BY 1)
SELECT p.device_id, count(*) AS frames, {r6("count(*) FILTER ((t1 - t_us) / 1e6 < 86400) / 86400.0", 9)} AS hz_short,
  {r6("count(*) FILTER ((t1 - t_us) / 1e6 < 432000) / least(432000.0, greatest((max(t1) - max(t0)) / 1e6, 1e-9))", 9)} AS hz_long
FROM packets p JOIN e ON p.device_id = e.device_id GROUP BY p.device_id"""))
def a24(spark, sf):
    return _round(a.link_rate(t.packets(spark, sf).select("device_id", "t_us"), ["device_id"], "t_us", 86_400.0, 432_000.0), "hz_short", "hz_long", digits=9)


@query("a25_detection_rates", f"""
WITH s AS (SELECT l_orderkey AS id, l_quantity AS d FROM lineitem WHERE l_returnflag = 'R'), k AS (SELECT id, count(*) AS k, sum(d) AS d FROM s GROUP BY id)
SELECT o_orderstatus AS grp, count(*) AS files, {r6("avg(CASE WHEN k IS NOT NULL THEN 1.0 ELSE 0.0 END)")} AS detected_share, {r6("COALESCE(sum(k), 0) / count(*)::DOUBLE")} AS segments_per_file,
  {r6("sum(d) / sum(k)")} AS mean_duration FROM orders LEFT JOIN k ON o_orderkey = id GROUP BY 1""")
def a25(spark, sf):
    files = t.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS grp")
    segs = t.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").selectExpr("l_orderkey AS id", "l_quantity AS d")
    return _round(a.detection_rates(files, segs, "id", ["grp"], "d"), "detected_share", "segments_per_file", "mean_duration")


@query("a26_group_profiles", with_views("windows", f"""
, c AS (SELECT label, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS v FROM windows), g AS (SELECT pos, avg(v) AS grand FROM c GROUP BY 1)
SELECT label, CAST(c.pos AS INT) AS pos, {r6("avg(v)")} AS mean, {r6("stddev_pop(v)")} AS sd, {r6("quantile_cont(v, 0.25)")} AS q25, {r6("median(v)")} AS median, {r6("quantile_cont(v, 0.75)")} AS q75,
  {r6("avg(v) - max(grand)")} AS difference FROM c JOIN g ON c.pos = g.pos GROUP BY label, c.pos"""))
def a26(spark, sf):
    return _round(a.group_profiles(t.windows(spark, sf), "label", "x"), "mean", "sd", "q25", "median", "q75", "difference")


@query("a27_ecdf_histogram", f"""
WITH e AS (SELECT l_returnflag AS grp, 'ecdf' AS kind, l_quantity AS at, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT grp, kind, at, sum(n) OVER (PARTITION BY grp ORDER BY at) / sum(n) OVER (PARTITION BY grp)::DOUBLE AS v FROM e),
h AS (SELECT l_returnflag AS grp, log10(l_extendedprice) AS v FROM lineitem WHERE l_extendedprice > 0), b AS (SELECT grp, min(v) AS lo, max(v) AS hi FROM h GROUP BY 1)
SELECT grp, kind, at, {r6("v")} AS v FROM c
UNION ALL SELECT h.grp, 'hist', CAST(least(59, floor((v - lo) / ((hi - lo) / 60))) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM h JOIN b ON h.grp = b.grp GROUP BY ALL""".replace(" AS at", " AS pos").replace(", at,", ", pos,").replace("ORDER BY at", "ORDER BY pos"))
def a27(spark, sf):
    r = t.table(spark, sf, "lineitem").selectExpr("l_returnflag AS grp", "l_quantity", "l_extendedprice")
    e = a.ecdf_points(r, ["grp"], "l_quantity").select("grp", F.lit("ecdf").alias("kind"), F.col("l_quantity").alias("pos"), rnd("cum_share").alias("v"))
    h = a.histogram(r, ["grp"], "l_extendedprice", 60, log10=True).select("grp", F.lit("hist").alias("kind"), F.col("bin").cast("double").alias("pos"), F.col("n").cast("double").alias("v"))
    return e.unionByName(h)


@query("a28_group_linear_fit", f"""
SELECT l_linenumber, {r6("regr_slope(l_extendedprice, l_quantity)", 4)} AS slope, {r6("regr_intercept(l_extendedprice, l_quantity)", 3)} AS intercept, count(*) AS n FROM lineitem GROUP BY 1""")
def a28(spark, sf):
    f = a.group_linear_fit(t.table(spark, sf, "lineitem"), ["l_linenumber"], "l_quantity", "l_extendedprice")
    return _round(_round(f, "slope", digits=4), "intercept", digits=3)


@query("a29_window_scalar_evolution", with_views("windows", f"""
SELECT vec_id, {r6("list_sum(list_transform(x, lambda v: v*v)) / 64")} AS mean_energy, {r6("list_sum(list_transform(x, lambda v: abs(v))) / 64")} AS mean_abs, CAST(vec_id * 0.25 + 1.5 AS DOUBLE) AS center FROM windows"""))
def a29(spark, sf):
    from echogrid.functions import scalars as fx

    x = F.col("x")
    return t.windows(spark, sf).select(
        "vec_id", rnd(fx.array_mean(F.transform(x, lambda v: v * v))).alias("mean_energy"), rnd(fx.array_mean(F.transform(x, lambda v: F.abs(v)))).alias("mean_abs"),
        (F.col("vec_id") * 0.25 + 1.5).alias("center"))
