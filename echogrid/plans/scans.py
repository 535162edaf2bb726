"""Registered queries: scans, decoders, signatures, caches, pluggable functions."""

from pyspark.sql import functions as F

from echogrid.functions import scalars as fx
from echogrid.registry import query
from echogrid.session import scratch_path
from echogrid.sources import recordings as rec
from echogrid.sources import scoring
from echogrid.sources import tables as t
from echogrid.sources.tables import r6, rnd, with_views

FS = 20.0


@query("s1_recording_index", with_views("file_index", "SELECT printf('E%d_S%02d_C%02d_A%02d_T%02d.csv', env, subject, 1, activity, trial) AS path, env, subject, 1 AS class_id, activity, trial, is_fall FROM file_index"))
def s1(spark, sf):
    names = t.file_index(spark, sf).select(F.concat(fx.recording_name("env", "subject", F.lit(1), "activity", "trial"), F.lit(".csv")).alias("path"))
    return rec.recording_index(names, "path")


@query("s2_lab_csv_scan", with_views("windows", f"""
, c AS (SELECT vec_id, unnest(range(0, 60)) AS k, list_transform(x, lambda v: CAST(round(v * 100) AS INT)) AS n FROM windows)
SELECT vec_id AS timestamp_low, {r6("sum(sqrt(CAST(n[k+1] * n[k+1] + n[64-k] * n[64-k] AS DOUBLE)))")} AS amplitude, 90 AS cells FROM c GROUP BY vec_id"""))
def s2(spark, sf):
    cells = rec.lab_cells()
    n = t.windows(spark, sf).select("vec_id", F.transform("x", lambda v: F.round(v * 100).cast("int")).alias("n"))
    text = [F.concat(F.get("n", F.lit(k)), F.lit("+"), F.get("n", F.lit(63 - k)), F.lit("i")).alias(c) if k < 60 else F.lit(None).cast("string").alias(c) for k, c in enumerate(cells)]
    path = scratch_path(spark, "lab")
    n.select(F.col("vec_id").alias("timestamp_low"), *text).write.csv(path, header=True)
    rows = rec.lab_csv_scan(spark, path)
    total = fx.array_sum(F.transform("iq", lambda c: F.hypot(c["re"], c["im"])))
    return rows.select("timestamp_low", rnd(total).alias("amplitude"), F.size("iq").alias("cells"))


@query("s3_inhouse_csv_scan", with_views("windows", f"""
, f AS (SELECT vec_id, recording_id % 12 + 1 AS take, recording_id, CASE WHEN vec_id % 17 = 0 THEN false ELSE true END AS ok, CASE WHEN vec_id % 10 < 4 THEN 'a' || (10 + recording_id % 3) ELSE 'none' END AS label FROM windows),
s AS (SELECT recording_id, max(take) AS take, count(*) AS packets, count(*) FILTER (NOT ok) AS rejected, (max(vec_id) - min(vec_id)) * 0.02::DOUBLE AS span, max(label) FILTER (label <> 'none') AS file_label, count(*) FILTER (label <> 'none') AS n_label_rows FROM f GROUP BY 1)
SELECT 'P' || recording_id || 'S1C1F2-1Q' || take || '_labeled.csv' AS file, take, packets, rejected, n_label_rows, file_label, {r6("(packets - 1) / span")} AS fs_hz_eff,
  COALESCE(file_label <> (CASE take WHEN 1 THEN 'a10' WHEN 2 THEN 'a10' WHEN 3 THEN 'a11' WHEN 4 THEN 'a11' WHEN 5 THEN 'a12' WHEN 6 THEN 'a12' END), false) AS label_mismatch FROM s"""))
def s3(spark, sf):
    csi = F.to_json(F.transform(F.sequence(F.lit(0), F.when(F.col("vec_id") % 17 == 0, 488).otherwise(489)), lambda k: F.round(F.get("x", k % 64) * 100).cast("int")))
    rows = t.windows(spark, sf).select(
        F.concat(F.lit("P"), "recording_id", F.lit("S1C1F2-1Q"), F.col("recording_id") % 12 + 1, F.lit("_labeled.csv")).alias("file"),
        (F.col("vec_id") * 20_000).alias("dev_timestamp"), csi.alias("csi"),
        F.when(F.col("vec_id") % 10 < 4, F.concat(F.lit("a"), 10 + F.col("recording_id") % 3)).otherwise("none").alias("label"))
    path = scratch_path(spark, "inhouse")
    rows.write.csv(path, header=True, escape='"')
    s = rec.inhouse_summary(rec.inhouse_csv_scan(spark, path), "dev_timestamp", "dev_timestamp")
    return s.select("file", "take", "packets", "rejected", "n_label_rows", "file_label", rnd("fs_hz_eff").alias("fs_hz_eff"), "label_mismatch")


@query("s4_amplitude_scan", """
SELECT CASE WHEN vec_id % 9 = 0 THEN 'bad_width' WHEN label > 1 THEN 'bad_label' END AS reject_reason, count(*) AS n FROM embeddings GROUP BY 1""")
def s4(spark, sf):
    rows = t.windows(spark, sf).select(F.when(F.col("vec_id") % 9 == 0, F.slice("x", 1, 63)).otherwise(F.col("x")).alias("amplitude"), "label")
    return rec.amplitude_scan(rows, "amplitude", "label", (64,)).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("s8_manifest", with_views("samples", f"""
SELECT recording_id, concat_ws('; ', CASE WHEN max(CASE WHEN x > 0.45 THEN 1 ELSE 0 END) = 1 THEN 'clipped' END, CASE WHEN max(CASE WHEN recording_id % 11 = 3 THEN 1 ELSE 0 END) = 1 THEN 'bad id' END) AS error_msg,
  count(*) AS rows, {r6("avg(x)")} AS mean, {r6("max(x)")} AS peak, CASE WHEN max(x) > 0.45 OR recording_id % 11 = 3 THEN 'error' ELSE 'ok' END AS status FROM samples GROUP BY recording_id"""))
def s8(spark, sf):
    m = rec.manifest(t.samples(spark, sf), ["recording_id"], {"clipped": F.col("x") > 0.45, "bad id": F.col("recording_id") % 11 == 3},
                     {"rows": F.count("*"), "mean": F.avg("x"), "peak": F.max("x")})
    return m.withColumns({"mean": rnd("mean"), "peak": rnd("peak")})


@query("s9_frame_decode", with_views("windows", f"""
, n AS (SELECT vec_id, list_transform(x, lambda v: CAST(round(v * 100) AS INT)) AS n FROM windows)
SELECT vec_id, CASE WHEN vec_id % 11 = 1 THEN 'bad_length' WHEN vec_id % 7 = 0 THEN 'bad_checksum' END AS reject_reason,
  CASE WHEN vec_id % 11 <> 1 AND vec_id % 7 <> 0 THEN vec_id END AS seq, CASE WHEN vec_id % 11 <> 1 AND vec_id % 7 <> 0 THEN
  {r6("list_sum(list_transform(range(0, 32), lambda k: sqrt(CAST(n[2*k+1]*n[2*k+1] + n[2*k+2]*n[2*k+2] AS DOUBLE))))", 3)} END AS total FROM n"""))
def s9(spark, sf):
    n = t.windows(spark, sf).select("vec_id", F.transform("x", lambda v: F.round(v * 100).cast("int")).alias("iq"))
    frames = rec.encode_frames(n, "vec_id", "iq")
    damaged = F.when(F.col("vec_id") % 11 == 1, F.substring("frame", 1, 20)).when(
        F.col("vec_id") % 7 == 0, F.concat(F.expr("substring(frame, 1, length(frame) - 1)"), F.unhex(F.lit("FF")))).otherwise(F.col("frame"))
    d = rec.decode_frames(frames.withColumn("frame", damaged))
    return d.select("vec_id", "reject_reason", "seq", rnd(fx.array_sum(F.col("amps")), 3).alias("total"))


@query("s10_signal_decode", with_views("windows", f"""
SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'length_mismatch' END AS reject_reason, CASE WHEN vec_id % 13 <> 0 THEN {r6("list_sum(x)")} END AS total FROM windows"""))
def s10(spark, sf):
    rows = t.windows(spark, sf).select("vec_id", rec.encode_signal(F.col("x")).alias("signal_b64"), F.when(F.col("vec_id") % 13 == 0, 63).otherwise(64).alias("signal_len"))
    d = rec.decode_signal(rows, "signal_b64", "signal_len")
    return d.select("vec_id", "reject_reason", rnd(fx.array_sum(F.transform("signal", lambda v: v.cast("double")))).alias("total"))


@query("s11_input_signature", """
WITH h AS (SELECT sha256(doc_id || ':' || sha256(text)) AS h FROM documents)
SELECT sha256(count(*) || ':' || """ + " || ':' || ".join(f"sum(CAST('0x' || h[{1 + 8 * k}:{8 + 8 * k}] AS BIGINT))" for k in range(8)) + """ || '#' || '{"fs":20}') AS signature, count(*) AS inputs FROM h""")
def s11(spark, sf):
    return rec.input_signature(t.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", '{"fs":20}')


@query("s12_retention", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events) GROUP BY 1")
def s12(spark, sf):
    kept = rec.retained(t.table(spark, sf, "events").select("ts"), "ts", 10)
    return kept.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("s13_upsert_cache", """
WITH a AS (SELECT l_orderkey AS k, arg_max(l_quantity, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100) AS v FROM lineitem GROUP BY 1)
SELECT k, v FROM a UNION ALL SELECT -o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT -o_orderkey, 1.0 FROM orders WHERE o_orderkey % 3 = 0""")
def s13(spark, sf):
    rows = t.table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS version", "l_quantity AS v", "l_linenumber")
    latest = rec.upsert_cache(rows.filter("l_linenumber <= 3").drop("l_linenumber"), rows.filter("l_linenumber > 3").drop("l_linenumber"), ["k"], "version").select("k", "v")
    stored = t.table(spark, sf, "orders").selectExpr("-o_orderkey AS k", "o_totalprice AS v")
    incoming = t.table(spark, sf, "orders").filter("o_orderkey % 3 = 0").selectExpr("-o_orderkey AS k", "1.0D AS v")
    return latest.unionByName(rec.replace_long(stored, incoming, ["k"]))


_WEIGHTS = [0.1 * (k % 7) - 0.3 for k in range(64)]


@query("v1_pluggable_scorer", with_views("windows", f"""
, w AS (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda k: x[k+1] * (0.1::DOUBLE * (k % 7) - 0.3::DOUBLE))) AS s FROM windows)
SELECT vec_id, {r6("1 / (1 + exp(-(s + 0.2)))")} AS proba_fall, CASE WHEN vec_id % 4 = 0 THEN 0.5::DOUBLE ELSE 0.468::DOUBLE END AS threshold, 'linear-1' AS model_version FROM w"""))
def v1(spark, sf):
    rows = t.windows(spark, sf).select("vec_id", "x", F.when(F.col("vec_id") % 4 == 0, F.lit(0.5)).alias("override"))
    s = scoring.score(rows, "x", scoring.linear_scorer(_WEIGHTS, 0.2), "linear-1", t.THRESHOLD, "override")
    return s.select("vec_id", rnd("proba_fall").alias("proba_fall"), "threshold", "model_version")


@query("v2_recording_probe", with_views("windows", f"""
SELECT vec_id, CASE WHEN vec_id % 23 = 0 THEN NULL ELSE {r6("list_max(x) - list_min(x)")} END AS spread, CASE WHEN vec_id % 23 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN vec_id % 23 = 0 THEN 'ValueError: broken recording' END AS error_msg FROM windows"""))
def v2(spark, sf):
    def probe(record: dict) -> dict:
        if record["vec_id"] % 23 == 0:
            raise ValueError("broken recording")
        return {"spread": float(max(record["x"]) - min(record["x"]))}

    p = scoring.probe_each(t.windows(spark, sf).select("vec_id", "x"), probe, "spread double", ["vec_id"])
    return p.withColumn("spread", rnd("spread"))


@query("v3_feature_registry", with_views("windows", f"""
, e AS (SELECT vec_id, x, list_transform(x, lambda v: abs(v)) AS m FROM windows)
SELECT vec_id, {r6("list_sum(list_transform(x, lambda v: v * v))")} AS energy, {r6("-list_sum(list_transform(m, lambda v: v / list_sum(m) * ln(v / list_sum(m)))) / ln(64)")} AS entropy FROM e"""))
def v3(spark, sf):
    w = t.windows(spark, sf).select("vec_id", "x")
    for kind in ("energy", "entropy"):
        w = scoring.extract(w, "x", FS, kind)
    return w.select("vec_id", rnd("energy").alias("energy"), rnd("entropy").alias("entropy"))


@query("v4_aggregate_functions", with_views("windows", f"""
, e AS (SELECT vec_id, list_sort(list_transform(x, lambda v: abs(v))) AS m FROM windows)
SELECT vec_id, {r6("2 * list_sum(list_transform(range(1, 65), lambda k: k * m[k])) / (64 * list_sum(m)) - 65 / 64.0::DOUBLE")} AS gini FROM e"""))
def v4(spark, sf):
    return scoring.extract(t.windows(spark, sf).select("vec_id", "x"), "x", FS, "gini").select("vec_id", rnd("gini").alias("gini"))
