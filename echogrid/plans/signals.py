"""Registered queries: windows, resampling, window features."""

from pyspark.sql import functions as F

from echogrid.functions import scalars as fx
from echogrid.operators import joins as j
from echogrid.operators import ordered as o
from echogrid.operators import series as w
from echogrid.operators import signals as g
from echogrid.plans.joins import _runs
from echogrid.plans.ordering import Q_SQL, channel_q
from echogrid.plans.series import _indexed
from echogrid.registry import query
from echogrid.sources import tables as t
from echogrid.sources.tables import r6, rnd, with_views

SIX_HOURS = 6 * 3600
FS = 20.0  # nominal rate of the packed 64-sample windows


def _chunk():
    return o.time_chunk("ts", SIX_HOURS)


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in cols})


@query("g1_sliding_windows", with_views("packets", f"""
, n AS (SELECT device_id, value, row_number() OVER (PARTITION BY device_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY device_id) AS len FROM packets),
s AS (SELECT DISTINCT device_id, CAST(round_even(k * 4.5::DOUBLE, 0) AS BIGINT) AS start FROM n, (SELECT unnest(range(0, (SELECT CAST(max(len / 4.5) AS BIGINT) + 2 FROM n))) AS k) r WHERE round_even(k * 4.5::DOUBLE, 0) + 16 <= len)
SELECT s.device_id, s.start, count(*) AS rows, {r6("avg(value)")} AS mean FROM s JOIN n ON n.device_id = s.device_id AND n.i >= s.start AND n.i < s.start + 16 GROUP BY ALL"""))
def g1(spark, sf):
    win = g.assign_windows(_indexed(spark, sf), ["device_id"], "i", 16, 4.5)
    return win.groupBy("device_id", "start").agg(F.count("*").alias("rows"), rnd(F.avg("value")).alias("mean"))


@query("g2_time_windows", with_views("packets", f"""
, e AS (SELECT device_id, min(t_us) AS t0, max(t_us) AS t1 FROM packets GROUP BY 1),
k AS (SELECT device_id, k, t0 + k * 43200000000 AS start FROM e, (SELECT unnest(range(0, (SELECT CAST(max((t1 - t0) / 43200000000) AS BIGINT) + 2 FROM e))) AS k) r WHERE t0 + k * 43200000000 + 259200000000 <= t1)
SELECT k.device_id, k.k, k.start, count(*) AS rows, {r6("avg(value)")} AS mean FROM k JOIN packets p ON p.device_id = k.device_id AND p.t_us >= k.start AND p.t_us < k.start + 259200000000 GROUP BY ALL HAVING count(*) >= 5"""))
def g2(spark, sf):
    p = t.packets(spark, sf).select("device_id", "t_us", "value")
    return _rounded(g.time_windows(p, ["device_id"], "t_us", 259_200_000_000, 43_200_000_000, [F.avg("value").alias("mean")], 5), "mean")


@query("g3_resample_uniform", with_views("packets", f"""
, n AS (SELECT device_id, t_us, value, lag(t_us) OVER w AS pt, lag(value) OVER w AS pv, min(t_us) OVER (PARTITION BY device_id) AS t0, max(t_us) OVER (PARTITION BY device_id) AS t1 FROM packets WINDOW w AS (PARTITION BY device_id ORDER BY seq)),
d AS (SELECT DISTINCT device_id, t0, t1 FROM n), k AS (SELECT device_id, k, t0 + k * 5400000000 AS pos FROM d, (SELECT unnest(range(0, (SELECT CAST(max((t1 - t0) / 5400000000) AS BIGINT) + 2 FROM d))) AS k) r WHERE t0 + k * 5400000000 <= t1)
SELECT k.device_id, k.k, {r6("CASE WHEN pt IS NULL THEN value ELSE pv + (value - pv) * ((pos - pt) / (t_us - pt)::DOUBLE) END")} AS value
FROM k ASOF JOIN n ON n.device_id = k.device_id AND k.pos <= n.t_us"""))
def g3(spark, sf):
    p = t.packets(spark, sf).select("device_id", "seq", "ts", "t_us", "value")
    r = g.resample_uniform(p, ["device_id"], ["ts", "seq"], "t_us", ["value"], 5.4e9, _chunk())
    return r.select("device_id", "k", rnd("value").alias("value"))


@query("g4_resample_gap_fill", with_views("packets", f"""
, n AS (SELECT device_id, seq, t_us, value, event_type, lag(t_us) OVER w AS pt, lag(value) OVER w AS pv, lag(event_type) OVER w AS pl FROM packets WINDOW w AS (PARTITION BY device_id ORDER BY seq)),
s AS (SELECT *, t_us - pt AS gap, greatest(1, CAST(round_even((t_us - pt) / 3.6e9, 0) AS BIGINT)) AS st FROM n),
f AS (SELECT *, COALESCE(gap > 0 AND st <= 12 AND abs(gap - st * 3.6e9) <= 1.2e9, false) AS fits FROM s),
e AS (SELECT *, unnest(range(1, CASE WHEN fits THEN st + 1 ELSE 2 END)) AS step, CASE WHEN fits THEN st ELSE 1 END AS n FROM f)
SELECT device_id, seq, step, CASE WHEN step < n THEN 'interp' WHEN gap IS NULL OR fits THEN 'raw' WHEN gap <= 0 THEN 'nonpositive' ELSE 'irregular' END AS kind,
  {r6("CASE WHEN step < n THEN (1 - step / n::DOUBLE) * pv + step / n::DOUBLE * value ELSE value END")} AS value, CASE WHEN step < n AND step / n::DOUBLE < 0.5 THEN pl ELSE event_type END AS event_type FROM e"""))
def g4(spark, sf):
    p = t.packets(spark, sf).select("device_id", "seq", "ts", "t_us", "value", "event_type")
    r = g.resample_gap_fill(p, ["device_id"], ["ts", "seq"], "t_us", "value", "event_type", 3.6e9, 1.2e9, 12, _chunk())
    return _rounded(r, "value").select("device_id", "seq", "step", "kind", "value", "event_type")


@query("g5_rescale_resample", with_views("packets", f"""
, n AS (SELECT device_id, t_us, value, lag(t_us) OVER w AS pt, lag(value) OVER w AS pv, min(t_us) OVER (PARTITION BY device_id) AS t0, max(t_us) OVER (PARTITION BY device_id) AS t1 FROM packets WINDOW w AS (PARTITION BY device_id ORDER BY seq)),
m AS (SELECT device_id, t_us, value, pt, pv, (t_us - t0) * 49 AS st FROM n WHERE t1 > t0), d AS (SELECT DISTINCT device_id, t0, t1 FROM n WHERE t1 > t0),
k AS (SELECT device_id, k, k * (t1 - t0) AS sp, t0 + k * (t1 - t0) / 49.0::DOUBLE AS pos FROM d, range(0, 50) r(k))
SELECT k.device_id, k.k, {r6("CASE WHEN pt IS NULL THEN value ELSE pv + (value - pv) * ((pos - pt) / (t_us - pt)) END")} AS value FROM k ASOF JOIN m ON m.device_id = k.device_id AND k.sp <= m.st"""))
def g5(spark, sf):
    p = t.packets(spark, sf).select("device_id", "seq", "ts", "t_us", "value")
    return _rounded(g.rescale_resample(p, ["device_id"], ["ts", "seq"], "t_us", ["value"], 50, _chunk()), "value")


@query("g6_fixed_length", with_views("windows", f"""
, c AS (SELECT vec_id, x[1:40 + vec_id % 40] AS y FROM windows), e AS (SELECT vec_id, y, CAST(unnest(range(0, 60)) AS INT) AS pos FROM c)
SELECT vec_id, pos, {r6("y[least(pos + 1, len(y))]")} AS v FROM e"""))
def g6(spark, sf):
    y = g.fixed_length(F.slice("x", F.lit(1), (40 + F.col("vec_id") % 40).cast("int")), 60)
    return _rounded(t.windows(spark, sf).select("vec_id", F.posexplode(y).alias("pos", "v")), "v")


@query("g7_bandpass")
def g7(spark, sf):
    f = g.bandpass(t.windows(spark, sf).select("vec_id", "x"), "x", FS, 0.5, 8.0)
    return _rounded(f.select("vec_id", F.posexplode("x").alias("i", "y")), "y")


def _packed(spark, sf):
    return g.pack_channels(t.windows(spark, sf), ["recording_id"], "ch", "x")


@query("g8_component_signal", with_views("samples", f"""
, c AS (SELECT recording_id, ch, i, x - avg(x) OVER (PARTITION BY recording_id, ch) AS c FROM samples) SELECT recording_id, {r6("sum(c * c)")} AS energy, 64 AS samples, 0.0::DOUBLE AS signal_mean FROM c GROUP BY 1"""))
def g8(spark, sf):
    s = g.select_component_signal(_packed(spark, sf), FS, 8)
    return s.select("recording_id", rnd("energy").alias("energy"), F.size("signal").alias("samples"), rnd(fx.array_mean(F.col("signal"))).alias("signal_mean"))


@query("g9_covariance", with_views("samples", f"""
SELECT a.recording_id, a.ch AS ch_a, b.ch AS ch_b, {r6("covar_samp(a.x, b.x)", 8)} AS cov FROM samples a JOIN samples b ON a.recording_id = b.recording_id AND a.i = b.i AND a.ch <= b.ch GROUP BY ALL"""))
def g9(spark, sf):
    return _rounded(g.channel_covariance(t.windows(spark, sf), ["recording_id"], "ch", "x"), "cov", digits=8)


@query("g9_component_eigenvalues", with_views("samples", f"""
, v AS (SELECT recording_id, ch, var_samp(x) AS v FROM samples GROUP BY ALL) SELECT recording_id, {r6("sum(v)")} AS eigen_sum, {r6("sum(v)")} AS eigen_sum_95 FROM v GROUP BY 1"""))
def g9e(spark, sf):
    p = _packed(spark, sf)
    q = g.covariance_component_signal(p, 4).select("recording_id", rnd("eigen_sum").alias("eigen_sum"))
    return q.join(g.covariance_component_signal(p, 4, "variance95").select("recording_id", rnd("eigen_sum").alias("eigen_sum_95")), "recording_id")


@query("g10_sum_normalize", with_views("samples", f"""
, s AS (SELECT recording_id, i, sum(x) AS s FROM samples WHERE ch % 2 = 0 GROUP BY ALL) SELECT recording_id, CAST(i AS INT) AS i, {r6("(s - avg(s) OVER w) / stddev_pop(s) OVER w")} AS z FROM s WINDOW w AS (PARTITION BY recording_id)"""))
def g10(spark, sf):
    s = g.summed_channels(t.windows(spark, sf).filter("ch % 2 = 0"), ["recording_id"], "x")
    return _rounded(s.select("recording_id", F.posexplode(g.zscore(F.col("signal"))).alias("i", "z")), "z")


@query("g11_representative_signal")
def g11(spark, sf):
    r = g.representative_signal(t.windows(spark, sf), ["recording_id"], "ch", "x", FS, 4, 6, 0.5, 8.0)
    return r.select("recording_id", "selected_streams", F.size("signal").alias("samples"), rnd(g.fx.array_dot(F.col("signal"), F.col("signal"))).alias("energy"))


_ACF = """, c AS (SELECT recording_id, ch, i, x - avg(x) OVER (PARTITION BY recording_id, ch) AS c FROM samples), e AS (SELECT recording_id, ch, sum(c * c) AS e FROM c GROUP BY ALL),
acf AS (SELECT a.recording_id, a.ch, a.i - b.i AS lag, sum(a.c * b.c) / max(e.e) AS r FROM c a JOIN c b ON a.recording_id = b.recording_id AND a.ch = b.ch AND a.i - b.i BETWEEN 0 AND 8
 JOIN e ON e.recording_id = a.recording_id AND e.ch = a.ch GROUP BY ALL)"""


def _acf(x):
    return g.standard_acf(x, g.acf_lag_count(F.size(x), FS, 0.4005))


@query("g12_standard_acf", with_views("samples", _ACF + f" SELECT recording_id * 10 + ch AS vec_id, CAST(lag AS INT) AS lag, {r6('r')} AS r FROM acf"))
def g12(spark, sf):
    return _rounded(t.windows(spark, sf).select("vec_id", F.posexplode(_acf(F.col("x"))).alias("lag", "r")), "r")


_CURVE = """, cv AS (SELECT recording_id * 10 + ch AS vec_id, k, k * 8 / 128.0::DOUBLE AS pos, list(r ORDER BY lag) AS rs FROM acf, range(0, 129) q(k) GROUP BY ALL),
cu AS (SELECT vec_id, k, rs[CAST(floor(pos) AS INT) + 1] + (rs[least(CAST(floor(pos) AS INT) + 1, 8) + 1] - rs[CAST(floor(pos) AS INT) + 1]) * (pos - floor(pos)) AS v FROM cv),
cl AS (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY k) AS p, lead(v) OVER (PARTITION BY vec_id ORDER BY k) AS nx FROM cu),
z0 AS (SELECT vec_id, min(k) FILTER (v <= 0) AS kz, min(k) FILTER (v <= 1 / exp(1)) AS ke FROM cl GROUP BY 1),
zz AS (SELECT z0.vec_id, kz, (a.k - 1 + a.p / (a.p - a.v)) * 0.003125 AS zero, (b.k - 1 + (b.p - 1 / exp(1)) / (b.p - b.v)) * 0.003125 AS decay FROM z0
 LEFT JOIN cl a ON a.vec_id = z0.vec_id AND a.k = kz LEFT JOIN cl b ON b.vec_id = z0.vec_id AND b.k = ke),
ar AS (SELECT cl.vec_id, CASE WHEN max(kz) IS NULL THEN sum((greatest(p, 0) + greatest(v, 0)) / 2 * 0.003125) FILTER (k > 0) ELSE sum(CASE WHEN k < kz THEN (p + v) / 2 * 0.003125 END) + max(CASE WHEN k = kz - 1 THEN v / 2 * (zero - k * 0.003125) END) END AS area,
 avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END) FILTER (k > 0) AS neg, avg(abs(v)) FILTER (k >= 96) AS tail, sum(abs(v - p)) AS tv FROM cl JOIN zz ON zz.vec_id = cl.vec_id GROUP BY cl.vec_id)"""


def _acf_scalars(spark, sf, names):
    s = t.windows(spark, sf).select("vec_id", g.acf_scalars(g.curve_at(_acf(F.col("x")), FS)).alias("s"))
    return s.select("vec_id", *[rnd(f"s.{n}").alias(n) for n in names])


@query("g13_acf_scalars", with_views("samples", _ACF + _CURVE + f"""
SELECT zz.vec_id, {r6("decay")} AS decay_1e_sec, {r6("zero")} AS first_zero_sec, {r6("area")} AS first_positive_area, {r6("neg")} AS negative_fraction, {r6("tail")} AS tail_abs_mean, {r6("tv")} AS total_variation
FROM zz JOIN ar ON ar.vec_id = zz.vec_id"""))
def g13(spark, sf):
    names = ("decay_1e_sec", "first_zero_sec", "first_positive_area", "negative_fraction", "tail_abs_mean", "total_variation")
    return _acf_scalars(spark, sf, names)


@query("g13_acf_extrema", with_views("samples", _ACF + _CURVE + f"""
, y AS (SELECT vec_id, k, v, s, s * v AS u, s * p AS pu, s * nx AS nu FROM cl, (VALUES (1), (-1)) q(s)), pk AS (SELECT * FROM y WHERE u > pu AND u > nu),
lb AS (SELECT a.vec_id, a.s, a.k, max(b.k) FILTER (b.k < a.k AND a.s * b.v > a.u) AS lstop, min(b.k) FILTER (b.k > a.k AND a.s * b.v > a.u) AS rstop FROM pk a JOIN cl b ON a.vec_id = b.vec_id GROUP BY ALL),
pr AS (SELECT a.vec_id, a.s, a.k, a.v, a.u - greatest(min(a.s * b.v) FILTER (b.k < a.k AND b.k > COALESCE(lstop, -1)), min(a.s * b.v) FILTER (b.k > a.k AND b.k < COALESCE(rstop, 999))) AS prom
 FROM pk a JOIN lb ON lb.vec_id = a.vec_id AND lb.s = a.s AND lb.k = a.k JOIN cl b ON b.vec_id = a.vec_id GROUP BY a.vec_id, a.s, a.k, a.v, a.u),
mn AS (SELECT vec_id, min(k) AS km, arg_min(v, k) AS vm FROM pr WHERE s = -1 AND prom >= 0.02 GROUP BY 1),
mx AS (SELECT pr.vec_id, min(pr.k) AS kp, arg_min(prom, pr.k) AS pp FROM pr JOIN mn ON mn.vec_id = pr.vec_id WHERE s = 1 AND prom >= 0.02 AND pr.k > km AND v > 0 GROUP BY 1)
SELECT z0.vec_id, {r6("km * 0.003125::DOUBLE")} AS first_min_lag_sec, {r6("vm")} AS first_min_value, {r6("kp * 0.003125::DOUBLE")} AS repeat_peak_lag_sec, {r6("pp")} AS repeat_peak_prominence FROM z0 LEFT JOIN mn ON mn.vec_id = z0.vec_id LEFT JOIN mx ON mx.vec_id = z0.vec_id"""))
def g13x(spark, sf):
    return _acf_scalars(spark, sf, ("first_min_lag_sec", "first_min_value", "repeat_peak_lag_sec", "repeat_peak_prominence"))


@query("g14_channel_acf_products", with_views("samples", _ACF + _CURVE + f" SELECT vec_id // 10 AS recording_id, CAST(k AS INT) AS lag_bin, {r6('avg(v)')} AS recovered FROM cu GROUP BY ALL"))
def g14(spark, sf):
    m = g.channel_acf_maps(_packed(spark, sf), FS)
    rows = m.select("recording_id", F.explode(F.sequence(F.lit(0), F.lit(128))).alias("lag_bin"), "mean_map")
    return rows.select("recording_id", "lag_bin", rnd(fx.array_mean(F.slice("mean_map", F.col("lag_bin") * 64 + 1, 64))).alias("recovered"))


@query("g15_channel_variants")
def g15(spark, sf):
    p = _packed(spark, sf)
    out = [g.channel_variant(p, k, FS).select("recording_id", F.lit(k).alias("kind"), rnd("energy_ratio").alias("energy_ratio"), rnd("peak_ratio").alias("peak_ratio"), rnd("changed_fraction").alias("changed_fraction"))
           for k in g.CHANNEL_FILTERS if k != "mean_signal"]
    return o.union_all(out)


@query("g15_channel_difference", with_views("samples", f"""
, d AS (SELECT recording_id, ch, i, x, COALESCE(x - lag(x) OVER (PARTITION BY recording_id, ch ORDER BY i), 0) AS d FROM samples),
c AS (SELECT *, x - avg(x) OVER w AS cx, d - avg(d) OVER w AS cd FROM d WINDOW w AS (PARTITION BY recording_id, ch))
SELECT recording_id, {r6("sum(cd * cd) / sum(cx * cx)")} AS energy_ratio, {r6("max(abs(cd)) / max(abs(cx))")} AS peak_ratio, {r6("avg(CASE WHEN abs(d - x) > 0 THEN 1.0 ELSE 0.0 END)")} AS changed_fraction FROM c GROUP BY 1"""))
def g15d(spark, sf):
    v = g.channel_variant(_packed(spark, sf), "difference", FS)
    return _rounded(v, "energy_ratio", "peak_ratio", "changed_fraction").drop("channels")


@query("g16_lag_product_map", with_views("samples", f"""
, z AS (SELECT recording_id * 10 + ch AS vec_id, i, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM samples WINDOW w AS (PARTITION BY recording_id, ch)),
p AS (SELECT a.vec_id, l.lag, a.i - 8 AS tm, a.z * b.z AS v FROM z a, range(1, 9) l(lag), z b WHERE b.vec_id = a.vec_id AND b.i = a.i - l.lag AND a.i >= 8),
r AS (SELECT vec_id, lag, list(v ORDER BY tm) AS vs FROM p GROUP BY ALL),
t AS (SELECT vec_id, lag, k, k * 55 / 15.0::DOUBLE AS pos, vs FROM r, range(0, 16) q(k)),
tr AS (SELECT vec_id, lag, k, vs[CAST(least(floor(pos), 54) AS INT) + 1] + (vs[CAST(least(floor(pos), 54) AS INT) + 2] - vs[CAST(least(floor(pos), 54) AS INT) + 1]) * (pos - least(floor(pos), 54)) AS v FROM t),
s AS (SELECT vec_id, quantile_cont(abs(v), 0.995) AS s FROM tr GROUP BY 1),
c AS (SELECT tr.vec_id, lag, k, greatest(least(v / s, 1e0), -1e0) AS v FROM tr JOIN s ON s.vec_id = tr.vec_id),
lr AS (SELECT vec_id, k, list(v ORDER BY lag) AS vs FROM c GROUP BY ALL), l AS (SELECT vec_id, k, b, b * 7 / 11.0::DOUBLE AS pos, vs FROM lr, range(0, 12) q(b))
SELECT vec_id, CAST(b AS INT) AS lag_bin, CAST(k AS INT) AS time_bin, {r6("vs[CAST(least(floor(pos), 6) AS INT) + 1] + (vs[CAST(least(floor(pos), 6) AS INT) + 2] - vs[CAST(least(floor(pos), 6) AS INT) + 1]) * (pos - least(floor(pos), 6))")} AS v FROM l"""))
def g16(spark, sf):
    m = t.windows(spark, sf).select("vec_id", F.posexplode(g.lag_product_map(F.col("x"), 8, 16, 12)).alias("p", "v"))
    return m.select("vec_id", F.expr("cast(p div 16 as int)").alias("lag_bin"), (F.col("p") % 16).alias("time_bin"), rnd("v").alias("v"))


def _dwt_sql() -> str:
    low = "[" + ",".join(f"{v!r}::DOUBLE" for v in g.DB4) + "]"
    high = "[" + ",".join(f"{v!r}::DOUBLE" for v in g._high_pass()) + "]"
    ctes, prev = [], "windows"
    for level in range(5):
        src = "x" if level == 0 else "a"
        def conv(taps):
            at = f"(2 * k + 1 - j)"
            mirrored = f"CASE WHEN {at} < 0 THEN -1 - {at} WHEN {at} >= len({src}) THEN 2 * len({src}) - 1 - {at} ELSE {at} END"
            return f"list_transform(range(0, (len({src}) + 7) // 2), lambda k: list_sum(list_transform(range(0, 8), lambda j: {taps}[j + 1] * {src}[({mirrored}) + 1])))"
        keep = "".join(f", cD{5 - m}" for m in range(level))
        ctes.append(f"l{level} AS (SELECT vec_id{keep}, {conv(low)} AS a, {conv(high)} AS cD{5 - level} FROM {prev})")
        prev = f"l{level}"
    return ", " + ", ".join(ctes)


def _e(b):
    return f"list_sum(list_transform({b}, lambda v: v * v))"


_BANDS = ["a", "cD1", "cD2", "cD3", "cD4", "cD5"]


@query("g17_dwt_energy_entropy", with_views("windows", _dwt_sql() + ", en AS (SELECT vec_id, " + ", ".join(f"{_e(b)} AS {b}" for b in _BANDS) + " FROM l4), tt AS (SELECT *, " + " + ".join(_BANDS) + " AS tot FROM en) SELECT vec_id, "
       + ", ".join(f"{r6(b, 8)} AS e_{'cA' if b == 'a' else b}" for b in _BANDS) + f", {r6('tot', 8)} AS e_total, {r6(' - '.join(['0'] + [f'{b} / tot * log2({b} / tot)' for b in _BANDS]))} AS entropy FROM tt"))
def g17(spark, sf):
    e = g.energy_entropy(g.wavelet_bands(t.windows(spark, sf).select("vec_id", "x"), "x")).drop("x")
    return _rounded(_rounded(e, *[f"e_{b}" for b in g.band_names()], "e_total", digits=8), "entropy")


@query("g18_dwt_reconstruct", with_views("windows", f"""
SELECT vec_id, 0.0::DOUBLE AS mse, 0.0::DOUBLE AS mae, {r6("10 * log10(list_sum(list_transform(x, lambda v: v * v)) / 64 / 1e-10)", 3)} AS snr_db FROM windows"""))
def g18(spark, sf):
    b = g.reconstruct(g.wavelet_bands(t.windows(spark, sf).select("vec_id", "x"), "x"))
    e = g.reconstruction_error(b, "x", "rebuilt")
    return e.select("vec_id", rnd("mse").alias("mse"), rnd("mae").alias("mae"), rnd("snr_db", 3).alias("snr_db"))


@query("g18_dwt_scalogram", with_views("windows", _dwt_sql() + f"""
, rr AS (SELECT vec_id, unnest([0, 1, 2, 3, 4, 5]) AS row, unnest(['cA', 'cD5', 'cD4', 'cD3', 'cD2', 'cD1']) AS band, unnest([a, cD5, cD4, cD3, cD2, cD1]) AS c FROM l4),
nn AS (SELECT vec_id, row, band, list_transform(c, lambda v: (v - list_min(c)) / (list_max(c) - list_min(c) + 1e-10)) AS c FROM rr)
SELECT vec_id, CAST(row AS INT) AS row, band, {r6("list_sum(list_transform(range(0, 64), lambda k: c[CAST(least(floor(k * (len(c) - 1) / 63.0::DOUBLE), len(c) - 2) AS INT) + 1] + (c[CAST(least(floor(k * (len(c) - 1) / 63.0::DOUBLE), len(c) - 2) AS INT) + 2] - c[CAST(least(floor(k * (len(c) - 1) / 63.0::DOUBLE), len(c) - 2) AS INT) + 1]) * (k * (len(c) - 1) / 63.0::DOUBLE - least(floor(k * (len(c) - 1) / 63.0::DOUBLE), len(c) - 2))))")} AS total FROM nn"""))
def g18s(spark, sf):
    r = g.scalogram_rows(g.wavelet_bands(t.windows(spark, sf).select("vec_id", "x"), "x"), ["vec_id"], 64)
    return r.select("vec_id", "row", "band", rnd(fx.array_sum(F.col("values"))).alias("total"))


@query("g19_cwt_scalogram", with_views("samples", f"""
, f AS (SELECT k, 9.999999 - k * (9.999999 - 1.0) / 7 AS f FROM range(0, 8) r(k)), fr AS (SELECT k, f, 6.0 / (2 * pi() * f) AS sg, CAST(least(greatest(8, ceil(3 * 6.0 / (2 * pi() * f) * 20)), 32) AS INT) AS rad FROM f),
fo AS (SELECT *, CASE WHEN 2 * rad + 1 <= 64 THEN rad ELSE 31 END AS off FROM fr),
nm AS (SELECT fo.k, sqrt(sum(exp(-pow(t / 20.0 / sg, 2)))) AS nrm FROM fo, range(-32, 33) q(t) WHERE abs(t) <= rad GROUP BY 1),
c AS (SELECT recording_id * 10 + ch AS vec_id, i, x - avg(x) OVER (PARTITION BY recording_id, ch) AS c FROM samples),
m AS (SELECT vec_id, fo.k, n.i AS n, sqrt(pow(sum(c * exp(-0.5 * pow(tt / 20.0 / sg, 2)) * cos(2 * pi() * f * tt / 20.0)), 2) + pow(sum(c * exp(-0.5 * pow(tt / 20.0 / sg, 2)) * sin(2 * pi() * f * tt / 20.0)), 2)) / max(nrm) AS a
 FROM (SELECT c.vec_id, c.i AS ci, c.c, n.i AS ni, c.i - n.i AS d FROM c, (SELECT unnest(range(0, 64)) AS i) n) q JOIN (SELECT unnest(range(0, 64)) AS i) n ON n.i = q.ni, fo JOIN nm ON nm.k = fo.k, LATERAL (SELECT q.d + rad - off AS tt) z WHERE abs(tt) <= rad GROUP BY ALL)
SELECT vec_id, CAST(k AS INT) AS row, {r6("sum(a) / max(max(a)) OVER (PARTITION BY vec_id)")} AS total FROM m GROUP BY vec_id, k"""))
def g19(spark, sf):
    m = g.morlet_maps(t.windows(spark, sf).select("vec_id", "x"), "x", FS, 8)
    rows = m.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row"), "scalogram")
    return rows.select("vec_id", "row", rnd(fx.array_sum(F.slice("scalogram", F.col("row") * 64 + 1, 64))).alias("total"))


def _maps(spark, sf):
    """8 x 8 maps (rows = frequency high to low) from the packed windows."""
    return t.windows(spark, sf).select("vec_id", F.transform("x", lambda v: F.abs(v)).alias("m"))


_MAP_SQL = """, m AS (SELECT vec_id, CAST(p // 8 AS INT) AS row, p % 8 AS col, abs(v) AS v FROM (SELECT vec_id, generate_subscripts(x, 1) - 1 AS p, unnest(x) AS v FROM windows)),
g AS (SELECT *, CASE WHEN v < avg(v) OVER (PARTITION BY vec_id, row) * least(1 / log10(2 + vec_id % 5 * 30), 1e0) THEN 0 ELSE v END AS d FROM m)"""


def _denoised(spark, sf):
    rows = _maps(spark, sf).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row"), "m")
    return rows.select("vec_id", "row", g.general_denoise(F.slice("m", F.col("row") * 8 + 1, 8), (2 + F.col("vec_id") % 5 * 30).cast("double")).alias("r"))


@query("g20_general_denoise", with_views("windows", _MAP_SQL + f" SELECT vec_id, row, {r6('sum(d)')} AS total, count(*) FILTER (d > 0)::INT AS lit FROM g GROUP BY ALL"))
def g20a(spark, sf):
    return _denoised(spark, sf).select("vec_id", "row", rnd(fx.array_sum(F.col("r"))).alias("total"), F.size(F.filter("r", lambda v: v > 0)).alias("lit"))


@query("g20_horizontal_denoise", with_views("windows", _MAP_SQL + f"""
, k AS (SELECT *, col - row_number() OVER (PARTITION BY vec_id, row ORDER BY col) AS grp FROM g WHERE d > 0), n AS (SELECT *, count(*) OVER (PARTITION BY vec_id, row, grp) AS run FROM k)
SELECT vec_id, row, {r6("sum(CASE WHEN run >= 3 THEN d ELSE 0 END)")} AS total, count(*) FILTER (run >= 3)::INT AS lit FROM n GROUP BY ALL"""))
def g20c(spark, sf):
    minimum = g.minimum_run(F.lit(1.0), FS, kappa=0.1)
    r = _denoised(spark, sf).withColumn("r", g.horizontal_denoise(F.col("r"), minimum))
    return r.select("vec_id", "row", rnd(fx.array_sum(F.col("r"))).alias("total"), F.size(F.filter("r", lambda v: v > 0)).alias("lit"))


@query("g20_vertical_denoise")
def g20b(spark, sf):
    v = g.vertical_denoise(_maps(spark, sf).withColumn("m", F.transform("m", lambda v: F.when(v > 0.1, v).otherwise(0.0))), "m", [float(8 - k) for k in range(8)], 1.5)
    return v.select("vec_id", rnd(fx.array_sum(F.col("m"))).alias("total"), F.size(F.filter("m", lambda v: v > 0)).alias("lit"))


_STFT = """, fr AS (SELECT recording_id * 10 + ch AS vec_id, f AS frame, i - 2 * f AS n, x FROM samples, range(0, 25) q(f) WHERE i >= 2 * f AND i < 2 * f + 16),
ham AS (SELECT n, 0.54 - 0.46 * cos(2 * pi() * n / 16) AS h FROM range(0, 16) q(n)),
mg AS (SELECT vec_id, frame, b, 2.0::DOUBLE * b AS f, sqrt(pow(sum(x * h * cos(2 * pi() * b * fr.n / 16)), 2) + pow(sum(x * h * sin(2 * pi() * b * fr.n / 16)), 2)) / (SELECT sum(h) FROM ham) AS mag FROM fr JOIN ham ON ham.n = fr.n, range(0, 9) q(b) GROUP BY ALL),
nz AS (SELECT vec_id, avg(mag) + 3 * stddev_pop(mag) AS noise FROM mg WHERE f >= 8 GROUP BY 1),
pb AS (SELECT mg.vec_id, frame, sum(mag) AS pbc, max(noise) * 7 AS th FROM mg JOIN nz ON nz.vec_id = mg.vec_id WHERE f BETWEEN 3 AND 15 GROUP BY mg.vec_id, frame)"""


@query("g21_spectrogram", with_views("samples", _STFT + f" SELECT vec_id, CAST(frame AS INT) AS frame, CAST(b AS INT) AS bin, {r6('mag')} AS mag FROM mg"))
def g21s(spark, sf):
    f = g.spectrogram(t.windows(spark, sf).select("vec_id", "x"), "x", 32.0)
    return _rounded(f.select("vec_id", "frame", F.posexplode("mag").alias("bin", "mag")), "mag")


def _stft(spark, sf):
    f = g.spectrogram(t.windows(spark, sf).select("vec_id", "x"), "x", 32.0)
    return g.stft_features(f, ["vec_id"], 32.0, 9, 2.0, 2 / 32.0, noise_k=0.5, pbc=(5.0, 25.0))


_FEATURE_SQL = _STFT.replace("3 * stddev_pop", "0.5 * stddev_pop").replace("max(noise) * 7 AS th", "max(noise) * 6 AS th").replace("f BETWEEN 3 AND 15", "f BETWEEN 5 AND 25") + f"""
, ab AS (SELECT *, pbc > th AS above FROM pb), isl AS (SELECT vec_id, frame, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS g FROM ab WHERE above),
rn AS (SELECT vec_id, min(frame) AS s, count(*) AS n FROM isl GROUP BY vec_id, g), bs AS (SELECT vec_id, arg_max(s, n * 1000 - s) AS s, max(n) AS n FROM rn GROUP BY 1),
ev AS (SELECT ab.vec_id, ab.frame, pbc, th, above, (bs.n IS NULL OR bs.n < 2 OR (ab.frame >= bs.s AND ab.frame < bs.s + bs.n)) AS ev, COALESCE(bs.n, 0) AS n FROM ab LEFT JOIN bs ON bs.vec_id = ab.vec_id),
fx AS (SELECT mg.vec_id, mg.frame, COALESCE(max(f) FILTER (f >= 1 AND mag >= noise), 0) AS ef, sum(CASE WHEN f >= 1 AND mag >= noise THEN mag * mag ELSE 0 END) AS tot FROM mg JOIN nz ON nz.vec_id = mg.vec_id GROUP BY ALL),
cs AS (SELECT mg.vec_id, mg.frame, f, sum(CASE WHEN mag >= noise THEN mag * mag ELSE 0 END) OVER (PARTITION BY mg.vec_id, mg.frame ORDER BY f) AS c FROM mg JOIN nz ON nz.vec_id = mg.vec_id WHERE f >= 1),
tf AS (SELECT fx.vec_id, fx.frame, any_value(ef) AS ef, CASE WHEN any_value(tot) > 0 THEN min(f) FILTER (c / tot >= 0.5) ELSE 0 END AS tf FROM fx JOIN cs ON cs.vec_id = fx.vec_id AND cs.frame = fx.frame GROUP BY ALL),
en AS (SELECT vec_id, frame, band, -sum(p * ln(p)) AS h FROM (SELECT vec_id, frame, band, mag * mag / sum(mag * mag) OVER (PARTITION BY vec_id, frame, band) AS p FROM mg, (VALUES ('a', 1, 10), ('b', 10, 30), ('c', 30, 16)) q(band, lo, hi) WHERE f >= lo AND f <= hi) WHERE p > 0 GROUP BY ALL)
SELECT ev.vec_id, {r6("avg(ef) FILTER (ev)")} AS ef_mean, {r6("stddev_pop(ef) FILTER (ev)")} AS ef_std, max(ef) FILTER (ev) AS ef_max, {r6("avg(tf) FILTER (ev)")} AS tf_mean, {r6("stddev_pop(tf) FILTER (ev)")} AS tf_std, max(tf) FILTER (ev) AS tf_max,
  {r6("avg(ea.h) FILTER (ev)")} AS entropy_1_10, {r6("avg(eb.h) FILTER (ev)")} AS entropy_10_30, count(*) AS frames, {r6("max(noise)")} AS noise_threshold, max(ev.n) > 0 AS event_detected, {r6("max(ev.n) * 0.0625::DOUBLE")} AS event_duration,
  {r6("max(ef) FILTER (ev) / nullif(max(tf) FILTER (ev), 0)")} AS ef_tf_ratio, {r6("COALESCE(sum(pbc - th) FILTER (above), 0) / sum(pbc) FILTER (NOT above)")} AS pbc_energy_ratio
FROM ev JOIN tf ON tf.vec_id = ev.vec_id AND tf.frame = ev.frame JOIN nz ON nz.vec_id = ev.vec_id JOIN en ea ON ea.vec_id = ev.vec_id AND ea.frame = ev.frame AND ea.band = 'a' JOIN en eb ON eb.vec_id = ev.vec_id AND eb.frame = ev.frame AND eb.band = 'b' GROUP BY ev.vec_id"""


@query("g21_stft_features", with_views("samples", _FEATURE_SQL))
def g21(spark, sf):
    f = _stft(spark, sf).drop("fractal_dim", "entropy_30_max")
    return _rounded(f, "ef_mean", "ef_std", "tf_mean", "tf_std", "entropy_1_10", "entropy_10_30", "noise_threshold", "event_duration", "ef_tf_ratio", "pbc_energy_ratio")


@query("g21_fractal_dimension")
def g21f(spark, sf):
    return _rounded(_stft(spark, sf).select("vec_id", "fractal_dim"), "fractal_dim")


@query("g22_welch_band_energy", with_views("samples", f"""
, h AS (SELECT n, 0.5 - 0.5 * cos(2 * pi() * n / 64) AS h FROM range(0, 64) q(n)), c AS (SELECT recording_id * 10 + ch AS vec_id, i, (x - avg(x) OVER (PARTITION BY recording_id, ch)) * h AS c FROM samples JOIN h ON h.n = i),
p AS (SELECT vec_id, k, (pow(sum(c * cos(2 * pi() * k * i / 64)), 2) + pow(sum(c * sin(2 * pi() * k * i / 64)), 2)) * 2 / (20 * (SELECT sum(h * h) FROM h)) AS psd FROM c, range(2, 7) q(k) GROUP BY ALL)
SELECT vec_id, {r6("sum((a.psd + b.psd) / 2 * 20 / 64)")} AS energy FROM p a JOIN p b USING (vec_id) WHERE b.k = a.k + 1 GROUP BY vec_id""".replace("sum((a.psd", "sum((a.psd")))
def g22(spark, sf):
    return t.windows(spark, sf).select("vec_id", rnd(g.welch_band_energy(F.col("x"), 64, FS, 0.5, 2.0)).alias("energy"))


@query("g23_presence_signal")
def g23(spark, sf):
    win = t.windows(spark, sf)
    mv = g.presence_signal(win, ["recording_id"], "ch", "x", FS, 4, 5, 0.5, 8.0).select(
        "recording_id", rnd(F.element_at(g.moving_variance_array(F.col("signal"), 4), -1)).alias("mv_current"))
    wander = g.presence_signal(win, ["recording_id"], "ch", "x", FS, 8, 5, 0.2, 5.0).select(
        "recording_id", rnd(g.welch_band_energy(F.col("signal"), 64, FS, 0.3, 1.5)).alias("band_energy"))
    return mv.join(wander, "recording_id")


@query("g24_baseline_threshold", with_views("packets", f"""
, q AS (SELECT device_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(*) AS n FROM packets GROUP BY 1),
i AS (SELECT p.device_id, p.value, n, b - a AS iqr, (p.value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS ok FROM packets p JOIN q ON q.device_id = p.device_id),
s AS (SELECT device_id, max(n) AS n, count(*) FILTER (ok) AS k, max(iqr) AS iqr, avg(value) FILTER (ok) AS m1, stddev_pop(value) FILTER (ok) AS s1, avg(value) AS m0, stddev_pop(value) AS s0 FROM i GROUP BY 1),
u AS (SELECT *, n >= 4 AND iqr > 0 AND k >= greatest(4, n // 2) AS use FROM s)
SELECT device_id, n, CASE WHEN use THEN k ELSE n END AS kept, {r6("greatest(CASE WHEN use THEN m1 + 2 * s1 ELSE m0 + 2 * s0 END, 0.3)")} AS threshold FROM u"""))
def g24(spark, sf):
    return _rounded(g.baseline_threshold(t.packets(spark, sf), ["device_id"], "value"), "threshold")


@query("g25_band_patches", with_views("file_index", """
, s AS (SELECT recording_id, p AS patch, sl AS slot, CASE WHEN sl < 22 THEN 0 WHEN sl < 43 THEN 1 ELSE 2 END AS band FROM file_index, range(0, 4) a(p), range(0, 64) b(sl)),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, patch, band ORDER BY md5('5:' || recording_id || ':' || patch || ':' || slot), slot) AS rn FROM s)
SELECT recording_id, CAST(patch AS INT) AS patch, CAST(slot AS INT) AS slot, CAST(band AS INT) AS band FROM r WHERE rn <= 6"""))
def g25(spark, sf):
    return g.band_patches(t.file_index(spark, sf).select("recording_id"), "recording_id", 64, 3, 6, 4, 5)


@query("g26_q_landscape", with_views("samples", Q_SQL + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY q DESC, ch) AS rank FROM q), s AS (SELECT *, CASE WHEN rank <= 6 THEN q / (sum(CASE WHEN rank <= 6 THEN q END) OVER (PARTITION BY recording_id) + 1e-10) END AS share FROM r),
f AS (SELECT *, max(CASE WHEN share >= 1.0 / 6 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id) AS anyp FROM s)
SELECT recording_id, ch, rank, rank <= 6 AS in_top, {r6("share")} AS share, {r6("1 / 6.0::DOUBLE")} AS threshold, (COALESCE(share >= 1.0 / 6, false) OR (anyp = 0 AND rank = 1)) AS selected, (anyp = 0 AND rank = 1) AS fallback FROM f"""))
def g26(spark, sf):
    return _rounded(g.q_landscape(channel_q(spark, sf), ["recording_id"], "ch", 6).drop("q"), "share", "threshold")


@query("g26_stage_table", with_views("samples", f"""
, s AS (SELECT recording_id, ch, unnest(['raw', 'absolute', 'difference']) AS stage, unnest([x, abs(x), x - COALESCE(lag(x) OVER (PARTITION BY recording_id, ch ORDER BY i), x)]) AS v, i FROM samples),
m AS (SELECT recording_id, ch, stage, greatest(avg(v * v) OVER w - pow(avg(abs(v)) OVER w, 2), 0) AS mv FROM s WINDOW w AS (PARTITION BY recording_id, ch, stage ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
q AS (SELECT recording_id, ch, stage, max(mv) / greatest(avg(mv), 1e-8) AS q FROM m GROUP BY ALL) SELECT recording_id, stage, {r6("max(q)")} AS q_max, {r6("avg(q)")} AS q_mean FROM q GROUP BY ALL"""))
def g26s(spark, sf):
    x = F.col("x")
    stages = F.map_from_arrays(F.array(*[F.lit(n) for n in ("raw", "absolute", "difference")]), F.array(x, F.transform(x, lambda v: F.abs(v)), w.difference(x)))
    long = t.windows(spark, sf).select("recording_id", "ch", F.explode(stages).alias("stage", "y")).select("recording_id", "ch", "stage", F.posexplode("y").alias("i", "v"))
    q = w.q_metric(long, ["recording_id", "ch", "stage"], "i", "v", 3)
    return _rounded(q.groupBy("recording_id", "stage").agg(F.max("q").alias("q_max"), F.avg("q").alias("q_mean")), "q_max", "q_mean")


@query("g27_window_dataset", with_views("samples", f"""
, f AS (SELECT recording_id, i, bool_or(x > 0.3) AS hot FROM samples GROUP BY ALL), k AS (SELECT *, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS grp FROM f WHERE hot),
ev AS (SELECT recording_id, min(i) AS a, max(i) + 1 AS b FROM k GROUP BY recording_id, grp), rec AS (SELECT DISTINCT recording_id FROM samples), st AS (SELECT recording_id, CAST(round_even(k * 5.0::DOUBLE, 0) AS BIGINT) AS start FROM rec, range(0, 5) r(k)),
h AS (SELECT st.recording_id, start, max(CASE WHEN (a + b - 1) / 2.0 >= start AND (a + b - 1) / 2.0 < start + 40 AND greatest(0, least(start + 40, b) - greatest(start, a)) / CAST(least(40, b - a) AS DOUBLE) > 0.5 THEN 1 ELSE 0 END) AS y,
  max(CASE WHEN least(start + 40, b + 2) > greatest(start, a - 2) THEN 1 ELSE 0 END) AS gd FROM st LEFT JOIN ev ON ev.recording_id = st.recording_id GROUP BY ALL),
d AS (SELECT h.recording_id, h.start, y, s.ch, s.i, s.x FROM h JOIN samples s ON s.recording_id = h.recording_id AND s.i >= start AND s.i < start + 40 WHERE y = 1 OR gd = 0)
SELECT recording_id || '_rx' || ch || '_s' || start AS sample_id, recording_id, start, ch, CAST(max(y) AS INT) AS label, count(*)::INT AS samples, {r6("avg(x)")} AS mean, {r6("stddev_pop(x)")} AS sd FROM d GROUP BY recording_id, start, ch"""))
def g27(spark, sf):
    win = t.windows(spark, sf).select("recording_id", "ch", "x")
    starts = win.select("recording_id").distinct().select("recording_id", F.explode(g.window_starts(F.lit(64), FS, 2.0, 0.25)).alias("start"))
    labelled = j.window_event_labels(starts, _runs(spark, sf), ["recording_id"], 40, 2).filter("kept")
    rows = labelled.join(win, "recording_id").withColumn("v", F.slice("x", F.col("start").cast("int") + 1, F.lit(40)))
    mean = fx.array_mean(F.col("v"))
    return rows.select(
        fx.sample_id(F.col("recording_id"), F.col("ch"), F.col("start")).alias("sample_id"), "recording_id", "start", "ch", F.col("y").alias("label"), F.size("v").alias("samples"),
        rnd(mean).alias("mean"), rnd(F.sqrt(fx.array_dot(F.col("v"), F.col("v")) / 40 - mean * mean)).alias("sd"))
