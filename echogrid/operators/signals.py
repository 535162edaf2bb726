"""Windowing, resampling and window features.

Long series stay long and go through prefix scans; a window is short by definition (<= a few thousand samples),
so its features are array expressions, or one Arrow batch of many windows where a recurrence or linear algebra
is needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.functions import kernels
from echogrid.functions import scalars as fx
from echogrid.operators import ordered as o
from echogrid.session import materialize

# db4 low-pass analysis taps.
DB4 = [
    -0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
    -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965,
]


# --- windows ---------------------------------------------------------------------------------------------

def window_starts(length: Column, fs: float, window_s: float, stride_s: float) -> Column:
    """Start indexes round(k * stride * fs) of all whole windows in a series of `length` samples."""
    n = round(window_s * fs)
    room = length - n
    count = F.floor(room / fs / stride_s + 1e-9) + 1
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda k: F.bround(k * F.lit(stride_s * fs)).cast("bigint")))
    return F.when(room >= 0, F.filter(starts, lambda s: s <= room)).otherwise(F.array().cast("array<bigint>"))


def assign_windows(df: DataFrame, keys: Sequence[str], index: str, n: int, step: float) -> DataFrame:
    """Every sample with the starts of all whole windows containing it, by arithmetic (no join on ranges)."""
    sizes = df.groupBy(*keys).agg((F.max(index) + 1).alias("__len"))
    lo = F.greatest(F.lit(0), F.floor((F.col(index) - n) / step))
    ks = F.sequence(lo, F.ceil((F.col(index) + 1) / step))
    starts = F.array_distinct(F.transform(ks, lambda k: F.bround(k * F.lit(float(step))).cast("bigint")))
    fits = F.filter(starts, lambda s: (s <= F.col(index)) & (F.col(index) < s + n) & (s + n <= F.col("__len")))
    return df.join(sizes, list(keys)).withColumn("start", F.explode(fits)).drop("__len")


def time_windows(df: DataFrame, keys: Sequence[str], time: str, window: int, stride: int, aggs: Sequence[Column], min_rows: int = 10) -> DataFrame:
    """Windows [t0 + k*stride, +window) anchored at each series' first time; windows past the end or too thin are dropped."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("__t0"), F.max(time).alias("__t1"))
    rel = F.col(time) - F.col("__t0")
    last = F.floor((F.col("__t1") - F.col("__t0") - window) / stride)
    lo = F.greatest(F.lit(0), F.floor((rel - window) / stride) + 1)
    ks = F.sequence(lo, F.floor(rel / stride))
    w = df.join(ends, list(keys)).withColumn("k", F.explode(F.filter(ks, lambda k: k <= last)))
    out = w.groupBy(*keys, "k").agg(F.count("*").alias("rows"), F.min("__t0").alias("__t0"), *aggs).filter(F.col("rows") >= min_rows)
    return out.withColumn("start", F.col("__t0") + F.col("k") * stride).drop("__t0")


# --- resampling ------------------------------------------------------------------------------------------

def resample_uniform(df: DataFrame, keys, order, time: str, values: Sequence[str], step: float, chunk: Column | None = None) -> DataFrame:
    """Linear interpolation on t0 + k*step. Each row fills the grid cells between its predecessor and itself.

    Times must increase strictly inside a series (see `drop_nonmonotonic`).
    """
    t0 = df.groupBy(*keys).agg(F.min(time).alias("__t0"), F.max(time).alias("__t1"))
    before = F.struct(F.col(time).alias("t"), *[F.col(v) for v in values])
    rows = o.prefix_scan(df, keys, order, {"__p": ("prev", before)}, chunk).join(t0, list(keys))
    cell, prev_cell = (F.floor((F.col(c) - F.col("__t0")) / step) for c in (time, "__p.t"))
    span = F.when(F.col("__p").isNull(), F.array(F.lit(0).cast("bigint"))).when(cell > prev_cell, F.sequence(prev_cell + 1, cell))
    grid = rows.withColumn("k", F.explode(span)).withColumn("__at", F.col("__t0") + F.col("k") * step)
    alpha = F.when(F.col("__p").isNull(), F.lit(1.0)).otherwise((F.col("__at") - F.col("__p.t")) / (F.col(time) - F.col("__p.t")))
    lerp = {v: F.coalesce(F.col(f"__p.{v}"), F.col(v)) + (F.col(v) - F.coalesce(F.col(f"__p.{v}"), F.col(v))) * alpha for v in values}
    return grid.select(*keys, "k", F.col("__at").alias("at"), *[e.alias(v) for v, e in lerp.items()])


def rescale_resample(df: DataFrame, keys, order, time: str, values: Sequence[str], n: int, chunk: Column | None = None) -> DataFrame:
    """Interpolate on n evenly spaced points of the normalised 0..1 time axis; integer clocks keep the ends exact."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("__t0"), F.max(time).alias("__t1"))
    before = F.struct(F.col(time).alias("t"), *[F.col(v) for v in values])
    rows = o.prefix_scan(df, keys, order, {"__p": ("prev", before)}, chunk).join(ends, list(keys)).filter("__t1 > __t0")
    cell = lambda c: F.expr(f"(({c} - __t0) * {n - 1}) div (__t1 - __t0)")
    span = F.when(F.col("__p").isNull(), F.array(F.lit(0).cast("bigint"))).when(cell(time) > cell("__p.t"), F.sequence(cell("__p.t") + 1, cell(time)))
    grid = rows.withColumn("k", F.explode(span))
    at = F.col("__t0") + F.col("k") * (F.col("__t1") - F.col("__t0")) / F.lit(float(n - 1))
    alpha = F.when(F.col("__p").isNull(), F.lit(1.0)).otherwise((at - F.col("__p.t")) / (F.col(time) - F.col("__p.t")))
    return grid.select(*keys, "k", *[(F.coalesce(F.col(f"__p.{v}"), F.col(v)) + (F.col(v) - F.coalesce(F.col(f"__p.{v}"), F.col(v))) * alpha).alias(v) for v in values])


def resample_gap_fill(df: DataFrame, keys, order, time: str, value: str, label: str, grid: float, tolerance: float, max_steps: int = 64, chunk: Column | None = None) -> DataFrame:
    """Insert steps-1 interpolated rows into gaps close to a whole number of grid steps, else keep the row only.

    `kind` is raw / interp / irregular / nonpositive; labels switch half way. One row per output sample.
    """
    before = F.struct(F.col(time).alias("t"), F.col(value).alias("v"), F.col(label).alias("l"))
    rows = o.prefix_scan(df, keys, order, {"__p": ("prev", before)}, chunk)
    gap = F.col(time) - F.col("__p.t")
    steps = F.greatest(F.lit(1), F.bround(gap / grid).cast("bigint"))
    fits = (gap > 0) & (steps <= max_steps) & (F.abs(gap - steps * grid) <= tolerance)
    rows = rows.withColumns({"__steps": F.when(fits, steps).otherwise(F.lit(1)), "__kind": F.when(gap.isNull() | fits, "raw").when(gap <= 0, "nonpositive").otherwise("irregular")})
    out = rows.withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__steps"))))
    a = F.col("step") / F.col("__steps")
    inner = F.col("step") < F.col("__steps")
    return out.select(
        *keys, *order, "step", F.when(inner, "interp").otherwise(F.col("__kind")).alias("kind"),
        F.when(inner, (1 - a) * F.col("__p.v") + a * F.col(value)).otherwise(F.col(value)).alias(value),
        F.when(inner & (a < 0.5), F.col("__p.l")).otherwise(F.col(label)).alias(label))


def fixed_length(values: Column, n: int) -> Column:
    """Cut, or repeat the last sample, to exactly n."""
    return F.when(F.size(values) >= n, F.slice(values, 1, n)).otherwise(F.concat(values, F.array_repeat(F.element_at(values, -1), F.greatest(F.lit(0), F.lit(n) - F.size(values)))))


# --- packed windows and batched kernels ------------------------------------------------------------------

def pack_channels(df: DataFrame, keys: Sequence[str], channel: str, values: str) -> DataFrame:
    """One row per window with `channels` array<array<double>> in channel order (the channel count is a hardware constant)."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(channel).alias("c"), F.col(values).alias("x"))))
    # an explicit partition count keeps small-but-costly windows spread out; the aggregate reuses this one shuffle
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).groupBy(*keys).agg(F.transform(rows, lambda r: r["x"]).alias("channels"))


#: Windows that `batched` computes at once: what a worker holds depends on it, not on the rows of an Arrow batch.
BATCH_ROWS = 256


def batched(df: DataFrame, column: str, fn: Callable[[np.ndarray], dict[str, list]], schema: str) -> DataFrame:
    """Apply `fn` to slices of Arrow batches of equal-length arrays; `fn` gets the stacked array and returns new columns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[a : a + BATCH_ROWS] for whole in frames for a in range(0, len(whole), BATCH_ROWS)):
            sizes = pdf[column].map(len)
            for _, part in pdf.groupby(sizes, sort=False):
                stacked = np.stack([np.stack(v) if isinstance(v[0], (list, np.ndarray)) else np.asarray(v, float) for v in part[column]]).astype(float)
                yield part.drop(columns=[column]).assign(**fn(stacked))

    return df.mapInPandas(run, schema)


def _schema(df: DataFrame, drop: str, added: str) -> str:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != drop)
    return f"{kept}, {added}" if kept else added


def bandpass(df: DataFrame, values: str, fs: float, low_hz: float, high_hz: float, order: int = 4) -> DataFrame:
    """Zero-phase Butterworth band-pass of a packed array column."""
    return batched(df, values, lambda x: {values: list(kernels.zero_phase_bandpass(x, fs, low_hz, high_hz, order))}, _schema(df, values, f"`{values}` array<double>"))


def select_component_signal(df: DataFrame, fs: float, radius: int) -> DataFrame:
    """Windows with `channels` -> 1-D `signal` (SVD components by eigen share and q share)."""

    def run(x: np.ndarray) -> dict[str, list]:
        r = kernels.svd_components(x, radius)
        return {"signal": list(r["signal"]), "candidates": r["candidates"], "selected": [";".join(map(str, np.flatnonzero(c))) for c in r["chosen"]], "energy": r["energy"]}

    return batched(df, "channels", run, _schema(df, "channels", "signal array<double>, candidates int, selected string, energy double"))


def covariance_component_signal(df: DataFrame, half: int, mode: str = "q") -> DataFrame:
    def run(x: np.ndarray) -> dict[str, list]:
        r = kernels.covariance_components(x, half, mode)
        return {"signal": list(r["signal"]), "selected": [";".join(map(str, o)) for o in r["order"]],
                "eigen_sum": r["eigenvalues"].sum(-1), "top_eigenvalue": r["eigenvalues"].max(-1)}

    return batched(df, "channels", run, _schema(df, "channels", "signal array<double>, selected string, eigen_sum double, top_eigenvalue double"))


def channel_covariance(df: DataFrame, keys, channel: str, values: str) -> DataFrame:
    """Sample covariance of every channel pair of a window, from packed channel rows joined on the window key."""
    c = df.select(*keys, channel, centered_array(F.col(values)).alias("c"))
    a, b = c.withColumnsRenamed({channel: "ch_a", "c": "ca"}), c.withColumnsRenamed({channel: "ch_b", "c": "cb"})
    return a.join(b, list(keys)).filter("ch_a <= ch_b").select(*keys, "ch_a", "ch_b", (fx.array_dot(F.col("ca"), F.col("cb")) / (F.size("ca") - 1)).alias("cov"))


def channel_acf_maps(df: DataFrame, fs: float, cells: int = 64) -> DataFrame:
    """Windows with `channels` -> flattened 129 x cells `mean_map`, `energy_map` and per-channel `curves`."""

    def run(x: np.ndarray) -> dict[str, list]:
        r = kernels.channel_products(x, fs, cells)
        flat = lambda m: list(m.reshape(len(m), -1))
        return {"mean_map": flat(r["mean"]), "energy_map": flat(r["energy"]), "curves": flat(r["curves"]), "inactive": list((~r["active"]).sum(1))}

    return batched(df, "channels", run, _schema(df, "channels", "mean_map array<double>, energy_map array<double>, curves array<double>, inactive int"))


CHANNEL_FILTERS = ("savgol", "hampel", "detrend", "difference", "mean_signal")


def channel_variant(df: DataFrame, kind: str, fs: float) -> DataFrame:
    """Windows with `channels` filtered inside each window, plus energy and peak ratios against the centred input."""
    from echogrid.operators import series

    width = max(5, round(0.051 * fs) | 1)
    filters = {
        "savgol": lambda x: series.savgol2(x, width), "hampel": lambda x: series.hampel(x, width),
        "detrend": series.detrend, "difference": series.difference,
    }
    if kind == "mean_signal":
        mean = F.transform(F.get("channels", F.lit(0)), lambda _, i: fx.array_mean(F.transform("channels", lambda c: F.get(c, i))))
        return df.withColumn("channels", F.array(mean))
    base = F.transform("channels", series.center)
    out = df.withColumns({"__base": base, "__old": F.col("channels"), "channels": F.transform("channels", filters[kind])})
    new = F.transform("channels", series.center)
    energy = lambda a: F.aggregate(F.flatten(a), F.lit(0.0), lambda s, v: s + v * v)
    peak = lambda a: F.array_max(F.transform(F.flatten(a), lambda v: F.abs(v)))
    changed = F.zip_with(F.flatten("channels"), F.flatten("__old"), lambda a, b: F.when(F.abs(a - b) > 0, 1.0).otherwise(0.0))
    return out.withColumns({
        "energy_ratio": energy(new) / F.greatest(energy(F.col("__base")), F.lit(1e-12)),
        "peak_ratio": peak(new) / F.greatest(peak(F.col("__base")), F.lit(1e-12)), "changed_fraction": fx.array_mean(changed)}).drop("__base", "__old")


# --- array features --------------------------------------------------------------------------------------

def centered_array(values: Column) -> Column:
    return fx.let(fx.array_mean(values), lambda m: F.transform(values, lambda v: v - m))


def zscore(values: Column, floor: float = 1e-8) -> Column:
    """Population z-score; a constant array is only centred."""
    return fx.let(centered_array(values), lambda c: fx.let(F.sqrt(fx.array_dot(c, c) / F.size(c)), lambda s: F.transform(c, lambda v: F.when(s > floor, v / s).otherwise(v))))


def moving_variance_array(values: Column, half: int) -> Column:
    """Padded moving variance of one packed window."""
    size = 2 * half + 1

    def over(x: Column) -> Column:
        n = F.size(x)

        def at(i: Column) -> Column:
            near = F.transform(F.sequence(i - half, i + half), lambda k: F.get(x, F.greatest(F.lit(0), F.least(k, n - 1))))
            return fx.let(near, lambda a: fx.let(fx.array_mean(a), lambda m: (fx.array_dot(a, a) / size - m * m) * (size / (2 * half))))

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return fx.let(values, over)


def standard_acf(values: Column, lags: Column) -> Column:
    """r[0..lags] with fixed denominator; NULL array for a constant signal."""
    def corr(c: Column) -> Column:
        return fx.let(fx.array_dot(c, c), lambda e: F.when(e > 0, F.transform(
            F.sequence(F.lit(0), lags), lambda k: fx.array_sum(F.transform(
                F.sequence(k, F.size(c) - 1), lambda i: F.get(c, i) * F.get(c, i - k))) / e)))

    return fx.let(centered_array(values), corr)


def acf_lag_count(n: Column, fs: float, max_lag_s: float) -> Column:
    return F.least(F.floor(F.least(F.lit(max_lag_s), (n - 1) / fs) * fs).cast("int"), n - 1)


def curve_at(curve: Column, fs: float, points: int = 129, span: float = 0.4) -> Column:
    """Curve on integer lags read at `points` positions on 0..span seconds."""
    def read(c: Column) -> Column:
        def point(k: Column) -> Column:
            pos = k * F.lit(span * fs / (points - 1))
            lo = F.least(F.floor(pos).cast("int"), F.size(c) - 1)
            return F.get(c, lo) + (F.get(c, F.least(lo + 1, F.size(c) - 1)) - F.get(c, lo)) * (pos - lo)

        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), point)

    return fx.let(curve, read)


def _crossing(curve: Column, threshold: float, dt: float) -> Column:
    def at(j: Column) -> Column:
        a, b = F.get(curve, j - 1), F.get(curve, j)
        return F.when(j < 0, F.lit(None).cast("double")).when(j == 0, F.lit(0.0)).otherwise((j - 1 + (a - threshold) / (a - b)) * dt)

    return fx.let(F.array_position(F.transform(curve, lambda v: v <= threshold), F.lit(True)).cast("int") - 1, at)


def _peaks(curve: Column, sign: int, prominence: float) -> Column:
    """(index, value, prominence) of strict local maxima of sign*curve with at least this prominence, in order."""
    def with_prominence(v: Column) -> Column:
        n = F.size(v)
        inner = F.filter(F.sequence(F.lit(1), n - 2), lambda i: (F.get(v, i) > F.get(v, i - 1)) & (F.get(v, i) > F.get(v, i + 1)))

        def base(top: Column, side: Column) -> Column:
            # walk away from the peak until a higher sample, keeping the lowest value on the way
            start = F.struct(top.alias("lo"), F.lit(True).alias("open"))
            step = lambda s, k: fx.let(F.get(v, k), lambda x: fx.let(s["open"] & (x <= top), lambda on: F.struct(
                F.when(on, F.least(s["lo"], x)).otherwise(s["lo"]).alias("lo"), on.alias("open"))))
            return F.aggregate(side, start, step)["lo"]

        def measure(i: Column) -> Column:
            return fx.let(F.get(v, i), lambda top: F.struct(
                i.alias("i"), (top * sign).alias("value"),
                (top - F.greatest(base(top, F.sequence(i - 1, F.lit(0), F.lit(-1))), base(top, F.sequence(i + 1, n - 1)))).alias("prominence")))

        return F.filter(F.transform(inner, measure), lambda p: p["prominence"] >= prominence)

    return fx.let(curve if sign > 0 else F.transform(curve, lambda v: -v), with_prominence)


def acf_scalars(curve: Column, span: float = 0.4, points: int = 129, prominence: float = 0.02) -> Column:
    """Struct of ten descriptors of an ACF curve on 0..span seconds; missing features stay NULL, never lag 0."""
    dt = span / (points - 1)
    tail_from = math.ceil(0.3 / dt - 1e-9)
    trapezoid = lambda a: fx.array_sum(F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda x, y: (x + y) / 2 * dt))

    def area(c: Column, zero: Column) -> Column:
        upto = lambda kept: F.when(kept <= 0, F.lit(0.0)).otherwise(
            trapezoid(F.slice(c, 1, F.greatest(kept, F.lit(1)))) + F.get(c, kept - 1) / 2 * (zero - (kept - 1) * dt))
        return F.when(zero.isNull(), trapezoid(F.transform(c, lambda v: F.greatest(v, F.lit(0.0))))).otherwise(
            fx.let(F.ceil(zero / dt - 1e-12).cast("int"), upto))

    def describe(c: Column) -> Column:
        rest, tail = F.slice(c, 2, points - 1), F.slice(c, tail_from + 1, points - tail_from)

        def extrema(low: Column) -> Column:
            later = F.get(F.filter(_peaks(c, 1, prominence), lambda p: (p["i"] > low["i"]) & (p["value"] > 0)), F.lit(0))
            return fx.let(later, lambda high: fx.let(_crossing(c, 0.0, dt), lambda zero: F.struct(
                _crossing(c, 1 / math.e, dt).alias("decay_1e_sec"), zero.alias("first_zero_sec"),
                (low["i"] * dt).alias("first_min_lag_sec"), low["value"].alias("first_min_value"),
                (high["i"] * dt).alias("repeat_peak_lag_sec"), high["prominence"].alias("repeat_peak_prominence"),
                area(c, zero).alias("first_positive_area"),
                fx.array_mean(F.transform(rest, lambda v: F.when(v < 0, 1.0).otherwise(0.0))).alias("negative_fraction"),
                fx.array_mean(F.transform(tail, lambda v: F.abs(v))).alias("tail_abs_mean"),
                fx.array_sum(F.zip_with(F.slice(c, 1, points - 1), rest, lambda a, b: F.abs(b - a))).alias("total_variation"))))

        return fx.let(F.get(_peaks(c, -1, prominence), F.lit(0)), extrema)

    return fx.let(curve, describe)


def lag_product_map(values: Column, lags: int, time_bins: int = 64, lag_bins: int = 128, percentile: float = 0.995) -> Column:
    """Flattened lag_bins x time_bins map of z-scored products at lags 1..L, resized, scaled to a percentile and clipped."""
    def build(z: Column) -> Column:
        n = F.size(z)
        rows = F.transform(F.sequence(F.lit(1), F.lit(lags)), lambda k: fx.linear_resize(
            F.transform(F.sequence(F.lit(lags), n - 1), lambda i: F.get(z, i) * F.get(z, i - k)), time_bins))

        def scaled(m: Column) -> Column:
            return fx.let(fx.percentile_scale(F.flatten(m), percentile), lambda s: F.transform(m, lambda r: fx.clip_to_scale(r, s)))

        def resized(m: Column) -> Column:
            def row(k: Column) -> Column:
                pos = k * F.lit((lags - 1) / (lag_bins - 1))
                lo = F.least(F.floor(pos).cast("int"), F.lit(max(lags - 2, 0)))
                return F.zip_with(F.get(m, lo), F.get(m, F.least(lo + 1, F.lit(lags - 1))), lambda a, b: a + (b - a) * (pos - lo))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(lag_bins - 1)), row))

        return fx.let(fx.let(rows, scaled), resized)

    return fx.let(zscore(values, 1e-6), build)


# --- wavelet ---------------------------------------------------------------------------------------------

def _high_pass() -> list[float]:
    return [(-1) ** (k + 1) * v for k, v in enumerate(reversed(DB4))]


def _mirror(i: Column, n: Column) -> Column:
    return F.when(i < 0, -1 - i).when(i >= n, 2 * n - 1 - i).otherwise(i)


def _analysis(values: Column, taps: list[float]) -> Column:
    weights = F.array(*[F.lit(v) for v in taps])

    def filtered(x: Column) -> Column:
        n = F.size(x)
        out = F.floor((n + len(taps) - 1) / 2).cast("int")
        return F.transform(F.sequence(F.lit(0), out - 1), lambda k: fx.array_sum(F.transform(
            weights, lambda w, j: w * F.get(x, _mirror(2 * k + 1 - j, n)))))

    return fx.let(values, filtered)


def wavelet_bands(df: DataFrame, values: str, levels: int = 5) -> DataFrame:
    """db4 decomposition with symmetric extension: columns cA and cD1 (coarsest) .. cD{levels} (finest)."""
    out = df.withColumn("__a", F.col(values))
    for level in range(levels):
        # one projection per level keeps each array evaluated once
        out = out.withColumns({f"cD{levels - level}": _analysis(F.col("__a"), _high_pass()), "__next": _analysis(F.col("__a"), DB4)})
        out = out.drop("__a").withColumnRenamed("__next", "__a")
    return out.withColumnRenamed("__a", "cA")


def band_names(levels: int = 5) -> list[str]:
    return ["cA"] + [f"cD{i}" for i in range(1, levels + 1)]


def energy_entropy(bands: DataFrame, levels: int = 5) -> DataFrame:
    """Energies per band, their total and the base-2 entropy of the shares."""
    names = band_names(levels)
    e = bands.withColumns({f"e_{b}": fx.array_dot(F.col(b), F.col(b)) for b in names}).drop(*names)
    total = sum((F.col(f"e_{b}") for b in names), F.lit(0.0))
    e = e.withColumn("e_total", total)
    parts = [F.when(F.col(f"e_{b}") / F.col("e_total") > 1e-10, -(F.col(f"e_{b}") / F.col("e_total")) * F.log2(F.col(f"e_{b}") / F.col("e_total"))).otherwise(0.0) for b in names]
    return e.withColumn("entropy", F.when(F.col("e_total") < 1e-10, 0.0).otherwise(sum(parts, F.lit(0.0))))


def scalogram_rows(bands: DataFrame, keys: Sequence[str], n: int, levels: int = 5) -> DataFrame:
    """Each band min-max scaled and stretched to n points; rows from low to high frequency."""
    order = ["cA"] + [f"cD{i}" for i in range(levels, 0, -1)]
    lo_hi = lambda c: fx.let(F.struct(F.array_min(c).alias("lo"), F.array_max(c).alias("hi")), lambda s: F.transform(c, lambda v: (v - s["lo"]) / (s["hi"] - s["lo"] + 1e-10)))
    rows = F.array(*[F.struct(F.lit(k).alias("row"), F.lit(b).alias("band"), F.col(b).alias("c")) for k, b in enumerate(order)])
    r = bands.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.row", "r.band", lo_hi(F.col("r.c")).alias("c"))
    return r.withColumn("values", fx.linear_resize(F.col("c"), n)).drop("c")


def _synthesis(a: Column, d: Column) -> Column:
    low, high = list(reversed(DB4)), list(reversed(_high_pass()))
    taps = len(DB4)

    def rebuild(pair: Column) -> Column:
        def at(t: Column) -> Column:
            # taps of matching parity: coefficient k contributes tap t + 6 - 2k
            first, odd = F.floor((t + taps - 2) / 2).cast("int"), (t + taps - 2) % 2
            total = F.lit(0.0)
            for j in range(taps // 2):
                k = first - j
                w_low = F.when(odd == 0, F.lit(low[2 * j])).otherwise(F.lit(low[2 * j + 1]))
                w_high = F.when(odd == 0, F.lit(high[2 * j])).otherwise(F.lit(high[2 * j + 1]))
                total = total + F.coalesce(F.get(pair["a"], k) * w_low + F.get(pair["d"], k) * w_high, F.lit(0.0))
            return total

        return F.transform(F.sequence(F.lit(0), 2 * F.size(pair["d"]) - taps + 1), at)

    return fx.let(F.struct(a.alias("a"), d.alias("d")), rebuild)


def reconstruct(bands: DataFrame, levels: int = 5) -> DataFrame:
    """Inverse transform to column `rebuilt`."""
    out = bands.withColumn("rebuilt", F.col("cA"))
    for i in range(1, levels + 1):
        out = out.withColumn("rebuilt", _synthesis(F.slice("rebuilt", 1, F.size(f"cD{i}")), F.col(f"cD{i}")))
    return out


def reconstruction_error(df: DataFrame, original: str, rebuilt: str) -> DataFrame:
    err = F.zip_with(F.col(original), F.slice(rebuilt, 1, F.size(original)), lambda a, b: a - b)
    out = df.withColumn("__e", err)
    mse = fx.array_dot(F.col("__e"), F.col("__e")) / F.size("__e")
    power = fx.array_dot(F.col(original), F.col(original)) / F.size(original)
    return out.withColumns({"mse": mse, "rmse": F.sqrt(mse), "mae": fx.array_mean(F.transform("__e", lambda v: F.abs(v))), "snr_db": 10 * F.log10(power / (mse + 1e-10))}).drop("__e")


# --- time-frequency --------------------------------------------------------------------------------------

def morlet_maps(df: DataFrame, values: str, fs: float, size: int = 224, low_hz: float = 1.0, high_hz: float = 170.0) -> DataFrame:
    """Max-normalised |CWT| at `size` linear frequencies, high to low, flattened to `scalogram`."""
    freqs = np.linspace(low_hz, min(high_hz, fs / 2 - 1e-6), size)[::-1]

    def run(x: np.ndarray) -> dict[str, list]:
        maps = kernels.morlet_scalograms(x, freqs, fs).reshape(len(x), -1)
        top = maps.max(-1, keepdims=True)
        return {"scalogram": list(maps / np.where(top > 0, top, 1.0))}

    return batched(df, values, run, _schema(df, values, "scalogram array<double>"))


def general_denoise(row: Column, q: Column, threshold_max: float = 1.0) -> Column:
    """Zero the cells of one map row below rowmean * min(1/log10 q, max)."""
    usable = q.isNotNull() & (q > 1.0) & (F.log10(q) > 0)
    level = F.when(usable, F.least(1.0 / F.log10(F.when(usable, q).otherwise(F.lit(10.0))), F.lit(threshold_max))).otherwise(F.lit(threshold_max))
    return fx.let(fx.array_mean(row) * level, lambda t: F.transform(row, lambda v: F.when(v < t, 0.0).otherwise(v)))


def minimum_run(bandwidth: Column, fs: float, carrier_hz: float = 2.4e9, kappa: float = 1.0) -> Column:
    wavelength = 299_792_458.0 / carrier_hz
    return F.greatest(F.lit(1), F.ceil(bandwidth * wavelength / max(kappa * 9.80665 / fs, 1e-12))).cast("int")


def horizontal_denoise(row: Column, minimum: Column) -> Column:
    """Zero the non-zero runs of one map row that are shorter than `minimum`."""
    def stretch(i: Column, step: int) -> Column:
        side = F.sequence(i, F.lit(0), F.lit(-1)) if step < 0 else F.sequence(i, F.size(row) - 1)
        return F.aggregate(side, F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), lambda s, k: F.struct(
            F.when(s["open"] & (F.get(row, k) > 0), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["open"] & (F.get(row, k) > 0)).alias("open")))["n"]

    return F.transform(row, lambda v, i: F.when((v > 0) & (stretch(i, -1) + stretch(i, 1) - 1 < minimum), 0.0).otherwise(v))


def vertical_denoise(df: DataFrame, values: str, freqs: Sequence[float], step_hz: float) -> DataFrame:
    """Column-wise reachability on a flattened map; state runs along time inside one map."""
    f = np.asarray(freqs)
    run = lambda x: {values: [kernels.keep_reachable(m.reshape(len(f), -1), f, step_hz).ravel() for m in x]}
    return batched(df, values, run, _schema(df, values, f"`{values}` array<double>"))


def spectrogram(df: DataFrame, values: str, fs: float, resolution_hz: float = 2.0, overlap: float = 0.9) -> DataFrame:
    """One row per frame: (keys, frame, mag array over frequency bins)."""
    def run(x: np.ndarray) -> dict[str, list]:
        mag, _ = kernels.stft_magnitude(x, fs, resolution_hz, overlap)
        return {"frames": [list(m) for m in mag]}

    packed = batched(df, values, run, _schema(df, values, "frames array<array<double>>"))
    return packed.select(*[c for c in packed.columns if c != "frames"], F.posexplode("frames").alias("frame", "mag"))


def higuchi(curve: Column) -> Column:
    """Higuchi dimension of a short curve clipped to [1, 2]; 1 when flat, NULL when too short."""
    n = F.size(curve)
    kmax = F.greatest(F.lit(3), F.least(F.floor(n / 3).cast("int"), F.lit(10)))

    def length(k: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), k - 1), lambda m: F.floor((n - m - 1) / k) >= 1)

        def one(m: Column) -> Column:
            cnt = F.floor((n - m - 1) / k).cast("int")
            dist = fx.array_sum(F.transform(F.sequence(F.lit(1), cnt), lambda i: F.abs(F.get(curve, (m + i * k).cast("int")) - F.get(curve, (m + (i - 1) * k).cast("int")))))
            return dist * (n - 1) / (cnt * k) / k

        return fx.array_mean(F.transform(starts, one))

    points = F.filter(F.transform(F.sequence(F.lit(1), kmax), lambda k: F.struct(F.ln(1.0 / k).alias("x"), length(k).alias("l"))), lambda p: p["l"] > 0)

    def slope(p: Column) -> Column:
        x, y = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: F.ln(v["l"]))
        cx, cy = centered_array(x), centered_array(y)
        return F.when(F.size(p) >= 3, F.greatest(F.lit(1.0), F.least(F.lit(2.0), fx.array_dot(cx, cy) / fx.array_dot(cx, cx))))

    flat = F.array_max(curve) <= F.array_min(curve)
    return F.when(n < 6, F.lit(None).cast("double")).when(flat, F.lit(1.0)).otherwise(fx.let(points, slope))


def stft_features(frames: DataFrame, keys: Sequence[str], fs: float, bins: int, resolution: float, hop_s: float, noise_k: float = 3.0, pbc=(5.0, 25.0), min_hz: float = 1.0) -> DataFrame:
    """Spectral fall features from spectrogram frames. All windows share one partitioning by `keys` (bounded frames)."""
    freqs = [k * resolution for k in range(bins)]
    per = Window.partitionBy(*keys)
    take = lambda lo, hi: F.slice("mag", lo + 1, hi - lo)
    noise_from = next(k for k, f in enumerate(freqs) if f >= fs / 4)
    noise_n = bins - noise_from
    nb = take(noise_from, bins)
    f = frames.withColumns({"__s": fx.array_sum(nb), "__ss": fx.array_dot(nb, nb)})
    cells = F.count("*").over(per) * noise_n
    f = f.withColumns({"__mu": F.sum("__s").over(per) / cells, "__m2": F.sum("__ss").over(per) / cells})
    f = f.withColumn("noise", F.col("__mu") + noise_k * F.sqrt(F.greatest(F.col("__m2") - F.col("__mu") * F.col("__mu"), F.lit(0.0)))).drop("__s", "__ss", "__mu", "__m2")
    lo_p = next(k for k, x in enumerate(freqs) if x >= pbc[0])
    hi_p = max(k for k, x in enumerate(freqs) if x <= pbc[1]) + 1
    f = f.withColumn("pbc", fx.array_sum(take(lo_p, hi_p))).withColumn("pbc_threshold", F.col("noise") * (hi_p - lo_p))
    f = f.withColumn("above", F.col("pbc") > F.col("pbc_threshold"))
    # longest run above: island number = frame - rank among frames above
    rank = F.row_number().over(Window.partitionBy(*keys, "above").orderBy("frame"))
    f = f.withColumn("__island", F.when(F.col("above"), F.col("frame") - rank))
    f = f.withColumn("__run", F.when(F.col("above"), F.count("*").over(Window.partitionBy(*keys, "__island"))))
    f = f.withColumn("__best", F.max("__run").over(per))
    f = f.withColumn("__start", F.min(F.when(F.col("__run") == F.col("__best"), F.col("frame"))).over(per))
    inside = F.coalesce((F.col("frame") >= F.col("__start")) & (F.col("frame") < F.col("__start") + F.col("__best")), F.lit(False))
    whole = F.col("__best").isNull() | (F.col("__best") < 2)
    f = f.withColumn("event", whole | inside)
    k0 = next(k for k, x in enumerate(freqs) if x >= min_hz)
    grid = F.sequence(F.lit(k0), F.lit(bins - 1))
    seg = F.transform("mag", lambda v: F.when(v >= F.col("noise"), v).otherwise(0.0))
    top = F.array_max(F.filter(grid, lambda k: F.get("mag", k) >= F.col("noise")))
    f = f.withColumn("ef", F.coalesce(top * F.lit(resolution), F.lit(0.0))).withColumn("__seg", seg)

    def torso(p: Column) -> Column:
        total = fx.array_sum(p)
        part = F.transform(p, lambda _, i: fx.array_sum(F.slice(p, 1, i + 1)))
        first = F.array_position(F.transform(part, lambda c: c / total >= 0.5), F.lit(True)).cast("int") - 1
        return F.when(total > 0, (F.when(first >= 0, first).otherwise(F.size(p) - 1) + k0) * F.lit(resolution)).otherwise(F.lit(0.0))

    f = f.withColumn("tf", fx.let(F.transform(F.slice("__seg", k0 + 1, bins - k0), lambda v: v * v), torso))
    for name, lo, hi in (("1_10", 1.0, 10.0), ("10_30", 10.0, 30.0), ("30_max", 30.0, freqs[-1])):
        ks = [k for k, x in enumerate(freqs) if lo <= x <= hi]
        if len(ks) < 2:
            f = f.withColumn(f"h_{name}", F.lit(None).cast("double"))
            continue
        power = F.transform(take(ks[0], ks[-1] + 1), lambda v: v * v)
        h = fx.let(power, lambda p: fx.let(fx.array_sum(p), lambda s: F.when(s > 0, -fx.array_sum(F.transform(p, lambda v: F.when(v > 0, v / s * F.ln(v / s)).otherwise(0.0))))))
        f = f.withColumn(f"h_{name}", h)
    in_event = lambda c: F.when(F.col("event"), F.col(c))
    curve = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("frame", "ef")))), lambda s: s["ef"])
    out = f.groupBy(*keys).agg(
        F.avg(in_event("ef")).alias("ef_mean"), F.stddev_pop(in_event("ef")).alias("ef_std"), F.max(in_event("ef")).alias("ef_max"),
        F.avg(in_event("tf")).alias("tf_mean"), F.stddev_pop(in_event("tf")).alias("tf_std"), F.max(in_event("tf")).alias("tf_max"),
        *[F.avg(in_event(f"h_{n}")).alias(f"entropy_{n}") for n in ("1_10", "10_30", "30_max")],
        F.count("*").alias("frames"), F.max("noise").alias("noise_threshold"), F.max("__best").alias("__best"),
        F.sum(F.when(F.col("above"), F.col("pbc") - F.col("pbc_threshold"))).alias("__over"), F.sum(F.when(~F.col("above"), F.col("pbc"))).alias("__under"),
        curve(F.col("event")).alias("__ev"), curve(F.lit(True)).alias("__all"))
    return out.withColumns({
        "fractal_dim": higuchi(F.when(F.size("__ev") >= 6, F.col("__ev")).otherwise(F.col("__all"))),
        "event_detected": F.col("__best").isNotNull(), "event_duration": F.coalesce(F.col("__best"), F.lit(0)) * F.lit(hop_s),
        "ef_tf_ratio": F.when(F.col("tf_max") > 0, F.col("ef_max") / F.nullif(F.col("tf_max"), F.lit(0.0))),
        "pbc_energy_ratio": F.when(F.col("__under") > 0, F.coalesce("__over", F.lit(0.0)) / F.nullif(F.col("__under"), F.lit(0.0)))}).drop("__best", "__over", "__under", "__ev", "__all")


def welch_band_energy(values: Column, n: int, fs: float, low_hz: float, high_hz: float) -> Column:
    """Trapezoid of a single-segment Hann periodogram over a band; only the band's bins are computed."""
    bins = [k for k in range(n // 2 + 1) if low_hz <= k * fs / n <= high_hz]
    if n < 8 or not bins:
        return F.lit(0.0)
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)]
    scale = fs * sum(v * v for v in hann)
    taper = F.array(*[F.lit(v) for v in hann])

    def power(w: Column, k: int) -> Column:
        angle = 2 * math.pi * k / n
        re = fx.array_sum(F.transform(w, lambda v, i: v * F.cos(i * angle)))
        im = fx.array_sum(F.transform(w, lambda v, i: v * F.sin(i * angle)))
        side = 1.0 if k == 0 or 2 * k == n else 2.0
        return (re * re + im * im) * (side / scale)

    def energy(w: Column) -> Column:
        psd = F.array(*[power(w, k) for k in bins])
        return fx.let(psd, lambda p: fx.array_sum(F.zip_with(F.slice(p, 1, len(bins) - 1), F.slice(p, 2, len(bins) - 1), lambda a, b: (a + b) / 2 * (fs / n)))) if len(bins) > 1 else F.lit(0.0)

    return fx.let(F.zip_with(centered_array(values), taper, lambda a, b: a * b), energy)


# --- composed chains -------------------------------------------------------------------------------------

def summed_channels(df: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """Element-wise sum of the channel arrays of each window (bounded number of equal-length channels)."""
    return df.groupBy(*keys).agg(F.collect_list(values).alias("__x")).withColumn(
        "signal", F.aggregate(F.slice("__x", 2, F.size("__x")), F.get("__x", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))).drop("__x")


def presence_signal(windows: DataFrame, keys: Sequence[str], channel: str, values: str, fs: float, half: int, top: int, low_hz: float, high_hz: float) -> DataFrame:
    """Band-pass -> top channels by q -> sum and z-score; packed windows in, one `signal` per window out."""
    from echogrid.operators.topk import topk_streams

    filtered = bandpass(windows.select(*keys, channel, values), values, fs, low_hz, high_hz)
    mv = moving_variance_array(F.transform(values, lambda v: F.abs(v)), half)
    q = fx.let(mv, lambda v: fx.let(fx.array_mean(v), lambda m: F.when(m < 1e-10, 0.0).otherwise(F.array_max(v) / m)))
    best = topk_streams(filtered.withColumn("q", q), keys, channel, top, threshold=False)
    return summed_channels(best, keys, values).withColumn("signal", zscore(F.col("signal")))


def representative_signal(windows: DataFrame, keys: Sequence[str], channel: str, values: str, fs: float, half: int, top: int, low_hz: float, high_hz: float) -> DataFrame:
    """Band-pass -> stream choice by q share -> covariance components -> summed, z-scored signal with stage counts."""
    from echogrid.operators.topk import topk_streams

    filtered = bandpass(windows.select(*keys, channel, values), values, fs, low_hz, high_hz)
    mv = moving_variance_array(F.transform(values, lambda v: F.abs(v)), half)
    q = fx.let(mv, lambda v: fx.let(fx.array_mean(v), lambda m: F.when(m < 1e-10, 0.0).otherwise(F.array_max(v) / m)))
    chosen = topk_streams(filtered.withColumn("q", q), keys, channel, top).filter("selected")
    packed = pack_channels(chosen, keys, channel, values).withColumn("selected_streams", F.size("channels"))
    return covariance_component_signal(packed, half).withColumn("signal", zscore(F.col("signal"), 1e-10))


def edge_reject_reason(frames: Column, span_s: Column, length: Column, window_s: float, samples: int) -> Column:
    """Why a live window yields no signal; NULL when it does."""
    return F.when(frames < 8, "too_few_frames").when(span_s < 0.9 * window_s, "short_span").when(length < samples, "short_length")


def baseline_threshold(df: DataFrame, keys: Sequence[str], value: str, k: float = 2.0, floor: float = 0.3) -> DataFrame:
    """max(mean + k*sd, floor) after Tukey outlier removal that is skipped when it would remove too much."""
    v = materialize(df.select(*keys, F.col(value).alias("v")))
    q = o.percentiles(v, keys, "v", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("v").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    pick = F.when(inside, F.col("v"))
    s = v.join(q, list(keys)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(pick).alias("kept"), F.max(iqr).alias("iqr"), F.avg(pick).alias("m1"), F.stddev_pop(pick).alias("s1"), F.avg("v").alias("m0"), F.stddev_pop("v").alias("s0"))
    use = (F.col("n") >= 4) & (F.col("iqr") > 0) & (F.col("kept") >= F.greatest(F.lit(4), F.floor(F.col("n") / 2)))
    return s.select(*keys, "n", F.when(use, F.col("kept")).otherwise(F.col("n")).alias("kept"),
                    F.greatest(F.when(use, F.col("m1") + k * F.col("s1")).otherwise(F.col("m0") + k * F.col("s0")), F.lit(floor)).alias("threshold"))


def band_patches(files: DataFrame, file: str, positions: int, bands: int = 3, per_band: int = 30, patches: int = 15, seed: int = 0) -> DataFrame:
    """Per file and patch `per_band` slots of each contiguous band, drawn in hash order."""
    size, extra = divmod(positions, bands)
    edge = extra * (size + 1)
    slot = F.col("slot")
    band = F.when(slot < edge, F.floor(slot / (size + 1))).otherwise(extra + F.floor((slot - edge) / size)).cast("int")
    slots = files.select(file, F.explode(F.sequence(F.lit(0), F.lit(patches - 1))).alias("patch")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(positions - 1))))
    keyed = slots.withColumns({"band": band, "__h": fx.stable_order(seed, F.col(file), F.col("patch"), slot)})
    # a (file, patch, band) group holds positions / bands slots: a hardware constant
    w = Window.partitionBy(file, "patch", "band").orderBy("__h", "slot")
    return keyed.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_band).drop("__h", "rn")


def q_landscape(q: DataFrame, keys: Sequence[str], channel: str, k: int) -> DataFrame:
    """Every candidate stream with rank, share, threshold, selected and fallback flags; nothing is dropped."""
    w = Window.partitionBy(*keys)
    r = q.withColumn("rank", F.row_number().over(w.orderBy(F.col("q").desc(), F.col(channel))))
    top = F.col("rank") <= k
    r = r.withColumns({"in_top": top, "threshold": 1.0 / F.sum(top.cast("int")).over(w), "share": F.when(top, F.col("q") / (F.sum(F.when(top, F.col("q"))).over(w) + 1e-10))})
    passed = F.coalesce(F.col("share") >= F.col("threshold"), F.lit(False))
    anyp = F.max(passed.cast("int")).over(w) == 1
    return r.withColumns({"selected": passed | (~anyp & (F.col("rank") == 1)), "fallback": ~anyp & (F.col("rank") == 1)})
