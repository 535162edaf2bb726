"""Ordered operators on series.

Two kinds of input:
* a series with a dense sample index: fixed frames run inside index chunks with a halo, one shuffle, any length;
* a series ordered by time: prefix scans over time chunks.
Filters that by definition stay inside one packed window work on its array and need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.functions import scalars as fx
from echogrid.operators import ordered as o
from echogrid.operators import topk
from echogrid.operators.transducer import whole_groups
from echogrid.session import materialize

WRAP = 1 << 32


# --- moving statistics on a dense index ------------------------------------------------------------------

def moving_stats(df: DataFrame, keys: Sequence[str], index: str, value: str, radius: int) -> DataFrame:
    """`mean`, `sum` and `variance` over +-radius samples, truncated at the ends, variance clamped at zero."""
    spread, w = o.with_halo(df, keys, index, radius, radius)
    frame = w.rowsBetween(-radius, radius)
    mean = F.avg(value).over(frame)
    square = F.avg(F.col(value) * F.col(value)).over(frame)
    out = spread.withColumns({"mean": mean, "sum": F.sum(value).over(frame), "__sq": square})
    out = out.withColumn("variance", F.greatest(F.col("__sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return o.own_rows(out.drop("__sq"))


def moving_variance_padded(df: DataFrame, keys: Sequence[str], index: str, value: str, half: int) -> DataFrame:
    """Variance over a fixed 2W+1 window with the end values repeated, scaled by (2W+1)/2W; W=0 gives zero."""
    ends = df.groupBy(*keys).agg(
        F.min_by(value, index).alias("__first"), F.max_by(value, index).alias("__last"), F.max(index).alias("__end"))
    spread, w = o.with_halo(df, keys, index, half, half)
    frame = w.rowsBetween(-half, half)
    sums = spread.withColumns({"__s": F.sum(value).over(frame), "__ss": F.sum(F.col(value) * F.col(value)).over(frame)})
    sums = o.own_rows(sums).join(ends, list(keys))
    left = F.greatest(F.lit(0), F.lit(half) - F.col(index))
    right = F.greatest(F.lit(0), F.col(index) + half - F.col("__end"))
    size = 2 * half + 1
    mean = (F.col("__s") + left * F.col("__first") + right * F.col("__last")) / size
    square = (F.col("__ss") + left * F.pow("__first", 2) + right * F.pow("__last", 2)) / size
    scale = size / (2 * half) if half > 0 else 1.0
    return sums.withColumn("variance", (square - mean * mean) * scale).drop("__s", "__ss", "__first", "__last", "__end")


def q_metric(df: DataFrame, keys: Sequence[str], index: str, value: str, radius: int, floor: float = 1e-8) -> DataFrame:
    """max / mean of the moving variance of |x| per series (truncated-window variant)."""
    mv = moving_stats(df.withColumn("__abs", F.abs(value)), keys, index, "__abs", radius)
    return mv.groupBy(*keys).agg((F.max("variance") / F.greatest(F.avg("variance"), F.lit(floor))).alias("q"))


def q_metric_padded(df: DataFrame, keys: Sequence[str], index: str, value: str, half: int, dead: float = 1e-10) -> DataFrame:
    """max / mean of the moving variance of |x|, 0 for dead series (padded-window variant)."""
    mv = moving_variance_padded(df.withColumn("__abs", F.abs(value)), keys, index, "__abs", half)
    mean = F.avg("variance")
    return mv.groupBy(*keys).agg(F.when(mean < dead, 0.0).otherwise(F.max("variance") / F.nullif(mean, F.lit(0.0))).alias("q"))


# --- clocks ----------------------------------------------------------------------------------------------

def _with_gap(df, keys, order, time, chunk):
    back = o.prefix_scan(df, keys, order, {"__prev": ("prev", time)}, chunk)
    return back.withColumn("gap", F.col(time) - F.col("__prev")).drop("__prev")


def unwrap_clock(df: DataFrame, keys, order, time: str, any_backward: bool = False, chunk: Column | None = None) -> DataFrame:
    """Adds 2^32 after each wrap: a jump back by more than 2^31, or any backward step with `any_backward`."""
    limit = 0 if any_backward else WRAP // 2
    stepped = materialize(_with_gap(df, keys, order, time, chunk).withColumn("__wrap", F.when(F.col("gap") < -limit, F.lit(1)).otherwise(F.lit(0))))
    out = o.prefix_scan(stepped, keys, order, {"wraps": ("sum", "__wrap")}, chunk)
    return out.withColumn("unwrapped", F.col(time) + F.col("wraps") * WRAP).drop("__wrap", "gap")


def reset_epochs(df: DataFrame, keys, order, time: str, back_s: float = 0.5, ahead_s: float = 60.0, chunk: Column | None = None) -> DataFrame:
    """Epoch number that grows whenever the clock leaves [previous - back, previous + ahead]."""
    jump = F.col("gap").isNotNull() & ~F.col("gap").between(-back_s, ahead_s)
    stepped = materialize(_with_gap(df, keys, order, time, chunk).withColumn("__jump", jump.cast("int")))
    return o.prefix_scan(stepped, keys, order, {"epoch": ("sum", "__jump")}, chunk).drop("__jump", "gap")


def repair_gaps(df: DataFrame, keys, order, time: str, nominal: float, chunk: Column | None = None) -> DataFrame:
    """Non-positive gaps become the nominal gap; the new clock is their running sum from 0."""
    gap = F.when(F.col("gap").isNull(), F.lit(0.0)).when(F.col("gap") <= 0, F.lit(nominal)).otherwise(F.col("gap").cast("double"))
    stepped = _with_gap(df, keys, order, time, chunk).withColumns({"__gap": gap, "repaired": F.coalesce(F.col("gap") <= 0, F.lit(False))})
    return o.prefix_scan(materialize(stepped), keys, order, {"clock": ("sum", "__gap")}, chunk).drop("__gap", "gap")


def native_rate(df: DataFrame, keys, order, time: str, chunk: Column | None = None, unit: float = 1e6, grid: float = 0.25) -> DataFrame:
    """Native rate 1 / median positive gap per series, and the same on a 0.25 Hz grid."""
    gaps = _with_gap(df, keys, order, time, chunk).filter("gap > 0").select(*keys, "gap")
    med = o.percentiles(gaps, keys, "gap", {"median_gap": 0.5})
    fs = F.lit(unit) / F.col("median_gap")
    return med.withColumns({"fs": fs, "fs_grid": F.greatest(F.bround(fs / grid) * grid, F.lit(grid))})


# --- islands ---------------------------------------------------------------------------------------------

def true_runs(df: DataFrame, keys, index: str, flag: Column, chunk_rows: int = 65_536) -> DataFrame:
    """Half-open index intervals [a, b) where the flag holds."""
    r = o.runs(df, keys, [index], F.coalesce(flag, F.lit(False)), [F.min(index).alias("a"), (F.max(index) + 1).alias("b")], F.floor(F.col(index) / chunk_rows))
    return r.filter("value").select(*keys, "a", "b")


def longest_run(runs: DataFrame, keys) -> DataFrame:
    """Longest run per series; the earliest wins ties."""
    best = F.max(F.struct((F.col("b") - F.col("a")).alias("len"), (-F.col("a")).alias("early"), "b"))
    return runs.groupBy(*keys).agg(best.alias("m")).select(*keys, (-F.col("m.early")).alias("a"), "m.b")


def threshold_segments(df: DataFrame, keys, index: str, time: str, value: str, threshold: float, min_duration: float, merge_gap: float, max_duration: float, chunk_rows: int = 65_536) -> DataFrame:
    """Runs above a threshold -> minimum duration -> merge small gaps -> cap to a centred maximum duration.

    Merging averages pairwise from the left, so the j-th of m merged averages has weight 2^-(m-j+1) (the first 2^-(m-1)).
    """
    found = o.runs(df, keys, [index], F.col(value) > threshold, [F.min(time).alias("start_s"), F.max(time).alias("end_s"), F.avg(value).alias("avg")], F.floor(F.col(index) / chunk_rows))
    kept = found.filter("value").filter(F.col("end_s") - F.col("start_s") >= min_duration).select(*keys, "start_s", "end_s", "avg")
    kept = o.sorted_chunks(kept, keys, ["start_s"])
    linked = o.prefix_scan(kept, keys, ["start_s"], {"__end": ("prev", "end_s")})
    apart = (F.col("__end").isNull() | (F.col("start_s") - F.col("__end") > merge_gap)).cast("int")
    grouped = o.prefix_scan(materialize(linked.withColumn("__new", apart)), keys, ["start_s"], {"__grp": ("sum", "__new")})
    placed = o.prefix_scan(materialize(grouped), [*keys, "__grp"], ["start_s"], {"__j": ("sum", F.lit(1))})
    sizes = grouped.groupBy(*keys, "__grp").agg(F.count("*").alias("__m"))
    weight = F.pow(F.lit(2.0), -(F.col("__m") - F.greatest(F.col("__j"), F.lit(2)) + 1).cast("double"))
    merged = placed.join(sizes, [*keys, "__grp"]).groupBy(*keys, "__grp").agg(
        F.min("start_s").alias("s"), F.max("end_s").alias("e"), F.sum(F.col("avg") * F.when(F.col("__m") == 1, F.lit(1.0)).otherwise(weight)).alias("avg"))
    long = F.col("e") - F.col("s") > max_duration
    mid = (F.col("s") + F.col("e")) / 2
    return merged.select(*keys, F.when(long, mid - max_duration / 2).otherwise(F.col("s")).alias("start_s"),
                         F.when(long, mid + max_duration / 2).otherwise(F.col("e")).alias("end_s"),
                         F.when(long, F.lit(float(max_duration))).otherwise(F.col("e") - F.col("s")).alias("duration"), "avg")


def minmax_motion(df: DataFrame, keys, channel: str, index: str, value: str, half: int, top: int = 10) -> DataFrame:
    """Moving variance averaged over the top-q channels of a recording, scaled to 0..1 (all zero when flat)."""
    absolute = df.withColumn("__abs", F.abs(value))
    mv = materialize(moving_variance_padded(absolute, [*keys, channel], index, "__abs", half).select(*keys, channel, index, "variance"))
    mean = F.avg("variance")
    q = mv.groupBy(*keys, channel).agg(F.when(mean < 1e-10, 0.0).otherwise(F.max("variance") / F.nullif(mean, F.lit(0.0))).alias("q"))
    best = topk.topk_streams(q, keys, channel, top, threshold=False).select(*keys, channel)
    avg = mv.join(best, [*keys, channel]).groupBy(*keys, index).agg(F.avg("variance").alias("mv"))
    ends = avg.groupBy(*keys).agg(F.min("mv").alias("lo"), F.max("mv").alias("hi"))
    flat = F.col("hi") - F.col("lo") < 1e-10
    return avg.join(ends, list(keys)).withColumn("mv_norm", F.when(flat, 0.0).otherwise((F.col("mv") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))).drop("lo", "hi")


# --- votes and smoothing on a dense index ----------------------------------------------------------------

def centered_mode(df: DataFrame, keys, index: str, flag: str, size: int) -> DataFrame:
    """Majority of a centred window; rows without a full window and even ties keep their own value."""
    left, right = (size // 2, size // 2) if size % 2 else (size // 2 - 1, size // 2)
    spread, w = o.with_halo(df, keys, index, left, right)
    frame = w.rowsBetween(-left, right)
    out = spread.withColumns({"__ones": F.sum(flag).over(frame), "__n": F.count("*").over(frame)})
    vote = F.when(F.col("__n") < size, F.col(flag)).when(2 * F.col("__ones") > size, 1).when(2 * F.col("__ones") < size, 0).otherwise(F.col(flag))
    return o.own_rows(out.withColumn("mode", vote).drop("__ones", "__n"))


def causal_majority(df: DataFrame, keys, index: str, flag: str, size: int = 5, need: int = 3, previous: bool = False) -> DataFrame:
    """1 when the last `size` rows exist and at least `need` of them are set; `previous` adds the prior row's vote too."""
    spread, w = o.with_halo(df, keys, index, size if previous else size - 1, 0)

    def vote(ahead: int) -> Column:
        frame = w.rowsBetween(-(size - 1) - ahead, -ahead)
        return ((F.count("*").over(frame) == size) & (F.sum(flag).over(frame) >= need)).cast("int")

    out = spread.withColumn("majority", vote(0))
    if previous:
        out = out.withColumn("previous_majority", F.when(F.col(index) > 0, vote(1)))
    return o.own_rows(out)


def weighted_smooth(df: DataFrame, keys, index: str, value: str) -> DataFrame:
    """.4/.3/.3 over three rows, .6/.4 over two, the raw value on the first."""
    spread, w = o.with_halo(df, keys, index, 2, 0)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    out = spread.withColumns({"__a": one, "__b": two})
    smooth = F.when(F.col(index) >= 2, 0.4 * F.col(value) + 0.3 * F.col("__a") + 0.3 * F.col("__b")).when(
        F.col(index) == 1, 0.6 * F.col(value) + 0.4 * F.col("__a")).otherwise(F.col(value))
    return o.own_rows(out.withColumn("smoothed", smooth).drop("__a", "__b"))


def debounce_confirm(df: DataFrame, keys, order, time: str, active: Column, seconds: float, unit: float = 1e6, chunk: Column | None = None) -> DataFrame:
    """Confirmed when the condition has held without a break for `seconds` since its streak began."""
    flagged = df.withColumn("active", F.coalesce(active, F.lit(False)))
    back = o.prefix_scan(flagged, keys, order, {"__was": ("prev", "active")}, chunk)
    starts = F.when(F.col("active") & ~F.coalesce(F.col("__was"), F.lit(False)), F.col(time))
    marked = materialize(back.withColumn("__start", starts).drop("__was"))
    held = o.prefix_scan(marked, keys, order, {"__since": ("last", "__start")}, chunk)
    return held.withColumn("confirmed", F.col("active") & ((F.col(time) - F.col("__since")) / unit >= seconds)).drop("__start", "__since")


def bh_fdr(df: DataFrame, family: Sequence[str], p: str, row_id: str, out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg step-up inside each family; NULL / NaN p pass through as NULL."""
    usable = F.when(F.col(p).isNotNull() & ~F.isnan(p), F.col(p))
    ok = df.withColumn("__p", usable).filter("__p IS NOT NULL")
    keys = list(family) or ["__all"]
    if not family:
        df, ok = df.withColumn("__all", F.lit(0)), ok.withColumn("__all", F.lit(0))
    ranked = materialize(o.number_rows(o.sorted_chunks(ok, keys, ["__p", row_id]), keys, ["__p", row_id], "__rank"))
    m = ok.groupBy(*keys).agg(F.count("*").alias("__m"))
    raw = ranked.join(m, keys).withColumn("__raw", F.col("__p") * F.col("__m") / (F.col("__rank") + 1))
    stepped = o.prefix_scan(raw, keys, ["__p", row_id], {out: ("min", "__raw")}, reverse=True)
    adjusted = stepped.select(*keys, row_id, F.least(F.greatest(F.col(out), F.lit(0.0)), F.lit(1.0)).alias(out))
    return df.join(adjusted, [*keys, row_id], "left").drop("__all")


def trial_block(trial: Column) -> Column:
    return F.when(trial <= 6, "early").when(trial <= 13, "mid").otherwise("late")


# --- filters inside one packed window --------------------------------------------------------------------

def _reflect(i: Column, n: Column) -> Column:
    """Index mirrored at the ends without repeating the end sample."""
    return F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)


def hampel(values: Column, width: int, sigmas: float = 3.0) -> Column:
    """Replace samples further than 3 x 1.4826 x MAD from the local median (odd width, reflected ends)."""
    r = width // 2
    middle = lambda a: F.get(F.sort_array(a), F.lit(r))

    def clean(x: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            near = F.transform(F.sequence(i - r, i + r), lambda k: F.get(x, _reflect(k, F.size(x))))

            def decide(pair: Column) -> Column:
                mad = middle(F.transform(pair["near"], lambda u: F.abs(u - pair["med"])))
                return F.when(F.abs(v - pair["med"]) > sigmas * 1.4826 * F.greatest(mad, F.lit(1e-8)), pair["med"]).otherwise(v)

            return fx.let(near, lambda a: fx.let(F.struct(a.alias("near"), middle(a).alias("med")), decide))

        return F.transform(x, one)

    return fx.let(values, clean)


def savgol_taps(width: int) -> list[float]:
    """Quadratic smoothing weights of odd width from their closed form."""
    m = width // 2
    scale = (2 * m - 1) * (2 * m + 1) * (2 * m + 3)
    return [3 * (3 * m * m + 3 * m - 1 - 5 * k * k) / scale for k in range(-m, m + 1)]


def savgol2(values: Column, width: int) -> Column:
    r = width // 2
    taps = F.array(*[F.lit(v) for v in savgol_taps(width)])
    smooth = lambda x: F.transform(x, lambda _, i: fx.array_sum(F.transform(taps, lambda w, j: w * F.get(x, _reflect(i - r + j, F.size(x))))))
    return fx.let(values, smooth)


def difference(values: Column) -> Column:
    return fx.let(values, lambda x: F.transform(x, lambda v, i: F.when(i == 0, 0.0).otherwise(v - F.get(x, i - 1))))


def center(values: Column) -> Column:
    return fx.let(fx.array_mean(values), lambda m: F.transform(values, lambda v: v - m))


def detrend(values: Column) -> Column:
    """Subtract mean and least-squares slope over a time axis running from -1 to 1."""
    def fit(c: Column) -> Column:
        axis = lambda i: 2.0 * i / (F.size(c) - 1) - 1.0
        up = fx.array_sum(F.transform(c, lambda v, i: v * axis(i)))
        down = fx.array_sum(F.transform(c, lambda v, i: axis(i) * axis(i)))
        return fx.let(up / down, lambda slope: F.transform(c, lambda v, i: v - slope * axis(i)))

    return fx.let(center(values), fit)


# --- peaks and crops -------------------------------------------------------------------------------------

def crop_around_peak(df: DataFrame, keys, index: str, value: str, length: int, radius: int, sum_radius: int) -> DataFrame:
    """Fixed-length slice centred on the peak of the summed moving variance, shifted inside and edge-padded."""
    mv = moving_stats(df.withColumn("__abs", F.abs(value)), keys, index, "__abs", radius).select(*keys, index, "variance")
    energy = moving_stats(mv, keys, index, "variance", sum_radius)
    peaks = topk.argmax_peak(energy.withColumn("e", F.round("sum", 12)), keys, index, "e").select(*keys, "peak")
    sizes = df.groupBy(*keys).agg((F.max(index) + 1).alias("__n"))
    b = peaks.join(sizes, list(keys))
    start = F.greatest(F.lit(0), F.least(F.col("peak") - length // 2, F.col("__n") - length)).cast("int")
    b = b.withColumn("crop_start", start)
    short = F.greatest(F.lit(0), length - F.col("__n"))
    pad = F.least(short, F.greatest(F.lit(0), length // 2 - F.col("peak"))).cast("int")
    b = b.withColumn("pad_left", pad)
    # each output position reads one clamped source index: an equi-join, padding included
    cells = b.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn(
        index, F.greatest(F.lit(0), F.least(F.col("crop_start") + F.col("pos") - F.col("pad_left"), F.col("__n") - 1)))
    return cells.join(df, [*keys, index]).drop("__n")


def _settled(distance: int, kept: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One round of suppression over whole (series, chunk) groups: own peaks with `state` 0 open or 1 kept; suppressed ones go.

    A peak that is higher than every open one within the distance is kept and suppresses them. Peaks of the neighbouring chunks
    are seen but not decided, so whatever is decided holds for the whole series.
    """
    for batch, starts in whole_groups(batches, "__group"):
        at, height = batch.column("__at").to_numpy(), batch.column("__height").to_numpy()
        own, state = batch.column("__own").to_numpy(zero_copy_only=False), batch.column("state").to_numpy().copy()
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        gone, near = np.zeros(len(at), dtype=bool), []
        for shift in range(1, min(distance, len(at))):
            close = (group[shift:] == group[:-shift]) & (at[shift:] - at[:-shift] < distance)
            if not close.any():
                break
            near.append((shift, close, height[shift:] >= height[:-shift]))  # of equal heights the later one wins
        while True:
            for shift, close, _ in near:
                gone[shift:] |= close & (state[:-shift] == 1)
                gone[:-shift] |= close & (state[shift:] == 1)
            open_ = (state == 0) & ~gone
            best = open_ & own
            for shift, close, later in near:
                both = close & open_[shift:] & open_[:-shift]
                best[:-shift] &= ~(both & later)
                best[shift:] &= ~(both & ~later)
            if not best.any():
                break
            state[best] = 1
        gone &= state == 0
        left = batch.filter(pa.array(own & ~gone))
        yield pa.RecordBatch.from_arrays([*[left.column(c) for c in kept], pa.array(state[own & ~gone])], [*kept, "state"])


def local_peaks(df: DataFrame, keys, index: str, value: str, distance: int, chunk_rows: int = 65_536) -> DataFrame:
    """Local maxima at least mean + sd high and `distance` apart, the higher peak winning, of equal ones the later.

    Suppression runs in rounds over chunks of the series, each seeing the peaks within `distance` of its borders; a round settles
    all that does not hang on an open peak of a neighbouring chunk, so few rounds are needed and no series sits in one task.
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg((F.avg(value) + F.stddev_pop(value)).alias("__level"))
    spread, w = o.with_halo(df, keys, index, 1, 1, chunk_rows)
    near = spread.withColumns({"__l": F.lag(value).over(w), "__r": F.lead(value).over(w)})
    tops = o.own_rows(near.filter((F.col(value) > F.col("__l")) & (F.col(value) > F.col("__r")))).join(stats, keys).filter(F.col(value) >= F.col("__level"))
    peaks = materialize(tops.select(*keys, F.col(index).cast("long").alias("__at"), F.col(value).cast("double").alias("__height"), F.lit(0).cast("long").alias("state")))
    while peaks.filter("state = 0").limit(1).count():
        spread, _ = o.with_halo(peaks, keys, "__at", distance, distance, chunk_rows)
        dealt = spread.withColumn("__group", F.xxhash64(*keys, o.CHUNK)).repartition(*keys, o.CHUNK).sortWithinPartitions("__group", "__at")
        peaks = materialize(dealt.mapInArrow(partial(_settled, distance, [*keys, "__at", "__height"]), peaks.schema))
    return peaks.select(*keys, F.col("__at").cast("int").alias("peak"))


def peak_segments(df: DataFrame, keys, channel: str, index: str, value: str, half: int, distance: int = 10, before: int = 20, after: int = 80) -> DataFrame:
    """Segments [peak - before, peak + after] on the variance averaged over channels whose q is above the 75th percentile."""
    mv = materialize(moving_variance_padded(df.withColumn("__abs", F.abs(value)), [*keys, channel], index, "__abs", half).select(*keys, channel, index, "variance"))
    mean = F.avg("variance")
    q = mv.groupBy(*keys, channel).agg(F.when(mean < 1e-10, 0.0).otherwise(F.max("variance") / F.nullif(mean, F.lit(0.0))).alias("q"))
    # the channel count of a recording is fixed by the hardware, so this percentile sees a bounded group
    limit = q.groupBy(*keys).agg(F.percentile("q", F.lit(0.75)).alias("__lim"))
    best = q.join(limit, list(keys)).filter("q > __lim").select(*keys, channel)
    avg = mv.join(best, [*keys, channel]).groupBy(*keys, index).agg(F.avg("variance").alias("mv"))
    sizes = avg.groupBy(*keys).agg(F.max(index).alias("__end"))
    peaks = local_peaks(avg, keys, index, "mv", distance)
    return peaks.join(sizes, list(keys)).select(*keys, "peak", F.greatest(F.lit(0), F.col("peak") - before).alias("a"), F.least(F.col("__end"), F.col("peak") + after).alias("b"))
