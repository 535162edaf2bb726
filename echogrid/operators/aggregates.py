"""Aggregations. Sums, counts and extrema combine map-side; percentiles and ranks go through `ecdf`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.operators import ordered as o
from echogrid.session import materialize


def link_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"))


def multi_dim_stats(df: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """The same statistics for each grouping column, one long table (dim, level, ...)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("level")) for d in dims]))
    long = df.select(pairs.alias("g"), value).select("g.dim", "g.level", value)
    # distinct values with counts first: everything below runs on the collapsed table
    table = materialize(o.ecdf(long, ["dim", "level"], value))
    mean = F.sum(F.col(value) * F.col("n")) / F.sum("n")
    base = table.groupBy("dim", "level").agg(
        F.sum("n").alias("n_rows"), mean.alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        *[o.quantile_from_ecdf(p, value).alias(nm) for nm, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))])
    spread = table.join(base.select("dim", "level", "mean"), ["dim", "level"]).groupBy("dim", "level").agg(
        F.sqrt(F.sum(F.col("n") * F.pow(F.col(value) - F.col("mean"), 2)) / (F.sum("n") - 1)).alias("std"))
    return base.join(spread, ["dim", "level"])


def recording_metadata(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, nominal_gap: float, fs: float, chunk: Column | None = None) -> DataFrame:
    """Per recording: packet timing, gain and received-power statistics, modes and dead-column flag.

    Expects columns agc, rssi_a, rssi_b, rssi_c, noise, rate besides the clock (microseconds).
    """
    from echogrid.functions.scalars import total_rss_dbm

    rss = total_rss_dbm([F.col(c).cast("double") for c in ("rssi_a", "rssi_b", "rssi_c")], F.col("agc"))
    gaps = o.prefix_scan(df.withColumn("rss", rss), keys, order, {"__prev": ("prev", time)}, chunk)
    gaps = materialize(gaps.withColumn("gap", F.col(time) - F.col("__prev")).drop("__prev"))
    positive = F.when(F.col("gap") > 0, F.col("gap"))
    base = gaps.groupBy(*keys).agg(
        F.count("*").alias("n_packets"), F.coalesce(F.sum(positive) / 1e6, F.lit(0.0)).alias("duration_sec"),
        (F.avg(positive) / 1000).alias("mean_gap_ms"), (F.stddev_pop(positive) / F.avg(positive)).alias("gap_cv"),
        F.avg((positive > 2 * nominal_gap).cast("double")).alias("frac_gap_gt_2x"),
        F.count_if(F.col("gap") <= 0).alias("n_nonpositive_gaps"),
        F.coalesce(F.count_if(F.col("gap") <= 0) / F.nullif(F.count("gap"), F.lit(0)), F.lit(0.0)).alias("frac_nonpositive"),
        F.avg("agc").alias("agc_mean"), F.stddev_pop("agc").alias("agc_std"), F.min("agc").alias("agc_min"), F.max("agc").alias("agc_max"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("rssi_a", "rssi_b", "rssi_c")],
        F.avg("rss").alias("rss_dbm_mean"), F.stddev_pop("rss").alias("rss_dbm_std"),
        F.min("noise").alias("noise_min"), F.max("noise").alias("noise_max"))
    means = [F.col(f"rssi_{x}_mean") for x in "abc"]
    best = F.when((means[0] >= means[1]) & (means[0] >= means[2]), 0).when(means[1] >= means[2], 1).otherwise(2)
    base = base.withColumns({
        "rssi_best_ant": best, "rssi_spread": F.greatest(*means) - F.least(*means),
        "noise_is_dead": (F.col("noise_min") == F.col("noise_max")) & (F.col("noise_min") == -127)}).drop("noise_min", "noise_max")
    quant = o.percentiles(gaps.filter("gap > 0"), keys, "gap", {"median_gap": 0.5, "p95_gap": 0.95})
    rate = most_common(gaps, keys, "rate").withColumnRenamed("value", "rate_mode")
    out = base.join(quant, list(keys), "left").join(rate, list(keys), "left")
    est = 1e6 / F.col("median_gap")
    return out.withColumns({
        "median_gap_ms": F.col("median_gap") / 1000, "gap_p95_ms": F.col("p95_gap") / 1000, "est_fs_hz": est,
        "is_lowrate": F.coalesce(est < 0.5 * fs, F.lit(False))}).drop("median_gap", "p95_gap")


def most_common(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mode per key; the smaller value wins ties."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias("value"))


def gap_diagnostics(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, grid: float, tolerance: float, max_steps: int = 64, chunk: Column | None = None) -> DataFrame:
    gaps = o.prefix_scan(df, keys, order, {"__prev": ("prev", time)}, chunk).withColumn("gap", F.col(time) - F.col("__prev"))
    steps = F.greatest(F.lit(1), F.bround(F.col("gap") / grid).cast("bigint"))
    fits = (steps <= max_steps) & (F.abs(F.col("gap") - steps * grid) <= tolerance)
    return gaps.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.count("gap").alias("diff_count"), F.count_if(F.col("gap") <= 0).alias("nonpositive_count"),
        F.count_if((F.col("gap") > 0) & ~fits).alias("irregular_count"),
        F.coalesce(F.sum(F.when((F.col("gap") > 0) & fits, steps - 1)), F.lit(0)).alias("missing_steps"),
        F.count_if(F.col("gap") > 0).alias("positive_diff_count"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion_metrics(df: DataFrame, keys: Sequence[str], truth: str, predicted: str) -> DataFrame:
    y, p = F.col(truth), F.col(predicted)
    c = df.groupBy(*keys).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    c = c.withColumns({
        "accuracy": _ratio(tp + tn, tn + fp + fn + tp), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn), "neg_precision": _ratio(tn, tn + fn), "specificity": _ratio(tn, tn + fp),
        "neg_f1": _ratio(2 * tn, 2 * tn + fp + fn)})
    both = (tn + fp > 0) & (fn + tp > 0)
    return c.withColumns({"balanced_accuracy": F.when(both, (F.col("recall") + F.col("specificity")) / 2), "macro_f1": (F.col("f1") + F.col("neg_f1")) / 2})


def _score_table(df: DataFrame, keys: Sequence[str], score: str, truth: str) -> DataFrame:
    return o.ecdf(df, keys, score, {"pos": F.col(truth).cast("int")})


def auroc_ap(df: DataFrame, keys: Sequence[str], score: str, truth: str) -> DataFrame:
    """AUROC with half-credit ties and step-wise average precision; NULL when one class is missing."""
    s = _score_table(df, keys, score, truth)
    neg, neg_below = F.col("n") - F.col("pos"), F.col("below") - F.col("pos_below")
    tp, at_least = F.col("pos_total") - F.col("pos_below"), F.col("total") - F.col("below")
    sums = s.groupBy(*keys).agg(
        F.sum(F.col("pos") * (neg_below + neg / 2)).alias("wins"), F.sum(F.col("pos") * tp / at_least).alias("steps"),
        F.max("pos_total").alias("p"), F.max(F.col("total") - F.col("pos_total")).alias("q"))
    ok = (F.col("p") > 0) & (F.col("q") > 0)
    return sums.select(*keys, F.col("p").alias("positives"), F.col("q").alias("negatives"),
                       F.when(ok, F.col("wins") / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("auroc"),
                       F.when(ok, F.col("steps") / F.nullif(F.col("p"), F.lit(0))).alias("ap"))


def oracle_threshold(df: DataFrame, keys: Sequence[str], score: str, truth: str) -> DataFrame:
    """Best balanced accuracy over all distinct scores used as `>=` thresholds; the lowest threshold wins ties."""
    s = _score_table(df, keys, score, truth)
    tpr = (F.col("pos_total") - F.col("pos_below")) / F.nullif(F.col("pos_total"), F.lit(0))
    tnr = (F.col("below") - F.col("pos_below")) / F.nullif(F.col("total") - F.col("pos_total"), F.lit(0))
    best = F.max(F.struct(((tpr + tnr) / 2).alias("ba"), (-F.col(score)).alias("neg")))
    return s.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.ba").alias("balanced_accuracy"), (-F.col("b.neg")).alias("threshold"))


def recording_rule(df: DataFrame, recording: str, truth: str, predicted: str, min_windows: int) -> DataFrame:
    per = df.groupBy(recording).agg(F.max(truth).alias("y"), (F.sum(predicted) >= min_windows).cast("int").alias("p"))
    c = confusion_metrics(per, [], "y", "p")
    return c.withColumns({"miss_rate": _ratio(F.col("fn"), F.col("fn") + F.col("tp")), "false_alarm_rate": _ratio(F.col("fp"), F.col("fp") + F.col("tn"))})


def unit_mean_score(df: DataFrame, unit: str, score: str, order: str, first: Sequence[str]) -> DataFrame:
    return df.groupBy(unit).agg(F.avg(score).alias(score), F.min_by(F.struct(*first), order).alias("f")).select(unit, score, *[f"f.{c}" for c in first])


def fit_scalar_normalization(df: DataFrame, columns: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """One row per column: median of finite values, then mean and population sd after imputing it."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.column", "s.v")
    finite = F.when(~F.isnan("v") & (F.abs(F.col("v")) != F.lit(float("inf"))), F.col("v"))
    long = long.withColumn("v", finite)
    med = o.percentiles(long, ["column"], "v", {"median": 0.5})
    filled = long.join(F.broadcast(med), "column", "left").withColumn("median", F.coalesce("median", F.lit(0.0))).withColumn("v", F.coalesce("v", "median"))
    return filled.groupBy("column").agg(F.max("median").alias("median"), F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(floor)).alias("std"))


def fit_map_normalization(df: DataFrame, values: str, floor: float = 1e-6) -> DataFrame:
    """Global mean and sd over every cell of an array column, from count, sum and sum of squares."""
    cells = df.select(
        F.size(values).alias("n"), F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("s"),
        F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v).alias("ss"))
    t = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    return t.select(mean.alias("mean"), F.greatest(F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(floor)).alias("std"))


def apply_scalar_normalization(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores plus missing indicators; `stats` has one row per column (a schema-sized table)."""
    one = stats.groupBy().pivot("column", list(columns)).agg(F.first(F.struct("median", "mean", "std"))).select(*[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.withColumn("__one", F.lit(1)).join(F.broadcast(one.withColumn("__one", F.lit(1))), "__one").drop("__one")
    out = {}
    for c in columns:
        v = F.col(c).cast("double")
        missing = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        out[f"{c}_z"] = (F.when(missing, F.col(f"__{c}.median")).otherwise(v) - F.col(f"__{c}.mean")) / F.col(f"__{c}.std")
        out[f"{c}_missing"] = missing.cast("int")
    return joined.withColumns(out).drop(*[f"__{c}" for c in columns])


def sample_summary(df: DataFrame, cell: str, subject: str, activity: str) -> DataFrame:
    """Per cell: files, subjects (sorted list), activities, largest subject share."""
    per = df.groupBy(cell, subject).agg(F.count("*").alias("n"))
    # one row per enrolled subject: the list is as long as the study's subject register
    subjects = per.groupBy(cell).agg(
        F.sum("n").alias("n_files"), F.count("*").alias("n_subjects"),
        F.array_join(F.transform(F.sort_array(F.collect_list(subject)), lambda s: F.format_string("S%02d", s)), ", ").alias("subjects"),
        F.round(F.max("n") / F.sum("n"), 3).alias("max_subject_share"))
    acts = df.select(cell, activity).distinct().groupBy(cell).agg(F.count("*").alias("n_activities"))
    return subjects.join(acts, cell)


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence, normalize: bool = False) -> DataFrame:
    counts = df.groupBy(row).pivot(column, list(levels)).count().na.fill(0)
    if not normalize:
        return counts
    total = sum((F.col(str(c)) for c in levels), F.lit(0))
    return counts.select(row, *[(F.col(str(c)) / total).alias(str(c)) for c in levels])


def group_share(df: DataFrame, group: str, category: str) -> DataFrame:
    counts = df.groupBy(group, category).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def qc_summary(df: DataFrame, group: str, padded: str, ratio: str, metrics: Sequence[str]) -> DataFrame:
    base = df.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(F.col(padded).cast("double")).alias("padded_rate"),
        F.avg(((F.col(ratio) < 0.01) | (F.col(ratio) > 0.9)).cast("double")).alias("degenerate_rate"))
    long = df.unpivot([group], list(metrics), "metric", "v")
    med = o.percentiles(long, [group, "metric"], "v", {"median": 0.5})
    wide = med.groupBy(group).pivot("metric", list(metrics)).agg(F.first("median"))
    return base.join(wide, group)


def concentration(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Gini, normalised entropy, effective rank and excess kurtosis of a group's non-negative values."""
    table = materialize(o.ecdf(df, keys, value))
    sums = table.groupBy(*keys).agg(F.sum(F.col("n") * F.col(value)).alias("s"), F.sum("n").alias("count"))
    v, n = F.col(value), F.col("n")
    p = v / F.nullif(F.col("s"), F.lit(0.0))
    out = table.join(sums, list(keys)).withColumn("__d", v - F.col("s") / F.col("count")).groupBy(*keys).agg(
        F.max("count").alias("count"), F.max("s").alias("s"),
        F.sum(v * (n * F.col("below") + n * (n + 1) / 2)).alias("ranked"),
        F.sum(F.when(v > 0, n)).alias("alive"), (-F.sum(F.when(v > 0, n * p * F.ln(p)))).alias("h"),
        (F.sum(n * F.pow("__d", 2)) / F.sum(n)).alias("m2"), (F.sum(n * F.pow("__d", 4)) / F.sum(n)).alias("m4"))
    c = F.col("count")
    return out.select(
        *keys, F.when(F.col("s") > 0, 2 * F.col("ranked") / (c * F.col("s")) - (c + 1) / c).alias("gini"),
        F.when(F.col("alive") > 1, F.col("h") / F.ln("alive")).alias("norm_entropy"), F.exp("h").alias("effective_rank"),
        F.when(F.col("m2") > 0, F.col("m4") / F.pow("m2", 2) - 3).alias("excess_kurtosis"))


def protocol_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    long = df.unpivot(list(keys), list(metrics), "metric", "v").filter("v IS NOT NULL")
    by = [*keys, "metric"]
    base = long.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("count"))
    return base.join(o.percentiles(long, by, "v", {"median": 0.5}), by)


def overlap_record(df: DataFrame, keys: Sequence[str], truth: str, a: str, b: str) -> DataFrame:
    ca, cb = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    t = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(ca & cb).alias("both_correct"), F.count_if(ca & ~cb).alias("a_only_correct"),
        F.count_if(cb & ~ca).alias("b_only_correct"), F.count_if(~ca & ~cb).alias("both_wrong"), F.count_if(F.col(a) != F.col(b)).alias("disagreement"))
    acc_a, acc_b = (F.col("both_correct") + F.col("a_only_correct")) / F.col("n"), (F.col("both_correct") + F.col("b_only_correct")) / F.col("n")
    oracle = (F.col("n") - F.col("both_wrong")) / F.col("n")
    return t.withColumns({
        "oracle_accuracy": oracle, "oracle_gain": oracle - F.greatest(acc_a, acc_b),
        "b_recovers_a": F.col("b_only_correct") / F.greatest(F.col("b_only_correct") + F.col("both_wrong"), F.lit(1)),
        "a_recovers_b": F.col("a_only_correct") / F.greatest(F.col("a_only_correct") + F.col("both_wrong"), F.lit(1))})


def label_composition(df: DataFrame, window: Sequence[str], index: str, label: str) -> DataFrame:
    """Per window the `label:count` text and the run-collapsed label sequence (a window has a fixed length)."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(label).alias("l"))))
    seq = F.transform(F.col("__rows"), lambda r: r["l"])
    packed = df.groupBy(*window).agg(rows.alias("__rows")).withColumn("__seq", seq)
    kinds = F.array_sort(F.array_distinct("__seq"))
    counts = F.transform(kinds, lambda k: F.concat(k, F.lit(":"), F.size(F.filter(F.col("__seq"), lambda v: v == k)).cast("string")))
    turns = F.filter(F.col("__seq"), lambda v, i: (i == 0) | (v != F.get(F.col("__seq"), i - 1)))
    return packed.select(*window, F.array_join(counts, ";").alias("counts_text"), F.array_join(turns, ";").alias("sequence_text"))


def window_majority_label(df: DataFrame, window: Sequence[str], index: str, label: str, center: Column, falls: Sequence[str] = ()) -> DataFrame:
    """`majority` (tie: centre's label, else the earliest), `center` and `any_fall` labels per window."""
    per = df.groupBy(*window, label).agg(
        F.count("*").alias("n"), F.min(index).alias("first"), F.max((F.col(index) == center).cast("int")).alias("has_center"))
    is_fall = F.col(label).isin(list(falls)) if falls else F.lit(False)
    mode = F.max(F.struct("n", "has_center", (-F.col("first")).alias("early"), F.col(label).alias("l")))
    mid = F.max_by(F.col(label), F.col("has_center"))
    first_fall = F.min_by(F.when(is_fall, F.col(label)), F.when(is_fall, F.col("first")))
    out = per.groupBy(*window).agg(mode.alias("m"), mid.alias("center"), first_fall.alias("ff"))
    any_fall = F.when(F.col("center").isin(list(falls)), F.col("center")).otherwise(F.coalesce("ff", "center")) if falls else F.col("center")
    return out.select(*window, F.col("m.l").alias("majority"), "center", any_fall.alias("any_fall"))


def presence_counts(df: DataFrame, group: Sequence[str], state: Column, severity: Column) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count_if(state == "PRESENT").alias("present"), F.count_if(state == "ABSENT").alias("absent"), F.count_if(state.isNull()).alias("unknown"), F.max(severity).alias("worst"))


def recipients_by_resident(recipients: DataFrame) -> DataFrame:
    """Shared list first, then one list per resident, as numbered rows rather than one growing array."""
    rows = recipients.withColumn("owner", F.coalesce(F.concat(F.lit("resident-"), F.col("resident_id").cast("string")), F.lit("shared")))
    return o.number_rows(rows, ["owner"], ["recipient_id"], "position")


def kind_counters(df: DataFrame, kind: str, reject: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count_if(F.col(reject).isNull()).alias("forwarded"), F.count_if(F.col(reject).isNotNull()).alias("rejected"))


def device_totals(df: DataFrame, device: str, seen: str, offline_after_s: float) -> DataFrame:
    """Known and online devices, judged against the newest time seen anywhere in the stream."""
    last = df.groupBy(device).agg(F.max(seen).alias("last"))
    now = df.agg(F.unix_micros(F.max(seen).cast("timestamp")).alias("now")).scalar()
    silent = last.withColumn("silent", (now - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6)
    return silent.agg(F.count("*").alias("devices"), F.count_if(F.col("silent") < offline_after_s).alias("online"))


def link_rate(df: DataFrame, keys: Sequence[str], time: str, short: float, long: float, unit: float = 1e6) -> DataFrame:
    """Rows in the last `short` and `long` seconds of each series; the long rate divides by the observed span."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    back = (F.col("t1") - F.col(time)) / unit
    span = F.least(F.lit(long), F.greatest((F.max("t1") - F.max("t0")) / unit, F.lit(1e-9)))
    return df.join(ends, list(keys)).groupBy(*keys).agg(
        F.count("*").alias("frames"), (F.count_if(back < short) / F.lit(short)).alias("hz_short"), (F.count_if(back < long) / span).alias("hz_long"))


def detection_rates(files: DataFrame, segments: DataFrame, file: str, group: Sequence[str], duration: str) -> DataFrame:
    per = segments.groupBy(file).agg(F.count("*").alias("k"), F.sum(duration).alias("d"))
    j = files.join(per, file, "left")
    return j.groupBy(*group).agg(
        F.count("*").alias("files"), F.avg(F.col("k").isNotNull().cast("double")).alias("detected_share"),
        (F.coalesce(F.sum("k"), F.lit(0)) / F.count("*")).alias("segments_per_file"), (F.sum("d") / F.sum("k")).alias("mean_duration"))


def group_profiles(df: DataFrame, group: str, values: str) -> DataFrame:
    """Element-wise mean, sd, quartiles per group and position, and the difference from the grand mean."""
    cells = df.select(group, F.posexplode(values).alias("pos", "v"))
    table = materialize(o.ecdf(cells, [group, "pos"], "v"))
    prof = table.groupBy(group, "pos").agg(
        (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"), F.sum("n").alias("k"),
        *[o.quantile_from_ecdf(p, "v").alias(nm) for nm, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))])
    sd = table.join(prof.select(group, "pos", "mean"), [group, "pos"]).groupBy(group, "pos").agg(F.sqrt(F.sum(F.col("n") * F.pow(F.col("v") - F.col("mean"), 2)) / F.sum("n")).alias("sd"))
    grand = prof.groupBy("pos").agg((F.sum(F.col("mean") * F.col("k")) / F.sum("k")).alias("grand"))
    return prof.join(sd, [group, "pos"]).join(grand, "pos").withColumn("difference", F.col("mean") - F.col("grand")).drop("k", "grand")


def ecdf_points(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return o.ecdf(df, group, value).select(*group, value, ((F.col("below") + F.col("n")) / F.col("total")).alias("cum_share"))


def histogram(df: DataFrame, group: Sequence[str], value: str, bins: int = 60, log10: bool = False) -> DataFrame:
    v = F.log10(F.when(F.col(value) > 0, F.col(value))) if log10 else F.col(value)
    rows = df.select(*group, v.alias("__v")).filter("__v IS NOT NULL")
    ends = rows.groupBy(*group).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    b = F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col("__v") - F.col("lo")) / width), F.lit(0))).cast("int")
    return rows.join(ends, list(group)).groupBy(*group, b.alias("bin")).agg(F.count("*").alias("n"))


def group_linear_fit(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    fit = df.groupBy(*group).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (F.max(x) - F.min(x)).alias("__spread"), F.count("*").alias("n"))
    return fit.filter("n >= 2 AND __spread > 1e-12").drop("__spread")
