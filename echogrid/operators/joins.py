"""Joins. Equi-joins carry the keys; hot keys are left to skew-join splitting or cut by pre-aggregation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.functions.scalars import stable_order
from echogrid.operators import ordered as o
from echogrid.operators.topk import bounded_top
from echogrid.session import materialize


def primary_resident(links: DataFrame, residents: DataFrame) -> DataFrame:
    """One resident per device: primary link first, then the oldest. A combinable min, not a window."""
    ranked = links.join(residents, "resident_id").groupBy("device_id").agg(
        F.min(F.struct((~F.col("is_primary")).alias("later"), "created_rank", "resident_id", "resident_name", "resident_room")).alias("r"))
    return ranked.select("device_id", "r.resident_id", "r.resident_name", "r.resident_room")


def attach_resident(events: DataFrame, devices: DataFrame, links: DataFrame, residents: DataFrame) -> DataFrame:
    """Events with the resident snapshot; device name and room fill in when nobody is linked."""
    known = devices.join(primary_resident(links, residents), "device_id", "left").select(
        "device_id", "facility_id", "resident_id", F.coalesce("resident_name", "name").alias("resident_name"),
        F.coalesce("resident_room", "room").alias("room"))
    return events.join(known, "device_id", "left")


def recipient_fanout(falls: DataFrame, recipients: DataFrame, history: DataFrame | None = None, totals: dict[str, Column] | None = None) -> DataFrame:
    """Falls x recipients of the same scope: shared recipients plus those of the fall's resident.

    Split into two equi-joins so that no residual OR keeps a whole scope in one join bucket: shared recipients join
    on the scope, personal ones on (scope, resident).  The running count comes from a pre-aggregated table.
    With `totals` (aggregates of `recipient_id` and `topic` by name), recipients are summed up per scope before the join,
    and a fall has one row for the shared and one for the personal ones in place of one per recipient.
    """
    reachable = recipients.filter("enabled AND push AND topic IS NOT NULL").select("recipient_id", "facility_id", F.col("resident_id").alias("for_resident"), "topic")
    shared = reachable.filter("for_resident IS NULL").drop("for_resident")
    personal = reachable.filter("for_resident IS NOT NULL").withColumnRenamed("for_resident", "resident_id")
    if totals is not None:
        summed = [c.alias(name) for name, c in totals.items()]
        shared, personal = shared.groupBy("facility_id").agg(*summed), personal.groupBy("facility_id", "resident_id").agg(*summed)
    counted = history if history is not None else falls
    by_resident = counted.filter("resident_id IS NOT NULL").groupBy("resident_id").agg(F.count("*").alias("by_resident"))
    by_device = counted.groupBy("device_id").agg(F.count("*").alias("by_device"))
    # falls without a resident stay out of the join on it: their null key would meet in one task
    alone = falls.filter("resident_id IS NULL").withColumn("by_resident", F.lit(None).cast("long"))
    named = falls.filter("resident_id IS NOT NULL").join(by_resident, "resident_id", "left")
    numbered = named.unionByName(alone).join(by_device, "device_id", "left").withColumn(
        "fall_count", F.coalesce(F.when(F.col("resident_id").isNotNull(), F.col("by_resident")), F.col("by_device"), F.lit(0))).drop("by_resident", "by_device")
    return o.union_all([salted_join(numbered, shared, ["facility_id"]), salted_join(numbered.filter("resident_id IS NOT NULL"), personal, ["facility_id", "resident_id"])])


#: Parts into which the rows of one key are dealt in a salted join.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Inner join of many rows with few per key: a key's left rows are dealt over `salts` parts, its right rows go to each of them."""
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [*keys, "__salt"]).drop("__salt")


def pair_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each side, `__left` and `__right`, for every key that both have."""
    rows = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    return rows(left, "__left").join(rows(right, "__right"), list(keys))


#: Most pairs that a task of a tiled join makes and, while there are fewer tasks than cores, least; tiles a task; right rows of a tile; keys that go to every task.
TASK_PAIRS, LEAST_PAIRS, TASK_TILES, TILE_ROWS, FEW_KEYS = 8_000_000, 250_000, 4, 4_096, 100_000


def tiled_join(left: DataFrame, right: DataFrame, keys: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Inner join whose output is much larger than its sides: the pairs of each key are cut into tiles, and tasks follow from the pairs.

    By their bytes the sides of such a join fit in a task or two. `counts` are the `pair_counts` of the sides. A row is copied once
    for each tile of its row or column, and a task holds the right rows of one tile at a time.
    """
    keys, counts = list(keys), materialize(pair_counts(left, right, keys) if counts is None else counts)
    found = counts.agg(F.count("*").alias("keys"), F.sum(F.col("__left").cast("double") * F.col("__right")).alias("pairs")).first()
    pairs, cores = found["pairs"] or 1.0, left.sparkSession.sparkContext.defaultParallelism
    tasks = math.ceil(max(pairs / TASK_PAIRS, min(2 * cores, pairs / LEAST_PAIRS)))
    down = F.ceil(F.col("__left") * F.least("__right", F.lit(TILE_ROWS)) * (TASK_TILES * tasks / pairs)).alias("__rows")
    tiles = counts.select(*keys, down, F.ceil(F.col("__right") / TILE_ROWS).alias("__columns"))
    tiles = F.broadcast(tiles) if found["keys"] <= FEW_KEYS else tiles
    at = [*keys, "__row", "__column"]

    def dealt(df: DataFrame, own: str, of: str, other: str, others: str) -> DataFrame:
        placed = df.join(tiles, keys).withColumn(own, F.pmod(F.xxhash64(*df.columns), F.col(of)))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))).drop(of, others).repartition(tasks, *at)

    # not broadcast: the copies are many more than the plan expects
    rows = dealt(left, "__row", "__rows", "__column", "__columns").hint("merge")
    return rows.join(dealt(right, "__column", "__columns", "__row", "__rows"), at).drop("__row", "__column")


def scope_anti(requested: DataFrame, scoped: DataFrame, key: str) -> DataFrame:
    return requested.join(scoped.select(key), key, "left_anti")


def dedup_anti(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def aligned_pair_join(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """Inner join of two manifests with `label_ok`; callers stop when any row disagrees."""
    r = right.withColumnRenamed(label, "__other")
    return left.join(r, key).withColumn("label_ok", F.col(label).eqNullSafe(F.col("__other"))).drop("__other")


def nearest_asof(source: DataFrame, target: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """For each target time the nearest source row; ties take the earlier one, ends clamp."""
    payload = F.struct(F.col(time).alias("at"), *[F.col(v) for v in values])
    src = source.select(*keys, time, F.lit(0).alias("__side"), payload.alias("__src"))
    tgt = target.withColumn("__side", F.lit(1)).withColumn("__src", F.lit(None).cast(src.schema["__src"].dataType))
    both = src.unionByName(tgt, allowMissingColumns=True)
    if chunk is None:
        both = o.sorted_chunks(both, keys, [time, "__side"])
    left = o.prefix_scan(both, keys, [time, "__side"], {"__left": ("last", "__src")}, chunk)
    rest = [c for c in target.columns if c not in (*keys, time)]
    if rest:
        left = left.withColumn("__id", F.struct(*rest))
    marked = o.prefix_scan(left, keys, [time, "__side"], {"__right": ("last", "__src")}, chunk, reverse=True)
    gap_left, gap_right = F.col(time) - F.col("__left.at"), F.col("__right.at") - F.col(time)
    take_left = F.col("__right").isNull() | (F.col("__left").isNotNull() & (gap_left <= gap_right))
    best = F.when(take_left, F.col("__left")).otherwise(F.col("__right"))
    hit = marked.filter("__side = 1").withColumn("__best", best)
    return hit.select(*[F.col(c) for c in target.columns], F.col("__best.at").alias("source_time"), *[F.col(f"__best.{v}") for v in values])


def range_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points inside [lo, hi) of the same key, as an equi-join on (key, bucket) instead of a nested loop."""
    buckets = F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))
    s = spans.filter(F.col(hi) > F.col(lo)).withColumn("__bucket", F.explode(buckets))
    p = points.withColumn("__bucket", F.floor(F.col(at) / width))
    joined = p.join(s, [*keys, "__bucket"]).filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi)))
    return joined.drop("__bucket")


def overlap_join(windows: DataFrame, spans: DataFrame, keys: Sequence[str], w_lo: str, w_hi: str, s_lo: str, s_hi: str, width: int) -> DataFrame:
    """Windows overlapping spans of the same key; each pair is emitted from one bucket only, so no later distinct."""
    def spread(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))

    pairs = spread(windows, w_lo, w_hi).join(spread(spans, s_lo, s_hi), [*keys, "__bucket"])
    home = F.greatest(F.floor(F.col(w_lo) / width), F.floor(F.col(s_lo) / width))
    overlap = (F.col(w_lo) < F.col(s_hi)) & (F.col(s_lo) < F.col(w_hi))
    return pairs.filter(overlap & (F.col("__bucket") == home)).drop("__bucket")


def window_event_labels(windows: DataFrame, events: DataFrame, keys: Sequence[str], n: int, guard: int, overlap: float = 0.5, width: int | None = None) -> DataFrame:
    """Label windows [start, start+n) against runs [a, b): `y`, and `kept` = positive or outside every guard band.

    `guard` is in samples. Positive needs the run midpoint inside and overlap / min(n, run length) > `overlap`.
    """
    w = windows.withColumn("__end", F.col("start") + n)
    e = events.select(*keys, "a", "b", (F.col("a") - guard).alias("__ga"), (F.col("b") + guard).alias("__gb"))
    hits = overlap_join(w, e, keys, "start", "__end", "__ga", "__gb", width or 4 * n)
    middle = (F.col("a") + F.col("b") - 1) / 2
    shared = F.greatest(F.lit(0), F.least(F.col("__end"), F.col("b")) - F.greatest(F.col("start"), F.col("a")))
    positive = (middle >= F.col("start")) & (middle < F.col("__end")) & (shared / F.least(F.lit(n), F.col("b") - F.col("a")) > overlap)
    per = hits.groupBy(*keys, "start").agg(F.max(positive.cast("int")).alias("__y"))
    out = windows.join(per, [*keys, "start"], "left")
    return out.withColumn("y", F.coalesce("__y", F.lit(0))).withColumn("kept", F.col("__y").isNull() | (F.col("__y") == 1)).drop("__y")


def interval_rules(windows: DataFrame, events: DataFrame, keys: Sequence[str], n: int, width: int | None = None) -> DataFrame:
    """Both lab rules per window: `midpoint` = run's integer midpoint inside, `contains` = whole run inside."""
    w = windows.withColumn("__end", F.col("start") + n)
    hits = overlap_join(w, events.select(*keys, "a", "b"), keys, "start", "__end", "a", "b", width or 4 * n)
    middle = F.floor((F.col("a") + F.col("b") - 1) / 2)
    per = hits.groupBy(*keys, "start").agg(
        F.max((middle >= F.col("start")) & (middle < F.col("__end"))).alias("midpoint"),
        F.max((F.col("start") <= F.col("a")) & (F.col("b") <= F.col("__end"))).alias("contains"))
    out = windows.join(per, [*keys, "start"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("midpoint", "contains")})


def interval_to_grid(intervals: DataFrame, rows: DataFrame, keys: Sequence[str], index: str, time: str, fs: float, us: float = 1e6) -> DataFrame:
    """Sample-index runs [a, b) to grid runs via time: round((t - t0) * fs), clamped to the grid."""
    bounds = rows.groupBy(*keys).agg(F.min(time).alias("__t0"), F.max(time).alias("__t1"))
    at = rows.select(*keys, F.col(index).alias("__i"), F.col(time).alias("__t"))
    first = intervals.join(at.withColumnRenamed("__i", "a").withColumnRenamed("__t", "__ta"), [*keys, "a"])
    both = first.withColumn("__last", F.col("b") - 1).join(
        at.withColumnRenamed("__i", "__last").withColumnRenamed("__t", "__tb"), [*keys, "__last"]).join(bounds, list(keys))
    last_cell = F.floor((F.col("__t1") - F.col("__t0")) * fs / us)
    cell = lambda c: F.greatest(F.lit(0), F.least(last_cell, F.bround((F.col(c) - F.col("__t0")) * fs / us).cast("bigint")))
    return both.select(*keys, "a", "b", cell("__ta").alias("ga"), (cell("__tb") + 1).alias("gb"))


def session_division(rows: DataFrame, protocol: dict[int, Sequence[int]], session: Sequence[str], klass: str, phase: str) -> DataFrame:
    """Sessions of each class against the phases its protocol asks for: complete flag and missing phases."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(k, list(v)) for k, v in protocol.items()], f"{klass} int, required array<int>")
    have = rows.groupBy(*session).agg(F.collect_set(phase).alias("have"))  # bounded by the number of phases
    joined = have.join(F.broadcast(wanted), klass)
    missing = F.sort_array(F.array_except("required", "have"))
    return joined.select(*session, (F.size(missing) == 0).alias("complete"), F.array_join(missing.cast("array<string>"), ",").alias("missing"))


def group_pairs(per_group: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """Unordered pairs of groups inside `by`, from a table with one row per (by, group)."""
    g = per_group.select(*by, group)
    if not by:
        g, by = g.withColumn("__all", F.lit(0)), ["__all"]
    a, b = g.withColumnRenamed(group, "group_a"), g.withColumnRenamed(group, "group_b")
    return a.join(b, list(by)).filter("group_a < group_b").drop("__all")


def live_overlay(devices: DataFrame, latest: DataFrame, now: Column, offline_after_s: float) -> DataFrame:
    """Devices with three-valued `online`, live last-seen first, presence upper-cased."""
    live = devices.join(latest, "device_id", "left")
    silent = (F.unix_micros(now) - F.unix_micros(F.col("live_seen").cast("timestamp"))) / 1e6
    return live.withColumn("online", F.when(F.col("live_seen").isNotNull(), silent < offline_after_s)).withColumn(
        "last_seen", F.coalesce("live_seen", "last_seen")).withColumn("presence", F.upper("state")).drop("live_seen", "state")


def composition_match(cells: DataFrame, sample: DataFrame, group: str, activity: str, value: str) -> DataFrame:
    """Group means weighted by the sample's activity shares; missing cells drop out and weights renormalise."""
    means = cells.groupBy(group, activity).agg(F.avg(value).alias("m"))
    shares = sample.groupBy(activity).agg(F.count("*").alias("w"))
    return means.join(shares, activity).groupBy(group).agg(
        (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("matched_mean"), F.count("*").alias("cells"))


def paired_gap(scores: DataFrame, arm_a: str, arm_b: str, value: str, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Paired differences of two arms with interval, win rate and minimal detectable effect (one result row)."""
    side = lambda arm, name: scores.filter(F.col("arm") == arm).select(*keys, F.col(value).alias(name))
    d = side(arm_a, "__a").join(side(arm_b, "__b"), list(keys)).select((F.col("__a") - F.col("__b")).alias("d")).filter("d IS NOT NULL AND NOT isnan(d)")
    stats = d.agg(
        F.count("*").alias("n_pairs"), F.avg("d").alias("gap_mean"), F.stddev_samp("d").alias("gap_sd"),
        F.avg((F.col("d") > 0).cast("double")).alias("win_rate")).withColumn("__one", F.lit(1))
    ends = o.percentiles(d.withColumn("__one", F.lit(1)), ["__one"], "d", {"gap_lo": alpha / 2, "gap_hi": 1 - alpha / 2})
    mde = 2.8 * F.col("gap_sd") / F.sqrt(F.col("n_pairs"))
    return stats.join(ends, "__one").drop("__one").withColumn("mde80", mde).withColumn("underpowered", F.abs("gap_mean") < mde)


def cell_template_match(template: DataFrame, pool: DataFrame, cell: Sequence[str], row_id: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Draw from the pool the template's cell counts in hash order; returns (picked rows, shortfall report)."""
    want = template.groupBy(*cell).agg(F.count("*").alias("wanted"))
    hashed = pool.withColumn("__h", stable_order(seed, F.col(row_id)))
    numbered = o.number_rows(hashed.join(want, list(cell)), cell, ["__h", row_id], "rank")
    picked = numbered.filter(F.col("rank") < F.col("wanted")).drop("__h", "rank", "wanted")
    have = pool.groupBy(*cell).agg(F.count("*").alias("available"))
    report = want.join(have, list(cell), "left").withColumn("available", F.coalesce("available", F.lit(0)))
    report = report.withColumn("taken", F.least("wanted", "available")).withColumn("shortfall", F.col("wanted") - F.col("taken"))
    return picked, report


def state_in_force(events: DataFrame, keys: Sequence[str], order: Sequence[str], is_state: Column, state: Column, chunk: Column | None = None) -> DataFrame:
    """Attach to every row the latest state value seen up to it (as-of join of one stream with itself)."""
    return o.prefix_scan(events, keys, order, {"state_in_force": ("last", F.when(is_state, state))}, chunk)


def sensor_sessions(files: DataFrame, pattern: str) -> DataFrame:
    """Files of several sensors with one time tag and suffix become one session with a sensor -> path map."""
    f = files.withColumns({
        "sensor": F.regexp_extract("path", pattern, 1), "tag": F.regexp_extract("path", pattern, 2), "suffix": F.regexp_extract("path", pattern, 3),
    }).filter("tag <> ''")
    # bounded: one file per sensor inside a session
    return f.groupBy("tag", "suffix").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sensor", "path")))).alias("paths"), F.count("*").alias("sensors"))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return bounded_top(df, keys, order, n)
