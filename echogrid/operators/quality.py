"""Filters, predicates and data-quality reports. Everything that drops rows can also count why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.operators import ordered as o

# Accepted label texts, the positive ones, message leaves, allowed role/split pairs, tenant format.
LABELS = ["none", "0", "nonfall", "non_fall", "fall", "1"] + [f"a{i}" for i in range(1, 13)]
POSITIVE_LABELS = ["a10", "a11", "a12", "fall", "1"]
UPLINK_LEAVES = ["presence", "telemetry", "signal", "ack"]
ROLE_SPLITS = {"source": ["train", "val"], "target": ["train", "val", "test"], "external": ["external"]}
TENANT_PATTERN = r"^(home-)?[0-9a-fA-F-]{36}$"


def recording_filter(df: DataFrame, env=None, subject=None, activity=None, fall_only=False, max_files=None, order=()) -> DataFrame:
    for name, wanted in (("env", env), ("subject", subject), ("activity", activity)):
        if wanted is not None:
            df = df.filter(F.col(name).isin(list(wanted)))
    if fall_only:
        df = df.filter("is_fall")
    return df.orderBy(*order).limit(max_files) if max_files is not None else df


def tenant_scope(df: DataFrame, facility_id=None, owner_user_id=None) -> DataFrame:
    """Rows of exactly one scope; the predicate stays on raw columns so it reaches the scan."""
    if (facility_id is None) == (owner_user_id is None):
        raise ValueError("exactly one of facility_id and owner_user_id is required")
    return df.filter(F.col("facility_id") == facility_id) if facility_id is not None else df.filter(F.col("owner_user_id") == owner_user_id)


def tenant_key(facility: Column, owner: Column) -> Column:
    return F.coalesce(facility.cast("string"), F.concat(F.lit("home-"), owner.cast("string")))


def falls_query(df: DataFrame, response=None, resident_id=None, from_ts=None, to_ts=None) -> DataFrame:
    if response is not None:
        df = df.filter(F.col("response") == response)
    if resident_id is not None:
        df = df.filter(F.col("resident_id") == resident_id)
    if from_ts is not None:
        df = df.filter(F.col("occurred_at") >= F.lit(from_ts).cast("timestamp_ntz"))
    if to_ts is not None:
        df = df.filter(F.col("occurred_at") <= F.lit(to_ts).cast("timestamp_ntz"))
    return df


def logs_query(df: DataFrame, level=None, text=None, resident_id=None, escape_wildcards=False) -> DataFrame:
    if level is not None:
        df = df.filter(F.col("level") == level)
    if resident_id is not None:
        df = df.filter(F.col("resident_id") == resident_id)
    if text is not None and text.strip():
        pattern = text.strip()
        if escape_wildcards:
            for mark in ("\\", "%", "_"):
                pattern = pattern.replace(mark, "\\" + mark)
        df = df.filter(F.col("msg").ilike(f"%{pattern}%"))
    return df


def identity_check(df: DataFrame, prefix: str) -> DataFrame:
    """Adds `reject_reason` (NULL = accepted): the topic is the truth, the payload must agree with it."""
    parts = F.split("topic", "/")
    tenant, device, leaf = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    reason = (
        F.when((F.size(parts) != 4) | (F.get(parts, F.lit(0)) != prefix), "malformed_topic")
        .when(tenant.rlike("[+#]") | device.rlike("[+#]") | (device == "") | ~tenant.rlike(TENANT_PATTERN), "bad_tenant")
        .when(~leaf.isin(UPLINK_LEAVES), "not_uplink")
        .when(~device.eqNullSafe(F.col("payload_device")), "device_mismatch")
        .when(~tenant.eqNullSafe(F.col("payload_tenant")), "tenant_mismatch")
    )
    return df.withColumns({"tenant": tenant, "device": device, "leaf": leaf, "reject_reason": reason})


def schema_reject(df: DataFrame, text: str, schema: str, required: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    """Parse JSON text into `value` and name the first violated rule in `reject_reason`.

    Unknown fields are found by comparing the object's keys with the schema's; `checks` hold range and enum rules
    over the parsed struct `value`.
    """
    from pyspark.sql.types import StructType

    known = StructType.fromDDL(schema).fieldNames()
    keys = F.json_object_keys(text)
    parsed = df.withColumn("value", F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    reason = F.when(keys.isNull(), "invalid_json")
    reason = reason.when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) > 0, "unknown_field")
    for name in required:
        reason = reason.when(F.col(f"value.{name}").isNull(), f"missing_{name}")
    for name, ok in checks.items():
        reason = reason.when(~F.coalesce(ok, F.lit(False)), name)
    return parsed.withColumn("reject_reason", reason)


def kind_router(df: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame per destination; each is a plain filter, so a sink can push it to the scan."""
    return {
        "presence_sink": df.filter(F.col("kind") == "presence"),
        "scoring": df.filter(F.col("kind") == "signal"),
        "status": df.filter(F.col("kind").isin("telemetry", "ack")),
    }


def label_normalize(label: Column) -> Column:
    """struct(label, ok, positive) after null -> none, trim and lower."""
    text = F.lower(F.trim(F.coalesce(label, F.lit("none"))))
    return F.struct(text.alias("label"), text.isin(LABELS).alias("ok"), text.isin(POSITIVE_LABELS).alias("positive"))


def constraint_audit(df: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, row_id) for every violated rule; one pass over the rows."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(row_id).alias("row_id"))


def drop_nonmonotonic(df: DataFrame, keys, arrival, time: str, chunk: Column | None = None) -> DataFrame:
    """Keep the first row of a series and every row later than its immediate predecessor (by arrival)."""
    back = o.prefix_scan(df, keys, arrival, {"__prev": ("prev", time)}, chunk)
    return back.filter(F.col("__prev").isNull() | (F.col(time) > F.col("__prev"))).drop("__prev")


def sort_unique_time(df: DataFrame, keys, arrival: Sequence[str], time: str) -> DataFrame:
    """One row per (series, time): the earliest arrival. A map-side combinable aggregate, not a window."""
    rest = [c for c in df.columns if c not in (*keys, time)]
    first = F.min_by(F.struct(*rest), F.struct(*arrival) if len(arrival) > 1 else F.col(arrival[0]))
    return df.groupBy(*keys, time).agg(first.alias("__row")).select(*keys, time, *[F.col(f"__row.{c}") for c in rest])


def truncate_corrupt_tail(df: DataFrame, keys, order, time: str, factor: float = 100.0, chunk: Column | None = None) -> DataFrame:
    """Drop everything from the first gap larger than factor x median positive gap."""
    from echogrid.session import materialize

    gaps = materialize(o.prefix_scan(df, keys, order, {"__prev": ("prev", time)}, chunk).withColumn("gap", F.col(time) - F.col("__prev")))
    limit = o.percentiles(gaps.filter("gap > 0"), keys, "gap", {"__median": 0.5})
    first_bad = (
        gaps.join(limit, list(keys)).filter(F.col("gap") > F.col("__median") * factor)
        .groupBy(*keys).agg(F.min(F.struct(*order)).alias("__cut"))
    )
    kept = gaps.join(first_bad, list(keys), "left")
    return kept.filter(F.col("__cut").isNull() | (F.struct(*order) < F.col("__cut"))).drop("__prev", "__cut", "gap")


def boundary_dedup(df: DataFrame, keys, part: str, time: str) -> DataFrame:
    """Stitching parts: drop rows not later than everything in the earlier parts (part-level maxima only)."""
    ends = df.groupBy(*keys, part).agg(F.max(time).alias("__end"))
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    seen = ends.select(*keys, part, F.max("__end").over(w).alias("__seen"))
    marked = df.join(seen, [*keys, part])
    return marked.withColumn("kept", F.col("__seen").isNull() | (F.col(time) > F.col("__seen"))).drop("__seen")


def usable_columns(df: DataFrame, features: Sequence[str], floor: float = 1e-12) -> DataFrame:
    """Per feature: rows with all features finite, population sd, and whether the column is kept."""
    finite = None
    for name in features:
        ok = F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(F.col(name)) != F.lit(float("inf")))
        finite = ok if finite is None else finite & ok
    stats = df.filter(finite).agg(F.count("*").alias("rows"), *[F.stddev_pop(n).alias(n) for n in features])
    long = stats.unpivot("rows", list(features), "feature", "sd")
    return long.withColumn("kept", F.col("sd") > floor)


def even_positions(n: Column, k: int) -> Column:
    """k evenly spaced positions in 0..n-1, rounded half to even, duplicates dropped."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (n - 1) / F.lit(float(max(k - 1, 1)))).cast("int"))
    return F.array_distinct(spread)


def channel_pick(slots: int, dropped: Sequence[int], target: int) -> list[int]:
    """Slot numbers kept out of `slots`: a fixed list that follows from the hardware layout, not from data."""
    usable = [s for s in range(slots) if s not in set(dropped)]
    if target >= len(usable):
        return usable
    return [usable[round(k * (len(usable) - 1) / (target - 1))] for k in range(target)]


def min_slice(df: DataFrame, groups, label: str, minimum: int) -> DataFrame:
    """Size and class check per group with the reason for skipping it."""
    counts = df.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("positives"))
    return counts.withColumn("skip_reason", F.when(F.col("n") < minimum, "too_small").when(
        (F.col("positives") == 0) | (F.col("positives") == F.col("n")), "one_class"))


def split_guard(df: DataFrame) -> DataFrame:
    """Violations of record rules: (rule, subject_key). Records carry id, role, split, group and path."""
    allowed = F.lit(False)
    for role, splits in ROLE_SPLITS.items():
        allowed = allowed | ((F.col("role") == role) & F.col("split").isin(splits))
    bad_id = df.filter(~F.col("id").rlike(r"^[A-Za-z0-9_.-]+$") | F.col("id").isin(".", "..")).select(F.lit("bad_id").alias("rule"), F.col("id").alias("subject_key"))
    dup_id = df.groupBy("id").count().filter("count > 1").select(F.lit("duplicate_id").alias("rule"), F.col("id").alias("subject_key"))
    bad_split = df.filter(~allowed).select(F.lit("bad_role_split").alias("rule"), F.col("id").alias("subject_key"))

    def spans(column: str, rule: str) -> DataFrame:
        per = df.groupBy(column).agg(F.min(F.struct("role", "split")).alias("lo"), F.max(F.struct("role", "split")).alias("hi"))
        return per.filter("lo <> hi").select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("subject_key"))

    repeat = df.groupBy("path").count().filter("count > 1").select(F.lit("repeated_path").alias("rule"), F.col("path").alias("subject_key"))
    return o.union_all([bad_id, dup_id, bad_split, spans("group", "group_spans_splits"), repeat])


def frame_usability(flags: Column, valid_mask: int, unusable_mask: int) -> Column:
    """NULL when usable, else the reason."""
    return F.when(flags.bitwiseAND(valid_mask) == 0, "not_valid").when(flags.bitwiseAND(unusable_mask) != 0, "diagnostic")


def boundary_stats(df: DataFrame, keys, part: str, time: str) -> DataFrame:
    """Per part: rows kept and dropped by `boundary_dedup` and the gap to the latest earlier time."""
    ends = df.groupBy(*keys, part).agg(F.max(time).alias("__end"))
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    seen = ends.select(*keys, part, F.max("__end").over(w).alias("__seen"))
    ok = F.col("__seen").isNull() | (F.col(time) > F.col("__seen"))
    return df.join(seen, [*keys, part]).groupBy(*keys, part).agg(
        F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"), F.min(F.when(ok, F.col(time) - F.col("__seen"))).alias("boundary_gap"))
