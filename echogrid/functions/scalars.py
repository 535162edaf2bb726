"""Column expressions: all native, so they stay inside generated code and reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Activity names, response labels, message texts, effect-size bins, receiver power offset.
ACTIVITY_NAMES = {
    1: "Sit still", 2: "Falling down (from sit)", 3: "Lie down", 4: "Stand still", 5: "Falling down (from stand)",
    6: "Walk to receiver", 7: "Turning", 8: "Walk to transmitter", 9: "Turning", 10: "Standing up", 11: "Sitting down",
    12: "Pick pen from ground",
}
RESPONSE_LABELS = {"PENDING": "대기중", "ACKNOWLEDGED": "확인함", "DISPATCHED": "출동중", "FALSE_ALARM": "오탐지"}
FALL_TITLE = "낙상 감지"
FALL_MESSAGE = "낙상이 감지되었습니다.\n시각: %s\n확률: %s (누적 %d회)"
FALL_LOG = "%s (%s) 낙상 감지 · 신뢰도 %.3f"
CLIFF_BINS = ((0.147, "negligible"), (0.33, "small"), (0.474, "medium"))
RSSI_OFFSET_DB = 44.0


def parse_complex(text: Column) -> Column:
    """`a+bi` or `a+-bi` as struct(re, im); NULL when the text is not complex."""
    pattern = r"^\s*([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)\s*\+?\s*([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)\s*[ij]\s*$"
    re = F.regexp_extract(text, pattern, 1).try_cast("double")
    im = F.regexp_extract(text, pattern, 2).try_cast("double")
    return F.when(re.isNotNull() & im.isNotNull(), F.struct(re.alias("re"), im.alias("im")))


def complex_magnitude(text: Column) -> Column:
    value = parse_complex(text)
    return F.hypot(value["re"], value["im"])


def iq_amplitude(flat: Column, pairs: int) -> Column:
    """Interleaved (imag, real) integers to `pairs` magnitudes; NULL when the length is wrong."""
    at = F.sequence(F.lit(0), F.lit(pairs - 1))
    amplitude = F.transform(at, lambda k: F.hypot(F.get(flat, 2 * k).cast("double"), F.get(flat, 2 * k + 1).cast("double")))
    return F.when(F.size(flat) == 2 * pairs, amplitude)


def device_topic(prefix: str, tenant: Column, device: Column, leaf: Column | None = None) -> Column:
    """`prefix/tenant/device[/leaf]`; NULL when a segment is empty or holds `/`, `+` or `#`."""
    ok = tenant.rlike(r"^[^/+#]+$") & device.cast("string").rlike(r"^[^/+#]+$")
    parts = [F.lit(prefix), tenant, device.cast("string")] + ([leaf] if leaf is not None else [])
    return F.when(ok, F.concat_ws("/", *parts))


def parse_topic(topic: Column) -> Column:
    parts = F.split(topic, "/")
    return F.struct(
        F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).alias("tenant"),
        F.get(parts, F.lit(2)).alias("device"), F.get(parts, F.lit(3)).alias("leaf"), F.size(parts).alias("parts"),
    )


def recording_name(env, subject, klass, activity, trial) -> Column:
    return F.format_string("E%d_S%02d_C%02d_A%02d_T%02d", *[F.col(c) if isinstance(c, str) else c for c in (env, subject, klass, activity, trial)])


def sample_id(recording: Column, rx: Column, start: Column) -> Column:
    return F.concat(recording.cast("string"), F.lit("_rx"), rx.cast("string"), F.lit("_s"), start.cast("string"))


def window_id(n: Column) -> Column:
    return F.concat(F.lit("w"), F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")))


def total_rss_dbm(rssi: Sequence[Column], agc: Column) -> Column:
    """Received power from per-antenna RSSI and gain; antennas reporting 0 are left out; NULL when none report."""
    power = sum((F.when(r > 0, F.pow(F.lit(10.0), r / 10.0)).otherwise(F.lit(0.0)) for r in rssi), F.lit(0.0))
    return F.when(power > 0, 10.0 * F.log10(power) - RSSI_OFFSET_DB - agc)


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds to timestamp; NULL for NaN, infinity and years outside 1..9999."""
    inside = seconds.between(-62_135_596_800.0, 253_402_300_799.0)
    return F.when(inside & ~F.isnan(seconds), F.timestamp_micros((F.round(seconds * 1e6, 0)).cast("bigint")))


def event_key(device: Column, ts: Column, seq: Column) -> Column:
    return F.concat_ws(":", device.cast("string"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), seq.cast("string"))


def label_of(mapping: dict, key: Column, default: str | None = None) -> Column:
    """Small fixed mapping as a CASE chain (stays in generated code)."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


def cliff_magnitude(delta: Column) -> Column:
    expr = F.when(delta.isNull(), F.lit(None).cast("string"))
    for bound, name in CLIFF_BINS:
        expr = expr.when(F.abs(delta) < bound, F.lit(name))
    return expr.otherwise(F.lit("large"))


def normal_text(text: Column, upper: bool = False) -> Column:
    return F.upper(F.trim(text)) if upper else F.lower(F.trim(text))


def zone_label(a: Column, b: Column, mode: str = "a") -> Column:
    """Zone pair label: `F?`, `F1`, `F1-?` or `F1-2`."""
    first = F.concat(F.lit("F"), a.cast("string"))
    if mode == "a":
        return F.when(a.isNull(), F.lit("F?")).otherwise(first)
    return F.when(a.isNull(), F.lit("F?")).otherwise(F.concat(first, F.lit("-"), F.coalesce(b.cast("string"), F.lit("?"))))


def device_mapping(device: Column, devices: Column) -> Column:
    """struct(primary, ids): ids default to the single device, duplicates dropped, primary must be one of them."""
    single = F.when(device.isNotNull(), F.array(device)).otherwise(F.array().cast("array<bigint>"))
    ids = F.array_distinct(F.coalesce(devices, single))
    primary = F.when(F.array_contains(ids, device), device).otherwise(F.try_element_at(ids, F.lit(1)))
    return F.struct(primary.alias("primary"), ids.alias("ids"))


def notification_text(at: Column, proba: Column, count: Column) -> Column:
    share = F.when(proba.isNull(), F.lit("N/A")).otherwise(F.concat(F.format_string("%.1f", F.round(proba * 100, 1)), F.lit("%")))
    return F.format_string(FALL_MESSAGE, F.date_format(at, "yyyy-MM-dd HH:mm:ss"), share, count)


def stable_order(seed: int | str, *ids: Column) -> Column:
    """Deterministic pseudo-random sort key: md5 of seed and id, identical on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def params_hash(params: Column) -> Column:
    """Digest of a canonical parameter text, e.g. `to_json` of a struct with sorted names."""
    return F.sha1(params)


def membership_hash(df: DataFrame, keys: Sequence[str], member: str, block: int = 4096, length: int = 10) -> DataFrame:
    """Digest of the sorted integer members of each group, as a two-level hash: no list grows past one block."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(member)), lambda v: v.cast("string")), ",")
    blocks = df.groupBy(*keys, F.floor(F.col(member) / block).alias("block")).agg(F.sha1(joined).alias("h"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block", "h"))), lambda v: v["h"])
    return blocks.groupBy(*keys).agg(F.substring(F.sha1(F.array_join(ordered, ",")), 1, length).alias("digest"))


def linear_resize(values: Column, bins: int) -> Column:
    """Resize an array to `bins` points by linear interpolation on [0, 1]."""

    def resize(v: Column) -> Column:
        last = F.size(v) - 1

        def point(k: Column) -> Column:
            pos = k * last / F.lit(float(bins - 1))
            lo = F.least(F.floor(pos).cast("int"), F.greatest(last - 1, F.lit(0)))
            return F.get(v, lo) + (F.get(v, F.least(lo + 1, last)) - F.get(v, lo)) * (pos - lo)

        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), point)

    return let(values, resize)


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def array_dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` (lambda bodies are not shared by the optimizer)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_percentile(values: Column, p: float) -> Column:
    """Interpolated percentile of one bounded array (a window, never a group)."""

    def pick(v: Column) -> Column:
        pos = (F.size(v) - 1) * F.lit(p)
        lo = F.get(v, F.floor(pos).cast("int"))
        return lo + (F.get(v, F.ceil(pos).cast("int")) - lo) * (pos - F.floor(pos))

    return let(F.sort_array(values), pick)


def percentile_scale(values: Column, p: float, floor: float = 1e-6) -> Column:
    """p-percentile of absolute values; tiny scales fall back to the maximum, then to 1."""
    magnitude = F.transform(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)), lambda v: F.abs(v))

    def choose(m: Column) -> Column:
        pair = F.struct(array_percentile(m, p).alias("scale"), F.array_max(m).alias("top"))
        return let(pair, lambda s: F.when(s["scale"] >= floor, s["scale"]).when(s["top"] >= floor, s["top"]).otherwise(F.lit(1.0)))

    return let(magnitude, choose)


def clip_to_scale(values: Column, scale: Column) -> Column:
    return F.transform(values, lambda v: F.greatest(F.least(v / scale, F.lit(1.0)), F.lit(-1.0)))


def block_pool(values: Column, height: int, width: int, rows: int, cols: int) -> Column:
    """Block means of a flattened height x width map on a rows x cols grid; leftover edges are cut."""
    kh, kw = height // rows, width // cols
    cells = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    inner = F.sequence(F.lit(0), F.lit(kh * kw - 1))

    def cell(c: Column) -> Column:
        r0, c0 = F.floor(c / cols) * kh, (c % cols) * kw
        take = F.transform(inner, lambda k: F.get(values, ((r0 + F.floor(k / kw)) * width + c0 + k % kw).cast("int")))
        return array_mean(take)

    return F.transform(cells, cell)


def log_scale(value: Column, scale: float) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)) * scale)
