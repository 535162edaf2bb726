"""Recording readers: file index, packed CSV cells, amplitude tables, binary frames, base64 signals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echogrid.functions import scalars as fx
from echogrid.operators import ordered as o

# Recording name patterns, cell layout, frame layout.
LAB_NAME = r"E(\d+)_S(\d+)_C(\d+)_A(\d+)_T(\d+)"
INHOUSE_NAME = r"^P(\d+)S(\d+)C(\d+)(?:F(\d+)-(\d+))?Q(\d+)_(labeled|csi)$"
TAKE_LABELS = {1: "a10", 2: "a10", 3: "a11", 4: "a11", 5: "a12", 6: "a12"}
FRAME_HEADER = "<HHBBI6sbBBBBBBBBBBbBBBBHHIbBHBB"
FRAME_MAGIC, FRAME_VERSION, FRAME_TYPE, HEADER_BYTES, MAX_PAYLOAD = 0xA55A, 1, 1, 46, 612


def scan_files(spark: SparkSession, glob: str) -> DataFrame:
    """Paths, sizes and times only: the content column is never read."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", "modificationTime")


def recording_index(df: DataFrame, path: str, strict: bool = True) -> DataFrame:
    """Parse lab recording names; `strict` stops the job at a bad name, otherwise bad names get NULL columns."""
    part = lambda k: F.regexp_extract(path, LAB_NAME, k).try_cast("int")
    bad = F.regexp_extract(path, LAB_NAME, 1) == ""
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad recording name: "), F.col(path)))).otherwise(part(1)) if strict else part(1)
    cols = {"env": checked, "subject": part(2), "class_id": part(3), "activity": part(4), "trial": part(5)}
    return df.withColumns(cols).withColumn("is_fall", F.col("activity").isin(2, 5)).orderBy("env", "subject", "class_id", "activity", "trial")


def lab_cells(rx: int = 3, sub: int = 30) -> list[str]:
    return [f"csi_1_{r}_{s}" for r in range(1, rx + 1) for s in range(1, sub + 1)]


def lab_csv_scan(spark: SparkSession, path: str, extra: str = "", cells: Sequence[str] | None = None) -> DataFrame:
    """Lab CSV: text cells to array<struct<re,im>>; missing cells are zero."""
    names = list(cells or lab_cells())
    head = "timestamp_low bigint" + (f", {extra}" if extra else "")
    raw = spark.read.csv(path, header=True, schema=head + ", " + ", ".join(f"{c} string" for c in names))
    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    iq = F.transform(F.array(*names), lambda c: F.coalesce(fx.parse_complex(c), zero))
    return raw.select(*[c for c in raw.columns if c not in names], iq.alias("iq"))


def inhouse_index(df: DataFrame, path: str) -> DataFrame:
    """Parse in-house names; other files are left out."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    g = lambda k: F.regexp_extract(stem, INHOUSE_NAME, k)
    out = df.filter(stem.rlike(INHOUSE_NAME)).withColumns({
        "person": g(1).try_cast("int"), "session": g(2).try_cast("int"), "config": g(3).try_cast("int"),
        "fresnel_a": g(4).try_cast("int"), "fresnel_b": g(5).try_cast("int"), "take": g(6).try_cast("int"), "has_label": g(7) == "labeled"})
    expected = fx.label_of(TAKE_LABELS, F.col("take"))
    return out.withColumns({"expected_label": expected, "is_fall_take": expected.isNotNull()})


def inhouse_csv_scan(spark: SparkSession, path: str, length: int = 490) -> DataFrame:
    """In-house CSV rows with `csi` as int array, `amplitude`, and `ok` = right length; "none" stays a text label."""
    raw = spark.read.csv(path, header=True, escape='"', schema="file string, dev_timestamp bigint, csi string, label string", nullValue="\u0000")
    csi = F.from_json("csi", "array<int>")
    rows = raw.withColumn("csi", csi).withColumn("ok", F.coalesce(F.size("csi") == length, F.lit(False)))
    return rows.withColumn("amplitude", fx.iq_amplitude(F.col("csi"), length // 2))


def inhouse_summary(rows: DataFrame, order: str, clock: str, fall_labels: Sequence[str] = ("a10", "a11", "a12")) -> DataFrame:
    """Per file: packets, rejects, effective rate, label found and whether it disagrees with the take number."""
    is_fall = F.col("label").isin(list(fall_labels))
    per = rows.groupBy("file").agg(
        F.count("*").alias("packets"), F.count_if(~F.col("ok")).alias("rejected"), F.min(clock).alias("t0"), F.max(clock).alias("t1"),
        F.coalesce(F.min(F.when(is_fall, F.col("label"))), F.lit("none")).alias("file_label"), F.count_if(is_fall).alias("n_label_rows"))
    span = (F.col("t1") - F.col("t0")) / 1e6
    named = inhouse_index(per, "file")
    return named.withColumn("fs_hz_eff", F.when(span > 0, (F.col("packets") - 1) / F.nullif(span, F.lit(0.0)))).withColumn(
        "label_mismatch", F.coalesce(F.col("expected_label") != F.col("file_label"), F.lit(False))).drop("t0", "t1")


def amplitude_scan(df: DataFrame, values: str, label: str, widths: Sequence[int] = (30, 90)) -> DataFrame:
    """Amplitude rows with `reject_reason`: wrong width, non-finite cells or non-binary label."""
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return df.withColumn("reject_reason", F.when(~F.size(values).isin(list(widths)), "bad_width").when(~finite, "not_finite").when(
        F.col(label).isNotNull() & ~F.col(label).isin(0, 1), "bad_label"))


def encode_frames(df: DataFrame, seq: str, iq: str) -> DataFrame:
    """Rows with an int array of (imag, real) pairs to `frame` bytes (the inverse of `decode_frames`)."""
    import struct

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for s, values in zip(pdf[seq], pdf[iq]):
                payload = np.asarray(values, dtype=np.int8).tobytes()
                head = struct.pack(FRAME_HEADER, FRAME_MAGIC, HEADER_BYTES + len(payload) + 2, FRAME_VERSION, FRAME_TYPE, int(s), b"\x01\x02\x03\x04\x05\x06",
                                   -40, *[0] * 10, -95, 0, 6, 0, 0, 0, 0, int(s) * 1000 % 2**32, 1, 2, len(payload), 0, 0)
                body = head + payload
                out.append(body + struct.pack("<H", sum(body) & 0xFFFF))
            yield pdf.drop(columns=[iq]).assign(frame=out)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != iq)
    return df.mapInPandas(run, f"{kept}, frame binary")


def decode_frames(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Binary frames to header fields, amplitudes and `reject_reason`; one Arrow batch at a time."""
    import struct

    names = ("seq", "mac", "rssi", "noise_floor", "channel", "timestamp_us", "fft_gain", "agc_gain", "csi_len")

    def one(raw: bytes | None) -> tuple:
        empty = (None,) * len(names)
        if raw is None or len(raw) < HEADER_BYTES + 2 or len(raw) > HEADER_BYTES + MAX_PAYLOAD + 2:
            return (*empty, None, "bad_length")
        if int(np.frombuffer(raw, np.uint8)[:-2].sum()) & 0xFFFF != struct.unpack_from("<H", raw, len(raw) - 2)[0]:
            return (*empty, None, "bad_checksum")
        h = struct.unpack_from(FRAME_HEADER, raw, 0)
        if h[2] != FRAME_VERSION:
            return (*empty, None, "bad_version")
        if h[3] != FRAME_TYPE:
            return (*empty, None, "bad_type")
        n = h[27]
        payload = np.frombuffer(raw[HEADER_BYTES : HEADER_BYTES + n], np.int8).astype(np.float32)
        if payload.size != n:
            return (*empty, None, "bad_length")
        amps = np.hypot(payload[0::2], payload[1::2])
        return (h[4], h[5].hex(":"), h[6], h[17], h[19], h[24], h[25], h[26], n, amps.astype(float), None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            decoded = pd.DataFrame([one(r) for r in pdf[frame]], columns=[*names, "amps", "reject_reason"], index=pdf.index)
            ints = [n for n in names if n != "mac"]
            decoded[ints] = decoded[ints].astype("Int64")
            yield pd.concat([pdf.drop(columns=[frame]), decoded], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != frame)
    schema = (f"{kept}, seq bigint, mac string, rssi bigint, noise_floor bigint, channel bigint, timestamp_us bigint, fft_gain bigint, "
              "agc_gain bigint, csi_len bigint, amps array<double>, reject_reason string")
    return df.mapInPandas(run, schema)


@F.pandas_udf(T.StringType())
def encode_signal(values: pd.Series) -> pd.Series:
    import base64

    return values.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode("ascii"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _floats(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def decode_signal(df: DataFrame, text: str, declared: str) -> DataFrame:
    """base64 float32 text to `signal`; the length check is native, only sound rows reach the Arrow decoder."""
    raw = df.withColumn("__raw", F.try_to_binary(F.col(text), F.lit("base64")))
    reason = F.when(F.col("__raw").isNull(), "bad_base64").when(F.octet_length("__raw") != 4 * F.col(declared), "length_mismatch")
    raw = raw.withColumn("reject_reason", reason)
    return raw.withColumn("signal", _floats(F.when(F.col("reject_reason").isNull(), F.col("__raw")))).drop("__raw")


def input_signature(df: DataFrame, path: str, content: str, config_json: str) -> DataFrame:
    """One signature over (path, sha-256 of the content) of every row and the canonical config text.

    Each row's digest enters as eight sums of 32-bit words, so rows in any order add up in parallel and no list is gathered,
    while swapping the contents of two paths changes the signature.
    """
    digest = F.sha2(F.concat_ws(":", F.col(path).cast("string"), F.sha2(F.col(content).cast("binary"), 256)), 256)
    word = lambda k: F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")
    sums = df.select(digest.alias("h")).agg(F.count("*").alias("inputs"), *[F.coalesce(F.sum(word(k)), F.lit(0)).alias(f"w{k}") for k in range(8)])
    parts = [F.col("inputs").cast("string"), *[F.col(f"w{k}").cast("string") for k in range(8)]]
    return sums.select(F.sha2(F.concat(F.concat_ws(":", *parts), F.lit("#"), F.lit(config_json)), 256).alias("signature"), "inputs")


def checked_signature(current: DataFrame, stored: str) -> DataFrame:
    """`current` unchanged, or an error when its signature differs from the stored one."""
    refused = F.raise_error(F.concat(F.lit("stored inputs differ: "), F.col("signature"))).cast("string")
    return current.withColumn("signature", F.when(F.col("signature") == stored, F.col("signature")).otherwise(refused))


def file_signature(spark: SparkSession, glob: str, config_json: str) -> DataFrame:
    return input_signature(spark.read.format("binaryFile").load(glob), "path", "content", config_json)


def manifest(df: DataFrame, keys: Sequence[str], checks: dict[str, Column], stats: dict[str, Column], error_chars: int | None = None) -> DataFrame:
    """One row per recording with stats, `status` and `error_msg`; a failing recording never stops the others.

    `error_chars` cuts the message where a consumer asks for short ones; by default it is whole.
    """
    errors = F.concat_ws("; ", *[F.when(F.max(bad.cast("int")) == 1, F.lit(name)) for name, bad in checks.items()])
    out = df.groupBy(*keys).agg((errors if error_chars is None else F.substring(errors, 1, error_chars)).alias("error_msg"), *[e.alias(n) for n, e in stats.items()])
    return out.withColumn("status", F.when(F.col("error_msg") == "", "ok").otherwise("error"))


def upsert_cache(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last write per key wins: one combinable aggregate over both sides.

    Columns go through `max_by` one by one, all by the same comparisons and so from the same row: fixed-width ones are then
    hashed, while a struct of them would have to be sorted before and behind the shuffle.
    """
    rest = [c for c in stored.columns if c not in keys]
    both = stored.unionByName(incoming)
    return both.groupBy(*keys).agg(*[F.max_by(c, version).alias(c) for c in rest])


def replace_long(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All stored rows of an incoming key are replaced by the incoming rows."""
    return stored.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)


def retained(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows newer than the newest time minus `days`; on a date-partitioned table the filter prunes folders."""
    newest = df.agg(F.max(ts).alias("newest")).scalar()
    return df.filter(F.col(ts) >= newest - F.make_interval(days=F.lit(days)))


def expired_dates(dates: DataFrame, newest: str, days: int) -> DataFrame:
    """Whole date partitions that the retention rule allows to drop."""
    return dates.filter(F.col("date") < F.date_sub(F.to_date(F.lit(newest)), days))
