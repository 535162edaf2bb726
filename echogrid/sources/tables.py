"""The given tables read as sensing tables, in Spark and (for cross-checks) as SQL text.

Every view is a lazy projection of whole tables; parquet column pruning and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.session import fan_out

# Scoring threshold and the activities that count as a fall.
THRESHOLD = 0.468
FALL_ACTIVITIES = (2, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS recording_id",
        "cast(vec_id % 3 AS int) + 1 AS env",
        "cast(vec_id % 30 AS int) + 1 AS subject",
        "label + 1 AS activity",
        "cast(floor(vec_id / 30) AS int) AS trial",
        "(label + 1) IN (2, 5) AS is_fall",
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packed 64-sample window per (recording, channel)."""
    return fan_out(table(spark, sf_dir, "embeddings")).selectExpr(
        "vec_id", "vec_id div 10 AS recording_id", "cast(vec_id % 10 AS int) AS ch", "label",
        "transform(embedding, v -> cast(v AS double)) AS x",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: (recording, channel, sample index, value)."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id div 10 AS recording_id", "cast(vec_id % 10 AS int) AS ch", "posexplode(embedding) AS (i, v)"
    ).selectExpr("recording_id", "ch", "i", "cast(v AS double) AS x")


def inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS device_id", "event_id AS seq", "ts", "least(value / 100.0D, 1.0D) AS proba_fall", "ts AS inferred_at"
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular per-device series with a microsecond clock."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS device_id", "event_id AS seq", "ts", "unix_micros(cast(ts AS timestamp)) AS t_us", "value", "event_type"
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS device_id", "c_nationkey AS facility_id", "c_name AS name", "c_mktsegment AS room"
    )


def resident_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey % 100 AS resident_id", "c_custkey AS device_id", "c_custkey < 100 AS is_primary"
    )


def residents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS resident_id", "s_name AS resident_name", "concat('room-', s_nationkey) AS resident_room",
        "s_nationkey AS created_rank",
    )


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS recipient_id", "p_size % 25 AS facility_id",
        "case when p_partkey % 3 = 0 then null else p_partkey % 100 end AS resident_id",
        "p_size % 2 = 0 AS enabled", "p_partkey % 5 <> 0 AS push",
        "case when p_partkey % 7 = 0 then null else concat('topic-', p_partkey) end AS topic",
        "p_name AS recipient_name",
    )


def fall_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS device_id", "o_custkey % 100 AS resident_id", "o_custkey % 25 AS facility_id",
        "o_orderdate AS occurred_at",
        "case o_orderstatus when 'P' then 'PENDING' when 'F' then 'ACKNOWLEDGED' else 'FALSE_ALARM' end AS response",
        "least(o_totalprice / 500000.0D, 1.0D) AS confidence",
    )


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "text AS msg", "upper(lang) AS level", "source AS facility_id", "doc_id % 100 AS resident_id",
        "n_chars",
    )


# The same views for the SQL side; a query lists the ones it needs with `with_views`.
SQL_VIEWS = {
    "file_index": """SELECT vec_id AS recording_id, CAST(vec_id % 3 AS INT) + 1 AS env, CAST(vec_id % 30 AS INT) + 1 AS subject,
        label + 1 AS activity, CAST(floor(vec_id / 30) AS INT) AS trial, (label + 1) IN (2, 5) AS is_fall FROM embeddings""",
    "windows": """SELECT vec_id, vec_id // 10 AS recording_id, CAST(vec_id % 10 AS INT) AS ch, label,
        list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings""",
    "samples": """SELECT recording_id, ch, CAST(i - 1 AS INT) AS i, CAST(v AS DOUBLE) AS x FROM (
        SELECT vec_id // 10 AS recording_id, CAST(vec_id % 10 AS INT) AS ch, unnest(embedding) AS v,
        generate_subscripts(embedding, 1) AS i FROM embeddings)""",
    "inference": """SELECT user_id AS device_id, event_id AS seq, ts, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS proba_fall,
        ts AS inferred_at FROM events""",
    "packets": """SELECT user_id AS device_id, event_id AS seq, ts, epoch_us(ts) AS t_us, value, event_type FROM events""",
    "devices": """SELECT c_custkey AS device_id, c_nationkey AS facility_id, c_name AS name, c_mktsegment AS room FROM customer""",
    "resident_devices": """SELECT c_custkey % 100 AS resident_id, c_custkey AS device_id, c_custkey < 100 AS is_primary FROM customer""",
    "residents": """SELECT s_suppkey AS resident_id, s_name AS resident_name, 'room-' || s_nationkey AS resident_room,
        s_nationkey AS created_rank FROM supplier""",
    "recipients": """SELECT p_partkey AS recipient_id, p_size % 25 AS facility_id,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 100 END AS resident_id, p_size % 2 = 0 AS enabled,
        p_partkey % 5 <> 0 AS push, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'topic-' || p_partkey END AS topic,
        p_name AS recipient_name FROM part""",
    "fall_events": """SELECT o_orderkey AS id, o_custkey AS device_id, o_custkey % 100 AS resident_id, o_custkey % 25 AS facility_id,
        o_orderdate AS occurred_at,
        CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'ACKNOWLEDGED' ELSE 'FALSE_ALARM' END AS response,
        least(o_totalprice / 500000.0::DOUBLE, 1.0::DOUBLE) AS confidence FROM orders""",
    "event_logs": """SELECT doc_id AS id, text AS msg, upper(lang) AS level, source AS facility_id, doc_id % 100 AS resident_id,
        n_chars FROM documents""",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """`WITH` the named views (space separated) in front of a query; the body may add CTEs after a leading comma."""
    views = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names.split())
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{views}{'' if body.startswith(',') else ' '}{body}"


def r6(expr: str, digits: int = 6) -> str:
    """SQL text rounding a double; adding zero turns -0.0 into 0.0."""
    return f"(round({expr}, {digits}) + 0)"


def rnd(col, digits: int = 6):
    """Spark twin of `r6`."""
    return F.round(col, digits)
