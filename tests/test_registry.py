import pytest

import __spark_entry__ as entry_module

SMALL = "/root/testdata/sf0.001"


def test_every_sql_check_has_a_query():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 180


def test_flagship_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["device_id", "seq", "recipient_id", "resident_id", "fall_count", "message"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["f4_logs_query", "j1_primary_resident", "a5_confusion_metrics", "u5_leakage_canary"])
def test_small_queries_agree_with_sql(spark, name):
    import duckdb

    from tools.check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry_module.queries()[name](spark, SMALL)
    res = con.execute(entry_module.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_filters_reach_the_scan(spark):
    plan = entry_module.queries()["f4_logs_query"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" not in plan


def test_hot_key_is_cut_into_chunks(spark):
    from pyspark.sql import functions as F

    from echogrid.operators import ordered as o

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("t"))
    spread, _ = o.with_halo(o.number_rows(rows, ["k"], ["t"], "i", F.floor(F.col("t") / 1000)), ["k"], "i", 4, 0, rows=512)
    largest = spread.groupBy("k", o.CHUNK).count().agg(F.max("count")).first()[0]
    assert largest <= 512 + 4
