import random

import pytest
from pyspark.sql import functions as F

from echogrid.operators import ordered as o


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(rng.choice([1, 1, 1, 2, 3]), t, rng.choice([None, rng.randint(0, 9)])) for t in range(300)]


@pytest.mark.parametrize("use_chunk", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_prefix_scan_equals_python_loop(spark, rows, use_chunk, reverse):
    df = spark.createDataFrame(rows, "k int, t int, v int").repartition(5)
    exprs = {"s": ("sum", "v"), "sb": ("sum_before", "v"), "m": ("max", "v"), "mb": ("max_before", "v"),
             "l": ("last", "v"), "p": ("prev", "v")}
    chunk = F.floor(F.col("t") / 17) if use_chunk else None
    got = {(r.k, r.t): r for r in o.prefix_scan(df, ["k"], ["t"], exprs, chunk, reverse).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        s = m = last = prev = None
        series = sorted([r for r in rows if r[0] == key], key=lambda r: r[1], reverse=reverse)
        for _, t, v in series:
            g = got[(key, t)]
            assert (g.sb, g.mb, g.p) == (s, m, prev)
            if v is not None:
                s, m, last = (s or 0) + v, v if m is None else max(m, v), v
            assert (g.s, g.m, g.l) == (s, m, last)
            prev = v


def test_number_rows_and_halo(spark, rows):
    df = spark.createDataFrame(rows, "k int, t int, v int")
    idx = o.number_rows(df, ["k"], ["t"])
    spread, w = o.with_halo(idx, ["k"], "i", 3, 2, rows=8)
    out = o.own_rows(spread.withColumn("n", F.count("*").over(w.rowsBetween(-3, 2))))
    got = {(r.k, r.i): r.n for r in out.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        size = sum(r[0] == key for r in rows)
        for i in range(size):
            assert got[(key, i)] == min(size - 1, i + 2) - max(0, i - 3) + 1


def test_runs_match_groupby(spark, rows):
    from itertools import groupby

    df = spark.createDataFrame(rows, "k int, t int, v int")
    out = o.runs(df, ["k"], ["t"], F.coalesce(F.col("v"), F.lit(0)) > 4, [F.count("*").alias("n"), F.min("t").alias("a")])
    got = sorted((r.k, r.a, r.n, r.value) for r in out.collect())
    want = []
    for key in {r[0] for r in rows}:
        series = sorted([r for r in rows if r[0] == key], key=lambda r: r[1])
        for flag, grp in groupby(series, key=lambda r: (r[2] or 0) > 4):
            grp = list(grp)
            want.append((key, grp[0][1], len(grp), flag))
    assert got == sorted(want)


def test_percentiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 400), rng.normal(size=400).round(1))]
    df = spark.createDataFrame(data, "g int, v double")
    out = o.percentiles(df, ["g"], "v", {"q25": 0.25, "med": 0.5, "q95": 0.95}).collect()
    for r in out:
        vals = [v for g, v in data if g == r.g]
        assert np.allclose([r.q25, r.med, r.q95], np.percentile(vals, [25, 50, 95]))


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 1.0), (1, 9.0)], "g int, v double")
    got = sorted(r.avg_rank for r in o.average_rank(df, ["g"], "v").collect())
    assert got == [1.0, 2.5, 2.5, 4.0]
