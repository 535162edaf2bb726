import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.operators.greedy import greedy_skip


@pytest.mark.parametrize("width", [3, 20, 10_000])
def test_greedy_skip_equals_a_plain_loop(spark, width):
    rng = np.random.default_rng(8)
    rows = []
    for key, n in ((1, 300), (2, 60), (3, 1)):  # key 1 holds most rows
        t = np.cumsum(rng.integers(0, 3, n)).astype(float)
        rows += [(key, k, float(v), float(v + rng.integers(1, 9))) for k, v in enumerate(t)]
    df = spark.createDataFrame(rows, "k int, i int, t double, r double")
    got = {(r.k, r.i): r.taken for r in greedy_skip(df, ["k"], ["t", "i"], "t", "r", F.floor(F.col("t") / width)).collect()}
    for key in (1, 2, 3):
        free = float("-inf")
        for k, i, t, r in rows:
            if k == key:
                want = t >= free
                assert got[(k, i)] == want
                free = r if want else free
