"""Set operations and stitching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.operators import topk


def stitch_phases(rows: DataFrame, session: Sequence[str], phase: str, index: str, fs: float) -> tuple[DataFrame, DataFrame]:
    """Concatenate phases in order on one synthetic clock: (rows with `pos` and `t`, phase boundaries).

    Only phase lengths are ordered per session (one row per phase); the samples get their offset by a join.
    """
    sizes = rows.groupBy(*session, phase).agg((F.max(index) + 1).alias("n"))
    w = Window.partitionBy(*session).orderBy(phase).rowsBetween(Window.unboundedPreceding, -1)
    bounds = sizes.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("end", F.col("start") + F.col("n"))
    bounds = bounds.withColumns({"start_s": F.col("start") / fs, "end_s": F.col("end") / fs}).drop("n")
    stitched = rows.join(bounds.select(*session, phase, "start"), [*session, phase]).withColumn("pos", F.col("start") + F.col(index)).drop("start")
    return stitched.withColumn("t", F.col("pos") / fs), bounds


def order_parts(rows: DataFrame, task: Sequence[str], part: str, time: str) -> DataFrame:
    """Parts of a task by (first time, name); one row per part reaches the window."""
    firsts = rows.groupBy(*task, part).agg(F.min(time).alias("first_time"))
    return firsts.withColumn("position", F.row_number().over(Window.partitionBy(*task).orderBy("first_time", part)))


def missing_keys(wanted: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(cached.select(*keys), list(keys), "left_anti")


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def leakage_canary(train: DataFrame, test: DataFrame, arm: str, levels: Sequence[str]) -> DataFrame:
    """Per arm how many subjects / files / sessions sit on both sides; one pass over the union."""
    both = train.select(arm, *levels).withColumn("__side", F.lit(1)).unionByName(test.select(arm, *levels).withColumn("__side", F.lit(2)))
    pair = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).cast("string").alias("member")) for n in levels]))
    long = both.select(arm, "__side", pair.alias("p")).groupBy(arm, "p.level", "p.member").agg(F.min("__side").alias("lo"), F.max("__side").alias("hi"))
    out = long.groupBy(arm).agg(*[F.count_if((F.col("level") == n) & (F.col("lo") < F.col("hi"))).alias(f"{n}_overlap") for n in levels])
    total = sum((F.col(f"{n}_overlap") for n in levels), F.lit(0))
    return out.withColumn("ok", total == 0)


def refit_union(train: DataFrame, val: DataFrame) -> DataFrame:
    return train.unionByName(val)


def four_mode_union(q: DataFrame, keys: Sequence[str], channel: str, antenna: Column, antennas: int, k: int) -> DataFrame:
    """Stream selection run freely and forced to each antenna, in one pass: each row joins two modes, then one top-k."""
    mode = F.explode(F.array(F.lit("free"), F.concat(F.lit("ant"), antenna.cast("string"), F.lit("_only"))))
    return topk.topk_streams(q.withColumn("selection_mode", mode), [*keys, "selection_mode"], channel, k)
