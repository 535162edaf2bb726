"""Greedy selection along an ordered series, in parallel over chunks of one series.

An item is taken when its `enter` value has reached the `release` value of the last taken item; taking it sets the
new release.  Rate limits, cooldowns and refractory periods are all of this form.  The choice looks sequential, but
a chunk only needs one number from the past (the release in force), so the work splits in three steps:

1. per chunk: where every possible incoming release would leave the chunk (only items early enough to be hit by
   the previous chunk's releases matter, so the table stays tiny);
2. per series: follow that table from chunk to chunk;
3. per chunk: mark the items, starting from the known release.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.operators.ordered import CHUNK
from echogrid.session import materialize


def _complete_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of a sorted partition holding whole groups only, with the group borders; at most one chunk is held back."""
    tail = None
    for pdf in frames:
        if tail is not None:
            pdf = pd.concat([tail, pdf], ignore_index=True)
        if pdf.empty:
            continue
        fresh = np.zeros(len(pdf), dtype=bool)
        fresh[0] = True
        for k in keys:
            v = pdf[k].to_numpy()
            fresh[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(fresh)
        tail = pdf.iloc[starts[-1] :]
        if len(starts) > 1:
            yield pdf.iloc[: starts[-1]], starts
    if tail is not None and len(tail):
        yield tail.reset_index(drop=True), np.array([0, len(tail)])


def _exits(enter: np.ndarray, release: np.ndarray, reach: int) -> list[float]:
    """Release in force after the chunk when item i < reach is the first one taken."""
    n = len(enter)
    jump = np.append(np.maximum(np.searchsorted(enter, release, side="left"), np.arange(1, n + 1)), n)
    last = np.arange(n + 1)
    while (jump < n).any():  # pointer doubling along the chain of taken items
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    return release[last[:reach]].tolist()


def greedy_skip(df: DataFrame, keys: Sequence[str], order: Sequence[str], enter: str, release: str, chunk: Column) -> DataFrame:
    """Adds `taken`. `enter` and `release` are doubles, `enter` never falls along `order`; a NULL release blocks the rest."""
    rows = materialize(df.withColumn(CHUNK, chunk))
    keys, by = list(keys), list(order)
    group = [*keys, CHUNK]
    slim = rows.select(*group, *by, F.col(enter).cast("double").alias("__in"), F.coalesce(F.col(release).cast("double"), F.lit(float("inf"))).alias("__out"))
    w = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    limits = slim.groupBy(*group).agg(F.max("__out").alias("__top")).withColumn("__limit", F.max("__top").over(w)).drop("__top")
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = lambda names, more: ", ".join(f"`{n}` {kinds[n]}" for n in names) + f", {more}"

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _complete_groups(frames, group):
            times, frees, bound = pdf["__in"].to_numpy(), pdf["__out"].to_numpy(), pdf["__limit"].to_numpy()
            at, leaves = [], []
            for a, b in zip(starts[:-1], starts[1:]):
                e = times[a:b]
                reach = 1 if np.isnan(bound[a]) else min(int(np.searchsorted(e, bound[a], side="left")) + 1, b - a)
                at.append(e[:reach].tolist())
                leaves.append(_exits(e, frees[a:b], reach))
            yield pdf.iloc[starts[:-1]][group].assign(at=at, leaves=leaves)

    def sorted_by_group(frame: DataFrame) -> DataFrame:
        return frame.repartition(*group).sortWithinPartitions(*group, *by)

    table = sorted_by_group(slim.join(limits, group)).mapInPandas(steps, schema(group, "at array<double>, leaves array<double>"))
    chained = table.repartition(*keys).sortWithinPartitions(*group)

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, force = None, -np.inf
        for pdf in frames:
            begin = []
            for key, at, leaves in zip(zip(*[pdf[k] for k in keys]), pdf["at"], pdf["leaves"]):
                if key != current:
                    current, force = key, -np.inf
                begin.append(force)
                i = int(np.searchsorted(at, force, side="left"))
                force = leaves[i] if i < len(at) else force
            yield pdf[group].assign(__start=begin)

    begins = materialize(chained.mapInPandas(chain, schema(group, "__start double")))

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _complete_groups(frames, group):
            times, frees, begin = pdf["__in"].tolist(), pdf["__out"].tolist(), pdf["__start"].to_numpy()
            taken = np.zeros(len(pdf), dtype=bool)
            for a, b in zip(starts[:-1], starts[1:]):
                i = bisect_left(times, begin[a], a, b)
                while i < b:
                    taken[i] = True
                    i = max(i + 1, bisect_left(times, frees[i], a, b))
            yield pdf[[*group, *by]].assign(taken=taken)

    marked = sorted_by_group(slim.join(begins, group)).mapInPandas(mark, schema([*group, *by], "taken boolean"))
    return rows.join(marked, [*group, *by]).drop(CHUNK)
