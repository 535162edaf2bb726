"""Ordered-series building blocks that never put one whole series into one task.

A plain `Window.partitionBy(series)` sends every row of a series to a single task; a series holding a third of
the data then decides the run time.  Here a series is cut into ordered chunks, the window runs inside
(series, chunk), and only one small row per chunk is carried across chunk borders.

* `prefix_scan`  running sum / max / last value / previous value, exact over the whole series
* `number_rows`  0-based row number over the whole series
* `with_halo`    fixed-width neighbourhoods on a series that already has a dense row number
* `ecdf`         distinct values of a group in order with counts below them: ranks and exact percentiles
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.session import materialize

CHUNK = "__chunk"


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def time_chunk(ts: str, seconds: int) -> Column:
    """Chunk id from a timestamp; monotone in time, bounded by the rate of one series inside `seconds`."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000))


def sorted_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-sort by (keys, order) and use the range partition as the chunk: balanced whatever the skew.

    The sorted rows are checkpointed, so every later reader sees the same chunk borders.
    """
    ordered = materialize(df.sort(*keys, *order))
    return ordered.withColumn(CHUNK, F.spark_partition_id())


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    exprs: dict[str, tuple[str, str | Column]],
    chunk: Column | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Add running values over the whole series given by `keys` in `order`.

    `exprs` maps an output name to (kind, value); kinds: `sum`, `sum_before`, `max`, `max_before`, `min`, `last`
    (last non-null value up to this row), `last_before`, `prev` (value of the previous row, null allowed).
    `chunk` must be monotone in `order`; without it the rows are range-sorted first.  `reverse` runs from the end.
    """
    original = df.columns
    if chunk is not None:
        df = df.withColumn(CHUNK, chunk)
    elif CHUNK not in df.columns:
        df = sorted_chunks(df, keys, order)
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    local = Window.partitionBy(*keys, CHUNK).orderBy(*[direction(c) for c in order])
    upto, before = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
    inputs = {name: (F.col(v) if isinstance(v, str) else v) for name, (_, v) in exprs.items()}
    position = F.struct(*_cols(order)) if len(order) > 1 else F.col(order[0])
    pick_end = F.min_by if reverse else F.max_by

    scanned, totals, carries, merged = {}, [], {}, {}
    across = Window.partitionBy(*keys).orderBy(direction(CHUNK)) if keys else Window.partitionBy(F.lit(0)).orderBy(direction(CHUNK))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in exprs.items():
        v, base = inputs[name], kind.removesuffix("_before")
        frame = before if kind.endswith("_before") else upto
        tot, car = f"__t_{name}", f"__c_{name}"
        if base == "sum":
            scanned[name] = F.sum(v).over(frame)
            totals.append(F.sum(v).alias(tot))
            carries[car] = F.sum(tot).over(earlier)
            merged[name] = F.when(
                F.col(name).isNotNull() | F.col(car).isNotNull(),
                F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(car), F.lit(0)),
            )
        elif base in ("max", "min"):
            agg, join = (F.max, F.greatest) if base == "max" else (F.min, F.least)
            scanned[name] = agg(v).over(frame)
            totals.append(agg(v).alias(tot))
            carries[car] = agg(tot).over(earlier)
            merged[name] = join(F.col(name), F.col(car))
        elif base == "last":
            scanned[name] = F.last(v, ignorenulls=True).over(frame)
            totals.append(pick_end(v, F.when(v.isNotNull(), position)).alias(tot))
            carries[car] = F.last(tot, ignorenulls=True).over(earlier)
            merged[name] = F.coalesce(F.col(name), F.col(car))
        elif base == "prev":
            scanned[name] = F.lag(F.struct(v.alias("v"))).over(local)
            totals.append(pick_end(F.struct(v.alias("v")), position).alias(tot))
            carries[car] = F.lag(tot).over(across)
            merged[name] = F.coalesce(F.col(name), F.col(car))["v"]
        else:
            raise ValueError(f"unknown scan kind {kind}")
    body = df.withColumns(scanned)
    carry = df.groupBy(*keys, CHUNK).agg(*totals).withColumns(carries).select(*keys, CHUNK, *carries)
    out = body.join(carry, [*keys, CHUNK]).withColumns(merged)
    return out.select(*original, *exprs)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "i", chunk: Column | None = None
) -> DataFrame:
    """0-based row number of each row inside its series."""
    numbered = prefix_scan(df, keys, order, {out: ("sum", F.lit(1))}, chunk)
    return numbered.withColumn(out, (F.col(out) - 1).cast("bigint"))


def with_halo(df: DataFrame, keys: Sequence[str], index: str, before: int, after: int, rows: int = 65_536):
    """Copy the rows near a chunk border into the neighbouring chunks.

    Returns (rows with `__chunk` and `__own`, window spec).  Any frame reaching at most `before` rows back and
    `after` rows ahead is then exact for rows with `__own`; the copies are dropped by `own_rows`.
    """
    rows = max(rows, before + after + 1)
    at = F.floor(F.col(index) / rows)
    first, last = F.floor((F.col(index) - after) / rows), F.floor((F.col(index) + before) / rows)
    spread = df.withColumn("__home", at).withColumn(CHUNK, F.explode(F.sequence(first, last)))
    spread = spread.withColumn("__own", F.col("__home") == F.col(CHUNK)).drop("__home")
    return spread, Window.partitionBy(*keys, CHUNK).orderBy(index)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("__own").drop("__own", CHUNK)


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    same: Column,
    aggs: Sequence[Column],
    chunk: Column | None = None,
) -> DataFrame:
    """Maximal stretches of rows with an equal `same` value; one output row per stretch (`run`, `value`, aggs)."""
    marked = df.withColumn("value", same)
    if chunk is None and CHUNK not in marked.columns:
        marked = sorted_chunks(marked, keys, order)
    stepped = prefix_scan(marked, keys, order, {"__before": ("prev", F.struct(F.col("value").alias("x")))}, chunk)
    change = F.when(
        F.col("__before").isNull() | ~F.col("__before.x").eqNullSafe(F.col("value")), F.lit(1)
    ).otherwise(F.lit(0))
    stepped = materialize(stepped.withColumn("__step", change).drop("__before"))
    ids = prefix_scan(stepped, keys, order, {"run": ("sum", F.col("__step"))}, chunk)
    return ids.groupBy(*keys, "run", "value").agg(*aggs)


def ecdf(df: DataFrame, groups: Sequence[str], value: str, extra: dict[str, Column] | None = None, with_next: bool = False) -> DataFrame:
    """Distinct finite values of each group in order with `n` rows, `below` rows before them and `total` rows.

    `extra` adds further counts (e.g. positives) with the suffix `_below` / `_total`; `with_next` adds the next value.  Rows collapse to distinct
    values before any shuffle, and the order is a range sort, so neither a hot group nor a hot value piles up.
    """
    counts = {"n": F.lit(1), **(extra or {})}
    if not groups:
        return ecdf(df.withColumn("__all", F.lit(0)), ["__all"], value, extra, with_next).drop("__all")
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    distinct = clean.groupBy(*groups, value).agg(*[F.sum(c).cast("bigint").alias(n) for n, c in counts.items()])
    chunks = sorted_chunks(distinct, groups, [value])
    scanned = prefix_scan(chunks, groups, [value], {_below(n): ("sum_before", F.col(n)) for n in counts})
    scanned = scanned.withColumns({_below(n): F.coalesce(F.col(_below(n)), F.lit(0)) for n in counts})
    if with_next:
        scanned = prefix_scan(materialize(scanned), groups, [value], {"next": ("prev", value)}, reverse=True)
    totals = chunks.groupBy(*groups).agg(*[F.sum(n).cast("bigint").alias(_total(n)) for n in counts])
    return scanned.drop(CHUNK).join(totals, list(groups))


def _below(name: str) -> str:
    return "below" if name == "n" else f"{name}_below"


def _total(name: str) -> str:
    return "total" if name == "n" else f"{name}_total"


def quantile_from_ecdf(p: float, value: str = "value") -> Column:
    """Linear-interpolated percentile as an aggregate over `ecdf` rows of one group."""
    at = (F.col("total") - 1) * F.lit(p)
    lo = F.max(F.when(F.col("below") <= F.floor(at), F.col(value)))
    hi = F.max(F.when(F.col("below") <= F.ceil(at), F.col(value)))
    frac = F.max(at - F.floor(at))
    return lo + (hi - lo) * frac


def percentiles(df: DataFrame, groups: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per group, with no group gathered into one task."""
    table = ecdf(df, groups, value)
    return table.groupBy(*groups).agg(*[quantile_from_ecdf(p, value).alias(n) for n, p in points.items()])


def average_rank(df: DataFrame, groups: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Tie-averaged 1-based rank of every row inside its group."""
    table = ecdf(df, groups, value).withColumn(out, F.col("below") + (F.col("n") + 1) / 2)
    return df.join(table.select(*groups, value, out), [*groups, value], "left")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
