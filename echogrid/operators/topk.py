"""Ordering, paging and top-k selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.functions.scalars import stable_order
from echogrid.operators import ordered as o


def ordered_page(df: DataFrame, ts: str, tie: str, limit: int, offset: int, max_limit: int) -> DataFrame:
    """Newest first with the total count beside each row: a partial top-k per task, one small final task.

    A limit above `max_limit` is refused, never shortened.
    """
    if not 0 <= limit <= max_limit:
        raise ValueError(f"limit {limit} is outside 0..{max_limit}")
    page = df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(limit + offset).offset(offset)
    return page.withColumn("total", df.agg(F.count("*").alias("total")).scalar())


def bounded_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 256) -> DataFrame:
    """First n rows per key. Each salt of a key is cut first, so a hot key is small before it meets in one task."""
    first, final = Window.partitionBy(*keys, "__salt").orderBy(*order), Window.partitionBy(*keys).orderBy(*order)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    df = salted.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= n).drop("__salt", "rn")
    return df.withColumn("rn", F.row_number().over(final)).filter(F.col("rn") <= n)


def low_hashes(df: DataFrame, keys: Sequence[str], digest: str, n: int, digits: int = 3) -> DataFrame:
    """Rows that may be among the first n of their key by a hexadecimal digest; keys are few.

    Rows are counted by key and leading digits, and those behind the digits at which a key reaches n are dropped. A key with
    fewer rows keeps all.
    """
    lead = F.substring(digest, 1, digits)
    counts = df.groupBy(*keys, lead.alias("__lead")).agg(F.count("*").alias("__c"))
    total = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__lead"))  # at most 16 ** digits rows a key
    cuts = counts.withColumn("__t", total).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(F.when(F.col("__t") >= n, F.col("__lead"))).alias("__cut"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(F.broadcast(cuts), same).filter(F.col("__cut").isNull() | (lead <= F.col("__cut"))).select(*df.columns)


def topk_streams(q: DataFrame, keys: Sequence[str], channel: str, k: int, threshold: bool = True, allowed: Sequence[int] | None = None) -> DataFrame:
    """Channels by q descending (ties: lower channel), share of the top-k sum, kept when share >= 1/k else the best one.

    The channel count per key is a hardware constant, so the per-key window is bounded.
    """
    if allowed is not None:
        q = q.filter(F.col(channel).isin(list(allowed)))
    w = Window.partitionBy(*keys)
    ranked = q.withColumn("rank", F.row_number().over(w.orderBy(F.col("q").desc(), F.col(channel)))).filter(F.col("rank") <= k)
    ranked = ranked.withColumn("n_top", F.count("*").over(w)).withColumn("share", F.col("q") / (F.sum("q").over(w) + 1e-10))
    if not threshold:
        return ranked.withColumn("selected", F.lit(True))
    passed = F.col("share") >= 1.0 / F.col("n_top")
    any_passed = F.max(passed.cast("int")).over(w) == 1
    return ranked.withColumn("selected", passed | (~any_passed & (F.col("rank") == 1)))


def argmax_peak(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """First index of the maximum per key, as one combinable aggregate."""
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(index)).alias("i"))).alias("m")).select(
        *keys, (-F.col("m.i")).alias("peak"), F.col("m.v").alias("peak_value"))


def stratified_sample(df: DataFrame, cell: Sequence[str], row_id: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows per cell in hash order (same draw on every run and engine)."""
    return bounded_top(df.withColumn("__h", stable_order(seed, F.col(row_id))), cell, [F.col("__h"), F.col(row_id)], n).drop("__h")


def balanced_sample(df: DataFrame, cell: Sequence[str], subject: str, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows per cell drawn round-robin over subjects, so no subject dominates."""
    hashed = df.withColumns({"__h": stable_order(seed, F.col(row_id)), "__s": stable_order(seed, F.col(subject))})
    deep = bounded_top(hashed, [*cell, subject], [F.col("__h"), F.col(row_id)], n).withColumnRenamed("rn", "depth")
    return bounded_top(deep, cell, [F.col("depth"), F.col("__s"), F.col(subject)], n).drop("__h", "__s")


def even_subsample(df: DataFrame, keys: Sequence[str], order: Sequence[str], m: int) -> DataFrame:
    """At most m evenly spaced rows per series (both ends included)."""
    numbered = o.sorted_chunks(df, keys, order)
    numbered = o.number_rows(numbered, keys, order, "i")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    step = (F.col("__n") - 1) / F.lit(float(max(m - 1, 1)))
    # row i is taken when it is the rounded position of one of the slots next to it
    slot = F.floor(F.col("i") / F.greatest(step, F.lit(1e-12)))
    hits = [F.bround((slot + d) * step).cast("bigint") == F.col("i") for d in (-1, 0, 1)]
    inside = [(slot + d).between(0, m - 1) for d in (-1, 0, 1)]
    taken = (hits[0] & inside[0]) | (hits[1] & inside[1]) | (hits[2] & inside[2])
    return numbered.join(sizes, list(keys)).filter((F.col("__n") <= m) | taken).drop("__n", o.CHUNK)


def leave_one_out(df: DataFrame, group: str, row_id: str, seed: int = 0, share: float = 0.2) -> DataFrame:
    """One fold for each value of `group`, named `fold`: its rows are `test`, all others `train` or, the first in hash order
    of each group, `val`. Ranks are made once and shared by the folds; rows are repeated once a fold, which is the result."""
    numbered = o.number_rows(df.withColumn("__h", stable_order(seed, F.col(row_id))), [group], ["__h", row_id], "rank")
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    folds = df.select(F.col(group).alias("fold")).distinct().agg(F.array_sort(F.collect_set("fold")).alias("folds"))
    part = F.greatest(F.lit(1), F.bround(F.col("n") * share))
    each = numbered.join(sizes, group).withColumn("fold", F.explode(folds.select("folds").scalar()))
    return each.withColumn("split", F.when(F.col(group) == F.col("fold"), "test").when(F.col("rank") < part, "val").otherwise("train")).drop("__h")


def split_assign(df: DataFrame, groups: Sequence[str], row_id: str, role: Column, seed: int = 0, share: float = 0.2) -> DataFrame:
    """Hash-ordered ranks to val / test / train; `external` rows keep their own split, too small groups are marked."""
    marked = df.withColumns({"role": role, "__h": stable_order(seed, F.col(row_id))})
    keys = [*groups, "role"]
    numbered = o.number_rows(marked, keys, ["__h", row_id], "rank")
    sizes = marked.groupBy(*keys).agg(F.count("*").alias("n"))
    part = F.greatest(F.lit(1), F.bround(F.col("n") * share)).cast("int")
    tests = F.when(F.col("role") == "target", part).otherwise(0)
    needed = F.when(F.col("role") == "target", 3).otherwise(2)
    split = (
        F.when(F.col("role") == "external", "external").when(F.col("n") < needed, "too_few")
        .when(F.col("rank") < part, "val").when(F.col("rank") < part + tests, "test").otherwise("train")
    )
    return numbered.join(sizes, keys).withColumn("split", split).drop("__h")
