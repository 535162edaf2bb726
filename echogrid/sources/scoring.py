"""Caller-supplied functions: scorers, per-recording probes, the feature registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.functions import scalars as fx
from echogrid.operators import signals as g


def score(df: DataFrame, features: str, load: Callable[[], Callable], model_version: str, threshold: float, override: str | None = None) -> DataFrame:
    """Score Arrow batches: `load` runs once per task and returns predict(list of feature arrays) -> probabilities.

    The result carries `proba_fall`, the threshold in force (column `override` wins over the model's) and the version.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for pdf in frames:
            yield pdf.drop(columns=[features]).assign(proba_fall=predict(list(pdf[features])) if len(pdf) else [])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != features)
    out = df.mapInPandas(run, f"{kept}, proba_fall double")
    limit = F.coalesce(F.col(override), F.lit(threshold)) if override else F.lit(threshold)
    return out.withColumns({"threshold": limit, "model_version": F.lit(model_version)})


def linear_scorer(weights: list[float], bias: float) -> Callable[[], Callable]:
    """Built-in scorer: logistic of a weighted sum."""
    def load():
        import numpy as np

        w = np.asarray(weights)
        return lambda rows: 1.0 / (1.0 + np.exp(-(np.stack(rows) @ w + bias)))

    return load


def probe_each(df: DataFrame, probe: Callable[[dict], dict], schema: str, keys: list[str], error_chars: int | None = None) -> DataFrame:
    """Run `probe` on every packed recording row; a failing row yields status `error` and the message, cut only on request."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for record in pdf.to_dict("records"):
                base = {k: record[k] for k in keys}
                try:
                    rows.append({**base, **probe(record), "status": "ok", "error_msg": None})
                except Exception as exc:  # isolate one bad recording from the batch
                    rows.append({**base, **dict.fromkeys(names), "status": "error", "error_msg": f"{type(exc).__name__}: {exc}"[:error_chars]})
            yield pd.DataFrame(rows, columns=[*keys, *names, "status", "error_msg"])

    kept = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.mapInPandas(run, f"{kept}, {schema}, status string, error_msg string")


def gini(values: Column) -> Column:
    return fx.let(F.sort_array(values), lambda v: fx.let(fx.array_sum(v), lambda s: F.when(s > 0, 2 * fx.array_sum(F.transform(v, lambda x, i: (i + 1) * x)) / (F.size(v) * s) - (F.size(v) + 1) / F.size(v))))


def norm_entropy(values: Column) -> Column:
    alive = F.filter(values, lambda v: v > 0)
    return fx.let(alive, lambda v: fx.let(fx.array_sum(v), lambda s: F.when(F.size(v) > 1, -fx.array_sum(F.transform(v, lambda x: x / s * F.ln(x / s))) / F.ln(F.size(v)))))


def q_of(values: Column, half: int) -> Column:
    return fx.let(g.moving_variance_array(F.transform(values, lambda v: F.abs(v)), half), lambda v: fx.let(fx.array_mean(v), lambda m: F.when(m < 1e-10, 0.0).otherwise(F.array_max(v) / m)))


# Feature registry: the same transformer serves batch builds and live scoring.
FEATURES: dict[str, Callable[[Column, float], Column]] = {
    "energy": lambda x, fs: fx.array_dot(x, x),
    "acf": lambda x, fs: g.standard_acf(x, g.acf_lag_count(F.size(x), fs, 0.4005)),
    "gini": lambda x, fs: gini(F.transform(x, lambda v: F.abs(v))),
    "entropy": lambda x, fs: norm_entropy(F.transform(x, lambda v: F.abs(v))),
    "q": lambda x, fs: q_of(x, 4),
}


def extract(df: DataFrame, values: str, fs: float, kind: str) -> DataFrame:
    if kind not in FEATURES:
        raise ValueError(f"unknown feature {kind!r}; one of {sorted(FEATURES)}")
    return df.withColumn(kind, FEATURES[kind](F.col(values), fs))
