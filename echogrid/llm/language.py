"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.llm.tables import pieces, stored, strings
from echogrid.llm.words import mix

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every character n-gram of the lower-cased texts; runs of other characters count as one space."""
    clean = [" " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " " for t in texts]
    point = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(clean)), [len(c) for c in clean])
    value, owners, buckets = mix(point + np.uint64(1)), [], []
    rolling = value
    for n in ORDERS:
        if n > 1:
            rolling = mix(rolling[:-1] * np.uint64(31) + value[n - 1:])
        inside = owner[: len(rolling)] == owner[n - 1:]
        owners.append(owner[: len(rolling)][inside])
        buckets.append((rolling[inside] >> np.uint64(17)).astype(np.int64) % BUCKETS)
    return np.concatenate(owners), np.concatenate(buckets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of each language in this task."""
    held: dict[str, np.ndarray] = {}
    for piece in pieces(batches, "text", 500_000):
        langs = piece.column("lang").to_pylist()
        owner, bucket = _grams(strings(piece, "text"))
        names = sorted(set(langs))
        which = np.array([names.index(x) for x in langs], dtype=np.int64)
        counts = np.bincount(which[owner] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
        for k, name in enumerate(names):
            held[name] = held.get(name, 0) + counts[k]
    for name, counts in held.items():
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full), pa.array(counts[full].astype(np.int64))], ["lang", "bucket", "n"])


def _score(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, prior, log_probability = model.value
    for piece in pieces(batches, "text", 500_000):
        texts = strings(piece, "text")
        owner, bucket = _grams(texts)
        cell, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
        who, where = cell // BUCKETS, cell % BUCKETS
        score = np.empty((len(texts), len(names)))
        for k in range(len(names)):
            score[:, k] = prior[k] + np.bincount(who, weights=times * log_probability[k, where], minlength=len(texts))
        lettered = np.array([LETTER.search(t) is not None for t in texts], dtype=bool)
        if len(names):
            best = score.argmax(axis=1)
            share = 1 / np.exp(np.minimum(score - score.max(axis=1, keepdims=True), 0)).sum(axis=1)
        else:
            best, share, lettered = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
        yield pa.RecordBatch.from_arrays([
            piece.column("doc_id"), pa.array([names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], pa.string()),
            pa.array(np.where(lettered, share, 0.0))], ["doc_id", "lang_pred", "score"])


def fit(train: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and log probabilities (language x bucket), from all rows of `train` (text, lang).

    Counts are added up in the tasks and by (language, bucket); the matrix holds BUCKETS values a language. Priors are equal:
    a long text decides by itself, and a short one is not pulled to the commonest language.
    """
    counts = stored(train.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long")
                    .groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    matrix = np.full((len(names), BUCKETS), smoothing)
    found = counts.toPandas()
    if len(found):
        matrix[found["lang"].map({n: k for k, n in enumerate(names)}).to_numpy(), found["bucket"].to_numpy()] += found["n"].to_numpy()
    return names, np.zeros(len(names)), np.log(matrix / matrix.sum(axis=1, keepdims=True))


def identified(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs` (doc_id, text); only the text is looked at.

    Texts without a letter, nulls included, are `und` with score 0, and so is every text when `train` names no language. Of
    equal scores the first language by name wins.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(train))
    return docs.select("doc_id", "text").mapInArrow(partial(_score, model), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """One document in three is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    train = docs.where(~held_out(F.col("doc_id")))
    return identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
