"""Packing documents into fixed sequences as a cutting-stock problem, solved by column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from echogrid.llm.tables import pieces, stored, strings
from echogrid.llm.tokens import Encoder

SEQUENCE = 2048
END_ID = 1
#: Lengths are rounded up to this grain in the linear program only; sequences hold the true lengths.
GRAIN = 8
RANK_BLOCK = 200_000


def _cut(path: str, fast_path: str | None, sequence: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path, fast_path)
    for piece in pieces(batches, "text"):
        rows = [], [], [], [], []
        for doc_id, text in zip(piece.column("doc_id").to_pylist(), strings(piece, "text"), strict=True):
            ids = np.append(np.asarray(encoder.ids(text), dtype="<u4"), np.uint32(END_ID))
            for start in range(0, len(ids), sequence):
                part = ids[start:start + sequence]
                for column, value in zip(rows, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of an unbounded knapsack and the copies of each item, by dynamic programming over the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = size <= c
        gain = np.where(fits, best[np.maximum(c - size, 0)] + value, -1.0)
        k = int(gain.argmax())
        best[c], choice[c] = (gain[k], k) if gain[k] > best[c - 1] else (best[c - 1], -1)
    copies, c = np.zeros(len(size), dtype=np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            copies[choice[c]] += 1
            c -= int(size[choice[c]])
    return float(best[capacity]), copies


def cutting_stock(sizes: list[int], demand: list[int], capacity: int, rounds: int = 5000) -> list[tuple[dict[int, int], int]]:
    """(pattern: copies by size, times used) covering the demand exactly.

    Linear program by the revised simplex method: the basis starts with one-size patterns, the knapsack over the duals prices
    the entering pattern, and the last basis is rounded down. What rounding leaves, fewer pieces than the basis patterns hold,
    is packed best-fit by falling size. `rounds` bounds the pivots; fewer pivots cost padding, never pieces.
    """
    size, need = np.array(sizes, dtype=np.int64), np.array(demand, dtype=np.float64)
    if not len(size):
        return []
    basis = np.diag(capacity // size).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ need
    for _ in range(rounds):
        best, column = knapsack(np.maximum(inverse.sum(axis=0), 0), size, capacity)
        if best <= 1 + 1e-7:
            break
        u = inverse @ column
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * u, 0)
        x[out] = step
        row = inverse[out] / u[out]
        inverse = inverse - np.outer(u, row)
        inverse[out] = row
        basis[:, out] = column
    columns = basis.round().astype(np.int64)
    times = np.floor(x + 1e-6).astype(np.int64)
    left = np.array(demand, dtype=np.int64) - columns @ times
    while (left < 0).any():  # guards the rounding of x: use one pattern less wherever a size is overfull
        times[np.flatnonzero((columns[left < 0] > 0).any(axis=0) & (times > 0))] -= 1
        left = np.array(demand, dtype=np.int64) - columns @ times
    used = [({int(size[k]): int(n) for k, n in enumerate(columns[:, p]) if n}, int(t)) for p, t in enumerate(times) if t]
    bins: list[tuple[int, dict[int, int]]] = []
    for k in np.argsort(-size):
        for _ in range(int(left[k])):
            fit = [(room, n) for n, (room, _) in enumerate(bins) if room >= size[k]]
            n = min(fit)[1] if fit else len(bins)
            room, held = bins[n] if fit else (capacity, {})
            held[int(size[k])] = held.get(int(size[k]), 0) + 1
            entry = (room - int(size[k]), held)
            bins[n:n + 1] = [entry]
    return used + [(held, 1) for _, held in bins]


def pack(docs: DataFrame, tokenizer: str, fast_tokenizer: str | None = None, sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and a closing END_ID; it is cut every `sequence` ids, so only its last piece is shorter. The histogram
    of piece lengths (at most sequence / grain classes) is all that reaches the driver. Pieces are ranked inside their class
    over hash blocks, so a class with most pieces is counted in many tasks, and a rank finds its pattern, copy and place in a
    table of a few entries per pattern. Null texts are empty and give one piece of one id; repeated rows and null doc_ids are
    packed like others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_cut, tokenizer, fast_tokenizer, sequence), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    cut = cut.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {r["class"]: r["count"] for r in cut.groupBy("class").count().collect()}
    sizes = sorted(histogram)
    patterns = cutting_stock(sizes, [histogram[s] for s in sizes], -(-sequence // grain))
    entries, first_sequence, first_rank = [], 0, dict.fromkeys(sizes, 0)
    for pattern, times in patterns:
        for place, (size, copies) in enumerate(sorted(pattern.items(), reverse=True)):
            entries.append((size, first_rank[size], first_rank[size] + copies * times, copies, first_sequence, place))
            first_rank[size] += copies * times
        first_sequence += times
    plan = spark.createDataFrame(entries, "class int, low long, high long, copies long, first long, place int")
    blocks = F.lit(sum(histogram.values()) // RANK_BLOCK + 16)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), blocks))
    before = cut.groupBy("class", "block").count().withColumn(
        "before", F.sum("count").over(W.partitionBy("class").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    before = stored(before.select("class", "block", F.coalesce("before", F.lit(0)).alias("before")), "ranks")
    within = F.row_number().over(W.partitionBy("class", "block").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = cut.withColumn("within", within).join(before, ["class", "block"]).withColumn("rank", F.col("within") - 1 + F.col("before"))
    # bounded: at most one pattern per class and one per piece that rounding leaves
    placed = ranked.join(F.broadcast(plan), "class").where("rank >= low and rank < high").withColumn(
        "sequence_id", F.expr("first + (rank - low) div copies")).withColumn("copy", F.expr("(rank - low) % copies"))
    fill = W.partitionBy("sequence_id").orderBy("place", "copy").rowsBetween(W.unboundedPreceding, 0)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(fill) - F.col("length")).alias("offset"))
