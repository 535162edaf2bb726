"""Ranked lexical search by norm buckets: exact top documents for a stated set of queries.

Every document is a sparse vector of term impacts over the query terms. Vectors are range-sorted by length and cut into
buckets. A bucket whose longest vector cannot reach a query's threshold is passed over by Cauchy-Schwarz. Inside a bucket the
coordinates of the query's strongest terms are added up exactly and the others bounded by the lengths that remain; what may
still reach the threshold is rescored in 64-bit integers. Thresholds are scores of documents already seen, so none is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echogrid.llm.tables import pieces, stored, strings
from echogrid.llm.words import ALPHANUMERIC, words

TOP = 10
#: Query text held by a task at once; more queries are ranked in several blocks.
BLOCK_BYTES = 2_000_000
#: Strongest terms of a query whose coordinates are added up before anything is bounded.
FOCUS = 12
#: Cells of the dense impact table of one bucket (documents x query terms).
CELLS = 1 << 21
BUCKET = 512
#: Documents of the longest vectors, scored first for thresholds to start from.
LEAD = 4096
#: Groups of tasks whose findings for an item are cut before they meet.
PARTS = 32
#: Bounds are in floating point; this share more than covers their rounding.
SLACK = 1 + 1e-9
# Fixed values of the score.
WEIGHT_SCALE, IMPACT_SCALE = 1000, 1_000_000_000
FLAT_PERCENT = 75
VECTOR = "doc_id long, n long, terms array<int>, tf array<int>"


class Statistics(NamedTuple):
    """Documents with a term, all their terms, and the documents of each query term."""

    documents: int
    terms: int
    holding: np.ndarray


class Queries(NamedTuple):
    """A block of items over a sorted vocabulary of word hashes; entries by item: term number and repeats."""

    ids: list
    vocabulary: np.ndarray
    first: np.ndarray
    term: np.ndarray
    repeats: np.ndarray


class Weighted(NamedTuple):
    """Queries as integer vectors, and what the bounds need of them."""

    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    length: np.ndarray
    rest: np.ndarray
    posting_first: np.ndarray
    posting_item: np.ndarray
    posting_weight: np.ndarray


def term_weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Integer impact of each entry: `tf` occurrences in a document of `n` terms."""
    m = 100 - FLAT_PERCENT + (FLAT_PERCENT * n * documents) // max(terms, 1)
    return (IMPACT_SCALE * tf) // (1000 * tf + 8 * m)


def read_queries(rows: list[tuple]) -> Queries:
    """Rows with one id are one item; rows that repeat a text under it add nothing. Items without terms stay empty."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0], r[1] or ""))
    w = words([r[1] or "" for r in rows], ALPHANUMERIC)
    ids = list(dict.fromkeys(r[0] for r in rows))
    number = {x: k for k, x in enumerate(ids)}
    vocabulary, term = np.unique(w.hashes, return_inverse=True)
    item = np.array([number[r[0]] for r in rows], dtype=np.int64)[w.owner] if rows else np.zeros(0, np.int64)
    key, repeats = np.unique(item * max(len(vocabulary), 1) + term, return_counts=True)
    item, term = key // max(len(vocabulary), 1), key % max(len(vocabulary), 1)
    return Queries(ids, vocabulary, np.searchsorted(item, np.arange(len(ids) + 1)), term, repeats.astype(np.int64))


def weigh(queries: Queries, stats: Statistics, focus: int = FOCUS) -> Weighted:
    each = np.array([term_weight(stats.documents, int(h)) for h in stats.holding], dtype=np.int64)
    weight = each[queries.term] * queries.repeats
    square = weight.astype(float) ** 2
    item = np.repeat(np.arange(len(queries.ids)), np.diff(queries.first))
    order = np.lexsort((-weight, item))
    strong = np.zeros(len(weight), dtype=bool)
    strong[order] = np.arange(len(weight)) - queries.first[item[order]] < focus
    total = np.bincount(item, square, len(queries.ids))
    rest = np.bincount(item[~strong], square[~strong], len(queries.ids))
    by_term = np.flatnonzero(strong)[np.argsort(queries.term[strong], kind="stable")]
    return Weighted(queries.first, queries.term, weight, np.sqrt(total), np.sqrt(rest),
                    np.searchsorted(queries.term[by_term], np.arange(len(queries.vocabulary) + 1)), item[by_term], weight[by_term].astype(float))


def _vectors(block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, number of terms, and the query terms of each document that has terms."""
    vocabulary: np.ndarray = block.value.vocabulary
    size = max(len(vocabulary), 1)
    for piece in pieces(batches, "text"):
        w = words(strings(piece, "text"), ALPHANUMERIC)
        at = np.searchsorted(vocabulary, w.hashes)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == w.hashes[known]
        key, tf = np.unique(w.owner[known] * size + at[known], return_counts=True)
        some = w.counts > 0
        offsets = np.searchsorted(key // size, np.append(np.flatnonzero(some), len(some))).astype(np.int32)
        column = lambda v: pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id").filter(pa.array(some)), pa.array(w.counts[some].astype(np.int64)), column(key % size), column(tf)], ["doc_id", "n", "terms", "tf"])


def _holding(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each query term in a task; term -1 counts documents, -2 their terms."""
    total, documents, terms = np.zeros(size, dtype=np.int64), 0, 0
    for batch in batches:
        total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        documents += batch.num_rows
        terms += int(batch.column("n").to_numpy().sum())
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2]).astype(np.int64)), pa.array(np.append(total[seen], [documents, terms]))], ["term", "n"])


def _lengths(stats: Statistics, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("terms")
        counts = np.diff(column.offsets.to_numpy())
        n = np.repeat(batch.column("n").to_numpy(), counts)
        impact = impacts(batch.column("tf").flatten().to_numpy().astype(np.int64), n, stats.documents, stats.terms).astype(float)
        owner = np.repeat(np.arange(batch.num_rows), counts)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(np.bincount(owner, impact**2, batch.num_rows)))], [*batch.schema.names, "length"])


class Board:
    """Best documents of every item so far: score, then smallest doc_id (null last)."""

    def __init__(self, thresholds: np.ndarray, top: int):
        self.top, self.least = top, thresholds
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in thresholds]

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        fresh = [(-int(s), d is None, d or 0) for s, d in zip(scores, ids, strict=True)]
        self.rows[item] = sorted(self.rows[item] + fresh)[:self.top]
        if len(self.rows[item]) == self.top:
            self.least[item] = max(self.least[item], -self.rows[item][-1][0])


def search_bucket(q: Weighted, board: Board, ids: list, length: np.ndarray, first: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int) -> tuple[int, int]:
    """Puts the bucket's documents on the board; returns how many (document, item) pairs were bounded and how many rescored."""
    open_ = np.flatnonzero((q.length * length.max() * SLACK >= board.least) & (q.length > 0))
    if not len(open_):
        return 0, 0
    # strongest coordinates: exact partial products and squared lengths by (document, item)
    n_items, owner = len(q.length), np.repeat(np.arange(len(ids)), np.diff(first))
    reach = q.posting_first[term + 1] - q.posting_first[term]
    entry = np.repeat(np.arange(len(term)), reach)
    posting = np.arange(len(entry)) - np.repeat(np.cumsum(reach) - reach, reach) + q.posting_first[term[entry]]
    cell = owner[entry] * n_items + q.posting_item[posting]
    value = impact[entry].astype(float)
    part = np.bincount(cell, value * q.posting_weight[posting], len(ids) * n_items).reshape(len(ids), n_items)[:, open_]
    taken = np.bincount(cell, value * value, len(ids) * n_items).reshape(len(ids), n_items)[:, open_]
    left = np.sqrt(np.maximum((length * length)[:, None] * SLACK - taken, 0))
    alive = (part + left * q.rest[open_]) * SLACK >= board.least[open_]
    dense = np.zeros((len(ids), size), dtype=np.int64)
    dense[owner, term] = impact
    rescored = 0
    for k in np.flatnonzero(alive.any(axis=0)):
        item = int(open_[k])
        rows = np.flatnonzero(alive[:, k])
        a, b = q.first[item], q.first[item + 1]
        scores = dense[np.ix_(rows, q.term[a:b])] @ q.weight[a:b]
        rescored += len(rows)
        good = (scores > 0) & (scores >= board.least[item])
        if good.any():
            board.add(item, scores[good], [ids[r] for r in rows[good]])
    return alive.size, rescored


def _search(block, stats: Statistics, seeds, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    queries: Queries = block.value
    q = weigh(queries, stats)
    size = max(len(queries.vocabulary), 1)
    board = Board(np.zeros(len(queries.ids)) if seeds is None else seeds.value.copy(), top)
    rows = max(1, min(BUCKET, CELLS // size))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            cut = batch.slice(start, rows)
            column = cut.column("terms")
            offsets = column.offsets.to_numpy().astype(np.int64)
            counts = np.diff(offsets)
            tf = cut.column("tf").flatten().to_numpy().astype(np.int64)
            impact = impacts(tf, np.repeat(cut.column("n").to_numpy(), counts), stats.documents, stats.terms)
            search_bucket(q, board, cut.column("doc_id").to_pylist(), cut.column("length").to_numpy(), offsets - offsets[0], column.flatten().to_numpy().astype(np.int64), impact, size)
    found = [(item, None if null else d, -s) for item, best in enumerate(board.rows) for s, null, d in best]
    item, doc, score = zip(*found, strict=True) if found else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])


def _block_ranking(docs: DataFrame, rows: list[tuple], top: int) -> DataFrame:
    spark = docs.sparkSession
    queries = read_queries(rows)
    block = spark.sparkContext.broadcast(queries)
    size = max(len(queries.vocabulary), 1)
    vectors = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_vectors, block), VECTOR), "vectors")
    counted = vectors.mapInArrow(partial(_holding, size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = {r["term"]: r["n"] for r in counted}
    stats = Statistics(total.get(-1, 0), total.get(-2, 0), np.array([total.get(t, 0) for t in range(len(queries.vocabulary))], dtype=np.int64))
    measured = vectors.mapInArrow(partial(_lengths, stats), VECTOR + ", length double").where("length > 0")
    found = "item long, doc_id long, score long"
    lead = measured.orderBy(F.desc("length")).limit(LEAD).mapInArrow(partial(_search, block, stats, None, top), found)
    least = np.zeros(len(queries.ids))
    for r in lead.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():
        least[r["item"]] = r["least"] if r["n"] >= top else 0
    seeds = spark.sparkContext.broadcast(least)
    # equal lengths, as of copies, are told apart by row, so they spread
    salted = measured.withColumn("salt", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    sorted_ = salted.repartitionByRange(F.desc("length"), "salt").sortWithinPartitions(F.desc("length"), "salt").drop("salt")
    best = sorted_.mapInArrow(partial(_search, block, stats, seeds, top), found)
    # cut by item and group of tasks before an item's rows meet
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = best.withColumn("part", F.spark_partition_id() % PARTS).withColumn("rank", rank("item", "part")).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, x) for k, x in enumerate(queries.ids)], "item long, item_id long")
    return best.withColumn("rank", rank("item")).where(F.col("rank") <= top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` documents of highest score above 0, equal scores by doc_id (null last).

    All rows of `docs` are ranked, repeated rows and null doc_ids as rows of their own; null and empty texts have no terms and
    count nowhere. Items are read in blocks of about BLOCK_BYTES by hash of their id, each block one pass over the documents.
    Rows of one item_id are one item with the terms of all its distinct texts; a null id is an id. Items without known terms,
    and empty tables, give no rows.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    volume = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(volume // BLOCK_BYTES) + 1
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        part = _block_ranking(docs, rows, top)
        out = part if out is None else out.unionByName(part)
    return out
