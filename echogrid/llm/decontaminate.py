"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each task turns its documents into word numbers, keeps the stretches that are long enough and made of benchmark words alone,
and sorts their suffixes. Every benchmark suffix is then binary-searched in the shard's array; its range of equal suffixes
lists all verbatim places, and consecutive places give the longest matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echogrid.llm.tables import pieces, strings
from echogrid.llm.words import ALPHANUMERIC, words

WINDOW = 13
#: A hit share of 1 in SHARE words makes a document contaminated.
SHARE = 20
#: Benchmark text held by a task at once; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 8_000_000
SHARD_WORDS = 400_000
MATCH = "array<struct<item: string, start: long, words: long>>"


class Suffixes:
    """The searchable side of a block of benchmark items: distinct windows as word numbers, and the items of each."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int):
        w = words([r[1] or "" for r in rows], ALPHANUMERIC)
        self.vocabulary = np.unique(w.hashes)
        number = np.searchsorted(self.vocabulary, w.hashes) + 1
        n_windows = np.where(w.counts >= window, w.counts - window + 1, np.minimum(w.counts, 1))
        item = np.repeat(np.arange(len(rows)), n_windows)
        offset = np.cumsum(w.counts) - w.counts
        at = np.arange(len(item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + offset[item]
        length = np.minimum(w.counts, window)[item]
        grid = np.zeros((len(item), window), dtype=np.int64)
        for j in range(window):
            has = length > j
            grid[has, j] = number[at[has] + j]
        self.windows, back = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
        pair = np.unique(np.stack([back.reshape(-1), item], axis=1), axis=0) if len(grid) else np.zeros((0, 2), np.int64)
        self.lengths = (self.windows > 0).sum(axis=1)
        self.item_of = pair[:, 1]
        self.item_first = np.searchsorted(pair[:, 0], np.arange(len(self.windows) + 1))
        self.names = [r[0] for r in rows]
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `text` ordered by their next `depth` numbers at least, by prefix doubling."""
    rank, reach = text.astype(np.int64), 1
    while reach < depth:
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-reach] = rank[reach:] + 1 if reach < len(rank) else 0
        rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1].reshape(-1)
        reach *= 2
    return np.argsort(rank, kind="stable")


def search(text: np.ndarray, order: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range [low, high) of `order` whose suffixes start with each window."""
    depth = windows.shape[1]
    padded = np.concatenate([text, np.zeros(depth, dtype=text.dtype)])

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            at, less, equal = order[middle], np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for j in range(depth):
                need = equal & (lengths[open_] > j)
                if not need.any():
                    break
                have = padded[at + j]
                less |= need & (have < windows[open_, j])
                equal &= ~need | (have == windows[open_, j])
            right = less | equal if upper else less
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low

    return bound(False), bound(True)


class _Shard:
    """Documents of a task and the stretches of their words that can hold a window."""

    def __init__(self):
        self.rows, self.counts, self.text, self.doc, self.at, self.size = [], [], [], [], [], 0

    def add(self, piece: pa.RecordBatch, w, number: np.ndarray, shortest: int) -> None:
        base = sum(r.num_rows for r in self.rows)
        self.rows.append(piece)
        self.counts.append(w.counts)
        owner = w.owner
        known = number > 0
        edge = np.ones(len(known) + 1, dtype=bool)
        edge[1:-1] = (known[1:] != known[:-1]) | (owner[1:] != owner[:-1])
        border = np.flatnonzero(edge)
        begin, end = border[:-1], border[1:]
        use = known[begin] & (end - begin >= max(shortest, 1)) if len(known) else np.zeros(0, bool)
        begin, end = begin[use], end[use]
        size = end - begin + 1  # a stretch and its closing zero
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        last = np.repeat(end, size) == at
        at = np.minimum(at, max(len(number) - 1, 0))
        first = np.cumsum(w.counts) - w.counts
        self.text.append(np.where(last, 0, number[at]) if len(at) else np.zeros(0, np.int64))
        self.doc.append(owner[at] + base)
        self.at.append(at - first[owner[at]])
        self.size += len(number)

    def found(self, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word position, window number) of every occurrence."""
        text, doc, at = (np.concatenate(x) for x in (self.text, self.doc, self.at))
        if not len(text):
            return doc, at, doc
        order = suffix_array(text, suffixes.windows.shape[1])
        low, high = search(text, order, suffixes.windows, suffixes.lengths)
        n = high - low
        window = np.repeat(np.arange(len(n)), n)
        place = order[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        return doc[place], at[place], window


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = start[1:] > end[:-1]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)
    return start[fresh], end[last]


def _matches(at: np.ndarray, window: np.ndarray, suffixes: Suffixes) -> list[dict]:
    """Longest matches of one document: for each item the longest stretches whose windows all occur in the item."""
    n = suffixes.item_first[window + 1] - suffixes.item_first[window]
    item = suffixes.item_of[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(suffixes.item_first[window], n)]
    start, length = np.repeat(at, n), np.repeat(suffixes.lengths[window], n)
    order = np.lexsort((start, item))
    item, start, length = item[order], start[order], length[order]
    fresh = np.ones(len(item), dtype=bool)
    fresh[1:] = (item[1:] != item[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:] - 1, len(item) - 1)
    return [{"item": suffixes.names[item[a]], "start": int(start[a]), "words": int(start[b] + length[b] - start[a])} for a, b in zip(first, last, strict=True)]


def _scan(block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    suffixes: Suffixes = block.value

    def flush(shard: _Shard) -> Iterator[pa.RecordBatch]:
        doc, at, window = shard.found(suffixes)
        order = np.argsort(doc, kind="stable")
        doc, at, window = doc[order], at[order], window[order]
        base = 0
        for piece, counts in zip(shard.rows, shard.counts, strict=True):
            bounds = np.searchsorted(doc, np.arange(base, base + piece.num_rows + 1))
            spans, matches = piece.column("spans").to_pylist(), piece.column("matches").to_pylist()
            for k in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[k], bounds[k + 1]
                old = spans[k]
                start = np.concatenate([at[a:b], [s["start"] for s in old]]).astype(np.int64)
                end = np.concatenate([at[a:b] + suffixes.lengths[window[a:b]], [s["end"] for s in old]]).astype(np.int64)
                spans[k] = [{"start": int(x), "end": int(y)} for x, y in zip(*_merge(start, end), strict=True)]
                matches[k] = matches[k] + _matches(at[a:b], window[a:b], suffixes)
            base += piece.num_rows
            yield pa.RecordBatch.from_arrays(
                [piece.column("row"), pa.array(counts, pa.int64()), pa.array(spans, piece.schema.field("spans").type), pa.array(matches, piece.schema.field("matches").type)],
                ["row", "n_words", "spans", "matches"])

    shard = _Shard()
    # the text lies inside the row, so a whole row passes through unchanged
    flat = (pa.RecordBatch.from_arrays([b.column(n) for n in range(b.num_columns)] + [b.column("row").field("text")], [*b.schema.names, "text"]) for b in batches)
    for piece in pieces(flat, "text"):
        w = words(strings(piece, "text"), ALPHANUMERIC)
        place = np.searchsorted(suffixes.vocabulary, w.hashes)
        known = place < len(suffixes.vocabulary)
        known[known] = suffixes.vocabulary[place[known]] == w.hashes[known]
        shard.add(piece, w, np.where(known, place + 1, 0), suffixes.shortest)
        if shard.size >= SHARD_WORDS:
            yield from flush(shard)
            shard = _Shard()
    if shard.rows:
        yield from flush(shard)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of `docs` as `row`, with n_words, hit `spans` (word start, end exclusive; disjoint) and `matches` per item.

    The benchmark is cut by hash into blocks of about BLOCK_BYTES, each sent to the tasks once; all blocks run in one stage.
    An item of fewer words than `window`, but one, is one window. Items without words match nothing. Items with a null id hit,
    but have no name to list. Repeated items count once by id. Null texts have no words.
    """
    spark = docs.sparkSession
    volume = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(volume // BLOCK_BYTES) + 1
    out = docs.select(F.struct("*").alias("row"), F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<struct<start: long, end: long>>").alias("spans"), F.array().cast(MATCH).alias("matches"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        block = spark.sparkContext.broadcast(Suffixes([tuple(r) for r in rows], window))
        out = out.mapInArrow(partial(_scan, block), T.StructType([*out.schema.fields]))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and longest (match in words, 0 if none) for every row."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda x: x.isNotNull())))
    return scan(docs.select("doc_id", "text"), benchmark, window).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).alias("longest"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return scan(docs, benchmark, window).where(~((n_hit > 0) & (share * n_hit >= F.col("n_words")))).select("row.*")
