"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles. Shingles have one global order: rare before frequent, ties by hash. A
shingle belongs to a class; a class asks for k shared shingles (k grows with the frequency), and classes of frequent shingles
are cut by hash into groups so that the number of combinations stays in proportion to the text. A set of n shingles can miss
at most r = n - ceil(t*n) of them in any partner, so its prefix is extended until it holds r + 1 units, where the k-th and every
later member of a class count one unit. Two linked sets then share a k-combination of one class: otherwise the set whose
prefix ends first would miss more than r of its own shingles. Combinations are the join keys; candidates are verified.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.components import components
from echogrid.llm.tables import BATCH_BYTES, bounded, long_list, pieces, stored, strings
from echogrid.llm.words import mix, shingles, words

WORDS_PER_SHINGLE = 3
PERCENT = 90
#: Frequency tiers: from this many documents on, a class asks for so many shared shingles.
TIERS = ((1, 1), (32, 2), (1024, 3))
#: At most so many frequent shingles are told apart by frequency; all others rank as rare. Only speed depends on it.
FREQUENT_LIMIT = 1 << 20
SLOTS = 1 << 24
#: Hashes that a task holds while it counts.
COUNTED = 2_000_000
BAND_BASE = 4  # the lowest frequency band kept: 2**4 documents
#: Members of a bucket that are compared with as many others in one task.
BLOCK = 1_000
STAR_ROUNDS = 2
#: 64-bit words of a set's parity sketch; sets of at least LONG_SET shingles carry a wide one as well.
SKETCH, WIDE_SKETCH, LONG_SET = 16, 512, 2048
COUNT_BITS = np.uint64(16)  # counting uses the upper 48 bits of a hash


# -- document frequencies ------------------------------------------------------------------------------------------------

def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array begins."""
    fresh = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    return np.flatnonzero(fresh)


def _count_rows(cells: int, hashes: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Gaps and counts of the distinct values, by cell. `hashes` is sorted in place: np.unique would hold several copies."""
    hashes >>= COUNT_BITS
    hashes.sort()
    first = _firsts(hashes)
    value, count = hashes[first], np.diff(first, append=len(hashes)).astype(np.uint32)
    del first
    cell = ((value >> np.uint64(16)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(cell, prepend=-1, append=cells + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        gaps = np.diff(value[a:b], prepend=np.uint64(0))
        yield int(cell[a]), zlib.compress(gaps.tobytes(), 1), zlib.compress(count[a:b].tobytes(), 1)


def _counts(cells: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        hashes = np.concatenate(held) if size else np.zeros(0, np.uint64)
        held.clear()
        rows = list(_count_rows(cells, hashes)) if size else []
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["cell", "gaps", "counts"])

    for piece in pieces(batches, "text"):
        held.append(shingles(words(strings(piece, "text")), k)[1])
        size += len(held[-1])
        if size > COUNTED:
            yield flush()
            size = 0
    yield flush()


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the rows of each cell (they arrive sorted by cell) and keep the frequent hashes with their band."""
    def done(value, count):
        keep = count >= 1 << BAND_BASE
        band = np.log2(count[keep]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(band)], ["hash", "band"])

    current, values, counts = None, [], []

    def merge():
        value, count = np.concatenate(values), np.concatenate(counts)
        values.clear()
        counts.clear()
        order = np.argsort(value)
        value, count = value[order], count[order]
        del order
        first = _firsts(value)
        return value[first], np.add.reduceat(count, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)

    for batch in batches:
        for cell, gaps, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if cell != current and values:
                yield done(*merge())
            current = cell
            values.append(np.cumsum(np.frombuffer(zlib.decompress(gaps), np.uint64)))
            counts.append(np.frombuffer(zlib.decompress(count), np.uint32))
            if sum(map(len, values)) > 8_000_000:
                value, total = merge()
                values.append(value)
                counts.append(total)
    if values:
        yield done(*merge())


def frequency_bands(docs: DataFrame, k: int) -> np.ndarray:
    """Byte table of frequency bands (0: rare), looked up at two slots of a hash; a function of the hash alone.

    Counts cover all documents. The lowest band kept is the first that leaves at most FREQUENT_LIMIT shingles, so what is sent
    to the driver and back has a fixed bound.
    """
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = int(max(64, volume >> 24))
    counted = docs.select("text").mapInArrow(partial(_counts, cells, k), "cell long, gaps binary, counts binary")
    frequent = stored(counted.repartition("cell").sortWithinPartitions("cell").mapInArrow(_frequent, "hash long, band int"), "bands")
    sizes = {r["band"]: r["count"] for r in frequent.groupBy("band").count().collect()}
    lowest, total = 65, 0
    for band in sorted(sizes, reverse=True):
        total += sizes[band]
        if total > FREQUENT_LIMIT:
            break
        lowest = band
    found = frequent.where(F.col("band") >= lowest).toPandas()
    table = np.zeros(SLOTS, dtype=np.uint8)
    value = found["hash"].to_numpy(np.int64).view(np.uint64)
    for slot in _slots(value):
        np.maximum.at(table, slot, found["band"].to_numpy(np.uint8))
    return table


def _slots(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix(value + np.uint64(77))
    mask = np.uint64(SLOTS - 1)
    return (mixed & mask).astype(np.int64), (mixed >> np.uint64(32) & mask).astype(np.int64)


# -- signatures ----------------------------------------------------------------------------------------------------------

def _rank_in(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by `keys` (last is the main one) and rank, from 0, inside runs of equal values of all keys but the first."""
    order = np.lexsort(keys)
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = False
    for key in keys[1:]:
        fresh[1:] |= key[order][1:] != key[order][:-1]
    at = np.arange(len(order))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return order, rank


def signatures(owner: np.ndarray, value: np.ndarray, sizes: np.ndarray, level: np.ndarray, table: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, combination hash) pairs and, per text, the number of rare shingles.

    `owner` and `value` list the distinct shingles of texts 0..len(sizes)-1; texts of one `level` share their classes.
    """
    first, second = _slots(value >> COUNT_BITS)
    band = np.minimum(table[first], table[second]).astype(np.int64)
    k = np.ones(len(value), dtype=np.int64)
    tier = np.zeros(len(value), dtype=np.int64)
    for n, (least, need) in enumerate(TIERS):
        if least > 1:
            hit = band >= int(np.log2(least))
            k[hit], tier[hit] = need, n
    groups = np.maximum(1, ((1 << level) * (100 - percent)) // 300)[owner]
    group = np.where(tier > 0, (mix(value + np.uint64(5)) >> np.uint64(33)).astype(np.int64) % groups, 0)
    rare = np.bincount(owner[tier == 0], minlength=len(sizes))
    cls = tier * (1 << 32) + group
    order, _ = _rank_in(value, band, owner)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    _, rank = _rank_in(place, cls, owner)
    unit = (rank >= k - 1)[order].astype(np.int64)
    own = owner[order]
    before = np.cumsum(unit) - unit
    start = np.searchsorted(own, np.arange(len(sizes)))
    start = np.minimum(start, max(len(own) - 1, 0))
    before = before - before[start][own] if len(own) else before
    slack = sizes - (sizes * percent + 99) // 100
    kept = order[before <= slack[own]]
    # members of one class of one text, in the global order
    kept = kept[np.lexsort((place[kept], cls[kept], owner[kept]))]
    run = np.ones(len(kept), dtype=bool)
    run[1:] = (owner[kept][1:] != owner[kept][:-1]) | (cls[kept][1:] != cls[kept][:-1])
    run_id = np.cumsum(run) - 1
    run_end = np.append(np.flatnonzero(run), len(kept))[1:][run_id] if len(kept) else np.zeros(0, np.int64)
    texts, sigs = [], []
    for need in sorted({t[1] for t in TIERS}):
        last = np.flatnonzero(k[kept] == need)
        sig = mix(value[kept][last] + level[owner[kept][last]].astype(np.uint64) + np.uint64(need << 8))
        for _ in range(need - 1):
            more = run_end[last] - last - 1
            head = np.repeat(last, more)
            sig = np.repeat(sig, more)
            last = head + 1 + np.arange(len(head)) - np.repeat(np.cumsum(more) - more, more)
            sig = mix(sig + value[kept][last])
        texts.append(owner[kept][last])
        sigs.append(sig)
    return np.concatenate(texts), np.concatenate(sigs), rare


def _parity(owner: np.ndarray, value: np.ndarray, n: int, words_: int) -> np.ndarray:
    """Bit maps of `64 * words_` bits per text; a shingle flips one bit, so two maps differ in at most as many bits as the sets in shingles."""
    bit = (mix(value + np.uint64(9)) >> np.uint64(20)) % np.uint64(64 * words_)
    odd = np.bincount(owner * (64 * words_) + bit.astype(np.int64), minlength=n * 64 * words_) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, 64 * words_), axis=1).view(np.int64).reshape(-1)


def _sign(k: int, percent: int, table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = table.value
    for piece in pieces(batches, "text", BATCH_BYTES // 2):
        owner, value = shingles(words(strings(piece, "text")), k)
        n = piece.num_rows
        sizes = np.bincount(owner, minlength=n).astype(np.int64)
        bounds = np.searchsorted(owner, np.arange(n + 1))
        digest = [hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        level = np.frexp(np.maximum(sizes, 1))[1].astype(np.int64) - 1
        smaller = np.frexp(np.maximum((sizes * percent + 99) // 100, 1))[1].astype(np.int64) - 1
        # a set that can only be linked with its equal needs no signature
        able = (sizes + 1) * percent <= 100 * sizes
        able |= sizes - (sizes * percent + 99) // 100 >= 1
        own, sig, rare = _signed(owner, value, sizes, able, level, bands, percent)
        own2, sig2, _ = _signed(owner, value, sizes, able & (smaller != level), smaller, bands, percent)
        own, sig = np.concatenate([own, own2]), np.concatenate([sig, sig2])
        order = np.lexsort((sig, own))
        own, sig = own[order], sig[order]
        long = np.flatnonzero(sizes >= LONG_SET)
        renamed = np.full(n, -1)
        renamed[long] = np.arange(len(long))
        far = renamed[owner] >= 0
        wide = _parity(renamed[owner[far]], value[far], len(long), WIDE_SKETCH)
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(sizes), pa.array(digest, pa.binary()), pa.array(rare.astype(np.int64)), long_list(_parity(owner, value, n, SKETCH), np.full(n, SKETCH)),
             long_list(wide, np.where(sizes >= LONG_SET, WIDE_SKETCH, 0)), long_list(sig, np.bincount(own, minlength=n))],
            ["doc_id", "n_shingles", "digest", "n_rare", "sketch", "wide", "sigs"])


def _signed(owner, value, sizes, chosen, level, bands, percent):
    use = chosen[owner]
    return signatures(owner[use], value[use], sizes, level, bands, percent)


# -- verification --------------------------------------------------------------------------------------------------------

def _sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        owner, value = shingles(words(strings(piece, "text")), k)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), long_list(value, np.bincount(owner, minlength=piece.num_rows))], ["node", "grams"])


def _apart(x: str, y: str):
    """Bits in which two parity sketches differ."""
    return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose parity sketches leave the threshold possible; none that meets it is lost."""
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x"), F.col("wide").alias("p"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"), F.col("wide").alias("q"))
    both_wide = (F.size("p") > 0) & (F.size("q") > 0)
    most = (100 - percent) * (F.col("n") + F.col("m"))
    return pairs.join(left, "a").join(right, "b").where(
        ((100 + percent) * _apart("x", "y") <= most) & (~both_wide | ((100 + percent) * _apart("p", "q") <= most))).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) whose shingle sets, read from the texts again, meet the threshold."""
    nodes = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = stored(docs.join(nodes, "doc_id", "left_semi").mapInArrow(partial(_sets, k), "node long, grams array<long>"), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(
        100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def jaccard_components(docs: DataFrame, k: int = WORDS_PER_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text; other columns are ignored).

    Texts link when 100 * |intersection| >= percent * |union| of their k-word shingle sets. Equal sets form one node, named by
    their smallest doc_id, before anything is joined. In each round every combination bucket pairs its members with one leader,
    and members already in the leader's component are left out; what remains between different components of a bucket is then
    compared in full, a large bucket block by block, so no link that changes a component is lost and a group of n near copies
    costs about n comparisons.
    Candidates pass a parity sketch first, which bounds the symmetric difference from below; the rest is verified on whole sets.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that share a doc_id are one node with several
    texts. Rows with a null doc_id cannot name a component: they keep their n_shingles, get a null component_id and link nothing.
    An empty table gives no rows.
    """
    spark = bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = spark.sparkContext.broadcast(frequency_bands(docs, k))
    base = stored(docs.mapInArrow(partial(_sign, k, percent, table), "doc_id long, n_shingles long, digest binary, n_rare long, sketch array<long>, wide array<long>, sigs array<long>"), "signed")
    classes = stored(
        base.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("n_rare", "sketch", "wide", "sigs")]),
        "classes")
    keyed = classes.select("node", "n", "n_rare", F.explode("sigs").alias("sig"))
    full = keyed.groupBy("sig").agg(F.count("*").alias("members")).where("members > 1").select("sig")
    keyed = stored(keyed.join(full, "sig", "left_semi"), "keyed")
    sketches = classes.select("node", "n", "sketch", "wide")
    near = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)

    several = base.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    texts = base.where("n_shingles > 0").select("doc_id", "digest").join(several, "doc_id", "left_semi")
    edges = stored(texts.join(classes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "links")
    open_ = keyed.withColumn("component", F.col("node"))
    for round_ in range(STAR_ROUNDS + 1):
        if round_ < STAR_ROUNDS:
            rank = F.struct("n_rare", "node", "n", "component") if round_ == 0 else F.struct(F.xxhash64(F.lit(round_), "node").alias("n_rare"), "node", "n", "component")
            lead = stored(open_.groupBy("sig").agg(F.min(rank).alias("lead")), "leads")
            met = open_.join(lead, "sig").select("node", "n", "component", F.col("lead.node").alias("b"), F.col("lead.n").alias("m"), F.col("lead.component").alias("other"))
        else:
            # the sketches are compared inside the join, so a large bucket emits only what may link
            # a large bucket is cut into blocks by node, and every two of its blocks meet in a task of their own
            blocks = open_.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
            cut = stored(open_.join(blocks, "sig").join(sketches.select("node", "sketch"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "blocks")
            every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            mate = cut.select("sig", F.col("block").alias("right"), every.alias("left"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("sketch").alias("y"))
            met = cut.withColumnRenamed("block", "left").withColumn("right", every).join(mate, ["sig", "left", "right"]).where((F.col("node") < F.col("b")) & (F.col("component") != F.col("other")) & near & (
                (100 + percent) * _apart("sketch", "y") <= (100 - percent) * (F.col("n") + F.col("m"))))
        pairs = met.where((F.col("component") != F.col("other")) & near).select(
            F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        # repeated doc_ids may repeat a pair, which does no harm; a distinct here would keep a hot leader's join in one task
        found = _verified(stored(_close(pairs, sketches, percent), "pairs"), docs, k, percent)
        edges = stored(edges.unionByName(found), "links")
        named = components(edges)
        if round_ == STAR_ROUNDS:
            break
        named = stored(named, "named")
        labelled = keyed.join(named, "node", "left").select("sig", "node", "n", "n_rare", F.coalesce("component", "node").alias("component"))
        labelled = stored(labelled, "labelled")
        split = labelled.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
        open_ = stored(labelled.join(split, "sig", "left_semi"), "open")
    named = stored(named, "named")
    owners = classes.select("digest", "node").join(named, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    owners = stored(owners, "owners")
    linked = base.select("doc_id", "n_shingles", "digest").join(owners, "digest", "left")
    return linked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
