"""Merkle manifest of a table by time-forward processing.

Every node has a label (tree, level, position). Digests travel from children to parents in the order of these labels: the
queue between rounds is a shuffle sorted by label, which spills, and inside a block of 3^HEIGHT neighbouring nodes it is a
heap. A sweep in the reversed order then carries each node's proof, as a suffix, from parents to children down to the leaves.
One round settles HEIGHT levels, so a tree of 17 billion leaves takes four.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echogrid.llm.tables import stored

FANOUT = 3
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a block that leave a task at once, with their proofs.
PART = 1_000
CARRIED = ("subroot", "root")
PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value, so that no two lists of fields read alike."""
    said = value.cast("string")
    return F.when(said.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above `n` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def forward(digests: list[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The node `levels` above these neighbours, and the child digests that each label received, in label order."""
    queue = [(1, i // FANOUT, i % FANOUT, d) for i, d in enumerate(digests)]  # sorted, hence a heap
    received: dict[tuple[int, int], list[str]] = {}
    top = digests[0]
    while levels and queue:
        label, got = queue[0][:2], []
        while queue and queue[0][:2] == label:
            got.append(heappop(queue)[3])
        received[label], top = got, _joined(got)
        if label[0] < levels:
            heappush(queue, (label[0] + 1, label[1] // FANOUT, label[1] % FANOUT, top))
    return top, received


def backward(n: int, levels: int, received: dict[tuple[int, int], list[str]], suffix: tuple | None) -> list[tuple | None]:
    """Proofs of the `n` lowest nodes: linked lists (left siblings, right siblings, proof of the parent)."""
    waiting = {(levels, 0): suffix}
    for (level, at), got in reversed(received.items()):
        above = waiting.pop((level, at))
        for j in range(len(got)):
            waiting[level - 1, at * FANOUT + j] = ("".join(got[:j]), "".join(got[j + 1:]), above)
    return [waiting[0, i] for i in range(n)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (tree, block) at a time from a task's rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = batch.column("tree").to_pylist(), batch.column("block").to_numpy()
        same = np.array([a == b for a, b in zip(tree[1:], tree[:-1], strict=True)], dtype=bool)
        edge = np.concatenate([[0], np.flatnonzero(~same | (block[1:] != block[:-1])) + 1, [len(tree)]]).astype(int)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if held and (tree[a], int(block[a])) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tree[a], int(block[a])
    if held:
        yield pa.Table.from_batches(held)


def _levels(total: int) -> int:
    return min(HEIGHT, levels_of(total))


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []

    def flush() -> pa.RecordBatch:
        tree, at, total, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(at, pa.int64()), pa.array(total, pa.int64()), pa.array(digest, pa.string())], ["tree", "at", "total", "digest"])

    for block in _blocks(batches):
        total, levels = block["total"][0].as_py(), _levels(block["total"][0].as_py())
        top, _ = forward(block["digest"].to_pylist(), levels)
        rows.append((block["tree"][0].as_py(), block["block"][0].as_py(), -(-total // FANOUT**levels), top))
        if len(rows) >= 10_000:
            yield flush()
            rows.clear()
    yield flush()


def _unlinked(path: tuple | None) -> list[dict]:
    out = []
    while path is not None:
        left, right, path = path
        out.append({"left": left, "right": right})
    return out


def _down(kind: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with `proof`, the siblings from their own level up to the root. A block's first row is its parents' message."""
    for block in _blocks(batches):
        message, rows = block.slice(0, 1).to_pylist()[0], block.slice(1)
        suffix = None
        for step in reversed(message["above"]):
            suffix = (step["left"], step["right"], suffix)
        levels = _levels(rows["total"][0].as_py())
        _, received = forward(rows["digest"].to_pylist(), levels)
        proofs = backward(rows.num_rows, levels, received, suffix)
        for part in range(0, rows.num_rows, PART):
            cut = rows.slice(part, PART)
            columns = []
            for f in kind:
                if f.name == "proof":
                    columns.append(pa.array([_unlinked(p) for p in proofs[part:part + PART]], f.type))
                elif f.name in CARRIED:
                    columns.append(pa.array([message[f.name]] * cut.num_rows, f.type))
                else:
                    columns.append(cut[f.name])
            yield from pa.Table.from_arrays(columns, schema=kind).combine_chunks().to_batches()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and the place inside the task's run of a tree to sorted rows."""
    from pyspark import TaskContext

    part, last, n = TaskContext.get().partitionId(), None, -1
    for batch in batches:
        place = []
        for tree in batch.column("tree").to_pylist():
            n = n + 1 if n >= 0 and tree == last else 0
            last = tree
            place.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), pa.array(place, pa.int64())], [*batch.schema.names, "part", "place"])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `at`, the 0-based place of each row inside its `tree` (null is a tree too), and `total`, the tree's rows.

    Rows are range-sorted by tree and order, so a hot tree spreads over tasks, and only one count a task and tree is carried on.
    """
    from pyspark.sql import Window as W

    kind = T.StructType([*df.schema.fields, T.StructField("part", T.LongType()), T.StructField("place", T.LongType())])
    rows = stored(df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).mapInArrow(_placed, kind), name)
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("n"))
    whole = W.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(F.col("tree").alias("__tree"), F.col("part").alias("__part"), F.coalesce(before, F.lit(0)).alias("__before"), F.sum("n").over(whole).alias("total"))
    joined = rows.join(offsets, rows["tree"].eqNullSafe(offsets["__tree"]) & (rows["part"] == offsets["__part"]))
    return joined.withColumn("at", F.col("place") + F.col("__before")).drop("__tree", "__part", "__before", "part", "place")


def _dealt(nodes: DataFrame) -> DataFrame:
    """Blocks of neighbouring nodes, whole and in label order, in one task each."""
    block = F.floor(F.col("at") / FANOUT**HEIGHT).cast("long")
    return nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Node tables (tree, at, total, digest) of every round from the leaves up, and one finished row a tree."""
    rounds, kind = [nodes], "tree string, at long, total long, digest string"
    while (rounds[-1].agg(F.max("total")).first()[0] or 1) > 1:
        rounds.append(stored(_dealt(rounds[-1]).select("tree", "block", "total", "digest").mapInArrow(_up, kind), "nodes"))
    return rounds[:-1], rounds[-1]


def descend(rounds: list[DataFrame], proofs: DataFrame) -> DataFrame:
    """Rows of the lowest round with `proof`; CARRIED columns of the tops' `proofs` (tree, at, proof, ...) go down with it.

    Messages and the rows of their block meet as one sorted run, so no proof is copied in a shuffle.
    """
    carried = [c for c in proofs.columns if c in CARRIED]
    for depth, nodes in enumerate(reversed(rounds)):
        block = F.floor(F.col("at") / FANOUT**HEIGHT).cast("long")
        messages = proofs.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), F.col("proof").alias("above"), *carried)
        met = nodes.withColumn("block", block).unionByName(messages, allowMissingColumns=True)
        met = met.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
        kind = nodes.select("*", *[F.lit("").alias(c) for c in carried], F.lit(None).cast(PATH).alias("proof")).schema
        proofs = met.mapInArrow(partial(_down, _arrow(kind)), kind)
        if depth < len(rounds) - 1:
            proofs = stored(proofs.select("tree", "at", "proof", *carried), "proofs")
    return proofs


def _arrow(kind) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def manifest(docs: DataFrame, claimed: list[Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, claimed, subroot, root and proof (sibling digests left and right, level by level) of every row.

    A leaf is the digest of FIELDS; a source's leaves ascend by doc_id (null first), equal doc_ids by leaf, so repeated rows are
    leaves of their own. `claimed` are the five values that somebody presents for a row, by default its own; their digest is
    kept for `folded`. Null is a source like any other. An empty table gives no rows. Other columns are ignored.
    """
    doc_id = F.col("doc_id").cast("long")
    leaves = docs.select(F.col("source").alias("tree"), doc_id.alias("doc_id"), leaf_digest([F.col(c) for c in FIELDS]).alias("digest"),
                         leaf_digest(claimed or [F.col(c) for c in FIELDS]).alias("claimed"))
    below, subroots = climb(numbered(leaves, ["doc_id", "digest"], "leaves"))
    # one node a source, under one tree
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    above, top = climb(numbered(named, ["source"], "subroots"))
    empty = F.array().cast(PATH)
    if above:
        root = top.select("tree", F.lit(0).cast("long").alias("at"), F.col("digest").alias("root"), empty.alias("proof"))
        nodes = descend(above, root)
    else:
        nodes = top.select("*", F.col("digest").alias("root"), empty.alias("proof"))
    tops = stored(nodes.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("at"), F.col("digest").alias("subroot"), "root", "proof"), "tops")
    if below:
        out = descend(below, tops)
    else:
        met = tops.select(F.col("tree").alias("__tree"), "subroot", "root", "proof")
        out = subroots.join(met, subroots["tree"].eqNullSafe(met["__tree"])).drop("__tree")
    return out.select("doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "claimed", "subroot", "root", "proof")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, folds = [], []
        for claimed, proof in zip(batch.column("claimed").to_pylist(), batch.column("proof").to_pylist(), strict=True):
            digests.append(_joined([s["left"] + s["right"] for s in proof]))
            node = claimed
            for s in proof:
                node = _joined([s["left"], node, s["right"]])
            folds.append(node)
        keep = ["doc_id", "leaf", "subroot", "root"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(digests, pa.string()), pa.array(folds, pa.string())], [*keep, "proof_sha256", "folded_root"])


def folded(proved: DataFrame) -> DataFrame:
    """Refolds every claimed leaf with its proof: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = proved.select("doc_id", "leaf", "claimed", "subroot", "root", "proof").mapInArrow(_fold, kind)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
