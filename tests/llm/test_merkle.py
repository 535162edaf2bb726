"""The manifest against a plain recursion: nulls, ties, repeated rows, trees of several rounds, empty tables, clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from echogrid.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree long, at long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    said = [None if v is None else str(v) for v in (row[0], row[3], row[2], row[4], row[1])]
    return digest(*["-" if v is None else f"{len(v.encode())}:{v}" for v in said])


def tree(leaves):
    """(top, proof of each leaf as a list of (left, right))."""
    proofs, nodes, members = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for i in run:
                for m in members[i]:
                    proofs[m].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        members = [[m for i in run for m in members[i]] for run in runs]
        nodes = [digest(*[nodes[i] for i in run]) for run in runs]
    return nodes[0], proofs


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted([r for r in rows if r[3] == s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, above = tree([t[0] for t in trees])
    out = []
    for k, g in enumerate(groups):
        for r, proof in zip(g, trees[k][1], strict=True):
            path = proof + above[k]
            node = leaf((r[0], r[1].replace("\n", "") if r[1] else r[1], *r[2:]))
            for lo, hi in path:
                node = digest(lo, node, hi)
            out.append((r[0], leaf(r), trees[k][0], root, digest(*[lo + hi for lo, hi in path]), node, node == root))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    claimed = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.translate("text", "\n", "")]
    got = merkle.folded(merkle.manifest(docs, claimed))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def test_manifest_equals_recursion_with_nulls_ties_and_repeats(spark):
    rows = [(k, f"text {k}" + ("\n" if k % 4 == 0 else ""), "en", ["b", "a", None, "é", "B"][k % 5], k) for k in range(40)]
    rows += [(None, None, None, None, None), (None, "", "", "", 0), (7, "again", "en", "b", 1), (3, "text 3", "en", "é", 3), (3, "text 3", "en", "é", 3), (99, "lone\n", "en", "only", -4)]
    assert run(spark, rows) == brute(rows)


def test_manifest_of_several_rounds(spark):
    rows = [(k, "x\n" if k % 97 == 0 else "x", "en", "hot" if k < 2300 else "cold", k) for k in range(2303)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 3, 4])
def test_manifest_of_one_source(spark, n):
    rows = [(k, "a\nb", "en", "s", 1) for k in range(n)]
    assert run(spark, rows) == brute(rows)


def test_manifest_of_no_rows_and_of_lone_leaves(spark):
    assert run(spark, []) == []
    rows = [(k, "t" * 100_000, "en", f"s{k}", 1) for k in range(5)]
    assert run(spark, rows) == brute(rows)


def test_own_values_verify(spark):
    docs = spark.createDataFrame([(k, "a\nb", "en", "s", 1) for k in range(10)], DOCS.split(", leaf")[0])
    assert all(r.verified for r in merkle.folded(merkle.manifest(docs)).collect())


def test_block_sweeps():
    leaves = [digest(str(i)) for i in range(28)]
    top, received = merkle.forward(leaves, merkle.levels_of(28))
    assert top == tree(leaves)[0] and merkle.levels_of(28) == 4 and merkle.levels_of(27) == 3
    for path, want in zip(merkle.backward(28, 4, received, None), tree(leaves)[1], strict=True):
        assert [(s["left"], s["right"]) for s in merkle._unlinked(path)] == want
