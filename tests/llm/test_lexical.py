"""Ranking against a full scan: ties, repeats, nulls, long and empty texts, several blocks; bounds lose nothing."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from echogrid.llm import lexical

DOCS = "doc_id long, text string, length double, rank int, item_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(docs, items, top=10):
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        asked = Counter(t for text in {t for i, t in items if i == item} for t in terms(text))
        found = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, k in asked.items())
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    left = spark.createDataFrame([(d, t, 0.0, 1, "x") for d, t in docs], DOCS)
    right = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    got = lexical.ranked(left, right, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in got.collect()], key=str)


@pytest.fixture
def docs():
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 120)) % 300)) for k in range(300)]
    rows += [(400 + k, "w1 W1 same-text w7") for k in range(30)]  # ties by doc_id
    rows += [(None, "w1 w7"), (None, "w1 w7"), (5, rows[5][1]), (900, None), (901, ""), (902, " .,;"), (903, "é’x w2 " * 3000), (904, "W3\x7fw4{w5}")]
    return rows


@pytest.fixture
def items(docs):
    return [(1, "w1 w7 same"), (2, docs[9][1]), (2, docs[9][1]), (3, "unknown words"), (4, None), (5, "w2 É é’x w2 w2"), (None, "w3 w4"), (6, "w1"), (7, docs[50][1]), (7, "w250 w251")]


def test_ranking_equals_full_scan(spark, docs, items):
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_buckets_and_few_results(spark, docs, items, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lexical, "CELLS", 2000)
    assert run(spark, docs, items, top=3) == brute(docs, items, 3)


def test_empty_tables(spark, docs, items):
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    size, n = 60, 2000
    queries = lexical.read_queries([(k, " ".join(f"t{x}" for x in rng.integers(0, size, 6))) for k in range(5)])
    size = len(queries.vocabulary)
    tf = [(rng.choice(size, c, replace=False), rng.integers(1, 4, c)) for c in rng.integers(1, size // 2, n)]
    holding = np.bincount(np.concatenate([t for t, _ in tf]), minlength=size)
    stats = lexical.Statistics(n, 40 * n, holding)
    q = lexical.weigh(queries, stats, focus=3)
    impact = [lexical.impacts(f.astype(np.int64), np.full(len(t), 40), n, 40 * n) for t, f in tf]
    length = np.array([math.sqrt(float((i.astype(float) ** 2).sum())) for i in impact])
    board, pairs, rescored = lexical.Board(np.zeros(5), 10), 0, 0
    order = np.argsort(-length)
    for a in range(0, n, 64):
        ids = order[a:a + 64]
        first = np.concatenate([[0], np.cumsum([len(tf[d][0]) for d in ids])])
        x, y = lexical.search_bucket(q, board, [int(d) for d in ids], length[ids], first, np.concatenate([tf[d][0] for d in ids]), np.concatenate([impact[d] for d in ids]), size)
        pairs, rescored = pairs + x, rescored + y
    assert rescored < 5 * n
    for k in range(5):
        a, b = queries.first[k], queries.first[k + 1]
        full = sorted((-sum(int(w) * int(impact[d][list(tf[d][0]).index(t)]) for t, w in zip(q.term[a:b], q.weight[a:b], strict=True) if t in tf[d][0]), False, d) for d in range(n))
        assert board.rows[k] == [f for f in full[:10] if f[0] < 0]
