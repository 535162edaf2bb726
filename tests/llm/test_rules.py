"""Counts, base test and expectation-maximisation of the quality rules against plain Python."""

import re

import numpy as np

from echogrid.llm import quality_rules as q

DOCS = "doc_id long, text string, row int, quality string, kept int"


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    repeated = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
            len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def texts():
    rng = np.random.default_rng(5)
    made = []
    for k in range(120):
        words = [f"{'é😀aB#|'[x % 6]}{x}" for x in rng.integers(0, [4, 30, 500][k % 3], rng.integers(1, 140))]
        for at in rng.integers(0, len(words), 6):
            words[at] += rng.choice(["\n", " \n", "\t", "\x0b", "\r\n", "\x00", " ", "!"])
        made.append(" ".join(words))
    line = "the same line again #1"
    return [*made, "\n".join([line] * 30), "\n" + "\n ".join([line] * 30), None, "", " \n\t", "a b", "a b c a b c", "x " * 60_000, made[0]]


def test_counts_and_base_equal_plain_python(spark):
    rows = [(k if k % 30 else None, t, 1, "x", 2) for k, t in enumerate(texts())]
    out = q.quality_report(spark.createDataFrame(rows, DOCS))
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(str(tuple(r)[:7]) for r in out.collect())
    small = [(d, t) for d, t, *_ in rows if t is None or len(t) < 100_000]
    want = [str((d, *counts(t))) for d, t in small] + [str((d, 60_000, 60_000, 0, 0, 60_000, True)) for d, t, *_ in rows if t and len(t) >= 100_000]
    assert got == sorted(want)
    assert not any(r.kept and r.base_failed for r in out.collect())


def test_expectation_maximisation_equals_plain_loops():
    rng = np.random.default_rng(2)
    votes = np.array([[int(v) for v in rng.integers(-1, 2, 4)] for _ in range(12)])
    votes, weight = np.unique(votes, axis=0), rng.integers(1, 50, len(np.unique(votes, axis=0))).astype(float)
    got, found = q.fit(votes, weight, rounds=7)
    n = sum(weight)
    good = [0.1 if -1 in v else 0.95 if 1 in v else 0.5 for v in votes.tolist()]
    for _ in range(7):
        rates = [[[0.0] * 3 for _ in range(4)] for _ in range(2)]
        for side in range(2):
            for r in range(4):
                mass = [q.PRIOR_SHARE * n * q.PRIOR_RATES[side][k] + 1.0 for k in range(3)]
                for v, w, g in zip(votes.tolist(), weight, good, strict=True):
                    mass[v[r] + 1] += w * (g if side else 1 - g)
                rates[side][r] = [m / sum(mass) for m in mass]
        prior = (sum(w * g for w, g in zip(weight, good, strict=True)) + 1) / (n + 2)
        good = []
        for v in votes.tolist():
            up = prior * np.prod([rates[1][r][v[r] + 1] for r in range(4)])
            down = (1 - prior) * np.prod([rates[0][r][v[r] + 1] for r in range(4)])
            good.append(up / (up + down))
    assert np.allclose(got, good) and np.isclose(found["prior"], prior)


def test_empty_table(spark):
    assert q.quality_report(spark.createDataFrame([], DOCS)).count() == 0
