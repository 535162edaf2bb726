"""Likelihoods against plain loops: word counts and base score, forward recursion, expected counts, edge rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.llm import hmm

DOCS = "doc_id long, text string, held_out string, n_tokens long, row long"


def split(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def base(rows):
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    counts = Counter(t for d, text in rows if not held[d] for t in split(text))
    n, v = sum(counts.values()), len(counts)
    room = n + 0.1 * (v + 1)
    return [(d, held[d], len(split(t)), sum(counts[x] > 0 for x in split(t)), n, sum(math.log10((counts[x] + 0.1) / room) for x in split(t))) for d, t in rows]


def score(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], DOCS)
    got = hmm.likelihoods(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, **more)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return got.collect()


def speech(n, seed):
    """Texts of two kinds that share no word but one."""
    rng = np.random.default_rng(seed)
    return [(k, " ".join([f"{'ab'[k % 2]}{w}" if w else "The" for w in rng.integers(0, 60, rng.integers(1, 80))])) for k in range(n)]


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    got, want = sorted([tuple(r)[:6] for r in got], key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])


def model(k, classes, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((classes, k)), 0))


def plain(x, m):
    """log-likelihood, expected starts, moves and emissions of one sequence by unscaled recursion."""
    a, b = [m.start * m.emit[x[0]]], [np.ones(len(m.start))]
    for c in x[1:]:
        a.append((a[-1] @ m.move) * m.emit[c])
    for c in x[:0:-1]:
        b.append(m.move @ (m.emit[c] * b[-1]))
    b, total = b[::-1], a[-1].sum()
    emit, move = np.zeros(m.emit.shape), np.zeros(m.move.shape)
    for t, c in enumerate(x):
        emit[c] += a[t] * b[t] / total
        if t:
            move += np.outer(a[t - 1], m.emit[c] * b[t]) * m.move / total
    return math.log(total), a[0] * b[0] / total, move, emit


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 5)
    monkeypatch.setattr(hmm, "GROUP", 7)


def test_recursions_equal_plain_loops(short):
    rng = np.random.default_rng(2)
    m = model(3, 9)
    texts = [rng.integers(0, 9, n).astype(np.uint16) for n in (1, 5, 6, 23, 10, 4, 61, 1, 15)]
    want = [plain(x, m) for x in texts]
    assert np.allclose(hmm.log_likelihoods(texts, m), [w[0] for w in want])
    got = hmm.expect(texts, m)
    assert np.isclose(got.log, sum(w[0] for w in want))
    for k, name in enumerate(("start", "move", "emit"), 1):
        assert np.allclose(getattr(got, name), sum(w[k] for w in want)), name
    assert hmm.log_likelihoods([], m).shape == (0,)


def test_steps_hold_no_gaps(short):
    """A group of long and short segments works on its tokens alone, not on steps times segments."""
    rng = np.random.default_rng(4)
    m = model(3, 9)
    texts = [rng.integers(0, 9, n).astype(np.uint16) for n in (5, 1, 3, 1, 1, 2)]
    s = hmm.cut(texts)
    (group, running), = hmm._groups(s.size, np.arange(len(s.size)))
    at, token, emit = hmm._emissions(s, m, group, running)
    assert len(token) == len(emit) == sum(len(x) for x in texts)
    for i, x in enumerate(group):
        assert [token[at[t] + i] for t in range(s.size[x])] == list(texts[s.text[x]])
    assert np.array_equal(emit, m.emit[token])


def test_places_of_known_hashes():
    rng = np.random.default_rng(5)
    ends = np.array([0, 1, 2**64 - 1], dtype=np.uint64)
    crowded = np.uint64(7 << 40) + np.arange(50, dtype=np.uint64)
    for known in (np.zeros(0, np.uint64), ends, np.unique(np.concatenate([ends, crowded, rng.integers(0, 2**64, 300, dtype=np.uint64)]))):
        asked = np.concatenate([known, ends, crowded + np.uint64(1), rng.integers(0, 2**64, 300, dtype=np.uint64)])
        place = {int(h): k for k, h in enumerate(known)}
        assert hmm._finder(known)(asked).tolist() == [place.get(int(h), len(known)) for h in asked]
    assert hmm._finder(ends[:2])(ends).tolist() == [0, 1, 2]


def test_probabilities_of_all_short_texts_sum_to_one():
    m = model(2, 3)
    texts = [np.array(x, dtype=np.uint16) for x in np.ndindex(3, 3, 3, 3)]
    assert np.isclose(np.exp(hmm.log_likelihoods(texts, m)).sum(), 1)


def test_very_long_text_stays_finite():
    m = model(4, 50)
    x = np.random.default_rng(3).integers(0, 50, 300_000).astype(np.uint16)
    now, log = m.start, 0.0
    for c in x[:3000]:
        now = now * m.emit[c]
        log += math.log(now.sum())
        now = now / now.sum() @ m.move
    assert np.isclose(hmm.log_likelihoods([x[:3000]], m)[0], log)
    assert np.isfinite(hmm.log_likelihoods([x], m)).all()


def test_base_score_and_counts_equal_brute_force(spark):
    rows = [*speech(60, 1), (None, "a1 a2"), (None, None), (3, "a1 a2"), (3, "a1 a2"), (1000, ""), (1001, "ÀB c \x0b D"), (1002, "new" * 5000 + " a1" * 2000)]
    close(score(spark, rows, rounds=2), base(rows))


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 40)
    monkeypatch.setattr(hmm, "OWN", 20)
    rows = speech(50, 4)
    got = score(spark, rows, rounds=2)
    close(got, base(rows))
    monkeypatch.undo()
    assert all(math.isfinite(r.score) for r in got)


def test_score_is_the_chain_of_classes_and_words(spark):
    """With one state the model is a unigram of classes, so every word has its smoothed share."""
    rows = speech(40, 5)
    got = score(spark, rows, states=1, rounds=1)
    counts = Counter(t for d, text in rows if zlib.crc32(str(d).encode()) % 10 for t in split(text))
    assert len({r.train_tokens for r in got}) == 1 and got[0].train_tokens == sum(counts.values())
    for r in got:
        if r.n_known == r.n_tokens:
            assert abs(r.score - r.base_score) < 0.05 * r.n_tokens


def test_states_learn_kinds_of_text(spark):
    rows = speech(400, 6)
    got = score(spark, rows, states=4, rounds=12)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_rounds_never_lower_the_likelihood(spark):
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 12, n).astype(np.uint16).tobytes() for n in rng.integers(1, 40, 60)]
    encoded = spark.createDataFrame([(bytearray(d),) for d in docs], "states binary")
    _, logs = hmm.baum_welch(encoded, model(3, 12, 5), 6)
    assert all(b >= a - 1e-9 for a, b in zip(logs, logs[1:], strict=False))


def test_no_rows_and_no_training_rows(spark):
    assert score(spark, []) == []
    rows = [(d, f"w{d}") for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0]
    got = score(spark, rows)
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got) and len(got) == len(rows)
