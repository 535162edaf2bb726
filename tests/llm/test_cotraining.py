"""The classifier's views against plain loops, its verdict on planted documents, and rows of every awkward kind."""

import re

import numpy as np
import pyarrow as pa

from echogrid.llm import cotraining as c

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, label int"


def beginnings(text):
    """Plain form of the content view."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
    return [w for w in words] + [(k, w[:k]) for k in c.PREFIXES for w in words if len(w) > 3]


def test_content_features_tell_words_and_beginnings_apart():
    texts = ["Alpha alphabet, BETA; x é", "", "alphab alpha1 bet", "é" * 9 + " alphabet"]
    owner, bucket = c.content_features(c.words(texts, c.LETTERS))
    seen = {}
    for k, text in enumerate(texts):
        plain = beginnings(text)
        got = sorted(bucket[owner == k])
        assert len(got) == len(plain)
        for p in plain:
            seen.setdefault(p, None)
    names = [p for k, t in enumerate(texts) for p in beginnings(t)]
    both = [b for k in range(len(texts)) for b in bucket[owner == k]]
    assert len(set(names)) >= len(set(both)) >= len(set(names)) - 1


def test_distinct_pairs_equal_sets():
    rng = np.random.default_rng(1)
    owner, value = rng.integers(0, 50, 5000), rng.integers(0, c.DIMENSIONS, 5000) % 97 * 1000
    got = set(zip(*map(list, c._distinct(owner, value, 50, c.DIMENSIONS)), strict=True))
    assert got == set(zip(owner.tolist(), value.tolist(), strict=True))
    assert len(c._distinct(owner[:0], value[:0], 0, 10)[0]) == 0


def test_page_features_count_layout_and_metadata():
    texts = ["Ab| 12!\nab| x", "", "a a a a"]
    got = c.page_features(texts, [14, None, 7], ["en", None, "en"], ["s", None, "t"])
    at = {name: k for k, name in enumerate(c.LAYOUT)}
    for k, text in enumerate(texts):
        n = max(len(text), 1)
        assert np.isclose(got[k, at["pipes"]], text.count("|") / n) and np.isclose(got[k, at["digits"]], sum(ch.isdigit() for ch in text) / n)
        assert np.isclose(got[k, at["upper"]], sum(ch.isupper() for ch in text) / n) and np.isclose(got[k, at["lines"]], np.log1p(1e4 * text.count("\n") / n))
        words = text.split()
        assert np.isclose(got[k, at["repeats"]], 1 - len(set(words)) / max(len(words), 1))
    assert got[1, at["no_chars"]] == 1 and got[0, at["no_chars"]] == 0
    metadata = got[:, len(c.LAYOUT):]
    assert (metadata.sum(axis=1) == 2).all() and (metadata[0, :c.LANGS] == metadata[2, :c.LANGS]).all() and metadata[1, 0] == 1 == metadata[1, c.LANGS]


def test_scores_are_dot_products_of_the_features():
    rng = np.random.default_rng(3)
    used = np.sort(rng.choice(c.DIMENSIONS, 30_000, replace=False))
    views = c.Views(used, rng.normal(size=len(used)), rng.normal(size=c.PAGE), (0.5, -0.5), ((1.0, 0.1), (0.5, 0.2), (2.0, 0.3)), 0.7)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 200, n)) for n in (0, 1, 50, 400)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, None]), pa.array(texts), pa.array([1, 2, 3, None]), pa.array(["en", None, "x", "y"]), pa.array([None, "s", "s", "t"])], ["row", "text", "n_chars", "lang", "source"])
    sent = type("Sent", (), {"value": views})
    got = pa.Table.from_batches(list(c._scored(sent, iter([batch])))).to_pylist()
    page = c.page_features(texts, [1, 2, 3, None], ["en", None, "x", "y"], [None, "s", "s", "t"])
    for k, text in enumerate(texts):
        _, bucket = c.content_features(c.words([text], c.LETTERS))
        content = 0.5 + sum(views.content[list(used).index(b)] for b in set(bucket.tolist()) & set(used.tolist()))
        a, b = content + 0.1, (-0.5 + page[k] @ views.page) * 0.5 + 0.2
        assert np.isclose(got[k]["content_odds"], a) and np.isclose(got[k]["page_odds"], b) and np.isclose(got[k]["score"], 1 / (1 + np.exp(-((a + b - 0.7) * 2 + 0.3))))


def corpus(n):
    """A quarter is rude (content), a quarter is tables (layout), the rest is clean; a fifth has no label."""
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 300, 60)]
        if k % 4 == 1:
            words[10] = words[30] = "scoundrel"
        text = (" | " if k % 4 == 2 else " ").join(words)
        rows.append((k, text, "en", f"s{k % 3}", len(text), "x", 1))
        if k % 5:
            labels.append((k, int(k % 4 != 2), int(k % 4 == 1)))
    return rows, labels


def test_verdict_on_planted_documents_and_awkward_rows(spark):
    rows, labels = corpus(1200)
    odd = [(None, None, None, None, None, None, None), (2000, "", None, "s0", None, "x", 1), (2001, "x" * 300_000, "en", None, -5, "x", 1), (7, rows[7][1], "en", "s1", 5, "x", 1), (None, rows[9][1], "en", "s0", 9, "x", 1)]
    labels += [(None, 1, 0), (3, None, 0), (5, 0, None), (9000, 0, 1), (11, 1, 0)]
    out = c.judged(spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == ["row", "content_odds", "page_odds", "score", "kept"] and out.select("row.*").columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.kept == (r.score >= c.THRESHOLD) for r in got)
    unlabelled = {r.row.doc_id: r.kept for r in got if r.row.doc_id is not None and r.row.doc_id < 1200 and r.row.doc_id % 5 == 0}
    right = [kept == (k % 4 in (0, 3)) for k, kept in unlabelled.items()]
    assert len(right) == 240 and sum(right) >= 230


def test_empty_tables(spark):
    rows, labels = corpus(20)
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert c.judged(spark.createDataFrame([], DOCS), none).count() == 0
    assert c.judged(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, none.schema)).count() == 0
    assert c.judged(docs, none).where("kept").count() == 20
