"""Refusals, subsets, folders and keys that used to give partial results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.operators import evaluate, stats, topk
from echogrid.operators.series import local_peaks
from echogrid.session import scratch_path
from echogrid.sources import recordings
from echogrid.streaming import streams

SMALL = "/root/testdata/sf0.001"


def test_page_refuses_a_large_limit(spark):
    with pytest.raises(ValueError):
        topk.ordered_page(spark.range(3), "id", "id", 501, 0, max_limit=500)


def test_signature_sees_swapped_files(spark):
    sign = lambda rows: recordings.input_signature(spark.createDataFrame(rows, "p string, c string"), "p", "c", "{}").first()[0]
    assert sign([("a", "x"), ("b", "y")]) == sign([("b", "y"), ("a", "x")]) != sign([("a", "y"), ("b", "x")])


def test_stored_signature_is_refused(spark):
    with pytest.raises(Exception, match="stored inputs differ"):
        recordings.checked_signature(spark.createDataFrame([("new", 1)], "signature string, inputs long"), "old").collect()


def test_kruskal_ranks_listed_groups_only(spark):
    rows = [(g, float(v)) for g, vs in {"a": (1, 2, 3, 9), "b": (4, 5, 6, 10), "c": (7, 8, 11, 12)}.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    some = stats.kruskal(df, [], "g", "v", ["a", "b"]).first()
    alone = stats.kruskal(df.where("g <> 'c'"), [], "g", "v", ["a", "b"]).first()
    assert some == alone and some["h"] > 0 and some["n_rows"] == 8


def test_stream_reads_a_folder_of_parts(spark):
    folder = scratch_path(spark, "parts")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(f"{folder}/events.parquet")
    count = lambda path: streams.run_to_table(streams.event_stream(spark, path).select(F.col("event_id")), "copy").count()
    assert count(folder) == count(SMALL) == events.count()


@pytest.mark.parametrize("chunk_rows", [16, 64, 10_000])
def test_peaks_in_rounds_equal_a_greedy_walk(spark, chunk_rows):
    """Rising chains over many chunks, ties and a plain random series."""
    rng = np.random.default_rng(6)
    series = {1: rng.random(600), 2: np.where(np.arange(600) % 3 == 1, 1 + np.arange(600) / 600, 0.0), 3: np.where(np.arange(600) % 4 == 2, 5.0, 0.0), 4: rng.random(600).round(1)}
    df = spark.createDataFrame([(k, i, float(v)) for k, s in series.items() for i, v in enumerate(s)], "k int, i long, v double")
    got = {}
    for r in local_peaks(df, ["k"], "i", "v", 7, chunk_rows).collect():
        got.setdefault(r.k, set()).add(r.peak)
    for k, s in series.items():
        tops = [i for i in range(1, 599) if s[i] > s[i - 1] and s[i] > s[i + 1] and s[i] >= s.mean() + s.std()]
        kept = []
        for i in sorted(tops, key=lambda i: (-s[i], -i)):
            if all(abs(i - j) >= 7 for j in kept):
                kept.append(i)
        assert got.get(k, set()) == set(kept), k


def test_salted_join_equals_a_plain_join(spark):
    from echogrid.operators.joins import salted_join

    left = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(300)] + [(None, 7)], "key int, row int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (6, "c"), (None, "d")], "key int, name string")
    want = sorted(map(tuple, left.join(right, ["key"]).collect()))
    assert sorted(map(tuple, salted_join(left, right, ["key"]).collect())) == want and len(want) > 400


def test_arms_are_scored_for_every_replicate_by_file(spark):
    """Two arms, two replicates, two rows a file; AUROC and accuracies against plain loops over the files' mean scores."""
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    rows = [(f, Vectors.dense([float(f % 2) + rng.normal(0, 0.8), rng.normal()]), f % 2) for f in range(40) for _ in range(2)]
    arms = [(arm, rep, "train" if (f + rep + (arm == "B")) % 3 else "test", f) for arm in "AB" for rep in (0, 1) for f in range(40)] + [("one", 0, "train", 0), ("one", 0, "test", 1)]
    frame = spark.createDataFrame(rows, ["file", "x", "y"])
    table = spark.createDataFrame(arms, "arm string, replicate int, side string, file long")
    got = {(r.arm, r.replicate): r for r in evaluate.score_arms(frame, table, "file", "x", "y").collect()}
    assert set(got) == {("A", 0), ("A", 1), ("B", 0), ("B", 1), ("one", 0)} and got["one", 0].auroc is None
    for key in (("A", 1), ("B", 0)):
        side = lambda s: [a[3] for a in arms if a[:2] == key and a[2] == s]  # noqa: B023, E731
        model = evaluate.fit_logistic(frame.filter(F.col("file").isin(side("train"))), "x", "y")
        scores, truth = {}, {}
        for r in model.transform(frame.filter(F.col("file").isin(side("test")))).collect():
            scores.setdefault(r.file, []).append(r.probability[1])
            truth[r.file] = r.y
        mean = {f: sum(s) / len(s) for f, s in scores.items()}
        pos, neg = [m for f, m in mean.items() if truth[f]], [m for f, m in mean.items() if not truth[f]]
        assert got[key].positives == len(pos) and np.isclose(got[key].auroc, np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]))
        assert np.isclose(got[key].balanced_accuracy, (np.mean([p >= 0.5 for p in pos]) + np.mean([q < 0.5 for q in neg])) / 2)
