"""Steps whose time, memory or shuffle grew faster than their input: the same results, made from fewer or smaller rows."""

from pyspark.sql import functions as F


def test_fanout_totals_equal_totals_of_the_pairs(spark):
    """Scopes are summed before the join: at most two rows a fall, with the totals of its pairs; keys repeat and are null."""
    from echogrid.operators.joins import recipient_fanout

    falls = spark.createDataFrame([(k % 37, k % 5, k % 3 if k % 7 else None, k % 4 if k % 3 else None) for k in range(80)] + [(None, 1, 1, 1)],
                                  "id long, device_id long, facility_id int, resident_id int")
    people = spark.createDataFrame([(k, k % 3 if k % 11 else None, None if k % 2 else k % 4, True, k % 13 > 0, f"t{k}" if k % 9 else None) for k in range(120)],
                                   "recipient_id long, facility_id int, resident_id int, enabled boolean, push boolean, topic string")
    pairs = recipient_fanout(falls, people)
    summed = recipient_fanout(falls, people, totals={"n": F.count("*"), "first": F.min("recipient_id")})
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = rows(pairs.groupBy("id").agg(F.count("*"), F.min("recipient_id"), F.max("fall_count")))
    assert rows(summed.groupBy("id").agg(F.sum("n"), F.min("first"), F.max("fall_count"))) == want and len(want) > 20
    assert summed.count() <= 2 * falls.count() < pairs.count()


def test_arms_are_joined_one_by_one(spark, monkeypatch):
    """No written plan unites the joins of several arms: its tasks would read a part of each. Rows of a file repeat."""
    from pyspark.ml.linalg import Vectors

    from echogrid.operators import evaluate

    plans, write = [], evaluate.materialize
    monkeypatch.setattr(evaluate, "materialize", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df))[1])
    rows = spark.createDataFrame([(k % 24, Vectors.dense([float(k % 2) + k / 99, float(k % 5)]), k % 2) for k in range(48)], ["file", "x", "y"])
    arms = spark.createDataFrame([(a, 0, "train" if f % 3 else "test", f) for a in "AB" for f in range(24)], "arm string, replicate int, side string, file long")
    got = evaluate.score_arms(rows, arms, "file", "x", "y").collect()
    assert [(r.arm, r.positives, r.negatives) for r in got] == [("A", 4, 4), ("B", 4, 4)] and got[0][2:] == got[1][2:]
    assert plans and not any("Union" in p and "Join" in p for p in plans)


def test_low_hashes_keep_the_first_rows_of_a_key(spark):
    """Few rows pass, the first ones among them; keys are null, rows repeat, and a small key keeps all."""
    from echogrid.functions.scalars import stable_order
    from echogrid.operators.topk import bounded_top, low_hashes

    rows = [(None if k % 3 == 0 else "a", k) for k in range(9000)] + [("b", 1), ("b", 1), (None, 3), (None, 3)]
    df = spark.createDataFrame(rows, "g string, row long").withColumn("h", stable_order(0, F.col("row")))
    near = low_hashes(df, ["g"], "h", 20)
    first = lambda d: sorted(map(str, bounded_top(d, ["g"], [F.col("h"), F.col("row")], 20).collect()))
    assert first(near) == first(df) and len(first(df)) == 42
    assert near.columns == df.columns and near.count() < 100


def test_batches_are_cut_whatever_arrow_sends(spark):
    """No call sees more than the set windows, every row comes back once, and lengths may differ."""
    from echogrid.operators.signals import BATCH_ROWS, batched

    df = spark.range(3000, numPartitions=1).selectExpr("id", "transform(sequence(1, 4 + cast(id % 2 as int)), k -> cast(id * k as double)) AS x")
    got = batched(df, "x", lambda x: {"n": [len(x)] * len(x), "s": list(x.sum(-1))}, "id long, n int, s double").collect()
    assert sorted((r.id, r.s) for r in got) == [(k, float(k * (15 if k % 2 else 10))) for k in range(3000)]
    assert max(r.n for r in got) <= BATCH_ROWS


def test_upsert_needs_no_sort(spark):
    """All columns of the newest row, nulls included, by hashing."""
    from echogrid.sources.recordings import upsert_cache

    stored = spark.createDataFrame([(1, 5, 1.0, 7), (2, 1, 2.0, 8), (None, 3, 3.0, 9), (4, None, 4.0, 1)], "k long, version long, v double, w int")
    incoming = spark.createDataFrame([(1, 6, None, 70), (2, 0, 20.0, 80), (None, 4, 30.0, None), (4, None, 40.0, 2), (5, 1, 5.0, 3)], "k long, version long, v double, w int")
    out = upsert_cache(stored, incoming, ["k"], "version")
    assert sorted(map(tuple, out.select("k", "v", "w").collect()), key=repr) == sorted([(1, None, 70), (2, 2.0, 8), (None, 30.0, None), (4, None, None), (5, 5.0, 3)], key=repr)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_stale_timer_of_a_device_does_no_work():
    """Rows wait for the watermark and run in order once; a timer set before later rows came touches no state."""
    from functools import partial
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    from echogrid.streaming import steps
    from echogrid.streaming.streams import _OrderedProcessor, _Rows

    kept, made, timers = {}, partial(steps.FallVote, threshold=0.5, cooldown_s=3.0), []
    value = SimpleNamespace(get=lambda: kept.get("s"), update=lambda s: kept.update(s=s), clear=kept.clear)
    rows = pd.DataFrame({"id": 1, "seq": np.arange(40), "ts": pd.to_datetime(np.arange(40), unit="s"), "now": np.arange(40.0), "p": np.arange(40) % 7 / 7})
    outputs = ["state", "fall_count", "new_fall"]
    machine = _OrderedProcessor(_Rows(made, ["now", "seq"], ["now", "p"], list(rows), outputs, "ts"), 10_000)
    machine.init(SimpleNamespace(getValueState=lambda *_: value, registerTimer=timers.append))
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    mixed = rows.sample(frac=1, random_state=1)
    got = [*machine.handleInputRows((1,), iter([mixed[:15], mixed[15:25]]), at(0)), *machine.handleInputRows((1,), iter([mixed[25:]]), at(9_500))]
    before, calls = kept["s"], len(timers)
    assert not list(machine.handleExpiredTimer((1,), at(9_500), None)) and kept["s"] is before and len(timers) == calls
    got += machine.handleExpiredTimer((1,), at(39_000), None)
    whole, want = pd.concat(got), made().run(rows["now"].to_numpy(), rows["p"].to_numpy())
    assert whole["seq"].tolist() == list(range(40)) and list(whole.columns) == [*rows, *outputs]
    assert all((whole[c].to_numpy() == want[c]).all() for c in outputs)
    assert not list(machine.handleExpiredTimer((1,), at(60_000), None)) and not kept


def test_tiled_join_equals_a_plain_join(spark, monkeypatch):
    """Every pair once, whatever the tiles: a hot key, keys on one side only, null keys, repeated rows, no pairs; no task has most of the rows."""
    from echogrid.operators import joins

    left = spark.createDataFrame([(1 if k % 3 else k % 40, k % 200) for k in range(600)] + [(None, 7)], "key int, row int")
    right = spark.createDataFrame([(1 if k % 2 else k % 50, f"n{k % 90}") for k in range(180)] + [(None, "d")], "key int, name string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(left.join(right, ["key"]))
    assert rows(joins.tiled_join(left, right, ["key"])) == want and len(want) > 30_000
    for name, value in {"TASK_PAIRS": 2_000, "LEAST_PAIRS": 500, "TILE_ROWS": 16}.items():
        monkeypatch.setattr(joins, name, value)
    for few in (joins.FEW_KEYS, 0):
        monkeypatch.setattr(joins, "FEW_KEYS", few)
        got = joins.tiled_join(left, right, ["key"])
        assert got.columns == ["key", "row", "name"] and rows(got) == want
        parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) > 8 and max(parts) < len(want) / 4
    assert joins.tiled_join(left.where("key > 1000"), right, ["key"]).collect() == []


def test_messages_are_written_once_a_fall_and_dealt_by_pairs(spark):
    """Few bytes of falls make many messages: several tasks share them, and the text is made before the join. Keys repeat and are null."""
    from echogrid.streaming import sinks

    falls = spark.createDataFrame([(k % 90, k % 3, k % 7 if k % 5 else None, k, k / 2000 if k % 11 else None, None if k % 13 else "unknown_device") for k in range(1500)],
                                  "device_id long, facility_id int, resident_id long, seq long, proba_fall double, reject_reason string")
    falls = falls.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    people = [(k, k % 4 if k % 17 else None, None if k % 3 else k % 7, k % 10 > 0, k % 9 > 0, f"t{k}" if k % 8 else None) for k in range(1800)] + [(1, 1, None, True, True, "t1")]
    recipients = spark.createDataFrame(people, "recipient_id long, facility_id int, resident_id long, enabled boolean, push boolean, topic string")
    out = sinks.notifications(falls, recipients)
    assert out.columns[-3:] == ["recipient_id", "topic", "message"]

    counts, want = {}, []
    for f in sorted(falls.collect(), key=lambda f: f.seq):
        if f.reject_reason is None:
            owner = ("r", f.resident_id) if f.resident_id is not None else ("d", f.device_id)
            counts[owner] = counts.get(owner, 0) + 1
            want += [(f.seq, r, counts[owner]) for r, place, who, on, push, topic in people if place == f.facility_id and who in (None, f.resident_id) and on and push and topic]
    got = out.select("seq", "recipient_id", "fall_count", "message", F.spark_partition_id().alias("part")).toPandas()
    assert sorted(zip(got["seq"], got["recipient_id"], got["fall_count"], strict=True)) == sorted(want) and len(want) > 250_000
    assert all(m.endswith(f"(누적 {n}회)") for m, n in zip(got["message"], got["fall_count"], strict=True))
    assert got["part"].value_counts().max() < len(got) * 0.8
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    joins = [(k, depth(line)) for k, line in enumerate(plan) if "Join Inner" in line and "__row#" in line and "__column#" in line]
    texts = [(k, depth(line)) for k, line in enumerate(plan) if "format_string(낙상" in line]
    assert len(joins) == 2 and texts and all(below > [d for j, d in joins if j < k][-1] for k, below in texts)
