"""Streams give what tables give, however the rows are split and in whatever order they come."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fernwalk.operators import observe
from fernwalk.operators import sentences as S
from fernwalk.streaming import streams


def documents():
    r = random.Random(9)
    pool = [f"Sentence {chr(97 + i)} stands here" for i in range(12)]
    return [(i, ". ".join(r.choices(pool, k=r.randint(1, 6)))) for i in range(30)] + [(30, None), (31, ""), (None, pool[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_the_first_page_wins_in_any_order(spark, tmp_path, seed):
    spark.conf.set(*streams.STATE_STORE)
    docs, r = documents(), random.Random(seed)
    r.shuffle(docs)
    for i in range(0, len(docs), 9):
        spark.createDataFrame(docs[i : i + 9], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string", 1)
    changes = streams.run_once(streams.first_page_stream(stream), str(tmp_path / "out"))
    whole = S.sentences(spark.createDataFrame(docs, "doc_id long, text string").where("doc_id IS NOT NULL"))
    want = {(x.doc_id, x.pos, x.s) for x in S.dedup_across_pages(whole, ["doc_id", "pos"]).collect()}
    assert {(x.doc_id, x.pos, x.s) for x in streams.standing(changes).collect()} == want
    assert not changes.where("op = 'drop'").isEmpty()
    # What comes after a run goes on from its state.
    spark.createDataFrame([(-1, docs[0][1] or "Sentence a stands here")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    again = streams.standing(streams.run_once(streams.first_page_stream(stream), str(tmp_path / "out")))
    assert again.where("doc_id = -1").count() > 0 and again.count() >= len(want)


def test_state_of_sentences_is_kept_without_python(spark, tmp_path):
    spark.conf.set(*streams.STATE_STORE)
    schema, folder = "doc_id long, text string", tmp_path / "in"
    folder.mkdir()
    stream = streams.first_page_stream(streams.read_stream(spark, str(folder), schema, 1))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan and "Python" not in plan
    told = lambda: sorted((x.op, x.doc_id, x.pos, x.s) for x in streams.run_once(stream, str(tmp_path / "out")).collect())
    assert told() == []  # no file yet
    want = []
    # A later page tells nothing, an earlier one takes the place of what was told, once.
    for docs, ops in (
        ([(5, "One. TWO"), (6, "two")], [("add", 5, 0, "One"), ("add", 5, 1, "TWO")]),
        ([(7, "one. two"), (5, "One. TWO")], []),
        ([(3, "two")], [("drop", 5, 1, "TWO"), ("add", 3, 0, "two")]),
        ([(4, "TWO")], []),
        ([(3, "x. Two"), (2, "Two"), (1, "y. Two")], [("add", 3, 0, "x"), ("add", 1, 0, "y"), ("drop", 3, 0, "two"), ("add", 1, 1, "Two")]),
    ):
        spark.createDataFrame(docs, schema).coalesce(1).write.mode("append").parquet(str(folder))
        want = sorted(want + ops)
        assert told() == want


def test_sentences_of_a_time_are_told_alike(spark, tmp_path):
    spark.conf.set(*streams.STATE_STORE)
    # Else times that run out keep such a stream going.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for docs, want in (([(5, "One. TWO")], {(5, 0, "One"), (5, 1, "TWO")}), ([(7, "one"), (3, "two")], {(5, 0, "One"), (3, 0, "two")})):
            spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = streams.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string", 1)
            changes = streams.run_once(streams.first_page_stream(stream, forget_ms=3_600_000), str(tmp_path / "out"))
            assert {(x.doc_id, x.pos, x.s) for x in streams.standing(changes).collect()} == want
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def plain_sessions(events, minutes=30):
    out = {}
    for user, t in sorted((u, t) for _, u, t in events):
        runs = out.setdefault(user, [])
        if runs and t - runs[-1][1] < minutes * 60:
            runs[-1] = (runs[-1][0], t, runs[-1][2] + 1)
        else:
            runs.append((t, t, 1))
    return {(u, a, b + minutes * 60, n) for u, runs in out.items() for a, b, n in runs}


def test_sessions_of_a_replay_with_late_events(spark, tmp_path):
    r = random.Random(3)
    # Events of three days; one in ten comes an hour after its time, and ten come two days after theirs.
    rows = [(i, r.randint(1, 3), r.randint(0, 259_200)) for i in range(400)]
    df = spark.createDataFrame([(i, u, t, "error" if i % 5 == 0 else "view", 1.5) for i, u, t in rows], "event_id long, user_id long, s long, event_type string, value double")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    late = {i for i, _, t in rows if t < 20_000 and i % 2}
    lag = f"CASE WHEN event_id IN ({', '.join(map(str, sorted(late)))}) THEN 172800 WHEN event_id % 10 = 0 THEN 3600 ELSE 0 END"
    streams.replay(df, str(tmp_path / "in"), 8, lag=lag)
    stream = streams.read_stream(spark, str(tmp_path / "in"), df.schema, 1)
    query = streams.sessions(stream, delay="3 hours").writeStream.format("memory").queryName(f"told{abs(hash(str(tmp_path)))}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    told = spark.table(query.name)
    dropped = streams.late_rows(query.recentProgress)
    assert dropped == len(late) > 0
    # With the late ones counted apart, sessions that are told are those of the rest; the last ones are still open.
    want = plain_sessions([x for x in rows if x[0] not in late])
    got = {(x.user, int(x.a), int(x.b), x.n) for x in told.selectExpr("user", "cast(start AS long) AS a", "cast(end AS long) AS b", "n").collect()}
    assert got <= want and len(want - got) <= 30 and len(got) > 50
    batch = streams.sessions(df.where(~F.col("event_id").isin(*late)), delay=None)
    assert {(x.user, int(x.a), int(x.b), x.n) for x in batch.selectExpr("user", "cast(start AS long) AS a", "cast(end AS long) AS b", "n").collect()} == want


def test_sketches_merge_within_their_error(spark):
    m = spark.range(50_000).select((F.col("id") % 3).cast("string").alias("phase"), (F.col("id") % 7).alias("day"), F.exp(F.randn(4) * 2).alias("elapsed_ms"))
    days = observe.timing_sketches(m, ["phase", "day"])
    merged = observe.merged_timing(days, ["phase"])
    for row in observe.rank_of(m, merged, ["phase"]).collect():
        assert row.below <= 0.95 + observe.RANK_ERROR and row.upto >= 0.95 - observe.RANK_ERROR
    assert days.agg(F.max(F.length("sketch"))).first()[0] < 10_000
    exact = {r.phase: (r.n, r.max_ms) for r in observe.phase_timing(m).collect()}
    assert {r.phase: (r.n, r.max_ms) for r in merged.collect()} == exact
    assert observe.merged_timing(observe.timing_sketches(m.where("false"), ["phase", "day"]), ["phase"]).isEmpty()
