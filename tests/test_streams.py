"""Streams that stop and go on, and the breaker against a plain fold."""

import random
from collections import Counter

from palisade.streaming import streams
from pyspark.sql import functions as F


def test_upsert_survives_a_stop(spark, tmp_path):
    """A second run from the same folder keeps what the first one made, also with none of the first run's variables."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [(i % 9, i, f"v{i}") for i in range(40)]
    schema = "k bigint, at bigint, v string"

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return streams.upsert_history(spark, stream, "k", "at", "v", folder=folder, buckets=4)

    run(rows[:20])
    run(rows[20:23] + [(3, -1, "old")])  # only some keys, and one row that is older than what is there
    history, current = run(rows[23:])
    assert history.count() == 41
    newest = {k: max((at, v) for kk, at, v in rows if kk == k) for k in range(9)}
    assert {r.k: (r.at, r.v) for r in current.collect()} == newest


def test_windows_close_over_several_batches(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    day = "2024-01-{:02d} 0{}:10:00"
    for k in range(10):  # ten files: two batches
        part = [(k * 10 + i, day.format(1 + k, i % 9), i % 3, "error" if i % 2 else "view", float(i)) for i in range(10)]
        spark.createDataFrame(part, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    events, end = streams.read_events(spark, path)
    got = streams.run_to_table(spark, streams.windowed(events, F.window("at", "6 hours")), "closing", end)
    table = spark.read.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))
    want = streams.windowed(table, F.window("at", "6 hours"))
    assert Counter(got.collect()) == Counter(want.collect()) and got.count() > 10


def test_breaker_recovers(spark):
    rng = random.Random(5)
    rows = [(k, i, 1_000_000 * (i * 7 + rng.randrange(7)), rng.random() < 0.6) for k in range(4) for i in range(150)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, us bigint, bad boolean").withColumn("at", F.timestamp_micros("us"))
    got = {(r.k, r.i): r.state for r in streams.breaker_states(df, "k", "at", "i", "bad", seconds=30, threshold=3, reset=40).collect()}
    want = {}
    for k in range(4):
        fails, opened = [], None
        for _, i, us, bad in (r for r in rows if r[0] == k):
            if opened is not None and us - opened < 40_000_000:
                want[k, i] = "refused"
            elif not bad:
                want[k, i], fails, opened = ("passed", fails, None) if opened is None else ("closed", [], None)
            else:
                fails = [*[t for t in fails if t >= us - 30_000_000], us]
                full = len(fails) >= 3
                want[k, i] = "reopened" if opened is not None else "opened" if full else "failed"
                opened = us if opened is not None or full else None
    assert got == want and {"closed", "reopened", "refused", "opened"} <= set(want.values())
    empty = streams.breaker_states(df.where("false"), "k", "at", "i", "bad")
    assert empty.count() == 0
