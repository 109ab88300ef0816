"""Keyed state over several batches, with a stop and a resume, against the batch queries."""

import random
from collections import Counter

import pytest
from palisade.streaming import keyed, streams
from pyspark.sql import functions as F

HOW = {"seconds": 30, "threshold": 3, "reset": 40}


def feed(spark, path, schema, rows, files):
    """Files in order of the rows, one batch each."""
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_breaker_resets_without_a_call(spark, tmp_path):
    rng = random.Random(5)
    schema = "k bigint, i bigint, us bigint, failed boolean"
    rows = sorted([(k if k else None, i, 1_000_000 * (i * 7 + rng.randrange(7)), rng.random() < 0.6) for k in range(4) for i in range(120)], key=lambda r: (r[2], r[1]))
    rows += [(3, 500, 2_000_000_000, False)]  # moves the watermark past all timers
    path, folder = str(tmp_path / "calls"), str(tmp_path / "state")
    at = F.timestamp_micros("us")

    def run(part, files):
        stream = feed(spark, path, schema, part, files).withColumn("at", at).withWatermark("at", "10 seconds")
        return keyed.breaker_stream(stream, "k", "i", folder=folder, **HOW)

    run(rows[:230], 3)
    got = run(rows[230:], 2)  # goes on from the checkpoint
    table = spark.createDataFrame(rows, schema).withColumn("at", at)
    want = streams.breaker_states(table, "k", "at", "i", "failed", **HOW)
    plain = lambda df: Counter((r.k, r.i, r.state) for r in df.collect())
    calls = got.where("state <> 'half_open'")
    assert plain(calls) == plain(want)
    openings = want.where("state IN ('opened', 'reopened')").select("k", (F.col("at") + F.expr(f"INTERVAL {HOW['reset']} SECONDS")).alias("at"))
    ready = got.where("state = 'half_open'").select("k", "at")
    assert Counter(ready.collect()) == Counter(openings.collect()) and ready.count() > 5


def test_sessions(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(c if c else None, t, "user" if t % 2 else "assistant", None if (c, t) == (2, 1) else f"turn {t} of {c}") for t in range(30) for c in range(9) if t <= 3 * c]
    path, folder = str(tmp_path / "turns"), str(tmp_path / "state")
    keyed.session_stream(feed(spark, path, schema, rows[:60], 3), "conv_id", "turn", "text", folder=folder)
    folded, sessions = keyed.session_stream(feed(spark, path, schema, rows[60:], 2), "conv_id", "turn", "text", folder=folder)
    found = {r.conv_id: (r.n, r.n_user, r.n_folded) for r in sessions.collect()}
    for c in range(9):
        own = [r for r in rows if r[0] == (c if c else None)]
        assert found[c if c else None] == (len(own), sum(r[2] == "user" for r in own), max(0, len(own) - 6))
    table = spark.createDataFrame(rows, schema)
    want = {r.conv_id: r.summary for r in streams.overflow(table.where("conv_id <> 2"), "conv_id", "turn", "text").collect()}
    lines: dict = {}
    for r in folded.where("conv_id <> 2").orderBy("turn").collect():
        lines.setdefault(r.conv_id, []).append(r.line)
    assert {k: "\n".join(v) for k, v in lines.items()} == want
    chars = {r.conv_id: r.folded_chars for r in sessions.collect()}
    assert all(chars[k] == len(v) for k, v in want.items())


def test_empty_streams(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "k bigint, i bigint, at timestamp, failed boolean").write.parquet(path)
    stream = spark.readStream.schema("k bigint, i bigint, at timestamp, failed boolean").parquet(path).withWatermark("at", "1 minute")
    try:
        assert keyed.breaker_stream(stream, "k", "i").count() == 0
    except Exception as error:
        pytest.fail(str(error)[:500])


def test_breaker_asks_the_store_once_for_calls_that_change_nothing():
    asked = []

    class Store:
        """A handle and its one value; each call is a message to the store."""

        held = None
        getValueState = lambda self, *_: self
        get = lambda self: asked.append("get") or self.held
        clear = lambda self: asked.append("clear")
        registerTimer = lambda self, at: asked.append("timer")

        def update(self, value):
            asked.append("update")
            self.held = value

    breaker = keyed.Breaker("k", "i", 30, 2, 40)
    breaker.init(Store())
    run = lambda *calls: [r.state for r in breaker.handleInputRows((1,), iter([{"us": s * 1_000_000, "i": s, "failed": f} for s, f in calls]), None)]
    assert run((1, False), (2, False)) == ["passed", "passed"] and asked == ["get"]
    assert run((3, True), (4, True), (5, False)) == ["failed", "opened", "refused"] and asked == ["get", "get", "timer", "update"]
    assert run((6, True)) == ["refused"] and asked[4:] == ["get"]
