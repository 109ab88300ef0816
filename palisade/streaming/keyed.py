"""Stateful streams by key: a circuit breaker whose reset needs no call, and sessions with a rolling fold.

State lives in Spark's state store: a short list and a few numbers for each key, whatever has passed through. What a stream has made
lies in a table with a folder for each batch, so a batch that runs again writes its own folder again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import scratch

#: The store that list states and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Breaker(StatefulProcessor):
    """What a breaker does with each call of a key, and when an open one is ready for a probe, be there a call or not."""

    def __init__(self, key: str, tie: str, seconds: float, threshold: int, reset: float):
        self.tie, self.seconds, self.threshold, self.reset = tie, int(seconds * 1e6), threshold, int(reset * 1e6)
        self.row = Row(key, tie, "us", "state")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "failures array<bigint>, opened bigint, ready boolean")  # as one value: each call to the store is a message

    def _due(self, opened: int) -> int:
        """The timer's time in milliseconds: not before the reset time is over."""
        return -(-(opened + self.reset) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        calls = sorted((r["us"], r[self.tie], r["failed"]) for r in rows)  # a batch's calls of one key
        had = self.state.get()
        failures, opened, ready = (list(had[0]), had[1], had[2]) if had else ([], None, False)
        now = (list(failures), opened, ready)
        before = opened
        for at, tie, failed in calls:
            if opened is not None and at - opened < self.reset:
                yield self.row(key[0], tie, at, "refused")
                continue
            if opened is not None and not ready:
                yield self.row(key[0], None, opened + self.reset, "half_open")
            if not failed:
                yield self.row(key[0], tie, at, "passed" if opened is None else "closed")
                failures, opened, ready = failures if opened is None else [], None, False
                continue
            failures = [x for x in [*failures, at] if x >= at - self.seconds][-self.threshold :]
            if opened is not None or len(failures) >= self.threshold:
                yield self.row(key[0], tie, at, "opened" if opened is None else "reopened")
                opened, ready = at, False
            else:
                yield self.row(key[0], tie, at, "failed")
        if opened != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            if opened is not None:
                self.handle.registerTimer(self._due(opened))
        if (failures, opened, ready) != now:
            self.state.update((failures, opened, ready)) if failures or opened is not None else self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        had = self.state.get()
        if had and had[1] is not None and not had[2] and self._due(had[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((list(had[0]), had[1], True))
            yield self.row(key[0], None, had[1] + self.reset, "half_open")

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """The last turns of each session stay in its state; those before are passed on as folded, once each, in order."""

    def __init__(self, session: str, order: str, text: str, keep: int):
        self.session, self.order, self.text, self.keep = session, order, text, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "at bigint, role string, text string")
        self.counts = handle.getValueState("counts", "n bigint, n_user bigint, n_folded bigint, folded_chars bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turns = [tuple(r) for r in self.turns.get()] if self.turns.exists() else []
        n, n_user, n_folded, chars = self.counts.get() if self.counts.exists() else (0, 0, 0, 0)
        new = [r for part in rows for r in zip(part[self.order].tolist(), part["role"].tolist(), part[self.text].tolist(), strict=True)]
        turns = sorted([*turns, *new], key=lambda r: r[0])
        old, turns = turns[: -self.keep], turns[-self.keep :]
        out = []
        for at, role, text in old:
            line = None if role is None or text is None else f"{role}: {text}"
            out.append((key[0], "folded", at, line, None, None, None, None))
            chars += len(line or "") + (1 if n_folded else 0)
            n_folded += 1
        n, n_user = n + len(new), n_user + sum(r[1] == "user" for r in new)
        self.turns.put(turns)
        self.counts.update((n, n_user, n_folded, chars))
        out.append((key[0], "session", max(r[0] for r in turns), None, n, n_user, n_folded, chars))
        found = pd.DataFrame(out, columns=[self.session, "kind", self.order, "line", "n", "n_user", "n_folded", "folded_chars"])
        yield found.astype({c: "Int64" for c in ("n", "n_user", "n_folded", "folded_chars")})

    def close(self) -> None:
        pass


def _run(spark: SparkSession, stream: DataFrame, folder: str) -> None:
    """All that the source holds, in micro-batches; a later call with the same folder goes on after it."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def _with_store(spark: SparkSession):
    """Sets the state store for one run; gives what puts the old one back."""
    old = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    return lambda: spark.conf.set(STORE[0], old) if old else spark.conf.unset(STORE[0])


def breaker_stream(calls: DataFrame, key: str, tie: str, seconds: float = 60, threshold: int = 5, reset: float = 30, folder: str | None = None) -> DataFrame:
    """key, tie, at, state of a stream of calls (key, tie, at: a watermarked timestamp, failed), as ``breaker_states`` has them, and a row
    ``half_open`` without a tie for each opening whose reset time has passed, by a timer if no call came.

    Calls must come in order of time from one batch to the next; those behind the watermark are dropped. Null keys are a key.
    """
    spark, folder = calls.sparkSession, folder or scratch(calls.sparkSession, "breaker-stream")
    kind = calls.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{tie}` bigint, us bigint, state string"
    back = _with_store(spark)
    try:
        rows = calls.select(key, F.col(tie).cast("bigint").alias(tie), "at", F.unix_micros("at").alias("us"), F.coalesce("failed", F.lit(False)).alias("failed"))
        _run(spark, rows.groupBy(key).transformWithState(Breaker(key, tie, seconds, threshold, reset), schema, "Update", "EventTime"), folder)
    finally:
        back()
    found = spark.read.schema(schema).parquet(f"{folder}/rows/batch=*")
    return found.select(key, tie, F.timestamp_micros("us").alias("at"), "state")


def session_stream(turns: DataFrame, session: str, order: str, text: str, keep: int = 6, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(folded, sessions) of a stream of turns: session, order, line of each turn that is not among the last ``keep``; and for each session
    n, n_user, n_folded, folded_chars (of the lines joined) as they are now. Turns of a session come in order from one batch to the next."""
    spark, folder = turns.sparkSession, folder or scratch(turns.sparkSession, "session-stream")
    kinds = {c: turns.schema[c].dataType.simpleString() for c in (session, order)}
    schema = f"`{session}` {kinds[session]}, kind string, `{order}` {kinds[order]}, line string, n bigint, n_user bigint, n_folded bigint, folded_chars bigint"
    back = _with_store(spark)
    try:
        _run(spark, turns.select(session, order, "role", text).groupBy(session).transformWithStateInPandas(Sessions(session, order, text, keep), schema, "Update", "None"), folder)
    finally:
        back()
    rows = spark.read.schema(schema).parquet(f"{folder}/rows/batch=*")
    sessions = rows.where("kind = 'session'").groupBy(session).agg(F.max_by(F.struct("n", "n_user", "n_folded", "folded_chars"), "n").alias("s"))
    return rows.where("kind = 'folded'").select(session, order, "line"), sessions.select(session, "s.*")
