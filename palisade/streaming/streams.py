"""Stateful work over conversations, failures and event streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import first_per_key
from ..sources.shared import scratch

KEEP_TURNS = 6


def last_turns(log: DataFrame, session: str, order: str, n: int = KEEP_TURNS) -> DataFrame:
    """The last n turns of each session, oldest first by ``turn_no``."""
    back = F.row_number().over(W.partitionBy(session).orderBy(F.desc(order)))
    kept = log.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")
    return kept.withColumn("turn_no", F.row_number().over(W.partitionBy(session).orderBy(order)))


def overflow(log: DataFrame, session: str, order: str, text: str, n: int = KEEP_TURNS) -> DataFrame:
    """session, n_folded, summary: all turns but the last n in one row, for sessions that have more."""
    back = F.row_number().over(W.partitionBy(session).orderBy(F.desc(order)))
    old = log.withColumn("_back", back).where(F.col("_back") > n)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "role", text))), lambda x: F.concat(x["role"], F.lit(": "), x[text]))
    return old.groupBy(session).agg(F.count("*").alias("n_folded"), F.array_join(parts, "\n").alias("summary"))


def repeated_calls(log: DataFrame, session: str, order: str | list[str], signature: Column) -> DataFrame:
    """Turns whose signature equals that of the turn before."""
    rows = log.withColumn("signature", signature)
    before = F.lag("signature").over(W.partitionBy(session).orderBy(order))
    return rows.withColumn("_before", before).where(F.col("signature").eqNullSafe(F.col("_before")) & F.col("_before").isNotNull()).drop("_before")


def failure_windows(failures: DataFrame, key: list[str], at: str, tie: str, seconds: int = 60, threshold: int = 5) -> DataFrame:
    """Adds n_recent (failures of the key in the last ``seconds``, this one included) and opened (n_recent reaches the threshold)."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    frame = W.partitionBy(*key).orderBy("_t").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return failures.withColumn("_t", t).withColumn("n_recent", F.count("*").over(frame)).withColumn("opened", F.col("n_recent") >= threshold).drop("_t")


def breaker_states(calls: DataFrame, key: str, at: str, tie: str, failed: str, seconds: float = 60, threshold: int = 5, reset: float = 30) -> DataFrame:
    """key, tie, at, state: what a circuit breaker of each key does with each call, in order of time.

    ``failed`` says how a call ends if it is let through. Closed: calls pass, and ``threshold`` failures within ``seconds`` open it. Open:
    calls are refused until ``reset`` seconds have passed, then one probe passes; a success closes the breaker and forgets the
    failures, a failure opens it anew. States: passed, failed, opened, refused, closed, reopened. Rows of a key come sorted in
    Arrow batches; a task holds one key's state, the times of its last failures, never its calls.
    """
    rows = calls.select(key, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(failed).cast("boolean").alias("failed"))
    rows = rows.repartition(key).sortWithinPartitions(key, "at", tie)

    def run(batches):
        now, failures, opened = None, deque(), None
        for batch in batches:
            states = []
            for k, t, bad in zip(*(batch.column(c).to_pylist() for c in (key, "at", "failed")), strict=True):
                if k != now:
                    now, failures, opened = k, deque(), None
                if opened is not None and t - opened < reset * 1_000_000:
                    states.append("refused")
                    continue
                if not bad:
                    states.append("passed" if opened is None else "closed")
                    if opened is not None:
                        failures.clear()
                    opened = None
                    continue
                failures.append(t)
                while failures[0] < t - seconds * 1_000_000:
                    failures.popleft()
                if len(failures) > threshold:  # older ones decide nothing
                    failures.popleft()
                if opened is not None:
                    states.append("reopened")
                    opened = t
                elif len(failures) >= threshold:
                    states.append("opened")
                    opened = t
                else:
                    states.append("failed")
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(tie), batch.column("at"), pa.array(states, pa.string())], names=[key, tie, "at", "state"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, tie, "at")]
    out = rows.mapInArrow(run, ", ".join(kinds) + ", state string")
    return out.withColumn("at", F.timestamp_micros("at"))


#: A time past all events; windows that begin here or later hold the mark that ends a stream, no event.
END = "2100-01-01"


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, Callable[[], None]]:
    """The events as a stream with a watermarked time ``at``, and what ends it: a mark far ahead, so that every window closes.

    Files are taken eight to a batch; events more than an hour behind the newest of the batches before are late and dropped.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may match a file as well as a folder of files; a plain path must be a folder
    marks = scratch(spark, "stream-end")
    spark.createDataFrame([], schema).write.parquet(marks)
    both = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(pattern).unionByName(spark.readStream.schema(schema).parquet(marks))

    def end() -> None:
        fixed = {"ts": F.lit(END), "event_type": F.lit("error")}
        spark.range(1).select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(marks)

    return both.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour"), end


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, end: Callable[[], None], at: str = "start") -> DataFrame:
    """All windows of a watermarked stream that is over, run in micro-batches to a table.

    In append mode a window is written once, when the watermark has passed it, and its state is dropped. All there is runs first;
    then ``end`` marks the end, and a second run from the checkpoint closes the windows still open. A batch that runs again
    writes its own folder again.
    """
    path, state = scratch(spark, name), scratch(spark, f"{name}-state")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    for last in (False, True):
        if last:
            end()
        query = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch=*").where(F.col(at) < F.lit(END))


def windowed(events: DataFrame, window: Column, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """window start and end, keys, n, total of a watermarked stream or of a table."""
    out = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    naive = lambda c: F.col(c).cast("timestamp_ntz")
    return out.select(naive("w.start").alias("start"), naive("w.end").alias("stop"), *keys, "n", "total")


def upsert_history(spark: SparkSession, stream: DataFrame, key: str, at: str, tie: str, folder: str | None = None, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """(history, current): micro-batches appended to a log, and the newest row of each key kept beside it.

    Everything that a restart needs lies in ``folder``: the log by batch, the stream's checkpoint, and the current rows in ``buckets`` of
    a hash of the key, each in a folder for the batch that last changed it. A batch reads and writes only buckets that its keys
    fall in, and of each the newest version below its own number; so a batch that failed, or a stream that was stopped, goes on as if it had not.
    """
    folder = folder or scratch(spark, "stat-upsert")
    log, current = f"{folder}/history", f"{folder}/current"
    order = [F.desc(at), F.desc(tie)]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    version_schema = T.StructType([*stream.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])

    def versions(below: int | None) -> DataFrame:
        """The newest version of each bucket (below a batch's number)."""
        rows = _table_or_empty(spark, current, version_schema)
        rows = rows if below is None else rows.where(F.col("version") < below)
        newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
        return rows.join(F.broadcast(newest), ["bucket", "version"])  # one row for each bucket

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        new = spark.read.schema(stream.schema).parquet(f"{log}/batch={number}").withColumn("bucket", bucket)
        touched = new.select("bucket").distinct()
        old = versions(number).join(F.broadcast(touched), "bucket", "left_semi").select(*stream.columns, "bucket")
        best = first_per_key(old.unionByName(new.select(*stream.columns, "bucket")), [key], order).withColumn("version", F.lit(number).cast("long"))
        written = scratch(spark, "stat-version")
        best.write.parquet(written)
        # per bucket, so that a repeated batch replaces its own version alone
        rows = spark.read.schema(version_schema).parquet(written)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(current)

    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    history = spark.read.schema(stream.schema).parquet(f"{log}/batch=*")
    return history, versions(None).select(*stream.columns)


def _table_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
