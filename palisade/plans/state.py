"""Queries of keyed streaming state, the record log and identity resolution, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity
from ..sources.log import RecordLog
from ..sources.shared import scratch
from ..sources.star import table
from ..streaming import keyed, streams
from .retrieval import _BREAKER

SLICES = 4


def _sliced(spark: SparkSession, rows: DataFrame, order: str, name: str) -> DataFrame:
    """The rows as a stream of ``SLICES`` files or more in order of a column, a slice or part of one to each batch."""
    path = scratch(spark, name)
    shares = [i / SLICES for i in range(1, SLICES)]
    bounds = rows.agg(F.percentile_approx(F.col(order).cast("double"), shares, 10_000)).collect()[0][0] or []
    number = F.lit(0)
    for b in bounds:
        number = number + (F.col(order).cast("double") > b).cast("int")
    for i in range(SLICES):  # one after the other: a file stream takes files in order of their time
        rows.where(number == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a call of its user, streamed in order of time; openings become ready for a probe by a timer."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("failed"))
    mark = spark.range(1).select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit(-1).cast(e.schema["event_id"].dataType).alias("event_id"), F.lit(streams.END).cast("timestamp").alias("at"), F.lit(False).alias("failed"))
    stream = _sliced(spark, e.unionByName(mark), "at", "calls").withWatermark("at", "1 hour")
    rows = keyed.breaker_stream(stream, "user_id", "event_id", seconds=5 * 86_400, threshold=2, reset=2 * 86_400)
    return rows.where("user_id >= 0").select("user_id", "event_id", "state")


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return keyed.session_stream(_sliced(spark, c, "turn", "turns"), "conv_id", "turn", "text")


def session_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session as the stream has left it: turns, those of the user, folded ones and the length of their fold."""
    return _sessions(spark, sf_dir)[1]


def session_stream_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn that the stream has folded, as its line."""
    return _sessions(spark, sf_dir)[0]


def _log(spark: SparkSession, sf_dir: str) -> RecordLog:
    """Events appended in three parts; then the errors of every other user deleted."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    log = RecordLog(spark, scratch(spark, "record-log"), "event_id bigint, user_id bigint, event_type string, value double", "event_id")
    for k in range(3):
        log.append(e.where(F.col("event_id") % 3 == k))
    log.delete(e.where("event_type = 'error' AND user_id % 2 = 0").select("event_id"), "event_id")
    return log


def record_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).tail(50).select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


def record_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).rows().groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def player_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of orders matched to customers as players: by number, by name and day of birth, or as new ones; how each was."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    day = lambda x: F.concat(F.lit("200"), (x % 7).cast("string"), F.lit("-01-02"))
    people = c.where(k % 2 == 0).select(
        k.alias("person_id"), F.when(k % 3 == 0, k).alias("ext_id"), F.concat(F.lit("P"), F.floor(k / 4).cast("string")).alias("name"),
        F.when(k % 5 != 0, day(k)).alias("birth_date"), F.when(k % 7 != 0, k % 5 + 2015).alias("draft_year"), F.lit("C").alias("position"),
    )
    o, q = table(spark, sf_dir, "orders"), F.col("o_custkey")
    records = o.select(
        F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, q).alias("ext_id"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("P"), F.floor(q / 4).cast("string"))).alias("name"),
        F.when(F.col("o_orderkey") % 2 == 0, day(q)).alias("birth_date"), F.year("o_orderdate").alias("draft_year"), F.lit("D").alias("position"),
    )
    return identity.resolve(people, records)[0]


QUERIES = {f.__name__: f for f in (breaker_stream, session_stream_counts, session_stream_folds, record_log_tail, record_log_rows, player_identity)}

_FOLDED = "b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)"
_LEFT = "NOT (event_type = 'error' AND user_id % 2 = 0)"
SQL = {
    "breaker_stream": _BREAKER + " UNION ALL SELECT user_id, NULL, 'half_open' FROM b WHERE state IN ('opened', 'reopened')",
    "session_stream_counts": f"""WITH {_FOLDED} SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (back > 6) AS n_folded,
        CAST(coalesce(length(string_agg(role || ': ' || text, chr(10)) FILTER (back > 6)), 0) AS BIGINT) AS folded_chars FROM b GROUP BY 1""",
    "session_stream_folds": f"WITH {_FOLDED} SELECT conv_id, turn, role || ': ' || text AS line FROM b WHERE back > 6",
    "record_log_tail": f"SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events WHERE {_LEFT} ORDER BY event_id DESC LIMIT 50",
    "record_log_rows": f"SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE {_LEFT} GROUP BY 1, 2",
}
