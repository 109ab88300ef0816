"""Taking records in: seeds, backfills, logs."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import first_per_key


def seeded(existing: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """The incoming class in place of the existing one if that is empty or ``force`` is set, else the existing one."""
    if force:
        return incoming.select(*existing.columns)
    there = existing.agg((F.count("*") > 0).alias("_there"))
    new = incoming.select(*existing.columns).crossJoin(F.broadcast(there)).where(~F.col("_there")).drop("_there")
    return existing.unionByName(new)


def first_seen(parts: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """Rows of several lists, each key from the first list that has it and there the first in ``order``."""
    union = reduce(DataFrame.unionByName, [p.withColumn("_list", F.lit(i)) for i, p in enumerate(parts)])
    return first_per_key(union, [key], [F.col("_list"), *order]).drop("_list")


def fill_missing(rows: DataFrame, seasons: DataFrame, key: str, year: str, value: str, games: str) -> DataFrame:
    """``value`` and ``games`` of the rows that lack a value, from ``seasons`` (key, season code, games, points); other rows stay.

    The season that ends in the row's year, else the latest that ended by then, else zeros.
    """
    missing = rows.where(F.col(value).isNull() & F.col(key).isNotNull())
    asked = missing.select(F.col(key).alias("_key"), F.col(year).alias("_year")).distinct()
    code = (F.col("_year") - 1) * 10000 + F.col("_year")
    s = seasons.select(F.col(key).alias("_of"), "season", F.col("games").alias("_games"), F.col("points").alias("_points"))
    found = asked.join(s, (F.col("_key") == F.col("_of")) & (F.col("season") % 10000 <= F.col("_year")))
    best = F.max_by(F.struct("_games", "_points"), F.struct((F.col("season") == code).alias("exact"), "season", "_games", "_points"))
    chosen = found.groupBy("_key", "_year").agg(best.alias("_s"))  # once for each key and year, so repeated rows stay
    joined = missing.join(chosen, (F.col(key) == F.col("_key")) & (F.col(year) == F.col("_year")), "left")
    rate = F.when(F.col("_s").isNotNull(), F.when(F.col("_s._games") > 0, F.round(F.col("_s._points") / F.col("_s._games"), 2))).otherwise(0.0)
    filled = joined.withColumns({value: rate, games: F.coalesce("_s._games", F.lit(0)).cast(rows.schema[games].dataType)}).select(*rows.columns)
    return filled.unionByName(rows.where(F.col(value).isNotNull() | F.col(key).isNull()))


def insert_missing(existing: DataFrame, incoming: DataFrame, branches: list[tuple[list[str], Callable[[DataFrame, DataFrame], Column]]]) -> DataFrame:
    """``existing`` and the distinct incoming rows that match none of it, by any branch: (columns of ``existing`` that it reads, its condition).

    One anti join for each, against the different values of those columns, so a row is held against a value once however many rows have it.
    """
    new = incoming.distinct()
    for columns, match in branches:
        e = existing.select(*columns).distinct().alias("e")
        new = new.alias("n").join(e, match(e, new), "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def set_where_null(rows: DataFrame, source: DataFrame, on: list[str], column: str) -> DataFrame:
    """``column`` from the source where the rows have none."""
    s = source.select(*on, F.col(column).alias("_new"))
    return rows.join(s, on, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new").select(*rows.columns)


def _is_record(lines: pa.Array) -> pa.Array:
    """Whether a line is one JSON object and nothing else; Spark's parser stops at the object's end and takes what follows for granted."""

    def good(line):
        try:
            return isinstance(json.loads(line), dict)
        except (TypeError, ValueError):
            return False

    return pa.array(map(good, lines.to_pylist()), pa.bool_())


def read_lines(spark: SparkSession, path: str, schema: T.StructType, n: int, order: str) -> DataFrame:
    """The ``n`` newest records of a file of JSON lines, newest first; lines that are no record, or whose fields are of other types, are left out."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = spark.read.text(path).where(F.arrow_udf(_is_record, T.BooleanType())("value")).select(F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where(F.col("r._bad").isNull() & F.col(f"r.{order}").isNotNull()).select("r.*").drop("_bad").orderBy(F.desc(order)).limit(n)


def fold_log(log: DataFrame, session: str, order: str, text: str, summaries: DataFrame, keep: int) -> DataFrame:
    """The log without the turns that summaries stand for, and the summaries before the ``keep`` turns left.

    ``summaries``: session, n_folded, summary. Deleted turns are found by their place from the end, as they were folded.
    """
    back = F.row_number().over(W.partitionBy(session).orderBy(F.desc(order)))
    left = log.withColumn("_back", back).where(F.col("_back") <= keep).drop("_back")
    first = summaries.select(session, F.lit(-1).cast(log.schema[order].dataType).alias(order), F.lit("system").alias("role"), F.col("summary").alias(text))
    return left.select(session, order, "role", text).unionByName(first)
