"""Join and listing shapes that the domain uses again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Up to n rows of each key, first in ``order``, with their place from 1."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def number_rows(df: DataFrame, by: list[str], block: Column, order: list[Column], name: str, descending: bool = False) -> DataFrame:
    """Adds ``name``: the place of each row in its group, from 1, as row_number over ``by`` in ``order`` would give it.

    ``block`` is the leading part of the order (a day, a range of values); rows are numbered within (by, block) and
    shifted by the counts of the blocks before, so a group may have any number of rows: no task sorts more than a block.
    ``descending``: higher blocks come first.
    """
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    upto = W.partitionBy(*by).orderBy(F.desc("_block") if descending else F.asc("_block")).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_at"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = rows.withColumn("_k", F.row_number().over(W.partitionBy(*by, "_block").orderBy(*order)))
    on = [F.col("_block").eqNullSafe(F.col("_at")), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]]
    return within.join(counts, on).select(*df.columns, (F.col("_before") + F.col("_k")).cast("int").alias(name))


def interval_join(rows: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, tie: str) -> DataFrame:
    """Each row with the span of its key that holds ``at``; an open end never ends.

    The key is an equality, so this is a hash or sort-merge join. Of several spans the one with the least ``tie`` is taken, once for each
    (key, at) that occurs; every row stays, repeated ones and those without a span too.
    """
    asked, s = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at")).dropna().distinct(), spans.alias("s")
    inside = (F.col("_key") == F.col(f"s.{key}")) & (F.col("_at") >= F.col(f"s.{start}")) & (F.col(f"s.{end}").isNull() | (F.col("_at") <= F.col(f"s.{end}")))
    found = asked.join(s, inside).groupBy("_key", "_at").agg(F.min(f"s.{tie}").alias(tie))
    return rows.join(found, (F.col(key) == F.col("_key")) & (F.col(at) == F.col("_at")), "left").select(*rows.columns, tie)


def missing_from(rows: DataFrame, others: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Rows that match none of the others: one anti join for each branch of the condition."""
    for other, condition in others:
        rows = rows.join(other, condition, "left_anti")
    return rows


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """A page of the ordered rows and the number of all rows on each."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """Current rows merged with incoming ones by key.

    Policies of a column: ``keep`` the old value unless null, ``replace`` by the new one where
    there is a new row, ``replace_if_not_null``. Each side has a key at most once.
    """
    c = current.alias("c").withColumn("_old", F.lit(True)).alias("c")
    n = incoming.alias("n").withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = c.join(n, on, "full_outer")
    out = [F.coalesce(F.col(f"n.{k}"), F.col(f"c.{k}")).alias(k) for k in keys]
    for name in current.columns:
        if name in keys:
            continue
        old, new = F.col(f"c.{name}"), F.col(f"n.{name}")
        kind = policy.get(name, "replace")
        value = {"keep": F.coalesce(old, new), "replace_if_not_null": F.coalesce(new, old), "replace": F.when(F.col("n._new"), new).otherwise(old)}[kind]
        out.append(value.alias(name))
    return joined.select(*out)


def replace_keys(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` in place of all current rows with their keys."""
    return current.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)
