"""Exact duplicates by a split of heavy hitters.

Texts are compared by the SHA-256 of their normalised form. Misra-Gries summaries, one per
partition and merged in a tree, name at most ``counters`` digests, among them every one with
more than rows / (counters + 1) copies. A second pass counts those exactly and finds the row
that stays; the verified ones are broadcast, and their copies are marked where they are read.
The other digests have few copies each and meet in an ordinary shuffle of digests; texts are
never shuffled.
"""

from __future__ import annotations

import pickle
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, text_or_empty, written

#: Digests that a summary names: 32 bytes and a count each, 200 kB at most.
COUNTERS = 4096
#: A winner whose id is longer is left to the shuffle, so the broadcast has at most COUNTERS * (LONGEST_ID + 100) bytes.
LONGEST_ID = 1024


def digest_of(text: str = "text") -> Column:
    """SHA-256 (32 bytes) of a text with every run of white space made one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), SPACE_CLASS + "+", " ").cast("binary"), 256))


def trim(counts: Counter, counters: int) -> Counter:
    """At most ``counters`` entries: the largest count that would not fit is taken from all (mergeable Misra-Gries)."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: n - cut for k, n in counts.items() if n > cut})


def frequent_digests(digests: DataFrame, counters: int = COUNTERS, fan_in: int = 16) -> list[bytes]:
    """At most ``counters`` values of the one binary column, with all that occur more than rows / (counters + 1) times."""

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = trim(counts, counters)
        yield pa.RecordBatch.from_pydict({"summary": [pickle.dumps(counts)]})

    def merge(parts):
        counts: Counter = Counter()
        for x in parts:
            counts.update(pickle.loads(x))
            counts = trim(counts, counters)
        return pickle.dumps(counts)

    summaries = digests.mapInArrow(summarise, "summary binary").rdd.map(lambda r: bytes(r[0]))
    while summaries.getNumPartitions() > fan_in:
        summaries = summaries.repartition(-(-summaries.getNumPartitions() // fan_in)).mapPartitions(lambda it: [merge(it)])
    return sorted(pickle.loads(merge(summaries.mapPartitions(lambda it: [merge(it)]).collect())))


def mark_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``df``, other columns are not read.

    Of equal texts the row with the smallest id stays, null ids last; of equal ids the first that was read, so exactly one row
    of a group is kept. Null and empty texts are one group, apart from texts of white space alone (one space). No rows give none.
    """
    spark = df.sparkSession
    rows = written(df.select(F.col(doc_id).alias("doc_id"), digest_of(text).alias("digest"), F.monotonically_increasing_id().alias("row")), "dedup-digests")
    total = rows.count()
    candidates = spark.createDataFrame([(bytearray(x),) for x in frequent_digests(rows.select("digest"), counters)], "digest binary")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    counted = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), first)
    short = F.coalesce(F.octet_length(F.col("first.doc_id").cast("string")), F.lit(0)) <= LONGEST_ID
    winners = F.broadcast(written(counted.where((F.col("group_size") * (counters + 1) > total) & short), "dedup-winners"))  # counters rows at most
    heavy = rows.join(winners, "digest")
    same = "rows between unbounded preceding and unbounded following"
    tail = rows.join(winners.select("digest"), "digest", "left_anti").select(
        "*",
        F.expr(f"count(*) over (partition by digest {same})").alias("group_size"),
        F.expr(f"min(struct(doc_id is null as none, doc_id, row)) over (partition by digest {same})").alias("first"),
    )
    return heavy.unionByName(tail).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; of equal texts under one id any one row stays."""
    stay = mark_copies(df, text, doc_id, counters).where("kept").select(F.col("doc_id").alias("palisade_id"), F.unhex("text_sha256").alias("palisade_stay"))
    own = df.withColumn("palisade_digest", digest_of(text))
    found = own.join(stay, (F.col("palisade_digest") == F.col("palisade_stay")) & own[doc_id].eqNullSafe(F.col("palisade_id")), "left_semi")
    return found.dropDuplicates(["palisade_digest"]).drop("palisade_digest")
