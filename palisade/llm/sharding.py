"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's shard among n comes from a short chain of jumps; the chain for n + 1 shards
has the same start, so a row either stays or goes to the new shard. No table of the
ring is kept or sent. The uniform numbers of the chain are md5 digests of key and
step, which any SQL engine can repeat.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket


#: Slots of equal rows are made this many at a time.
RUN = 65_536


def key_text(column: str) -> Column:
    """The stable key: the id as text, ``null`` for a null id."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def jump(key: Column, shards: int) -> Column:
    """Shard of ``key`` in 0 .. shards - 1.

    The expected number of jumps is 1 + ln(shards); the fold stops asking for digests
    once the chain has left the range. 64 + 4 log2(shards) steps leave no chain unfinished
    but with a chance below 2**-60; such a chain keeps its last shard, for every run alike.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    steps = min(shards, 64 + 4 * math.ceil(math.log2(shards + 1)))

    def step(at, i):
        # uniform in (0, 1]: 32 bits of the digest, plus one
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") + 1.0) / 4294967296.0
        jumped = F.floor((at["next"] + 1).cast("double") / u)
        return F.when(at["next"] >= shards, at).otherwise(
            F.struct(at["next"].alias("shard"), F.least(jumped, F.lit(float(shards))).cast("long").alias("next"))
        )

    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda at: at["shard"].cast("int"))


def shard_documents(df: DataFrame, shards: int = 16, rows_per_bucket: int = 256, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``law`` is ``key``: doc_id and the number of shards decide, so rows with equal ids share a
    shard and null ids are one key. ``size`` is the UTF-8 length plus 1 (null text: 1, crc 0).
    ``slot`` numbers the rows of a shard from 0 without gaps, in order of a digest of key, text_crc32 and size:
    rows are ranked inside small ranges of digests and shifted by the running count of the
    ranges before, so no shard is ever sorted as a whole. Rows that tie in a rank are identical. ``grown_shard`` is the shard
    among one more.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = key_text("doc_id")
    total = df.count()
    buckets = bucket(total, rows_per_bucket * shards)
    # the text has a part in the digest, so that the rows of one key (null ids, say) lie in many ranges
    row = F.concat_ws(":", key, F.lit("slot"), F.crc32(raw.cast("binary")).cast("string"), (F.octet_length(raw) + 1).cast("string"))
    place = F.conv(F.substring(F.md5(row.cast("binary")), 1, 8), 16, 10).cast("long")
    spread = F.shiftright(place * F.lit(buckets).cast("long"), 32).cast("int")
    rows = df.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        jump(key, shards).alias("shard"),
        place.alias("place"),
        spread.alias("part"),
        jump(key, shards + 1).alias("grown_shard"),
    )
    counts = df.select(jump(key, shards).alias("shard"), spread.alias("part")).groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard", "part",
        F.coalesce(F.expr("sum(n) OVER (PARTITION BY shard ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)).alias("before"),
    )
    # equal rows are counted before the shuffle and dealt out again, so that one row repeated many times fills no task
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    ranked = same.withColumn(
        "first",
        F.expr("coalesce(sum(n) OVER (PARTITION BY shard, part ORDER BY place, doc_id NULLS LAST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"),
    )
    dealt = ranked.join(before, ["shard", "part"]).select(*same.columns, (F.col("before") + F.col("first")).alias("first"))
    runs = dealt.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    slots = runs.withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("start"), F.col("first") + F.least(F.col("n"), F.col("start") + RUN) - 1)))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
