"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be copied ratio = target / source size times. The
whole part is taken as it is; the fractional parts are rounded together: two documents
with fractions between 0 and 1 trade mass, each weighed by its size so that the words
taken stay the same, until one of them is 0 or 1. Which way the trade goes is random,
with the odds that keep each document's expectation. A block of documents ends with at
most one open fraction; the open ones of many blocks meet in the next level of a tree,
until a source has one left, which is rounded alone. A source so misses its target by
less than one document.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty, words_of, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)


def n_words(text: str = "text"):
    return F.size(words_of(text_or_empty(text))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """source, weight, n_docs, source_size, target, ratio: one row per source, null source last.

    The total is ``share`` of all sizes, dealt by weight; a source stops at ``most``
    times its size and the others share the excess by weight, until none is above.
    That is target = min(most * size, level * weight); each round below is one sum over
    the table of sources. Sizes are whole numbers, so the level is exact.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    names = written(totals, "mix-sources")
    ordered = names.orderBy(F.col("source").asc_nulls_last())
    schema = T.StructType(names.schema.fields + [T.StructField("weight", T.LongType())])
    ranked = spark.createDataFrame(
        ordered.rdd.zipWithIndex().map(lambda x: (*x[0], weights[x[1] % len(weights)])), schema
    )
    sources = written(ranked, "mix-weights")
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).collect()[0]
    total, level = share * (whole["size"] or 0), Fraction(0)
    capped_size, capped_weight = -1, -1
    if whole["weight"] and whole["size"]:
        level = total / whole["weight"]
        while True:
            full = F.col("source_size").cast("decimal(38,0)") * most * level.denominator <= F.col("weight").cast("decimal(38,0)") * level.numerator
            row = sources.where(full).agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).collect()[0]
            if (row["s"], row["w"]) == (capped_size, capped_weight) or row["w"] == whole["weight"]:
                break
            capped_size, capped_weight = row["s"], row["w"]
            level = (total - most * capped_size) / (whole["weight"] - capped_weight)
    target = F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.lit(float(level)))
    return sources.withColumn("target", target).withColumn(
        "ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def _uniform(*parts) -> float:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big") / 2.0**64


def _pivot(a: tuple, b: tuple, u: float) -> tuple[float, float]:
    """New fractions of two (fraction, size) with the same total of fraction * size; one is 0 or 1."""
    (p, s), (q, t) = a, b
    up = min((1 - p) * s, q * t)  # most that a may gain from b
    down = min(p * s, (1 - q) * t)
    moved = up if u * (up + down) < down else -down
    p, q = p + moved / s, q - moved / t
    # the end that stopped the trade is exact, whatever the division made of it
    if moved > 0:
        return (1.0, q) if (1 - a[0]) * s <= b[0] * t else (p, 0.0)
    return (0.0, q) if a[0] * s <= (1 - b[0]) * t else (p, 1.0)


_EPS = 1e-9


def _settle(f: float) -> float:
    return 0.0 if f < _EPS else 1.0 if f > 1 - _EPS else f


def _rounding(seed: int, last: bool):
    """mapInArrow over rows sorted by group: settles mix_fraction, one open row at most per group.

    Only the open row of a group is held between batches. ``last``: it is rounded alone.
    """

    def close(row, copies, fraction):
        names = row.schema.names
        for name, value, kind in (("mix_copies", copies, pa.int64()), ("mix_fraction", fraction, pa.float64())):
            row = row.set_column(names.index(name), name, pa.array([value], kind))
        return row

    def run(batches):
        held = None  # (group, key, fraction, size, copies, row)

        def end(h):
            f = h[2]
            if last and f is not None:
                return close(h[5], h[4] + (_uniform(seed, "last", h[1]) < f), None)
            return close(h[5], h[4], f)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(n).to_pylist() for n in ("mix_group", "mix_key", "mix_fraction", "mix_size", "mix_copies")}
            copies, fractions, keep, out = list(cols["mix_copies"]), [None] * batch.num_rows, [True] * batch.num_rows, []
            at = None  # row of this batch that is held
            for i in range(batch.num_rows):
                group, key, f, size = cols["mix_group"][i], cols["mix_key"][i], cols["mix_fraction"][i], cols["mix_size"][i]
                if held is not None and held[0] != group:
                    if at is None:
                        out.append(end(held))
                    else:
                        f0 = held[2]
                        if last:
                            copies[at] = held[4] + (_uniform(seed, "last", held[1]) < f0)
                        else:
                            fractions[at] = f0
                    held, at = None, None
                f = _settle(f)
                if f in (0.0, 1.0):
                    copies[i] += int(f)
                    continue
                if held is None:
                    held, at = (group, key, f, size, copies[i], None), i
                    continue
                p, q = map(_settle, _pivot((held[2], held[3]), (f, size), _uniform(seed, held[1], key)))
                if p in (0.0, 1.0):  # the held row is settled
                    if at is None:
                        out.append(close(held[5], held[4] + int(p), None))
                    else:
                        copies[at] += int(p)
                    held, at = None, None
                else:
                    held = (group, held[1], p, held[3], held[4], held[5])
                if q in (0.0, 1.0):
                    copies[i] += int(q)
                else:
                    held, at = (group, key, q, size, copies[i], None), i
            if at is not None:
                keep[at] = False
                held = (*held[:5], batch.slice(at, 1))
            names = batch.schema.names
            done = batch.set_column(names.index("mix_copies"), "mix_copies", pa.array(copies, pa.int64()))
            done = done.set_column(names.index("mix_fraction"), "mix_fraction", pa.array(fractions, pa.float64()))
            yield done.filter(pa.array(keep)) if at is not None else done
            yield from out
        if held is not None:
            yield end(held)

    return run


def mix(
    df: DataFrame, seed: int = 42, block_rows: int = 64, fan_in: int = 64, text: str = "text", keep: list[str] | None = None, **how
) -> DataFrame:
    """Every row of ``df``, its columns ``keep`` (all if None), with mix_size, mix_source_size, mix_target and mix_copies added.

    Blocks follow from source and a hash of doc_id and text, never from the cluster, so
    reruns agree. Null text: size 0. Null source: a source of its own, the last. Sizes of 0 add no words
    and get no copies of their fraction (they keep the whole part). Repeated rows draw apart but
    may swap. An empty table gives an empty table. Own columns named as an added one give way to it.
    """
    rows = _rounded(df, df.columns if keep is None else keep, seed, block_rows, fan_in, text, **how)
    own = [c for c in (df.columns if keep is None else keep) if c not in ADDED]
    return rows.select(*[F.col("palisade_row")[c].alias(c) for c in own], *ADDED)


ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def _rounded(df: DataFrame, own: list[str], seed: int, block_rows: int, fan_in: int, text: str, **how) -> DataFrame:
    """palisade_row (the own columns as a struct, so no name can clash) and the added columns."""
    text_key = text_or_empty(text)
    sized = df.select(F.col("source").cast("string").alias("source"), n_words(text).alias("size"))
    sources = source_targets(sized, **how)
    most = sources.agg(F.max("n_docs")).collect()[0][0] or 0
    s = sources.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("mix_source"), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), F.col("ratio").alias("mix_ratio"), F.col("n_docs").alias("mix_n"),
    )
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("palisade_row"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("mix_source"),
        n_words(text).alias("mix_size"),
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64(text_key))).alias("mix_key"),
    )
    rows = rows.join(s, "mix_source")
    whole = F.floor("mix_ratio")
    block = F.pmod(F.xxhash64("mix_key", F.lit(seed)), F.greatest(F.lit(1), F.ceil(F.col("mix_n") / block_rows)))
    rows = rows.select(
        "palisade_row", "mix_source", "mix_size", "mix_source_size", "mix_target", "mix_key", whole.cast("long").alias("mix_copies"),
        F.when(F.col("mix_size") > 0, F.col("mix_ratio") - whole).otherwise(F.lit(0.0)).alias("mix_fraction"), block.cast("long").alias("mix_block"),
    )
    group = F.concat_ws("/", "mix_source", F.col("mix_block").cast("string"))

    def level(frame, last):
        grouped = frame.withColumn("mix_group", group)
        dealt = grouped.repartition("mix_group").sortWithinPartitions("mix_group", "mix_key", "mix_size")
        return dealt.mapInArrow(_rounding(seed, last), dealt.schema).drop("mix_group")

    blocks = max(1, -(-most // block_rows))
    settled, open_rows = [], rows
    while blocks > 1:
        now = written(level(open_rows, last=False), "mix-level")
        settled.append(now.where("mix_fraction IS NULL"))
        open_rows = now.where("mix_fraction IS NOT NULL").withColumn("mix_block", F.floor(F.col("mix_block") / fan_in).cast("long"))
        blocks = -(-blocks // fan_in)
    out = level(open_rows, last=True)
    for x in settled:
        out = out.unionByName(x)
    return out.select("palisade_row", *ADDED)


def mixed(df: DataFrame, seed: int = 42, block_rows: int = 64, fan_in: int = 64, text: str = "text", **how) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken, columns as they were."""
    out = _rounded(df, df.columns, seed, block_rows, fan_in, text, **how)
    copies = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return out.select("palisade_row", F.explode(copies)).select("palisade_row.*")
