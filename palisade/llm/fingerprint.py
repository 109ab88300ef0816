"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

A text is the multiset of its paragraphs; paragraphs longer than a bound are cut at
sentence ends, so one edit changes few members. Each member is hashed to a wide vector
and the fingerprint is the lane-wise sum modulo a power of two: a member can be added or
taken away without the others, and their order does not matter. The vector has one lane
that counts members, 8 full lanes modulo 2**32 for equality, and 256 signed lanes modulo 2**32, to
one of which each occurrence of a member adds 1 or -1: the first, the second and further ones go each their own way. The sum of the
squares of those lanes estimates how many members there are, that of the lanes of a difference how many differ, within
9 % (one standard error); a member that is there k times counts k times, up to 2**31 of them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, text_or_empty

FULL, SIGNED = 8, 256
#: Members are at most about this long; cuts depend on the content near them, and only in 16 * LONG characters without
#: any cut on where the last one was.
LONG = 160
_SENTENCE = re.compile(r"(?<=[.!?,;|]) ")
_FINER = re.compile(r"(?<=[aeiou]) ")


def cuts(piece: str, around: int = 8) -> list[int]:
    """Where a long piece without sentences is cut: where a hash of the ``around`` characters before says so, one place in ``LONG``."""
    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = np.zeros(len(codes) - around + 1, np.uint64)
    for k in range(around):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
    found = (np.flatnonzero((h >> np.uint64(32)) % np.uint64(LONG) == 0) + around).tolist()
    out = [0]
    for end in [*found, len(piece)]:
        while end - out[-1] > 16 * LONG:
            out.append(out[-1] + LONG)
        if end - out[-1] >= around:
            out.append(end)
    return [*out[:-1], len(piece)] if len(out) > 1 else [0, len(piece)]


def members(text: str) -> list[str]:
    """The paragraphs of a text, long ones cut; an empty text has none."""
    if not text:
        return []
    out = []
    for line in text.split("\n"):
        if len(line) <= LONG:
            out.append(line)
            continue
        for part in _SENTENCE.split(line):
            for piece in [part] if len(part) <= LONG else _FINER.split(part):
                if len(piece) <= 4 * LONG:
                    out.append(piece)
                else:
                    at = cuts(piece)
                    out += [piece[a:b] for a, b in zip(at, at[1:], strict=False)]
    return out


def digest(member: str) -> bytes:
    return hashlib.blake2b(member.encode("utf-8", "surrogatepass"), digest_size=4 * FULL).digest()


class Fingerprint:
    """Vector of a multiset of members; adds and removes members, prints as hexadecimal digits."""

    __slots__ = ("count", "full", "signed")

    def __init__(self):
        self.count, self.full, self.signed = 0, np.zeros(FULL, np.uint32), np.zeros(SIGNED, np.int32)

    def change(self, digests: list[bytes], sign: int = 1, held: Mapping[bytes, int] | None = None) -> Fingerprint:
        """Adds (or, with sign -1, removes) the members with these digests.

        ``held`` has, for members that repeat, how many of each are there already: an added one is the next occurrence, a removed one the last. Without
        it, those added are the first ones, and those removed the only ones.
        """
        if digests:
            counts = Counter(digests)
            rows = np.frombuffer(b"".join(counts), "<u4").reshape(-1, FULL)
            times = np.fromiter(counts.values(), np.int64, len(counts))
            first = np.zeros(len(counts), np.int64)
            if held:
                first = np.fromiter((held.get(d, 0 if sign > 0 else k) - (0 if sign > 0 else k) for d, k in counts.items()), np.int64, len(counts))
            full = (rows.astype(np.uint64) * times[:, None].astype(np.uint64)).sum(axis=0).astype(np.uint32)
            of = np.repeat(np.arange(len(times)), times)
            number = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + first[of]
            z = (rows[of, 0].astype(np.uint64) << np.uint64(32) | rows[of, 1]) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
            z ^= z >> np.uint64(31)
            one = 1.0 - 2.0 * ((z >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
            signed = np.bincount((z % np.uint64(SIGNED)).astype(np.int64), weights=one, minlength=SIGNED).astype(np.int32)
            self.full = self.full + full if sign > 0 else self.full - full
            self.signed = self.signed + signed if sign > 0 else self.signed - signed
            self.count = (self.count + sign * len(digests)) % 2**32
        return self

    def __str__(self) -> str:
        narrow = -(1 << 15) <= self.signed.min() and self.signed.max() < 1 << 15  # the length tells which
        return (self.count.to_bytes(4, "little") + self.full.astype("<u4").tobytes() + self.signed.astype("<i2" if narrow else "<i4").tobytes()).hex()

    def likeness(self, other: Fingerprint) -> float:
        """Estimated share of members that both have alike among those that either has, 1 for equal multisets."""
        if self.count == other.count and np.array_equal(self.full, other.full):
            return 1.0
        squares = lambda lanes: float((lanes.astype(np.float64) ** 2).sum())
        both, apart = squares(self.signed) + squares(other.signed), max(1.0, squares(self.signed - other.signed))
        return max(0.0, min(1.0, (both - apart) / max(both + apart, 1.0)))


def fingerprint(text: str) -> Fingerprint:
    return Fingerprint().change([digest(x) for x in members(text)])


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many from the start of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _order_key(doc_id, digest, salt) -> tuple:
    """Ascending where the documents descend: null ids come last of all, so first here."""
    return (doc_id is not None, doc_id, digest, salt)


def with_follower(df: DataFrame, rows_per_bucket: int = 64, most_buckets: int = 1 << 17) -> DataFrame:
    """Rows (bucket, guest, doc_id, text, digest, salt) such that, sorted by bucket, guest and descending doc_id, digest and salt,
    each own row is followed by the next document of the whole table.

    Buckets are ranges of (doc_id, digest of the text, number of the row), so neither equal nor null ids nor equal rows have to share
    one. Their bounds come from a sample of keys, at most 8 for each of ``most_buckets``; bounds and first keys of buckets, some
    50 bytes each, reach the driver and the workers, texts never do. The first row of each bucket goes along as
    a guest to the bucket before; the table's first row to the last bucket. No bucket is held in memory.
    """
    spark = df.sparkSession
    rows = df.count()
    n = min(most_buckets, bucket(rows, rows_per_bucket))
    keyed = df.select(
        "doc_id", "text", F.xxhash64("text").alias("digest"), F.pmod(F.monotonically_increasing_id(), F.lit(1021)).cast("int").alias("salt")
    )
    keys = keyed.select("doc_id", "digest", "salt")
    sample = keys.sample(min(1.0, 8 * n / rows), 42).collect() if n > 1 else []
    ordered = sorted(_order_key(*r) for r in sample)
    bounds = sorted({ordered[i * len(ordered) // n] for i in range(1, n)}) if ordered else []
    shared = spark.sparkContext.broadcast(bounds)

    def keys_of(*columns):
        return map(_order_key, *(c.to_pylist() for c in columns))

    @F.arrow_udf("int")
    def bucket_of(doc_id: pa.Array, digest: pa.Array, salt: pa.Array) -> pa.Array:
        found = shared.value
        return pa.array([bisect.bisect_right(found, key) for key in keys_of(doc_id, digest, salt)], pa.int32())

    placed = keyed.withColumn("bucket", bucket_of("doc_id", "digest", "salt"))
    own_key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "digest", "salt")
    heads = sorted(placed.groupBy("bucket").agg(F.max(own_key).alias("head")).collect(), key=lambda r: -r["bucket"])
    before = {_order_key(*r["head"][1:]): heads[i - 1]["bucket"] for i, r in enumerate(heads)}
    guests = spark.sparkContext.broadcast(before)

    @F.arrow_udf("int")
    def guest_of(doc_id: pa.Array, digest: pa.Array, salt: pa.Array) -> pa.Array:
        found = guests.value
        return pa.array([found.get(key, -1) for key in keys_of(doc_id, digest, salt)], pa.int32())

    to = guest_of("doc_id", "digest", "salt")
    own = F.struct("bucket", F.lit(False).alias("guest"))
    guest = F.when(F.col("to") >= 0, F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest")))
    sent = placed.withColumn("to", to).select("doc_id", "text", "digest", "salt", F.explode(F.array_compact(F.array(own, guest))).alias("to"))
    return sent.select("to.bucket", "to.guest", "doc_id", "text", "digest", "salt")


def fingerprint_documents(df: DataFrame, text: str = "text", **how) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row.

    Next: by descending doc_id (of any type that Spark can order), null ids last, equal ids by descending xxhash64 of the text;
    after the last comes the first. A table of one row follows itself. Null texts count as empty: no members, a fingerprint of
    zeros. ``df`` is read three times and must give its rows alike each time, as a table does; a bucket that has lost its
    follower stops the job.
    """
    rows = with_follower(df.select("doc_id", text_or_empty(text).alias("text")), **how)
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), F.desc("digest"), F.desc("salt"))
    dealt = dealt.select("bucket", "guest", "doc_id", "text")

    def run(batches):
        last = None  # (bucket, doc_id, text, fingerprint, digests) that waits for its follower
        lost = "a bucket has lost its follower: the table differs between two readings"
        for batch in batches:
            out = {x: [] for x in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for b, guest, doc_id, t in zip(*(batch.column(x).to_pylist() for x in ("bucket", "guest", "doc_id", "text")), strict=True):
                if guest and (last is None or last[0] != b):
                    continue  # a further guest
                parts = members(t)
                digests = {x: digest(x) for x in set(parts)}
                fp = Fingerprint().change([digests[x] for x in parts])
                if last is not None and last[0] == b:
                    _, own_id, own, own_fp, own_digests = last
                    new = edited(own, t)
                    known = digests | own_digests
                    new_fp = Fingerprint().change([known.get(x) or digest(x) for x in members(new)])
                    values = (own_id, len(own), hashlib.sha256(new.encode()).hexdigest(), str(own_fp), str(new_fp), own_fp.likeness(new_fp), own_fp.likeness(fp))
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
                elif last is not None:
                    raise ValueError(lost)
                last = None if guest else (b, doc_id, t, fp, digests)
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))
        if last is not None:
            raise ValueError(lost)

    kind = df.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(
        run,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
