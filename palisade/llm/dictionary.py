"""A table of the distinct words of a corpus, and lookups in it for every word of every text.

The table is dealt in buckets by a hash of the word. Words travel packed: one row holds
the words that one task has for one bucket, so a word costs a few bytes of shuffle and a
task sends each of its words once. Lookups go two ways: the most frequent words (a fixed
number of them, none long) are sent to every worker; the others are asked for by blocks of documents, each
block asking each bucket once, and the answers meet the block's documents again.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST, merged, written

#: Words that every worker holds: with at most ``LONGEST`` bytes each, 17 MB of text.
FREQUENT = 262_144
#: Entries of a task's running count or of a block's rare words before they are passed on, and their bytes.
BOUND, BOUND_BYTES = 500_000, 32 << 20
BLOCK_RARE, BLOCK_WORDS, CHUNK = 60_000, 1_000_000, 128
#: Distinct words of a bucket, about; a block asks for ``ASKED`` words of each bucket, up to ``MOST_RARE`` in all.
BUCKET_WORDS, ASKED, MOST_RARE = 32_768, 192, 1_000_000
#: Words that a task holds while it samples their hashes.
SET_WORDS = 20_000
#: Words of one row of the table, and their bytes unless it is one word.
ROW_WORDS, ROW_BYTES = 16_384, 4 << 20
_LEVELS = 4096


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned whole numbers as compressed byte planes."""
    v = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def unpack_numbers(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def pack_words(words: list[bytes]) -> bytes:
    lengths = pack_numbers(np.fromiter(map(len, words), np.uint64, len(words)))
    return len(lengths).to_bytes(4, "little") + lengths + zlib.compress(b"".join(words), 1)


def word_lengths(blob: bytes) -> np.ndarray:
    """Bytes of each word of ``pack_words``."""
    return unpack_numbers(blob[4 : 4 + int.from_bytes(blob[:4], "little")]).astype(np.int64)


def unpack_words(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    ends = np.cumsum(unpack_numbers(blob[4 : 4 + n])).astype(np.int64).tolist()
    raw = zlib.decompress(blob[4 + n :])
    return [raw[s:e] for s, e in zip([0, *ends], ends)]


class Ragged:
    """Arrays of numbers end to end."""

    def __init__(self, lengths: np.ndarray, flat: np.ndarray):
        self.lengths, self.flat = np.asarray(lengths, np.int64), flat
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def of(cls, rows: list, kind=np.int64) -> Ragged:
        return cls(np.fromiter(map(len, rows), np.int64, len(rows)), np.fromiter((x for r in rows for x in r), kind))

    def take(self, at: np.ndarray) -> Ragged:
        """The rows at these places."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return Ragged(lengths, self.flat[places])

    def join(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.lengths, other.lengths]), np.concatenate([self.flat, other.flat]))

    def packed(self) -> bytes:
        lengths = pack_numbers(self.lengths)
        return len(lengths).to_bytes(4, "little") + lengths + pack_numbers(self.flat)

    @classmethod
    def unpacked(cls, blob: bytes, kind=np.int64) -> Ragged:
        n = int.from_bytes(blob[:4], "little")
        return cls(unpack_numbers(blob[4 : 4 + n]), unpack_numbers(blob[4 + n :]).astype(kind))


def bucket_of(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def by_bucket(words: list[bytes], at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its words) for every bucket that has any; ``at`` has the bucket of each word."""
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(at[part[0]]), part


def distinct_words(texts: DataFrame, split: Callable[[bytes], list[bytes]], share: int = 256) -> int:
    """About how many distinct words all ``texts`` (one binary column) have: those are counted whose hash is a multiple of ``share``."""

    def run(batches):
        sampled: set[int] = set()
        found: set[bytes] = set()

        def settle():
            sampled.update(h for h in map(zlib.crc32, found) if h % share == 0)
            found.clear()

        for batch in batches:
            for x in batch.column(0):
                found.update(split(x.as_py()))
                if len(found) > SET_WORDS:  # a worker keeps what it once took, so the set stays small
                    settle()
            if len(sampled) > SET_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(sampled, pa.int64())], names=["h"])
                sampled.clear()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(sampled, pa.int64())], names=["h"])

    return share * texts.mapInArrow(run, "h bigint").distinct().count()


def word_table(texts: DataFrame, split: Callable[[bytes], list[bytes]], values: Callable[[list[bytes], np.ndarray], Ragged], buckets: int) -> DataFrame:
    """bucket, words, counts, answers: the distinct words of all ``texts`` (one binary column), packed.

    ``split`` gives a text's words, ``values`` the numbers to store for a list of words and
    their counts; it sees each distinct word once. Every word is in one row.
    """

    def count(batches):
        counts: Counter = Counter()

        def rows():
            words = list(counts)
            numbers = np.fromiter(counts.values(), np.uint64, len(words))
            got = [(b, pack_words([words[i] for i in part]), pack_numbers(numbers[part])) for b, part in by_bucket(words, bucket_of(words, buckets))]
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in got], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "words", "counts"]
            )

        read = 0
        for batch in batches:
            for x in batch.column(0):
                raw = x.as_py()
                counts.update(split(raw))
                read += len(raw)
                if len(counts) > BOUND or read > BOUND_BYTES and sum(map(len, counts)) > BOUND_BYTES:
                    yield rows()
                    read = 0
                elif read > BOUND_BYTES:
                    read = 0
        yield rows()

    def gather(batches):
        counts: Counter = Counter()

        def rows(b):
            words, i = sorted(counts), 0
            while i < len(words):
                sizes = np.cumsum(np.fromiter(map(len, words[i : i + ROW_WORDS]), np.int64))
                part = words[i : i + max(1, int(np.searchsorted(sizes, ROW_BYTES, side="right")))]
                i += len(part)
                numbers = np.fromiter((counts[w] for w in part), np.uint64, len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in (pack_words(part), pack_numbers(numbers), values(part, numbers).packed()))],
                    names=["bucket", "words", "counts", "answers"],
                )
            counts.clear()

        now = None
        for batch in batches:
            for b, words, numbers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != now and now is not None:
                    yield from rows(now)
                now = b
                for w, n in zip(unpack_words(words), unpack_numbers(numbers).tolist(), strict=True):
                    counts[w] += n
        if now is not None:
            yield from rows(now)

    sent = texts.mapInArrow(count, "bucket int, words binary, counts binary").repartition("bucket").sortWithinPartitions("bucket")
    return written(sent.mapInArrow(gather, "bucket int, words binary, counts binary, answers binary"), "dictionary")


def totals(table: DataFrame) -> tuple[int, int]:
    """(sum of all counts, number of distinct words)."""

    def run(batches):
        for batch in batches:
            got = [unpack_numbers(x.as_py()) for x in batch.column("counts")]
            yield pa.RecordBatch.from_pydict({"n": [int(sum(x.sum(dtype=np.int64) for x in got))], "v": [sum(map(len, got))]})

    row = table.select("counts").mapInArrow(run, "n bigint, v bigint").agg(F.sum("n"), F.sum("v")).collect()[0]
    return row[0] or 0, row[1] or 0


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts below 4096 as they are, larger ones by their logarithm: few numbers, same order."""
    c = counts.astype(np.float64)
    return np.where(c < _LEVELS, c, _LEVELS + np.floor(np.log2(np.maximum(c, 1) / _LEVELS) * 16)).astype(np.int64)


def frequent_words(table: DataFrame, size: int = FREQUENT) -> tuple[list[bytes], Ragged]:
    """The words of highest count that are not longer than ``LONGEST``, as many whole levels of counts as fit in ``size``,
    most frequent first, and their answers."""

    def short(words, counts):
        numbers = unpack_numbers(counts)
        return numbers, word_lengths(words) <= LONGEST

    def histogram(batches):
        import pickle

        total = np.zeros(_LEVELS + 1024)
        for batch in batches:
            for words, counts in zip(batch.column("words"), batch.column("counts"), strict=True):
                numbers, fits = short(words.as_py(), counts.as_py())
                total += np.bincount(_levels(numbers[fits]), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"part": [pickle.dumps((total,))]})

    got = merged(table.select("words", "counts").mapInArrow(histogram, "part binary"))
    if got is None:
        return [], Ragged.of([])
    above = np.cumsum(got[0][::-1])[::-1]  # words at this level or higher
    least = int(np.argmax(above <= size)) if (above <= size).any() else len(above)

    def pick(batches):
        for batch in batches:
            for words, counts, answers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                numbers, fits = short(words, counts)
                places = np.flatnonzero((_levels(numbers) >= least) & fits)
                if len(places):
                    all_words = unpack_words(words)
                    chosen = [all_words[i] for i in places.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], pa.binary()) for x in (pack_words(chosen), pack_numbers(numbers[places]), Ragged.unpacked(answers).take(places).packed())],
                        names=["words", "counts", "answers"],
                    )

    rows = table.select("words", "counts", "answers").mapInArrow(pick, "words binary, counts binary, answers binary").collect()
    words = [w for r in rows for w in unpack_words(bytes(r[0]))]
    counts = np.concatenate([unpack_numbers(bytes(r[1])) for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    parts = [Ragged.unpacked(bytes(r[2])) for r in rows] or [Ragged.of([])]
    answers = Ragged(np.concatenate([p.lengths for p in parts]), np.concatenate([p.flat for p in parts]))
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    return [words[i] for i in order], answers.take(np.array(order, np.int64))


def look_up(
    df: DataFrame,
    table: DataFrame,
    buckets: int,
    prepare: Callable[[], Callable],
    finish: Callable[[], Callable],
    out_kind: str,
    frequent: int = FREQUENT,
    more: DataFrame | None = None,
    place: Callable[[list[bytes]], np.ndarray] | None = None,
    probe: Callable[[bytes, list[bytes]], np.ndarray] | None = None,
) -> DataFrame:
    """Answers for every word of every row of ``df`` (doc_id of any type, text as binary), rows finished as ``out_kind``.

    ``prepare()`` gives, once per task, a function of a list of texts that returns (their lists
    of words, a number for each text); ``finish()`` one of (doc_ids, numbers, codes, Ragged) -> record batch, where ``codes`` has an array for
    each document that points into the answers. A word that the table lacks has no answer (an empty row).

    The documents are read twice, once for the questions and once for what the answers go
    into; block numbers follow the partitions of ``df``, so ``df`` must be a scan of a table. A block whose two
    readings differ is found by a checksum and stops the job.

    ``more`` (bucket, answers) has rows of another kind, in buckets of their own: ``probe(answers, words)`` gives
    one number for each word that ``place`` sends there (``place`` gives the buckets of all words).
    """
    place = place or (lambda ws: bucket_of(ws, buckets))
    block_rare = min(MOST_RARE, max(BLOCK_RARE, ASKED * buckets))  # rows of (block, bucket) hold as many words at any number of buckets
    block_words = BLOCK_WORDS * max(1, block_rare // BLOCK_RARE)
    words, answers = frequent_words(table, frequent)
    shared = df.sparkSession.sparkContext.broadcast((words, answers.lengths, answers.flat))
    n_frequent = len(words)

    def blocks(batches, questions: bool):
        codes_of = dict(zip(shared.value[0], range(n_frequent)))
        split = prepare()
        base, block = 0, 0
        rare: dict[bytes, int] = {}
        held, seen, rare_bytes = [], 0, 0  # documents of this block

        def rows():
            nonlocal block, seen, rare_bytes
            words, check = list(rare), zlib.crc32(b"\0".join(rare))
            number = base + block
            block, seen, rare_bytes = block + 1, 0, 0
            rare.clear()
            if questions:
                got = [(number, b, check, pack_numbers(part), pack_words([words[i] for i in part])) for b, part in by_bucket(words, place(words))]
                return pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in got], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["block", "bucket", "sum", "places", "words"],
                )
            got = []
            for i in range(0, len(held), CHUNK):
                part = held[i : i + CHUNK]
                lengths = np.fromiter((len(x[2]) for x in part), np.int64, len(part))
                flat = np.concatenate([x[2] for x in part])
                got.append((number, check, [x[0] for x in part], [x[1] for x in part], Ragged(lengths, flat).packed()))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in got], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.float64()), pa.binary()))],
                names=["block", "sum", "doc_ids", "numbers", "codes"],
            )

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            base = batch.column("part")[0].as_py() << 24 if batch.num_rows else base
            ids, raws = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i in range(0, len(ids), CHUNK):
                lists, numbers = split(raws[i : i + CHUNK], questions)
                for doc_id, ws, number in zip(ids[i : i + CHUNK], lists, numbers, strict=True):
                    codes = list(map(codes_of.get, ws))
                    if None in codes:
                        for k, c in enumerate(codes):
                            if c is None:
                                rare_bytes += 0 if ws[k] in rare else len(ws[k])
                                codes[k] = n_frequent + rare.setdefault(ws[k], len(rare))
                    if not questions:
                        held.append((doc_id, number, np.array(codes, np.int64)))
                    seen += len(ws)
                    if len(rare) > block_rare or seen > block_words or rare_bytes > BOUND_BYTES:
                        yield rows()
        if seen or held or rare:
            yield rows()

    def reply(batches):
        known, now, parts, size = {}, None, [], 0
        values = blob = None
        for batch in batches:
            out = []
            for b, is_question, block, check, places, words, answers in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if b != now:
                    known, now, parts, size, values, blob = {}, b, [], 0, None, None
                if not is_question and words is None:
                    blob = answers
                    continue
                if not is_question:
                    got = unpack_words(words)
                    known.update(zip(got, range(size, size + len(got))))
                    parts.append(Ragged.unpacked(answers))
                    size += len(got)
                    continue
                if blob is not None:
                    told = probe(blob, unpack_words(words))
                    out.append((block, check, places, Ragged(np.ones(len(told), np.int64), told).packed()))
                    continue
                if values is None:  # the table's rows come first; one empty row more for words it lacks
                    values = Ragged(np.concatenate([*(p.lengths for p in parts), [0]]), np.concatenate([*(p.flat for p in parts), np.zeros(0, np.int64)]))
                found = values.take(np.fromiter((known.get(w, size) for w in unpack_words(words)), np.int64))
                out.append((block, check, places, found.packed()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "sum", "places", "answers"]
            )

    def meet(batches):
        end = finish()
        base = Ragged(shared.value[1], shared.value[2])
        now, check, places, parts, full = None, None, [], [], None
        for batch in batches:
            for block, s, doc_ids, numbers, codes, spots, answers in zip(*(batch.column(n).to_pylist() for n in ("block", "sum", "doc_ids", "numbers", "codes", "places", "answers")), strict=True):
                if block != now:
                    now, check, places, parts, full = block, s, [], [], None
                if s != check:
                    raise ValueError("a partition of the documents differs between its two readings")
                if codes is None:
                    places.append(unpack_numbers(spots).astype(np.int64))
                    parts.append(Ragged.unpacked(answers))
                    continue
                if full is None:
                    full = base
                    if parts:
                        got = Ragged(np.concatenate([p.lengths for p in parts]), np.concatenate([p.flat for p in parts]))
                        full = base.join(got.take(np.argsort(np.concatenate(places))))
                doc_ids = pa.array(doc_ids, id_type(batch))
                docs = Ragged.unpacked(codes)
                cuts = (docs.starts + docs.lengths)[:-1]
                top = int(docs.flat.max()) if len(docs.flat) else -1
                if top >= len(full.lengths):
                    raise ValueError("a partition of the documents differs between its two readings")
                yield end(doc_ids, numbers, np.split(docs.flat, cuts), full)

    id_type = lambda batch: batch.schema.field("doc_ids").type.value_type
    ids = f"array<{df.schema['doc_id'].dataType.simpleString()}>"
    rows = df.select("doc_id", "text", F.spark_partition_id().alias("part"))  # of the scan, whatever stage it ends in
    asked = rows.mapInArrow(lambda it: blocks(it, True), "block bigint, bucket int, sum bigint, places binary, words binary")
    none = F.lit(None)
    both = table.select(
        "bucket", F.lit(False).alias("is_question"), none.cast("bigint").alias("block"), none.cast("bigint").alias("sum"), none.cast("binary").alias("places"), "words", "answers"
    )
    if more is not None:
        both = both.unionByName(more.select(
            "bucket", F.lit(False).alias("is_question"), *[none.cast(t).alias(c) for c, t in (("block", "bigint"), ("sum", "bigint"), ("places", "binary"), ("words", "binary"))], "answers"
        ))
    both = both.unionByName(asked.select("bucket", F.lit(True).alias("is_question"), "block", "sum", "places", "words", none.cast("binary").alias("answers")))
    replies = both.repartition("bucket").sortWithinPartitions("bucket", "is_question").mapInArrow(reply, "block bigint, sum bigint, places binary, answers binary")
    told = rows.mapInArrow(lambda it: blocks(it, False), f"block bigint, sum bigint, doc_ids {ids}, numbers array<double>, codes binary")
    all_rows = told.select("*", none.cast("binary").alias("places"), none.cast("binary").alias("answers")).unionByName(
        replies.select("block", "sum", none.cast(ids).alias("doc_ids"), none.cast("array<double>").alias("numbers"), none.cast("binary").alias("codes"), "places", "answers")
    )
    return all_rows.repartition("block").sortWithinPartitions("block", F.col("codes").isNotNull()).mapInArrow(meet, out_kind)
