"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The counts of all words and word pairs of the training texts are quantised to powers of
two: an n-gram with count c enters the filter once for each level 1 .. 1 + floor(log2 c).
Asking for level after level until one is missing gives the quantised count back, never
too low. The filter is dealt in segments by a hash of the n-gram, which tasks fill. A filter of up to
``BROADCAST_BYTES`` is sent to the executors as a file, which their workers map; of a larger one every segment stays where it is and
the n-grams of blocks of documents are sent to it, with equal scores. P(w | v) = (c(vw) + mu P(w)) / (c(v) + mu) with
P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). Exact word counts for the base score come from a table of
distinct words.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, text_or_empty, written
from .dictionary import BUCKET_WORDS, CHUNK, Ragged, bucket_of, distinct_words, look_up, pack_numbers, totals, unpack_numbers, word_table

#: No word holds white space, so this stands for the end of a text.
END = b"\n"
#: Bits of filter per training token (most tokens start a pair that is new), and membership bits per level.
BITS_PER_TOKEN, PROBES = 5, 3
#: Training tokens per segment, bytes of the filter up to which it is broadcast, levels at most.
SEGMENT_TOKENS, BROADCAST_BYTES, LEVELS = 500_000, 1_024_000_000, 48
#: Bits a training token of a small corpus at most, and bytes that a filter takes while more than ``BITS_PER_TOKEN`` fit in them.
MOST_BITS, FILL_BYTES = 64, 64_000_000
#: Words of which a worker keeps hash and level.
KEPT_WORDS = 50_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text (UTF-8) with A-Z lower-cased, then its end."""
    return [*raw.lower().split(), END]


def fold_of(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % 5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


class Words:
    """Hashes of words, and with ``levels`` what it gives for them: worked out once for the first ``KEPT_WORDS`` different ones, most of a text."""

    def __init__(self, levels=None):
        self.levels, self.index = levels, {}
        self.hashes, self.ones = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray | None]:
        """Hash and level of each word."""
        at, n = list(map(self.index.get, words)), len(self.hashes)
        hashes, ones = self.hashes, self.ones
        if None in at:
            fresh: dict[bytes, int] = {}
            for k, i in enumerate(at):
                if i is None:
                    at[k] = n + fresh.setdefault(words[k], len(fresh))
            new = word_hashes(list(fresh))
            hashes = np.concatenate([hashes, new])
            if self.levels:
                ones = np.concatenate([ones, self.levels(_mixed(new + _A))])
            if n + len(fresh) <= KEPT_WORDS:
                self.index.update(zip(fresh, range(n, len(hashes))))
                self.hashes, self.ones = hashes, ones
        places = np.array(at, np.int64)
        return hashes[places], ones[places] if self.levels else None


def n_grams(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the pairs of a stream of texts; before the first stands an end."""
    before = np.concatenate([word_hashes([END]), stream[:-1]])
    return _mixed(stream + _A), _mixed(_mixed(before) * _A + stream)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(counts.astype(np.float64))).astype(np.int64) + 1, LEVELS)


def count_at(level: np.ndarray) -> np.ndarray:
    """Middle of the counts that share a level; 0 and 1 are exact."""
    top = np.exp2(level.astype(np.float64))
    return np.where(level > 0, (top / 2 + top - 1) / 2, 0.0)


class Segments:
    """Where the bits of an n-gram lie: a segment by its high bits, places inside by mixing in level and probe."""

    def __init__(self, n_tokens: int, bits_per_token: int = BITS_PER_TOKEN):
        self.shift = max(0, (-(-n_tokens // SEGMENT_TOKENS) - 1).bit_length())
        self.n = 1 << self.shift
        self.bits = 64 * max(1, -(-bits_per_token * n_tokens // (self.n * 64)))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.shift)).astype(np.int64) if self.shift else np.zeros(len(hashes), np.int64)

    def places(self, hashes: np.ndarray, level: int, probe: int) -> np.ndarray:
        salt = np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 % 2**64)
        mixed = _mixed(hashes ^ salt)
        return (mixed - mixed // np.uint64(self.bits) * np.uint64(self.bits)).astype(np.int64)  # the remainder; numpy divides by one number faster than it takes %


def train_filter(texts: DataFrame, segments: Segments) -> DataFrame:
    """segment, bits: the filter of all n-grams of ``texts`` (one binary column), a row per segment with any."""
    bound = 4_000_000

    def gather(batches):
        seen, held, known = [], 0, Words()

        def rows():
            hashes, counts = np.unique(np.concatenate(seen), return_counts=True)
            seen.clear()
            of = segments.of(hashes)
            cuts = np.flatnonzero(np.diff(of)) + 1
            starts = [0, *cuts.tolist()]
            got = []
            for h, c, s in zip(np.split(hashes, cuts), np.split(counts, cuts), starts, strict=True):
                got.append((int(of[s]), pack_numbers(np.diff(h, prepend=np.uint64(0))), pack_numbers(c)))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["segment", "hashes", "counts"])

        for batch in batches:
            texts = batch.column(0)
            for i in range(0, len(texts), CHUNK):  # the words of a whole batch would be millions of objects
                stream = [t for x in texts.slice(i, CHUNK) for t in tokens(x.as_py())]
                seen += n_grams(known(stream)[0])
                held += 2 * len(stream)
                if held > bound:
                    yield rows()
                    held = 0
        if seen:
            yield rows()

    def fill(batches):
        now, hashes, counts = None, [], []

        def row():
            h, back = np.unique(np.concatenate(hashes), return_inverse=True)
            level = levels_of(np.bincount(back, weights=np.concatenate(counts).astype(np.float64)))
            bits = np.zeros(segments.bits, bool)
            for k in range(1, int(level.max()) + 1):
                part = h[level >= k]
                for probe in range(PROBES):
                    bits[segments.places(part, k, probe)] = True
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for s, h, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != now and now is not None:
                    yield row()
                    hashes, counts = [], []
                now = s
                hashes.append(np.cumsum(unpack_numbers(h), dtype=np.uint64))
                counts.append(unpack_numbers(c))
        if now is not None:
            yield row()

    sent = texts.mapInArrow(gather, "segment int, hashes binary, counts binary")
    dealt = sent.repartition("segment").sortWithinPartitions("segment")
    return written(dealt.mapInArrow(fill, "segment int, bits binary"), "lm-filter")


def probe_levels(bits: np.ndarray, hashes: np.ndarray, at: np.ndarray, segments: Segments) -> np.ndarray:
    """Level of each n-gram: probes level after level while all bits are there. ``at`` is the first bit of its segment in ``bits``."""
    out = np.zeros(len(hashes), np.int64)
    rows = np.arange(len(hashes))
    for level in range(1, LEVELS + 1):
        for probe in range(PROBES):
            place = at[rows] + segments.places(hashes[rows], level, probe)
            rows = rows[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
        if not len(rows):
            break
        out[rows] = level
    return out


class Filter:
    """The whole filter as a file of each executor; answers quantised counts.

    The driver writes it segment by segment and never holds it, and the workers of an executor share its pages.
    """

    def __init__(self, table: DataFrame, segments: Segments):
        self.segments, self.name = segments, f"lm-filter-{uuid.uuid4().hex}"
        folder = tempfile.mkdtemp(prefix="palisade-")  # executors that come later read it too
        atexit.register(shutil.rmtree, folder, True)
        with open(os.path.join(folder, self.name), "wb") as out:
            out.truncate(segments.n * segments.bits // 8)  # at most BROADCAST_BYTES, as its user sees to
            for row in table.toLocalIterator():
                out.seek(row["segment"] * (segments.bits // 8))
                out.write(row["bits"])
        table.sparkSession.sparkContext.addFile(out.name)

    def asker(self):
        """A function of hashes, for one task."""
        bits, segments = np.memmap(SparkFiles.get(self.name), np.uint8, "r"), self.segments
        return lambda hashes: probe_levels(bits, hashes, segments.of(hashes) * segments.bits, segments)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        return self.asker()(hashes)


def log_probabilities(ones: np.ndarray, pairs: np.ndarray, end: int, starts: np.ndarray, mu: float, base: float) -> np.ndarray:
    """log10 P of each token of a stream of texts that begin at ``starts``, from the levels of its words and pairs and of the end of a text."""
    c = count_at(ones)
    before = np.concatenate([c[:1], c[:-1]])
    before[starts] = count_at(np.array([end]))[0]
    both = np.minimum(count_at(pairs), before)
    return np.log10((both + mu * (c + 0.5) / base) / (before + mu))


def score_texts(
    df: DataFrame, mu: float = 8.0, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, words_per_bucket: int = BUCKET_WORDS,
    bits_per_token: int | None = None, **how,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows with a crc32 of the id modulo 5 other than 1 train the model; all are scored. doc_id has any type that casts to
    text; a null one counts as the text ``null``. Null texts count as empty: one token, the end. Repeated rows count each
    time. The fewer bits a token gets, the more pairs of words that were never seen are taken for seen (``BITS_PER_TOKEN``: about one in
    seven, at most one level; ``MOST_BITS``: none to speak of), so a small corpus gets more. With no training row every word is unknown: N and V are 0 and the base of a token is log10(1).
    """
    raw = df.select(F.struct("doc_id", (fold_of() == 1).alias("held_out")).alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    training = raw.where(~F.col("doc_id.held_out")).select("text")
    buckets = bucket(distinct_words(raw.select("text"), bytes.split), words_per_bucket)  # near enough, for how many buckets there are
    table = word_table(training, tokens, lambda words, counts: Ragged(np.ones(len(words), np.int64), counts.astype(np.int64)), buckets)
    n, v = totals(table)
    base = n + 0.5 * (v + 1)
    if bits_per_token is None:  # what FILL_BYTES allow; below 5 bits the filter would claim too much, so it grows from there
        bits_per_token = max(BITS_PER_TOKEN, min(MOST_BITS, 8 * FILL_BYTES // max(n, 1)))
    segments = Segments(n, bits_per_token)
    filled = train_filter(training, segments)
    sent = segments.n * segments.bits // 8 <= broadcast_bytes
    model = Filter(filled, segments) if sent else None
    mark = len(END) + 8  # an n-gram is asked for as END and its hash: no word, and no other key, has an END and more

    def prepare():
        known = Words(model.asker()) if sent else None
        end = known.levels(_mixed(word_hashes([END]) + _A))[0] if sent else 0

        def split(texts, questions):
            lists = [tokens(x) for x in texts]
            if sent and questions:
                return lists, [0.0] * len(texts)
            lengths = list(map(len, lists))
            starts = np.cumsum([0, *lengths])[:-1]
            stream = [t for x in lists for t in x]
            if sent:
                hashes, levels = known(stream)
                logs = log_probabilities(levels, known.levels(n_grams(hashes)[1]), end, starts, mu, base)
                return lists, np.add.reduceat(logs, starts).tolist() if lists else []
            ones, pairs = n_grams(word_hashes(stream))
            raw = [END + ones[i].tobytes() for i in range(len(ones))], [END + pairs[i].tobytes() for i in range(len(pairs))]
            return [x + raw[0][s : s + k] + raw[1][s : s + k] for x, s, k in zip(lists, starts.tolist(), lengths, strict=True)], [0.0] * len(texts)

        return split

    def hashes_of(words):
        return np.frombuffer(b"".join(w[len(END) :] for w in words), np.uint64)

    def place(words):
        at = bucket_of(words, buckets)
        if not sent and (grams := np.array([len(w) == mark and w.startswith(END) for w in words], bool)).any():
            at[grams] = buckets + segments.of(hashes_of([w for w, is_gram in zip(words, grams, strict=True) if is_gram]))
        return at

    def probe(bits, words):
        hashes = hashes_of(words)
        return probe_levels(np.frombuffer(bits, np.uint8), hashes, np.zeros(len(hashes), np.int64), segments)

    def finish():
        state = {}

        def end(ids, numbers, codes, answers):
            if state.get("for") is not answers:
                counts = np.zeros(len(answers.lengths))
                counts[answers.lengths > 0] = answers.flat
                state.update({"for": answers, "counts": counts, "known": counts > 0, "logs": np.log10((counts + 0.5) / base)})
            if not sent:
                grams, codes = [np.split(x, 3)[1:] for x in codes], [x[: len(x) // 3] for x in codes]
                ones, pairs = ([state["counts"][g[k]].astype(np.int64) for g in grams] for k in (0, 1))
                numbers = [float(log_probabilities(a, b, a[-1], np.zeros(1, int), mu, base).sum()) for a, b in zip(ones, pairs, strict=True)]
            return pa.RecordBatch.from_arrays(
                [
                    ids, pa.array([len(x) for x in codes], pa.int64()),
                    pa.array([int(state["known"][x].sum()) for x in codes], pa.int64()), pa.array([n] * len(codes), pa.int64()),
                    pa.array([float(state["logs"][x].sum()) for x in codes], pa.float64()), pa.array(numbers, pa.float64()),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        return end

    more = None if sent else filled.select((F.col("segment") + buckets).alias("bucket"), F.col("bits").alias("answers"))
    kind = df.schema["doc_id"].dataType.simpleString()
    out = look_up(
        raw, table, buckets, prepare, finish,
        f"doc_id struct<doc_id: {kind}, held_out: boolean>, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        more=more, place=place, probe=probe, **how,
    )
    return out.select("doc_id.doc_id", "doc_id.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
