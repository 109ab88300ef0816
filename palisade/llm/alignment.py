"""Alignment of two tokenizers' tokens over a corpus, through a dictionary of groups.

A text is cut where tokens of both tokenizers end; the A ids and B ids between two such cuts are a group, and each A token of
a group is linked with each of its B tokens. Few groups are distinct. So a task interns the groups it meets, and keeps for each
document how often it holds which; the dictionary of distinct groups, with the number of documents that hold each, comes from one
shuffle of what the tasks have interned. Links are expanded once for each distinct group and take the group's number of
documents. A pair of ids that one document holds in several of its groups would count more than once; the task that reads the document
sees that and passes on by how much, so

    documents of a pair = documents of all groups that link it - what documents hold it more than once.

The sums of a group over its links are joined back by its key, once for each block of documents that has it.

Neither tokenizer looks past the end of a word (a run of other characters than white space, with the white space before it) if a
space or a newline follows, so both tokenize words alone, and each task tokenizes a word once.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _SPACE, _WIDE, check_model, pieces
from .common import text_or_empty, written
from .dictionary import pack_numbers, unpack_numbers
from .token_count import Encoder

#: What a block of documents holds at most before it is passed on: distinct groups, bytes of their keys, groups of its documents.
BLOCK_GROUPS, BLOCK_BYTES, BLOCK_CODES = 400_000, 32 << 20, 16_000_000
#: Words that a task keeps tokenized, and their bytes; bytes of text that it tokenizes at once.
WORDS, WORD_BYTES, CHUNK_BYTES = 400_000, 32 << 20, 2 << 20
#: Characters of new words that are tokenized in one run.
RUN = 16_384


def _unit_pattern(space: str) -> re.Pattern:
    """Words, each with the white space before it; one ends only where a space or a newline follows, or the text ends."""
    other = "".join(c for c in space.replace("\t-\r", "\t\v\f\r") if c not in " \n")
    return re.compile(f"[{space}]*[^{space}]+(?:[{other}][{space}]*(?:[^{space}]+|\\Z))*|[{space}]+\\Z")


_UNITS, _WIDE_UNITS = _unit_pattern(" \t-\r"), _unit_pattern(_SPACE)


def units(text: str) -> list[str]:
    """The words of a text; joined they give it back."""
    return (_WIDE_UNITS if _WIDE.search(text.encode("utf-8", "replace")) else _UNITS).findall(text)


class Tokenizers:
    """Byte-level A and sentence-piece B, for runs of words."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        check_model(a_path)
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        table = pieces(a_path)
        raw, ends = table.flat.tobytes(), np.cumsum(table.lengths).tolist()
        self.a_bytes = [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]
        self.b = Encoder(b_path).model
        ids = range(self.b.get_piece_size())
        shown = lambda i, x: bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode()
        self.b_bytes = [shown(i, self.b.id_to_piece(i)) for i in ids]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        if not self.a_size.all() or not self.b_size.all():
            raise ValueError("tokens without bytes cannot be aligned")

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A ids and B ids of a text that starts with white space; None where the joined tokens are not the text."""
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode("\n" + text)[2:]  # two tokens first: the model's mark and the newline
        raw = text.encode("utf-8", "replace")
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


class Block:
    """Documents whose groups are interned together."""

    def __init__(self):
        self.single: dict[int, int] = {}  # a << 32 | b -> code, of groups of one A id and one B id
        self.several: dict[tuple, int] = {}
        self.keys: list[str] = []
        self.sizes: list[tuple[int, int]] = []
        self.links: list[tuple[int, ...]] = []  # distinct pairs of a group, as a << 32 | b
        self.docs = np.zeros(1024, np.int64)  # documents that hold a group
        self.excess: Counter = Counter()
        self.rows: list[tuple] = []
        self.key_bytes = self.n_codes = 0
        self._sizes = np.zeros((0, 2), np.int64)

    def _new(self, a: tuple, b: tuple) -> int:
        key = ",".join(map(str, a)) + "|" + ",".join(map(str, b))
        self.keys.append(key)
        self.sizes.append((len(a), len(b)))
        self.links.append(tuple(x << 32 | y for x in set(a) for y in set(b)))
        self.key_bytes += len(key)
        if len(self.keys) > len(self.docs):
            self.docs = np.r_[self.docs, np.zeros(len(self.docs), np.int64)]
        return len(self.keys) - 1

    def groups(self, a: np.ndarray, b: np.ndarray, models: Tokenizers) -> tuple[list[int], np.ndarray]:
        """The codes of the groups between neighbouring common ends, and these ends in bytes."""
        a_ends, b_ends = np.cumsum(models.a_size[a]), np.cumsum(models.b_size[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_to, b_to = np.searchsorted(a_ends, ends, side="right"), np.searchsorted(b_ends, ends, side="right")
        a_from, b_from = np.r_[0, a_to[:-1]], np.r_[0, b_to[:-1]]
        one = (a_to - a_from == 1) & (b_to - b_from == 1)
        codes = np.empty(len(ends), np.int64)
        pairs, inverse = np.unique(a[a_from[one]] << 32 | b[b_from[one]], return_inverse=True)
        found = []
        for p in pairs.tolist():
            code = self.single.get(p)
            if code is None:
                code = self.single[p] = self._new((p >> 32,), (p & 0xFFFFFFFF,))
            found.append(code)
        codes[one] = np.array(found, np.int64)[inverse]
        a_ids, b_ids = a.tolist(), b.tolist()
        many = np.flatnonzero(~one)
        for i, s, e, u, v in zip(many.tolist(), *(x[many].tolist() for x in (a_from, a_to, b_from, b_to)), strict=True):
            key = (*a_ids[s:e], -1, *b_ids[u:v])
            code = self.several.get(key)
            if code is None:
                code = self.several[key] = self._new(tuple(a_ids[s:e]), tuple(b_ids[u:v]))
            codes[i] = code
        return codes.tolist(), ends

    def words(self, new: list[str], models: Tokenizers) -> dict[str, tuple[int, ...] | None]:
        """The codes of each word's groups; None where its tokens do not join to it.

        Words that end in no white space are tokenized many at a time, one after the other: none changes its neighbour. The rest, and runs
        that do not come back whole, go alone.
        """
        out: dict[str, tuple[int, ...] | None] = {}
        run: list[str] = []
        size = 0

        def alone(word):
            ids = models.ids(word)
            out[word] = None if ids is None else tuple(self.groups(*ids, models)[0])

        def settle():
            nonlocal size
            ids = models.ids("".join(run))
            if ids is not None:
                codes, ends = self.groups(*ids, models)
                lengths = np.fromiter((len(w) if w.isascii() else len(w.encode("utf-8", "replace")) for w in run), np.int64, len(run))
                own = np.cumsum(lengths)
                to = np.searchsorted(ends, own, side="right").tolist()
            if ids is None or not np.array_equal(ends[np.array(to) - 1], own):
                for word in run:
                    alone(word)
            else:
                out.update((w, tuple(codes[s:e])) for w, s, e in zip(run, [0, *to], to, strict=False))  # tuples of numbers: the collector leaves them out
            run.clear()
            size = 0

        for word in new:
            if word[-1].isspace() or word[0] not in " \n":
                alone(word)
                continue
            run.append(word)
            size += len(word)
            if size > RUN:
                settle()
        if run:
            settle()
        return out

    def add(self, doc_id, codes: list[int] | None) -> None:
        """A document with these groups in order; None for one without tokens."""
        if codes is None:
            self.rows.append((doc_id, 0, 0, 0, 0, "", None, None))
            return
        if len(self._sizes) < len(self.sizes):
            self._sizes = np.array(self.sizes, np.int64)
        found, times = np.unique(np.array(codes, np.int64), return_counts=True)
        self.docs[found] += 1
        order = found.tolist()
        sizes = self._sizes[found]
        pairs = np.sort(np.fromiter(chain.from_iterable(map(self.links.__getitem__, order)), np.int64))
        again = pairs[1:][pairs[1:] == pairs[:-1]]
        if len(again):
            self.excess.update(again.tolist())
        self.n_codes += len(order)
        text = ";".join(map(self.keys.__getitem__, codes))
        self.rows.append(
            (doc_id, int(sizes[:, 0] @ times), int(sizes[:, 1] @ times), len(codes), int(sizes.prod(axis=1) @ times),
             hashlib.sha256(text.encode()).hexdigest(), pack_numbers(np.diff(found, prepend=0)), pack_numbers(times))
        )

    def full(self) -> bool:
        return len(self.keys) > BLOCK_GROUPS or self.key_bytes > BLOCK_BYTES or self.n_codes > BLOCK_CODES or len(self.excess) > 4 * BLOCK_GROUPS


_FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times")
_KINDS = (None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())


def _read(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One reading of all texts: rows of documents (kind 0), of a block's groups (1) and of pairs held more than once (2)."""

    def run(batches):
        models, block, number = Tokenizers(a_path, b_path), Block(), 0
        known: dict[str, tuple[int, ...] | None] = {}
        word_bytes = 0
        base = TaskContext.get().partitionId() << 24

        def batch_of(kind, columns, n):
            own = {"kind": pa.array([kind] * n, pa.int8()), "block": pa.array([base + number] * n, pa.int64())} | columns
            return pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(n, f.type) for f in schema], schema=schema)

        def rows():
            nonlocal block, number, word_bytes
            for i in range(0, len(block.rows), 1024):
                part = block.rows[i : i + 1024]
                yield batch_of(0, {x: pa.array([r[k] for r in part], kind or id_kind) for k, (x, kind) in enumerate(zip(_FIELDS, _KINDS, strict=True))}, len(part))
            keys = block.keys
            for i in range(0, len(keys), 16_384):
                part = keys[i : i + 16_384]
                n = len(part)
                yield batch_of(1, {"place": pa.array(np.arange(i, i + n), pa.int64()), "key": pa.array(part, pa.string()), "n": pa.array(block.docs[i : i + n], pa.int64())}, n)
            if block.excess:
                n = len(block.excess)
                pairs = np.fromiter(block.excess, np.int64, n)
                yield batch_of(2, {"a": pa.array(pairs >> 32, pa.int64()), "b": pa.array(pairs & 0xFFFFFFFF, pa.int64()), "n": pa.array(list(block.excess.values()), pa.int64())}, n)
            block, number, word_bytes = Block(), number + 1, 0
            known.clear()

        def take(ids, texts):
            nonlocal word_bytes
            lists = [units(" " + t) if t and "▁" not in t else [] for t in texts]
            new = [w for w in dict.fromkeys(chain.from_iterable(lists)) if w not in known]
            word_bytes += sum(map(len, new))
            known.update(block.words(new, models))
            for doc_id, ws in zip(ids, lists, strict=True):
                got = list(map(known.__getitem__, ws))
                block.add(doc_id, None if not got or None in got else list(chain.from_iterable(got)))
            if len(known) > WORDS or word_bytes > WORD_BYTES:
                known.clear()
                word_bytes = 0

        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            schema = pa.schema([
                ("kind", pa.int8()), ("block", pa.int64()), *[(x, k or id_kind) for x, k in zip(_FIELDS, _KINDS, strict=True)],
                ("place", pa.int64()), ("key", pa.string()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
            ])
            ids, texts, size = [], [], 0
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc_id)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size > CHUNK_BYTES:
                    take(ids, texts)
                    ids, texts, size = [], [], 0
                    if block.full():
                        yield from rows()
            take(ids, texts)
            if block.full():
                yield from rows()
        if block.rows:
            yield from rows()

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(
        run,
        f"kind tinyint, block bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes binary, times binary, "
        "place bigint, key string, n bigint, a bigint, b bigint",
    )


def _meet(rows: DataFrame, kind: str) -> DataFrame:
    """Documents with the sums of their groups; a block's sums come first, in order of place."""

    def run(batches):
        now, parts, sums = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if s == e:
                    continue
                if blocks[s] != now:
                    now, parts, sums = blocks[s], [], None
                own = batch.slice(s, e - s)
                is_doc = np.array(own.column("place").is_null())
                n = int((~is_doc).sum())
                if n:
                    parts.append(np.stack([own.slice(0, n).column(x).to_numpy() for x in ("place", "best", "total")]).astype(np.int64))
                if n == len(is_doc):
                    continue
                docs = own.slice(n)
                if sums is None:
                    sums = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
                    if not np.array_equal(sums[0], np.arange(sums.shape[1])):
                        raise ValueError("a block has lost groups")
                best, total = [], []
                for codes, times in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist(), strict=True):
                    if codes is None:
                        best.append(0)
                        total.append(0)
                        continue
                    at, n_times = np.cumsum(unpack_numbers(codes)).astype(np.int64), unpack_numbers(times).astype(np.int64)
                    best.append(int(sums[1][at] @ n_times))
                    total.append(int(sums[2][at] @ n_times))
                columns = {x: docs.column(x) for x in _FIELDS[:6]} | {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    dealt = rows.repartition("block").sortWithinPartitions("block", F.col("place").isNull(), "place")
    return dealt.mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")


def _links(groups: DataFrame, *keep: str, distinct: bool = False) -> DataFrame:
    """keep, a, b: the links of each group, or its distinct pairs."""
    side = lambda i: F.split(F.split_part("key", F.lit("|"), F.lit(i)), ",").cast("array<bigint>")
    once = F.array_distinct if distinct else lambda x: x
    return groups.select(*keep, F.explode(once(side(1))).alias("a"), once(side(2)).alias("bs")).select(*keep, "a", F.explode("bs").alias("b"))


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    n_best: links whose pair is in as many documents as any pair of its A id; count_sum: over the links, the documents that hold the pair.
    Rows are documents: equal rows count each. Null and empty texts, and those that a tokenizer does not give back (U+2581 is a
    space to B), have no tokens: zeros and an empty hash. No rows give none; other columns are not read. Both files are read by all workers.
    """
    check_model(a_path)
    kind = df.schema["doc_id"].dataType.simpleString()
    own = df.select("doc_id", text_or_empty(text).alias("text"))
    read = written(_read(own, a_path, b_path), "alignment-blocks")
    of_blocks = read.where("kind = 1").select("block", "place", "key", "n")
    groups = written(of_blocks.groupBy("key").agg(F.sum("n").alias("docs")), "alignment-groups")
    counted = _links(groups, "docs", distinct=True).unionByName(read.where("kind = 2").select((-F.col("n")).alias("docs"), "a", "b"))
    pairs = counted.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    pairs = written(
        pairs.withColumn("best", F.expr("docs = max(docs) over (partition by a rows between unbounded preceding and unbounded following)")), "alignment-pairs"
    )
    sums = _links(groups, "key").join(pairs, ["a", "b"]).groupBy("key").agg(F.sum(F.col("best").cast("bigint")).alias("best"), F.sum("docs").alias("total"))
    told = of_blocks.join(sums, "key").select("block", "place", "best", "total")
    docs = read.where("kind = 0").select("block", *_FIELDS)
    none = lambda of, names: [F.lit(None).cast(of.schema[x].dataType).alias(x) for x in names]
    both = told.select("*", *none(docs, _FIELDS)).unionByName(docs.select("*", *none(told, ("place", "best", "total"))))
    return _meet(both, kind).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pair_counts(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """a, b, docs: in how many rows each pair of ids is linked; no pair of U+2581's texts."""
    own = df.select("doc_id", text_or_empty(text).alias("text"))
    read = written(_read(own, a_path, b_path), "alignment-blocks")
    groups = read.where("kind = 1").groupBy("key").agg(F.sum("n").alias("docs"))
    counted = _links(groups, "docs", distinct=True).unionByName(read.where("kind = 2").select((-F.col("n")).alias("docs"), "a", "b"))
    return counted.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
