"""Near-duplicates by SimHash: fingerprints, and links between those within a few bits.

Two fingerprints within ``radius`` bits agree on at least ``keep`` of ``radius + keep``
blocks of bits, so tables keyed by each choice of ``keep`` blocks bring every linked
pair together. Within a key they are compared bit-sliced: plane k holds bit k of all
fingerprints of a tile; xor with a fingerprint's bit k marks who differs there, carry-save
counters add the marks for all at once, and rows of the comparison stop as soon as every
counter has passed the radius. Only links that join parts not yet joined leave a task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .components import components

BITS = 64
#: Rows of a tile.
TILE = 512
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(raw: bytes, size: int = 3) -> int:
    """Fingerprint of a text (UTF-8): bit set if set in over half of its shingles' hashes; no words: 0."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()  # of bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return 0
    join = b" ".join
    grams = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    return majority(np.fromiter((xxh64_intdigest(join(g), 42) for g in grams), np.uint64))


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: row k has bit k of each value; padded with zeros to whole words."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    wide = np.zeros((BITS, -(-len(values) // 64) * 64), np.uint8)
    wide[:, : len(values)] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all a[i], b[j] that differ in at most ``radius`` bits."""
    table, words = planes(b), -(-len(b) // 64)
    n_counters = max(1, radius.bit_length())
    masks = np.where((a[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1), _ONES, np.uint64(0))
    rows = np.arange(len(a))
    over = np.zeros((len(a), words), np.uint64)
    if len(b) % 64:
        over[:, -1] = _ONES << np.uint64(len(b) % 64)
    start = (1 << n_counters) - 1 - radius  # so that one mark past the radius overflows
    counters = [np.full((len(a), words), _ONES if start >> c & 1 else 0, np.uint64) for c in range(n_counters)]
    for k in range(BITS):
        carry = table[k][None, :] ^ masks[:, k][:, None]
        for c in range(n_counters):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        over |= carry
        if k % 8 == 7:
            open_rows = (over != _ONES).any(axis=1)
            if not open_rows.all():
                rows, over, masks = rows[open_rows], over[open_rows], masks[open_rows]
                counters = [c[open_rows] for c in counters]
                if not len(rows):
                    break
    found = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little") if len(rows) else np.zeros((0, 0), np.uint8)
    i, j = np.nonzero(found)
    return rows[i], j


class _Forest:
    """Union-find over the rows of one group; keeps the links that joined something."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links among ``values`` (distinct) that join all that chains of near pairs join."""
    forest = _Forest(len(values))
    for s in range(0, len(values), TILE):
        for t in range(s, len(values), TILE):
            i, j = near_pairs(values[s : s + TILE], values[t : t + TILE], radius)
            ahead = i + s < j + t
            for x, y in zip((i[ahead] + s).tolist(), (j[ahead] + t).tolist(), strict=True):
                forest.join(x, y)
    return forest.links


def _linked(radius: int):
    def run(batches):
        keys, values = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)

        def flush(keys, values, last):
            """Compares all whole groups, several to a tile; the rest waits."""
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            ends = [*cut.tolist(), *([len(values)] if last and len(values) else [])]
            found, start, done = [], 0, 0
            for k, end in enumerate(ends):
                following = ends[k + 1] if k + 1 < len(ends) else None
                if following is not None and following - start <= TILE:
                    continue
                part = np.unique(values[start:end])
                found += [(part[i], part[j]) for i, j in spanning_links(part, radius)]
                start = done = end
            return found, keys[done:], values[done:]

        for batch in batches:
            got = [batch.column(n).to_numpy() for n in ("band", "s", "t")]
            keys = np.concatenate([keys, np.stack(got, axis=1).astype(np.int64)])
            values = np.concatenate([values, batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)])
            found, keys, values = flush(keys, values, False)
            yield _edges(found)
        yield _edges(flush(keys, values, True)[0])

    return run


def _edges(found: list) -> pa.RecordBatch:
    ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def blocks_to_keep(n: int, radius: int) -> int:
    """How many blocks a table's key takes, so that a key meets about 64 of ``n`` spread fingerprints at most."""
    keep = 1
    while keep < 4 and n > 64 << (BITS * keep // (radius + keep)):
        keep += 1
    return keep


def links(prints: DataFrame, radius: int = 3, split: int = 16 * TILE) -> DataFrame:
    """a, b: links among the distinct longs ``fp`` that span all components of distance <= ``radius``.

    A key with more than ``split`` fingerprints is dealt in tiles: each pair of tiles
    is a group of its own, so no task meets the whole key and no pair is lost.
    """
    keep = blocks_to_keep(prints.count(), radius)
    n_blocks = radius + keep
    edges = [BITS * i // n_blocks for i in range(n_blocks + 1)]
    masks = []
    for chosen in combinations(range(n_blocks), keep):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    tables = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]))
    rows = prints.select("fp", tables.alias("band"))
    hot = written(rows.groupBy("band").count().where(F.col("count") > split), "simhash-hot")
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(0)) / (split // 2)).cast("int")
    tile = F.pmod(F.xxhash64("fp", F.lit("tile")), F.greatest(parts, F.lit(1))).cast("int")
    dealt = rows.join(hot, "band", "left").withColumn("n", parts).withColumn("tile", F.when(F.col("n") > 1, tile).otherwise(F.lit(0)))
    pairs = F.when(F.col("n") > 1, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(pairs)).select("fp", "band", F.least("tile", "other").alias("s"), F.greatest("tile", "other").alias("t"))
    dealt = dealt.repartition("band", "s", "t").sortWithinPartitions("band", "s", "t")
    return dealt.mapInArrow(_linked(radius), "a bigint, b bigint")


def fingerprints(df: DataFrame, text: Column, size: int = 3) -> DataFrame:
    """The columns of ``df`` and ``fp`` (long: the 64 bits as they are) of a text in each row; null texts count as empty."""
    place = len(df.columns)

    def run(batches):
        for batch in batches:
            fp = np.fromiter((simhash(x.as_py(), size) for x in batch.column(place)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(fp.view(np.int64))], names=[*batch.schema.names[:place], "fp"])

    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("fp")
    return df.select("*", raw).mapInArrow(run, df.select("*", F.lit(0).cast("long").alias("fp")).schema)


def classes(prints: DataFrame, radius: int = 3, edges: DataFrame | None = None) -> DataFrame:
    """fp, root, component_id for the fingerprints that several rows of ``prints`` (doc_id, fp) share or link.

    component_id is the smallest doc_id of all rows that links reach (null if all are null); root is
    the smallest fingerprint. A fingerprint that is left out has one row and no link. Exact copies are one fingerprint, so
    their number never matters to the comparison. ``edges`` (a, b) are used in place of links by radius if given.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    found = components(links(nodes.select("fp"), radius) if edges is None else edges)
    roots = written(found.select(F.col("node").alias("fp"), "root"), "simhash-roots")
    merged = nodes.join(roots, "fp", "left").where("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "fp"))
    merged = written(merged.select("fp", "root", "least"), "simhash-merged")
    least = written(merged.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    return written(merged.join(least, "root").select("fp", "root", "component_id"), "simhash-classes")


def near_duplicates(df: DataFrame, text: str = "text", radius: int = 3, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row.

    Texts without words have the fingerprint zero and link like others. Repeated rows are in one component.
    A row with a null id and no other row in its component has a null component_id.
    """
    rows = df.select("doc_id", F.col(text).alias("text"))
    prints = written(fingerprints(rows, F.col("text"), size).select("doc_id", "fp"), "simhash-prints")
    kinds = classes(prints, radius).select("fp", F.lit(True).alias("grouped"), "component_id")
    return prints.join(kinds, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def drop_near_duplicates(df: DataFrame, text: str = "text", radius: int = 3, size: int = 3) -> DataFrame:
    """One row of each component, columns as they were: that of the smallest doc_id, of rows that tie
    in it the first by text. Rows without a partner all stay."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))  # so that no name can clash
    marked = written(fingerprints(packed, F.col("row")[text], size), "simhash-marked")
    kinds = classes(marked.select(F.col("row")["doc_id"].alias("doc_id"), "fp"), radius)
    # kinds grows with the rows, so it is never broadcast: texts meet it by one shuffle at every size
    joined = marked.join(kinds.hint("merge"), "fp", "left")
    alone = joined.where("root IS NULL").select("row.*")
    heads = joined.where(F.col("root").isNotNull() & F.col("row")["doc_id"].eqNullSafe(F.col("component_id")))
    first = F.row_number().over(W.partitionBy("root").orderBy(F.xxhash64(F.col("row")[text]), F.col("row")[text]))
    return alone.unionByName(heads.withColumn("place", first).where("place = 1").select("row.*"))
