"""Near copies by the Jaccard index of five-word shingles: candidates by SimHash and MinHash, every link confirmed exactly.

A text is the set of hashes of its runs of five words; texts with one set are one node. Nodes
whose SimHash over that set lies within a few bits are candidates, as operator 7 links them. At an index of 0.8 two SimHashes
differ in about 9 of 64 bits, and tables that find such pairs number in the thousands; so nodes that
share a band of their MinHash signature are candidates too if the signatures also agree in
enough rows (bands and rows both leave a stated chance of missing a pair at the threshold).
Candidates form components, each text goes once to the group of its component, and there all pairs
not yet joined are compared by their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .components import components
from .licenses import _M, _mixed, bands, shingle_hashes
from .simhash import classes, links, majority

#: Rows of a band, and the chance that bands (or the agreement of signatures) miss a pair at the threshold.
ROWS, MISS = 6, 1e-3
#: Members of a band's group, and shingles of a component's, above which it is dealt in pairs of tiles.
SPLIT, HEAVY = 8192, 1 << 22


def shingle_set(raw: bytes) -> np.ndarray:
    """Sorted hashes of the five-word runs of a text (UTF-8); a shorter text is one run, one without words has none."""
    from xxhash import xxh64_intdigest

    found = raw.lower().split()  # of bytes, as SimHash splits them
    if len(found) < 5:
        return np.array([xxh64_intdigest(b" ".join(found))] if found else [], np.uint64)
    return np.unique(shingle_hashes(found))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def signature(shingles: np.ndarray, n_hashes: int) -> np.ndarray:
    """Least of each of ``n_hashes`` hash functions over a set that is not empty."""
    salts = _mixed(np.arange(1, n_hashes + 1, dtype=np.uint64) * _M)[:, None]
    least = np.full(n_hashes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 1 << 11):
        part = _mixed((shingles[None, i : i + (1 << 11)] ^ salts) * _M)
        least = np.minimum(least, part.min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each ``ROWS`` rows of a signature."""
    rows = least.reshape(-1, ROWS)
    keys = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mixed((keys ^ rows[:, r]) * _M)
    return keys


def agreement(threshold: float, n_hashes: int) -> float:
    """Share of equal signature rows that a pair at the threshold misses with a chance of about ``MISS``."""
    return threshold - 3.1 * math.sqrt(threshold * (1 - threshold) / n_hashes)


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that join all that chains of near pairs join; near(i, rest) marks the near ones among ``rest``.

    Each row is held only against rows that nothing has reached yet, so a group of copies takes one step.
    """
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            reached = rest[hit].tolist()
            out += [(i, j) for j in reached]
            queue += reached
            rest = rest[~hit]
    return out


def _prints(df: DataFrame, text: str, n_hashes: int) -> DataFrame:
    """doc_id, fp (hash of the shingle set), sim (its SimHash), size (of the set), sketch (a byte per hash function), bands."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            fps, sims, sizes, sketches, keys = [], [], [], [], []
            for x in batch.column(1):
                s = shingle_set(x.as_py())
                least = signature(s, n_hashes) if len(s) else None
                fps.append(xxh64_intdigest(s.tobytes()) if len(s) else 0)
                sims.append(majority(s))
                sizes.append(len(s))
                sketches.append(b"" if least is None else least.astype(np.uint8).tobytes())
                keys.append([] if least is None else band_keys(least).view(np.int64))
            fp, sim = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sims))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), fp, sim, pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "fp", "sim", "size", "sketch", "bands"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    rows = df.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint, sim bigint, size bigint, sketch binary, bands array<bigint>")


def _with_fp(df: DataFrame, text: str) -> DataFrame:
    """row (the columns of ``df``) and fp."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = (shingle_set(x.as_py()) for x in batch.column(1))
            fp = np.fromiter((xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["row", "fp"])

    raw = F.coalesce(F.col("row")[text].cast("string"), F.lit("")).cast("binary").alias("fp")
    return packed.select("row", raw).mapInArrow(run, packed.select("row", F.lit(0).cast("long").alias("fp")).schema)


def _dealt(rows: DataFrame, key: str, parts) -> DataFrame:
    """``rows`` with s and t, grouped by key, s and t: pairs of tiles where ``parts`` is above one."""
    tile = F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("parts")).cast("int")
    others = F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
    out = rows.withColumn("parts", parts.cast("int")).withColumn("tile", tile).withColumn("other", F.explode(others))
    out = out.withColumn("s", F.least("tile", "other")).withColumn("t", F.greatest("tile", "other"))
    return out.repartition(key, "s", "t").sortWithinPartitions(key, "s", "t")


def _groups(batches, key: str):
    """Tables of the rows of each group of several rows, as sorted rows arrive."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([held.column(n).to_numpy().astype(np.int64) for n in (key, "s", "t")], axis=1)
        cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        for start, end in zip(cut, cut[1:], strict=False):
            if end - start > 1:
                yield held.slice(start, end - start)
        held = held.slice(cut[-1])
    if held is not None and held.num_rows > 1:
        yield held


def _edges(groups, near_of):
    for group in groups:
        fp = group.column("fp").to_numpy()
        links = np.array(spanning(len(fp), near_of(group)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(fp[links[:, 0]]), pa.array(fp[links[:, 1]])], names=["a", "b"])


def within_radius(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b: links that span the components of nodes (fp, sim) whose SimHashes are within ``radius`` bits."""
    heads = written(nodes.groupBy("sim").agg(F.min("fp").alias("head")), "near-sims")
    same = nodes.select("fp", "sim").join(heads, "sim").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    pairs = links(heads.select(F.col("sim").alias("fp")), radius)
    a, b = (heads.select(F.col("sim").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    return same.unionByName(pairs.join(a, "a").join(b, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def candidates(nodes: DataFrame, threshold: float, n_hashes: int, split: int = SPLIT) -> DataFrame:
    """a, b: links that span the components of nodes (fp, sketch, bands) with a band in common and sketches alike."""
    least = agreement(threshold, n_hashes)

    def near_of(group):
        marks = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, n_hashes)
        return lambda i, rest: (marks[rest] == marks[i]).mean(axis=1) >= least

    rows = nodes.select("fp", F.explode("bands").alias("band"))
    # counted by map-side sums and joined back: a window would sort all rows of a hot band in one task
    counts = written(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "near-bands")
    shared = written(rows.join(counts.hint("merge"), "band"), "near-shared")
    shared = shared.join(nodes.select("fp", "sketch").hint("merge"), "fp")
    parts = F.when(F.col("n") > split, F.ceil(F.col("n") / (split // 2))).otherwise(1)
    return _dealt(shared, "band", parts).select("band", "s", "t", "fp", "sketch").mapInArrow(lambda b: _edges(_groups(b, "band"), near_of), "a bigint, b bigint")


def confirmed(texts: DataFrame, threshold: float, heavy: int = HEAVY) -> DataFrame:
    """a, b: links that span the components of Jaccard >= ``threshold`` within each candidate component.

    ``texts``: fp, comp, weight (shingles of the whole component) and text, one row per fp.
    """

    def near_of(group):
        sets = [shingle_set(x) for x in group.column("text").to_pylist()]
        sizes = np.array([len(x) for x in sets])

        def near(i, rest):
            fits = np.minimum(sizes[rest], sizes[i]) >= threshold * np.maximum(sizes[rest], sizes[i])
            hit = np.zeros(len(rest), bool)
            some = np.flatnonzero(fits)
            if len(some):
                values = np.concatenate([sets[j] for j in rest[some].tolist()])
                spot = np.minimum(np.searchsorted(sets[i], values), sizes[i] - 1)
                owner = np.repeat(np.arange(len(some)), sizes[rest[some]])
                both = np.bincount(owner[sets[i][spot] == values], minlength=len(some))
                hit[some] = both / (sizes[i] + sizes[rest[some]] - both) >= threshold
            return hit

        return near

    parts = F.when(F.col("weight") > heavy, F.ceil(F.col("weight") / (heavy // 2))).otherwise(1)
    return _dealt(texts, "comp", parts).select("comp", "s", "t", "fp", "text").mapInArrow(lambda b: _edges(_groups(b, "comp"), near_of), "a bigint, b bigint")


def drop_near_copies(df: DataFrame, text: str = "text", threshold: float = 0.8, radius: int = 3, split: int = SPLIT, heavy: int = HEAVY) -> DataFrame:
    """One row of each component of texts whose five-word Jaccard index reaches ``threshold``, columns as they were.

    That of the smallest doc_id stays, of rows that tie in it the first by a hash of the text and the text; rows without a
    partner all stay. ``df`` is read twice, so it should be a table. Only the row of the smallest doc_id of a shingle set can
    stay, so the texts are shuffled once, by set and doc_id together (a set that a third of all rows have is no hot key), and
    one for each set at most is ever compared.
    """
    n_hashes = ROWS * bands(threshold, ROWS, MISS)
    prints = written(_prints(df, text, n_hashes), "near-prints")
    firsts = [F.first(c).alias(c) for c in ("sim", "size", "sketch", "bands")]
    nodes = written(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), *firsts), "near-nodes")
    found = components(written(within_radius(nodes, radius).unionByName(candidates(nodes, threshold, n_hashes, split)), "near-candidates"))
    comps = written(found.select(F.col("node").alias("fp"), F.col("root").alias("comp")), "near-components")
    sized = comps.join(nodes.select("fp", "size"), "fp")
    weights = sized.groupBy("comp").agg(F.sum("size").alias("weight"))
    sized = sized.select("fp", "comp").join(weights, "comp")
    marks = written(nodes.select("fp", "n", "least").join(sized, "fp", "left"), "near-marks")
    rows, least = _with_fp(df, text).alias("r"), marks.hint("merge").alias("m")
    is_first = (F.col("r.fp") == F.col("m.fp")) & F.col("r.row")["doc_id"].eqNullSafe(F.col("m.least"))
    first_rows = written(rows.join(least, is_first).select("r.row", "r.fp", "m.n", "m.comp", "m.weight"), "near-firsts")
    texts = first_rows.where("comp IS NOT NULL").select("fp", "comp", "weight", F.coalesce(F.col("row")[text].cast("string"), F.lit("")).cast("binary").alias("text"))
    found = written(confirmed(texts.dropDuplicates(["fp"]), threshold, heavy), "near-links")
    kinds = classes(prints.select("doc_id", "fp"), edges=found)
    single = F.col("n") == 1
    alone = first_rows.where(single & F.col("comp").isNull()).select("row.*")
    unlinked = first_rows.where(single & F.col("comp").isNotNull()).join(kinds.select("fp"), "fp", "left_anti").select("row.*")
    k = kinds.hint("merge").alias("k")
    is_head = (F.col("r.fp") == F.col("k.fp")) & F.col("r.row")["doc_id"].eqNullSafe(F.col("k.component_id"))
    heads = first_rows.where(~(single & F.col("comp").isNull())).alias("r").join(k, is_head).select("r.row", "k.root")
    place = F.row_number().over(W.partitionBy("root").orderBy(F.xxhash64(F.col("row")[text]), F.col("row")[text]))
    return alone.unionByName(unlinked).unionByName(heads.withColumn("place", place).where("place = 1").select("row.*"))
