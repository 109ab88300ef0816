"""Source divergence audit: how far the term shares of a language's sources lie apart, in exact whole numbers.

A group is a (lang, source). With smoothed shares p of a term in a group and q in another, the divergence sums
f(p, q) = floor((p - q)**2 / q) over all V kept terms of the language. Most of these terms are absent from one group or both,
and an absent term has the same share z in all of a group. So, by inclusion and exclusion over the supports of g and h,

    sum f = price of g's terms against z_h + price of h's terms against z_g + (V - |g| - |h|) * f(z_g, z_h)
            + for each term in both: f(p_g, p_h) - f(p_g, z_h) - f(z_g, p_h) + f(z_g, z_h).

The prices come from a group's histogram of counts (a few thousand rows, whatever the vocabulary), once for each distinct z; the
terms in both from the postings of each term, joined with each other inside the tasks that hold them, as sums for pairs of groups.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

SCALE = 1_000_000_000
#: Entries of a task's running count, and bytes of their terms, before they are passed on.
BOUND, BOUND_BYTES = 500_000, 32 << 20
#: Pairs of postings, and sums of pairs of groups, that a task holds.
BOUND_PAIRS = 1_000_000
#: Rows up to which a side of a join is broadcast: a group, or a share of an absent term, with at most 256 bytes of names.
SMALL, LONG_NAME = 100_000, 256

#: ASCII letters in lower case, all else of ASCII a space; bytes of other characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters A to Z (lower-cased) and of characters beyond ASCII."""
    return raw.translate(_TERMS).split()


def term_counts(df: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it) of df (lang, source, text as binary)."""

    def count(batches):
        counts: dict[tuple, Counter] = {}
        held = read = checked = 0

        def rows():
            for (lang, source), found in counts.items():
                words = list(found)
                both = np.fromiter(found.values(), np.int64, len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                     pa.array(both & 0xFFFFFFFF, pa.int64()), pa.array(both >> 32, pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            counts.clear()

        for batch in batches:
            for lang, source, raw in zip(*(batch.column(x).to_pylist() for x in ("lang", "source", "text")), strict=True):
                found = counts.setdefault((lang, source), Counter())
                before, get = len(found), found.get
                for t, n in Counter(terms(raw)).items():
                    found[t] = get(t, 0) + n + (1 << 32)  # both counts in one number
                held += len(found) - before
                read += len(raw)
                full = held > BOUND or read > 32 * BOUND_BYTES
                if not full and read - checked > BOUND_BYTES:
                    checked, full = read, sum(len(t) for c in counts.values() for t in c) > BOUND_BYTES
                if full:
                    yield from rows()
                    held = read = checked = 0
        yield from rows()

    sent = df.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + kept)), exact at any count."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", above, (total + kept).cast("decimal(20,0)"))).cast("bigint")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q): shares are at most 10**9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _small(df: DataFrame, *names: str) -> DataFrame:
    """``df``, to be broadcast if it has at most SMALL rows with short names; else joined by a shuffle."""
    size = df.agg(F.count("*"), F.max(sum((F.octet_length(x) for x in names), F.lit(0)))).collect()[0]
    return F.broadcast(df) if size[0] <= SMALL and (size[1] or 0) <= LONG_NAME else df


def _overlaps(postings: DataFrame) -> DataFrame:
    """lang, source, item, common: for any two sources of a language the sum over the terms in both of what corrects their prices.

    ``postings`` (lang, term, source, p, z) hold a term's rows side by side. Pairs are formed and summed in numpy, a bounded number at a
    time; what leaves a task is one row for each pair of groups that it has seen (or more, where there are over BOUND_PAIRS).
    """

    def gaps(p, q):
        return (p - q) ** 2 // q

    def run(batches):
        codes: dict[tuple, int] = {}
        names: list[tuple] = []
        sums: dict[int, list[int]] = {}
        held = None  # the rows of a term that may go on in the next batch
        waiting, n_waiting = [], 0

        def settle():
            nonlocal n_waiting
            if not waiting:
                return
            key, ab, ba = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            n_waiting = 0
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            for k, x, y in zip(key[order][starts].tolist(), np.add.reduceat(ab[order], starts).tolist(), np.add.reduceat(ba[order], starts).tolist(), strict=True):
                old = sums.setdefault(k, [0, 0])
                old[0] += x
                old[1] += y

        def rows():
            found = [(names[k >> 32], names[k & 0xFFFFFFFF], *v) for k, v in sums.items()]
            out = [r for a, b, ab, ba in found for r in ((a[0], a[1], b[1], ab), (a[0], b[1], a[1], ba))]
            sums.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "common"]
            )

        def pairs(ends, code, p, z):
            """ends: for each row the end of its term's rows."""
            nonlocal n_waiting
            at, d = np.flatnonzero(np.arange(len(ends)) + 1 < ends), 1
            while len(at):
                for i in (at[k : k + BOUND_PAIRS] for k in range(0, len(at), BOUND_PAIRS)):
                    j = i + d
                    i, j = np.where(code[i] < code[j], i, j), np.where(code[i] < code[j], j, i)
                    pi, pj, zi, zj = p[i], p[j], z[i], z[j]
                    ab = gaps(pi, pj) - gaps(pi, zj) - gaps(zi, pj) + gaps(zi, zj)
                    ba = gaps(pj, pi) - gaps(pj, zi) - gaps(zj, pi) + gaps(zj, zi)
                    waiting.append(((code[i] << 32) | code[j], ab, ba))
                    n_waiting += len(i)
                    if n_waiting >= BOUND_PAIRS:
                        settle()
                d += 1
                at = at[at + d < ends[at]]

        def take(table, new):
            groups = list(zip(table.column("lang").to_pylist(), table.column("source").to_pylist(), strict=True))
            for g in dict.fromkeys(groups):
                if g not in codes:
                    codes[g] = len(names)
                    names.append(g)
            code = np.fromiter(map(codes.__getitem__, groups), np.int64, len(groups))
            starts = np.flatnonzero(new)
            lengths = np.diff(np.r_[starts, len(new)])
            pairs(np.repeat(starts + lengths, lengths), code, *(table.column(x).to_numpy().astype(np.int64) for x in ("p", "z")))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            lang, term = (table.column(x).combine_chunks() for x in ("lang", "term"))
            new = np.ones(len(lang), bool)
            new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(new)[-1])
            held = table.slice(last).combine_chunks().to_batches()[0]
            if last:
                take(table.slice(0, last), new[:last])
            if len(sums) > BOUND_PAIRS:
                yield rows()
        if held is not None:
            take(pa.Table.from_batches([held]), np.arange(held.num_rows) == 0)
        settle()
        yield rows()

    dealt = postings.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term")
    sums = dealt.mapInArrow(run, "lang string, source string, item string, common bigint")
    return sums.groupBy("lang", "source", "item").agg(F.sum("common").alias("common"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    ``pair``: for each other source of the language the divergence of this one from it, all ranks. ``term``: the kept terms that the
    source has more of than its language, by their share of the divergence from it, ``top`` at most. A language keeps the terms in
    ``least_docs`` or more of its rows. Ranks go by value, then by the item's bytes.

    Null texts, languages and sources count as empty; repeated rows count each; other columns are not read. A group without
    terms has shares of absent terms alone; a language that keeps no term gives pairs of value 0; no rows give none. ``df`` is read twice.
    """
    own = df.select(text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"), text_or_empty(text).cast("binary").alias("text"))
    seen = own.select("lang", "source").distinct()
    whole = "rows between unbounded preceding and unbounded following"
    counted = term_counts(own).select(
        "*",
        F.expr(f"sum(docs) over (partition by lang, term {whole})").alias("lang_docs"),
        F.expr(f"sum(n) over (partition by lang, term {whole})").alias("lang_n"),
    )
    postings = written(counted.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n"), "divergence-postings")

    langs = postings.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    zero = F.lit(0).cast("bigint")
    groups = seen.join(totals, ["lang", "source"], "left").join(F.broadcast(langs) if langs.count() <= SMALL else langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(x, zero).alias(x) for x in ("total", "support", "kept", "lang_total")],
    )
    groups = written(groups.withColumn("z", F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept")))), "divergence-groups")
    small = _small(groups, "lang", "source")

    placed = postings.join(small, ["lang", "source"])
    placed = placed.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    histogram = written(postings.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "divergence-counts")
    absent = _small(groups.where("kept > 0").groupBy("lang").agg(F.collect_set("z").alias("zs")).select("lang", F.explode("zs").alias("zero")), "lang")
    priced = histogram.join(small, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).join(absent, "lang")
    prices = written(
        priced.groupBy("lang", "source", "zero").agg(
            F.sum(F.col("terms") * gap(F.col("p"), F.col("zero"))).alias("over"), F.sum(F.col("terms") * gap(F.col("zero"), F.col("p"))).alias("under")
        ),
        "divergence-prices",
    )

    other = small.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"), F.col("support").alias("other_support"))
    pairs = groups.select("lang", "source", "kept", "support", "z").join(other, "lang").where(F.col("source") != F.col("item"))
    pairs = pairs.join(prices.select("lang", "source", F.col("zero").alias("other_z"), "over"), ["lang", "source", "other_z"], "left")
    pairs = pairs.join(prices.select("lang", F.col("source").alias("item"), F.col("zero").alias("z"), "under"), ["lang", "item", "z"], "left")
    pairs = pairs.join(_overlaps(placed), ["lang", "source", "item"], "left")
    value = (
        F.coalesce("over", zero) + F.coalesce("under", zero) + F.coalesce("common", zero)
        + (F.col("kept") - F.col("support") - F.col("other_support")) * gap(F.col("z"), F.col("other_z"))
    )
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(value, zero).alias("value"))  # no kept term: no z
    rank = "row_number() over (partition by lang, source order by value desc, item)"
    pairs = pairs.withColumn("rank", F.expr(rank))

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    more = placed.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    most = groups.agg(F.max("support")).collect()[0][0] or 0
    parts = max(1, round((most / top) ** 0.5))  # as many rows in a part as its best, of all parts, make in a group
    more = more.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    more = more.withColumn("rank", F.expr(rank.replace("lang, source", "lang, source, part"))).where(F.col("rank") <= top).drop("rank")
    more = more.withColumn("rank", F.expr(rank)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(more)
