"""Alignment, exact deduplication and the divergence audit against brute force, on the table with every odd case."""

import collections
import hashlib
import re

import numpy as np
import pytest
from palisade.llm import alignment, dictionary, divergence, exact_dedup, fingerprint, lm_score
from palisade.llm.queries import tokenizer_path
from pyspark.sql import functions as F
from test_llm import CLASHES, ROWS, SCHEMA, by_row

A_PATH, B_PATH = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
#: Tabs, carriage returns, wide spaces, white space at either end, characters that no piece has, special tokens as text.
ODD = [
    "a\tb\r\nc  d \t e", "\t\r\n x", "end \n\t ", "tab\t", "x   y z 　w", "   a", "<s> a</s> <|endoftext|> <0x41>", "▁ mark", "🙂🙂 ßß ǆ 中文 字",
    "=" * 300, "0123456789" * 40, "a" * 500, "\u0000 \u0001", "it's they'll 'tis", "é é", "  two  spaces", "\n\n\n", " ", "​﻿ x", "The the THE the",
]
EXTRA = [(1000 + i, t, "en", "src9", 1) for i, t in enumerate(ODD)]
#: A language without a name and one that keeps no term, each of several sources.
EXTRA += [(1100 + i, "Words of no language, words", None, s, None) for i, s in enumerate((None, "a", "b", "b", ""))] + [(1200 + i, f"alone{i}", "xx", s, 1) for i, s in enumerate("abc")]
MORE = ("key", "digest", "row", "first", "group_size", "a", "b", "n", "place", "codes", "term", "value", "rank", "part", "item", "z", "p", "docs")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    df = spark.createDataFrame(ROWS + EXTRA, SCHEMA)
    df.select("*", *[F.lit("clash").alias(c) for c in dict.fromkeys((*CLASHES, *MORE))]).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def aligned():
    """Per row (A ids, B ids) of each group, from the libraries on whole texts and ends as sets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out = []
    for _, text, *_ in ROWS + EXTRA:
        groups = None
        if text:
            a, b, raw = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text), (" " + text).encode()
            a_bytes = [bytes(byte_of[c] for c in a_model.id_to_token(i)) for i in a]
            b_pieces = [b_model.id_to_piece(i) for i in b]
            b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in b_pieces]
            if b"".join(a_bytes) == raw == b"".join(b_bytes):
                a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
                cuts = np.intersect1d(a_ends, b_ends)
                a_at, b_at = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
                groups = [([], []) for _ in cuts]
                for side, at, ids in ((0, a_at, a), (1, b_at, b)):
                    for g, x in zip(at, ids, strict=True):
                        groups[g][side].append(x)
        out.append(groups)
    return out


def test_alignment(docs, empty, monkeypatch):
    found = aligned()
    assert sum(g is None for g in found) == 4 and max(len(g or []) for g in found) > 10_000
    counts = collections.Counter(p for g in found for p in {(x, y) for a, b in g or [] for x in a for y in b})
    most = collections.Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = collections.Counter()
    for (doc_id, *_), groups in zip(ROWS + EXTRA, found, strict=True):
        links = [(x, y) for a, b in groups or [] for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups or [])
        want[
            doc_id, sum(len(a) for a, _ in groups or []), sum(len(b) for _, b in groups or []), len(groups or []), len(links),
            sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ] += 1
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = alignment.align(docs, A_PATH, B_PATH)
    assert got.columns == list(columns) and by_row(got.collect(), *columns) == want
    pairs = alignment.pair_counts(docs, A_PATH, B_PATH).collect()
    assert {(r.a, r.b): r.docs for r in pairs} == counts
    assert alignment.align(empty, A_PATH, B_PATH).collect() == []


def test_alignment_in_small_blocks(docs, spark, monkeypatch):
    """A document's figures do not depend on where blocks end or how much a task keeps."""
    whole = by_row(alignment.align(docs, A_PATH, B_PATH).collect(), "doc_id", "n_best", "count_sum", "groups_sha256")
    small = docs.withColumn("text", F.col("text"))
    read = alignment._read

    def tiny(df, a, b):
        def run(batches):
            alignment.BLOCK_GROUPS, alignment.WORDS, alignment.CHUNK_BYTES = 50, 20, 100
            return batches

        return read(df.mapInArrow(run, df.schema), a, b)

    monkeypatch.setattr(alignment, "_read", tiny)
    assert by_row(alignment.align(small, A_PATH, B_PATH).collect(), "doc_id", "n_best", "count_sum", "groups_sha256") == whole
    for key, value in (("BLOCK_GROUPS", 400_000), ("WORDS", 400_000), ("CHUNK_BYTES", 2 << 20)):
        spark.range(8, numPartitions=8).mapInArrow(lambda it, k=key, v=value: (setattr(alignment, k, v), it)[1], "id bigint").collect()  # workers are kept


def test_alignment_ids_of_text(spark, docs):
    got = alignment.align(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), A_PATH, B_PATH)
    assert got.schema["doc_id"].dataType.simpleString() == "string" and got.count() == len(ROWS + EXTRA)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("counters", [1, 3, 4096])
def test_exact_dedup(docs, empty, counters):
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in ROWS + EXTRA:
        groups[hashlib.sha256(normal(text).encode()).hexdigest()].append(doc_id)
    want = collections.Counter()
    for h, ids in groups.items():
        first = min(ids, key=lambda i: (i is None, i or 0))
        for k, doc_id in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            want[doc_id, first, len(ids), k == 0, h] += 1
    got = exact_dedup.mark_copies(docs, counters=counters)
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got.columns == list(columns) and by_row(got.collect(), *columns) == want
    stay = exact_dedup.drop_copies(docs, counters=counters)
    assert stay.columns == docs.columns
    assert collections.Counter((r.doc_id, normal(r.text)) for r in stay.collect()) == collections.Counter(
        (min(ids, key=lambda i: (i is None, i or 0)), normal(next(t for i, t, *_ in ROWS + EXTRA if i == min(ids, key=lambda i: (i is None, i or 0)) and hashlib.sha256(normal(t).encode()).hexdigest() == h)))
        for h, ids in groups.items()
    )
    assert exact_dedup.mark_copies(empty, counters=counters).collect() == [] and exact_dedup.drop_copies(empty).collect() == []


def test_misra_gries_bound(spark):
    """Every digest with more than rows / (counters + 1) copies is named, by at most as many as counters."""
    values = [b"%d" % (i % 300) for i in range(3000)] + [b"hot"] * 700 + [b"warm"] * 400
    df = spark.createDataFrame([(bytearray(x),) for x in values], "digest binary").repartition(40)
    found = exact_dedup.frequent_digests(df, 12, fan_in=3)
    assert {b"hot", b"warm"} <= set(found) and len(found) <= 12


def brute_audit(rows, least=3, top=200):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    docs, group, lang_n = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, ts in terms:
        docs.update((lang, t) for t in set(ts))
        group[lang, source].update(ts)
        lang_n[lang].update(ts)
    out = collections.Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for lang in lang_n:
        kept = sorted(t for t in lang_n[lang] if docs[lang, t] >= least)

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        own = {s: shares(c) for (x, s), c in group.items() if x == lang}
        q = shares(lang_n[lang])
        for s in own:
            pair = [(-sum(f(own[s][t], own[h][t]) for t in kept), h.encode(), h) for h in own if h != s]
            term = [(-f(own[s][t], q[t]), t.encode(), t) for t in kept if group[lang, s][t] and own[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                for k, (v, _, item) in enumerate(found):
                    out[lang, s, part, item, -v, k + 1] += 1
    return out


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("top", [3, 200])
def test_divergence(docs, empty, top):
    got = divergence.audit(docs, top=top)
    want = brute_audit(ROWS + EXTRA, top=top)
    assert got.columns == list(COLUMNS) and by_row(got.collect(), *COLUMNS) == want
    assert {k[2] for k in want} == {"pair", "term"} and any(k[4] == 0 and k[0] == "xx" for k in want) and any(not k[0] for k in want)
    assert divergence.audit(empty).collect() == []


def test_divergence_without_broadcasts(docs, monkeypatch):
    """The same sums where groups are too many to be broadcast, and tasks pass on sums of a few pairs at a time."""
    monkeypatch.setattr(divergence, "SMALL", -1)
    assert by_row(divergence.audit(docs).collect(), *COLUMNS) == brute_audit(ROWS + EXTRA)


def test_shares_of_huge_counts(spark):
    n, total, kept = 9 * 10**15, 10**16, 10**9
    row = spark.createDataFrame([(n, total, kept)], "n bigint, total bigint, kept bigint").select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()[0]
    assert row.p == 1 + 10**9 * (n + 1) // (total + kept)


@pytest.mark.parametrize("n", [30_000, 65_535, 100_000, 131_071])
def test_fingerprints_of_many_equal_paragraphs(n):
    """A paragraph that is there n times counts n times: the share of a multiset that an edit leaves, at any n."""
    own, new = ["same line"] * n, ["same line"] * (2 * n // 3) + [f"other {i}" for i in range(n // 3)]
    a, b = (fingerprint.Fingerprint().change([fingerprint.digest(x) for x in part]) for part in (own, new))
    x, y = collections.Counter(own), collections.Counter(new)
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs(a.likeness(b) - true) < 0.1 and a.likeness(a) == 1.0
    text = "\n" * n
    cut = fingerprint.edited(text, "word " * n)
    parts = collections.Counter(fingerprint.members(text)), collections.Counter(fingerprint.members(cut))
    true = sum((parts[0] & parts[1]).values()) / sum((parts[0] | parts[1]).values())
    assert abs(fingerprint.fingerprint(text).likeness(fingerprint.fingerprint(cut)) - true) < 0.1


def test_fingerprints_change_by_occurrences():
    """Adding and removing repeated members one by one gives what the whole text gives, if told how many are there."""
    d = [fingerprint.digest(x) for x in ("a", "b", "c")]
    whole = fingerprint.Fingerprint().change([d[0]] * 5 + [d[1]] * 2 + [d[2]])
    step = fingerprint.Fingerprint().change([d[0]] * 3 + [d[2]]).change([d[0]] * 2 + [d[1]] * 2, held={d[0]: 3})
    assert str(step) == str(whole)
    less = step.change([d[0]] * 4 + [d[1]], -1, held={d[0]: 5, d[1]: 2})
    assert str(less) == str(fingerprint.Fingerprint().change([d[0], d[1], d[2]]))
    assert str(less.change([d[0], d[1], d[2]], -1)) == str(fingerprint.Fingerprint())
    wide = fingerprint.Fingerprint()
    wide.signed[3] = 1 << 20
    assert len(str(wide)) == 2 * (36 + 4 * fingerprint.SIGNED) and len(str(whole)) == 2 * (36 + 2 * fingerprint.SIGNED)


def test_distinct_words_are_counted_by_a_sample_of_hashes(spark):
    texts = [(" ".join(f"w{(i * 37 + k) % 40_000}" for k in range(400)),) for i in range(2000)]
    df = spark.createDataFrame(texts, "text string").select(F.col("text").cast("binary").alias("text")).repartition(6)
    true = len({w for (t,) in texts for w in t.split()})
    assert abs(dictionary.distinct_words(df, bytes.split) - true) < 0.25 * true
    assert dictionary.distinct_words(df, bytes.split, share=1) == true
    assert dictionary.distinct_words(df.where("false"), bytes.split) == 0


def test_asked_words_cost_alike_at_any_number_of_buckets():
    """Bytes of a block's rows for each word it asks: blocks grow with the buckets, so rows do not get shorter."""
    rng = np.random.default_rng(0)

    def cost(buckets):
        n = min(dictionary.MOST_RARE, max(dictionary.BLOCK_RARE, dictionary.ASKED * buckets))
        words = [b" " + bytes(rng.integers(97, 123, 6 + i % 9).astype("u1")) for i in range(n)]
        rows = [len(dictionary.pack_numbers(p)) + len(dictionary.pack_words([words[i] for i in p])) + 64 for _, p in dictionary.by_bucket(words, dictionary.bucket_of(words, buckets))]
        return sum(rows) / n

    few, many = cost(50), cost(4000)
    assert many < 1.5 * few


def test_false_claims_of_the_filter(spark):
    """The share of unseen n-grams that the filter takes for seen: next to none with the bits of a small corpus, one in seven with the fewest."""
    rng = np.random.default_rng(1)
    texts = [(bytearray(b" ".join(b"w%d" % k for k in rng.integers(0, 3000, 300))),) for _ in range(200)]
    df = spark.createDataFrame(texts, "text binary")
    never = rng.integers(0, 1 << 62, 20_000).astype(np.uint64)
    claimed = {}
    for bits in (5, 64):
        segments = lm_score.Segments(60_200, bits)
        model = lm_score.Filter(lm_score.train_filter(df, segments), segments)
        claimed[bits] = float((model.levels(never) > 0).mean())
    assert claimed[64] < 0.001 and 0.05 < claimed[5] < 0.25
