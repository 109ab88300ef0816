"""The operators of the llm subpackage against brute force, on a table with every odd case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from palisade.llm import bpe, classifier, components, dictionary, fingerprint, licenses, lm_score, mixing, quality_rules, sharding, simhash, token_count
from palisade.llm.queries import tokenizer_path
from pyspark.sql import functions as F

WORDS = "the and of that tion ing ere onde wha lin stre ble our ent ous 12 3.5 ## && é ñandú größe 你好 😀 don't it's LICENSE".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "  ", ". ", ", "]) for _ in range(n))


def _rows():
    rng = random.Random(7)
    rows = [(i, _text(rng, rng.randint(0, 120)), "en", f"src{min(i % 7, 3)}", 1) for i in range(120)]
    near = _text(rng, 300).split(" ")
    for i in range(200, 206):
        near[i % len(near)] += "x" if i % 2 else ""
        rows.append((i, " ".join(near), "de", "src0", 1))
    rows += [(i, rows[3][1], "en", "src0", 1) for i in range(300, 312)]  # exact copies
    rows += [rows[5], rows[5]]  # the same row again
    rows += [(400, None, None, None, None), (401, "", "en", "src1", 0), (402, " \n\t ", "en", "src1", 0), (None, "a null id with some words in it", "en", "src2", 1)]
    rows += [(403, "one", "en", "src2", 1), (404, "A b", "fr", None, 1), (405, "x" * 60_000, "en", "src2", 1), (406, _text(rng, 12_000), "en", "src3", 1)]
    rows += [(407, "wide  space　   here <|endoftext|> and ▁ there\x1c", "en", "src3", 1), (408, "same words same words same words same words " * 9, "en", "src1", 1)]
    rows += [(409, "Released under the MIT License. And more.", "en", "src1", 1), (410, "no\x00nul", "en", "src1", 1)]
    return rows


ROWS = _rows()
#: Names that the operators use inside or return.
CLASHES = ("n_words", "kept", "words", "mix_size", "mix_copies", "fp", "row", "score", "bucket", "shard", "palisade_row", "clean_text", "part", "block", "stats")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "e")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def raw(text):
    return (text or "").encode()


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", raw(text))


def by_row(rows, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in rows)


def test_quality_rules(docs, empty):
    order, measured = quality_rules.plan_cascade(docs, sample_rows=50)
    assert sorted(order) == sorted(measured)

    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        counts = collections.Counter(grams)
        covered = {k for i, g in enumerate(grams) if counts[g] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    got = quality_rules.judge(docs, order).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_row(got, "doc_id", *columns) == collections.Counter((i, *brute(t)) for i, t, *_ in ROWS)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert set(got[0].asDict()) == {"doc_id", *columns, "base_failed", "kept"}
    kept = quality_rules.keep_good(docs, order)
    assert by_row(kept.collect(), "doc_id") == by_row([r for r in quality_rules.judge(docs, order[::-1]).collect() if r.kept], "doc_id")
    assert kept.columns == docs.columns
    assert by_row(kept.collect(), "doc_id") == collections.Counter((r.doc_id,) for r in got if r.kept)
    assert by_row(kept.collect(), "doc_id") == by_row(quality_rules.keep_good(docs, order[::-1]).collect(), "doc_id")
    assert quality_rules.judge(empty, quality_rules.plan_cascade(empty)[0]).count() == 0


def test_cascade_stops_at_the_first_rejection(spark):
    """A rule after the one that rejects is never evaluated; one before a rule that passes is."""
    fails = F.raise_error(F.lit("asked")).cast("boolean")
    rules = {"short": F.col("n") < 10, "dear": F.when(F.col("n") >= 0, fails)}
    assert [r[0] for r in spark.range(5).toDF("n").select(quality_rules.cascade(rules, ["short", "dear"])).collect()] == ["short"] * 5
    with pytest.raises(Exception, match="asked"):
        spark.range(5).toDF("n").select(quality_rules.cascade(rules, ["dear", "short"])).collect()


def test_sample_of_rules_is_small_at_any_partitioning(spark):
    df = spark.range(0, 40_000, 1, 200).select(F.concat_ws(" ", F.array_repeat(F.lit("word"), 12), "id").alias("text"))
    rows = []
    real = quality_rules.written
    quality_rules.written = lambda sample, name: rows.append(sample.count()) or real(sample, name)
    try:
        order, measured = quality_rules.plan_cascade(df, sample_rows=500)
    finally:
        quality_rules.written = real
    assert 300 < rows[0] < 800 and order[0] == max(measured, key=lambda x: (measured[x][1] + 0.5 / rows[0]) / measured[x][0])


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        ids = model.encode(t or "", add_special_tokens=False).ids
        text = model.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    for frequent in (0, 20, 10_000):  # every word asked for, some, none
        got = bpe.encode_decode(docs, path, frequent=frequent, words_per_bucket=40).collect()
        assert by_row(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encode_decode(empty, path).count() == 0
    with pytest.raises(ValueError):
        bpe.check_model(tokenizer_path("word_bpe_49k.json"))


def test_dictionary_blocks(docs, monkeypatch):
    for name, value in (("BLOCK_RARE", 10), ("CHUNK", 3), ("BOUND", 40), ("ROW_WORDS", 7)):
        monkeypatch.setattr(dictionary, name, value)  # in local mode workers fork with these
    numbers = np.array([0, 1, 255, 256, 2**40], np.uint64)
    assert (dictionary.unpack_numbers(dictionary.pack_numbers(numbers)) == numbers).all()
    words = [b"", b"a", "é".encode(), b"x" * 300]
    assert dictionary.unpack_words(dictionary.pack_words(words)) == words
    ragged = dictionary.Ragged.of([[1, 2], [], [3]])
    assert ragged.take(np.array([2, 0, 1])).flat.tolist() == [3, 1, 2]


def test_long_words(spark, tmp_path, monkeypatch):
    """Megabyte-long words are neither sent to all workers nor held in large numbers, and every count stays exact."""
    import sentencepiece
    from tokenizers import Tokenizer

    long = ["".join(random.Random(i).choices("abcdef0123", k=400_000)) for i in range(4)]
    rows = [(i, " ".join(["the of", long[i % 4], "and"] * 2)) for i in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    for name, value in (("BOUND_BYTES", 500_000), ("ROW_BYTES", 500_000)):
        monkeypatch.setattr(dictionary, name, value)
    table = dictionary.word_table(df.select(F.col("text").cast("binary")), lm_score.tokens, lambda w, c: dictionary.Ragged(np.ones(len(w), np.int64), c.astype(np.int64)), 2)
    counts = collections.Counter(w for _, t in rows for w in lm_score.tokens(t.encode()))
    held = [dict(zip(dictionary.unpack_words(r.words), dictionary.unpack_numbers(r.counts).tolist(), strict=True)) for r in table.collect()]
    assert sum(map(collections.Counter, held), collections.Counter()) == counts and max(sum(map(len, h)) for h in held if len(h) > 1) <= 500_000
    words, _ = dictionary.frequent_words(table)
    assert set(words) == {w for w in counts if len(w) <= 64}
    path = tokenizer_path("piece_bpe_32k.model")
    assert all(len(x) <= 64 for x in token_count.frequent_pre_tokens(df))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, path).collect()} == {i: len(model.encode(t)) for i, t in rows}
    path = tokenizer_path("byte_bpe_50k.json")
    ids = {t: hashlib.sha256(np.array(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for t in {t for _, t in rows}}
    assert {r.doc_id: r.ids_sha256 for r in bpe.encode_decode(df, path).collect()} == {i: ids[t] for i, t in rows}


def test_ids_of_any_type(spark, tmp_path):
    """A string or a date serves as doc_id in every operator; with strings the results are those of the same longs."""
    rows = [(str(i), t, "en", s, 1) for i, t, _, s, _ in ROWS[:40] if i is not None] + [(None, "a null id", "en", "src1", 1)]
    spark.createDataFrame(rows, SCHEMA.replace("doc_id bigint", "doc_id string")).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    longs = df.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    longs.write.parquet(str(tmp_path / "l"))
    longs = spark.read.parquet(str(tmp_path / "l"))
    dates = longs.withColumn("doc_id", F.date_add(F.lit("2020-01-01"), F.col("doc_id").cast("int")))
    labels = longs.select("doc_id", F.lit(1).alias("quality"))
    for run, clear in (
        (licenses.scan, str), (lambda x: quality_rules.judge(x, list(quality_rules.READS)), str), (lambda x: bpe.encode_decode(x, tokenizer_path("byte_bpe_50k.json")), str),
        (lambda x: classifier.score_documents(x, labels.select(F.col("doc_id").cast(x.schema["doc_id"].dataType) if x is not dates else F.lit(None).cast("date").alias("doc_id"), "quality")), None),
        (fingerprint.fingerprint_documents, None), (sharding.shard_documents, str), (simhash.near_duplicates, None),
        (lambda x: token_count.count_tokens(x, tokenizer_path("piece_bpe_32k.model")), str), (lambda x: mixing.mix(x, keep=["doc_id"]), str), (lm_score.score_texts, str),
    ):
        got, want = run(df), run(longs)
        assert got.schema["doc_id"].dataType.simpleString() == "string"
        columns = [c for c in got.columns if not (clear is None and c not in ("held_out", "score", "n_chars", "fingerprint"))]
        plain = lambda rows: collections.Counter(tuple(str(round(r[c], 9) if isinstance(r[c], float) else r[c]) for c in columns) for r in rows)  # noqa: B023, E731
        assert plain(got.collect()) == plain(want.collect())
        assert run(dates).count() == len(rows)


def test_classifier(spark, docs, empty):
    rng = random.Random(1)
    good = [(i, _text(rng, 80)) for i in range(1000, 1200)]
    bad = [(i, "spam %%% " * rng.randint(20, 60)) for i in range(1200, 1300)]
    rows = [(i, t, "en", "s", 1) for i, t in good + bad]
    df = spark.createDataFrame(rows + ROWS, SCHEMA)
    labels = [(i, int(i < 1200), 0) for i, _ in good + bad] + [(5, None, None), (None, 1, 0), (99999, 1, 0), (1000, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = classifier.score_documents(df, labels).collect()
    assert len(got) == len(rows) + len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str("null" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id and 1000 <= r.doc_id < 1300]
    assert np.mean([r.predicted == int(r.doc_id < 1200) for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {(r.doc_id, round(r.score, 9)) for r in classifier.score_documents(df, flipped).collect()}
    assert again == {(r.doc_id, round(r.score, 9)) for r in got}  # held-out labels are never read
    kept = classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(ROWS)
    nothing = classifier.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert classifier.score_documents(empty, labels).count() == 0
    fitted = classifier.isotonic(np.array([1.0, 0.0, 2.0, 1.0]), np.array([1.0, 1.0, 2.0, 2.0]))
    assert (np.diff(fitted) >= 0).all()


def test_classifier_against_dense_solution(spark, tmp_path):
    """Scores equal those of the normal equations of the whole matrix, solved at once, and an isotonic fit by its max-min
    formula; the random features rank as exact kernel ridge does."""
    rng = random.Random(6)
    rows = [(i, _text(rng, 60) if i % 3 else "spam %%% buy " * rng.randint(4, 30) + _text(rng, 20)) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0 and rng.random() < 0.9)) for i, _ in rows], "doc_id bigint, quality int")
    y_of = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r.score for r in classifier.score_documents(df, labels).collect()}
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i, _ in rows])
    x, y = np.array([classifier.statistics(t.encode()) for _, t in rows]), np.array([float(y_of[i]) for i, _ in rows])
    fit = fold != 1
    z = np.clip((x - x[fit].mean(axis=0)) / np.sqrt(np.maximum(x[fit].var(axis=0), 1e-8)), -4, 4)
    draw = np.random.default_rng(42)
    waves = draw.normal(size=(x.shape[1], 256)) * 0.25
    features = np.hstack([np.ones((len(x), 1)), np.cos(z @ waves + draw.uniform(0, 2 * math.pi, 256)) * math.sqrt(2 / 256)])
    penalty = np.diag([1e-6] + [1.0] * 256)
    weights = lambda rows: np.linalg.solve(features[rows].T @ features[rows] + penalty, features[rows].T @ y[rows])
    raw, unseen = features @ weights(fit), np.where(fold == 0, features @ weights(fold == 2), features @ weights(fold == 0))
    at = np.clip(((unseen[fit] + 0.5) / 2 * 400).astype(int), 0, 399)
    used = np.unique(at)
    n, good = np.array([(at == k).sum() for k in used]), np.array([y[fit][at == k].sum() for k in used])
    mean = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()
    steps = [max(min(mean(a, b) for b in range(k, len(used))) for a in range(k + 1)) for k in range(len(used))]
    want = np.clip(np.interp(raw, -0.5 + (used + 0.5) * 2 / 400, steps), 0, 1)
    assert np.allclose([got[i] for i, _ in rows], want, atol=1e-6)
    kernel = np.exp(-0.5 * 0.25**2 * ((z[:, None, :] - z[None, fit, :]) ** 2).sum(axis=2))
    centred = y[fit] - y[fit].mean()
    exact = kernel @ np.linalg.solve(kernel[fit] + np.eye(fit.sum()), centred) + y[fit].mean()
    assert np.corrcoef(exact, raw)[0, 1] > 0.95


def _sums(parts):
    """The fingerprint of these members by sums of whole numbers, apart from the operator's own."""
    count, full, signed, seen, all64 = 0, [0] * 8, [0] * 256, collections.Counter(), (1 << 64) - 1
    for x in parts:
        d = hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=32).digest()
        w = [int.from_bytes(d[4 * k : 4 * k + 4], "little") for k in range(8)]
        count, full = count + 1, [(a + b) % 2**32 for a, b in zip(full, w, strict=True)]
        z = ((w[0] << 32 | w[1]) + seen[x] * 0x9E3779B97F4A7C15) & all64  # each occurrence by itself
        seen[x] += 1
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & all64
        z = (z ^ z >> 27) * 0x94D049BB133111EB & all64
        z ^= z >> 31
        signed[z % 256] += -1 if z >> 32 & 1 else 1
    width = 2 if max(map(abs, signed)) < 2**15 else 4
    return (count.to_bytes(4, "little") + b"".join(a.to_bytes(4, "little") for a in full) + b"".join((a % 2 ** (8 * width)).to_bytes(width, "little") for a in signed)).hex()


def test_likeness_of_long_texts():
    """At ten thousand members the estimate tells an edited text from another one, and is near the true share."""
    rng = random.Random(12)
    make = lambda n: "\n".join(f"line {rng.random()} {k}" for k in range(n))
    for n in (30, 1000, 10_000):
        near, far = [], []
        for _ in range(6):
            a, b = make(n), make(n)
            new = fingerprint.edited(a, b)
            x, y = set(fingerprint.members(a)), set(fingerprint.members(new))
            near.append(fingerprint.fingerprint(a).likeness(fingerprint.fingerprint(new)) - len(x & y) / len(x | y))
            far.append(fingerprint.fingerprint(a).likeness(fingerprint.fingerprint(b)))
        assert abs(np.mean(near)) < 0.1 and np.max(np.abs(near)) < 0.2 and np.mean(far) < 0.1


def test_cuts_follow_content():
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefghij0123456789", k=50_000))
    whole, moved = fingerprint.members(text), fingerprint.members("an" + text[:20_000] + "zz" + text[20_000:])
    assert "".join(whole) == text and len(whole) > 100 and max(map(len, whole)) <= 17 * fingerprint.LONG
    assert len(set(whole) - set(moved)) <= 4
    assert "".join(fingerprint.members("x" * 60_000)) == "x" * 60_000


def test_null_and_equal_ids_share_no_bucket(spark, tmp_path):
    rows = [(None, f"null {i}") for i in range(200)] + [(7, f"seven {i % 3}") for i in range(200)] + [(i, f"text {i}") for i in range(50)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    placed = fingerprint.with_follower(df, rows_per_bucket=20).where("not guest").groupBy("bucket").count().collect()
    assert len(placed) > 12 and max(r["count"] for r in placed) < 100
    got = fingerprint.fingerprint_documents(df, rows_per_bucket=20).collect()
    assert by_row(got, "doc_id", "n_chars") == collections.Counter((i, len(t)) for i, t in rows)


def test_fingerprint(spark, docs, empty):
    import xxhash

    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), seed=42)).astype(np.int64)
    order = sorted([(i, t or "") for i, t, *_ in ROWS], key=lambda x: (x[0] is None, -(x[0] or 0), -signed(x[1])))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        new = fingerprint.edited(t, order[(k + 1) % len(order)][1])
        want[(i, len(t), hashlib.sha256(new.encode()).hexdigest(), _sums(fingerprint.members(t)), _sums(fingerprint.members(new)))] += 1
    for rows in (4, 10_000):
        got = fingerprint.fingerprint_documents(docs, rows_per_bucket=rows).collect()
        assert by_row(got, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint") == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got])
    assert fingerprint.fingerprint_documents(empty).count() == 0
    alone = fingerprint.fingerprint_documents(spark.createDataFrame(ROWS[:1], SCHEMA)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    a, b = "one line\ntwo line\nthree", "three\none line\ntwo line"
    assert str(fingerprint.fingerprint(a)) == str(fingerprint.fingerprint(b)) != str(fingerprint.fingerprint(a + "\nfour"))
    f = fingerprint.fingerprint(a + "\nfour").change([fingerprint.digest("four")], -1)
    assert str(f) == str(fingerprint.fingerprint(a))


def test_sharding(docs, empty):
    for per in (1, 1000):
        got = sharding.shard_documents(docs, 16, rows_per_bucket=per).collect()
        assert by_row(got, "doc_id", "size", "text_crc32") == collections.Counter((i, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t, *_ in ROWS)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        shard_of = {}
        assert all(shard_of.setdefault(r.doc_id, r.shard) == r.shard for r in got)
    assert sharding.shard_documents(empty).count() == 0


def test_equal_rows_are_counted_before_the_shuffle(spark):
    row = F.lit("one text").alias("text")
    df = spark.range(150_000).select(F.lit(7).alias("doc_id"), row).unionByName(spark.range(50).select(F.col("id").cast("int").alias("doc_id"), row))
    got = sharding.shard_documents(df)
    bounds = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("z")).collect()
    assert sum(r.n for r in bounds) == 150_050 and all((r.d, r.a, r.z) == (r.n, 0, r.n - 1) for r in bounds)
    assert got.where("doc_id = 7").select("shard").distinct().count() == 1


def test_jump_moves_only_to_the_new_shard(spark):
    ids = spark.range(4000)
    shards = ids.select(*[sharding.jump(F.col("id").cast("string"), n).alias(f"s{n}") for n in (1, 2, 7, 8, 100, 101)]).collect()
    assert all(r.s1 == 0 and r.s8 in (r.s7, 7) and r.s101 in (r.s100, 100) for r in shards)
    counts = collections.Counter(r.s8 for r in shards)
    assert len(counts) == 8 and min(counts.values()) > 400


def _simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw(text).lower())
    if not w:
        return 0
    import xxhash

    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = {t: _simhash(t) for _, t, *_ in ROWS}
    assert by_row(got, "doc_id", "fingerprint") == collections.Counter((i, f"{prints[t]:016x}") for i, t, *_ in ROWS)
    values = sorted(set(prints.values()))
    up = list(range(len(values)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        least[top(values.index(prints[t]))].append(i)
    want = collections.Counter((i, min([x for x in least[top(values.index(prints[t]))] if x is not None], default=None)) for i, t, *_ in ROWS)
    assert by_row(got, "doc_id", "component_id") == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(min((x for x in v if x is not None), default=None) for v in least.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    values = []
    for base in rng.integers(0, 2**63, 30):
        for _ in range(12):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(k)
            values.append(x)
    v = np.unique(np.array(values, np.uint64))
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
    i, j = simhash.near_pairs(v, v, radius)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(near)), strict=True))


def test_hot_bucket_is_split(spark):
    rng = random.Random(2)
    values = {(7 << 48) | rng.getrandbits(16) for _ in range(400)}  # all agree on three blocks
    df = spark.createDataFrame([(x,) for x in values], "fp bigint")
    edges = {frozenset((r.a, r.b)) for r in simhash.links(df, 3, split=64).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in map(tuple, edges))
    whole = components.components(df.alias("x").crossJoin(df.alias("y")).where("bit_count(x.fp ^ y.fp) BETWEEN 1 AND 3").selectExpr("x.fp AS a", "y.fp AS b"))
    found = components.components(spark.createDataFrame([tuple(x) for x in edges], "a bigint, b bigint"))
    assert {(r.node, r.root) for r in found.collect()} == {(r.node, r.root) for r in whole.collect()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (7, 6), (300, 299)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_token_counts(docs, empty):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = collections.Counter((i, len(raw(t)), len(model.encode(t or ""))) for i, t, *_ in ROWS)
    for frequent in (3, 10_000):
        got = token_count.count_tokens(docs, path, limit=100, frequent=frequent).collect()
        assert by_row(got, "doc_id", "n_bytes", "n_tokens") == want and all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_count.count_tokens(empty, path).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs, block_rows=4, fan_in=3).collect()
    again = mixing.mix(docs.repartition(3), block_rows=4, fan_in=3).collect()
    columns = ("doc_id", "mix_size", "mix_source_size", "mix_target", "mix_copies")
    assert by_row(got, *columns) == by_row(again, *columns)
    sizes, weights = collections.Counter(), {}
    for _, t, _, s, _ in ROWS:
        sizes[s] += len(split(t))
    for k, s in enumerate(sorted(sizes, key=lambda x: (x is None, x))):
        weights[s] = (3, 1, 2)[k % 3]
    total, free, targets = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = (total - sum(targets.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not over:
            break
        targets |= {s: 2 * sizes[s] for s in over}
        free -= over
    targets |= {s: level * weights[s] for s in free}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert math.isclose(r.mix_target, targets[r.source]) and r.mix_source_size == sizes[r.source] and 0 <= r.mix_copies <= 2
        taken[r.source] += r.mix_copies * r.mix_size
        largest[r.source] = max(largest[r.source], r.mix_size)
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)
    out = mixing.mixed(docs, block_rows=4, fan_in=3)
    assert out.columns == docs.columns and out.count() == sum(r.mix_copies for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_lm_scores(docs, empty):
    tokens = lambda t: [*raw(t).lower().split(), b"\n"]
    key = lambda i: str("null" if i is None else i).encode()
    c, pairs = collections.Counter(), collections.Counter()
    for i, t, *_ in ROWS:
        if zlib.crc32(key(i)) % 5 != 1:
            x = tokens(t)
            c.update(x)
            pairs.update(zip([b"\n", *x], x, strict=False))
    n = sum(c.values())
    base = n + 0.5 * (len(c) + 1)
    level = lambda k: (2 ** (k.bit_length() - 1) + 2 ** k.bit_length() - 1) / 2 if k else 0.0  # noqa: E731  the middle of the counts of a level
    texts = collections.defaultdict(set)
    for i, t, *_ in ROWS:
        texts[i].add(t)
    scores = []
    wide = {"bits_per_token": 64}
    for how in (wide, wide | {"frequent": 5, "words_per_bucket": 30}, wide | {"broadcast_bytes": 64, "words_per_bucket": 30}, {}, {"broadcast_bytes": 0}, {"bits_per_token": 5}):
        got = lm_score.score_texts(docs, **how).collect()
        want = collections.Counter((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, zlib.crc32(key(i)) % 5 == 1) for i, t, *_ in ROWS)
        assert by_row(got, "doc_id", "n_tokens", "n_known", "train_tokens", "held_out") == want
        near = []
        for r in got:
            (t,) = texts[r.doc_id]
            x = tokens(t)
            assert abs(r.base_score - sum(math.log10((c[w] + 0.5) / base) for w in x)) < 1e-6 * len(x)
            exact = sum(math.log10((min(level(pairs[(v, w)]), level(c[v])) + 8 * (level(c[w]) + 0.5) / base) / (level(c[v]) + 8)) for v, w in zip([b"\n", *x], x, strict=False))
            near.append(abs(r.score - exact) / len(x))
        assert np.mean(near) < (0.1 if how.get("bits_per_token") == 5 else 0.02)  # a small corpus has 64 bits a token
        scores.append(collections.Counter((r.doc_id, round(r.score, 6)) for r in got))
    # the same filter answers alike, broadcast or asked by segment
    assert scores[0] == scores[1] == scores[2] == scores[3] == scores[4]
    assert lm_score.score_texts(empty).count() == 0


def test_filter_never_loses_a_count(spark):
    segments = lm_score.Segments(5000)
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"w%d" % k for k in rng.zipf(1.5, 200) % 300) for _ in range(20)]
    table = lm_score.train_filter(spark.createDataFrame([(x,) for x in texts], "text binary"), segments)
    model = lm_score.Filter(table, segments)
    counts = collections.Counter()
    for x in texts:
        ones, pairs = lm_score.n_grams(lm_score.word_hashes(lm_score.tokens(x)))
        counts.update(pairs.tolist())
        counts.update(ones.tolist())
    keys = np.array(list(counts), np.uint64)
    level = model.levels(keys)
    want = lm_score.levels_of(np.array([counts[int(k)] for k in keys]))
    assert (level >= want).all() and np.mean(level > want) < 0.1


def _holds(template, found, threshold):
    """Does any passage of the template's length hold enough of its shingles? Every start is tried."""
    w = licenses.words(template.encode())
    wanted = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    at = [i for i, g in enumerate(grams) if g in wanted]
    return any(len({grams[j] for j in at if i <= j < i + len(w)}) >= threshold * len(wanted) for i in at)


def _damaged(rng, words, share):
    out = []
    for w in words:
        kind = rng.random()
        if kind < share / 3:
            out.append("changed")
        elif kind < 2 * share / 3:
            out += ["inserted", w]
        elif kind >= share:
            out.append(w)
    return out


def test_licenses_against_every_window():
    """Licenses of damaged passages in running text, held against a search of all windows: none too many, recall 0.9 at least."""
    rng, scanner = random.Random(4), licenses.Scanner()
    all_templates = licenses.TEMPLATES + licenses.TEXTS
    found = missed = 0
    for _ in range(12):
        for _, text in all_templates:
            words = _damaged(rng, text.split(), rng.choice([0.0, 0.01, 0.03, 0.05]))
            around = [rng.choice(WORDS[:15]) for _ in range(rng.randint(0, 60))]
            raw = " ".join([*around, *words, *around]).encode()
            got = {m[0] for m in scanner.matches(raw)}
            want = {name for name, x in all_templates if _holds(x, licenses.words(raw), 0.8)}
            assert got <= want
            found, missed = found + len(want), missed + len(want - got)
    assert found > 150 and missed <= 0.02 * found


def test_licenses(docs, empty):
    got = licenses.scan(docs).collect()
    assert {r.doc_id: r.licenses for r in got if r.licenses} == {409: ["MIT"]} and len(got) == len(ROWS)
    twice = " ".join([dict(licenses.TEXTS)["ISC"], "and then some other words", dict(licenses.TEXTS)["ISC"]])
    spans = [m for m in licenses.Scanner(licenses.TEXTS).matches(twice.encode()) if m[0] == "ISC"]
    assert [m[3] for m in spans] == [1.0, 1.0] and spans[0][1] == 0 and spans[0][2] + 5 == spans[1][1]
    assert licenses.scan(empty).count() == 0
    assert (1 - 0.6**2) ** licenses.bands(0.6, 2, 1e-3) <= 1e-3
